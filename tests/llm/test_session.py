"""The text operators leave the session as it was."""

from tests.llm.conftest import SF
from tidemark.llm import common, lines, simhash
from tidemark.llm.catalog import QUERIES
from tidemark.operators import volatility as vol
from tidemark.session import SETTINGS, configure


def settings(spark):
    return dict(spark.conf.getAll), {r["key"]: r["value"] for r in spark.sql("SET -v").select("key", "value").collect()}


def test_only_the_packages_settings_are_set(spark):
    configure(spark)
    set_before, all_before = settings(spark)
    common.prepare(spark)
    common.table(spark, SF, "documents")
    QUERIES["op10_lines"](spark, SF).count()
    QUERIES["op11_mixing"](spark, SF).count()
    set_after, all_after = settings(spark)
    assert set_after == set_before
    assert [k for k in all_before if all_after[k] != all_before[k]] == []
    assert not [k for k in SETTINGS if "arrow.max" in k or "CoPartition" in k]


def test_core_joins_over_unions_after_text_operators(spark, documents):
    lines.dedup(documents).count()
    simhash.near_duplicates(documents).count()
    bars = spark.range(300).selectExpr("concat('S', id % 3) AS symbol", "date_add('2020-01-01', CAST(id DIV 3 AS INT)) AS ts",
                                       "100 + sin(id) AS close")
    actuals = vol.realized_targets(bars, 24, 3)
    every = actuals.selectExpr("'oracle' AS forecaster", "symbol", "step", "actual AS pred").union(
        actuals.selectExpr("'bad' AS forecaster", "symbol", "step", "9.0D AS pred")).union(vol.ewma_forecasts(bars, None, 24, 3))
    assert vol.forecast_scores(every, actuals, ["oracle", "ewma", "bad"]).count() == 4
    joined = every.join(actuals, ["symbol", "step"]).groupBy("forecaster").count().collect()
    assert len({r["count"] for r in joined}) == 1 and len(joined) == 3


def test_batches_are_bounded_whatever_the_session_sends():
    import pyarrow as pa

    texts = pa.array(["x" * n for n in (0, 9_000_000, 5_000_000, 5_000_000, *[1] * 700)])
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    parts = list(common.slices([batch.slice(0, 0), batch]))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts.to_pylist()
    assert all(p.num_rows <= common.BATCH_ROWS and (p.num_rows == 1 or p.nbytes <= common.BATCH_BYTES) for p in parts)
    doubled = common.by_slice(lambda c: pa.array([len(x) for x in c.to_pylist()]), texts)
    assert doubled.to_pylist() == [len(x) for x in texts.to_pylist()]
    assert len(common.by_slice(lambda c: pa.array([], pa.int64()), texts.slice(0, 0))) == 0
