"""Queries over point-in-time fundamentals, the universe and the signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import facts, signals, universe
from tidemark.plans import standins
from tidemark.plans.queries_prices import (
    JUMP_M, PANEL_M, VERDICTS_M, monthly_panel, monthly_verdicts, panel_of, stored_verdicts,
)
from tidemark.plans.registry import (
    FACTS_Q, FACTS_T, FACTS_Y, TICKERS, R, panel_sql, query, rounded,
)

#: End of every study over the stand-in data; later than its last date.
LAST = "2002-12-31"
TAG = "1-URGENT"
SHARE_TAGS = ("1-URGENT", "2-HIGH")
BALANCE = {"ca": "1-URGENT", "cash": "2-HIGH", "cl": "3-MEDIUM", "ta": "5-LOW"}
FORMS = ("F", "O")

ASOFS = "asofs AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS asof FROM lineitem)"
FILINGS = "filings AS (SELECT o_custkey AS cik, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filed FROM orders)"
SUPPLIER_FILINGS = """filings AS (SELECT l_suppkey AS cik, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def asofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of lineitem as formation dates."""
    li = standins.table(spark, sf_dir, "lineitem")
    return li.select(F.trunc(F.to_date("l_shipdate"), "MM").alias("asof")).distinct()


@query(f"""WITH {FACTS_Q}
SELECT cik, "end", val, accn, filed FROM facts_q WHERE tag = '{TAG}' AND filed <= DATE '1998-06-30'
QUALIFY row_number() OVER (PARTITION BY cik ORDER BY "end" DESC, filed DESC, accn DESC) = 1""")
def pit_latest_fact(spark, sf_dir):
    rows = facts.latest_facts(standins.facts_quarterly(spark, sf_dir), TAG, "1998-06-30")
    return rows.select("cik", "end", "val", "accn", "filed")


@query(f"""WITH {FACTS_T}, {ASOFS}
SELECT asof, cik, "end", val, filed FROM asofs JOIN facts_t ON filed <= asof
QUALIFY row_number() OVER (PARTITION BY asof, cik ORDER BY "end" DESC, filed DESC, accn DESC) = 1""")
def pit_facts_panel(spark, sf_dir):
    rows = facts.facts_at(standins.facts_total(spark, sf_dir), ["TOTAL"], asofs(spark, sf_dir), "asof", LAST)
    return rows.select("asof", "cik", "end", "val", "filed")


@query(f"""WITH {FACTS_T}
SELECT cik, "end", val, filed FROM facts_t
QUALIFY row_number() OVER (PARTITION BY cik, "end" ORDER BY filed DESC, accn DESC) = 1""")
def restated_facts(spark, sf_dir):
    rows = facts.restated(standins.facts_total(spark, sf_dir))
    return rows.select("cik", "end", "val", "filed")


@query(f"""WITH {FACTS_Q}
SELECT cik, tag, "end", val FROM facts_q WHERE tag IN ('2-HIGH', '5-LOW')""")
def facts_by_tag(spark, sf_dir):
    rows = facts.read_facts(standins.facts_quarterly(spark, sf_dir), ["2-HIGH", "5-LOW"])
    return rows.select("cik", "tag", "end", "val")


@query(f"""WITH {FILINGS}
SELECT * FROM filings WHERE form IN ('F', 'O') AND filed BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def filings_window(spark, sf_dir):
    return facts.read_filings(standins.filings(spark, sf_dir), FORMS, "1997-01-01", "1998-12-31").select("cik", "form", "filed")


@query(f"""WITH {FILINGS}
SELECT DISTINCT cik FROM filings
WHERE form IN ('F', 'O') AND filed BETWEEN DATE '1998-06-30' - 456 AND DATE '1998-06-30'""")
def alive_filers(spark, sf_dir):
    return facts.alive(standins.filings(spark, sf_dir), "1998-06-30", FORMS)


@query(f"""WITH {FILINGS}, {ASOFS}
SELECT DISTINCT asof, cik FROM asofs JOIN filings ON filed <= asof AND filed >= asof - 456 WHERE form IN ('F', 'O')""")
def alive_panel(spark, sf_dir):
    return facts.alive_at(standins.filings(spark, sf_dir), asofs(spark, sf_dir), FORMS)


@query(f"""WITH {FACTS_T}, {FACTS_Y},
allf AS (
  SELECT cik, start, "end", '10-Q' AS form, val FROM facts_t
  UNION ALL SELECT cik, "end" - 364, "end", '10-K', val FROM facts_y WHERE tag = '5-LOW'
  UNION ALL SELECT cik, NULL, "end", '10-K', val FROM facts_y WHERE tag = '5-LOW'
  UNION ALL SELECT cik, "end" - 180, "end", '10-Q', val FROM facts_y WHERE tag = '5-LOW')
SELECT cik, start, "end", form, val FROM allf
WHERE start IS NOT NULL AND CASE WHEN form = '10-K' THEN "end" - start BETWEEN 340 AND 400
                                 ELSE "end" - start BETWEEN 80 AND 100 END""")
def form_matched_durations(spark, sf_dir):
    cols = ["cik", "start", "end", "form", "val"]
    yearly = standins.facts_yearly(spark, sf_dir).filter(F.col("tag") == "5-LOW")
    rows = (
        standins.facts_total(spark, sf_dir).select(cols)
        .unionByName(yearly.withColumn("start", F.date_sub("end", 364)).select(cols))
        .unionByName(yearly.select(cols))
        .unionByName(yearly.withColumn("start", F.date_sub("end", 180)).withColumn("form", F.lit("10-Q")).select(cols))
    )
    return facts.form_matched_durations(rows)


# Thresholds that split the stand-in suppliers.
_SCREEN = {"min_price": 104.5, "min_adv": 5500.0, "lookback_days": 93}


def _liquid_sql(closes: str) -> str:
    return f"""med_close AS (SELECT asof, symbol, median(close) AS c FROM {closes} GROUP BY 1, 2),
med_volume AS (
  SELECT asof, symbol, median(volume) AS v FROM asofs JOIN bars_m ON ts <= asof AND ts >= asof - 93 GROUP BY 1, 2),
liquid AS (SELECT asof, symbol FROM med_close JOIN med_volume USING (asof, symbol) WHERE c > 104.5 AND c * v > 5500.0)"""


@query(f"""WITH {VERDICTS_M}, {panel_sql(JUMP_M, 2, "ts BETWEEN DATE '1998-06-30' - 103 AND DATE '1998-06-30'")}, {TICKERS},
{SUPPLIER_FILINGS}, asofs AS (SELECT DATE '1998-06-30' AS asof),
seen AS (SELECT asof, symbol, close FROM asofs JOIN truncated ON ts <= asof AND ts >= asof - 93),
{_liquid_sql('seen')},
alive AS (SELECT DISTINCT cik FROM filings WHERE form = 'F' AND filed BETWEEN DATE '1998-06-30' - 30 AND DATE '1998-06-30')
SELECT l.symbol, t.cik FROM liquid l JOIN tickers t ON l.symbol = t.symbol SEMI JOIN alive a ON t.cik = a.cik""")
def universe_on_date(spark, sf_dir):
    return universe.build(
        monthly_verdicts(spark, sf_dir), standins.bars_monthly(spark, sf_dir), standins.supplier_filings(spark, sf_dir),
        standins.tickers(spark, sf_dir), "1998-06-30", **_SCREEN, forms=("F",), alive_days=30, max_jump=JUMP_M, newest=None)


UNIVERSE = f"""{PANEL_M}, {TICKERS}, {SUPPLIER_FILINGS}, {ASOFS},
seen AS (
  SELECT asof, p.symbol, p.close FROM asofs JOIN panel p ON p.ts <= asof AND p.ts >= asof - 93
  WHERE NOT EXISTS (SELECT 1 FROM breaks b WHERE b.symbol = p.symbol AND b.ts > p.ts AND b.ts <= asof)),
{_liquid_sql('seen')},
alive AS (SELECT DISTINCT asof, cik FROM asofs JOIN filings ON filed <= asof AND filed >= asof - 30 WHERE form = 'F'),
universe AS (
  SELECT l.asof, l.symbol, t.cik FROM liquid l JOIN tickers t ON l.symbol = t.symbol
  SEMI JOIN alive a ON t.cik = a.cik AND l.asof = a.asof)"""


def universe_frame(spark: SparkSession, sf_dir: str, verdicts: DataFrame) -> DataFrame:
    return universe.build_at(
        panel_of(verdicts), standins.bars_monthly(spark, sf_dir), standins.supplier_filings(spark, sf_dir),
        standins.tickers(spark, sf_dir), asofs(spark, sf_dir), **_SCREEN, forms=("F",), alive_days=30)


@query(f"WITH {UNIVERSE} SELECT asof, symbol, cik FROM universe")
def universe_panel(spark, sf_dir):
    return universe_frame(spark, sf_dir, monthly_verdicts(spark, sf_dir))


MOMENTUM = f"""{PANEL_M}, {ASOFS},
seen_days AS (
  SELECT DISTINCT asof, p.ts FROM asofs JOIN panel p ON p.ts <= asof
  WHERE NOT EXISTS (SELECT 1 FROM breaks b WHERE b.symbol = p.symbol AND b.ts > p.ts AND b.ts <= asof)),
placed AS (SELECT asof, ts, row_number() OVER (PARTITION BY asof ORDER BY ts DESC) AS back FROM seen_days),
grid AS (
  SELECT f.asof, f.ts AS far, n.ts AS near FROM placed f JOIN placed n ON f.asof = n.asof WHERE f.back = 12 AND n.back = 2),
momentum AS (
  SELECT g.asof, a.symbol, b.close / a.close - 1 AS score
  FROM grid g JOIN panel a ON a.ts = g.far JOIN panel b ON b.ts = g.near AND a.symbol = b.symbol
  WHERE NOT EXISTS (SELECT 1 FROM breaks k WHERE k.symbol = a.symbol AND k.ts > g.far AND k.ts <= g.asof))"""


def momentum_scores(spark: SparkSession, sf_dir: str, verdicts: DataFrame) -> DataFrame:
    return signals.momentum(panel_of(verdicts), asofs(spark, sf_dir), lookback=12, skip=2, last=LAST)


@query(f"WITH {MOMENTUM} SELECT asof, symbol, {R('score', 9)} AS score FROM momentum")
def signal_momentum(spark, sf_dir):
    return rounded(momentum_scores(spark, sf_dir, stored_verdicts(spark, sf_dir)), 9)


@query(f"""WITH {FACTS_Q}, {ASOFS}, {TICKERS},
points AS (SELECT asof, asof AS point, 'now' AS at FROM asofs UNION ALL SELECT asof, asof - 365, 'then' FROM asofs),
known AS (
  SELECT p.asof, p.at, p.point, f.cik, f.tag, f.val, f.filed FROM points p JOIN facts_q f ON f.filed <= p.point
  WHERE f.tag IN ('1-URGENT', '2-HIGH')
  QUALIFY row_number() OVER (PARTITION BY p.asof, p.at, f.cik, f.tag ORDER BY f."end" DESC, f.filed DESC, f.accn DESC) = 1),
usable AS (SELECT * FROM known WHERE val > 0 AND filed >= point - 400),
pairs AS (
  SELECT n.asof, n.cik, n.tag, n.val AS now, t.val AS earlier FROM usable n JOIN usable t
  ON n.asof = t.asof AND n.cik = t.cik AND n.tag = t.tag AND n.at = 'now' AND t.at = 'then'
  QUALIFY row_number() OVER (PARTITION BY n.asof, n.cik ORDER BY n.tag) = 1)
SELECT asof, symbol, {R('-ln(now / earlier)', 9)} AS score FROM pairs JOIN tickers USING (cik)""")
def signal_issuance(spark, sf_dir):
    s = signals.issuance(standins.facts_quarterly(spark, sf_dir), standins.tickers(spark, sf_dir),
                         asofs(spark, sf_dir), LAST, SHARE_TAGS)
    return rounded(s, 9)


@query(f"""WITH {FACTS_Y}, {ASOFS}, {TICKERS},
known AS (
  SELECT a.asof, f.cik, f.tag, f."end", f.val FROM asofs a JOIN facts_y f ON f.filed <= a.asof
  QUALIFY row_number() OVER (PARTITION BY a.asof, f.cik, f.tag, f."end" ORDER BY f.filed DESC, f.accn DESC) = 1),
wide AS (
  SELECT asof, cik, "end", max(val) FILTER (tag = '1-URGENT') AS ca, max(val) FILTER (tag = '2-HIGH') AS cash,
         max(val) FILTER (tag = '3-MEDIUM') AS cl, max(val) FILTER (tag = '5-LOW') AS ta FROM known GROUP BY 1, 2, 3),
complete AS (
  SELECT *, row_number() OVER w AS r, lag("end") OVER v AS end0, lag(ca) OVER v AS ca0, lag(cash) OVER v AS cash0,
         lag(cl) OVER v AS cl0, lag(ta) OVER v AS ta0
  FROM wide WHERE ca IS NOT NULL AND cash IS NOT NULL AND cl IS NOT NULL AND ta IS NOT NULL
  WINDOW w AS (PARTITION BY asof, cik ORDER BY "end" DESC), v AS (PARTITION BY asof, cik ORDER BY "end"))
SELECT asof, symbol, {R('-(((ca - ca0) - (cash - cash0) - (cl - cl0)) / ((ta + ta0) / 2))', 9)} AS score
FROM complete JOIN tickers USING (cik) WHERE r = 1 AND "end" - end0 BETWEEN 330 AND 400 AND (ta + ta0) / 2 > 0""")
def signal_accruals(spark, sf_dir):
    s = signals.accruals(standins.facts_yearly(spark, sf_dir), standins.tickers(spark, sf_dir),
                         asofs(spark, sf_dir), LAST, BALANCE)
    return rounded(s, 9)


@query(f"""WITH {FACTS_T}, {ASOFS}, {TICKERS},
known AS (
  SELECT a.asof, f.cik, f."end", f.val, f.filed FROM asofs a JOIN facts_t f ON f.filed <= a.asof
  WHERE f."end" - f.start BETWEEN 80 AND 100
  QUALIFY row_number() OVER (PARTITION BY a.asof, f.cik, f."end" ORDER BY f.filed DESC, f.accn DESC) = 1),
lagged AS (
  SELECT *, "end" - lag("end", 4) OVER w AS gap, val - lag(val, 4) OVER w AS raw FROM known
  WINDOW w AS (PARTITION BY asof, cik ORDER BY "end")),
diffs AS (SELECT asof, cik, "end", filed, raw AS diff FROM lagged WHERE gap BETWEEN 330 AND 400),
scaled AS (
  SELECT *, stddev_samp(diff) OVER h AS scale, count(*) OVER h AS n, lead("end") OVER w AS later FROM diffs
  WINDOW w AS (PARTITION BY asof, cik ORDER BY "end"),
         h AS (PARTITION BY asof, cik ORDER BY "end" ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT asof, symbol, {R('diff / scale', 7)} AS score FROM scaled JOIN tickers USING (cik)
WHERE later IS NULL AND n >= 4 AND filed >= asof - 60 AND scale > 0""")
def signal_earnings_surprise(spark, sf_dir):
    s = signals.earnings_surprise(
        standins.facts_total(spark, sf_dir), standins.tickers(spark, sf_dir), asofs(spark, sf_dir), LAST, tag="TOTAL")
    return rounded(s, 7)


@query(f"""WITH {PANEL_M}, dates AS (SELECT unnest([DATE '1997-06-01', DATE '1999-01-01']) AS asof)
SELECT d.asof, p.symbol, p.close AS score FROM dates d JOIN panel p ON p.ts = d.asof""")
def signal_per_date(spark, sf_dir):
    panel = monthly_panel(spark, sf_dir)

    def close_on(day):
        return panel.filter(F.col("ts") == F.lit(day).cast("date")).select("symbol", F.col("close").alias("score"))

    return signals.per_date(close_on, ["1997-06-01", "1999-01-01"])
