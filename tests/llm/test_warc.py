import base64
import hashlib
import struct

import zstandard

from tidemark.llm import common, warc

PAGES = [(1, "http://a/", "<p>same</p>"), (2, "http://b/ x\r\ny", "<p>same</p>"), (3, None, "<p>other é</p>"), (4, "http://d/", ""),
         (5, "http://e/", None), (6, "u", "x\r\n\r\ny" * 300000), (None, "n", "<p>same</p>"), (None, "m", "alone"), (7, "t", "tie"), (7, "t", "tie")]


def brute(pages):
    first = {}
    for key, _, body in pages:
        body = body or ""
        first[body] = max(first.get(body, key), key, key=lambda k: -1 if k is None else k)
    out = []
    for key, _, body in pages:
        raw = (body or "").encode()
        top = first[body or ""]
        out.append((key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if key == top else "revisit", None if key == top else top))
    return sorted(out, key=str)


def frame(spark, rows):
    return common.prepare(spark).createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, archive string")


def test_round_trip(spark):
    records = warc.read(warc.write(frame(spark, PAGES))).collect()
    assert [r.problem for r in records] == [None] * len(PAGES)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str) == brute(PAGES)
    assert {bytes(r.payload) for r in records if r.record_type == "response"} == {(b or "").encode() for _, _, b in PAGES}
    assert warc.read(warc.write(frame(spark, []))).count() == 0


def test_files_and_the_dictionary(spark, tmp_path):
    pages = [(i, f"http://x/{i}", f"<html><head><title>page {i}</title></head><body>{'some shared text ' * 20}{i}</body></html>") for i in range(300)]
    saved = warc.save_files(warc.write(frame(spark, pages)), str(tmp_path)).collect()
    assert len(saved) == len(list(tmp_path.glob("*.warc.zst")))
    content = sorted(tmp_path.glob("*.warc.zst"))[0].read_bytes()
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and zstandard.ZstdDecompressor().decompress(content[8:8 + size])[:4] == b"\x37\xa4\x30\xec"
    got = warc.read_files(spark, f"{tmp_path}/*.warc.zst").collect()
    assert sorted(r.page_id for r in got) == list(range(300)) and not any(r.problem for r in got)


def test_a_raw_dictionary_and_other_skippable_frames():
    records = [warc.record(i, "u", b"payload %d " % i * 50, None, True) for i in range(64)]
    trained = zstandard.train_dictionary(2048, records, k=64, d=8)
    pack = zstandard.ZstdCompressor(dict_data=trained).compress
    raw = struct.pack("<II", 0x184D2A5D, len(trained.as_bytes())) + trained.as_bytes()
    content = raw + pack(records[0]) + struct.pack("<II", 0x184D2A51, 3) + b"abc" + pack(records[1])
    assert [r for _, r in warc.frames(content)] == records[:2]
    assert [r for _, r in warc.frames(b"")] == []


def test_damage_is_reported():
    good = warc.record(1, "u", b"body", None, True)
    assert warc.parse(good)["problem"] is None
    assert warc.parse(None)["problem"] == "damaged frame"
    assert warc.parse(b"nonsense")["problem"] == "no version line"
    assert warc.parse(good.replace(b"WARC-Date: ", b"X-Date: "))["problem"] == "no WARC-Date"
    assert warc.parse(good + b"x")["problem"] == "wrong length"
    assert warc.parse(good.replace(b"body", b"bod!"))["problem"] == "wrong payload"
    assert warc.parse(good.replace(b"WARC-Type: ", b"WARC-Type "))["problem"] == "malformed header"
    revisit = warc.record(1, "u", b"body", 2, False)
    assert warc.parse(revisit)["refers_to"] == 2 and warc.parse(revisit)["payload_bytes"] == 4
    content = warc.archive([good, good])
    whole = [r for _, r in warc.frames(content)]
    assert whole == [good, good]
    cut = [r for _, r in warc.frames(content[:-3])]
    assert cut == [good, None]
    assert [r for _, r in warc.frames(content + b"junk at the end")][-1] is None
