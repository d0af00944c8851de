"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

An archive is a row (archive, content), the shape Spark's ``binaryFile`` source has, so
archives travel on any file system Spark can read. The writer fills one archive after
another from its partition; each carries a dictionary trained on its own records. The
reader decodes frame by frame and checks the version line, the mandatory headers, the
lengths and the digest of every record; what fails is reported in ``problem``.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import common

#: Payload after which an archive is closed. A record is never cut.
ARCHIVE_BYTES = 2 << 20
#: Dictionary size, and the most that a record lends to its training.
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 8 << 10
#: Date of all records; a fixed one keeps a retried task's output the same.
DATE = "2024-01-01T00:00:00Z"

_DICTIONARY_MAGIC = 0x184D2A5D
_FRAME_MAGIC = 0xFD2FB528
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page: int | None, url: str | None, payload: bytes, response: int | None, is_response: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    headers = {
        "WARC-Type": "response" if is_response else "revisit", "WARC-Record-ID": _urn(page), "WARC-Date": DATE,
        "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    if not is_response:
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _urn(response)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """Records as frames behind their dictionary; too few records to train one go without."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:SAMPLE_BYTES] for r in records], k=256, d=8)
    except zstandard.ZstdError:
        trained = None
    out = []
    if trained is not None:
        held = zstandard.ZstdCompressor().compress(trained.as_bytes())
        out += [struct.pack("<II", _DICTIONARY_MAGIC, len(held)), held]
    packer = zstandard.ZstdCompressor(dict_data=trained) if trained is not None else zstandard.ZstdCompressor()
    return b"".join(out + [packer.compress(r) for r in records])


def frames(content: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(offset, decoded frame) of an archive; None and the end where a frame is damaged."""
    view, at, trained = memoryview(content), 0, None
    while at < len(view):
        if len(view) - at < 8:
            yield at, None
            return
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                yield at, None
                return
            if at == 0 and magic == _DICTIONARY_MAGIC:
                held = bytes(view[8:8 + size])
                if held[:4] == struct.pack("<I", _FRAME_MAGIC):
                    held = zstandard.ZstdDecompressor().decompress(held)
                trained = zstandard.ZstdCompressionDict(held)
            at += 8 + size
            continue
        unpacker = (zstandard.ZstdDecompressor(dict_data=trained) if trained is not None else zstandard.ZstdDecompressor()).decompressobj()
        parts, fed = [], at
        try:
            while not unpacker.eof and fed < len(view):
                parts.append(unpacker.decompress(view[fed:fed + (32 << 10)]))
                fed = min(len(view), fed + (32 << 10))
        except zstandard.ZstdError:
            unpacker = None
        if unpacker is None or not unpacker.eof:
            yield at, None
            return
        yield at, b"".join(parts)
        at = fed - len(unpacker.unused_data)


def parse(raw: bytes | None) -> dict:
    """Fields of one record. ``problem`` says what is wrong with it, the other fields are then as far as known."""
    out = {"page_id": None, "url": None, "record_type": None, "refers_to": None, "payload": None,
           "payload_bytes": None, "payload_digest": None, "problem": None}

    def bad(problem: str) -> dict:
        return out | {"problem": problem}

    if raw is None:
        return bad("damaged frame")
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        return bad("no version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return bad("malformed header")
        headers[name.strip().lower()] = value.strip()
    for name in _MANDATORY:
        if name.lower() not in headers:
            return bad(f"no {name}")
    kind = headers["warc-type"]
    out |= {"page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": kind,
            "refers_to": _page(headers.get("warc-refers-to"))}
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        return bad("malformed Content-Length")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        return bad("wrong length")
    if kind not in ("response", "revisit"):
        return out  # other kinds carry no page
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not found or not size or not stated:
        return bad("malformed block")
    out |= {"payload_bytes": int(size[1]), "payload_digest": stated}
    if kind == "revisit":
        return bad("revisit without its response") if "warc-refers-to" not in headers else out
    out["payload"] = payload
    return bad("wrong payload") if len(payload) != out["payload_bytes"] or digest(payload) != stated else out


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archives (archive, content) with a record for every row of ``pages``.

    Of rows with equal payloads (null: empty) the one with the largest key is the
    response, those with smaller keys are revisits that refer to it; rows that share
    the largest key are all responses. A null key is smaller than any other. Repeated
    rows get a record each, an empty table no archive. Other columns are not read.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), body.alias("body")).withColumn(
        "print", F.concat_ws("-", F.sha1("body"), F.octet_length("body").cast("string")))
    # Copies fold before the exchange, so a payload that most pages share is a row a task.
    first = rows.groupBy("print").agg(F.max("page").alias("response"))
    dealt = rows.join(first, "print").select(
        "page", "url", "body", "response", F.col("page").eqNullSafe(F.col("response")).alias("is_response"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            content = archive(held)
            name = hashlib.sha256(content).hexdigest()[:24] + ".warc.zst"
            return pa.RecordBatch.from_pydict({"archive": pa.array([name]), "content": pa.array([content], pa.binary())})

        for batch in common.slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(*row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return dealt.mapInArrow(fill, "archive string, content binary")


RECORDS = ("archive string, offset long, page_id long, url string, record_type string, refers_to long, payload binary, "
           "payload_bytes long, payload_digest string, problem string")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of archives (archive, content); null content counts as an empty archive, which has none.

    ``payloads=False`` leaves the payload column null once it is checked.
    """
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([
            ("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for at, raw in frames(content.as_py() or b""):
                    one = {"archive": name, "offset": at} | parse(raw)
                    size += len(raw or b"")
                    if not payloads:
                        one["payload"] = None
                    rows.append(one)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return archives.select("archive", "content").mapInArrow(unpack, RECORDS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``.warc.zst`` files, by any path that Spark can read."""
    files = common.prepare(spark).read.format("binaryFile").load(path)
    return read(files.select(F.col("path").alias("archive"), "content"))


def save_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files to ``folder``, which every executor must mount; gives (archive, bytes) when run."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = os.path.join(folder, f".{name}.part")
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, os.path.join(folder, name))
                yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [len(content)]})

    return archives.select("archive", "content").mapInArrow(save, "archive string, bytes long")

