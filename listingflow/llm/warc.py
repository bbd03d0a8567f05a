"""Deterministic, sharded WARC files: range-sorted records, regenerated headers and digests.

Payload digests and the first page of each group of equal payloads come from slim columns.
These decisions travel beside the pages through one exchange by ranges, so the payload moves
once and a page meets its decision as the row before it.  The ranges come from a sample that
hashes of the rows pick, so shards, names and bytes depend on the pages alone, not on how they
are stored or on a run's random numbers.  Each task writes one shard's gzip-member records to
files under temporary names and starts a new file when the compressed size reaches
``file_bytes``.  The manifest holds the files of successful attempts only; a second job renames
them, which may be repeated, and what lost attempts left goes with the temporary folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import settle
from .common import by_batch, ship, store, to_batch

ship(__name__)

FILE_BYTES, LEVEL, DATE, MIN_BYTES = 256 << 20, 6, "1970-01-01T00:00:00Z", 0
#: Payload bytes of a shard; beyond ``MAX_SHARDS`` of them shards grow.  ``SAMPLE`` rows a shard place the bounds.
SHARD_BYTES, MAX_SHARDS, SAMPLE = 32 << 20, 20_000, 20
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs
RECORD_DDL = (
    "page_id long, record_type string, url string, record_id string, refers_to long, refers_to_record string, "
    "payload_bytes long, payload_digest string, digest_ok boolean, payload binary"
)
RECORD = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("record_id", pa.string()),
    ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary()),
])
FILE = pa.schema([
    ("part", pa.int64()), ("seq", pa.int64()), ("temporary", pa.string()), ("name", pa.string()), ("bytes", pa.int64()),
    ("records", pa.int64()), ("first_page", pa.int64()), ("last_page", pa.int64()),
])
FILE_DDL = "part long, seq long, temporary string, name string, bytes long, records long, first_page long, last_page long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{digest}/{ordinal}')}>"


def header_value(text: str) -> str:
    """One header line: control characters, which would end it, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def member(fields: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id, url, payload: bytes, refers_to, ordinal: int, date: str, level: int) -> bytes:
    """A response record, or a revisit record without the payload where ``refers_to`` is given."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    return member([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, ordinal)),
        ("WARC-Date", date), ("WARC-Target-URI", None if url is None else header_value(url)),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("WARC-Profile", SAME_PAYLOAD if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest, 0) if revisit else None),
        ("X-Refers-To-Page", refers_to), ("X-Page-Id", page_id), ("X-Payload-Length", len(payload)),
    ], block, level)


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, digest, size) of every page."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("size"))


def first_pages(slim: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload an earlier page has."""
    slim = slim.filter(F.col("page_id").isNotNull() & (F.col("size") >= min_bytes)).select("page_id", "digest")
    shared = settle(
        slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    return slim.join(shared, "digest").filter("page_id <> refers_to").distinct()


def range_key() -> Column:
    """A text that sorts as (page_id, digest) does, null ids first."""
    place = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), place), F.lit("0")), F.hex("digest"))


def shard_bounds(slim: DataFrame, shard_bytes: int) -> list[str]:
    """First keys of all shards but the first, about ``shard_bytes`` of payload apart.

    About ``SAMPLE`` keys a shard are picked by their hash and collected, at most
    ``SAMPLE * MAX_SHARDS`` or so; the payload between them is summed over all rows.
    """
    size, n = slim.agg(F.sum("size"), F.count(F.lit(1))).first()
    shards = min(-(-(size or 0) // shard_bytes), MAX_SHARDS)
    if shards < 2:
        return []
    stride = max(n // (shards * SAMPLE), 1)
    some = slim.filter(F.pmod(F.xxhash64("page_id", "digest"), F.lit(stride)) == 0)
    keys = sorted(r["key"] for r in some.select(range_key().alias("key")).distinct().collect())
    between = np.zeros(len(keys) + 1)
    for place, held in slim.groupBy(shard_number(keys).alias("place")).agg(F.sum("size")).collect():
        between[place] = held
    shard = (np.cumsum(between) - between / 2) * shards // max(between.sum(), 1)
    return [key for key, last, now in zip(keys, shard, shard[1:]) if now != last]


def shard_number(bounds: list[str]) -> Column:
    """The shard of a row of (page_id, digest)."""
    if not bounds:
        return F.lit(0)

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, "S57"), keys.to_numpy().astype("S57"), "right").astype(np.int32))

    return find(range_key())


def write_warc(
    pages: DataFrame, folder: str, *, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE,
    prefix: str = "pages", level: int = LEVEL, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write (page_id, url, html) as WARC files in ``folder``; returns the manifest as a table.

    A null html is an empty payload, a null url has no target header.  Of equal payloads of at
    least ``min_bytes`` bytes the one with the smallest page_id is the response, the others
    revisit it; of repeated rows the first is the response.  Pages with a null page_id sort
    first and are responses.  Other columns are ignored; an empty table writes no file.  The
    same pages give the same files, however they are stored.
    """
    schema = pages.sparkSession.createDataFrame([], "page_id long, url string, html string").schema
    pages = pages.select(*(F.col(f.name).cast(f.dataType) for f in schema))
    rows = pages.select(
        "page_id", F.unhex(F.sha1(F.coalesce("html", F.lit("")))).alias("digest"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("refers_to"), "url", "html",
    )
    slim = settle(digests(pages))
    bounds = shard_bounds(slim, shard_bytes)
    told = first_pages(slim, min_bytes).select(
        "page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        out, state = None, {}

        def close():
            nonlocal out
            out.close()
            out = None
            return tuple(state[f.name] for f in FILE)

        def files():
            nonlocal out, state
            seq, key, refers, ordinal = 0, None, None, 0
            for batch in batches:
                for page_id, digest, kind, target, url, html, shard in zip(*(batch.column(i) for i in range(7))):
                    page_id, digest, part = page_id.as_py(), digest.as_py(), shard.as_py()
                    if (page_id, digest) != key:
                        key, refers, ordinal = (page_id, digest), None, 0
                    if not kind.as_py():
                        refers = target.as_py()
                        continue
                    payload = (html.as_py() or "").encode()
                    again = page_id if ordinal and page_id is not None and len(payload) >= min_bytes else None
                    data = page_record(page_id, url.as_py(), payload, refers if refers is not None else again, ordinal, date, level)
                    ordinal += 1
                    if out is None:
                        name = f"{prefix}-{part:05d}-{seq:05d}.warc.gz"
                        state = {"part": part, "seq": seq, "temporary": f"_temporary/{uuid.uuid4().hex}.warc.gz", "name": name,
                                 "bytes": 0, "records": 0, "first_page": page_id}
                        out = fs.open_output_stream(f"{root}/{state['temporary']}", compression=None)
                        info = f"software: listingflow\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
                        start = member([
                            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, name)}>"),
                            ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
                        ], info, level)
                        out.write(start)
                        state["bytes"] += len(start)
                        seq += 1
                    out.write(data)
                    state["bytes"] += len(data)
                    state["records"] += 1
                    state["last_page"] = page_id
                    if state["bytes"] >= file_bytes:
                        yield close()
            if out is not None:
                yield close()

        yield from by_batch(files(), FILE)

    both = rows.unionByName(told).withColumn("shard", shard_number(bounds))
    ordered = both.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("page_id", "digest", "kind", "url")
    written = settle(ordered.mapInArrow(write, FILE_DDL))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, root = store(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist()):
                # A repeated attempt finds the file in its place.
                if fs.get_file_info(f"{root}/{temporary}").type != FileType.NotFound:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
            yield batch

    spark = pages.sparkSession
    written.mapInArrow(rename, FILE_DDL).drop("temporary").write.parquet(f"{folder}/_manifest")
    fs, root = store(folder)
    if fs.get_file_info(f"{root}/_temporary").type.name == "Directory":
        fs.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{folder}/_manifest")


def records_of(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip-member record of an open file."""
    rest = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            rest = rest or stream.read(size)
            if not rest:
                if parts:
                    raise ValueError("the file ends inside a record")
                return
            parts.append(z.decompress(rest))
            rest = z.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        if not lines[0].startswith("WARC/") or len(body) != int(fields["Content-Length"]) + 4:
            raise ValueError(f"not a whole record: {lines[0]}")
        yield fields, body[:-4]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of all files of the manifest, digests computed anew; a revisit has no payload of its own."""
    manifest = spark.read.parquet(f"{folder}/_manifest").select("name")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for fields, block in records_of(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        ok = fields["WARC-Block-Digest"] == f"sha1:{sha1_base32(block)}"
                        page, first = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                        if fields["WARC-Type"] == "revisit":
                            n, digest, payload = int(fields["X-Payload-Length"]), said, None
                        else:
                            n, digest = len(payload), sha1_base32(payload)
                            ok = ok and digest == said
                        rows.append((
                            None if page is None else int(page), fields["WARC-Type"], fields.get("WARC-Target-URI"), fields["WARC-Record-ID"],
                            None if first is None else int(first), fields.get("WARC-Refers-To"), n, digest, ok, payload,
                        ))
                        held += len(block)
                        if held > 1 << 24 or len(rows) == 4096:
                            yield to_batch(rows, RECORD)
                            rows, held = [], 0
        yield to_batch(rows, RECORD)

    files = manifest.count()
    return manifest.repartition(max(files, 1), "name").mapInArrow(load, RECORD_DDL)
