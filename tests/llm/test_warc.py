"""WARC files: round trip, revisits, rolling, repeatability, odd pages."""

import gzip
import hashlib
import os

from listingflow.llm import warc
from listingflow.llm.common import shared_folder, store


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


ROWS = [(5, "http://a/\r\nX: y", "<p>é</p>", 1), (2, "http://b/", "<p>é</p>", 1), (9, None, None, 1), (7, "u", "", 1), (3, "u", "x" * 3_000_000, 1),
        (4, "u", "only", 1), (4, "u", "only", 1), (None, "u", "<p>é</p>", 1), (None, None, None, 1), (11, "u", "<p>é</p>", 1)]


def test_round_trip(spark):
    folder = shared_folder(spark, "warc-test")
    manifest = warc.write_warc(pages_of(spark, ROWS), folder)
    assert sum(r["records"] for r in manifest.collect()) == len(ROWS)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(ROWS) and all(r["digest_ok"] for r in got)
    facts = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in got)
    assert facts == sorted([
        ("2", "response", "None", 9), ("5", "revisit", "2", 9), ("11", "revisit", "2", 9), ("None", "response", "None", 9),
        ("7", "response", "None", 0), ("9", "revisit", "7", 0), ("None", "response", "None", 0),
        ("3", "response", "None", 3_000_000), ("4", "response", "None", 4), ("4", "revisit", "4", 4),
    ])
    by_id = {r["record_id"]: r for r in got}
    assert len(by_id) >= len(ROWS) - 1
    for r in got:
        if r["record_type"] == "revisit":
            first = by_id[r["refers_to_record"]]
            assert first["page_id"] == r["refers_to"] and first["payload_digest"] == r["payload_digest"] and r["payload"] is None
        else:
            assert len(r["payload"]) == r["payload_bytes"]
    assert next(r["url"] for r in got if r["page_id"] == 5) == "http://a/%0D%0AX: y"


def files(folder):
    _, root = store(folder)
    names = sorted(n for n in os.listdir(root) if n.endswith(".warc.gz"))
    return {n: open(f"{root}/{n}", "rb").read() for n in names}


def test_files_roll_are_repeatable_and_gzip(spark):
    rows = [(i, f"http://h/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 40, 0) for i in range(300)]
    made = []
    for _ in range(2):
        folder = shared_folder(spark, "warc-test")
        manifest = warc.write_warc(pages_of(spark, rows).repartition(3), folder, file_bytes=5_000).collect()
        found = files(folder)
        assert {r["name"]: r["bytes"] for r in manifest} == {n: len(b) for n, b in found.items()}
        assert all(r["bytes"] < 6_000 for r in manifest) and len(manifest) > 10
        assert not os.path.exists(f"{store(folder)[1]}/_temporary")
        made.append(found)
    assert made[0] == made[1]
    order = [line for n in sorted(made[0]) for line in gzip.decompress(made[0][n]).split(b"\r\n") if line.startswith(b"X-Page-Id")]
    assert order == [f"X-Page-Id: {i}".encode() for i in range(300)]


def test_shards_depend_on_the_pages_alone(spark):
    # A page of which a third of all rows are copies, null ids, negative ids and equal payloads.
    rows = [(i - 50, f"u{i}", hashlib.sha256(str(i % 70).encode()).hexdigest() * (1 + i % 9), 0) for i in range(200)]
    rows += [(7, "hot", "<p>hot</p>" * 9, 0)] * 150 + [(None, "none", f"n{i}" * 40, 0) for i in range(60)]
    made = []
    for parts, key in ((1, "url"), (5, "url"), (7, "html")):
        folder = shared_folder(spark, "warc-test")
        manifest = warc.write_warc(pages_of(spark, rows).repartition(parts, key), folder, shard_bytes=9_000).collect()
        assert len({r["part"] for r in manifest}) > 4 and sum(r["records"] for r in manifest) == len(rows)
        made.append(files(folder))
        got = warc.read_warc(spark, folder).collect()
        assert len(got) == len(rows) and all(r["digest_ok"] for r in got)
        assert sum(r["record_type"] == "response" and r["page_id"] == 7 for r in got) == 2  # its own page and the hot one
    assert made[0] == made[1] == made[2]
    ids = [line[11:] for n in sorted(made[0]) for line in gzip.decompress(made[0][n]).split(b"\r\n") if line.startswith(b"X-Page-Id")]
    assert [int(x) for x in ids] == sorted(r[0] for r in rows if r[0] is not None)


def test_small_payloads_and_empty_table(spark):
    folder = shared_folder(spark, "warc-test")
    warc.write_warc(pages_of(spark, ROWS), folder, min_bytes=5)
    kinds = sorted((str(r["page_id"]), r["record_type"]) for r in warc.read_warc(spark, folder).collect())
    assert kinds == sorted([("2", "response"), ("5", "revisit"), ("11", "revisit"), ("None", "response"), ("7", "response"), ("9", "response"),
                            ("None", "response"), ("3", "response"), ("4", "response"), ("4", "response")])
    folder = shared_folder(spark, "warc-test")
    assert warc.write_warc(pages_of(spark, []), folder).count() == 0
    assert warc.read_warc(spark, folder).collect() == []
