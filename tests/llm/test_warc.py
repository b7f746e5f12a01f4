import gzip
import hashlib
import time

from pyspark.sql import functions as F

from tidewake.llm import warc
from tidewake.llm.common import shared_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"key": F.lit("x"), "size": F.lit(1)})


def test_round_trip(spark):
    big, same = "é" * 500_000, "y" * 2000
    rows = [(1, "http://a/", big), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "u", same), (9, "u", same), (7, "u", same),
            (5, "u", "short"), (6, "u", "short"), (None, "u", "z" * 1200), (8, "u", "a\r\n\r\nWARC/1.1\r\n"), (9, "u", same)]
    got = warc.archive_round_trip(pages(spark, rows)).collect()
    ends = {}
    bodies = {}
    for r in sorted(got, key=lambda r: r["chunk_no"]):
        assert len(r["data"]) <= warc.CHUNK_BYTES
        bodies.setdefault(r["record_key"], []).append((r["chunk_no"], bytes(r["data"])))
        if r["is_last"]:
            ends.setdefault(r["record_key"], []).append(r)
    assert sum(map(len, ends.values())) == len(rows)
    for key, _, html in rows:
        raw = (html or "").encode()
        for r in ends[None if key is None else str(key)]:
            assert (r["payload_bytes"], r["digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
            revisit = key in (4, 7)
            assert (r["record_type"], r["refers_to"]) == (("revisit", "9") if revisit else ("response", None))
    assert b"".join(d for _, d in bodies["1"]) == big.encode() and len(bodies["1"]) == 16
    assert b"".join(d for _, d in bodies["8"]) == rows[9][2].encode()
    assert b"".join(d for _, d in bodies["4"]) == b""


def test_prefix_digests(spark):
    body = "".join(chr(97 + i % 26) for i in range(200_000))
    got = sorted(warc.archive_round_trip(pages(spark, [(1, "u", body)])).collect(), key=lambda r: r["chunk_no"])
    upto = hashlib.sha1()
    for r in got:
        upto.update(r["data"])
        assert r["digest"] == upto.hexdigest()


def test_archives_are_gzip_members_and_roll_over(spark):
    folder = shared_path(spark, "warc-test")
    rows = [(i, f"http://h/{i}", f"{i}" * 3000) for i in range(20)]
    listed = warc.write_archives(warc.chunk_rows(warc.plan_records(pages(spark, rows).coalesce(1), "page_id", "url", "html")), folder, max_archive=200)
    files = listed.collect()
    assert len(files) > 3 and sum(f["records"] for f in files) == 20
    text = gzip.decompress(open(files[0]["path"], "rb").read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\n")
    assert warc.read_archives(listed, folder).where("is_last").count() == 20


def test_empty(spark):
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_large_payloads_are_hashed_once(spark):
    """The digest stands below the explode in the plan, and 40 MB are cut in seconds."""
    rows = warc.chunk_rows(warc.plan_records(pages(spark, [(1, "u", "x")]), "page_id", "url", "html"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = {word: [i for i, line in enumerate(plan) if word in line] for word in ("Generate", "sha1(")}
    assert len(at["sha1("]) == 1 and at["sha1("][0] > at["Generate"][0]
    big = spark.range(1).select(F.lit(1).alias("key"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789abcdef"), 40 * 65536).cast("binary").alias("payload"),
                                F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    warc.chunk_rows(big).where("last").count()
    start = time.time()
    assert warc.chunk_rows(big).agg(F.sum(F.octet_length("data"))).first()[0] == 40 << 20
    assert time.time() - start < 5
