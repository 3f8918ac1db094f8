"""Large records and large benchmarks in bounded memory; null items."""

from __future__ import annotations

import hashlib
import io
import re
import resource
import subprocess
import sys
import tracemalloc

import pytest
from pyspark.sql import functions as F

from newsdesk.llm import decontaminate, warc


def test_a_record_of_200_mb_is_written_and_read_in_little_memory(tmp_path):
    code = f"""
import hashlib, resource, sys
sys.path.insert(0, {sys.path[0]!r})
from newsdesk.llm import warc
payload = bytes(200 << 20)
with open({str(tmp_path / "big")!r}, "wb") as f:
    warc.write_record(f.write, 1, "u", payload, hashlib.sha1(payload).digest(), None)
del payload
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
resource.setrlimit(resource.RLIMIT_AS, (resource.getrlimit(resource.RLIMIT_AS)[0],) * 2)
with open({str(tmp_path / "big")!r}, "rb") as f:
    assert [p for _, _, p in warc.read_records(f, payloads=False)] == [None]
print(before >> 10, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    before, after = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-2:])
    assert before < 800 and after - before < 40  # MB: the payload once, its reader next to nothing
    tracemalloc.start()
    with open(tmp_path / "big", "rb") as f:
        assert len(list(warc.read_records(f, payloads=False))) == 1
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0


def test_broken_frames_are_told():
    good = warc.record_bytes(1, "u", b"hello", hashlib.sha1(b"hello").digest(), None)
    import zlib

    text = zlib.decompress(good, 31)
    for wrong, said in ((re.sub(rb"Content-Length: (\d+)", lambda m: b"Content-Length: %d" % (int(m[1]) - 1), text, count=1), "length"), (text[:-1], "length"), (text + b"x", "length"), (b"GET" + text[4:], "no WARC"), (text.replace(b"\r\n\r\nhello", b"\r\nhello"), "HTTP header|length")):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError, match=said):
            list(warc.read_records(io.BytesIO(z.compress(wrong) + z.flush())))


def test_archives_are_rolled(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 400) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=2_000)
    assert manifest.count() > 3 and manifest.filter("bytes > 4000").count() == 0
    assert {r.page_id for r in warc.resolved(warc.scan_archives(manifest)).collect()} == set(range(50))


def test_many_revisits_are_joined_alike(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "x" * 2000 + str(i % 3)) for i in range(30)], "page_id long, url string, html string")
    few = warc.resolved(warc.scan_archives(warc.write_archives(pages, f"file://{tmp_path}/a"))).collect()
    monkeypatch.setattr(warc, "SENT_REVISITS", 0)
    assert sorted(few) == sorted(warc.resolved(warc.scan_archives(warc.write_archives(pages, f"file://{tmp_path}/b"))).collect())


def test_a_benchmark_of_16_mb_stays_small():
    words = [f"w{i:05d}" for i in range(20_000)]
    items = [(i, " ".join(words[(i * 37 + k * k) % 20_000] for k in range(60)).encode()) for i in range(38_000)]
    assert 15 << 20 < sum(len(t) for _, t in items) < 17 << 20
    tracemalloc.start()
    windows = decontaminate.BenchmarkWindows(items)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 200 << 20
    mask, found = windows.scan(items[5][1].split()[:30])
    assert mask.all() and "5" in found


def test_a_null_item_marks_words_but_is_no_item(spark):
    bench = spark.createDataFrame([(None, "one two three"), (7, "four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three x", 5), (2, "four five", 6), (3, "none", 7)], "doc_id long, text string, _bench_mask int")
    for limit in (1 << 20, 8):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in decontaminate.scan(docs, bench, broadcast_bytes=limit).collect()}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got == {1: (3, 0, True, sha("")), 2: (2, 1, True, sha("7")), 3: (0, 0, False, sha(""))}
    kept = decontaminate.reject(docs, bench)
    assert kept.schema == docs.schema and [tuple(r) for r in kept.collect()] == [(3, "none", 7)]
    assert decontaminate.remove_spans(docs, bench).schema == docs.schema


def test_addresses_of_any_length(spark, tmp_path):
    """Headers of megabytes are read as they were written, within the query as well."""
    url = "http://a.example/" + "x/" * 2_500_000
    good = warc.record_bytes(1, url, b"hello", hashlib.sha1(b"hello").digest(), None)
    assert [(h["WARC-Target-URI"], p) for h, _, p in warc.read_records(io.BytesIO(good + good))] == [(url, b"hello")] * 2
    page = "p" * 2000
    pages = spark.createDataFrame([(1, url, page), (2, "u", page), (3, url, None), (4, None, "")], "page_id long, url string, html string").withColumn("records", F.lit("clash")).withColumn("sha1", F.lit(0))
    records = warc.scan_archives(warc.write_archives(pages, f"file://{tmp_path}/l"), payloads=False)
    assert {(r.page_id, len(r.url)) for r in records.collect()} == {(1, len(url)), (2, 1), (3, len(url)), (4, 11)}
    assert {(r.page_id, r.record_type) for r in warc.resolved(records).collect()} == {(1, "revisit"), (2, "response"), (3, "response"), (4, "response")}
