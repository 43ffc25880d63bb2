"""Archives: round trip against brute force, rolling, determinism, lost attempts, odd rows."""

from __future__ import annotations

import gzip
import pathlib

from pyspark.sql import functions as F

from postwise.llm import warc
from postwise.llm.common import shared_path, table

SF_DIR = "/root/testdata/sf0.001"


def expected(rows):
    """(key, url, payload) rows as sorted records."""
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    seen, out = set(), []
    for key, _, html in rows:
        body = (html or "").encode()
        lead = first.get(html or "")
        response = lead is None or (key == lead and (key, html or "") not in seen)
        seen.add((key, html or ""))
        kind, refers = ("response", None) if response else ("revisit", lead)
        out.append((key or -1, len(body), warc.base32_sha1(body), kind, refers or -1))
    return sorted(out)


def got(frame):
    return sorted(
        (r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1)
        for r in frame.collect()
    )


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF_DIR, "pages").select("page_id", "url", "html").collect()]
    assert got(warc.query(spark, SF_DIR)) == expected(rows)


def folder(spark):
    return pathlib.Path(shared_path(spark, "test").removeprefix("file://"))


def test_ranges_files_and_payloads(spark):
    rows = [(i * i * 1000 + 1, f"http://h/{i}", f"page {i % 37} " * (i % 50)) for i in range(300)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for partitions in (1, 7):
        path = folder(spark)
        manifest = warc.write_archives(frame.repartition(partitions), str(path), shard_bytes=20_000, file_bytes=2_000)
        listed = {r["file"]: r["records"] for r in manifest.collect()}
        assert len(listed) > 20 and sum(listed.values()) == 300
        # A file of a lost attempt, and one that was renamed but is in no manifest.
        (path / "_temporary").mkdir(exist_ok=True)
        (path / "_temporary" / "lost.warc.gz").write_bytes(b"x")
        (path / "999999-00000.warc.gz").write_bytes(b"x")
        found = warc.read_archives(spark, str(path))
        assert got(found) == expected(rows)
        texts = {r["page_id"]: bytes(r["payload"]) for r in found.filter("payload IS NOT NULL").collect()}
        assert all(t == dict((k, h) for k, _, h in rows)[k].encode() for k, t in texts.items())
        seen.append({f: (path / f).read_bytes() for f in listed})
        keys = []
        for name in sorted(listed):
            text = gzip.decompress(seen[-1][name])
            assert text.count(b"WARC/1.1\r\n") == listed[name] + 1
            keys += [int(line.split(b": ")[1]) for line in text.split(b"\r\n") if line.startswith(b"WARC-Page-ID")]
        assert keys == sorted(keys)
    assert seen[0] == seen[1]


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, digest int, KIND string"
    rows = [(5, None, None), (3, "http://a/\r\nX: y", ""), (3, "u", ""), (None, "u", "z"), (9, "u", "z"), (9, "u", "z"),
            (-4, "u", "é" * 200_000), (1 << 62, "u", "é" * 200_000), (None, "v", "alone"), (None, "v", "alone")]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], schema)
    path = str(folder(spark))
    warc.write_archives(frame, path, shard_bytes=1000)
    assert got(warc.read_archives(spark, path)) == expected(rows)
    path = str(folder(spark))
    warc.write_archives(frame, path, least_bytes=1)
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, path).filter("payload_bytes = 0").collect()}
    assert set(kinds.values()) == {"response"}
    path = str(folder(spark))
    assert warc.write_archives(frame.filter(F.lit(False)), path).count() == 0
    assert warc.read_archives(spark, path).count() == 0
