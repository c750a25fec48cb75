import gzip
import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from seamark.llm import common
from seamark.llm.warc import WarcArchive, make_record, op4_warc_archive, parse_record

SCHEMA = "page_id long, url string, html string, shard int, digest string, kind int, name string"


def brute(rows):
    groups = defaultdict(list)
    for p, html in rows:
        groups[html or ""].append(p)
    out = Counter()
    for p, html in rows:
        raw = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        last = max(ids, default=None)
        again = len(raw) >= 1000 and len(groups[html or ""]) > 1 and last is not None and p != last
        out[p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None] += 1
    return out


def found(df):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


def test_query_against_brute_force(spark, sf):
    rows = duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall()
    assert found(op4_warc_archive(spark, sf)) == brute(rows)


ROWS = [(i, f"http://x/{i}", h) for i, h in enumerate(["a" * 1000, "a" * 999, None, "", "é" * 700, "a" * 1000, "é" * 700, "a" * 999, "b" * 300_000])] + [(5, "u\r\nX: 1", "a" * 1000), (None, None, "a" * 1000), (None, None, "c" * 2000), (4, "u", "zz")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "d", 2, "n") for r in ROWS], SCHEMA)


def test_odd_rows_and_copies(spark, pages):
    for limit, shard in ((8 << 20, 24 << 20), (400, 500)):
        archive = WarcArchive(spark, file_bytes=limit, shard_bytes=shard)
        archive.write(pages)
        assert found(archive.read()) == brute([(p, h) for p, _, h in ROWS])
    archive = WarcArchive(spark)
    archive.write(pages.where("false"))
    assert archive.read().count() == 0


def test_files_are_deterministic_gzip_with_sums(spark, pages):
    names = []
    for _ in range(2):
        archive = WarcArchive(spark, file_bytes=400, shard_bytes=500)
        archive.write(pages)
        top = Path(archive.path.removeprefix("file:"))
        rows = {r["name"]: r for r in archive.manifest().collect()}
        on_disk = {p.name: p.read_bytes() for p in top.glob("*.warc.gz")}
        assert set(rows) == set(on_disk) and not list(top.glob("_pages-*"))
        assert all(hashlib.sha256(data).hexdigest() == rows[n]["sha256"] and len(data) == rows[n]["bytes"] for n, data in on_disk.items())
        assert sum(gzip.decompress(d).count(b"WARC/1.1\r\n") for d in on_disk.values()) == len(ROWS)
        names.append({n: r["sha256"] for n, r in rows.items()})
    assert names[0] == names[1] and len(names[0]) > 3


def test_any_number_of_shards_and_several_readers(spark, pages, monkeypatch):
    monkeypatch.setattr(common, "MOST_BOUNDS", 3)
    rows = [(i * i % 977 - 300, f"http://x/{i}", f"{i % 50}" * 700) for i in range(300)]
    archive = WarcArchive(spark, file_bytes=3_000, shard_bytes=10_000)
    archive.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert found(archive.read()) == brute([(p, h) for p, _, h in rows])
    shards = sorted((r["shard"], r["records"]) for r in archive.manifest().groupBy("shard").agg({"records": "sum"}).withColumnRenamed("sum(records)", "records").collect())
    assert len(shards) > 20 and max(n for _, n in shards) < 60
    assert archive.read().rdd.getNumPartitions() == 8


def test_payloads_come_back(spark, pages):
    archive = WarcArchive(spark)
    archive.write(pages)
    got = Counter((r["page_id"], bytes(r["payload"]).decode()) for r in archive.read(True).collect() if r["payload"] is not None)
    kept = brute([(p, h) for p, _, h in ROWS])
    assert sum(got.values()) == sum(n for (_, _, _, kind, _), n in kept.items() if kind == "response")
    assert got[None, "c" * 2000] == 1 and got[2, ""] == 1


def test_damage_is_found():
    record = make_record(1, "http://x/", b"<p>hi</p>", hashlib.sha1(b"<p>hi</p>").hexdigest(), None)
    parse_record(record)
    with pytest.raises(ValueError):
        parse_record(record.replace(b"<p>hi", b"<p>ho"))
    with pytest.raises(ValueError):
        parse_record(record[:-1])
