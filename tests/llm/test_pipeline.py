from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_bestfit_pack, test_fm_decontam, test_near_dedup
from seamark.llm.quality_rank import CUT, features, learn
from seamark.llm.secret_ledger import RULES, Scanner


def redact(text):
    out, at = "", 0
    for s, k, e in Scanner().spans(text or ""):
        if s >= at:
            out += text[at:s] + f"[REDACTED:{RULES[k].kind}]"
        at = max(at, e)
    return None if text is None else out + text[at:]


#: Names that operators and their helpers use inside.
INNER = "_blob _found _hit _bad _gone _part _parts _may_be _spot _bucket _bits _key _text again blob_id findings n id k".split()


def test_run_against_brute_force(spark, tmp_path):
    sf = str(tmp_path)  # a small corpus in which every stage has something to do
    for table, rows in (("documents", "doc_id between 300 and 650"), ("labels", "true"), ("benchmark", "true")):
        duckdb.sql(f"copy (select * from '/root/testdata/sf0.01/{table}.parquet' where {rows}) to '{sf}/{table}.parquet'")
    documents = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    model = learn(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    docs = [(d, t) for d, t in documents if model.score(features(t)[None, :])[0] >= CUT]
    kept = {d for d, _, _, k in test_near_dedup.brute(docs, 5) if k}
    docs = [x for x in docs if x[0] in kept]
    bad = {k[0] for k in test_fm_decontam.brute(docs, items) if k[-1]}
    docs = [(d, redact(t)) for d, t in docs if d not in bad]
    assert bad and len(docs) < len(documents) and any("[REDACTED:" in t for _, t in docs)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == test_bestfit_pack.brute(docs)
    test_bestfit_pack.check_sequences(rows)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("source", "score").withColumnRenamed("lang", "label")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_columns_named_as_inner_ones_come_through(spark, odd, odd_rows, sf):
    docs = odd.select("doc_id", "text", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in INNER])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[n] == (None if r["doc_id"] is None else f"{n}:{r['doc_id']}") for r in rows for n in INNER), name


def test_folders_of_ended_stages_are_deleted(spark, sf):
    from seamark.llm import common

    before = set(Path(common.shared_root(spark).removeprefix("file:")).iterdir())
    corpus_pipeline.run(spark, sf).count()
    left = {p.name.rsplit("-", 1)[0] for p in set(Path(common.shared_root(spark).removeprefix("file:")).iterdir()) - before}
    assert left <= {*(n for n, _ in corpus_pipeline.STAGES[:-1]), "secret-ledger", "pieces", "pack"}


def test_odd_rows_pass(spark, odd, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() > 0
