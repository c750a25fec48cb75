import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from seamark.llm import common, token_store, tokens
from seamark.llm.token_store import TokenStore, cut_points, marks, merkle_root, op6_token_store
from seamark.llm.tokens import tokenizer_path


def brute(rows):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    out, before = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((d, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return out


def test_query_against_brute_force(spark, sf, documents):
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in op6_token_store(spark, sf).collect())
    assert got == brute(documents)


def test_several_ranges_share_chunks(spark, documents, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_DOCS", 30)
    rows = documents + [(d + 10_000, t) for d, t in documents[:80]] + [(d + 20_000, (t or "") + " tail") for d, t in documents[:40]]
    store = TokenStore(spark)
    store.write(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in store.read().collect())
    assert got == brute(rows)
    stored = [h for r in store.rows().collect() for h, part in token_store._parts(r["ends"], token_store.split_hashes(bytes(r["hashes"])), r["stored"], bytes(r["data"])) if part is not None]
    assert len(stored) == len(set(stored)), "a chunk is stored once"
    parts, root = store.manifest()
    assert len(parts) > 5 and len(root) == 64


def test_four_byte_ids_and_any_number_of_ranges(spark, documents, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_DOCS", 10)
    monkeypatch.setattr(token_store, "BLOCK_RANGES", 4)
    monkeypatch.setattr(token_store, "BORROWERS", 5)
    monkeypatch.setattr(token_store, "id_width", lambda path: 4)
    monkeypatch.setattr(common, "MOST_BOUNDS", 3)
    rows = documents[:60] + [(d + 10_000, t) for d, t in documents[:60]] + [(50_000 + i, documents[3][1]) for i in range(40)]
    store = TokenStore(spark)
    store.write(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], zlib.crc32(bytes(r["ids"]))) for r in store.read(True).collect())
    assert got == [(*x, x[3]) for x in brute(rows)]
    assert {r["width"] for r in store._manifest().collect()} == {4} and len(store.manifest()[0]) > 8


def test_width_follows_the_vocabulary(tmp_path):
    from tokenizers import models

    for n, width in ((10, 2), (65_536, 2), (65_537, 4)):
        Tokenizer(models.WordLevel({f"w{i}": i for i in range(n)}, "w0")).save(str(tmp_path / "v.json"))
        assert token_store.id_width(str(tmp_path / "v.json")) == width


def test_units_with_one_hash_are_encoded_one_by_one(documents, monkeypatch):
    monkeypatch.setattr(tokens, "_HASHES", np.stack([np.ones(256, np.uint64), tokens._HASHES[1]]))
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    said = ["ab ba", "some other words", ""]
    assert [x.tolist() for x in tokens.UnitEncoder(tokenizer_path("byte_bpe_50k.json")).encode_many(said)] == [t.encode(x, add_special_tokens=False).ids for x in said]


def test_odd_rows(spark, odd, odd_rows, none):
    store = TokenStore(spark)
    store.write(odd)
    got = Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in store.read().collect())
    assert got == Counter(brute(odd_rows))
    store = TokenStore(spark)
    store.write(none)
    assert store.read().count() == 0


def test_damage_is_found(spark):
    store = TokenStore(spark)
    store.write(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"))
    rows = store.rows().collect()
    bad = spark.createDataFrame([r.asDict() | {"data": bytes(len(r["data"]))} for r in rows], token_store.STORED)
    store.rows = lambda: bad
    with pytest.raises(Exception, match="differs from its hash"):
        store.read().collect()


def test_cut_points_and_root():
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000)
    cuts = np.array(cut_points(len(ids), marks(ids).tolist()))
    sizes = np.diff(np.concatenate([[0], cuts]))
    assert cuts[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    both = np.concatenate([ids[:777], ids])
    after = marks(both) - 777
    assert cut_points(len(ids), after[after > 0].tolist()) == cuts.tolist(), "what stands before a document doesn't matter"
    moved = np.array(cut_points(len(both), marks(both).tolist()))
    assert len(set((moved - 777).tolist()) & set(cuts.tolist())) > len(cuts) // 2, "cuts follow the content"
    assert merkle_root([b"a", b"b", b"c"]) != merkle_root([b"a", b"c", b"b"])
