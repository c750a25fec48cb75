import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seamark.llm import fm_decontam
from seamark.llm.fm_decontam import Windows, blocks, digest_columns, find_hits, keep_clean, occurrences, words
from seamark.llm.fm_index import FMIndex, WaveletRanks, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = Counter()
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= got
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def found(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in digest_columns(df).collect())


ITEMS = [(1, "a b c d e f g h i j k l m n o p"), (2, "Q r,S! é"), (3, None), (4, ""), (None, "a b c d e f g h i j k l m"), (1, "a b c d e f g h i j k l m n o p"), (5, "zz"), (10, "b c d e f g h i j k l m n"), (6, "x " * 40)]
DOCS = [(1, None), (2, ""), (3, "zz"), (4, "A-b c\nD e f g h i j k l M n o p"), (4, "q r s É é"), (4, "q r s É é"), (5, "w " * 100 + "a b c d e f g h i j k l m n tail"), (6, "x " * 13 + "x"), (7, "x " * 12), (None, "q r s é q r s é"), (8, "abc " * 5000)]


def test_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, [2], "s") for r in DOCS], "doc_id long, text string, n_words int, hits array<int>, _text string")
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, words string")
    for shard, block in ((10**6, 1 << 20), (20, 1 << 20), (50, 20), (50, 13)):
        monkeypatch.setattr(fm_decontam, "SHARD_WORDS", shard)
        assert found(find_hits(docs, items, block_words=block)) == brute(DOCS, ITEMS)
    assert found(find_hits(docs, items.where("false"))) == brute(DOCS, [])
    assert find_hits(docs.where("false"), items).count() == 0
    for block in (1 << 20, 20):
        monkeypatch.setattr(fm_decontam, "BLOCK_WORDS", block)
        clean = keep_clean(docs, items)
        assert clean.columns == docs.columns
        assert Counter(r["doc_id"] for r in clean.collect()) == Counter({k[0]: 0 for k in brute(DOCS, ITEMS)}) + sum((Counter({k[0]: n}) for k, n in brute(DOCS, ITEMS).items() if not k[-1]), Counter())
    r = find_hits(docs, items).where("doc_id = 5").first()
    assert DOCS[6][1][r["spans"][0]["start"] : r["spans"][0]["end"]] == "a b c d e f g h i j k l m n"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=14), max_size=8), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), max_size=6))
def test_occurrences(texts, phrases):
    w = Windows([(str(i), [f"w{x}".encode() for x in p]) for i, p in enumerate(phrases)], 3)
    codes = np.array([c for t in texts for c in (*(w.codes.get(f"w{x}".encode(), 0) for x in t), 0)], np.int64)
    got = Counter(zip(*(x.tolist() for x in occurrences(codes, w)), strict=True))
    want = Counter()
    for n in w.starts:
        for k, row in enumerate(next(w.phrases(n))[1].tolist()):
            said = [f"w{x}" for x in row]
            have = {str(i) for i, p in enumerate(phrases) if min(3, len(p)) == n and any([w.codes[f"w{x}".encode()] for x in p[j : j + n]] == row for j in range(len(p) - n + 1))}
            assert {w.items[j] for j in w.of(n, np.array([k]))} == have, said
            for i in range(len(codes) - n + 1):
                if codes[i : i + n].tolist() == row:
                    want[i, n, k] += 1
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60))
def test_index_parts(xs):
    x = np.array([*xs, 0], np.int64)
    seps = iter(range(-len(x), 0))
    unique = [next(seps) if c == 0 else c for c in x.tolist()]
    order = suffix_order(x)
    assert order.tolist() == sorted(range(len(x)), key=lambda i: unique[i:])
    r = WaveletRanks(x, 3)
    at = np.arange(len(x))
    assert (r.access(at) == x).all()
    for c in range(8):
        assert r.rank(np.full(len(x) + 1, c), np.arange(len(x) + 1)).tolist() == [int((x[:i] == c).sum()) for i in range(len(x) + 1)]
    assert sorted(FMIndex(x, 4).locate(at).tolist()) == at.tolist()


def test_a_block_is_small(spark, monkeypatch):
    """Half a million words, all of them different: what goes to the executors stays within 40 MB, and any benchmark comes in such blocks."""
    import pickle

    w = Windows([("a", [b"%d" % i for i in range(250_000)]), ("b", [b"x%d" % i for i in range(250_000)])])
    assert len(pickle.dumps(w)) < 40 << 20 and sum(len(s) for s in w.starts.values()) == 500_000 - 24
    items = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 7 % 50))) for i in range(40)], "item_id long, text string")
    made = list(blocks(items, block_words=60))
    assert len(made) > 10 and all(len(b.stream) <= 60 for b in made)


def test_words():
    assert words("ÀB'c_9²\x7f-ÿ") == ["Àb".encode(), b"c", "9²".encode(), "ÿ".encode()]
