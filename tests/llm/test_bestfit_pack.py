import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seamark.llm.bestfit_pack import op10_best_fit_packing, pack_documents, plan_best_fit
from seamark.llm.tokens import UnitEncoder, tokenizer_path


def brute(rows, capacity=2048):
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    out = Counter()
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def check_sequences(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in rows) // capacity)


def test_query_against_brute_force(spark, sf, documents):
    rows = op10_best_fit_packing(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == brute(documents)
    used, least = check_sequences(rows)
    assert used <= least + 1


def test_odd_rows(spark, odd, odd_rows, none):
    rows = pack_documents(odd).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == brute(odd_rows)
    check_sequences(rows)
    assert pack_documents(none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
def test_plan_places_every_piece_once(counts):
    first, sequence, offset, opened = plan_best_fit(counts, 40)
    lengths = [x for x in sorted(counts, reverse=True) for _ in range(counts[x])]
    at = np.searchsorted(first, np.arange(len(lengths)), "right") - 1
    rows = [{"sequence_id": int(sequence[i] + g - first[i]), "offset": int(offset[i]), "length": lengths[g]} for g, i in enumerate(at)]
    used, least = check_sequences(rows, 40)
    assert used == opened and used <= best_fit_decreasing(lengths, 40)


def best_fit_decreasing(lengths, capacity):
    bins = []
    for x in lengths:
        fits = [i for i, free in enumerate(bins) if free >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def test_units_give_the_ids_of_whole_texts():
    texts = ["a  b", " a\n\n b \t", "x   y", "it's  1 2 3", "\x1c \x1d a", "é́ ́x ΑΣ ΑΣΑ", "", "   ", "<|endoftext|> <|startoftext|>a", "don't're 's\n\n\nq\n", "w" * 100 + " " + "w" * 100, "foo,bar baz.\nQux! ÀÉß, ÿ|x İi J\u030c, a\u0301. µ² x²,y Ⅷ.", "a×b ÷c É, È.", " ,a b,\u00a0, \u00a0  c", "'s.'S it'S,"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = Tokenizer.from_file(tokenizer_path(name))
        t.encode_special_tokens = True
        enc = UnitEncoder(tokenizer_path(name), limit=3)
        for x, ids in zip(texts * 2, enc.encode_many(texts * 2), strict=True):
            assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x
        for x in texts * 2:
            assert np.frombuffer(enc.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
