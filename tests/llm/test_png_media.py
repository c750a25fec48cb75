import hashlib
import math
import statistics
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seamark.llm.png_media import SIGNATURE, _chunk, dct_hash, decode_many, decode_png, encode_png, filtered, media_features, media_table, op3_png_media, pad, read_lines


def brute(text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def brute_feature(text):
    """The transform by its sums: 32 x 32 means of the samples, 8 x 8 cosines, one bit each."""
    raw = (text or "").encode()
    x = [list((raw + bytes(-len(raw) % 64 if raw else 64))[i : i + 64]) for i in range(0, max(64, len(raw) + -len(raw) % 64), 64)]

    def averaged(rows):
        n = len(rows)
        at = [i * n // 32 for i in range(32)] + [n]
        return [rows[at[i]] if n < 32 else [sum(c) / (at[i + 1] - at[i]) for c in zip(*rows[at[i] : at[i + 1]])] for i in range(32)]

    small = averaged([list(c) for c in zip(*averaged(x))])  # columns first
    cos = [[math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    low = [round(sum(cos[u][i] * cos[v][j] * small[j][i] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low[1:])
    return "".join(f"{int(''.join(str(int(y > middle)) for y in low[k : k + 8]), 2):02x}" for k in range(0, 64, 8)), min(abs(y - middle) for y in low if y != middle)


def test_query_against_brute_force(spark, sf, documents):
    rows = op3_png_media(spark, sf).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows}
    assert got == {d: brute(t) for d, t in documents}
    assert all(len(r["feature"]) == 16 and len(r["media_sha256"]) == 64 and r["media_bytes"] > 57 for r in rows)
    feature = {r["doc_id"]: r["feature"] for r in rows}
    for d, t in documents[:40]:
        want, gap = brute_feature(t)
        assert feature[d] == want or gap < 1e-4
    used = Counter(k for _, t in documents[:40] for k in read_lines(encode_png(pad((t or "").encode())))[:, 0].tolist())
    assert len([k for k, n in used.items() if k and n > 5]) >= 3, "rows are stored with filters that reading has to undo"


def test_odd_rows(spark, odd, odd_rows, none):
    rows = media_features(media_table(odd)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == Counter((d, *brute(t)) for d, t in odd_rows)
    same = {(r["media_sha256"], bytes(r["hash"])) for r in rows if r["doc_id"] in (5, 6)}
    assert len(same) == 1
    assert media_features(media_table(none)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=3000), st.sampled_from([None, 0, 1, 2, 3, 4])), min_size=1, max_size=6))
def test_round_trip(images):
    made = [encode_png(pad(raw), row_filter=k) for raw, k in images]
    assert [x.tobytes() for x in decode_many(made)] == [pad(raw) for raw, _ in images]
    assert all(decode_png(m).tobytes() == pad(raw) for m, (raw, _) in zip(made, images))
    assert list(decode_many([])) == []


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_all_row_filters(kind):
    rows = np.random.default_rng(kind).integers(0, 256, (9, 16), np.uint8)
    lines = b""
    for i, row in enumerate(rows.tolist()):
        up = rows[i - 1].tolist() if i else [0] * 16
        line = []
        for j, x in enumerate(row):
            a, b, c = row[j - 1] if j else 0, up[j], up[j - 1] if j else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - [0, a, b, (a + b) // 2, nearest][kind]) % 256)
        lines += bytes([kind, *line])
    assert filtered(rows, kind).tobytes() == lines
    data = SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 9, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")
    assert (decode_png(data) == rows).all()


def test_damage_is_found():
    data = encode_png(pad(b"some text" * 40))
    for at in (0, 20, 30, len(data) // 2, len(data) - 6):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            decode_png(bytes(bad))
    with pytest.raises(ValueError):
        decode_png(data[:-12])


def test_hash_follows_low_frequencies():
    tiles = np.random.default_rng(2).integers(20, 236, (8, 8), np.uint8)  # all of the low frequencies, none of the high ones alone
    smooth = np.kron(tiles, np.ones((25, 8), np.uint8))
    noisy = np.clip(smooth + np.random.default_rng(0).integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    other = np.random.default_rng(1).integers(0, 256, smooth.shape, np.uint8)

    def far(a, b):
        return sum((p ^ q).bit_count() for p, q in zip(dct_hash(a), dct_hash(b)))

    assert far(smooth, noisy) < 16 < far(smooth, other)
