"""Exact, memoised use of public tokenizers.

A text is cut into units at places where both vocabularies put a boundary whatever stands around it: before a run of white space
that follows another character, and between a run of Latin letters and one of some marks. So the ids of a text are the ids of its
units in a row, and a unit that was seen before is not encoded again. A unit that is one run of Latin letters goes to the
tokenizer's model itself, all others through the whole tokenizer.

`encode_many` does the cutting and the lookup for many texts at once with numpy: a unit is known by two independent 64-bit
hashes of its bytes, and its ids are gathered from a pool. Texts with characters beyond Latin-1 and very long ones go one by one,
and so do the texts of a part in which two units have one first hash and not the other.

Defined results: an empty text has no ids; equal texts have equal ids; no texts give no lists.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: White space by Unicode's White_Space property (Python's class without U+001C to U+001F), Latin letters and marks.
_SPACE, _OTHER, _LETTERS, _MARKS = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]", "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,;:!?|&%$#*]"
_SPACED = re.compile(rf"{_SPACE}*(?:{_LETTERS}+(?={_MARKS})|{_OTHER}+)|{_SPACE}+").findall
_UNSPACED = re.compile(rf"{_LETTERS}+(?={_MARKS})|{_OTHER}+").findall
_SPACED_WORD, _WORD = re.compile(f" ?{_LETTERS}+").fullmatch, re.compile(f"{_LETTERS}+").fullmatch
_BEYOND_LATIN = re.compile(r"[^\x00-\xff]").search
#: Units in each of the two generations of the memo, and the longest unit that is kept.
MEMO_UNITS, MEMO_CHARS = 100_000, 48


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies have for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    def __init__(self, tokenizer, spaced: bool, limit: int):
        super().__init__()
        self.whole, self.model, self.limit, self.old = tokenizer.encode, tokenizer.model.tokenize, limit, {}
        self.is_word, self.lower, self.letters = (_SPACED_WORD, False, _byte_letters()) if spaced else (_WORD, True, _byte_letters())

    def make(self, unit: str) -> bytes:
        if self.is_word(unit):
            raw = (unit.lower() if self.lower else unit).encode()
            return array("I", [x.id for x in self.model(raw.decode("latin-1").translate(self.letters))]).tobytes()
        return array("I", self.whole(unit, add_special_tokens=False).ids).tobytes()

    def __missing__(self, unit: str) -> bytes:
        got = self.old.get(unit)
        if got is None:
            got = self.make(unit)
        if len(unit) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.old = self.copy()
                self.clear()
            self[unit] = got
        return got


class UnitEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = MEMO_UNITS):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        # White space is part of the ids, or it is dropped and case too: known by what the tokenizer makes of it.
        self.spaced = bool(tokenizer.encode(" ", add_special_tokens=False).ids)
        self._memo = _Memo(tokenizer, self.spaced, limit)
        self._many = _Many()

    def encode(self, text: str) -> bytes:
        if self.spaced:
            units = _SPACED(text)
        else:
            units = _UNSPACED(text if _BEYOND_LATIN(text) else text.lower())
        return b"".join(map(self._memo.__getitem__, units))


    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text as unsigned 32-bit integers."""
        raws = [t.encode() for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        part: list[int] = []
        size = 0
        for i, raw in enumerate(raws):
            if len(raw) > BATCH_BYTES:
                out[i] = np.frombuffer(self.encode(texts[i]), "<u4")
                continue
            part.append(i)
            size += len(raw)
            if size >= BATCH_BYTES:
                self._encode_part(texts, raws, part, out)
                part, size = [], 0
        self._encode_part(texts, raws, part, out)
        return out

    def _encode_part(self, texts: list[str], raws: list[bytes], part: list[int], out: list) -> None:
        if not part:
            return
        raw = b"".join([raws[i] for i in part])
        sizes = np.array([len(raws[i]) for i in part], np.int64)
        begins = np.cumsum(sizes) - sizes
        odd = np.zeros(len(part), bool)
        offsets, ids = np.zeros(len(part) + 1, np.int64), np.zeros(0, np.uint32)
        if raw:
            data = np.frombuffer(raw, np.uint8)
            kind = _KIND[data]
            strange = kind == _BEYOND
            strange[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs for times and divided by
            owner = np.searchsorted(begins, np.flatnonzero(strange), "right") - 1
            odd[owner] = True
            space, first = kind == _BLANK, np.zeros(len(data) + 1, bool)
            first[begins] = True
            first = first[:-1]
            after_mark = np.zeros(len(data), bool)
            after_mark[1:] = (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
            if self.spaced:
                start = space.copy()
                start[1:] &= ~space[:-1]
            else:
                start = ~space
                start[1:] &= space[:-1]
                first &= ~space
            at = np.flatnonzero(start | after_mark | first)
            if len(at):
                try:
                    counts, ids = self._memo_many(raw, data, at)
                except _Clash:
                    for i in part:
                        out[i] = np.frombuffer(self.encode(texts[i]), "<u4")
                    return
                ends = np.concatenate([[0], np.cumsum(counts)])
                offsets = ends[np.searchsorted(at, np.append(begins, len(data)), "left")]
        for k, i in enumerate(part):
            out[i] = np.frombuffer(self.encode(texts[i]), "<u4") if odd[k] else ids[offsets[k] : offsets[k + 1]]

    def _memo_many(self, raw: bytes, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in each unit, and all ids in a row."""
        power, inverse = _powers(len(data))
        table = _HASHES if self.spaced else _LOWER_HASHES
        h, check = (np.add.reduceat(t[data] * power[: len(data)], at) * inverse[at] for t in table)
        found, first, which = np.unique(h, return_index=True, return_inverse=True)
        m = self._many
        place = np.searchsorted(m.key, found)
        new = np.flatnonzero((place == len(m.key)) | (m.key[np.minimum(place, len(m.key) - 1)] != found))
        if len(new):
            if len(m.key) > MANY_UNITS:
                self._many = m = _Many()
                new, place = np.arange(len(found)), np.zeros(len(found), np.int64)
            ids, counts = self._make_many(raw, at, np.append(at[1:], len(raw)), first[new].tolist())
            m.add(found[new], check[first[new]], ids, counts, place[new])
            place = np.searchsorted(m.key, found)
        unit = place[which]
        if (m.check[unit] != check).any():
            raise _Clash
        counts = m.count[unit]
        index = np.repeat(m.offset[unit] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return counts, m.pool[index]


    def _make_many(self, raw: bytes, at: np.ndarray, ends: np.ndarray, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        model, make, letters = self._memo.model, self._memo.make, self._memo.letters
        blank = letters[32]
        ids, counts = array("I"), []
        for start, end in zip(at[which].tolist(), ends[which].tolist(), strict=True):
            unit = raw[start:end]
            if not self.spaced:
                unit = unit.rstrip(_BLANKS)
                if unit.isalpha():  # of bytes: ASCII letters only
                    got = [x.id for x in model(unit.lower().decode())]
                    ids.extend(got)
                    counts.append(len(got))
                    continue
            elif unit[0] == 32 and unit[1:].isalpha():
                got = [x.id for x in model(blank + unit[1:].decode())]
                ids.extend(got)
                counts.append(len(got))
                continue
            text = unit.decode()
            if self.spaced and text[0] == " " and text[1:].isalpha():  # Latin-1 letters here
                got = [x.id for x in model(unit.decode("latin-1").translate(letters))]
                ids.extend(got)
                counts.append(len(got))
                continue
            got = make(text)
            ids.frombytes(got)
            counts.append(len(got) // 4)
        return np.frombuffer(ids, np.uint32), np.array(counts, np.int64)


class _Clash(Exception):
    """Two units have one hash."""


class _Many:
    """Units in order of their hash, with a place in the pool of ids."""

    def __init__(self):
        self.key, self.check = np.zeros(1, np.uint64), np.zeros(1, np.uint64)  # the empty unit
        self.offset, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, counts: np.ndarray, place: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        offset = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.key, self.check = np.insert(self.key, place, key), np.insert(self.check, place, check)
        self.offset, self.count = np.insert(self.offset, place, offset), np.insert(self.count, place, counts)


#: Bytes of text that go through numpy at once, and units that are known at once.
BATCH_BYTES, MANY_UNITS = 1 << 20, 1_000_000
_BLANKS = b" \t\n\x0b\x0c\r"
_OTHER_KIND, _BLANK, _LETTER, _MARK, _BEYOND = range(5)
_KIND = np.array([_BLANK if bytes([b]) in _BLANKS else _LETTER if 65 <= b <= 90 or 97 <= b <= 122 or 0x80 <= b <= 0xBF or b == 0xC3 else _MARK if chr(b) in _MARKS[1:-1] else _BEYOND if b >= 0xC0 else _OTHER_KIND for b in range(256)], np.uint8)
_HASHES = np.random.default_rng(7).integers(1, 1 << 64, (2, 256), np.uint64)
#: For vocabularies without case: capitals as small letters, white space as nothing. (Of Latin-1's capitals only ASCII's.)
_LOWER_HASHES = _HASHES[:, [b + 32 if 65 <= b <= 90 else b for b in range(256)]].copy()
_LOWER_HASHES[:, list(_BLANKS)] = 0
_POWER: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _POWER or len(_POWER[0]) < n:
        base = 0x9E3779B97F4A7C15
        _POWER[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n + BATCH_BYTES, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64))]
    return _POWER[0], _POWER[1]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
