"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that are hashed in one go; a longer text is cut between words and its parts put together.
BITE = 1 << 20
#: Cells of the sketches that bound the similarity of two texts.
CELLS = 256

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_IS_WORD = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: Blocks of scripts that put no space between words, first and last code point: each of their letters is a word.
_SPACELESS = [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]
#: Code points from here on are Han letters.
_HAN = 0x20000
_kinds: list[np.ndarray] = []
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a uint64 over all."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        up, down = np.full(n, _STEP, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        if n > 4 * BITE:  # of one word longer than that; not kept
            return np.cumprod(up), np.cumprod(down)
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def _kind(code: np.ndarray) -> np.ndarray:
    """By code point: 0 parts words, 1 belongs to one, 2 is a word of its own."""
    if not _kinds:
        # a mark belongs to the letter it stands on
        table = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(_HAN)] + [True], np.int8)
        for low, high in _SPACELESS:
            table[low : high + 1] *= 2
        table[_HAN] = 2
        _kinds.append(table)
    return _kinds[0][np.minimum(code, _HAN)]


def _bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes start and end."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _IS_WORD[b]
    lead = np.flatnonzero(b >= 0xC0)
    alone = lead[:0]
    if len(lead):
        # code points from the bytes; what a shorter one lacks is shifted out
        size = 2 + (b[lead] >= 0xE0) + (b[lead] >= 0xF0)
        code = b[lead].astype(np.int64) & (0x7F >> size)
        for k in range(1, 4):
            code = np.where(k < size, code << 6 | b[np.minimum(lead + k, len(b) - 1)] & 0x3F, code)
        kind = _kind(code)
        for k in range(4):
            at = lead[k < size] + k + 1
            inside[at] = kind[k < size] > 0
        alone, past = lead[kind == 2], (lead + size)[kind == 2]
    edge = np.diff(inside)
    if not len(alone):
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts, ends = edge == 1, edge == -1
    starts[alone] = ends[past] = True
    # a word that goes on before or after a letter of its own ends or starts there
    ends[alone] |= inside[alone] > 0
    starts[past] |= inside[past + 1] > 0
    return np.flatnonzero(starts), np.flatnonzero(ends)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word: a polynomial over its bytes, taken from running sums."""
    b = np.frombuffer(raw, np.uint8)
    starts, ends = _bounds(b)
    up, down = _power(max(len(b), BITE))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


#: Where a long text may be cut: blanks, and the comma and full stop of texts without blanks.
_BREAKS = [b" ", b"\n", "\u3001".encode(), "\u3002".encode(), "\uff0c".encode()]


def _cut(raw: bytes) -> Iterator[bytes]:
    while len(raw) > BITE:
        at = max(raw.rfind(x, 0, BITE) for x in _BREAKS)
        if at <= 0:
            at = min((i for i in (raw.find(x, BITE) for x in _BREAKS) if i > 0), default=len(raw))
        yield raw[:at]
        raw = raw[at:]
    yield raw


def _shingled(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of texts whose words lie one text after the other; a text of fewer words than WIDTH has one of all."""
    n = len(words)
    first = np.concatenate([[0], np.cumsum(counts)])
    many = np.maximum(counts - WIDTH + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(many)])
    acc = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        acc[: n - k] = acc[: n - k] * _MULT + words[k:] if n > k else acc[: n - k]
    at = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], many)
    out = mix(acc[at]) if n else acc[:0]
    for i in np.flatnonzero((counts > 0) & (counts < WIDTH)):
        h = np.uint64(counts[i])
        for w in words[first[i] : first[i + 1]]:
            h = np.uint64((int(h) * int(_MULT) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[out_first[i]] = mix(np.array([h], np.uint64))[0]
    return out, out_first


def shingle_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, and where each text's begin (one more entry at the end).

    Words are runs of letters, their marks and digits, in lower case; a letter of a script without spaces is one by itself.
    A text without words has no shingle; repeated shingles stay.
    """
    raws = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    words: list[np.ndarray] = []
    counts = np.zeros(len(raws), np.int64)
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            h, starts = _word_hashes(b" ".join(raws[i] for i in held))
            begins = np.cumsum([0] + [len(raws[i]) + 1 for i in held[:-1]])
            where = np.searchsorted(starts, np.append(begins, np.iinfo(np.int64).max))
            counts[held] = np.diff(where)
            words.append(h)
            held, size = [], 0

    for i, raw in enumerate(raws):
        if len(raw) > BITE:
            flush()
            parts = [_word_hashes(p)[0] for p in _cut(raw)]
            counts[i] = sum(map(len, parts))
            words += parts
            continue
        if size + len(raw) > BITE:
            flush()
        held.append(i)
        size += len(raw) + 1
    flush()
    return _shingled(np.concatenate(words) if words else np.zeros(0, np.uint64), counts)


def bites(items: Iterable, size_of, most: int = BITE) -> Iterator[list]:
    """Runs of items whose sizes come to about ``most``."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += size_of(x)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
