"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token at every position of a pre-token. Tokens are
taken greedily; a token may follow another only if the merges would leave the seam between the two alone, which a
table of pairs (filled as pairs are met) records. When no token fits, the last one is exchanged for its longest
proper prefix in the vocabulary and the dead position is remembered, so each position is left at most once. The
result is what applying the merges by rank gives.

Texts are independent, so Spark only has to deal out the rows: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.shingles import bites

#: Fixed value: the pattern by which the byte-level tokenizers cut a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of remembered pre-tokens and ids a worker keeps (about), and pairs of its pair table; the rest is worked out anew.
MEMORY, PAIRS = 72_000_000, 300_000
#: Characters of a text that are cut into pre-tokens at once, and of texts that make one batch of rows.
STRETCH = 1 << 18

OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType(), False),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that stands for it in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Seams:
    """The pair-compatibility table: may token y stand right of token x in an encoding?"""

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        self.joined = {a << 32 | b: rank for rank, (a, b, _) in enumerate(merges)}
        self.made = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        for rank, (a, b, c) in enumerate(merges):
            if self.made[c] < 0 and self.parts[c] is None:
                self.made[c], self.parts[c] = rank, (a, b)
        self.known: dict[int, bool] = {}

    def holds(self, x: int, y: int) -> bool:
        found = self.known.get(x << 32 | y)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[x << 32 | y] = self._walk(x, y)
        return found

    def _walk(self, x: int, y: int) -> bool:
        """Undo the two tokens' merges from the last to the first; the seam breaks if the pieces beside it at some
        time have a merge of their own that comes before either piece is used up."""
        until_x = until_y = float("inf")
        while True:
            rank = self.joined.get(x << 32 | y)
            if rank is not None and rank < until_x and rank <= until_y:
                return False
            made_x, made_y = self.made[x], self.made[y]
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                until_x, x = made_x, self.parts[x][1]
            else:
                until_y, y = made_y, self.parts[y][0]


class Tokenizer:
    """One per worker and vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        letters = {c: chr(b) for b, c in byte_letters().items()}
        plain = lambda token: "".join(map(letters.__getitem__, token))
        #: Tokens with one character for each of their bytes.
        self.vocab = vocab = {plain(token): i for token, i in vocab.items()}
        merges = [(plain(a), plain(b)) for a, b in merges]
        self.seams = Seams([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], size)
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token, i)
            self.length[i] = len(token)
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for token, i in vocab.items():
            for end in range(len(token) - 1, 0, -1):
                if (j := vocab.get(token[:end])) is not None:
                    self.shorter[i] = j
                    break
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = token.encode("latin-1")
        for content, i in special.items():
            raw[i] = content.encode()
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pieces = regex.compile(PRE_TOKEN).findall
        #: A blank between two other characters starts a pre-token, so a text may be cut before it.
        self.seam = regex.compile(r"(?<=\S) (?=\S)").search
        self.packed = _Memory(self._pack)
        self.said = [str(i) for i in range(size)]

    def forget(self) -> None:
        """Lets go of the pre-tokens and pairs met so far."""
        self.packed = _Memory(self._pack)
        self.seams.known.clear()

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        s = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        whole = self.vocab.get(s)
        return [whole] if whole is not None else self.backtrack(s)

    def backtrack(self, s: str) -> list[int]:
        """Ids of a pre-token given with one character a byte."""
        n, length, shorter, holds, known = len(s), self.length, self.shorter, self.seams.holds, self.seams.known.get
        longest = [-1] * n
        for end, i in self.automaton.iter(s):
            longest[end - length[i] + 1] = i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                if not dead[at + length[token]]:
                    if last < 0:
                        break
                    fits = known(last << 32 | token)
                    if holds(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last, token = token, longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError(f"the vocabulary cannot spell {s!r}")
                dead[at] = 1
                out.pop()
                at -= length[last]
                token, last = shorter[last], out[-1] if out else -1
        return out

    def _pack(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece), np.int32).tobytes()

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special tokens, and stretches of what lies between that can be encoded apart."""
        between = self.cut.split(text) if self.cut is not None and any(x in text for x in self.special) else [text]
        for k, part in enumerate(between):
            if k % 2:
                yield True, part
                continue
            at = 0
            while len(part) - at > STRETCH and (m := self.seam(part, at + STRETCH)) is not None:
                yield False, part[at : m.start()]
                at = m.start()
            if at < len(part):
                yield False, part[at:]

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a whole text, and the same in decimal with commas between."""
        packed = []
        for special, part in self.parts(text):
            if special:
                packed.append(np.array([self.special[part]], np.int32).tobytes())
            else:
                packed.append(b"".join(map(self.packed.__getitem__, self.pieces(part))))
        ids, said = np.frombuffer(b"".join(packed), np.int32), self.said.__getitem__
        return ids, ",".join([",".join(map(said, ids[at : at + STRETCH].tolist())) for at in range(0, len(ids), STRETCH)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes one after the other, gathered from one blob, a stretch at a time."""
        out = []
        for at in range(0, len(ids), STRETCH):
            some = ids[at : at + STRETCH]
            first = self.offsets[some]
            size = self.offsets[some + 1] - first
            ends = np.cumsum(size)
            out.append(self.blob[np.repeat(first - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class _Memory(dict):
    """Values by pre-token, in a younger and an older half; when the younger is full, the older goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.size = make, {}, 0

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 100:
            if self.size > MEMORY // 2:
                self.older, self.size = dict(self), 0
                self.clear()
            self[key] = value
            self.size += 250 + 2 * len(key) + len(value)
        return value


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def tokenize(df: DataFrame, text: str = "text", keep: Iterable[str] = ("doc_id",), outputs: Iterable[str] = ("n_tokens", "ids"), path: str | None = None) -> DataFrame:
    """The columns ``keep`` as they are and the wanted ``outputs`` (see OUTPUTS) of every row's whole text.

    ``decoded`` and ``decoded_sha256`` come from the ids, not from the text. A null text counts as empty: no tokens.
    Repeated rows give repeated rows, an empty table an empty one; columns neither kept nor read are left out, and
    a kept column with the name of an output is an error. ``path`` is a tokenizer file that every executor can read.
    """
    keep, outputs, path = list(keep), list(outputs), path or default_path()
    if clash := set(keep) & set(outputs):
        raise ValueError(f"columns are both kept and made: {sorted(clash)}")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, OUTPUTS[c]) for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            at = 0
            for part in bites(batch.column(len(keep)), lambda v: len(v.as_py() or ""), STRETCH):
                made: dict[str, list] = {c: [] for c in outputs}
                for value in part:
                    ids, decimal = t.encode(value.as_py() or "")
                    if "n_tokens" in made:
                        made["n_tokens"].append(len(ids))
                    if "ids" in made:
                        made["ids"].append(ids)
                    if "ids_sha256" in made:
                        made["ids_sha256"].append(hashlib.sha256(decimal.encode()).hexdigest())
                    if "decoded" in made or "decoded_sha256" in made:
                        raw = t.decode(ids)
                        if "decoded" in made:
                            made["decoded"].append(raw.decode("utf-8", "replace"))
                        if "decoded_sha256" in made:
                            made["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                rows = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(keep))] + [pa.array(v, _ARROW[c]) for c, v in made.items()], names=keep + outputs)
        t.forget()  # the worker may go on with other steps

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)
