"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For every bit a binary classifier, the naive Bayes log odds of hashed letter
n-grams between the languages whose bit is 1 and those whose bit is 0, scores a text. Decoding is loss-weighted: each
language weighs the loss of a bit by the mean margin by which the bit's classifier tells training texts of that language,
and the codeword of the least weighted loss is taken. (How often a bit is right would not do: on texts whose n-grams it has
counted it nearly always is, and all bits would weigh the same.) Training counts n-grams by language over all training
rows and turns the counts of a feature into its weights in Spark, so the driver gets a table of fixed size; the margins
come from a bounded sample of the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import written
from tidemark.llm.shingles import bites

#: n-grams are hashed to 2 ** BITS features, whatever the size of the corpus.
BITS = 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Languages up to which all distinct splits of them make the code; more get RANDOM_BITS random ones, of which the best
#: of DRAWS codes is taken; two codewords must then differ in a quarter of the bits.
EXHAUSTIVE, RANDOM_BITS, DRAWS = 5, 63, 40
#: Training rows (about, chosen by a hash of the text) from which the bits' margins are taken.
CALIBRATION = 20_000
#: Languages whose counts a task holds at once.
HELD = 64
#: A text whose best codeword loses only so little less than the second (per bit) is flagged.
MARGIN = 0.2


def _features(texts: list[str | None]) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Feature of the n-gram at every place, where each text begins and ends, and whether the text has a letter.

    Characters other than letters count as one blank, which a text ends with. Only n-grams that end within their text
    are its own: see _stops().
    """
    lowered = [(t or "").lower() for t in texts]
    # a blank before, between and behind, so that a text has the same n-grams wherever it stands
    code = np.frombuffer((" " + " ".join([*lowered, ""])).encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter(code)
    sizes = np.array([len(t) for t in lowered])
    begins = np.concatenate([[1], np.cumsum(sizes + 1) + 1])[:-1]
    has = np.zeros(len(texts), bool)
    places = np.flatnonzero(sizes)
    if len(places):
        has[places] = np.logical_or.reduceat(np.append(letter, False), np.stack([begins[places], begins[places] + sizes[places]], 1).ravel())[::2]
    plain = np.where(letter, code, 32).astype(np.uint32)
    # runs of blanks become one
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    kept = plain[keep]
    at = np.concatenate([[0], np.cumsum(keep)])
    first = at[np.minimum(begins, len(plain))]
    owner_end = np.append(first[1:], len(kept))
    feats, h = [], np.zeros(len(kept), np.uint32)
    for n in ORDERS:
        m = max(len(kept) - n + 1, 0)
        h = (h[:m] * np.uint32(0x01000193)) ^ kept[n - 1 : n - 1 + m]
        x = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        feats.append((x >> np.uint32(32 - BITS)).astype(np.int32))
    return feats, (first, owner_end), has


def _stops(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Where the places end at which a text's own n-grams begin."""
    return np.maximum(end - n + 1, first)


def _counted(texts: list[str]) -> list[np.ndarray]:
    """How often each feature occurs in the texts, by order."""
    feats, (first, end), _ = _features(texts)
    out = []
    for n, f in zip(ORDERS, feats, strict=True):
        edge = np.zeros(len(f) + 1, np.int8)
        stops = _stops(first, end, n)
        some = stops > first
        edge[first[some]] += 1
        edge[stops[some]] -= 1
        out.append(np.bincount(f[np.cumsum(edge[:-1]) > 0], minlength=1 << BITS))
    return out


_letters: list[np.ndarray] = []


def _is_letter(code: np.ndarray) -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[:] = [chr(c).isalpha() for c in range(0x110000)]
        _letters.append(table)
    return _letters[0][code]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # +1 or -1 by language and bit
    weights: np.ndarray  # by order, bit and feature
    trust: np.ndarray | None = None  # by language and bit: a bit's share of the language's loss; none: all the same

    def __post_init__(self):
        if self.trust is None:
            self.trust = np.full(self.code.shape, 1 / self.code.shape[1])

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log odds by text and bit, and which texts have a letter."""
        feats, (first, end), has = _features(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        for k, f in enumerate(feats):
            stop = _stops(first, end, ORDERS[k])
            for bit in range(self.code.shape[1]):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[k, bit][f], dtype=np.float64)])
                out[:, bit] += (sums[np.minimum(stop, len(f))] - sums[np.minimum(first, len(f))]) / np.maximum(stop - first, 1)
        return out / len(ORDERS), has

    def decode(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score from 0 to 1, and whether a second codeword is as near.

        The loss of a bit is log(1 + exp(-margin)), weighted for each language by ``trust``.
        """
        sharp = np.clip(scores * 8, -30, 30)
        loss = (np.log1p(np.exp(-sharp[:, None, :] * self.code[None])) * self.trust[None]).sum(2)
        order = np.sort(loss, 1)
        likely = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        close = order[:, 1] - order[:, 0] < MARGIN if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return loss.argmin(1), likely.max(1) / likely.sum(1), close


def distance(code: np.ndarray) -> int:
    """The fewest bits in which two codewords differ."""
    differ = (code.shape[1] - code @ code.T) / 2
    return int(differ[~np.eye(len(code), dtype=bool)].min()) if len(code) > 1 else code.shape[1]


def codewords(n: int) -> np.ndarray:
    """+1 or -1 by language and bit: all distinct splits of few languages, else random ones that split evenly.

    Of DRAWS random codes the one whose nearest two codewords lie farthest apart is taken; a quarter of the bits is
    the least distance allowed.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        return np.array([[1, *x] for x in product((-1, 1), repeat=n - 1) if -1 in x]).T.astype(float)
    rng = np.random.default_rng(n)
    half = np.array([1.0] * (n // 2) + [-1.0] * (n - n // 2))
    best = max((np.stack([rng.permutation(half) for _ in range(RANDOM_BITS)], 1) for _ in range(DRAWS)), key=distance)
    if distance(best) < RANDOM_BITS // 4:
        raise ValueError(f"{n} languages need more than {RANDOM_BITS} bits")
    return best


def _counts(rows: DataFrame) -> DataFrame:
    """lang, feature (order times 2 ** BITS plus its hash) and n, over all rows (lang, text)."""
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told(k: str, got: np.ndarray) -> pa.RecordBatch:
            order, feature = np.nonzero(got)
            return pa.RecordBatch.from_arrays([pa.array([k] * len(order), pa.string()), pa.array(order * size + feature, pa.int32()), pa.array(got[order, feature], pa.int64())], names=["lang", "feature", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part in bites(zip(langs, batch.column(1).to_pylist(), strict=True), lambda r: len(r[1])):
                by: dict[str, list[str]] = {}
                for k, t in part:
                    by.setdefault(k, []).append(t)
                for k, texts in by.items():
                    if k not in sums and len(sums) >= HELD:
                        yield told(*sums.popitem())
                    got = sums.setdefault(k, np.zeros((len(ORDERS), size), np.int64))
                    for order, n in enumerate(_counted(texts)):
                        got[order] += n
        for k, got in sums.items():
            yield told(k, got)

    return rows.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def _weights(counts: DataFrame, languages: list[str], totals: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log odds by order, bit and feature, worked out where a feature's counts lie; totals are by language and order."""
    size, bits = 1 << BITS, code.shape[1]
    number = {k: i for i, k in enumerate(languages)}
    base = totals + 0.5 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, per = batch.column(0).to_numpy(), batch.column(1)
            order = feature // size
            n = np.zeros((len(feature), len(languages)))
            which = np.repeat(np.arange(len(feature)), np.diff(per.offsets.to_numpy()))
            flat = per.flatten()
            n[which, [number[k] for k in flat.field(0).to_pylist()]] = flat.field(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_odds(n, base[:, order].T, code)), pa.list_(pa.float32()))], names=["feature", "w"])

    # at most orders x 2 ** BITS rows, whatever the number of languages
    per_feature = counts.groupBy("feature").agg(F.collect_list(F.struct("lang", "n")).alias("per"))
    got = per_feature.mapInArrow(run, "feature int, w array<float>").toArrow()
    weights = np.zeros((len(ORDERS), size, bits), np.float32)
    for order in range(len(ORDERS)):  # a feature that no text has
        weights[order] = _odds(np.zeros((1, len(languages))), base[:, order][None], code)
    if len(got):
        weights.reshape(-1, bits)[got.column("feature").to_numpy()] = np.stack(got.column("w").to_numpy())
    return np.ascontiguousarray(weights.transpose(0, 2, 1))


def _odds(n: np.ndarray, base: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log odds by feature and bit of counts by feature and language; each language weighs the same."""
    share = (n + 0.5) / base
    out = np.zeros((len(n), code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, zero = share[:, code[:, bit] > 0], share[:, code[:, bit] < 0]
        if one.shape[1] and zero.shape[1]:
            out[:, bit] = np.log(one.mean(1)) - np.log(zero.mean(1))
    return out


def trusted(margin: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights by language and bit from each bit's summed margin over a language's ``seen`` texts; rows sum to 1.

    A bit that tends to be wrong weighs next to nothing.
    """
    mean = np.maximum(margin / np.maximum(seen, 1)[:, None], 1e-3)
    return mean / mean.sum(1, keepdims=True)


def train(df: DataFrame, text: str = "text", lang: str = "lang", calibration: int = CALIBRATION) -> Model:
    """A model of all rows that have a text and a language. No such row: a model that knows no language.

    N-grams are counted over all rows; only the bits' margins come from about ``calibration`` of them.
    """
    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = written(_counts(rows), "ngrams")
    totals = counts.groupBy("lang", F.expr(f"feature div {1 << BITS}").alias("k")).agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in totals})
    number = {k: i for i, k in enumerate(languages)}
    table = np.zeros((len(languages), len(ORDERS)))
    for r in totals:
        table[number[r["lang"]], r["k"]] = r["n"]
    code = codewords(len(languages))
    model = Model(languages, code, _weights(counts, languages, table, code))
    if len(languages) < 2:
        return model
    share = max(1, -(-rows.count() // calibration))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, seen = np.zeros(code.shape), np.zeros(len(languages))
        for batch in batches:
            for part in bites(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), lambda r: len(r[1])):
                of = np.array([number[k] for k, _ in part])
                scores, has = shared.value.scores([t for _, t in part])
                np.add.at(seen, of[has], 1)
                np.add.at(margin, of[has], (scores * code[of])[has])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(code.size), -1 - np.arange(len(seen))), pa.int32()), pa.array(np.append(margin.ravel(), seen))], names=["at", "n"])

    sample = rows if share == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    margin_, seen_ = np.zeros(code.size), np.zeros(len(languages))
    for r in sample.mapInArrow(judge, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        table_of, at = (margin_, r["at"]) if r["at"] >= 0 else (seen_, -1 - r["at"])
        table_of[at] = r["n"]
    return replace(model, trust=trusted(margin_.reshape(code.shape), seen_))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (0 to 1) and ambiguous of every row's whole text.

    A null text, one without a letter, and any text where the model knows no language give ``und``, 0 and true.
    Repeated rows are kept; columns with the names of the three are replaced.
    """
    names = ["lang_pred", "score", "ambiguous"]
    # a text column with such a name is read before it is replaced
    at_text = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if c not in names]
    columns = [*(df.columns[i] for i in kept), *names]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = 0
            for part in bites((t.as_py() for t in batch.column(at_text)), lambda t: len(t or "")):
                known = np.zeros(len(part), bool)
                if m.languages:
                    scores, known = m.scores(part)
                    best, score, close = m.decode(scores)
                lang = [m.languages[best[i]] if known[i] else UNDETERMINED for i in range(len(part))]
                made = [pa.array(lang, pa.string()), pa.array([float(score[i]) if known[i] else 0.0 for i in range(len(part))]), pa.array([bool(close[i]) if known[i] else True for i in range(len(part))])]
                rows = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in kept] + made, names=columns)
                at += len(part)

    schema = T.StructType([df.schema[i] for i in kept])
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return df.mapInArrow(run, schema)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the rows that no model of this corpus learns from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
