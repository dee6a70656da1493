"""Questions with options scored against the frames of videos."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.operators import stats
from tidemark.sources.shared import written

SELECTORS = ["Uniform", "Relevance", "Variance", "Blend"]


def centroids(frames: DataFrame) -> DataFrame:
    """video_id and the mean vector of its frames."""
    mean = Summarizer.mean(array_to_vector(F.col("emb").cast("array<double>")))
    return frames.groupBy("video_id").agg(vector_to_array(mean).alias("mean"))


#: Questions of a block, and frames of a deal: a task holds one of each, and all its products are made by it. Frames are
#: handed to Python once a block, which takes longer than the products of a small one.
QUESTIONS, DEAL = 1024, 131_072
#: Products that a task holds at once, and those of one tile: of a block of questions with some frames, in the cache of a core.
PRODUCTS, TILE = 1 << 21, 1 << 17


def _met(questions: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows of questions (side 0) and frames (side 1) by group: a deal of a video's frames with a block of its questions.

    A question goes to every deal of its video, a frame to every block of the questions on its video, and no pair of
    them is a row. Frames of a group are in order of their place in the video.
    """
    partitions = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("video_id")
    placed = frames.select("video_id", "frame_idx", "t", "emb", (F.row_number().over(w.orderBy("frame_idx")) - 1).cast("long").alias("place"), F.count("*").over(w).alias("n"))
    blocks = questions.groupBy("video_id").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("blocks"))
    # the mean of an option's products is its product with the mean frame
    sizes = centroids(frames).join(frames.groupBy("video_id").agg(F.count("*").alias("n")), "video_id").join(blocks, "video_id")
    group = lambda block, deal: F.concat_ws(":", block, deal, F.col("video_id").cast("string")).alias("group")
    asks = questions.join(sizes, "video_id")
    asks = asks.withColumn("deal", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / DEAL).cast("int"))))
    means = F.transform("options", lambda o: vectors.dot(o, F.col("mean")))
    answer = F.col("answer_idx").cast("int") if "answer_idx" in questions.columns else F.lit(None).cast("int")
    told = F.col("told") if "told" in questions.columns else F.lit(None).cast("array<double>")
    doubles = lambda c: F.col(c).cast("array<double>")
    asks = asks.select(group(F.pmod(F.xxhash64("question_id"), "blocks"), F.col("deal")), F.lit(0).alias("side"), "video_id", "n", "question_id", F.concat(F.array(doubles("q_emb")), F.col("options").cast("array<array<double>>")).alias("asked"), means.alias("means"), answer.alias("answer"), told.alias("told"))
    rows = placed.join(blocks, "video_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(group(F.col("block"), F.floor(F.col("place") / DEAL)), F.lit(1).alias("side"), "place", "frame_idx", "t", "emb")
    return asks.unionByName(rows, allowMissingColumns=True).repartition(partitions, "group").sortWithinPartitions("group", "side", "place")


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length."""
    if lists.null_count:
        raise ValueError("a vector is null")
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Pieces of batches in which a column has one value, and that value."""
    for batch in batches:
        runs = pc.run_end_encode(batch.column(by))
        begin = 0
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            yield name, batch.slice(begin, end - begin)
            begin = end


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The questions and the frames of each group."""
    held: list[pa.RecordBatch] = []
    now = None
    for name, part in _runs(batches, "group"):
        if name != now and held:
            yield _sides(held)
            held = []
        now = name
        held.append(part)
    if held:
        yield _sides(held)


def _sides(held: list[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
    table = pa.Table.from_batches(held).combine_chunks()
    first = int(pc.sum(pc.equal(table["side"], 0)).as_py() or 0)
    return table.slice(0, first), table.slice(first)


def _padded(x: np.ndarray, more: int) -> np.ndarray:
    """Rows of zeros after the last, so that all products are made by one kernel and equal vectors have equal ones."""
    return np.pad(x, ((0, more), (0, 0)))


class Asked(NamedTuple):
    """Some questions on a deal of frames, whose vectors are ``emb``; ``asked`` [question, 1 + option, component]."""

    asks: pa.Table
    frames: pa.Table
    emb: np.ndarray
    asked: np.ndarray
    means: np.ndarray

    def tiles(self) -> Iterator[tuple[int, np.ndarray]]:
        """The first frame of each tile, and its products [question, 1 + option, frame]."""
        n, (m, width, size) = len(self.frames), self.asked.shape
        flat = _padded(self.asked.reshape(-1, size), -m * width % 64)
        step = min(max(64, TILE // len(flat) // 64 * 64), n + -n % 64)
        # all tiles have one shape; ``emb`` goes on with zeros
        for at in range(0, n, step):
            yield at, (flat @ self.emb[at : at + step].T)[: m * width, : n - at].reshape(m, width, -1)

    def sc(self, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[i, option]: sc of the question asked[i] on the frame at[i]."""
        out = np.empty((len(asked), self.asked.shape[1] - 1))
        for i in range(0, len(out), 4096):
            q = asked[i : i + 4096]
            out[i : i + 4096] = np.einsum("iod,id->io", self.asked[q, 1:], self.emb[at[i : i + 4096]]) - self.means[q]
        return out


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[Asked]:
    for asks, frames in _groups(batches):
        if not len(asks) or not len(frames):
            continue
        emb = _padded(_matrix(frames["emb"]), max(64, TILE // 64))
        width = len(asks["asked"][0])
        # at least as many as fill the 64 rows of a kernel
        step = max(1, 64 // width, PRODUCTS // (width * len(frames)))
        for at in range(0, len(asks), step):
            some = asks.slice(at, step).combine_chunks()
            yield Asked(some, frames, emb, np.array(some["asked"].to_pylist(), np.float64), np.array(some["means"].to_pylist(), np.float64))


class Scored(NamedTuple):
    """Some questions on a deal of frames: r and v [question, frame]."""

    of: Asked
    r: np.ndarray
    v: np.ndarray

    @property
    def asks(self) -> pa.Table:
        return self.of.asks

    @property
    def frames(self) -> pa.Table:
        return self.of.frames


def _sum(x: np.ndarray) -> np.ndarray:
    """Over the second axis, which is short."""
    out = x[:, 0].copy()
    for i in range(1, x.shape[1]):
        out += x[:, i]
    return out


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[Scored]:
    for x in _asked(batches):
        r, v = np.empty((2, len(x.asks), len(x.frames)))
        for at, products in x.tiles():
            end, options = at + products.shape[2], products.shape[1] - 1
            r[:, at:end] = products[:, 0]
            sc = products[:, 1:] - x.means[:, :, None]
            sc -= (_sum(sc) / options)[:, None]
            v[:, at:end] = _sum(np.square(sc, out=sc)) / options
        yield Scored(x, r, v)


def _blend(x: Scored, add: float) -> np.ndarray:
    """Mean z-score of r and v, by the means and deviations over all frames of the question's video."""
    told = x.asks["told"].to_pylist()
    here = np.stack([x.r.mean(1), x.r.std(1), x.v.mean(1), x.v.std(1)], 1)
    m = np.array([a if a is not None else b for a, b in zip(told, here, strict=True)], np.float64)
    return ((x.r - m[:, :1]) / (m[:, 1:2] + add) + (x.v - m[:, 2:3]) / (m[:, 3:] + add)) / 2


def _lists(x: np.ndarray) -> pa.Array:
    """One list per row."""
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).reshape(-1))


def _type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _told(questions: DataFrame, frames: DataFrame) -> DataFrame:
    """``questions`` with means and deviations of r and v where a video has several deals, else null."""
    long = frames.groupBy("video_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > DEAL).select("video_id")
    some, their = (df.join(long, "video_id", "left_semi") for df in (questions, frames))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _scored(batches):
            n = x.r.shape[1]
            parts = {"n": np.full(len(x.r), float(n)), "r": x.r.sum(1), "rr": (x.r**2).sum(1), "v": x.v.sum(1), "vv": (x.v**2).sum(1)}
            yield pa.RecordBatch.from_arrays([x.asks["question_id"].combine_chunks(), *map(pa.array, parts.values())], names=["question_id", *parts])

    sums = _met(some, their).mapInArrow(run, f"question_id {_type(questions, 'question_id')}, n double, r double, rr double, v double, vv double")
    sums = sums.groupBy("question_id").agg(*[F.sum(c).alias(c) for c in ("n", "r", "rr", "v", "vv")])
    mean = lambda c: F.col(c) / F.col("n")
    deviation = lambda c: F.sqrt(F.greatest(mean(c + c) - mean(c) * mean(c), F.lit(0.0)))
    told = sums.select("question_id", F.array(mean("r"), deviation("r"), mean("v"), deviation("v")).alias("told"))
    return questions.join(told, "question_id", "left")


def frame_scores(questions: DataFrame, frames: DataFrame, add: float = 1e-8, columns: tuple[str, ...] = ("question_id", "video_id", "frame_idx", "t", "r", "s", "sc", "v", "b")) -> DataFrame:
    """question_id, video_id, frame_idx, t, r, s, sc, v, b of every frame of a question's video, or those ``columns`` of them.

    r is the frame's product with the question, s with each option, sc is s less its mean over the video's frames, v
    the variance of sc across options, b the mean of the z-scores of r and v. Products are made by blocks of questions
    and deals of frames, and only the columns named leave a task. Where few rows of a question are wanted, there are
    pick_frames, whole_votes and rank_correlation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _scored(batches):
            b = _blend(x, add)
            for at, products in x.of.tiles():
                m, n, s = len(products), products.shape[2], products[:, 1:]
                end = at + n
                asked, place = np.repeat(np.arange(m), n), np.tile(np.arange(at, end), m)
                last = lambda y: _lists(y.transpose(0, 2, 1).reshape(m * n, -1))  # noqa: E731, B023
                flat = lambda y: pa.array(y[:, at:end].reshape(-1))  # noqa: E731, B023
                made = {
                    **{c: lambda c=c: x.asks[c].take(asked).combine_chunks() for c in ("question_id", "video_id")},  # noqa: B023
                    **{c: lambda c=c: x.frames[c].take(place).combine_chunks() for c in ("frame_idx", "t")},  # noqa: B023
                    "r": lambda: flat(x.r),  # noqa: B023
                    "s": lambda: last(s),  # noqa: B023
                    "sc": lambda: last(s - x.of.means[:, :, None]),  # noqa: B023
                    "v": lambda: flat(x.v),  # noqa: B023
                    "b": lambda: flat(b),  # noqa: B023
                }
                whole = pa.RecordBatch.from_arrays([made[c]() for c in columns], names=list(columns))
                for i in range(0, m * n, 1 << 16):
                    yield whole.slice(i, 1 << 16)

    types = {"question_id": _type(questions, "question_id"), "video_id": _type(questions, "video_id"), "frame_idx": _type(frames, "frame_idx"), "t": _type(frames, "t"), "s": "array<double>", "sc": "array<double>"}
    return _met(_told(questions, frames), frames).mapInArrow(run, ", ".join(f"{c} {types.get(c, 'double')}" for c in columns))


def pick_frames(questions: DataFrame, frames: DataFrame, ks: tuple[int, ...] = (4, 8, 16, 32), add: float = 1e-8) -> DataFrame:
    """The rows of ``select_frames(frame_scores(questions, frames), ks)``, of which tasks give only those that may be picked."""
    most = max(ks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _scored(batches):
            n = x.r.shape[1]
            place, total = x.frames["place"].to_numpy(), x.asks["n"][0].as_py()
            steps = {k: np.unique(np.rint(np.arange(min(k, total)) * (total - 1) / max(min(k, total) - 1, 1)).astype(np.int64)) for k in ks}
            asked, selector, k, score, at = [], [], [], [], []
            for which, scores in enumerate((x.r, x.v, _blend(x, add)), 1):
                rounded = np.round(scores, 9)
                for i, row in enumerate(rounded):
                    # equal scores go to the earlier frame: all above the least that is taken, then the first of its equals
                    least = np.partition(row, n - most)[n - most] if n > most else -np.inf
                    best = np.flatnonzero(~(row < least))
                    best = best[np.lexsort((best, -row[best]))][:most]
                    asked.append(np.full(len(best), i))
                    selector.append(np.full(len(best), which))
                    k.append(np.zeros(len(best), np.int64))
                    score.append(row[best])
                    at.append(best)
            for size, taken in steps.items():
                even = np.flatnonzero(np.isin(place, taken))
                for i in range(len(x.r)):
                    asked.append(np.full(len(even), i))
                    selector.append(np.zeros(len(even), np.int64))
                    k.append(np.full(len(even), size))
                    score.append(np.zeros(len(even)))
                    at.append(even)
            asked, selector, k, score, at = map(np.concatenate, (asked, selector, k, score, at))
            taken = [x.asks["question_id"].take(asked), x.frames["frame_idx"].take(at), x.frames["t"].take(at)]
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in taken), _lists(x.of.sc(asked, at)), pa.array(selector.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(score)], names=["question_id", "frame_idx", "t", "sc", "which", "k", "x"])

    schema = f"question_id {_type(questions, 'question_id')}, frame_idx {_type(frames, 'frame_idx')}, t {_type(frames, 't')}, sc array<double>, which int, k int, x double"
    rows = _met(_told(questions, frames), frames).mapInArrow(run, schema)
    # read twice below
    rows = written(rows.withColumn("selector", F.array(*map(F.lit, SELECTORS))[F.col("which")]), "picked")
    kept = ["question_id", "k", "selector", "frame_idx", "t", "sc"]
    rank = F.row_number().over(Window.partitionBy("question_id", "selector").orderBy(F.desc("x"), "frame_idx"))
    best = rows.filter("which > 0").withColumn("rank", rank).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("rank <= k")
    return best.select(*kept).unionByName(rows.filter("which = 0").select(*kept))


def whole_votes(questions: DataFrame, frames: DataFrame) -> DataFrame:
    """question_id, predicted, correct, margin, n_frames: the vote of all frames of a question's video (see ``vote``).

    Votes are counted where the products are made; a row per question, option and deal of frames leaves a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _asked(batches):
            m, options, n = len(x.asks), x.means.shape[1], len(x.frames)
            answer = x.asks["answer"].to_numpy()
            votes, total, margin = np.zeros((m, options), np.int64), np.zeros((m, options)), np.zeros(m)
            for _, products in x.tiles():
                sc = products[:, 1:] - x.means[:, :, None]
                rounded = np.round(sc, 9)
                voted, best = np.zeros(rounded[:, 0].shape, np.int32), rounded[:, 0]
                for o in range(1, options):
                    # the first of equals; what is no number is the largest
                    more = ~((rounded[:, o] <= best) | (best != best))
                    voted, best = np.where(more, o, voted), np.where(more, rounded[:, o], best)
                votes += np.stack([(voted == o).sum(1) for o in range(options)], 1)
                total += sc.sum(2)
                margin += sc[np.arange(m), answer].sum(1)
                sc[np.arange(m), answer] = -np.inf
                margin -= sc.max(1).sum(1)
            ids = x.asks["question_id"].take(np.repeat(np.arange(m), options)).combine_chunks()
            columns = [np.repeat(answer, options).astype(np.int32), np.tile(np.arange(options, dtype=np.int32), m), votes.reshape(-1), total.reshape(-1), np.repeat(margin, options), np.full(m * options, n)]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=["question_id", "answer_idx", "option", "votes", "total", "margin", "n_frames"])

    rows = _met(questions, frames).mapInArrow(run, f"question_id {_type(questions, 'question_id')}, answer_idx int, option int, votes long, total double, margin double, n_frames long")
    sums = rows.groupBy("question_id", "answer_idx", "option").agg(F.sum("votes").alias("votes"), F.sum("total").alias("total"), (F.sum("margin") / F.sum("n_frames")).alias("margin"), F.sum("n_frames").alias("n_frames"))
    return _decided(sums, ["question_id"])


def rank_correlation(questions: DataFrame, frames: DataFrame) -> DataFrame:
    """question_id, spearman of r and v over the frames of a question's video (see ``stats.spearman``).

    A video of one deal is ranked where its products are made; the rows of a longer one are sorted by Spark.
    """
    long = frames.groupBy("video_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > DEAL).select("video_id")

    def ranks(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        edge = np.r_[0, np.flatnonzero(np.diff(x[order])) + 1, len(x)]
        out = np.empty(len(x))
        out[order] = np.repeat((edge[:-1] + edge[1:] + 1) / 2, np.diff(edge))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _scored(batches):
            out = []
            for a, b in zip(x.r, x.v, strict=True):
                a, b = (y - y.mean() for y in (ranks(a), ranks(b)))
                size = np.sqrt((a @ a) * (b @ b))
                out.append(float(a @ b / size) if size > 0 else None)
            yield pa.RecordBatch.from_arrays([x.asks["question_id"].combine_chunks(), pa.array(out, pa.float64())], names=["question_id", "spearman"])

    one = _met(*(df.join(long, "video_id", "left_anti") for df in (questions, frames))).mapInArrow(run, f"question_id {_type(questions, 'question_id')}, spearman double")
    rows = frame_scores(*(df.join(long, "video_id", "left_semi") for df in (questions, frames)))
    return one.unionByName(stats.spearman(rows, "r", "v", ["question_id"]))


def select_frames(scores: DataFrame, ks: tuple[int, ...] = (4, 8, 16, 32)) -> DataFrame:
    """question_id, k, selector, frame_idx, t, sc of the frames each selector picks; fewer frames than k: all.

    Ranks are worked out once for all k; equal scores go to the earlier frame. Of a score, no more than the largest k
    frames of a question leave a task (Spark keeps so many before it shuffles); only the frames' places are counted
    over whole questions.
    """
    most = max(ks)
    kept = ["frame_idx", "t", "sc"]
    by_score = scores.select("question_id", *kept, F.explode(F.array(*[F.struct(F.lit(s).alias("selector"), F.round(c, 9).alias("x")) for s, c in zip(SELECTORS[1:], ("r", "v", "b"), strict=True)])).alias("_s")).select("question_id", *kept, "_s.*")
    rank = F.row_number().over(Window.partitionBy("question_id", "selector").orderBy(F.desc("x"), "frame_idx"))
    best = by_score.withColumn("rank", rank).filter(F.col("rank") <= most)
    best = best.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("rank <= k").select("question_id", "k", "selector", *kept)
    w = Window.partitionBy("question_id")
    rows = scores.select("question_id", *kept, (F.row_number().over(w.orderBy("frame_idx")) - 1).alias("place"), F.count("*").over(w).alias("n"))
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("take", F.least("k", "n"))
    steps = F.transform(F.sequence(F.lit(0), F.col("take") - 1), lambda i: F.when(F.col("take") > 1, F.bround(i * (F.col("n") - 1) / (F.col("take") - 1)).cast("long")).otherwise(F.lit(0)))
    even = rows.filter(F.array_contains(steps, F.col("place").cast("long"))).select("question_id", "k", F.lit(SELECTORS[0]).alias("selector"), *kept)
    return best.unionByName(even)


def vote(picked: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """Majority vote of frames: by, predicted, correct, margin, n_frames.

    Each frame votes for its largest sc (first of equals); equal votes are decided by the sum of sc, then the first.
    margin is the mean of the answer's sc less the largest other. ``answers`` has question_id and answer_idx.
    """
    rows = picked.join(answers, "question_id")
    best = vectors.argmax(F.transform("sc", lambda x: F.round(x, 9)))
    others = F.filter("sc", lambda x, i: i != F.col("answer_idx"))
    rows = rows.withColumns({"voted": best, "margin_one": F.element_at("sc", F.col("answer_idx") + 1) - F.array_max(others)})
    long = rows.select(*by, "answer_idx", "voted", "margin_one", F.posexplode("sc").alias("option", "x"))
    sums = long.groupBy(*by, "answer_idx", "option").agg(F.count_if(F.col("voted") == F.col("option")).alias("votes"), F.sum("x").alias("total"), F.avg("margin_one").alias("margin"), F.count("*").alias("n_frames"))
    return _decided(sums, by)


def _decided(sums: DataFrame, by: list[str]) -> DataFrame:
    """The option of most votes of each ``by``, from one row per option."""
    chosen = F.max_by("option", F.struct("votes", F.round("total", 9).alias("total"), (-F.col("option")).alias("o")))
    out = sums.groupBy(*by, "answer_idx").agg(chosen.alias("predicted"), F.first("margin").alias("margin"), F.first("n_frames").alias("n_frames"))
    return out.select(*by, "predicted", (F.col("predicted") == F.col("answer_idx")).alias("correct"), "margin", "n_frames")


def spread(picked: DataFrame, by: list[str]) -> DataFrame:
    """Minutes between the first and last picked frame, and different minutes hit."""
    return picked.groupBy(*by).agg(((F.max("t") - F.min("t")) / 60).alias("span_min"), F.countDistinct(F.floor(F.col("t") / 60)).alias("n_segments"))


def jaccard(picked: DataFrame, one: str, other: str, by: list[str]) -> DataFrame:
    """Jaccard similarity of the frames that two selectors pick."""
    sets = picked.groupBy(*by).agg(F.collect_set(F.when(F.col("selector") == one, F.col("frame_idx"))).alias("a"), F.collect_set(F.when(F.col("selector") == other, F.col("frame_idx"))).alias("b"))
    return sets.select(*by, (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard"))


#: Means of these are reported by selector and k, and intervals of the first three.
METRICS = ["vote_acc", "margin", "votes_odd", "span_min", "n_segments"]


def evaluate(questions: DataFrame, whole: DataFrame, picked: DataFrame) -> DataFrame:
    """One row per question, k and selector: the METRICS, and whole_video_acc and odd_is_answer of the question.

    votes_odd says whether the vote went to the option that is least like the others. ``questions`` has question_id,
    options and answer_idx, and is joined by Spark's choice; ``whole`` is the vote of all frames (see whole_votes).
    """
    by = ["question_id", "k", "selector"]
    answers = questions.select("question_id", "answer_idx")
    odd = vectors.odd_one_out(F.col("options"))
    once = whole.select("question_id", F.col("correct").cast("double").alias("whole_video_acc"))
    once = once.join(questions.select("question_id", odd.alias("odd"), (odd == F.col("answer_idx")).cast("double").alias("odd_is_answer")), "question_id")
    rows = vote(picked, answers, by).join(spread(picked, by), by).join(once, "question_id")
    return rows.select(*by, F.col("correct").cast("double").alias("vote_acc"), "margin", (F.col("predicted") == F.col("odd")).cast("double").alias("votes_odd"), "odd_is_answer", "whole_video_acc", "span_min", "n_segments")


def variant_nulls(questions: DataFrame, frames: DataFrame, variants: list[str], top: int = 16, block: int | None = None) -> DataFrame:
    """question_id, and z_<v> and pct_<v> of each variant, a column of option vectors; all go over the frames together."""
    name = F.concat_ws("|", F.col("question_id").cast("string"), "variant")
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("options")) for v in variants])
    rows = questions.select("question_id", "video_id", F.inline(each)).withColumn("name", name)
    z = swapped_null(rows.select(F.col("name").alias("question_id"), "video_id", "options"), frames, top, block or BLOCK)
    told = rows.select("question_id", "variant", "name").join(z.withColumnRenamed("question_id", "name"), "name")
    one = lambda c, v: F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{v}")
    return told.groupBy("question_id").agg(*[one(c, v) for v in variants for c in ("z", "pct")])


#: Questions of a block of the swapped null: every frame goes to every block, so larger ones shuffle less.
BLOCK = 2048
#: Frames of a deal of the swapped null, and its least deals.
FRAMES, DEALS = 32_768, 16


def swapped_null(questions: DataFrame, frames: DataFrame, top: int = 16, block: int = BLOCK, options: str = "options") -> DataFrame:
    """question_id, z, pct, real: a question's top-k mean variance on its own video against that on every other one.

    z is null with fewer than two other videos or none of its own. Questions are dealt to blocks of about ``block`` and
    frames to deals, a video to one of them if it is not long; every deal meets every block in a task, which holds the
    block and multiplies runs of frames with it. It keeps, per question and video, only its largest values, so no pair of
    rows is made, no vector reaches the driver, and the plan is the same for any number of questions.
    ``questions`` has question_id, video_id and ``options`` (arrays of equal size). An option that is null counts as a
    row of no question.
    """
    # read three times below, so the products are made once and their means written
    per = written(null_values(questions.select("question_id", "video_id", F.col(options).alias("options")), frames, top, block), "null")
    own = questions.select("question_id", F.col("video_id").alias("own"))
    per = per.join(own, "question_id").withColumn("mine", F.col("video_id") == F.col("own"))
    real = per.filter("mine").groupBy("question_id").agg(F.max("x").alias("real"))
    x = F.col("x")
    sums = per.filter("NOT mine").join(real, "question_id", "left").groupBy("question_id").agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.count(x).alias("n"), F.count_if(x < F.col("real") - 1e-12).alias("below"))
    rows = per.select("question_id").distinct().join(real, "question_id", "left").join(sums, "question_id", "left")
    z = F.when((F.col("n") >= 2) & F.col("real").isNotNull(), (F.col("real") - F.col("m")) / (F.col("s") + 1e-12))
    return rows.select("question_id", "real", z.alias("z"), F.when(z.isNotNull(), F.col("below") / F.col("n")).alias("pct"))


def null_values(questions: DataFrame, frames: DataFrame, top: int, block: int) -> DataFrame:
    """question_id, video_id, x: the mean of the ``top`` largest option variances of every question on every video."""
    partitions = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-questions.count() // block))
    deals = max(DEALS, -(-frames.count() // FRAMES))
    group = lambda block, deal: F.concat_ws(":", block, deal).alias("group")
    asks = questions.filter("options IS NOT NULL").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    asks = asks.select(group(F.pmod(F.xxhash64("question_id"), F.lit(blocks)), F.col("deal")), F.lit(0).alias("side"), F.lit("").alias("run"), F.lit(0).alias("kind"), "question_id", F.col("options").cast("array<array<double>>").alias("options"))
    # vectors travel as they are; a video's mean comes before its frames, in each of the deals that a long one has
    means = centroids(frames).join(frames.groupBy("video_id").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("parts")), "video_id")
    parted = frames.select("video_id", "emb").join(means.select("video_id", "parts"), "video_id").select("video_id", F.pmod(F.xxhash64("emb"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "emb")
    first = means.select("video_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "mean")
    rows = parted.unionByName(first, allowMissingColumns=True).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(group(F.col("block"), F.pmod(F.xxhash64("video_id", "part"), F.lit(deals))), F.lit(1).alias("side"), F.concat_ws(":", "part", F.col("video_id").cast("string")).alias("run"), "kind", "video_id", "mean", "emb")
    dealt = asks.unionByName(rows, allowMissingColumns=True).repartition(partitions, "group").sortWithinPartitions("group", "side", "run", "kind")
    dealt = dealt.withColumn("run", F.concat_ws(":", "group", "side", "run"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = group = ids = flat = shift = best = video = None

        def told() -> Iterator[pa.RecordBatch]:
            if best is not None and best.shape[1]:
                yield pa.RecordBatch.from_arrays([ids, video.take(pa.array(np.zeros(len(ids), np.int64))), _lists(best)], names=["question_id", "video_id", "values"])

        for name, part in _runs(batches, "run"):
            if name != now:
                yield from told()
                now, best = name, None
            if part.column("side")[0].as_py() == 0:
                if held and held[0].column("group")[0] != part.column("group")[0]:
                    held = []  # a group without frames
                held.append(part)
                continue
            if held:
                own, held = pa.Table.from_batches(held), []
                group, ids = own["group"][0], own["question_id"].combine_chunks()
                options = np.array(own["options"].to_pylist(), np.float64)
                flat = options.reshape(-1, options.shape[2]).T
            if part.column("group")[0] != group:
                continue  # a group without questions
            if best is None:
                best, shift, video = np.empty((len(ids), 0)), np.array(part.column("mean")[0].as_py(), np.float64), part.column("video_id").slice(0, 1)
                part = part.slice(1)
            if not len(part):
                continue
            emb = _matrix(pa.chunked_array([part.column("emb")])) - shift
            for at in range(0, len(emb), max(1, PRODUCTS // flat.shape[1])):
                products = emb[at : at + max(1, PRODUCTS // flat.shape[1])] @ flat
                best = np.concatenate([best, products.reshape(len(products), len(ids), -1).var(2).T], 1)
                if best.shape[1] > top:
                    best = np.partition(best, best.shape[1] - top, 1)[:, -top:]
        yield from told()

    tops = dealt.mapInArrow(run, f"question_id {_type(questions, 'question_id')}, video_id {_type(frames, 'video_id')}, values array<double>")
    # as many short lists as a long video has parts
    best = F.slice(F.sort_array(F.flatten(F.collect_list("values")), asc=False), 1, top)
    return tops.groupBy("question_id", "video_id").agg(best.alias("best")).select("question_id", "video_id", vectors.mean(F.col("best")).alias("x"))
