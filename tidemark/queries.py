"""Queries over the stand-in tables, and their DuckDB SQL.

The tables of the studies (cues, frames, questions, catalogue) are read from tables that have their shape: cues and
peaks from events, frames and questions from embeddings, the catalogue from part, option texts from conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import BoundaryConfig
from tidemark.functions import lexicon, options, vectors
from tidemark.operators import encode, events, evidence, intervals, matching, sampling, signals, stats
from tidemark.plans import jobs
from tidemark.sources import archives, files, listing
from tidemark.sources.shared import shared_folder

DAY = 86400.0
VISUAL = ("view", "click")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def six(x: str | Column) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


# --- stand-ins -------------------------------------------------------------------------------------------------------


def seconds(ts: str = "ts") -> Column:
    """Seconds since the first of January 2024."""
    return (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6


def cues(spark, sf_dir) -> DataFrame:
    """video = user, from the time of an event on, as long as 60 times its value."""
    t = seconds()
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("cue_idx"), t.alias("start"), (t + F.col("value") * 60).alias("end"), F.col("event_type").alias("text"))


def samples(spark, sf_dir) -> DataFrame:
    """An irregular series per user and modality."""
    modality = F.when(F.col("event_type").isin(*VISUAL), "visual").otherwise("text")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), modality.alias("modality"), F.col("event_id").alias("id"), seconds().alias("t"), F.col("value").alias("raw"))


def peaks(spark, sf_dir) -> DataFrame:
    """Samples with a z-score per series; those of 1 and more are peaks."""
    rows = signals.zscore(samples(spark, sf_dir), ["video_id", "modality"], "raw")
    return rows.withColumn("is_peak", F.col("norm") >= 1)


def frames(spark, sf_dir) -> DataFrame:
    """video = label, two seconds apart in order of vec_id."""
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), at.alias("frame_idx"), (at * 2.0).alias("t"), "vec_id", F.col("embedding").alias("emb"))


def questions(spark, sf_dir) -> DataFrame:
    """A stated query set against all frames: vectors whose id is divisible by 20 ask, the four after each are its options."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    asks = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("label").alias("video_id"), F.col("embedding").alias("q_emb"))
    opts = e.filter("vec_id % 20 BETWEEN 1 AND 4").select((F.col("vec_id") - F.col("vec_id") % 20).alias("question_id"), F.col("vec_id").alias("o"), F.col("embedding").alias("x"))
    opts = opts.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda z: z["x"]).alias("options")).filter(F.size("options") == 4)
    return asks.join(opts, "question_id").withColumn("answer_idx", (F.floor(F.col("question_id") / 20) % 4).cast("int"))


def catalogue(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("domain"), F.col("p_brand").alias("sub"), F.col("p_size").alias("mb"), F.col("p_name").alias("name"))


_T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE"
_CUES = f"cues AS (SELECT user_id AS video_id, event_id AS cue_idx, {_T} AS s, {_T} + value * 60 AS e, event_type AS text FROM events)"
_SAMPLES = f"samples AS (SELECT user_id AS video_id, CASE WHEN event_type IN ('view', 'click') THEN 'visual' ELSE 'text' END AS modality, event_id AS id, {_T} AS t, value AS raw FROM events)"
_PEAKS = _SAMPLES + ", norms AS (SELECT *, avg(raw) OVER w AS m, stddev_pop(raw) OVER w AS sd FROM samples WINDOW w AS (PARTITION BY video_id, modality)), signal AS (SELECT video_id, modality, id, t, raw, CASE WHEN sd <= 1e-12 THEN 0 ELSE (raw - m) / sd END AS norm FROM norms), peaks AS (SELECT * FROM signal WHERE norm >= 1)"
_NEAR = """, pairs AS (SELECT p.video_id, p.modality, p.t, p.norm AS score, q.t AS qt, q.norm AS qs, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.t - q.t), q.t) AS rn FROM peaks p LEFT JOIN peaks q ON p.video_id = q.video_id AND p.modality <> q.modality),
near AS (SELECT video_id, modality, t, score, qs, abs(t - qt) AS gap FROM pairs WHERE rn = 1)"""
_FRAMES = "frames AS (SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 2.0::DOUBLE AS t, vec_id, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings)"
_QUESTIONS = "questions AS (SELECT a.vec_id AS question_id, a.label AS video_id, CAST(a.embedding AS DOUBLE[]) AS q_emb, a.vec_id // 20 % 4 AS answer_idx FROM embeddings a WHERE vec_id % 20 = 0 AND EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id = a.vec_id + 4)), opts AS (SELECT vec_id - vec_id % 20 AS question_id, vec_id % 20 - 1 AS o, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 20 BETWEEN 1 AND 4)"


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


_SCORES = f"""{_FRAMES}, {_QUESTIONS},
raw AS (SELECT q.question_id, q.video_id, q.answer_idx, f.frame_idx, f.t, o.o, {_dot("f.emb", "q.q_emb")} AS r, {_dot("f.emb", "o.x")} AS s FROM frames f JOIN questions q USING (video_id) JOIN opts o USING (question_id)),
cent AS (SELECT *, s - avg(s) OVER (PARTITION BY question_id, o) AS sc FROM raw),
fr AS (SELECT question_id, video_id, answer_idx, frame_idx, t, min(r) AS r, var_pop(sc) AS v, list(sc ORDER BY o) AS sc FROM cent GROUP BY ALL),
scores AS (SELECT *, ((r - avg(r) OVER w) / (stddev_pop(r) OVER w + 1e-8) + (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8)) / 2 AS b FROM fr WINDOW w AS (PARTITION BY question_id))"""
_PICKED = f"""{_SCORES},
ranked AS (SELECT question_id, answer_idx, frame_idx, t, sc, row_number() OVER (PARTITION BY question_id ORDER BY frame_idx) - 1 AS place, count(*) OVER (PARTITION BY question_id) AS n,
  row_number() OVER (PARTITION BY question_id ORDER BY round(r, 9) DESC, frame_idx) AS rr, row_number() OVER (PARTITION BY question_id ORDER BY round(v, 9) DESC, frame_idx) AS rv, row_number() OVER (PARTITION BY question_id ORDER BY round(b, 9) DESC, frame_idx) AS rb FROM scores),
ks AS (SELECT *, least(k, n) AS take FROM ranked, (SELECT unnest([4, 8, 16, 32]) AS k)),
picked AS (SELECT question_id, answer_idx, k, 'Relevance' AS selector, frame_idx, t, sc FROM ks WHERE rr <= take UNION ALL SELECT question_id, answer_idx, k, 'Variance', frame_idx, t, sc FROM ks WHERE rv <= take UNION ALL SELECT question_id, answer_idx, k, 'Blend', frame_idx, t, sc FROM ks WHERE rb <= take
  UNION ALL SELECT question_id, answer_idx, k, 'Uniform', frame_idx, t, sc FROM ks WHERE list_contains(list_transform(range(take), lambda i: CASE WHEN take > 1 THEN CAST(round_even(i * (n - 1)::DOUBLE / (take - 1), 0) AS BIGINT) ELSE 0 END), place))"""


def _vote_sql(source: str, by: str) -> str:
    return f"""votes AS (SELECT {by}, answer_idx, frame_idx, sc, list_position(list_transform(sc, lambda x: round(x, 9)), list_max(list_transform(sc, lambda x: round(x, 9)))) - 1 AS voted, sc[answer_idx + 1] - list_max(list_filter(sc, lambda x, i: i <> answer_idx + 1)) AS m1 FROM {source}),
long AS (SELECT {by}, answer_idx, voted, m1, unnest(sc) AS x, unnest([0, 1, 2, 3]) AS option FROM votes),
sums AS (SELECT {by}, answer_idx, option, count(*) FILTER (voted = option) AS votes, round(sum(x), 9) AS total, avg(m1) AS margin, count(*) AS n_frames FROM long GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY votes DESC, total DESC, option) AS rn FROM sums),
voted AS (SELECT {by}, option AS predicted, option = answer_idx AS correct, margin, n_frames FROM best WHERE rn = 1)"""


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


# --- time grids, windows, coverage -----------------------------------------------------------------------------------


@query("cue_windows", f"""WITH {_CUES}, d AS (SELECT video_id, max(e) AS dur FROM cues GROUP BY 1),
w AS (SELECT video_id, dur, unnest(range(CAST(ceil(dur / 43200) AS BIGINT))) AS i FROM d),
m AS (SELECT w.video_id, i, (i * 43200::DOUBLE + least((i + 1) * 43200::DOUBLE, dur)) / 2 AS t, c.* EXCLUDE (video_id) FROM w JOIN cues c ON c.video_id = w.video_id AND c.s < least((i + 1) * 43200::DOUBLE, dur) AND c.e > i * 43200::DOUBLE)
SELECT video_id, i, round(min(t), 6) AS t, string_agg(text, ' ' ORDER BY s, cue_idx) AS text FROM m GROUP BY video_id, i""")
def cue_windows(spark, sf_dir):
    """Texts of half-day windows."""
    return intervals.cue_windows(cues(spark, sf_dir), 43200.0).select("video_id", "i", six("t").alias("t"), "text")


@query("context_text", f"""WITH {_CUES}, {_PEAKS}
SELECT p.video_id, round(p.t, 6) AS t, coalesce(string_agg(c.text, ' ' ORDER BY c.s, c.cue_idx), '') AS subtitle_text FROM peaks p LEFT JOIN cues c ON c.video_id = p.video_id AND c.s <= p.t + 7200 AND c.e >= p.t - 7200 GROUP BY p.video_id, p.t""")
def context_text(spark, sf_dir):
    """Texts around peaks."""
    points = peaks(spark, sf_dir).filter("is_peak").select("video_id", "t")
    return intervals.context_text(points, cues(spark, sf_dir), 7200.0).select("video_id", six("t").alias("t"), "subtitle_text")


@query("coverage", f"""WITH {_CUES}, d AS (SELECT video_id, max(e) AS dur FROM cues GROUP BY 1),
o AS (SELECT c.video_id, greatest(s, 0) AS s, least(e, dur) AS e, cue_idx FROM cues c JOIN d USING (video_id) WHERE least(e, dur) > greatest(s, 0)),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY video_id ORDER BY s, e, cue_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM o),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY s, e, cue_idx ROWS UNBOUNDED PRECEDING) AS island FROM f),
h AS (SELECT video_id, island, max(e) - min(s) AS len FROM g GROUP BY ALL)
SELECT video_id, round(least(sum(len) / any_value(dur), 1), 6) AS coverage FROM h JOIN d USING (video_id) GROUP BY video_id""")
def coverage(spark, sf_dir):
    """Share of time under cues."""
    c = cues(spark, sf_dir)
    return intervals.coverage(c, c.groupBy("video_id").agg(F.max("end").alias("duration"))).select("video_id", six("coverage").alias("coverage"))


@query("moving_mean", f"WITH {_SAMPLES} SELECT id, round(avg(raw) OVER (PARTITION BY video_id ORDER BY t, id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS mean FROM samples")
def moving_mean(spark, sf_dir):
    """W4"""
    rows = samples(spark, sf_dir).withColumn("_o", F.struct("t", "id"))
    return intervals.moving_mean(rows, "raw", "video_id", "_o").select("id", six("mean").alias("mean"))


@query("time_grid", """WITH v AS (SELECT p_partkey AS video_id, p_size * 1.5::DOUBLE AS dur FROM part)
SELECT video_id, i, i * 2.0::DOUBLE AS t FROM (SELECT video_id, unnest(range(CAST(ceil(dur / 2) AS BIGINT))) AS i FROM v)""")
def time_grid(spark, sf_dir):
    """G1: frames every two seconds."""
    return intervals.time_grid(catalogue(spark, sf_dir).select(F.col("id").alias("video_id"), (F.col("mb") * 1.5).alias("duration")), 2.0)


@query("index_grid", """WITH v AS (SELECT p_partkey AS video_id, p_size * 40 AS n, 29.97::DOUBLE AS fps FROM part),
k AS (SELECT *, unnest(range(CAST(ceil(n / fps) AS BIGINT))) AS k FROM v)
SELECT video_id, CAST(floor(k * fps) AS BIGINT) AS frame_no, round(floor(k * fps) / fps, 6) AS t, floor(floor(k * fps) / 300) AS batch, round(n / fps, 6) AS duration FROM k WHERE floor(k * fps) < n""")
def index_grid(spark, sf_dir):
    """One frame a second by its number, in batches."""
    v = intervals.duration_of(catalogue(spark, sf_dir).select(F.col("id").alias("video_id"), (F.col("mb") * 40).alias("n_frames"), F.lit(29.97).alias("fps")))
    rows = intervals.batches(intervals.index_grid(v).withColumn("frame_idx", F.col("frame_no")), 300)
    return rows.join(v.select("video_id", "duration"), "video_id").select("video_id", "frame_no", six("t").alias("t"), F.col("batch").cast("double").alias("batch"), six("duration").alias("duration"))


# --- signals ---------------------------------------------------------------------------------------------------------


@query("change_scores", f"""WITH {_FRAMES}, l AS (SELECT *, lag(emb) OVER (PARTITION BY video_id ORDER BY t) AS before FROM frames)
SELECT video_id, t, round(1 - {_dot("emb", "before")} / (sqrt({_dot("emb", "emb")}) * sqrt({_dot("before", "before")})), 6) AS raw, round({_dot("emb", "before")} / (sqrt({_dot("emb", "emb")}) * sqrt({_dot("before", "before")})), 6) AS similarity FROM l WHERE before IS NOT NULL""")
def change_scores(spark, sf_dir):
    """T1, P14, P15"""
    rows = signals.change_scores(frames(spark, sf_dir), ["video_id"])
    return rows.select("video_id", "t", six("raw").alias("raw"), six(1 - F.col("raw")).alias("similarity"))


@query("normalised_vectors", f"WITH {_FRAMES} SELECT vec_id, round(sqrt({_dot('emb', 'emb')}), 6) AS norm, round(emb[1] / greatest(sqrt({_dot('emb', 'emb')}), 1e-12), 6) AS first FROM frames")
def normalised_vectors(spark, sf_dir):
    """P13"""
    return frames(spark, sf_dir).select("vec_id", six(vectors.norm(F.col("emb"))).alias("norm"), six(vectors.normalise(F.col("emb"))[0]).alias("first"))


@query("zscores", f"WITH {_SAMPLES} SELECT id, round(CASE WHEN stddev_pop(raw) OVER w <= 1e-12 THEN 0 ELSE (raw - avg(raw) OVER w) / stddev_pop(raw) OVER w END, 6) AS z, round((raw - avg(raw) OVER w) / (stddev_pop(raw) OVER w + 1e-8), 6) AS z_eps, least(round(CASE WHEN stddev_pop(raw) OVER w <= 1e-12 THEN 0 ELSE (raw - avg(raw) OVER w) / stddev_pop(raw) OVER w END, 6), 2) AS shown FROM samples WINDOW w AS (PARTITION BY video_id, modality)")
def zscores(spark, sf_dir):
    """T5, T7, P16"""
    rows = signals.zscore(samples(spark, sf_dir), ["video_id", "modality"], "raw", "z")
    rows = signals.zscore(rows, ["video_id", "modality"], "raw", "z_eps", floor=-1.0, add=1e-8)
    return rows.select("id", six("z").alias("z"), six("z_eps").alias("z_eps"), F.least(six("z"), F.lit(2.0)).alias("shown"))


@query("robust_scale", f"""WITH {_SAMPLES}, q AS (SELECT video_id, quantile_cont(raw, 0.05) AS lo, quantile_cont(raw, 0.95) AS hi FROM samples GROUP BY 1)
SELECT id, round(CASE WHEN hi - lo <= 1e-12 THEN 0 ELSE least(greatest((raw - lo) / (hi - lo), 0), 1) END, 6) AS norm FROM samples JOIN q USING (video_id)""")
def robust_scale(spark, sf_dir):
    """T6"""
    return signals.robust_scale(samples(spark, sf_dir), ["video_id"], "raw").select("id", six("norm").alias("norm"))


@query("sample_width", f"""WITH {_SAMPLES}, d AS (SELECT video_id, t - lag(t) OVER (PARTITION BY video_id ORDER BY t) AS d FROM samples)
SELECT video_id, round(median(d), 6) AS step, round(greatest(86400 / greatest(median(d), 1e-9), 1), 6) AS width FROM d GROUP BY video_id""")
def sample_width(spark, sf_dir):
    """T2"""
    return signals.width_in_samples(samples(spark, sf_dir), ["video_id"], DAY).select("video_id", six("step").alias("step"), six("width").alias("width"))


_SERIES = f"{_SAMPLES}, series AS (SELECT video_id, id, t, raw, row_number() OVER (PARTITION BY video_id ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM samples), steps AS (SELECT video_id, greatest(86400 / greatest(median(d), 1e-9), 1) AS w FROM (SELECT video_id, t - lag(t) OVER (PARTITION BY video_id ORDER BY t) AS d FROM series) GROUP BY 1)"


def _series_signal(spark, sf_dir, **settings) -> DataFrame:
    config = BoundaryConfig(smoothing_seconds=DAY, peak_prominence=0.5, peak_min_spacing=2 * DAY, **settings)
    return signals.signals(samples(spark, sf_dir).select("video_id", "t", "raw"), ["video_id"], config)


@query("gaussian_smoothing", f"""WITH {_SERIES}, o AS (SELECT s.video_id, s.i, s.n, w, unnest(range(-CAST(floor(4 * w + 0.5) AS BIGINT), CAST(floor(4 * w + 0.5) AS BIGINT) + 1)) AS k FROM series s JOIN steps USING (video_id))
SELECT o.video_id, o.i, round(CASE WHEN any_value(o.n) < 3 THEN any_value(z.raw) FILTER (k = 0) ELSE sum(z.raw * exp(-0.5 * (k / w) * (k / w))) / sum(exp(-0.5 * (k / w) * (k / w))) END, 6) AS smooth FROM o JOIN series z ON z.video_id = o.video_id AND z.i = least(greatest(o.i + k, 0), o.n - 1) GROUP BY o.video_id, o.i""")
def gaussian_smoothing(spark, sf_dir):
    """T3"""
    return _series_signal(spark, sf_dir).select("video_id", "i", six("smooth").alias("smooth"))


@query("moving_average", f"""WITH {_SERIES}, o AS (SELECT s.video_id, s.i, s.n, unnest(range(-(greatest(CAST(round_even(w, 0) AS BIGINT), 1) // 2), greatest(CAST(round_even(w, 0) AS BIGINT), 1) - greatest(CAST(round_even(w, 0) AS BIGINT), 1) // 2)) AS k FROM series s JOIN steps USING (video_id))
SELECT o.video_id, o.i, round(CASE WHEN any_value(o.n) < 3 THEN any_value(z.raw) FILTER (k = 0) ELSE avg(z.raw) END, 6) AS smooth FROM o JOIN series z ON z.video_id = o.video_id AND z.i = least(greatest(o.i + k, 0), o.n - 1) GROUP BY o.video_id, o.i""")
def moving_average(spark, sf_dir):
    """T4"""
    return _series_signal(spark, sf_dir, smoothing="moving_average").select("video_id", "i", six("smooth").alias("smooth"))


#: Local maxima of the values v of x (video_id, i, t, n, v), and the least values on either side up to the next higher one.
_MAXIMA = """r AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, v ORDER BY i) AS g FROM x), runs AS (SELECT video_id, v, min(i) AS a, max(i) AS b, any_value(n) AS n FROM r GROUP BY video_id, v, g),
m AS (SELECT c.video_id, c.v, (c.a + c.b) // 2 AS i FROM runs c JOIN x l ON l.video_id = c.video_id AND l.i = c.a - 1 AND l.v < c.v JOIN x h ON h.video_id = c.video_id AND h.i = c.b + 1 AND h.v < c.v WHERE c.n >= 3),
s AS (SELECT m.*, coalesce((SELECT max(i) FROM x WHERE x.video_id = m.video_id AND x.i < m.i AND x.v > m.v), -1) AS lo, coalesce((SELECT min(i) FROM x WHERE x.video_id = m.video_id AND x.i > m.i AND x.v > m.v), 1000000000) AS hi FROM m),
q AS (SELECT s.video_id, s.i, s.v, min(x.v) FILTER (x.i <= s.i) AS l, min(x.v) FILTER (x.i >= s.i) AS h FROM s JOIN x ON x.video_id = s.video_id AND x.i > s.lo AND x.i < s.hi GROUP BY ALL)"""


@query("prominent_peaks", f"""WITH {_SERIES}, x AS (SELECT video_id, i, t, n, CASE WHEN stddev_pop(raw) OVER p <= 1e-12 THEN 0 ELSE (raw - avg(raw) OVER p) / stddev_pop(raw) OVER p END AS v FROM series WINDOW p AS (PARTITION BY video_id)),
{_MAXIMA}
SELECT video_id, i, round(v - greatest(l, h), 6) AS prominence FROM q WHERE v - greatest(l, h) >= 0.5""")
def prominent_peaks(spark, sf_dir):
    """Peaks before spacing."""
    config = BoundaryConfig(smoothing="none", peak_prominence=0.5, peak_min_spacing=0.0)
    rows = signals.signals(samples(spark, sf_dir).select("video_id", "t", "raw"), ["video_id"], config)
    return rows.filter("is_peak").select("video_id", "i", six("prominence").alias("prominence"))


@query("boundary_signal", f"""WITH RECURSIVE {_SERIES}, o AS (SELECT s.video_id, s.i, s.n, w, unnest(range(-CAST(floor(4 * w + 0.5) AS BIGINT), CAST(floor(4 * w + 0.5) AS BIGINT) + 1)) AS k FROM series s JOIN steps USING (video_id)),
g AS (SELECT o.video_id, o.i, any_value(o.n) AS n, CASE WHEN any_value(o.n) < 3 THEN any_value(z.raw) FILTER (k = 0) ELSE sum(z.raw * exp(-0.5 * (k / w) * (k / w))) / sum(exp(-0.5 * (k / w) * (k / w))) END AS y FROM o JOIN series z ON z.video_id = o.video_id AND z.i = least(greatest(o.i + k, 0), o.n - 1) GROUP BY o.video_id, o.i),
x AS (SELECT g.video_id, g.i, s.t, g.n, CASE WHEN stddev_pop(y) OVER p <= 1e-12 THEN 0 ELSE (y - avg(y) OVER p) / stddev_pop(y) OVER p END AS v FROM g JOIN series s ON s.video_id = g.video_id AND s.i = g.i WINDOW p AS (PARTITION BY g.video_id)),
{_MAXIMA},
c AS (SELECT q.video_id, x.t, row_number() OVER (PARTITION BY q.video_id ORDER BY q.v - greatest(l, h) DESC, q.i DESC) AS k FROM q JOIN x ON x.video_id = q.video_id AND x.i = q.i WHERE q.v - greatest(l, h) >= 0.5),
kept AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS ts FROM x UNION ALL
  SELECT c.video_id, c.k, CASE WHEN len(list_filter(ts, lambda y: abs(y - c.t) < {2 * DAY})) = 0 THEN list_append(ts, c.t) ELSE ts END FROM kept JOIN c ON c.video_id = kept.video_id AND c.k = kept.k + 1),
chosen AS (SELECT video_id, arg_max(ts, k) AS ts FROM kept GROUP BY video_id)
SELECT video_id, CAST(i AS INTEGER) AS i, round(t, 6) AS t, round(v, 6) AS norm, list_contains(ts, t) AS is_peak FROM x JOIN chosen USING (video_id)""")
def boundary_signal(spark, sf_dir):
    """The whole series job."""
    return _series_signal(spark, sf_dir).select("video_id", "i", six("t").alias("t"), six("norm").alias("norm"), "is_peak")


@query("top_apart", f"""WITH {_SAMPLES}, one AS (SELECT video_id, id, t, raw FROM samples QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY raw DESC, t DESC) = 1),
two AS (SELECT s.video_id, s.id, s.t, s.raw FROM samples s JOIN one o ON o.video_id = s.video_id AND abs(s.t - o.t) >= {2 * DAY} QUALIFY row_number() OVER (PARTITION BY s.video_id ORDER BY s.raw DESC, s.t DESC) = 1),
three AS (SELECT s.video_id, s.id, s.t, s.raw FROM samples s JOIN one o ON o.video_id = s.video_id AND abs(s.t - o.t) >= {2 * DAY} JOIN two w ON w.video_id = s.video_id AND abs(s.t - w.t) >= {2 * DAY} QUALIFY row_number() OVER (PARTITION BY s.video_id ORDER BY s.raw DESC, s.t DESC) = 1)
SELECT video_id, id, round(t, 6) AS t, raw FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)""")
def top_apart(spark, sf_dir):
    """The three largest values of a series that lie two days apart."""
    return signals.top_apart(samples(spark, sf_dir).select("video_id", "id", "t", "raw"), ["video_id"], "t", "raw", 3, 2 * DAY).withColumn("t", six("t"))


# --- joins and events ------------------------------------------------------------------------------------------------


@query("nearest_peak", f"WITH {_PEAKS}{_NEAR} SELECT video_id, modality, round(t, 6) AS t, round(gap, 6) AS distance FROM near")
def nearest_peak(spark, sf_dir):
    """The closest peak of the other modality; null where there is none."""
    p = peaks(spark, sf_dir).filter("is_peak").select("video_id", "modality", "t")
    sides = [matching.nearest(p.filter(F.col("modality") == a), p.filter(F.col("modality") == b).select("video_id", "t")) for a, b in (events.MODALITIES, events.MODALITIES[::-1])]
    rows = sides[0].unionByName(sides[1])
    return rows.select("video_id", "modality", six("t").alias("t"), F.when(F.col("distance") < float("inf"), six("distance")).alias("distance"))


_EVENTS = f"""WITH {_CUES}, {_PEAKS}{_NEAR}, across AS (SELECT n.*, s.norm AS sample, row_number() OVER (PARTITION BY n.video_id, n.modality, n.t ORDER BY abs(n.t - s.t), s.t) AS rn FROM near n LEFT JOIN signal s ON s.video_id = n.video_id AND s.modality <> n.modality),
ev AS (SELECT video_id, modality, t, score, gap, coalesce(gap <= 21600, false) AS aligned, CASE WHEN gap <= 21600 THEN qs ELSE sample END AS other FROM across WHERE rn = 1)"""


def _events(spark, sf_dir, with_cues: bool = False) -> DataFrame:
    return events.event_table(peaks(spark, sf_dir), cues(spark, sf_dir) if with_cues else None, 21600.0, 7200.0)


@query("event_table", _EVENTS + """, txt AS (SELECT e.video_id, e.t, string_agg(c.text, ' ' ORDER BY c.s, c.cue_idx) AS text FROM (SELECT DISTINCT video_id, t FROM ev) e JOIN cues c ON c.video_id = e.video_id AND c.s <= e.t + 7200 AND c.e >= e.t - 7200 GROUP BY ALL)
SELECT e.video_id, modality, round(e.t, 6) AS timestamp_seconds, round(CASE WHEN modality = 'visual' THEN score ELSE other END, 6) AS visual_score, round(CASE WHEN modality = 'text' THEN score ELSE other END, 6) AS text_score, round(gap, 6) AS nearest_other_peak_seconds, CASE WHEN aligned THEN 'aligned' ELSE modality || '-only' END AS event_type, coalesce(text, '') AS subtitle_text FROM ev e LEFT JOIN txt USING (video_id, t)""")
def event_table(spark, sf_dir):
    """A3, J2, J3"""
    e = _events(spark, sf_dir, True)
    d = F.col("nearest_other_peak_seconds")
    return e.select("video_id", "modality", six("timestamp_seconds").alias("timestamp_seconds"), six("visual_score").alias("visual_score"), six("text_score").alias("text_score"), F.when(d < float("inf"), six(d)).alias("nearest_other_peak_seconds"), "event_type", "subtitle_text")


_TOL = ", tol AS (SELECT unnest([3600, 21600, 86400])::DOUBLE AS tolerance_seconds), al AS (SELECT *, coalesce(gap <= tolerance_seconds, false) AS near FROM ev, tol)"
_SHARES = "round(avg(near::INT) FILTER (modality = 'visual'), 6) AS visual_alignment_fraction, round(avg(near::INT) FILTER (modality = 'text'), 6) AS text_alignment_fraction"
TOLERANCES = (3600.0, 21600.0, 86400.0)


@query("video_alignment", _EVENTS + _TOL + f" SELECT video_id, tolerance_seconds, {_SHARES}, count(*) FILTER (modality = 'visual' AND NOT near) AS visual_only, count(*) FILTER (modality = 'text' AND NOT near) AS text_only, count(*) FILTER (modality = 'visual' AND near) AS aligned_pairs FROM al GROUP BY ALL")
def video_alignment(spark, sf_dir):
    """A1"""
    rows = events.alignment(_events(spark, sf_dir), TOLERANCES)
    return rows.withColumns({c: six(c) for c in ("visual_alignment_fraction", "text_alignment_fraction")})


@query("pooled_alignment", _EVENTS + _TOL + f" SELECT tolerance_seconds, {_SHARES} FROM al GROUP BY ALL")
def pooled_alignment(spark, sf_dir):
    """A2"""
    rows = events.alignment(_events(spark, sf_dir), TOLERANCES, by_video=False)
    return rows.withColumns({c: six(c) for c in ("visual_alignment_fraction", "text_alignment_fraction")})


@query("event_counts", _EVENTS + " SELECT video_id, count(*) FILTER (modality = 'visual' AND NOT aligned) AS visual_only, count(*) FILTER (modality = 'text' AND NOT aligned) AS text_only, count(*) FILTER (modality = 'visual' AND aligned) AS shared FROM ev GROUP BY video_id")
def event_counts(spark, sf_dir):
    """A4"""
    return events.event_counts(_events(spark, sf_dir))


_STATS = _EVENTS + """, d AS (SELECT video_id, max(e) AS dur FROM cues GROUP BY 1),
o AS (SELECT c.video_id, greatest(s, 0) AS s, least(e, dur) AS e, cue_idx FROM cues c JOIN d USING (video_id) WHERE least(e, dur) > greatest(s, 0)),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY video_id ORDER BY s, e, cue_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM o),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY s, e, cue_idx ROWS UNBOUNDED PRECEDING) AS island FROM f),
h AS (SELECT video_id, island, max(e) - min(s) AS len FROM g GROUP BY ALL), cov AS (SELECT video_id, least(sum(len) / any_value(dur), 1) AS coverage, any_value(dur) AS dur FROM h JOIN d USING (video_id) GROUP BY video_id),
sig AS (SELECT video_id, avg(raw) FILTER (modality = 'visual') AS av, count(*) FILTER (modality = 'visual' AND norm >= 1) AS vp, count(*) FILTER (modality = 'text' AND norm >= 1) AS tp FROM signal GROUP BY 1),
st AS (SELECT video_id, dur, coverage, av, vp, tp, CASE WHEN coverage >= median(coverage) OVER () THEN 'high' ELSE 'low' END || ' speech / ' || CASE WHEN av >= median(av) OVER () THEN 'high' ELSE 'low' END || ' visual change' AS grp FROM cov JOIN sig USING (video_id))"""


def _stats(spark, sf_dir) -> DataFrame:
    c = cues(spark, sf_dir)
    return events.grouped(events.video_stats(peaks(spark, sf_dir), c, c.groupBy("video_id").agg(F.max("end").alias("duration"))))


@query("video_stats", _STATS + ' SELECT video_id, round(dur, 6) AS duration_seconds, round(coverage, 6) AS subtitle_coverage, round(av, 6) AS average_visual_change, vp AS visual_peaks, tp AS text_peaks, grp AS "group" FROM st')
def video_stats(spark, sf_dir):
    """A6, and the groups of A5"""
    return _stats(spark, sf_dir).withColumns({c: six(c) for c in ("duration_seconds", "subtitle_coverage", "average_visual_change")})


@query("group_alignment", _STATS + ' SELECT grp AS "group", count(DISTINCT video_id) AS videos, round(avg(gap), 6) AS mean_nearest_distance, round(avg(aligned::INT), 6) AS aligned FROM ev JOIN st USING (video_id) WHERE modality = \'visual\' GROUP BY grp')
def group_alignment(spark, sf_dir):
    """A5, J5"""
    rows = events.group_alignment(_events(spark, sf_dir), _stats(spark, sf_dir), 21600.0)
    return rows.withColumns({c: six(c) for c in ("mean_nearest_distance", "aligned")})


@query("distance_histogram", _EVENTS + ", r AS (SELECT min(gap) AS lo, max(gap) AS hi FROM ev) SELECT CAST(CASE WHEN hi > lo THEN least(floor((gap - lo) / ((hi - lo) / 30)), 29) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM ev, r WHERE gap IS NOT NULL GROUP BY 1")
def distance_histogram(spark, sf_dir):
    """A7"""
    return events.histogram(_events(spark, sf_dir), "nearest_other_peak_seconds").select(F.col("bin").cast("long").alias("bin"), "n")


@query("matched_strengths", _EVENTS + " SELECT video_id, round(t, 6) AS timestamp_seconds, round(score, 6) AS visual_score, round(other, 6) AS text_score FROM ev WHERE modality = 'visual' AND aligned AND other IS NOT NULL")
def matched_strengths(spark, sf_dir):
    """A8"""
    return events.matched_strengths(_events(spark, sf_dir)).select("video_id", *[six(c).alias(c) for c in ("timestamp_seconds", "visual_score", "text_score")])


# --- questions, options, evidence ------------------------------------------------------------------------------------


@query("frame_scores", f"WITH {_SCORES} SELECT question_id, frame_idx, round(r, 6) AS r, round(v, 6) AS v, round(b, 5) AS b, round(sc[1], 6) AS sc0 FROM scores")
def frame_scores(spark, sf_dir):
    """E3, J10"""
    scores = evidence.frame_scores(questions(spark, sf_dir), frames(spark, sf_dir), columns=("question_id", "frame_idx", "r", "v", "b", "sc"))
    return scores.select("question_id", "frame_idx", six("r").alias("r"), six("v").alias("v"), F.round("b", 5).alias("b"), six(F.col("sc")[0]).alias("sc0"))


@query("topk_mean", f"WITH {_SCORES}, k AS (SELECT question_id, v, row_number() OVER (PARTITION BY question_id ORDER BY v DESC) AS rn FROM scores) SELECT question_id, round(avg(v), 6) AS top FROM k WHERE rn <= 16 GROUP BY question_id")
def topk_mean(spark, sf_dir):
    """K6: mean of the 16 largest variances."""
    best = evidence.pick_frames(questions(spark, sf_dir), frames(spark, sf_dir), (16,)).filter("selector = 'Variance'")
    return best.groupBy("question_id").agg(six(F.avg(vectors.variance(F.col("sc")))).alias("top"))


_NULL = f"""{_FRAMES}, {_QUESTIONS},
sim AS (SELECT q.question_id, q.video_id AS own, f.video_id, f.frame_idx, o.o, {_dot("f.emb", "o.x")} AS s FROM frames f, questions q JOIN opts o USING (question_id)),
ce AS (SELECT *, s - avg(s) OVER (PARTITION BY question_id, video_id, o) AS sc FROM sim), va AS (SELECT question_id, own, video_id, frame_idx, var_pop(sc) AS v FROM ce GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id, video_id ORDER BY v DESC) AS rn FROM va), tp AS (SELECT question_id, own, video_id, avg(v) AS x FROM rk WHERE rn <= 16 GROUP BY ALL),
re AS (SELECT question_id, x AS real FROM tp WHERE own = video_id), nu AS (SELECT question_id, any_value(real) AS real, (any_value(real) - avg(x)) / (stddev_pop(x) + 1e-12) AS z, avg((x < real - 1e-12)::INT) AS pct FROM tp JOIN re USING (question_id) WHERE own <> video_id GROUP BY question_id)"""


@query("swapped_null", f"WITH {_NULL} SELECT question_id, round(real, 6) AS real, round(z, 5) AS z, round(pct, 6) AS pct FROM nu")
def swapped_null(spark, sf_dir):
    """E4, J8"""
    rows = evidence.swapped_null(questions(spark, sf_dir), frames(spark, sf_dir).select("video_id", "emb"))
    return rows.select("question_id", six("real").alias("real"), F.round("z", 5).alias("z"), six("pct").alias("pct"))


@query("signal_summary", f"""WITH {_NULL}, g AS (SELECT CAST(question_id // 20 % 3 AS VARCHAR) AS grp, z FROM nu), a AS (SELECT * FROM g UNION ALL SELECT 'All', z FROM g)
SELECT grp AS "group", 'z' AS variant, count(*) AS n, round(median(z), 5) AS median_z, round(avg((z > 1.645)::INT), 6) AS share FROM a GROUP BY grp""")
def signal_summary(spark, sf_dir):
    """A12"""
    z = evidence.swapped_null(questions(spark, sf_dir), frames(spark, sf_dir).select("video_id", "emb"))
    rows = stats.signal_summary(z.withColumn("g", (F.floor(F.col("question_id") / 20) % 3).cast("string")), "g", ["z"])
    return rows.select("group", "variant", "n", F.round("median_z", 5).alias("median_z"), six("share").alias("share"))


def _picked(spark, sf_dir, ks: tuple[int, ...] = (4, 8, 16, 32)) -> DataFrame:
    return evidence.pick_frames(questions(spark, sf_dir), frames(spark, sf_dir), ks)


def _whole(spark, sf_dir) -> DataFrame:
    return evidence.whole_votes(questions(spark, sf_dir), frames(spark, sf_dir))


@query("selected_frames", f"WITH {_PICKED} SELECT question_id, k, selector, frame_idx, t FROM picked")
def selected_frames(spark, sf_dir):
    """K7"""
    return _picked(spark, sf_dir).select("question_id", "k", "selector", "frame_idx", "t")


def _answers(spark, sf_dir) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", "answer_idx")


@query("frame_votes", f"WITH {_PICKED}, {_vote_sql('picked', 'question_id, k, selector')} SELECT question_id, k, selector, predicted, correct, round(margin, 6) AS margin, n_frames FROM voted")
def frame_votes(spark, sf_dir):
    """E5"""
    return evidence.vote(_picked(spark, sf_dir), _answers(spark, sf_dir), ["question_id", "k", "selector"]).withColumn("margin", six("margin"))


@query("whole_video_votes", f"WITH {_SCORES}, {_vote_sql('scores', 'question_id')} SELECT question_id, predicted, correct, round(margin, 6) AS margin, n_frames FROM voted")
def whole_video_votes(spark, sf_dir):
    """E6"""
    return _whole(spark, sf_dir).withColumn("margin", six("margin"))


_ODD = f"""{_QUESTIONS}, od AS (SELECT a.question_id, a.o, round(sum(1 - {_dot("a.x", "b.x")}), 9) AS d FROM opts a JOIN opts b ON a.question_id = b.question_id AND a.o <> b.o GROUP BY ALL),
odd AS (SELECT question_id, o AS odd FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d DESC, o) AS rn FROM od) WHERE rn = 1)"""


@query("odd_one_out", f"WITH {_ODD}, sp AS (SELECT a.question_id, avg(1 - {_dot('a.x', 'b.x')}) AS spread FROM opts a JOIN opts b ON a.question_id = b.question_id AND a.o < b.o GROUP BY 1) SELECT question_id, CAST(odd AS INTEGER) AS odd, odd = answer_idx AS is_answer, round(spread, 6) AS spread FROM questions JOIN odd USING (question_id) JOIN sp USING (question_id)")
def odd_one_out(spark, sf_dir):
    """E7, A9, J9, A18"""
    odd = vectors.odd_one_out(F.col("options"))
    return questions(spark, sf_dir).select("question_id", odd.alias("odd"), (odd == F.col("answer_idx")).alias("is_answer"), six(vectors.mean_pairwise_distance(F.col("options"))).alias("spread"))


@query("selection_spread", f"WITH {_PICKED} SELECT question_id, k, selector, round((max(t) - min(t)) / 60, 6) AS span_min, count(DISTINCT floor(t / 60)) AS n_segments FROM picked GROUP BY ALL")
def selection_spread(spark, sf_dir):
    """E8, P17"""
    return evidence.spread(_picked(spark, sf_dir), ["question_id", "k", "selector"]).withColumn("span_min", six("span_min"))


_JACCARD = f"{_PICKED}, ja AS (SELECT question_id, count(*) FILTER (n = 2)::DOUBLE / count(*) AS j FROM (SELECT question_id, frame_idx, count(*) AS n FROM picked WHERE k = 16 AND selector IN ('Relevance', 'Variance') GROUP BY ALL) GROUP BY question_id)"


@query("selector_overlap", f"""WITH {_JACCARD}, rr AS (SELECT question_id, rank() OVER (PARTITION BY question_id ORDER BY r) + (count(*) OVER (PARTITION BY question_id, r) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY question_id ORDER BY v) + (count(*) OVER (PARTITION BY question_id, v) - 1) / 2.0::DOUBLE AS b FROM scores),
sp AS (SELECT question_id, corr(a, b) AS s FROM rr GROUP BY question_id) SELECT question_id, round(j, 6) AS jaccard, round(s, 6) AS spearman FROM ja JOIN sp USING (question_id)""")
def selector_overlap(spark, sf_dir):
    """E9, A13"""
    j = evidence.jaccard(_picked(spark, sf_dir, (16,)), "Relevance", "Variance", ["question_id"])
    return j.join(evidence.rank_correlation(questions(spark, sf_dir), frames(spark, sf_dir)), "question_id").select("question_id", six("jaccard").alias("jaccard"), six("spearman").alias("spearman"))


@query("overlap_summary", f"WITH {_JACCARD} SELECT count(j) AS n, round(avg(j), 6) AS mean, round(stddev_samp(j), 6) AS std, round(min(j), 6) AS least, round(quantile_cont(j, 0.25), 6) AS q1, round(median(j), 6) AS median, round(quantile_cont(j, 0.75), 6) AS q3, round(max(j), 6) AS largest FROM ja")
def overlap_summary(spark, sf_dir):
    """A16"""
    j = evidence.jaccard(_picked(spark, sf_dir, (16,)), "Relevance", "Variance", ["question_id"])
    rows = stats.describe(j, "jaccard")
    return rows.select("n", *[six(c).alias(c) for c in rows.columns if c != "n"])


@query("selector_accuracy", f"WITH {_PICKED}, {_vote_sql('picked', 'question_id, k, selector')} SELECT k, " + ", ".join(f"round(avg(correct::INT) FILTER (selector = '{s}'), 6) AS \"{s}\"" for s in evidence.SELECTORS) + " FROM voted GROUP BY k")
def selector_accuracy(spark, sf_dir):
    """One row per k, one column per selector."""
    votes = evidence.vote(_picked(spark, sf_dir), _answers(spark, sf_dir), ["question_id", "k", "selector"])
    rows = votes.groupBy("k").pivot("selector", evidence.SELECTORS).agg(F.avg(F.col("correct").cast("double")))
    return rows.select("k", *[six(s).alias(s) for s in evidence.SELECTORS])


@query("group_accuracy", f"WITH {_PICKED}, {_vote_sql('picked', 'question_id, k, selector')} SELECT question_id // 20 % 3 AS g, " + ", ".join(f"round(avg(correct::INT) FILTER (selector = '{s}'), 6) AS \"{s}\"" for s in evidence.SELECTORS) + " FROM voted WHERE k = 16 GROUP BY 1")
def group_accuracy(spark, sf_dir):
    """A15"""
    picked = _picked(spark, sf_dir, (16,))
    votes = evidence.vote(picked, _answers(spark, sf_dir), ["question_id", "selector"])
    rows = votes.groupBy((F.floor(F.col("question_id") / 20) % 3).alias("g")).pivot("selector", evidence.SELECTORS).agg(F.avg(F.col("correct").cast("double")))
    return rows.select("g", *[six(s).alias(s) for s in evidence.SELECTORS])


_EVAL = f"""{_PICKED}, {_vote_sql('picked', 'question_id, k, selector')}, od AS (SELECT a.question_id, a.o, round(sum(1 - {_dot("a.x", "b.x")}), 9) AS d FROM opts a JOIN opts b ON a.question_id = b.question_id AND a.o <> b.o GROUP BY ALL),
odd AS (SELECT question_id, o AS odd FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d DESC, o) AS rn FROM od) WHERE rn = 1),
sp AS (SELECT question_id, k, selector, (max(t) - min(t)) / 60 AS span_min, count(DISTINCT floor(t / 60)) AS n_segments FROM picked GROUP BY ALL),
ev AS (SELECT question_id, k, selector, correct::INT::DOUBLE AS vote_acc, margin, (predicted = odd)::INT::DOUBLE AS votes_odd, span_min, n_segments FROM voted JOIN sp USING (question_id, k, selector) JOIN odd USING (question_id))"""


def _eval(spark, sf_dir) -> DataFrame:
    return evidence.evaluate(questions(spark, sf_dir), _whole(spark, sf_dir), _picked(spark, sf_dir))


@query("selector_report", f"WITH {_EVAL} SELECT k, " + ", ".join(f"round(avg({m}) FILTER (selector = '{s}'), 6) AS \"{s}_{m}\"" for s in evidence.SELECTORS for m in evidence.METRICS) + " FROM ev GROUP BY k")
def selector_report(spark, sf_dir):
    """Five metrics by k and selector."""
    rows = stats.wide_means(_eval(spark, sf_dir), "k", "selector", evidence.SELECTORS, evidence.METRICS)
    return rows.select("k", *[six(c).alias(c) for c in rows.columns if c != "k"])


_U = "CAST(('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query("bootstrap_ci", f"""WITH r AS (SELECT label, vec_id, {_dot("CAST(embedding AS DOUBLE[])", "CAST(embedding AS DOUBLE[])")} AS x FROM embeddings),
h AS (SELECT label, x, b, md5(concat_ws('|', 0, b, vec_id)) AS h FROM r, (SELECT unnest(range(500)) AS b)),
w AS (SELECT label, b * 4 + i AS k, x, {" + ".join(f"(u >= {c})::INT" for c in stats.POISSON)} AS w FROM (SELECT *, {_U} AS u FROM h, (SELECT unnest(range(4)) AS i))),
m AS (SELECT label, k, sum(w * x) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0)
SELECT label, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi FROM m JOIN (SELECT label, avg(x) AS mean FROM r GROUP BY 1) USING (label) GROUP BY label""")
def bootstrap_ci(spark, sf_dir):
    """Of the squared lengths of all vectors, 2000 resamples."""
    rows = read(spark, sf_dir, "embeddings").select("label", "vec_id", vectors.dot(F.col("embedding"), F.col("embedding")).alias("x"))
    return stats.bootstrap(rows, "x", ["label"], key="vec_id").select("label", six("mean").alias("mean"), six("ci_lo").alias("ci_lo"), six("ci_hi").alias("ci_hi"))


@query("selector_intervals", f"""WITH {_EVAL}, r AS (SELECT question_id, selector, unnest(['vote_acc', 'margin', 'votes_odd']) AS metric, unnest([vote_acc, margin, votes_odd]) AS x FROM ev WHERE k = 16),
h AS (SELECT question_id, b, md5(concat_ws('|', 0, b, question_id)) AS h FROM (SELECT DISTINCT question_id FROM r), (SELECT unnest(range(500)) AS b)),
w AS (SELECT question_id, b * 4 + i AS j, {" + ".join(f"(u >= {c})::INT" for c in stats.POISSON)} AS w FROM (SELECT *, {_U} AS u FROM h, (SELECT unnest(range(4)) AS i))),
m AS (SELECT selector, metric, j, sum(w * x) / sum(w) AS m FROM w JOIN r USING (question_id) GROUP BY ALL HAVING sum(w) > 0)
SELECT selector, metric, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi FROM m JOIN (SELECT selector, metric, avg(x) AS mean FROM r GROUP BY ALL) USING (selector, metric) GROUP BY selector, metric""")
def selector_intervals(spark, sf_dir):
    """A17 over A14: intervals of three metrics by selector at k = 16."""
    rows = stats.intervals(_eval(spark, sf_dir).filter("k = 16"), ["selector"], evidence.METRICS[:3], "question_id")
    return rows.select("selector", "metric", *[six(c).alias(c) for c in ("mean", "ci_lo", "ci_hi")])


@query("spearman_matrix", """WITH x AS (SELECT p_partkey AS id, unnest(['size', 'price', 'key']) AS c, unnest([p_size::DOUBLE, p_retailprice, p_partkey::DOUBLE]) AS x FROM part),
r AS (SELECT id, c, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2.0::DOUBLE AS r FROM x)
SELECT p.c AS a, q.c AS b, round(corr(p.r, q.r), 6) AS spearman FROM r p JOIN r q USING (id) GROUP BY ALL""")
def spearman_matrix(spark, sf_dir):
    """A13 over a whole table"""
    rows = read(spark, sf_dir, "part").select(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("key"))
    return stats.spearman_matrix(rows, ["size", "price", "key"]).withColumn("spearman", six("spearman"))


def _option_rows(spark, sf_dir) -> DataFrame:
    """A question per part: its options are the words of its name in several orders and forms."""
    n = F.col("p_name")
    opts = F.array(F.concat(F.lit("A. "), n), F.concat(F.lit("B) "), F.array_join(F.reverse(F.split(n, " ")), " ")), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("C. "), F.col("p_size").cast("string"), F.lit(" of them"))).otherwise(F.concat(F.lit("C. "), n)), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("D. after "), n)).otherwise(F.concat(F.lit(" D. "), n)))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("task_type"), options.strip_options(opts).alias("options"), F.array(*map(F.lit, "ABCD"))[(F.col("p_partkey") % 4).cast("int")].alias("answer"))


_OPTS = """q AS (SELECT p_partkey AS question_id, p_type AS task_type, p_partkey % 4 AS answer_idx, [p_name, list_aggregate(list_reverse(string_split(p_name, ' ')), 'string_agg', ' '), CASE WHEN p_partkey % 3 = 0 THEN p_size || ' of them' ELSE p_name END, CASE WHEN p_partkey % 5 = 0 THEN 'after ' || p_name ELSE p_name END] AS options FROM part),
bags AS (SELECT *, list_transform(options, lambda o: list_sort(regexp_extract_all(lower(o), '\\w+'))) AS bags FROM q),
perm AS (SELECT *, len(bags[1]) > 1 AND bags[1] = bags[2] AND bags[1] = bags[3] AND bags[1] = bags[4] AS perm FROM bags),
tags AS (SELECT question_id, task_type, answer_idx, options, perm, list_transform(options, lambda o: CASE WHEN regexp_matches(o, '^\\W*\\d[\\d,.]*\\b') AND len(string_split(o, ' ')) <= 5 THEN 'Numeric' WHEN perm OR regexp_matches(o, '(?i)\\b(after|before|first|last|next)\\b') THEN 'Temporal/order' WHEN len(list_intersect(regexp_extract_all(lower(o), '[a-z]+'), ['red','orange','yellow','green','blue','purple','pink','white','black','gray','grey','brown','golden','silver','beige'])) > 0 OR regexp_matches(lower(o), '\\b(ring|widget|gear|anvil)\\b') THEN 'Concrete visual' ELSE 'Abstract' END) AS types FROM perm)"""


#: Stands for a user's lexicon: two words of concrete categories, one with two of them, two nouns of which one is too short to
#: count, and categories that are not concrete.
LEXICON = [("ring", "fashion"), ("widget", "tool"), ("widget", "toy"), ("gear", "noun"), ("anvil", "noun"), ("of", "noun"), ("plate", "idea"), ("rod", "measure"), ("new", "time")]


def _lexicon(spark) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(c).alias("category")) for w, c in LEXICON])))


def _option_texts(spark, sf_dir) -> DataFrame:
    return _option_rows(spark, sf_dir).select("question_id", F.posexplode("options").alias("o", "text"))


def _option_types(spark, sf_dir) -> DataFrame:
    """question_id, task_type, o, type: a row per option, which takes along what its tag depends on."""
    rows = _option_rows(spark, sf_dir).withColumn("perm", options.is_permutation(F.col("options")))
    long = rows.select("question_id", "task_type", "perm", F.posexplode("options").alias("o", "text"))
    long = lexicon.concrete(long, ["question_id", "o"], "text", _lexicon(spark))
    return long.select("question_id", "task_type", "o", options.option_type(F.col("text"), F.col("perm"), F.col("concrete")).alias("type"))


def _tagged(spark, sf_dir) -> DataFrame:
    """Options with their tags."""
    rows = _option_rows(spark, sf_dir).withColumn("perm", options.is_permutation(F.col("options")))
    long = _option_types(spark, sf_dir)
    types = long.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "type"))), lambda x: x["type"]).alias("types"))
    return rows.join(types.hint("merge"), "question_id")


_LEXICON = "lexicon AS (SELECT unnest([" + ", ".join(f"'{w}'" for w, _ in LEXICON) + "]) AS word, unnest([" + ", ".join(f"'{c}'" for _, c in LEXICON) + "]) AS category)"


@query("lexicon_counts", f"""WITH {_OPTS}, {_LEXICON}, w AS (SELECT question_id, unnest(range(4)) AS o, unnest(options) AS text FROM q), x AS (SELECT question_id, o, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM w)
SELECT question_id, CAST(o AS INTEGER) AS o, category, count(*) AS n FROM x JOIN lexicon USING (word) WHERE category <> 'noun' OR length(word) > 2 GROUP BY ALL""")
def lexicon_counts(spark, sf_dir):
    """Words of the options by category of the lexicon."""
    return lexicon.lookup(_option_texts(spark, sf_dir), ["question_id", "o"], "text", _lexicon(spark))


@query("option_tags", f"""WITH {_OPTS}, cnt AS (SELECT *, list_transform(['Numeric', 'Temporal/order', 'Concrete visual', 'Abstract'], lambda k: len(list_filter(types, lambda t: t = k))) AS counts FROM tags)
SELECT question_id, array_to_string(types, '|') AS types, ['Numeric', 'Temporal/order', 'Concrete visual', 'Abstract'][list_position(counts, list_max(counts))] AS option_type, perm, round(list_avg(list_transform(options, lambda o: len(string_split(o, ' ')))), 6) AS n_words, CAST(answer_idx AS INTEGER) AS answer_idx, 'Question: ' || task_type || ' Answer: ' || options[1] AS prompt FROM cnt""")
def option_tags(spark, sf_dir):
    """P1, P2, P7-P12"""
    rows = _tagged(spark, sf_dir).withColumnRenamed("types", "tags")
    return rows.select("question_id", F.array_join("tags", "|").alias("types"), options.dominant(F.col("tags")).alias("option_type"), "perm", six(options.mean_words(F.col("options"))).alias("n_words"), options.answer_index(F.col("answer")).alias("answer_idx"), options.prompts(F.col("task_type"), F.col("options"))[0].alias("prompt"))


@query("option_crosstab", f"""WITH {_OPTS}, x AS (SELECT task_type, unnest(types) AS t FROM tags)
SELECT task_type, """ + ", ".join(f"round(count(*) FILTER (t = '{t}')::DOUBLE / count(*), 6) AS \"{t}\"" for t in options.TYPES) + " FROM x GROUP BY task_type")
def option_crosstab(spark, sf_dir):
    """A11"""
    rows = stats.crosstab_shares(_option_types(spark, sf_dir), "task_type", "type", options.TYPES)
    return rows.select("task_type", *[six(F.col(f"`{t}`")).alias(t) for t in options.TYPES])


def _variants(spark, sf_dir) -> DataFrame:
    """Questions with both kinds of option vectors (E10): alone, and, for the template, with the question's vector added."""
    q = questions(spark, sf_dir)
    plus = F.transform("options", lambda o: vectors.normalise(F.zip_with(o, F.col("q_emb"), lambda x, y: x + y)))
    return q.withColumns({"alone": F.transform("options", lambda o: vectors.normalise(o)), "template": plus})


_VARIANTS = f"""{_QUESTIONS}, plus AS (SELECT question_id, o, x, list_transform(list_zip(x, q_emb), lambda z: z[1] + z[2]) AS y FROM opts JOIN questions USING (question_id)),
unit AS (SELECT question_id, o, list_transform(x, lambda v: v / sqrt({_dot("x", "x")})) AS alone, list_transform(y, lambda v: v / sqrt({_dot("y", "y")})) AS template FROM plus)"""


@query("spread_by_task", f"""WITH {_VARIANTS}, sp AS (SELECT a.question_id, avg(1 - {_dot('a.template', 'b.template')}) AS template, avg(1 - {_dot('a.alone', 'b.alone')}) AS alone FROM unit a JOIN unit b ON a.question_id = b.question_id AND a.o < b.o GROUP BY 1)
SELECT video_id AS task, count(*) AS n, round(avg(template), 6) AS template, round(avg(alone), 6) AS alone, round(avg(template) / avg(alone), 6) AS compression FROM sp JOIN questions USING (question_id) GROUP BY 1""")
def spread_by_task(spark, sf_dir):
    """A10: options in the template lie closer together than alone."""
    spread = lambda c: vectors.mean_pairwise_distance(F.col(c))
    rows = stats.spread_by_task(_variants(spark, sf_dir).select(F.col("video_id").alias("task"), spread("template").alias("a"), spread("alone").alias("b")), "task", "a", "b")
    return rows.select("task", "n", *[six(c).alias(c) for c in ("template", "alone", "compression")])


@query("variant_votes", f"""WITH {_FRAMES}, {_VARIANTS}, raw AS (SELECT q.question_id, q.answer_idx, f.frame_idx, u.o, unnest(['alone', 'template']) AS variant, unnest([{_dot('f.emb', 'u.alone')}, {_dot('f.emb', 'u.template')}]) AS s FROM frames f JOIN questions q USING (video_id) JOIN unit u USING (question_id)),
cent AS (SELECT *, s - avg(s) OVER (PARTITION BY question_id, variant, o) AS x FROM raw), fr AS (SELECT question_id, variant, answer_idx, frame_idx, list(x ORDER BY o) AS sc FROM cent GROUP BY ALL), {_vote_sql('fr', 'question_id, variant')}
SELECT question_id, variant, predicted, correct, round(margin, 6) AS margin, n_frames FROM voted""")
def variant_votes(spark, sf_dir):
    """The vote of all frames under either kind of option vectors; a question's vectors of both go over the frames once."""
    kinds = F.array(*[F.struct(F.struct(F.col("question_id").alias("question_id"), F.lit(k).alias("variant")).alias("question_id"), F.col(k).alias("options")) for k in ("alone", "template")])
    q = _variants(spark, sf_dir).select("video_id", "q_emb", "answer_idx", F.inline(kinds))
    return evidence.whole_votes(q, frames(spark, sf_dir)).select("question_id.*", "predicted", "correct", six("margin").alias("margin"), "n_frames")


@query("variant_nulls", f"""WITH {_FRAMES}, {_VARIANTS}, sim AS (SELECT q.question_id, q.video_id AS own, f.video_id, f.frame_idx, u.o, unnest(['alone', 'template']) AS variant, unnest([{_dot('f.emb', 'u.alone')}, {_dot('f.emb', 'u.template')}]) AS s FROM frames f, questions q JOIN unit u USING (question_id)),
ce AS (SELECT *, s - avg(s) OVER (PARTITION BY question_id, variant, video_id, o) AS sc FROM sim), va AS (SELECT question_id, variant, own, video_id, frame_idx, var_pop(sc) AS v FROM ce GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id, variant, video_id ORDER BY v DESC) AS rn FROM va), tp AS (SELECT question_id, variant, own, video_id, avg(v) AS x FROM rk WHERE rn <= 16 GROUP BY ALL),
re AS (SELECT question_id, variant, x AS real FROM tp WHERE own = video_id), nu AS (SELECT question_id, variant, (any_value(real) - avg(x)) / (stddev_pop(x) + 1e-12) AS z, avg((x < real - 1e-12)::INT) AS pct FROM tp JOIN re USING (question_id, variant) WHERE own <> video_id GROUP BY ALL)
SELECT question_id, round(max(z) FILTER (variant = 'alone'), 5) AS z_alone, round(max(pct) FILTER (variant = 'alone'), 6) AS pct_alone, round(max(z) FILTER (variant = 'template'), 5) AS z_template, round(max(pct) FILTER (variant = 'template'), 6) AS pct_template FROM nu GROUP BY question_id""")
def variant_nulls(spark, sf_dir):
    """The null of both kinds of option vectors, in one pass over the frames."""
    rows = evidence.variant_nulls(_variants(spark, sf_dir), frames(spark, sf_dir).select("video_id", "emb"), ["alone", "template"])
    return rows.select("question_id", *[F.round(c, 5 if c[0] == "z" else 6).alias(c) for c in rows.columns[1:]])


# --- samples and splits ----------------------------------------------------------------------------------------------

_H = "md5({} || ':' || CAST({} AS VARCHAR))"


@query("allocation", """WITH s AS (SELECT p_type AS stratum, count(*) AS size FROM part GROUP BY 1), t AS (SELECT sum(size) - 3 * count(*) AS cap, 60 - 3 * count(*) AS lft FROM s),
b AS (SELECT stratum, size, (size - 3) * lft // cap AS base, (size - 3) * lft % cap AS rest, lft FROM s, t), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, size DESC, stratum) AS rn, lft - sum(base) OVER () AS more FROM b)
SELECT stratum, size, CAST(3 + base + (rn <= more)::INT AS BIGINT) AS quota FROM r""")
def allocation(spark, sf_dir):
    """K1"""
    return sampling.allocate(catalogue(spark, sf_dir).groupBy(F.col("domain").alias("stratum")).agg(F.count("*").alias("size")), 60, 3)


_QUOTA = """s AS (SELECT p_type AS domain, count(*) AS size FROM part GROUP BY 1), t AS (SELECT sum(size) - 3 * count(*) AS cap, 60 - 3 * count(*) AS lft FROM s),
b AS (SELECT domain, size, (size - 3) * lft // cap AS base, (size - 3) * lft % cap AS rest, lft FROM s, t), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, size DESC, domain) AS rn, lft - sum(base) OVER () AS more FROM b),
quotas AS (SELECT domain, CAST(3 + base + (rn <= more)::INT AS BIGINT) AS quota FROM r)"""


@query("stratified_sample", f"""WITH {_QUOTA}, cells AS (SELECT p_type AS domain, p_brand AS sub, count(*) AS size FROM part GROUP BY ALL),
f AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY {_H.format("'7'", "sub")}, sub) <= quota)::BIGINT AS one FROM cells JOIN quotas USING (domain)),
l AS (SELECT *, quota - sum(one) OVER (PARTITION BY domain) AS lft, sum(size - one) OVER (PARTITION BY domain) AS room FROM f),
d AS (SELECT *, CASE WHEN room > 0 THEN (size - one) * lft // greatest(room, 1) ELSE 0 END AS base, CASE WHEN room > 0 THEN (size - one) * lft % greatest(room, 1) ELSE 0 END AS rest FROM l),
takes AS (SELECT domain, sub, one + base + (row_number() OVER (PARTITION BY domain ORDER BY rest DESC, size - one DESC, sub) <= lft - sum(base) OVER (PARTITION BY domain))::BIGINT AS take FROM d),
p AS (SELECT p_partkey AS id, p_type AS domain, p_brand AS sub, p_size AS mb, p_name AS name, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY {_H.format("'7'", "p_partkey")}, p_partkey) AS rn FROM part)
SELECT id, domain, sub, mb, name FROM p JOIN takes USING (domain, sub) WHERE rn <= take""")
def stratified_sample(spark, sf_dir):
    """K2; its properties (quotas, cover, repeatability) are tested too."""
    return sampling.stratified(catalogue(spark, sf_dir), "domain", "sub", "id", 60, 3, 7)


@query("dev_split", f"""WITH r AS (SELECT p_partkey AS id, p_type AS domain, row_number() OVER (PARTITION BY p_type ORDER BY {_H.format("'7'", "p_partkey")}, p_partkey) AS rn FROM part) SELECT id, domain, CASE WHEN rn <= 100 THEN 'dev' ELSE 'test' END AS split FROM r""")
def dev_split(spark, sf_dir):
    """K3, J4"""
    return sampling.split(catalogue(spark, sf_dir), "domain", "id", 100, 7).select("id", "domain", "split")


@query("per_task_sample", f"""WITH r AS (SELECT p_partkey AS id, p_brand AS sub, row_number() OVER (PARTITION BY p_brand ORDER BY {_H.format("'3'", "p_partkey")}, p_partkey) AS rn FROM part) SELECT id, sub FROM r WHERE rn <= 25""")
def per_task_sample(spark, sf_dir):
    """K4"""
    return sampling.at_most(catalogue(spark, sf_dir), "sub", "id", 25, 3).select("id", "sub")


@query("round_robin", "WITH r AS (SELECT p_partkey AS id, p_type AS domain, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS rn FROM part WHERE p_size < 40) SELECT id, domain FROM r ORDER BY rn, domain LIMIT 20")
def round_robin(spark, sf_dir):
    """The smallest of each domain in turn; the limit is the feature."""
    return sampling.round_robin(catalogue(spark, sf_dir).filter("mb < 40"), "domain", 20, "mb", "id").select("id", "domain")


@query("first_assets", "WITH r AS (SELECT p_name AS name, p_partkey AS id, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part WHERE lower(p_type) = 'economy') SELECT name, CASE WHEN length(CAST(id AS VARCHAR)) < 3 THEN lpad(CAST(id AS VARCHAR), 3, '0') ELSE CAST(id AS VARCHAR) END AS video_id FROM r WHERE rn = 1")
def first_assets(spark, sf_dir):
    """P3, P4, P5"""
    rows = sampling.first_per(catalogue(spark, sf_dir).filter(F.lower("domain") == "economy"), "name", "id")
    return rows.select("name", sampling.zero_pad(F.col("id").cast("string")).alias("video_id"))


@query("domain_counts", "SELECT p_type AS domain, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC")
def domain_counts(spark, sf_dir):
    """A19"""
    return catalogue(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain")


@query("strongest_peak", f"WITH {_PEAKS} SELECT video_id, arg_max(id, (norm, -id)) AS id FROM signal WHERE modality = 'visual' GROUP BY video_id")
def strongest_peak(spark, sf_dir):
    """The sample of largest z of each video."""
    rows = peaks(spark, sf_dir).filter("modality = 'visual'")
    return rows.groupBy("video_id").agg(F.max_by("id", F.struct("norm", -F.col("id"))).alias("id"))


@query("task_groups", "SELECT c_mktsegment AS task, count(*) AS n, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'machines' ELSE 'rest' END AS grp FROM customer GROUP BY 1")
def task_groups(spark, sf_dir):
    """A small dimension, and an error for what it does not know."""
    names = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("task")).groupBy("task").agg(F.count("*").alias("n"))
    dim = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(g).alias("grp")) for t, g in (("AUTOMOBILE", "machines"), ("MACHINERY", "machines"), ("BUILDING", "rest"), ("FURNITURE", "rest"), ("HOUSEHOLD", "rest"))])))
    unknown = F.raise_error(F.concat(F.lit("no group for task "), F.col("task"))).cast("string")
    return names.join(F.broadcast(dim), "task", "left").withColumn("grp", F.coalesce("grp", unknown))


# --- encoding --------------------------------------------------------------------------------------------------------


@query("cache_keys", """SELECT conv_id, turn, substr(sha256('{"conv_id":' || conv_id || ',"turn":' || turn || ',"model":"hashing-32"}'), 1, 16) AS cache_key FROM conversations""")
def cache_keys(spark, sf_dir):
    """E2"""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    return rows.select("conv_id", "turn", encode.cache_key(F.col("conv_id"), F.col("turn"), F.lit("hashing-32").alias("model")).alias("cache_key"))


@query("uncached_texts", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def uncached_texts(spark, sf_dir):
    """Conversations with a system turn stand for the cache."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return encode.missing(rows, rows.filter("role = 'system'").distinct(), "conv_id").select("conv_id", "turn")


@query("encoded_texts", """WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM conversations),
h AS (SELECT conv_id, turn, ('0x' || substr(md5(w), 15, 2))::INT % 32 AS place, CASE WHEN substr(md5(w), 1, 1) >= '8' THEN 1 ELSE -1 END AS one FROM w),
s AS (SELECT conv_id, turn, place, sum(one) AS x FROM h GROUP BY ALL)
SELECT conv_id, turn, CAST(place AS INTEGER) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)), 5) AS x FROM s WHERE x <> 0""")
def encoded_texts(spark, sf_dir):
    """Texts encoded by the hashing stand-in, the places of their vectors that are not 0."""
    rows = encode.encode(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", encode.HashingEncoder)
    return rows.select("conv_id", "turn", F.posexplode("emb").alias("place", "x")).filter("x <> 0").withColumn("x", F.round(F.col("x").cast("double"), 5))


# --- sources ---------------------------------------------------------------------------------------------------------


def _stamp(x: Column) -> Column:
    """hh:mm:ss,mmm of whole milliseconds."""
    part = lambda v, n: F.lpad(v.cast("string"), n, "0")
    hours = F.floor(x / 3600000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(F.floor(x / 60000) % 60, 2), F.lit(":"), part(F.floor(x / 1000) % 60, 2), F.lit(","), part(x % 1000, 3))


@query("subtitle_cues", f"""WITH {_CUES}, m AS (SELECT video_id, cue_idx, CAST(round(s * 1000) AS BIGINT) AS s, CAST(round(e * 1000) AS BIGINT) AS e, text FROM cues)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY s, cue_idx) - 1 AS cue_idx, round(s / 1000.0::DOUBLE, 3) AS start, round(e / 1000.0::DOUBLE, 3) AS "end", text FROM m WHERE e > s""")
def subtitle_cues(spark, sf_dir):
    """Events written as one SRT text per user, and parsed."""
    c = cues(spark, sf_dir).withColumns({"s": F.round(F.col("start") * 1000).cast("long"), "e": F.round(F.col("end") * 1000).cast("long")})
    block = F.concat(F.col("cue_idx").cast("string"), F.lit("\r\n"), _stamp(F.col("s")), F.lit(" --> "), _stamp(F.col("e")), F.lit("\r\n<i>"), F.col("text"), F.lit("</i>\r\n"))
    texts = c.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "cue_idx", block.alias("b")))), lambda x: x["b"]), "\r\n").alias("content"))
    rows = files.parse_subtitles(texts)
    return rows.select("video_id", "cue_idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@query("unique_ids", "SELECT p_partkey AS id, CASE WHEN n > 1 THEN p_name || '_' || n ELSE p_name END AS video_id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def unique_ids(spark, sf_dir):
    """Names that repeat get a number."""
    return files.unique_ids(catalogue(spark, sf_dir), "name", "id").select("id", "video_id")


@query("media_manifest", "SELECT CAST(p_partkey AS VARCHAR) AS video_id, '/v/' || p_name || '.mp4' AS video_path, '/v/' || p_name || '.srt' AS subtitle_path, p_name AS asset_id, p_type AS domain, p_brand AS sub_category FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 45)")
def media_manifest(spark, sf_dir):
    """The media pair of each selected asset, those without one left out. Large parts stand for what is on disk."""
    p = catalogue(spark, sf_dir)
    selection = p.select(F.col("id").cast("string").alias("video_id"), F.col("name").alias("videoID"), "domain", F.col("sub").alias("sub_category"))
    there = p.filter("mb > 45").select(F.col("name").alias("video_id")).distinct()
    path = lambda ending: F.concat(F.lit("/v/"), F.col("video_id"), F.lit(ending))
    return files.manifest(selection, there.select("video_id", path(".mp4").alias("video_path"), path(".srt").alias("subtitle_path")), require_all=False)


@query("embedded_questions", f"WITH {_QUESTIONS} SELECT question_id, video_id FROM questions WHERE video_id IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50)")
def embedded_questions(spark, sf_dir):
    """Questions on videos with 50 frames or more."""
    long = frames(spark, sf_dir).groupBy("video_id").count().filter("count >= 50")
    return questions(spark, sf_dir).join(long, "video_id", "left_semi").select("question_id", "video_id")


@query("question_constants", f"WITH {_SCORES}, {_vote_sql('scores', 'question_id')}, od AS (SELECT a.question_id, a.o, round(sum(1 - {_dot('a.x', 'b.x')}), 9) AS d FROM opts a JOIN opts b ON a.question_id = b.question_id AND a.o <> b.o GROUP BY ALL), odd AS (SELECT question_id, o AS odd FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d DESC, o) AS rn FROM od) WHERE rn = 1) SELECT count(*) AS n, round(avg(correct::INT), 6) AS whole_video_accuracy, round(avg((odd = answer_idx)::INT), 6) AS odd_is_answer FROM voted JOIN odd USING (question_id) JOIN questions USING (question_id)")
def question_constants(spark, sf_dir):
    """Accuracy of the vote of all frames, and how often the odd option is the answer."""
    votes = _whole(spark, sf_dir)
    odd = questions(spark, sf_dir).select("question_id", (vectors.odd_one_out(F.col("options")) == F.col("answer_idx")).alias("hit"))
    return votes.join(odd, "question_id").agg(F.count("*").alias("n"), six(F.avg(F.col("correct").cast("double"))).alias("whole_video_accuracy"), six(F.avg(F.col("hit").cast("double"))).alias("odd_is_answer"))


def _asset_rows(spark, sf_dir) -> DataFrame:
    """Annotations made from parts, in the columns of schemas.QUESTIONS."""
    p = catalogue(spark, sf_dir)
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    key = F.col("id").cast("string")
    return p.select(text("q", key).alias("question_id"), F.col("name").alias("videoID"), sampling.zero_pad(key).alias("video_id"), F.when(F.col("mb") > 25, "long").otherwise("short").alias("duration"), "domain", F.col("sub").alias("sub_category"), F.col("domain").alias("task_type"), text("What is ", F.col("name"), "?").alias("question"), F.array(text("A. ", key), text("B. ", F.col("name"))).alias("options"), F.lit("A").alias("answer"), text("https://v/", key).alias("url"))


@query("annotations", "SELECT 'q' || p_partkey AS question_id, CASE WHEN length(p_partkey::VARCHAR) < 3 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS video_id, CASE WHEN p_size > 25 THEN 'long' ELSE 'short' END AS duration, 'A. ' || p_partkey || '|B. ' || p_name AS options FROM part")
def annotations(spark, sf_dir):
    """Annotations written as Parquet and read by their schema."""
    path = shared_folder(spark, "annotations")
    _asset_rows(spark, sf_dir).write.parquet(path)
    return files.read_annotations(spark, path).select("question_id", "video_id", "duration", F.array_join("options", "|").alias("options"))


@query("selection", "SELECT p_partkey::VARCHAR AS video_id, CASE WHEN p_size > 25 THEN '/media/' ELSE '/root/x/' END || p_name || '.mp4' AS video_path, '/root/x/' || p_name || '.srt' AS subtitle_path FROM part")
def selection(spark, sf_dir):
    """A selection written as CSV and read with its relative paths resolved."""
    path = shared_folder(spark, "selection")
    rows = catalogue(spark, sf_dir).select(F.col("id").alias("video_id"), F.concat(F.when(F.col("mb") > 25, "/media/").otherwise(""), F.col("name"), F.lit(".mp4")).alias("video_path"), F.concat("name", F.lit(".srt")).alias("subtitle_path"))
    files.write_report(rows, path)
    return files.read_selection(spark, path, "/root/x", ("video_id", "video_path", "subtitle_path")).select("video_id", "video_path", "subtitle_path")


@query("media_pairs", """WITH f AS (SELECT '/m/' || p_brand || '/' || p_name || '-' || p_partkey % 50 AS stem, p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'MP4' WHEN 1 THEN 'mkv' ELSE 'txt' END AS e FROM part),
v AS (SELECT DISTINCT stem, stem || '.' || e AS p FROM f WHERE e <> 'txt'), t AS (SELECT stem, max(k % 2) AS srt FROM f WHERE k % 5 <> 0 GROUP BY stem),
j AS (SELECT v.p AS video_path, stem || CASE WHEN srt = 1 THEN '.srt' ELSE '.vtt' END AS subtitle_path, regexp_extract(stem, '([^/]+)$', 1) AS raw FROM v JOIN t USING (stem)),
n AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY video_path) AS n FROM j)
SELECT CASE WHEN n > 1 THEN raw || '_' || n ELSE raw END AS video_id, video_path, subtitle_path FROM n""")
def media_pairs(spark, sf_dir):
    """S3: videos and subtitles of a listing, paired by folder and name."""
    p = catalogue(spark, sf_dir)
    stem = F.concat(F.lit("/m/"), F.col("sub"), F.lit("/"), F.col("name"), F.lit("-"), (F.col("id") % 50).cast("string"))
    video = F.when(F.col("mb") % 3 == 0, ".MP4").when(F.col("mb") % 3 == 1, ".mkv").otherwise(".txt")
    subtitle = F.when(F.col("id") % 5 == 0, ".doc").when(F.col("id") % 2 == 1, ".srt").otherwise(".vtt")
    listing = p.select(F.explode(F.array(F.concat(stem, video), F.concat(stem, subtitle))).alias("path")).distinct()
    return files.pair_media(listing)


@query("vector_tables", f"WITH {_FRAMES} SELECT CAST(video_id AS VARCHAR) AS video_id, frame_idx, t, round({_dot('emb', 'emb')}, 6) AS length FROM frames")
def vector_tables(spark, sf_dir):
    """Frame vectors written in order of video and time, and read by their schema."""
    path = shared_folder(spark, "vectors")
    rows = frames(spark, sf_dir).select(F.col("video_id").cast("string"), F.col("frame_idx").cast("long"), "t", F.col("emb").cast("array<float>"))
    files.write_vectors(rows, path)
    return files.read_vectors(spark, path).select("video_id", "frame_idx", "t", six(vectors.dot(F.col("emb"), F.col("emb"))).alias("length"))


@query("archived_vectors", f"WITH {_FRAMES} SELECT CAST(video_id AS VARCHAR) AS video_id, frame_idx, t, round({_dot('emb', 'emb')}, 6) AS length FROM frames")
def archived_vectors(spark, sf_dir):
    """A numpy archive for each video, found again by listing their folder."""
    root = shared_folder(spark, "archives")
    archives.write_archives(frames(spark, sf_dir).select("video_id", "t", "emb"), root, "float32").write.format("noop").mode("overwrite").save()
    there = listing.list_files(spark, root).filter("size > 0").select(F.regexp_extract("path", r"([^/]+)[.]npz$", 1).alias("video_id"), "path")
    rows, _ = archives.read_archives(there)
    return rows.select("video_id", "frame_idx", "t", six(vectors.dot(F.col("emb"), F.col("emb"))).alias("length"))


@query("report", _EVENTS + " SELECT video_id, modality, round(t, 6) AS t, gap IS NULL AS alone, round(gap, 6) AS gap FROM ev")
def report(spark, sf_dir):
    """The event table as CSV, where no other peak is an infinite distance."""
    path = shared_folder(spark, "report")
    files.write_report(_events(spark, sf_dir).select("video_id", "modality", "timestamp_seconds", "nearest_other_peak_seconds"), path, "modality")
    rows = files.read_report(spark, path, "video_id long, timestamp_seconds double, nearest_other_peak_seconds double, modality string")
    gap = F.col("nearest_other_peak_seconds")
    return rows.select("video_id", "modality", six("timestamp_seconds").alias("t"), (gap == float("inf")).alias("alone"), F.when(gap < float("inf"), six(gap)).alias("gap"))


@query("run_config", "SELECT CAST(count(*) AS BIGINT) AS n_events, CAST(min(user_id) AS BIGINT) AS first_user, 'zscore' AS normalization FROM events")
def run_config(spark, sf_dir):
    """Settings and figures of a run as one row of JSON."""
    path = shared_folder(spark, "config")
    told = read(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.min("user_id").alias("u")).first()
    files.write_config(spark, {"n_events": told["n"], "first_user": told["u"], "normalization": BoundaryConfig().normalization}, path)
    return spark.read.schema("n_events long, first_user long, normalization string").json(path)


@query("job_errors", """WITH v AS (SELECT DISTINCT user_id AS k FROM events),
probes AS (SELECT user_id AS k, count(*) AS n_frames, CASE WHEN min(value) < 0.1 THEN 0 ELSE 24 END AS fps FROM events WHERE event_type <> 'error' GROUP BY ALL),
framed AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type IN ('view', 'click') AND value > 100), cued AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase' AND value > 100)
SELECT CAST(v.k AS VARCHAR) AS video_id, CASE WHEN coalesce(p.fps, 0) <= 0 THEN 'no frame rate' WHEN f.k IS NULL THEN 'no frame vectors' ELSE 'no cues' END AS error
FROM v LEFT JOIN probes p ON p.k = v.k LEFT JOIN framed f ON f.k = v.k LEFT JOIN cued c ON c.k = v.k WHERE coalesce(p.fps, 0) <= 0 OR f.k IS NULL OR c.k IS NULL""")
def job_errors(spark, sf_dir):
    """Which videos a job leaves out, and why: users are videos; their high views and clicks are frames, their high purchases cues."""
    e = read(spark, sf_dir, "events").withColumn("video_id", F.col("user_id").cast("string"))
    probes = e.filter("event_type <> 'error'").groupBy("video_id").agg(F.count("*").alias("n_frames"), F.when(F.min("value") < 0.1, 0.0).otherwise(24.0).alias("fps"))
    high = e.filter("value > 100")
    return jobs.video_errors(e, probes, high.filter("event_type = 'purchase'"), high.filter(F.col("event_type").isin(*VISUAL)))


@query("sized_videos", "SELECT p_partkey AS id, s.mb FROM part LEFT JOIN (SELECT p_partkey AS k, p_retailprice AS mb FROM part WHERE p_size > 10) s ON p_partkey = k WHERE s.mb < 1200")
def sized_videos(spark, sf_dir):
    """Sizes of files mapped to videos; those without one, or too large, go."""
    p = read(spark, sf_dir, "part")
    sizes = p.filter("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("mb"))
    return sampling.sized(p.select(F.col("p_partkey").alias("id")), sizes, "id", "mb", 1200).select("id", "mb")
