"""Secret scan with multipart credential linking, in DataFrame operations only.

Certain patterns (assignments of secrets, access key ids, long hex runs) are always reported. Weak candidates (names
of accounts, unlabelled random tokens, endpoints) are reported only where complementary parts meet: a secret with an
identifier or an endpoint, in one scope and within reach of each other. A scope is the text between blank lines.

The parts of all texts become rows, scopes are numbered by a window over a text's parts, and an interval join on
(text, scope, bucket of the place) with a check of the distance finds the companions. Only texts that hold a weak
candidate take part, rows that repeat a text are one from the start, and spans of one pattern cannot overlap, so a bucket
holds a bounded number of parts. Parts that overlap are one credential seen twice, and no companions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.native import cut_out, found, let, running_max

#: The base patterns and the least length of each (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The weak patterns.
ACCOUNT = r"""(?i:access|client|account|app|user|key)[_-]?(?i:key[_-]?)?(?i:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
RANDOM = r"[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"""(?i:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+"""
#: A blank line ends a scope.
BREAK = r"\n[\x20\t\r]*\n"
KINDS = ["assign", "access", "hex", "account", "random", "endpoint"]
SECRET, COMPANION, STOP = "secret", "companion", "stop"
ROLES = {"assign": SECRET, "hex": SECRET, "random": SECRET, "access": COMPANION, "account": COMPANION, "endpoint": COMPANION}
SPAN = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>"


def _spans(text: Column, kind: str, pattern: str, keep) -> Column:
    kept = F.filter(found(text, pattern), keep)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of spans of the three certain kinds."""
    return {
        "assign": _spans(text, "assign", ASSIGN, lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 6),
        "access": _spans(text, "access", ACCESS, lambda m: m["end"] - m["start"] >= 20),
        # every run of 24 or more is the whole of a run, so asking for the length at once drops the same matches
        "hex": _spans(text, "hex", r"[0-9a-f]{24,}", lambda m: F.lit(True)),
    }


def weak_spans(text: Column) -> dict[str, Column]:
    mixed = lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[a-z]") & m["match"].rlike("[A-Z]")
    return {
        "account": _spans(text, "account", ACCOUNT, lambda m: F.lit(True)),
        "random": _spans(text, "random", RANDOM, mixed),
        "endpoint": _spans(text, "endpoint", ENDPOINT, lambda m: F.lit(True)),
    }


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def suspect(text: Column) -> Column:
    """True where a text holds any weak candidate."""
    return text.rlike(ACCOUNT) | text.rlike(ENDPOINT) | text.rlike(RANDOM)


def linked(df: DataFrame, key: list[str], text: str = "text", reach: int = 400) -> DataFrame:
    """One row per key with ``_extra``: the weak spans that have a companion within reach in their scope, beside them.

    ``key`` must fix the text: rows that share it count as one.
    """
    texts = df.filter(suspect(F.col(text))).select(*key, F.col(text).alias("_t"))
    t = F.col("_t")
    stops = F.transform(found(t, BREAK), lambda m: F.struct(m["start"].alias("start"), F.lit(-1).alias("kind_no"), F.lit(STOP).alias("kind"), m["end"].alias("end")))
    parts = texts.select(*key, F.explode(F.concat(stops, *base_spans(t).values(), *weak_spans(t).values())).alias("p")).select(*key, "p.*").distinct()  # repeated rows, within tasks first
    scoped = Window.partitionBy(*key).orderBy("start", "kind_no", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("scope", F.count(F.when(F.col("kind") == STOP, 1)).over(scoped)).filter(F.col("kind") != STOP)
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    parts = parts.withColumn("role", role).withColumn("bucket", F.floor(F.col("start") / reach))
    weak = parts.filter(F.col("kind_no") >= KINDS.index("account"))
    # each part is offered to its own bucket and to those beside it
    offered = parts.select(*[F.col(k).alias(f"o_{k}") for k in key], F.col("scope").alias("o_scope"), F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("o_bucket"))
    meets = (F.col("scope") == F.col("o_scope")) & (F.col("bucket") == F.col("o_bucket")) & (F.col("role") != F.col("o_role")) & (F.abs(F.col("start") - F.col("o_start")) <= reach) & ((F.col("end") <= F.col("o_start")) | (F.col("o_end") <= F.col("start")))
    for k in key:
        meets = meets & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    kept = weak.join(offered, meets, "left_semi")
    return kept.groupBy(*key).agg(F.collect_set(F.struct("start", "kind_no", "kind", "end")).alias("_extra"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = 400) -> DataFrame:
    """Secrets of every row's whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    One row per row of ``df``, repeated rows too; a null text counts as empty, a null id is kept; other columns are
    not read. Places are code points, ends exclusive. An empty table gives an empty table.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.md5("text"))
    base = docs.select("doc_id", "mark", *[v.alias(k) for k, v in base_spans(F.col("text")).items()])
    base = base.select("doc_id", "mark", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], F.concat("assign", "access", "hex").alias("base"))
    more = linked(docs, ["doc_id", "mark"], "text", reach).select(F.col("doc_id").alias("o_id"), F.col("mark").alias("o_mark"), "_extra")
    rows = base.join(more, base["doc_id"].eqNullSafe(more["o_id"]) & (base["mark"] == more["o_mark"]), "left")
    extra = F.coalesce(F.col("_extra"), F.array().cast(SPAN))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", extra)).alias("spans"), F.size(extra).cast("long").alias("n_linked"))


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each group of overlapping spans replaced by ``mark``."""
    def kept(ordered: Column) -> Column:
        """Parts between groups: each begins where all spans before have ended, and ends where the next span begins."""
        n = F.length(text).cast("long")

        def between(reached: Column) -> Column:
            gaps = F.transform(F.concat(F.transform(ordered, lambda s: s["start"]), F.array(n)), lambda s, i: F.struct(F.coalesce(F.get(reached, i - 1), F.lit(0).cast("long")).alias("start"), s.alias("end"), (i == 0).alias("first"), (i == F.size(ordered)).alias("last")))
            # a span that begins inside an earlier one, or at its end, is joined to it
            gaps = F.filter(gaps, lambda g: g["first"] | g["last"] | (g["end"] > g["start"]))
            return let(gaps, lambda g: F.array_join(cut_out(text, F.transform(g, lambda x: x["start"]), F.transform(g, lambda x: x["end"])), mark))

        return let(running_max(F.transform(ordered, lambda s: s["end"])), between)

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), kept)).otherwise(text)


def redact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "<SECRET>", reach: int = 400) -> DataFrame:
    """``df`` with every reported span of ``text`` replaced by ``mark``; no row is dropped, a null text stays null.

    Repeated rows are each rewritten, texts may be of any length, an empty table gives an empty one.

    Texts without weak candidates are rewritten where they lie; only the others are joined with their linked spans.
    """
    t = F.col(text)
    none = F.array().cast(SPAN)
    is_suspect = F.coalesce(suspect(t), F.lit(False))
    spans = lambda c: F.concat(*base_spans(c).values())
    plain = df.filter(~is_suspect).withColumn("_spans", F.when(t.isNotNull(), spans(t)).otherwise(none))
    rest = df.filter(is_suspect).withColumn("_mark", F.md5(t))
    more = linked(rest, [doc_id, "_mark"], text, reach).select(F.col(doc_id).alias("_o_id"), F.col("_mark").alias("_o_mark"), "_extra")
    rest = rest.join(more, rest[doc_id].eqNullSafe(more["_o_id"]) & (rest["_mark"] == more["_o_mark"]), "left").withColumn("_spans", F.concat(spans(t), F.coalesce(F.col("_extra"), none)))
    both = plain.unionByName(rest.drop("_mark", "_o_id", "_o_mark", "_extra"))
    return both.withColumn(text, _redacted(t, F.col("_spans"), mark)).drop("_spans")
