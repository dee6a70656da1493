"""Thin queries over the operators of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontam, html, icws, langid, minhash, negatives, pii, secrets, simhash, trie, warc
from tidemark.llm.shared import shared_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key would lie in a secret store; an example in a file keeps the result the same from run to run."""
    store = shared_folder(spark, "key")
    spark.range(1).select(F.lit("an example key")).write.text(store)
    return pii.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), spark.read.text(store))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are written as legacy archives, converted, and read back from the WARC files."""
    arc, out = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    warc.write_arc(_read(spark, sf_dir, "pages"), arc)
    warc.convert(spark, arc, out)
    rows = warc.read_warc(spark, out).filter(F.col("type").isin("response", "revisit"))
    return rows.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


#: Fixed value: the text of both turns of conversation -7.
CONTROL = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in their layouts, formatted, and read back from the formatted strings."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(CONTROL).alias("text")) for k, role in enumerate(("user", "assistant"))])
    more = spark.range(1).select(F.inline(turns))
    raw = chat.to_layouts(chat.gather(rows.unionByName(more)))
    made = chat.render(chat.canonical(raw)).select("conv_id", "layout", "formatted", "loss_spans")
    back = made.withColumns({"turns": chat.parse(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_edited(_read(spark, sf_dir, "documents"))


def minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 as a search for near copies: bands of signatures joined, candidates verified by Jaccard similarity."""
    return minhash.near_classes(_read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(_read(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()))
    rows = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op10_icws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_classes(_read(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are moved on by one; every fiftieth row is an anchor."""
    rows = _read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_html": op2_html,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_chat": op5_chat,
    "op6_minhash": op6_minhash,
    "op7_bpe": op7_bpe,
    "op8_decontam": op8_decontam,
    "op9_langid": op9_langid,
    "op10_icws": op10_icws,
    "op11_negatives": op11_negatives,
    "op12_trie": op12_trie,
    "op13_simhash": op13_simhash,
    "minhash_classes": minhash_classes,
}

def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _op1_sql() -> str:
    """Places come from a running sum over the pieces between matches, companions from a plain range join."""
    # RE2 folds case beyond ASCII, so the letters are spelled out
    words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    cased = lambda ws: "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ws.split("|")) + ")"
    account = rf"""{cased("access|client|account|app|user|key")}[_-]?(?:[Kk][Ee][Yy][_-]?)?{cased("id|name")}["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{{4,}}"""
    endpoint = rf"""{cased("https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3")}://[^\x00-\x20"'<>]+"""
    kinds = [("stop", -1, secrets.BREAK, "true"), ("assign", 0, assign, f"length(regexp_extract(m, {_quoted(assign)}, 2)) >= 6"), ("access", 1, secrets.ACCESS, "length(m) >= 20"), ("hex", 2, secrets.HEX, "length(m) >= 24"), ("account", 3, account, "true"), ("random", 4, secrets.RANDOM, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"), ("endpoint", 5, endpoint, "true")]
    parts = " UNION ALL ".join(f"SELECT rid, '{k}' AS kind, {n} AS kind_no, regexp_extract_all(text, {_quoted(p)}) AS ms, string_split_regex(text, {_quoted(p)}) AS gs FROM d" for k, n, p, _ in kinds)
    keep = " OR ".join(f"(kind = '{k}' AND {c})" for k, _, _, c in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT rid, kind, kind_no, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM ({parts}) WHERE len(ms) > 0),
e AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM m),
p AS (SELECT rid, kind, kind_no, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM e WHERE {keep}),
c AS (SELECT *, count(*) FILTER (kind = 'stop') OVER (PARTITION BY rid ORDER BY s, kind_no, e ROWS UNBOUNDED PRECEDING) AS scope, kind IN ('assign', 'hex', 'random') AS secret FROM p),
r AS (SELECT rid, kind, kind_no, s, e FROM c WHERE kind_no BETWEEN 0 AND 2
  UNION ALL SELECT rid, kind, kind_no, s, e FROM c w WHERE kind_no > 2 AND EXISTS (SELECT 1 FROM c o WHERE o.kind_no >= 0 AND o.rid = w.rid AND o.scope = w.scope AND o.secret <> w.secret AND abs(o.s - w.s) <= 400 AND (o.e <= w.s OR w.e <= o.s))),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind_no > 2) AS n_linked,
  string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, kind_no, e) FILTER (kind_no <= 2) AS base, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, kind_no, e) AS spans FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g USING (rid)"""


def _op5_sql() -> str:
    escaped = "replace(replace(replace({}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}'))),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS told, coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS loss,
  sum(length(replace({escaped.format("role")}, ':', '\\c')) + length({escaped.format("text")}) + {len(chat.OPEN + chat.BETWEEN + chat.CLOSE)}) AS chars, string_agg(role, ',' {order}) AS roles, bool_and(role IN ('system', 'user', 'assistant')) AS known FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
  CASE WHEN roles = 'user,assistant' AND n_turns = 2 THEN 'prompt' WHEN roles = 'system,user,assistant' AND n_turns = 3 THEN 'instruction' WHEN known AND conv_id % 2 <> 0 THEN 'conversations' ELSE 'messages' END AS layout
FROM g"""


_OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, CAST(1 + i // 4 * 5 AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b"""

def _op8_sql(stretch: int = 13, share: float = 0.75) -> str:
    """No mask is used: every stretch that counts has three agreeing tokens in a row, so these are joined."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT b, min(item_id) AS item_id, count(*) AS n_items FROM (SELECT item_id, {words} AS b FROM benchmark) WHERE len(b) >= {decontam.LEAST} GROUP BY b),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= {decontam.SHORT}),
bp AS (SELECT item_id, n_items, b, unnest(range(1, len(b) - 1)) AS p FROM b WHERE len(b) >= {decontam.SHORT}),
h AS (SELECT doc_id, item_id, n_items, w, b, k, p, least(len(b), {stretch}) AS width, least(p - 1, k - 1, {stretch}) AS l, least(len(w) - k + 1, len(b) - p + 1, {2 * stretch}) AS r FROM dp JOIN bp ON w[k] = b[p] AND w[k + 1] = b[p + 1] AND w[k + 2] = b[p + 2]),
s AS (SELECT doc_id, item_id, n_items, width, list_transform(range(l + r), lambda i: CAST(w[k - l + i] = b[p - l + i] AS INT)) AS same FROM h),
v AS (SELECT doc_id, item_id, n_items, width, list_max(list_transform(range(1, len(same) - width + 2), lambda i: list_sum(same[i:i + width - 1]))) AS n FROM s WHERE len(same) >= width)
SELECT doc_id, item_id, CAST(max(n_items) AS BIGINT) AS n_items, CAST(max(n) AS BIGINT) AS n_tokens FROM v WHERE n >= ceil(width * {share} - 1e-9) GROUP BY doc_id, item_id
UNION ALL SELECT DISTINCT doc_id, item_id, n_items, len(b) FROM d JOIN b ON len(b) < {decontam.SHORT} AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(b, ' ') || ' ')"""


_OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS rn FROM s WHERE same),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.rn <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def _op12_sql() -> str:
    """Every prefix is spelled out as a list; the CRC is worked out bit by bit."""
    step = "list_reduce(list_concat([xor(a, b)], range(8)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: {step}), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, {crc} % 4 AS h, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
s AS (SELECT k.conv_id, p AS d, role, text FROM k JOIN t ON t.conv_id = k.base AND p <= taken UNION ALL SELECT k.conv_id, p - h + taken, role, text FROM k JOIN t USING (conv_id) WHERE p > h),
q AS (SELECT k.conv_id, coalesce(list([role, text] ORDER BY d) FILTER (d IS NOT NULL), []) AS seq FROM k LEFT JOIN s USING (conv_id) GROUP BY k.conv_id),
m AS (SELECT conv_id, len(seq) AS l, unnest(range(len(seq) + 1)) AS d, seq FROM q), o AS (SELECT conv_id, l, d, seq[1:d] AS key FROM m),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = d), '')) AS ends FROM o GROUP BY d, key),
u AS (SELECT key[1:d - 1] AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.key[n.d][2], '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS own FROM n LEFT JOIN u ON u.key = n.key AND u.d = n.d),
x AS (SELECT unnest(range(d + 1)) AS a, key, own, (n_children = 0)::INT AS leaf FROM w), y AS (SELECT a, key[1:a] AS key, sum(leaf) AS n_leaves, sum(own) AS saved FROM x GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN y ON y.key = w.key AND y.a = w.d LEFT JOIN w p ON p.d = w.d - 1 AND p.key = w.key[1:w.d - 1]"""


ORACLE_SQL: dict[str, str] = {
    "op11_negatives": _OP11_SQL,
    "op12_trie": _op12_sql(),
    "op8_decontam": _op8_sql(),
    "op4_warc": _OP4_SQL,
    "op5_chat": _op5_sql(),
    "op1_secrets": _op1_sql(),
}
