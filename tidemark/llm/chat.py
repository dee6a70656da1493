"""Chat formatting: layouts known by the fingerprint of their nested field paths become canonical turns and one string.

A record's nested field paths are read from its skeleton: its JSON with the strings emptied and runs of equal items
made one, which stays small however long the texts are. Their hash is looked up among declared mappings, each of which
says where the turns lie; a record of another hash goes to the first mapping whose paths it contains, so fields that a
mapping does not name are ignored and optional ones may lack. The record is then read by the mapping's own schema. Turns are written as

    ### role: text </turn>

with a line break after each. Inside roles and texts the characters of the template's control strings are written as
a backslash and a letter, so the template's own ``#`` and ``<`` are the only ones and every string is read back whole.
Only DataFrame operations are used; records are independent, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import cut_out, let, running_sum

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
#: Character -> what stands for it. The backslash comes first here and last when reading.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]
TURNS = "array<struct<role:string,text:string>>"

#: Layout -> an example, from which the fingerprint is made, and its mapping: either the path of each turn with its
#: role, or the path of a list with the names of its role and text fields and other names of roles. Paths in ``optional``
#: need not be there; their turn is then left out.
LAYOUTS: dict[str, dict] = {
    "prompt": {"example": '{"prompt":"","completion":""}', "fields": [("user", "$.prompt"), ("assistant", "$.completion")]},
    "instruction": {"example": '{"instruction":"","input":"","output":""}', "fields": [("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")], "optional": ["$.input"]},
    "messages": {"example": '{"messages":[{"role":"","content":""}]}', "list": ("$.messages", "role", "content", {})},
    "conversations": {"example": '{"conversations":[{"from":"","value":""}]}', "list": ("$.conversations", "from", "value", {"human": "user", "gpt": "assistant"})},
}


#: A JSON string, read without recursion.
_STRING = r'"(?:[^"\\]|\\.)*+"'
#: Names of leaf types in a schema; a name of a field is followed by a colon, or stands between backquotes.
_LEAF = r"(`(?:[^`]|``)*+`)|\b(?:BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|STRING|VOID|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)"


def skeleton(raw: Column) -> Column:
    """The JSON text with every string that is a value emptied, and runs of equal flat items made one."""
    empty = F.regexp_replace(raw, rf'({_STRING}\s*+:)|(")(?:[^"\\]|\\.)*+(")', "$1$2$3")
    return F.regexp_replace(empty, r"(\{[^{}]*+\})(?:\s*+,\s*+\1)++", "$1")


def fingerprint(raw: Column) -> Column:
    """Hash of the nested field paths of a JSON text, whatever the types and values of the leaves; null if it is none."""
    shape = F.schema_of_variant(F.try_parse_json(skeleton(raw)))
    return F.sha2(F.regexp_replace(shape, _LEAF, "$1"), 256)


#: Room for strings of any length.
_JSON = {"maxStringLen": str((1 << 31) - 1), "mode": "PERMISSIVE"}


def _turns(raw: Column, mapping: dict) -> Column:
    """Turns of a record whose layout is known. Paths are one field below the top."""
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    if "fields" in mapping:
        names = [path.removeprefix("$.") for _, path in mapping["fields"]]
        read = F.from_json(raw, ", ".join(f"{quoted(n)} string" for n in dict.fromkeys(names)), _JSON)
        made = let(read, lambda v: F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(v[n], F.lit("")).alias("text"), F.lit(n).alias("name")) for (role, _), n in zip(mapping["fields"], names, strict=True)]))
        if optional := [path.removeprefix("$.") for path in mapping.get("optional", [])]:
            made = let(F.json_object_keys(skeleton(raw)), lambda keys: F.filter(made, lambda t: ~t["name"].isin(optional) | F.array_contains(keys, t["name"])))
        return F.transform(made, lambda t: F.struct(t["role"], t["text"]))
    path, role, text, names = mapping["list"]
    path = path.removeprefix("$.")
    named = lambda r: F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[r], r) if names else r
    read = F.from_json(raw, f"{quoted(path)} array<struct<{quoted(role)}:string,{quoted(text)}:string>>", _JSON)
    return F.transform(read[path], lambda x: F.struct(F.coalesce(named(x[role]), F.lit("")).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))


def _contains(bare: Column, mapping: dict) -> Column:
    """Whether a record (its skeleton) has the paths of a mapping, but for the optional ones, whatever else it has.

    Every item of a list must have the text field or that of the role, and some item both; an empty list is one without turns.
    """
    keys = F.coalesce(F.json_object_keys(bare), F.array().cast("array<string>"))
    if "fields" in mapping:
        need = [path.removeprefix("$.") for _, path in mapping["fields"] if path not in mapping.get("optional", [])]
        return F.forall(F.array(*map(F.lit, need)), lambda n: F.array_contains(keys, n))
    path, role, text, _ = mapping["list"]
    items = F.from_json(F.get_json_object(bare, path), "array<map<string,string>>", {"mode": "PERMISSIVE"})
    has = lambda x, n: F.coalesce(F.map_contains_key(x, n), F.lit(False))
    sound = let(items, lambda xs: (F.size(xs) == 0) | (F.forall(xs, lambda x: has(x, role) | has(x, text)) & F.exists(xs, lambda x: has(x, role) & has(x, text))))
    return F.array_contains(keys, path.removeprefix("$.")) & F.coalesce(sound, F.lit(False))


def canonical(df: DataFrame, raw: str = "raw", layouts: dict[str, dict] | None = None) -> DataFrame:
    """``df`` with ``fingerprint``, ``layout`` and ``turns`` (array of role and text) of the JSON records in ``raw``.

    A record whose fingerprint is that of a mapping is read by it, any other by the first declared mapping whose paths it
    contains. A record that is null, no JSON or of an unknown layout keeps its row; layout is then null and turns empty
    (``errors`` has these rows, layout_counts tells how many). Texts of any length are read. Missing roles and texts are empty strings. Columns with the names of the three are replaced.
    """
    layouts = layouts or LAYOUTS
    df = df.withColumn("fingerprint", fingerprint(F.col(raw)))
    layout, bare = F.lit(None).cast("string"), skeleton(F.col(raw))
    for name, mapping in reversed(layouts.items()):
        layout = F.when(F.col("fingerprint").isNotNull() & _contains(bare, mapping), F.lit(name)).otherwise(layout)
    for name, mapping in layouts.items():
        layout = F.when(F.col("fingerprint") == fingerprint(F.lit(mapping["example"])), F.lit(name)).otherwise(layout)
    df, turns = df.withColumn("layout", layout), F.array().cast(TURNS)
    for name, mapping in layouts.items():
        turns = F.when(F.col("layout") == name, F.coalesce(_turns(F.col(raw), mapping), F.array().cast(TURNS))).otherwise(turns)
    return df.withColumn("turns", turns)


def errors(made: DataFrame, raw: str = "raw") -> DataFrame:
    """The records that ``canonical`` could not read, with ``error``: no record, no JSON, or an unknown layout."""
    error = F.when(F.col(raw).isNull(), "no record").when(F.col("fingerprint").isNull(), "no JSON").otherwise("unknown layout")
    return made.filter("layout IS NULL").withColumn("error", error).drop("layout", "turns")


def layout_counts(made: DataFrame) -> DataFrame:
    """fingerprint, layout and n of the records that ``canonical`` made: what no mapping knows has a null layout."""
    return made.groupBy("fingerprint", "layout").agg(F.count("*").alias("n"))


def _escaped(s: Column, escapes) -> Column:
    for plain, stands in escapes:
        s = F.replace(s, F.lit(plain), F.lit(stands))
    return s


def _plain(s: Column, escapes) -> Column:
    for plain, stands in reversed(escapes):
        s = F.replace(s, F.lit(stands), F.lit(plain))
    return s


def render(df: DataFrame, turns: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans``: the places (code points, end exclusive) of the texts of ``loss_role``.

    No turns give an empty string without spans, null turns nulls; repeated rows stay, other columns too, but for those
    with the names of the two, which are replaced. Empty texts have empty spans.
    """
    written = F.transform(turns, lambda t: F.struct(_escaped(t["role"], ROLE_ESCAPES).alias("role"), _escaped(t["text"], ESCAPES).alias("text"), (t["role"] == loss_role).alias("loss")))
    df = df.withColumn("_w", written)
    strings = F.transform("_w", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE)))
    ends = running_sum(F.transform("_w", lambda t: (F.length(t["role"]) + F.length(t["text"]) + len(OPEN + BETWEEN + CLOSE)).cast("long")))
    spans = F.zip_with("_w", ends, lambda t, e: F.struct((e - len(CLOSE) - F.length(t["text"])).alias("start"), (e - len(CLOSE)).alias("end"), t["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    return df.withColumns({"formatted": F.array_join(strings, ""), "loss_spans": spans}).drop("_w")


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array of role and text; null of a null, empty of an empty string."""
    parts = F.split(formatted, CLOSE)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    pattern = f"(?s)^{OPEN}([^:]*){BETWEEN}(.*)$"
    return F.transform(parts, lambda p: F.struct(_plain(F.regexp_extract(p, pattern, 1), ROLE_ESCAPES).alias("role"), _plain(F.regexp_extract(p, pattern, 2), ESCAPES).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    parts = cut_out(formatted, F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]))
    return F.array_join(F.transform(parts, lambda p: _plain(p, ESCAPES)), "")


def gather(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, turn, role, text) -> one row per key with ``turns`` in order of turn, then role, then text.

    Null roles and texts are empty strings, a null turn comes first, a null key is a key; repeated rows are turns of
    their own.
    """
    row = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("turns"))


def to_layouts(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row (key, raw) per gathered conversation, written in the layout that its shape calls for."""
    roles, text = F.transform("turns", lambda t: t["role"]), lambda i: F.col("turns")[i]["text"]
    known = F.forall("turns", lambda t: t["role"].isin("system", "user", "assistant"))
    back = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    listed = F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    shared = F.to_json(F.struct(F.transform("turns", lambda t: F.struct(back(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations")))
    raw = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))))
        .when(known & (F.pmod(F.coalesce(F.col(key), F.lit(0)), F.lit(2)) == 1), shared)
        .otherwise(listed)
    )
    return conversations.select(key, raw.alias("raw"))
