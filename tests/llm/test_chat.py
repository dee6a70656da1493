import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rendered(spark, conversations):
    rows = [(i, k, r, t) for i, c in enumerate(conversations) for k, (r, t) in enumerate(c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.render(chat.canonical(chat.to_layouts(chat.gather(df))))


NASTY = ["\\### Assistant: </turn> ok", "", "\\", "\\\\b", "\\b#h<l:", " </turn>\n### user: x", "ü🙂\n\n", "### : ", "<", '"quoted" \t\x01', "x" * 3000]


def test_round_trip(spark):
    conversations = [[("user", a), ("assistant", b)] for a in NASTY for b in NASTY[:4]] + [[("system", a), ("user", a), ("assistant", a)] for a in NASTY] + [[(a, a)] for a in NASTY] + [[("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d")] * 400, [("assistant", "")]]
    df = rendered(spark, conversations).withColumns({"back": chat.parse(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    for r in df.collect():
        want = conversations[r.conv_id]
        assert r.layout is not None
        assert [(t.role, t.text) for t in r.back] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
    layouts = {r.layout for r in df.collect()}
    assert layouts == set(chat.LAYOUTS)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "#"]), st.text(alphabet="\\#<:bhlc/turn> \n", max_size=12)), min_size=1, max_size=4), min_size=20, max_size=30))
def test_random(spark, conversations):
    for r in rendered(spark, conversations).withColumn("back", chat.parse(F.col("formatted"))).collect():
        assert [(t.role, t.text) for t in r.back] == conversations[r.conv_id]


def test_fingerprint_takes_paths_not_types(spark):
    same = ['{"messages":[{"role":"a","content":null}]}', '{"messages":[{"content":"x","role":1.5},{"role":true}]}', '{"messages":[{"role":"a","content":"b"}]}']
    other = ['{"messages":[{"role":"a"}]}', '{"messages":{"role":"a","content":"b"}}', '{"message":[{"role":"a","content":"b"}]}', "{}", "[1]"]
    df = spark.createDataFrame([(s,) for s in same + other], "raw string")
    got = [r[0] for r in df.select(chat.fingerprint(F.col("raw"))).collect()]
    assert len(set(got[: len(same)])) == 1 and len(set(got[len(same) :])) == len(other) and got[0] not in got[len(same) :]


def test_fingerprint_of_odd_names(spark):
    same = ['{"a1":"x","b c":[1]}', '{"a1":5,"b c":["q","r"]}', '{"b c":[null],"a1":{"STRING":1}}', '{"b c":[null],"a1":{"STRING":"DOUBLE"}}']
    got = [r[0] for r in spark.createDataFrame([(s,) for s in same], "raw string").select(chat.fingerprint(F.col("raw"))).collect()]
    assert got[0] == got[1] != got[2] == got[3]


def test_very_long_texts_and_many_turns(spark):
    unit, n = 'x"\\n# </turn>é ', 1_500_000
    turn = lambda k, role, text: F.struct(F.lit(k).alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    long = spark.range(1).select(F.lit(1).alias("conv_id"), F.array(turn(0, "user", F.repeat(F.lit(unit), n)), turn(1, "assistant", F.lit("b"))).alias("turns"))
    many = spark.range(1).select(F.lit(2).alias("conv_id"), F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: F.struct(i.alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("té"), i.cast("string")).alias("text"))).alias("turns"))
    made = chat.render(chat.canonical(chat.to_layouts(long.union(many))))
    back = made.withColumns({"t": chat.parse(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    got = {r.conv_id: r for r in back.select("conv_id", F.size("t").alias("n"), F.sha2(F.array_join(F.transform("t", lambda t: t["text"]), ""), 256).alias("h"), F.sha2("loss", 256).alias("loss")).collect()}
    told = sha("".join(f"té{i}" for i in range(1, 50_001)))
    assert (got[1].n, got[1].h, got[1].loss) == (2, sha(unit * n + "b"), sha("b")) and (got[2].n, got[2].h, got[2].loss) == (50_000, told, told)


def test_layout_counts(spark):
    df = spark.createDataFrame([('{"x":1}',), ('{"x":"a"}',), (None,), ('{"prompt":"a","completion":"b"}',)], "raw string")
    assert sorted((r.layout or "", r.n) for r in chat.layout_counts(chat.canonical(df)).collect()) == [("", 1), ("", 2), ("prompt", 1)]


def test_unknown_and_null(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "no json", "c"), (3, '{"x":1}', "c"), (4, '{"prompt":null,"completion":"b"}', "c")], "id long, raw string, layout string")
    got = {r.id: r for r in chat.render(chat.canonical(df)).collect()}
    assert all(got[i].layout is None and got[i].turns == [] and got[i].formatted == "" for i in (1, 2, 3))
    assert [(t.role, t.text) for t in got[4].turns] == [("user", ""), ("assistant", "b")]
    assert chat.render(chat.canonical(df.limit(0))).count() == 0


def test_query_edges(spark, tmp_path):
    from tidemark.llm.queries import op5_chat

    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 3, None, "t"), (2, None, "user", "n"), (2, 0, "user", "m")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op5_chat(spark, str(tmp_path)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\na\nassistant\na\n") and got[1].loss_chars == 2 and got[1].loss_sha256 == sha("aa")
    assert got[None].turns_sha256 == sha("\nt\n") and got[2].turns_sha256 == sha("user\nn\nuser\nm\n")
    text = "\\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n") and got[-7].loss_sha256 == sha(text)


RECORDS = [
    ('{"messages":[{"role":"user","content":"a","name":"n"},{"role":"assistant","content":"b"}],"id":5}', "messages", [("user", "a"), ("assistant", "b")]),
    ('{"id":"x1","conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}],"model":"m"}', "conversations", [("user", "a"), ("assistant", "b")]),
    ('{"instruction":"do","output":"done"}', "instruction", [("system", "do"), ("assistant", "done")]),
    ('{"instruction":"do","input":null,"output":"done","source":[1,{"a":2}]}', "instruction", [("system", "do"), ("user", ""), ("assistant", "done")]),
    ('{"messages":[]}', "messages", []),
    ('{"messages":[{"role":"user","content":"a"},{"role":"assistant"}]}', "messages", [("user", "a"), ("assistant", "")]),
    ('{"prompt":"p","completion":"c","meta":{"messages":[1]}}', "prompt", [("user", "p"), ("assistant", "c")]),
    ('{"prompt":"p, \\"completion\\":1"}', None, []),
    ('{"messages":[{"text":"a"}]}', None, []),
    ('{"messages":{"role":"user","content":"a"}}', None, []),
    ('{"messages":[1,2]}', None, []),
    ('{"outer":{"prompt":"p","completion":"c"}}', None, []),
    ("[]", None, []),
    ("{", None, []),
    (None, None, []),
]


def test_optional_and_ignored_fields(spark):
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(RECORDS)], "id long, raw string, error string")
    made = chat.canonical(df)
    for r in made.collect():
        _, layout, turns = RECORDS[r.id]
        assert (r.id, r.layout, [(t.role, t.text) for t in r.turns]) == (r.id, layout, turns)
    bad = {r.id: r.error for r in chat.errors(made).collect()}
    assert bad == {i: {None: "no record", "{": "no JSON"}.get(raw, "unknown layout") for i, (raw, layout, _) in enumerate(RECORDS) if layout is None}
