import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions import options
from tidemark.operators import encode, sampling


def strata(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "stratum string, size long")


def test_allocation(spark):
    got = {r.stratum: r.quota for r in sampling.allocate(strata(spark, {"a": 10, "b": 30, "c": 60}), 20, 2).collect()}
    assert got == {"a": 3, "b": 6, "c": 11} and sum(got.values()) == 20
    assert {r.quota for r in sampling.allocate(strata(spark, {"a": 3, "b": 3}), 6, 3).collect()} == {3}
    for n, least in ((4, 3), (5, 3), (99, 0)):
        with pytest.raises(ValueError):
            sampling.allocate(strata(spark, {"a": 2, "b": 9}), n, least)


def test_two_levels(spark):
    rows = [(d, f"{d}{s}", f"{d}{s}{i}") for d in "xy" for s in range(2) for i in range(2)]
    df = spark.createDataFrame(rows, "domain string, sub string, id string")
    one = sorted(r.id for r in sampling.stratified(df, "domain", "sub", "id", 4, 1, 5).collect())
    assert len({i[:2] for i in one}) == 4  # one of each stratum
    assert one == sorted(r.id for r in sampling.stratified(df.repartition(3), "domain", "sub", "id", 4, 1, 5).collect())
    with pytest.raises(ValueError):
        sampling.stratified(df, "domain", "sub", "id", 5, 3, 5)


def test_stratified_query(spark, sf_dir):
    from tidemark.queries import QUERIES, catalogue

    rows = QUERIES["stratified_sample"](spark, sf_dir).collect()
    quota = {r.domain: r.quota for r in sampling.allocate(catalogue(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("size")), 60, 3, "domain").collect()}
    assert Counter(r.domain for r in rows) == Counter(quota) and len({r.id for r in rows}) == 60
    for d, n in quota.items():  # as many different sub-categories as there is room for
        have = catalogue(spark, sf_dir).filter(F.col("domain") == d).select("sub").distinct().count()
        assert len({r["sub"] for r in rows if r.domain == d}) == min(n, have)


def test_split_and_caps(spark):
    df = spark.createDataFrame([(i % 2, i, j) for i in range(20) for j in range(2)], "s int, id int, j int")
    got = sampling.split(df, "s", "id", 4, 1).collect()
    assert all(len({r.id for r in got if r.s == s and r.split == "dev"}) == 4 for s in (0, 1)) and len(got) == 40
    assert Counter(r.s for r in sampling.at_most(df, "s", "id", 3, 1).collect()) == {0: 3, 1: 3}
    assert [r.s for r in sampling.round_robin(df, "s", 3, "id", "j").collect()] == [0, 1, 0]
    assert sampling.first_per(df, "s", "id").count() == 2


def test_samples_rank_no_whole_stratum(spark):
    """Tasks keep as many rows of a stratum as are wanted before anything is shuffled, and the rows are those of a full sort."""
    df = spark.range(5000).selectExpr("id % 3 AS s", "id % 7 AS c", "id")
    for rows in (sampling.at_most(df, "s", "id", 25, 3), sampling.stratified(df, "s", "c", "id", 60, 3, 7), sampling.split(df, "s", "id", 100, 7), sampling.take_quota(df, df.groupBy("s").agg(F.lit(9).alias("quota")), "s", "id", 1)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    key = lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i)
    assert {r.id for r in sampling.at_most(df, "s", "id", 25, 3).collect()} == {i for s in range(3) for i in sorted(range(s, 5000, 3), key=key)[:25]}
    nulls = spark.createDataFrame([(None, 1), (None, 2), (1, None), (1, 3)], "s int, id int")
    assert {(r.s, r.id, r.split) for r in sampling.split(nulls, "s", "id", 9, 1).collect()} == {(None, 1, "dev"), (None, 2, "dev"), (1, None, "dev"), (1, 3, "dev")}


def test_options(spark):
    rows = [("A", ["A. Two", "B) after it", " C. red hat", "D. love"]), ("C", ["a b", "b a", "a  b", "B A"]), ("D", ["①②", "5 of them all are here now", "10", ""])]
    df = spark.createDataFrame(rows, "answer string, o array<string>").withColumn("o", options.strip_options(F.col("o")))
    df = df.withColumn("perm", options.is_permutation(F.col("o")))
    got = df.select("perm", options.answer_index(F.col("answer")).alias("a"), F.transform("o", lambda x: options.option_type(x, F.col("perm"), F.lit(False))).alias("t"), options.mean_words(F.col("o")).alias("n")).collect()
    assert [r.perm for r in got] == [False, True, False] and [r.a for r in got] == [0, 2, 3]
    assert got[0].t == ["Numeric", "Temporal/order", "Concrete visual", "Abstract"] and set(got[1].t) == {"Temporal/order"}
    assert got[2].t == ["Temporal/order", "Abstract", "Numeric", "Abstract"] and got[2].n == 2.25
    ties = spark.createDataFrame([(["Abstract", "Numeric"],), (["Abstract", "Abstract", "Numeric"],)], "t array<string>")
    assert [r[0] for r in ties.select(options.dominant(F.col("t"))).collect()] == ["Numeric", "Abstract"]
    with pytest.raises(Exception, match="no answer letter"):
        df.select(options.answer_index(F.lit("E"))).collect()


def test_encoding(spark):
    rows = [(i, f"text number {i % 3}") for i in range(10)] + [(10, None)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(2)
    model = encode.HashingEncoder(16)
    for r in encode.encode(df, "text", lambda: encode.HashingEncoder(16), size=3).collect():
        assert r.emb == pytest.approx(model([r.text or ""])[0].tolist(), abs=1e-6)
    assert encode.missing(df, df.filter("id < 4"), "id").count() == 7
