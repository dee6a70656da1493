import re

from tidemark import queries
from tidemark.functions import lexicon


def test_texts_of_one_file_are_dealt_before_their_words_are_counted(spark):
    texts = spark.range(400).selectExpr("id AS k", "concat('ring ring of w', id) AS text").coalesce(1)
    known = spark.createDataFrame([("ring", "fashion"), ("of", "noun")], "word string, category string")
    rows = lexicon.lookup(texts, ["k"], "text", known)
    assert sorted((r.k, r.category, r.n) for r in rows.collect()) == [(k, "fashion", 2) for k in range(400)]
    # the first exchange of the texts is by key alone, and keeps its number of tasks
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode.*\n.*RepartitionByExpression \[k#\d+L?\], " + spark.conf.get("spark.sql.shuffle.partitions"), plan)


def test_the_crosstab_puts_no_options_together_again(spark, sf_dir):
    """Options are tagged and counted as rows of their own: no list per question, and the questions are read for them alone."""
    plan = queries.option_crosstab(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("parquet") == 2


def test_tags_are_not_sent_to_every_task(spark, sf_dir):
    """Only the lexicon may be: the options and questions are as many as the input, however small its files are."""
    for name, at_most in (("option_crosstab", 1), ("option_tags", 1)):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") <= at_most and "SortMergeJoin" in plan, name
