"""Words of texts looked up in a lexicon table (schemas.LEXICON: word, category)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import options

#: The categories of a lexicon that count as concrete.
CONCRETE = "animal body car clothing cooking dance eating fabric fashion fire furniture home liquid ocean plant shape_and_size ship sports swimming tool toy vehicle water weather weapon beach hiking driving exercise appearance sailing air_travel music".split()
#: The category that marks a word as a noun for a physical thing; only words of more than two letters count by it.
NOUN = "noun"


def lookup(texts: DataFrame, key: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """``key`` and category with ``n``, how many words of the text are in that category, repeats included.

    A word counts in each of its categories, once however often the lexicon lists it there. The lexicon is an input of
    any size, so Spark chooses how it is joined; different words are counted within a text before that. Texts
    are dealt by key first, so a task counts the words of its share of them, however few files they come from.
    """
    dealt = texts.select(*key, text).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    words = dealt.select(*key, F.explode(options.letters(F.col(text))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("_n"))
    known = lexicon.filter("word IS NOT NULL AND category IS NOT NULL").select(F.lower("word").alias("word"), "category").distinct()
    met = words.join(known, "word").filter((F.col("category") != NOUN) | (F.length("word") > 2))
    return met.groupBy(*key, "category").agg(F.sum("_n").alias("n"))


def concrete(texts: DataFrame, key: list[str], text: str, lexicon: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """``texts`` with ``concrete``: a word of one of the categories (by default CONCRETE), or a noun of more than two letters."""
    counts: Column = F.col("category").isin([*(CONCRETE if categories is None else categories), NOUN])
    hit = lookup(texts, key, text, lexicon).filter(counts).select(*key).distinct().withColumn("concrete", F.lit(True))
    # as many rows as texts, though Spark takes them for few by the size of the files: sent to every task they would fill it
    return texts.join(hit.hint("merge"), key, "left").withColumn("concrete", F.coalesce("concrete", F.lit(False)))
