"""Expressions over the options of multiple-choice questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and words of the option tags.
PREFIX = r"^\s*[A-D][\.\)]\s*"
NUMERIC = r"(?U)(?i)^\W*(\d[\d,\.]*|(zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|hundred))\b"
TEMPORAL = r"(?U)(?i)\b(before|after|first|then|finally|later|earlier|begin\w*|end\w*|start\w*|order|sequence|last|next|followed|while|during|until|since|minutes?|seconds?|hours?)\b|->|→|\(\d\)"
CIRCLED = "[①-⑳]"
COLOURS = "red orange yellow green blue purple pink white black gray grey brown golden silver beige".split()
TYPES = ["Numeric", "Temporal/order", "Concrete visual", "Abstract"]
TEMPLATE = ("Question: ", " Answer: ")


def strip_options(options: Column) -> Column:
    return F.transform(options, lambda o: F.trim(F.regexp_replace(o, PREFIX, "")))


def answer_index(letter: Column) -> Column:
    """0 to 3; any other letter raises an error."""
    at = F.instr(F.lit("ABCD"), letter)
    return F.when((at > 0) & (F.length(letter) == 1), at - 1).otherwise(F.raise_error(F.concat(F.lit("no answer letter: "), F.coalesce(letter, F.lit("null")))).cast("int"))


def prompts(question: Column, options: Column) -> Column:
    return F.transform(options, lambda o: F.concat(F.lit(TEMPLATE[0]), question, F.lit(TEMPLATE[1]), o))


def n_words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(text), r"(?U)\s+")))


def mean_words(options: Column) -> Column:
    return F.aggregate(F.transform(options, n_words), F.lit(0), lambda s, x: s + x) / F.size(options)


def is_permutation(options: Column) -> Column:
    """All options hold the same words, more than one, in any order."""
    bags = F.transform(options, lambda o: F.array_sort(F.regexp_extract_all(F.lower(o), F.lit(r"(?U)\w+"), F.lit(0))))
    return (F.size(bags[0]) > 1) & F.forall(bags, lambda b: b == bags[0])


def letters(text: Column) -> Column:
    """Runs of a-z in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def option_type(text: Column, permutation: Column, concrete: Column) -> Column:
    """First tag that fits; ``concrete`` says whether a lexicon knows a concrete word of the text."""
    return (
        F.when(text.rlike(NUMERIC) & (n_words(text) <= 5), TYPES[0])
        .when(permutation | text.rlike(CIRCLED) | text.rlike(TEMPORAL), TYPES[1])
        .when(concrete | F.arrays_overlap(letters(text), F.array(*map(F.lit, COLOURS))), TYPES[2])
        .otherwise(TYPES[3])
    )


def dominant(types: Column) -> Column:
    """The most frequent tag; of equally frequent ones the first in the order of TYPES."""
    counts = F.transform(F.array(*map(F.lit, TYPES)), lambda k: F.size(F.filter(types, lambda t: t == k)))
    return F.array(*map(F.lit, TYPES))[F.array_position(counts, F.array_max(counts)).cast("int") - 1]
