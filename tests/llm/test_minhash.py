import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import minhash, shingles


def words(t):
    return re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", (t or "").lower())


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


TEXTS = ["", None, "one", "One, two", "a b c d e", "a b c d e f", "É é ß", "!!! ...", "x " * 30, "A-b_c d'e f", "w" * 50 + " y z"]


def test_shingles_are_those_of_the_words():
    values, first = shingles.shingle_hashes(TEXTS)
    seen = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        want = [tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))]
        got = values[first[i] : first[i + 1]].tolist()
        assert len(got) == len(want)
        for g, s in zip(got, want, strict=True):
            assert seen.setdefault(s, g) == g
    assert len(set(seen.values())) == len(seen)


def plain_words(t):
    """Letter by letter: a letter of a script without spaces is a word, others go on while marks, letters and digits follow."""
    out, on = [], False
    for c in (t or "").lower():
        alone = any(low <= ord(c) <= high for low, high in shingles._SPACELESS) or ord(c) >= shingles._HAN
        if unicodedata.category(c)[0] not in "LMN" and ord(c) < shingles._HAN:
            on = False
        elif alone or not on:
            out.append(c)
            on = not alone
        else:
            out[-1] += c
    return out


MARKED = ["\u201equoted\u201c \u2013 dash\u2014dash\u2026", "a\u00a0b\u3000c", "\u4e2d\u6587\uff0c\u6587\u672c\u3002", "abc\u4e2d12\u6587x", "\u3042\u30a2\u30fc\u0e01\u0e33", "e\u0301te\u0301 \u0928\u092e\u0938\u094d\u0924\u0947", "\U00020000\U0001f600\U00010400z", "\u4e2d", "\u00e9", "\u2014", "x\u4e2d", "\ud55c\uad6d\uc5b4 \u0440\u0443\u0441\u0441\u043a\u0438\u0439-\u044f\u0437\u044b\u043a", "\u4e2d \u6587 a"]


def test_words_of_all_scripts():
    rng = random.Random(3)
    letters = list("".join(MARKED)) + list("ab1 .") * 3
    for text in MARKED + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(600)]:
        raw = text.lower().encode()
        starts, ends = shingles._bounds(np.frombuffer(raw, np.uint8))
        assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == plain_words(text), text


def test_copies_that_differ_in_marks_or_in_one_letter():
    likeness = minhash.ShingleSets()
    near = lambda a, b: likeness.alike(likeness.vector(a), likeness.vector(b))
    text = [f"w{i}" for i in range(60)]
    assert near(" ".join(text), " \u2013 ".join(text)) == near(" ".join(text), "\u00a0".join(text)) == 1.0
    han = "".join(chr(0x4E00 + 7 * i % 5000) for i in range(342))
    assert near(han, han[:170] + "\u9fa5" + han[171:]) > 0.9


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)) + " " + "q" * 3000 + " end" + "".join(chr(0x4E00 + i % 3000) + "\u3002" * (i % 40 == 0) for i in range(4000))
    whole = shingles.shingle_hashes([text, "a b c d e f", text])
    monkeypatch.setattr(shingles, "BITE", 700)
    parts = shingles.shingle_hashes([text, "a b c d e f", text])
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_estimate():
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 500, 2000)]
    for share in (0.0, 0.1, 0.5):
        other = [f"v{i}" if rng.random() < share / 3 else w for i, w in enumerate(base)]
        a, b = " ".join(base), " ".join(other)
        sig, _ = minhash.signatures([a, b])
        x, y = shingle_set(a), shingle_set(b)
        assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.13


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        f = [minhash.written(s[0], e[0]) for s, e in map(minhash.signatures, ([t], [edited], [after]))]
        near = lambda a, b: float(a == b) if not a or not b else np.mean([a[j : j + 4] == b[j : j + 4] for j in range(0, len(a), 4)])
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), f[0], f[1], near(f[0], f[1]), near(f[0], f[2])))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edited(spark, ranges):
    rng = np.random.default_rng(2)
    rows = [(int(i) * 3 - 50, " ".join(f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 40)))) for i in rng.permutation(90)]
    rows += [(None, "null id"), (None, None), (7, "same id a"), (7, "same id b"), (7, "same id b"), (1 << 40, "far é🙂é🙂 away"), (-50, "the first again")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, range string").repartition(5)
    got = sorted((tuple(r) for r in minhash.compare_edited(df, ranges=ranges).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("ranges", [4, 30])
def test_rows_of_one_id_lie_in_many_ranges(spark, ranges):
    """Null ids and an id that most rows have are dealt to several tasks, and the order stays that of id and text."""
    rng = np.random.default_rng(4)
    text = lambda: " ".join(str(rng.choice(list("abcdefgh"))) * int(rng.integers(1, 4)) for _ in range(rng.integers(0, 12)))
    rows = [(None, text()) for _ in range(150)] + [(5, text()) for _ in range(100)] + [(int(i), text()) for i in range(40)] + [(5, "the same")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = minhash.compare_edited(df, ranges=ranges)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == sorted(brute(rows), key=repr)
    many = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat(md5(cast(id AS string)), ' a b c d e') AS text")
    tasks = minhash.compare_edited(many).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 2500


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "only one row here it is")], "doc_id long, text string")
    assert [tuple(r) for r in minhash.compare_edited(df).collect()] == brute([(1, "only one row here it is")])
    assert minhash.compare_edited(df.limit(0)).count() == 0
    assert minhash.fingerprints(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from tidemark.llm.queries import op6_minhash

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op6_minhash(spark, sf_dir).collect()), key=repr)
    assert got == sorted(brute(docs), key=repr)
