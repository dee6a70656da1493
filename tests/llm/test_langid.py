import functools
import math
import random
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import langid
from tidemark.llm.queries import op9_langid


def test_features():
    feats, (first, end), has = langid._features(["Ab, 1c", "", "?!", "é"])
    assert has.tolist() == [True, False, False, True]
    # "ab c", a blank between texts; the n-grams that start in a text are its own
    alone, (f, e), _ = langid._features(["ab c"])
    assert [x[first[0] : e[0]].tolist() for x in feats[:1]] == [x[f[0] : e[0]].tolist() for x in alone[:1]]


def test_codewords():
    for n in (2, 3, 4, 5, 6, 40):
        code = langid.codewords(n)
        assert len(np.unique(code, axis=0)) == n and all(len(set(c)) == 2 for c in code.T)
    assert langid.codewords(4).shape == (4, 7)


def test_decoding_corrects_a_bit():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.zeros((3, code.shape[1], 4), np.float32))
    for i in range(5):
        for bit in range(code.shape[1]):
            scores = code[i].copy()
            scores[bit] *= -0.5
            assert model.decode(scores[None])[0][0] == i
    assert model.decode(np.zeros((1, code.shape[1])))[2][0]


def test_held_out_accuracy(spark, sf_dir):
    path = sf_dir.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in op9_langid(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert len(rows) == len(docs)
    hits = [rows[d.doc_id].lang_pred == d.lang for d in docs if d.lang and rows[d.doc_id].held_out]
    assert np.mean(hits) > 0.97
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= rows[d.doc_id].score <= 1 for d in docs)


def test_weights_differ_on_the_given_documents(spark, sf_dir):
    """The mean margins make weights that differ; told on rows held out, with and without them."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()))
    even = 1 / model.code.shape[1]
    assert np.abs(model.trust / even - 1).max() > 0.1, model.trust
    ask = docs.filter(langid.held_out() & docs.lang.isNotNull())
    share = lambda m: np.mean([r.lang == r.lang_pred for r in langid.predict(ask, m).collect()])
    weighted, flat = share(model), share(langid.Model(model.languages, model.code, model.weights))
    print(f"held-out accuracy {weighted:.4f} with the weights, {flat:.4f} without", model.trust / even)
    assert weighted > 0.97 and weighted >= flat - 0.005


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !?", None), (5, "", None), (5, "", None), (6, "the dog " * 50000, None), (None, "und der hund", None)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, score int").repartition(3)
    model = langid.train(df)
    assert model.languages == ["de", "en"]
    got = sorted(((r.doc_id or 0, r.lang_pred, r.ambiguous) for r in langid.predict(df, model).collect()))
    assert [g[:2] for g in got] == [(0, "de"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (5, "und"), (6, "en")]
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"} and langid.predict(df.limit(0), model).count() == 0
    one = langid.train(df.filter("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(df.filter("doc_id = 1"), one).collect()} == {"en"}


def plain_features(text):
    """Feature lists by order, by plain arithmetic."""
    out, kept = [], []
    for c in (text or "").lower() + " ":
        c = c if c.isalpha() else " "
        if c != " " or (kept and kept[-1] != " "):
            kept.append(c)
    for n in langid.ORDERS:
        row = []
        for i in range(len(kept) - n + 1):
            h = 0
            for c in kept[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
            row.append((h * 0x9E3779B1 + n * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - langid.BITS))
        out.append(row)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = {"a": "lo la li lu mo ma", "b": "lo kar ker kor ma", "c": "zup zep li zap kor", "d": "la zup ñi ñu"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randrange(1, 12))) + rng.choice(["", " 7", "!", " -- Lo"]), k) for i in range(160) for k in [rng.choice("abcd")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    langs, size = sorted(words), 1 << langid.BITS
    counts = {k: [Counter() for _ in langid.ORDERS] for k in langs}
    for _, t, k in rows:
        for c, f in zip(counts[k], plain_features(t), strict=True):
            c.update(f)
    code = [list(x) for x in langid.codewords(4)]
    bits = range(len(code[0]))
    share = lambda k, o, f: (counts[k][o][f] + 0.5) / (sum(counts[k][o].values()) + 0.5 * size)

    @functools.cache
    def odds(o, f, bit):
        mean = lambda sign: np.mean([share(k, o, f) for k, c in zip(langs, code, strict=True) if c[bit] == sign])
        return math.log(mean(1)) - math.log(mean(-1))

    def scores(text):
        return [sum(sum(odds(o, f, bit) for f in fs) / max(len(fs), 1) for o, fs in enumerate(plain_features(text))) / len(langid.ORDERS) for bit in bits]

    trust = []
    for k, c in zip(langs, code, strict=True):
        own = [scores(t) for _, t, x in rows if x == k]
        better = [max(sum(s[bit] * c[bit] for s in own) / len(own), 1e-3) for bit in bits]
        trust.append([b / sum(better) for b in better])
    assert max(map(max, trust)) > 1.05 * min(map(min, trust))  # the weights do differ
    want = {}
    texts = [t for _, t, _ in rows] + ["zap", "lo ma kar", "Ñu la", "q", ""]
    for t in texts:
        s = scores(t)
        loss = [sum(w * math.log1p(math.exp(-8 * c[b] * s[b])) for b, w in enumerate(ws)) for c, ws in zip(code, trust, strict=True)]
        likely = [math.exp(-(x - min(loss)) * len(bits)) for x in loss]
        want[t] = (langs[loss.index(min(loss))], max(likely) / sum(likely)) if any(map(str.isalpha, t)) else ("und", 0.0)
    model = langid.train(df)
    assert np.allclose(model.trust, trust)
    ask = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = langid.predict(ask, model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.lang_pred == want[r.text][0] and abs(r.score - want[r.text][1]) < 1e-4


def test_codes_of_many_languages_lie_apart():
    for n in (6, 20, 60, 200):
        code = langid.codewords(n)
        assert code.shape == (n, langid.RANDOM_BITS) and langid.distance(code) >= langid.RANDOM_BITS // 4


def test_prediction_takes_the_text_alone(spark):
    df = spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de")], "doc_id long, text string, lang string")
    model = langid.train(df)
    a = [tuple(r) for r in langid.predict(df.select("text"), model).collect()]
    b = [(r.text, r.lang_pred, r.score, r.ambiguous) for r in langid.predict(df.selectExpr("-doc_id AS doc_id", "text", "'x' AS lang"), model).collect()]
    assert a == b
