"""Rows that share an id, or have none, are told apart by their text."""

import random

from tidemark.llm import decontam, icws


def test_keep_one_and_decontaminate(spark):
    rng = random.Random(8)
    new = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    texts = [new() for _ in range(9)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:7]] + [(8, texts[7]), (9, texts[8])]
    copies = [(7, texts[4]), (None, texts[8] + " more"), (20, texts[0]), (None, texts[1] + " more"), (9, texts[4])]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(4)
    kept = [tuple(r) for r in icws.keep_one(df).collect()]
    # text 0 stays under 20 (an id comes before none); of text 1 and its copy, both without an id, one stays
    assert [r for r in kept if r[1].startswith(texts[1])] in ([(None, texts[1])], [(None, texts[1] + " more")])
    want = [r for r in rows if r not in ((None, texts[0]), (None, texts[1]))] + [(20, texts[0])]
    assert sorted((r for r in kept if not r[1].startswith(texts[1])), key=repr) == sorted(want, key=repr)

    bench = spark.createDataFrame([(1, texts[2]), (2, texts[5])], "item_id long, text string")
    clean = sorted((tuple(r) for r in decontam.decontaminate(df, bench).collect()), key=repr)
    assert clean == sorted((r for r in rows + copies if r[1] not in (texts[2], texts[5])), key=repr)
