import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from tidemark.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


SAMPLES = ["", " ", "\n\n  x", "don't we'll I'M", "a" * 5000, "ababababab" * 50, "日本語テキスト🙂🙂", "x<|endoftext|>y<|endoftext|><|endoftext|>", "  leading\tand trailing  ", "  ", "12345 67.89", "\x00\x01"]


@pytest.mark.parametrize("text", SAMPLES)
def test_same_as_library(library, text):
    ids, decimal = bpe.tokenizer(PATH).encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert decimal == ",".join(map(str, want))
    assert bpe.tokenizer(PATH).decode(ids).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefgthieno rs.\n'0ßéñ"), max_size=60))
def test_random_texts(text):
    t = bpe.tokenizer(PATH)
    want = _library().encode(text, add_special_tokens=False).ids
    assert t.encode(text)[0].tolist() == want


def test_every_token_encodes_to_itself():
    t = bpe.tokenizer(PATH)
    assert all(t.backtrack(s) == [i] for s, i in t.vocab.items() if i not in t.special.values())


_lib = []


def _library():
    if not _lib:
        _lib.append(Library.from_file(PATH))
    return _lib[0]


def test_rows(spark):
    rows = [(1, "hello world", "z"), (2, None, "z"), (2, None, "z"), (None, "", "z"), (3, "ha " * 20000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.tokenize(df, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(out) == 5
    for row, (_, text, _) in zip(out, rows, strict=True):
        text = text or ""
        want = _library().encode(text, add_special_tokens=False).ids
        assert row.ids == want and row.n_tokens == len(want) and row.decoded == text
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.tokenize(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from tidemark.llm.queries import op7_bpe

    got = {r.doc_id: r for r in op7_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = _library().encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_a_worker_forgets_what_it_met_when_its_task_ends(spark):
    """Workers go on with other steps, so only the vocabulary stays."""
    path = bpe.default_path()

    def held(batches):
        for _ in batches:
            t = bpe.tokenizer(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(t.packed) + len(t.packed.older) + len(t.seams.known)])], names=["n"])

    texts = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "concat('strange', id, 'ness wordiness', id) AS text")
    assert bpe.tokenize(texts).agg({"n_tokens": "min"}).first()[0] > 2
    assert [r.n for r in spark.range(0, 1, 1, 1).mapInArrow(held, "n long").collect()] == [0]
