import random

import public_tokenizers
import pyarrow as pa
import pytest
from made_texts import prose
from tokenizers import Tokenizer

from srcatlas.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lists(made):
    return bpe.listed(made.flat, made.counts, pa.int32())


def check(library, texts):
    own = lists(bpe.vocabulary(PATH).encode([t or "" for t in texts]))
    back = bpe.vocabulary(PATH).decode(own).to_pylist()
    for text, ids, decoded in zip(texts, own.to_pylist(), back, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == want, text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_random_texts(library):
    rng = random.Random(5)
    parts = list("abcde ééàÉÅßΣσςİ'sSTt1²½٣日本語の \u0085 ​　\x1c\x1f\t\n!!!??<>|/w😀👍🏽éﬁǅͅΐẞ")
    parts += ["<|endoftext|>", "<|startoftext|>", "'ll", "'ve", "the"]
    check(library, ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)])


def test_documents(library, documents):
    check(library, [r.text for r in documents.select("text").collect()])


def test_odd_and_long_texts(library):
    texts = ["", None, "   ", "<|ENDOFTEXT|>", "a</w>b", "<|endoftext|><|endoftext|>", "!" * 5000, "ab" * 4000, "é" * 3000]
    check(library, [*texts, "thethere" * 900, "=" * 99 + "-" * 77, prose(30_000)])


def test_results_do_not_depend_on_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    check(library, ["one two three four", "five six seven", "one five nine"] * 3)


def test_cuts_are_never_inside_a_token():
    own = bpe.Vocabulary(PATH)
    assert not own.joined.all() and own.joined.any()
    for merge in list(own.merges)[:2000]:
        assert own.merges[merge] & 0xFFFFFF < len(own.tokens)


def test_columns_pass_through(spark, library):
    rows = [(1, "Hello world", "x", 5), (2, None, "y", 6), (2, None, "y", 6), (None, "", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd name` string, ids int")
    got = bpe.coded(df, PATH, decoded="decoded")
    assert got.columns == ["doc_id", "text", "odd name", "ids", "decoded"]
    made = sorted((r["odd name"], r.ids, r.decoded) for r in got.collect())
    want = library.encode("Hello world", add_special_tokens=False).ids
    assert made == [("x", want, "hello</w> world</w>"), ("y", [], ""), ("y", [], ""), ("z", [], "")]
    again = bpe.decoded(got.select("doc_id", "ids"), PATH)
    assert sorted(r.decoded for r in again.collect()) == ["", "", "", "hello</w> world</w>"]
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decoded(nulls, PATH).collect()] == ["", ""]
    assert bpe.coded(df.limit(0), PATH).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
