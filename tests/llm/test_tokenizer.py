from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm.tokenizer import VOCABULARY, CorpusEncoder, MergeReplay, encode_corpus, word_ids
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="the public vocabulary isn't here")
REPLAY = MergeReplay.parse(Path(VOCABULARY).read_bytes()) if Path(VOCABULARY).exists() else None


def reference():
    import tiktoken

    from loomwork.llm.tokenizer import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=REPLAY.ranks, special_tokens={})


def encode(texts):
    ids, offsets = CorpusEncoder(REPLAY).batch(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aab'' sd\n\t  1２é٣ß  　​ll'veX\r_-．中👩🏽‍💻")) | st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_same_ids_as_a_word_by_word_encoder(texts):
    enc = reference()
    assert encode(texts) == [enc.encode_ordinary(t) for t in texts]


def test_round_trip_special_strings_and_long_words():
    texts = ["The string <|endoftext|> stays text", "a" * 30_000, " " * 5000, "word " * 5000, "\n\n \n x  y   z "]
    enc = reference()
    assert [enc.decode(x) for x in encode(texts)] == texts
    assert encode([None, ""]) == [[], []]


def test_memory_bound_changes_nothing():
    texts = [f"token{i} and more{i}" for i in range(300)]
    small, large = CorpusEncoder(REPLAY, limit=10), CorpusEncoder(REPLAY)
    for at in range(0, 300, 50):
        assert small.batch(texts[at : at + 50])[0].tolist() == large.batch(texts[at : at + 50])[0].tolist()


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello", "x"), (1, "hello", "x"), (2, None, "x"), (None, "", None)], "doc_id bigint, text string, ids string")
    got = [(r[0], tuple(r[1])) for r in encode_corpus(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, (31373,)), (1, (31373,)), (2, ()), (None, ())], key=repr)
    assert rows(encode_corpus(df.limit(0))) == []


def test_corpus_words_and_their_bound(spark):
    texts = ["the cat sat", "the  cat's hat\n", None, "", " odd　spaces \t", "the " * 50, "x" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = reference()
    want = sorted((i, tuple(enc.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    for sent in (0, 2, 1000):
        assert sorted((r[0], tuple(r[1])) for r in encode_corpus(df, sent_words=sent).collect()) == want
    blob = spark.sparkContext.broadcast(Path(VOCABULARY).read_bytes())
    found = {bytes(r["word"]).decode(): (r["n"], r["ids"]) for r in word_ids(df, "text", blob).collect()}
    assert found[" the"] == (49, enc.encode_ordinary(" the")) and found["the"][0] == 3 and found["'s"][0] == 1
