import random

import pytest

from pathweave.llm import tokenizer as K

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = K.read_vocabulary(f"{K.TOKENIZERS}/{K.VOCABULARY}")
    return K.Tokenizer(ranks), tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})


def test_random_texts(both):
    mine, theirs = both
    random.seed(3)
    for chars in ("aeinrst hlo", "abcABC 019\n\t", "éüß中文🙂 ’", "=-_*#/ \n"):
        for _ in range(400):
            s = "".join(random.choice(chars) for _ in range(random.randint(0, 80)))
            assert mine.encode(s) == theirs.encode_ordinary(s)


def test_long_pieces_and_special_strings(both):
    mine, theirs = both
    for s in ("A" * 30000, "ab" * 20000, " " * 5000 + "x", "<|endoftext|>", "MKV" * 4000):
        assert mine.encode(s) == theirs.encode_ordinary(s) and mine.decode(mine.encode(s)) == s


def test_corpus(spark, data, both):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = K.encode_corpus(docs).collect()
    assert len(got) == len(texts) and all(r.ids == both[1].encode_ordinary(texts[r.doc_id] or "") for r in got)
    assert {r.doc_id: r.n_tokens for r in K.count_tokens(docs).collect()} == {r.doc_id: len(r.ids) for r in got}


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a", "x"), (3, "a", "x")], "doc_id bigint, text string, ids string")
    assert sorted((r.doc_id, r.ids) for r in K.encode_corpus(df).collect()) == [(1, []), (2, []), (3, [64]), (3, [64])]
    assert K.encode_corpus(df.limit(0)).count() == 0
