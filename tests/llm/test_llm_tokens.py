import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_llm_golay_simhash import docs
from tokenizers import Tokenizer

from quireflow.llm import bpe, tokencount, tokenfiles

ODD = ["", None, " ", "\n", "a", " a", "a ", "a\n", "\na", "x\ny z", "a  b", "1\n2\n3 4", "\0a b", "x \0y", "don't I'LL 123abc½²", "日本語 ΣΑΣ Σ", "İstanbul ǅ ﬁ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "x<|endof text|>", "é ́a", "😀😀 a\x1cb\x85c\xa0d", "''s ''' 'S", "ª º µ ÿ Ÿ ſ K", "a" * 3000, "ab " * 3000, "\t\r\n \x0b\x0c", "<|EndOfText|>"]


def noise(n, seed):
    rng = random.Random(seed)
    letters = "aB'sSé ß\n\t0½Σσ日!.<|>́ \x1cǅ  tt"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def own(spark, n=120):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(n).collect()]


def test_bpe_equals_the_library(spark):
    texts = ODD + noise(300, 1) + own(spark)
    ranks = bpe.ranks_of(tokenfiles.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=tokenfiles.pattern(), mergeable_ranks=ranks, special_tokens={})
    df = docs(spark, texts).withColumn("ids_text", F.lit("mine")).withColumn("t", F.lit(1))
    got = {r["doc_id"]: r for r in bpe.encode(df, ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        text = " ".join(map(str, ids))
        assert (got[i]["n_tokens"], got[i]["ids_text"]) == (len(ids), text)
        assert got[i]["ids_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and got[i]["decoded_ok"]


def library_of(name="byte_bpe_50k.tiktoken"):
    ranks = bpe.ranks_of(tokenfiles.path(name))
    return tiktoken.Encoding("own", pat_str=tokenfiles.pattern(), mergeable_ranks=ranks, special_tokens={})


def ids_of(coder, texts):
    ids, at = coder.encode(texts)
    assert [bytes(x) for x in coder.decode(ids, at)] == [t.encode() for t in texts]
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_bpe_caches_turn_over():
    coder = bpe.Codec(tokenfiles.path("byte_bpe_50k.tiktoken"), tokenfiles.pattern())
    coder.known.most = 10
    texts = noise(60, 2)
    first = ids_of(coder, texts)
    assert [ids_of(coder, [t])[0] for t in texts] == first


def test_words_of_any_length():
    coder, library = bpe.Codec(tokenfiles.path("byte_bpe_50k.tiktoken"), tokenfiles.pattern()), library_of()
    rng = random.Random(4)
    letters = ["a", "ab", "theaingsr", "=-", "é", "日本", "0123456789", "aeiou", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    words = ["".join(rng.choice(some) for _ in range(n)) for some in letters for n in (60, 64, 65, 66, 200, 1500)]
    assert ids_of(coder, words) == [library.encode_ordinary(w) for w in words]
    words = ["a" * 5000, "".join(rng.choice("theaingsr") for _ in range(4000)), "é" * 3000]
    assert ids_of(coder, words) == [library.encode_ordinary(w) for w in words]
    assert sum(map(len, ids_of(coder, ["x" * 200_000]))) < 200_000


def test_both_queries_give_the_same_ids():
    coder = bpe.Codec(tokenfiles.path("byte_bpe_50k.tiktoken"), tokenfiles.pattern())
    rng = random.Random(5)
    raw = ["".join(rng.choice(some) for _ in range(rng.randint(1, 40))).encode() for some in ("ab", "theaingsr", "aaab", "é日a") for _ in range(100)]
    short, long_ = (coder.merge(raw, q) for q in (bpe.ENCODE, bpe.ENCODE_LONG))
    assert short[0].tolist() == long_[0].tolist() and short[1].tolist() == long_[1].tolist()


def test_bpe_decodes_ids(spark):
    texts = ODD + noise(50, 6)
    coded = bpe.encode(docs(spark, texts), ids=True).withColumn("decoded", F.lit("mine"))
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(coded).collect()}
    assert got == {i: (t or "").encode() for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "64"), (2, "64 64")], "doc_id long, ids_text string")
    one = bpe.Codec(tokenfiles.path("byte_bpe_50k.tiktoken"), tokenfiles.pattern()).decode(np.array([64], dtype=np.int32), np.array([0, 1]))[0]
    rows = [(r["doc_id"], None if r["decoded"] is None else bytes(r["decoded"])) for r in bpe.decode(odd).collect()]
    assert sorted(rows, key=str) == sorted([(1, None), (2, b""), (None, bytes(one)), (2, bytes(one) * 2)], key=str)
    assert bpe.decode(odd.limit(0)).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, "9999999")], "doc_id long, ids_text string")).collect()


def test_bpe_small_slices_and_other_vocabulary(spark):
    texts = ODD + own(spark, 20)
    ranks = bpe.ranks_of(tokenfiles.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=tokenfiles.pattern(), mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs(spark, texts), vocabulary="byte_bpe_multi_50k.tiktoken", at_once=10).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(library.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_counts_equal_the_library(spark):
    texts = ODD + noise(400, 3) + own(spark)
    library = Tokenizer.from_file(tokenfiles.path("word_bpe_49k.json"))
    expected = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for table in (50_000, 3, 0):
        got = {r["doc_id"]: r for r in tokencount.count_tokens(docs(spark, texts), table=table, limit=100).collect()}
        assert [got[i]["n_tokens"] for i in range(len(texts))] == expected
        assert all(got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (expected[i] > 100) for i, t in enumerate(texts))


def test_empty_tables_and_repeated_rows(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert bpe.encode(empty).count() == 0 and tokencount.count_tokens(empty).count() == 0
    df = docs(spark, ["a b", "a b", None], [7, 7, None])
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.encode(df).collect()) == [(0, 0), (7, 2), (7, 2)]
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokencount.count_tokens(df).collect()) == [(0, 0), (7, 2), (7, 2)]


def test_table_is_bounded(spark):
    found = tokencount.frequent(docs(spark, own(spark)), "text", tokenfiles.path("word_bpe_49k.json"), 50, 100)
    assert len(found) == 50
