import hashlib
from collections import Counter

import tiktoken
from oracle import SMALL
from pyspark.sql import functions as F
from test_llm_similar import plain_groups
from test_llm_text import plain_lines

import corpus_pipeline
from quireflow.llm import bpe, langid, mixing, tokenfiles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, docs, sf_dir, folder):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, two, three, four, five = staged(spark, docs, SMALL, tmp_path)
    assert all(d.columns == COLUMNS for d in (one, two, three, four))
    rows = docs.orderBy("doc_id").collect()
    names, _, rejected = langid.learnt(docs).predict([r["text"] for r in rows])
    first = {r["doc_id"]: (r["text"], n) for r, n, x in zip(rows, names, rejected) if not x}
    assert {r["doc_id"]: (r["text"], r["lang"]) for r in one.collect()} == first
    ids = sorted(first)
    lines = dict(zip(ids, plain_lines([first[i][0] for i in ids])))
    assert {r["doc_id"]: r["text"] for r in two.collect()} == lines
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    groups = plain_groups(lines)
    kept = {i: t for i, t in lines.items() if groups[i] == i}
    assert {r["doc_id"]: r["text"] for r in three.collect()} == kept
    copies = Counter(r["doc_id"] for r in four.collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(three).collect() if r["copies"]}) and max(copies.values()) <= 2
    assert all(r["text"] == kept[r["doc_id"]] for r in four.collect())
    library = tiktoken.Encoding("own", pat_str=tokenfiles.pattern(), mergeable_ranks=bpe.ranks_of(tokenfiles.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = five.collect()
    assert Counter(r["doc_id"] for r in got) == copies
    for r in got:
        ids_ = library.encode_ordinary(kept[r["doc_id"]])
        assert r["n_tokens"] == len(ids_) and r["ids_text"] == " ".join(map(str, ids_)) and r["decoded_ok"]
        assert r["decoded_sha256"] == hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest()


def test_odd_documents(spark, tmp_path):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    text = base.first()["text"]
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, text, None, None, 1), (9003, text, None, None, 1), (None, text, "en", "s", 5), (9004, "12 34", "en", "s", 5)], base.schema)
    docs = base.unionByName(odd).withColumn("_found", F.lit("mine")).withColumn("gone", F.lit(1)).withColumn("h", F.lit(2.5))
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    out = staged(spark, docs, f"{tmp_path}/in", tmp_path / "out")
    assert all(d.columns == docs.columns for d in out[:4])
    assert {9001, 9002, 9004} & {r["doc_id"] for r in out[0].collect()} == set()
    assert out[0].where("doc_id is null").count() == 1 and out[4].count() == out[3].count()
    empty = docs.limit(0)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]
