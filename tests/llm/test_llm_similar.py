import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_golay_simhash import TEXTS, docs

from quireflow.llm import similar


def plain_set(text, size=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_groups(texts, similarity=0.8):
    """Least id reachable, by all pairs."""
    ids, sets = sorted(texts), {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if find(a) != find(b) and jaccard(sets[a], sets[b]) >= similarity:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def edited(rng, base, edits):
    own = list(base)
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"w{rng.randrange(3000)}"
    return own


@pytest.mark.parametrize("text", TEXTS)
def test_shingle_set(text):
    assert len(similar.shingle_set(text.encode() if text else None, 5)) == len(plain_set(text))


@pytest.mark.parametrize("length", [20, 60, 300])
def test_keys_meet(length):
    """Of pairs at the least similarity, at least 97 of 100 share a key and are near by their fingerprints."""
    rng, hits, total, most = random.Random(length), 0, 0, similar.most_bits(0.8)
    while total < 200:
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        pair = [" ".join(base), " ".join(edited(rng, base, rng.randint(1, max(1, length // 30))))]
        if not 0.8 <= jaccard(*map(plain_set, pair)) <= 0.9:
            continue
        total += 1
        own = [similar.shingle_set(t.encode(), 5) for t in pair]
        prints = [np.array([similar.simhash.majority([similar.mix(h, i)]) for h in own], dtype=np.uint64) for i in range(similar.PRINTS)]
        least = [np.array([similar.mix(h, similar.PRINTS + i).min() for h in own]) for i in range(similar.LEAST)]
        keys, rows = similar.keys_of(prints, least)
        stacked = np.stack(prints, axis=1)
        hits += bool(set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())) and bool(similar.near(stacked[0], stacked[1], most))
    assert hits >= 0.97 * total


def corpus():
    """Texts alone, pairs near the least similarity on both sides of it, a dense group, a group around one passage."""
    rng = random.Random(12)
    texts = []
    for i in range(80):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(10, 200))]
        texts += [" ".join(base), " ".join(edited(rng, base, i % 4 * len(base) // 100 + 1))]
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts += [" ".join(edited(rng, base, 2)) for _ in range(60)]
    passage = [f"w{rng.randrange(3000)}" for _ in range(60)]
    texts += [" ".join(passage + [f"w{rng.randrange(3000)}" for _ in range(60)]) for _ in range(60)]
    return texts + ["", None, " ", "solo", "Solo", "SOLO\v"] + [texts[0]] * 20


@pytest.mark.parametrize("block", [4096, 16])
def test_groups_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(similar.candidates, "__defaults__", (block,))
    texts = dict(enumerate(corpus()))
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs(spark, list(texts.values()))).collect()}
    assert got == plain_groups(texts)


def test_odd_tables(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert similar.near_copies(empty).count() == 0 and similar.keep_one(empty).count() == 0
    df = docs(spark, ["a b c d e", "a b c d e", "zz", "a b c d e", "other thing", None, " "], [None, 3, 3, 5, None, 7, 8])
    df = df.withColumn("m0", F.lit("mine")).withColumn("component_id", F.lit(0)).withColumn("_gone", F.lit(1)).withColumn("digest", F.lit(2))
    got = similar.near_copies(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(False, 3, 3), (False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 8, 7), (True, 0, 0), (True, 0, 0)]
    kept = similar.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 3, 3, 7]


def test_no_link_is_missed(spark, monkeypatch):
    """Links whose fingerprints or keys don't meet are found too."""
    monkeypatch.setattr(similar, "most_bits", lambda similarity: 0)
    monkeypatch.setattr(similar.missed, "__defaults__", (4,))
    texts = dict(enumerate(corpus()))
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs(spark, list(texts.values()))).collect()}
    assert got == plain_groups(texts)


def test_prefixes_and_parities_allow_what_is_similar():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 500]:
        for similarity in (0.5, 0.8, 0.9):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            most = int(len(a) * (1 - similarity) + 1e-9)
            b = np.unique(a[most:])
            common = rng.permutation(a)[: n // 2]
            assert set(similar.prefix(a, similarity, common).tolist()) & set(similar.prefix(b, similarity, common).tolist())
            size, bits = np.array([len(a), len(b)]), np.stack([similar.parities(a), similar.parities(b)])
            assert similar.allowed(size, bits, np.array([1, 2]), 0, similarity).tolist() == [1]


def test_histograms_allow_what_is_similar():
    rng = np.random.default_rng(4)
    for n in (1, 7, 60, 3000, 400_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b, other = a[int(len(a) * 0.2 + 1e-9) :], np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        cells = [similar.histogram(x)[None] for x in (a, b, other)]
        assert similar.may_be(cells[0], cells[1], np.array([len(a) + len(b)]), 0.8).all()
        assert n > 20_000 or not similar.may_be(cells[0], cells[2], np.array([len(a) + len(other)]), 0.8).any()


def test_long_texts_that_share_a_passage_move_little(spark):
    """Pairs whose parities tell nothing go no further than their histograms; the similar one is found."""
    rng = random.Random(6)
    passage = [f"w{rng.randrange(3000)}" for _ in range(30)]
    texts = [" ".join(passage + [f"w{rng.randrange(3000)}" for _ in range(4000)]) for _ in range(24)]
    texts.append(" ".join(texts[0].split()[:-90]))
    pairs = spark.createDataFrame([(a, b) for b in range(len(texts)) for a in range(b)], "u long, v long")

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = written()
        got = [tuple(r) for r in similar.similar(docs(spark, texts), pairs, "text", 5, 0.8).collect()]
        assert got == [(0, len(texts) - 1)] and written() - at < 5_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
