import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quireflow.llm import components, golay, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, errors=4):
    """Least id reachable, by all pairs."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= errors:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)
    assert set(np.bincount(golay.decode(words))) == {2048}


def test_indices_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 500).astype(np.uint32)
    a, mask = golay.neighbours(x, range(23))
    for _ in range(2):
        y = x ^ np.uint32(1) << rng.integers(0, 23, 500).astype(np.uint32)
        y = y ^ np.uint32(1) << rng.integers(0, 23, 500).astype(np.uint32)
        b, other = golay.neighbours(y, range(23))
        for i in range(500):
            assert set(a[i][mask[i]]) & set(b[i][other[i]])


@pytest.mark.parametrize("errors", range(5))
def test_keys_meet(errors):
    rng = random.Random(errors)
    x = np.array([rng.getrandbits(64) for _ in range(400)], dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.sample(range(64), errors):
            y[i] ^= np.uint64(1) << np.uint64(b)
    found = [[set() for _ in x] for _ in range(2)]
    for side, fps in zip(found, (x, y)):
        for k, s, r in zip(*(v.tolist() for v in simhash.keys_of(fps.view(np.int64)))):
            side[r].add((k, s))
    for a, b in zip(*found):
        assert a & {(k, {0: 0, 1: 2, 2: 1}[s]) for k, s in b}


TEXTS = ["", None, "  \t\n", "One", "one two three", "ONE two\vthree four", "É é A a B b", "x" * 5000 + " y" * 3000, "a b c d e f g h i j"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text else None) == plain_fingerprint(text)


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts + ["", None, " ", "", "solo"] + [texts[0]] * 30


@pytest.mark.parametrize("block", [512, 3])
def test_components_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash.links, "__defaults__", (4, block))
    texts = corpus()
    expected = plain_components({i: plain_fingerprint(t) for i, t in enumerate(texts)})
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    assert len(got) == len(texts) and {r["doc_id"]: r["component_id"] for r in got} == expected
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_ball_of_fingerprints(spark):
    """Many distinct fingerprints around a centre, and a chain: links far beyond any key's block."""
    fps = {i: 0 for i in range(1)}
    fps |= {1 + b: 1 << b for b in range(64)}
    fps |= {100 + b: (1 << b) | (1 << (b + 1)) for b in range(63)}
    chain, x = {}, 0xAAAA5555CCCC3333
    for i in range(12):
        chain[1000 + i] = x
        x ^= 0b1111 << (4 * i)
    fps |= chain
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    pairs = simhash.links(nodes, block=16)
    by = {f: i for i, f in rows}
    edges = [(by[r["a"]], by[r["b"]]) for r in pairs.collect()]
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 4 for a, b in edges) and len(edges) < 40 * len(fps)
    found = components.components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()
    assert {r["node"]: r["component"] for r in found} == {i: c for i, c in plain_components(fps).items()}


def test_odd_tables(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    df = docs(spark, ["a b c d e", "a b c d e", "zz", "a b c d e", "other thing"], [None, 3, 3, 5, None]).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(0)).withColumn("_gone", F.lit(1))
    got = simhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(False, 3, 3), (False, 3, 3), (False, 5, 3), (True, 0, 0), (True, 0, 0)]


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(5, 5), (1, 0), (100, 101)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_components_do_not_stop_early(spark, monkeypatch):
    """However hashes of the state might agree between rounds, long paths and combs are followed to their ends."""
    monkeypatch.setattr(components.F, "xxhash64", lambda *columns: components.F.lit(0))
    rng = np.random.default_rng(5)
    names = rng.permutation(400).tolist()
    edges = list(zip(names[:150], names[1:151])) + [(names[i], names[200 + i]) for i in range(0, 150, 3)] + [(names[151 + i % 7], names[160 + i]) for i in range(30)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for x in {x for e in edges for x in e}}


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """By the files of the fingerprints, keys look small; the driver could not hold them."""
    plans, cut = [], simhash.cut
    noted = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(simhash, "cut", lambda df, name: noted(df) or cut(df, name))
    monkeypatch.setattr(components, "cut", lambda df, name: noted(df) or cut(df, name))
    noted(simhash.near_duplicates(docs(spark, corpus())))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
