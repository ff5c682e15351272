import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F
from test_llm_golay_simhash import docs

from quireflow.llm import flac, media, queries, topk


def payloads():
    rng = random.Random(3)
    out = [b"\0" * 64, b"a" * 64, bytes(range(256)) * 4, os.urandom(5000), b"\xff\x00" * 1000, b"\0" * 1023 + b"\xff", b"ab", b"abc", b"a", (b"\x00" * 500 + b"\xff") * 10]
    out += [bytes(int(127 + 100 * math.sin(i / 40)) for i in range(5000)), b"\x00" * 200 + b"\xff" + b"\x00" * 200, b"x" * flac.BLOCK, b"xy" * flac.BLOCK]
    return out + [bytes(rng.choice(b"ab\xff\x00 xyz") for _ in range(rng.randint(1, 3000))) for _ in range(80)]


def test_flac_round_trip_and_seek():
    data = payloads()
    coded = flac.encode(data)
    assert [p for p, _ in flac.decode(coded)] == data
    rng = random.Random(4)
    for _ in range(100):
        i = rng.randrange(len(data))
        start, count = rng.randrange(len(data[i])), rng.randint(1, len(data[i]))
        assert flac.seek(coded[i], start, count) == data[i][start : start + count]
    assert flac.encode([]) == [] and flac.decode([]) == []


def test_flac_uses_predictors():
    smooth = bytes(int(127 + 100 * math.sin(i / 40)) for i in range(5000))
    assert len(flac.encode([smooth])[0]) < 0.5 * len(smooth)


def plain_decode(media_):
    """A bit-by-bit decoder of one stream: no lanes, no tables, no seek points."""
    at, last = 4, False
    while not last:
        last, n = bool(media_[at] & 0x80), int.from_bytes(media_[at + 1 : at + 4], "big")
        at += 4 + n
    out = []
    while at < len(media_):
        assert media_[at : at + 2] == b"\xff\xf8"
        lead = media_[at + 4]
        n = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
        size = int.from_bytes(media_[at + 4 + n : at + 6 + n], "big") + 1
        start, bit = at, 8 * (at + 7 + n)

        def take(k):
            nonlocal bit
            v = 0
            for _ in range(k):
                v = v << 1 | (media_[bit >> 3] >> (7 - (bit & 7)) & 1)
                bit += 1
            return v

        sign = lambda v, k: v - (1 << k) if v >> (k - 1) else v
        code = take(8) >> 1
        if code == 0:
            x = [sign(take(8), 8)] * size
        elif code == 1:
            x = [sign(take(8), 8) for _ in range(size)]
        else:
            order = code - 8 if code < 32 else code - 31
            x = [sign(take(8), 8) for _ in range(order)]
            if code >= 32:
                precision, shift = take(4) + 1, take(5)
                coefs = [sign(take(precision), precision) for _ in range(order)]
            assert take(6) == 0
            k = take(4)
            while len(x) < size:
                q = 0
                while not take(1):
                    q += 1
                u = q << k | take(k)
                r = u >> 1 if not u & 1 else -(u + 1 >> 1)
                if code >= 32:
                    p = sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift
                else:
                    p = (0, x[-1] if order > 0 else 0, 2 * x[-1] - x[-2] if order > 1 else 0)[order]
                x.append(r + p)
        out += x
        at = -(-bit // 8) + 2
        crc = 0
        for b in media_[start : at - 2]:
            crc ^= b << 8
            for _ in range(8):
                crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
        assert crc == int.from_bytes(media_[at - 2 : at], "big")
    return bytes(v + 128 for v in out)


def test_flac_against_a_plain_decoder():
    data = payloads()[:40]
    assert [plain_decode(m) for m in flac.encode(data)] == data


@pytest.mark.parametrize("place", [30, -1, -20, 3])
def test_flac_finds_damage(place):
    coded = bytearray(flac.encode([b"the quick brown fox " * 40])[0])
    coded[place] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(coded)])


def test_media_digests(spark):
    texts = ["", None, "a", "é" * 40, "x" * 64, "word " * 3000]
    got = {r["doc_id"]: r for r in media.digests(docs(spark, texts).withColumn("media", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    stored = media.to_media(docs(spark, texts))
    assert {r["doc_id"]: (len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) for r in stored.collect()} == {i: (r["media_bytes"], r["media_sha256"]) for i, r in got.items()}
    blocks = media.pcm_blocks(stored).where("doc_id = 5").orderBy("block").collect()
    assert b"".join(r["pcm"] for r in blocks).startswith(texts[5].encode()) and [r["sample_offset"] for r in blocks] == [flac.BLOCK * i for i in range(len(blocks))]
    assert got[0]["feature"] == got[1]["feature"]
    assert media.digests(docs(spark, ["x"]).limit(0)).count() == 0


def brute(rows, queries_, k=5):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)

    known = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, v in queries_:
        if q is None or not ok(v):
            continue
        w = [math.floor(256 * x) for x in v]
        best = sorted((-sum(a * b for a, b in zip(w, c)), i) for i, c in known if i != q and len(c) == len(w))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,dim", [(4096, 8), (7, 8), (5, 1), (3, 64)])
def test_top_k_against_all_pairs(spark, block, dim):
    rng = np.random.default_rng(block + dim)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dim), 1)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # a common vector: ties
    rows += [(201, rows[3][1]), (201, rows[7][1]), (149, rows[9][1])]  # rows that repeat a vec_id
    rows += [(300, None), (301, []), (302, [1.0] * (dim + 1)), (303, [float("nan")] * dim), (304, [float("inf")] * dim), (305, [None] * dim), (None, [1.0] * dim), (306, [0.0] * dim), (307, [-3.0] * dim), (350, [None] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine")).withColumn("slice", F.lit(1))
    asked = df.where("vec_id % 10 = 0")
    got = sorted(map(tuple, topk.search(df, asked, block=block, query_block=4).collect()))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(single, [(i, v) for i, v in single if i is not None and i % 10 == 0])


def test_top_k_completes_few_scores():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    c = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 32))))
    c[2000:] = np.floor(c[2000:] / 50)  # a block of small vectors
    q, own = c[:30], np.arange(30)[:, None] == np.arange(2000)[None, :]
    scores = np.where(own, -np.inf, q @ c[:2000].T)
    blocks = [topk._partials(q, c[at : at + 2000], 4) for at in (0, 2000)]
    rows, cols, score, top = topk.local_lists(blocks[0], own, 5)
    assert len(rows) <= 30 * 5 * 4 and (score == scores[rows, cols]).all()
    cutoff = np.array([np.sort(score[rows == i])[-5] for i in range(30)])
    assert (cutoff <= np.sort(scores, axis=1)[:, -5]).all()
    got = topk.collected(blocks[0], own, top, cutoff)
    assert len(got[0]) < 0.2 * own.size  # most scores are never put together
    found = np.zeros(own.shape, dtype=bool)
    found[got] = True
    assert found[scores >= cutoff[:, None]].all()
    far = topk.local_lists(blocks[1], np.zeros_like(own), 5)[3]
    assert (far.sum(axis=1) < cutoff).all()  # the other block is left out altogether


def test_top_k_few_and_large(spark):
    df = spark.createDataFrame([(0, [1e6, 2.0]), (1, [-1e6, 3.0]), (2, [3e7, -3e7])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df, df).collect())) == brute([tuple(r) for r in df.collect()], [tuple(r) for r in df.collect()])
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_top_k_equals_sql(spark):
    assert same(spark, queries.QUERIES["op6_exact_top_k"], queries.ORACLE_SQL["op6_exact_top_k"]) > 0


def test_top_k_broadcasts_nothing(spark, monkeypatch):
    """Queries are repeated for each slice: as a broadcast they'd be held by the driver."""
    plans, cut = [], topk.cut
    monkeypatch.setattr(topk, "cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, name))
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    found = topk.search(vectors, vectors.where("vec_id % 20 = 0"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) == 3 and not any("Broadcast" in p for p in plans)
