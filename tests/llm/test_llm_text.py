import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SMALL, same
from pyspark.sql import functions as F
from test_llm_golay_simhash import docs

from quireflow.llm import langid, licensescan, linededup, mixing, queries, sharding

# --- license scan


def test_license_equals_sql(spark):
    assert same(spark, queries.QUERIES["op2_license_scan"], queries.ORACLE_SQL["op2_license_scan"]) > 0


def test_licenses_are_found(spark):
    known = licensescan.known_texts()
    mit = next(t for n, t in known if n == "MIT")
    variants = [mit, mit.upper(), mit.replace("license", "licence").replace("License", "Licence"), "Copyright 2020 Somebody\n" + mit, mit.replace("\n", "\r\n").replace('"', "“"), mit.replace("Copyright (c) <year> <copyright holders>", "© 1999 A. Person, all rights reserved"), "  " + mit.replace(" ", "   ") + "\n\n"]
    others = [mit + " And more.", mit[:-20], "", None, "!!!", "Copyright 2000 X"]
    got = {r["doc_id"]: r for r in licensescan.scan(docs(spark, variants + others).withColumn("license", F.lit("mine")).withColumn("digest", F.lit(1))).collect()}
    assert [got[i]["license"] for i in range(len(variants))] == ["MIT"] * len(variants)
    assert [got[len(variants) + i]["license"] for i in range(len(others))] == [None] * len(others)
    assert got[len(variants) + 3]["digest"] is None and got[len(variants) + 2]["digest"] == got[len(variants) + 4]["digest"] == got[len(variants) + 5]["digest"]
    for name, text in known:
        assert licensescan.scan(docs(spark, [text])).first()["license"] == name
    assert licensescan.scan(docs(spark, ["x"]).limit(0)).count() == 0


def rewrapped(text, width):
    """A text whose paragraphs are wrapped anew; notices keep their lines."""
    notice, out = re.compile(r"[ \t]*(copyright (\(c\) )?[<\[0-9]|©)", re.I), []
    for paragraph in re.split(r"\n[ \t]*\n", text):
        rest = []
        for line in [*paragraph.split("\n"), None]:
            if line is None or notice.match(line):
                out += textwrap.wrap(" ".join(rest), width, break_long_words=False, break_on_hyphens=False) + ([line] if line else [])
                rest = []
            else:
                rest.append(line)
        out.append("")
    return "\n".join(out)


def test_licenses_wrapped_at_all_widths(spark):
    known, texts = licensescan.known_texts() + licensescan.long_texts(), []
    assert {n for n, _ in known} >= {"MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
    for name, text in known:
        form = licensescan.canonical_text(text)
        # the GPL's appendix has a notice within a line, which is one by itself where a line begins with it: its terms only
        wrapped = [text] if "<name of author>" in text and name.startswith("GPL") else [rewrapped(text, w) for w in range(10, 121)]
        assert [t for t in wrapped if licensescan.canonical_text(t) != form] == [], name
        texts += [(name, t) for t in wrapped[::20]]
    isc = next(t for n, t in known if n == "ISC").replace("that the above copyright", "that the above\ncopyright")
    texts += [("ISC", isc), ("ISC", isc.replace("Copyright (c) <year> <copyright holders>", "Copyright The Authors of Something"))]
    got = {r["doc_id"]: r["license"] for r in licensescan.scan(docs(spark, [t for _, t in texts])).collect()}
    assert [got[i] for i in range(len(texts))] == [n for n, _ in texts]


def test_license_forms_agree(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aLé (c)©.,\n\tlicence sub-license whilst “x” per cent ") for _ in range(80)) for _ in range(60)]
    texts += ["licence licence licence", "(c) x\ny", "a (c) b", "\t copyright me\nkeep"]
    got = [r["f"] for r in docs(spark, texts).orderBy("doc_id").select(licensescan.canonical(F.col("text")).alias("f")).collect()]
    assert got == [licensescan.canonical_text(t) for t in texts]


def test_known_licenses_of_the_callers_own(spark):
    known = spark.createDataFrame([("b", "Some terms."), ("a", "some TERMS"), ("c", "..")], "license string, text string")
    assert licensescan.scan(docs(spark, ["some   terms!", "."]), known).where("license is not null").first()["license"] == "a"


# --- line dedup


def test_lines_equal_sql(spark):
    assert same(spark, queries.QUERIES["op10_line_dedup"], queries.ORACLE_SQL["op10_line_dedup"]) > 0


def long_line(rng, n=60):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 99)) for _ in range(n))


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(7)
    line = lambda n=12: long_line(rng, n)
    passage, block = long_line(rng), "\n".join(line() for _ in range(40))
    clean = ["\n".join(line() for _ in range(10)) for _ in range(5)]
    texts = [*clean, clean[0] + "\n" + passage, passage + "\n" + line(), block, line() + "\n" + block + "\n" + line(), "", None, "\n\n", "\n\n", "solo"]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(5)] == clean
    assert passage in got[5] and passage not in got[6] and got[7] == block
    assert got[8].count("\n") < 15 and got[8].split("\n")[0] == texts[8].split("\n")[0] and got[8].split("\n")[-1] == texts[8].split("\n")[-1]
    assert got[9] == "" and got[10] is None and got[11] == "\n\n" and got[12] == "" and got[13] == "solo"


def shortest_runs(lines, most):
    """The shortest runs [start, stop) of more than `most` words, from each line with words on and up to each."""
    words = [len(x.encode().split()) for x in lines]
    out = set()
    for a in range(len(lines)):
        if words[a]:
            heads = [b for b in range(a, len(lines)) if sum(words[a : b + 1]) > most]
            tails = [b for b in range(a + 1) if words[b] and sum(words[b : a + 1]) > most]
            out |= {(a, heads[0] + 1)} if heads else set()
            out |= {(tails[-1], a + 1)} if tails else set()
    return out


def plain_lines(texts, window=2, divisor=4, most=50, passages=True):
    """The same by plain Python: {doc: kept lines}."""
    import hashlib

    seen, units = set(), []
    for i, t in enumerate(texts):
        lines = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        start = 0
        for j in range(len(lines)):
            if j == len(lines) - 1 or (j >= window - 1 and sum(h[j - k] * 31**k for k in range(window)) % divisor == 0):
                if j + 1 - start > 1:
                    units.append((i, start, j + 1, "\n".join(lines[start : j + 1])))
                start = j + 1
        if passages:
            units += [(i, a, b, "\n".join(lines[a:b])) for a, b in shortest_runs(lines, most)]
        else:
            units += [(i, j, j + 1, x) for j, x in enumerate(lines) if len(x.encode().split()) > most]
    gone = defaultdict(set)
    for i, a, b, u in sorted(set(units)):
        if u in seen:
            gone[i] |= set(range(a, b))
        seen.add(u)
    return ["\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, t in enumerate(texts)]


@pytest.mark.parametrize("window,passages", [(2, False), (3, False), (2, True), (3, True)])
def test_lines_against_plain_python(spark, window, passages):
    rng = random.Random(8)
    pool = [long_line(rng, rng.choice([1, 5, 70])) for _ in range(30)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, texts), window=window, passages=passages).collect()}
    assert [got[i] for i in range(len(texts))] == plain_lines(texts, window, passages=passages)


def plain_passages(texts, most=50):
    """Lines of each text that lie in a run of more than `most` words which occurs before: by plain Python, every run."""
    gone, at = [set() for _ in texts], defaultdict(list)
    lines = [t.split("\n") for t in texts]
    for i, own in enumerate(lines):
        for a in range(len(own)):
            at[own[a]].append((i, a))
    for i, own in enumerate(lines):
        for a in range(len(own)):
            for j, b in at[own[a]]:
                if (j, b) >= (i, a):
                    break
                n = 0
                while a + n < len(own) and b + n < len(lines[j]) and own[a + n] == lines[j][b + n]:
                    n += 1
                if len("\n".join(own[a : a + n]).encode().split()) > most:
                    gone[i] |= {x for x in range(a, a + n) if own[x].split()}
    return gone


def test_passages_go_to_their_last_line(spark):
    rng = random.Random(18)
    fresh = lambda n: [long_line(rng, rng.randint(3, 14)) for _ in range(n)]
    passage = fresh(9)
    texts = ["\n".join(fresh(a) + passage + fresh(a)) for a in (1, 2, 3, 5, 8)] + ["\n".join(fresh(3) + passage[:1] + fresh(3))]
    got = [r["text"] for r in linededup.dedup_lines(docs(spark, texts), passages=True).orderBy("doc_id").collect()]
    assert got[0] == texts[0] and all(not set(t.split("\n")) & set(passage) for t in got[1:5])
    assert [len(t.split("\n")) for t in got[1:5]] == [4, 6, 10, 16] and got[5] == texts[5]


def test_passages_against_plain_python(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    rng = random.Random(19)
    pool = [long_line(rng, rng.choice([1, 5, 30, 70])) for _ in range(12)] + [""]
    own = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(40)]
    for texts in ([r["text"] for r in table], own):
        lost = plain_passages(texts)
        chunks = plain_lines(texts, passages=False)
        got = [r["text"] for r in linededup.dedup_lines(docs(spark, texts), passages=True).orderBy("doc_id").collect()]
        for t, new, gone, old in zip(texts, got, lost, chunks):
            left = [x for i, x in enumerate(t.split("\n")) if i not in gone]
            # beside passages only chunks and blank lines inside of passages go
            assert not Counter(filter(str.strip, new.split("\n"))) - Counter(left) and not Counter(filter(str.strip, new.split("\n"))) - Counter(old.split("\n"))
        assert {x for t in texts for x in t.split("\n")} - {""} == {x for t in got for x in t.split("\n")} - {""}
    assert [r["doc_id"] for r in queries.QUERIES["op10_line_dedup"](spark, SMALL).where("lines_removed > 0").collect()]


def test_text_of_very_many_lines(spark):
    """Losing most of 40,000 lines takes time linear in them."""
    rng = random.Random(20)
    block = [long_line(rng, 12) for _ in range(20_000)]
    texts = ["\n".join(block), "\n".join(["own first line", *block, "own last line"])]
    got = linededup.report(docs(spark, texts)).orderBy("doc_id").collect()
    assert got[0]["lines_removed"] == 0 and got[1]["n_lines"] == 20_002 and got[1]["lines_removed"] == 20_000


def test_line_dedup_odd_tables(spark):
    rng = random.Random(9)
    text = "\n".join(long_line(rng, 20) for _ in range(12))
    df = docs(spark, [text, text, text, text], [None, 4, 4, 9]).withColumn("gone", F.lit("g")).withColumn("_id", F.lit("i")).withColumn("unit", F.lit(2))
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns and {(r["gone"], r["_id"], r["unit"]) for r in out.collect()} == {("g", "i", 2)}
    got = [(r["doc_id"], len(r["text"])) for r in out.collect()]
    assert sorted(n == len(text) for i, n in got if i is None) == [True] and all(n < len(text) for i, n in got if i is not None)
    assert linededup.dedup_lines(df.limit(0)).count() == 0 and linededup.report(df.limit(0)).count() == 0


def test_lost_lines_are_not_broadcast(spark):
    """The join with what rows lose is the same on small and large tables."""
    plan = linededup.marked(docs(spark, ["a\nb", "a\nb"]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


# --- mixing


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    assert mixing.targets([100, 100]) == [200.0, 100.0]
    sizes = [10, 500, 30, 80, 0, 200]
    t = mixing.targets(sizes)
    assert math.isclose(sum(t), 1.5 * sum(sizes)) and all(0 <= x <= 2 * s for x, s in zip(t, sizes))
    rate = [x / w for x, w, s in zip(t, (5, 2, 1, 5, 2, 1), sizes) if x < 2 * s]
    assert max(rate) - min(rate) < 1e-9


def test_tree_splits_exactly():
    rng = np.random.default_rng(1)
    for shards in (1, 2, 3, 16, 7):
        quotas = rng.integers(0, 500, 6)
        out = mixing.split_tree(quotas, shards, rng)
        assert (out.sum(axis=1) == quotas).all() and out.sum(axis=0).max() - out.sum(axis=0).min() <= math.ceil(math.log2(shards)) + 1 and (out >= 0).all()


def test_mix(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("size", F.lit("mine")).withColumn("h", F.lit(0))
    rows = mixing.mix(df).collect()
    assert len(rows) == 1000 and rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and len(r["shards"]) == r["copies"] and all(0 <= s < 16 for s in r["shards"])
    names = sorted(by)
    expected = mixing.targets([sum(r["size"] for r in by[n]) for n in names])
    for n, t in zip(names, expected):
        taken = sum(r["taken"] for r in by[n])
        assert math.isclose(by[n][0]["target"], t) and abs(taken - t) <= 0.03 * t
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def plain_copies(rows):
    """copies of each (doc_id, h) by plain Python: whole passes, the first rows by hash that fit, and rows that fill."""
    sources = sorted({r["source"] for r in rows}, key=lambda n: (n is None, n or ""))
    sizes = [sum(r["size"] for r in rows if r["source"] == n) for n in sources]
    out = {}
    for n, size, t in zip(sources, sizes, mixing.targets(sizes)):
        own = sorted((r for r in rows if r["source"] == n), key=lambda r: r["h"])
        full = min(2, int(t // size)) if size else 0
        left, taken = t - full * size, 0
        if left > 0:
            while taken < len(own) and own[taken]["size"] <= left:
                left -= own[taken]["size"]
                taken += 1
        more = set(range(taken))
        for _ in range(mixing.FILLS):
            if full >= 2 or left <= 0.5:
                break
            gap, i = min(((abs(left - own[i]["size"]), i) for i in range(taken, len(own)) if i not in more), default=(left, -1))
            if gap >= left:
                break
            more.add(i)
            left -= own[i]["size"]
        for i, r in enumerate(own):
            out[r["doc_id"]] = full + (i in more)
    return out


def test_mix_against_plain_python(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert {r["doc_id"]: r["copies"] for r in rows} == plain_copies(rows)


def test_shards_lie_together_and_are_shuffled(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("_row", F.lit("mine")).withColumn("h", F.lit(0))
    out = mixing.sharded(df).select("_shard", "doc_id", "source", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = sorted(out.collect(), key=lambda r: r["at"])
    decided = Counter((r["doc_id"], s) for r in mixing.mix(df).collect() for s in r["shards"])
    assert Counter((r["doc_id"], r["_shard"]) for r in rows) == decided
    orders = []
    for s in range(16):
        own = [r for r in rows if r["_shard"] == s]
        assert len({r["part"] for r in own}) <= -(-4 // 16) and len({r["source"] for r in own}) > 1  # together in a task
        ids = [r["doc_id"] for r in own]
        assert ids != sorted(ids) and ids != sorted(ids, reverse=True)
        orders.append(ids)
    assert [[r["doc_id"] for r in sorted(mixing.sharded(df.repartition(3)).select("_shard", "doc_id", F.monotonically_increasing_id().alias("at")).collect(), key=lambda r: r["at"]) if r["_shard"] == s] for s in range(16)] == orders


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    df = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 60}") for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert {r["doc_id"]: r["copies"] for r in rows} == plain_copies(rows) and len(rows) == 600


def test_mix_odd_tables(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c", None), (1, None, "s"), (1, None, "s"), (2, "d e", None), (3, "", "z"), (None, "a b c", None)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 6 and {r["source"]: r["source_size"] for r in rows} == {None: 8, "s": 0, "z": 0}
    assert all(r["target"] == 12.0 for r in rows if r["source"] is None)


# --- sharding


def test_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 65537):
        x = np.arange(n)
        p = sharding.permute(x, n)
        assert sorted(p) == list(range(n)) and (sharding.permute(p, n, back=True) == x).all()


def test_shards(spark):
    texts = ["", None, "é", *[f"t{i}" for i in range(40)], *["same"] * 20]
    ids = [None, None, *range(len(texts) - 12), *[3] * 10]
    df = docs(spark, texts, ids).withColumn("shard", F.lit("mine")).withColumn("row_number", F.lit(0))
    rows = sharding.shard_by_rows(df).collect()
    again = sharding.shard_by_rows(df.repartition(9)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
        assert int(sharding.permute(np.array([r["slot"] * 16 + r["shard"]]), len(rows), back=True)[0]) == r["row_number"]
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sharding.shard_by_rows(df.limit(0)).count() == 0


# --- language identification


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 1000
    held = [r for r in found if r["held_out"]]
    assert len(held) > 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.98 and all(0 <= r["score"] <= 1 for r in found)


def test_model_is_kneser_ney(spark):
    """Probabilities against plain interpolated Kneser-Ney."""
    texts = {"a": ["abab cab", "cab abc"], "b": ["bcd dcb", "bdb"]}
    names = sorted(texts)
    raw = {}
    for i, n in enumerate(names):
        for t in texts[n]:
            padded = "  " + t
            for order in (1, 2, 3):
                for k in range(2, len(padded)):
                    raw.setdefault((i, order, padded[k - order + 1 : k + 1]), 0)
                    raw[i, order, padded[k - order + 1 : k + 1]] += 1
    pack = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    columns = list(zip(*[(i, o, pack(g), c) for (i, o, g), c in raw.items()]))
    model = langid.estimate(names, np.array(columns[0]), np.array(columns[1]), np.array(columns[2], dtype=np.uint64), np.array(columns[3]))
    alphabet = {g for (_, o, g) in raw if o == 1}

    def p(i, g):
        k = len(g)
        if k == 0:
            return 1 / (len(alphabet) + 1)
        count = (lambda x: raw.get((i, 3, x), 0)) if k == 3 else (lambda x: len({h for (j, o, h), _ in raw.items() if j == i and o == k + 1 and h[1:] == x and cont(i, h)}))
        total = sum(count(x) for x in {h for (_, o, h) in raw if o == k} if x[:-1] == g[:-1])
        kinds = sum(count(x) > 0 for x in {h for (_, o, h) in raw if o == k} if x[:-1] == g[:-1])
        if not total:
            return p(i, g[1:])
        return max(count(g) - 0.75, 0) / total + 0.75 * kinds / total * p(i, g[1:])

    def cont(i, h):
        """Whether the next higher order's weight of h is positive."""
        return raw.get((i, 3, h), 0) > 0 if len(h) == 3 else any(j == i and o == 3 and x[1:] == h for (j, o, x) in raw)

    text = "ab dcz"
    entropy, length, has = model.entropies([text, "", "12", "b"])
    assert length.tolist()[:2] == [6, 0] and has.tolist() == [True, False, False, True]
    for i in range(2):
        padded = "  " + text
        expected = -sum(math.log(p(i, padded[k - 2 : k + 1])) for k in range(2, len(padded))) / 6
        assert abs(entropy[0, i] - expected) < 1e-4


def test_identify_odd_texts(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learnt(df)
    texts = ["", None, " 12 !", "x", "日本語テキスト", "a " * 5000, "\U0001d400\U00010400 "]
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, texts).withColumn("score", F.lit("mine")), model).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(len(texts))] == [True, True, True, False, False, False, False]
    assert all(got[i]["rejected"] and got[i]["score"] == 0 for i in range(3)) and got[4]["rejected"]
    through = langid.predicted(docs(spark, texts), model).collect()
    assert {r["doc_id"]: (r["_lang_pred"], r["_rejected"]) for r in through} == {i: (r["lang_pred"], r["rejected"]) for i, r in got.items()}
    assert langid.identify(df.limit(0), model).count() == 0
    nothing = langid.train(docs(spark, ["x"]).select("doc_id", F.lit(None).cast("string").alias("lang"), F.col("text").alias("t")))
    assert langid.identify(docs(spark, ["abc"]), nothing).first()["lang_pred"] == "und"
    assert langid.identify(df, model).where("rejected").count() == 0


def test_training_is_bounded_by_rows(spark):
    rows = [(1, "en", f"text number {i}") for i in range(900)] + [(2, "en", "the same row")] * 300 + [(i, "de", f"zeile {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, t string")
    found = langid.training(df, 50).collect()
    assert Counter(r["lang"] for r in found) == {"en": 50, "de": 40}
    assert sorted(r["r"] for r in found if r["lang"] == "en") == list(range(1, 51))
    assert len(langid.training(df, 5000).collect()) == 900 + 1 + 40
    assert sorted(map(tuple, langid.training(df.repartition(5), 50).collect())) == sorted(map(tuple, found))


def test_rejection_is_calibrated(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learnt(df)
    assert np.isfinite(model.limit).all() and (model.limit[:, 0] >= model.limit[:, -1]).all()  # short texts stray further
    held = [(r["lang"], r["text"]) for r in df.where(langid.fold() == 1).where("lang is not null").collect()]
    names, _, rejected = model.predict([t for _, t in held])
    assert not rejected.any() and sum(a == n for a, (n, _) in zip(names, held)) > 0.98 * len(held)
    rng = random.Random(8)
    noise = ["".join(rng.choice("qxzjkvwQXZ") for _ in range(n)) for n in (30, 100, 1000)]
    assert model.predict([*noise, "эта фраза написана не так", "これは日本語の文です" * 30])[2].all()


def test_many_languages(spark):
    rows = [(i, f"l{i % 600}", f"{'abcdefghij'[i % 10] * 3} {i}") for i in range(1200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, t string"))
    assert len(model.languages) == 600 and model.predict(["aaa"])[0][0] in {f"l{i}" for i in range(600)}


def test_prediction_does_not_depend_on_batches(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").limit(50)
    model = langid.learnt(df)
    texts = [r["text"] for r in df.collect()]
    whole = model.entropies(texts)[0]
    assert np.allclose(whole, np.concatenate([model.entropies([t])[0] for t in texts]), atol=1e-5)


@pytest.mark.parametrize("passages", [True, False])
def test_line_units_are_compared_by_their_bytes(spark, monkeypatch, passages):
    """Units of equal digest but other bytes are no copies of each other."""
    asked = []
    monkeypatch.setattr(linededup, "digest_of", lambda unit: asked.append(unit) or F.length(unit) % 7, raising=False)
    rng = random.Random(18)
    pool = [long_line(rng, rng.choice([1, 5, 70])) for _ in range(12)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, texts), passages=passages).collect()}
    assert asked and [got[i] for i in range(len(texts))] == plain_lines(texts, passages=passages)
