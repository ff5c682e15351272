"""Near copies by shingles' Jaccard similarity, with SimHash fingerprints and Golay keys as near_duplicates() has them.

Texts whose sets of shingles have a Jaccard similarity of 0.8 differ in some 15 of 100 bits of a fingerprint, far
beyond what keys of two segments of 64 bits reach. So

* a text has several fingerprints, made from its distinct shingles by several mixes of their hashes;
* each segment of each alone gives Golay indices (its own and its one-bit neighbours'). By the pigeonhole principle, of
  9 segments one has at most 2 errors, and its indices surely meet, if at most 26 bits of 192 differ; beyond that
  they meet with a chance that falls slowly, as indices at 3 or 4 errors often meet too;
* an index alone would bring together too many texts by chance, so that a key also holds the shingle of least hash, by
  several hashes. Texts share one with a chance of their similarity, others only if they share that shingle, and of
  those that share a frequent one the Golay index keeps apart all but some hundredths.

Texts that meet and whose fingerprints are near enough are candidates; the sets of shingles themselves decide. Equal
sets are one node from the start. A group of a few gives all its candidates, a larger one a spanning forest of them, in
an order that differs by key, so that a text which isn't similar to one pivot meets others.

Links that these keys miss are found by an exact completion. Sets of similarity s or more share one of the first
n - ceil(s * n) + 1 shingles of either, in any common order (prefix filter): texts of different groups that share one, and
whose sizes and parities of shingles allow the similarity, are compared too. The order takes shingles last that are common
in a sample; that changes speed, not results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quireflow.llm import golay, simhash
from quireflow.llm.common import cut, drop_table, free_shuffles, in_batches, map_arrow, utf8_of
from quireflow.llm.components import components

#: Production parameters: words in a shingle and least similarity.
WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of a text, and least shingles that its keys hold.
PRINTS, LEAST = 3, 3
#: Texts in a block of one key; groups up to FEW give all their candidates.
BLOCK, FEW = 4096, 8
#: Candidates are texts whose fingerprints differ by no more than the expected bits and so many standard deviations.
DEVIATIONS = 4
#: Texts whose keys go out at once.
AT_ONCE = 512
#: Completion: words of 64 parities of a text's shingles, rows in the sample of shingles, texts in which one is common,
#: and texts in a block.
PARITIES, SAMPLE, COMMON, PREFIX_BLOCK = 8, 2000, 3, 1024
#: Cells in which a text's shingles are counted before its set is sent to another's.
CELLS = 1024
F_NAMES, M_NAMES = [f"f{i}" for i in range(PRINTS)], [f"m{i}" for i in range(LEAST)]


def mix(x: np.ndarray, by: int) -> np.ndarray:
    """Unsigned 64-bit values, permuted and scattered (the finalizer of SplitMix64), another way for each `by`."""
    x = x + np.uint64((by + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *simhash.shingle_hashes(text, words)]))


def most_bits(similarity: float) -> int:
    """Most bits, of all fingerprints, in which candidates differ. Sets of similarity s have a cosine of at least
    2s / (1 + s), and a bit of theirs differs with the chance of their angle over pi."""
    p, n = acos(2 * similarity / (1 + similarity)) / pi, 64 * PRINTS
    return int(n * p + DEVIATIONS * sqrt(n * p * (1 - p)))


def common_shingles(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """The shingles of at least COMMON of some SAMPLE rows, sorted; they only order prefixes."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(every)) == 0).limit(2 * SAMPLE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in utf8_of(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    counts = map_arrow(some.select(F.col(text).cast("string").alias("t")), run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["h"] for r in counts.select("h").limit(100 * SAMPLE).collect()], dtype=np.int64).view(np.uint64))


def prefix(own: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n shingles: common ones last, else by a mix of their hashes."""
    if not len(own):
        return own
    n = len(own)
    # common is sorted: a search in it costs less than isin(), which would sort it for each text
    last = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own if len(common) else np.zeros(n, dtype=bool)
    order = np.lexsort((mix(own, PRINTS + LEAST), last))
    return own[order[: n - ceil(similarity * n - 1e-9) + 1]]


def parities(own: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITIES cells: whether it holds an odd number of the shingles. Sets differ in at least as
    many shingles as their parities in bits."""
    odd = np.bincount((own % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def sketches(docs: DataFrame, text: str, words: int, similarity: float = SIMILARITY, common: np.ndarray = np.zeros(0, dtype=np.uint64)) -> DataFrame:
    """(doc_id, digest, f0.., m0.., size, bits, prefix): digest and size of the set of shingles, fingerprints, least
    shingles, parities and prefix; m is null where there is no shingle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, prints, least, sizes, bits, firsts = [], [], [], [], [], []
        for t in utf8_of(batch.column(1)):
            own = shingle_set(t, words)
            digests.append(xxhash.xxh3_128_digest(own.tobytes()))
            prints.append([simhash.majority(mix(own[at : at + simhash.CHUNK], i) for at in range(0, len(own), simhash.CHUNK)) for i in range(PRINTS)])
            least.append([int(mix(own, PRINTS + i).min()) for i in range(LEAST)] if len(own) else [None] * LEAST)
            sizes.append(len(own))
            bits.append(parities(own).tobytes())
            firsts.append(prefix(own, similarity, common).view(np.int64))
        longs = [pa.array(c, pa.uint64()).view(pa.int64()) for c in (*zip(*prints), *zip(*least))]
        more = [pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), *longs, *more], ["doc_id", "digest", *F_NAMES, *M_NAMES, "size", "bits", "prefix"])

    schema = "doc_id long, digest binary, " + ", ".join(f"{c} long" for c in F_NAMES + M_NAMES) + ", size long, bits binary, prefix array<long>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), run, schema)


def keys_of(prints: list[np.ndarray], least: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the rows they belong to."""
    keys, rows, tag = [], [], PRINTS + LEAST
    for fp in prints:
        for at, bits in simhash.SEGMENTS:
            found, first = golay.neighbours((fp >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.uint32), range(bits))
            row, col = np.nonzero(first)
            index = found[row, col].astype(np.uint64)
            for m in least:
                tag += 1
                keys.append(mix(m[row] ^ mix(index, tag), tag))
                rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether rows of fingerprints differ in at most `most` bits."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= most


def met(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among the texts of one key, as positions: all among a few, else a spanning forest."""
    n = len(prints)
    if n <= FEW:
        a, b = np.triu_indices(n, 1)
        hit = near(prints[a], prints[b], most)
        return a[hit], b[hit]
    left, a, b = np.arange(n), [], []
    queue: list[int] = []
    while len(left):
        if queue:
            at = queue.pop()
        else:
            at, left = int(left[0]), left[1:]
        hit = near(prints[left], prints[at], most)
        a += [at] * int(hit.sum())
        b += left[hit].tolist()
        queue += left[hit].tolist()
        left = left[~hit]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def candidates(nodes: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """(u, v), u < v: nodes that share a key and are near by their fingerprints."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = [c.to_numpy(zero_copy_only=False) for c in batch.slice(at, AT_ONCE).columns]
                keys, rows = keys_of([c.view(np.uint64) for c in part[1 : 1 + PRINTS]], [c.view(np.uint64) for c in part[1 + PRINTS :]])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[0][rows]), pa.array(part[1][rows])], ["k", "node", "f0"])

    rows = in_batches(nodes.where("m0 is not null").select("node", *F_NAMES, *M_NAMES), emit, "k long, node long, f0 long")
    # keys of one text go no further; counting them moves keys only, and the other fingerprints follow the rest. f0 tells
    # texts of a repeated doc_id apart
    counts = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(rows.join(counts.hint("merge"), "k"), "similar-keys")
    dealt = shared.join(nodes.select("node", *F_NAMES), ["node", "f0"]).withColumn("of", F.ceil(F.col("n") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), "of").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    groups = dealt.groupBy("k", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.collect_list(F.struct("node", *F_NAMES)).alias("of")).where("size(of) > 1").select("k", "of")

    def meet(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        members, at = batch.column(1).flatten(), batch.column(1).offsets.to_numpy()
        at, order = at - at[0], batch.column(0).to_numpy()
        node = members.field(0).to_numpy()
        prints = np.stack([members.field(1 + i).to_numpy() for i in range(PRINTS)], axis=1).view(np.uint64)
        size = np.diff(at)
        two = at[:-1][size == 2]
        two = two[near(prints[two], prints[two + 1], most)]
        a, b = [node[two]], [node[two + 1]]
        for s, e, k in zip(at[:-1][size > 2], at[1:][size > 2], order[size > 2]):
            turn = s + np.argsort(mix(node[s:e].view(np.uint64), int(k & 3)), kind="stable")
            x, y = met(prints[turn], most)
            a.append(node[turn[x]])
            b.append(node[turn[y]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"]) if len(a) else None

    return map_arrow(groups, meet, "u long, v long").where("u <> v").distinct()


def histogram(own: np.ndarray) -> np.ndarray:
    """How many of the shingles each of CELLS cells holds, up to 255. Sets differ in at least as many shingles as the
    counts do, cell by cell; unlike parities, counts tell long texts apart."""
    return np.minimum(np.bincount((own % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8)


def may_be(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows of histograms allow the similarity of sets; sizes: both sets' sizes added."""
    apart = np.abs(a.astype(np.int16) - b).sum(axis=1, dtype=np.int64)
    return apart <= sizes * (1 - similarity) / (1 + similarity) + 1e-9


def similar(docs: DataFrame, pairs: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) of doc_ids whose sets of shingles have at least this Jaccard similarity.

    A pair takes its sets along, which are larger than the texts. So histograms go first: most pairs that share but a
    shingle end there."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in utf8_of(batch.column(1))]
        cells = [histogram(s).tobytes() for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(cells, pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["node", "s", "cells", "n"])

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, CELLS) for i in (2, 3))
        hit = pa.array(may_be(a, b, batch.column(4).to_numpy(), similarity))
        return pa.RecordBatch.from_arrays([batch.column(i).filter(hit) for i in range(2)], ["u", "v"])

    ids = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    # (distinct last: rows lie by node after the join, so that texts move once)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col(text).cast("string").alias("t")).join(ids, "node", "left_semi").distinct()
    sets = cut(map_arrow(texts, run, "node long, s array<long>, cells binary, n long"), "shingles")
    side = lambda n, *c: sets.select(F.col("node").alias(n), *(F.col(x).alias(f"{x}_{n}") for x in c))
    near_ = pairs.join(side("u", "cells", "n"), "u").join(side("v", "cells", "n"), "v").select("u", "v", "cells_u", "cells_v", (F.col("n_u") + F.col("n_v")).alias("n"))
    rest = cut(map_arrow(near_, told, "u long, v long").distinct(), "allowed")
    free_shuffles(docs.sparkSession)
    both = rest.join(side("u", "s"), "u").join(side("v", "s"), "v")
    shared = F.size(F.array_intersect("s_u", "s_v"))
    found = cut(both.where(shared >= F.lit(similarity) * (F.size("s_u") + F.size("s_v") - shared)).select("u", "v"), "links")
    drop_table(sets)
    drop_table(rest)
    free_shuffles(docs.sparkSession)
    return found


def allowed(size: np.ndarray, bits: np.ndarray, group: np.ndarray, at: int, similarity: float) -> np.ndarray:
    """Positions after `at` of texts of another group whose sizes and parities allow the similarity."""
    a, b = int(size[at]), size[at + 1 :]
    fits = (group[at + 1 :] != group[at]) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9)
    rest = np.nonzero(fits)[0] + at + 1
    apart = np.bitwise_count(bits[rest] ^ bits[at]).sum(axis=1, dtype=np.int64)
    return rest[apart <= (a + size[rest]) * (1 - similarity) / (1 + similarity) + 1e-9]


def missed(nodes: DataFrame, groups: DataFrame, similarity: float, block: int = PREFIX_BLOCK) -> DataFrame:
    """(u, v), u < v: nodes of different groups(id, component_id) that may be similar, a superset of those that are."""
    spread = cut(nodes.where("size > 0").select("id", "prefix").join(groups.hint("merge"), "id"), "prefixes")
    rows = spread.select(F.explode("prefix").alias("k"), "id", F.col("component_id").alias("g"))
    # a shingle within one group tells nothing
    between = rows.groupBy("k").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("k", "n")
    shared = cut(rows.join(between.hint("merge"), "k"), "prefix-keys")
    drop_table(spread)
    dealt = shared.join(nodes.select("id", "node", "size", "bits").hint("merge"), "id").withColumn("of", F.ceil(F.col("n") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("id"), "of").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    met_ = dealt.groupBy("k", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.collect_list(F.struct("node", "g", "size", "bits")).alias("of")).where("size(of) > 1").select("of")

    def meet(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        members, at = batch.column(0).flatten(), batch.column(0).offsets.to_numpy()
        at = at - at[0]
        node, group, size = (members.field(i).to_numpy() for i in range(3))
        bits = np.frombuffer(b"".join(members.field(3).to_pylist()), dtype="<u8").reshape(-1, PARITIES)
        a, b = [], []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            for i in range(e - s - 1):
                hit = allowed(size[s:e], bits[s:e], group[s:e], i, similarity)
                a.append(np.full(len(hit), node[s + i]))
                b.append(node[s + hit])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"]) if len(a) else None

    return map_arrow(met_, meet, "u long, v long").where("u <> v").distinct()


def near_copies(docs: DataFrame, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): component_id is the least doc_id that can be reached by links between texts whose sets
    of `words`-word shingles (a shorter text: all its words) have a Jaccard similarity of at least `similarity`.

    Keys of fingerprints give most links; what they miss between groups comes from prefixes of the sets, so that the
    groups are those of all links. Null, empty and blank texts have no shingle and are equal. The rows
    of one doc_id are linked. A row without doc_id gets a null component_id and links nothing. No rows give no rows;
    other columns of docs don't matter, whatever their names.
    """
    spark = docs.sparkSession
    own = cut(sketches(docs, text, words, similarity, common_shingles(docs, text, words)), "sketches")
    known = own.where("doc_id is not null")
    merged = known.groupBy("digest").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in [*F_NAMES, *M_NAMES, "size", "bits", "prefix"]))
    nodes = cut(merged.withColumn("id", F.monotonically_increasing_id()), "nodes")
    pairs = cut(candidates(nodes, most_bits(similarity)), "candidates")
    free_shuffles(spark)
    links = similar(docs, pairs, text, words, similarity)
    drop_table(pairs)
    # a doc_id with several rows joins their texts
    several = known.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other").select("doc_id")
    more = known.join(several, "doc_id", "left_semi").join(nodes.select("digest", "node"), "digest").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = components(links.unionByName(more), "u", "v")
    first = cut(nodes.join(found.hint("merge"), nodes["node"] == found["node"], "left").select("id", "digest", nodes["node"], F.coalesce(found["component"], nodes["node"]).alias("component_id")), "groups")
    rest = cut(missed(nodes, first.select("id", "component_id"), similarity), "missed")
    free_shuffles(spark)
    if rest.limit(1).count():
        joined = similar(docs, rest, text, words, similarity).unionByName(first.select(F.col("node").alias("u"), F.col("component_id").alias("v")))
        found = components(joined, "u", "v")
        first = first.join(found.hint("merge"), first["node"] == found["node"], "left").select("digest", F.coalesce(found["component"], first["node"]).alias("component_id"))
    free_shuffles(spark)
    return own.join(first.select("digest", "component_id").hint("merge"), "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near copies: of each component the rows of its least doc_id stay, so rows that repeat a doc_id stay
    or go together. Rows without doc_id stay. Columns as in docs."""
    found = near_copies(docs, text, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found["_gone"], "left_anti")
