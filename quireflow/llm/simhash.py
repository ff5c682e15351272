"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments of 22, 21 and 21 bits, each decoded to indices of the Golay code
(see golay.py). If two fingerprints differ in at most 4 bits, then by the pigeonhole principle

* either a segment has no error; of the other two, one has at most 2: the key is the segment and an index of the other;
* or every segment has an error; then two segments have exactly 1 (three errors in one would make 5): the key is a
  pair of indices. One fingerprint gives the neighbours' indices of the first segment with its own index of the
  second, the other the reverse, so either gives about 5 keys, not 28. One error flips a segment's parity and leaves
  one half of the segment as it is; both are part of the key, so that few keys meet by chance.

Keys are counted with map-side combining; only rows of keys that can link anything go on. Keys of many fingerprints
are cut into blocks, all pairs of which are compared. A group gives a spanning forest of its links, never all pairs.
Equal fingerprints are one node from the start, so copies cost nothing. Joins are merge joins: all sides grow with the
input, and what Spark takes for small by its files may be far larger at the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quireflow.llm import golay
from quireflow.llm.common import cut, in_batches, map_arrow, utf8_of
from quireflow.llm.components import components

#: Production parameters: words in a shingle, most differing bits, seed of the shingles' hash.
WORDS, ERRORS, SEED = 4, 4, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints in a block of one key, and fingerprints whose keys go out at once: each has some hundreds, and a batch
#: lies in the memory of Python and of the JVM.
BLOCK, AT_ONCE = 512, 512
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingle_hashes(text: bytes | None, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """The hashes of one UTF-8 text's shingles, repeats included, some at a time. Null, empty or blank: none."""
    if not text or not (parts := text.lower().split()):  # bytes: lower() is A-Z only, split() is at \x20 and \x09-\x0D
        return
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        spans = (starts[: 1 - words].tolist(), ends[words - 1 :].tolist())
    else:
        spans = ([0], [len(line)])
    hash_ = xxhash.xxh64_intdigest
    for at in range(0, len(spans[0]), CHUNK):
        yield np.array([hash_(line[s:e], seed) for s, e in zip(spans[0][at : at + CHUNK], spans[1][at : at + CHUNK])], dtype="<u8")


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes that come some at a time: a bit is 1 if set in over half of them. None: 0."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for some in hashes:
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(some)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one UTF-8 text. Null, empty or blank: 0."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): every row's fingerprint as a signed long. doc_id may be null or repeat."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((fingerprint(t, words, seed) for t in utf8_of(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), run, "doc_id long, fp long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sides (0: links with its like; 1 and 2: link with each other) and positions in fps (signed longs)."""
    fps = fps.view(np.uint64)
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.uint32) for at, bits in SEGMENTS]
    own = [golay.decode(p) for p in parts]
    near = [golay.neighbours(p, range(bits)) for p, (_, bits) in zip(parts, SEGMENTS)]
    apart = [golay.neighbours(p, range(bits), False) for p, (_, bits) in zip(parts, SEGMENTS)]
    odd = [np.bitwise_count(p).astype(np.int64) & 1 for p in parts]
    keys, sides, rows = [], [], []

    def give(tag: int, fixed: np.ndarray, some: tuple[np.ndarray, np.ndarray], side: int, shift: int) -> None:
        row, col = np.nonzero(some[1])
        keys.append(np.int64(tag) << np.int64(40) | fixed[row] | some[0][row, col] << np.int64(shift))
        sides.append(np.full(len(row), side, dtype=np.int8))
        rows.append(row)

    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                give(tag := tag + 1, parts[i].astype(np.int64) << np.int64(12), near[j], 0, 0)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        half = SEGMENTS[i][1] // 2
        for kept, free in ((parts[i] >> np.uint32(half), range(half)), (parts[i] & np.uint32((1 << half) - 1), range(half, SEGMENTS[i][1]))):
            tag, same = tag + 1, kept.astype(np.int64) << np.int64(26)
            give(tag, same | own[j] | odd[i] << np.int64(24) | odd[j] << np.int64(25), golay.neighbours(parts[i], free, False), 1, 12)
            give(tag, same | own[i] << np.int64(12) | (1 - odd[i]) << np.int64(24) | (1 - odd[j]) << np.int64(25), apart[j], 2, 0)
    return np.concatenate(keys), np.concatenate(sides), np.concatenate(rows)


def spanning(fps: np.ndarray, errors: int = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: a pivot takes all that it links with; those are
    then compared with what is left only."""
    fps = fps.view(np.uint64)
    left = np.ones(len(fps), dtype=bool)
    a, b = [], []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            rest = np.nonzero(left)[0]
            if not len(rest):
                break
            hit = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= errors]
            left[hit] = False
            a += [at] * len(hit)
            b += hit.tolist()
            queue += hit.tolist()
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def links(distinct: DataFrame, errors: int = ERRORS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column fp. They connect just what all pairs within `errors`
    (at most 4) bits would connect."""
    if errors > 4:
        raise ValueError("the keys cover at most 4 differing bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                fps = batch.column(0).slice(at, AT_ONCE).to_numpy(zero_copy_only=False)
                keys, sides, rows = keys_of(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sides), pa.array(fps[rows])], ["k", "side", "fp"])

    rows = in_batches(distinct.select("fp"), emit, "k long, side byte, fp long")
    n = F.count("*").alias("n")
    one = F.sum(F.expr("int(side = 1)"))
    counts = rows.groupBy("k").agg(n, one.alias("one")).where("n > 1 and (k >= (7L << 40) and one > 0 and one < n or k < (7L << 40))").drop("one")
    # hint: rows and counts are many times the table of nodes, whose files Spark takes for their size
    met = cut(rows.join(counts.hint("merge"), "k"), "simhash-keys")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = met.withColumn("of", blocks).withColumn("i", F.pmod(F.xxhash64("fp"), "of").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    groups = dealt.groupBy("k", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1").select("fps")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        column = batch.column(0)
        values, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        at = at - at[0]
        a, b = [], []
        size = np.diff(at)
        two = at[:-1][size == 2]
        hit = two[np.bitwise_count((values[two] ^ values[two + 1]).view(np.uint64)) <= errors]
        a.append(values[hit])
        b.append(values[hit + 1])
        for s, e in zip(at[:-1][size > 2], at[1:][size > 2]):
            x, y = spanning(values[s:e], errors)
            a.append(values[s:e][x])
            b.append(values[s:e][y])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

    return map_arrow(groups, verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", words: int = WORDS, errors: int = ERRORS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that can be reached by links.

    Null, empty and blank texts have fingerprint 0 and link like others. Rows of one doc_id each keep their
    fingerprint; the doc_id links them. A row without doc_id gets a null component_id and links nothing, as nothing
    names it. No rows give no rows; other columns of docs don't matter, whatever their names.
    """
    own = cut(fingerprints(docs, text, words, seed), "fingerprints")
    known = own.where("doc_id is not null")
    nodes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    pairs = links(nodes, errors)
    ends = pairs.join(nodes.select(F.col("fp").alias("a"), F.col("node").alias("u")).hint("merge"), "a").join(nodes.select(F.col("fp").alias("b"), F.col("node").alias("v")).hint("merge"), "b").select("u", "v")
    # a doc_id with several rows joins their fingerprints
    several = known.groupBy("doc_id").agg(F.min("fp").alias("one"), F.max("fp").alias("other")).where("one <> other").select("doc_id")
    more = known.join(several.hint("merge"), "doc_id", "left_semi").join(nodes.hint("merge"), "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = components(ends.unionByName(more), "u", "v")
    roots = nodes.join(found.hint("merge"), nodes["node"] == found["node"], "left").select("fp", F.coalesce(found["component"], nodes["node"]).alias("component_id"))
    return own.join(roots.hint("merge"), "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))

