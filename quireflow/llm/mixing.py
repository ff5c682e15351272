"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A row's block is the leading bits of its hash: a source's blocks come in permuted order from the start. A source's
target is some whole passes over its blocks and the first blocks of one more, whose number is its quota. The quotas of
all sources are split among the output shards by a binary tree: each node draws, without replacement, how many blocks
of every source go to its left half (a multivariate hypergeometric draw), down to single shards. Each shard then takes
the next blocks of every source, disjoint from all others', and shuffles the rows locally.

The last block of a quota is cut at a row: its rows' hashes are narrowed down by further bits, level by level, each by
one aggregation and a running sum over a source's bins, and up to FILLS rows that fill the gap best are added. The driver
sees a row to each source, which has a listed weight, and holds a row of the tree to each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from quireflow.llm.common import cut, words_of

#: Production parameters: weights by the sources' order, the share of all sizes, the most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Blocks to a source, levels of BLOCKS by which its cut is narrowed down, shards and seed of the mix.
BLOCKS, LEVELS, SHARDS, SEED = 1024, 3, 16, 20240501
#: Rows that may be added past a source's cut to fill what is left of its target.
FILLS = 3
#: A table of facts of so many sources is broadcast; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 20_000
BITS = BLOCKS.bit_length() - 1


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: float = PASSES) -> list[float]:
    """Target of each source: `share` of all sizes by weight (which repeat in order); none is above `passes` times its
    source's size, and what it can't take is shared by weight among the others."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    cap = passes * np.array(sizes, dtype=float)
    out, open_, left = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool), share * float(sum(sizes))
    while open_.any() and left > 0:
        want = left * w / w[open_].sum()
        full = open_ & (want >= cap)
        if not full.any():
            out[open_] = want[open_]
            break
        out[full] = cap[full]
        left -= cap[full].sum()
        open_ &= ~full
    return out.tolist()


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many blocks of each source (row) go to each shard (column). Shards of a node get equal totals, but for one."""
    if shards == 1:
        return quotas.reshape(-1, 1)
    left = shards // 2
    total = int(quotas.sum())
    share = total * left // shards
    drawn, rest, wanted = np.zeros_like(quotas), total, share
    for i, q in enumerate(quotas.tolist()):  # the joint draw, one conditional draw after another
        rest -= q
        drawn[i] = min(q, wanted) if not rest else rng.hypergeometric(q, rest, wanted) if q and wanted else 0
        wanted -= int(drawn[i])
    return np.hstack([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


@dataclass
class Source:
    """What the driver knows of a source: taken are rows whose hash is below `cut` in the pass after `full`."""

    name: str | None
    size: int
    rows: int
    target: float = 0.0
    full: int = 0
    left: float = 0.0
    cut: int = 0
    done: bool = False
    extra: list[tuple[int | None, int]] = field(default_factory=list)
    shards: list[int] = field(default_factory=list)


FACTS = "_source string, _size long, _target double, _full int, _left double, _cut long, _done boolean, _extra array<struct<id: bigint, h: bigint>>, _ends array<bigint>"


def with_facts(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """rows with what is known of their sources. The table has a row to each source: it is broadcast within the bound
    of BROADCAST_SOURCES, else joined as it is."""
    facts = [(s.name, s.size, float(s.target), s.full, float(s.left), s.cut, s.done, list(s.extra), s.shards) for s in sources]
    known = rows.sparkSession.createDataFrame(facts, FACTS)
    known = F.broadcast(known) if len(sources) <= BROADCAST_SOURCES else known
    return rows.join(known, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")


def plan(rows: DataFrame, weights=WEIGHTS, share=SHARE, passes=PASSES, shards=SHARDS, seed=SEED) -> list[Source]:
    """The sources of rows(source, size, h): targets, cuts and the blocks that each shard takes."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    sources = [Source(r["source"], int(r["size"]), int(r["rows"])) for r in found]
    sources.sort(key=lambda s: (s.name is None, (s.name or "").encode("utf-8")))
    for s, t in zip(sources, targets([s.size for s in sources], weights, share, passes)):
        s.target = t
        s.full = min(int(passes), int(t // s.size)) if s.size else 0
        s.left = t - s.full * s.size
        s.done = s.left <= 0
    for level in range(1, LEVELS + 1):
        going = [s for s in sources if not s.done]
        if not going:
            break
        shift = 63 - BITS * level
        inside = with_facts(rows, going).where(F.shiftright("h", shift + BITS) == F.shiftright("_cut", shift + BITS))
        bins = inside.groupBy("source", "_left", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bin")).alias("upto")
        sums = bins.select("source", "_left", "bin", upto, "size")
        # of each source the first bin that doesn't fit, with the words before it, else the last one with all words
        over = F.min(F.when(F.col("upto") > F.col("_left"), F.struct("bin", (F.col("upto") - F.col("size")).alias("before"))))
        ends = {r["source"]: r for r in sums.groupBy("source").agg(over.alias("over"), F.max(F.struct("bin", "upto")).alias("last")).collect()}
        for s in going:
            if not (r := ends.get(s.name)):  # no row in the block: all before it fits
                s.done = True
            elif r["over"]:
                s.cut, s.left = r["over"]["bin"] << shift, s.left - r["over"]["before"]
            else:
                s.cut, s.left, s.done = (r["last"]["bin"] + 1) << shift, s.left - r["last"]["upto"], True
    # the row past the cut that leaves the least gap, if it leaves a smaller one, and so on
    for _ in range(FILLS):
        going = [s for s in sources if s.full < passes and s.left > 0.5]
        if not going:
            break
        gap = F.abs(F.col("_left") - F.col("size"))
        past = with_facts(rows, going).where((F.col("h") >= F.col("_cut")) & (gap < F.col("_left")) & ~F.exists("_extra", lambda e: e["h"] == F.col("h")))
        best = {r["source"]: r["x"] for r in past.groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "h", "doc_id", "size")).alias("x")).collect()}
        if not best:
            break
        for s in going:
            if x := best.get(s.name):
                s.extra.append((x["doc_id"], x["h"]))
                s.left -= x["size"]
    shift = 63 - BITS
    quotas = np.array([s.full * BLOCKS + (s.cut + (1 << shift) - 1 >> shift) for s in sources], dtype=np.int64)
    split = split_tree(quotas, shards, np.random.default_rng(seed)) if sources else np.zeros((0, shards), dtype=np.int64)
    for s, q in zip(sources, np.cumsum(split, axis=1)):
        s.shards = q.tolist()
    return sources


def sized(docs: DataFrame, text: str, source: str, seed: int) -> DataFrame:
    """doc_id, source, size (words) and h, a hash of 63 bits of id and text."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text)).bitwiseAND(F.lit((1 << 63) - 1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words_of(text).alias("size"), h.alias("h"))


def decided(rows: DataFrame, sources: list[Source], shards: int = SHARDS) -> DataFrame:
    """rows with source_size, target, copies, taken and shards: the shard of each copy."""
    if not sources:
        return rows.select("*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"), F.array().cast("array<int>").alias("shards"))
    added = F.exists("_extra", lambda e: (e["h"] == F.col("h")) & e["id"].eqNullSafe(F.col("doc_id")))
    out = with_facts(rows, sources).withColumnsRenamed({"_size": "source_size", "_target": "target"})
    out = out.withColumn("copies", F.col("_full") + ((F.col("h") < F.col("_cut")) | added).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    block = F.shiftright("h", 63 - BITS)
    # a row that fills a gap may lie past the last block of the quota: it goes to the last shard
    at = lambda p: F.least(F.size(F.filter("_ends", lambda e: e <= p * BLOCKS + block)), F.lit(shards - 1)).cast("int")
    return out.withColumn("shards", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), at)).otherwise(F.array().cast("array<int>"))).drop("_full", "_left", "_cut", "_done", "_extra", "_ends")


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, h, source_size, target, copies, taken, shards) for each row of docs.

    size is the text's number of words, null counting as none. Sources are listed by code point, null last; a row
    without source belongs to the null source. copies is how often the mix takes the row, at most `passes` times, and
    taken the words that makes. Rows that repeat with equal id and text share their decisions; rows without id are
    told apart by their texts. A source without words has target 0 and gives whole passes of nothing. An empty table
    gives no rows. Every run decides alike. Other columns are not read.
    """
    rows = cut(sized(docs, text, source, seed), "sizes")
    return decided(rows, plan(rows, weights, share, passes, shards, seed), shards)


def _dealt(docs: DataFrame, text: str, source: str, **how) -> DataFrame:
    """(_shard, _row): a row for each time that the mix takes a row of docs. The rows of a shard lie together in ranges of a hash of row, pass and shard, sorted by it: each shard is shuffled by
    itself, and the passes over a source come in different orders. A range is a task's work: their number follows the
    session's shuffle partitions, so shards may be of any size."""
    seed, shards = how.get("seed", SEED), how.get("shards", SHARDS)
    rows = cut(sized(docs, text, source, seed), "sizes")
    sources = plan(rows, how.get("weights", WEIGHTS), how.get("share", SHARE), how.get("passes", PASSES), shards, seed)
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text)).bitwiseAND(F.lit((1 << 63) - 1))
    named = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.lit(0).cast("long").alias("size"), h.alias("h")
    )
    taken = decided(named, sources, shards).where("copies > 0").select("_row", "h", F.posexplode("shards").alias("_pass", "_shard"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = -(-parts // shards)
    dealt = taken.withColumn("_order", F.xxhash64(F.lit(seed + 1), "h", "_pass", "_shard")).withColumn("_range", F.pmod(F.shiftright("_order", 40), F.lit(ranges)))
    return dealt.repartition(parts, "_shard", "_range").sortWithinPartitions("_shard", "_range", "_order").select("_shard", "_row")


def sharded(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix laid out by shards: _shard and the columns of docs. Nulls, ties, empty tables: see mix()."""
    return _dealt(docs, text, source, **how).select("_shard", "_row.*")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: rows of docs, each as often as the mix takes it, in the columns of docs, laid out as sharded()
    does."""
    return _dealt(docs, text, source, **how).select("_row.*")
