"""Sharding by a Feistel permutation of global row numbers.

Rows get global numbers 0..n-1 in the order of their ids. A keyed Feistel network permutes the numbers of the least
even-width binary domain that holds n; walking its cycle until a number below n comes makes it a permutation of
0..n-1. Position p belongs to shard p mod k, slot p div k: counts differ by one at most, slots have no gaps, and both
directions (row to place, place to row) are computed without any table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quireflow.llm.common import cut

#: Production parameters: shards, seed and rounds of the network.
SHARDS, SEED, ROUNDS = 16, 20240501, 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """The finaliser of splitmix64: a round function."""
    x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int, rounds: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(1, 2**63, rounds)]


def permute(numbers: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS, back: bool = False) -> np.ndarray:
    """The place of each of the row numbers 0..n-1 among n; with back, the row number at each place."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _keys(seed, rounds)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        if back:
            for k in reversed(keys):
                left, right = right ^ (_mixed(left, k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mixed(right, k) & mask)
        return left << half | right

    with np.errstate(over="ignore"):
        out = once(numbers.astype(np.uint64))
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """rows with global numbers from 0 in ascending order (nulls first), and how many there are, without a single-task sort: ranges are sorted
    apart, and each range's start is added. The driver sees a count for each range."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = cut(sorted_.withColumn("_range", F.shiftright("_at", 33).cast("long")).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "numbered")
    counts = kept.groupBy("_range").count().collect()
    start, total = [], 0
    for r in sorted(counts, key=lambda r: r["_range"]):
        start.append((r["_range"], total))
        total += r["count"]
    # a row to each range: as many as the session has shuffle partitions, in their own table and not in the plan
    first = F.broadcast(rows.sparkSession.createDataFrame(start, "_range long, _first long"))
    return kept.join(first, "_range").withColumn(name, F.col("_first") + F.col("_at")).drop("_at", "_range", "_first"), total


def shard_by_rows(docs: DataFrame, text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, row_number, shard, slot, grown_shard), a row to each row of docs.

    size is the text's UTF-8 bytes plus 1, null counting as no bytes; its crc32 is that of no bytes, 0. Rows are
    numbered by doc_id (nulls first), then by the text's digest: repeated rows differ in their places only, so every
    run gives the same rows. An empty table gives no rows. Other columns are not read. grown_shard is null: a further
    shard deals all rows anew under this law.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("_digest"), F.expr("rand(7)").alias("_tie"))
    rows, n = numbered(cut(small, "sizes"), ["doc_id", "size", "text_crc32", "_digest", "_tie"])

    def place(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in numbers:
            yield pd.Series(permute(x.to_numpy(), n, seed))

    placed = rows.withColumn("_place", F.pandas_udf(place, "long")("row_number"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"), F.expr(f"_place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
