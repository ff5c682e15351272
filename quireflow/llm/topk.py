"""Exact top-k search by inner product with a three-phase uniform threshold.

A score is a sum of partial scores over groups of dimensions, so each group of each block of candidates is a local
list. Phase 1 gathers the best entries of every local list: the k-th best of the candidates' full scores among them is
a lower bound of the k-th best score of all. Only the lists' entries are completed; of the rest a block keeps each
list's greatest value. Phase 2 gives the cutoff to every block: queries for which a block's greatest values don't add up
to it skip the block. Elsewhere a candidate that reaches it must, in some group, lie within 1/m of the slack below that
group's greatest partial score, the same share for each of the m lists; only such entries are collected. Phase 3
completes the collected ones' scores exactly, drops what stays below the cutoff, and merges the best of all blocks.

Vectors are packed into blocks. Every block of queries meets every block of candidates once, by an equi-join on a
slice number: candidates are dealt to slices, queries go to each slice. Work is thus queries times candidates, in
blocks, but rows are few: k to a query and task. All joins are merge joins: Spark doesn't count the copies of a query for
each slice, so it would broadcast them, slices times what the driver was to hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quireflow.llm.common import cut, in_batches

#: Production parameters: results of a query, groups of dimensions, vectors in a block of candidates and of queries.
K, GROUPS, BLOCK, QUERIES = 5, 4, 4096, 512
#: Largest sum of magnitudes that doubles add up exactly; scores beyond are integers of any size, but cutoffs and
#: greatest values are doubles: they are given so much room.
EXACT, ROUNDED = 2.0**53, 1e-9


def packed(vectors: DataFrame, block: int) -> DataFrame:
    """(dim, n, ids, data) from rows (vec_id, v): blocks of up to `block` vectors of one length, as 64-bit ids and
    doubles floor(256 * x). Vectors that are null, empty or hold null or non-finite components take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, data = zip(*held.pop(dim))
            values = np.concatenate(data)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(values) // dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["dim", "n", "ids", "data"])

        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            size = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                rows = np.nonzero(size == dim)[0]
                for i in range(0, len(rows), block):
                    some = rows[i : i + block]
                    values = np.floor(256 * flat[start[some][:, None] + np.arange(dim)[None, :]])
                    held.setdefault(dim, []).append((ids[some], values.ravel()))
                    if sum(len(x[0]) for x in held[dim]) >= block:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return in_batches(vectors.where(ok & finite), run, "dim int, n int, ids binary, data binary")


class Best:
    """The k best entries of each query so far: by score, then by the smaller id."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Takes entries, each a pair of rows of its own."""
        if not len(query):
            return
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        for q, i, s in zip(query[keep].tolist(), ids[keep].tolist(), score[keep].tolist()):
            self.known.setdefault(q, []).append((-s, i))

    def trim(self) -> None:
        for q, found in self.known.items():
            self.known[q] = sorted(found)[: self.k]

    def batch(self) -> pa.RecordBatch | None:
        self.trim()
        rows = [(q, i, int(-s)) for q, found in self.known.items() for s, i in found]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query_id", "vec_id", "score"])


def _partials(q: np.ndarray, c: np.ndarray, groups: int) -> list[np.ndarray]:
    """Partial scores by group of dimensions, exact."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] >= EXACT:
        q, c = q.astype(object), c.astype(object)
        q, c = np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(c)
    edges = np.linspace(0, q.shape[1], min(groups, q.shape[1]) + 1).astype(int)
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(edges[:-1], edges[1:])]


def _read(batch: pa.RecordBatch, i: int, names: list[str]) -> list[np.ndarray]:
    kinds = {"qids": np.int64, "ids": np.int64, "qdata": np.float64, "data": np.float64, "cutoff": np.float64}
    return [np.frombuffer(batch.column(n)[i].as_buffer(), dtype=kinds[n]) for n in names]


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k greatest values."""
    k = min(k, values.shape[1])
    return np.argpartition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k :]


def local_lists(parts: list[np.ndarray], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of partial scores by group: rows and columns of the k greatest of each row in any group, the full scores of just
    these, and each row's greatest partial score by group (the query's own rows, marked in own, left out)."""
    top = np.stack([np.where(own, -np.inf, p).max(axis=1, initial=-np.inf) for p in parts], axis=1).astype(np.float64)
    places = []
    for p in parts:
        cols = _top(np.where(own, -np.inf, p), k)
        rows = np.repeat(np.arange(len(p)), cols.shape[1])
        places.append(rows * p.shape[1] + cols.ravel())
    rows, cols = np.divmod(np.unique(np.concatenate(places)), parts[0].shape[1])
    ok = ~own[rows, cols]
    rows, cols = rows[ok], cols[ok]
    return rows, cols, sum(p[rows, cols] for p in parts), top


def collected(parts: list[np.ndarray], own: np.ndarray, top: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the entries that may reach their row's cutoff: in some group within an equal share of the
    slack below its greatest partial score."""
    with np.errstate(invalid="ignore"):  # a row without candidates
        slack = (top.sum(axis=1) - cutoff) / len(parts)
        some = np.zeros(own.shape, dtype=bool)
        for p, t in zip(parts, top.T):
            some |= (p >= (t - slack - ROUNDED * np.abs(t))[:, None]).astype(bool)
    return np.nonzero(some & ~own)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, groups: int = GROUPS, block: int = BLOCK, query_block: int = QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k candidates of greatest integer inner product, all if there
    are fewer, ties to the smaller vec_id; a row is never the result of a query of its own vec_id.

    vectors and queries hold vec_id and embedding. Components become floor(256 * x). Rows without vec_id, and vectors
    that are null, empty or hold null or non-finite components, take no part, neither do candidates of another length
    than the query's. Rows that repeat a vec_id are candidates each; query rows of one vec_id are one query, whose
    candidates count once for each of them. No rows give no rows; other columns are not read.
    """
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    slices = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = packed(pick(vectors), block).withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    blocks = cut(blocks.repartition(slices, "slice").withColumn("block", F.monotonically_increasing_id()), "blocks")
    asked = packed(pick(queries).repartition(max(1, slices // 4)), query_block)
    asked = asked.select("dim", F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.monotonically_increasing_id().alias("asked"))
    asked = cut(asked, "queries")
    everywhere = lambda q: q.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def phase1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for i in range(batch.num_rows):
                qids, ids, q, c = _read(batch, i, ["qids", "ids", "qdata", "data"])
                parts = _partials(q.reshape(len(qids), -1), c.reshape(len(ids), -1), groups)
                rows, cols, score, top = local_lists(parts, qids[:, None] == ids[None, :], k)
                best.add(qids[rows], ids[cols], score)
                best.trim()
                row = [(None, None, None, *(batch.column(n)[i].as_py() for n in ("asked", "slice", "block")), top.tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*row), kinds)], names)
        if (out := best.batch()) is not None:
            more = [pa.nulls(out.num_rows, t) for t in kinds[3:]]
            yield pa.RecordBatch.from_arrays([*out.columns, *more], names)

    def phase23(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for i in range(batch.num_rows):
                qids, ids, q, c, cutoff = _read(batch, i, ["qids", "ids", "qdata", "data", "cutoff"])
                top = np.frombuffer(next(x["top"] for x in batch.column("tops")[i].as_py() if x["block"] == batch.column("block")[i].as_py()))
                top = top.reshape(len(qids), -1)
                live = top.sum(axis=1) >= cutoff
                if not live.any():
                    continue
                qids, cutoff, top = qids[live], cutoff[live], top[live]
                parts = _partials(q.reshape(len(live), -1)[live], c.reshape(len(ids), -1), groups)
                rows, cols = collected(parts, qids[:, None] == ids[None, :], top, cutoff)
                score = sum(p[rows, cols] for p in parts) if len(rows) else np.zeros(0)
                keep = score >= cutoff[rows]
                best.add(qids[rows[keep]], ids[cols[keep]], score[keep])
                best.trim()
        if (out := best.batch()) is not None:
            yield out

    def with_cutoffs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries again, from (dim, qids, qdata, asked, cuts): cutoffs in the order of the ids."""
        for batch in rows:
            for i in range(batch.num_rows):
                (qids,) = _read(batch, i, ["qids"])
                cuts = {x["q"]: x["c"] for x in batch.column("cuts")[i].as_py() or ()}
                cutoff = np.array([cuts.get(x, -np.inf) for x in qids.tolist()])
                cutoff = cutoff - ROUNDED * np.abs(cutoff)
                columns = [batch.column(n).slice(i, 1) for n in ("dim", "qids", "qdata", "asked")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([cutoff.tobytes()], pa.binary())], ["dim", "qids", "qdata", "asked", "cutoff"])

    names = ["query_id", "vec_id", "score", "asked", "slice", "block", "top"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    met = everywhere(asked).join(blocks.hint("merge"), ["slice", "dim"]).select("qids", "qdata", "ids", "data", "asked", "slice", "block")
    first = cut(in_batches(met, phase1, "query_id long, vec_id long, score long, asked long, slice int, block long, top binary"), "lists")
    score_rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    gathered = first.where("query_id is not null").select("query_id", "vec_id", "score")
    cutoffs = gathered.withColumn("r", score_rank).where(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("c"))
    # a query with fewer gathered than k has no cutoff: all of its candidates are completed

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (qids,) = _read(batch, i, ["qids"])
                qids = np.unique(qids)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("asked")[i].as_py()] * len(qids), pa.int64()), pa.array(qids)], ["asked", "query_id"])

    named = asked.select("asked", "qids").mapInArrow(unpack, "asked long, query_id long").join(cutoffs.hint("merge"), "query_id")
    by_block = named.groupBy("asked").agg(F.collect_list(F.struct(F.col("query_id").alias("q"), "c")).alias("cuts"))
    ready = asked.join(by_block.hint("merge"), "asked", "left").select("dim", "qids", "qdata", "asked", "cuts")
    ready = cut(ready.mapInArrow(with_cutoffs, "dim int, qids binary, qdata binary, asked long, cutoff binary"), "cutoffs")
    tops = first.where("top is not null").groupBy("asked", "slice").agg(F.collect_list(F.struct("block", "top")).alias("tops"))
    met = everywhere(ready).join(tops.hint("merge"), ["asked", "slice"]).join(blocks.hint("merge"), ["slice", "dim"])
    found = in_batches(met.select("qids", "qdata", "cutoff", "ids", "data", "tops", "block"), phase23, "query_id long, vec_id long, score long")
    return found.withColumn("rank", score_rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
