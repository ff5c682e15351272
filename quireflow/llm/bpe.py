"""Byte-level BPE encoding and decoding with DuckDB's recursive queries and ordered aggregation.

Each partition splits its texts into pre-tokens and encodes those that its worker hasn't met: a recursive query holds
one row per token position, joins neighbours with the merge table and contracts, in each step, every word's leftmost
pair of minimum rank, until no pair is left. Words that have no pair left drop out; the state is keyed by position, so
it never outgrows the words' bytes. Documents are decoded from their own ids: a join with the vocabulary and an
aggregation ordered by position.

Words of more than SHORT bytes take another step of the same kind: it contracts all disjoint occurrences of the word's
minimum-rank pair, from the left, where that is what one at a time would give. That is so unless a pair with the new
token ranks below it, which the merge table tells; then only the leftmost goes. Steps then follow the number of
different ranks in a word and not its length, so a pre-token may be of any length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quireflow.llm import tokenfiles
from quireflow.llm.common import held, in_batches, runs

#: Entries in each generation of a worker's cache, bytes of words that one recursive query takes (a longer word is
#: alone), DuckDB's memory.
CACHE, AT_ONCE, MEMORY = 120_000, 1 << 17, "100MB"
#: Longest pre-token (bytes) of which each step contracts one pair.
SHORT = 64
#: Bits of a token's position within its word.
PLACE = 40
HERE = (1 << PLACE) - 1

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_ok boolean"

#: k holds the word's number and, in its low bits, the token's position within it; id and next are the token and its
#: right neighbour (-1: none). A step finds each word's pair of minimum rank, leftmost first, drops its first token,
#: makes the second one the merged token and closes the gap. Positions past a word's end keep an older step.
ENCODE = f"""
WITH RECURSIVE tokens(k, id, next, step) USING KEY (k) AS (
    SELECT k, id, next, 0 FROM bytes
    UNION ALL
    (WITH best AS (
        SELECT t.k >> {PLACE} AS word, min((m.rank << {PLACE}) | (t.k & {HERE})) AS best
        FROM tokens t JOIN merges m ON m.pair = ((t.id << 32) | t.next) GROUP BY 1
    ), pick AS MATERIALIZED (SELECT word, (word << {PLACE}) | (best & {HERE}) AS place, best >> {PLACE} AS rank FROM best)
    SELECT CASE WHEN t.k > p.place THEN t.k - 1 ELSE t.k END, CASE WHEN t.k = p.place + 1 THEN p.rank ELSE t.id END,
           CASE WHEN t.k = p.place - 1 THEN p.rank ELSE t.next END, t.step + 1
    FROM tokens t JOIN pick p ON p.word = (t.k >> {PLACE}) WHERE t.k <> p.place)
)
SELECT k, id FROM tokens JOIN (SELECT k >> {PLACE} AS word, max(step) AS last FROM tokens GROUP BY 1) ON (k >> {PLACE}) = word AND step = last
ORDER BY k
"""
#: The step for long words: of a run of places where the minimum rank fits, every second pair from the left goes. Merged
#: away tokens stay as -1, so places don't move.
ENCODE_LONG = f"""
WITH RECURSIVE tokens(k, id) USING KEY (k) AS (
    SELECT k, id FROM bytes
    UNION ALL
    (WITH pairs AS (
        SELECT k, id, lead(k) OVER w AS next_k, lead(id) OVER w AS next FROM tokens WHERE id >= 0 WINDOW w AS (ORDER BY k)
    ), ranked AS MATERIALIZED (
        SELECT p.k, p.id, m.rank, m.alone
        FROM pairs p LEFT JOIN merges m ON m.pair = CASE WHEN p.next_k >> {PLACE} = p.k >> {PLACE} THEN (p.id << 32) | p.next ELSE -1 END
    ), best AS (
        SELECT k >> {PLACE} AS word, min((rank << {PLACE}) | (k & {HERE})) AS best FROM ranked WHERE rank IS NOT NULL GROUP BY 1
    ), fits AS (
        SELECT r.*, b.best, coalesce(r.rank = b.best >> {PLACE}, false) AS fits, row_number() OVER (ORDER BY k) AS nth
        FROM ranked r JOIN best b ON r.k >> {PLACE} = b.word
    ), placed AS (
        SELECT *, coalesce(max(CASE WHEN NOT fits THEN nth END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM fits
    ), gone AS (
        SELECT *, fits AND CASE WHEN alone THEN k & {HERE} = best & {HERE} ELSE (nth - before) % 2 = 1 END AS merged FROM placed
    )
    SELECT k, CASE WHEN lag(merged, 1, false) OVER (ORDER BY k) THEN -1 WHEN merged THEN rank ELSE id END FROM gone)
)
SELECT k, id FROM tokens WHERE id >= 0 ORDER BY k
"""
#: The bytes of each document's tokens, in order.
DECODE = "SELECT doc, list(plain ORDER BY place) AS plain FROM coded JOIN vocab USING (id) GROUP BY doc ORDER BY doc"

#: White space other than the single spaces and line ends between words.
ODD_SPACE = (
    "  ", "\n\n", " \n", "\n ", *"\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　",
    *map(chr, range(0x2000, 0x200B)),
)


def ranks_of(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Cache:
    """Two generations: what is looked up stays, what isn't goes when the younger one is full."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def turn(self) -> None:
        """Lets the elder generation go if the younger one is full."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Keys that are in neither generation; the others are in the younger one from now on."""
        young, old = self.young, self.old
        out = []
        for k in {k for k in keys if k not in young}:
            if (v := old.get(k)) is not None:
                young[k] = v
            else:
                out.append(k)
        return out


class Codec:
    """Encodes words by the recursive query and decodes ids by the ordered aggregation: a DuckDB connection to a worker.
    Caches hold ids as packed 32-bit integers."""

    def __init__(self, file: str, pattern: str):
        import duckdb
        import regex

        ranks = ranks_of(file)
        self.split = regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self.byte = np.array([ranks[bytes([b])] for b in range(256)])
        pair, rank = _merges(ranks)
        left, right = pair >> 32, pair & 0xFFFFFFFF
        # tokens that are part of a token of lower rank
        part = np.unique(np.concatenate([left[rank < left], right[rank < right]]))
        self._table("merges", pair=pa.array(pair), rank=pa.array(rank), alone=pa.array(np.isin(rank, part)))
        self._table("vocab", id=pa.array(list(ranks.values()), pa.int32()), plain=pa.array(list(ranks), pa.binary()))
        #: Each id in decimal, and a space.
        self.decimal = pa.array([f"{i} " for i in range(max(ranks.values()) + 1)], pa.binary())
        self.known_id = np.isin(np.arange(len(self.decimal)), list(ranks.values()))
        self.known = Cache(CACHE)

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("source", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM source")
        self.db.unregister("source")

    def learn(self, words: list[str]) -> None:
        """Encodes pre-tokens."""
        raw = [w.encode() for w in words]
        for query, some in ((ENCODE, [i for i, r in enumerate(raw) if len(r) <= SHORT]), (ENCODE_LONG, [i for i, r in enumerate(raw) if len(r) > SHORT])):
            start = 0
            while start < len(some):
                stop, size = start, 0
                while stop < len(some) and (stop == start or size + len(raw[some[stop]]) <= AT_ONCE):
                    size += len(raw[some[stop]])
                    stop += 1
                word, ids = self.merge([raw[i] for i in some[start:stop]], query)
                packed, at = ids.astype(np.int32).tobytes(), (4 * np.searchsorted(word, np.arange(stop - start + 1))).tolist()
                self.known.young.update((words[i], packed[a:b]) for i, a, b in zip(some[start:stop], at, at[1:]))
                start = stop

    def merge(self, raw: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words and their ids, in order, by the recursive query."""
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ids, ends = self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)], np.cumsum(length)
        k = np.repeat(np.arange(len(raw)), length) << PLACE | np.arange(len(ids)) - np.repeat(ends - length, length)
        after = np.append(ids[1:], -1)
        after[ends - 1] = -1
        self._table("bytes", k=pa.array(k), id=pa.array(ids), next=pa.array(after))
        found = self.db.sql(query).to_arrow_table()
        self.db.execute("DROP TABLE bytes")
        return found.column("k").to_numpy() >> PLACE, found.column("id").to_numpy()

    def pieces(self, texts: list[str]) -> pa.ListArray:
        """Each text as chunks: 0 and its start, then a line end or a space (left out) and what follows. Where single
        spaces and line ends part the words, the pattern never reaches across a chunk's start; other texts are given
        as single words, with 0 before each."""
        plain, odd = {}, {}
        for i, t in enumerate(texts):
            if any(x in t for x in ODD_SPACE) or t[:1] in " \n" or t[-1:] in " \n":
                odd[i] = [f"\0{w}" for w in self.split(t)]
            else:
                plain[i] = "\0" + t.replace("\n", " \n")
        parts = pc.split_pattern(pa.array(plain.values(), pa.string()), " ")
        if odd:
            parts = pa.concat_arrays([parts, pa.array(odd.values(), pa.list_(pa.string()))])
            parts = parts.take(pa.array(np.argsort(np.array([*plain, *odd]))))
        return parts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids start (and the last one's end)."""
        parts = self.pieces(texts)
        coded = parts.flatten().dictionary_encode()
        chunks = [c[1:] if c[:1] == "\0" else c if c[:1] == "\n" else f" {c}" for c in coded.dictionary.to_numpy(zero_copy_only=False)]
        known, words, mixed = self.known, [], {}
        known.turn()
        for c in known.missing(chunks):
            if (c[1:] if c[:1] == " " else c).isalpha() and c.isascii():  # one pre-token by itself
                words.append(c)
            else:
                mixed[c] = self.split(c)
        words += known.missing(w for some in mixed.values() for w in some if w not in mixed or len(some) == 1)
        self.learn(words)
        young = known.young
        for c, some in mixed.items():
            if len(some) != 1:
                young[c] = b"".join([young[w] for w in some])
        packed = pa.array([young[c] for c in chunks], pa.binary()).take(coded.indices)
        if not len(packed):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int32)
        at = np.frombuffer(packed.buffers()[1], dtype=np.int32)[: len(packed) + 1]
        ids = np.frombuffer(packed.buffers()[2] or b"", dtype=np.int32)[: at[-1] // 4]
        return ids, at[parts.offsets.to_numpy() - parts.offsets[0].as_py()] // 4

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[memoryview]:
        """The bytes of each text's ids."""
        size = np.diff(starts)
        self.db.register("coded", pa.table({"doc": np.repeat(np.arange(len(size)), size), "place": np.arange(len(ids)), "id": ids}))
        found = self.db.sql(DECODE).to_arrow_table().combine_chunks()
        self.db.unregister("coded")
        out: list[memoryview] = [memoryview(b"")] * len(size)
        for part in found.to_batches():
            lists = part.column("plain")
            plain = lists.flatten()
            at = np.frombuffer(plain.buffers()[1], dtype=np.int32 if plain.type == pa.binary() else np.int64)[plain.offset : plain.offset + len(plain) + 1]
            data, edges = memoryview(plain.buffers()[2] or b"").cast("B"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for doc, a, b in zip(part.column("doc").to_pylist(), at[edges[:-1]].tolist(), at[edges[1:]].tolist()):
                out[doc] = data[a:b]
        return out

    def decimal_of(self, ids: np.ndarray, starts: np.ndarray) -> list[memoryview]:
        """Each text's ids in decimal, joined by a space."""
        shown = self.decimal.take(pa.array(ids))
        if not len(shown):
            return [memoryview(b"")] * (len(starts) - 1)
        at, data = np.frombuffer(shown.buffers()[1], dtype=np.int32)[: len(ids) + 1], memoryview(shown.buffers()[2]).cast("B")
        return [data[a : max(a, b - 1)] for a, b in zip(at[starts[:-1]].tolist(), at[starts[1:]].tolist())]


def _merges(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens (ids packed into one integer) that make a token, and its rank."""
    pairs = np.fromiter(
        (x for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None for x in (a << 32 | b, r)),
        dtype=np.int64,
    )
    return pairs[::2].copy(), pairs[1::2].copy()


def codec(file: str, pattern: str) -> Codec:
    """One codec to a Python worker: what it has learnt serves the tasks to come."""
    return held(("bpe", file, pattern), lambda: Codec(file, pattern))


def encode(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    folder: str | None = None,
    ids: bool = False,
    at_once: int = 1 << 21,
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the bytes
    that the row's ids decode to), decoded_ok (these are the text's bytes); with ids also ids_text, the ids themselves.

    A null text counts as empty: no tokens. doc_id may be null or repeat, each row gives a row. Equal texts give
    equal values. Other columns are not read. at_once: bytes of text that are put together at a time.
    """
    file, pattern = tokenfiles.path(vocabulary, folder), tokenfiles.pattern()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_ok", "ids_text"][: 5 + ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(file, pattern)
        for batch in batches:
            for start, stop in runs(batch.column(1), at_once):
                texts = [t or "" for t in batch.column(1).slice(start, stop - start).to_pylist()]
                coded, starts = coder.encode(texts)
                shown, plain = coder.decimal_of(coded, starts), coder.decode(coded, starts)
                columns = [
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in shown], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string()),
                    pa.array([x == t.encode() for x, t in zip(plain, texts)], pa.bool_()),
                ]
                if ids:
                    columns.append(pa.array([str(x, "ascii") for x in shown], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *columns], names)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return in_batches(chosen, run, SCHEMA + ", ids_text string" * ids, "bpe")


def decode(
    coded: DataFrame, ids: str = "ids_text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None, at_once: int = 1 << 21
) -> DataFrame:
    """(doc_id, decoded) per row of coded(doc_id, ids): the bytes that its decimal ids, joined by a space, stand for.
    Null ids decode to null, no ids to no bytes; an id that the vocabulary lacks fails the job. doc_id may be null or
    repeat; no rows give no rows."""
    file, pattern = tokenfiles.path(vocabulary, folder), tokenfiles.pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(file, pattern)
        for batch in batches:
            for start, stop in runs(batch.column(1), at_once):
                rows = batch.column(1).slice(start, stop - start).to_pylist()
                parts = [np.array((r or "").split(), dtype=np.int32) for r in rows]
                starts = np.cumsum([0, *map(len, parts)])
                some = np.concatenate(parts)
                if not coder.known_id[np.clip(some, 0, len(coder.known_id) - 1)].all() or len(some) and (some.min() < 0 or some.max() >= len(coder.known_id)):
                    raise ValueError("an id is not in the vocabulary")
                out = [None if r is None else bytes(x) for r, x in zip(rows, coder.decode(some, starts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    chosen = coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).cast("string").alias("ids"))
    return in_batches(chosen, run, "doc_id long, decoded binary", "bpe")
