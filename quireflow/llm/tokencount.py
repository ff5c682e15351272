"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

A bounded sample gives the frequent pre-tokens; their token counts are broadcast as a compact hash table of at most
TABLE entries. Each worker looks up the distinct chunks (runs without white space) of a batch, splits those that it
hasn't met into pre-tokens, and encodes only pre-tokens that neither the table nor its own bounded cache holds. Texts
beyond Latin-1, and those with control characters that libraries take for space or not, go through the library's own
normaliser and splitter first; what follows is the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from quireflow.llm import tokenfiles
from quireflow.llm.common import in_batches, runs

#: Entries of the broadcast table, longest pre-token in it (bytes), rows sampled for it in all; entries of a worker's cache.
TABLE, LONGEST, SAMPLE, CACHE = 50_000, 32, 2_000, 300_000
#: Production limit of tokens.
LIMIT = 2048
#: Control characters that some libraries take for white space.
ODD = regex.compile("[\x1c-\x1f\x85]")


def latin(text: str) -> bool:
    """Whether the text is within Latin-1, where all libraries agree on letters, digits and normal forms."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Counter_:
    """Counts tokens with one library tokenizer, one to a Python worker."""

    def __init__(self, file: str, table: dict[str, int]):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        #: Counts of chunks, and of pre-tokens in the letters of the vocabulary.
        self.table, self.cache, self.pieces = table, {}, {}
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.letters = byte_letters()

    def of_word(self, word: str) -> int:
        """Tokens of one pre-token."""
        n = self.table.get(word)
        if n is None:
            n = len(self.tok.model.tokenize("".join(self.letters[b] for b in word.encode())))
        return n

    def of_chunk(self, chunk: str) -> int:
        n = self.cache.get(chunk)
        if n is None:
            n = self.cache[chunk] = sum(map(self.of_word, self.split(chunk)))
        return n

    def hard(self, text: str) -> int:
        """Tokens of a text without special strings, split by the library."""
        words = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        count = 0
        for word, _ in words:
            n = self.pieces.get(word)
            if n is None:
                n = self.pieces[word] = len(self.tok.model.tokenize(word))
            count += n
        return count

    def count(self, texts: list[str]) -> list[int]:
        if len(self.cache) > CACHE or len(self.pieces) > CACHE:
            self.cache, self.pieces = {}, {}
        out, easy, at = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and "<|" in text:
                parts = self.special.split(text)
                out[i] = len(parts) - 1
            for part in parts:
                if latin(part) and not ODD.search(part):
                    easy.append(part.lower())
                    at.append(i)
                else:
                    out[i] += self.hard(part)
        if easy:
            split = pc.utf8_split_whitespace(pa.array(easy, pa.large_string()).cast(pa.string()))
            coded = split.flatten().dictionary_encode()
            table, known = self.table.get, self.of_chunk
            each = np.array([n if (n := table(c)) is not None else known(c) for c in coded.dictionary.to_pylist()] + [0], dtype=np.int64)
            total = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy()]))) if len(coded) else np.zeros(1, dtype=np.int64)
            ends = split.offsets.to_numpy() - split.offsets[0].as_py()
            for i, n in zip(at, (total[ends[1:]] - total[ends[:-1]]).tolist()):
                out[i] += n
        return out


_COUNTERS: dict[str, Counter_] = {}


def frequent(docs: DataFrame, text: str, file: str, table: int, sample: int) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens in a bounded sample: the first rows of each partition, `sample` of
    all or one a partition. They only save time: any table gives the same counts. A pre-token must be one chunk by
    itself, so that looking it up needs no splitting. Texts stay where they are; each partition gives its share of
    pre-tokens at most."""
    texts = docs.select(F.col(text).cast("string").alias("t"))
    parts = max(1, texts.rdd.getNumPartitions())
    rows, share = -(-sample // parts), max(20, 4 * table // parts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, left = Counter(), rows
        for batch in batches:
            for t in batch.column(0).slice(0, left).to_pylist():
                if t and latin(t):
                    own.update(t.lower().split())
            left -= min(left, batch.num_rows)
            if not left:
                break
        counter = Counter_(file, {})
        some = [(w, n, counter.of_word(w)) for w, n in own.most_common(share) if len(w.encode()) <= LONGEST and counter.split(w) == [w]]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), (pa.string(), pa.int64(), pa.int32()))], ["w", "times", "n"])

    found = in_batches(texts, tally, "w string, times long, n int").groupBy("w").agg(F.sum("times").alias("times"), F.first("n").alias("n"))
    return {r["w"]: r["n"] for r in found.orderBy(F.col("times").desc(), "w").limit(table).collect()}


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = "word_bpe_49k.json", folder: str | None = None, limit: int = LIMIT, table: int = TABLE, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are the library's without added begin or end, special strings inside texts counting as one token each. A
    null text counts as empty: 0 bytes, 0 tokens. doc_id may be null or repeat; no rows give no rows; other columns
    are not read.
    """
    file = tokenfiles.path(vocabulary, folder)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, file, table, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(file)
        if counter is None:
            counter = _COUNTERS[file] = Counter_(file, {})
        counter.table = shared.value
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = []
            for start, stop in runs(batch.column(1), 1 << 21):
                n += counter.count([t or "" for t in batch.column(1).slice(start, stop - start).to_pylist()])
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
