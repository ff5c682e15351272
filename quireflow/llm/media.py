"""Media columns: texts as FLAC streams, and PCM blocks with seekable sample offsets out of FLAC streams."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quireflow.llm import flac
from quireflow.llm.common import in_batches, runs

#: Bytes to whose multiple a payload is padded, and whose CRC-32 is taken at its end.
PAD = 64
#: Bytes that are coded at a time.
AT_ONCE = 1 << 21


def padded(text: bytes | None) -> bytes:
    """The payload of a text: zeros bring it to a positive multiple of PAD."""
    text = text or b""
    return text + b"\0" * ((-len(text)) % PAD if text else PAD)


def feature(payload: bytes) -> str:
    """What the samples look like: their number, sum, energy, sign changes and peak, in integers."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    flips = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};flips={flips};peak={int(np.abs(x).max(initial=0))}"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    for batch in batches:
        for start, stop in runs(batch.column(1), AT_ONCE):
            yield batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start).to_pylist()


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each row's text as a FLAC stream; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            media = flac.encode([padded(t) for t in texts])
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t")), run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, column: str = "media") -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, byte_offset, pcm) of each frame of media(doc_id, media): unsigned
    8-bit samples, the frame's first sample and the place of its bytes in the stream. All checksums are checked; a
    stream that fails stops the job. A null stream gives no rows, one without samples neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, streams in _batches(batches):
            known = [(i, m) for i, m in zip(ids.to_pylist(), streams) if m is not None]
            rows = []
            for (i, _), (payload, s) in zip(known, flac.decode([m for _, m in known])):
                rows += [(i, b, first, n, at, payload[first : first + n]) for b, (first, n, at) in enumerate(zip(s.first, s.size, s.start))]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "block", "sample_offset", "n_samples", "byte_offset", "pcm"])

    return in_batches(media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("binary").alias("m")), run, "doc_id long, block int, sample_offset long, n_samples int, byte_offset long, pcm binary")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The text (null: empty) is padded, stored as a FLAC stream, read back from the stored bytes, and described from
    what was read. Equal texts give equal values. doc_id may be null or repeat; no rows give no rows; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            media = flac.encode([padded(t) for t in texts])
            rows = [(len(t or b""), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)) for t, m, (p, _) in zip(texts, media, flac.decode(media))]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t")), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
