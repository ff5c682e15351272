"""Language identification by interpolated Kneser-Ney character language models.

Labelled texts give n-gram counts of each language (orders 1 to ORDER), counted in parallel and summed with map-side
combining. Every n-gram that any language has seen becomes an entry of a sorted hash array with its log-probability
under each language; contexts have their back-off weights in an array alike. A text's cross-entropy under a language
is the mean over its characters; the lowest one wins. How unlike its training texts a text may be before it is
rejected is calibrated by quantiles, in bands of length, on labelled texts that took no part in the counts.

Training reads at most SAMPLE rows of each language: chosen by the hash of id and text, the same ones in any run. The
model's size is that of the sample's n-grams times its languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quireflow.llm.common import cut, in_batches, release, runs

#: Production parameters: longest n-gram, rows of each language to learn from and to calibrate on, absolute discount.
ORDER, SAMPLE, CALIBRATION, DISCOUNT = 3, 1500, 300, 0.75
#: Ranges of hashes by which training rows are chosen.
BUCKETS = 4096
#: Bands of length (characters) in which rejection is calibrated: each from its value on, the first from 0.
BANDS = (5, 10, 20, 40, 80, 160, 320, 1280)
#: A text is rejected whose cross-entropy (nats a character) is above its band's quantile QUANTILE of held-out texts by
#: more than SPREAD times the quantile's distance from the median, and by more than MARGIN: a document with some odd
#: passages stays. A band of fewer than ENOUGH texts borrows from the next shorter one.
QUANTILE, SPREAD, MARGIN, ENOUGH = 0.99, 2.0, 2.0, 5
#: Rows up to which the chosen ids are broadcast.
BROADCAST_ROWS = 1_000_000
UNKNOWN = "und"
#: Bits of a character in a packed n-gram.
CHAR = 21


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)


_LETTERS: np.ndarray | None = None


def letters_of(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    out = _LETTERS[np.minimum(codes, 0xFFFF)]
    for i in np.nonzero(codes > 0xFFFF)[0]:
        out[i] = chr(codes[i]).isalpha()
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowered code points of all texts with blanks for runs of other characters, ORDER - 1 blanks before each text;
    the start of each text's own symbols with the end of all at last; and which texts hold a letter."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" " * (ORDER - 1)).join(["", *lowered]).encode("utf-32-le", "surrogatepass"), dtype="<u4") if texts else np.zeros(0, dtype=np.uint32)
    size = np.array([len(t) for t in lowered], dtype=np.int64)
    starts = np.cumsum(size + ORDER - 1) - size
    letter = letters_of(codes)
    codes = np.where(letter, codes, np.uint32(32))
    own = np.ones(len(codes), dtype=bool)
    pads = (starts[:, None] - np.arange(1, ORDER)[None, :]).ravel()
    own[pads] = False
    # of a run of blanks within a text the first stays; blanks right after the pads go
    keep = letter | ~own
    keep[1:] |= own[1:] & letter[:-1]
    count = np.concatenate(([0], np.cumsum(keep)))
    edges = np.append(starts, len(codes))
    known = np.concatenate(([0], np.cumsum(letter)))
    has = known[np.minimum(starts + size, len(codes))] > known[starts]
    return codes[keep], count[edges], has


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The packed n-gram that ends at each position from order - 1 on."""
    out = np.zeros(max(0, len(codes) - order + 1), dtype=np.uint64)
    for k in range(order):
        out = out << np.uint64(CHAR) | codes[k : len(codes) - order + 1 + k].astype(np.uint64)
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of wanted in the sorted array, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def band_of(length: np.ndarray) -> np.ndarray:
    """The band of each length."""
    return np.maximum(np.searchsorted(BANDS, length, side="right") - 1, 0)


@dataclass
class Model:
    """Sorted hash arrays of one order each. prob[n]: log-probability of the n-gram's last character (row) under each
    language (column), for n-grams that any language saw; back[n]: log back-off weight of contexts of n characters."""

    languages: list[str]
    grams: list[np.ndarray]
    prob: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray
    limit: np.ndarray

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropies (text by language), scored characters, and which texts hold a letter."""
        codes, edges, has = symbols(texts)
        total = np.zeros((len(texts), len(self.languages)))
        stops = np.append(edges[1:-1] - (ORDER - 1), edges[-1:]) if len(texts) else edges[:0]  # without the next text's pads
        step = max(1 << 12, (1 << 20) // max(4, len(self.languages)))
        for start in range(ORDER - 1, len(codes), step):
            at = np.arange(start, min(start + step, len(codes)))
            of = np.searchsorted(edges[:-1], at, side="right") - 1
            at, of = at[at < stops[of]], of[at < stops[of]]
            if len(at):
                score, first = self.scores(codes[at[0] - ORDER + 1 : at[-1] + 1], at - at[0] + ORDER - 1), of[0]
                for i in range(total.shape[1]):
                    add = np.bincount(of - first, weights=score[:, i])
                    total[first : first + len(add), i] -= add
        length = stops - edges[:-1]
        return total / np.maximum(length, 1)[:, None], length, has

    def scores(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probabilities of the characters at the given places under each language."""
        out = np.zeros((len(at), len(self.languages)), dtype=np.float32)
        todo = np.arange(len(at))
        sofar = np.zeros((len(at), len(self.languages)), dtype=np.float32)
        for order in range(ORDER, 0, -1):
            place, there = find(self.grams[order], grams(codes, order)[at[todo] - order + 1])
            out[todo[there]] = sofar[there] + self.prob[order][place[there]]
            todo, sofar = todo[~there], sofar[~there]
            if not len(todo):
                return out
            if order > 1:
                place, there = find(self.contexts[order - 1], grams(codes, order - 1)[at[todo] - order + 1])
                sofar[there] += self.back[order - 1][place[there]]
        out[todo] = sofar + self.floor
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages (UNKNOWN for texts without a letter), scores in 0..1, and which texts are rejected."""
        entropy, length, has = self.entropies(texts)
        if not len(texts):
            return [], np.zeros(0), np.zeros(0, dtype=bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        # the languages' shares at the evidence of at most 20 characters: more would round every score to 1
        weight = np.minimum(length, 20)[:, None]
        share = 1 / np.exp((least[:, None] - entropy) * weight).sum(axis=1)
        rejected = ~has | (least > self.limit[best, band_of(length)])
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
        return names, np.where(has, share, 0.0), rejected


def tallies(rows: DataFrame) -> DataFrame:
    """(lang, n, gram, count): n-gram counts of rows(lang, t), summed within each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for start, stop in runs(batch.column(1), 1 << 21):
                texts, own = batch.column(1).slice(start, stop - start).to_pylist(), names[start:stop]
                for lang in sorted(set(own)):
                    codes, edges, _ = symbols([t for t, n in zip(texts, own) if n == lang])
                    pads = np.zeros(len(codes), dtype=bool)
                    for k in range(1, ORDER):
                        pads[edges[:-1] - k] = True
                    for n in range(1, ORDER + 1):
                        some, count = np.unique(grams(codes, n)[~pads[n - 1 :]], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), n, dtype=np.int32)), pa.array(some.view(np.int64)), pa.array(count.astype(np.int64))], ["lang", "n", "gram", "count"])

    return in_batches(rows.select("lang", "t"), run, "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


def estimate(languages: list[str], lang: np.ndarray, n: np.ndarray, gram: np.ndarray, count: np.ndarray, discount: float = DISCOUNT) -> Model:
    """Interpolated Kneser-Ney: the highest order from counts, lower orders from the number of different characters
    that precede an n-gram, each order interpolated with the next lower one, the lowest with a uniform distribution."""
    size = len(languages)
    last = lambda grams_, k: grams_ & np.uint64((1 << CHAR * k) - 1)
    keys: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * (ORDER + 1)
    weight: list[np.ndarray] = [np.zeros((0, size))] * (ORDER + 1)
    for k in range(ORDER, 0, -1):
        of = n == k
        keys[k] = np.unique(gram[of])
        weight[k] = np.zeros((len(keys[k]), size))
        if k == ORDER:
            np.add.at(weight[k], (np.searchsorted(keys[k], gram[of]), lang[of]), count[of])
        else:
            np.add.at(weight[k], np.searchsorted(keys[k], last(keys[k + 1], k)), weight[k + 1] > 0)
    uniform = 1 / (len(keys[1]) + 1.0)
    p: list[np.ndarray] = [np.full((1, size), uniform)]
    contexts, gammas = [], []
    for k in range(1, ORDER + 1):
        context, at = np.unique(keys[k] >> np.uint64(CHAR), return_inverse=True)
        total, kinds = np.zeros((len(context), size)), np.zeros((len(context), size))
        np.add.at(total, at, weight[k])
        np.add.at(kinds, at, weight[k] > 0)
        seen = total > 0
        gamma = np.where(seen, discount * kinds / np.where(seen, total, 1), 1.0)
        lower = p[0] if k == 1 else p[k - 1][np.searchsorted(keys[k - 1], last(keys[k], k - 1))]
        p.append(np.maximum(weight[k] - discount, 0) / np.where(seen, total, 1)[at] + gamma[at] * lower)
        contexts.append(context)
        gammas.append(np.log(gamma).astype(np.float32))
    floor = np.full(size, np.log(uniform)) + (gammas[0][0] if len(gammas[0]) else 0)
    return Model(languages, keys, [np.log(x).astype(np.float32) for x in p], contexts, gammas, floor.astype(np.float32), np.full((size, len(BANDS)), np.inf))


def chosen(labelled: DataFrame, rows: int) -> DataFrame:
    """(lang, doc_id, th, r): of each language the `rows` pairs of id and text (by its hash) with the least hashes, ranked
    from 1; all if there are fewer.

    Hashes are cut into BUCKETS ranges and counted with map-side combining. Only pairs of the first ranges that hold
    enough are ranked, so no task meets a frequent language's every row. Repeated rows count once.
    """
    ids = labelled.select("lang", "doc_id", "th", F.xxhash64(F.lit(7), "doc_id", "th").alias("h")).withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    counts = ids.groupBy("lang", "b").agg(F.approx_count_distinct("h", 0.1).alias("n"))
    before = Window.partitionBy("lang").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # counts are right within some hundredths in sum: half as many again are ranked
    enough = counts.withColumn("sofar", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("sofar") < rows + rows // 2).select("lang", "b")
    few = ids.join(enough, ["lang", "b"]).distinct()
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("b", "h", "doc_id", "th")))
    return ranked.where(F.col("r") <= rows).select("lang", "doc_id", "th", "r")


def training(labelled: DataFrame, rows: int) -> DataFrame:
    """(lang, r, t): at most `rows` rows of each language of labelled(doc_id, lang, t), those that chosen() names."""
    labelled = labelled.where("lang is not null and doc_id is not null and t is not null").withColumn("th", F.xxhash64("t"))
    languages = labelled.select("lang").distinct().count()
    picked = chosen(labelled, rows)
    picked = F.broadcast(picked) if rows * languages <= BROADCAST_ROWS else picked
    return labelled.join(picked, ["lang", "doc_id", "th"]).dropDuplicates(["lang", "doc_id", "th"]).select("lang", "r", "t")


def train(labelled: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """A model of labelled(doc_id, lang, t), from at most `sample` rows of each language, calibrated on up to
    `calibration` further ones. Rows without id, label or text teach nothing, repeated ones once. Without rows the model
    knows nothing."""
    rows = cut(training(labelled, sample + calibration), "training")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    # every fifth row calibrates, up to the number asked for
    held = (F.col("r") % 5 == 0) & (F.col("r") <= 5 * calibration)
    found = tallies(rows.where(~held)).toArrow()
    code = {name: i for i, name in enumerate(names)}
    lang = np.array([code[x] for x in found.column("lang").to_pylist()], dtype=np.int64)
    model = estimate(names, lang, found.column("n").to_numpy(), found.column("gram").to_numpy().view(np.uint64), found.column("count").to_numpy())
    if names:
        calibrate(model, rows.where(held))
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Sets the greatest entropy by language and band of length. Each text of rows(lang, t) is scored whole and by its
    beginnings of each band's length. A language with too few texts to calibrate on takes the others' greatest limits; if
    no language has enough, nothing is rejected but texts without a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in runs(batch.column(1), 1 << 20):
                names, texts = (batch.column(i).slice(start, stop - start).to_pylist() for i in range(2))
                pairs = [(model.languages.index(n), t[:size]) for n, t in zip(names, texts) for size in (*(b for b in BANDS if b < len(t)), None)]
                own, some = np.array([p[0] for p in pairs]), [p[1] for p in pairs]
                entropy, length, has = model.entropies(some)
                columns = [pa.array(own, pa.int32()), pa.array(band_of(length), pa.int32()), pa.array(entropy[np.arange(len(own)), own]), pa.array(has)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "band", "e", "has"])

    scored = in_batches(rows.select("lang", "t"), run, "lang int, band int, e double, has boolean").where("has")
    known = {}
    for r in scored.groupBy("lang", "band").agg(F.percentile("e", F.lit(QUANTILE)).alias("q"), F.percentile("e", F.lit(0.5)).alias("m"), F.count("*").alias("n")).collect():
        if r["n"] >= ENOUGH:
            known[r["lang"], r["band"]] = r["q"] + max(SPREAD * (r["q"] - r["m"]), MARGIN)
    for i in range(len(model.languages)):
        bands = [b for b in range(len(BANDS)) if (i, b) in known]
        for b in range(len(BANDS)):
            if bands:
                model.limit[i, b] = known[i, max((x for x in bands if x <= b), default=bands[0])]
    few = np.isinf(model.limit).all(axis=1)
    if known:
        model.limit[few] = model.limit[~few].max(axis=0)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row of docs. A null text, or one without a letter, is UNKNOWN, scores 0
    and is rejected. Other texts get a learnt language even if rejected, which only texts far from every language are.
    doc_id may be null or repeat; no rows give no rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in runs(batch.column(1), 1 << 20):
                names, score, rejected = shared.value.predict([t or "" for t in batch.column(1).slice(start, stop - start).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), run, "doc_id long, lang_pred string, score double, rejected boolean")


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with _lang_pred, _score and _rejected, in one pass without a join: rows go through as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            column, out = pa.array([t if isinstance(t, str) else None for t in texts], pa.string()), []
            for start, stop in runs(column, 1 << 20):
                names, score, rejected = shared.value.predict([t or "" for t in column.slice(start, stop - start).to_pylist()])
                out.append(pd.DataFrame({"lang_pred": names, "score": score, "rejected": rejected}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})
        release()

    found = F.pandas_udf(of, "lang_pred string, score double, rejected boolean")(F.col(text).cast("string"))
    return docs.withColumn("_found", found).select(*docs.columns, F.col("_found.lang_pred").alias("_lang_pred"), F.col("_found.score").alias("_score"), F.col("_found.rejected").alias("_rejected"))


def fold() -> Column:
    """crc32 of the id as text, modulo 3: rows of fold 1 are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def learnt(docs: DataFrame, text: str = "text") -> Model:
    """The production model: from labelled rows outside the held-out fold."""
    return train(docs.where(fold() != 1).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col(text).cast("string").alias("t")))
