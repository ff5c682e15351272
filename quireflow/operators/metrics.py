"""Extraction quality: error rates, field accuracy, classification reports, histograms, run times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quireflow.functions import text

#: Characters of a concatenated side beyond which workers compare it.
LONG = 20_000


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return zero(F.try_divide(a.cast("double"), b.cast("double")))


def document_text(tokens: DataFrame, key: list[str], order: str, word: str = "text") -> DataFrame:
    """(key.., text): a document's words in order, joined by blanks; empty words are left out."""
    parts = F.array_sort(F.collect_list(F.when(F.length(word) > 0, F.struct(F.col(order).alias("o"), F.col(word).alias("w")))))
    return tokens.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["w"]), " ").alias("text"))


def error_rates(pairs: DataFrame, predicted: str = "predicted", truth: str = "truth", unicode: bool = True, long: Column | None = None) -> DataFrame:
    """pairs with distances, lengths, cer and wer of the normal forms. Rows for which long holds are compared in workers."""
    p, t = text.normalize(F.col(predicted), unicode=unicode), text.normalize(F.col(truth), unicode=unicode)
    seen = pairs.withColumn("_p", p).withColumn("_t", t)
    seen = seen.withColumn("_pt", F.regexp_extract_all("_p", F.lit(text.TOKEN), 1)).withColumn("_tt", F.regexp_extract_all("_t", F.lit(text.TOKEN), 1))
    chars, tokens = F.levenshtein("_p", "_t"), text.token_distance(F.col("_pt"), F.col("_tt"))
    if long is not None:  # nulls cost the workers nothing
        far = lambda f, *c: f(*[F.when(long, F.col(x)) for x in c])
        chars, tokens = F.when(long, far(text.long_distance, "_p", "_t")).otherwise(chars), F.when(long, far(text.long_token_distance, "_pt", "_tt")).otherwise(tokens)
    out = seen.withColumn("char_distance", chars).withColumn("char_length", F.length("_t")).withColumn("token_distance", tokens).withColumn("token_length", F.size("_tt"))
    rate = lambda d, n, p: F.when(F.col(n) > 0, F.col(d) / F.col(n)).otherwise(F.when(p > 0, 1.0).otherwise(0.0))
    return out.withColumn("cer", rate("char_distance", "char_length", F.length("_p"))).withColumn("wer", rate("token_distance", "token_length", F.size("_pt"))).drop("_p", "_t", "_pt", "_tt")


def global_error_rates(pairs: DataFrame, order: str, predicted: str = "predicted", truth: str = "truth", by: list[str] | None = None, most: int | None = None, unicode: bool = True, long: int = LONG) -> DataFrame:
    """Error rates of the concatenated texts, of all or by group; exact at any length. Groups with a side of more than
    `long` characters are compared in workers, bit-parallel and in blocks (text.long_distance()). That still takes time with
    the square of the length, so callers may ask for null beyond `most` characters; micro_error_rates() is the measure for
    corpora."""
    both = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(predicted, F.lit("")).alias("p"), F.coalesce(truth, F.lit("")).alias("t"))))
    side = lambda n: F.array_join(F.transform("_all", lambda x: x[n]), " ")
    joined = pairs.groupBy(*(by or [])).agg(both.alias("_all"), F.coalesce(F.greatest(F.sum(F.length(predicted)), F.sum(F.length(truth))), F.lit(0)).alias("_n"))
    fits = F.lit(True) if most is None else F.col("_n") <= most
    cut_ = joined.withColumn("predicted", F.when(fits, side("p"))).withColumn("truth", F.when(fits, side("t")))
    rates = error_rates(cut_, unicode=unicode, long=F.col("_n") > long)
    return rates.select(*(by or []), F.when(fits, F.col("cer")).alias("cer"), F.when(fits, F.col("wer")).alias("wer"))


def micro_error_rates(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of distances over sums of lengths, of error_rates()."""
    return rates.groupBy(*(by or [])).agg(ratio(F.sum("char_distance"), F.greatest(F.sum("char_length"), F.lit(1))).alias("cer"), ratio(F.sum("token_distance"), F.greatest(F.sum("token_length"), F.lit(1))).alias("wer"), F.count("*").alias("n"))


def ocr_evaluation(samples: DataFrame) -> DataFrame:
    """One row: corpus rates of samples(predicted, truth, seconds); a null prediction is an undetected sample: it counts
    as wrong entirely and takes no time, but its lengths stay out of the corpus sums."""
    seen = F.col("predicted").isNotNull()
    s = samples.withColumn("_d", F.when(seen, F.levenshtein("predicted", "truth"))).withColumn("_w", F.when(seen, F.size(text.words(F.col("truth"))))).withColumn("_l", F.when(seen, F.length("truth")))
    each = F.when(seen, F.col("_d") / F.greatest(F.length("truth"), F.lit(1))).otherwise(1.0)
    return s.agg(ratio(F.sum("_d"), F.greatest(F.sum("_l"), F.lit(1))).alias("cer"), ratio(F.sum("_d"), F.greatest(F.sum("_w"), F.lit(1))).alias("char_distance_per_word"), zero(F.avg(each)).alias("mean_sample_cer"), F.count("*").alias("num_samples"), F.count("predicted").alias("num_detected"), ratio(F.sum(F.when(seen, F.col("seconds")).otherwise(0.0)), F.greatest(F.count("*"), F.lit(1))).alias("mean_seconds"))


def field_scores(pairs: DataFrame, predicted: str = "predicted", truth: str = "truth", unicode: bool = True) -> DataFrame:
    """pairs with exact_match and edit_accuracy of the lower-cased normal forms."""
    seen = pairs.withColumn("_p", text.normalize(F.col(predicted), lowercase=True, unicode=unicode)).withColumn("_t", text.normalize(F.col(truth), lowercase=True, unicode=unicode))
    return seen.withColumn("exact_match", (F.col("_p") == F.col("_t")).cast("double")).withColumn("edit_accuracy", text.edit_accuracy(F.col("_p"), F.col("_t"))).drop("_p", "_t")


def field_accuracy(scores: DataFrame, field: str = "field") -> DataFrame:
    """(field, exact_match, edit_accuracy, support)."""
    return scores.groupBy(field).agg(F.avg("exact_match").alias("exact_match"), F.avg("edit_accuracy").alias("edit_accuracy"), F.count("*").alias("support"))


def macro_micro(scores: DataFrame, field: str = "field") -> DataFrame:
    """One row: means of the fields' means and means of all rows; 0 without rows."""
    fields = scores.groupBy(field).agg(F.sum("exact_match").alias("e"), F.sum("edit_accuracy").alias("a"), F.count("*").alias("n"))
    return fields.agg(zero(F.avg(F.col("e") / F.col("n"))).alias("macro_exact"), zero(F.avg(F.col("a") / F.col("n"))).alias("macro_edit"), ratio(F.sum("e"), F.sum("n")).alias("micro_exact"), ratio(F.sum("a"), F.sum("n")).alias("micro_edit"))


def normalized_field_accuracy(pairs: DataFrame, unicode: bool = True) -> DataFrame:
    """(field, exact_percent, normalized_accuracy, support): shares of equal raw texts and of equal NFC forms."""
    same = (text.normalize_field(F.col("predicted"), unicode) == text.normalize_field(F.col("truth"), unicode)).cast("double")
    return pairs.groupBy("field").agg((F.avg((F.col("predicted") == F.col("truth")).cast("double")) * 100).alias("exact_percent"), F.avg(same).alias("normalized_accuracy"), F.count("*").alias("support"))


def best_candidates(candidates: DataFrame, key: list[str], score: str = "score", order: str = "pos") -> DataFrame:
    """One candidate to each key: the greatest score, the first of equals."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), F.col(order))
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def grouped_values(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """(key.., values): values in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(*key).agg(F.transform(parts, lambda p: p["v"]).alias("values"))


def confusion(pairs: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """(y_true, y_pred, n)."""
    return pairs.groupBy(F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, labels: list[str]) -> DataFrame:
    """A row to each of the labels, a column to each: counts of confusion()."""
    return counts.groupBy("y_true").pivot("y_pred", labels).agg(F.sum("n")).na.fill(0)


def label_union(pairs: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """(label): all labels of both sides."""
    return pairs.select(F.explode(F.array(truth, predicted)).alias("label")).distinct()


def class_report(counts: DataFrame, ignore: str | None = None) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, support) from confusion(); `ignore` is a label that gets no row and
    whose pairs count as misses or false alarms of the others only."""
    n, none, hit = F.col("n"), F.lit(0).cast("long"), F.col("y_true") == F.col("y_pred")
    side = lambda label, **v: F.struct(F.col(label).alias("label"), *[v.get(c, none).alias(c) for c in ("tp", "fp", "fn")])
    as_true = side("y_true", tp=F.when(hit, n).otherwise(none), fn=F.when(hit, none).otherwise(n))
    as_predicted = side("y_pred", fp=F.when(hit, none).otherwise(n))
    sides = counts.select(F.inline(F.array(as_true, as_predicted)))
    out = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    out = out.where(F.col("label") != ignore) if ignore is not None else out
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


def averages(report: DataFrame) -> DataFrame:
    """One row: accuracy, and micro, macro and weighted precision, recall and F1 of class_report()."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = [ratio(tp, F.sum("support")).alias("accuracy"), p.alias("micro_precision"), r.alias("micro_recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1")]
    out += [zero(F.avg(c)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    out += [ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return report.agg(*out)


def iou_by_label(best: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, mean_iou, recall_50, n), and a row of all labels (null)."""
    hit = F.avg((F.col("iou") >= threshold).cast("double"))
    return best.rollup("label").agg(F.avg("iou").alias("mean_iou"), hit.alias("recall_50"), F.count("*").alias("n"))


def run_stats(runs: DataFrame, value: str = "seconds", by: list[str] | None = None) -> DataFrame:
    """mean, std (population), min, max, throughput (runs a second) and n."""
    v = F.col(value)
    return runs.groupBy(*(by or [])).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), ratio(F.count(v), F.sum(v)).alias("throughput"), F.count(v).alias("n"))


def stage_stats(runs: DataFrame) -> DataFrame:
    """run_stats() by stage of runs(timings: map of seconds)."""
    return run_stats(runs.select(F.explode("timings").alias("stage", "seconds")), by=["stage"])


def memory_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("gpu_memory_mb").alias("max_mb"), F.avg("gpu_memory_mb").alias("mean_mb"))


def char_confusions(pairs: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """(truth_char, predicted_char, n): characters of equal place that differ, up to the shorter text."""
    n = F.least(F.length(predicted), F.length(truth))
    chars = lambda c: F.split(F.substring(F.col(c), F.lit(1), n), "")
    rows = pairs.where(n > 0).select(F.explode(F.arrays_zip(chars(truth).alias("t"), chars(predicted).alias("p"))).alias("x")).select(F.col("x.t").alias("truth_char"), F.col("x.p").alias("predicted_char"))
    return rows.where("truth_char <> predicted_char").groupBy("truth_char", "predicted_char").agg(F.count("*").alias("n"))


def top(rows: DataFrame, n: int, by: list) -> DataFrame:
    return rows.orderBy(*by).limit(n)


def confusion_pivot(confusions: DataFrame, chars: list[str]) -> DataFrame:
    """A row to each true character, a column to each of `chars`: mean counts, 0 where there are none."""
    return confusions.groupBy("truth_char").pivot("predicted_char", chars).agg(F.avg("n")).na.fill(0.0)


def histogram(rows: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n) from 1 to bins over low..high, the last bin closed; values are clipped where bounds are given, else the
    bounds are the data's. Empty bins give no row; if all values are equal they share one bin."""
    rows = rows.where(F.col(value).isNotNull())
    if low is None or high is None:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))))
    else:
        rows = rows.withColumn("_lo", F.lit(float(low))).withColumn("_hi", F.lit(float(high)))
    v = F.greatest("_lo", F.least("_hi", F.col(value).cast("double")))
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins))).otherwise(1)
    return rows.select(b.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
