"""Queries over documents, conversations, labels, events and pages: pairing, splits, text quality, tags, run times."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quireflow.constants import SPLITS, SUFFIX_PRIORITY
from quireflow.functions import text
from quireflow.operators import generate, kie, metrics, ordering, pages, pairing
from quireflow.plans.registry import query, table
from quireflow.sources import annotations as A


@query("SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def pair_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pair_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.unmatched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def pair_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.with_truth(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def pair_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.with_optional(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


_FILES = "SELECT page_id // 2 AS stem, CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.bmp' END AS suffix, url AS path FROM pages"


@query(f"SELECT stem, suffix, path FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY CASE suffix WHEN '.jpg' THEN 1 WHEN '.jpeg' THEN 2 ELSE 3 END, path) AS r FROM ({_FILES}) WHERE suffix IN ('.jpg', '.jpeg', '.png')) WHERE r = 1")
def suffix_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").selectExpr("page_id div 2 AS stem", "CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.bmp' END AS suffix", "url AS path")
    return A.pick_by_suffix(files, SUFFIX_PRIORITY).select("stem", "suffix", "path")


@query("SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]+$', '\\1') AS stem FROM pages")
def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.stem(F.col("url")).alias("stem"))


def _split_sql(shares: dict[str, str]) -> str:
    a, b = list(shares.values())[:2]
    return f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * {a}) THEN 'train' WHEN k <= floor(n * {a}) + floor(n * {b}) THEN 'val' ELSE 'test' END AS split FROM r
"""


@query(_split_sql(SPLITS))
def split_70_20_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query(_split_sql({"train": "0.8", "val": "0.1", "test": "0.1"}))
def split_80_10_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"train": "0.8", "val": "0.1", "test": "0.1"}).select("doc_id", "split")


@query("WITH r AS (SELECT row_number() OVER (ORDER BY md5('42:' || doc_id)) AS k, count(*) OVER () AS n FROM documents) SELECT CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM r GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.split_counts(pairing.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"train": "0.8", "val": "0.2"}))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 25")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 25 rows, the same ones in every run."""
    return pairing.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 25, "doc_id")


@query(r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' '))) AS normal_sha256 FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of all texts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.normalize(F.col("text"), lowercase=True), 256).alias("normal_sha256"))


@query(r"SELECT conv_id, turn, len(t)::INT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+|[0-9]+(?:[./:-][0-9]+)*|[^ \t\n\r\f\v]') AS t FROM conversations)")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.withColumn("t", text.tokenize(F.col("text"))).select("conv_id", "turn", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


#: DuckDB's levenshtein() counts bytes: for it, the tables' letters beyond ASCII become control characters of one byte.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = "".join(map(chr, [*range(0x01, 0x09), *range(0x0E, 0x20)]))[: len(LETTERS)]


def by_letters(sql: str) -> str:
    """SQL whose levenshtein() compares letters."""
    one = lambda x: f"translate({x}, '{LETTERS}', '{_BYTES}')"
    return re.sub(r"levenshtein\((lower\(\w+\)|\w+), (lower\(\w+\)|\w+)\)", lambda m: f"levenshtein({one(m[1])}, {one(m[2])})", sql)


_PAIRS = r"""
pairs AS (
    SELECT conv_id, turn, role AS field, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS truth, trim(regexp_replace(nxt, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS predicted
    FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM conversations)
    WHERE nxt IS NOT NULL
)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, field, truth, predicted): each turn with the next one."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    seen = table(spark, sf_dir, "conversations").withColumn("nxt", F.lead(F.struct("text")).over(w)).where("nxt is not null").withColumn("nxt", F.col("nxt.text"))
    squeezed = lambda c: text.squeeze(F.coalesce(F.col(c), F.lit("")))
    return seen.select("conv_id", "turn", F.col("role").alias("field"), squeezed("text").alias("truth"), squeezed("nxt").alias("predicted"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.field_scores(pairs(spark, sf_dir))


@query(by_letters(f"WITH {_PAIRS} SELECT conv_id, turn, levenshtein(predicted, truth) AS char_distance, round(CASE WHEN length(truth) > 0 THEN levenshtein(predicted, truth) / length(truth) WHEN length(predicted) > 0 THEN 1 ELSE 0 END, 9) AS cer FROM pairs"))
def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.error_rates(pairs(spark, sf_dir))
    return rates.select("conv_id", "turn", F.col("char_distance").cast("long").alias("char_distance"), F.round("cer", 9).alias("cer"))


@query()
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distances of token lists: the tests hold them against a plain loop."""
    return metrics.error_rates(pairs(spark, sf_dir)).select("conv_id", "turn", "token_distance", "token_length", F.round("wer", 9).alias("wer"))


_SCORES = f"WITH {_PAIRS}, s AS (SELECT *, (lower(predicted) = lower(truth))::INT::DOUBLE AS exact_match, CASE WHEN length(truth) > 0 THEN greatest(0, 1 - levenshtein(lower(predicted), lower(truth)) / length(truth)) WHEN length(predicted) > 0 THEN 0 ELSE 1 END AS edit_accuracy FROM pairs)"


@query(by_letters(f"{_SCORES} SELECT field, round(avg(exact_match), 9) AS exact_match, round(avg(edit_accuracy), 9) AS edit_accuracy, count(*) AS support FROM s GROUP BY field"))
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.field_accuracy(scores(spark, sf_dir))
    return out.select("field", F.round("exact_match", 9).alias("exact_match"), F.round("edit_accuracy", 9).alias("edit_accuracy"), "support")


@query(by_letters(f"{_SCORES}, f AS (SELECT avg(exact_match) AS e, avg(edit_accuracy) AS a FROM s GROUP BY field) SELECT round((SELECT avg(e) FROM f), 9) AS macro_exact, round((SELECT avg(a) FROM f), 9) AS macro_edit, round(avg(exact_match), 9) AS micro_exact, round(avg(edit_accuracy), 9) AS micro_edit FROM s"))
def macro_micro_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.macro_micro(scores(spark, sf_dir))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(by_letters(f"WITH {_PAIRS} SELECT field, round(sum(levenshtein(predicted, truth)) / greatest(sum(length(truth)), 1), 9) AS cer, count(*) AS n FROM pairs GROUP BY field"))
def global_cer_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro_error_rates(metrics.error_rates(pairs(spark, sf_dir)), ["field"]).select("field", F.round("cer", 9).alias("cer"), "n")


@query(by_letters(f"WITH {_PAIRS}, c AS (SELECT conv_id, string_agg(predicted, ' ' ORDER BY turn, predicted, truth) AS p, string_agg(truth, ' ' ORDER BY turn, predicted, truth) AS t FROM pairs GROUP BY conv_id) SELECT conv_id, round(levenshtein(p, t) / length(t), 9) AS cer FROM c"))
def concatenated_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of whole conversations, their turns joined."""
    return metrics.global_error_rates(pairs(spark, sf_dir), "turn", by=["conv_id"]).select("conv_id", F.round("cer", 9).alias("cer"))


@query(by_letters(f"WITH {_PAIRS} SELECT round(sum(d) / greatest(sum(length(truth)), 1), 9) AS cer, round(sum(d) / greatest(sum(w), 1), 9) AS char_distance_per_word, round(avg(CASE WHEN d IS NULL THEN 1 ELSE d / greatest(length(truth), 1) END), 9) AS mean_sample_cer, count(*) AS num_samples, count(d) AS num_detected FROM (SELECT CASE WHEN turn % 4 <> 0 THEN levenshtein(predicted, truth) END AS d, CASE WHEN turn % 4 <> 0 THEN truth END AS truth, CASE WHEN turn % 4 <> 0 THEN len(list_filter(string_split(truth, ' '), lambda x: x <> '')) END AS w FROM pairs)"))
def ocr_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the samples counts as undetected."""
    samples = pairs(spark, sf_dir).withColumn("predicted", F.when(F.col("turn") % 4 != 0, F.col("predicted"))).withColumn("seconds", F.lit(0.5))
    out = metrics.ocr_evaluation(samples)
    return out.select(*[F.round(c, 9).alias(c) for c in ("cer", "char_distance_per_word", "mean_sample_cer")], "num_samples", "num_detected")


_CHARS = f"WITH {_PAIRS}, c AS (SELECT substr(truth, i, 1) AS truth_char, substr(predicted, i, 1) AS predicted_char FROM (SELECT truth, predicted, unnest(range(1, least(length(truth), length(predicted)) + 1)) AS i FROM pairs)), n AS (SELECT truth_char, predicted_char, count(*) AS n FROM c WHERE truth_char <> predicted_char GROUP BY ALL)"


@query(f"{_CHARS} SELECT * FROM n")
def char_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.char_confusions(pairs(spark, sf_dir))


@query(f"{_CHARS} SELECT * FROM n ORDER BY n DESC, truth_char, predicted_char LIMIT 20")
def char_confusions_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top(metrics.char_confusions(pairs(spark, sf_dir)), 20, [F.col("n").desc(), "truth_char", "predicted_char"])


@query(f"{_CHARS} SELECT truth_char, coalesce(avg(n) FILTER (WHERE predicted_char = 'e'), 0) AS e, coalesce(avg(n) FILTER (WHERE predicted_char = 't'), 0) AS t, coalesce(avg(n) FILTER (WHERE predicted_char = ' '), 0) AS blank FROM n WHERE predicted_char IN ('e', 't', ' ') GROUP BY truth_char")
def confusion_chars_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = metrics.char_confusions(pairs(spark, sf_dir)).where(F.col("predicted_char").isin("e", "t", " "))
    return metrics.confusion_pivot(few, ["e", "t", " "]).withColumnRenamed(" ", "blank")


@query(by_letters(f"WITH {_PAIRS} SELECT conv_id, turn, round(levenshtein(predicted, truth) / length(truth), 9) AS cer FROM pairs WHERE length(truth) > 0 ORDER BY round(levenshtein(predicted, truth) / length(truth), 9) DESC, conv_id, turn LIMIT 20"))
def worst20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.error_rates(pairs(spark, sf_dir).where("length(truth) > 0")).select("conv_id", "turn", F.round("cer", 9).alias("cer"))
    return metrics.top(rates, 20, [F.col("cer").desc(), "conv_id", "turn"])


@query(by_letters(f"WITH {_PAIRS} SELECT bin, count(*) AS n FROM (SELECT least(floor(greatest(0, least(3, levenshtein(predicted, truth) / length(truth))) / 3 * 30) + 1, 30)::INT AS bin FROM pairs WHERE length(truth) > 0) GROUP BY bin"))
def cer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(metrics.error_rates(pairs(spark, sf_dir).where("length(truth) > 0")), "cer", 30, 0, 3)


@query(by_letters(f"{_SCORES} SELECT conv_id, turn, field, predicted, truth FROM s WHERE exact_match = 0"))
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where("exact_match = 0").select("conv_id", "turn", "field", "predicted", "truth")


_RULED = "ruled AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS y_true, CASE WHEN n_chars > 3000 THEN 'good' WHEN n_chars > 400 THEN 'poor' ELSE 'O' END AS y_pred FROM documents JOIN labels USING (doc_id))"
_COUNTS = f"WITH {_RULED}, l AS (SELECT DISTINCT unnest([y_true, y_pred]) AS label FROM ruled), c AS (SELECT label, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp, count(*) FILTER (WHERE y_true <> label AND y_pred = label) AS fp, count(*) FILTER (WHERE y_true = label AND y_pred <> label) AS fn FROM l, ruled GROUP BY label), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, tp + fn AS support FROM r)"


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y_true, y_pred): documents' quality and a rule on their length."""
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return met.select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("y_true"), F.when(F.col("n_chars") > 3000, "good").when(F.col("n_chars") > 400, "poor").otherwise("O").alias("y_pred"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in names else F.col(c) for c in df.columns])


@query(f"{_COUNTS} SELECT label, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM f")
def token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_report(metrics.confusion(ruled(spark, sf_dir))), "precision", "recall", "f1")


@query(f"{_COUNTS} SELECT label, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM f WHERE label <> 'O'")
def token_report_without_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_report(metrics.confusion(ruled(spark, sf_dir)), "O"), "precision", "recall", "f1")


@query(f"{_COUNTS} SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(sum(tp) / (sum(tp) + sum(fp)), 9) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 9) AS micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1, round(sum(precision * support) / sum(support), 9) AS weighted_precision, round(sum(recall * support) / sum(support), 9) AS weighted_recall, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM f")
def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.averages(metrics.class_report(metrics.confusion(ruled(spark, sf_dir))))
    return rounded(out, *out.columns)


@query(f"WITH {_RULED} SELECT y_true, y_pred, count(*) AS n FROM ruled GROUP BY ALL")
def confusion_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(ruled(spark, sf_dir))


@query(f"WITH {_RULED} SELECT y_true, count(*) FILTER (WHERE y_pred = 'O') AS \"O\", count(*) FILTER (WHERE y_pred = 'good') AS good, count(*) FILTER (WHERE y_pred = 'poor') AS poor FROM ruled GROUP BY y_true")
def confusion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(metrics.confusion(ruled(spark, sf_dir)), ["O", "good", "poor"])


@query(f"WITH {_RULED} SELECT DISTINCT unnest([y_true, y_pred]) AS label FROM ruled")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_union(ruled(spark, sf_dir))


_RUN = "round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(count(value) / sum(value), 9) AS throughput, count(value) AS n FROM events"


@query(f"SELECT {_RUN}")
def runtime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.run_stats(table(spark, sf_dir, "events"), "value")
    return out.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", F.round("throughput", 9).alias("throughput"), "n")


@query(f"SELECT event_type AS stage, {_RUN} GROUP BY event_type")
def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.create_map("event_type", "value").alias("timings"))
    out = metrics.stage_stats(runs)
    return out.select("stage", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", F.round("throughput", 9).alias("throughput"), "n")


_TAGS = "tags AS (SELECT user_id, event_id, ts, value, CASE event_type WHEN 'signup' THEN 'B-A' WHEN 'click' THEN 'I-A' WHEN 'purchase' THEN 'B-B' WHEN 'view' THEN 'I-B' ELSE 'O' END AS label FROM events)"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE event_type WHEN 'signup' THEN 'B-A' WHEN 'click' THEN 'I-A' WHEN 'purchase' THEN 'B-B' WHEN 'view' THEN 'I-B' ELSE 'O' END")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", label.alias("label"))


def _runs_sql(source: str) -> str:
    return f"""
f AS (SELECT *, CASE WHEN label <> 'O' THEN substr(label, 3) END AS field, left(label, 1) AS prefix FROM {source}),
p AS (SELECT *, lag(field) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM f),
o AS (SELECT *, sum((field IS NOT NULL AND (prefix = 'B' OR before IS NULL OR before <> field))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS entity FROM p)
SELECT user_id, entity, field, round(avg(value), 6) AS score, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS event_ids FROM o WHERE field IS NOT NULL GROUP BY ALL
"""


def _merged(runs: DataFrame) -> DataFrame:
    out = ordering.merge_entities(runs.withColumn("o", F.struct("ts", "event_id")).withColumn("w", F.col("event_id").cast("string")), ["user_id"], "o", "w", "value")
    return out.select("user_id", "entity", "field", F.round("score", 6).alias("score"), F.replace("text", F.lit(" "), F.lit(",")).alias("event_ids"))


@query(f"WITH {_TAGS}, {_runs_sql('tags')}")
def bio_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(ordering.tag_runs(tags(spark, sf_dir), ["user_id"], ["ts", "event_id"]))


_ODD = "odd AS (SELECT * REPLACE (CASE WHEN label = 'O' AND event_id % 2 = 0 THEN '?' ELSE label END AS label) FROM tags), kept AS (SELECT * FROM odd WHERE label <> '?')"


@query(f"WITH {_TAGS}, {_ODD}, {_runs_sql('kept')}")
def bio_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = tags(spark, sf_dir).withColumn("label", F.when((F.col("label") == "O") & (F.col("event_id") % 2 == 0), "?").otherwise(F.col("label")))
    return _merged(ordering.tag_runs_strict(odd, ["user_id"], ["ts", "event_id"]))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_subtoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.first_subtokens(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_candidates(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def grouped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped_values(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id").select("user_id", F.array_join("values", ",").alias("types"))


@query("SELECT conv_id, turn, role, nxt AS next_role FROM (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM conversations)")
def kie_next_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("at", F.struct("turn", "role", "text"))
    return c.select("conv_id", "turn", "role", kie.next_of("role", "conv_id", "at").alias("next_role"))


@query(
    """
WITH s AS (SELECT user_id, event_id, event_type = 'signup' AS seller, event_type = 'click' AS name, lead(event_id) OVER w IS NOT NULL AS has_next, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT e.*, s.g, s.name AND s.has_next AND s.g > 0 AS able FROM events e JOIN s USING (event_id)),
k AS (SELECT *, sum(able::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, event_id FROM k WHERE able AND n = 1
"""
)
def kie_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine over events: a signup arms, the next click that has a successor fires."""
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    e = e.withColumn("more", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("at")).isNotNull())
    out = kie.vendor_flags(e, F.col("event_type") == "signup", F.col("event_type") == "click", F.col("more"), "user_id", "at")
    return out.where("vendor").select("user_id", "event_id")


@query("SELECT event_id, coalesce((props->>'k')::BIGINT, -1) AS k, CASE WHEN list_contains(json_keys(props), 'k') THEN 'present' ELSE 'absent' END AS state FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a JSON field, and whether the key is there at all."""
    props = F.from_json("props", "k BIGINT")
    state = F.when(F.array_contains(F.json_object_keys("props"), "k"), "present").otherwise("absent")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(props["k"], F.lit(-1)).cast("long").alias("k"), state.alias("state"))


@query("SELECT doc_id, (60 + ('0x' || substr(md5(source), 1, 2))::INT % 180)::INT AS r, (60 + ('0x' || substr(md5(source), 3, 2))::INT % 180)::INT AS g, (60 + ('0x' || substr(md5(source), 5, 2))::INT % 180)::INT AS b, left(source, 20) AS label FROM documents")
def field_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.field_colour(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", c[0].alias("r"), c[1].alias("g"), c[2].alias("b"), text.truncate(F.col("source"), 20).alias("label"))


@query("SELECT doc_id, 'Document ' || doc_id || ' from ' || source || ' / ' || lang AS filled FROM documents")
def fill_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("Document {{id}} from {{SOURCE}} / {{lang}}").alias("text"), F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("source"), "source", F.lit("lang"), "lang").alias("values"))
    return generate.fill_template(docs).select("doc_id", "filled")


@query("SELECT doc_id, label_id, round(lilt_score, 9) AS lilt_score FROM (SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END::INT AS label_id, 1 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))) AS lilt_score FROM (SELECT doc_id, (n_chars % 7) / 2.0 AS a, (n_chars % 5) / 2.0 AS b, (n_chars % 3) / 2.0 AS c FROM documents))")
def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.array(*[(F.col("n_chars") % m) / 2.0 for m in (7, 5, 3)])
    return pages.argmax_label(table(spark, sf_dir, "documents").select("doc_id", logits.alias("logits"))).select("doc_id", "label_id", F.round("lilt_score", 9).alias("lilt_score"))
