"""The queries opN_<name> over the driver's tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quireflow.llm import bpe, langid, licensescan, linededup, media, mixing, sharding, simhash, tokencount, topk
from quireflow.llm.common import documents


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensescan.scan(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "shards")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(documents(spark, sf_dir))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.learnt(docs))
    return found.select("doc_id", F.coalesce(langid.fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_rows(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_source_mixing": op3_source_mixing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_flac_media": op5_flac_media,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_sharding": op9_sharding,
    "op10_line_dedup": op10_line_dedup,
}

def _license_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    form = f"translate(text, {quoted(licensescan.UPPER + licensescan.MARKS)}, {quoted(licensescan.LOWER + ' ' * len(licensescan.MARKS))})"
    form = f"regexp_replace({form}, {quoted('(?m)' + licensescan.COPYRIGHT)}, ' ', 'g')"
    form = f"' ' || trim(regexp_replace({form}, {quoted(licensescan.BLANKS)}, '  ', 'g'), ' ') || ' '"
    for a, b in licensescan.SPELLINGS:
        form = f"replace({form}, {quoted(' ' + a.replace(' ', '  ') + ' ')}, {quoted(' ' + b + ' ')})"
    known = ", ".join(f"({quoted(name)}, {quoted(digest)})" for name, digest in licensescan.known_digests())
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (VALUES {known}) AS k(license, digest) GROUP BY digest),
own AS (SELECT doc_id, sha256({form}) AS digest FROM documents)
SELECT doc_id, own.digest, license FROM own LEFT JOIN known ON known.digest = own.digest
"""


ORACLE_SQL: dict[str, str] = {
    "op6_exact_top_k": """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM ok q JOIN ok c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scores)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op2_license_scan": _license_sql(),
    "op10_line_dedup": r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n FROM docs),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines),
ends AS (SELECT *, i = n - 1 OR (i >= 1 AND (lag(h) OVER w * 31 + h) % 4 = 0) AS stop FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ends),
counted AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto, upto - words AS before FROM (SELECT doc_id, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines) WHERE words > 0),
spans AS (
    SELECT doc_id, min(i) AS start, max(i) + 1 AS stop FROM placed GROUP BY doc_id, chunk HAVING count(*) > 1
    UNION
    SELECT a.doc_id, a.i, min(b.i) + 1 FROM counted a JOIN counted b ON b.doc_id = a.doc_id AND b.upto > a.before + 50 GROUP BY a.doc_id, a.i
    UNION
    SELECT b.doc_id, max(a.i), b.i + 1 FROM counted b JOIN counted a ON a.doc_id = b.doc_id AND a.before < b.upto - 50 GROUP BY b.doc_id, b.i
),
units AS (SELECT s.doc_id, s.start, s.stop, string_agg(l.line, chr(10) ORDER BY l.i) AS unit FROM spans s JOIN lines l ON l.doc_id = s.doc_id AND l.i BETWEEN s.start AND s.stop - 1 GROUP BY s.doc_id, s.start, s.stop),
again AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, start, stop) AS r FROM units),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS i FROM again WHERE r > 1),
left_ AS (
    SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS lines_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS t
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT doc_id, n_lines::INT AS n_lines, lines_removed::INT AS lines_removed, strlen(t) AS n_bytes, sha256(t) AS text_sha256 FROM left_
""",
}
