"""Queries of the corpus problems, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawright.llm import bpe, language, overlap, packing, personal, sampling, subjects, toxicity
from stratawright.session import cut, read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlapping_pairs(read_table(spark, sf_dir, "posts"))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_counts(read_table(spark, sf_dir, "posts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(read_table(spark, sf_dir, "posts"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted(read_table(spark, sf_dir, "posts"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("record_kind", "record_id", "field", "lang")


def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(*(read_table(spark, sf_dir, t) for t in ("posts", "communities", "declared_langs")))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, communities = read_table(spark, sf_dir, "posts"), read_table(spark, sf_dir, "communities")
    texts = language.train(spark, posts, read_table(spark, sf_dir, "declared_langs"))
    return language.language_segments(language.record_fields(posts, communities), texts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.found(read_table(spark, sf_dir, "posts"), read_table(spark, sf_dir, "content_labels"))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.long_form(toxicity.scores(*toxicity.train(read_table(spark, sf_dir, "posts"), read_table(spark, sf_dir, "content_labels"))))


def p4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.passages(*toxicity.train(read_table(spark, sf_dir, "posts"), read_table(spark, sf_dir, "content_labels")))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(read_table(spark, sf_dir, "posts"), read_table(spark, sf_dir, "content_labels"))


def p5_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the distinct instances of the sampled posts."""
    return sampling.sample_with_details(read_table(spark, sf_dir, "posts"), read_table(spark, sf_dir, "instances"), "post_id")[1]


def p5_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled posts, one row per canonical id."""
    return sampling.sample_with_details(read_table(spark, sf_dir, "posts"), read_table(spark, sf_dir, "instances"), "post_id")[0]


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose pieces the packing has placed in several containers."""
    return packing.split_items(p7_packing(spark, sf_dir), "doc_id")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(cut(bpe.token_sizes(read_table(spark, sf_dir, "documents"), "doc_id", "text")), "doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """container, items, used, unused: how each container is filled."""
    rows = p7_packing(spark, sf_dir).filter("container is not null")
    filled = rows.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("piece_size").alias("used"))
    return filled.withColumn("unused", F.lit(packing.CAPACITY).cast("bigint") - F.col("used"))


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers the packing needs beside the fewest that any could, and that none is overfull."""
    return packing.summary(p7_packing(spark, sf_dir), "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found(*(read_table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_list")))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.corpus_shares(*(read_table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_list")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_counts, p2_found, p2_redacted, p3_found, p3_confidence, p3_segments, p4_found, p4_scores, p4_passages, p4_rates,
        p5_instances, p5_posts, p6_ids, p7_found, p7_packing, p7_containers, p7_summary, p8_found, p8_shares,
    )
}

_SAMPLED = """
WITH spelled AS (
  SELECT *, nullif(regexp_replace(lower(regexp_replace(post_id, '[\\s\\x00-\\x1f]+', '', 'g')), '^t3_', ''), '') AS canonical FROM {table}
), numbered AS (
  SELECT *, CASE WHEN regexp_full_match(canonical, '[0-9a-z]{{1,11}}')
    THEN list_reduce(list_transform(string_split(canonical, ''), lambda c: (instr('0123456789abcdefghijklmnopqrstuvwxyz', c) - 1)::BIGINT), lambda a, b: a * 36 + b)
    ELSE ('0x' || substr(sha256(canonical), 1, 13))::BIGINT END AS number FROM spelled
), kept AS (
  SELECT * FROM numbered WHERE canonical IS NOT NULL AND ((number % 2147483648) * 1327217885 + 608135816) % 2147483648 < 214748364
)
"""

SQL: dict[str, str] = {
    "p5_posts": _SAMPLED.format(table="posts") + "SELECT canonical AS post_id, count(*) AS n_rows FROM kept GROUP BY canonical",
    "p5_instances": _SAMPLED.format(table="instances")
    + """SELECT DISTINCT canonical AS post_id, target, community_track, split, difficulty, pool_id, shuffle_seed FROM kept
    WHERE canonical IN (SELECT regexp_replace(lower(regexp_replace(post_id, '[\\s\\x00-\\x1f]+', '', 'g')), '^t3_', '') FROM posts)""",
}
