"""From cleaned posts to splits: duplicates, eligibility, deterministic splits of communities and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratawright.functions.hashing import Hash, blake2b63
from stratawright.functions.text import casefold


def dedupe_paired(posts: DataFrame) -> DataFrame:
    """One row per post_id: ids seen in two communities are dropped, else the longest body wins, of equals the earliest (``seq``).

    One aggregation by id; the winner is a max over a struct, so there is no sort of whole groups.
    """
    rest = [c for c in posts.columns if c != "post_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.length("selftext"), -F.col("seq")))
    found = posts.withColumn("_key", casefold("subreddit")).groupBy("post_id").agg(best.alias("row"), F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    return found.filter("_low = _high").select("post_id", "row.*")


def dedupe_first(posts: DataFrame) -> DataFrame:
    """One row per post_id: the first one read."""
    rest = [c for c in posts.columns if c != "post_id"]
    return posts.groupBy("post_id").agg(F.min_by(F.struct(*rest), "seq").alias("row")).select("post_id", "row.*")


def unique_titles(posts: DataFrame) -> DataFrame:
    """Posts whose folded title no other post has; every copy of a repeated title is dropped.

    The count of titles is aggregated before it is joined, so a title with very many copies is no hot group.
    """
    keyed = posts.withColumn("_title", casefold("title"))
    once = keyed.groupBy("_title").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("_title")
    return keyed.join(once, "_title", "left_semi").drop("_title")


def build_report(raw: DataFrame, usable: DataFrame, deduped: DataFrame, unique: DataFrame) -> DataFrame:
    """rows_read, rejected, collisions_and_copies, duplicate_titles, kept: one row."""
    counts = [d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((raw, "rows_read"), (usable, "usable"), (deduped, "deduped"), (unique, "kept"))]
    row = counts[0]
    for other in counts[1:]:
        row = row.join(F.broadcast(other))  # one row each
    return row.select("rows_read", (F.col("rows_read") - F.col("usable")).alias("rejected"), (F.col("usable") - F.col("deduped")).alias("collisions_and_copies"), (F.col("deduped") - F.col("kept")).alias("duplicate_titles"), "kept")


def community_counts(posts: DataFrame, column: str = "subreddit") -> DataFrame:
    return posts.groupBy(casefold(column).alias("key")).agg(F.count(F.lit(1)).alias("posts"))


def load_communities(raw: DataFrame) -> DataFrame:
    """community_id, name, public_description of the last row of each folded id that has both; ``seq`` is the order read."""
    some = raw.filter("community_id is not null and trim(community_id) <> '' and public_description is not null and trim(public_description) <> ''")
    last = some.groupBy(casefold("community_id").alias("key")).agg(F.max_by(F.struct("community_id", "public_description"), "seq").alias("row"))
    return last.select("key", "row.community_id", F.concat(F.lit("r/"), F.col("row.community_id")).alias("name"), "row.public_description")


def select_eligible(posts: DataFrame, communities: DataFrame, min_posts: int = 20) -> tuple[DataFrame, DataFrame]:
    """Posts and communities that have metadata and ``min_posts`` posts; posts take the metadata's spelling of the community."""
    keyed = posts.withColumn("key", casefold("subreddit"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_posts)
    kept = communities.join(counts.select("key"), "key", "left_semi")
    joined = keyed.drop("subreddit").join(kept.select("key", F.col("community_id").alias("subreddit")), "key")
    return joined.drop("key"), kept.orderBy("key")


def split_communities(communities: DataFrame, seed: int, fraction: float, max_k: int, hash_fn: Hash = blake2b63) -> DataFrame:
    """Adds split_group. The first round-half-even(n * fraction) communities by hash are unseen, at least ``max_k`` on either side.

    The window is global, over the list of communities (thousands), never over posts.
    """
    order = Window.orderBy(hash_fn(seed, "community", F.col("community_id")), "community_id")
    ranked = communities.withColumn("_rank", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    unseen = F.least(F.greatest(F.bround(F.col("_n") * F.lit(fraction)), F.lit(max_k)), F.col("_n") - max_k)
    return ranked.withColumn("split_group", F.when(F.col("_rank") <= unseen, "unseen").otherwise("seen")).drop("_rank", "_n")


def assign_splits(posts: DataFrame, seed: int, train: float, dev: float, by: str = "subreddit", key: str = "post_id", hash_fn: Hash = blake2b63) -> DataFrame:
    """Adds split: within each community, by hash, round-half-even parts that are never empty; unseen communities are all test.

    ``split_group`` of the community must be a column. Ranks are computed per community and hash range (salted by the leading bits of
    the hash), so a community with a third of all posts is ranked by many tasks.
    """
    hashed = posts.withColumn("_h", hash_fn(seed, "post", F.col(key))).withColumn("_range", F.shiftright(F.col("_h"), 52))
    counts = hashed.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy(by).orderBy("_range")
    counts = counts.withColumn("_before", F.sum("_c").over(over) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(by))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy("_h", key))
    ranked = hashed.withColumn("_i", inside).join(counts, [by, "_range"]).withColumn("_rank", F.col("_i") + F.col("_before"))
    n_train = F.least(F.greatest(F.bround(F.col("_n") * F.lit(train)), F.lit(1)), F.col("_n") - 2)
    n_dev = F.least(F.greatest(F.bround(F.col("_n") * F.lit(dev)), F.lit(1)), F.col("_n") - n_train - 1)
    seen = F.when(F.col("_n") < 3, F.raise_error(F.lit("a seen community needs three posts"))).when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_dev, "dev").otherwise("test")
    return ranked.withColumn("split", F.when(F.col("split_group") == "unseen", "test").otherwise(seen)).drop("_h", "_range", "_i", "_before", "_n", "_rank")
