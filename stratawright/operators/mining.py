"""Community vectors, negative pools and instances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawright.functions.hashing import Hash, blake2b63, hash_each
from stratawright.functions.vectors import dot, l2_normalize
from stratawright.session import wide

#: Most bytes of vectors that every task may hold.
HELD_BYTES = 64_000_000
DIFFICULTIES = ("random", "semantic", "hard")


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key, by a vector aggregate: each task sums whole vectors, one partial sum per key is exchanged."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = rows.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    return vectors.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("vector"))


def community_vectors(train_vectors: DataFrame, description_vectors: DataFrame) -> DataFrame:
    """community_id, vector: seen communities by the mean of their train posts, unseen ones by their description."""
    return mean_vectors(train_vectors, "community_id", "vector").unionByName(description_vectors.select("community_id", "vector"))


def missing_vectors(communities: DataFrame, vectors: DataFrame) -> DataFrame:
    return communities.select("community_id").join(vectors, "community_id", "left_anti")


def similar_pairs(vectors: DataFrame) -> DataFrame:
    """track, target, candidate, similarity of all ordered pairs of a track: its square, because each target's pool is all of its track.

    While the vectors take at most HELD_BYTES, each task multiplies batches of them with all that it holds; beyond, tracks meet in a join.
    """
    number, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if number * (8 * width + 64) <= HELD_BYTES:
        return _multiplied(vectors)
    unit = vectors.select("track", "community_id", l2_normalize(F.col("vector")).alias("v"))
    left = unit.toDF("track", "target", "a")
    right = unit.toDF("track", "candidate", "b")
    return left.join(right, "track").filter("target <> candidate").select("track", "target", "candidate", dot(F.col("a"), F.col("b")).alias("similarity"))


def _multiplied(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("track", "community_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    held = vectors.sparkSession.sparkContext.broadcast(rows.toPandas())  # at most HELD_BYTES

    def unit(frame: pd.DataFrame) -> np.ndarray:
        matrix = np.stack(frame["vector"].to_numpy())
        return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracks = {track: (part["community_id"].to_numpy(), unit(part)) for track, part in held.value.groupby("track")}
        for frame in frames:
            for track, part in frame.groupby("track"):
                names, matrix = tracks[track]
                for at in range(0, len(part), 64):
                    some = part.iloc[at : at + 64]
                    target = np.repeat(some["community_id"].to_numpy(), len(names))
                    candidate = np.tile(names, len(some))
                    other = target != candidate
                    yield pd.DataFrame({"track": track, "target": target[other], "candidate": candidate[other], "similarity": (unit(some) @ matrix.T).ravel()[other]})

    kind = vectors.schema["community_id"].dataType.simpleString()
    return rows.repartition(vectors.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, f"track string, target {kind}, candidate {kind}, similarity double")


def hard_ranks(pairs: DataFrame, digits: int | None = None) -> DataFrame:
    """Adds rank: most similar first, of equals the lower id. ``digits`` rounds similarities first."""
    value = F.round("similarity", digits) if digits is not None else F.col("similarity")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("track", "target").orderBy(value.desc(), "candidate")))


def negative_pools(pairs: DataFrame, seed: int, semantic_size: int, hash_fn: Hash = blake2b63, digits: int | None = None) -> DataFrame:
    """pool_id, community_track, target, difficulty, mining_strategy, negative_pool.

    hard: all candidates by similarity; semantic: the nearest ``semantic_size``, permuted; random: all, permuted.
    """
    ranked = hard_ranks(pairs, digits)

    def pool(rows: DataFrame, difficulty: str, order: list) -> DataFrame:
        listed = rows.groupBy("track", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("candidate")))), lambda s: s["candidate"]).alias("negative_pool"))
        return listed.withColumn("difficulty", F.lit(difficulty))

    def permuted(name: str) -> list:
        return [hash_fn(seed, name, F.col("target"), F.col("candidate")).alias("h")]

    pools = (
        pool(ranked, "random", permuted("random"))
        .unionByName(pool(ranked.filter(F.col("rank") <= semantic_size), "semantic", permuted("semantic")))
        .unionByName(pool(ranked, "hard", [F.col("rank")]))
    )
    source = F.when(F.col("track") == "seen", "content").otherwise("description")
    strategy = F.when(F.col("difficulty") == "random", "random").otherwise(F.concat_ws("_", "difficulty", source))
    return pools.select(F.concat_ws(":", "track", "target", "difficulty").alias("pool_id"), F.col("track").alias("community_track"), "target", "difficulty", strategy.alias("mining_strategy"), "negative_pool")


def instances(posts: DataFrame, seed: int, hash_fn: Hash = blake2b63) -> DataFrame:
    """One row per post outside train and difficulty, with pool_id and shuffle_seed."""
    rows = posts.filter("split <> 'train'").withColumn("difficulty", F.explode(F.array(*map(F.lit, DIFFICULTIES))))
    return rows.select("post_id", F.col("subreddit").alias("target"), F.col("split_group").alias("community_track"), "split", "difficulty", F.concat_ws(":", "split_group", "subreddit", "difficulty").alias("pool_id"), hash_fn(seed, F.col("post_id"), F.col("difficulty")).alias("shuffle_seed"))


def select_posts(rows: DataFrame, seed: int, per_community: int, hash_fn: Hash = blake2b63) -> DataFrame:
    """The first ``per_community`` test posts of each target by hash, from the random instances."""
    wanted = rows.filter("difficulty = 'random' and split = 'test'")
    order = Window.partitionBy("target").orderBy(hash_fn(seed, "evaluation", F.col("post_id")), "post_id")
    return wanted.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_community).select("post_id", "target", "community_track")


REPRESENTATIONS = ("name-only", "anonymous-id+description")


def candidates_for_k(target: Column, pool: Column, k: Column, length: Column | None = None) -> Column:
    """Target and the first k - 1 negatives of the pool; k < 2 or a short pool is an error. ``length``: of the pool, if ``pool`` is its beginning only."""
    bad = (k < 2) | ((F.size(pool) if length is None else length) < k - 1)
    return F.when(bad, F.raise_error(F.lit("k below 2 or pool too small"))).otherwise(F.concat(F.array(target), F.slice(pool, F.lit(1), (k - 1).cast("int"))))


def _named_pools(pools: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """pool_id, list (number of the list among those of its id), length, named (the first ``most`` ids with name and description), times (equal rows), pools (rows of the id)."""
    of_id = Window.partitionBy("pool_id")
    once = pools.groupBy("pool_id", "negative_pool").agg(F.count(F.lit(1)).alias("times")).withColumn("list", F.row_number().over(of_id.orderBy("negative_pool"))).withColumn("pools", F.sum("times").over(of_id))
    few = once.select("pool_id", "list", "times", "pools", F.size("negative_pool").alias("length"), F.slice("negative_pool", F.lit(1), F.lit(most)).alias("ids")).filter("length >= 0")
    each = few.select("*", F.posexplode_outer("ids").alias("place", "candidate")).drop("ids")
    item = F.when(F.col("place").isNotNull(), F.struct("place", "candidate", "name", "public_description", F.coalesce("known", F.lit(False)).alias("known")))
    return each.join(known, "candidate", "left").groupBy("pool_id", "list", "length", "times", "pools").agg(F.array_sort(F.collect_list(item)).alias("named"))


def _hint(df: DataFrame, size: Column) -> str:
    """How to join ``df``: by broadcast if its rows take at most HELD_BYTES by ``size``, else by exchange, whatever Spark guesses of it."""
    return "broadcast" if (df.agg(F.sum(size + 64)).first()[0] or 0) <= HELD_BYTES else "merge"


def questions(selected: DataFrame, rows: DataFrame, pools: DataFrame, communities: DataFrame, counts: list[int], representations: list[str], text_modes: list[str], hash_fn: Hash = blake2b63) -> DataFrame:
    """The question matrix: selected posts x difficulties x K x representations x text modes, with candidates in display order.

    The matrix is a literal array. Candidates get names and descriptions once per pool, before pools meet posts, and are ordered inside their array, so
    no exchange carries their texts by post. Posts are brought together before they get those; while the pools take at most HELD_BYTES, a post's questions stay in one partition.
    Nothing that grows with the posts is ever broadcast: Spark guesses rows behind an explode as few.
    """
    if unknown := sorted(set(representations) - set(REPRESENTATIONS)):
        raise ValueError(f"unknown representations: {unknown}")
    keys = ["post_id", "target", "community_track", "difficulty"]
    known = communities.select(F.col("community_id").alias("candidate"), "name", "public_description", F.lit(True).alias("known"))
    letters = lambda x: 4 * sum(F.coalesce(F.length(x[n]), F.lit(0)) for n in ("candidate", "name", "public_description"))
    lists = _named_pools(pools.select("pool_id", "negative_pool"), known, max(0, max(counts) - 1))
    hint = _hint(lists, F.aggregate("named", F.lit(0), lambda n, x: n + letters(x) + 64))
    own = known.withColumnRenamed("candidate", "target").hint(_hint(known, letters(F.struct("candidate", "name", "public_description"))))

    kept = rows.join(selected.select("post_id").hint("merge"), "post_id", "left_semi")
    drawn = kept.join(lists.select("pool_id", "list", "length", F.transform("named", lambda x: x["candidate"]).alias("ids")).hint(hint), "pool_id")
    hashes = [
        F.struct(F.lit(k).alias("k"), hash_each(hash_fn, [F.col("shuffle_seed"), k, "candidate"], candidates_for_k(F.col("target"), F.col("ids"), F.lit(k), F.col("length"))).alias("h"))
        for k in counts
    ]
    # Behind Python Spark knows no partitioning any more; what is exchanged here is ids and numbers.
    base = drawn.select(*keys, "pool_id", "list", F.array(*hashes).alias("hashes")).repartition(wide(rows.sparkSession), "post_id")
    base = base.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    full = base.join(lists.drop("length").hint(hint), ["pool_id", "list"]).join(own, "target", "left").select("*", F.inline("hashes"))
    first = F.struct(F.lit(-1).alias("place"), F.col("target").alias("candidate"), "name", "public_description", F.coalesce("known", F.lit(False)).alias("known"))
    chosen = F.concat(F.array(first), F.filter("named", lambda x: x["place"] < F.col("k") - 1))
    unknown = lambda x: F.raise_error(F.concat(F.lit("no such community: "), x["candidate"]))
    placed = lambda h, x: F.struct(h.alias("h"), F.when(x["known"], x["candidate"]).otherwise(unknown(x)).alias("candidate"), x["name"].alias("name"), x["public_description"].alias("public_description"))
    ordered = full.select(*keys, "k", "rows", "pools", "times", F.array_sort(F.zip_with("h", chosen, placed)).alias("items"))
    # Several rows of one post, target and difficulty, or several pools of one id, are one question together.
    single = (F.col("rows") == 1) & (F.col("pools") == 1)
    several = ordered.filter(~single).groupBy(*keys, "k").agg(F.array_sort(F.flatten(F.collect_list(F.flatten(F.array_repeat("items", F.col("times").cast("int")))))).alias("items"))
    found = ordered.filter(single).select(*keys, "k", "items").unionByName(several)
    matrix = F.explode(F.array(*[F.struct(F.lit(r).alias("representation"), F.lit(t).alias("text_mode")) for r in representations for t in text_modes]))
    asked = found.withColumn("m", matrix).select("*", "m.*").drop("m")
    labels = F.when(F.col("representation") == "name-only", F.col("items.name")).otherwise(F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.format_string("option_%02d", i)))
    texts = F.when(F.col("representation") == "name-only", F.col("items.name")).otherwise(F.col("items.public_description"))
    qid = F.concat_ws("|", "text_mode", "representation", "community_track", "difficulty", F.col("k").cast("string"))
    return asked.select(
        F.concat_ws("|", "post_id", qid).alias("prediction_id"), qid.alias("qid"), "post_id", "target", "text_mode", "representation", "community_track", "difficulty", "k",
        F.col("items.candidate").alias("candidates"), labels.alias("labels"), texts.alias("texts"),
    )


def remaining(asked: DataFrame, done: DataFrame) -> DataFrame:
    """Questions without a prediction yet; both sides are exchanged, because Spark's guess of rows behind an explode would broadcast millions of ids."""
    return asked.join(done.select("prediction_id").hint("merge"), "prediction_id", "left_anti")


def batches(asked: DataFrame) -> DataFrame:
    """Questions that are sent together: those of one post, text mode, representation and K."""
    return asked.groupBy("post_id", "text_mode", "representation", "k").agg(F.array_sort(F.collect_list("qid")).alias("qids"), F.count(F.lit(1)).alias("size"))
