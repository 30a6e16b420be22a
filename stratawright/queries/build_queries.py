"""Build: duplicates, eligibility, splits, vectors, pools, instances, questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawright.functions.hashing import blake2b63, sha256_60
from stratawright.operators import baseline, build, mining
from stratawright.session import ensure_checkpoint_dir, read_table
from stratawright.sources import files

QUERIES, SQL = {}, {}
SEED = 7


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Posts with an order of reading that the other engine can compute too."""
    df = read_table(spark, d, "posts")
    body = F.coalesce("selftext", F.lit(""))
    return df.select("post_id", F.trim("subreddit").alias("subreddit"), F.coalesce("title", F.lit("")).alias("title"), body.alias("selftext"), F.coalesce("created_utc", F.lit(0)).alias("created_utc")).filter("subreddit is not null").withColumn("seq", sha256_60(F.col("post_id"), F.col("title"), F.col("selftext"), F.col("created_utc"), F.col("subreddit")))


_RAW = """raw AS (SELECT post_id, s AS subreddit, t AS title, b AS selftext, c AS created_utc, ('0x' || substr(sha256(post_id || chr(0) || t || chr(0) || b || chr(0) || c::VARCHAR || chr(0) || s), 1, 15))::BIGINT AS seq
  FROM (SELECT post_id, trim(subreddit) AS s, coalesce(title, '') AS t, coalesce(selftext, '') AS b, coalesce(created_utc, 0) AS c FROM posts WHERE subreddit IS NOT NULL))"""
_DEDUPED = (
    _RAW
    + """, deduped AS (SELECT post_id, arg_max(subreddit, r) AS subreddit, arg_max(title, r) AS title, arg_max(selftext, r) AS selftext, arg_max(created_utc, r) AS created_utc FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY length(selftext), seq DESC) AS r, lower(subreddit) AS k FROM raw) GROUP BY post_id HAVING count(DISTINCT k) = 1)"""
)


@query(f"WITH {_DEDUPED} SELECT post_id, subreddit, sha256(title) AS title, length(selftext) AS n, created_utc FROM deduped")
def A1_dedupe_paired(spark, d):
    return build.dedupe_paired(_raw(spark, d)).select("post_id", "subreddit", F.sha2("title", 256).alias("title"), F.length("selftext").cast("bigint").alias("n"), "created_utc")


@query(f"WITH {_RAW} SELECT post_id, arg_min(subreddit, seq) AS subreddit, arg_min(length(selftext), seq) AS n FROM raw GROUP BY post_id")
def A2_dedupe_first(spark, d):
    return build.dedupe_first(_raw(spark, d)).select("post_id", "subreddit", F.length("selftext").cast("bigint").alias("n"))


_FOLD = "replace(lower(title), 'ß', 'ss')"


@query(f"WITH {_DEDUPED} SELECT post_id FROM (SELECT post_id, count(*) OVER (PARTITION BY {_FOLD}) AS n FROM deduped) WHERE n = 1")
def A3_W9_unique_titles(spark, d):
    return build.unique_titles(build.dedupe_paired(_raw(spark, d))).select("post_id")


@query(f"WITH {_DEDUPED}, kept AS (SELECT count(*) AS n FROM (SELECT count(*) AS c FROM deduped GROUP BY lower(title)) WHERE c = 1) SELECT (SELECT count(*) FROM posts) AS rows_read, (SELECT count(*) FROM posts) - (SELECT count(*) FROM raw) AS rejected, (SELECT count(*) FROM raw) - (SELECT count(*) FROM deduped) AS collisions_and_copies, (SELECT count(*) FROM deduped) - (SELECT n FROM kept) AS duplicate_titles, (SELECT n FROM kept) AS kept")
def A4_build_report(spark, d):
    raw = _raw(spark, d)
    deduped = build.dedupe_paired(raw)
    once = deduped.groupBy(F.lower("title").alias("t")).agg(F.count(F.lit(1)).alias("c")).filter("c = 1")
    return build.build_report(read_table(spark, d, "posts"), raw, deduped, once)


@query("SELECT lower(trim(subreddit)) AS key, count(*) AS posts FROM posts WHERE subreddit IS NOT NULL GROUP BY 1")
def A5_community_counts(spark, d):
    return build.community_counts(_raw(spark, d))


@query("""SELECT lower(community_id) AS key, arg_max(community_id, s) AS community_id, 'r/' || arg_max(community_id, s) AS name, arg_max(public_description, s) AS public_description FROM (
  SELECT *, sha256(community_id || public_description) AS s FROM communities WHERE trim(coalesce(community_id, '')) <> '' AND trim(coalesce(public_description, '')) <> '') GROUP BY 1""")
def src_csv_communities(spark, d):
    """Written as CSV in a known order and read back by alias; last row wins per folded id, rows without id or description left out."""
    order = F.sha2(F.concat("community_id", "public_description"), 256)
    folder = written_csv(read_table(spark, d, "communities").select(F.col("community_id").alias("subreddit_name"), F.col("public_description").alias("description"), "split_group").coalesce(1).sortWithinPartitions(order))
    return build.load_communities(files.read_communities(spark, folder)).select("key", "community_id", "name", "public_description")


@query("""SELECT post_id, lower(trim(subreddit)) AS subreddit, coalesce(created_utc, 0) AS created_utc FROM posts WHERE trim(coalesce(subreddit, '')) <> '' AND trim(coalesce(title, '')) <> ''
  AND lower(trim(coalesce(selftext, ''))) NOT IN ('[deleted]', '[removed]') AND regexp_matches(regexp_replace(coalesce(selftext, ''), '(?i)https?://\\S+|www\\.\\S+', '', 'g'), '[\\p{L}\\p{N}]')""")
def src_csv_posts(spark, d):
    """Written as CSV under other names of the columns and read back by alias: the usable posts."""
    rows = read_table(spark, d, "posts").select(F.concat(F.lit("t3_"), "post_id").alias("reddit_id"), F.col("subreddit").alias("label"), F.col("title").alias("Title"), F.col("selftext").alias("body"), F.col("created_utc").cast("string").alias("created_at"))
    usable = files.read_posts(spark, [written_csv(rows)])[1]
    return usable.select("post_id", F.lower("subreddit").alias("subreddit"), "created_utc")


def written_csv(df: DataFrame) -> str:
    """The folder, below the shared checkpoint folder, into which the rows were written as CSV."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stratawright-{df.sparkSession.sparkContext.applicationId}/csv-{uuid.uuid4().hex}"
    df.write.csv(folder, header=True, escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return folder


_COMMUNITIES = "comm AS (SELECT lower(community_id) AS key, min(community_id) AS community_id, min(name) AS name, coalesce(max(public_description), '') AS public_description, min(split_group) AS split_group FROM communities GROUP BY 1)"


def _communities(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "communities")
    return c.groupBy(F.lower("community_id").alias("key")).agg(F.min("community_id").alias("community_id"), F.min("name").alias("name"), F.coalesce(F.max("public_description"), F.lit("")).alias("public_description"), F.min("split_group").alias("split_group"))


@query(f"WITH {_RAW}, {_COMMUNITIES}, big AS (SELECT lower(subreddit) AS key FROM raw GROUP BY 1 HAVING count(*) >= 20) SELECT raw.post_id, comm.community_id AS subreddit, raw.created_utc FROM raw JOIN comm ON comm.key = lower(raw.subreddit) JOIN big ON big.key = comm.key")
def J1_f_min_posts(spark, d):
    posts, _ = build.select_eligible(_raw(spark, d), _communities(spark, d), 20)
    return posts.select("post_id", "subreddit", "created_utc")


@query(f"WITH {_COMMUNITIES}, ranked AS (SELECT community_id, row_number() OVER (ORDER BY ('0x' || substr(sha256('{SEED}' || chr(0) || 'community' || chr(0) || community_id), 1, 15))::BIGINT, community_id) AS r, count(*) OVER () AS n FROM comm) SELECT community_id, CASE WHEN r <= least(greatest(round_even(n * 0.2, 0), 8), n - 8) THEN 'unseen' ELSE 'seen' END AS split_group FROM ranked")
def W2_split_communities(spark, d):
    c = _communities(spark, d).drop("split_group")
    return build.split_communities(c, SEED, 0.2, 8, sha256_60).select("community_id", "split_group")


@query(f"""WITH ranked AS (SELECT c_custkey, n_name, row_number() OVER (PARTITION BY n_name ORDER BY ('0x' || substr(sha256('{SEED}' || chr(0) || 'post' || chr(0) || c_custkey::VARCHAR), 1, 15))::BIGINT, c_custkey) AS r, count(*) OVER (PARTITION BY n_name) AS n
  FROM customer JOIN nation ON n_nationkey = c_nationkey), parts AS (SELECT *, least(greatest(round_even(n * 0.8, 0), 1), n - 2) AS t FROM ranked)
  SELECT c_custkey, n_name, CASE WHEN n_name < 'C' THEN 'test' WHEN r <= t THEN 'train' WHEN r <= t + least(greatest(round_even(n * 0.1, 0), 1), n - t - 1) THEN 'dev' ELSE 'test' END AS split FROM parts""")
def W1_J2_assign_splits(spark, d):
    c, n = read_table(spark, d, "customer"), read_table(spark, d, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name").withColumn("split_group", F.when(F.col("n_name") < "C", "unseen").otherwise("seen"))
    return build.assign_splits(rows, SEED, 0.8, 0.1, "n_name", "c_custkey", sha256_60).select("c_custkey", "n_name", "split")


@query(f"WITH {_COMMUNITIES} SELECT p.post_id, comm.split_group FROM posts p JOIN comm ON comm.key = lower(trim(p.subreddit))")
def J2_split_group(spark, d):
    posts = _raw(spark, d).withColumn("key", F.lower("subreddit"))
    return posts.join(_communities(spark, d), "key").select("post_id", "split_group")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("community_id"), F.col("embedding").alias("vector"))
    means = mining.mean_vectors(e, "community_id", "vector")
    return means.withColumn("track", F.when(F.substring("community_id", 2, 9).cast("int") < 7, "seen").otherwise("unseen"))


_VECTORS = "vec AS (SELECT 'c' || label AS id, CASE WHEN label < 7 THEN 'seen' ELSE 'unseen' END AS track, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY label)"
_RANKED = f"{_VECTORS}, pairs AS (SELECT a.track, a.id AS target, b.id AS candidate, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM vec a JOIN vec b ON a.track = b.track AND a.id <> b.id), ranked AS (SELECT *, row_number() OVER (PARTITION BY track, target ORDER BY s DESC, candidate) AS rank FROM pairs)"


@query("""WITH one AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label), mean AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label < 7) GROUP BY 1, 2) GROUP BY label),
  every AS (SELECT label, v FROM mean UNION ALL SELECT label, list_transform(v, lambda x: x::DOUBLE) FROM one WHERE label >= 7) SELECT 'c' || label AS community_id, len(v)::BIGINT AS d, round(v[1], 6) AS first, round(v[64], 6) AS last FROM every""")
def A6_U7_community_vectors(spark, d):
    """Some communities by the mean of their vectors, the others by one vector of their own."""
    e = read_table(spark, d, "embeddings").withColumn("community_id", F.concat(F.lit("c"), F.col("label").cast("string"))).withColumn("vector", F.transform("embedding", lambda x: x.cast("double")))
    own = e.filter("label >= 7").groupBy("community_id").agg(F.min_by("vector", "vec_id").alias("vector"))
    v = F.col("vector")
    both = mining.community_vectors(e.filter("label < 7"), own)
    return both.select("community_id", F.size(v).cast("bigint").alias("d"), F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"))


@query(f"WITH {_RANKED} SELECT track, target, candidate, round(s, 6) AS similarity, rank::BIGINT AS rank FROM ranked")
def J8_W4_hard_rank(spark, d):
    return mining.hard_ranks(mining.similar_pairs(_vectors(spark, d)), 9).select("track", "target", "candidate", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _hash(name: str) -> str:
    return f"('0x' || substr(sha256('{SEED}' || chr(0) || '{name}' || chr(0) || target || chr(0) || candidate), 1, 15))::BIGINT"


_POOLS = f"""{_RANKED}, pool AS (
  SELECT track, target, 'random' AS difficulty, string_agg(candidate, '|' ORDER BY {_hash("random")}, candidate) AS pool FROM ranked GROUP BY 1, 2
  UNION ALL SELECT track, target, 'semantic', string_agg(candidate, '|' ORDER BY {_hash("semantic")}, candidate) FROM ranked WHERE rank <= 3 GROUP BY 1, 2
  UNION ALL SELECT track, target, 'hard', string_agg(candidate, '|' ORDER BY rank) FROM ranked GROUP BY 1, 2)"""


@query(f"WITH {_POOLS} SELECT track || ':' || target || ':' || difficulty AS pool_id, track AS community_track, target, difficulty, CASE WHEN difficulty = 'random' THEN 'random' WHEN track = 'seen' THEN difficulty || '_content' ELSE difficulty || '_description' END AS mining_strategy, pool AS negative_pool FROM pool")
def M4_W5_W6_pools(spark, d):
    pools = mining.negative_pools(mining.similar_pairs(_vectors(spark, d)), SEED, 3, sha256_60, 9)
    return pools.withColumn("negative_pool", F.array_join("negative_pool", "|"))


_CLEAN = "clean AS (SELECT DISTINCT post_id, lower(trim(subreddit)) AS subreddit, lower(trim(split)) AS split FROM posts WHERE split IS NOT NULL AND subreddit IS NOT NULL)"


def _clean(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "posts").filter("split is not null and subreddit is not null")
    return p.select("post_id", F.lower(F.trim("subreddit")).alias("subreddit"), F.lower(F.trim("split")).alias("split")).distinct()


@query(f"WITH {_CLEAN} SELECT post_id, subreddit AS target, split, difficulty, 'seen:' || subreddit || ':' || difficulty AS pool_id, ('0x' || substr(sha256('{SEED}' || chr(0) || post_id || chr(0) || difficulty), 1, 15))::BIGINT AS shuffle_seed FROM clean CROSS JOIN (SELECT unnest(['random', 'semantic', 'hard']) AS difficulty) WHERE split <> 'train'")
def M4_instances(spark, d):
    rows = mining.instances(_clean(spark, d).withColumn("split_group", F.lit("seen")), SEED, sha256_60)
    return rows.drop("community_track")


@query(f"WITH {_CLEAN}, numbered AS (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY ('0x' || substr(sha256('{SEED}' || chr(0) || 'evaluation' || chr(0) || post_id), 1, 15))::BIGINT, post_id) AS n FROM clean WHERE split = 'test') SELECT post_id, subreddit AS target FROM numbered WHERE n <= 3")
def W3_select_posts(spark, d):
    rows = mining.instances(_clean(spark, d).withColumn("split_group", F.lit("seen")), SEED, sha256_60)
    return mining.select_posts(rows, SEED, 3, sha256_60).select("post_id", "target")


_INST = "inst AS (SELECT DISTINCT post_id, target, community_track, difficulty, pool_id, shuffle_seed FROM instances WHERE shuffle_seed IS NOT NULL AND difficulty IS NOT NULL)"
_POOL1 = "pools AS (SELECT pool_id, negative_pool AS pool FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY coalesce(mining_strategy, ''), array_to_string(negative_pool, ',')) AS n FROM negative_pools) WHERE n = 1)"


def _instances(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "instances").filter("shuffle_seed is not null and difficulty is not null").select("post_id", "target", "community_track", "difficulty", "pool_id", "shuffle_seed").distinct()


def _pools(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct(F.coalesce("mining_strategy", F.lit("")), F.array_join("negative_pool", ","))
    return read_table(spark, d, "negative_pools").groupBy("pool_id").agg(F.min_by("negative_pool", order).alias("negative_pool"))


@query(f"WITH {_INST}, {_POOL1} SELECT post_id, difficulty, inst.pool_id, len(pool)::BIGINT AS size FROM inst JOIN pools ON pools.pool_id = inst.pool_id")
def J3_pool_lookup(spark, d):
    return _instances(spark, d).join(_pools(spark, d), "pool_id").select("post_id", "difficulty", "pool_id", F.size("negative_pool").cast("bigint").alias("size"))


@query(f"WITH {_INST} SELECT p.post_id, inst.difficulty, inst.shuffle_seed FROM (SELECT DISTINCT post_id FROM posts WHERE lower(trim(split)) = 'test') p JOIN inst ON inst.post_id = p.post_id")
def J4_seed_lookup(spark, d):
    chosen = read_table(spark, d, "posts").filter("lower(trim(split)) = 'test'").select("post_id").distinct()
    return chosen.join(_instances(spark, d), "post_id").select("post_id", "difficulty", "shuffle_seed")


@query("SELECT post_id, subreddit, split FROM posts WHERE post_id IN (SELECT post_id FROM instances)")
def J5_src_parquet_filtered(spark, d):
    return read_table(spark, d, "posts").join(read_table(spark, d, "instances").select("post_id"), "post_id", "left_semi").select("post_id", "subreddit", "split")


_NAMED = """names AS (SELECT community_id, min(name) AS name FROM communities GROUP BY 1)"""


@query(f"""WITH {_INST}, {_POOL1}, {_NAMED}, c AS (SELECT post_id, target, community_track, difficulty, shuffle_seed, k, unnest(list_prepend(target, pool[1:k - 1])) AS candidate FROM inst JOIN pools ON pools.pool_id = inst.pool_id CROSS JOIN (SELECT unnest([4, 16]) AS k)),
  h AS (SELECT c.*, names.name, ('0x' || substr(sha256(shuffle_seed::VARCHAR || chr(0) || k::VARCHAR || chr(0) || 'candidate' || chr(0) || candidate), 1, 15))::BIGINT AS h FROM c LEFT JOIN names ON names.community_id = candidate),
  placed AS (SELECT *, row_number() OVER (PARTITION BY post_id, target, community_track, difficulty, k ORDER BY h, candidate) AS place FROM h),
  listed AS (SELECT post_id, community_track, difficulty, k, string_agg(candidate, '|' ORDER BY place) AS candidates, string_agg(coalesce(name, '?'), '|' ORDER BY place) AS names, string_agg(printf('option_%02d', place), '|' ORDER BY place) AS options FROM placed GROUP BY post_id, target, community_track, difficulty, k)
  SELECT post_id || '|' || t || '|' || r || '|' || community_track || '|' || difficulty || '|' || k AS prediction_id, candidates, CASE WHEN r = 'name-only' THEN names ELSE options END AS labels
  FROM listed, (SELECT unnest(['title', 'title+selftext']) AS t), (SELECT unnest(['name-only', 'anonymous-id+description']) AS r)""")
def J6_J9_questions(spark, d):
    """Question matrix of all instances, two candidate counts, both representations and both text modes: candidates in display order with their labels."""
    rows, pools, named = _instances(spark, d), _pools(spark, d), _named(spark, d)
    asked = mining.questions(rows.select("post_id").distinct(), rows, pools, named, [4, 16], ["name-only", "anonymous-id+description"], ["title", "title+selftext"], sha256_60)
    return asked.select("prediction_id", F.array_join("candidates", "|").alias("candidates"), F.array_join("labels", "|", "?").alias("labels"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "communities").groupBy("community_id").agg(F.min("name").alias("name"), F.max("public_description").alias("public_description"))


@query(f"""WITH {_INST} SELECT post_id || '|' || t || '|' || r || '|' || community_track || '|' || difficulty || '|' || k AS prediction_id FROM inst, (SELECT unnest(['title', 'title+selftext']) AS t), (SELECT unnest(['name-only', 'anonymous-id+description']) AS r), (SELECT unnest([4, 16]) AS k)
  WHERE hash(0) = hash(0) AND ('0x' || substr(sha256(post_id), 1, 2))::INTEGER >= 128""")
def J7_J9_remaining(spark, d):
    """Questions of the matrix that a first half of the posts has not answered yet."""
    cross = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(r).alias("r"), F.lit(k).alias("k")) for t in ("title", "title+selftext") for r in ("name-only", "anonymous-id+description") for k in (4, 16)]))
    asked = _instances(spark, d).withColumn("m", cross).select("post_id", F.concat_ws("|", "post_id", "m.t", "m.r", "community_track", "difficulty", F.col("m.k").cast("string")).alias("prediction_id"))
    done = asked.filter(F.conv(F.substring(F.sha2("post_id", 256), 1, 2), 16, 10).cast("int") < 128)
    return mining.remaining(asked, done).select("prediction_id")


@query(f"WITH {_INST} SELECT post_id, count(*) AS size, string_agg(difficulty, ',' ORDER BY difficulty) AS difficulties FROM inst GROUP BY post_id")
def A22_batch_group(spark, d):
    asked = _instances(spark, d).select("post_id", F.lit("title").alias("text_mode"), F.lit("name-only").alias("representation"), F.lit(4).alias("k"), F.col("difficulty").alias("qid"))
    return mining.batches(asked).select("post_id", "size", F.array_join("qids", ",").alias("difficulties"))


@query("SELECT DISTINCT post_id FROM posts WHERE lower(trim(split)) = 'train' AND post_id NOT IN (SELECT post_id FROM instances) AND lower(trim(subreddit)) IN (SELECT lower(community_id) FROM communities)")
def J11_training_posts(spark, d):
    """Train posts without the evaluated ones, of known communities."""
    posts = read_table(spark, d, "posts").select("post_id", F.lower(F.trim("subreddit")).alias("subreddit"), F.lower(F.trim("split")).alias("split"))
    known = read_table(spark, d, "communities").select(F.lower("community_id").alias("community_id"))
    return baseline.training_posts(posts, read_table(spark, d, "instances"), known).select("post_id").distinct()


@query("SELECT subreddit, post_id FROM (SELECT DISTINCT lower(trim(subreddit)) AS subreddit, post_id FROM posts WHERE lower(trim(split)) = 'train' AND subreddit IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY ('0x' || substr(sha256('baseline' || chr(0) || post_id), 1, 15))::BIGINT, post_id) <= 200")
def W10_baseline_sample(spark, d):
    """At most 200 train posts per community by stable hash."""
    rows = read_table(spark, d, "posts").filter("lower(trim(split)) = 'train' and subreddit is not null").select(F.lower(F.trim("subreddit")).alias("subreddit"), "post_id").distinct()
    return baseline.sample_per_community(rows, 200, "baseline", sha256_60).select("subreddit", "post_id")


@query(f"""WITH {_DEDUPED}, {_COMMUNITIES}, uniq AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {_FOLD}) AS titles FROM deduped) WHERE titles = 1), big AS (SELECT lower(subreddit) AS key FROM uniq GROUP BY 1 HAVING count(*) >= 8),
  eligible AS (SELECT comm.key, comm.community_id FROM comm JOIN big ON big.key = comm.key),
  groups AS (SELECT key, community_id, CASE WHEN r <= least(greatest(round_even(n * 0.2, 0), 8), n - 8) THEN 'unseen' ELSE 'seen' END AS split_group FROM (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(sha256('{SEED}' || chr(0) || 'community' || chr(0) || community_id), 1, 15))::BIGINT, community_id) AS r, count(*) OVER () AS n FROM eligible)),
  ranked AS (SELECT post_id, community_id AS subreddit, split_group, row_number() OVER (PARTITION BY community_id ORDER BY ('0x' || substr(sha256('{SEED}' || chr(0) || 'post' || chr(0) || post_id), 1, 15))::BIGINT, post_id) AS r, count(*) OVER (PARTITION BY community_id) AS n FROM uniq JOIN groups ON groups.key = lower(uniq.subreddit)),
  parts AS (SELECT *, least(greatest(round_even(n * 0.8, 0), 1), n - 2) AS t FROM ranked)
  SELECT post_id, subreddit, split_group, CASE WHEN split_group = 'unseen' THEN 'test' WHEN r <= t THEN 'train' WHEN r <= t + least(greatest(round_even(n * 0.1, 0), 1), n - t - 1) THEN 'dev' ELSE 'test' END AS split FROM parts""")
def M6_build_dataset(spark, d):
    """The whole chain of the build, from copies to splits, with the hash that both engines have."""
    unique = build.unique_titles(build.dedupe_paired(_raw(spark, d)))
    posts, communities = build.select_eligible(unique, _communities(spark, d).drop("split_group"), 8)
    groups = build.split_communities(communities, SEED, 0.2, 8, sha256_60)
    joined = posts.join(groups.select(F.col("community_id").alias("subreddit"), "split_group"), "subreddit")
    return build.assign_splits(joined, SEED, 0.8, 0.1, hash_fn=sha256_60).select("post_id", "subreddit", "split_group", "split")
