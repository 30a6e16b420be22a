"""Scalar functions, filters, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawright.functions import answers, text
from stratawright.functions.hashing import sha256_60
from stratawright.functions.vectors import cosine, dot, l2_normalize
from stratawright.operators import metrics
from stratawright.operators.mining import candidates_for_k
from stratawright.session import read_table

QUERIES, SQL = {}, {}
#: Python white space in the other engine's regular expressions.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "posts")


@query("SELECT post_id, CASE WHEN trim(coalesce(selftext, '')) <> '' THEN trim(selftext) WHEN trim(coalesce(title, '')) <> '' THEN trim(title) ELSE '' END AS first FROM (SELECT post_id, regexp_replace(selftext, '^" + _WS + "+|" + _WS + "+$', '', 'g') selftext, regexp_replace(title, '^" + _WS + "+|" + _WS + "+$', '', 'g') title FROM posts)")
def fn_first_nonblank(spark, d):
    df = _posts(spark, d)
    return df.select("post_id", text.first_nonblank(df, ["text", "selftext", "title"]).alias("first"))


@query()
def fn_normalize_title(spark, d):
    return _posts(spark, d).select("post_id", text.normalize_title("title").alias("title"))


@query()
def fn_clean_body(spark, d):
    return _posts(spark, d).select("post_id", text.clean_body("selftext").alias("selftext"))


@query("SELECT doc_id, replace(lower(nfc_normalize(lang)), 'ß', 'ss') AS folded, length(lang) AS n FROM documents WHERE lang IS NOT NULL")
def fn_casefold(spark, d):
    return read_table(spark, d, "documents").filter("lang is not null").select("doc_id", text.casefold("lang").alias("folded"), F.length("lang").cast("bigint").alias("n"))


@query("SELECT post_id, title AS title_text, CASE WHEN coalesce(selftext, '') <> '' THEN title || chr(10) || chr(10) || selftext ELSE title END AS train_text FROM posts WHERE title IS NOT NULL")
def fn_post_text(spark, d):
    df = _posts(spark, d).filter("title is not null")
    return df.select("post_id", text.post_text("title", "selftext", "title").alias("title_text"), text.train_text("title", "selftext").alias("train_text"))


@query("SELECT post_id, CASE WHEN regexp_full_match(regexp_replace(lower(post_id), '^t3_', ''), '[a-z0-9]+') THEN regexp_replace(lower(post_id), '^t3_', '') ELSE '?' END AS id, regexp_extract('/r/x/comments/' || lower(post_id) || '/t/', '/comments/([a-z0-9]+)(?:/|$)', 1) AS linked FROM instances")
def fn_extract_post_id(spark, d):
    df = read_table(spark, d, "instances")
    none = F.lit(None).cast("string")
    link = F.concat(F.lit("/r/x/comments/"), F.lower("post_id"), F.lit("/t/"))
    digest = F.lit("c"), F.lit("t"), F.lit(0)
    linked = text.extract_post_id(none, link, *digest)
    return df.select("post_id", F.coalesce(text.extract_post_id(F.col("post_id"), none, *digest), F.lit("?")).alias("id"), F.when(F.length(linked) == 64, "").otherwise(linked).alias("linked"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS iso, (event_id * 7 + 1600000000)::BIGINT AS number, 0::BIGINT AS empty FROM events")
def fn_parse_created(spark, d):
    ev = read_table(spark, d, "events")
    iso = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    number = (F.col("event_id") * 7 + 1600000000).cast("string")
    return ev.select("event_id", text.parse_created(iso).alias("iso"), text.parse_created(F.concat(number, F.lit(".5"))).alias("number"), text.parse_created(F.lit(" ")).alias("empty"))


@query("SELECT event_id, ('0x' || substr(sha256('7' || chr(0) || 'post' || chr(0) || event_id::VARCHAR), 1, 15))::BIGINT AS h FROM events")
def fn_stable_uint_sha(spark, d):
    return read_table(spark, d, "events").select("event_id", sha256_60(7, "post", F.col("event_id")).alias("h"))


@query()
def fn_stable_uint(spark, d):
    """The contract's hash; golden values in the tests."""
    from stratawright.functions.hashing import blake2b63

    return read_table(spark, d, "events").select("event_id", blake2b63(7, "post", F.col("event_id")).alias("h"))


@query("SELECT vec_id, round(list_dot_product(e, e), 5) AS squared, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, len(e)::BIGINT AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def fn_l2_normalize(spark, d):
    e = F.col("embedding")
    return read_table(spark, d, "embeddings").select("vec_id", F.round(dot(e, e), 5).alias("squared"), F.round(l2_normalize(e)[0], 6).alias("first"), F.size(e).cast("bigint").alias("d"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn_cosine(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("SELECT DISTINCT pool_id, community_track || ':' || target || ':' || difficulty AS rebuilt, CASE WHEN difficulty = 'random' THEN 'random' ELSE difficulty || '_' || CASE WHEN community_track = 'seen' THEN 'content' ELSE 'description' END END AS strategy, 'r/' || target AS name FROM negative_pools")
def fn_keys_and_strategy(spark, d):
    """Pool ids, mining strategies and community names."""
    df = read_table(spark, d, "negative_pools")
    strategy = F.when(F.col("difficulty") == "random", "random").otherwise(F.concat_ws("_", "difficulty", F.when(F.col("community_track") == "seen", "content").otherwise("description")))
    return df.select("pool_id", F.concat_ws(":", "community_track", "target", "difficulty").alias("rebuilt"), strategy.alias("strategy"), text.community_name("target").alias("name")).distinct()


_FIRST_POOLS = "(SELECT pool_id, target, negative_pool AS pool FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY coalesce(mining_strategy, ''), array_to_string(negative_pool, ',')) n FROM negative_pools) WHERE n = 1)"


@query(f"""SELECT pool_id, k, array_to_string(c, '|') AS candidates, (list_position(c, target) - 1)::INTEGER AS position, sha256(array_to_string(c, chr(0))) AS fingerprint FROM (
  SELECT pool_id, target, k, list_prepend(target, pool[1:k - 1]) AS c FROM {_FIRST_POOLS} CROSS JOIN (SELECT unnest([4, 16]) AS k) WHERE len(pool) >= k - 1)""")
def fn_candidates_for_k(spark, d):
    """Target and pool prefix, target position and fingerprint, for K = 4 and 16."""
    order = F.struct(F.coalesce("mining_strategy", F.lit("")), F.array_join("negative_pool", ","))
    pools = read_table(spark, d, "negative_pools").groupBy("pool_id").agg(F.min_by(F.struct("target", "negative_pool"), order).alias("r")).select("pool_id", "r.*")
    asked = pools.withColumn("k", F.explode(F.array(F.lit(4), F.lit(16)))).filter(F.size("negative_pool") >= F.col("k") - 1)
    c = asked.withColumn("c", candidates_for_k(F.col("target"), F.col("negative_pool"), F.col("k")))
    return c.select("pool_id", "k", F.array_join("c", "|").alias("candidates"), answers.target_position(F.col("c"), F.col("target")).alias("position"), answers.fingerprint(F.col("c")).alias("fingerprint"))


@query("""SELECT event_id, round(w[1] / (w[1] + w[2] + w[3] + w[4]), 9) AS p_first, round(list_max(w) / list_sum(w), 9) AS confidence, round(list_sum(list_transform(w, lambda x: x * x)) / (list_sum(w) * list_sum(w)), 9) AS squared,
  'option_0' || (list_position(w, list_max(w)))::VARCHAR AS choice FROM (SELECT event_id, [(event_id % 7 + 1)::DOUBLE, (event_id % 5 + 1)::DOUBLE, (event_id % 3 + 1)::DOUBLE, 2.0::DOUBLE] AS w FROM events)""")
def fn_normalize_probs(spark, d):
    """Normalised probabilities, confidence, sum of squares and arg-max label (first of equals)."""
    w = F.array(*[(F.col("event_id") % n + 1).cast("double") for n in (7, 5, 3)], F.lit(2.0))
    labels = answers.option_labels(F.lit(4))
    rows = read_table(spark, d, "events").select("event_id", labels.alias("labels"), F.map_from_arrays(labels, w).alias("raw"))
    p = answers.normalize_probabilities(F.col("labels"), F.col("raw"))
    rows = rows.withColumn("p", p)
    return rows.select("event_id", F.round(F.col("p")[0], 9).alias("p_first"), F.round(answers.confidence(F.col("p")), 9).alias("confidence"), F.round(answers.squared_sum(F.col("p")), 9).alias("squared"), answers.argmax_label(F.col("labels"), F.col("raw")).alias("choice"))


@query("SELECT event_id, 'model' || (event_id % 3)::VARCHAR || CASE WHEN event_id % 2 = 0 THEN '@' || substr(sha256(event_id::VARCHAR), 1, 8) ELSE '' END AS system, CASE WHEN event_id % 4 = 0 THEN '—' ELSE printf('%.3f', (event_id % 1000) / 1000.0) END AS shown, round(1.0 / (event_id % 5 + 2), 9) AS chance, value / (event_id % 3 + 1) AS amortized FROM events")
def fn_labels_and_formats(spark, d):
    """System label, metric format, random chance, amortised latency."""
    i = F.col("event_id")
    rev = F.when(i % 2 == 0, F.sha2(i.cast("string"), 256))
    shown = F.when(i % 4 != 0, (i % 1000) / 1000.0)
    return read_table(spark, d, "events").select("event_id", answers.system_label(F.concat(F.lit("model"), (i % 3).cast("string")), rev).alias("system"), answers.format_metric(shown).alias("shown"), F.round(answers.random_chance(i % 5 + 2), 9).alias("chance"), (F.col("value") / (i % 3 + 1)).alias("amortized"))


@query("SELECT count(*) AS rows_read, count(*) FILTER (WHERE trim(coalesce(subreddit, '')) <> '' AND trim(coalesce(title, '')) <> '') AS usable_title, count(*) FILTER (WHERE trim(coalesce(subreddit, '')) <> '' AND trim(coalesce(title, '')) <> '' AND trim(coalesce(selftext, '')) <> '') AS usable_pair FROM posts")
def f_usable(spark, d):
    title = (F.trim(F.coalesce("subreddit", F.lit(""))) != "") & (F.trim(F.coalesce("title", F.lit(""))) != "")
    return _posts(spark, d).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(title).alias("usable_title"), F.count_if(title & (F.trim(F.coalesce("selftext", F.lit(""))) != "")).alias("usable_pair"))


@query("SELECT post_id, target, community_track FROM instances WHERE difficulty = 'random' AND lower(trim(split)) = 'test'")
def f_eval_split(spark, d):
    return read_table(spark, d, "instances").filter("difficulty = 'random' and lower(trim(split)) = 'test'").select("post_id", "target", "community_track")


@query("SELECT n AS max_options, array_to_string(list_filter([4, 16, 64], lambda k: k <= n), ',') AS run, array_to_string(list_filter([4, 16, 64], lambda k: k > n), ',') AS skipped FROM (SELECT unnest([4, 20, 100]) AS n)")
def f_k_limit(spark, d):
    """Candidate counts that a worker can take, and those that are skipped."""
    from stratawright.scoring.scorer import limited_counts

    rows = [(n, *(",".join(map(str, part)) for part in limited_counts([4, 16, 64], n))) for n in (4, 20, 100)]
    return spark.createDataFrame(rows, "max_options int, run string, skipped string")


@query("SELECT post_id, subreddit, title FROM posts UNION ALL BY NAME SELECT community_id AS post_id, name AS subreddit, public_description AS title FROM communities")
def U1_union(spark, d):
    c = read_table(spark, d, "communities").select(F.col("community_id").alias("post_id"), F.col("name").alias("subreddit"), F.col("public_description").alias("title"))
    return _posts(spark, d).select("post_id", "subreddit", "title").unionByName(c, allowMissingColumns=True)


@query("SELECT DISTINCT community_track, array_to_string(list_sort(list_distinct(list_intersect([4, 16, 64], [16, 64, 128]))), ',') AS shared, array_to_string(list_sort(list_concat([4, 16], [64])), ',') AS requested FROM negative_pools")
def U3_U6_array_sets(spark, d):
    """Shared and requested candidate counts."""
    a = lambda *xs: F.array(*map(F.lit, xs))
    return read_table(spark, d, "negative_pools").select("community_track", F.array_join(F.array_sort(F.array_intersect(a(4, 16, 64), a(16, 64, 128))).cast("array<string>"), ",").alias("shared"), F.array_join(F.array_sort(F.concat(a(4, 16), a(64))).cast("array<string>"), ",").alias("requested")).distinct()


@query("SELECT DISTINCT target FROM instances EXCEPT SELECT target FROM negative_pools")
def U4_set_difference(spark, d):
    return read_table(spark, d, "instances").select("target").distinct().join(read_table(spark, d, "negative_pools").select("target"), "target", "left_anti")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT event_id // 2 AS i FROM events WHERE event_id % 2 = 0 EXCEPT SELECT event_id // 2 FROM events WHERE event_id % 2 = 1)) AS only_a, (SELECT count(*) FROM (SELECT DISTINCT event_id // 2 AS i FROM events WHERE event_id % 2 = 1 EXCEPT SELECT event_id // 2 FROM events WHERE event_id % 2 = 0)) AS only_b")
def U5_J10_set_equality(spark, d):
    """Ids that only one of two runs has, by one full outer join of their distinct ids."""
    ev = read_table(spark, d, "events").select(F.expr("event_id div 2").alias("i"), (F.col("event_id") % 2 == 0).alias("even"))
    sides = ev.groupBy("i").agg(F.max("even").alias("a"), F.max(~F.col("even")).alias("b"))
    return sides.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


@query("SELECT DISTINCT post_id, target, community_track FROM instances ORDER BY community_track, target, post_id")
def O3_selected_order(spark, d):
    return read_table(spark, d, "instances").select("post_id", "target", "community_track").distinct().orderBy("community_track", "target", "post_id")


@query("SELECT count(*) FILTER (WHERE lower(trim(split)) = 'train') AS train, count(*) FILTER (WHERE lower(trim(split)) <> 'train') AS not_train, count(*) FILTER (WHERE split IS NULL) AS unknown FROM posts")
def f_train_f_not_train(spark, d):
    split = F.lower(F.trim("split"))
    return _posts(spark, d).agg(F.count_if(split == "train").alias("train"), F.count_if(split != "train").alias("not_train"), F.count_if(split.isNull()).alias("unknown"))


@query("SELECT DISTINCT post_id, split FROM posts ORDER BY post_id, split")
def O1_posts_order(spark, d):
    return _posts(spark, d).select("post_id", "split").distinct().orderBy("post_id", "split")


@query("SELECT lower(community_id) AS key, count(*) AS n FROM communities GROUP BY 1 ORDER BY 1")
def O2_communities_order(spark, d):
    return read_table(spark, d, "communities").groupBy(text.casefold("community_id").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy("key")


@query("SELECT pool_id, array_to_string(negative_pool[1:3], '|') AS prefix, negative_pool[len(negative_pool)] AS last FROM (SELECT DISTINCT pool_id, negative_pool FROM negative_pools)")
def O5_pool_prefix(spark, d):
    pools = read_table(spark, d, "negative_pools").select("pool_id", "negative_pool").distinct()
    return pools.select("pool_id", F.array_join(F.slice("negative_pool", 1, 3), "|").alias("prefix"), F.try_element_at("negative_pool", F.lit(-1)).alias("last"))


@query("SELECT community_track, difficulty, count(DISTINCT post_id) AS ids, string_agg(DISTINCT lower(trim(split)), ',' ORDER BY lower(trim(split))) AS splits FROM instances WHERE difficulty IS NOT NULL GROUP BY 1, 2")
def A21_id_and_slice_sets(spark, d):
    rows = read_table(spark, d, "instances").filter("difficulty is not null")
    sets = metrics.slice_sets(rows, ["community_track", "difficulty"], "post_id", F.lower(F.trim("split")))
    return sets.select("community_track", "difficulty", "ids", F.array_join("values", ",").alias("splits"))


@query("SELECT subreddit, title FROM posts WHERE lower(trim(split)) = 'train'")
def src_parquet_projected(spark, d):
    """Two of six columns, filtered at the scan."""
    return _posts(spark, d).filter(F.lower(F.trim("split")) == "train").select("subreddit", "title")


@query("SELECT n_name, coalesce(r_name, 'none') AS r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def J14_left_outer(spark, d):
    """The kind of join that shows models with and without a saved endpoint."""
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region").filter("r_regionkey < 3")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_name", F.coalesce("r_name", F.lit("none")).alias("r_name"))


@query("SELECT * FROM (VALUES ('first-option', 'local', 'native'), ('word-overlap', 'local', 'native')) t(model, adapter, probabilities)")
def O7_src_registry(spark, d):
    from stratawright.sources.files import registry

    return registry(spark).select("model", "adapter", "probabilities")


@query("SELECT event_id, map_extract_value(map([0, 1], ['a', 'b']), (event_id % 2)::INTEGER) AS candidate FROM events")
def J12_fn_label_to_candidate(spark, d):
    labels, candidates = F.array(F.lit("l0"), F.lit("l1")), F.array(F.lit("a"), F.lit("b"))
    choice = F.concat(F.lit("l"), (F.col("event_id") % 2).cast("string"))
    return read_table(spark, d, "events").select("event_id", answers.label_to_candidate(labels, candidates, choice).alias("candidate"))
