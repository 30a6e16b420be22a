"""Metrics, comparison, scoring and the supervised baseline. Predictions are derived from ``events`` by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawright.operators import metrics
from stratawright.session import read_table, wide

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def predictions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    conf = (i * 7919 % 1001) / 1000.0
    return read_table(spark, d, "events").select(
        i.cast("string").alias("post_id"), F.col("user_id").cast("string").alias("target"), F.lit("title").alias("text_mode"),
        F.when(i % 2 == 0, "name-only").otherwise("anonymous-id+description").alias("representation"), F.col("event_type").alias("community_track"),
        F.element_at(F.array(F.lit("random"), F.lit("semantic"), F.lit("hard")), (i % 3 + 1).cast("int")).alias("difficulty"),
        F.element_at(F.array(F.lit(4), F.lit(16), F.lit(64)), (F.expr("event_id div 6") % 3 + 1).cast("int")).alias("k"),
        conf.alias("confidence"), ((i * 104729 % 1000 + 1) / 1001.0).alias("true_probability"), (i * 31 % 100 < 100 * conf).alias("correct"), (conf * conf).alias("squared_probability_sum"),
        F.col("value").alias("amortized_latency_ms"), F.when(i % 5 != 0, (i % 97).cast("double")).alias("input_tokens"), F.when(i % 7 != 0, (i % 89).cast("double")).alias("output_tokens"),
        F.when(i % 11 != 0, F.lit(1.0) / 3).alias("forward_count"), F.when(i % 13 != 0, (i % 10) / 1000.0).alias("api_cost_usd"), F.lit("native").alias("probability_source"),
    )


_PRED = """pred AS (SELECT event_id, event_id::VARCHAR AS post_id, user_id::VARCHAR AS target, CASE WHEN event_id % 2 = 0 THEN 'name-only' ELSE 'anonymous-id+description' END AS representation,
  event_type AS track, CASE event_id % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'semantic' ELSE 'hard' END AS difficulty, CASE (event_id // 6) % 3 WHEN 0 THEN 4 WHEN 1 THEN 16 ELSE 64 END AS k,
  (event_id * 7919 % 1001) / 1000.0::DOUBLE AS conf, (event_id * 104729 % 1000 + 1) / 1001.0::DOUBLE AS p, (event_id * 31 % 100) < 100 * ((event_id * 7919 % 1001) / 1000.0::DOUBLE) AS correct, value,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 97)::DOUBLE END AS tin, CASE WHEN event_id % 7 <> 0 THEN (event_id % 89)::DOUBLE END AS tout, CASE WHEN event_id % 11 <> 0 THEN 1.0::DOUBLE / 3 END AS fwd, CASE WHEN event_id % 13 <> 0 THEN (event_id % 10) / 1000.0::DOUBLE END AS cost FROM events),
  pooled AS (SELECT *, track AS community_track FROM pred UNION ALL BY NAME SELECT *, 'all' AS community_track FROM pred)"""
_K = ["representation", "community_track", "difficulty", "k"]
_KEYS = ", ".join(_K)


@query(f"WITH {_PRED} SELECT {_KEYS}, count(*) AS examples, count(DISTINCT target) AS communities, round(avg(correct::INTEGER), 9) AS accuracy FROM pooled GROUP BY ALL")
def A7_A8_A9_accuracy(spark, d):
    m = metrics.slice_metrics(predictions(spark, d), pool=True)
    return m.select(*_K, "examples", "communities", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {_PRED}, t AS (SELECT {_KEYS}, target, avg(correct::INTEGER) AS a, count(*) AS n, sum(correct::INTEGER) AS r FROM pooled GROUP BY ALL) SELECT {_KEYS}, sum(n)::BIGINT AS examples, count(*) AS communities, round(sum(r) / sum(n), 9) AS accuracy, round(avg(a), 9) AS macro_community_accuracy FROM t GROUP BY {_KEYS}")
def A7_A10_slice_metrics(spark, d):
    """Flagship: accuracy and mean over communities per slice, with the pooled track."""
    m = metrics.slice_metrics(predictions(spark, d), pool=True)
    return m.select(*_K, "examples", "communities", F.round("accuracy", 9).alias("accuracy"), F.round("macro_community_accuracy", 9).alias("macro_community_accuracy"))


@query(f"WITH {_PRED} SELECT {_KEYS}, round(avg(-ln(greatest(p, 1e-12))), 7) AS nll, round(avg(conf * conf - 2 * p + 1), 7) AS brier FROM pooled GROUP BY ALL")
def A11_A12_nll_brier(spark, d):
    m = metrics.slice_metrics(predictions(spark, d), pool=True)
    return m.select(*_K, F.round("nll", 7).alias("nll"), F.round("brier", 7).alias("brier"))


@query(f"WITH {_PRED}, b AS (SELECT {_KEYS}, least(floor(conf * 15), 14) AS bin, count(*) AS n, avg(correct::INTEGER) AS a, avg(conf) AS c FROM pooled GROUP BY ALL) SELECT {_KEYS}, round(sum(n * abs(a - c)) / sum(n), 7) AS ece_15 FROM b GROUP BY {_KEYS}")
def A13_ece_15(spark, d):
    return metrics.ece(predictions(spark, d), pool=True).select(*_K, F.round("ece_15", 7).alias("ece_15"))


@query(f"WITH {_PRED}, w AS (SELECT {_KEYS}, sum(1 - correct::INTEGER) OVER o / row_number() OVER o AS risk FROM pooled WINDOW o AS (PARTITION BY {_KEYS} ORDER BY conf DESC, track, target, post_id ROWS UNBOUNDED PRECEDING)) SELECT {_KEYS}, round(avg(risk), 7) AS aurc FROM w GROUP BY {_KEYS}")
def A14_W7_aurc(spark, d):
    return metrics.aurc(metrics.pooled(predictions(spark, d))).select(*_K, F.round("aurc", 7).alias("aurc"))


@query()
def A15_bootstrap_ci(spark, d):
    """Rows only: the draws of PCG64 have no SQL; held against numpy in the tests."""
    return metrics.bootstrap_intervals(metrics.pooled(predictions(spark, d)), 1000, 42)


@query(f"WITH {_PRED} SELECT {_KEYS}, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM pooled GROUP BY ALL")
def A16_latency_quantiles(spark, d):
    q = metrics.latency_quantiles(metrics.pooled(predictions(spark, d)))
    return q.select(*_K, F.round("latency_ms_p50", 6).alias("p50"), F.round("latency_ms_p95", 6).alias("p95"))


@query(f"WITH {_PRED} SELECT {_KEYS}, round(avg(coalesce(tin, 0)), 7) AS mean_input_tokens, round(avg(coalesce(tout, 0)), 7) AS mean_output_tokens, round(avg(coalesce(fwd, 1)), 7) AS mean_forward_count, round(sum(coalesce(cost, 0)), 6) AS api_cost_usd FROM pooled GROUP BY ALL")
def A17_usage_means_cost(spark, d):
    m = metrics.slice_metrics(predictions(spark, d), pool=True)
    return m.select(*_K, *[F.round(c, 6 if c == "api_cost_usd" else 7).alias(c) for c in ("mean_input_tokens", "mean_output_tokens", "mean_forward_count", "api_cost_usd")])


@query(f"WITH {_PRED} SELECT k, round(avg(correct::INTEGER), 9) AS accuracy FROM pooled WHERE community_track = 'all' AND difficulty = 'hard' AND representation = 'anonymous-id+description' AND k IN (16, 64) GROUP BY k")
def A18_f_headline(spark, d):
    return metrics.headline(metrics.slice_metrics(predictions(spark, d), pool=True)).select("k", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {_PRED} SELECT representation, round(avg(correct::INTEGER), 9) AS accuracy, avg(correct::INTEGER) >= 0.5 AS passed FROM pred GROUP BY 1")
def A19_sanity_accuracy(spark, d):
    rows = metrics.accuracy_gate(predictions(spark, d), ["representation"], 0.5)
    return rows.select("representation", F.round("accuracy", 9).alias("accuracy"), "passed")


@query(f"""WITH {_PRED}, s AS (SELECT 'system' || (event_id % 3)::VARCHAR AS system, k, avg(correct::INTEGER) AS a FROM pred WHERE NOT (event_id % 3 = 2 AND k = 64) GROUP BY 1, 2)
  SELECT system, coalesce(max(CASE WHEN k = 16 THEN printf('%.3f', a) END), 'unsupported') AS k16, coalesce(max(CASE WHEN k = 64 THEN printf('%.3f', a) END), 'unsupported') AS k64 FROM s GROUP BY system""")
def A20_U2_compare_pivot(spark, d):
    rows = predictions(spark, d)
    runs = None
    for n in range(3):
        part = rows.filter(F.col("post_id").cast("bigint") % 3 == n).filter((F.lit(n) != 2) | (F.col("k") != 64))
        run = part.groupBy("k").agg(F.avg(F.col("correct").cast("int")).alias("accuracy")).withColumn("system", F.lit(f"system{n}"))
        runs = run if runs is None else runs.unionByName(run)
    return metrics.compare_pivot(runs)


@query(f"WITH {_PRED} SELECT {_KEYS}, 'native' AS probability_source, (row_number() OVER (ORDER BY {_KEYS}) - 1)::BIGINT AS group_index FROM (SELECT DISTINCT {_KEYS} FROM pooled)")
def A23_W8_source_and_index(spark, d):
    rows = metrics.pooled(predictions(spark, d))
    both = metrics.probability_source(rows).join(metrics.group_index(rows), metrics.KEYS)
    return both.select(*_K, "probability_source", F.col("group_index").cast("bigint").alias("group_index"))


@query(f"WITH {_PRED}, m AS (SELECT {_KEYS}, avg(correct::INTEGER) AS a FROM pooled GROUP BY ALL) SELECT n.community_track, n.difficulty, n.k, round(n.a, 9) AS names, round(x.a, 9) AS descriptions FROM m n JOIN m x ON n.community_track = x.community_track AND n.difficulty = x.difficulty AND n.k = x.k AND n.representation = 'name-only' AND x.representation <> 'name-only'")
def J13_names_vs_descriptions(spark, d):
    m = metrics.slice_metrics(predictions(spark, d), pool=True)
    gap = metrics.representation_gap(m).filter("names is not null and descriptions is not null")
    return gap.select("community_track", "difficulty", "k", F.round("names", 9).alias("names"), F.round("descriptions", 9).alias("descriptions"))


@query(f"WITH {_PRED} SELECT {_KEYS}, least(floor(conf * 15), 14)::BIGINT AS bin, count(*) AS n, round(avg(correct::INTEGER), 9) AS accuracy FROM pooled WHERE conf <= 1 GROUP BY ALL")
def A13_calibration_bins(spark, d):
    b = metrics.calibration_bins(predictions(spark, d), pool=True)
    return b.select(*_K, F.col("bin").cast("bigint").alias("bin"), "n", F.round("accuracy", 9).alias("accuracy"))


@query()
def O4_metric_table(spark, d):
    """The whole metric table, in key order; the bootstrap columns make it rows-only."""
    return metrics.all_metrics(predictions(spark, d), seed=7)


@query()
def M7_evaluate_local(spark, d):
    """Questions of the instance table, at two candidate counts, scored by the local first-option scorer, one prediction row each."""
    from stratawright.operators import mining
    from stratawright.queries.build_queries import _instances, _named, _pools
    from stratawright.scoring.scorer import FirstOption, score

    rows = _instances(spark, d)
    asked = mining.questions(rows.select("post_id").distinct(), rows, _pools(spark, d), _named(spark, d), [4, 16], ["name-only"], ["title"])
    titles = read_table(spark, d, "posts").select("post_id", "title").repartition(wide(spark), "post_id").groupBy("post_id").agg(F.max("title").alias("state"))
    return score(asked.join(titles.hint("shuffle_hash"), "post_id"), FirstOption(), together=True, columns=["prediction_id", "prediction", "correct", "k", "confidence", "candidate_fingerprint"])


@query()
def M1_supervised_baseline(spark, d):
    """Rows only: multinomial logistic regression over the vectors with an even id, then the best of four candidates for each of the others."""
    from stratawright.operators import baseline

    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))
    model, labels = baseline.train_classifier(e.filter("vec_id % 2 = 0"), "label", max_iter=300)
    scored = baseline.class_scores(e.filter("vec_id % 2 = 1"), model, labels)
    names = F.array(*map(F.lit, labels))
    others = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.element_at(names, ((F.array_position(names, F.col("label")) - 1 + i) % len(labels) + 1).cast("int")))
    candidates = F.concat(F.array("label"), F.filter(others, lambda x: x != F.col("label")))
    return scored.filter(F.array_contains(names, F.col("label"))).select("vec_id", "label", baseline.best_candidate(candidates, F.col("scores")).alias("prediction"))


@query(f"WITH {_PRED} SELECT difficulty, k, count(*) AS examples, round(avg(correct::INTEGER), 9) AS accuracy FROM pred GROUP BY ALL")
def A24_baseline_accuracy(spark, d):
    """Accuracy per slice; its bootstrap interval, which has no SQL, is a query of its own."""
    from stratawright.operators.baseline import baseline_accuracy

    return baseline_accuracy(predictions(spark, d), ["difficulty", "k"], 1000, 7).select("difficulty", "k", "examples", F.round("accuracy", 9).alias("accuracy"))


@query()
def A24_baseline_interval(spark, d):
    """Rows only: bootstrap with one seed for every slice; held against numpy in the tests."""
    from stratawright.operators.baseline import baseline_accuracy

    return baseline_accuracy(predictions(spark, d), ["difficulty", "k"], 1000, 7)


@query()
def M2_sanity(spark, d):
    """Fixed examples through the word-overlap scorer, per representation."""
    from stratawright.plans.pipeline import sanity
    from stratawright.scoring.scorer import WordOverlap

    about = {r.subject: r.about for r in read_table(spark, d, "subject_list").orderBy("subject").collect()}  # sixteen rows
    names = list(about)
    examples = [{"title": about[n], "target": n, "candidates": [names[(i + j) % len(names)] for j in range(4)]} for i, n in enumerate(names)]
    rows = sanity(WordOverlap(), {"min_accuracy": 0.8, "communities": about, "examples": examples})
    return spark.createDataFrame([(r["representation"], r["correct"], r["total"], r["accuracy"], r["passed"]) for r in rows], "representation string, correct int, total int, accuracy double, passed boolean")
