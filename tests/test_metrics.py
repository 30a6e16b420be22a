import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawright.operators import metrics
from stratawright.operators.baseline import baseline_accuracy, best_candidate, resampled_means

KEYS = ["k"]


def frame(spark, conf, correct, k=4):
    rows = [(k, f"t{i % 3}", f"p{i:05d}", c, bool(x)) for i, (c, x) in enumerate(zip(conf, correct, strict=True))]
    return spark.createDataFrame(rows, "k int, target string, post_id string, confidence double, correct boolean")


def numpy_ece(conf, correct):
    conf, correct, total = np.array(conf), np.array(correct, float), 0.0
    for i in range(15):
        inside = (conf >= i / 15) & ((conf < (i + 1) / 15) | ((i == 14) & (conf <= 1)))
        if inside.any():
            total += inside.sum() * abs(correct[inside].mean() - conf[inside].mean())
    return total / len(conf)


def numpy_aurc(order, correct):
    wrong = 1 - np.array(correct, float)[order]
    return (np.cumsum(wrong) / np.arange(1, len(wrong) + 1)).mean()


@pytest.mark.parametrize("case", ["random", "ties", "edges", "one", "constant"])
def test_ece_and_aurc(spark, case):
    rng = np.random.default_rng(1)
    conf = {"random": rng.random(500), "ties": np.repeat([0.3, 0.6], 50), "edges": np.array([i / 15 for i in range(16)]), "one": np.array([0.7]), "constant": np.ones(20)}[case]
    correct = rng.random(len(conf)) < 0.5
    df = frame(spark, conf.tolist(), correct)
    order = sorted(range(len(conf)), key=lambda i: (-conf[i], f"t{i % 3}", i))
    assert metrics.ece(df, KEYS).first().ece_15 == pytest.approx(numpy_ece(conf, correct), abs=1e-12)
    assert metrics.aurc(df, KEYS).first().aurc == pytest.approx(numpy_aurc(order, correct), abs=1e-12)


def test_confidence_above_one_counts_in_denominator(spark):
    assert metrics.ece(frame(spark, [0.5, 1.0000001], [True, True]), KEYS).first().ece_15 == pytest.approx(0.25)


def test_no_probabilities_stay_null(spark):
    df = frame(spark, [None, None], [True, False])
    assert metrics.ece(df, KEYS).count() == 0 and metrics.aurc(df, KEYS).count() == 0


def test_bootstrap_equals_numpy(spark):
    correct = np.random.default_rng(3).random(60) < 0.4
    df = frame(spark, [0.5] * 60, correct).unionByName(frame(spark, [0.5] * 5, [True] * 5, 16))
    got = {r.k: r for r in metrics.bootstrap_intervals(df, 50, 42, KEYS).collect()}
    order = sorted(range(60), key=lambda i: (f"t{i % 3}", i))
    values, rng = correct[order].astype(float), np.random.default_rng(42)
    means = [values[rng.integers(0, 60, 60)].mean() for _ in range(50)]
    assert (got[4].accuracy_ci95_low, got[4].accuracy_ci95_high) == tuple(np.quantile(means, [0.025, 0.975]))
    assert got[16].accuracy_ci95_low == got[16].accuracy_ci95_high == 1


def test_latency_quantiles(spark):
    values = np.random.default_rng(2).random(37)
    df = spark.createDataFrame([(4, float(v)) for v in values], "k int, amortized_latency_ms double")
    row = metrics.latency_quantiles(df, KEYS).first()
    assert (row.latency_ms_p50, row.latency_ms_p95) == pytest.approx(tuple(np.quantile(values, [0.5, 0.95])))


def test_baseline(spark):
    df = frame(spark, [0.5] * 40, [i % 4 > 0 for i in range(40)])
    row = baseline_accuracy(df, KEYS, 1000, 5).first()
    order = sorted(range(40), key=lambda i: (f"t{i % 3}", i))
    values = np.array([i % 4 > 0 for i in order], float)
    means = np.random.default_rng(5).choice(values, (1000, 40)).mean(axis=1)
    assert row.accuracy == 0.75 and row.accuracy_ci95_low == np.quantile(means, 0.025)
    scores = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(1.0))
    assert spark.range(1).select(best_candidate(F.array(F.lit("b"), F.lit("a")), scores)).first()[0] == "b"


def test_pooled_track_keeps_file_order(spark):
    """Two tracks with interleaved targets and tied confidence: ``all`` is ordered by own track first, as the predictions are filed."""
    rng = np.random.default_rng(8)
    rows = [("m", "r", ("seen", "unseen")[i % 2], "hard", 4, f"t{i % 5}", f"p{i:03d}", float(rng.integers(0, 3)) / 3, bool(rng.random() < 0.4 + 0.3 * (i % 2)), f"source {i % 2}", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "text_mode string, representation string, community_track string, difficulty string, k int, target string, post_id string, confidence double, correct boolean, probability_source string, amortized_latency_ms double")
    filed = sorted(rows, key=lambda r: (r[2], r[5], r[6]))
    by_confidence = sorted(filed, key=lambda r: -r[7])
    pool = metrics.pooled(df)
    got = metrics.aurc(pool).filter("community_track = 'all'").first().aurc
    assert got == pytest.approx(numpy_aurc(np.arange(200), [r[8] for r in by_confidence]), abs=1e-12)
    row = metrics.bootstrap_intervals(pool, 100, 3).filter("community_track = 'all'").first()
    values, generator = np.array([r[8] for r in filed], float), np.random.default_rng(3)
    means = [values[generator.integers(0, 200, 200)].mean() for _ in range(100)]
    assert (row.accuracy_ci95_low, row.accuracy_ci95_high) == tuple(np.quantile(means, [0.025, 0.975]))
    assert metrics.probability_source(pool).filter("community_track = 'all'").first()[-1] == filed[0][9]


def test_one_value_in_many_ranges(spark):
    """A scorer with constant confidence does not put a slice into one range."""
    df = frame(spark, [1.0] * 4000, [i % 3 > 0 for i in range(4000)])
    assert metrics.in_ranges(df, KEYS, [F.col("confidence").desc(), F.col("target"), F.col("post_id")]).select("_r").distinct().count() > 1
    order = sorted(range(4000), key=lambda i: (f"t{i % 3}", i))
    assert metrics.aurc(df, KEYS).first().aurc == pytest.approx(numpy_aurc(order, [i % 3 > 0 for i in range(4000)]), abs=1e-12)


def test_pooling_partial_sums_equals_pooling_rows(spark):
    rows = [("m", "r", ("a", "b")[i % 2], "hard", 4, f"t{i % 3}", (i * 7 % 11) / 10, i % 4 > 0, 0.3 + i / 100, 0.5, float(i % 5), None, None, 0.1) for i in range(50)]
    df = spark.createDataFrame(rows, "text_mode string, representation string, community_track string, difficulty string, k int, target string, confidence double, correct boolean, true_probability double, squared_probability_sum double, input_tokens double, output_tokens double, forward_count double, api_cost_usd double")
    for operator in (metrics.slice_metrics, metrics.ece, metrics.calibration_bins):
        one, two = operator(df, pool=True), operator(metrics.pooled(df))
        keys = [c for c in one.columns if c in (*metrics.KEYS, "bin")]
        for x, y in zip(one.orderBy(*keys).collect(), two.orderBy(*keys).collect(), strict=True):
            assert all(a == pytest.approx(b, abs=1e-12) if isinstance(a, float) else a == b for a, b in zip(x, y, strict=True))


def test_too_long_a_slice_is_refused(spark):
    with pytest.raises(Exception, match="too long"):
        metrics.bootstrap_intervals(frame(spark, [0.5] * 6, [True] * 6), 10, 1, KEYS, most=5).collect()


def test_resampling_in_blocks_is_one_matrix():
    values = np.random.default_rng(1).random(37)
    whole = np.random.default_rng(9).choice(values, (50, 37)).mean(axis=1)
    assert (resampled_means(values, 50, 9, block=100) == whole).all()
