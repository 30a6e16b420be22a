import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stratawright.functions.hashing import stable_uint_py
from stratawright.operators import build, mining
from stratawright.queries import build_queries
from stratawright.plans import pipeline
from stratawright.sources import files, storage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the encoder below, which workers cannot import
SCHEMA = "post_id string, subreddit string, title string, selftext string, created_utc bigint, seq bigint"


def rows(spark, *values):
    return spark.createDataFrame([(*v, i) for i, v in enumerate(values)], SCHEMA)


def test_dedupe(spark):
    df = rows(spark, ("a", "X", "t", "long", 0), ("a", "x", "t", "longer", 0), ("a", "x", "t2", "longer", 0), ("b", "x", "t", "b", 0), ("b", "y", "t", "b", 0))
    assert [(r.post_id, r.seq) for r in build.dedupe_paired(df).collect()] == [("a", 1)]
    assert {(r.post_id, r.seq) for r in build.dedupe_first(df).collect()} == {("a", 0), ("b", 3)}


def test_unique_titles_drop_all_copies(spark):
    df = rows(spark, ("a", "x", "Same", "1", 0), ("b", "y", "same", "2", 0), ("c", "y", "Straße", "2", 0), ("d", "y", "STRASSE", "2", 0), ("e", "y", "other", "2", 0))
    assert [r.post_id for r in build.unique_titles(df).collect()] == ["e"]


@pytest.mark.parametrize("n", [3, 4, 5, 15, 25])
def test_assign_splits(spark, n):
    df = spark.range(n).select(F.concat(F.lit("p"), "id").alias("post_id"), F.lit("c").alias("subreddit"), F.lit("seen").alias("split_group"))
    got = {r.post_id: r.split for r in build.assign_splits(df, 7, 0.8, 0.1).collect()}
    order = sorted(got, key=lambda p: stable_uint_py(7, "post", p))
    train = min(max(round(n * 0.8), 1), n - 2)
    dev = min(max(round(n * 0.1), 1), n - train - 1)
    assert [got[p] for p in order] == ["train"] * train + ["dev"] * dev + ["test"] * (n - train - dev)


def test_assign_splits_needs_three(spark):
    df = spark.range(2).select(F.concat(F.lit("p"), "id").alias("post_id"), F.lit("c").alias("subreddit"), F.lit("seen").alias("split_group"))
    with pytest.raises(Exception, match="three posts"):
        build.assign_splits(df, 7, 0.8, 0.1).collect()


def test_pools_and_candidates(spark):
    df = spark.createDataFrame([("seen", f"c{i}", [1.0, float(i + 1)]) for i in range(5)], "track string, community_id string, vector array<double>")
    pools = {r.pool_id: r for r in mining.negative_pools(mining.similar_pairs(df), 9, 3).collect()}
    assert len(pools) == 15
    hard = pools["seen:c0:hard"].negative_pool
    assert hard == ["c1", "c2", "c3", "c4"] and pools["seen:c0:hard"].mining_strategy == "hard_content"
    assert pools["seen:c0:random"].negative_pool == sorted(hard, key=lambda c: stable_uint_py(9, "random", "c0", c))
    assert set(pools["seen:c0:semantic"].negative_pool) == set(hard[:3])
    c = spark.range(1).select(mining.candidates_for_k(F.lit("a"), F.array(*map(F.lit, "bcd")), F.lit(3))).first()[0]
    assert c == ["a", "b", "c"]
    with pytest.raises(Exception, match="pool too small"):
        spark.range(1).select(mining.candidates_for_k(F.lit("a"), F.array(F.lit("b")), F.lit(3))).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.csv").write_text('﻿id,permalink,subreddit_name,title,text,create_time\nt3_abc,/r/x/comments/wrong/a/,x,A title,"Useful\nbody",2024-01-01 00:00:00\n,/r/x/comments/def/a/,x,Another title,Another body,0\ngone,,x,Gone,[deleted],0\nurl,,x,URL,https://example.com,0\n', encoding="utf-8")
    (tmp_path / "in" / "a.csv").write_text('id,subreddit,Title,title,selftext\nz1,y,Upper,,"a ""quoted"" body"\n')
    assert [f[-5:] for f in files.discover_csvs([str(tmp_path)])] == ["a.csv", "b.csv"]
    with pytest.raises(ValueError, match="no CSV"):
        files.discover_csvs([str(tmp_path / "x.txt")])
    raw, posts = files.read_posts(spark, [str(tmp_path / "in")])
    got = {r.post_id: r for r in posts.collect()}
    assert raw.count() == 5 and set(got) == {"abc", "def", "z1"}
    assert got["abc"].selftext == "Useful\nbody" and got["z1"].title == "Upper" and got["z1"].selftext == 'a "quoted" body' and got["abc"].created_utc == 1704067200
    files.guard_run(str(tmp_path / "run"), {"a": 1})
    files.guard_run(str(tmp_path / "run"), {"a": 1})
    with pytest.raises(ValueError, match="another run"):
        files.guard_run(str(tmp_path / "run"), {"a": 2})


def test_aliases_and_ids(spark, tmp_path):
    """Every alias of the contract, its order where several are filled, and which links hold an id."""
    (tmp_path / "a.csv").write_text("reddit_id,perm_link,label,Title,selftext,body,text,created_utc,create_time,created_at\nt3_aa1,,x,One,from selftext,from body,from text,5,6,7\n,/r/x/comments/bb2/,x,Two,,from body,from text,,6,7\n,/r/x/comments/cc3,x,Three,,,from text,,,2024-01-01T00:00:00Z\nT3_dd4,/comments/EE5/z,x,Four,,,from text,,,\n")
    (tmp_path / "b.csv").write_text("name,subreddit,subreddit_name,title,body\nff6,first,second,Five,text\n")
    got = {r.title: r for r in files.read_posts(spark, [str(tmp_path)])[1].collect()}
    assert {t: (r.selftext, r.created_utc) for t, r in got.items() if t != "Five"} == {"One": ("from selftext", 5), "Two": ("from body", 6), "Three": ("from text", 1704067200), "Four": ("from text", 0)}
    assert (got["One"].post_id, got["Two"].post_id, got["Four"].post_id) == ("aa1", "bb2", "ee5") and len(got["Three"].post_id) == 64
    assert (got["Five"].post_id, got["Five"].subreddit) == ("ff6", "first")


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1\n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|arsing|malformed"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()


def test_storage(spark, tmp_path):
    path = f"file://{tmp_path}/deep/er/x.json"
    storage.write_text(path, "ä\n")
    storage.write_text(path, "ö\n")
    assert storage.read_text(path) == "ö\n" and storage.exists(path) and storage.is_folder(str(tmp_path / "deep"))
    assert storage.files_under(str(tmp_path)) and not [f for f in storage.files_under(str(tmp_path)) if f.endswith(".writing")]
    with pytest.raises(FileNotFoundError):
        storage.read_text(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no CSV"):
        files.discover_csvs([str(tmp_path)])


def test_missing_communities_and_unknown_representations_are_errors(spark):
    rows = spark.createDataFrame([("p", "a", "seen", "hard", "seen:a:hard", 5)], "post_id string, target string, community_track string, difficulty string, pool_id string, shuffle_seed long")
    pools = spark.createDataFrame([("seen:a:hard", ["b"])], "pool_id string, negative_pool array<string>")
    known = spark.createDataFrame([("a", "r/a", "about a"), ("b", "r/b", "about b")], "community_id string, name string, public_description string")
    assert mining.questions(rows, rows, pools, known, [2], ["name-only"], ["title"]).count() == 1
    with pytest.raises(Exception, match="no such community: b"):
        mining.questions(rows, rows, pools, known.filter("community_id = 'a'"), [2], ["name-only"], ["title"]).collect()
    with pytest.raises(ValueError, match="unknown representations"):
        mining.questions(rows, rows, pools, known, [2], ["names"], ["title"])


def test_questions_of_repeated_rows_and_pools_are_one(spark):
    """Two rows of one post, target and difficulty, or two pools of one id, give one question that holds the candidates of all."""
    from stratawright.functions.hashing import sha256_60, stable_uint_py

    schema = "post_id string, target string, community_track string, difficulty string, pool_id string, shuffle_seed long"
    rows = [("p", "a", "seen", "hard", "x", 5), ("p", "a", "seen", "hard", "y", 6), ("q", "b", "seen", "hard", "x", 7), ("r", "c", "seen", "hard", "z", 8), (None, "c", "seen", "hard", "z", 9)]
    pools = [("x", ["b", "c", "d"]), ("y", ["d", "c"]), ("z", ["a", "b"]), ("z", ["a", "b"]), ("z", ["d", "a"]), ("w", [])]
    known = spark.createDataFrame([(c, f"r/{c}", f"about {c}") for c in "abcd"], "community_id string, name string, public_description string")
    df, pools_df = spark.createDataFrame(rows, schema), spark.createDataFrame(pools, "pool_id string, negative_pool array<string>")
    want = {}
    for post, target, _, difficulty, pool, seed in rows[:4]:
        for name, ids in pools:
            for k in (2, 3) if name == pool else ():
                want.setdefault(f"{post}|title|name-only|seen|{difficulty}|{k}", []).extend((stable_uint_py(seed, k, "candidate", c), c) for c in [target, *ids[: k - 1]])
    got = {r.prediction_id: r for r in mining.questions(df, df, pools_df, known, [2, 3], ["name-only"], ["title"]).collect()}
    assert {i: r.candidates for i, r in got.items()} == {i: [c for _, c in sorted(x)] for i, x in want.items()} and all(r.labels == [f"r/{c}" for c in r.candidates] for r in got.values())
    other = mining.questions(df, df, pools_df, known, [2, 3], ["anonymous-id+description"], ["title"], sha256_60).collect()
    assert len(other) == 6 and all(sorted(r.texts) == sorted(f"about {c}" for c in r.candidates) for r in other)
    with pytest.raises(Exception, match="pool too small"):
        mining.questions(df, df, pools_df, known, [4], ["name-only"], ["title"]).collect()


def test_pools_beyond_the_held_bytes_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(f"p{i}", "a", "seen", "hard", "x", i) for i in range(9)], "post_id string, target string, community_track string, difficulty string, pool_id string, shuffle_seed long")
    pools = spark.createDataFrame([("x", ["b", "c"])], "pool_id string, negative_pool array<string>")
    known = spark.createDataFrame([(c, f"r/{c}", None) for c in "abc"], "community_id string, name string, public_description string")
    held = sorted(mining.questions(rows, rows, pools, known, [2, 3], ["name-only"], ["title"]).collect())
    monkeypatch.setattr(mining, "HELD_BYTES", 0)
    assert sorted(mining.questions(rows, rows, pools, known, [2, 3], ["name-only"], ["title"]).collect()) == held and len(held) == 18


def test_similar_pairs_either_way(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", ("seen", "unseen")[i % 2], rng.normal(size=8).tolist()) for i in range(9)]
    vectors = spark.createDataFrame(rows, "community_id string, track string, vector array<double>")
    held = {tuple(r)[:3]: r.similarity for r in mining.similar_pairs(vectors).collect()}
    monkeypatch.setattr(mining, "HELD_BYTES", 0)
    joined = {tuple(r)[:3]: r.similarity for r in mining.similar_pairs(vectors).collect()}
    assert held.keys() == joined.keys() and len(held) == 5 * 4 + 4 * 3 and all(held[k] == pytest.approx(v, abs=1e-12) for k, v in joined.items())


def encoder(texts):
    return np.array([[1.0, sum(map(ord, t)) % 17 + 1] for t in texts], "float32")


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("build")
    lines = ["id,permalink,subreddit_name,title,text,create_time"] + [f"c{i}{j},,c{i},Title {i} {j},Body {i} {j},{1700000000 + j}" for i in range(4) for j in range(3)]
    (folder / "posts.csv").write_text("\n".join(lines) + "\n")
    (folder / "communities.csv").write_text("subreddit_name,public_description\n" + "\n".join(f"c{i},About {i}" for i in range(4)) + "\n")
    report = pipeline.build_dataset(spark, [str(folder / "posts.csv")], str(folder / "communities.csv"), str(folder / "out"), encoder, seed=7, max_k=2, unseen=0.5, train=0.34, dev=0.33, semantic_size=2, min_posts=3)
    return folder, report


def test_build_end_to_end(spark, dataset):
    folder, report = dataset
    assert report["kept"] == 12 and report["communities"] == 4
    posts = spark.read.parquet(f"{folder}/out/posts.parquet").collect()
    groups = {r.community_id: r.split_group for r in spark.read.parquet(f"{folder}/out/communities.parquet").collect()}
    assert sorted(groups.values()) == ["seen", "seen", "unseen", "unseen"]
    assert all(p.split == "test" for p in posts if groups[p.subreddit] == "unseen")
    for r in spark.read.parquet(f"{folder}/out/manifests/negative_pools.parquet").collect():
        assert r.target not in r.negative_pool and all(groups[c] == groups[r.target] for c in r.negative_pool)


def test_evaluate_resume_and_compare(spark, dataset):
    from stratawright.scoring.scorer import FirstOption, WordOverlap, read_predictions

    folder, _ = dataset
    settings = {"counts": [2], "representations": ["name-only", "anonymous-id+description"], "text_modes": ["title", "title+selftext"], "per_community": 1, "seed": 7, "samples": 10}
    first = pipeline.evaluate(spark, f"{folder}/out", f"{folder}/r1", FirstOption(), model="first-option", **settings).collect()
    assert read_predictions(spark, f"{folder}/r1/predictions.jsonl").count() == 48 and len(first) == 36
    again = pipeline.evaluate(spark, f"{folder}/out", f"{folder}/r1", FirstOption(), model="first-option", **settings).collect()
    drop = lambda rows: [{k: v for k, v in r.asDict().items() if "latency" not in k} for r in rows]
    assert read_predictions(spark, f"{folder}/r1/predictions.jsonl").count() == 48 and drop(again) == drop(first)
    pipeline.evaluate(spark, f"{folder}/out", f"{folder}/r2", WordOverlap(), model="word-overlap", revision="0123456789", **settings)
    table = pipeline.compare_runs(spark, [f"{folder}/r1", f"{folder}/r2"])
    assert {r.system for r in table.collect()} == {"first-option", "word-overlap@01234567"} and table.count() == 72
    with pytest.raises(ValueError, match="two or more"):
        pipeline.compare_runs(spark, [f"{folder}/r1"])
    pipeline.evaluate(spark, f"{folder}/out", f"{folder}/r3", FirstOption(), model="first-option", **{**settings, "text_modes": ["title"]})
    with pytest.raises(ValueError, match="differs in text_modes"):
        pipeline.compare_runs(spark, [f"{folder}/r1", f"{folder}/r3"])


def test_supervised_job(spark, dataset):
    folder, _ = dataset
    result = pipeline.supervised(spark, f"{folder}/out", f"{folder}/baseline.json", encoder, counts=[2], per_community=1, seed=7, train_per_community=2, samples=20)
    assert storage.read_text(f"{folder}/baseline.json").startswith("{") and result["seen_communities"] == 2
    assert {(m["community_track"], m["k"]) for m in result["metrics"]} == {("seen", 2)} and all(m["examples"] == 2 and 0 <= m["accuracy"] <= 1 for m in result["metrics"])


def test_run_keeps_what_it_was_told(spark, dataset):
    import json

    from stratawright.scoring.scorer import FirstOption

    folder, _ = dataset
    settings = {"counts": [2], "representations": ["name-only"], "per_community": 1, "seed": 7, "samples": 5, "instruction": "Pick one.", "adapter": "local", "registry": {"model": "first-option", "runtime_model": "first"}}
    pipeline.evaluate(spark, f"{folder}/out", f"{folder}/r9", FirstOption(), model="first-option", **settings)
    run = json.loads(storage.read_text(f"{folder}/r9/run.json"))
    assert run["instruction"] == "Pick one." and run["adapter"] == "local" and run["runtime_model"] == "first" and run["text_modes"] == ["title", "title+selftext"] and "spark" in run["runtime"]
    with pytest.raises(ValueError, match="another run"):
        pipeline.evaluate(spark, f"{folder}/out", f"{folder}/r9", FirstOption(), model="first-option", **{**settings, "instruction": "Pick another."})


def test_streaming_counts_once(spark, dataset, tmp_path):
    from stratawright.scoring.scorer import FirstOption
    from stratawright.streaming import incremental

    folder, _ = dataset
    pipeline.evaluate(spark, f"{folder}/out", f"{folder}/r4", FirstOption(), model="first-option", counts=[2], representations=["name-only"], text_modes=["title"], per_community=1, seed=7, samples=5)
    query = incremental.start(spark, f"{folder}/r4/predictions.jsonl", "live", str(tmp_path / "state"))
    query.awaitTermination(60)
    assert spark.table("live").filter("community_track = 'all'").agg(F.sum("examples")).first()[0] == 12


def test_unique_titles_query_reads_every_title(spark, tmp_path):
    titles = ["Straße", "STRASSE", "Привет мир", "ПРИВЕТ МИР", "Ёлка", "日本語の題", "Été à Paris", "ÉTÉ À PARIS", "“Quoted”", "ΣΊΣΥΦΟΣ", "σίσυφος", "plain"]
    rows = [(f"p{i}", "s", t, "text", i) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "post_id string, subreddit string, title string, selftext string, created_utc long").write.parquet(str(tmp_path / "posts.parquet"))
    folded = [t.casefold() for t in titles]
    want = {f"p{i}" for i, t in enumerate(folded) if folded.count(t) == 1}
    got = {r.post_id for r in build_queries.QUERIES["A3_W9_unique_titles"](spark, str(tmp_path)).collect()}
    assert got == want == {"p4", "p5", "p8", "p11"}
