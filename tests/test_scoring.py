import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark import cloudpickle

from stratawright import cli
from stratawright.plans.pipeline import doctor, sanity
from stratawright.scoring import remote, scorer
from stratawright.scoring.scorer import WordOverlap, limited_counts, normalize_answers, score
from stratawright.sources import credentials, settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])
QUESTION = {"q": {"type": "choice", "criteria": ["a", "b"]}}


def test_worker_protocol_and_limits():
    worker = remote.CommandWorker([sys.executable, str(Path(__file__).with_name("support_worker.py"))])
    worker.open()
    try:
        result, latency = worker.predict("text", QUESTION)
        assert result["answers"] == {"q": {"choice": "a"}} and latency == 2.5 and worker.probabilities == "none"
        with pytest.raises(ValueError, match="at most 2 options"):
            worker.predict("text", {"q": {"criteria": ["a", "b", "c"]}})
        with pytest.raises(ValueError, match="at most 2 questions"):
            worker.predict("text", {str(i): QUESTION["q"] for i in range(3)})
    finally:
        worker.close()


def test_score_with_worker(spark):
    rows = [(f"p|title|name-only|seen|{d}|2", f"title|name-only|seen|{d}|2", "p", "c1", "title", "name-only", "seen", d, 2, ["c2", "c1"], ["r/c2", "r/c1"], ["r/c2", "r/c1"], "text") for d in ("hard", "random")]
    df = spark.createDataFrame(rows, "prediction_id string, qid string, post_id string, target string, text_mode string, representation string, community_track string, difficulty string, k int, candidates array<string>, labels array<string>, texts array<string>, state string")
    got = score(df, remote.CommandWorker([sys.executable, str(Path(__file__).with_name("support_worker.py"))])).collect()
    assert len(got) == 2
    for r in got:
        assert r.prediction == "c2" and not r.correct and r.confidence is None and r.batch_questions == 2 and r.input_tokens == 1.5 and r.forward_count == 0.5 and r.target_position == 1
    local = score(df, WordOverlap()).collect()
    assert all(r.confidence == 0.5 and r.probabilities == [0.5, 0.5] for r in local)


class Told(WordOverlap):
    """Answers in an envelope that says more, and remembers what it was asked."""

    def predict(self, state, questions):
        result, latency = super().predict(state, questions)
        said = {q["instructions"] for q in questions.values()}
        return {**result, "id": ",".join(said), "served_model": "m@2"}, latency


def asked(spark, number):
    rows = [(f"p{i}|title|name-only|seen|{d}|2", f"title|name-only|seen|{d}|2", f"p{i}", "c1", "title", "name-only", "seen", d, 2, ["c2", "c1"], ["r/c2", "r/c1"], ["r/c2", "r/c1"], "text") for i in range(number) for d in ("hard", "random")]
    return spark.createDataFrame(rows, "prediction_id string, qid string, post_id string, target string, text_mode string, representation string, community_track string, difficulty string, k int, candidates array<string>, labels array<string>, texts array<string>, state string")


def test_answers_keep_response_model_and_instruction(spark):
    row = score(asked(spark, 1), Told(), instruction="Pick one.").first()
    assert json.loads(row.response) == {"id": "Pick one."} and row.served_model == "m@2"
    assert score(asked(spark, 1), WordOverlap()).first().response is None


def test_chosen_columns_and_posts_together(spark):
    """Fewer columns, and questions that a window brings together, give the same predictions; lists come from Arrow as they are."""
    import pyarrow as pa

    names = ["prediction_id", "candidates", "confidence", "batch_questions"]
    want = sorted(tuple(r) for r in score(asked(spark, 5), WordOverlap()).select(*names).collect())
    got = score(asked(spark, 5), WordOverlap(), together=True, columns=names)
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == want and len(want) == 10 and {w[3] for w in want} == {2}
    values = [["a", None, "c"], None, [], ["ß"]]
    assert scorer.listed(pa.array([["x"], *values]).slice(1)) == values and scorer.listed(pa.array(["a", None])) == ["a", None]


def test_commits_in_chunks_and_resumes(spark, tmp_path, monkeypatch):
    path, done = str(tmp_path / "predictions.jsonl"), []
    keep = scorer.append_predictions

    def failing(scored, where):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(1)
        keep(scored, where)

    monkeypatch.setattr(scorer, "append_predictions", failing)
    with pytest.raises(RuntimeError, match="lost"):
        scorer.predictions_for(spark, asked(spark, 40), WordOverlap(), path, every=20)
    kept = scorer.read_predictions(spark, path).count()
    assert 0 < kept < 80
    monkeypatch.setattr(scorer, "append_predictions", keep)
    assert scorer.predictions_for(spark, asked(spark, 40), WordOverlap(), path, every=20).count() == 80
    assert scorer.read_predictions(spark, path).groupBy("post_id", "batch_questions").count().filter("count <> 2 or batch_questions <> 2").count() == 0


def test_no_criteria_ask_yes_or_no():
    assert scorer.options({}) == (["no", "yes"], ["No", "Yes"])


def test_worker_warms_up_and_ends():
    worker = remote.CommandWorker([sys.executable, str(Path(__file__).with_name("support_worker.py"))])
    worker.open()
    child = worker.lines.child
    assert worker.warm_up()["answers"]["warmup"]["choice"] == "r/one"
    worker.close()
    assert child.poll() is not None
    with pytest.raises(RuntimeError, match="not running"):
        worker.predict("text", QUESTION)
    with pytest.raises(RuntimeError):
        remote.CommandWorker([sys.executable, "-c", "print('{\"type\": \"capabilities\", \"protocol\": 1, \"probabilities\": \"some\"}')"]).open()


def test_http_suffix_and_retry_policy():
    assert remote.HttpScorer("http://h/", "m", suffix="/v1/x").url == "http://h/v1/x" == remote.HttpScorer("http://h/v1/x/", "m", suffix="/v1/x").url
    assert remote.Retry(4).waits() == [1, 2, 4] and max(remote.Retry(9).waits()) == 30


def test_credentials(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    path = credentials.save("m", "https://host/x", "secret")
    assert credentials.load("m") == {"endpoint": "https://host/x", "token": "secret"} and path.stat().st_mode & 0o777 == 0o600
    credentials.save("m", "https://other")
    assert credentials.load("m")["token"] == "secret" and credentials.load("n") == {}
    credentials.save("m", "https://other", "")
    assert credentials.load("m") == {"endpoint": "https://other"}
    with pytest.raises(ValueError, match="http"):
        credentials.save("m", "ftp://host")
    monkeypatch.setenv("TOKEN_HERE", "t")
    assert cli.main(["configure", "n", "--endpoint", "https://h", "--token-from", "TOKEN_HERE"]) == 0 and credentials.load("n")["token"] == "t"
    assert cli.main(["configure", "n", "--endpoint", "no address", "--token-from", "TOKEN_HERE"]) == 2


def test_run_settings_by_either_name():
    task = {"name": "x", "benchmark_seed": 5, "candidate_counts": [4], "candidate_representations": ["name-only"], "splits": {}}
    model = {"posts_per_community": 10, "bootstrap_samples": 7, "instruction": "Pick.", "seed": 6, "revision": None}
    assert cli.run_settings(task, model) == {"seed": 6, "counts": [4], "representations": ["name-only"], "per_community": 10, "samples": 7, "instruction": "Pick."}


def test_settings():
    text = """# a comment
name: demo  # another
list:
  - one
  - a+b
counts: [4, 8, 16]
deep:
  rate: 0.5
  on: true
  none: null
  text: "a: b # c"
items:
  - title: What now? It's 5
    candidates: [r/a, r/b]
    more: {x: 1, y: 'z'}
  - title: second
plain:
- x
"""
    assert settings.parse("a.yaml", text) == {
        "name": "demo", "list": ["one", "a+b"], "counts": [4, 8, 16], "deep": {"rate": 0.5, "on": True, "none": None, "text": "a: b # c"},
        "items": [{"title": "What now? It's 5", "candidates": ["r/a", "r/b"], "more": {"x": 1, "y": "z"}}, {"title": "second"}], "plain": ["x"],
    }
    assert settings.parse("a.json", '{"a": [1]}') == {"a": [1]}
    for bad in ("a: &x 1", "a: 1\na: 2", "a: 1\n    b: 2\n  c: 3"):
        with pytest.raises(ValueError):
            settings.parse_yaml(bad)


def test_normalize_answers():
    take = lambda r: normalize_answers(r, QUESTION)["q"]
    assert take({"q": {"choice": "b", "why": 1}})["extra"] == {"why": 1}
    assert take({"answers": {"q": {"decision": "a"}}})["choice"] == "a"
    assert take({"q": {"probabilities": {"a": 0.5, "b": 0.5}}})["choice"] == "a"
    for bad in ({"q": {"choice": "z"}}, {"q": {"probabilities": {"a": 1}}}, {"q": {}}, {}):
        with pytest.raises(ValueError):
            take(bad)


def serve(script):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            step = script[min(len(seen), len(script)) - 1]
            if step == "drop":
                self.connection.close()
                return
            code, body = step
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, seen


@pytest.mark.parametrize("first", [(503, {}), "drop"])
def test_http_retries(monkeypatch, first):
    monkeypatch.setattr(remote.time, "sleep", lambda s: None)
    server, seen = serve([first, (200, {"answers": {"q": {"choice": "a"}}, "usage": {"cost": 0.5}, "model": "m@1"})])
    result, _ = remote.HttpScorer(f"http://127.0.0.1:{server.server_port}/x", "m").predict("s", QUESTION)
    assert len(seen) == 2 and result["usage"]["api_cost_usd"] == 0.5 and result["served_model"] == "m@1" and seen[0]["questions"]["q"]["criteria"] == {"a": "a", "b": "b"}
    server.shutdown()


def test_http_does_not_retry_refusals():
    server, seen = serve([(402, {})])
    with pytest.raises(RuntimeError, match="HTTP 402"):
        remote.HttpScorer(f"http://127.0.0.1:{server.server_port}/x", "m").predict("s", QUESTION)
    assert len(seen) == 1
    server.shutdown()


def test_limits_sanity_doctor():
    assert limited_counts([2, 4], 2) == ([2], [4])
    with pytest.raises(ValueError):
        limited_counts([4], 2)
    config = {"min_accuracy": 0.8, "communities": {"r/a": "bread and dough", "r/b": "cats"}, "examples": [{"title": "my bread and dough", "target": "r/a", "candidates": ["r/b", "r/a"]}]}
    rows = {r["representation"]: r for r in sanity(WordOverlap(), config)}
    assert rows["anonymous-id+description"]["passed"] and not rows["name-only"]["passed"]
    assert not doctor(None)[0][1] and doctor({"model": "m", "adapter": "http"})[1][1] is False
