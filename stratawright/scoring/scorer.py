"""Scoring of questions: the scorer interface, local scorers, answer normalisation, and the distributed stage."""

from __future__ import annotations

import json
import time
from collections import namedtuple
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from stratawright.session import cut

Questions = dict[str, dict[str, Any]]

#: Schema of a prediction row.
PREDICTION = (
    "prediction_id string, post_id string, target string, prediction string, correct boolean, text_mode string, representation string, community_track string, difficulty string, k int, target_position int, "
    "candidates array<string>, candidate_fingerprint string, choice string, probabilities array<double>, true_probability double, confidence double, squared_probability_sum double, public_probability_sum double, "
    "probability_source string, batch_questions int, batch_latency_ms double, amortized_latency_ms double, input_tokens double, output_tokens double, forward_count double, api_cost_usd double, answer_extra string, response string, served_model string, batch_usage string"
)


class Scorer(Protocol):
    """One worker. It is pickled to the executors and opened there, once per task."""

    probabilities: str  # native, self_reported or none
    max_questions: int | None
    max_options: int | None

    def open(self) -> None: ...
    def predict(self, state: str, questions: Questions) -> tuple[dict[str, Any], float]: ...
    def close(self) -> None: ...


class LocalScorer:
    probabilities, max_questions, max_options = "native", None, None

    def open(self) -> None:
        pass

    def close(self) -> None:
        pass

    def weights(self, state: str, labels: list[str], texts: list[str]) -> list[float]:
        raise NotImplementedError

    def predict(self, state: str, questions: Questions) -> tuple[dict[str, Any], float]:
        began, answers = time.perf_counter(), {}
        for qid, question in questions.items():
            labels, texts = options(question)
            weights = self.weights(state, labels, texts)
            best = max(range(len(labels)), key=lambda i: (weights[i], -i))
            answers[qid] = {"choice": labels[best], "probabilities": dict(zip(labels, weights, strict=True))}
        return {"answers": answers, "usage": {"input_tokens": len(state.split()), "forward_count": 1}}, (time.perf_counter() - began) * 1000


class FirstOption(LocalScorer):
    """The first option, all equally likely."""

    def weights(self, state: str, labels: list[str], texts: list[str]) -> list[float]:
        return [1.0] * len(labels)


class WordOverlap(LocalScorer):
    """Options by the words that they share with the text."""

    def weights(self, state: str, labels: list[str], texts: list[str]) -> list[float]:
        words = set(state.casefold().split())
        return [1.0 + len(words & set((t or "").casefold().split())) for t in texts]


def options(question: dict[str, Any]) -> tuple[list[str], list[str]]:
    """Labels and texts of a question's criteria: a list of names, label -> text, or yes and no if there are none."""
    criteria = question.get("criteria") or {"no": "No", "yes": "Yes"}
    if isinstance(criteria, dict):
        return [str(x) for x in criteria], [str(x) for x in criteria.values()]
    return [str(x) for x in criteria], [str(x) for x in criteria]


def normalize_answers(result: dict[str, Any], questions: Questions) -> dict[str, dict[str, Any]]:
    """Answers with a valid choice: bare or in an envelope, ``decision`` for ``choice``, or the first most likely option."""
    given, out = result.get("answers", result), {}
    for qid, question in questions.items():
        if qid not in given:
            raise ValueError(f"no answer for {qid}")
        answer, (labels, _) = dict(given[qid]), options(question)
        probabilities = answer.pop("probabilities", None)
        if probabilities is not None and set(labels) - set(probabilities):
            raise ValueError(f"probabilities of {qid} lack {sorted(set(labels) - set(probabilities))}")
        choice = answer.pop("choice", answer.pop("decision", None))
        if choice is None:
            if probabilities is None:
                raise ValueError(f"{qid} has neither choice nor probabilities")
            choice = max(labels, key=lambda x: probabilities[x])
        if str(choice) not in labels:
            raise ValueError(f"{qid}: {choice!r} is no option")
        out[qid] = {"choice": str(choice), "probabilities": probabilities, "extra": answer}
    return out


def check_limits(scorer: Scorer, questions: Questions) -> None:
    if scorer.max_questions is not None and len(questions) > scorer.max_questions:
        raise ValueError(f"at most {scorer.max_questions} questions at a time, not {len(questions)}")
    for qid, question in questions.items() if scorer.max_options is not None else ():
        n = len(options(question)[0])
        if n > scorer.max_options:
            raise ValueError(f"at most {scorer.max_options} options, {qid} has {n}")


INSTRUCTION = "Select the community of this post."

#: A question as a worker's task reads it.
Asked = namedtuple("Asked", "post_id text_mode representation k prediction_id qid target community_track difficulty candidates labels texts state")
#: How many of its columns tell its batch.
BATCH = 4


def score_batch(scorer: Scorer, rows: list[Asked], instruction: str = INSTRUCTION) -> list[dict[str, Any]]:
    """Prediction rows of the questions of one post, text mode, representation and K, sent together."""
    import hashlib

    questions: Questions = {}
    for row in rows:
        criteria = row.labels if row.representation == "name-only" else dict(zip(row.labels, row.texts, strict=True))
        questions[row.qid] = {"type": "choice", "instructions": instruction, "criteria": criteria}
    check_limits(scorer, questions)
    result, latency = scorer.predict(rows[0].state or "", questions)
    # Whatever else an enveloped answer says is kept, so that nothing needs a rerun for it.
    besides = {k: v for k, v in result.items() if k not in ("answers", "usage", "probability_source", "served_model")} if "answers" in result else {}
    answers, usage, n, out = normalize_answers(result, questions), dict(result.get("usage") or {}), len(questions), []
    for row in rows:
        answer, labels, candidates = answers[row.qid], row.labels, row.candidates
        shares = public = None
        if answer["probabilities"] is not None:
            raw = [float(answer["probabilities"][x]) for x in labels]
            public = sum(raw)
            if public <= 0:
                raise ValueError("probabilities do not sum to a positive number")
            shares = [x / public for x in raw]
        place, chosen = candidates.index(row.target), candidates[labels.index(answer["choice"])]
        out.append(
            {
                "prediction_id": row.prediction_id, "post_id": row.post_id, "target": row.target, "prediction": chosen, "correct": chosen == row.target, "text_mode": row.text_mode, "representation": row.representation,
                "community_track": row.community_track, "difficulty": row.difficulty, "k": row.k, "target_position": place, "candidates": candidates,
                "candidate_fingerprint": hashlib.sha256("\0".join(candidates).encode()).hexdigest(), "choice": answer["choice"], "probabilities": shares,
                "true_probability": shares and shares[place], "confidence": shares and max(shares), "squared_probability_sum": shares and sum(x * x for x in shares), "public_probability_sum": public,
                "probability_source": result.get("probability_source", scorer.probabilities), "batch_questions": n, "batch_latency_ms": latency, "amortized_latency_ms": latency / n,
                "input_tokens": usage.get("input_tokens", 0) / n, "output_tokens": usage.get("output_tokens", 0) / n, "forward_count": usage.get("forward_count", 1) / n,
                "api_cost_usd": usage.get("api_cost_usd", usage.get("cost", 0)) / n, "answer_extra": json.dumps(answer["extra"]), "response": json.dumps(besides) if besides else None, "served_model": result.get("served_model"), "batch_usage": json.dumps(usage),
            }
        )
    return out


def listed(column: pa.Array) -> list[Any]:
    """Values of a column; strings, also those in lists, come in bulk, which is several times as fast as value by value."""
    if pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    values, at, out = listed(column.flatten()), 0, []
    for n in column.value_lengths().to_pylist():
        out.append(None if n is None else values[at : at + n])
        at += n or 0
    return out


def score(asked: DataFrame, scorer: Scorer, partitions: int | None = None, instruction: str = INSTRUCTION, together: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Predictions of all questions (with the post's text in ``state``).

    Questions of one batch are brought together and sorted, so a task streams through its batches and holds one at a time. ``together``: the plan
    of ``asked`` has done so in enough partitions; a window asks Spark for the same, which adds an exchange only where it has not. ``columns``: those of PREDICTION that leave
    Python, where Spark cannot prune them; all by default. A retried
    task asks again: write the result once before using it, and keep speculation off for this stage.
    """
    batch = list(Asked._fields[:BATCH])
    rows = asked.withColumn("texts", F.when(F.col("representation") != "name-only", F.col("texts"))).select(*Asked._fields)  # names are their own text
    if together:
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*batch).orderBy("qid")))
    else:
        rows = rows.repartition(partitions or 3 * asked.sparkSession.sparkContext.defaultParallelism, *batch).sortWithinPartitions(*batch, "qid")
    kind = _parse_datatype_string(PREDICTION)
    kind = StructType([kind[name] for name in columns or kind.names])
    schema = to_arrow_schema(kind)

    def answered(out: list[dict[str, Any]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[f.name] for row in out], f.type, from_pandas=True) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer.open()
        try:
            held: list[Asked] = []
            for part in batches:
                out = []
                for row in map(Asked, *(listed(part.column(i)) for i in range(len(Asked._fields)))):
                    if held and row[:BATCH] != held[0][:BATCH]:
                        out += score_batch(scorer, held, instruction)
                        held = []
                    held.append(row)
                if out:
                    yield answered(out)
            if held:
                yield answered(score_batch(scorer, held, instruction))
        finally:
            scorer.close()

    return rows.mapInArrow(run, kind)


def append_predictions(scored: DataFrame, path: str) -> None:
    """Append predictions as JSON lines."""
    scored.write.mode("append").json(path)


def read_predictions(spark, path: str) -> DataFrame:
    """Predictions of a folder; a broken line is an error, an absent folder holds none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], PREDICTION)
    return spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)


def limited_counts(counts: list[int], max_options: int | None) -> tuple[list[int], list[int]]:
    """Candidate counts that a worker can take and those it cannot; none left is an error."""
    run = [k for k in counts if max_options is None or k <= max_options]
    if not run:
        raise ValueError(f"no candidate count is within {max_options} options")
    return run, [k for k in counts if k not in run]


#: Questions between two commits.
COMMIT_EVERY = 20_000


def predictions_for(spark, asked: DataFrame, scorer: Scorer, path: str, instruction: str = INSTRUCTION, every: int = COMMIT_EVERY) -> DataFrame:
    """Score what ``path`` does not hold yet, append it, and return all predictions there. A rerun adds nothing.

    Posts are scored in chunks of about ``every`` questions, each committed by itself, so a run that dies keeps all chunks before; a chunk holds whole
    batches, because it takes whole posts.
    """
    left = cut(asked.join(read_predictions(spark, path).select("prediction_id"), "prediction_id", "left_anti"))
    chunks = -(-left.count() // every)
    for n in range(chunks):
        part = left if chunks == 1 else left.filter(F.pmod(F.xxhash64("post_id"), F.lit(chunks)) == n)
        append_predictions(score(part, scorer, instruction=instruction), path)
    return read_predictions(spark, path).filter(F.col("prediction_id").isNotNull())
