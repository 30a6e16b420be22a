"""Subject area of each document (problem 8).

Method: complement naive Bayes from the labelled documents, refined with expectation-maximization over the unlabelled ones, and
calibrated independent subject posteriors. The unit is the sentence, because a document may be about several subjects: each
sentence has a posterior over the subjects and "none" (small talk); the share of a document that is about a subject is the mean of its
sentences' posteriors by words. The first model takes a labelled document's sentences for all its subjects; every further round gives each
sentence of *all* documents its posterior, within the labels where there are any, and counts words by these weights. Texts are read
once, into a table of hashed words; a fixed number of features bounds the counts, and sentences weigh in whole units, so sums
do not depend on the order in which tasks meet. At last a logistic curve of its own maps each subject's shares to probabilities, fitted on labelled
documents by models that have not seen them (two folds) and drawn towards the curve of all subjects while labels are few; a subject is
given where its probability reaches the threshold with the best balance of precision and recall there.

The labels are fitted on at most MOST_LABELS labelled documents (a bounded sample by hash of the id); word counts cover all documents.
Labels are read without case and blanks and counted once; "none" beside a subject is ignored.

Defined cases: a null or empty text has no subject and no share; repeated texts get the same subjects; very long texts are read whole; without
labels nothing has a subject; an empty table gives an empty result; a null id takes no part; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratawright.llm.scrub import plain, romanised, unaccented
from stratawright.session import cut, spread

#: Hashed features, rounds over all documents, most labelled documents.
FEATURES, ROUNDS, MOST_LABELS = 1 << 17, 2, 16_000
SMOOTH, STRENGTH, PURITY = 1.0, 4.0, 3
SEED, REMEMBERED = 5, 300_000
#: Words of the neighbouring sentences count this much for a sentence.
NEIGHBOUR = 0.15
#: What a word of an unlabelled document counts, beside one of a labelled.
UNLABELLED = 0.1
#: Whole units of a sentence's weight, and the weight of the curve of all subjects in the fit of each one's, in documents.
UNITS, PULL = 1024, 2.0
#: Most bytes of the labelled texts.
MOST_BYTES = 256_000_000
NONE = "none"

ENDS = re.compile(r"(?<=[.!?…])\s+|[\r\n]+|(?<=[。！？])")
WORD = re.compile(r"[^\W\d_]+|[぀-ヿ一-鿿]")
CJK = re.compile(r"[぀-ヿ一-鿿々]+")


def sentences(text: str | None) -> list[list[str]]:
    """Words of every sentence, in one spelling; Japanese runs are cut into pairs of characters."""
    if not text:
        return []
    text = plain(text).casefold()
    out = []
    for part in ENDS.split(text):
        if not part:
            continue
        if part.isascii():
            words = WORD.findall(part)
        else:
            words = []
            for run in CJK.findall(part):
                words += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
            words += WORD.findall(unaccented(romanised(CJK.sub(" ", part))))
        if words:
            out.append(words)
    return out


def feature(word: str) -> int:
    """Hash of a word, the same in every process."""
    value = 2166136261
    for byte in word.encode("utf-8", "surrogatepass"):
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    return (value ^ value >> 15) % FEATURES


class Reader:
    """Hashed words of texts; remembers words."""

    def __init__(self) -> None:
        self.memory: dict[str, int] = {}

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of all words, the sentence ends among them, and the text of every sentence."""
        ids: list[int] = []
        ends, owner = [], []
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        for i, text in enumerate(texts):
            for words in sentences(text):
                for word in words:
                    if (at := memory.get(word)) is None:
                        at = memory[word] = feature(word)
                    ids.append(at)
                ends.append(len(ids))
                owner.append(i)
        return np.array(ids, "int64"), np.array(ends, "int64"), np.array(owner, "int64")


Read = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Model:
    """Complement naive Bayes: ``weights`` (features, classes) are -log of the words' share outside each class, less their mean."""

    names: list[str]  # the last is NONE
    weights: np.ndarray
    slope: np.ndarray | float = 1.0  # of each subject
    offset: np.ndarray | float = 0.0
    threshold: float = 0.25

    def posterior(self, ids: np.ndarray, ends: np.ndarray, owner: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        """Posterior of every sentence over the classes; ``allowed`` (texts, classes) leaves only these."""
        if not len(ends):
            return np.zeros((0, len(self.names)), "float32")
        score = np.add.reduceat(self.weights[ids], np.concatenate([[0], ends[:-1]]), axis=0)
        mixed = score.copy()
        same = owner[1:] == owner[:-1]
        mixed[1:][same] += NEIGHBOUR * score[:-1][same]
        mixed[:-1][same] += NEIGHBOUR * score[1:][same]
        if allowed is not None:
            mixed = np.where(allowed[owner], mixed, -1e9)
        mixed -= mixed.max(axis=1, keepdims=True)
        np.exp(mixed, out=mixed)
        return mixed / mixed.sum(axis=1, keepdims=True)

    def shares(self, read: Read, number: int) -> np.ndarray:
        """Share of each of ``number`` texts (as read) that is about each class."""
        ids, ends, owner = read
        out = np.zeros((number, len(self.names)))
        if len(ends):
            size = np.diff(ends, prepend=0).astype(float)
            np.add.at(out, owner, self.posterior(ids, ends, owner) * size[:, None])
            out /= np.maximum(np.bincount(owner, size, number), 1)[:, None]
        return out

    def probability(self, share: np.ndarray) -> np.ndarray:
        """Calibrated probabilities (texts, subjects) that texts with these shares of each subject are about it."""
        return 1 / (1 + np.exp(-np.clip(self.slope * odds_of(share) + self.offset, -40, 40)))


def odds_of(share: np.ndarray) -> np.ndarray:
    clipped = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(clipped / (1 - clipped))


def complement_weights(counts: np.ndarray) -> np.ndarray:
    """Weights from word counts (features, classes); classes are made equally likely first.

    A word counts by how far its classes are from evenly mixed (one less its relative entropy, to the power PURITY), so that words
    that all subjects of a language share do not add up to a subject.
    """
    level = counts / np.maximum(counts.sum(axis=0), 1e-9) * counts.sum() / counts.shape[1]
    outside = level.sum(axis=1, keepdims=True) - level + SMOOTH
    weights = -np.log(outside / outside.sum(axis=0))
    weights -= weights.mean(axis=1, keepdims=True)
    part = (level + 1e-9) / (level + 1e-9).sum(axis=1, keepdims=True)
    even = -(part * np.log(part)).sum(axis=1) / np.log(counts.shape[1])
    pure = np.clip(1 - even, 0, 1)
    pure /= max(float(pure[counts.sum(axis=1) >= 5].max(initial=0.0)), 1e-6)  # the clearest of the common words counts in full
    weights *= STRENGTH * np.minimum(pure, 1.0)[:, None] ** PURITY
    weights[counts.sum(axis=1) == 0] = 0
    return np.clip(weights, -8, 8).astype("float32")


def count_words(model: Model | None, read: Read, allowed: np.ndarray, out: np.ndarray) -> None:
    """Add to ``out`` (features, classes) the words of texts (as read) by their sentences' posteriors, in UNITS."""
    ids, ends, owner = read
    if not len(ends):
        return
    if model is None:
        weight = allowed[owner] / np.maximum(allowed[owner].sum(axis=1, keepdims=True), 1)
    else:
        weight = model.posterior(ids, ends, owner, allowed)
    units = np.rint(weight * UNITS).astype("int64")  # whole units: their sums are exact in any order
    size, starts = np.diff(ends, prepend=0), np.concatenate([[0], ends[:-1]])
    sentence, c = np.nonzero(units)
    number = size[sentence]
    words = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(starts[sentence], number)
    at = ids[words] * out.shape[1] + np.repeat(c, number)
    out += np.bincount(at, np.repeat(units[sentence, c], number), out.size).reshape(out.shape)


def labelled(documents: DataFrame, subject_labels: DataFrame, names: list[str], most: int = MOST_LABELS) -> pd.DataFrame:
    """doc_id, text and subjects (list) of at most ``most`` labelled documents."""
    name = F.lower(F.trim(F.regexp_replace("subject", r"(?U)\s+", " ")))
    rows = subject_labels.filter("doc_id is not null").select("doc_id", name.alias("subject")).filter(F.col("subject").isin(*names, NONE))
    sets = rows.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(sets), "doc_id")  # at most ``most`` rows
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over at most ``most`` rows
    few = texts.withColumn("so_far", F.sum(F.octet_length("text")).over(order)).filter(F.col("so_far") <= MOST_BYTES).drop("so_far")
    return few.toPandas().sort_values("doc_id", ignore_index=True)


def encoded(documents: DataFrame) -> DataFrame:
    """doc_id, words (hashed), ends (of sentences) of every document with a text, stored: texts are read and split once for all rounds."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            ids, ends, owner = reader.read(batch.column(1).to_pylist())
            number = np.bincount(owner, minlength=batch.num_rows) if len(owner) else np.zeros(batch.num_rows, "int64")
            last = np.cumsum(number)  # sentences up to each document
            stops = np.concatenate([[0], ends])[last]
            first = np.repeat(np.concatenate([[0], stops[:-1]]), number)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], o]), pa.int32()), pa.array(v, pa.int32())) for o, v in ((stops, ids), (last, ends - first))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "words", "ends"])

    rows = spread(documents.filter("doc_id is not null and text is not null").select("doc_id", "text"))
    return cut(rows.mapInArrow(run, f"doc_id {kind}, words array<int>, ends array<int>"))


def stored(words: pa.ListArray, ends: pa.ListArray) -> Read:
    """What ``Reader.read`` gave for the documents of a batch of ``encoded``."""
    word_at, end_at = words.offsets.to_numpy().astype("int64"), ends.offsets.to_numpy().astype("int64")
    number = np.diff(end_at)
    ids = words.values.to_numpy()[word_at[0] : word_at[-1]].astype("int64")
    stops = ends.values.to_numpy()[end_at[0] : end_at[-1]].astype("int64") + np.repeat(word_at[:-1] - word_at[0], number)
    return ids, stops, np.repeat(np.arange(len(number)), number)


def fit(documents: DataFrame, texts: DataFrame, subject_labels: DataFrame, subject_list: DataFrame) -> Model:
    """The model; ``texts`` are the documents as ``encoded``."""
    names = sorted({r.subject.strip().lower() for r in subject_list.select("subject").dropna().collect()})
    classes = [*names, NONE]
    frame = labelled(documents, subject_labels, names)
    truth = np.array([[n in s for n in names] + [not set(s) & set(names)] for s in frame["subjects"]], bool).reshape(len(frame), len(classes))
    if not len(frame):
        return Model(classes, np.zeros((FEATURES, len(classes)), "float32"), threshold=2.0)
    fold = np.random.default_rng(SEED).permutation(len(frame)) % 2
    reader = Reader()
    chunks = [(rows, reader.read([frame["text"].iloc[i] for i in rows])) for side in (0, 1) for rows in np.array_split(np.flatnonzero(fold == side), max(1, len(frame) // 1000))]

    def local(sides: tuple[int, ...], background: np.ndarray | None, model: Model | None = None, steps: int = 4) -> Model:
        """Model of the labelled documents of some folds, from ``model`` on if there is one, over the counts of all documents if there are any."""
        for step in range(steps):
            counts = np.zeros((FEATURES, len(classes)))
            for rows, read in chunks:
                if len(rows) and fold[rows[0]] in sides:
                    allowed = truth[rows].copy()
                    if model is not None:
                        allowed[:, -1] = True  # small talk occurs in every document
                    count_words(model, read, allowed, counts)
            if background is not None and model is not None:
                counts += UNLABELLED * background
            model = Model(classes, complement_weights(counts / UNITS))
        return model

    model = local((0, 1), None)
    background = None
    labelled_ids = set(frame["doc_id"])
    for _ in range(ROUNDS):
        background = expected_counts(texts, model, labelled_ids)
        model = local((0, 1), background, model, 2)
    share = np.zeros((len(frame), len(classes)))
    for side in (0, 1):
        if (fold == side).any() and (fold != side).any():
            other = local((1 - side,), background)
            for rows, read in chunks:
                if len(rows) and fold[rows[0]] == side:
                    share[rows] = other.shares(read, len(rows))
    calibrate(model, share[:, :-1], truth[:, :-1])
    return model


def expected_counts(texts: DataFrame, model: Model, labelled_ids: set) -> np.ndarray:
    """Word counts by class, in UNITS, over all documents that are not labelled: one E-step. Partial sums by task, FEATURES rows at most."""
    classes = len(model.names)
    held = texts.sparkSession.sparkContext.broadcast((model, labelled_ids))  # FEATURES weights by class, MOST_LABELS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, skip = held.value
        counts = np.zeros((FEATURES, classes))
        for batch in batches:
            keep = pa.array([i not in skip for i in batch.column(0).to_pylist()], pa.bool_())
            rows = batch.filter(keep)
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                count_words(own, stored(part.column(1), part.column(2)), np.ones((part.num_rows, classes), bool), counts)
        at = np.flatnonzero(counts.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(counts[at, c].astype("int64")) for c in range(classes))], ["feature", *(f"c{c}" for c in range(classes))])

    kinds = "feature bigint, " + ", ".join(f"c{c} bigint" for c in range(classes))
    summed = texts.mapInArrow(run, kinds).groupBy("feature").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(classes)]).toPandas()
    out = np.zeros((FEATURES, classes))
    if len(summed):
        out[summed["feature"].to_numpy("int64")] = summed[[f"c{c}" for c in range(classes)]].to_numpy()
    return out


def logistic(x: np.ndarray, truth: np.ndarray, towards: tuple[float, float], pull: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with a quadratic penalty on the distance from ``towards``."""
    a, b = towards
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((truth - p) * x).sum() - pull * (a - towards[0]), (truth - p).sum() - pull * (b - towards[1])])
        h = np.array([[(w * x * x).sum() + pull, (w * x).sum()], [(w * x).sum(), w.sum() + pull]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)  # short steps, so that it does not overshoot
        a, b = a + step[0], b + step[1]
    return float(max(a, 0.1)), float(b)


def calibrate(model: Model, share: np.ndarray, truth: np.ndarray) -> None:
    """Fit each subject's curve and the threshold (best F1) on shares (documents, subjects) of documents that the model had not seen."""
    x, truth = odds_of(share), truth.astype(float)
    every = logistic(x.ravel(), truth.ravel(), (1.0, 0.0), 0.01)
    curves = [logistic(x[:, c], truth[:, c], every, PULL) for c in range(share.shape[1])]
    model.slope, model.offset = np.array([a for a, _ in curves]), np.array([b for _, b in curves])
    chance = model.probability(share).ravel()
    order = np.argsort(-chance, kind="stable")
    right = np.cumsum(truth.ravel()[order])
    f1 = 2 * right / (np.arange(1, len(order) + 1) + max(truth.sum(), 1))
    value = chance[order]
    f1[:-1][value[:-1] == value[1:]] = 0
    at = int(np.argmax(f1))
    under = value[at + 1] if at + 1 < len(value) else 0.0
    model.threshold = float((value[at] + under) / 2)


def subject_scores(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, subject, share, probability, is_case: one row per document (of ``encoded``) and subject with a share of 1 % or more."""
    held = texts.sparkSession.sparkContext.broadcast(model)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        names = pa.array(own.names[:-1])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                share = own.shares(stored(part.column(1), part.column(2)), part.num_rows)[:, :-1]
                chance = own.probability(share)
                doc, subject = np.nonzero(share >= 0.01)
                flag = chance[doc, subject] >= own.threshold
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), names.take(pa.array(subject)), pa.array(share[doc, subject]), pa.array(chance[doc, subject]), pa.array(flag)], ["doc_id", "subject", "share", "probability", "is_case"])

    return texts.mapInArrow(run, f"doc_id {kind}, subject string, share double, probability double, is_case boolean")


def subject_sums(texts: DataFrame, model: Model) -> DataFrame:
    """subject, documents (cases), mass (sum of all shares, small ones too): partial sums, one row per task and subject."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        names = own.names[:-1]
        cases, mass = np.zeros(len(names), "int64"), np.zeros(len(names))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                share = own.shares(stored(part.column(1), part.column(2)), part.num_rows)[:, :-1]
                cases += ((share >= 0.01) & (own.probability(share) >= own.threshold)).sum(axis=0)
                mass += share.sum(axis=0)
        some = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.string()), pa.array(cases[some]), pa.array(mass[some])], ["subject", "documents", "mass"])

    return texts.mapInArrow(run, "subject string, documents bigint, mass double")


def found(documents: DataFrame, subject_labels: DataFrame, subject_list: DataFrame) -> DataFrame:
    """doc_id, subject of every document outside the labelled sample."""
    texts = encoded(documents)
    cases = subject_scores(texts, fit(documents, texts, subject_labels, subject_list)).filter("is_case").select("doc_id", "subject")
    return cases.join(subject_labels.select("doc_id").dropna().distinct(), "doc_id", "left_anti").distinct()


def corpus_shares(documents: DataFrame, subject_labels: DataFrame, subject_list: DataFrame) -> DataFrame:
    """subject, documents, share_of_documents, expected_share (by words of each document, documents counting alike)."""
    texts = encoded(documents)
    rows = subject_sums(texts, fit(documents, texts, subject_labels, subject_list))
    total = texts.agg(F.count(F.lit(1)).alias("total"))
    counted = rows.groupBy("subject").agg(F.sum("documents").alias("documents"), F.sum("mass").alias("mass"))
    return counted.join(F.broadcast(total)).select("subject", "documents", (F.col("documents") / F.col("total")).alias("share_of_documents"), (F.col("mass") / F.col("total")).alias("expected_share"))
