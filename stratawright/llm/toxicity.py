"""Abusive, hateful or sexual content (problem 4).

Method: maximum-scoring segment search. Tokens are words and pairs of neighbouring words. Each token has, per category, its log-odds
between labelled posts of that category and the whole corpus, smoothed with an informative Dirichlet prior whose strength is
spread over the tokens as they occur in *all* posts, and shrunk by its standard error. A linear-time scan over the running sum finds, in each post,
every maximal passage (Ruzzo and Tompa); a passage is calibrated by an extreme-value (Gumbel) law, fitted to the best passages of
the posts labelled as none, into the probability that ordinary text of that length reaches such a score. All significant passages of
a post, title and text together, are combined by the sum statistic of Karlin and Altschul. Scores of the labelled
posts themselves come from models that have not seen them (two folds), so calibration and threshold are not those of the training.

The classifier is fitted on at most MOST_LABELS labelled posts (a bounded sample by hash of the id); token counts of the prior cover all
posts. Labels are read without case and blanks; repeated rows count once; a post labelled with a category and with none has the category.

Defined cases: null and empty texts score 0 in every category; several rows of one post are one post, scored by its worst
text; long texts are read whole; without labelled cases of a category every score in it is 0; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
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

CATEGORIES = ("abusive", "hateful", "sexual")
#: Most labelled posts that the classifier is fitted on, and most bytes of their texts.
MOST_LABELS, MOST_BYTES = 40_000, 128_000_000
#: Strength of the Dirichlet prior, and what a token costs in a passage.
PRIOR, DRIFT = 30.0, 0.5
#: Rounds of fitting; all but the first learn from the best passages only.
ROUNDS = 4
#: Scores are cut to this range, so that no single token decides.
CLIP = 3.0
#: Surprise from which a passage is significant by itself (one ordinary text in 20 has one) and counts among the passages of its post.
SIGNIFICANT = 1.3
SEED = 7

#: Digits and signs written for letters.
LEET = str.maketrans("0134578@$!", "oieastbasi")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_]([ .\-*_·])(?:[^\W\d_]\1){1,20}[^\W\d_])(?![^\W_])")
RUNS = re.compile(r"(.)\1+")
TOKEN = re.compile(r"[^\W_]+(?:[@$!*]+[^\W_]+)*|[぀-ヿ一-鿿]")
CJK = re.compile(r"[぀-ヿ一-鿿]")
#: Two letters and a digit or sign, or a letter between digits: not a number with a unit or the code of a model.
MIXED = re.compile(r"^(?=.*[\d@$!*])(?:.*[^\W\d_].*[^\W\d_]|\d+[^\W\d_]\d)")
JOINED = re.compile(r"[ .\-*_·]")


def tokens(text: str | None) -> list[str]:
    """Words of a text in one spelling: letters set apart are joined, digits in words become letters, repeated letters one."""
    if not text:
        return []
    text = plain(text).casefold()
    text = SPACED.sub(lambda m: JOINED.sub("", m[0]), text)
    if not text.isascii():
        text = unaccented(romanised(text))
        if CJK.search(text):
            text = CJK.sub(lambda m: f" {m[0]} ", text)
    return TOKEN.findall(text)


def normal(word: str) -> str:
    """Spelling under which a word is counted; numbers are one word."""
    if word.isalpha():
        return RUNS.sub(r"\1", word)
    if word.isdigit():
        return "0"
    if MIXED.match(word):
        word = word.translate(LEET).replace("*", "")
    return RUNS.sub(r"\1", word)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) by the linear-time algorithm of Ruzzo and Tompa."""
    total, kept = 0.0, []  # (start, end, sum before, sum behind, place of the last one that began lower)
    for at, score in enumerate(scores.tolist()):
        before = total
        total += score
        if score <= 0:
            continue
        start = at
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]  # those between began at least as high
            if j < 0 or kept[j][3] >= total:
                kept.append((start, at + 1, before, total, j))
                break
            start, before = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, right - left) for a, b, left, right, _ in kept]


def sum_surprise(z: list[float]) -> float:
    """-log10 of the probability of normalised scores (largest first) as good together, by Karlin and Altschul: the best number of them.

    The sum t of r scores is reached with probability exp(-t) t^(r-1) / (r! (r-1)!); each further passage costs a factor of 2 for the choice.
    """
    best, t = 0.0, 0.0
    for r, x in enumerate(z, 1):
        t += x
        best = max(best, (t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2)) / math.log(10))
    return best


#: Token scores of texts one behind the other, and where each text begins and ends.
Part = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Model:
    words: dict[str, int]  # 0 is any other word
    single: np.ndarray  # (words, categories)
    pair_keys: np.ndarray  # sorted first * len(words) + second
    pair_scores: np.ndarray
    location: np.ndarray  # Gumbel law of the best score, by category: location + scale * log(length)
    scale: np.ndarray
    threshold: np.ndarray

    def token_scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of every token: its own and that of the pair that it ends. ``first`` marks the first token of each text."""
        scores = self.single[ids]
        if len(ids) > 1 and len(self.pair_keys):
            keys = ids[:-1] * len(self.words) + ids[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            hit = np.flatnonzero((self.pair_keys[at] == keys) & ~first[1:])
            scores[hit + 1] += self.pair_scores[at[hit]]
        return scores - DRIFT

    def scored(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all tokens, and where each text begins and ends."""
        starts = np.concatenate([[0], ends[:-1]]).astype("int64")
        first = np.zeros(len(ids), bool)
        first[starts[ends > starts]] = True
        return self.token_scores(ids, first), starts, ends

    def best(self, scores: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Best passage score of every text by category."""
        lengths = ends - starts
        out = np.zeros((len(ends), len(CATEGORIES)))
        some = np.flatnonzero(lengths)
        if not len(some):
            return out
        first = np.zeros(len(scores), bool)
        first[starts[some]] = True
        wall = 4 * CLIP * (int(lengths.max()) + 1)
        for c in range(len(CATEGORIES)):
            # A wall before every text keeps the least prefix within the text; sums of one batch stay exact enough in float64.
            walled = scores[:, c] - first * wall
            prefix = np.cumsum(walled)
            before = np.concatenate([[0.0], prefix[:-1]]) - first * wall
            out[some, c] = np.maximum.reduceat(prefix - np.minimum.accumulate(before), starts[some])
        return np.maximum(out, 0.0)

    def surprise(self, best: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """-log10 of the probability that ordinary text of that length has a passage as good."""
        z = (best - (self.location + self.scale * np.log(np.maximum(lengths, 1))[:, None])) / self.scale
        tail = -np.expm1(-np.exp(-np.clip(z, -30, 600)))
        value = np.where(z > 30, z / np.log(10), -np.log10(np.maximum(tail, 1e-300)))
        return np.where(best > 0, np.maximum(value, 0.0), 0.0)

    def significant(self, parts: list[Part], value: np.ndarray) -> Iterator[tuple[int, int, list[tuple[float, int, int, int, float]]]]:
        """(post, category, passages): all significant passages, best first, of every post and category that has one.

        A passage is (surprise in units of the law, part, first token, token behind its last, score). ``value`` is the surprise of the best passage
        of each post; where it is not significant, none is, so only the others are searched.
        """
        lengths = sum(ends - starts for _, starts, ends in parts)
        least = -math.log(-math.log1p(-(10**-SIGNIFICANT)))
        for i, c in zip(*np.nonzero(value >= SIGNIFICANT), strict=True):
            usual = self.location[c] + self.scale[c] * math.log(max(lengths[i], 1))
            found = [((v - usual) / self.scale[c], n, a, b, v) for n, (scores, starts, ends) in enumerate(parts) for a, b, v in maximal_segments(scores[starts[i] : ends[i], c])]
            if found := sorted((x for x in found if x[0] >= least), reverse=True):
                yield int(i), int(c), found

    def best_surprise(self, parts: list[Part]) -> np.ndarray:
        return self.surprise(np.maximum.reduce([self.best(*part) for part in parts]), sum(ends - starts for _, starts, ends in parts))

    def combined(self, parts: list[Part]) -> np.ndarray:
        """Surprise of all significant passages of every post, whose texts are ``parts``."""
        value = self.best_surprise(parts)
        for i, c, found in self.significant(parts, value.copy()):
            if len(found) > 1:
                value[i, c] = max(value[i, c], sum_surprise([z for z, *_ in found]))
        return value


@dataclass
class Corpus:
    """In how many rows of the whole corpus the words and pairs of the labelled posts occur, and the number of rows."""

    words: np.ndarray
    keys: np.ndarray
    pairs: np.ndarray
    rows: int


class Evidence:
    """Word and pair occurrences of the labelled posts, from which weights are fitted for any choice of passages."""

    def __init__(self, posts: list[list[int]], n_words: int):
        sizes = np.array([len(p) for p in posts], "int64")
        self.words = np.array([w for p in posts for w in p], "int64")
        self.doc = np.repeat(np.arange(len(posts)), sizes)
        self.ends = np.cumsum(sizes)
        self.n_words, self.n_docs = n_words, len(posts)
        joined = (self.words[:-1] >= 0) & (self.words[1:] >= 0) & (self.doc[:-1] == self.doc[1:]) if len(self.words) else np.empty(0, bool)
        self.pair_at = np.flatnonzero(joined) + 1  # place of the second word
        keys = self.words[self.pair_at - 1] * n_words + self.words[self.pair_at]
        self.keys, self.pair = np.unique(keys, return_inverse=True)

    def _docs(self, ids: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
        """In how many posts each id occurs."""
        both = np.unique(ids * np.int64(self.n_docs + 1) + docs)
        return np.bincount(both // (self.n_docs + 1), minlength=size)[:size].astype(float)

    def fit(self, inside: np.ndarray, cases: int, error_of: float, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of words and pairs between the places marked ``inside`` (in ``cases`` posts) and the corpus."""
        real = self.words >= 0

        def odds(ids: np.ndarray, places: np.ndarray, size: int, everywhere: np.ndarray) -> np.ndarray:
            within = inside[places]
            a = self._docs(ids[within], self.doc[places[within]], size)
            b = np.maximum(everywhere - a, 0)
            other = max(corpus.rows - cases, 1)
            alpha = np.maximum(PRIOR * everywhere / max(corpus.rows, 1), 1e-3)
            first = (a + alpha) / np.maximum(cases + PRIOR - a - alpha, 0.5)
            second = (b + alpha) / np.maximum(other + PRIOR - b - alpha, 0.5)
            delta = np.log(first) - np.log(second)
            error = np.sqrt(1 / (a + alpha) + 1 / (b + alpha))
            # Without an occurrence inside, a word only tells against, and at least as much as it is frequent.
            delta = np.where(delta > 0, np.maximum(delta - error_of * np.minimum(error, 1.0), 0), delta)
            return np.clip(np.where((a < 2) & (delta > 0), 0.5 * delta, delta), -CLIP, CLIP)

        ones = odds(self.words[real], np.flatnonzero(real), self.n_words, corpus.words)
        ones[0] = min(ones[0], 0.0)
        at = np.minimum(np.searchsorted(corpus.keys, self.keys), max(len(corpus.keys) - 1, 0))
        pairs = corpus.pairs[at] if len(corpus.keys) else np.zeros(len(self.keys))
        twos = odds(self.pair, self.pair_at, len(self.keys), pairs) if len(self.keys) else np.empty(0)
        return ones, twos


def fit_weights(posts: list[list[int]], labels: np.ndarray, corpus: Corpus, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of single words and pairs by category. ``posts`` are word ids with -1 between texts.

    The first round takes whole posts for passages. Each further round takes the best passage of each labelled case under the
    weights so far, so what a case says besides no longer counts for the category.
    """
    proof = Evidence(posts, n_words)
    ones, twos = np.zeros((n_words, len(CATEGORIES))), np.zeros((len(proof.keys), len(CATEGORIES)))
    for c in range(len(CATEGORIES)):
        cases = np.flatnonzero(labels[:, c])
        if not len(cases):
            continue
        inside = np.isin(proof.doc, cases)
        for error_of in (1.6, 1.0, 0.7, 0.7)[:ROUNDS]:
            one, two = proof.fit(inside, len(cases), error_of, corpus)
            scores = np.where(proof.words >= 0, one[proof.words], -1e6) - DRIFT
            scores[proof.pair_at] += two[proof.pair]
            inside = np.zeros(len(proof.words), bool)
            for d in cases:
                end = proof.ends[d]
                start = end - len(posts[d])
                passages = maximal_segments(scores[start:end])
                best = max((v for *_, v in passages), default=0.0)
                for a, b, value in passages:
                    if value >= 0.7 * best:
                        inside[start + a : start + b] = True
        ones[:, c], twos[:, c] = one, two
    keep = np.abs(twos).max(axis=1, initial=0.0) > 0.2
    return ones, proof.keys[keep], twos[keep]


def labelled(posts: DataFrame, content_labels: DataFrame, most: int = MOST_LABELS) -> tuple[pd.DataFrame, float]:
    """post_id, texts, and a column per category of at most ``most`` labelled posts, and which part of all labelled ids these were taken from."""
    name = F.lower(F.trim(F.regexp_replace("category", r"(?U)\s+", " ")))
    rows = content_labels.filter("post_id is not null").groupBy(F.col("post_id").cast("string").alias("post_id")).agg(*[F.max((name == c).cast("int")).alias(c) for c in CATEGORIES])
    rows = cut(rows)
    share = min(1.0, most / max(1, rows.count()))
    few = rows.orderBy(F.xxhash64("post_id"), "post_id").limit(most)
    texts = posts.select(F.col("post_id").cast("string").alias("post_id"), "title", "selftext").join(F.broadcast(few), "post_id")  # at most ``most`` ids
    found = texts.groupBy("post_id", *CATEGORIES).agg(F.max("title").alias("title"), F.max_by("selftext", F.length("selftext")).alias("selftext"))
    size = F.coalesce(F.octet_length("title"), F.lit(0)) + F.coalesce(F.octet_length("selftext"), F.lit(0))
    order = Window.orderBy(F.xxhash64("post_id"), "post_id")  # over at most ``most`` rows
    found = found.withColumn("so_far", F.sum(size).over(order)).withColumn("with_text", F.count(F.lit(1)).over(Window.partitionBy())).filter(F.col("so_far") <= MOST_BYTES)
    frame = found.toPandas().sort_values("post_id", ignore_index=True)
    return frame.drop(columns=["so_far", "with_text"]), share * (len(frame) / frame["with_text"].iloc[0] if len(frame) else 1.0)


def word_ids(texts: list[str | None], known: dict[str, int], memory: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts one behind the other, and where each text ends. ``memory`` is kept between calls."""
    ids: list[int] = []
    ends = []
    get = memory.get
    for text in texts:
        for word in tokens(text):
            if (i := get(word)) is None:
                if len(memory) > 300_000:
                    memory.clear()
                i = memory[word] = known.get(normal(word), 0)
            ids.append(i)
        ends.append(len(ids))
    return np.array(ids, "int64"), np.array(ends, "int64")


def encoded(posts: DataFrame, words: dict[str, int]) -> DataFrame:
    """post_id, subreddit, title, selftext, the texts as word ids: the texts are read and normalised once for counting and scoring."""
    held = posts.sparkSession.sparkContext.broadcast(words)  # bounded by MOST_LABELS posts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        memory: dict[str, int] = {}
        for batch in batches:
            columns = []
            for column in (2, 3):
                ids, ends = word_ids(batch.column(column).to_pylist(), known, memory)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["post_id", "subreddit", "title", "selftext"])

    rows = posts.filter("post_id is not null").select(F.col("post_id").cast("string").alias("post_id"), F.col("subreddit").cast("string").alias("subreddit"), "title", "selftext")
    return cut(spread(rows).mapInArrow(run, "post_id string, subreddit string, title array<int>, selftext array<int>"))


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists one behind the other, and where each list ends."""
    offsets = lists.offsets.to_numpy().astype("int64")
    return lists.values.to_numpy()[offsets[0] : offsets[-1]].astype("int64"), offsets[1:] - offsets[0]


def corpus_counts(texts: DataFrame, n_words: int, keys: np.ndarray) -> Corpus:
    """Counts over all rows: partial sums by task, one row per word and pair of the labelled posts."""
    held = texts.sparkSession.sparkContext.broadcast(keys)  # bounded by MOST_LABELS posts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        seen, twice, n = np.zeros(n_words, "int64"), np.zeros(len(wanted), "int64"), 0
        for batch in batches:
            words, pairs = [], []
            for column in (0, 1):
                ids, ends = flat(batch.column(column))
                doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                words.append(doc * n_words + ids)
                if len(ids) > 1 and len(wanted):
                    both = ids[:-1] * n_words + ids[1:]
                    at = np.minimum(np.searchsorted(wanted, both), len(wanted) - 1)
                    hit = (wanted[at] == both) & (doc[1:] == doc[:-1])
                    pairs.append(doc[1:][hit] * len(wanted) + at[hit])
            seen += np.bincount(np.unique(np.concatenate(words)) % n_words, minlength=n_words)
            if pairs:
                twice += np.bincount(np.unique(np.concatenate(pairs)) % len(wanted), minlength=len(wanted))
            n += batch.num_rows
        one, two = np.flatnonzero(seen), np.flatnonzero(twice)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], one, n_words + two])), pa.array(np.concatenate([[n], seen[one], twice[two]]))], ["item", "n"])

    rows = texts.select("title", "selftext").mapInArrow(run, "item bigint, n bigint").groupBy("item").agg(F.sum("n").alias("n")).toPandas()
    both, total = np.zeros(n_words + len(keys)), 0
    if len(rows):
        item, n = rows["item"].to_numpy("int64"), rows["n"].to_numpy("float64")
        total = int(n[item < 0].sum())
        both[item[item >= 0]] = n[item >= 0]
    return Corpus(both[:n_words], keys, both[n_words:], total)


def gumbel(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Location and scale of the best scores of ordinary texts, by moments, robust against a few wrong labels."""
    if len(best) < 20:
        return 0.0, 1.0
    scale = 0.5
    for _ in range(8):
        rest = best - scale * np.log(np.maximum(lengths, 1))
        low, middle = np.quantile(rest, [0.25, 0.75])
        scale = float(np.clip((middle - low) / (np.log(np.log(4)) - np.log(np.log(4 / 3))), 0.15, 3.0))
    rest = best - scale * np.log(np.maximum(lengths, 1))
    return float(np.median(rest) + scale * np.log(np.log(2))), scale


def threshold(surprise: np.ndarray, truth: np.ndarray, weight: float) -> float:
    """Least surprise of a case: where precision and recall are best balanced on posts that the model had not seen.

    Each post that is no case stands for ``weight`` posts of the corpus, of which the labelled sample holds relatively many cases.
    """
    if not truth.any():
        return float("inf")
    order = np.argsort(-surprise, kind="stable")
    value, right = surprise[order], np.cumsum(truth[order])
    wrong = weight * np.cumsum(~truth[order])
    f1 = 2 * right / (right + wrong + truth.sum())
    f1[:-1][value[:-1] == value[1:]] = 0
    at = int(np.argmax(f1))
    under = value[at + 1] if at + 1 < len(value) else 0.0
    return float((value[at] + under) / 2)


def train(posts: DataFrame, content_labels: DataFrame) -> tuple[Model, DataFrame]:
    """The fitted model, and the posts as word ids."""
    frame, share = labelled(posts, content_labels)
    vocabulary: dict[str, int] = {"": 0}
    memory: dict[str, int] = {}
    docs = []
    for title, body in zip(frame["title"], frame["selftext"], strict=True):
        ids: list[int] = []
        for text in (title, body):
            for word in tokens(text if isinstance(text, str) else None):
                if word not in memory:
                    memory[word] = vocabulary.setdefault(normal(word), len(vocabulary))
                ids.append(memory[word])
            ids.append(-1)
        docs.append(ids)
    labels = frame[list(CATEGORIES)].to_numpy("int64").reshape(len(frame), len(CATEGORIES))
    n = len(vocabulary)
    texts = encoded(posts, vocabulary)
    told = Evidence([d for d, mine in zip(docs, labels, strict=True) if mine.any()], n)
    corpus = corpus_counts(texts, n, told.keys)

    def model(rows: np.ndarray) -> Model:
        mine = [i for i in rows if labels[i].any()]  # the others are in the corpus counts
        one, keys, two = fit_weights([docs[i] for i in mine], labels[mine].reshape(len(mine), len(CATEGORIES)), corpus, n)
        size = len(CATEGORIES)
        return Model(vocabulary, one, keys, two, np.zeros(size), np.ones(size), np.zeros(size))

    fold = np.random.default_rng(SEED).permutation(len(docs)) % 2
    best, lengths, unseen = np.zeros((len(docs), len(CATEGORIES))), np.zeros(len(docs), "int64"), []
    for side in (0, 1):
        rows = np.flatnonzero(fold == side)
        if len(rows) and (fold != side).any():
            other = model(np.flatnonzero(fold != side))
            cuts = [docs[i].index(-1) for i in rows]
            titles, bodies = [docs[i][:at] for i, at in zip(rows, cuts, strict=True)], [docs[i][at + 1 : -1] for i, at in zip(rows, cuts, strict=True)]
            parts = [other.scored(np.array([w for d in part for w in d], "int64"), np.cumsum([len(d) for d in part])) for part in (titles, bodies)]
            best[rows] = np.maximum.reduce([other.best(*part) for part in parts])
            lengths[rows] = sum(ends - starts for _, starts, ends in parts)
            unseen.append((rows, other, parts))
    final = model(np.arange(len(docs)))
    for c in range(len(CATEGORIES)):
        final.location[c], final.scale[c] = gumbel(best[labels[:, c] == 0, c], lengths[labels[:, c] == 0])
    surprise = np.zeros(best.shape)
    for rows, other, parts in unseen:
        other.location, other.scale = final.location, final.scale
        surprise[rows] = other.combined(parts)
    weight = max(1.0, corpus.rows * share / max(1, len(docs)))  # of all labelled posts, so it does not grow where MOST_LABELS binds
    for c in range(len(CATEGORIES)):
        final.threshold[c] = threshold(surprise[:, c], labels[:, c] == 1, weight)
    return final, texts


def scores(model: Model, texts: DataFrame) -> DataFrame:
    """post_id, subreddit, and by category its score (surprise of its significant passages) and whether it is a case. One row per row of posts."""
    held = texts.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_LABELS posts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            value = own.combined([own.scored(*flat(batch.column(c))) for c in (2, 3)])
            flags = (value >= own.threshold) & (value > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(value[:, c]) for c in range(len(CATEGORIES))), *(pa.array(flags[:, c]) for c in range(len(CATEGORIES)))], ["post_id", "subreddit", *CATEGORIES, *(f"is_{c}" for c in CATEGORIES)])

    kinds = "post_id string, subreddit string, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", " + ", ".join(f"is_{c} boolean" for c in CATEGORIES)
    return texts.mapInArrow(run, kinds)


def passages(model: Model, texts: DataFrame) -> DataFrame:
    """post_id, field, category, first_token, tokens, score, surprise: every significant passage of every post, in tokens of its field."""
    held = texts.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_LABELS posts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            parts = [own.scored(*flat(batch.column(c))) for c in (2, 3)]
            rows = [(i, ("title", "selftext")[n], CATEGORIES[c], a, b - a, v, z / math.log(10)) for i, c, found in own.significant(parts, own.best_surprise(parts)) for z, n, a, b, v in found]
            take, *columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["post_id", "field", "category", "first_token", "tokens", "score", "surprise"])

    return texts.mapInArrow(run, "post_id string, field string, category string, first_token bigint, tokens bigint, score double, surprise double").distinct()


def long_form(scored: DataFrame) -> DataFrame:
    """post_id, subreddit, category, score, is_case: one row per post and category."""
    wide = scored.groupBy("post_id").agg(F.min(F.lower(F.trim("subreddit"))).alias("subreddit"), *[F.max(c).alias(c) for c in CATEGORIES], *[F.max(f"is_{c}").alias(f"is_{c}") for c in CATEGORIES])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score"), F.col(f"is_{c}").alias("is_case")) for c in CATEGORIES]))
    return wide.select("post_id", "subreddit", parts.alias("p")).select("post_id", "subreddit", "p.category", "p.score", "p.is_case")


def found(posts: DataFrame, content_labels: DataFrame) -> DataFrame:
    """post_id, category of every post outside the labelled sample that is a case."""
    scored = scores(*train(posts, content_labels))
    cases = scored.filter(" or ".join(f"is_{c}" for c in CATEGORIES))
    fresh = cases.join(content_labels.select(F.col("post_id").cast("string").alias("post_id")).distinct(), "post_id", "left_anti")
    return long_form(fresh).filter("is_case").select("post_id", "category")


def rates(posts: DataFrame, content_labels: DataFrame) -> DataFrame:
    """subreddit, category, posts, cases, rate."""
    rows = long_form(scores(*train(posts, content_labels)))
    counted = rows.groupBy("subreddit", "category").agg(F.count(F.lit(1)).alias("posts"), F.sum(F.col("is_case").cast("bigint")).alias("cases"))
    return counted.withColumn("rate", F.col("cases") / F.col("posts"))
