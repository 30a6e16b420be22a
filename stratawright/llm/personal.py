"""Personal information inside free text (problem 2).

Method: linear-chain conditional random field over word-shape features, trained from the small labelled table of
``personal_examples`` and decoded by Viterbi in numpy batches. A text is cut into lines, a line into tokens; a token's features are its shape, its ending,
its beginning, its word if the table knows it, the kind of word it is (CLASSES), and those of three neighbours on either side. A token's share in the
scores depends on its type alone, so it is computed once per type and worker and then gathered.

Tokens that cannot belong to an item are left out of the decoding by a bound that is exact: where the best run of labels other than O through a
token loses against O even with the largest moves, the best path has O there, and what lies between is decoded by itself. What the field labels is an item, unless it is none by
definition (a name of a single part or with a digit, a bracket or the end of a sentence in it, a mail address without an at, a telephone number of fewer than
seven digits).

Defined cases: null, empty and blank texts hold no items; long lines are decoded whole; positions are code points of the stored
text; repeated rows give one item each; an empty table gives an empty result; further columns are ignored; a null id takes no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawright.llm.personal_examples import GIVEN, KINDS, labelled_lines, template_words
from stratawright.llm.scrub import plain, unaccented
from stratawright.session import spread

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
INNER = np.array([name[0] == "I" for name in LABELS])
REACH = 3
OFFSETS = 2 * REACH + 1
#: Most features of a token that ``features`` makes; token types remembered per worker.
WIDTH, REMEMBERED = 12, 150_000
EPOCHS, RATE, DECAY, BATCH = 4, 0.4, 5e-4, 40
#: Epoch from which on the weights are averaged.
AVERAGED = 1
#: Fewest occurrences in the table of a feature; how often a word of the table is taken for an unknown one.
KNOWN, KNOWN_WORD, FORGET = 5, 20, 0.2
#: Signs that stand between words or cling to them.
SIGNS = "\n\r\t.,;:!?()[]{}<>\"“”„«»…/|*_#-–—'’。、（）！？"
#: A word is often used in a corpus if it is so many times and in such a share of all rows.
USUAL_ROWS, USUAL_SHARE = 3, 2e-4
#: How likely a corpus uses a word of each kind often as plain or as proper word, as drawn for the labelled table; else it is rare.
USUAL = {"language": (0.84, 0.02), "brand": (0.02, 0.6), "given": (0.02, 0.7), "other": (0.02, 0.15)}

#: A letter, digit or underscore of a script that divides words; Japanese runs are tokens of their own.
_W = r"[^\W぀-ヿ㐀-鿿]"
TOKEN = re.compile(
    r"https?://\S+|www\.\S+"  # links
    r"|&#?\w+;"  # escaped characters
    rf"|(?:{_W}|[.+%-])+[@＠](?:{_W}|-)+(?:\.(?:{_W}|-)+)+"  # an address as such
    rf"|\d+(?:[-./,:]\d+)*(?!{_W})"  # numbers with their separators
    rf"|{_W}+(?:[.+_'’\u00ad\u200b-\u200f\u2060\ufeff-]{_W}+)*"  # words, also joined ones; what shows nothing divides none
    r"|[぀-ヿ㐀-鿿]+"
    r"|[^\w\s]"
)
#: TOKEN for lines in ASCII without a sign that links, mail addresses or escaped characters have.
ASCII_TOKEN = re.compile(r"\d+(?:[-./,:]\d+)*(?!\w)|\w+(?:[.+_'-]\w+)*|[^\w\s]")


def pattern_for(line: str) -> re.Pattern[str]:
    return ASCII_TOKEN if line.isascii() and "@" not in line and "&" not in line and "://" not in line and "www." not in line else TOKEN


SHAPES = str.maketrans({**{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "d" for c in "0123456789"}})
LETTER_RUN = re.compile(r"X{2,}|x{2,}|j{2,}")
DIGIT_RUN = re.compile(r"d+")
GIVEN_NAMES = frozenset(unaccented(n.lower()) for n in GIVEN)
#: Kinds of words, by which the field can tell words that its table does not hold.
CLASSES = {
    "road": "street st road rd avenue ave lane ln drive dr close court ct boulevard blvd way place pl square sq terrace crescent row parkway grove gardens mews walk alley highway hill rue chemin impasse via viale piazza corso vicolo rua avenida travessa largo calle plaza paseo ulica ul aleja plac sokak sokagi cadde caddesi bulvari улица ул проспект переулок",
    "unit": "apt apartment flat unit suite floor fl apto app no nr д", "box": "box pob postfach apartado postbus bp", "title": "mr mrs ms miss dr prof professor sir herr frau señor señora signor signora monsieur madame mme pan pani",
    "identity": "ssn ni nino insurance security passport licence license id identity tax dni nie nif pesel bsn ausweis steuer fiscale fiscal kimlik инн personal", "call": "phone tel telephone mobile cell fax call text ring dial whatsapp sms number telefon",
    "mail": "mail email e-mail at dot", "day": "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december",
    "goods": "order invoice serial part model version ticket case tracking isbn page chapter room lane level", "farewell": "thanks cheers regards sincerely signed love yours hi hello dear greetings",
}
CLASS_OF = {word: f"k={name}" for name, words in CLASSES.items() for word in map(unaccented, words.split())}
ROAD_END = re.compile(r"(?:strasse|str|weg|gasse|allee|platz|ring|damm|ufer|straat|laan|gracht|kade|plein|dijk)$")


def shown(token: str) -> str:
    """A token as it shows: compatibility-composed, without invisible characters, in one script if it mixes look-alike letters."""
    return token if token.isascii() else plain(token)


def folded(token: str) -> str:
    return unaccented(shown(token).lower())


JOIN = re.compile(r"[-'’.]")


@dataclass(frozen=True)
class Usage:
    """Words that a corpus uses often: ``plain`` ones, and ``proper`` ones, which it writes with a capital for the most part."""

    plain: frozenset[str] = frozenset()
    proper: frozenset[str] = frozenset()

    def of(self, low: str, vocabulary: frozenset[str]) -> str:
        if low in self.plain or low in vocabulary:
            return "plain"
        if low in self.proper:
            return "proper"
        if low.isalpha():
            return "rare"
        parts = [p for p in JOIN.split(low) if p]
        return "plain" if all(p in self.plain or p in vocabulary for p in parts) else "rare"


def features(token: str, vocabulary: frozenset[str], usage: str) -> list[str]:
    """Names of a token's features. ``vocabulary`` are the words that count as such, ``usage`` tells how the corpus uses the word (Usage)."""
    text = shown(token)
    low = unaccented(text.lower())
    if text.startswith(("http://", "https://", "www.")):
        return ["s=link", "b"]
    if len(text) > 1 and ("@" in text or "＠" in text):
        return ["s=mail", "b", f"h={low[low.find('@') + 1 :][-4:]}"]
    shape = text.translate(SHAPES) if text.isascii() else "".join("j" if "\u3040" <= c <= "\u9fff" else "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in text)
    runs = LETTER_RUN.sub(lambda m: m[0][0] * 2, shape)
    short = DIGIT_RUN.sub(lambda m: f"d{min(len(m[0]), 12)}", runs)
    out = [f"s={short}", "b"]
    if low in vocabulary:
        out.append(f"w={low}")
    kind = CLASS_OF.get(low.rstrip("."))
    if kind:
        out.append(kind)
    if low.isalpha() or "-" in low or "'" in low:
        given = low in GIVEN_NAMES
        if given:
            out += ["given", f"given:{runs[:2]}"]
        elif not kind and len(low) > 5 and ROAD_END.search(low):
            out.append("k=road")
        if "j" not in runs:
            out.append(f"i={runs[:1]}{min(len(low), 3)}")
            if not given and len(low) > 1:
                out += [f"c={runs[:2]}:{usage}", f"c={usage}"]
    elif low[:1].isdigit():
        out += [f"n={short}:{low[:1]}", f"n={short}:{low[:2]}", f"q={sum(c.isdigit() for c in low)}"]
    elif not any(map(str.isalnum, low)):
        out.append("sign")
    elif "d" in shape:
        out += [f"q={sum(c.isdigit() for c in low)}", "mixed"]
    return out


class Tagger:
    """Weights of the field: ``weights`` (features, offsets, labels), ``moves`` (labels, labels), ``starts`` (labels).

    ``vocabulary`` are the words of the labelled table, ``usage`` how the corpus at hand uses its words.
    """

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, starts: np.ndarray, vocabulary: frozenset[str], usage: Usage = Usage()):
        self.names, self.weights, self.moves, self.starts, self.vocabulary, self.usage = names, weights, moves, starts, vocabulary, usage
        self._reset()

    def __getstate__(self) -> tuple:
        return self.names, self.weights, self.moves, self.starts, self.vocabulary, self.usage

    def __setstate__(self, state: tuple) -> None:
        self.names, self.weights, self.moves, self.starts, self.vocabulary, self.usage = state
        self._reset()

    def knowing(self, usage: Usage) -> Tagger:
        """The same field for a corpus of that usage."""
        return Tagger(self.names, self.weights, self.moves, self.starts, self.vocabulary, usage)

    def _reset(self) -> None:
        self.types: dict[str, int] = {"": 0}
        self.shares = np.zeros((1024, OFFSETS, len(LABELS)), "float32")  # by type: what it adds to the token at each offset
        gain = self.moves - self.moves[0, 0]
        self.step = np.maximum(gain.max(axis=0), self.starts - self.starts[0])[1:]  # most that each label other than O wins by the move into it
        self.out = float(max(gain[1:, 0].max(), 0.0))  # and by the move out of it

    def slots(self, token: str) -> list[int]:
        low = folded(token)
        return [i for f in features(token, self.vocabulary, self.usage.of(low, self.vocabulary)) if (i := self.names.get(f)) is not None]

    def type_of(self, token: str) -> int:
        at = self.types.get(token)
        if at is None:
            at = self.types[token] = len(self.types)
            if at >= len(self.shares):
                self.shares = np.concatenate([self.shares, np.zeros_like(self.shares)])
            self.shares[at] = self.weights[self.slots(token)].sum(axis=0)
        return at

    def emissions(self, types: np.ndarray) -> np.ndarray:
        """Scores (tokens, labels) of all tokens one behind the other; ``types`` has REACH zeros around every line."""
        n = len(types) - 2 * REACH
        out = np.zeros((n, len(LABELS)), "float32")
        for o in range(OFFSETS):
            out += self.shares[:, o][types[o : o + n]]
        return out

    def live(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which tokens may have a label other than O in a best path.

        A run of such labels wins no more over O than its tokens' largest gains and the largest moves; the best run through a token is the token with
        the best runs that end before and begin behind it. Where even that loses, the token is O. Lines begin at ``starts``.
        """
        gain = (scores[:, 1:] - scores[:, :1] + self.step).max(axis=1).astype(float)
        first, last = np.zeros(len(gain), bool), np.zeros(len(gain), bool)
        first[starts], last[np.append(starts[1:], len(gain)) - 1] = True, True
        return best_ending(gain, first) + best_ending(gain[::-1], last[::-1])[::-1] - gain + self.out >= 0

    def decode(self, scores: np.ndarray, heads: np.ndarray, tails: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Labels of all tokens, by Viterbi over the parts [head, tail) and O elsewhere.

        ``opens`` and ``closes`` tell which parts begin and end their line; an O stands on the other sides. Parts of one length are decoded together.
        """
        labels = np.zeros(len(scores), "int8")
        sizes = tails - heads
        order = np.argsort(sizes, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            n = int(sizes[same[0]])
            for some in np.array_split(same, -(-len(same) * n // 60_000)):
                at = heads[some]
                best = np.where(opens[some, None], self.starts, self.moves[0]) + scores[at]
                back = []
                for t in range(1, n):
                    through = best[:, :, None] + self.moves
                    back.append(through.argmax(axis=1))
                    best = through.max(axis=1) + scores[at + t]
                label = (best + np.where(closes[some, None], 0, self.moves[:, 0])).argmax(axis=1)
                rows = np.arange(len(some))
                for t in range(n - 1, -1, -1):
                    labels[at + t] = label
                    if t:
                        label = back[t - 1][rows, label]
        return labels


def best_ending(gain: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest sum of a run that ends at each place and begins in the same line; ``first`` marks where lines begin."""
    total = np.cumsum(gain)
    before = np.concatenate([[0.0], total[:-1]])
    # A drop larger than all sums before each line keeps the least prefix within the line.
    drop = np.cumsum(first) * (np.abs(gain).sum() + 1.0)
    return total - drop - np.minimum.accumulate(before - drop)


# --- training ----------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def train() -> Tagger:
    """The tagger, by stochastic gradient of the log-likelihood (forward-backward), averaged over the later steps, with a fixed seed."""
    from stratawright.llm.language import SEEDS

    plain_lines = [s.strip() for text in SEEDS.values() for s in re.split(r"(?<=[.?!])\s+", text)]
    lines, invented, given = labelled_lines(more_without=plain_lines)
    vocabulary = frozenset(folded(t) for line in [*template_words(), *plain_lines] for t in TOKEN.findall(line) if len(t) > 1 and t.isalpha())
    rng = np.random.default_rng(3)
    tokens, gold = [], []
    counts: dict[str, int] = {}
    made: dict[tuple[str, bool, str], list[str]] = {}
    for text, items in lines:
        spans = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
        labels = np.zeros(len(spans), "int64")
        for a, b, kind in items:
            inside = [i for i, (x, y, _) in enumerate(spans) if x < b and y > a]
            for k, i in enumerate(inside):
                labels[i] = LABELS.index(("I-" if k else "B-") + kind)
        found = []
        for *_, token in spans:
            low = folded(token)
            # How a corpus will use a word is drawn: words of the language are mostly often, parts of names seldom.
            plain, proper = USUAL["language"] if low in vocabulary else USUAL["brand"] if low in invented else USUAL["given"] if low in given or low in GIVEN_NAMES else USUAL["other"]
            draw = rng.random()
            usage = "plain" if draw < plain else "proper" if draw < plain + proper else "rare"
            key = (token, bool(rng.random() > FORGET), usage)
            if key not in made:
                made[key] = features(token, vocabulary if key[1] else frozenset(), usage)
            found.append(made[key])
            for f in found[-1]:
                counts[f] = counts.get(f, 0) + 1
        tokens.append(found)
        gold.append(labels)
    names = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= (KNOWN_WORD if f[:2] == "w=" else KNOWN)))}
    size, k = len(names) + 1, len(LABELS)
    weights = np.zeros((size, OFFSETS, k), "float32")  # the last row stays zero and pads
    moves, starts = np.zeros((k, k), "float32"), np.zeros(k, "float32")
    for a, label in enumerate(LABELS):
        for b, following in enumerate(LABELS):
            if following[0] == "I" and label[2:] != following[2:]:
                moves[a, b] = -20.0
        if label[0] == "I":
            starts[a] = -20.0
    fixed = moves < -10
    squares = [np.full_like(x, 1e-6) for x in (weights, moves, starts)]
    sums, steps = [np.zeros(x.shape) for x in (weights, moves, starts)], 0
    slots = [[(at := [names[f] for f in found if f in names]) + [size - 1] * (WIDTH - len(at)) for found in line] for line in tokens]
    order = np.arange(len(lines))
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        chunks = sorted((order[i : i + BATCH * 8] for i in range(0, len(order), BATCH * 8)), key=lambda c: c[0])
        batches = [b[i : i + BATCH] for c in chunks for b in [c[np.argsort([len(tokens[j]) for j in c], kind="stable")]] for i in range(0, len(b), BATCH)]
        rng.shuffle(picks := np.arange(len(batches)))
        for pick in picks:
            rows = [r for r in batches[pick] if len(tokens[r])]
            n = max(len(tokens[r]) for r in rows)
            feats = np.full((len(rows), n + 2 * REACH, WIDTH), size - 1, "int64")
            truth, mask = np.zeros((len(rows), n), "int64"), np.zeros((len(rows), n), bool)
            for i, r in enumerate(rows):
                feats[i, REACH : REACH + len(tokens[r])] = slots[r]
                truth[i, : len(tokens[r])], mask[i, : len(tokens[r])] = gold[r], True
            scores = np.zeros((len(rows), n, k), "float32")
            for o in range(OFFSETS):
                scores += weights[feats[:, o : o + n], o].sum(axis=2)
            scores[~mask] = 0
            # Forward and backward in probabilities, every step scaled to sum 1, so that a step is one product of matrices.
            emitted, turn = np.exp((scores - scores.max(axis=2, keepdims=True)).astype(float)), np.exp(moves.astype(float))
            forward, backward, scale = np.empty_like(emitted), np.ones_like(emitted), np.ones((len(rows), n, 1))
            for t in range(n):
                step = (forward[:, t - 1] @ turn if t else np.exp(starts.astype(float))) * emitted[:, t]
                scale[:, t] = step.sum(axis=1, keepdims=True)
                forward[:, t] = step / scale[:, t]
                if t and (over := ~mask[:, t]).any():
                    forward[over, t], scale[over, t] = forward[over, t - 1], 1.0
            ahead = emitted / scale
            for t in range(n - 2, -1, -1):
                backward[:, t] = (ahead[:, t + 1] * backward[:, t + 1]) @ turn.T
                if (over := ~mask[:, t + 1]).any():
                    backward[over, t] = 1.0
            wrong = forward * backward
            wrong[np.arange(len(rows))[:, None], np.arange(n)[None], truth] -= 1
            wrong[~mask] = 0
            first = wrong[:, 0].sum(axis=0)
            inner = mask[:, 1:]
            pair = turn * (forward[:, :-1][inner].T @ (ahead * backward)[:, 1:][inner])
            np.subtract.at(pair, (truth[:, :-1][mask[:, 1:]], truth[:, 1:][mask[:, 1:]]), 1)
            pair[fixed] = 0
            first[starts < -10] = 0
            windows = np.stack([feats[:, o : o + n] for o in range(OFFSETS)])[:, mask]  # (offset, token, feature)
            offset, token, place = np.nonzero(windows != size - 1)
            at = windows[offset, token, place] * OFFSETS + offset
            pull = wrong[mask][token]
            grad = np.empty((size * OFFSETS, k), "float32")
            for label in range(k):
                grad[:, label] = np.bincount(at, weights=pull[:, label], minlength=len(grad))
            grad = grad.reshape(weights.shape) / len(rows)
            grad[-1] = 0
            for value, square, slope in zip((weights, moves, starts), squares, (grad, pair / len(rows), first / len(rows)), strict=True):
                square += slope * slope
                value -= RATE * slope / np.sqrt(square + 1e-8)
            weights *= 1 - DECAY
            weights[-1] = 0
            if epoch >= AVERAGED:
                for value, mean in zip((weights, moves, starts), sums, strict=True):
                    mean += value
                steps += 1
    weights, moves, starts = ((x / steps).astype("float32") for x in sums)
    return Tagger(names, weights[:-1].copy(), moves, starts, vocabulary)


# --- items -------------------------------------------------------------------------------------------------------------------

PART = re.compile(r"[^\W\d_]+")
AT = re.compile(r"[@＠]|\bat\b", re.IGNORECASE)
NO_NAME = re.compile(r"[\d()\[\]]|[^\W\d_]{2}[.!?:]")


def is_item(kind: str, item: str) -> bool:
    """Whether what the field found can be an item at all, by what its kind means.

    A name has two parts or more, no digit or bracket, and no sentence ends within it; a mail address has an at, a telephone number seven digits;
    the others have a digit.
    """
    if kind == "email":
        return bool(AT.search(item))
    if kind != "name":
        return sum(map(str.isdigit, item)) >= (7 if kind == "phone" else 1)
    return len(PART.findall(item)) > 1 and not NO_NAME.search(item[:-1])


def find_items(tagger: Tagger, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Items (start, end, kind) of every text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if len(tagger.types) > REMEMBERED:
        tagger._reset()
    get, new = tagger.types.get, tagger.type_of
    lines: list[tuple[int, int, str]] = []
    flat: list[int] = [0] * REACH
    ends: list[int] = []
    gap = [0] * REACH
    for i, text in enumerate(texts):
        if not text:
            continue
        at = 0
        for line in text.split("\n"):
            words = pattern_for(line).findall(line)
            if words:
                flat += [get(w) or new(w) for w in words]
                flat += gap
                ends.append(len(flat) - REACH)
                lines.append((i, at, line))
            at += len(line) + 1
    if not lines:
        return out
    stops = np.array(ends, "int64")
    scores = tagger.emissions(np.array(flat, "int64"))
    begins = np.concatenate([[0], stops[:-1]])  # in scores, which have no zeros in front
    real = np.ones(len(scores), bool)
    real[(stops[:-1, None] - 1 - np.arange(REACH)).ravel()] = False  # the gap behind each line but the last
    scores, sizes = scores[real], stops - begins - REACH
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    live = tagger.live(scores, begins)
    first, last = np.zeros(len(live), bool), np.zeros(len(live), bool)
    first[begins], last[begins + sizes - 1] = True, True
    heads = np.flatnonzero(live & (first | ~np.concatenate([[False], live[:-1]])))
    tails = np.flatnonzero(live & (last | ~np.concatenate([live[1:], [False]]))) + 1
    labels = tagger.decode(scores, heads, tails, first[heads], last[tails - 1])
    found = np.flatnonzero(labels)
    if not len(found):
        return out
    inner = INNER[labels[found]]  # I-: belongs to the item before, which is of its kind and next to it
    owner = np.searchsorted(begins, found, side="right") - 1
    spans: list[tuple[int, int]] = []
    seen = -1
    ends_at = np.append(np.flatnonzero(~inner)[1:], len(found)) - 1
    for k, end in zip(np.flatnonzero(~inner).tolist(), ends_at.tolist(), strict=True):
        j = int(owner[k])
        i, at, line = lines[j]
        if j != seen:
            spans, seen = [m.span() for m in pattern_for(line).finditer(line)], j
        kind = LABELS[labels[found[k]]][2:]
        a, b = spans[found[k] - begins[j]][0], spans[found[end] - begins[j]][1]
        if kind == "phone" and a and (line[a - 1] == "+" or line[a - 1] == "(" and ")" in line[a:b]):
            a -= 1  # the sign or bracket that opens a number belongs to it
        if is_item(kind, line[a:b]):
            out[i].append((at + a, at + b, kind))
    return out


def redact(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
    """The text with ``[KIND]`` in place of every item."""
    if not text:
        return text
    parts, at = [], 0
    for a, b, kind in sorted(items):
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def usage_of(posts: DataFrame) -> Usage:
    """How the corpus uses its words: those that make up USUAL_SHARE or more of a word per row (and USUAL_ROWS), by how they are mostly written.

    Counted in the JVM over all texts with partial sums; signs are blanked and words split at blanks, which needs no regular expression.
    The list has at most (words of a row) / USUAL_SHARE entries.
    """
    rows = posts.filter("post_id is not null")
    total = rows.count()
    text = F.translate(F.concat_ws(" ", "title", "selftext"), SIGNS, " " * len(SIGNS))
    counted = rows.select(F.explode(F.split(text, " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(r"word rlike '^\\p{L}+$'")
    low = F.lower("word")
    joined = counted.groupBy(low.alias("low")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("word") == low, F.col("n")).otherwise(0)).alias("plain"))
    plain, proper = set(), set()
    for row in joined.filter(F.col("n") >= max(USUAL_ROWS, USUAL_SHARE * total)).collect():
        (plain if 2 * row.plain >= row.n else proper).add(folded(row.low))
    return Usage(frozenset(plain), frozenset(proper - plain))


def personal_items(posts: DataFrame) -> DataFrame:
    """post_id, field, kind, start_pos, end_pos: one row per item of title and selftext."""
    held = posts.sparkSession.sparkContext.broadcast(train().knowing(usage_of(posts)))  # bounded by USUAL_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held.value
        for batch in batches:
            take, rows = [], []
            for column, field in ((1, "title"), (2, "selftext")):
                for i, items in enumerate(find_items(tagger, batch.column(column).to_pylist())):
                    for a, b, kind in items:
                        take.append(i)
                        rows.append((field, kind, a, b))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["post_id", "field", "kind", "start_pos", "end_pos"])

    rows = spread(posts.filter("post_id is not null").select(F.col("post_id").cast("string"), "title", "selftext"))
    return rows.mapInArrow(run, "post_id string, field string, kind string, start_pos bigint, end_pos bigint")


def redacted(posts: DataFrame) -> DataFrame:
    """post_id, title, selftext with typed placeholders, and n_items. One row per row of ``posts``."""
    held = posts.sparkSession.sparkContext.broadcast(train().knowing(usage_of(posts)))  # bounded by USUAL_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held.value
        for batch in batches:
            columns, number = [], [0] * batch.num_rows
            for column in (1, 2):
                texts = batch.column(column).to_pylist()
                found = find_items(tagger, texts)
                number = [n + len(items) for n, items in zip(number, found, strict=True)]
                columns.append(pa.array([redact(t, items) for t, items in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(number, pa.int64())], ["post_id", "title", "selftext", "n_items"])

    rows = spread(posts.select(F.col("post_id").cast("string"), "title", "selftext"))
    return rows.mapInArrow(run, "post_id string, title string, selftext string, n_items bigint")


def found(posts: DataFrame) -> DataFrame:
    """post_id, field, kind, start_pos: distinct items over the rows of each post."""
    return personal_items(posts).select("post_id", "field", "kind", "start_pos").distinct()
