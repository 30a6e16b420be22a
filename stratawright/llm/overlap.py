"""Same or near-same records across splits (problem 1).

Method: minwise hash shingles with banded buckets. A title is reduced to its *matter*: the words that tell what it is about,
without what is asked, particles, tags and the order of its parts, and its *codes*, the words that hold a digit (models, lengths of
time, running numbers). Equal codes are a condition for a pair, so they are part of every bucket key. The shingles are the letter trigrams of the
words of the matter, each within its word, because a matter is the same in whatever order its parts stand and a slip of the pen spoils
few of them; test data states the case by matter, so it replaces shingles of five words. Only buckets that hold both a train and
an evaluation title give candidates; they are verified by the exact Jaccard similarity of their shingle sets and by
aligning their words, where a word may differ by slips (dropped, doubled or swapped letters) only.

What is asked is told in two ways, neither of which holds phrases. A clause of a title that is no more than half of it, without a code,
and either ends in a question mark with a word of asking in it or consists of words of request for at least half, is an asking clause and left out. And
the corpus itself teaches which words ask: a word that lies in such short question clauses in ASKED or more of all titles that have it
is an asking word wherever it stands, so the same question is recognised without its sign or its comma.

Everything up to the last join works on *distinct* matters, so copies of one title are compared once; a bucket holds distinct
matters with the same codes and the same minima, in essence the pairs to be reported.

Defined cases: null titles, titles without a letter, and rows without a known split take no part; a null id takes no part; several rows of one
id are one post; ties and repeated rows give one pair; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawright.llm.scrub import plain, romanised, unaccented
from stratawright.session import cut, spread

#: Two matters of similarity s share a bucket with probability 1 - (1 - s ** ROWS) ** BANDS: 0.991 at SIMILARITY, the least that counts.
BANDS, ROWS = 26, 3
#: Least Jaccard similarity of the trigram sets of two matters. Two slips in each of two of nine words leave about 0.6.
SIMILARITY = 0.55

#: Share of a word's titles in which it lies in a short question clause, from which on it is a word that asks; and the fewest titles that
#: tell, as a number and as a share of all titles, which bounds the list by (words of a title) / LEAST_SHARE entries.
ASKED, LEAST_TITLES, LEAST_SHARE = 0.4, 3, 2e-5

#: Articles, possessives, prepositions and particles, which carry no matter, by language.
PARTICLES = {
    "en": "a an the my our your its of from in on at to for with and or is are am be very just really please also simply actually maybe",
    "de": "der die das dem ein eine mein meine von in mit für und ist sehr nur wirklich bitte auch", "fr": "le la les un une mon ma de du en dans et est très juste vraiment aussi",
    "es": "el la los las un una mi de en y es muy solo realmente también", "pt": "o a os as um uma meu minha de em e muito só mesmo realmente também",
    "it": "il lo la i gli le un una mio mia di in e molto solo davvero anche", "nl": "de het een mijn van in en is heel erg alleen echt ook even",
    "pl": "i oraz w na z bardzo tylko naprawdę też także proszę", "tr": "bir ve çok sadece gerçekten lütfen", "ru": "и в на с очень только правда действительно тоже также пожалуйста просто", "ja": "本当",
}
#: Marks that forums put to a title.
MARKS = "repost crosspost xpost post update updated edit edited solved bump help question discussion x 2nd 3rd try attempt"
#: Interrogatives and auxiliaries that open questions, by language.
ASKERS = {
    "en": "who what why how where when which can could should would will does do did is are am has have any anyone anybody someone somebody", "de": "wer was warum wie wo wann welche kann soll sollte hat ist jemand",
    "fr": "qui que quoi pourquoi comment où quand quel est dois peut quelqu", "es": "quién qué por cómo dónde cuándo cuál es debería puede alguien", "pt": "quem que como onde quando qual é devo pode alguém",
    "it": "chi che perché come dove quando quale è dovrei può qualcuno", "nl": "wie wat waarom hoe waar wanneer welke kan moet is heeft iemand", "pl": "kto co czemu dlaczego jak gdzie kiedy czy ktoś",
    "tr": "kim ne neden nasıl nerede hangi mi mı mu mü var", "ru": "кто что почему как где когда какой ли стоит есть", "ja": "何 誰 普通",
}
#: Words of request, by language.
REQUESTS = {
    "en": "advice advise thoughts ideas tips suggestions recommendations opinions explain appreciate appreciated thanks clue wondering", "de": "rat hilfe tipps ideen vorschläge danke", "fr": "conseil conseils aide avis merci",
    "es": "consejo consejos ayuda gracias", "pt": "conselho ajuda dicas obrigado", "it": "consiglio consigli aiuto grazie", "nl": "advies hulp bedankt", "pl": "rada porada pomoc dzięki",
    "tr": "tavsiye yardım teşekkürler", "ru": "совет помогите подскажите спасибо", "ja": "助言 教",
}

LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[一-鿿々]+|[゠-ヿ]+|[぀-ゟ]+|[^\W_぀-ヿ一-鿿]+")
KANA = re.compile(r"^[぀-ゟ]+$")
#: Where clauses end: signs that are not inside a word or number, and brackets.
CLAUSE = re.compile(r"(?<!\w)[-–—/](?!\w)|[.:,?!…](?!\w)|[;()\[\]{}|。？！、：；（）「」]")
#: Words and clause ends of a text in ASCII, as WORD and CLAUSE find them.
ASCII = re.compile(r"[a-z0-9]+|[;()\[\]{}|]|[.:,?!](?![a-z0-9_])|(?<![a-z0-9_])[-/](?![a-z0-9_])")
TAG = re.compile(r"\[[^\[\]\d]{1,40}\]")
QUESTION = re.compile(r"[?？]$|か[。]?$")


def words_of(text: str) -> list[str]:
    """Words in one spelling. Japanese is cut into runs of one script, of which syllables without meaning are left out."""
    return _words(plain(text))


def _words(text: str) -> list[str]:
    text = unaccented(romanised(text.casefold()))
    return [w for w in WORD.findall(text) if not KANA.match(w)]


def _table(*lists: str) -> frozenset[str]:
    return frozenset(w for words in lists for w in words_of(words))


_PARTICLES = _table(MARKS, *PARTICLES.values())
_ASKERS, _REQUESTS = _table(*ASKERS.values()), _table(*REQUESTS.values())


def clauses(title: str) -> list[tuple[list[str], bool]]:
    """Words of each clause of a title, and whether it is asking as far as its sign tells. Tags in square brackets are left out."""
    text = plain(title)
    if "[" in text:
        text = TAG.sub(" ", text)
    out: list[tuple[list[str], bool]] = []
    words: list[str] = []
    if text.isascii():
        for token in ASCII.findall(text.lower()):
            if token.isalnum():
                words.append(token)
            elif words:
                out.append((words, token == "?"))
                words = []
        return [*out, (words, False)] if words else out
    at = 0
    for end in [*(m.end() for m in CLAUSE.finditer(text)), len(text)]:
        words = _words(text[at:end])
        if words:
            out.append((words, bool(QUESTION.search(text[at:end].rstrip()))))
        at = end
    return out


def asking_clauses(parts: list[tuple[list[str], bool]]) -> list[bool]:
    """Which clauses are short questions: no code in them, and at most half of the title."""
    total = sum(len(words) for words, _ in parts)
    return [question and 2 * len(words) <= total + 2 and all(map(str.isalpha, words)) for words, question in parts]


class Fillers:
    """Words without matter: particles, marks, and the words that ask, as the corpus taught them."""

    def __init__(self, asking: Iterable[str] = ()):
        self.words = _PARTICLES | frozenset(asking)
        self._reset()

    def __getstate__(self) -> frozenset[str]:
        return self.words

    def __setstate__(self, words: frozenset[str]) -> None:
        self.words = words
        self._reset()

    def _reset(self) -> None:
        self.by_letter: dict[str, list[tuple[str, int]]] = {}
        for word in sorted(self.words):
            if len(word) >= 4:
                self.by_letter.setdefault(word[0], []).append((word, _letters(word)))
        self.known: dict[str, bool] = {}

    def slip(self, word: str) -> bool:
        """Whether a word is a filler but for slips."""
        if len(word) < 4:
            return word in self.words
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            mine = _letters(word)
            found = word in self.words or any((mine ^ letters).bit_count() <= 2 and slips(word, filler) for filler, letters in self.by_letter.get(word[0], ()))
            self.known[word] = found
        return found


def matter_of(title: str | None, fillers: Fillers) -> tuple[str, str] | None:
    """(codes, words), each sorted and joined by blanks; None if the title has no letter."""
    if title is None or not LETTER.search(title):
        return None
    parts = clauses(title)
    total = sum(len(words) for words, _ in parts)
    codes, kept, asked, known = [], set(), set(), fillers.words
    for (words, _), short in zip(parts, asking_clauses(parts), strict=True):
        new = [w for w in words if w not in known]
        asks = short and not _ASKERS.isdisjoint(words)
        if not asks and new and 2 * len(words) <= total and not _REQUESTS.isdisjoint(new):
            asks = len(new) <= 2 * sum(w in _REQUESTS for w in new) and all(map(str.isalpha, words))
        for word in new:
            if not word.isalpha():
                codes.append(word)
            else:
                (asked if asks else kept).add(word)
    if len(kept) + len(codes) < 3:  # too little is left to tell a matter by
        kept |= asked
    if not kept and not codes:
        kept = set(words_of(title))
    return " ".join(sorted(codes)), " ".join(sorted(kept))


# --- minima ------------------------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20_240_611)
_MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype="uint64") | np.uint64(1)


def shingle_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter trigrams of all words of all rows, and where each row begins."""
    marked = [f"{w.replace(' ', '  ')} " for w in words]
    starts = np.cumsum([0, *(len(m) + 1 for m in marked)])[:-1]
    codes = np.frombuffer((" " + " ".join(marked) + " ").encode("utf-32-le"), "uint32").astype("uint64")
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed, starts


def band_keys(codes: list[str], words: list[str]) -> np.ndarray:
    """BANDS bucket keys of every row, as int64."""
    hashes, starts = shingle_hashes(words)
    keys = np.empty((len(words), BANDS), "uint64")
    salt = pd.util.hash_array(np.array(codes, dtype=object)) if codes else np.empty(0, "uint64")
    for n in range(BANDS * ROWS):
        band, row = divmod(n, ROWS)
        least = np.minimum.reduceat((hashes * _MULTIPLY[n]) >> np.uint64(20), starts)
        key = key if row else salt * np.uint64(0xD6E8FEB86659FD93) + np.uint64((band + 1) * 0x2545F4914F6CDD1D % (1 << 64))
        key = (key ^ least) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
        keys[:, band] = key
    return keys.view("int64")


# --- verification ------------------------------------------------------------------------------------------------------------


def trigrams(words: str) -> set[str]:
    return {f" {w} "[i : i + 3] for w in words.split(" ") for i in range(len(w))}


def slips(a: str, b: str, most: int = 2) -> bool:
    """Whether ``a`` becomes ``b`` by at most ``most`` dropped, added or swapped letters behind the first."""
    if a[:1] != b[:1] or abs(len(a) - len(b)) > most or min(len(a), len(b)) < 3:
        return False
    if max(len(a), len(b)) < 5:
        most = 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = row[j - 1] if x == y else min(row[j], now[j - 1]) + 1
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, row = row, now
    return row[-1] <= most


def _letters(word: str) -> int:
    """Set of the letters of a word as bits; a slip changes at most one."""
    return sum({1 << ord(c) % 64 for c in word})


def outline(words: str, fillers: Fillers) -> int:
    """First letters of the words of a matter, as bits: in the upper 32 those that need a partner in a like matter, in the lower 32 all.

    Slips leave the first letter, so each word that is no slip of a filler has a partner with its first letter in the other matter.
    The n-th word with a letter has a bit of its own; bits shared by chance only let more pairs through.
    """
    every: dict[str, int] = {}
    firm: dict[str, int] = {}
    bits = 0
    for word in words.split(" "):
        first = word[:1]
        every[first] = n = every.get(first, 0) + 1
        bits |= 1 << (ord(first or " ") * 11 + n * 7) % 32
        if not fillers.slip(word):
            firm[first] = n = firm.get(first, 0) + 1
            bits |= 1 << 32 + (ord(first or " ") * 11 + n * 7) % 32
    return bits - (1 << 64) if bits >> 63 else bits


def may_match(a: Column, b: Column) -> Column:
    """Whether the outlines let two matters be one: true for every pair that same_matter accepts."""
    low = F.lit(0xFFFFFFFF)

    def unmet(x: Column, y: Column) -> Column:
        return F.shiftrightunsigned(x, 32).bitwiseAND(F.bitwise_not(y)).bitwiseAND(low)

    return (unmet(a, b) == 0) & (unmet(b, a) == 0)


def same_matter(a: str, b: str, fillers: Fillers) -> bool:
    """Whether two matters with equal codes are one."""
    if a == b:
        return True
    x, y = trigrams(a), trigrams(b)
    if len(x & y) < SIMILARITY * len(x | y):
        return False
    one, two = set(a.split(" ")), set(b.split(" "))
    only, other = sorted(one - two), sorted(two - one)
    for word in list(only):
        match = next((w for w in other if slips(word, w)), None)
        if match is not None:
            only.remove(word)
            other.remove(match)
    return all(fillers.slip(w) for w in [*only, *other])


# --- plan --------------------------------------------------------------------------------------------------------------------


def split_name(column: str | Column) -> Column:
    """train, dev, test or null, without regard to case and blanks."""
    col = F.col(column) if isinstance(column, str) else column
    name = F.lower(F.regexp_replace(col, r"(?U)\s+", ""))
    return F.when(name.isin("train", "dev", "test"), name)


def titles(posts: DataFrame) -> DataFrame:
    """post_id, split, subreddit, title of the rows that may take part."""
    rows = posts.select(F.col("post_id").cast("string").alias("post_id"), split_name("split").alias("split"), F.col("subreddit").cast("string").alias("subreddit"), "title")
    return rows.filter("post_id is not null and split is not null and title is not null")


def asking_words(rows: DataFrame) -> Fillers:
    """Fillers with the words that lie in short question clauses in ASKED or more of the titles that have them, over all titles.

    Each task sums its own titles first, so one row per task and word is exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, asked = Counter(), Counter()
        for batch in batches:
            for title in batch.column(0).to_pylist():
                parts = clauses(title)
                seen.update({w for words, _ in parts for w in words})
                if len(parts) > 1:
                    asked.update({w for (words, _), short in zip(parts, asking_clauses(parts), strict=True) if short for w in words})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([asked[w] for w in seen], pa.int64())], ["word", "n", "asked"])

    total = rows.count()
    counted = spread(rows.select("title")).mapInArrow(run, "word string, n bigint, asked bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))
    least = max(LEAST_TITLES, LEAST_SHARE * total)
    return Fillers(r.word for r in counted.filter((F.col("n") >= least) & (F.col("asked") >= ASKED * F.col("n"))).select("word").collect())


def matters(rows: DataFrame, fillers: Fillers, texts: bool) -> DataFrame:
    """Of every title that has a matter: with ``texts`` train, codes, words and matter_id, else post_id, split, subreddit, train and matter_id."""
    kept = ["split"] if texts else ["post_id", "split", "subreddit"]
    held = rows.sparkSession.sparkContext.broadcast(fillers)  # bounded by LEAST_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = [matter_of(t, own) for t in batch.column(len(kept)).to_pylist()]
            keep = pa.array([m is not None for m in found], pa.bool_())
            some = [m for m in found if m is not None]
            columns = [batch.column(i).filter(keep) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m[0] for m in some], pa.string()), pa.array([m[1] for m in some], pa.string())], [*kept, "codes", "words"])

    found = spread(rows.select(*kept, "title")).mapInArrow(run, ", ".join(f"{c} string" for c in [*kept, "codes", "words"]))
    found = found.withColumn("matter_id", F.xxhash64("codes", "words")).withColumn("train", F.col("split") == "train")
    return found.drop("split") if texts else found.drop("codes", "words")


def matter_links(rows: DataFrame, fillers: Fillers) -> DataFrame:
    """Distinct (train_id, eval_id) of matters that are one, an identical one included."""
    distinct = matters(rows, fillers, texts=True).groupBy("matter_id").agg(F.first("codes").alias("codes"), F.first("words").alias("words"), F.max("train").alias("t"), F.max(~F.col("train")).alias("e"))
    distinct = cut(distinct)
    held = rows.sparkSession.sparkContext.broadcast(fillers)  # bounded by LEAST_SHARE

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            if batch.num_rows:
                words = batch.column(2).to_pylist()
                keys = band_keys(batch.column(1).to_pylist(), words)
                outlines = np.array([outline(w, own) for w in words], "int64")
                take = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(take), pa.array(np.repeat(outlines, BANDS))], ["key", "id", "outline"])

    train, other = (distinct.filter(side).select("matter_id", "codes", "words").mapInArrow(bands, "key bigint, id bigint, outline bigint") for side in ("t", "e"))
    pairs = train.toDF("key", "train_id", "a").join(other.toDF("key", "eval_id", "b"), "key")
    pairs = pairs.filter((F.col("train_id") != F.col("eval_id")) & may_match(F.col("a"), F.col("b"))).select("train_id", "eval_id").distinct()

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        own = held.value
        return pd.Series([same_matter(x, y, own) for x, y in zip(a, b, strict=True)], dtype=bool)

    text = distinct.select("matter_id", "words")
    told = pairs.join(text.toDF("train_id", "train_words"), "train_id").join(text.toDF("eval_id", "eval_words"), "eval_id")
    near = told.filter(verified("train_words", "eval_words")).select("train_id", "eval_id")
    same = distinct.filter("t and e").select(F.col("matter_id").alias("train_id"), F.col("matter_id").alias("eval_id"))
    return cut(near.unionByName(same))


def overlapping_pairs(posts: DataFrame) -> DataFrame:
    """post_id_a < post_id_b: every pair of a train and an evaluation post on one matter."""
    rows = titles(posts)
    fillers = asking_words(rows)
    links = matter_links(rows, fillers)
    found = cut(matters(rows, fillers, texts=False).select("post_id", "train", "matter_id"))
    train = found.filter("train").select(F.col("matter_id").alias("train_id"), F.col("post_id").alias("a"))
    other = found.filter("not train").select(F.col("matter_id").alias("eval_id"), F.col("post_id").alias("b"))
    pairs = other.join(links, "eval_id").join(train, "train_id").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("post_id_a"), F.greatest("a", "b").alias("post_id_b")).distinct()


def overlap_counts(posts: DataFrame) -> DataFrame:
    """split, subreddit, posts, overlapping, pairs: evaluation posts, those with a train post on their matter, and their pairs.

    Pairs are counted from the number of train posts of each matter, without expanding them.
    """
    rows = titles(posts)
    fillers = asking_words(rows)
    links = matter_links(rows, fillers)
    found = cut(matters(rows, fillers, texts=False))
    posts_of = found.groupBy("post_id", "split", "matter_id").agg(F.min(F.lower(F.trim("subreddit"))).alias("subreddit"))
    weights = posts_of.filter("split = 'train'").groupBy(F.col("matter_id").alias("train_id")).agg(F.count(F.lit(1)).alias("n"))
    linked = links.join(weights, "train_id").groupBy(F.col("eval_id").alias("matter_id")).agg(F.sum("n").alias("pairs"))
    other = posts_of.filter("split <> 'train'").join(linked, "matter_id", "left")
    return other.groupBy("split", "subreddit").agg(F.count(F.lit(1)).alias("posts"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
