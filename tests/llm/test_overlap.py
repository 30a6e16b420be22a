import numpy as np
import pytest

from stratawright.llm import overlap

SCHEMA = "post_id string, split string, subreddit string, title string, key string"
BASE = "Old thread pool (Vaslett E70) suddenly parses the header wrongly in a noisy studio after 34 weeks, any ideas if money is tight"


#: Other titles, from which the operator learns what is asked.
TEACHING = [(f"k{i}", "train", "x", f"Kettle {i} {thing} at noon. Any ideas if money is tight?") for i, thing in enumerate(["leaks", "hums", "rusts", "smokes"])]
FILLERS = overlap.Fillers("anyone ideas money tight".split())


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    return {(r.post_id_a, r.post_id_b) for r in overlap.overlapping_pairs(df).collect()}


@pytest.mark.parametrize(
    ("other", "same"),
    [
        ("Any ideas? Vaslett E70 old thread pool suddenly parses the header wrongly after 34 weeks in a noisy studio", True),
        (BASE.upper(), True),
        ("[Update] " + BASE.replace("header", "haeder").replace("thread", "thraed"), True),
        (BASE.replace("a", "а").replace("(", "&#40;"), True),
        (BASE.replace("e", "ｅ"), True),
        (BASE.replace("E70", "E90"), False),
        (BASE.replace("34", "35"), False),
        (BASE.replace("Vaslett", "Quinmora"), False),
        (BASE.replace("noisy", "dusty"), False),
        (BASE.replace("thread pool", "web server"), False),
    ],
)
def test_same_matter(spark, other, same):
    got = pairs(spark, [("a", "train", "x", BASE), ("b", " TEST ", "y", other), *TEACHING])
    assert got == ({("a", "b")} if same else set())


@pytest.mark.parametrize("ask", ["Could somebody point me in the right direction?", "Does anyone know the cause?", "Thoughts welcome", "[Advice needed]", "Kindly explain", "I would appreciate advice", "Kann mir jemand raten?", "D'où ça peut venir?"])
def test_unseen_questions_carry_no_matter(spark, ask):
    """Questions of no corpus, in a table that teaches nothing."""
    title = "Vaslett E70: thread pool parses the header wrongly after 34 weeks"
    assert pairs(spark, [("a", "train", "x", title), ("b", "dev", "x", f"{title}. {ask}"), ("c", "test", "y", f"{title} - {ask}"), ("d", "test", "y", f"{title.replace('pool', 'dump')}. {ask}")]) == {("a", "b"), ("a", "c")}


def test_learned_words():
    """A word that stands mostly in short questions asks; one of the matter does not."""
    parts = [overlap.clauses(t) for *_, t in TEACHING]
    asked = [w for p in parts for (words, _), short in zip(p, overlap.asking_clauses(p), strict=True) if short for w in words]
    assert set(asked) == {"any", "ideas", "if", "money", "is", "tight"}
    assert overlap.asking_clauses(overlap.clauses("Why does the kettle leak at noon?")) == [False]


def test_only_across_splits_and_edges(spark):
    rows = [("c", "train", "x", BASE), ("c", "train", "x", BASE), ("a", "dev", "x", BASE), ("b", "test", "y", BASE), ("n", None, "y", BASE), ("e", "test", "y", ""), ("f", "train", "y", "  "), ("g", "train", "y", "🙃🙃"), ("h", "dev", "y", "🙃🙃"), ("i", "dev", "y", None), (None, "train", "y", BASE), ("z", "train", "x", "Daily small talk #20435"), ("y", "dev", "x", "daily small talk #20435"), ("w", "dev", "x", "Daily small talk #20436"), ("l", "train", None, "long " * 20_000)]
    assert pairs(spark, rows) == {("a", "c"), ("b", "c"), ("y", "z")}
    assert pairs(spark, []) == set()


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("mor", "tal", "ven", "gris", "plo", "hak") for b in ("ton", "ble", "per", "mick", "sand", "ling")]
    rows = []
    for i in range(300):
        title = " ".join(rng.choice(words, 8)) + f" {rng.integers(1, 4)} weeks"
        rows.append((f"t{i:03d}", "train", "x", title))
        if i % 3 == 0:
            shuffled = " ".join(rng.permutation(title.split(" ")[:8])) + " " + " ".join(title.split(" ")[8:])
            rows.append((f"e{i:03d}", "dev", "x", shuffled))
    got = pairs(spark, rows)
    matter = {r[0]: overlap.matter_of(r[3], overlap.Fillers()) for r in rows}
    want = {(e, t) for e in matter if e[0] == "e" for t in matter if t[0] == "t" and matter[e][0] == matter[t][0] and overlap.same_matter(matter[e][1], matter[t][1], overlap.Fillers())}
    assert len(want) >= 100 and got <= want and len(got) >= 0.97 * len(want)


def test_counts_without_expanding(spark):
    df = spark.createDataFrame([("a", "train", "X", BASE), ("b", "train", "X", BASE), ("c", "test", "Y ", BASE), ("d", "test", "y", "Something else entirely")], "post_id string, split string, subreddit string, title string")
    row = overlap.overlap_counts(df).collect()
    assert [(r.split, r.subreddit, r.posts, r.overlapping, r.pairs) for r in row] == [("test", "y", 2, 1, 2)]


def test_slips():
    assert overlap.slips("absobrs", "absorbs") and overlap.slips("dnugeeon", "dungeon") and overlap.slips("effrt", "effort")
    assert not overlap.slips("vasova", "vasmora") and not overlap.slips("brelport", "melport") and not overlap.slips("cat", "dog")


def test_candidates_down_to_the_least_similarity(spark):
    """Pairs just above SIMILARITY share a bucket and pass the outline filter."""
    rng = np.random.default_rng(1)
    letters = np.array(list("bcdfghklmnprstvz"))
    a, b = [], []
    while len(a) < 400:
        words = ["".join(rng.choice(letters, rng.integers(7, 10))) for _ in range(rng.integers(3, 7))]
        slipped = []
        for word in words:
            at = [int(x) for x in rng.choice(np.arange(1, len(word)), rng.integers(0, 3), replace=False)]
            slipped.append("".join(c for i, c in enumerate(word) if i not in at))
        one, two = (" ".join(sorted(set(w))) for w in (words, slipped))
        x, y = overlap.trigrams(one), overlap.trigrams(two)
        if 0.55 <= len(x & y) / len(x | y) <= 0.62 and overlap.same_matter(one, two, FILLERS):
            a.append(one)
            b.append(two)
    shared = (overlap.band_keys([""] * 400, a) == overlap.band_keys([""] * 400, b)).any(axis=1)
    df = spark.createDataFrame([(overlap.outline(x, FILLERS), overlap.outline(y, FILLERS)) for x, y in zip(a, b, strict=True)], "a bigint, b bigint")
    passed = np.array([r[0] for r in df.select(overlap.may_match(df.a, df.b)).collect()])
    assert passed.all() and shared.mean() >= 0.98


def test_outline_tells_unlike_matters_apart(spark):
    words = ["kitchen vormel", "garden tulvek", "kitcehn vormel", "anyoen kitchen vormel"]
    df = spark.createDataFrame([(overlap.outline(words[0], FILLERS), overlap.outline(w, FILLERS)) for w in words], "a bigint, b bigint")
    assert [r[0] for r in df.select(overlap.may_match(df.a, df.b)).collect()] == [True, False, True, True]
    assert FILLERS.slip("anyoen") and not FILLERS.slip("vormel")
