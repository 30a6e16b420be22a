import re

import numpy as np
import personal_cases
import pytest

from stratawright.llm import language, personal, subjects, toxicity
from stratawright.llm.personal_examples import labelled_lines
from stratawright.llm.scrub import plain

POSTS = "post_id string, subreddit string, title string, selftext string, score int"


@pytest.fixture(scope="module")
def tagger():
    return personal.train()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("My landlord, Nadia Ekthorne, refuses to answer.", [("name", "Nadia Ekthorne")]),
        ("Send it to greta.fenerudo@inbox.vaslett.test, thanks.", [("email", "greta.fenerudo@inbox.vaslett.test")]),
        ("Call or text (303) 555-0132 after six.", [("phone", "(303) 555-0132")]),
        ("My tax ID 947 47 3196 is printed on the letter.", [("id_number", "947 47 3196")]),
        ("Ship it to 36 Orchard Lane, Apt 3, Merrowby, QX1 7ZZ.", [("address", "36 Orchard Lane, Apt 3, Merrowby, QX1 7ZZ")]),
        ("My doctor is Dr. Elif Kellivic.", [("name", "Elif Kellivic")]),
        ("Part QX-1755-0142-7 is the one you need.", []),
        ("Version 10.4.17.118 fixed it.", []),
        ("Thanks, Oskar L.", []),
        ("Follow @Melport_fan for updates.", []),
        ("", []),
        (None, []),
        ("word " * 30_000, []),
    ],
)
def test_items(tagger, text, want):
    assert [(k, text[a:b]) for a, b, k in personal.find_items(tagger, [text])[0]] == want


@pytest.mark.parametrize("kind", personal_cases.CASES)
def test_hand_written_sentences(tagger, kind):
    """Sentences that the table's rules cannot compose: at least 0.9 of the items of every kind are found, and few others."""
    gold, got = set(), set()
    for line in personal_cases.CASES[kind].split("\n"):
        text, spans = personal_cases.read(line)
        gold |= {(line, a, kind) for a, _ in spans}
        got |= {(line, a, k) for a, _, k in personal.find_items(tagger, [text])[0]}
    assert len(gold & got) >= 0.9 * len(gold) and len(gold & got) >= 0.9 * len(got)


def test_sentences_without_items(tagger):
    """No usage of a corpus is known here, so capitalised pairs may look like names; at most a quarter of these hard lines is touched."""
    lines = personal_cases.NOTHING.split("\n")
    assert sum(bool(found) for found in personal.find_items(tagger, lines)) <= len(lines) / 4


def test_usage(spark):
    rows = [(str(i), "x", "the Brelvik pump leaks", "The pump is old", 1) for i in range(4)] + [("9", "x", "Zorivic", None, 1), (None, "x", "zug zug", None, 1)]
    usage = personal.usage_of(spark.createDataFrame(rows, POSTS))
    assert {"the", "pump", "leaks", "is", "old"} == usage.plain and usage.proper == {"brelvik"}
    assert usage.of("zorivic", frozenset()) == "rare" and usage.of("old-pump", frozenset()) == "plain"


def test_held_out_lines(tagger):
    """Lines of the same rules under another seed, with other made-up names."""
    right = wrong = missed = 0
    lines = labelled_lines(600, seed=99)[0]
    for (text, items), found in zip(lines, personal.find_items(tagger, [t for t, _ in lines]), strict=True):
        gold, got = {(a, k) for a, _, k in items}, {(a, k) for a, _, k in found}
        right, wrong, missed = right + len(gold & got), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.93


def test_pruning_changes_nothing(tagger, monkeypatch):
    texts = [t for t, _ in labelled_lines(200, seed=5)[0]]
    found = personal.find_items(tagger, texts)
    monkeypatch.setattr(personal.Tagger, "live", lambda self, scores, starts: np.ones(len(scores), bool))
    assert personal.find_items(tagger, texts) == found


def test_redact_and_distinct(spark):
    df = spark.createDataFrame([("a", "x", "Hi", "Mail: ivo.kell@post.example.org\nbye", 1), ("a", "x", "Hi", "Mail: ivo.kell@post.example.org\nbye", 1), ("b", None, None, None, 2), (None, "x", "Call (303) 555-0132", "", 3)], POSTS)
    rows = {r.post_id: r for r in personal.redacted(df).collect()}
    assert rows["a"].selftext == "Mail: [EMAIL]\nbye" and rows["b"].selftext is None
    assert [tuple(r) for r in personal.found(df).collect()] == [("a", "selftext", "email", 6)]
    assert personal.found(df.limit(0)).collect() == []


def test_plain():
    assert plain("Ｆuｌl wіdth &#40;x) a​b") == "Full width (x) ab"
    assert plain("Привет мир") == "Привет мир"


@pytest.fixture(scope="module")
def classifier():
    return language.Classifier(language.grow({}) | language.seed_texts())


@pytest.mark.parametrize(
    ("text", "lang"),
    [
        ("I would like to know what is wrong with it and why nobody could tell me.", {"en"}),
        ("Ich weiß nicht, warum niemand mir sagen konnte, dass es nicht mehr funktioniert.", {"de"}),
        ("ich weiss nicht, WARUM NIEMAND mir sagen konnte, dass es nicht mehr funktioniert.", {"de"}),
        ("Никто не смог мне сказать, почему оно больше не работает.", {"ru"}),
        ("nikto ne smog mne skazat, pochemu ono bolshe ne rabotaet.", {"ru"}),
        ("誰も教えてくれませんでした。どうすればいいですか。", {"ja"}),
        ("Nobody here could tell me why it does not work any more. Personne ici n'a pu me dire pourquoi cela ne marche plus.", {"en", "fr"}),
        ('The sign only said "Achtung" and nobody could tell me why.', {"en"}),
        ("[deleted]", set()), ("https://example.com/der-die-das", set()), ("🙂 12345", set()), ("", set()), (None, set()),
    ],
)
def test_field_language(classifier, text, lang):
    assert {name for name, _, _ in language.merge(classifier.field(text))} == lang


def test_long_text_is_read_whole(classifier):
    text = "I would like to know what is wrong with it. " * 3000 + "Niemand konnte mir sagen, warum es nicht mehr funktioniert."
    assert {name for name, _, _ in language.merge(classifier.field(text))} == {"en", "de"}


def test_every_dictionary_is_tried(classifier):
    for letters in ("zorvik lumbek tarnow quidel " * 12, "brelport vasmora melport dunkeld " * 20):
        name, margin = classifier.score(language.folded(letters))
        assert margin < language.MARGIN and classifier.segment(letters) == (None, margin / (2 * language.MARGIN))
    letters = "nobody here could tell me why it does not work any more " * 2
    name, margin = classifier.score(language.folded(letters))
    assert (name, margin >= language.MARGIN) == ("en", True) and classifier.segment(letters) == ("en", min(1.0, margin / (2 * language.MARGIN)))


def test_fields_encode_their_segments_together(classifier, monkeypatch):
    """Many fields at once give what each gives alone, and no segment is encoded by itself but those told together."""
    texts = [None, "", "hm", "日本語のテキストはここにあります。 Thanks a lot for that.", "Уже несколько недель пытаюсь выяснить это", *(t + " " + u for t in language.SEEDS.values() for u in list(language.SEEDS.values())[:3])]
    alone = [classifier.field(t) for t in texts]
    assert any(alone) and classifier.memory
    classifier.memory.clear()
    assert classifier.fields(texts) == alone
    classifier.memory.clear()
    segments = list(dict.fromkeys(letters for t in texts for s in language.segments(t) for _, letters in [language.legible(s)] if letters))
    one_by_one = [classifier.score(x) for x in segments]
    monkeypatch.setattr(language, "REMEMBERED", len(segments) - 1)
    classifier.learn([*segments, "one more of them here"])
    assert [classifier.memory[x] for x in segments] == one_by_one
    monkeypatch.setattr(classifier, "coders", None)
    assert [classifier.score(x) for x in segments] == one_by_one


def test_texts_end_where_the_expression_ends_them():
    import random

    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choices("ab.!?…\"')]» \t\n/|。é", [6, 6, 4, 3, 3, 1, 1, 2, 2, 1, 1, 8, 1, 0.3, 0.3, 0.3, 0.2, 1], k=draw.randrange(24)))
        assert language.ended(text) == language.ENDS.split(text)
        letters = re.sub("[^a-z]+", " ", text.lower()).strip()
        assert not text.isascii() or language.folded(text) == letters


def test_wrong_labels_by_every_declaration(spark):
    long = {name: language.SEEDS[name][:300] for name in ("en", "de", "fr")}
    posts = spark.createDataFrame([(f"{a}{b}", None, f"{long[a]}\n{long[b]}" if a != b else long[a]) for a in long for b in long] + [("enen", None, long["en"])] * 3, "post_id string, title string, selftext string")
    communities = spark.createDataFrame([("c", long["fr"])], "community_id string, public_description string")
    declared = [("post", "enen", "English"), ("post", "enen", "de"), ("post", "dede", "en"), ("post", "dede", "unknown"), ("post", "frfr", "unknown"), ("post", "ende", "en"), ("community", "c", "tlh"), ("community", "c", "fr-CA")]
    got = {(r.record_id, r.lang) for r in language.wrong_labels(posts, communities, spark.createDataFrame(declared, "record_kind string, record_id string, lang string")).collect()}
    assert got == {(a + b, x) for a in long for b in long for x in (a, b)} - {("enen", "en")}


def test_a_certain_segment_stands_beside_a_doubtful_one():
    first, certain, doubtful = ("e" * 300, "en", 1.0), ("d" * 100, "de", 1.0), ("d" * 20, "de", 0.5)
    assert {name for name, _, _ in language.merge([first, certain, doubtful])} == {"en", "de"}
    assert {name for name, _, _ in language.merge([first, doubtful])} == {"en"}


def test_declared_codes(spark):
    values = ["en", "en_GB", "EN", " English ", "es-419", "deutsch", "ger", "pt-BR", "", "und", None, "klingon", "ja-JP"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "lang string").select(language.declared_code("lang")).collect()]
    assert got == ["en", "en", "en", "en", "es", "de", "de", "pt", None, None, None, "?", "ja"]


def test_wrong_labels(spark):
    english, german = "Nobody here could tell me why it does not work any more.", "Niemand konnte mir sagen, warum es nicht mehr funktioniert."
    posts = spark.createDataFrame([("ok", "s", english, ""), ("wrong", "s", german, None), ("none", "s", english, german), ("none", "s", english, None), ("mixed", "s", english, german), ("empty", "s", "", "[deleted]"), (None, "s", english, "")], "post_id string, subreddit string, title string, selftext string")
    communities = spark.createDataFrame([("c", "r/c", german), ("c", "r/c", None)], "community_id string, name string, public_description string")
    declared = spark.createDataFrame([("post", "ok", "English"), ("post", "wrong", "en"), ("post", "mixed", "en"), ("post", "gone", "de"), ("post", "none", "und"), ("community", "c", "de-DE")], "record_kind string, record_id string, lang string")
    got = {(r.record_id, r.field, r.lang) for r in language.wrong_labels(posts, communities, declared).collect()}
    assert got == {("wrong", "title", "de"), ("none", "title", "en"), ("none", "selftext", "de"), ("mixed", "title", "en"), ("mixed", "selftext", "de")}
    assert language.wrong_labels(posts.limit(0), communities.limit(0), declared.limit(0)).collect() == []


def test_maximal_segments_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.normal(-0.2, 1, 25)
        best = max((v for *_, v in toxicity.maximal_segments(s)), default=0.0)
        assert best == pytest.approx(max(0.0, max(s[i:j].sum() for i in range(25) for j in range(i + 1, 26))))
    assert toxicity.maximal_segments(np.array([1.0, -5.0, 2.0])) == [(0, 1, 1.0), (2, 3, 2.0)]


def test_significant_passages_add_up():
    size = len(toxicity.CATEGORIES)
    single = np.array([[0.0] * size, [-1.0] * size, [3.0, -2.0, -2.0]])  # word 2 tells for the first category
    model = toxicity.Model({"": 0, "calm": 1, "bad": 2}, single, np.empty(0, "int64"), np.empty((0, size)), np.zeros(size), np.full(size, 0.5), np.zeros(size))
    passage, gap = [2, 2], [1] * 6
    once, twice = gap + passage + gap * 3 + [1, 1], gap + passage + gap + passage + gap
    texts = [once, twice, gap + passage + gap, gap * 3]
    ids, ends = np.array([w for d in texts for w in d], "int64"), np.cumsum([len(d) for d in texts])
    none = (np.zeros((0, size)), np.zeros(len(texts), "int64"), np.zeros(len(texts), "int64"))
    value = model.combined([model.scored(ids, ends), none])[:, 0]
    assert value[1] > value[0] + 1 > 1 and value[3] == 0
    title = model.scored(np.array(passage * 4, "int64"), np.arange(2, 9, 2))
    both = model.combined([title, model.scored(ids, ends)])[:, 0]
    assert both[2] > value[2] + 1 and both[1] > value[1]


def test_token_spellings():
    assert [toxicity.normal(w) for w in toxicity.tokens("w.o.r.t.h.l.e.s.s v e r m i n f1l7hy vermiiiin іdiot idi​ot E110")] == ["worthles", "vermin", "filthy", "vermin", "idiot", "idiot", "e10"]


def content(spark):
    rng = np.random.default_rng(1)
    calm = ["the engine stops on cold mornings", "my cake never rises in this oven", "the parrot sings at four in the morning", "nobody answered my last question", "this damn thing is killing me", "someone called me an idiot and I reported it"]
    bad = {"abusive": "you are a worthless idiot and should vanish", "hateful": "the velmari are vermin and must be driven out", "sexual": "send me nudes tonight I am so horny"}
    posts, labels = [], []
    for i in range(900):
        text = ". ".join(rng.choice(calm, 3))
        kind = (list(bad) + [None] * 6)[i % 9]
        if kind:
            text += ". " + bad[kind]
        posts.append((f"p{i}", "S" if i % 2 else "s ", f"title {i}", text, 1))
        if i % 3 != 1 or i < 300:
            labels.append((f"p{i}", (f" {kind.upper()}" if kind else "none"), 9))
    posts += [("null", None, None, None, 1), ("p1", "s", "title 1", posts[1][3] + ". more", 1), (None, "s", "x", bad["abusive"], 1)]
    return spark.createDataFrame(posts, POSTS), spark.createDataFrame(labels + labels[:20], "post_id string, category string, score int"), bad


def test_bound_of_labels_leaves_the_weight(spark, monkeypatch):
    posts, labels, _ = content(spark)
    weights = []
    monkeypatch.setattr(toxicity, "threshold", lambda surprise, truth, weight: weights.append(weight) or 1.0)
    for most in (40_000, 150):
        monkeypatch.setattr(toxicity.labelled, "__defaults__", (most,))
        toxicity.train(posts, labels)
    assert weights[0] > 1 and weights == pytest.approx([weights[0]] * 6)


def test_toxic_posts(spark):
    posts, labels, bad = content(spark)
    got = {(r.post_id, r.category) for r in toxicity.found(posts, labels).collect()}
    known = {r.post_id for r in labels.collect()}
    want = {(r.post_id, k) for r in posts.collect() if r.post_id and r.selftext for k, v in bad.items() if v in r.selftext and r.post_id not in known}
    assert want and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    rates = {(r.subreddit, r.category): r for r in toxicity.rates(posts, labels).collect()}
    assert rates[("s", "abusive")].cases == pytest.approx(100, abs=3)
    assert toxicity.found(posts.limit(0), labels.limit(0)).collect() == []
    assert toxicity.found(posts, labels.limit(0)).collect() == []


def test_passages(spark):
    """Every significant passage is told with its place, and a post is a case only by its passages."""
    posts, labels, bad = content(spark)
    model, texts = toxicity.train(posts, labels)
    rows = toxicity.passages(model, texts).collect()
    told = {r.post_id: r for r in posts.collect() if r.post_id}
    assert rows and all(r.tokens > 0 and r.first_token + r.tokens <= len(toxicity.tokens(told[r.post_id].title if r.field == "title" else told[r.post_id].selftext)) for r in rows)
    cases = {(r.post_id, r.category) for r in toxicity.long_form(toxicity.scores(model, texts)).collect() if r.is_case and r.score >= toxicity.SIGNIFICANT}
    assert cases and cases <= {(r.post_id, r.category) for r in rows}


def test_several_passages_are_all_found():
    size = len(toxicity.CATEGORIES)
    single = np.zeros((3, size))
    single[1], single[2, 0] = -2.0, 4.0
    model = toxicity.Model({"": 0, "calm": 1, "bad": 2}, single, np.empty(0, "int64"), np.empty((0, size)), np.zeros(size), np.full(size, 0.5), np.zeros(size))
    ids = np.array([2, 1, 1, 1, 2, 2, 1, 1, 1, 1, 2])
    part = model.scored(ids, np.array([len(ids)]))
    ((post, category, found),) = model.significant([part], model.best_surprise([part]))
    assert (post, category) == (0, 0) and {(a, b) for _, _, a, b, _ in found} == {(0, 1), (4, 6), (10, 11)}


def test_counts_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(rng.choice("gearbox clutch guitar chord hello thanks".split(), 30)) + ".") for i in range(400)]
    texts = subjects.encoded(spark.createDataFrame(docs, "doc_id bigint, text string"))
    model = subjects.Model(["a", "b", "none"], np.random.default_rng(7).normal(size=(subjects.FEATURES, 3)).astype("float32"))
    one, two = subjects.expected_counts(texts.coalesce(1), model, set()), subjects.expected_counts(texts.repartition(7), model, set())
    assert one.sum() > 0 and (one == two).all()


def test_stored_words_are_those_read(spark):
    texts = ["One two. Three!\n\nFour five six.", "", "🙂", "Seven eight nine. Ten"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    table = subjects.encoded(df).orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
    for got, want in zip(subjects.stored(table.column(1), table.column(2)), subjects.Reader().read(texts), strict=True):
        assert (got == want).all()


def test_each_subject_has_its_curve():
    rng = np.random.default_rng(3)
    truth = rng.random((2000, 2)) < 0.3
    share = np.clip(np.where(truth, [0.6, 0.25], [0.1, 0.02]) + rng.normal(0, 0.05, truth.shape), 0, 1)
    model = subjects.Model(["a", "b", "none"], np.zeros((1, 3), "float32"))
    subjects.calibrate(model, share, truth)
    chance = model.probability(share)
    assert model.slope.shape == (2,) and all(((chance[:, c] >= model.threshold) == truth[:, c]).mean() > 0.97 for c in (0, 1))


def test_subjects(spark):
    rng = np.random.default_rng(2)
    words = {"cars": "gearbox clutch piston tyre exhaust brake", "music": "guitar chord melody drum verse violin", "none": "hello thanks anyway reply weekend friend"}
    line = lambda s: f"I think the {' and the '.join(rng.choice(words[s].split(), 3))} is it."
    docs, labels, truth = [], [], {}
    for i in range(600):
        subject = [("cars",), ("music",), ("cars", "music"), ()][i % 4]
        text = "\n".join(line(s) for s in [*subject * 3, "none"])
        docs.append((i, text, "x"))
        if i < 300:
            labels += [(i, s.upper() + " ") for s in subject or ("none",)]
        else:
            truth[i] = set(subject)
    docs += [(9000, None, "x"), (9001, "", "x"), (9002, "🙂", "x"), (9003, line("cars") * 5000, "x"), (None, "gearbox", "x")]
    truth[9003] = {"cars"}
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    given = spark.createDataFrame(labels + labels[:10], "doc_id bigint, subject string")
    listed = spark.createDataFrame([("cars", ""), ("music", "")], "subject string, about string")
    got: dict[int, set] = {}
    for r in subjects.found(documents, given, listed).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i, set()) == s for i, s in truth.items()) >= 0.97 * len(truth) and not set(got) & {9000, 9001, 9002, None}
    shares = {r.subject: r for r in subjects.corpus_shares(documents, given, listed).collect()}
    assert shares["cars"].documents == pytest.approx(301, abs=8)
    assert subjects.found(documents.limit(0), given.limit(0), listed).collect() == []
    assert subjects.found(documents, given.limit(0), listed).collect() == []


def test_small_shares_count(spark):
    texts = {"cars": "The gearbox and the clutch of my engine are worn.", "music": "The guitar and the violin play this melody."}
    docs = [(i, texts["cars" if i % 2 else "music"]) for i in range(200)] + [(1000, "\n".join([texts["cars"]] * 400 + [texts["music"]]))]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    given = spark.createDataFrame([(i, "cars" if i % 2 else "music") for i in range(200)], "doc_id bigint, subject string")
    listed = spark.createDataFrame([("cars", ""), ("music", "")], "subject string, about string")
    want = subjects.fit(documents, subjects.encoded(documents), given, listed)
    share = want.shares(subjects.Reader().read([text for _, text in docs]), len(docs))[:, want.names.index("music")]
    assert ((share > 0) & (share < 0.01)).any()
    got = {r.subject: r.expected_share for r in subjects.corpus_shares(documents, given, listed).collect()}
    assert got["music"] == pytest.approx(share.sum() / len(docs), rel=1e-9)


def test_no_word_list_is_a_prefix():
    """Sentences are split at the same places whatever follows."""
    text = "First part here. Second part, here!\nThird"
    assert [re.sub(r"\W+$", "", s) for s in language.segments(text)] == ["First part here", "Second part, here", "Third"]
