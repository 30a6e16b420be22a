import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratawright.llm import bpe, packing, sampling


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ours = bpe.ByteBPE(bpe.vocabulary_path())
    return ours, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


@pytest.mark.parametrize("text", ["", " ", "Hello world", "<|endoftext|> is text", "a\r\nb\t\tc  ", "naïve café 日本語 🙂👩‍🔧", "x" * 5000, "ab" * 700, "Äöß漢字🙂" * 300, "\0\x01", "12345678901234567890", "don't we'll"])
def test_ids_equal_tiktoken(reference, text):
    ours, theirs = reference
    assert list(ours.encode(text)) == theirs.encode_ordinary(text)
    data = text.encode()
    if len(data) > 1:
        assert ours._scan(data) == ours._heap(data)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_tiktoken_anything(reference, text):
    ours, theirs = reference
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert list(ours.encode(text)) == theirs.encode_ordinary(text)


def test_column_with_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x", 5), (2, "", "y", 6), (3, "hello", "z", 7), (3, "hello", "z", 7)], "doc_id bigint, text string, ids string, key int")
    got = [(r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect()]
    assert sorted(got) == [(1, []), (2, []), (3, [31373]), (3, [31373])]
    assert bpe.encode_column(df.limit(0), "doc_id", "text").collect() == []


def check_runs(counts, capacity):
    runs = packing.plan_runs(counts, capacity)
    used, seen = Counter(), Counter()
    for r in runs.itertuples():
        for k in range(r.lo, r.hi):
            used[r.first + (k - r.lo) % r.width] += r.size
            seen[r.size] += 1
    assert seen == Counter(counts) and max(used.values()) <= capacity
    return len(used)


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=12))
def test_plan_is_a_packing_near_the_bound(counts):
    n = check_runs(counts, 40)
    bound = -(-sum(s * c for s, c in counts.items()) // 40)
    assert bound <= n <= 2 * bound + 1  # at most one container is less than half full


def brute_force(items, capacity):
    """Fewest containers, by trying everything."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_dominance_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(60):
        items = sorted((rng.randint(3, 20) for _ in range(8)), reverse=True)
        fixed, left = packing.reduce_instance(Counter(items), 20)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(n for n, _ in fixed) + brute_force(rest, 20) == brute_force(items, 20)


def test_pack_splits_only_large_items(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([5000, 2048, 0, None, 100, 100, 1900, 2049, 4096])], "doc_id bigint, size bigint")
    rows = packing.pack(df, "doc_id").collect()
    assert {r.doc_id for r in rows if r.pieces > 1} == {0, 7, 8}
    assert {r.doc_id for r in rows if r.container is None} == {2, 3}
    total, load = Counter(), Counter()
    for r in rows:
        total[r.doc_id] += r.piece_size
        if r.container is not None:
            load[r.container] += r.piece_size
    assert total[0] == 5000 and total[8] == 4096 and max(load.values()) <= 2048
    assert packing.pack(df.limit(0), "doc_id").collect() == []


def test_summary_and_split_items_come_from_the_placement(spark):
    rng = random.Random(3)
    sizes = [rng.choice([rng.randint(1, 300), rng.randint(300, 2048), rng.randint(2049, 9000)]) for _ in range(800)] + [0, None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size bigint")
    packed = packing.pack(df, "doc_id")
    assert {r.doc_id for r in packing.split_items(packed, "doc_id").collect()} == {i for i, s in enumerate(sizes) if (s or 0) > 2048}
    assert packing.split_items(packed.withColumn("container", F.lit(1)), "doc_id").collect() == []
    row = packing.summary(packed, "doc_id").first()
    assert (row.items, row.tokens, row.overfull) == (800, sum(s or 0 for s in sizes), 0) and row.fullest <= 2048
    assert row.least_containers <= row.containers <= 1.03 * row.least_containers + 1
    assert packing.summary(packed.limit(0), "doc_id").first().containers == 0


def test_hot_size_is_ranked_in_groups(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1024).cast("bigint").alias("size"))
    load = Counter(r.container for r in packing.pack(df, "doc_id").collect())
    assert len(load) == 1500 and set(load.values()) == {2}


def test_sample_is_stable(spark):
    ids = [sampling_id(i) for i in range(20_000)]
    df = spark.createDataFrame([(i,) for i in ids], "post_id string")
    small = {r.post_id for r in sampling.sample(df.limit(8000), "post_id").collect()}
    large = {r.post_id for r in sampling.sample(df.repartition(7), "post_id").collect()}
    assert small <= large and large == {r.post_id for r in sampling.sample(df, "post_id").collect()}
    assert abs(len(large) - 2000) <= 3  # consecutive numbers: far closer than chance
    wider = {r.post_id for r in sampling.sample(df, "post_id", 0.2).collect()}
    assert large <= wider


def sampling_id(n):
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    n += 1_000_000_000
    while n:
        n, r = divmod(n, 36)
        out = digits[r] + out
    return out


def test_sample_spellings_nulls_and_details(spark):
    posts = spark.createDataFrame([(sampling_id(i), "x") for i in range(200)] + [(sampling_id(3), "copy"), (None, "x"), (" ", "x"), ("not-base 36!", "x")], "post_id string, extra string")
    details = spark.createDataFrame([(f"t3_{sampling_id(i).upper()} ", i) for i in range(200)] + [(f"t3_{sampling_id(3)}", 3), ("zzzzzz", 1), (None, 2)], "post_id string, n int")
    kept, rows = sampling.sample_with_details(posts, details, "post_id")
    ids = {r.post_id for r in kept.collect()}
    got = rows.collect()
    assert {r.post_id for r in got} == {i for i in ids if i != "not-base36!"} and len(got) == len({(r.post_id, r.n) for r in got})
    assert None not in ids and "" not in ids
    with pytest.raises(ValueError):
        sampling.in_sample("post_id", 1.5)
