import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from stratawright.functions import answers, hashing, text
from stratawright.functions.vectors import l2_normalize


def one(spark, column, *values):
    """The column over one row with columns a, b, ..."""
    names = "abcdefg"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


def test_hash_golden(spark):
    assert hashing.stable_uint_py(7, "post", "abc") == 2894031618341345022
    row = spark.range(1).select(hashing.blake2b63(7, "post", F.lit("abc")).alias("h"), hashing.sha256_60(7, "post", F.lit("abc")).alias("s")).first()
    assert row.h == 2894031618341345022
    assert row.s == int(hashlib.sha256(b"7\0post\0abc").hexdigest()[:15], 16)
    with pytest.raises(Exception, match="null in a hash key"):
        spark.range(1).select(hashing.sha256_60(7, F.lit(None).cast("string"))).collect()


@pytest.mark.parametrize("value", ["ﬁne  Ｔitle", " a \x1cb ", "ß", "", "𝔘nicode x", None])
def test_normalize_title(spark, value):
    want = " ".join(unicodedata.normalize("NFKC", value or "").split())
    assert one(spark, text.normalize_title("a"), value) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("Useful body", "Useful body"), ("[deleted]", ""), (" [Removed] ", ""), ("https://example.com", ""), ("see https://example.com now", "see https://example.com now"), ("a\r\nb", "a\nb"), ("!!!", ""), (None, ""), ("www.x.y", ""), ("日本", "日本")],
)
def test_clean_body(spark, value, want):
    assert one(spark, text.clean_body("a"), value) == want


@pytest.mark.parametrize(("value", "want"), [("", 0), ("1700000000", 1700000000), ("1700000000.9", 1700000000), ("2024-01-01T00:00:00Z", 1704067200), ("2024-01-01 00:00:00", 1704067200)])
def test_parse_created(spark, value, want):
    assert one(spark, text.parse_created("a"), value) == want


def test_parse_created_rejects(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        one(spark, text.parse_created("a"), "garbage")


def test_post_id(spark):
    col = text.extract_post_id(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(0))
    assert one(spark, col, "t3_aBc", "/r/x/comments/wrong/a/", "X", "T") == "abc"
    assert one(spark, col, "", "/r/x/comments/DEF/a/", "X", "T") == "def"
    assert one(spark, col, "no id!", None, "Straße", "T") == hashlib.sha256(b"strasse\0t\x000").hexdigest()


def test_first_nonblank(spark):
    df = spark.createDataFrame([(" ", "x "), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(text.first_nonblank(df, ["a", "missing", "b"])).collect()] == ["x", ""]


def test_post_text_errors(spark):
    assert one(spark, text.post_text("a", "b", "title+selftext"), "t", "s") == "t\n\ns"
    with pytest.raises(Exception, match="needs a body"):
        one(spark, text.post_text("a", "b", "title+selftext"), "t", "")


def test_answers(spark):
    df = spark.range(1).select(F.array(F.lit("x"), F.lit("y")).alias("l"), F.create_map(F.lit("x"), F.lit(3.0), F.lit("y"), F.lit(1.0)).alias("p"))
    row = df.select(answers.normalize_probabilities(F.col("l"), F.col("p")).alias("n"), answers.argmax_label(F.col("l"), F.col("p")).alias("m"), answers.label_to_candidate(F.col("l"), F.array(F.lit("c1"), F.lit("c2")), F.lit("y")).alias("c")).first()
    assert row.n == [0.75, 0.25] and row.m == "x" and row.c == "c2"
    with pytest.raises(Exception, match="zero vector"):
        spark.range(1).select(l2_normalize(F.array(F.lit(0.0)))).collect()
