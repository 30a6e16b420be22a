"""Text columns as the benchmark build reads them. What Spark can express stays in the JVM; Unicode folding is one Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python understands it: Unicode white space and the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f\x85]"
URL = r"(?iU)https?://\S+|www\.\S+"


def col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


def casefold(column: str | Column) -> Column:
    """Unicode case folding, which lower() is not (sharp s becomes ss). Texts in ASCII, where both agree, are folded in the JVM; Python sees a null for them."""
    value = col(column)
    ascii_only = F.octet_length(value) == F.length(value)
    return F.when(ascii_only, F.lower(value)).otherwise(_casefold(F.when(~ascii_only, value)))


def strip(column: str | Column) -> Column:
    return F.regexp_replace(col(column), rf"^{SPACE}+|{SPACE}+$", "")


def first_nonblank(df: DataFrame, names: list[str]) -> Column:
    """The first alias that exists in ``df`` and is not blank, stripped; else the empty text."""
    there = [n for n in names if n in df.columns]
    return F.coalesce(*[F.nullif(strip(F.col(f"`{n}`")), F.lit("")) for n in there], F.lit(""))


def normalize_title(column: str | Column) -> Column:
    """NFKC, every run of white space one blank, stripped."""
    return F.trim(F.regexp_replace(nfkc(F.coalesce(col(column), F.lit(""))), rf"{SPACE}+", " "))


def clean_body(column: str | Column) -> Column:
    """Body with uniform line ends; empty if deleted, removed, or without a letter or digit outside links."""
    value = strip(F.regexp_replace(nfkc(F.coalesce(col(column), F.lit(""))), "\r\n", "\n"))
    gone = F.lower(value).isin("[deleted]", "[removed]") | ~F.regexp_replace(value, URL, "").rlike(r"[\p{L}\p{N}]")
    return F.when(gone, F.lit("")).otherwise(value)


def post_text(title: str | Column, body: str | Column, mode: str | Column) -> Column:
    """What a model is shown: the title, or title, empty line and body. A missing body or an unknown mode is an error."""
    mode = F.lit(mode) if isinstance(mode, str) and mode in ("title", "title+selftext") else col(mode)
    both = F.when(col(body) == "", F.raise_error(F.lit("title+selftext needs a body"))).otherwise(F.concat(col(title), F.lit("\n\n"), col(body)))
    return F.when(mode == "title", col(title)).when(mode == "title+selftext", both).otherwise(F.raise_error(F.concat(F.lit("unknown text mode: "), mode)))


def train_text(title: str | Column, body: str | Column) -> Column:
    return F.when(F.coalesce(col(body), F.lit("")) != "", F.concat(col(title), F.lit("\n\n"), col(body))).otherwise(col(title))


def extract_post_id(explicit: Column, permalink: Column, subreddit: Column, title: Column, created: Column) -> Column:
    """Id given as such, else that of the permalink, else a digest of community, title and time."""
    bare = F.lower(F.regexp_replace(F.coalesce(explicit, F.lit("")), "^t3_", ""))
    linked = F.lower(F.regexp_extract(F.coalesce(permalink, F.lit("")), r"(?i)/comments/([a-z0-9]+)/", 1))
    digest = F.sha2(F.concat_ws("\0", casefold(subreddit), casefold(title), created.cast("string")), 256)
    return F.coalesce(F.when(bare.rlike("^[a-z0-9]+$"), bare), F.nullif(linked, F.lit("")), digest)


def parse_created(column: str | Column) -> Column:
    """Seconds since 1970 of a number or an ISO time (no zone is UTC); 0 for an empty text; anything else is an error."""
    value = strip(F.coalesce(col(column), F.lit("")))
    number = F.try_to_number(value, F.lit("999999999999")).cast("bigint")
    return F.when(value == "", F.lit(0).cast("bigint")).otherwise(F.coalesce(number, value.try_cast("double").cast("bigint"), F.unix_seconds(value.cast("timestamp"))))


def community_name(community_id: str | Column) -> Column:
    return F.concat(F.lit("r/"), col(community_id))
