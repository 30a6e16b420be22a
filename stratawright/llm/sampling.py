"""Reproducible sample that stays as data grows (problem 5).

Method: golden-ratio low-discrepancy selection. Every record has a persistent sequence number, the number that its own
base-36 id spells; it does not depend on file order, partitioning or the other records. With the fixed-point golden ratio
``g`` and a fixed shift, record ``s`` is selected when ``(s * g + shift) mod 1`` lies in ``[0, rate)``. Consecutive numbers are
spread evenly (three-distance theorem), so every stretch of growth is sampled at the same rate, and a selected record stays
selected whatever arrives later. All arithmetic is on BIGINT modulo 2^31, exact in every engine.

Defined cases: an id is read without blanks, case and a ``t3_`` prefix, so copies and spellings of one id share one decision; an id
that is not 1 to 11 base-36 digits gets 52 bits of its SHA-256 as its number; a null or blank id is in no sample; ties
cannot occur; an empty table gives an empty sample; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 1 << 31
#: floor(2^31 * (sqrt(5) - 1) / 2), odd, so the map is a bijection of the sequence numbers modulo 2^31.
GOLDEN = 1_327_217_885
#: Fixed random shift.
SHIFT = 608_135_816
RATE = 0.1


def canonical_id(column: str | Column) -> Column:
    """Id without blanks, case and type prefix; null if nothing is left."""
    col = F.col(column) if isinstance(column, str) else column
    bare = F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)[\s\p{Cntrl}\p{Cf}]+", "")), "^t3_", "")
    return F.when(bare != "", bare)


def sequence_number(canonical: Column) -> Column:
    """Persistent number of a canonical id."""
    digits = F.when(canonical.rlike("^[0-9a-z]{1,11}$"), F.conv(canonical, 36, 10).cast("bigint"))
    return F.coalesce(digits, F.conv(F.substring(F.sha2(canonical, 256), 1, 13), 16, 10).cast("bigint"))


def position(number: Column, shift: int = SHIFT) -> Column:
    """Place of a sequence number in [0, 2^31)."""
    return F.pmod(F.pmod(number, F.lit(MODULUS).cast("bigint")) * F.lit(GOLDEN).cast("bigint") + F.lit(shift).cast("bigint"), F.lit(MODULUS).cast("bigint"))


def in_sample(column: str | Column, rate: float = RATE, shift: int = SHIFT) -> Column:
    """Whether the id is in the sample of about ``rate`` of all ids; a larger rate keeps every member."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in [0, 1]")
    return F.coalesce(position(sequence_number(canonical_id(column)), shift) < F.lit(int(rate * MODULUS)).cast("bigint"), F.lit(False))


def sample(df: DataFrame, id_col: str, rate: float = RATE, shift: int = SHIFT) -> DataFrame:
    """The rows of ``df`` whose id is in the sample: a filter, without any exchange."""
    return df.filter(in_sample(id_col, rate, shift))


def sample_with_details(parents: DataFrame, details: DataFrame, id_col: str, rate: float = RATE) -> tuple[DataFrame, DataFrame]:
    """Sampled parents, one row per canonical id with its number of rows, and exactly the distinct details of those parents."""
    kept = sample(parents, id_col, rate).groupBy(canonical_id(id_col).alias(id_col)).agg(F.count(F.lit(1)).alias("n_rows"))
    rows = sample(details, id_col, rate).withColumn(id_col, canonical_id(id_col)).distinct()
    return kept, rows.join(kept.select(id_col), id_col, "left_semi")
