"""Filling of containers of fixed capacity (problem 7).

Method: Martello-Toth dominance reduction, then best fit. The instance that has to be solved is the *histogram* of item
sizes, which has at most ``capacity + 1`` rows however large the corpus is; only it is brought to the driver. The reduction
permanently fixes sets that provably dominate every other set for the same item (item alone; item with the largest partner
when no three fit; item with a partner that fills the container exactly; item with one partner at least as large as the best
pair), for as many copies at once as the histogram holds. The rest is filled by best fit in decreasing size, again for
runs of equal items. The outcome is a table of *runs* (size, first rank, last rank, first container, containers) with which
every executor places its own items: an item's rank within its size is computed in salted groups, so a size that holds a third
of all items is ranked by many tasks.

Defined cases: an item larger than the capacity, and only such an item, is split into full containers and a rest; an
item of size 0 (null or empty text) takes no room and has container null; ties are placed in order of salt, id and piece;
repeated ids are separate items; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratawright.session import cut

CAPACITY = 2048
#: Groups over which the ranking of the items of one size is spread.
SALTS = 256


class Bins:
    """Groups of equally filled containers: residual room -> list of (how many, {size: items in each})."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []
        self.groups: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)

    def add(self, room: int, count: int, filling: dict[int, int]) -> None:
        if count:
            if room not in self.groups or not self.groups[room]:
                insort(self.rooms, room)
            self.groups[room].append((count, filling))

    def tightest(self, size: int) -> tuple[int, int, dict[int, int]] | None:
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        count, filling = self.groups[room].pop()
        if not self.groups[room]:
            del self.rooms[at]
        return room, count, filling

    def place(self, size: int, items: int) -> None:
        """Best fit of ``items`` equal items: each goes where the least room stays, which keeps it in the container just used."""
        while items:
            found = self.tightest(size)
            if found is None:
                each = self.capacity // size
                full, rest = divmod(items, each)
                self.add(self.capacity - each * size, full, {size: each})
                if rest:
                    self.add(self.capacity - rest * size, 1, {size: rest})
                return
            room, count, filling = found
            each = room // size
            full = min(count, items // each)
            rest = items - full * each if full < count else 0
            used = full + bool(rest)
            self.add(room - each * size, full, {**filling, size: filling.get(size, 0) + each})
            if rest:
                self.add(room - rest * size, 1, {**filling, size: filling.get(size, 0) + rest})
            self.add(room, count - used, filling)
            items -= full * each + rest


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """The containers that dominance fixes, as (how many, filling), and the histogram that is left."""
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[int, dict[int, int]]] = []

    def take(filling: dict[int, int]) -> None:
        times = min(left[s] // k for s, k in filling.items())
        fixed.append((times, filling))
        for s, k in filling.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))

    def smallest(number: int, but: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(number - len(out), left[s] - (s == but))
            if len(out) >= number:
                break
        return out

    def partner(size: int, room: int) -> int | None:
        at = bisect_left(sizes, room + 1) - 1
        if at >= 0 and sizes[at] == size and left[size] < 2:
            at -= 1
        return sizes[at] if at >= 0 else None

    for size in sorted(left, reverse=True):
        while left.get(size, 0):
            room = capacity - size
            low = smallest(3, size)
            fits = sum(sum(low[: i + 1]) <= room for i in range(len(low)))
            if not fits:
                take({size: 1})
                continue
            best = partner(size, room)
            pair = {size: 2} if best == size else {size: 1, best: 1}
            if fits == 1 or size + best == capacity:
                take(pair)
            elif fits == 2:
                top = 0
                for a in sizes:
                    if left[a] - (a == size) > 0 and a * 2 <= room:
                        b = partner(size, room - a)
                        if b is not None and b >= a and (b != a or left[a] - (a == size) > 1):
                            top = max(top, a + b)
                if best < top:
                    break
                # For all copies at once: removing them leaves the largest partner the same and the best pair no better.
                take(pair)
            else:
                break
    return fixed, left


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Runs (size, lo, hi, first, width): the item of rank k in [lo, hi) lies in container first + (k - lo) % width."""
    fixed, left = reduce_instance(counts, capacity)
    bins = Bins(capacity)
    for size in sorted(left, reverse=True):
        bins.place(size, left[size])
    rows, used, first = [], defaultdict(int), 0
    for count, filling in [*fixed, *(g for room in sorted(bins.groups) for g in bins.groups[room])]:
        for size, each in filling.items():
            rows.append((size, used[size], used[size] + count * each, first, count))
            used[size] += count * each
        first += count
    runs = pd.DataFrame(rows, columns=["size", "lo", "hi", "first", "width"]).astype("int64")
    return runs.sort_values(["size", "lo"], ignore_index=True)


def pack(sizes: DataFrame, id_col: str, size_col: str = "size", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``id_col``, piece, pieces, piece_size, container. ``sizes`` should be a stored table."""
    whole = F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / capacity)
    items = (
        sizes.select(F.col(id_col).alias("key"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("n"))
        .withColumn("pieces", (whole + 1).cast("bigint"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
        .withColumn("piece_size", F.when(F.col("piece") < F.col("pieces") - 1, F.lit(capacity)).otherwise(F.col("n") - F.col("piece") * capacity).cast("bigint"))
        .withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(SALTS)))
    )
    per_salt = cut(items.groupBy("piece_size", "salt").count())
    counts = {r.piece_size: r.n for r in per_salt.groupBy("piece_size").agg(F.sum("count").alias("n")).collect() if r.piece_size > 0}
    runs = plan_runs(counts, capacity)
    offsets = per_salt.withColumn("offset", F.sum("count").over(Window.partitionBy("piece_size").orderBy("salt")) - F.col("count")).drop("count")
    ranked = (
        items.withColumn("place", F.row_number().over(Window.partitionBy("piece_size", "salt").orderBy("key", "piece")) - 1)
        .join(F.broadcast(offsets), ["piece_size", "salt"])  # at most (capacity + 1) * SALTS rows of three numbers
        .withColumn("rank", F.col("offset") + F.col("place"))
    )
    span = 1 << 42
    starts = (runs["size"] * span + runs["lo"]).to_numpy("int64")
    lo, first, width = (runs[c].to_numpy("int64") for c in ("lo", "first", "width"))

    @F.pandas_udf("bigint")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(size), dtype="Int64")
        some = (size > 0).to_numpy()
        if some.any():
            ranks = rank.to_numpy("int64")[some]
            at = np.searchsorted(starts, size.to_numpy("int64")[some] * span + ranks, side="right") - 1
            out[some] = first[at] + (ranks - lo[at]) % width[at]
        return out

    placed = ranked.withColumn("container", container("piece_size", "rank"))
    return placed.select(F.col("key").alias(id_col), "piece", "pieces", "piece_size", "container")


def split_items(packed: DataFrame, id_col: str) -> DataFrame:
    """``id_col`` of the items whose pieces lie in more than one container."""
    return packed.filter("pieces > 1").groupBy(id_col).agg(F.countDistinct("container").alias("n")).filter("n > 1").select(id_col)


def summary(packed: DataFrame, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, split, pieces, tokens, containers, fullest, least_containers and overfull.

    ``least_containers`` is the fewest that any filling needs: all tokens in full containers, or one for every piece of more than half a container.
    ``overfull`` counts containers above the capacity, which must be 0.
    """
    placed = packed.filter("container is not null")
    load = placed.groupBy("container").agg(F.sum("piece_size").alias("used"), F.count(F.lit(1)).alias("pieces"), F.sum((F.col("piece_size") * 2 > capacity).cast("bigint")).alias("large"), F.sum((F.col("piece") == 0).cast("bigint")).alias("items"), F.sum(((F.col("piece") == 0) & (F.col("pieces") > 1)).cast("bigint")).alias("split"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    least = F.greatest(F.ceil(total("used") / capacity), total("large"))
    return load.agg(
        total("items").alias("items"), total("split").alias("split"), total("pieces").alias("pieces"), total("used").alias("tokens"), F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"), least.alias("least_containers"), total((F.col("used") > capacity).cast("bigint")).alias("overfull"),
    )
