"""Filling containers of fixed capacity, by minimum bin slack.

Sizes, not items, are packed: a histogram has at most ``capacity`` rows however many items there are. Each step takes
the largest size left, finds by a bitset of reachable sums the fullest container that holds it, and repeats that
container as often as the counts allow, so the number of steps depends on the sizes and not on the number of items. The
items then find their containers by their rank within their size.

An item above the capacity is cut into full containers and a rest, which is packed like any item. An item without size
(null or empty text) takes no room: it is kept with a null container. A null size counts as none. Repeated rows are
items of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import materialise

PIECE_SCHEMA = "item_id {kind}, piece_no bigint, size bigint, container_id bigint"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Sizes (with multiplicity) whose sum is the largest one within ``room``."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    goal = 1 << room
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, part = min(counts[size], room // size), 1
        while left > 0:
            take = min(part, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left -= take
            part *= 2
        if reach & goal:
            break
    best, chosen = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not (before >> best) & 1:
            chosen[size] = chosen.get(size, 0) + take
            best -= size * take
    return chosen


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(sizes of one container with multiplicity, how many such containers), until nothing is left."""
    left = {s: n for s, n in counts.items() if 0 < s <= capacity and n > 0}
    plan = []
    while left:
        large = max(left)
        left[large] -= 1
        combination = fullest({s: n for s, n in left.items() if n}, capacity - large)
        left[large] += 1
        combination[large] = combination.get(large, 0) + 1
        times = min(left[s] // m for s, m in combination.items())
        plan.append((combination, times))
        for s, m in combination.items():
            left[s] -= m * times
            if not left[s]:
                del left[s]
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each size: first rank, first container and multiplicity of each run of equal containers."""
    ranks: dict[int, int] = {}
    out: dict[int, list] = {}
    container = 0
    for combination, times in plan:
        for size, m in combination.items():
            at = ranks.get(size, 0)
            out.setdefault(size, []).append((at, container, m))
            ranks[size] = at + m * times
        container += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in out.items()}


def fill_containers(items: DataFrame, id_column: str, size_column: str, capacity: int, rows_per_bucket: int = 100_000) -> DataFrame:
    """(item_id, piece_no, size, container_id); every item is kept whole unless it exceeds ``capacity``."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = items.schema[id_column].dataType.simpleString()
    size = F.coalesce(F.col(size_column).cast("bigint"), F.lit(0))
    cut = items.select(F.col(id_column).alias("item_id"), F.greatest(size, F.lit(0)).alias("whole"))
    cut = cut.select("item_id", "whole", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / capacity) - 1, F.lit(0)))).alias("piece_no"))
    pieces = cut.select("item_id", F.col("piece_no").cast("bigint").alias("piece_no"), F.least(F.col("whole") - F.col("piece_no") * capacity, F.lit(capacity)).alias("size"))
    pieces = materialise(pieces, "fill-pieces")
    # Bounded by the capacity, whatever the number of items.
    counts = {r["size"]: r["n"] for r in pieces.filter("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan_containers(counts, capacity))
    # Ranks within a size in two levels, so that a size held by a third of all items is no single task.
    buckets = max(8, sum(counts.values()) // rows_per_bucket)
    salted = pieces.filter("size > 0").withColumn("bucket", F.pmod(F.xxhash64("item_id", "piece_no"), F.lit(buckets)))
    per = salted.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = per.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("item_id", "piece_no")) - 1
    ranked = salted.withColumn("local", local).join(offsets, ["size", "bucket"]).select("item_id", "piece_no", "size", (F.col("before") + F.col("local")).alias("rank"))

    def place(frames):
        for pdf in frames:
            container = np.zeros(len(pdf), dtype=np.int64)
            sizes, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                first, base, many = slots[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                container[at] = base[k] + (rank[at] - first[k]) // many[k]
            yield pdf[["item_id", "piece_no", "size"]].assign(container_id=container)

    placed = ranked.mapInPandas(place, PIECE_SCHEMA.format(kind=kind))
    return placed.unionByName(pieces.filter("size = 0").withColumn("container_id", F.lit(None).cast("bigint")))
