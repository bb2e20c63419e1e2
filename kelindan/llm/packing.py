"""Filling fixed-capacity containers with items, online, by the sum-of-squares rule.

Every item goes to the fill level that makes the sum of the squared counts of partly filled containers smallest; a level array holds how
many open containers there are of each fill, so a placement costs one look at the levels and never at the containers. Only items above the capacity
are cut, into full containers and a rest. Items are packed in bounded runs side by side; what each run leaves open meets in further rounds, as
items of their fill, until one run holds all that is open or a round puts no two of them together.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelindan.session import keep


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(container, offset, fill by container) of items no larger than ``capacity``, in the given order; items of size 0 get the container -1."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    container, offset = np.full(len(sizes), -1, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    fills: list[int] = []
    for k, s in enumerate(sizes.tolist()):
        if s == 0:
            continue
        # A move from level h to h + s changes the sum by 2 (n[h+s] - n[h] + 1), where neither an empty nor a full container counts.
        there = counts[s : capacity + 1].copy()
        there[-1] = -1 if s < capacity else there[-1]
        here = counts[: capacity + 1 - s]
        cost = 2 * (there - here) + 2
        if s < capacity:
            cost[-1] = 1 - 2 * here[-1]
        cost[0] = 2 * counts[s] + 1 if s < capacity else 0
        cost[1:][here[1:] == 0] = np.iinfo(np.int64).max
        h = int(len(cost) - 1 - np.argmin(cost[::-1]))
        if h == 0:
            c = len(fills)
            fills.append(0)
        else:
            c = open_at[h].popleft()
            counts[h] -= 1
        container[k], offset[k] = c, h
        fills[c] = h + s
        if h + s < capacity:
            counts[h + s] += 1
            open_at[h + s].append(c)
    return container, offset, np.asarray(fills, dtype=np.int64)


def pack(items: DataFrame, item: str, size: str, capacity: int, items_per_run: int = 50_000) -> DataFrame:
    """(item, piece, start, length, container, offset): where every piece of every item lies.

    An item up to ``capacity`` is one piece; a longer one is cut at multiples of ``capacity``, each full piece a container of its own. Null and
    zero sizes take no room and get no row; negative sizes raise. Repeated rows are items of their own. Containers are named by strings that
    say nothing about order. A run leaves open a number of containers that depends on the capacity rather than on its items, so each round has far fewer units
    than the one before; ``items_per_run`` bounds what a task holds and how much runs side by side.
    """
    items = keep(items.select(F.col(item).alias("item"), F.col(size).cast("long").alias("size")), "items")
    if not items.where("size < 0").isEmpty():
        raise ValueError("a size is negative")
    cut = items.where("size > 0").select("item", F.posexplode(F.expr(f"sequence(0L, size - 1, {capacity}L)")).alias("piece", "start"), F.col("size").alias("n"))
    cut = keep(cut.select("item", "piece", "start", F.least(F.lit(capacity), F.col("n") - F.col("start")).alias("length"), F.monotonically_increasing_id().alias("row")), "pieces")
    whole = cut.where(F.col("length") == capacity).select("item", "piece", "start", "length", F.concat(F.lit("f"), "row").alias("container"), F.lit(0).cast("long").alias("offset"))
    # In each round the open containers of the last one are the items: `unit` is a piece or an open container.
    units = cut.where(F.col("length") < capacity).select(F.concat(F.lit("p"), "row").alias("unit"), F.col("length").alias("size"))
    placed = units.select("unit", F.col("unit").alias("container"), F.lit(0).cast("long").alias("offset"))
    n = units.count()
    for k in count():
        runs = max(1, -(-n // items_per_run))
        shuffled = units.withColumn("run", F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(runs)).cast("int")).repartition(runs, "run")
        put = keep(shuffled.mapInPandas(_runner(k, capacity), "unit string, container string, base long, fill long"), f"round{k}")
        moved = placed.withColumnRenamed("container", "unit0").join(put.select(F.col("unit").alias("unit0"), "container", "base"), "unit0", "left")
        placed = keep(moved.select("unit", F.coalesce("container", "unit0").alias("container"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")), f"placed{k}")
        units = put.where(F.col("fill") < capacity).select(F.col("container").alias("unit"), F.col("fill").alias("size")).distinct()
        left = units.count()
        if runs == 1 or left == n:
            break
        n = left
    rest = cut.where(F.col("length") < capacity).withColumn("unit", F.concat(F.lit("p"), "row")).join(placed, "unit").select("item", "piece", "start", "length", "container", "offset")
    return whole.unionByName(rest).withColumnRenamed("item", item)


def _runner(k: int, capacity: int):
    def pack_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        # The rule takes items as they come; large ones first leave the small ones to fill what is left, which loses about a quarter of the room that a random order does.
        for run, pdf in pd.concat(held).sort_values(["run", "size", "unit"], ascending=[True, False, True]).groupby("run", sort=True):
            container, offset, fills = sum_of_squares(pdf["size"].to_numpy(), capacity)
            names = np.asarray([f"r{k}-{run}-{c}" for c in range(len(fills))], dtype=object)
            yield pd.DataFrame({"unit": pdf["unit"].to_numpy(), "container": names[container], "base": offset, "fill": fills[container]})

    return pack_runs
