"""Append-only logs of attempts: last state, resume, interleaving of hosts, runs of failures, gaps, nearest neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key, as one aggregate that combines before it shuffles; null keys are left out."""
    rest = [c for c in log.columns if c != key]
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(key, "last.*").select(*log.columns)


def _blocks(rows: DataFrame, key: str, block: Column) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).withColumn("__block", F.coalesce(block.cast("string"), F.lit("")))


def _before(blocks: DataFrame, key: str, value: str, how: str) -> DataFrame:
    """What the earlier blocks of a key come to, for each of its blocks: their ``sum``, or the ``last`` value that is not null."""
    w = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(key, "__block", (F.coalesce(F.sum(value).over(w), F.lit(0)) if how == "sum" else F.last(value, ignorenulls=True).over(w)).alias("__before"))


# The operators below go through the rows of a key in order. A key may hold a third of all rows, so its rows are cut into blocks along that order (``block``
# must not decrease in it): windows run within (key, block), and blocks, of which there are few, are stitched by a window over one row each.


def numbered(rows: DataFrame, group: str, order: list[str], block: Column) -> DataFrame:
    """Adds ``k``, the number of a row, from 1, in its group's order."""
    b = _blocks(rows, group, block)
    before = _before(b.groupBy(group, "__block").agg(F.count("*").alias("__n")), group, "__n", "sum")
    inner = b.withColumn("__k", F.row_number().over(Window.partitionBy(group, "__block").orderBy(*order)))
    return inner.join(before, [group, "__block"]).withColumn("k", F.col("__k") + F.col("__before")).drop("__block", "__k", "__before")


def running(rows: DataFrame, group: str, order: list[str], block: Column, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums, each row's own value included, in the order of its group."""
    b = _blocks(rows, group, block)
    for name, value in sums.items():
        b = b.withColumn(f"__{name}", value.cast("long"))
    within = Window.partitionBy(group, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.select("*", *[F.sum(f"__{n}").over(within).alias(f"__in_{n}") for n in sums])
    per = b.groupBy(group, "__block").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    upto = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(group, "__block", *[F.coalesce(F.sum(f"__{n}").over(upto), F.lit(0)).alias(f"__to_{n}") for n in sums])
    out = out.join(before, [group, "__block"]).select("*", *[(F.col(f"__in_{n}") + F.col(f"__to_{n}")).alias(n) for n in sums])
    return out.drop("__block", *[f"__{p}{n}" for n in sums for p in ("", "in_", "to_")])


def carried(rows: DataFrame, group: str, order: list[str], block: Column, values: dict[str, Column], current: bool = True) -> DataFrame:
    """Adds the last value that is not null at or before each row of its group (``current``), or before it."""
    b = _blocks(rows, group, block)
    for name, value in values.items():
        b = b.withColumn(f"__{name}", value)
    within = Window.partitionBy(group, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    out = b.select("*", *[F.last(f"__{n}", ignorenulls=True).over(within).alias(f"__in_{n}") for n in values])
    place = F.struct(*order)
    per = b.groupBy(group, "__block").agg(*[F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), place)).alias(f"__{n}") for n in values])
    upto = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(group, "__block", *[F.last(f"__{n}", ignorenulls=True).over(upto).alias(f"__to_{n}") for n in values])
    out = out.join(before, [group, "__block"]).select("*", *[F.coalesce(f"__in_{n}", f"__to_{n}").alias(n) for n in values])
    return out.drop("__block", *[f"__{p}{n}" for n in values for p in ("", "in_", "to_")])


def breaker(log: DataFrame, host: str, time: str, status: str, order: list[str], block: Column, refused_s: int = 900, blocked_s: int = 1800, error_s: int = 300, errors: int = 3, blocks: int = 5) -> DataFrame:
    """Adds ``trips`` (seconds for which an answer makes its host be left alone, null if it does not) and ``open`` (was the host to be left alone when it was asked?).

    429 and 503 trip at once, every ``errors``-th answer in a row without a status (null or 0) does, and so does every ``blocks``-th 403 since the last success of a host that
    had one. The last trip counts. All states are running sums and carried values, so a host with a third of all attempts is cut into blocks like any other.
    """
    code = F.coalesce(F.col(status), F.lit(0))
    failed, refused, good = code == 0, code == 403, code.between(200, 299)
    rows = log.withColumn("__s", F.unix_seconds(F.to_timestamp(time)))
    rows = running(rows, host, order, block, {"e": F.when(failed, 1).otherwise(0), "f": F.when(refused, 1).otherwise(0)})
    # Where the count of errors or refusals stood when it was last set back.
    rows = carried(rows, host, order, block, {"e0": F.when(~failed, F.col("e")), "f0": F.when(good, F.col("f"))})
    run, since = F.col("e") - F.coalesce("e0", F.lit(0)), F.col("f") - F.col("f0")
    trips = (
        F.when(code.isin(429, 503), refused_s)
        .when(failed & (run % errors == 0), error_s)
        .when(refused & since.isNotNull() & (since % blocks == 0), blocked_s)
    )
    rows = rows.withColumn("trips", trips)
    rows = carried(rows, host, order, block, {"until": F.when(F.col("trips").isNotNull(), F.col("__s") + F.col("trips"))}, current=False)
    return rows.withColumn("open", F.coalesce(F.col("__s") < F.col("until"), F.lit(False))).drop("__s", "e", "f", "e0", "f0", "until")


def outcomes(landed: DataFrame, least: int = 400, skip: tuple[str, ...] = (), paywalled: tuple[str, ...] = ()) -> DataFrame:
    """(url, status, via) of what was landed for each URL: ``domain``, ``allowed`` by the host's rules, status and characters of the answer of the origin and of the
    archive (null: not asked, or no copy). A host that forbids it, an origin that fails and a body shorter than ``least`` are read from the archive if it has more."""
    from kelindan.functions.urls import registrable

    failed = lambda p: F.coalesce(F.col(f"{p}_status"), F.lit(0)).between(400, 999) | (F.coalesce(F.col(f"{p}_status"), F.lit(0)) == 0) | (F.coalesce(F.col(f"{p}_bytes"), F.lit(0)) == 0)
    chars = lambda p: F.coalesce(F.col(f"{p}_chars"), F.lit(0))
    kept, behind_wall = ~failed("archive"), F.coalesce(F.col("domain").isin(*paywalled), F.lit(False)) if paywalled else F.lit(False)
    skipped = F.coalesce(registrable(F.col("domain")).isin(*skip), F.lit(False)) if skip else F.lit(False)
    archive = kept & (~F.col("allowed") | failed("origin") | ((chars("origin") < least) & ~behind_wall & (chars("archive") > chars("origin"))))
    n = F.when(archive, chars("archive")).otherwise(chars("origin"))
    body = F.when(n == 0, "empty").when(n < least, F.when(behind_wall, "paywalled").otherwise("short_body")).otherwise("ok")
    code = F.coalesce("origin_status", F.lit(0))
    status = (
        F.when(skipped, "skipped_domain")
        .when(archive, body)
        .when(~F.col("allowed"), "robots_disallowed")
        .when(failed("origin"), F.when(code == 0, "network_error").when(code >= 400, "http_error").otherwise("no_archive"))
        .otherwise(body)
    )
    return landed.select("url", status.alias("status"), F.when(skipped, "").when(archive, "wayback").otherwise("origin").alias("via"))


def interleave(rows: DataFrame, group: str, order: list[str], block: Column) -> DataFrame:
    """Adds ``round`` and ``group_first``, the position in a round robin over groups: first the first row of each group, in the order in which groups begin. What
    sorts turns is two columns, so no global sort in one task is needed."""
    first = rows.groupBy(group).agg(F.min(F.struct(*order)).alias("__f"))
    out = numbered(rows, group, order, block).join(first, group)
    return out.withColumnRenamed("k", "round").withColumn("group_first", F.col(f"__f.{order[0]}")).drop("__f")


def failure_runs(log: DataFrame, key: str, order: list[str], failed: Column, least: int, block: Column) -> DataFrame:
    """(key, run, length) of every island of at least ``least`` consecutive failures per key: rows are numbered by the successes before them."""
    b = _blocks(log, key, block).withColumn("__f", failed)
    per = b.groupBy(key, "__block").agg(F.count_if(~F.col("__f")).alias("__n"))
    inner = b.withColumn("__k", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(Window.partitionBy(key, "__block").orderBy(*order)))
    marked = inner.where("__f").join(_before(per, key, "__n", "sum"), [key, "__block"]).withColumn("run", F.col("__k") + F.col("__before"))
    return marked.groupBy(key, "run").agg(F.count("*").alias("length")).where(F.col("length") >= least)


def gaps(log: DataFrame, key: str, time: Column, order: list[str], least_s: float, block: Column) -> DataFrame:
    """Adds gap_s (null on the first row of a key) and wait_s, what a minimum gap of ``least_s`` would have added."""
    b = _blocks(log, key, block).withColumn("__t", F.unix_micros(time.cast("timestamp")) / 1e6)
    per = b.groupBy(key, "__block").agg(F.max("__t").alias("__n"))
    inner = b.withColumn("__k", F.lag("__t").over(Window.partitionBy(key, "__block").orderBy(*order)))
    out = inner.join(_before(per, key, "__n", "last"), [key, "__block"]).withColumn("gap_s", F.col("__t") - F.coalesce("__k", "__before"))
    return out.withColumn("wait_s", F.coalesce(F.greatest(F.lit(0.0), least_s - F.col("gap_s")), F.lit(0.0))).drop("__block", "__t", "__k", "__before")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, block) -> DataFrame:
    """Adds the last ``value`` of ``right`` at or before ``left_time`` per key. Both sides are one stream per key in which the last value is carried down, so there is
    no range join. ``block``: a function from a column of times to blocks."""
    a = left.select(F.struct(*left.columns).alias("row"), F.col(key).alias("__key"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(key).alias("__key"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = _blocks(a.unionByName(b), "__key", block(F.col("__t")))
    order = ["__t", "__side", "__v"]
    per = both.groupBy("__key", "__block").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__n"))
    w = Window.partitionBy("__key", "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = both.withColumn("__k", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    found = inner.join(_before(per, "__key", "__n", "last"), ["__key", "__block"], "left")
    return found.select("row.*", F.coalesce("__k", "__before").alias(value))
