"""Scoring of rules against labels: agreement of raters, strata, recall from strata, resampling, samples and quotas."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelindan.functions.stats import wilson, wilson_or_census


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa) of two raters; 1 where chance alone would agree always; null for no rows. One pass counts label pairs, whose number
    is bounded by the labels."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    of_a = pairs.groupBy(F.col("x").alias("l")).agg(F.sum("c").alias("ca"))
    of_b = pairs.groupBy(F.col("y").alias("l")).agg(F.sum("c").alias("cb"))
    both = of_a.join(of_b, "l").agg(F.sum(F.col("ca") * F.col("cb")).cast("double").alias("chance"))
    seen = pairs.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    out = seen.join(both).select("n", (F.col("same") / F.col("n")).alias("observed"), F.coalesce(F.col("chance") / (F.col("n") * F.col("n")), F.lit(0.0)).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def strata(rows: DataFrame, stratum: str, positive: Column, pool: Column | None = None) -> DataFrame:
    """(stratum, n, k, rate, ci_low, ci_high): Wilson intervals, or the bare rate where the sample is its whole pool."""
    g = rows.groupBy(stratum).agg(F.count("*").alias("n"), F.count_if(positive).alias("k"), *([F.max(pool).alias("pool")] if pool is not None else []))
    lo, hi = wilson_or_census(F.col("k"), F.col("n"), F.col("pool")) if pool is not None else wilson(F.col("k"), F.col("n"))
    return g.select(stratum, "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(lo, 6).alias("ci_low"), F.round(hi, 6).alias("ci_high"))


def recall(table: DataFrame) -> DataFrame:
    """(found, missed, recall, missed_worst, recall_worst) from strata: (role flagged | unflagged, n, k, pool). What is flagged and right counts as found; an unflagged
    stratum is extrapolated by its miss rate, in the worst case at the upper end of its interval."""
    _, hi = wilson(F.col("k"), F.col("n"))
    part = table.where("n > 0").select("role", (F.col("pool") * F.col("k") / F.col("n")).alias("e"), (F.col("pool") * hi).alias("w"))
    s = part.agg(
        F.sum(F.when(F.col("role") == "flagged", F.col("e"))).alias("found"), F.sum(F.when(F.col("role") == "unflagged", F.col("e"))).alias("missed"), F.sum(F.when(F.col("role") == "unflagged", F.col("w"))).alias("missed_worst")
    )
    return s.select("found", "missed", F.try_divide("found", F.col("found") + F.col("missed")).alias("recall"), "missed_worst", F.try_divide("found", F.col("found") + F.col("missed_worst")).alias("recall_worst"))


def bootstrap_recall(table: DataFrame, draws: int = 2000, seed: int = 1, blocks: int = 16) -> DataFrame:
    """(low, high) of the recall by resampling: each stratum with labels is drawn anew as a binomial of its n and rate, once a draw. Strata stay distributed: one row a
    stratum draws all its numbers from a seed of its own, and draws are summed by an aggregate, so any number of strata will do."""
    strata = table.where("n > 0").select("stratum", "role", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), F.col("pool").cast("double").alias("pool"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.arange(draws)
        for pdf in batches:
            found, missed = np.zeros(draws), np.zeros(draws)
            for name, role, n, k, pool in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, *hashlib.sha256(f"{role}|{name}".encode()).digest()[:8]])
                share = pool * rng.binomial(n, k / n, draws) / n
                if role == "flagged":
                    found += share
                else:
                    missed += share
            yield pd.DataFrame({"i": ids, "found": found, "missed": missed})

    drawn = strata.repartition(blocks, "stratum").mapInPandas(draw, "i long, found double, missed double").groupBy("i").agg(F.sum("found").alias("f"), F.sum("missed").alias("m"))
    share = drawn.select(F.try_divide("f", F.col("f") + F.col("m")).alias("r")).where("r is not null")
    return share.agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))


def quota_sample(rows: DataFrame, stratum: str, key: str, group: str, quota: dict[str, int], per_group: int = 1, salt: str = "7") -> DataFrame:
    """Rows drawn in an order given by a hash of their key: at most ``per_group`` of a group, at most the quota of a stratum. The window per group
    runs first, so that the one per stratum sees few rows of a hot group."""
    order = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    w = rows.where(F.col(stratum).isin(list(quota))).withColumn("__o", order)
    w = w.withColumn("__g", F.row_number().over(Window.partitionBy(stratum, group).orderBy("__o", key))).where(F.col("__g") <= per_group)
    # The largest quota is a constant, by which Spark cuts a stratum before it meets in one task.
    w = w.withColumn("__s", F.row_number().over(Window.partitionBy(stratum).orderBy("__o", key))).where(F.col("__s") <= max(quota.values(), default=0))
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(stratum))
    return w.where(F.col("__s") <= limit).drop("__o", "__g", "__s")


def share(rows: DataFrame, flags: list[str]) -> DataFrame:
    """(name, n, share) of boolean columns, by one aggregate over all and an unpivot of its single row."""
    one = rows.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    return one.unpivot(["__n"], flags, "name", "n").select("name", "n", F.round(F.col("n") / F.col("__n"), 6).alias("share"))


def label_problems(labels: DataFrame, key: str, domains: dict[str, list[str]]) -> DataFrame:
    """(key, column, problem) of labels that are missing or not of their column's domain, compared trimmed and in upper case; no rows: the sheet is fit for scoring."""
    out = None
    for column, valid in domains.items():
        v = F.upper(F.trim(F.coalesce(F.col(column), F.lit(""))))
        one = labels.select(key, F.lit(column).alias("column"), F.when(v == "", "missing").when(~v.isin(valid), "invalid").alias("problem")).where("problem is not null")
        out = one if out is None else out.unionByName(one)
    return out


def repeat_agreement(labels: DataFrame, item: str, repeat_of: str, label: str) -> DataFrame:
    """(n, same) of items that were shown twice: the repeat against its original."""
    first = labels.select(F.col(item).alias("__o"), F.col(label).alias("__l"))
    pairs = labels.where(F.col(repeat_of).isNotNull()).join(first, F.col(repeat_of) == F.col("__o"))
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col("__l")).alias("same"))


def scored(key: DataFrame, sheet: DataFrame, item: str) -> DataFrame:
    """The private key joined to a labeller's sheet; labels are compared trimmed and in upper case."""
    clean = [F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in sheet.columns if c != item]
    return key.join(sheet.select(item, *clean), item)


def positive(label: Column, about: Column, target: str, strict: bool = True) -> Column:
    """The labeller agrees that it is the target and that it is about the event; an unsure one counts unless it is strict."""
    return (label == target) & (about.isin("YES") if strict else about.isin("YES", "UNSURE"))


def agreement_of(a: DataFrame, b: DataFrame, item: str, columns: dict[str, Column]) -> DataFrame:
    """(what, n, observed, expected, kappa) of two labellers' sheets, joined by item; ``columns``: what is compared, as an expression that both sheets have."""
    left, right = ([item, *[c.alias(k) for k, c in columns.items()]] for _ in range(2))
    both = a.select(*left).join(b.select(*right).toDF(item, *[f"{k}__b" for k in columns]), item)
    out = None
    for k in columns:
        one = kappa(both, k, f"{k}__b").select(F.lit(k).alias("what"), "n", "observed", "expected", "kappa")
        out = one if out is None else out.unionByName(one)
    return out
