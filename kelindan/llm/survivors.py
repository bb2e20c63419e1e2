"""Best representative of each duplicate group.

Two ways to choose, both in aggregates that combine before they shuffle, so that a group of a third of all rows is no hot task:

* ``best_records`` picks the surviving record and the record that supplies each field by declared orders of trust.
* ``fuse_fields`` is Bayesian fusion with copy detection: it estimates source accuracies and the dependence between sources from
  the false values they share, discounts copied votes and selects the value of maximum posterior for each field.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelindan.session import keep

_WHITE = r"[\s\x85   -     　﻿]+"
_BLANKS = f"^{_WHITE}|{_WHITE}$"


def present(c: Column) -> Column:
    """True where a value is neither null nor white space nor a dash."""
    return F.coalesce(~F.regexp_replace(c, _BLANKS, "").isin("", "-"), F.lit(False))


def real_day(c: Column) -> Column:
    """The first ten characters, where they are a real day written YYYY-MM-DD; else null."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(head, "yyyy-MM-dd").isNotNull(), head)


def best_records(records: DataFrame) -> DataFrame:
    """(cluster_id, keep_id, title_from, author_from) of every non-blank ``cluster_id`` with two or more distinct ``doc_id``.

    Records are ordered by real day (others last), larger ``n_chars`` (null is 0), ``doc_id``. A title comes from the first record
    that has one, those with ``via`` origin first; an author from the record with the latest ``fetched_at`` (null is earliest), ties
    by smallest ``doc_id``; '' if no record has one. Records without ``doc_id`` are left out, repeated rows count once, an empty
    table gives an empty result, and further columns are ignored.
    """
    r = records.where(F.col("doc_id").isNotNull() & (F.regexp_replace("cluster_id", _BLANKS, "") != "")).select(
        "cluster_id",
        "doc_id",
        F.coalesce(real_day(F.col("publish_date")), F.lit("~")).alias("day"),
        (-F.coalesce(F.col("n_chars").cast("long"), F.lit(0))).alias("less"),
        F.coalesce(F.col("via") != "origin", F.lit(True)).alias("copy"),
        present(F.col("title")).alias("titled"),
        present(F.col("author")).alias("authored"),
        (-F.coalesce(F.unix_micros("fetched_at"), F.lit(-(1 << 62)))).alias("older"),
    )
    order = ("day", "less", "doc_id")
    return (
        r.groupBy("cluster_id")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.max("doc_id").alias("last_id"),
            F.min(F.struct(*order)).alias("kept"),
            F.min(F.when(F.col("titled"), F.struct("copy", *order))).alias("titled"),
            F.min(F.when(F.col("authored"), F.struct("older", "doc_id"))).alias("authored"),
        )
        .where("first_id <> last_id")
        .select(
            "cluster_id",
            F.col("kept.doc_id").alias("keep_id"),
            F.coalesce("titled.doc_id", F.lit("")).alias("title_from"),
            F.coalesce("authored.doc_id", F.lit("")).alias("author_from"),
        )
    )


def fuse_fields(
    records: DataFrame,
    group: str,
    record: str,
    source: str,
    fields: list[str],
    tolerance: float = 0.002,
    detect: int = 5,
    shrink: float = 0.6,
    false_values: int = 20,
    prior_accuracy: float = 0.8,
    copy_rate: float = 0.8,
    prior_dependence: float = 0.1,
) -> DataFrame:
    """(group, field, value, posterior, votes): for every group and field the value of maximum posterior, ties by smallest value.

    Rounds go on until no source's accuracy moves by more than ``tolerance``. Dependence is judged anew in the first ``detect`` rounds; from then on it is held, and steps shrink
    by ``shrink`` a round, as few claims can make two sources change places for ever: that settles every fusion, at the latest when steps are below the tolerance. Claims are (group, field, source, value); a source that claims several values in one group votes for each. Votes are counted
    once per source, so what is compared is bounded by the number of sources, not of rows. Each round scores a value by the sum of its
    sources' log odds ``ln(n A / (1 - A))``, each vote discounted by the chance that it was copied, turns scores into posteriors over
    the values claimed in the group, and takes a source's accuracy as the mean posterior of its claims. Dependence of two sources follows
    from the claims on which they agree on true, agree on false, and differ: shared false values are strong evidence, as independent
    sources seldom err alike, and each difference speaks against. The source of higher accuracy counts as the original. A vote is
    discounted only for the originals that claim the same value, so that what a partial copier claims on its own counts in full.

    Source pairs are compared by counts per pair: only the ``sources`` of one value or item (a bounded dimension) pair up, never the
    rows, and values of the same sources do so once, as a set. Null groups, sources and absent values are left out.
    """
    claims = records.where(F.col(group).isNotNull() & F.col(source).isNotNull() & F.col(record).isNotNull()).select(
        F.col(group).alias("g"),
        F.col(source).alias("s"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.regexp_replace(F.col(f).cast("string"), _BLANKS, "").alias("v")) for f in fields])),
    )
    claims = keep(claims.where(present(F.col("v"))).groupBy("g", "f", "s", "v").agg(F.count("*").alias("rows")), "claims")
    shared = claims.groupBy("g", "f", "v").agg(F.array_sort(F.collect_set("s")).alias("ss")).where(F.size("ss") > 1).withColumn("set", F.md5(F.to_json("ss")))
    shared = keep(shared, "shared")
    sets = keep(shared.select("set", "ss").distinct(), "sets")
    common = keep(_common(claims), "common")
    claims = keep(claims.join(shared.drop("ss"), ["g", "f", "v"], "left"), "marked")
    acc = claims.select("s").distinct().select("s", F.lit(prior_accuracy).alias("a"))
    own = None
    n = float(false_values)
    for k in count():
        scored = claims.join(acc, "s")
        scored = scored.withColumn("w", F.lit(1.0)) if own is None else scored.join(own, ["set", "s"], "left")
        scored = scored.withColumn("vote", F.log(F.lit(n) * F.col("a") / (1 - F.col("a"))) * F.coalesce("w", F.lit(1.0)))
        values = scored.groupBy("g", "f", "v").agg(F.sum("vote").alias("score"), F.count("*").alias("votes"), F.max("set").alias("set"))
        top = values.groupBy("g", "f").agg(F.max("score").alias("top"), F.count("*").alias("kinds"))
        joined = values.join(top, ["g", "f"]).withColumn("e", F.exp(F.col("score") - F.col("top")))
        mass = joined.groupBy("g", "f").agg((F.sum("e") + F.greatest(F.lit(0.0), F.lit(n) - F.max("kinds") + 1) * F.exp(-F.max("top"))).alias("z"))
        posterior = joined.join(mass, ["g", "f"]).select("g", "f", "v", "votes", "set", F.round(F.col("e") / F.col("z"), 9).alias("p"))
        posterior = keep(posterior, f"posterior{k}")
        judged = claims.join(posterior.drop("set"), ["g", "f", "v"])
        judged = judged.groupBy("s").agg(F.least(F.lit(0.99), F.greatest(F.lit(0.05), F.avg("p"))).alias("new"))
        step = 1.0 if k < detect else shrink ** (k - detect + 1)
        moved = acc.join(judged, "s").select("s", (F.col("a") + step * (F.col("new") - F.col("a"))).alias("a"), (step * F.abs(F.col("new") - F.col("a"))).alias("by"))
        moved = keep(moved, f"accuracy{k}")
        if k and (moved.agg(F.max("by")).first()[0] or 0.0) <= tolerance:
            break
        acc = moved.select("s", "a")
        if k >= detect:
            continue
        dependence = keep(_dependence(posterior, sets, common, acc, n, copy_rate, prior_dependence), f"dependence{k}")
        own = keep(_independence(sets, dependence, copy_rate), f"own{k}")
    best = posterior.groupBy("g", "f").agg(F.min(F.struct((-F.col("p")).alias("q"), "v", "votes")).alias("b"))
    return best.select(F.col("g").alias(group), F.col("f").alias("field"), F.col("b.v").alias("value"), (-F.col("b.q")).alias("posterior"), F.col("b.votes").alias("votes"))


def _pairs(lists: DataFrame, column: str, *others: str) -> DataFrame:
    """Every pair (a, b) of an array in ascending order."""
    return lists.select(*others, F.explode(column).alias("a"), column).select(*others, "a", F.explode(column).alias("b")).where("a < b")


def _common(claims: DataFrame) -> DataFrame:
    """(a, b, both): on how many claims two sources can agree or differ: in each item (group, field) that both speak of, as many as the one with fewer values
    claims there, so one where each claims one value. Items of the same sources are one list with its count before they pair up."""
    items = claims.groupBy("g", "f", "s").agg(F.count("*").alias("n")).groupBy("g", "f").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("m")).where(F.size("m") > 1)
    pairs = _pairs(items.groupBy("m").agg(F.count("*").alias("times")), "m", "times")
    return pairs.groupBy(F.col("a.s").alias("a"), F.col("b.s").alias("b")).agg(F.sum(F.col("times") * F.least("a.n", "b.n")).alias("both"))


def _dependence(posterior: DataFrame, sets: DataFrame, common: DataFrame, accuracy: DataFrame, n: float, copy_rate: float, prior: float) -> DataFrame:
    """(a, b, copier, d): the chance that of two sources with a value in common the less accurate one copies. Log odds sum the ratios of what is seen if it does,
    with chance ``copy_rate`` a claim, to what is seen if both err on their own. Every value that two sources or more claim counts."""
    shares = posterior.where("set is not null").groupBy("set").agg(F.sum("p").alias("true"), F.sum(1 - F.col("p")).alias("false"))
    pairs = _pairs(shares.join(sets, "set"), "ss", "true", "false").groupBy("a", "b").agg(F.sum("true").alias("same_true"), F.sum("false").alias("same_false"))
    acc_a, acc_b = accuracy.select(F.col("s").alias("a"), F.col("a").alias("pa")), accuracy.select(F.col("s").alias("b"), F.col("a").alias("pb"))
    pairs = pairs.join(common, ["a", "b"]).join(acc_a, "a").join(acc_b, "b")
    low = F.least("pa", "pb")
    differ = F.greatest(F.lit(0.0), F.col("both") - F.col("same_true") - F.col("same_false"))
    true_ratio, false_ratio = F.log(copy_rate / low + 1 - copy_rate), F.log(copy_rate * n / (1 - low) + 1 - copy_rate)
    odds = F.lit(math.log(prior / (1 - prior))) + F.col("same_true") * true_ratio + F.col("same_false") * false_ratio + differ * math.log(max(1 - copy_rate, 1e-9))
    bounded = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), odds))
    return pairs.select("a", "b", F.when(F.col("pa") >= F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("copier"), (1 / (1 + F.exp(-bounded))).alias("d"))


def _independence(sets: DataFrame, dependence: DataFrame, copy_rate: float) -> DataFrame:
    """(set, s, w): the chance that a source has a value that just this set of sources claims from none of the more accurate ones among them."""
    pairs = _pairs(sets, "ss", "set").join(dependence, ["a", "b"])
    return pairs.groupBy("set", F.col("copier").alias("s")).agg(F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - copy_rate * F.col("d"))))).alias("w"))
