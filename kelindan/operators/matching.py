"""Tiered matching of names to a register: type and numbers must agree, then words in the name, else near-identical spellings; never a guess."""

from __future__ import annotations

import difflib
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelindan.session import keep

# Kinds of school, and words that tell nothing.
KINDS = ("sd", "smp", "sma", "smk", "mi", "mts", "ma", "tk", "kb", "paud", "ra", "slb", "sps", "tpa")
FILLER = ("negeri", "swasta", "kabupaten", "kab", "kota", "desa", "ds", "kelurahan", "kel", "kec", "kecamatan", "al", "dan", "di")


def name_tokens(name: Column) -> Column:
    """struct(kind, state, numbers, words): state is n (negeri), s (swasta) or ''; numbers lose leading zeros; words lose fillers. Without a known kind all
    but fillers are words."""
    s = F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " ")
    s = F.regexp_replace(s, r"\b(sd|smp|sma|smk|mi|mts|ma) (?:negeri|n)\b", "$1n")
    toks = F.filter(F.split(F.trim(s), " +"), lambda t: t != "")
    head = F.coalesce(F.try_element_at(toks, F.lit(1)), F.lit(""))
    kind = F.regexp_extract(head, f"^({'|'.join(sorted(KINDS, key=lambda k: (-len(k), k)))})[ns]?$", 1)
    rest = F.when(kind != "", F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0)))).otherwise(toks)
    isnum = lambda t: t.rlike("^[0-9]+$")
    filler = F.array(*[F.lit(f) for f in FILLER])
    return F.struct(
        kind.alias("kind"),
        F.when(kind != "", F.substring(head, F.length(kind) + 1, F.lit(1))).otherwise("").alias("state"),
        F.array_sort(F.array_distinct(F.transform(F.filter(rest, isnum), lambda t: F.regexp_replace(t, "^0+(?=.)", "")))).alias("numbers"),
        F.array_sort(F.array_distinct(F.filter(rest, lambda t: ~isnum(t) & ~F.array_contains(filler, t)))).alias("words"),
    )


def contained(left: DataFrame, right: DataFrame, on: list[str], words: str, others: str) -> DataFrame:
    """Rows of both sides that agree ``on`` columns and of which all ``words`` of the left are among ``others`` of the right. Rows meet by the one of the left's words that is in
    the fewest of the right's, so a hot key without a number or a common word pairs nothing; rows without a word meet all that agree, as they are in all. The right's
    columns other than ``on`` must have names of their own. All joins are by sorting: Spark sizes a side by the files that it comes from, not by its words, and would broadcast too much."""
    spelt = right.withColumn("__w", F.explode(F.array_distinct(F.concat(F.coalesce(others, F.array().cast("array<string>")), F.array(F.lit(""))))))
    count = spelt.groupBy(*on, "__w").agg(F.count("*").alias("__n"))
    each = left.withColumn("__id", F.xxhash64(*left.columns)).withColumn("__w", F.explode(F.when(F.size(words) > 0, F.col(words)).otherwise(F.array(F.lit("")))))
    rare = each.join(count.hint("merge"), [*on, "__w"], "left").groupBy("__id").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__w")).alias("m")).select("__id", F.col("m.__w").alias("__w"))
    pairs = each.join(rare.hint("merge"), ["__id", "__w"]).join(spelt.hint("merge"), [*on, "__w"])
    return pairs.where(F.size(F.array_except(words, others)) == 0).drop("__w", "__id")


def holders(rows: DataFrame, key: str, on: list[str], words: str) -> DataFrame:
    """(key, n, first): how many rows with another key agree ``on`` columns and have all words of the key's rows, and the least such key; keys without any are left out. Only
    distinct sets of words meet, each with its count and its two least keys, of which one is another: rows of one set are not paired, so the work grows with the sets."""
    sets = rows.where(" and ".join(f"{c} is not null" for c in (key, *on, words))).select(*on, key, F.array_sort(F.array_distinct(words)).alias("__set"))
    each = sets.groupBy(*on, "__set", key).agg(F.count("*").alias("__rows"))
    place = F.row_number().over(Window.partitionBy(*on, "__set").orderBy(key))
    least = each.withColumn("__k", place).where("__k <= 2").groupBy(*on, "__set").agg(F.array_sort(F.collect_list(key)).alias("__keys"))
    right = each.groupBy(*on, "__set").agg(F.sum("__rows").alias("__size")).join(least.hint("merge"), [*on, "__set"]).withColumnRenamed("__set", "__held")
    right = keep(right, "sets")
    met = contained(right.select(*on, F.col("__held").alias("__set")), right, on, "__set", "__held")
    least_two = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__keys")))), 1, 2)
    met = met.groupBy(*on, "__set").agg(F.sum("__size").alias("__size"), least_two.alias("__keys"))
    # Rows of the same key are no others: of one row per key, as keys mostly have, that is the row itself.
    own = each.groupBy(key).agg(F.collect_list(F.struct(*on, "__set", "__rows")).alias("__own")).select(key, "__own", F.explode("__own").alias("__o")).select(key, "__own", "__o.*")
    agree = lambda x: functools.reduce(lambda a, b: a & b, [x[c] == F.col(c) for c in on]) & (F.size(F.array_except("__set", x["__set"])) == 0)
    same = F.aggregate(F.filter("__own", agree), F.lit(0).cast("long"), lambda a, x: a + x["__rows"])
    others = own.join(met.hint("merge"), [*on, "__set"]).withColumn("__others", F.col("__size") - same).where("__others > 0")
    other = F.when(F.col("__keys")[0] == F.col(key), F.try_element_at("__keys", F.lit(2))).otherwise(F.col("__keys")[0])
    return others.groupBy(key).agg(F.sum(F.col("__rows") * F.col("__others")).alias("n"), F.min(other).alias("first"))


def tiered(names: DataFrame, register: DataFrame, key: str, name: str, id_: str, reg_name: str, address: str | None = None) -> DataFrame:
    """(key, result, tier, ids): candidates agree in kind and numbers and hold all words of the name; a tier counts only if the one before found nothing; several
    candidates of a tier are ambiguous. Names without a known kind match nothing."""
    left = names.select(F.col(key), name_tokens(F.col(name)).alias("a")).where("a.kind <> ''").select(key, "a.kind", "a.state", F.concat_ws(",", "a.numbers").alias("nums"), F.col("a.words").alias("words")).distinct()
    where = F.split(F.regexp_replace(F.lower(F.coalesce(F.col(address), F.lit(""))), "[^a-z0-9]+", " "), " ") if address else F.array().cast("array<string>")
    right = register.select(F.col(id_).alias("__id_"), name_tokens(F.col(reg_name)).alias("b"), where.alias("place")).select(
        "__id_", F.col("b.kind").alias("kind"), F.col("b.state").alias("st"), F.concat_ws(",", "b.numbers").alias("nums"), F.col("b.words").alias("w2"), F.array_union("b.words", "place").alias("w3")
    )
    pool = contained(left, right, ["kind", "nums"], "words", "w3").where((F.col("state") == "") | (F.col("state") == F.col("st")))
    hits = pool.withColumn("tier", F.when(F.size(F.array_except("words", "w2")) == 0, 1).otherwise(2))
    best = hits.groupBy(key, "tier").agg(F.sort_array(F.collect_set("__id_")).alias("ids")).groupBy(key).agg(F.min(F.struct("tier", "ids")).alias("m"))
    tier = F.when(F.col("m.tier") == 1, "name").when(F.col("m.tier") == 2, "address").otherwise("")
    found = names.select(key).distinct().join(best, key, "left")
    return found.select(
        key, F.when(F.size("m.ids") == 1, "matched").when(F.size("m.ids") > 1, "ambiguous").otherwise("none").alias("result"), tier.alias("tier"), F.coalesce(F.array_join("m.ids", "|"), F.lit("")).alias("ids")
    )


#: From this ratio on, near-identical spellings share three letters in a row if one has six or more, else two, or are the same.
LEAST_CUTOFF = 0.86


def _grams(word: Column, n: int) -> Column:
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def spelling_tier(names: DataFrame, register: DataFrame, key: str, name: str, id_: str, reg_name: str, cutoff: float = 0.86) -> DataFrame:
    """(key, ids): the last tier, for names that the others left: every word has a near-identical one (by difflib's ratio) in the register's name. Only
    candidates of the same kind and numbers that share letters in a row with the name's longest word are compared: spellings whose ratio is ``LEAST_CUTOFF`` or more do."""
    if cutoff < LEAST_CUTOFF:
        raise ValueError(f"spellings less alike than {LEAST_CUTOFF} need not share letters in a row")
    toks = lambda df, c, *keep: df.select(*keep, name_tokens(F.col(c)).alias("a")).where("a.kind <> ''")
    left = toks(names, name, key).select(key, "a.kind", F.concat_ws(",", "a.numbers").alias("nums"), F.array_join("a.words", " ").alias("w"))
    right = toks(register, reg_name, id_).select(id_, "a.kind", F.concat_ws(",", "a.numbers").alias("nums"), F.array_join("a.words", " ").alias("w2"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [bool(w) and all(x in v.split(" ") or difflib.get_close_matches(x, v.split(" "), n=1, cutoff=cutoff) for x in w.split(" ")) for w, v in zip(pdf["w"], pdf["w2"])]
            yield pdf.loc[ok, [key, id_]]

    longest = F.array_max(F.transform(F.split("w", " "), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    grams = F.when(F.length("top") >= 6, _grams(F.col("top"), 3)).when(F.length("top") >= 2, _grams(F.col("top"), 2)).otherwise(F.array("top"))
    left = left.where("w <> ''").withColumn("top", longest).withColumn("gram", F.explode(F.array_distinct(grams))).drop("top")
    held = F.flatten(F.transform(F.split("w2", " "), lambda x: F.concat(_grams(x, 3), _grams(x, 2), F.array(x))))
    right = right.withColumn("gram", F.explode(F.array_distinct(held)))
    pairs = left.join(right, ["kind", "nums", "gram"]).select(key, id_, "w", "w2").distinct()
    hits = pairs.mapInPandas(near, _schema(pairs, key, id_))
    return hits.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(F.col(id_).cast("string"))), "|").alias("ids"))


def _schema(df: DataFrame, *cols: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)
