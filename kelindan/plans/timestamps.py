"""Query p2_found: one unambiguous form of every date and time of citations and the fetch ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelindan.operators.timestamps import normalise_timestamps
from kelindan.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the three columns in one pass over each table; zones come from outlets by domain, whose few rows Spark may
    broadcast by their size."""
    cited = table(spark, sf_dir, "citations").select(
        "domain",
        F.inline(
            F.array(
                F.struct(F.lit("citation_date").alias("col"), F.col("citation_id").alias("rec_id"), F.col("date").alias("value")),
                F.struct(F.lit("citation_access_date").alias("col"), F.col("citation_id").alias("rec_id"), F.col("access_date").alias("value")),
            )
        ),
    )
    ledger = table(spark, sf_dir, "fetch_ledger").select(
        "domain", F.lit("ledger_extracted_date").alias("col"), F.col("entry_id").alias("rec_id"), F.col("extracted_date").alias("value")
    )
    outlets = table(spark, sf_dir, "outlets").select(F.lower(F.trim("domain")).alias("site"), "tz").dropDuplicates(["site"])
    values = cited.unionByName(ledger).where(F.col("value").rlike("[0-9]"))
    joined = values.withColumn("site", F.lower(F.trim("domain"))).join(outlets, "site", "left")
    found = normalise_timestamps(joined, "value", "tz").where(F.col("norm").isNotNull())
    return found.select("col", "rec_id", "norm").distinct()


QUERIES = {"p2_found": p2_found}
