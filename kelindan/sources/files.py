"""Readers and writers of the files that stages exchange."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a declared schema; a line that does not parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_nested_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose array, map and struct columns hold JSON. An empty quoted cell is an empty string, an empty bare cell is null."""
    simple = (T.ArrayType, T.MapType, T.StructType)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, simple) else f.dataType) for f in schema])
    raw = spark.read.schema(flat).options(header=True, mode="FAILFAST", multiLine=True, escape='"', nullValue="\u0000", emptyValue="").csv(path)
    return raw.select(*[F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, simple) else F.col(f.name) for f in schema])


def _counted(df: DataFrame, write) -> int:
    """Writes and returns how many rows were written."""
    from pyspark.sql import Observation

    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines with null fields kept; returns the number of rows."""
    return _counted(df, lambda d: d.write.option("ignoreNullFields", False).json(path))


def write_nested_csv(df: DataFrame, path: str) -> int:
    """The reverse of ``read_nested_csv``: nested columns as JSON text. Returns the number of rows; without rows nothing is written at all."""
    if df.isEmpty():
        return 0
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])
    return _counted(flat, lambda d: d.write.options(header=True, escape='"', nullValue="\u0000", emptyValue='""').csv(path))


def write_report(facts: dict, spark: SparkSession, path: str) -> None:
    """A small report as one JSON document."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(path).where("trim(value) <> ''").first()[0])


def write_corpus(docs: DataFrame, path: str) -> int:
    """Records of a corpus in order of day, undated ones first, then of id: files are ranges of that order."""
    return write_jsonl(docs.orderBy(F.coalesce("publish_date", F.lit("")), "doc_id"), path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text) of every file of a folder."""
    t = spark.read.option("wholetext", True).text(path)
    return t.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("stem"), F.col("value").alias("text"))


def attach_cached(ledger: DataFrame, cached: DataFrame) -> DataFrame:
    """Ledger rows with the text that was kept under the stem of their cache path; rows without a kept text drop out."""
    stem = F.regexp_extract("cache_path", r"([^/]+?)(?:\.[^/]*)?$", 1)
    return ledger.withColumn("stem", stem).join(cached, "stem").drop("stem")


def write_run(tables: dict[str, DataFrame], base: str, run_id: str) -> dict[str, int]:
    """Writes tables under ``base/<name>/run_id=...``; a run is immutable, so a second write of one id fails. Returns rows per table, counted as they are written."""
    return {name: _counted(df, lambda d, n=name: d.write.mode("errorifexists").parquet(f"{base}/{n}/run_id={run_id}")) for name, df in tables.items()}


def point_to(spark: SparkSession, base: str, run_id: str) -> None:
    """Names the run that is to be read."""
    write_report({"run_id": run_id}, spark, f"{base}/_latest")


def pointed_run(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the run that the pointer names."""
    return spark.read.parquet(f"{base}/{name}/run_id={read_report(spark, f'{base}/_latest')['run_id']}")


def latest_run(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The newest run of a table; ids sort by time."""
    runs = spark.read.option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")
    newest = runs.agg(F.max("run_id").alias("run_id"))
    return runs.join(newest, "run_id", "left_semi")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: A record of a region dump: ('11.01','Kabupaten X',1.5,2.5,...). Quotes inside are doubled or escaped.
_RECORD = r"\('([0-9.]+)','((?:[^'\\\\]|''|\\\\.)*)',(NULL|[-0-9.]+),(NULL|[-0-9.]+)"


def read_region_dump(spark: SparkSession, path: str) -> DataFrame:
    """(kode, provinsi_kode, nama, lat, lng) of the regencies of an SQL dump; NULL is null. Provinces have no dot in their code, districts two."""
    text = spark.read.option("wholetext", True).text(path)
    rec = text.select(F.explode(F.regexp_extract_all("value", F.lit(_RECORD), F.lit(0))).alias("r"))
    part = lambda k: F.regexp_extract("r", _RECORD, k)
    name = F.replace(F.replace(part(2), F.lit("\\'"), F.lit("'")), F.lit("''"), F.lit("'"))
    rows = rec.select(part(1).alias("kode"), name.alias("nama"), part(3).try_cast("double").alias("lat"), part(4).try_cast("double").alias("lng"))
    dots = F.length("kode") - F.length(F.replace("kode", F.lit("."), F.lit("")))
    provinces = rows.where(~F.contains("kode", F.lit("."))).select(F.col("kode").alias("provinsi_kode"), F.col("nama").alias("provinsi"))
    return rows.where(dots == 1).withColumn("provinsi_kode", F.substring_index("kode", ".", 1)).join(provinces, "provinsi_kode", "left").select("kode", "provinsi_kode", "provinsi", "nama", "lat", "lng")


def lexicon_manifest(version: str, tables: dict[str, int], inputs: DataFrame | None = None) -> str:
    """What a run was made of, as JSON: rule version (``lexicon.version()``), rows per table, and digests of its input files (``file_digests``, one row a file)."""
    files = {r.path: r.sha256 for r in inputs.select("path", "sha256").toLocalIterator()} if inputs is not None else {}
    return json.dumps({"rules": version, "rows": tables, "inputs": files}, sort_keys=True)
