"""Sources and sinks: documents, JSON contracts, sidecar inventories and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.functions import text as T
from itembank.operators import uploads as U


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``text`` of every file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_layout_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words of recognised pages, with integer boxes."""
    return spark.read.csv(path, sep="\t", header=True, schema="page int, block int, par int, line int, left int, top int, width int, height int, conf double, word string")


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below ``path``: id, cache key, bytes and year, by their folded path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return f.select("path", T.document_id(F.col("path")).alias("document_id"), T.cache_key(F.col("content")).alias("cache_key"), F.col("length").alias("bytes"), T.year_of(F.col("path")).alias("year"))


def upload_files(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """JSON files of at most 1 MiB."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return f.where(F.col("length") <= most).select("path", F.col("content").cast("string").alias("json"))


def todo(wanted: DataFrame, done: DataFrame, key: str = "cache_key") -> DataFrame:
    """What an incremental build still has to do."""
    return wanted.join(done.select(key), key, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet with nested options as JSON text, replaced as a whole."""
    cols = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").parquet(path)


#: A progress snapshot, version 1, as it is exported and imported.
SNAPSHOT = "struct<schemaVersion:int,exportedAt:string,attempts:array<struct<id:string,finishedAt:string>>,progress:array<struct<questionId:string,seen:long,correct:long,wrong:long,favorite:boolean>>>"


def export_progress(attempts: DataFrame, progress: DataFrame, exported_at: str) -> DataFrame:
    """``user_id``, ``json``: one document of version 1 for each user with attempts (attempt_id, finished) or
    progress (item_id, seen, correct, wrong, favorite), both in order of their ids. An account's history
    is one document, as what reads it expects."""
    a = attempts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("attempt_id").cast("string").alias("id"), F.col("finished").cast("string").alias("finishedAt")))).alias("attempts"))
    p = progress.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("item_id").cast("string").alias("questionId"), "seen", "correct", "wrong", "favorite"))).alias("progress"))
    none = [F.coalesce(c, F.array()).alias(c) for c in ("attempts", "progress")]
    return a.join(p, "user_id", "full_outer").select("user_id", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(exported_at).alias("exportedAt"), *none)).alias("json"))


def import_progress(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts and progress of snapshots (user_id, json); one of another version, or whose lists are none, gives nothing."""
    ok = snapshots.where(U.snapshot_ok(F.col("json"))).select("user_id", F.from_json("json", SNAPSHOT).alias("s"))
    a = ok.select("user_id", F.inline("s.attempts")).select("user_id", F.col("id").alias("attempt_id"), F.col("finishedAt").cast("timestamp").alias("finished"))
    p = ok.select("user_id", F.inline("s.progress")).withColumnRenamed("questionId", "item_id")
    return a, p


def legacy_snapshot(attempts: DataFrame, progress: DataFrame, now) -> DataFrame:
    """What an old store hands to an account: one row with version, time of export, ``attempts`` and
    ``progress`` as JSON; no row if both are empty. A store is one user's, so its rows fit one row."""
    whole = lambda rows: rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("json"), F.count("*").alias("n"))
    both = whole(attempts).select(F.col("json").alias("attempts"), F.col("n").alias("a")).join(whole(progress).select(F.col("json").alias("progress"), F.col("n").alias("p")))
    return both.where("a + p > 0").select(F.lit(1).alias("schemaVersion"), now.alias("exportedAt"), "attempts", "progress")
