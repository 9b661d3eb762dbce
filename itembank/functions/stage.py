"""Written stages: what several outputs share is computed once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; a local master without one gets
    a folder of its own, any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="itembank-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") if "://" in base else "file://" + base.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str, **counters: Column) -> tuple[DataFrame, dict]:
    """``df`` as a table in the shared folder, and the ``counters`` observed while it was written."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    seen = Observation()
    (df.observe(seen, *[c.alias(n) for n, c in counters.items()]) if counters else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out, seen.get if counters else {}


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A filter of keys has so many bits a key, in maps of so many bits each, and 16 MiB at most: beyond that it
#: lets more rows pass, which bears on time only, since what passes is joined.
KEY_BITS, MAP_BITS, MOST_BITS = 32, 1 << 15, 1 << 27


def looked_up(rows: DataFrame, values: DataFrame, key: str, n: int, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` joined (left) to ``values``, a table of ``n`` rows with one for each ``key``, where few rows find one.

    Rows whose key surely isn't there, by a bitmap of the keys' hashes, stay where they are and get nulls;
    the others, one in 32 of those without a value among them, are joined exactly. ``rows`` are read
    twice and so should be a written table.
    """
    bits = min(most_bits, max(1, -(-n * KEY_BITS // MAP_BITS)) * MAP_BITS)
    place = F.pmod(F.xxhash64(key), F.lit(bits)).alias("_place")
    maps = values.select(place).groupBy(F.shiftright("_place", 15).alias("_map")).agg(F.bitmap_construct_agg(F.col("_place") % MAP_BITS).alias("_bits"))
    told = rows.withColumn("_place", place).withColumn("_map", F.shiftright("_place", 15)).join(F.broadcast(maps), "_map", "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_place % {MAP_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1, F.lit(False))
    found = told.where(there).select(*rows.columns).join(values, key, "left").select(*rows.columns, *[c for c in values.columns if c != key])
    return told.where(~there).select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in values.schema if f.name != key]).unionByName(found)


#: Both halves of a row's hash, added up as numbers that can't overflow: the same for any order of rows.
def checksum(columns: list[str]) -> Column:
    return F.coalesce(F.sum(F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")), F.lit(0)).cast("string")
