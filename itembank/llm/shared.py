"""What several corpus operators need: the shared folder, written tables, components.

Executors can be lost at any time, so intermediate results are written as Parquet to the
folder that the cluster shares (``spark.checkpoint.dir``) and read again; nothing is kept on
one machine only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI. Where ``spark.checkpoint.dir`` is unset, a local master gets a folder
    of its own and any other raises: executors elsewhere would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="itembank-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") if "://" in base else "file://" + base.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table written to the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A key with a larger share of the rows is looked up by broadcast; fewer than 1 / share keys have it.
HOT_SHARE = 0.001


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], total: int, how: str = "left") -> DataFrame:
    """``rows`` joined to ``values`` (one row a key, ``n``: how many of the rows have it) by ``keys``.

    However many rows share a key, no task gets them all: keys of over a thousandth of the ``total``
    are under a thousand at any size, so theirs are broadcast and their rows stay where they are;
    the others are joined by a shuffle. Null keys find nothing.
    """
    hot = F.broadcast(values.where(F.col("n") > HOT_SHARE * total))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(values.where(F.col("n") <= HOT_SHARE * total), keys, how)
    return rows.join(hot, keys).unionByName(rest)


#: A filter of keys has so many bits a key, in maps of so many bits each, and 16 MiB at most: beyond that it
#: lets more rows pass, which bears on time only, since what passes is joined.
KEY_BITS, MAP_BITS, MOST_BITS = 32, 1 << 15, 1 << 27


def sifted(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``key`` surely isn't among the longs of ``keys``, and the others.

    Neither part is shuffled. All rows with such a key are in the second part, besides one in 32 of
    the others; a join of that part with ``keys`` tells these apart, so that wide rows move only
    where their key is likely to be there. Null keys are in either part.
    """
    bits = min(most_bits, max(1, -(-keys.count() * KEY_BITS // MAP_BITS)) * MAP_BITS)
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits)).alias("place")
    maps = keys.select(place).groupBy(F.shiftright("place", 15).alias("map")).agg(F.bitmap_construct_agg(F.col("place") % MAP_BITS).alias("bits"))
    told = rows.select(F.struct(*rows.columns).alias("row"), place).withColumn("map", F.shiftright("place", 15)).join(F.broadcast(maps), "map", "left")
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast(place % {MAP_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1, F.lit(False))
    own = [F.col("row")[c].alias(c) for c in rows.columns]
    return told.where(~there).select(*own), told.where(there).select(*own)


#: Python workers live as long as an executor: they give memory back to the system when they free it,
#: and Arrow batches, which the executor and its workers hold, have at most so many bytes.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "1048576"}
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> None:
    """Let workers import this package from where the driver has it, unless it was shipped to them, and
    keep them small."""
    for k, v in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(k, v)
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(most, str(BATCH_BYTES))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def slices(batches, rows: int = 500, most_bytes: int = 8 << 20):
    """Arrow batches (Spark bounds them by bytes) in slices of at most ``rows`` rows.

    A slice of long rows is halved until it holds ``most_bytes`` or one row, so that what is made
    of a slice stays small. Empty batches give nothing.
    """
    for b in batches:
        todo = [(i, min(rows, b.num_rows - i)) for i in range(0, b.num_rows, rows)][::-1]
        while todo:
            at, n = todo.pop()
            part = b.slice(at, n)
            if n > 1 and part.nbytes > most_bytes:
                todo += [(at + n // 2, n - n // 2), (at, n // 2)]
            else:
                yield part


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns ``node``, ``component`` for every node of ``edges`` (columns ``a``, ``b``, long).

    Alternates small-star and large-star steps until nothing changes; ``component`` is the
    smallest node that can be reached. Every step is an aggregate with map-side combine and a
    plain join, so a node with very many neighbours is split by adaptive execution. Null ends
    and loops are ignored; no edges give no rows. Raises if ``max_rounds`` isn't enough.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    cur = written(e, "links")
    last = None
    for _ in range(max_rounds):
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last or not state["n"]:
            out = written(cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                cur.select("v", "v")).groupBy("node").agg(F.min("component").alias("component")), "components")
            dropped(cur)
            return out
        last = state
        # small star: every smaller neighbour of a node links to the smallest of them; first, so
        # that what a node's many links say is said by links between few nodes from then on
        least = cur.groupBy("u").agg(F.min("v").alias("m"))
        joined = cur.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))).distinct()
        # large star: every larger neighbour links to the smallest of the neighbourhood
        both = small.union(small.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nxt = written(large, "links")
        dropped(cur)
        cur = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
