"""Stored tables that change in steps: nothing of a step is seen before its manifest is there.

A store is a folder with data in parts (buckets of some key) and manifests; the highest numbered
manifest names the folder of each part. A step writes new folders for the parts that it changes,
beside the old ones, and then its manifest, under a temporary name, which is renamed. A step that
fails, or is killed, leaves the store as it was, and of two steps from one version only one can
commit. A step with the number of a batch that is in already changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.functions import stage
from itembank.operators import practice as P

BUCKETS = 64
#: Shares of a bucket that tasks add up and write on their own.
SHARES = 16


class Conflict(RuntimeError):
    """Another step committed first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    batch: int = -1
    #: The folder of each part, by table and bucket ("progress/7").
    parts: dict | None = None


class Store:
    """Versioned tables in parts below ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def current(self) -> Version:
        """The last committed version."""
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*.json")) or []
        if not found:
            return Version(parts={})
        last = max((str(f.getPath().toString()) for f in found))
        (raw,) = self.spark.read.text(last, wholetext=True).collect()
        return Version(**json.loads(raw["value"]))

    def read(self, version: Version, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows as of a version, of all buckets or some; none where it has no part."""
        names = [f"{table}/{b}" for b in (range(self.buckets) if buckets is None else buckets)]
        paths = [f"{self.path}/{version.parts[n]}" for n in names if n in version.parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, table: str, buckets: list[int], dealt: bool = False) -> dict:
        """New folders for ``buckets`` with the rows of ``df`` (which has ``bucket``), seen by nobody yet; rows
        that are ``dealt`` by bucket or finer already aren't moved again."""
        folder = f"data/{table}-{uuid.uuid4().hex[:12]}"
        (df if dealt else df.repartition("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        there = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))}
        return {f"{table}/{b}": f"{folder}/bucket={b}" if f"bucket={b}" in there else None for b in buckets}

    def commit(self, since: Version, changed: dict, batch: int) -> Version:
        """The version after ``since`` with ``changed`` parts (None: gone)."""
        parts = {k: v for k, v in (since.parts | changed).items() if v is not None}
        new = Version(since.number + 1, batch, parts)
        temporary, final = f"{self.path}/.manifest-{uuid.uuid4().hex}", f"{self.path}/manifest-{new.number:09d}.json"
        out = self._fs.create(self._path(temporary), True)
        out.write(bytearray(json.dumps(new.__dict__, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(self._path(final)) or not self._fs.rename(self._path(temporary), self._path(final)):
            self._fs.delete(self._path(temporary), False)
            raise Conflict(f"version {new.number} of {self.path} is there already")
        return new


# Progress

PROGRESS = "user_id long, item_id string, seen long, correct long, wrong long, last_seen timestamp"
LEDGER = "user_id long, attempt_id string"


def record(store: Store, attempts: DataFrame, batch: int) -> Version:
    """Fold a batch of ``attempts`` (user_id, attempt_id, finished, outcomes) into the stored progress.

    An attempt that the ledger has, or that the batch repeats, counts once, the first to finish; refused
    ones (:func:`practice.checked_attempts`) not at all. Only buckets of users in the batch are read
    and written, so a batch costs what it touches. For streams: ``foreachBatch(lambda df, n: record(store, df, n))``.
    """
    now = store.current()
    if batch <= now.batch:
        return now
    ok = P.checked_attempts(attempts.select(F.col("user_id").cast("long").alias("user_id"), F.col("attempt_id").cast("string").alias("attempt_id"), "finished", "outcomes")).where("issue is null and user_id is not null and attempt_id is not null")
    once = ok.groupBy("user_id", "attempt_id").agg(F.min(F.struct("finished", "outcomes")).alias("a")).withColumn("bucket", store.bucket("user_id"))
    once, _ = stage.written(once, "attempts")
    touched = [r["bucket"] for r in once.select("bucket").distinct().collect()]  # at most store.buckets
    ledger = store.read(now, "ledger", LEDGER, touched)
    new, counted = stage.written(once.join(ledger, ["user_id", "attempt_id"], "left_anti"), "new-attempts", n=F.count("*"))
    if not counted["n"]:
        return store.commit(now, {}, batch)
    rows = new.select("user_id", "a.finished", F.explode("a.outcomes").alias("o"))
    said = lambda v: F.coalesce((F.col("o.outcome") == v).cast("long"), F.lit(0)).alias(v)
    added = rows.select("user_id", F.col("o.item_id").cast("string").alias("item_id"), F.lit(1).cast("long").alias("seen"), said("correct"), said("wrong"), F.col("finished").alias("last_seen"))
    both = store.read(now, "progress", PROGRESS, touched).unionByName(added)
    # rows move once: by shares of a bucket, within which they are added up and written
    share = F.pmod(F.xxhash64("user_id"), F.lit(store.buckets * SHARES))
    total = both.withColumn("share", share).repartition("share").groupBy("share", "user_id", "item_id").agg(*[F.sum(c).alias(c) for c in ("seen", "correct", "wrong")], F.max("last_seen").alias("last_seen"))
    total = total.withColumn("bucket", (F.col("share") % store.buckets).cast("int")).drop("share")
    every = ledger.unionByName(new.select("user_id", "attempt_id")).withColumn("bucket", store.bucket("user_id"))
    return store.commit(now, store.write(total, "progress", touched, dealt=True) | store.write(every, "ledger", touched), batch)


def progress(store: Store) -> DataFrame:
    return store.read(store.current(), "progress", PROGRESS)


# Builds by content

FILES = "document_id string, path string, cache_key string"


def delta(files: DataFrame, known: DataFrame) -> DataFrame:
    """``document_id``, ``path``, ``cache_key``, ``change``: new, changed, gone or same, by the key of the content."""
    a, b = files.select("document_id", "path", "cache_key"), known.select("document_id", F.col("cache_key").alias("old"), F.col("path").alias("old_path"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("cache_key").isNull(), "gone").when(F.col("old") != F.col("cache_key"), "changed").otherwise("same")
    return a.join(b, "document_id", "full_outer").select("document_id", F.coalesce("path", "old_path").alias("path"), F.coalesce("cache_key", "old").alias("cache_key"), change.alias("change"))


def rebuild(store: Store, files: DataFrame, build, schema: str) -> tuple[Version, dict]:
    """Bring a derived table up to date with ``files`` (document_id, path, cache_key; one row each).

    ``build`` makes rows (with ``document_id``, of ``schema``) from files. Only buckets with a new,
    changed or gone file are written, and of these only new and changed files are built again, the
    rest is taken over. Without a change nothing is written, not even a manifest. Also returns how
    many files there are of each change.
    """
    now = store.current()
    known = store.read(now, "files", FILES)
    plan, _ = stage.written(delta(files, known).withColumn("bucket", store.bucket("document_id")), "delta")
    counts = {r["change"]: r["n"] for r in plan.groupBy("change").agg(F.count("*").alias("n")).collect()}
    touched = [r["bucket"] for r in plan.where("change <> 'same'").select("bucket").distinct().collect()]
    if not touched:
        return now, counts
    todo = plan.where(F.col("change").isin("new", "changed")).select("document_id", "path", "cache_key")
    kept = store.read(now, "built", schema, touched).join(plan.where("change = 'same'").select("document_id"), "document_id", "left_semi")
    made = kept.unionByName(build(todo)).withColumn("bucket", store.bucket("document_id"))
    listed = plan.where((F.col("change") != "gone") & F.col("bucket").isin(touched)).select("document_id", "path", "cache_key", "bucket")
    return store.commit(now, store.write(made, "built", touched) | store.write(listed, "files", touched), now.batch), counts


# Tables written and read again


@dataclass(frozen=True)
class Receipt:
    """What a write put down: rows and an order-free checksum of all columns."""

    path: str
    rows: int
    checksum: str


def put(df: DataFrame, path: str) -> Receipt:
    """Write a table as a whole, counting on the way."""
    seen = stage.Observation()
    df.observe(seen, F.count("*").alias("rows"), stage.checksum(df.columns).alias("checksum")).write.mode("overwrite").parquet(path)
    return Receipt(path, seen.get["rows"], seen.get["checksum"])


def read_back(spark: SparkSession, receipt: Receipt, schema) -> tuple[DataFrame, DataFrame]:
    """The stored table, and one row ``written``, ``stored``, ``same`` that compares it with its receipt."""
    stored = spark.read.schema(schema).parquet(receipt.path)
    one = stored.agg(F.count("*").alias("stored"), stage.checksum(stored.columns).alias("c"))
    return stored, one.select(F.lit(receipt.rows).cast("long").alias("written"), "stored", ((F.col("stored") == receipt.rows) & (F.col("c") == receipt.checksum)).alias("same"))


