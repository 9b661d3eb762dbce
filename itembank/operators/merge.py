"""Merging a supplement into a bank: all of it or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how questions of a supplement are classified.
METHOD = "curacion_fuente_tematica_aportada"
UPDATED = ["prompt", "options", "answer", "topic", "block", "units", "method", "status", "reason", "active"]


def problems(bank: DataFrame, supplement: DataFrame) -> DataFrame:
    """``item_id``, ``problem``: rows that name no question of the bank, name one twice, or contradict its answer."""
    have = bank.select("item_id", F.col("answer").alias("old"), F.lit(True).alias("there"))
    named = supplement.where("item_id is not null").groupBy("item_id").agg(F.count("*").alias("n"), F.min("answer").alias("answer"))
    problem = F.when(F.col("there").isNull(), "unknown").when(F.col("n") > 1, "twice").when(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("answer")), "contradicts")
    return named.join(have, "item_id", "left").select("item_id", problem.alias("problem")).where("problem is not null")


def _sound(bad: DataFrame) -> Column:
    """True if there are no problems; else reading it raises, naming their number and the first one."""
    first = F.min(F.struct("item_id", "problem"))
    one = bad.agg(F.when(F.count("*") > 0, F.concat(F.count("*").cast("string"), F.lit(" rows of the supplement can't be merged, first "), first["item_id"].cast("string"), F.lit(": "), first["problem"])).alias("e"))
    return F.when(one.scalar().isNull(), True).otherwise(F.raise_error(one.scalar()).cast("boolean"))


def merged(bank: DataFrame, supplement: DataFrame, source_id: str, topic: str) -> DataFrame:
    """``bank`` with the supplement's questions, ``action`` telling kept, updated and inserted rows.

    Rows of ``supplement`` (item_id or null, number, prompt, options, answer, status, reason, active)
    that name a question replace its text, answer, classification and status and leave its origin; the
    others are inserted as ``source_id:first:number``. If any row can't be merged, the plan raises as a
    whole: no row of it is given out, so nothing is written.
    """
    block = F.split_part(F.lit(topic), F.lit("."), F.lit(1))
    fixed = {"topic": F.lit(topic), "block": block, "units": F.lit(20000), "method": F.lit(METHOD)}
    new = supplement.withColumns({c: v.cast(bank.schema[c].dataType) for c, v in fixed.items()})
    s = new.where("item_id is not null").select("item_id", F.struct(*UPDATED).alias("s"))
    kept = bank.join(s, "item_id", "left").withColumn("action", F.when(F.col("s").isNull(), "kept").otherwise("updated"))
    kept = kept.select(*[F.when(F.col("s").isNull(), F.col(c)).otherwise(F.col(f"s.{c}")).alias(c) if c in UPDATED else F.col(c) for c in bank.columns], "action")
    ins = new.where("item_id is null").withColumns({"item_id": F.concat_ws(":", F.lit(source_id), F.lit("first"), F.col("number").cast("string")), "exam_id": F.lit(source_id), "section": F.lit("first"), "action": F.lit("inserted")})
    rows = kept.unionByName(ins.select(*[F.col(c).cast(bank.schema[c].dataType) if c in ins.columns else F.lit(None).cast(bank.schema[c].dataType).alias(c) for c in bank.columns], "action"))
    return rows.where(_sound(problems(bank, supplement)))


def coverage_row(supplement: DataFrame, source_id: str) -> DataFrame:
    """What a supplement adds to the coverage: new questions, and those that were there already."""
    new = F.count_if(F.col("item_id").isNull())
    return supplement.agg(new.alias("expected"), new.alias("extracted"), F.count_if(F.col("item_id").isNull() & F.col("answer").isNotNull()).alias("answered"), F.count_if(F.col("item_id").isNotNull()).alias("already_present")).select(F.lit(source_id).alias("exam_id"), "*")
