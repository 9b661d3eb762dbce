"""Several readings of a questionnaire: each aligned to the plan apart, then resolved by priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itembank.operators import layout as L

#: A document's embedded reading counts if it has so many questions.
LEAST_EMBEDDED = 20


def together(readings: list[tuple[str, DataFrame]], key: str = "doc_id") -> DataFrame:
    """The questions of all readings (key, segment, number, prompt, options, page, order) with
    ``reading`` and its ``priority``, 0 first."""
    one = lambda i, name, df: df.select(key, "segment", "number", "prompt", "options", "page", "order", F.lit(name).alias("reading"), F.lit(i).alias("priority"))
    return reduce(DataFrame.unionByName, [one(i, n, df) for i, (n, df) in enumerate(readings)])


def without_thin(rows: DataFrame, reading: str, least: int = LEAST_EMBEDDED, key: str = "doc_id") -> DataFrame:
    """``rows`` without those of a reading in documents where it has too few questions."""
    n = F.count_if(F.col("reading") == reading).over(Window.partitionBy(key))
    return rows.withColumn("_n", n).where((F.col("reading") != reading) | (F.col("_n") >= least)).drop("_n")


def cells(rows: DataFrame, plan: list[tuple[str, int]], key: str = "doc_id") -> DataFrame:
    """``key``, ``priority``, ``reading``, ``section``, ``number``, ``how``, ``question`` (struct) for every
    place of the plan that a reading fills. One shuffle aligns all documents' readings, each apart."""
    of = [key, "priority", "reading"]
    each = rows.select(*of, "page", "order", "number", "segment", F.struct("prompt", "options", "page", "order").alias("question"))
    return L.aligned(each, plan, of, "question").where("question is not null").select(*of, "section", "number", "how", "question")


def resolved(rows: DataFrame, by: list[str], repairs: DataFrame | None = None, overrides: list[str] = ()) -> DataFrame:
    """Of each cell (``by``) the row of the first reading that has it; ``reading`` tells whose it is.

    ``rows`` have ``priority`` and ``reading``; readings named in ``overrides`` come before all others,
    the later named the earlier. ``repairs`` (``by`` and the columns of the rows but these two) come last. Of
    one reading's rows for a cell the smallest wins. All in one aggregate, so one shuffle.
    """
    first = reduce(lambda c, x: F.when(F.col("reading") == x[1], -1 - x[0]).otherwise(c), enumerate(overrides), F.col("priority"))
    every = rows.withColumn("priority", first)
    if repairs is not None:
        every = every.unionByName(repairs.withColumns({"priority": F.lit(1 << 30), "reading": F.lit("repair")}))
    rest = [c for c in every.columns if c not in (*by, "priority", "reading")]
    g = every.groupBy(*by).agg(F.min(F.struct("priority", "reading", *rest)).alias("r"))
    return g.select(*by, "r.reading", *[F.col(f"r.{c}").alias(c) for c in rest])
