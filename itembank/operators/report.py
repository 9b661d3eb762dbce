"""The report of a build as lines of Markdown, from tables of several grains.

Every section gives rows of ``part``, ``name``, ``a``, ``b``, ``line``, and these order them; no window
runs over the whole report, and :func:`write` sorts by them once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.functions import stage
from itembank.operators.build import DECIDED, Build

#: Columns of a build that the report needs.
COLUMNS = ["item_id", "ord", "section", "number", "topic", "method", "status", "reason", "decision", "preview"]
#: The report's texts.
TITLE = "# Informe de importación"
SUMMARY = ["Exámenes procesados", "Preguntas totales", "Banco activo (vigente)", "Excluidas del banco activo", "Rechazadas en parsing"]
HEADS = {
    2: ["## Resumen general"], 3: ["## Estado de las preguntas"], 4: ["## Cobertura por examen", "", "| Examen | Esperadas | Extraídas | Activas | Secciones |", "|--------|-----------|-----------|---------|-----------|"],
    5: ["## Distribución por tema (banco activo)"], 6: ["## Clasificación manual de preguntas pendientes", "", "| Pregunta | Tema | Motivo |", "|---|---|---|"], 7: ["## Preguntas rechazadas en parsing"],
    8: ["## Preguntas fuera del banco activo", "", "| ID | Examen | Sección | # | Estado | Motivo |", "|----|--------|---------|---|--------|--------|"],
}
CRITERIA = [
    "## Criterio de admisión", "", "Las preguntas entran en el banco vigente (`active: true`) únicamente si:", "1. Tienen respuesta oficial (letra A–D).", "2. La clasificación temática alcanza confianza ≥ 0.68.",
    "3. No hacen referencia a normativa expresamente derogada.", "4. No son duplicadas literales de otra pregunta anterior.", "",
    "Las preguntas excluidas se conservan con trazabilidad completa y", "pueden consultarse en el explorador con el filtro 'Pendientes de revisión'.",
]


def _rows(df: DataFrame, part: int, lines: list[Column], name: Column | None = None, a: Column | None = None, b: Column | None = None) -> DataFrame:
    """One or several lines for each row of ``df``; those of one row are numbered within ``b``."""
    zero = F.lit(0).cast("long")
    at = F.posexplode(F.array(*lines)).alias("k", "line")
    name, a, b = F.lit("") if name is None else name, zero if a is None else a, zero if b is None else b
    return df.select(F.lit(part).alias("part"), name.alias("name"), a.cast("long").alias("a"), (b.cast("long") * len(lines)).alias("b0"), at).select("part", "name", "a", (F.col("b0") + F.col("k")).alias("b"), "line")


def markdown(built: Build, exams: DataFrame, program: list[tuple[str, str, list[str]]], date: str, source: str) -> DataFrame:
    """The report's lines. ``exams``: exam_id, ord. ``program``: block, its name, its topics in order."""
    spark, fmt = built.questions.sparkSession, F.format_string
    # duplicates are looked for once, for all parts
    q, _ = stage.written(built.questions.select("exam_id", "position", "active", *COLUMNS[:-1]), "report-questions")
    fixed = [(1, k, x) for k, x in enumerate([TITLE, "", f"Fecha: {date}", f"Fuente: {source}", ""])]
    fixed += [(p, k - 1000, x) for p, texts in HEADS.items() for k, x in enumerate(texts + [""] * (len(texts) == 1))] + [(9, k, x) for k, x in enumerate(CRITERIA)]
    out = [spark.createDataFrame(fixed, "part int, a long, line string").select("part", F.lit("").alias("name"), "a", F.lit(0).cast("long").alias("b"), "line")]
    n = q.agg(F.count("*").alias("all"), F.count_if("active").alias("active"))
    both = n.join(built.coverage.agg(F.count("*").alias("exams"))).join(built.excluded.agg(F.count("*").alias("rejected")))
    values = [F.col("exams"), F.col("all"), F.col("active"), F.col("all") - F.col("active"), F.col("rejected")]
    out.append(_rows(both, 2, [fmt(f"- **{s}**: %d", v) for s, v in zip(SUMMARY, values, strict=True)]))
    out.append(_rows(q.groupBy("status").agg(F.count("*").alias("n")), 3, [fmt("- `%s`: %d", "status", "n")], F.col("status")))
    told = F.regexp_replace(F.regexp_replace("section_counts", r'[{}"]', ""), ": ", "=")
    exam = F.col("exam_id").cast("string")
    out.append(_rows(built.coverage.join(exams.select("exam_id", "ord"), "exam_id"), 4, [fmt("| %s | %d | %d | %d | %s |", exam, "expected", "extracted", "active", told)], a=F.col("ord")))
    topics = [(i, k, f"### Bloque {b}: {name}" if k < 0 else t, t) for i, (b, name, ts) in enumerate(program) for k, t in [(-1, ""), *enumerate(ts)]]
    grid = spark.createDataFrame(topics, "i long, k long, head string, topic string").join(q.where("active").groupBy("topic").agg(F.count("*").alias("n")), "topic", "left")
    line = F.when(F.col("k") < 0, F.col("head")).otherwise(fmt("- **%s**: %d preguntas", "topic", F.coalesce("n", F.lit(0))))
    out.append(_rows(grid, 5, [line], a=F.col("i"), b=F.col("k")))
    decided = q.where(F.col("method") == DECIDED)
    out.append(_rows(decided, 6, [fmt("| `%s` | %s | %s |", "item_id", "topic", "decision")], F.lit(""), F.col("ord"), F.col("position")))
    out.append(_rows(built.excluded, 7, [fmt("- [%s] #%d: %s", exam, "number", "reason"), fmt("  Texto: _%s_", "preview")], a=F.col("ord"), b=F.col("position")))
    cells = [exam, F.col("section"), F.col("number"), F.col("status"), F.col("reason")]
    out.append(_rows(q.where("not active"), 8, [fmt("| %s | %s | %s | %d | `%s` | %s |", F.col("item_id"), *cells)], a=F.col("ord"), b=F.col("position")))
    return reduce(DataFrame.unionByName, out)


def write(lines: DataFrame, path: str) -> None:
    """The report as one text file; its lines grow with exceptions and topics, not with the bank."""
    lines.orderBy("part", "name", "a", "b").select("line").coalesce(1).write.mode("overwrite").text(path)
