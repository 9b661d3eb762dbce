"""Exam transcripts to questions: headers, starts, options, answers and what continues them.

A transcript is one row, and its fold depends on what came before, so each is read by a small
helper inside ``mapInArrow``; nothing is shuffled. Quirks kept on purpose: a start does not end the
question before it (only an answer line, a header or the end do, so a question without an answer
line is lost when another starts), letters of options are not checked (their order counts), and a
question belongs to the last section whose header stands strictly above its first line.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.functions import workers

#: The patterns of a transcript's lines, and the sections of an exam with the pattern
#: of their header, exercise, reserve, number of questions and blocks.
START = r"^([0-9]+)\.\s+(.+)"
OPTION = r"^\s+([A-D])\)\s+(.+)"
ANSWER = r"^\s+RESPUESTA CORRECTA:\s+([A-D])\)"
HEADER = r"^(PRIMERA PARTE|SUPUESTO [IV]+)\s*[—–-]\s*(Preguntas.*)"
SEPARATOR = r"^[-=]+$"
SECTIONS = [
    ("first", r"PRIMERA PARTE\s*[—–-]\s*Preguntas\s+1\s+a\s+80", "primera_parte", False, 80, ["I", "II", "III", "IV"]),
    ("first_reserve", r"PRIMERA PARTE\s*[—–-]\s*Preguntas\s+de\s+reserva", "primera_parte", True, 5, ["I", "II", "III", "IV"]),
    ("case_iii", r"SUPUESTO I\s*[—–-]\s*Preguntas\s+1\s+a\s+20", "supuesto_practico", False, 20, ["III"]),
    ("case_iii_reserve", r"SUPUESTO I\s*[—–-]\s*Preguntas\s+de\s+reserva", "supuesto_practico", True, 5, ["III"]),
    ("case_iv", r"SUPUESTO II\s*[—–-]\s*Preguntas\s+1\s+a\s+20", "supuesto_practico", False, 20, ["IV"]),
    ("case_iv_reserve", r"SUPUESTO II\s*[—–-]\s*Preguntas\s+de\s+reserva", "supuesto_practico", True, 5, ["IV"]),
]


def section_of(line: Column) -> Column:
    """The section that a line announces anywhere in it; the first of the list, or null."""
    return F.coalesce(*[F.when(line.rlike(p), F.lit(key)) for key, p, *_ in SECTIONS])


def line_kind(line: Column) -> Column:
    """header, separator, answer, option, start, blank or text; the first that fits."""
    return (
        F.when(line.rlike(HEADER), "header").when(F.trim(line).rlike(SEPARATOR), "separator").when(line.rlike(ANSWER), "answer").when(line.rlike(OPTION), "option")
        .when(line.rlike(START), "start").when(F.regexp_replace(line, r"\s", "") == "", "blank").otherwise("text")
    )


def questions_of(text: str) -> list[tuple[str | None, int, str, list[str], str | None]]:
    """``(section, number, prompt, options, answer)`` of a transcript, in order."""
    start, option, answer, header, rule = (re.compile(p) for p in (START, OPTION, ANSWER, HEADER, SEPARATOR))
    heads = [(key, re.compile(p)) for key, p, *_ in SECTIONS]
    found, section = [], None
    number, place, prompt, options = None, None, [], []

    def close(letter: str | None) -> None:
        if number is not None:
            found.append((place, number, re.sub(r"\s+", " ", " ".join(prompt)).strip(), [o.strip() for o in options], letter and letter.lower()))

    for line in (text or "").split("\n"):
        # most lines can be told by a word that a pattern asks for
        announces = "PRIMERA PARTE" in line or "SUPUESTO" in line
        said = next((key for key, p in heads if p.search(line)), None) if announces else None
        headed, ruled = announces and header.match(line), rule.match(line.strip())
        m = None if headed or ruled or "RESPUESTA" not in line else answer.match(line)
        if headed or m:
            close(m[1] if m else None)
            number, prompt, options = None, [], []
        elif ruled:
            pass
        elif line[:1].isspace() and (m := option.match(line)):
            options.append(m[2])
        elif m := start.match(line):
            number, place, prompt, options = int(m[1]), section, [m[2]], []
        elif number is not None and (more := line.strip()):
            if options:
                options[-1] += " " + more
            else:
                prompt.append(more)
        section = said or section
    close(None)
    return found


QUESTIONS = "number int, section string, prompt string, options array<string>, answer string, position int"
_KINDS = {"number": pa.int32(), "section": pa.string(), "prompt": pa.string(), "options": pa.list_(pa.string()), "answer": pa.string(), "position": pa.int32()}
_ORDER = ["section", "number", "prompt", "options", "answer", "position"]


def parse_txt(docs: DataFrame, key: str = "exam_id", text: str = "text", only: list[str] | None = None, also: list[str] | None = None) -> DataFrame:
    """``key``, number, section, prompt, options, answer and position (from 0) of every question of every
    transcript; of these columns ``only`` some, if others aren't needed and needn't be moved. Columns of
    ``docs`` named in ``also`` come with each question.

    Null and empty texts have none; a question before any header has a null section, one without an
    answer line a null answer. Repeated rows come out repeated.
    """
    workers.ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names, also = [n for n in _KINDS if only is None or n in only], also or []

    def run(batches):
        for b in workers.slices(batches):
            keys, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                mine = [(*q, at) for at, q in enumerate(questions_of(t))]
                rows += mine
                keys += [i] * len(mine)
            cols = dict(zip(_ORDER, list(zip(*rows, strict=True)) or [()] * 6, strict=True))
            of = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), *[pa.array(cols[n], _KINDS[n]) for n in names], *[b.column(i).take(of) for i in range(2, 2 + len(also))]], names=[key, *names, *also])

    kinds = [f"{key} {kind}", *[c for c in QUESTIONS.split(", ") if c.split()[0] in names], *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in also]]
    return docs.select(key, text, *also).mapInArrow(run, ", ".join(kinds))


#: The sections' names and numbers of questions.
EXPECTED = [(key, n) for key, _, _, _, n, _ in SECTIONS]


def section_grid(questions: DataFrame, specs: list[tuple[str, int]], key: str) -> DataFrame:
    """``key``, ``section``, ``expected`` for every exam there is and every section of the specs."""
    of_one = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("expected")) for s, n in specs])
    return questions.select(key).distinct().select(key, F.explode(of_one).alias("x")).select(key, "x.section", "x.expected")


def accepted(questions: DataFrame) -> DataFrame:
    """``questions`` with ``issues``: what keeps a question out of the bank (empty: nothing).

    The contract of an import: a section, four options with text, a prompt, an answer from a to d
    or none.
    """
    size = F.size("options")
    issues = F.array_compact(F.array(
        F.when(F.col("section").isNull(), "no section"), F.when(size != 4, F.concat(size.cast("string"), F.lit(" options"))), F.when(F.exists("options", lambda o: F.trim(o) == ""), "empty option"),
        F.when(F.trim("prompt") == "", "empty prompt"), F.when(F.col("answer").isNotNull() & ~F.col("answer").isin("a", "b", "c", "d"), "answer")))
    return questions.withColumn("issues", F.array_join(issues, "; "))


def coverage(questions: DataFrame, specs: list[tuple[str, int]] = EXPECTED, key: str = "exam_id") -> DataFrame:
    """By exam: ``expected``, ``extracted``, ``answered``, ``section_counts`` (JSON by section, in
    order) and ``missing`` (section:number, in the order of the specs' names and numbers)."""
    have = questions.where("section is not null").groupBy(key, "section").agg(F.count("*").alias("n"), F.count("answer").alias("answered"), F.collect_set("number").alias("numbers"))
    by = section_grid(questions, specs, key).join(have, [key, "section"], "left")
    gaps = F.transform(F.array_except(F.sequence(F.lit(1), F.col("expected")), F.coalesce("numbers", F.array().cast("array<int>"))), lambda n: F.struct(F.col("section").alias("section"), n.alias("number")))
    g = by.groupBy(key).agg(
        F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("extracted"), F.sum(F.coalesce("answered", F.lit(0))).cast("long").alias("answered"), F.sum("expected").cast("long").alias("expected"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("section", "n")))).alias("s"), F.array_sort(F.flatten(F.collect_list(gaps))).alias("m"))
    return g.select(
        key, "expected", "extracted", "answered", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["section"], x["n"].cast("string"))), ",").alias("section_counts"),
        F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["section"], x["number"].cast("string"))), ",").alias("missing"))


def exam_summary(questions: DataFrame, key: str = "exam_id") -> DataFrame:
    """One card for each exam: questions, answered ones, and a count for each section."""
    return questions.groupBy(key).agg(F.count("*").alias("questions"), F.count("answer").alias("answered"), *[F.count_if(F.col("section") == k).alias(k) for k, *_ in SECTIONS])
