"""The bank build as one plan: transcripts to bank, coverage, exclusions and review queue.

Transcripts are parsed and classified once; that stage is written, its counters are observed on
the way, and every output reads it. Effects keep their order: rows that break the contract are
excluded first, coverage counts active questions before duplicates are marked, and a duplicate is
deactivated last, whether or not the first of its kind is active.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.functions import stage
from itembank.functions import text as T
from itembank.operators import classify as C
from itembank.operators import exam as E
from itembank.sources import files

#: Reasons of exclusions and statuses, methods of classification, and a transcript's file name.
OUTSIDE = "Pregunta fuera de cualquier sección reconocida"
BROKEN = ["Tiene {} opciones en lugar de 4", "Tiene alguna opción vacía", "Enunciado vacío", "Respuesta inválida: "]
REASONS = {
    "missing_official_answer": "Sin plantilla oficial disponible", "classification_review": "Tema asignado con indicios insuficientes para el banco vigente",
    "valid": "Respuesta oficial enlazada y clasificación compatible con el programa vigente", "duplicate": "Duplicada literalmente; se conserva la primera aparición",
}
DECIDED, OVERRIDDEN, BY_RULES, FALLEN_BACK = "revision_manual_2026_09_26", "curacion_manual_verificada", "taxonomia_reglas_2025", "fallback_sin_indicio"
METHODS = {"decided": DECIDED, "overridden": OVERRIDDEN, "rules": BY_RULES, "fallback": FALLEN_BACK}
#: Columns of a bank's questions that are added on the way out, and what they follow from.
DERIVED = {"reason": ["status", "old", "decision"], "method": ["method"], "exercise": ["section"], "is_reserve": ["section"], "block": ["topic"]}
#: Characters of an excluded row's prompt that are shown.
PREVIEW = 100
TRANSCRIPT = "03 Preguntas y respuestas en texto.txt"


@dataclass(frozen=True)
class Build:
    """``questions`` of the bank, ``coverage`` by exam, ``excluded`` rows, and what was counted on the way:
    ``parsed``, ``outside``, ``broken``, ``active_before_duplicates``. What wasn't asked for is None."""

    questions: DataFrame | None
    coverage: DataFrame
    excluded: DataFrame | None
    counters: dict

    def review(self) -> DataFrame:
        """The review queue: every question that isn't active, with its status and reason."""
        return self.questions.where("not active")


def transcripts(spark: SparkSession, directory: str, exams: DataFrame, name: str = TRANSCRIPT) -> DataFrame:
    """``exam_id``, ``text`` of the exams (exam_id, folder) whose transcript, a file of that ``name`` or
    pattern, lies in their folder below ``directory``. Exams without one are left out, and so is any
    file that no exam names."""
    parts = F.split("path", "/")
    texts = files.read_texts(spark, f"{directory}/*/{name}").select(F.url_decode(F.element_at(parts, -2)).alias("folder"), "text")
    return texts.join(exams.select("exam_id", "folder"), "folder").select("exam_id", "text")


def contract_issues() -> Column:
    """What keeps a question of a known section out of the bank; empty if nothing does."""
    size, answer = F.size("options"), F.col("answer")
    blank = lambda x: ~x.rlike(r"[^\s\p{Z}]")  # noqa: E731 - the first other character tells
    found = F.array_compact(F.array(
        F.when(size != 4, F.format_string(BROKEN[0].replace("{}", "%d"), size)), F.when(F.exists("options", blank), BROKEN[1]),
        F.when(blank(F.col("prompt")), BROKEN[2]), F.when(answer.isNotNull() & ~answer.isin("a", "b", "c", "d"), F.concat(F.lit(BROKEN[3]), answer))))
    return F.array_join(found, "; ")


def _of_section(specs, i: int) -> Column:
    """A section's attribute, by its name; a plan's sections are few."""
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.coalesce(*[F.when(F.col("section") == s[0], lit(s[i])) for s in specs])


def item_id() -> Column:
    """A question's id, from its exam, section and number."""
    return F.concat_ws(":", F.col("exam_id").cast("string"), "section", "number")


def _same(signature: Column) -> Column:
    """A signature itself where it is short, else its digest; a hyphen, which no signature has, tells these apart."""
    return T.once(signature, lambda s: F.when(F.octet_length(s) <= 24, s).otherwise(F.concat(F.lit("-"), F.base64(F.unhex(F.md5(s))))))


def build(texts: DataFrame, exams: DataFrame | None, lexicon: list[tuple[str, list[str]]], outdated: list[tuple[str, str]], decisions: DataFrame | None = None, overrides: DataFrame | None = None, specs=E.SECTIONS, only: list[str] | None = None) -> Build:
    """Build a bank from ``texts`` (exam_id, text) of ``exams`` (exam_id, ord, year, answer_status); where
    ``exams`` is None, texts have these columns already.

    ``decisions`` (item_id, topic, reason) come before ``overrides`` (item_id, topic) and those before
    the rules, which choose among the topics of the section's blocks. Questions repeat as often as
    transcripts do; equal item ids stay apart by their place. Coverage has a row for every exam with
    a transcript; its ``excluded`` counts the exam's excluded rows. Of the columns of ``questions`` some
    can be asked for (``only``; none: no questions), so that texts nobody reads needn't be moved and
    stored. Excluded rows are made where ``prompt`` or, stored for them alone, ``preview`` is asked for; with
    nothing but ``preview`` there are no questions. ``n_options`` is the number of options without their texts.
    """
    # exams are joined to whole transcripts, and what follows from the texts is made where they are parsed;
    # questions, of which there are many more, move only where equal ones are looked for
    asked = lambda c: only is None or c in only
    told = only is None or bool({*only} - {"preview"})
    cols = ["exam_id", "ord", "position", "year", "answer_status", "section", "number", "prompt", "preview", "options", "n_options", "answer", "topic", "units", "method", "status", "old", "decision", "active", "issues", "sig"]
    if only is None:
        cols = [c for c in cols if c not in ("preview", "n_options")]
    else:
        wanted = {"exam_id", "ord", "position", "section", "active", "issues", *only, *(["number"] if "preview" in only else []), *(["number", "status", "sig"] if told else []), *[c for k, cs in DERIVED.items() if k in only for c in cs]}
        cols = [c for c in cols if c in wanted and not (c == "preview" and "prompt" in only)]
    of_exam = [c for c in ("ord", "year", "answer_status") if c in cols]
    whole = texts.where("exam_id is not null") if exams is None else texts.select("exam_id", "text").join(exams.select("exam_id", *of_exam), "exam_id")
    also = {"old": lambda _, whole: C.outdated_reason(whole, outdated), "sig": lambda prompt, _: _same(T.signature_of(prompt, "txt"))}
    ranked = C.classified(E.parse_txt(whole, also=of_exam), lexicon, _of_section(specs, 5), {k: f for k, f in also.items() if k == "old" or k in cols})
    ranked = ranked.withColumn("issues", F.when(F.col("section").isNull(), OUTSIDE).otherwise(contract_issues()))
    ranked = ranked.withColumns({"n_options": F.size("options"), "preview": F.when(F.col("issues") != "", F.substring("prompt", 1, PREVIEW))})
    # both kinds of decisions in one join; a decision comes before an override
    kinds = [t.select("item_id", F.lit(i).alias("kind"), "topic", F.col("reason") if i == 0 else F.lit(None).cast("string").alias("reason")) for i, t in enumerate((decisions, overrides)) if t is not None]
    chosen, parsed = F.lit(None).cast("struct<kind:int,topic:string,reason:string>"), None
    if kinds:
        # few questions have one, so the others needn't move
        first = reduce(DataFrame.unionByName, kinds).groupBy("item_id").agg(F.min(F.struct("kind", "topic", "reason")).alias("chosen"))
        needed = {*cols, "number", "answer", "units", "old", "topic"}
        parsed, _ = stage.written(ranked.select(*[c for c in ranked.columns if c in needed]), "bank-parsed")
        ranked, chosen = stage.looked_up(parsed.withColumn("item_id", item_id()), first, "item_id", first.count()), F.col("chosen")
    ranked = ranked.withColumns({
        "topic": F.coalesce(chosen["topic"], "topic"), "units": F.when(chosen.isNotNull(), 20000).otherwise(F.col("units")), "decision": chosen["reason"],
    } | ({"method": F.when(chosen["kind"] == 0, "decided").when(chosen["kind"] == 1, "overridden").otherwise(F.col("method"))} if "method" in cols else {}))
    status = C.status("txt", F.col("answer"), F.lit(None), F.col("old"), F.col("units"))
    ranked = ranked.withColumn("status", status).withColumn("active", (F.col("status") == "valid") & (F.col("issues") == ""))
    # what follows from these columns is added on the way out, so that it isn't stored and moved
    staged, counters = stage.written(
        ranked.select(*cols), "bank-stage", parsed=F.count("*"), outside=F.count_if(F.col("section").isNull()), broken=F.count_if(F.col("section").isNotNull() & (F.col("issues") != "")), active_before_duplicates=F.count_if("active"))
    if parsed is not None:
        stage.dropped(parsed)
    covered, kept_out = coverage(staged, texts, exams, specs), excluded(staged) if {"prompt", "preview"} & {*cols} else None
    if not told:
        return Build(None, covered, kept_out, counters)
    good = deduplicated(staged.where("issues = ''").drop("issues", "preview"), counters["parsed"])
    derived = {
        "reason": lambda: F.coalesce(*[F.when(F.col("status") == s, F.coalesce("decision", F.lit(r)) if s == "valid" else F.lit(r)) for s, r in REASONS.items()], "old"),
        "method": lambda: F.coalesce(*[F.when(F.col("method") == m, text) for m, text in METHODS.items()]),
        "exercise": lambda: _of_section(specs, 2), "is_reserve": lambda: _of_section(specs, 3), "block": lambda: T.block_of(F.col("topic")),
    }
    questions = good.withColumns({k: f() for k, f in derived.items() if asked(k)}).drop("old")
    return Build(questions, covered, kept_out, counters)


#: A signature with a larger share of the questions is looked up by broadcast; fewer than 1 / share have it.
HOT_SHARE = 0.0001


def deduplicated(questions: DataFrame, total: int) -> DataFrame:
    """``questions``, a written table of at most ``total`` rows, with ``item_id`` and ``duplicate_of``, all but the first (by
    exam and place) of a signature deactivated.

    Only ids, places and signatures are grouped. Of what repeats, the most frequent signatures are broadcast; questions
    move only where their signature is neither among those nor, surely, unique.
    """
    place = F.struct("ord", "position", item_id().alias("item_id"))
    first, counted = stage.written(questions.groupBy("sig").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1"), "bank-firsts", n=F.count("*"))
    often = F.broadcast(first.where(F.col("n") > HOT_SHARE * total).select("sig", F.col("f").alias("_f")))
    told = questions.join(often, "sig", "left")
    seldom = first.where(F.col("n") <= HOT_SHARE * total).select("sig", "f")
    rest = stage.looked_up(questions.join(often, "sig", "left_anti"), seldom, "sig", counted["n"])
    q = told.where("_f is not null").withColumnRenamed("_f", "f").unionByName(rest).withColumn("item_id", item_id())
    q = q.withColumn("duplicate_of", F.when(F.col("f") < F.struct("ord", "position", "item_id"), F.col("f.item_id"))).drop("f", "sig")
    gone = F.col("active") & F.col("duplicate_of").isNotNull()
    return q.withColumns({"status": F.when(gone, "duplicate").otherwise(F.col("status")), "active": F.col("active") & F.col("duplicate_of").isNull()})


def coverage(staged: DataFrame, texts: DataFrame, exams: DataFrame | None, specs=E.SECTIONS) -> DataFrame:
    """By exam: expected, extracted, active (before duplicates), section_counts (JSON, sections in order
    of their first question), excluded."""
    good = F.col("issues") == ""
    by = staged.where("section is not null").groupBy("exam_id", "section").agg(F.count_if(good).alias("n"), F.min(F.when(good, F.col("position"))).alias("at"))
    counts = by.where("n > 0").groupBy("exam_id").agg(F.sort_array(F.collect_list(F.struct("at", "section", "n"))).alias("s"))
    told = F.concat(F.lit("{"), F.array_join(F.transform("s", lambda x: F.format_string('"%s": %d', x["section"], x["n"])), ", "), F.lit("}"))
    whole = staged.groupBy("exam_id").agg(F.count_if(good).alias("extracted"), F.count_if("active").alias("active"), F.count_if(~good).alias("excluded"))
    have = texts.select("exam_id").where("exam_id is not null").distinct()
    have = have if exams is None else have.join(exams.select("exam_id"), "exam_id", "left_semi")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return have.join(whole, "exam_id", "left").join(counts.select("exam_id", told.alias("c")), "exam_id", "left").select(
        "exam_id", F.lit(sum(s[4] for s in specs)).cast("long").alias("expected"), zero("extracted"), zero("active"), F.coalesce("c", F.lit("{}")).alias("section_counts"), zero("excluded"))


def excluded(staged: DataFrame) -> DataFrame:
    """``exam_id``, ``ord``, ``position``, ``section``, ``number``, ``preview`` (100 characters), ``reason`` of rows kept out."""
    preview = F.col("preview") if "preview" in staged.columns else F.substring("prompt", 1, PREVIEW)
    return staged.where("issues <> ''").select("exam_id", "ord", "position", "section", "number", preview.alias("preview"), F.col("issues").alias("reason"))
