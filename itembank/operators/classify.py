"""Classification of items against a topic lexicon, and decisions on their status.

Scores and confidences are integers (twentieths, and units of 0.00005), so that they are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.functions import text as T

#: Confidence needed for an item to be active, in units of 0.00005: profiles pdf (0.68) and txt (0.675, which rounds to it).
THRESHOLD = {"pdf": 13600, "txt": 13500}
FALLBACK = 6000


def topic_scores(lexicon: list[tuple[str, list[str]]], prompt: Column, whole: Column) -> Column:
    """An array of topic, topic_ord and score, from folded texts.

    A term in the prompt scores 60 + min(40, its length), elsewhere in the item 20. The lexicon is
    a list in the plan (its size is a parameter's), so an item is scored without any join.
    """
    scores = enumerate(_scores(lexicon, prompt, whole))
    return F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(i).alias("topic_ord"), s.alias("score")) for i, (t, s) in scores])


def _scores(lexicon: list[tuple[str, list[str]]], prompt: Column, whole: Column) -> list[tuple[str, Column]]:
    """Each topic with its score."""
    out = []
    for topic, terms in lexicon:
        s = F.lit(0)
        for t in map(T_fold_py, terms):
            s = s + F.when(prompt.contains(t), 60 + min(40, len(t))).when(whole.contains(t), 20).otherwise(0)
        out.append((topic, s.cast("int")))
    return out


def _folded(items: DataFrame) -> DataFrame:
    p = F.coalesce("prompt", F.lit(""))
    return items.withColumn("_p", T.fold(p)).withColumn("_a", T.fold(F.concat_ws(" ", p, F.array_join("options", " "))))


def score_topics(items: DataFrame, lexicon: list[tuple[str, list[str]]]) -> DataFrame:
    """``item_id``, ``topic``, ``topic_ord``, ``score`` for every item and topic."""
    df = _folded(items)
    return df.select("item_id", F.explode(topic_scores(lexicon, F.col("_p"), F.col("_a"))).alias("x")).select("item_id", "x.topic", "x.topic_ord", "x.score")


def T_fold_py(t: str) -> str:
    """The folding of :func:`itembank.functions.text.fold` for a lexicon's terms."""
    return t.lower().replace("ß", "ss").translate(str.maketrans(T.ACCENTED, T.PLAIN))


def ranked(items: DataFrame, lexicon: list[tuple[str, list[str]]], blocks: Column | None = None, also: dict | None = None) -> DataFrame:
    """``items`` with their best ``topic``, its ``score`` and ``margin`` to the second, within the row;
    ties go to the lexicon's order. The margin is null where there is one topic only. Of ``blocks``
    (an array of names), only their topics count; where the lexicon has none of these, all do. ``also`` names further columns, each a function of
    the folded prompt and the folded whole, which are made once for all."""
    p = F.coalesce("prompt", F.lit(""))
    own = lambda t: F.coalesce(F.array_contains(blocks, t.split(".")[0]), F.lit(False))
    names = {t.split(".")[0]: own(t) for t, _ in lexicon} if blocks is not None else {}

    def best(two: Column) -> Column:
        first, second = F.get(two, F.lit(0)), F.get(two, F.lit(1))
        margin = F.when(second["out"] == first["out"], second["neg"] - first["neg"])
        return F.struct(first["topic"].alias("topic"), (-first["neg"]).alias("score"), margin.alias("margin"))

    def places(x: Column) -> Column:  # own topics come first
        every = [F.struct(F.when(names[t.split(".")[0]], 0).otherwise(1).alias("out") if names else F.lit(1).alias("out"), (-s).alias("neg"), F.lit(i).alias("topic_ord"), F.lit(t).alias("topic")) for i, (t, s) in enumerate(_scores(lexicon, x["p"], x["a"]))]
        return T.once(F.sort_array(F.array(*every)), best)

    texts = F.struct(T.fold(p).alias("p"), T.fold(F.concat_ws(" ", p, F.array_join("options", " "))).alias("a"))
    also = also or {}
    told = lambda x: F.struct(places(x).alias("best"), *[f(x["p"], x["a"]).alias(k) for k, f in also.items()])
    df = items.withColumn("_r", T.once(texts, told))
    return df.withColumns({k: F.col(f"_r.best.{k}") for k in ("topic", "score", "margin")} | {k: F.col(f"_r.{k}") for k in also}).drop("_r")


def confidence_units(score: Column, margin: Column) -> Column:
    """0.56 + 0.035 score + 0.025 margin, at most 0.98, in units; without any hit 0.30.
    A single topic's margin (null) is its score."""
    found = lambda x: F.when(x["s"] > 0, F.least(F.lit(19600), 11200 + 35 * x["s"] + 25 * F.coalesce(x["m"], x["s"]))).otherwise(FALLBACK).cast("int")
    return T.once(F.struct(score.alias("s"), margin.alias("m")), found)


def classified(items: DataFrame, lexicon, blocks: Column | None = None, also: dict | None = None) -> DataFrame:
    """``items`` with ``topic``, ``units`` and ``method`` by the rules, within the row, and the columns of ``also``."""
    r = ranked(items, lexicon, blocks, also)
    units, method = confidence_units(F.col("score"), F.col("margin")), F.when(F.col("score") > 0, "rules").otherwise("fallback")
    return r.withColumns({"units": units, "method": method}).drop("score", "margin")


def classify(items: DataFrame, lexicon, decisions: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """``item_id``, ``topic``, ``units``, ``method``: a decision, else an override, else the rules."""
    r = classified(items, lexicon).select("item_id", "topic", "units", "method")
    for name, table in (("override", overrides), ("decision", decisions)):
        if table is not None:
            t = table.select(F.col("item_id"), F.col("topic").alias("_t"))
            r = r.join(t, "item_id", "left").select("item_id", F.coalesce("_t", "topic").alias("topic"), F.when(F.col("_t").isNotNull(), 20000).otherwise(F.col("units")).alias("units"), F.when(F.col("_t").isNotNull(), name).otherwise(F.col("method")).alias("method"))
    return r


def outdated_reason(folded: Column, terms: list[tuple[str, str]]) -> Column:
    """The reason of the first term, in the list's order, that the text contains."""
    return T.once(folded, lambda x: F.coalesce(*[F.when(x.contains(T_fold_py(t)), F.lit(r)) for t, r in terms])) if terms else F.lit(None).cast("string")


def issues(prompt: Column, options: Column, answer: Column, section: Column) -> Column:
    """What is wrong with a row, joined by semicolons; empty if nothing is."""
    return F.array_join(
        F.array_compact(F.array(
            F.when(F.size(F.coalesce(options, F.array().cast("array<string>"))) != 4, "options"), F.when(F.exists(options, lambda o: F.trim(F.coalesce(o, F.lit(""))) == ""), "empty option"),
            F.when(F.trim(F.coalesce(prompt, F.lit(""))) == "", "empty prompt"), F.when(answer.isNotNull() & ~answer.isin("a", "b", "c", "d"), "answer"), F.when(section.isNull(), "section"),
        )), "; ")


def quality_reason(prompt: Column, options: Column) -> Column:
    """The first of: page leakage, nested option marker, noise, too long; null if the text is fine."""
    return F.coalesce(
        F.when(prompt.rlike(r"(?i)\bpage \d+ of \d+"), "page_leak"), F.when(F.exists(options, lambda o: o.rlike(r"(?i)(?:^|\s)[a-d]\)\s")), "nested_option"),
        F.when(prompt.rlike(r"[*#%]{3,}"), "noise"), F.when((F.length(prompt) > 2400) | F.exists(options, lambda o: F.length(o) > 1200), "too_long"),
    )


def status(profile: str, answer: Column, quality: Column, outdated: Column, units: Column, graphic: Column | None = None) -> Column:
    """Decision list: missing, (pdf: annulled, graphic, quality), outdated, low confidence, valid."""
    s = F.when(answer.isNull(), "missing_official_answer")
    if profile == "pdf":
        s = s.when(answer == "anulada", "annulled")
        if graphic is not None:
            s = s.when(graphic, "graphic")
        s = s.when(quality.isNotNull(), "ocr_review")
    return s.when(outdated.isNotNull(), "outdated").when(units < THRESHOLD[profile], "classification_review").otherwise("valid")


def document_role(path: Column) -> Column:
    """Role by name; the first that fits."""
    p = F.lower(path)
    return F.when(p.contains("convocatoria"), "call").when(p.contains("plantilla") | p.contains("respuestas"), "key").when(p.contains("cuestionario"), "questionnaire").otherwise("compendium")


def needs_ocr(pages: Column, chars: Column, year: Column) -> Column:
    return (pages > 2) & ((chars < 5000) | year.between(2005, 2018))

