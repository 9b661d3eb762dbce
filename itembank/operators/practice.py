"""Practising: filters and pools, tests, answers to outcomes, attempts, reviews and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itembank.functions import stage
from itembank.functions import text as T

#: Most outcomes of an attempt, longest question id, rows of an explorer page, most
#: rows that a read returns, and seconds left from which a countdown is urgent.
MOST_OUTCOMES, LONGEST_ID, PAGE_ROWS, MOST_ROWS, URGENT = 150, 180, 200, 1000, 600
PENDING = ["missing_official_answer", "classification_review", "ocr_review"]


def filters(text: str = "", blocks=(), topics=(), years=(), access=(), origins=(), status: str = "all") -> Column:
    """The conjunction of an explorer's filters; an empty one puts no constraint.

    The text is searched, folded, in the prompt directly followed by the options, so a match may
    reach from one into the other. Rows without an origin are official.
    """
    c = F.lit(True)
    if text:
        from_text = T.fold_search(F.concat(F.coalesce("prompt", F.lit("")), F.array_join("options", " ")))
        c = c & from_text.contains(T_fold_search(text))
    for name, wanted in (("block", blocks), ("topic", topics), ("year", years), ("access", access)):
        if wanted:
            c = c & F.col(name).isin(*wanted)
    if origins:
        c = c & F.coalesce("origin", F.lit("official")).isin(*origins)
    answered = F.col("answer").isNotNull() & (F.col("answer") != "anulada")
    return c & {"all": F.lit(True), "active": F.col("active"), "historical": answered, "pending": F.col("status").isin(*PENDING)}[status]


def T_fold_search(x: str) -> str:
    return x.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))


def explorer_page(items: DataFrame, rows: int = PAGE_ROWS, **wanted) -> DataFrame:
    """The first rows, in order of input (``seq``), of what the filters leave."""
    return items.where(filters(**wanted)).orderBy("seq").limit(rows)


def pool(items: DataFrame, progress: DataFrame, kind: str = "all", blocks=(), topics=(), reserves: bool = False, origins=()) -> DataFrame:
    """Items that a custom test may take: blocks, topics, origin, no reserves unless asked for, and
    all, unseen, failed or favorite ones by ``progress`` (item_id, seen, wrong, favorite)."""
    keep = {"all": F.lit(True), "unseen": F.coalesce("seen", F.lit(0)) == 0, "failed": F.coalesce("wrong", F.lit(0)) > 0, "favorite": F.coalesce("favorite", F.lit(False))}[kind]
    c = filters(blocks=blocks, topics=topics, origins=origins)
    c = c if reserves else c & ~F.coalesce("reserve", F.lit(False))
    return items.where(c).join(progress.select("item_id", "seen", "wrong", "favorite"), "item_id", "left").where(keep).select(*items.columns)


def custom_test(eligible: DataFrame, seed: str, n: int) -> DataFrame:
    """``item_id``, ``rank``: the first ``n`` of a reproducible shuffle."""
    top = eligible.select("item_id").orderBy(*T.seeded_order(seed, "item_id")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*T.seeded_order(seed, "item_id"))).cast("long"))


def toggled_block(selected: Column, topics: Column) -> Column:
    """A block's topics are taken out if all are selected, and else all put in; sorted."""
    whole = F.size(F.array_except(topics, selected)) == 0
    return F.sort_array(F.when(whole, F.array_except(selected, topics)).otherwise(F.array_union(selected, topics)))


def section_test(items: DataFrame, sections: list[str]) -> DataFrame:
    """``exam``, ``item_ids``: by exam the ids of some sections by original number, then input order."""
    some = items.where(F.col("section").isin(*sections))
    return some.groupBy("exam").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "seq", "item_id"))), lambda x: x["item_id"]).alias("item_ids"))


def outcome(answer: Column, key: Column) -> Column:
    """blank without an answer, else correct or wrong; against a null or annulled key it is wrong."""
    return F.when(answer.isNull() | (answer == ""), "blank").when(answer == key, "correct").otherwise("wrong")


def outcomes(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """``attempt_id``, ``pos``, ``item_id``, ``topic``, ``outcome``, ``answer``, ``correct_answer``.

    ``attempts`` has ``attempt_id``, ``item_ids`` (array) and ``answers`` (map from id to letter);
    ids that no item has are left out, positions stay.
    """
    one = attempts.select("attempt_id", "answers", F.posexplode("item_ids").alias("pos", "item_id"))
    one = one.withColumn("answer", F.try_element_at("answers", "item_id")).drop("answers")
    return one.join(items.select("item_id", "topic", F.col("answer").alias("correct_answer")), "item_id").select("attempt_id", "pos", "item_id", "topic", outcome(F.col("answer"), F.col("correct_answer")).alias("outcome"), "answer", "correct_answer")


def results(rows: DataFrame, by: list[str]) -> DataFrame:
    """correct, wrong, blank, thirds (3 correct - wrong) and maximum of outcomes by ``by``."""
    n = lambda v: F.count_if(F.col("outcome") == v)
    g = rows.groupBy(*by).agg(n("correct").alias("correct"), n("wrong").alias("wrong"), n("blank").alias("blank"), F.count("*").alias("maximum"))
    return g.withColumn("thirds", 3 * F.col("correct") - F.col("wrong"))


def attempt_record(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """Each attempt with its result as JSON: counts, thirds, and the counts by topic in order."""
    rows = outcomes(attempts, items)
    topics = results(rows, ["attempt_id", "topic"]).groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("topic", "correct", "wrong", "blank"))).alias("by_topic"))
    whole = results(rows, ["attempt_id"]).join(topics, "attempt_id")
    return whole.select("attempt_id", F.to_json(F.struct("correct", "wrong", "blank", "thirds", "maximum", "by_topic")).alias("result"))


def review(rows: DataFrame, which: str = "all") -> DataFrame:
    """Outcomes to look through: all, wrong or blank; ``place`` numbers what is left, from 1."""
    left = rows if which == "all" else rows.where(F.col("outcome") == which)
    return left.withColumn("place", F.row_number().over(Window.partitionBy("attempt_id").orderBy("pos")).cast("long"))


def checked_attempts(attempts: DataFrame) -> DataFrame:
    """``attempts`` (``outcomes``: array of item_id, outcome) with ``issue``: null, or why a write is
    refused as a whole: too many outcomes, or an id that is null or too long."""
    bad = F.exists("outcomes", lambda o: o["item_id"].isNull() | (F.length(o["item_id"]) > LONGEST_ID))
    return attempts.withColumn("issue", F.when(F.col("outcomes").isNull(), "no outcomes").when(F.size("outcomes") > MOST_OUTCOMES, "too many outcomes").when(bad, "question id"))


def recorded(attempts: DataFrame) -> DataFrame:
    """Progress by user and item: an attempt counts once by ``(user_id, attempt_id)``, the first to
    finish, and only if :func:`checked_attempts` finds nothing; blanks are seen too."""
    ok = checked_attempts(attempts).where("issue is null")
    once = ok.groupBy("user_id", "attempt_id").agg(F.min(F.struct("finished", "outcomes")).alias("a"))
    rows = once.select("user_id", "a.finished", F.explode("a.outcomes").alias("o"))
    n = lambda v: F.count_if(F.col("o.outcome") == v)
    return rows.groupBy("user_id", F.col("o.item_id").alias("item_id")).agg(F.count("*").alias("seen"), n("correct").alias("correct"), n("wrong").alias("wrong"), F.max("finished").alias("last_seen"))


def current(progress: DataFrame, items: DataFrame) -> DataFrame:
    """Progress on items that are still active."""
    return progress.join(items.where("active").select("item_id"), "item_id", "left_semi")


def mistakes(progress: DataFrame, items: DataFrame) -> DataFrame:
    """Failed items that are still active, most failures first, then by id; ``rank`` by user."""
    failed = current(progress.where("wrong > 0"), items)
    return failed.select("user_id", "item_id", "wrong", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("wrong"), "item_id")).cast("long").alias("rank"))


def cards(progress: DataFrame, items: DataFrame) -> DataFrame:
    """By user: failed, favorites, seen, and unseen of the active items."""
    active, counted = stage.written(items.where("active").select("item_id", "active"), "active-items", n=F.count("*"))  # both uses read it
    total = F.lit(counted["n"]).cast("long")
    g = current(progress, active).groupBy("user_id").agg(F.count_if(F.col("wrong") > 0).alias("failed"), F.count_if("favorite").alias("favorites"), F.count_if(F.col("seen") > 0).alias("seen"))
    return g.select("user_id", "failed", "favorites", "seen", (total - F.col("seen")).alias("unseen"))


def newest(rows: DataFrame, order: str, tie: str, most: int = MOST_ROWS) -> DataFrame:
    """The newest rows first, of equals by ``tie``, as many as a read returns."""
    return rows.orderBy(F.desc(order), tie).limit(most)


def countdown(minutes: Column, elapsed: Column) -> Column:
    """Seconds left, not below zero, and whether that is urgent."""
    left = F.greatest(minutes * 60 - elapsed, F.lit(0)).cast("long")
    return F.struct(left.alias("left"), (left < URGENT).alias("urgent"))


def solutions(items: DataFrame, answers: DataFrame) -> DataFrame:
    """A test's solution sheet: ``test_id``, position, right answer, own answer, topic, provenance.

    ``items`` has ``test_id`` and ``position``; ``answers`` test_id, item_id, answer.
    """
    mine = answers.select("test_id", "item_id", F.col("answer").alias("own"))
    official = F.concat_ws(" · ", F.col("year").cast("string"), "sitting", F.concat_ws(" ", "section", F.col("number").cast("string")), F.concat(F.lit("p. "), F.col("page").cast("string")))
    added = F.concat(F.lit("source: "), F.col("source"), F.lit(" · "), F.col("number").cast("string"))
    show = lambda c: F.coalesce(F.upper(c), F.lit("—"))
    return items.join(mine, ["test_id", "item_id"], "left").select("test_id", "position", show(F.col("answer")).alias("answer"), show(F.col("own")).alias("own"), "topic", F.when(F.col("origin") == "uploaded", added).otherwise(official).alias("provenance"))


def reserve(stored: Column, mode: Column, index: Column) -> Column:
    """Stored, or by place in a simulation: the five after the first eighty, and from 105 on."""
    return F.coalesce(stored, F.lit(False)) | ((mode == "simulation") & (index.between(80, 84) | (index >= 105)))


#: Questions of a simulation's parts.
FIRST, FIRST_RESERVE, CASE, CASE_RESERVE = 80, 5, 20, 5


def exam_simulation(items: DataFrame, seed: str, practical: str) -> DataFrame:
    """``item_id``, ``part`` (0 to 3), ``filler``, ``position`` of a simulated exam with the practical block ``practical``.

    Eighty of the first part, no uploads; five of its reserve; twenty of the block's case questions that
    are no reserves; five case reserves of the block, filled up with other case questions of the block.
    No item comes twice, and a part that is short stays short. ``items``: item_id, section, exercise,
    block, reserve, origin. One scan ranks items by what they could serve as, which bounds them; the
    parts are chosen among these few.
    """
    case = (F.col("exercise") == "supuesto_practico") & (F.col("block") == practical)
    reserve = F.coalesce("reserve", F.lit(False))
    may = {"a": (F.col("section") == "first") & (F.coalesce("origin", F.lit("official")) != "uploaded"), "b": F.col("section") == "first_reserve", "c": case & ~reserve, "d": case}
    order = T.seeded_order(seed, "item_id")
    few = items.select("item_id", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in may.items()], (case & reserve).alias("own")).where("a or b or c or d")
    # of items alike in all this no more than a whole exam's can be chosen, and the first come first
    rank = F.row_number().over(Window.partitionBy("a", "b", "c", "d", "own").orderBy(*order))
    few = few.withColumn("k", rank).where(F.col("k") <= FIRST + FIRST_RESERVE + CASE + CASE_RESERVE).drop("k").withColumn("part", F.lit(None).cast("int"))
    for part, (k, n) in enumerate(zip("abcd", (FIRST, FIRST_RESERVE, CASE, CASE_RESERVE), strict=True)):
        free = F.col("part").isNull() & F.col(k)
        first = [~free] + ([~F.coalesce("own", F.lit(False))] if k == "d" else [])
        place = F.row_number().over(Window.orderBy(*first, *order))
        few = few.withColumn("place", place).withColumn("part", F.when(free & (F.col("place") <= n), part).otherwise(F.col("part"))).drop("place")
    filler = (F.col("part") == 3) & ~F.coalesce("own", F.lit(False))
    chosen = few.where("part is not null").select("item_id", "part", filler.alias("filler"))
    return chosen.withColumn("position", F.row_number().over(Window.orderBy("part", "filler", *order)).cast("long"))


def own_rows(spark: SparkSession, path: str, user: int) -> DataFrame:
    """A stored table's rows of one user, which is all that there is a way to read: the filter is part of
    the scan, whatever is done with the result. Raises without a user."""
    if user is None or isinstance(user, bool) or not isinstance(user, int):
        raise PermissionError("sign in to read progress")
    return spark.read.parquet(path).where(F.col("user_id") == F.lit(user))
