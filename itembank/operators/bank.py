"""Joins, duplicates, coverage, scores, progress, samples and imports of a question bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.functions import text as T


def candidate_dedup(rows: DataFrame, least: int = 4) -> DataFrame:
    """First row, by ``seq``, of each page, number and 160-character signature of at least ``least``."""
    sig = rows.withColumn("sig", T.signature(F.col("prompt"), "txt")).where(F.length("sig") >= least)
    cols = [c for c in sig.columns if c not in ("page", "number", "sig")]
    return sig.groupBy("page", "number", "sig").agg(F.min_by(F.struct(*cols), "seq").alias("r")).select("page", "number", "sig", *[F.col(f"r.{c}").alias(c) for c in cols])


def mark_duplicates(items: DataFrame, profile: str) -> DataFrame:
    """``items`` with ``duplicate_of``: the first item, by ``seq``, of the same signature.

    The first one is found by an aggregate with map-side combine over a digest of the signature, and
    joined back, so a signature that very many items share is split by adaptive execution and no
    text is shuffled for the sake of its key. Items of one ``seq`` and signature are all first.
    """
    sig = items.withColumn("sig", F.md5(T.signature(F.concat_ws(" ", F.col("prompt"), F.array_join("options", " ")), profile)))
    first = sig.groupBy("sig").agg(F.min(F.struct("seq", "item_id")).alias("f"), F.count("*").alias("n")).where("n > 1").select("sig", "f")
    return sig.join(first, "sig", "left").withColumn("duplicate_of", F.when(F.col("f.seq") < F.col("seq"), F.col("f.item_id"))).drop("f", "sig")


def expected_grid(specs: DataFrame) -> DataFrame:
    """``exam``, ``section``, ``number`` from 1 to each section's count."""
    return specs.select("exam", "section", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))


def missing(grid: DataFrame, have: DataFrame) -> DataFrame:
    return grid.join(have.select("exam", "section", "number"), ["exam", "section", "number"], "left_anti")


def priority_union(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Of each key the row of the first source that has it; ``source_no`` tells which."""
    every = None
    for i, s in enumerate(sources):
        one = s.withColumn("source_no", F.lit(i))
        every = one if every is None else every.unionByName(one)
    cols = [c for c in every.columns if c not in key]
    order = F.struct("source_no", *[c for c in cols if c != "source_no"])
    return every.groupBy(*key).agg(F.min(order).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in cols])


def merge_supplement(items: DataFrame, extra: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Matched rows are updated from ``extra`` where it has a value, others inserted or kept."""
    e = extra.select(key, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_new"))
    i = items.select(key, *cols, F.lit(True).alias("_old"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").otherwise("update")
    return i.join(e, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in cols], action.alias("action"))


def supplement_issues(items: DataFrame, extra: DataFrame, key: str, answer: str) -> DataFrame:
    """``key``, ``issue`` of the rows of ``extra`` that may not be merged: ``unknown``, if no item has the
    key that they name, or ``contradicts``, if an item has another answer already.

    Rows without a key are inserts and always may; an item without an answer contradicts nothing, a
    row without one contradicts every item that has one.
    """
    have = items.select(key, F.col(answer).alias("_answer"), F.lit(True).alias("_there"))
    issue = F.when(F.col("_there").isNull(), "unknown").when(F.col("_answer").isNotNull() & ~F.col("_answer").eqNullSafe(F.col(answer)), "contradicts")
    return extra.where(F.col(key).isNotNull()).select(key, answer).join(have, key, "left").select(key, issue.alias("issue")).where("issue is not null")


def with_answers(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """``questions`` with ``answer`` from a key (exam, section, number, answer), lower case; null where it has none.

    A key that names a place several times gives its smallest answer, so no question is multiplied.
    """
    one = keys.groupBy("exam", "section", "number").agg(F.min(T.normal_answer(F.col("answer"))).alias("answer"))
    return questions.drop("answer").join(one, ["exam", "section", "number"], "left")


def exam_cards(items: DataFrame) -> DataFrame:
    """By exam: all questions, active ones, and years from the first to the last."""
    return items.groupBy("exam").agg(F.count("*").alias("questions"), F.count_if("active").alias("active"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def split_key(stream: DataFrame, sections: DataFrame) -> DataFrame:
    """A flat, ordered key (``pos`` from 1, ``answer``) dealt to sections by their lengths, in order.

    Sections are few (a questionnaire's); their running total makes ranges, and a position joins
    the one range it lies in.
    """
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sections.withColumn("lo", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("hi", F.col("lo") + F.col("n"))
    return stream.join(F.broadcast(ranges), (F.col("pos") > F.col("lo")) & (F.col("pos") <= F.col("hi"))).select(*[c for c in stream.columns if c not in ("pos", "answer")], "section", (F.col("pos") - F.col("lo")).alias("number"), "answer")


def score(rows: DataFrame, by: list[str], outcome: str = "outcome") -> DataFrame:
    """Correct, wrong, blank, total, thirds (3 correct - wrong) and percentage by ``by``.

    A wrong answer costs a third of a right one; without rows the percentage is 0.
    """
    n = lambda v: F.count_if(F.col(outcome) == v)
    g = rows.groupBy(*by).agg(n("correct").alias("correct"), n("wrong").alias("wrong"), n("blank").alias("blank"), F.count("*").alias("total"))
    thirds = 3 * F.col("correct") - F.col("wrong")
    return g.withColumn("thirds", thirds).withColumn("percentage", F.when(F.col("total") == 0, 0.0).otherwise(thirds * 100.0 / (3 * F.col("total"))))


def record_once(attempts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First write of each key wins; a retry changes nothing."""
    cols = [c for c in attempts.columns if c not in key and c not in order]
    return attempts.groupBy(*key).agg(F.min(F.struct(*order, *cols)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in [*order, *cols]])


def fold_progress(events: DataFrame) -> DataFrame:
    """Per user and question: seen (blanks too), correct, wrong, last, and favourite by parity."""
    o = F.col("outcome")
    return events.groupBy("user_id", "question").agg(
        F.count_if(o.isin("correct", "wrong", "blank")).alias("seen"), F.count_if(o == "correct").alias("correct"), F.count_if(o == "wrong").alias("wrong"),
        F.max(F.when(o.isin("correct", "wrong", "blank"), F.col("ts"))).alias("last"), (F.count_if(o == "toggle") % 2 == 1).alias("favorite"))


def sync_lww(client: DataFrame, server: DataFrame, now: Column, key: str = "user_id") -> DataFrame:
    """Last writer wins; the client's clock counts up to five minutes ahead, ties are downloads."""
    c = client.select(key, F.least(F.coalesce("updated", F.lit("1970-01-01").cast("timestamp")), now + F.expr("interval 5 minutes")).alias("cu"), F.col("payload").alias("cp"))
    s = server.select(key, F.col("updated").alias("su"), F.col("payload").alias("sp"))
    action = F.when(F.col("cu").isNull(), "downloaded").when(F.col("su").isNull(), "created").when(F.col("cu") > F.col("su"), "uploaded").otherwise("downloaded")
    up = F.col("action") != "downloaded"
    return c.join(s, key, "full_outer").withColumn("action", action).select(key, "action", F.when(up, F.col("cu")).otherwise(F.col("su")).alias("updated"), F.when(up, F.col("cp")).otherwise(F.col("sp")).alias("payload"))


def upsert_latest(rows: DataFrame, key: list[str], order: str, tie: str) -> DataFrame:
    """The latest version of each key, of equals that with the largest ``tie``."""
    cols = [c for c in rows.columns if c not in (*key, order, tie)]
    return rows.groupBy(*key).agg(F.max(F.struct(order, tie, *cols)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in [order, tie, *cols]])


def import_guard(incoming: DataFrame, existing: DataFrame, key: str = "user_id", most: int = 10_000) -> DataFrame:
    """``incoming`` with ``refused``: null for accounts that are empty so far and import no more than
    ``most`` items, else the reason, by which the whole import of the account fails."""
    there = existing.select(key).distinct().withColumn("_there", F.lit(True))
    size = incoming.groupBy(key).agg(F.count("*").alias("_n"))
    why = F.when(F.col("_n") > most, "too many items").when(F.col("_there"), "the account has progress")
    return incoming.join(size.join(there, key, "left").select(key, why.alias("refused")), key)


def sample(items: DataFrame, seed: str, n: int, key: str = "item_id") -> DataFrame:
    """``n`` items of a reproducible shuffle, with their ``rank``."""
    top = items.orderBy(*T.seeded_order(seed, key)).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*T.seeded_order(seed, key))).cast("long"))


def simulation(items: DataFrame, seed: str, strata: list[tuple[str, int]], stratum: str = "stratum", key: str = "item_id") -> DataFrame:
    """For each stratum its first items of the shuffle; a short one is topped up by fillers.

    Each stratum is a top-k of its own, so no partition is ranked as a whole. Fillers are the next
    items of the shuffle that no stratum took; authentic ones come first.
    """
    out, wanted = None, 0
    for i, (name, n) in enumerate(strata):
        part = items.where(F.col(stratum) == name).orderBy(*T.seeded_order(seed, key)).limit(n).select(key, F.lit(i).alias("block"), F.lit(False).alias("filler"))
        out = part if out is None else out.union(part)
        wanted += n
    lack = wanted - out.count()
    fill = items.join(out.select(key), key, "left_anti").orderBy(*T.seeded_order(seed, key)).limit(max(0, lack)).select(key, F.lit(len(strata)).alias("block"), F.lit(True).alias("filler"))
    every = out.union(fill)
    return every.withColumn("position", F.row_number().over(Window.orderBy("block", *T.seeded_order(seed, key))).cast("long"))


def explore(items: DataFrame, text: str = "", years: list[int] | None = None, blocks: list[str] | None = None, status: str = "all") -> DataFrame:
    """Conjunction of the filters that are set; the text is searched in the prompt and options, folded."""
    df = items
    if text:
        df = df.where(T.fold_search(F.concat(F.coalesce("prompt", F.lit("")), F.array_join("options", " "))).contains(text))
    if years:
        df = df.where(F.col("year").isin(years))
    if blocks:
        df = df.where(F.col("block").isin(blocks))
    pending = F.col("status").isin("missing_official_answer", "classification_review", "ocr_review")
    facet = {"all": F.lit(True), "active": F.col("active"), "historical": F.col("answer").isNotNull() & (F.col("answer") != "anulada"), "pending": pending}
    return df.where(facet[status])


def eligible(items: DataFrame, progress: DataFrame, pool: str) -> DataFrame:
    """Items of a pool: all, unseen, failed or favorite; an item without progress is unseen."""
    p = progress.select("item_id", "seen", "wrong", "favorite")
    keep = {"all": F.lit(True), "unseen": F.coalesce("seen", F.lit(0)) == 0, "failed": F.coalesce("wrong", F.lit(0)) > 0, "favorite": F.coalesce("favorite", F.lit(False))}[pool]
    return items.join(p, "item_id", "left").where(keep).select(*items.columns)


def resolve_spec(spec: DataFrame, items: DataFrame) -> DataFrame:
    """Ids of a test in their order; those that no item has are dropped."""
    return spec.select(F.posexplode("ids").alias("pos", "item_id")).join(items, "item_id")


def validate_uploads(uploads: DataFrame, topics: DataFrame, profile: str = "client") -> DataFrame:
    """``source_id``, ``id``, ``issues`` of every uploaded question.

    ``uploads``: source_id, title, q struct(id, topic, prompt, options, answer). Profile ``server``
    trims blanks only. Ids have to be unique in a source, topics to exist, options to be four.
    """
    trim = F.trim if profile == "server" else lambda x: F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")
    size = lambda x: F.length(trim(F.coalesce(x, F.lit(""))))
    ids = uploads.groupBy("source_id", "q.id").agg(F.count("*").alias("n"))
    known = topics.select(F.col("topic").alias("known")).distinct()
    u = uploads.select("source_id", "title", "q.*").join(ids, ["source_id", "id"], "left").join(F.broadcast(known), F.col("topic") == F.col("known"), "left")
    bad = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("id").rlike(r"\A[a-z0-9][a-z0-9-]{0,79}\z"), F.lit(False)), "id"), F.when(F.coalesce("n", F.lit(2)) > 1, "repeated id"), F.when(F.col("known").isNull(), "topic"),
        F.when(~size(F.col("title")).between(1, 160), "title"), F.when(~size(F.col("prompt")).between(1, 3000), "prompt"),
        F.when((F.size(F.coalesce("options", F.array().cast("array<string>"))) != 4) | F.exists("options", lambda o: ~size(o).between(1, 1500)), "options"), F.when(~F.coalesce(F.col("answer").isin("a", "b", "c", "d"), F.lit(False)), "answer"),
    ))
    return u.select("source_id", "id", F.array_join(bad, "; ").alias("issues"))
