"""Answer keys, inventories, coverage and the validator of a bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.functions import text as T
from itembank.operators.exam import EXPECTED, section_grid

#: An answer as a key prints it, marks of pages and options that don't belong in a
#: text, the caps on lengths, and the endings of a document's recognised texts.
KEY_ANSWER = r"[A-Da-d]|ANULADA|Anulada|anulada"
PAGE_MARK = r"(?i)\bp[aá]gina\s+\d+\s+de\s+\d+\b"
OPTION_MARK = r"(?i)(?:^|\s)[a-d][.)]\s+"
MOST_PROMPT, MOST_OPTION = 2400, 1200
SIDECARS = {"psm6": ".psm6.txt", "layout": ".layout.json", "psm4": ".psm4.txt", "psm4_high": ".psm4-400.txt", "psm6_high": ".psm6-high.txt"}
EASY_SCANS = ["2007 libre", "2008 pi", "2014 pi"]


def answer_pairs(words: DataFrame) -> DataFrame:
    """``doc``, ``x``, ``y``, ``number``, ``answer`` from a key page's words (doc, i, x, y, token).

    A number and its answer are one word (``12.B``) or two neighbours in reading order on one line
    (within 3 points). Answers are lower case.
    """
    w = Window.partitionBy("doc").orderBy("i")
    t = words.withColumns({"t": F.trim("token"), "next": F.lead("token").over(w), "next_y": F.lead("y").over(w)})
    joined = F.regexp_extract("t", rf"^(\d{{1,3}})[.)]\s*({KEY_ANSWER})$", 1)
    alone = F.regexp_extract("t", r"^(\d{1,3})[.)]$", 1)
    beside = (alone != "") & F.col("next").rlike(rf"^(?:{KEY_ANSWER})$") & (F.abs(F.col("next_y") - F.col("y")) <= 3)
    number = F.when(joined != "", joined).when(beside, alone)
    answer = F.when(joined != "", F.regexp_extract("t", rf"^(\d{{1,3}})[.)]\s*({KEY_ANSWER})$", 2)).when(beside, F.col("next"))
    return t.select("doc", "x", "y", number.cast("int").alias("number"), F.lower(answer).alias("answer")).where("number is not null")


def key_pairs(embedded: DataFrame, recognised: DataFrame, least: int = 5) -> DataFrame:
    """Pairs of each document's embedded words, or of the recognised ones where there are too few."""
    few = embedded.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("doc")
    return embedded.join(few, "doc", "left_semi").unionByName(recognised.join(few, "doc", "left_anti"))


def key_issues(stream: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc``, ``issue`` of keys that don't fit their sections: another length, or numbers other than
    1 to each section's length in order. ``stream``: doc, pos (from 1), number; ``sections``: ord, n."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # a questionnaire's sections are few
    ranges = sections.withColumn("lo", F.coalesce(F.sum("n").over(w), F.lit(0))).select("lo", (F.col("lo") + F.col("n")).alias("hi"))
    total = sections.agg(F.sum("n")).scalar()
    placed = stream.join(F.broadcast(ranges), (F.col("pos") > F.col("lo")) & (F.col("pos") <= F.col("hi")), "left")
    g = placed.groupBy("doc").agg(F.count("*").alias("have"), F.count_if(F.coalesce(F.col("number") != F.col("pos") - F.col("lo"), F.lit(True))).alias("odd"))
    return g.select("doc", F.when(F.col("have") != total, "length").when(F.col("odd") > 0, "numbers").alias("issue")).where("issue is not null")


def literal_key(keys: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc``, ``section``, ``number``, ``answer`` of keys written out as one text (doc, text)."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sections.withColumn("lo", F.coalesce(F.sum("n").over(w), F.lit(0)))
    parts = keys.select("doc", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("p", "answer"))
    return parts.join(F.broadcast(ranges), (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("lo") + F.col("n"))).select("doc", "section", (F.col("p") - F.col("lo") + 1).cast("long").alias("number"), F.lower("answer").alias("answer"))


#: Names that are complex whatever they say, and the years that are.
COMPLEX_NAMES = ["tai libre 2018.pdf", "tai libre 2018_segundo ejercicio.pdf", "tai pi 2018.pdf"]
COMPLEX_YEARS = range(2005, 2019)


def needs_recognition(path: Column, pages: Column, chars: Column) -> Column:
    """Whether a document has to be recognised: over two pages, and hardly any text or a complex old questionnaire.

    The path says a year from 2005 to 2018; the name is a questionnaire's, and no answers' or template's.
    """
    folded = F.lower(path)
    name = F.element_at(F.split(folded, "/"), -1)
    old = folded.rlike("|".join(map(str, COMPLEX_YEARS)))
    no_key = (~name.contains("respuesta") | name.contains("cuestionario y respuestas")) & ~name.contains("plant")
    return (pages > 2) & ((chars < 5000) | (old & no_key & (name.contains("cuestionario") | name.isin(*COMPLEX_NAMES))))


def needs_high_accuracy(path: Column) -> Column:
    folded = F.lower(path)
    return ~F.exists(F.array(*[F.lit(x) for x in EASY_SCANS]), lambda x: folded.contains(x))


def sidecar(path: Column, kind: str) -> Column:
    """Where a document's recognised text of a kind lies, from the path of its first one."""
    return F.regexp_replace(path, r"\.psm6\.txt$", SIDECARS[kind])


def joined_pages(pages: DataFrame) -> DataFrame:
    """``doc``, ``text``: a document's pages (doc, page, text) in order, form feeds between them."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return pages.groupBy("doc").agg(F.concat(F.array_join(texts, "\n\f\n"), F.lit("\n")).alias("text"))


def inventory(files: DataFrame, imported: DataFrame) -> DataFrame:
    """``files`` (path, chars, pages) with id, year, role, status and text mode; ``imported`` has paths."""
    known = imported.select("path").distinct().withColumn("_in", F.lit(True))
    folded = T.fold(F.element_at(F.split("path", "/"), -1))
    role = F.when(folded.contains("convocatoria"), "convocatoria").when(folded.contains("respuesta") | folded.contains("plant"), "plantilla").when(folded.contains("cuestionario"), "cuestionario").otherwise("recopilatorio")
    mode = F.when((F.col("pages") > 2) & (F.col("chars") < 5000), "ocr_cache").otherwise("embedded")
    return files.join(known, "path", "left").select(
        T.document_id(F.col("path")).alias("document_id"), "path", "pages", T.year_of(F.col("path")).alias("year"), role.alias("role"),
        F.when(F.col("_in"), "imported").otherwise("reviewed_reference").alias("status"), mode.alias("text_mode"))


def chars_by_document(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.max("page").alias("last_page"))


def page_counts(questions: DataFrame, least: int) -> DataFrame:
    """``doc``, ``first_page``, ``questions``: the first page with at least ``least`` questions (else the
    first with any), and how many there are from it on."""
    by = questions.groupBy("doc", "page").agg(F.count("*").alias("n"))
    first = by.groupBy("doc").agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("page"))), F.min("page")).alias("first_page"))
    return by.join(first, "doc").where(F.col("page") >= F.col("first_page")).groupBy("doc", "first_page").agg(F.sum("n").cast("long").alias("questions"))


def config_issues(meta: DataFrame, program: DataFrame, call: str, topics: int, blocks: list[str], version: int = 2) -> DataFrame:
    """``rule``, ``n``: what is wrong with a bank's head: call, schema version, topics, order of blocks.

    ``meta`` is one row (official_call, schema_version); ``program`` has ord, block, topics (array).
    """
    m = meta.agg(F.count_if(F.col("official_call") != call).alias("call"), F.count_if(F.col("schema_version") != version).alias("version"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"])
    p = program.agg((F.coalesce(F.sum(F.size("topics")), F.lit(0)) != topics).cast("long").alias("topics"), (order != F.array(*[F.lit(b) for b in blocks])).cast("long").alias("blocks"))
    return m.unpivot([], ["call", "version"], "rule", "n").union(p.unpivot([], ["topics", "blocks"], "rule", "n"))


def violations(items: DataFrame, topics: DataFrame, sources: DataFrame) -> DataFrame:
    """``rule``, ``n``: how many items break each rule of the validator.

    ``items``: item_id, prompt, options, answer, block, topic, status, active, units (confidence),
    source, page. ``sources``: source, pages. Topics are those of the program.
    """
    t = F.broadcast(topics.select(F.col("topic").alias("_t")).distinct())  # a program's topics
    s = sources.select(F.col("source").alias("_s"), "pages").dropDuplicates(["_s"])
    i = items.join(t, F.col("topic") == F.col("_t"), "left").join(s, F.col("source") == F.col("_s"), "left")
    text = F.concat_ws(" ", F.col("prompt"), F.array_join("options", " "))
    act = F.col("active")
    rules = {
        "options": F.size("options") != 4, "blank_option": F.exists("options", lambda o: F.trim(o) == ""), "answer": F.col("answer").isNotNull() & ~F.col("answer").isin("a", "b", "c", "d", "anulada"),
        "block": ~F.col("topic").startswith(F.concat("block", F.lit("."))), "topic": F.col("_t").isNull(), "source": F.col("_s").isNull(), "page": ~F.coalesce(F.col("page").between(1, F.col("pages")), F.lit(False)),
        "active_status": act & (F.col("status") != "valid"), "active_answer": act & ~F.coalesce(F.col("answer").isin("a", "b", "c", "d"), F.lit(False)), "active_confidence": act & (F.col("units") < 13600),
        "active_footer": act & text.rlike(PAGE_MARK), "active_nested": act & F.exists("options", lambda o: o.rlike(OPTION_MARK)), "active_length": act & ((F.length("prompt") > MOST_PROMPT) | F.exists("options", lambda o: F.length(o) > MOST_OPTION)),
    }
    one = i.agg((F.count("item_id") - F.countDistinct("item_id")).alias("id"), *[F.count_if(c).alias(k) for k, c in rules.items()])
    return one.unpivot([], ["id", *rules], "rule", "n")


def document_rules(documents: DataFrame, expected: int) -> DataFrame:
    """``rule``, ``n``: a wrong number of documents, and those still pending."""
    one = documents.agg((F.count("*") != expected).cast("long").alias("count"), F.count_if(F.col("status").isin("reviewed_not_imported", "reviewed_ocr_required")).alias("pending"))
    return one.unpivot([], ["count", "pending"], "rule", "n")


def coverage_rules(coverage: DataFrame, items: DataFrame, stored: DataFrame) -> DataFrame:
    """``rule``, ``n``: coverage that doesn't add up to the items, exams with gaps, and a stored table of
    another size. ``coverage``: expected, extracted, missing (text, empty if nothing is)."""
    c = coverage.agg(F.coalesce(F.sum("extracted"), F.lit(0)).alias("sum"), F.count_if((F.col("extracted") != F.col("expected")) | (F.col("missing") != "")).alias("gaps"))
    n, m = items.agg(F.count("*")).scalar(), stored.agg(F.count("*")).scalar()
    one = c.select((F.col("sum") != n).cast("long").alias("sum"), "gaps", (m != n).cast("long").alias("stored"))
    return one.unpivot([], ["sum", "gaps", "stored"], "rule", "n")


def section_integrity(questions: DataFrame, specs: list[tuple[str, int]] = EXPECTED, key: str = "exam_id") -> DataFrame:
    """``key``, ``section``, ``n``, ``expected``, ``ok`` for every exam and section of the specs."""
    have = questions.groupBy(key, "section").agg(F.count("*").alias("n"))
    return section_grid(questions, specs, key).join(have, [key, "section"], "left").select(key, "section", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("expected").cast("long").alias("expected"), (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("ok"))


def report(items: DataFrame, topics: DataFrame) -> DataFrame:
    """``ord``, ``line`` of a Markdown report: totals, statuses, active items of every topic."""
    # items are read once: all three parts come from these few rows, whose shuffle Spark reuses, as no
    # filter is moved below it
    few = items.groupBy("status", "active", "topic").agg(F.count("*").alias("k"))
    live = F.coalesce(F.sum(F.when(F.col("active"), F.col("k"))), F.lit(0)).alias("a")
    status = few.groupBy("status").agg(F.sum("k").alias("n")).select(F.struct(F.lit(2), F.col("status"), F.lit(0)).alias("ord"), F.format_string("- %s: %d", "status", "n").alias("line"))
    whole = few.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), live).select(F.struct(F.lit(1), F.lit(""), F.lit(0)).alias("ord"), F.format_string("Questions: %d, active: %d", "n", "a").alias("line"))
    by = topics.join(few.groupBy("topic").agg(live.alias("n")), "topic", "left").select(F.struct(F.lit(3), F.lit(""), F.col("topic_ord")).alias("ord"), F.format_string("- %s: %d", F.col("topic"), F.coalesce("n", F.lit(0))).alias("line"))
    every = whole.union(status).union(by)
    return every.select(F.col("ord").cast("struct<part:int,name:string,no:int>").alias("ord"), "line")


def single(rows: DataFrame) -> DataFrame:
    """``rows`` if it is exactly one; else an error when it is read. More than two are never read."""
    two = rows.limit(2)
    n = two.agg(F.count("*")).scalar()
    checked = F.when(n == 1, True).otherwise(F.raise_error(F.concat(F.lit("one row expected, there are at least "), n.cast("string"))).cast("boolean"))
    one = two.sparkSession.range(1).select(checked.alias("_ok"))
    return one.join(two, F.col("_ok"), "left").drop("_ok")
