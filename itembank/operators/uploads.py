"""Uploaded sources: the JSON contract, checks of the client and the server, canonical questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's schema, the pattern of ids and the largest file.
QUESTION = "struct<id:string,topicId:string,prompt:string,options:array<string>,correctAnswer:string,explanation:string,sourceNote:string>"
SOURCE = f"struct<schemaVersion:int,sourceId:string,title:string,questions:array<{QUESTION}>>"
ID = r"\A[a-z0-9][a-z0-9-]{0,79}\z"
MOST_BYTES, MOST_QUESTIONS = 1 << 20, 200


def parsed(files: DataFrame) -> DataFrame:
    """``files`` (``json`` and other columns) with ``s``: the source, null where it is no JSON object."""
    return files.withColumn("s", F.when(F.trim("json").startswith("{"), F.from_json("json", SOURCE)))


def topics_of(program: DataFrame) -> DataFrame:
    """``topic``, ``name``, ``block`` of a program (block, topics: array of id, name)."""
    return program.select("block", F.explode("topics").alias("t")).select(F.col("t.id").alias("topic"), F.col("t.name").alias("name"), "block")


def trimmed(x: Column) -> Column:
    """As a client trims: all white space, no-break ones too, at both ends."""
    return F.regexp_replace(x, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def issues(sources: DataFrame, topics: DataFrame, profile: str = "client", by: str = "source_no") -> DataFrame:
    """``by``, ``question_no`` (from 0; -1: the source itself), ``issue``: the first one of each.

    The client trims all white space but counts lengths untrimmed (in code points here); the server
    trims blanks only, counts trimmed lengths, and has a limit on the whole file.
    """
    if profile not in ("client", "server"):
        raise ValueError(profile)
    bare = F.trim if profile == "server" else trimmed
    size = lambda x: F.length(bare(x)) if profile == "server" else F.when(bare(x) == "", 0).otherwise(F.length(x))
    outside = lambda x, n: ~F.coalesce(size(x).between(1, n), F.lit(False))
    s, n = F.col("s"), F.size(F.coalesce(F.col("s.questions"), F.array().cast(f"array<{QUESTION}>")))
    head = F.when(s.isNull() | F.coalesce(s["schemaVersion"] != 1, F.lit(True)), "schemaVersion")
    if profile == "server":
        head = head.when(F.octet_length("json") > MOST_BYTES, "size")
    head = head.when(~F.coalesce(s["sourceId"].rlike(ID), F.lit(False)), "sourceId").when(outside(s["title"], 160), "title").when(~n.between(1, MOST_QUESTIONS), "questions")
    own = sources.select(by, F.lit(-1).alias("question_no"), head.alias("issue")).where("issue is not null")
    q = sources.select(by, F.posexplode("s.questions").alias("question_no", "q"), "s")
    known = F.broadcast(topics.select(F.col("topic").alias("_t")).distinct())
    earlier = F.exists(F.slice("s.questions", F.lit(1), F.col("question_no")), lambda o: o["id"] == F.col("q.id"))
    options = F.coalesce(F.col("q.options"), F.array().cast("array<string>"))
    issue = (
        F.when(~F.coalesce(F.col("q.id").rlike(ID), F.lit(False)), "id").when(F.coalesce(earlier, F.lit(False)), "repeated id").when(F.col("_t").isNull(), "topicId").when(outside(F.col("q.prompt"), 3000), "prompt")
        .when((F.size(options) != 4) | F.exists(options, lambda o: outside(o, 1500)), "options").when(~F.coalesce(F.col("q.correctAnswer").isin("a", "b", "c", "d"), F.lit(False)), "correctAnswer")
        .when(F.col("q.explanation").isNotNull() & outside(F.col("q.explanation"), 3000), "explanation").when(F.col("q.sourceNote").isNotNull() & outside(F.col("q.sourceNote"), 500), "sourceNote")
    )
    return own.union(q.join(known, F.col("q.topicId") == F.col("_t"), "left").select(by, "question_no", issue.alias("issue")).where("issue is not null"))


def canonical(saved: DataFrame, topics: DataFrame) -> DataFrame:
    """Questions of saved sources (``s``, ``uploaded_at``) as items of the bank, in the sources' order, trimmed as the client does."""
    block = F.broadcast(topics.select(F.col("topic").alias("_t"), "block").dropDuplicates(["_t"]))
    q = saved.select("s", F.year("uploaded_at").alias("year"), F.posexplode("s.questions").alias("p", "q")).join(block, F.col("q.topicId") == F.col("_t"), "left")
    exam = F.concat(F.lit("uploaded:"), F.col("s.sourceId"))
    return q.select(
        F.concat(exam, F.lit(":"), F.col("q.id")).alias("item_id"), exam.alias("exam"), "year", F.lit("libre").alias("access"), F.lit("uploaded").alias("section"), F.lit(False).alias("reserve"), (F.col("p") + 1).cast("long").alias("number"),
        trimmed(F.col("q.prompt")).alias("prompt"), F.transform("q.options", trimmed).alias("options"), F.col("q.correctAnswer").alias("answer"), F.coalesce("block", F.lit("")).alias("block"), F.col("q.topicId").alias("topic"),
        F.lit("valid").alias("status"), F.lit(True).alias("active"), F.lit("uploaded").alias("origin"), F.col("s.title").alias("source"))


def with_names(items: DataFrame, topics: DataFrame) -> DataFrame:
    """``items`` with ``topic_name``: that of the program, else the topic itself."""
    names = F.broadcast(topics.select("topic", F.col("name").alias("_n")).dropDuplicates(["topic"]))
    return items.join(names, "topic", "left").withColumn("topic_name", F.coalesce("_n", "topic")).drop("_n")


def united(bank: DataFrame, uploads: DataFrame) -> DataFrame:
    """Bank and uploads; columns that one of them lacks are null."""
    return bank.unionByName(uploads, allowMissingColumns=True)


#: Questions that are shown of a file before it is saved.
SHOWN = 3


def preview(sources: DataFrame, bad: DataFrame, saved: DataFrame, by: str = "source_no") -> DataFrame:
    """``by``, ``title``, ``questions``, ``first`` (prompts of the first three), ``replaces`` of every source without
    an issue; ``bad`` are those of :func:`issues`, ``saved`` has the ``sourceId`` of what is stored."""
    stored = saved.select(F.col("sourceId").alias("_id"), F.lit(True).alias("_there")).distinct()
    ok = sources.join(bad.select(by).distinct(), by, "left_anti").join(stored, F.col("s.sourceId") == F.col("_id"), "left")
    return ok.select(by, trimmed(F.col("s.title")).alias("title"), F.size("s.questions").cast("long").alias("questions"), F.transform(F.slice("s.questions", 1, SHOWN), lambda q: trimmed(q["prompt"])).alias("first"), F.coalesce("_there", F.lit(False)).alias("replaces"))


def totals(saved: DataFrame) -> DataFrame:
    return saved.agg(F.count("*").alias("sources"), F.coalesce(F.sum(F.size("s.questions")), F.lit(0)).cast("long").alias("questions"))


def is_object(json: Column) -> Column:
    """Whether a text is a JSON object (not a list, a number or null)."""
    return F.coalesce(F.trim(json).startswith("{") & F.try_parse_json(json).isNotNull(), F.lit(False))


def snapshot_ok(json: Column) -> Column:
    """Whether a progress snapshot has version 1 and lists of attempts and progress."""
    v = F.try_parse_json(json)
    return F.coalesce((F.try_variant_get(v, "$.schemaVersion", "int") == 1) & F.try_variant_get(v, "$.attempts", "array<variant>").isNotNull() & F.try_variant_get(v, "$.progress", "array<variant>").isNotNull(), F.lit(False))
