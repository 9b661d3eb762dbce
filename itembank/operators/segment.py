"""Raw lines to questions: line types, sections, segments, alignment and geometry.

What a window can express is a window over one document's lines. A document's lines are bounded,
a corpus's are not, so nothing here is ordered across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``line_no`` from 0, ``line`` of every line."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line"))


def line_type(line: Column) -> Column:
    """header, answer, option, start, blank or text; the first that fits."""
    return (
        F.when(line.rlike(r"^\s*$"), "blank").when(line.rlike(r"(?i)^\s*(?:section|part|block)\b"), "header").when(line.rlike(r"(?i)^\s*answer\s*:\s*[a-d]"), "answer")
        .when(line.rlike(r"(?i)^\s*[a-d]\s*[).]\s"), "option").when(line.rlike(r"^\s*\d{1,3}\s*[.)-]\s"), "start").otherwise("text")
    )


def segments(lines: DataFrame, starts: Column) -> DataFrame:
    """``lines`` with ``segment``: how many starts there are up to the line, in its document."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("segment", F.sum(starts.cast("long")).over(w))


def section_as_of(lines: DataFrame, header: Column) -> DataFrame:
    """``lines`` with ``section``: the last header strictly above."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("section", F.last(F.when(header, F.col("line")), ignorenulls=True).over(w))


def restart_segments(rows: DataFrame, key: str, order: list[str], number: str) -> DataFrame:
    """A number that isn't larger, and small or far below the one before it, starts a new segment."""
    w = Window.partitionBy(key).orderBy(*order)
    prev, n = F.lag(number).over(w), F.col(number)
    fresh = (n <= prev) & ((n <= 5) | (n < prev - 10))
    df = rows.withColumn("_f", F.coalesce(fresh, F.lit(False)).cast("long"))
    return df.withColumn("segment", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``key``, ``after``, ``before``: neighbouring distinct numbers with others missing between."""
    w = Window.partitionBy(key).orderBy(number)
    d = rows.select(key, number).distinct().withColumn("before", F.lead(number).over(w))
    return d.where(F.col("before") > F.col(number) + 1).select(key, F.col(number).alias("after"), "before")


def repaired(numbers: Column) -> Column:
    """Numbers, in order, where one more than 10 above its repaired predecessor becomes the next."""
    step = lambda acc, x: F.concat(acc, F.array(F.when((F.size(acc) > 0) & (x > F.try_element_at(acc, F.lit(-1)) + 10), F.try_element_at(acc, F.lit(-1)) + 1).otherwise(x)))
    return F.aggregate(numbers, F.array().cast("array<int>"), step)


#: Readings of the markers b, c and d, and the longest run of marks after one.
READ_AS = {"b": ["hb", "bh"], "c": ["ec", "e", "€", "£", "<", "¢", "ç", "ce", "cc", "cl"], "d": ["dd", "od", "0d"]}


def marker_label(token: Column) -> Column:
    """The option a misread marker stands for; ``?`` where it could be any."""
    t = F.lower(F.trim(F.regexp_replace(F.trim(token), r"[.),/;:]+$", "")))
    label = F.when(t.isin("a", "b", "c", "d"), t).when(t.isin("aj", "bj", "cj", "dj"), F.substring(t, 1, 1))
    for letter, tokens in READ_AS.items():
        label = label.when(t.isin(*tokens), letter)
    return label.otherwise("?")


def marker_number(token: Column) -> Column:
    """The number of a marker; null if it isn't one."""
    t = F.regexp_replace(F.trim(token), r"[.),;:]+$", "")
    return F.when(t.rlike(r"^[0-9]{1,9}$"), t).try_cast("int")


def column_clusters(boxes: DataFrame, width: int = 18) -> DataFrame:
    """``boxes`` (page, x, y, token) with ``col`` and ``flow``: columns left to right, then down.

    A column takes what lies within ``width`` of its first member, so the fold is anchored.
    """
    member = F.struct("x", "y", "token")
    step = lambda acc, b: F.when((F.size(acc) == 0) | (b["x"] > F.try_element_at(acc, F.lit(-1)) + width), F.concat(acc, F.array(b["x"]))).otherwise(acc)
    g = boxes.groupBy("page").agg(F.sort_array(F.collect_list(member)).alias("m"))
    g = g.withColumn("anchors", F.aggregate("m", F.array().cast("array<int>"), step))
    placed = F.array_sort(F.transform("m", lambda b: F.struct(F.size(F.filter("anchors", lambda a: a <= b["x"])).alias("col"), b["y"].alias("y"), b["x"].alias("x"), b["token"].alias("token"))))
    return g.select("page", F.posexplode(placed).alias("flow", "b")).select("page", "flow", "b.col", "b.x", "b.y", "b.token")


def layout_lines(words: DataFrame) -> DataFrame:
    """Words (page, line, left, top, word) to lines: box and text in reading order."""
    g = words.groupBy("page", "line").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.sort_array(F.collect_list(F.struct(F.col("left").alias("l"), "word"))).alias("w"))
    return g.select("page", "line", "left", "top", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))
