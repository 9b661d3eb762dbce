"""The exam manifest: rules expanded to exams, questionnaires, sections and the grid of questions.

A rule names years, an access, a status of answers and the plans of its questionnaires. Everything
that counts or aligns against "what should be there" joins these tables instead of literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections of a plan as name:questions:blocks; a name that ends in reserve is one, one
#: that begins with case belongs to the practical exercise. Rules: years, access, sitting, plans of the
#: questionnaires, pages of the answer templates (-1: the last), status of the answers.
PLANS = {
    "general": "first:80:I,II,III,IV first_reserve:5:I,II,III,IV case_iii:20:III case_iii_reserve:5:III case_iv:20:IV case_iv_reserve:5:IV",
    "internal": "first:50:I,II,III,IV first_reserve:5:I,II,III,IV case_iii:12:III case_iii_reserve:3:III case_iv:12:IV case_iv_reserve:3:IV",
    "old_first": "first:99:I,II,III,IV",
    "old_second": "case_iii:18:III case_iv:18:IV case_v:18:IV",
    "first_50": "first:50:I,II first_iii:50:III first_iii_reserve:3:III first_iv:50:IV first_iv_reserve:3:IV",
    "first_50_reserve": "first:50:I,II first_reserve:3:I,II first_iii:50:III first_iii_reserve:3:III first_iv:50:IV first_iv_reserve:3:IV",
    "second_40": "case_iii:40:III case_iii_reserve:3:III case_iv:40:IV case_iv_reserve:3:IV",
    "internal_first_25": "first:25:I,II first_iii:25:III first_iii_reserve:3:III first_iv:25:IV first_iv_reserve:3:IV first_v:25:IV first_v_reserve:3:IV",
    "internal_second_20": "case_iii:20:III case_iii_reserve:3:III case_iv:20:IV case_iv_reserve:3:IV case_v:20:IV case_v_reserve:3:IV",
    "internal_25": "first:25:I,II first_iii:25:III first_iii_reserve:3:III first_iv:25:IV first_iv_reserve:3:IV case_iii:12:III case_iii_reserve:3:III case_iv:12:IV case_iv_reserve:3:IV",
    "internal_25_reserve": "first:25:I,II first_reserve:3:I,II first_iii:25:III first_iii_reserve:3:III first_iv:25:IV first_iv_reserve:3:IV case_iii:12:III case_iii_reserve:3:III case_iv:12:IV case_iv_reserve:3:IV",
    "first_100": "first:100:I,II,III,IV first_reserve:3:I,II,III,IV",
    "second_30": "case_iii:30:III case_iii_reserve:3:III case_iv:30:IV case_iv_reserve:3:IV",
    "internal_50": "first:50:I,II,III,IV first_reserve:3:I,II,III,IV case_iii:12:III case_iii_reserve:3:III case_iv:12:IV case_iv_reserve:3:IV",
    "first_100_of_5": "first:100:I,II,III,IV first_reserve:5:I,II,III,IV",
    "second_30_of_5": "case_iii:30:III case_iii_reserve:5:III case_iv:30:IV case_iv_reserve:5:IV",
}
RULES = [
    ([2005], "libre", "ordinario", ["old_first", "old_second"], "oficial"), ([2006], "libre", "ordinario", ["old_first old_second"], "oficial"), ([2007], "libre", "ordinario", ["old_first old_second"], "oficial_definitiva"),
    ([2008], "libre", "ordinario", ["first_50", "second_40"], "oficial_definitiva"), ([2008, 2010], "promocion_interna", "ordinario", ["internal_first_25", "internal_second_20"], "oficial_definitiva"),
    ([2009], "promocion_interna", "ordinario", ["internal_first_25 internal_second_20"], "oficial_definitiva"), ([2014, 2015], "promocion_interna", "ordinario", ["internal_25"], "oficial_definitiva"),
    ([2015], "libre", "ordinario", ["first_50", "second_40"], "oficial_definitiva"), ([2016], "libre", "ordinario", ["first_50_reserve", "second_40"], "oficial_definitiva"),
    ([2016], "promocion_interna", "ordinario", ["internal_25_reserve"], "oficial_definitiva"), ([2017], "libre", "ordinario", ["first_100", "second_30"], "oficial_definitiva"),
    ([2017], "promocion_interna", "ordinario", ["internal_50"], "oficial_definitiva"), ([2018], "libre", "ordinario", ["first_100_of_5", "second_30_of_5"], "oficial_provisional"),
    ([2018], "promocion_interna", "ordinario", ["internal"], "oficial_provisional"), ([2019, 2022, 2024], "libre", "ordinario", ["general"], "oficial_definitiva"),
    ([2019, 2022, 2024], "promocion_interna", "ordinario", ["internal"], "oficial_definitiva"), ([2025], "libre", "ordinario", ["general"], "oficial_provisional_actualizada"), ([2025], "libre", "extraordinario", ["general"], "oficial_provisional"),
]
RULE = "years array<int>, access string, sitting string, questionnaires array<string>, answer_status string"


def sections(spark: SparkSession, rules=RULES, plans: dict[str, str] = PLANS) -> DataFrame:
    """``exam_id``, ``year``, ``access``, ``sitting``, ``answer_status``, ``questionnaire`` (from 1), ``ord`` (of the
    section in it, from 1), ``section``, ``n``, ``blocks``, ``reserve``, ``exercise``: a row for each section."""
    rule = spark.createDataFrame(rules, RULE)
    plan = spark.createDataFrame(list(plans.items()), "plan string, text string")
    one = rule.select(F.explode("years").alias("year"), "access", "sitting", "answer_status", F.posexplode("questionnaires").alias("q", "names"))
    part = one.select("*", F.posexplode(F.split("names", " ")).alias("p", "plan")).join(F.broadcast(plan), "plan")
    s = part.select("*", F.posexplode(F.split("text", " ")).alias("s", "spec")).withColumn("f", F.split("spec", ":"))
    name = F.get("f", F.lit(0))
    exam = F.concat_ws("-", F.col("year").cast("string"), F.replace("access", F.lit("_"), F.lit("-")), F.when(F.col("sitting") != "ordinario", F.col("sitting")))
    return s.select(
        exam.alias("exam_id"), "year", "access", "sitting", "answer_status", (F.col("q") + 1).alias("questionnaire"), (F.col("p") * 100 + F.col("s") + 1).alias("ord"), name.alias("section"), F.get("f", F.lit(1)).cast("int").alias("n"),
        F.split(F.get("f", F.lit(2)), ",").alias("blocks"), name.endswith("_reserve").alias("reserve"), F.when(name.startswith("case"), "supuesto_practico").otherwise("primera_parte").alias("exercise"))


def grid(sections: DataFrame) -> DataFrame:
    """``exam_id``, ``section``, ``number`` of every question that there should be."""
    return sections.select("exam_id", "section", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))


def coverage(sections: DataFrame, have: DataFrame) -> DataFrame:
    """``exam_id``, ``expected``, ``extracted``, ``missing`` (section:number, in order) of every exam of the manifest.

    ``have``: exam_id, section, number; what the manifest doesn't have, and what comes twice, counts for nothing.
    """
    seen = have.select("exam_id", "section", "number").distinct().withColumn("there", F.lit(True))
    g = grid(sections).join(seen, ["exam_id", "section", "number"], "left")
    gap = F.sort_array(F.collect_list(F.when(F.col("there").isNull(), F.struct("section", "number"))))
    out = g.groupBy("exam_id").agg(F.count("*").alias("expected"), F.count("there").alias("extracted"), gap.alias("m"))
    return out.select("exam_id", "expected", "extracted", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["section"], x["number"].cast("string"))), ",").alias("missing"))
