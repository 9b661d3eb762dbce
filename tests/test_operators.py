import datetime as dt
import unicodedata
from itertools import combinations

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itembank.functions import text as T
from itembank.operators import bank as B
from itembank.operators import classify as C
from itembank.operators import layout, ocr
from itembank.operators import segment as S
from itembank.sources import files
from itembank.streaming import progress


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_fold_is_pythons(spark):
    words = ["Straße ÀÉÎÕÜ", "ñandú Ço", "ŽŠ ğ", "", "abc_1"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.fold(F.col("w")).alias("f"))
    for r in df.collect():
        assert r["f"] == "".join(c for c in unicodedata.normalize("NFD", r["w"].casefold()) if unicodedata.category(c) != "Mn")


def test_scalars(spark):
    assert one(spark, T.number_es(F.lit(12345.5))) == "12.345,50" and one(spark, T.number_es(F.lit(-1234.5))) == "-1234,50"
    assert one(spark, T.mmss(F.lit(7384))) == "123:04" and one(spark, T.slug(F.lit(" ¡Hola, Ñandú! "))) == "hola-nandu"
    assert one(spark, T.year_of(F.lit("exam-2019-b"))) == 2019


def test_score_of_a_third_per_error(spark):
    rows = spark.createDataFrame([("t", "correct"), ("t", "wrong"), ("t", "blank")], "topic string, outcome string")
    r = B.score(rows, ["topic"]).first()
    assert (r["correct"], r["wrong"], r["blank"], r["thirds"]) == (1, 1, 1, 2)
    assert B.score(rows.limit(0), ["topic"]).count() == 0


def test_rank_ties_follow_the_lexicon(spark):
    items = spark.createDataFrame([(1, "alpha beta", ["x"]), (2, None, None)], "item_id long, prompt string, options array<string>")
    r = {x["item_id"]: x for x in C.classify(items, [("B", ["beta"]), ("A", ["alph", "x"])]).collect()}
    assert r[1]["topic"] == "A" and r[2]["topic"] == "B" and r[2]["method"] == "fallback" and r[2]["units"] == 6000


def test_duplicates_by_profile(spark):
    long = "word " * 60
    items = spark.createDataFrame([(1, 1, long + "a", []), (2, 2, long + "b", []), (3, 3, long + "a", []), (4, 4, None, None)], "item_id long, seq long, prompt string, options array<string>")
    got = lambda p: {r["item_id"]: r["duplicate_of"] for r in B.mark_duplicates(items, p).collect()}
    assert got("pdf") == {1: None, 2: None, 3: 1, 4: None} and got("txt") == {1: None, 2: 1, 3: 1, 4: None}


def test_merge_and_sync(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "n")], "id long, v string")
    assert {(r["id"], r["v"], r["action"]) for r in B.merge_supplement(a, b, "id", ["v"]).collect()} == {(1, "x", "keep"), (2, "z", "update"), (3, "n", "insert")}
    now = dt.datetime(2024, 1, 1, 12)
    c = spark.createDataFrame([(1, now + dt.timedelta(hours=1), "c"), (2, now, "c"), (3, now, "c")], "user_id long, updated timestamp, payload string")
    s = spark.createDataFrame([(1, now + dt.timedelta(minutes=10), "s"), (2, now, "s"), (4, now, "s")], "user_id long, updated timestamp, payload string")
    got = {r["user_id"]: (r["action"], r["payload"]) for r in B.sync_lww(c, s, F.lit(now)).collect()}
    assert got == {1: ("downloaded", "s"), 2: ("downloaded", "s"), 3: ("created", "c"), 4: ("downloaded", "s")}


def test_simulation_tops_up(spark):
    items = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(20)], "item_id long, stratum string")
    r = B.simulation(items, "s", [("a", 5), ("b", 5)]).collect()
    assert len(r) == 10 and len({x["item_id"] for x in r}) == 10 and sum(x["filler"] for x in r) == 2


def test_uploads(spark):
    q = "struct<id:string,topic:string,prompt:string,options:array<string>,answer:string>"
    rows = [(1, "t", ("q1", "t1", "p", ["1", "2", "3", "4"], "a")), (1, "t", ("q2", "zz", "p", ["1"], "a")), (2, "t", ("q", "t1", "p", ["1", "2", "3", "4"], "a")), (2, "t", ("q", "t1", "p", ["1", "2", "3", "4"], "e")), (3, None, None)]
    got = sorted((r["source_id"], str(r["id"]), r["issues"]) for r in B.validate_uploads(spark.createDataFrame(rows, f"source_id long, title string, q {q}"), spark.createDataFrame([("t1",)], "topic string")).collect())
    assert got[0][2] == "" and "topic" in got[1][2] and "options" in got[1][2] and got[2][2] == "repeated id" and "answer" in got[3][2] and got[4][2].startswith("id")


@given(st.lists(st.sampled_from("abcd?"), max_size=9))
def test_alignment_is_the_best_one(labels):
    worth = lambda c: sum({w: 2, "?": 0}.get(labels[i], -2) for i, w in zip(c, "abcd", strict=True))
    ways = list(combinations(range(len(labels)), 4))
    score, places = ocr.align(labels)
    assert (score, places) == ((max(map(worth, ways)), places) if ways else (-10_000, []))
    assert not ways or worth(places) == score


@given(st.lists(st.integers(0, 3), max_size=7), st.lists(st.integers(0, 3), max_size=7))
def test_lcs(a, b):
    got = layout.longest_common(a, b)
    assert [a[i] for i, _ in got] == [b[j] for _, j in got]
    subs = {tuple(a[i] for i in c) for n in range(len(a) + 1) for c in combinations(range(len(a)), n)}
    assert len(got) == max(n for n in range(len(b) + 1) for c in combinations(range(len(b)), n) if tuple(b[j] for j in c) in subs)


def test_folds(spark):
    assert one(spark, S.repaired(F.array(*[F.lit(x) for x in (1, 2, 30, 4, 99, 7)]))) == [1, 2, 3, 4, 5, 7]
    boxes = spark.createDataFrame([(1, 0, 5, "a"), (1, 17, 1, "b"), (1, 19, 0, "c"), (1, 36, 0, "d")], "page int, x int, y int, token string")
    assert [(r["token"], r["col"]) for r in S.column_clusters(boxes).orderBy("flow").collect()] == [("b", 1), ("a", 1), ("c", 2), ("d", 2)]


def test_sections_and_segments(spark):
    lines = spark.createDataFrame([(1, 0, "Section A"), (1, 1, "x"), (1, 2, "Section B"), (1, 3, "y")], "doc_id long, line_no int, line string")
    got = S.section_as_of(lines, S.line_type(F.col("line")) == "header").orderBy("line_no").collect()
    assert [r["section"] for r in got] == [None, "Section A", "Section A", "Section B"]


def test_sources(spark, tmp_path):
    (tmp_path / "b 2018.txt").write_text("one\ntwo")
    (tmp_path / "u.json").write_text('{"a": 1}')
    d = f"file://{tmp_path}"
    assert files.read_texts(spark, d + "/*.txt").first()["text"] == "one\ntwo"
    inv = files.inventory(spark, d)
    assert inv.count() == 2 and files.todo(inv, inv).count() == 0 and files.upload_files(spark, d).count() == 1
    files.write_table(spark.createDataFrame([(1, ["x"])], "a int, o array<string>"), d + "/t")
    assert spark.read.parquet(d + "/t").first()["o"] == '["x"]'


def test_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 7, 1, "correct"), (1, t, 7, 1, "correct"), (2, t, 7, 1, "wrong")]
    schema = "event_id long, ts timestamp, user_id long, question long, outcome string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    q = progress.progress_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("p").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from p").collect()
    assert [(x["seen"], x["correct"], x["wrong"]) for x in r] == [(2, 1, 1)]


def test_what_may_not_be_merged(spark):
    have = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, answer string")
    extra = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (9, "a"), (None, "a")], "id int, answer string")
    got = sorted(tuple(r) for r in B.supplement_issues(have, extra, "id", "answer").collect())
    assert got == [(1, "contradicts"), (3, "contradicts"), (9, "unknown")]
    assert B.supplement_issues(have, extra.limit(0), "id", "answer").count() == 0


def test_texts_are_folded_a_few_times_below_a_filter(spark):
    from itembank.plans import practice

    rows = practice.full_items(spark, "/root/testdata/sf0.001").where("active").select("item_id")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("translate(") <= 5  # the text once; prompt and whole item for the score and for the margin
