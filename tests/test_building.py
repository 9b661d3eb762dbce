"""The build, its stores and what feeds it, on small cases."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from itembank.functions import stage
from itembank.functions import text as T
from itembank.operators import audit as A
from itembank.operators import build as M
from itembank.operators import manifest as X
from itembank.operators import merge as G
from itembank.operators import practice as P
from itembank.operators import readings as RD
from itembank.operators import report as R
from itembank.operators import store as W

OPTIONS = "  A) uno\n  B) dos\n  C) tres\n  D) cuatro\n"
ANSWER = "  RESPUESTA CORRECTA: B)\n"
LEXICON = [("I.1", ["constitución"]), ("III.1", ["red"]), ("IV.1", ["servidor"])]


def transcript(*sections):
    return "".join(f"{head}\n" + "".join(f"{n}. {prompt}\n{opts}{answer}" for n, (prompt, opts, answer) in enumerate(qs, 1)) for head, qs in sections)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("exams")
    first = [("La constitución dice", OPTIONS, ANSWER), ("La constitución calla", "  A) uno\n  B) dos\n", ANSWER), ("La  Constitución, dice", OPTIONS, ANSWER), ("ley 6/1997 y la constitución", OPTIONS, ANSWER), ("Nada de nada", OPTIONS, ANSWER)]
    texts = {
        "A": transcript(("PRIMERA PARTE — Preguntas 1 a 80", first), ("SUPUESTO I — Preguntas 1 a 20", [("La red de un servidor", OPTIONS, ANSWER), ("La red sin respuesta", OPTIONS, "")])),
        "B": transcript(("Sin cabecera", [("Fuera de sección", OPTIONS, ANSWER)]), ("PRIMERA PARTE — Preguntas 1 a 80", [("La constitución dice", OPTIONS, ANSWER), ("Nada de nada", OPTIONS, ANSWER)])),
        "unnamed": transcript(("PRIMERA PARTE — Preguntas 1 a 80", first)),
    }
    for folder, text in texts.items():
        (d / f"2019 {folder}").mkdir()
        (d / f"2019 {folder}" / M.TRANSCRIPT).write_text(text)
    exams = spark.createDataFrame([("a", 1, "2019 A", 2019, "oficial"), ("b", 2, "2019 B", 2019, "oficial"), ("c", 3, "2019 C", 2019, "oficial")], "exam_id string, ord int, folder string, year int, answer_status string")
    decisions = spark.createDataFrame([("b:first:2", "I.1", "leída")], "item_id string, topic string, reason string")
    texts = M.transcripts(spark, f"file://{d}", exams)
    return M.build(texts, exams, LEXICON, [("ley 6/1997", "derogada")], decisions), exams


def test_effects_keep_their_order(built):
    b, _ = built
    q = {r["item_id"]: r for r in b.questions.collect()}
    assert {k: (r["status"], r["active"], r["duplicate_of"]) for k, r in q.items()} == {
        "a:first:1": ("valid", True, None), "a:first:3": ("duplicate", False, "a:first:1"), "a:first:4": ("outdated", False, None), "a:first:5": ("classification_review", False, None),
        "a:case_iii:1": ("valid", True, None), "a:case_iii:2": ("missing_official_answer", False, None), "b:first:1": ("duplicate", False, "a:first:1"), "b:first:2": ("duplicate", False, "a:first:5")}
    # of the topics only those of the section's block count, and a duplicate of an inactive question goes as well
    assert q["a:case_iii:1"]["topic"] == "III.1" and q["b:first:2"]["method"] == M.DECIDED and q["a:first:4"]["reason"] == "derogada"
    # coverage counted active questions before the duplicates went
    cov = {r["exam_id"]: r for r in b.coverage.collect()}
    assert {k: (r["expected"], r["extracted"], r["active"], r["excluded"]) for k, r in cov.items()} == {"a": (135, 6, 3, 1), "b": (135, 2, 2, 1)}
    assert json.loads(cov["a"]["section_counts"]) == {"first": 4, "case_iii": 2} and list(json.loads(cov["a"]["section_counts"])) == ["first", "case_iii"]
    assert b.counters == {"parsed": 10, "outside": 1, "broken": 1, "active_before_duplicates": 5}
    assert sorted(tuple(r) for r in b.excluded.select("exam_id", "section", "number", "reason").fillna("").collect()) == [("a", "first", 2, "Tiene 2 opciones en lugar de 4"), ("b", "", 1, M.OUTSIDE)]
    assert b.review().count() == 6


def test_only_what_is_asked_for_is_stored(spark):
    text = transcript(("PRIMERA PARTE — Preguntas 1 a 80", [("La constitución dice", OPTIONS, ANSWER), ("ley 6/1997 y la constitución", OPTIONS, ANSWER), ("La constitución dice", OPTIONS, ANSWER), ("Dos", "  A) uno\n  B) dos\n", ANSWER)]))
    texts = spark.createDataFrame([("a", text), ("b", text)], "exam_id string, text string")
    exams = spark.createDataFrame([("a", 1, 2019, "oficial"), ("b", 2, 2019, "oficial")], "exam_id string, ord int, year int, answer_status string")
    decisions = spark.createDataFrame([("b:first:1", "I.1", "leída")], "item_id string, topic string, reason string")
    whole, none, some = (M.build(texts, exams, LEXICON, [("ley 6/1997", "derogada")], decisions, only=x) for x in (None, [], ["reason"]))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(whole.coverage) == rows(none.coverage) == rows(some.coverage) and whole.counters == none.counters == some.counters
    cols = ["item_id", "status", "reason", "active", "duplicate_of"]
    assert sorted(map(str, whole.questions.select(cols).collect())) == sorted(map(str, some.questions.select(cols).collect())) and whole.review().count() == some.review().count() == 5
    assert none.questions is None and none.excluded is None and not {"prompt", "options"} & set(some.questions.columns)


def shuffled_bytes(spark):
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def many(spark, exams=60, each=60):
    """Transcripts of questions with long texts that don't compress, a third of them repeated; exams; decisions, two of them on one question."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    prompts = [f"la constitución {word(60)}" for _ in range(40)] + ["la red"]
    opts = lambda: "".join(f"  {x}) {word(40)}\n" for x in "ABCD")
    one = lambda: (prompts[-1] if rng.random() < 0.2 else rng.choice(prompts) if rng.random() < 0.2 else f"la constitución {word(60)}", opts(), ANSWER)
    texts = [(f"e{i}", transcript(("PRIMERA PARTE — Preguntas 1 a 80", [one() for _ in range(each)]))) for i in range(exams)]
    marks = [("e3:first:1", "IV.1", "leída"), ("e3:first:1", "III.1", "otra"), ("e9:first:7", "I.1", "leída"), ("none:first:1", "I.1", "leída")]
    rows = [(e, 1000 - i, 2019, "oficial") for i, (e, _) in enumerate(texts)]
    return texts, (
        spark.createDataFrame(texts, "exam_id string, text string"), spark.createDataFrame(rows, "exam_id string, ord int, year int, answer_status string"), spark.createDataFrame(marks, "item_id string, topic string, reason string"))


def test_questions_stay_where_they_are(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(M, "HOT_SHARE", 0.05, raising=False)
    texts, (t, e, d) = many(spark)
    before = shuffled_bytes(spark)
    M.build(t, e, LEXICON, [], d).questions.write.format("noop").mode("overwrite").save()
    moved = shuffled_bytes(spark) - before
    assert 0 < moved < 1.5 * sum(len(x) for _, x in texts)


@pytest.mark.parametrize("share", [0.0001, 0.05, 2])
def test_duplicates_by_definition(spark, no_broadcast, monkeypatch, share):
    monkeypatch.setattr(M, "HOT_SHARE", share)  # all repeated signatures are broadcast, some, none
    texts, (t, e, d) = many(spark, 20, 20)
    first, want = {}, {}
    for i, text in reversed(texts):  # a later transcript has a smaller number
        for n, line in enumerate((x for x in text.split("\n") if x[:1].isdigit()), 1):
            item = f"{i}:first:{n}"
            want[item] = first.setdefault(line.split(". ", 1)[1], item)
    topics = {"e3:first:1": "III.1", "e9:first:7": "I.1"}
    for b in (M.build(t, e, LEXICON, [], d), M.build(t.join(e, "exam_id"), None, LEXICON, [], d, only=["item_id", "method", "topic"])):
        got = b.questions.collect()
        assert {r["item_id"]: r["duplicate_of"] or r["item_id"] for r in got} == want and len(got) == len(want) == b.counters["parsed"] == 400
        assert {r["item_id"]: r["topic"] for r in got if r["method"] == M.DECIDED} == topics
        assert sum(r["active"] for r in b.coverage.collect()) == b.counters["active_before_duplicates"] > sum(r["active"] for r in got)


def test_looked_up_finds_every_key(spark):
    rows = spark.createDataFrame([(i, str(i % 50) if i % 7 else None) for i in range(1000)], "i int, k string")
    values = spark.createDataFrame([(str(k), k * k) for k in range(40, 60)], "k string, v int")
    for bits in (1 << 15, 1 << 27):
        got = stage.looked_up(rows, values, "k", values.count(), bits).collect()
        assert sorted((r["i"], r["v"]) for r in got) == sorted(((i, (i % 50) ** 2 if i % 7 and i % 50 >= 40 else None) for i in range(1000)), key=lambda x: x[0])


def test_blank_options_by_definition(spark):
    texts = ["", " ", "\u00a0", "\u2003\t", "\n", "x", " \n x", "\u200b", None]
    df = spark.createDataFrame([("p", ["x", "y", "z", t], "a", t is None) for t in texts], "prompt string, options array<string>, answer string, missing boolean")
    got = [r[0] for r in df.select(M.contract_issues()).collect()]
    assert got == [M.BROKEN[1]] * 5 + [""] * 4


def test_report_text(spark, built, tmp_path):
    b, exams = built
    R.write(R.markdown(b, exams, [("I", "Uno", ["I.1"]), ("III", "Tres", ["III.1", "III.2"])], "2026-01-31", "`x/`"), f"file://{tmp_path}/report")
    (name,) = [x for x in os.listdir(tmp_path / "report") if x.endswith(".txt")]
    lines = (tmp_path / "report" / name).read_text().split("\n")
    assert lines[0] == R.TITLE and "- **Preguntas totales**: 8" in lines and "- **Rechazadas en parsing**: 2" in lines and "- `duplicate`: 3" in lines
    assert "| a | 135 | 6 | 3 | first=4, case_iii=2 |" in lines and "- **III.2**: 0 preguntas" in lines and "| `b:first:2` | I.1 | leída |" in lines and "- [b] #1: " + M.OUTSIDE in lines
    heads = [x for x in lines if x.startswith("## ")]
    assert heads == [x for p in sorted(R.HEADS) for x in R.HEADS[p] if x.startswith("## ")] + [R.CRITERIA[0]]


def test_report_looks_for_duplicates_once(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(M, "HOT_SHARE", 2, raising=False)
    texts, (t, e, d) = many(spark)
    b = M.build(t, e, LEXICON, [], d, only=["item_id", "ord", "section", "number", "prompt", "topic", "method", "status", "reason", "decision"])
    before = shuffled_bytes(spark)
    b.questions.write.format("noop").mode("overwrite").save()
    once = shuffled_bytes(spark) - before
    lines = R.markdown(b, e, [("I", "Uno", ["I.1"])], "2026-01-31", "`x/`")
    lines.write.format("noop").mode("overwrite").save()
    assert shuffled_bytes(spark) - before < 2.5 * once


def test_footers(spark):
    pad = lambda n: "·" * n
    anchor = "Ejercicio único"
    cases = {
        "uno dos Página 3 de 9": "uno dos", "uno Página 3 de 9 dos tres Página 4 de 9": "uno Página 3 de 9 dos tres", "uno Página 3 de 9 tail words": "uno Página 3 de 9 tail words", "uno | pagina 3 de 9 Bloque IV": "uno",
        "uno  \n dos": "uno dos", "Página 1 de 2": "", "": "", "uno 2024 - OEP TAI x Página 3 de 9 | 4": "uno", "páginas 3 de 9": "páginas 3 de 9", "uno PÁGINA 3 DE 9": "uno",
        # an anchor that begins 109, 110 or 111 characters before the reference
        **{f"uno {anchor}{pad(n - len(anchor) - 1)} Página 3 de 9": "uno" if n <= 110 else f"uno {anchor}{pad(n - len(anchor) - 1)}" for n in (109, 110, 111)},
    }
    got = spark.createDataFrame(list(cases.items()), "x string, want string").select("x", "want", T.without_footer(F.col("x")).alias("got")).collect()
    assert [(r["x"], r["got"]) for r in got] == [(r["x"], r["want"]) for r in got]
    assert spark.range(1).select(T.without_footer(F.lit(None).cast("string")).alias("x")).first()["x"] is None


def test_recognition_by_name(spark):
    rows = [("2010 pi/TAI CUESTIONARIO.pdf", 9, 9000, True), ("2010 pi/TAI CUESTIONARIO.pdf", 2, 10, False), ("2019/TAI CUESTIONARIO.pdf", 9, 9000, False), ("2019/x.pdf", 9, 10, True), ("2010/RESPUESTAS cuestionario.pdf", 9, 9000, False),
            ("2010/Cuestionario y respuestas.pdf", 9, 9000, True), ("2010/Plantilla cuestionario.pdf", 9, 9000, False), ("2018 libre/TAI LIBRE 2018.pdf", 9, 9000, True), ("2018/x.pdf", 9, 9000, False)]
    got = spark.createDataFrame(rows, "path string, pages int, chars int, want boolean").select("want", A.needs_recognition(F.col("path"), F.col("pages"), F.col("chars")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_manifest(spark):
    s = X.sections(spark)
    total = {r["exam_id"]: r["n"] for r in s.groupBy("exam_id").agg(F.sum("n").alias("n")).collect()}
    assert len(total) == 24 and sum(n == 135 for n in total.values()) == 5 and total["2005-libre"] == 153
    assert s.groupBy("exam_id", "section").count().where("count > 1").count() == 0
    have = X.grid(s).where("not (exam_id = '2019-libre' and section = 'first' and number in (3, 4))")
    cov = {r["exam_id"]: r for r in X.coverage(s, have.union(have.limit(5)).union(spark.createDataFrame([("2019-libre", "first", 99)], "exam_id string, section string, number int"))).collect()}
    assert cov["2019-libre"]["missing"] == "first:3,first:4" and cov["2019-libre"]["extracted"] == 133 and all(r["missing"] == "" for k, r in cov.items() if k != "2019-libre")


BANK = "item_id string, exam_id string, section string, number long, prompt string, options array<string>, answer string, topic string, block string, units int, method string, status string, reason string, active boolean"
EXTRA = "item_id string, number long, prompt string, options array<string>, answer string, status string, reason string, active boolean"


def test_merge_is_all_or_nothing(spark, tmp_path):
    bank = spark.createDataFrame([("x:1", "x", "first", 1, "p", ["o"], "a", "I.1", "I", 1, "m", "valid", "", True), ("x:2", "x", "first", 2, "q", ["o"], None, "I.1", "I", 1, "m", "valid", "", True)], BANK)
    row = lambda i, n, a: (i, n, f"new {n}", ["o"], a, "outdated", "r", False)
    good = spark.createDataFrame([row("x:1", 1, "a"), row("x:2", 2, "c"), row(None, 7, "d")], EXTRA)
    got = {r["item_id"]: r for r in G.merged(bank, good, "extra", "I.9").collect()}
    assert {k: (r["prompt"], r["answer"], r["topic"], r["exam_id"], r["action"]) for k, r in got.items()} == {
        "x:1": ("new 1", "a", "I.9", "x", "updated"), "x:2": ("new 2", "c", "I.9", "x", "updated"), "extra:first:7": ("new 7", "d", "I.9", "extra", "inserted")}
    for bad, said in ((row("x:1", 1, "b"), "x:1: contradicts"), (row("x:9", 1, "b"), "x:9: unknown"), (row("x:2", 1, "b"), "x:2: twice")):
        out = G.merged(bank, good.union(spark.createDataFrame([bad], EXTRA)).where("true" if said.endswith("twice") else "item_id is null or number <> 1 or prompt = 'new 1'"), "extra", "I.9")
        out = out if not said.endswith("contradicts") else G.merged(bank, spark.createDataFrame([bad, row(None, 8, "a")], EXTRA), "extra", "I.9")
        with pytest.raises(Exception, match=said):
            out.write.parquet(f"{tmp_path}/{said[4:]}")
        assert not os.path.exists(f"{tmp_path}/{said[4:]}/_SUCCESS")
    assert G.merged(bank, good.limit(0), "extra", "I.9").where("action = 'kept'").count() == 2
    assert tuple(G.coverage_row(good, "extra").first()) == ("extra", 1, 1, 1, 2)


ATTEMPTS = "user_id long, attempt_id string, finished timestamp, outcomes array<struct<item_id:string,outcome:string>>"
DAY = dt.datetime(2026, 1, 1)


def attempts(spark, *rows):
    return spark.createDataFrame([(u, a, DAY + dt.timedelta(days=n), [(i, o) for i, o in outs]) for u, a, n, outs in rows], ATTEMPTS)


def shown(store):
    return {(r["user_id"], r["item_id"]): (r["seen"], r["correct"], r["wrong"], r["last_seen"].day) for r in W.progress(store).collect()}


def test_attempts_count_once(spark, tmp_path):
    store = W.Store(spark, f"file://{tmp_path}/s", 4)
    first = attempts(spark, (1, "t1", 1, [("q", "correct"), ("r", "blank")]), (1, "t1", 0, [("q", "wrong")]), (2, "t1", 2, [("q", "wrong")]), (1, "bad", 3, [("x" * 181, "wrong")]), (None, "t", 1, [("q", "wrong")]))
    W.record(store, first, 0)
    want = {(1, "q"): (1, 0, 1, 1), (2, "q"): (1, 0, 1, 3)}  # of a repeated attempt the first to finish counts
    assert shown(store) == want
    W.record(store, first, 0)
    W.record(store, first, 1)
    assert shown(store) == want and store.current().batch == 1
    W.record(store, attempts(spark, (1, "t2", 5, [("q", "correct")])), 2)
    assert shown(store) == want | {(1, "q"): (2, 1, 1, 6)}
    assert shown(W.Store(spark, f"file://{tmp_path}/none", 4)) == {}


def test_a_step_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    store = W.Store(spark, f"file://{tmp_path}/s", 4)
    W.record(store, attempts(spark, (1, "t1", 1, [("q", "correct")])), 0)
    before, state = shown(store), store.current()
    batch = attempts(spark, (1, "t2", 2, [("q", "wrong")]), (3, "t3", 2, [("z", "wrong")]))

    def killed(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(W.Store, "commit", killed)  # data are written, the manifest isn't
        with pytest.raises(KeyboardInterrupt):
            W.record(store, batch, 1)
    assert shown(store) == before and store.current() == state
    W.record(store, batch, 1)
    assert shown(store) == before | {(1, "q"): (2, 1, 1, 3), (3, "z"): (1, 0, 1, 3)}
    with pytest.raises(W.Conflict):
        store.commit(state, {}, 9)


def test_rebuild_touches_only_what_changed(spark, tmp_path):
    store = W.Store(spark, f"file://{tmp_path}/s", 4)
    state = {f"d{i}": f"text {i}" for i in range(20)}
    built = []

    def run():
        files = spark.createDataFrame([(k, k, v) for k, v in state.items()], "document_id string, path string, cache_key string")

        def make(todo):
            built.append(sorted(r["document_id"] for r in todo.collect()))
            return todo.select("document_id", F.upper("cache_key").alias("v"))

        return W.rebuild(store, files, make, "document_id string, v string")

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names}

    v1, counts = run()
    assert counts == {"new": 20} and len(built[-1]) == 20
    seen = files()
    v2, counts = run()
    assert v2 == v1 and counts == {"same": 20} and files() == seen and len(built) == 1
    state["d3"] = "other"
    v3, counts = run()
    assert counts == {"same": 19, "changed": 1} and built[-1] == ["d3"] and {k for k in v3.parts if v3.parts[k] != v1.parts[k]} == {f"{t}/{b}" for t in ("built", "files") for b in [next(iter({k.split("/")[1] for k in v3.parts if v3.parts[k] != v1.parts[k]}))]}
    del state["d5"]
    _, counts = run()
    assert counts == {"same": 19, "gone": 1} and built[-1] == []
    rows = {r["document_id"]: r["v"] for r in store.read(store.current(), "built", "document_id string, v string").collect()}
    assert rows == {k: v.upper() for k, v in state.items()}


def test_a_lost_file_is_found(spark, tmp_path):
    df = spark.range(1000).select("id", F.array(F.col("id").cast("string")).alias("o")).repartition(4)
    receipt = W.put(df, f"file://{tmp_path}/t")
    assert tuple(W.read_back(spark, receipt, df.schema)[1].first()) == (1000, 1000, True)
    os.remove(tmp_path / "t" / sorted(x for x in os.listdir(tmp_path / "t") if x.endswith(".parquet"))[0])
    r = W.read_back(spark, receipt, df.schema)[1].first()
    assert r["written"] == 1000 and r["stored"] < 1000 and not r["same"]
    other = W.put(df.withColumn("id", F.when(F.col("id") == 7, 8).otherwise(F.col("id"))), f"file://{tmp_path}/u")
    assert other.rows == receipt.rows and other.checksum != receipt.checksum
    assert W.put(df.limit(0), f"file://{tmp_path}/e").rows == 0


def test_scope_is_in_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, v string").write.parquet(f"{tmp_path}/p")
    df = P.own_rows(spark, f"{tmp_path}/p", 1)
    assert [r["v"] for r in df.collect()] == ["a"]
    plan = df.select("v")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,1)" in plan.split("PushedFilters")[1].split("]")[0]
    for nobody in (None, True, "1 or true"):
        with pytest.raises(PermissionError):
            P.own_rows(spark, f"{tmp_path}/p", nobody)


ITEMS = "item_id long, section string, exercise string, block string, reserve boolean, origin string"


def simulate(rows, seed="s", block="IV"):
    """Plain Python over a shuffle by the same hash."""
    import hashlib

    order = lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0])
    used, out = set(), []

    def take(part, n, keep, first=lambda r: False):
        for r in sorted((r for r in rows if r[0] not in used and keep(r)), key=lambda r: (not first(r), order(r)))[:n]:
            used.add(r[0])
            out.append((r[0], part, part == 3 and not first(r)))

    case = lambda r: r[2] == "supuesto_practico" and r[3] == block
    take(0, 80, lambda r: r[1] == "first" and r[5] != "uploaded")
    take(1, 5, lambda r: r[1] == "first_reserve")
    take(2, 20, lambda r: case(r) and not r[4])
    take(3, 5, case, lambda r: bool(case(r) and r[4]))
    return [(*x, i) for i, x in enumerate(out, 1)]


def test_simulation_with_shortages(spark):
    row = lambda i, s, block="IV", reserve=False, origin=None: (i, s, "supuesto_practico" if s.startswith("case") else "primera_parte", block, reserve, origin)
    mixed = [(900 + i, "first", "supuesto_practico", "IV", i % 2 == 0, None) for i in range(30)]  # fit several parts
    full = [row(i, "first") for i in range(100)] + [row(100 + i, "first", origin="uploaded") for i in range(9)] + [row(200 + i, "first_reserve", reserve=True) for i in range(8)]
    full += [row(300 + i, "case_iv") for i in range(40)] + [row(400 + i, "case_iv_reserve", reserve=True) for i in range(7)] + [row(500 + i, "case_iii", "III") for i in range(40)]
    short = [row(i, "first") for i in range(10)] + [row(20, "first", origin="uploaded"), row(30, "case_iv_reserve", reserve=True)] + [row(40 + i, "case_iv") for i in range(23)] + [row(70 + i, "case_iii", "III") for i in range(50)]
    for rows in (full, short, full + mixed, mixed, short[:12], [(1, "first", None, None, None, None)]):
        got = sorted((tuple(r) for r in P.exam_simulation(spark.createDataFrame(rows, ITEMS), "s", "IV").collect()), key=lambda r: r[3])
        assert [tuple(x) for x in got] == simulate(rows)
    assert P.exam_simulation(spark.createDataFrame([], ITEMS), "s", "IV").count() == 0


def test_first_reading_wins(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0, "low", "x"), (1, "a", 1, 1, "high", "y"), (1, "a", 2, 1, "high", "z"), (1, "a", 2, 2, "over", "w")], "doc_id int, section string, number int, priority int, reading string, prompt string")
    repairs = spark.createDataFrame([(1, "a", 1, "r"), (1, "a", 9, "s")], "doc_id int, section string, number int, prompt string")
    cells = lambda **k: sorted((r["number"], r["reading"], r["prompt"]) for r in RD.resolved(rows, ["doc_id", "section", "number"], **k).collect())
    assert cells() == [(1, "low", "x"), (2, "high", "z")]
    assert cells(repairs=repairs) == [(1, "low", "x"), (2, "high", "z"), (9, "repair", "s")]
    assert cells(overrides=["high", "over"]) == [(1, "high", "y"), (2, "over", "w")]


def test_readings_are_aligned_apart(spark):
    q = lambda n, p: (1, 1, n, p, ["a"], 1, n)
    kind = "doc_id int, segment int, number int, prompt string, options array<string>, page int, order int"
    thin = spark.createDataFrame([q(1, "thin 1"), q(2, "thin 2")], kind)
    one, two = spark.createDataFrame([q(1, "one 1"), q(3, "one 3")], kind), spark.createDataFrame([q(2, "two 2"), q(3, "two 3")], kind)
    every = RD.together([("embedded", thin), ("one", one), ("two", two)])
    cells = RD.cells(RD.without_thin(every, "embedded", 3), [("first", 4)])
    got = RD.resolved(cells, ["doc_id", "section", "number"])
    assert sorted((r["number"], r["reading"], r["question"]["prompt"]) for r in got.collect()) == [(1, "one", "one 1"), (2, "two", "two 2"), (3, "one", "one 3")]


def test_progress_rows_move_once(spark, tmp_path):
    plans = {}

    class Seen(W.Store):
        def write(self, df, table, *rest, **more):
            plans[table] = df._jdf.queryExecution().executedPlan().toString()
            return super().write(df, table, *rest, **more)

    store = Seen(spark, f"file://{tmp_path}/store", 4)
    schema = "user_id long, attempt_id string, finished timestamp, outcomes array<struct<item_id:string,outcome:string>>"
    for n, said in enumerate(("correct", None, "wrong")):
        rows = [(u, f"{u}-{n}", dt.datetime(2026, 1, 1 + n), [("a", said), ("b", "blank")]) for u in range(40)]
        W.record(store, spark.createDataFrame(rows, schema), n)
    got = {(r["user_id"], r["item_id"]): (r["seen"], r["correct"], r["wrong"], r["last_seen"].day) for r in W.progress(store).collect()}
    assert got == {(u, i): (3, int(i == "a"), int(i == "a"), 3) for u in range(40) for i in "ab"}
    assert plans["progress"].count("Exchange") == 1
