"""Layouts read by coordinates, their marks by definition, and the alignment to a plan."""

import itertools
import json
import random
import re
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from itembank.operators import layout as L
from itembank.sources import files


def line(top, *words):
    return (float(top), " ".join(t for _, t in words).ljust(7), [(float(x), float(top), t) for x, t in words])


def question(top, number, prompt, marks="a) b) c) d)", step=10):
    lines = [line(top, (40, number), (130, prompt))]
    return lines + [line(top + step * (i + 1), (90, m), (130, f"{prompt}{i}")) for i, m in enumerate(marks.split())]


def page(no, *parts):
    return (no, 1000.0, 1000.0, [x for p in parts for x in p])


def read(spark, *pages):
    docs = spark.createDataFrame([(1, list(pages))], f"doc_id long, pages {L.PAGES}")
    return [(q["segment"], q["number"], q["prompt"], q["options"], q["page"], q["inferred"]) for q in L.layout_questions(docs).collect()]


def test_numbers_are_read_recovered_and_repaired(spark):
    got = read(spark, page(1, question(100, "1.", "uno"), question(200, "A", "dos"), question(300, "3.", "tres", "a) b) € 0d)"), question(400, "422.", "cuatro"), question(500, "1.", "otra"), question(600, "2.", "mala", "a) b)")))
    assert [(s, n, p, i) for s, n, p, _, _, i in got] == [(1, 1, "uno", False), (1, 2, "dos", True), (1, 3, "tres", False), (1, 4, "cuatro", False), (2, 1, "otra", False)]
    assert got[1][3] == ["dos0", "dos1", "dos2", "dos3"] and got[2][3] == ["tres0", "tres1", "tres2", "tres3"]


def test_leading_gap_first_page_and_instructions(spark):
    cover = page(1, [line(100, (40, "9."), (130, "Portada con texto"))])
    body = page(2, question(100, "%", "cero"), question(200, "2.", "dos"), question(300, "3.", "Instrucciones finales"), question(400, "4.", "cuatro"), question(500, "5.", "cinco"), question(600, "6.", "seis"), [line(990, (40, "7."), (130, "below the content"))])
    got = read(spark, cover, body)
    assert [(n, p, i) for _, n, p, _, _, i in got] == [(1, "cero", True), (2, "dos", False), (4, "cuatro", False), (5, "cinco", False), (6, "seis", False)]
    assert {x[4] for x in got} == {2}


def test_hard_layouts(spark):
    docs = [(1, None), (2, []), (3, [(1, None, None, None)]), (4, [(1, 0.0, 0.0, [])]), (5, [(1, 1000.0, 1000.0, [(None, None, None), (50.0, None, [(None, None, None)])])]), (None, [page(1, question(100, "1.", "uno"), question(200, "2.", "dos"))])]
    df = spark.createDataFrame(docs, f"doc_id long, pages {L.PAGES}")
    assert [(r["doc_id"], r["number"]) for r in L.layout_questions(df).collect()] == [(None, 1), (None, 2)]
    assert L.layout_questions(df.limit(0)).count() == 0


def test_marks_by_definition(spark):
    rng = random.Random(5)
    tokens = ["1.", "12", "1234", "a)", "b", "C.", "word", "|", "€", "e", "O)", "x", "ab", "0d)", "3", "", "ñu"]
    pages = [(p, 1000.0, 800.0, [(float(top), "t" * rng.choice([3, 9]), [(rng.choice([10.0, 30.0, 50.0, 71.9, 72.0, 300.0]), rng.choice([5.0, float(top)]), rng.choice(tokens)) for _ in range(rng.randint(0, 5))]) for top in rng.sample(range(0, 800), 40)]) for p in (1, 2)]
    want = []
    for no, width, height, lines in pages:
        for top, text, words in lines:
            if not words or not height * 0.025 <= top <= height * 0.98:
                continue
            started = False
            for i, (left, y, t) in enumerate(words):
                can = not started and all(x < width * 0.072 for x, _, _ in words[: i + 1]) and left >= width * 0.03 and bool(re.fullmatch(r"\d{1,3}", t.rstrip(".),;:"))) and len(text) >= 7
                started |= can
                mark = re.fullmatch(r"([a-dA-DOo]|ce|CE|Cc|CC|cl|CL|od|0d|OD|€|£|<|¢|e|E|ç|[1-4])\s*" + ("[.)/]?" if i == 0 else "[.)/]"), t)
                noise = i > 0 and re.fullmatch("[a-dA-D]", t) and not any(re.search("[A-Za-zñÑ]{2,}", x) for _, _, x in words[:i])
                want.append((no, t, height * 0.025 <= y <= height * 0.98, i == 0, width * 0.03 <= left < width * 0.072, can, left >= width * 0.072 and bool(mark or noise)))
    stored = spark.createDataFrame([(None,), ([],), (pages,), (pages[:1],)], f"pages {L.PAGES}").toArrow()["pages"].combine_chunks()
    none, empty, whole, one = map(L.marked_words, L.nested(stored))
    assert none == empty == [] and one == [w for w in whole if w.page == 1]
    assert [(w.page, w.text, w.shown, w.head, w.banded, w.start, w.option) for w in whole] == want


def test_texts_are_looked_at_once(spark):
    # marks are made for whole columns: a text that comes in many documents and lines is read once
    body = page(1, question(100, "1.", "uno"), question(200, "2.", "dos"), [(300.0, None, [(None, 300.0, " uno "), (50.0, None, None)]), (None, "no place", [(40.0, 5.0, "3.")])])
    stored = spark.createDataFrame([([body],), ([body, body],), (None,), ([body],)] * 5, f"pages {L.PAGES}").toArrow()["pages"].combine_chunks()
    L._read.cache_clear()
    rows = [L.marked_words(w) for w in L.nested(stored)]
    texts = {" uno ", "", *"1. 2. 3. uno dos a) b) c) d) uno0 uno1 uno2 uno3 dos0 dos1 dos2 dos3".split()}
    assert (L._read.cache_info().misses, L._read.cache_info().hits) == (len(texts), 0)
    assert [len(r) for r in rows] == [22, 44, 0, 22] * 5 and rows[1] == rows[0] * 2 and rows[4:8] == rows[:4]
    assert [(w.text, w.shown, w.head, w.banded, w.start, w.option) for w in rows[0][-2:]] == [("uno", True, True, False, False, False), ("", False, False, True, False, False)]


def test_longest_common_is_longest():
    rng = random.Random(7)
    for _ in range(200):
        a, b = [rng.randint(1, 4) for _ in range(rng.randint(0, 7))], [rng.randint(1, 4) for _ in range(rng.randint(0, 7))]
        got = L.longest_common(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
        in_b = lambda s: all(x in it for it in [iter(b)] for x in s)
        longest = max(n for n in range(len(a) + 1) if any(in_b(s) for s in itertools.combinations(a, n)))
        assert len(got) == longest


def test_alignment_fills_gaps(spark):
    # the second section was read before the first one's end: only its segment can fill it
    items = [(1, 1), (2, 1), (1, 2), (2, 2), (3, 1)]
    got = L.placed(items, [("one", 3), ("two", 2)])
    assert [x[:2] for x in got] == [("one", 1), ("one", 2), ("one", 3), ("two", 1), ("two", 2)]
    assert sorted(x[3] for x in got).count("missing") == 0 and len({x[2] for x in got}) == 5
    # a large section takes segments until its numbers reach 65 %
    got = L.placed([(1, 1), (2, 1), (1, 2), (8, 2), (1, 3)], [("big", 10), ("small", 2)])
    assert [(x[0], x[1]) for x in got if x[2] is not None] == [("big", 1), ("big", 2), ("big", 8), ("small", 1)]
    df = spark.createDataFrame([(1, 1, 5, 1, 1, "x", 0), (1, 1, 9, None, None, "y", 0), (1, 2, 1, 2, 1, "z", 0), (None, 1, 1, 1, 1, "w", 0)], "doc long, page int, order int, number int, segment int, ref string, extra int")
    rows = {(r["doc"], r["section"], r["number"]): (r["ref"], r["how"]) for r in L.aligned(df, [("one", 3)], "doc", "ref").collect()}
    assert rows == {(1, "one", 1): ("x", "aligned"), (1, "one", 2): ("z", "aligned"), (1, "one", 3): (None, "missing"), (None, "one", 1): ("w", "aligned"), (None, "one", 2): (None, "missing"), (None, "one", 3): (None, "missing")}
    assert L.aligned(df.limit(0), [("one", 3)], "doc", "ref").count() == 0


def test_legacy_snapshot(spark):
    a, p = spark.createDataFrame([("t1", 5)], "id string, n int"), spark.createDataFrame([("q2", 1), ("q1", 0)], "questionId string, wrong int")
    now = F.lit("2024-01-01T00:00:00Z")
    one = files.legacy_snapshot(a, p, now).first()
    assert json.loads(one["attempts"]) == [{"id": "t1", "n": 5}] and [x["questionId"] for x in json.loads(one["progress"])] == ["q1", "q2"] and one["schemaVersion"] == 1
    assert files.legacy_snapshot(a.limit(0), p.limit(0), now).count() == 0 and files.legacy_snapshot(a.limit(0), p, now).count() == 1


def test_references_pass_through(spark):
    rows = spark.createDataFrame([(1, "x", 1, 5, 2, 1, ("p", [1])), (1, "x", 1, 4, 1, 1, ("q", [2])), (1, "y", 1, 4, 9, 1, ("r", [3]))], "k int, reading string, page int, order int, number int, segment int, ref struct<a:string,b:array<int>>")
    got = {(r["k"], r["reading"], r["number"], r["ref"] and r["ref"]["a"], r["how"]) for r in L.aligned(rows, [("s", 2)], ["k", "reading"], "ref").collect()}
    assert got == {(1, "x", 1, "q", "aligned"), (1, "x", 2, "p", "aligned"), (1, "y", 1, None, "missing"), (1, "y", 2, None, "missing")}


def without_offsets(kind):
    """An array without rows whose buffers can't be read."""
    import pyarrow as pa

    nothing = pa.foreign_buffer(8, 0)
    if pa.types.is_list(kind):
        return pa.Array.from_buffers(kind, 0, [None, nothing], children=[without_offsets(kind.value_type)])
    if pa.types.is_struct(kind):
        return pa.Array.from_buffers(kind, 0, [None], children=[without_offsets(f.type) for f in kind])
    return pa.Array.from_buffers(kind, 0, [None, *[nothing] * (2 if pa.types.is_string(kind) else 1)])


def read_without_offsets():
    import pyarrow as pa

    from itembank.functions import workers

    words = pa.list_(pa.struct([("left", pa.float64()), ("top", pa.float64()), ("text", pa.string())]))
    lines = pa.list_(pa.struct([("top", pa.float64()), ("text", pa.string()), ("words", words)]))
    pages = without_offsets(pa.struct([("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("lines", lines)]))
    column = pa.Array.from_buffers(pa.list_(pages.type), 2, [None, pa.py_buffer(bytes(12))], children=[pages])
    (cut,) = workers.slices([pa.RecordBatch.from_arrays([column], names=["pages"])])
    assert [w.texts for w in L.nested(cut.column(0))] == [[], []]


def test_arrays_without_rows_need_no_offsets():
    # a worker that reads them may crash, so in a process of its own
    root = Path(__file__).resolve().parents[1]
    code = f"import sys; sys.path[:0] = [{str(root)!r}, {str(root / 'tests')!r}]; import test_layout; test_layout.read_without_offsets()"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_batches_are_cut():
    import pyarrow as pa

    from itembank.functions import workers

    b = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 5000)], names=["text"])
    cut = [*workers.slices([b], 64, 20_000)]
    assert max(c.num_rows for c in cut) <= 20 and pa.Table.from_batches(cut).num_rows == 5000
