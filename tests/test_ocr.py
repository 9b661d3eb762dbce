"""Readings of damaged text, on small literal cases."""

from itembank.operators import exam as E
from itembank.operators import ocr


def test_strict_reading():
    text = "1. ¿Qué es la red?\na) uno b) dos\nc) tres d) cuatro\nPágina 1 de 9\n422) Indique el valor\na. w b. x c. y d. z\n3. no options here\n\f\n1. Otra de las\nA) p B) q C) r D) s"
    got = ocr.embedded(text)
    assert [(q.segment, q.number, q.prompt, q.options, q.page) for q in got] == [
        (1, 1, "¿Qué es la red?", ["uno", "dos", "tres", "cuatro"], 1), (1, 2, "Indique el valor", ["w", "x", "y", "z"], 1), (2, 1, "Otra de las", ["p", "q", "r", "s"], 1)]
    assert ocr.embedded("") == [] == ocr.relaxed("") == ocr.chain("")


def test_damaged_markers():
    text = "7. Señale la opción de la lista\na) uno\nhb) dos\n€) tres\n0d) cuatro\n8. Indique qué es\na) w\nb) x\ne) y\nd) z\n"
    for read in (ocr.relaxed, ocr.chain):
        assert [(q.number, q.options) for q in read(text)] == [(7, ["uno", "dos", "tres", "cuatro"]), (8, ["w", "x", "y", "z"])]
    # an unreadable number is inferred by the chain
    broken = text.replace("8. Indique", "%. Indique")
    assert [q.number for q in ocr.chain(broken)] == [7, 8]


def test_alignment_and_runs():
    assert ocr.align(list("abcd")) == (8, [0, 1, 2, 3]) and ocr.align(list("xabc?d"))[0] == 8 and ocr.align(list("abc"))[1] == []
    assert ocr.runs_of_four(list("abab?dcabcd")) == [[2, 3, 4, 5], [7, 8, 9, 10]]
    assert ocr.quality("¿Qué es?", True) == -100 and ocr.quality("¿Qué es la red de datos que se usa?", True) > 4 and ocr.quality("12 34 56 78 ¿ 90 12 34", True) < 0
    assert [ocr.label(t) for t in ("aj", "ec)", "0d.", "O)", "zz", "¢")] == ["a", "c", "d", "?", "?", "c"]


def test_readings_in_spark(spark):
    text = "1. ¿Qué es la red?\na) uno b) dos\nc) tres d) cuatro"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text), (4, "Instrucciones")], "doc_id long, text string")
    first = ocr.extract(docs, "embedded")
    assert sorted(str(r["doc_id"]) for r in first.collect()) == ["1", "None"]
    assert ocr.no_instructions(first).count() == 2
    assert ocr.extract(docs.limit(0), "chain").count() == 0


def test_transcript_quirks():
    head, opts = "PRIMERA PARTE — Preguntas 1 a 80", "  A) a\n  B) b\n  C) c\n  D) d\n"
    end = "  RESPUESTA CORRECTA: B)\n"
    # a start doesn't end the question before it; one without an answer is lost, unless a header or the end follows
    q = E.questions_of(f"{head}\n1. lost one\n{opts}2. kept one\n more of it\n{opts} tail\n{end}3. last\n{opts}")
    assert [(x[0], x[1], x[2], x[4]) for x in q] == [("first", 2, "kept one more of it", "b"), ("first", 3, "last", None)] and q[0][3] == ["a", "b", "c", "d tail"]
    # the header closes a question under the section it was in; the next start belongs to the new one
    q = E.questions_of(f"{head}\n1. one\n{opts}SUPUESTO I — Preguntas 1 a 20\n=====\n1. two\n{opts}{end}")
    assert [(x[0], x[4]) for x in q] == [("first", None), ("case_iii", "b")]
    # an announcement inside a line sets the section but closes nothing; letters' order isn't checked
    q = E.questions_of(f"see SUPUESTO II — Preguntas de reserva\n1. one\n  B) x\n  A) y\n{end}")
    assert q == [("case_iv_reserve", 1, "one", ["x", "y"], "b")] and E.questions_of("") == []


def test_the_chain_is_the_longest_path():
    """Against every way to choose line marks, on texts with damaged numbers, markers and prompts."""
    from itertools import combinations

    import random

    r = random.Random(4)
    for _ in range(60):
        text = "".join(
            f"\n{r.choice(['%', i + 1, i + 1, i + 1, 1])}. {r.choice(['¿Qué es la red de datos?', '¿Cuál es la que señale?', '12 34'])}\n{r.choice(['a)', 'aj)', 'x)'])} uno\nb) dos\n{r.choice(['c)', '€)', 'e)'])} tres\n{r.choice(['d)', '0d'])} cuatro"
            for i in range(r.randint(1, 4)))
        marked = ocr.Marked(text, ocr.DAMAGED, ocr.align)
        nodes = [m for m in ocr.re.finditer(ocr.LINE_MARK, text) if m[1].rstrip(".)") not in set("abcdABCD")]
        said = [ocr.number(m[1]) for m in nodes]

        def worth(i, end, nodes=nodes, marked=marked, said=said, text=text):
            score, four = marked.four(nodes[i].end(), end)
            return ocr.quality(text[nodes[i].end() : four[0][0]], said[i] is not None) if score >= ocr.GOOD else -100

        def score(path, nodes=nodes, said=said):
            total = {1: 20, None: 5}.get(said[path[0]], 0)
            for a, b in zip(path, path[1:], strict=False):
                w = worth(a, nodes[b].start())
                if w < ocr.GOOD or total < 0:
                    return None
                x, y = said[a], said[b]
                total += 100 + w + (5 if x is not None and y == x + 1 else 2 if x is not None and x >= 10 and y == 1 else 0 if y is None else -5)
            return total if total > 0 and worth(path[-1], len(text)) >= ocr.GOOD else None

        every = [s for n in range(1, len(nodes) + 1) for p in combinations(range(len(nodes)), n) if (s := score(p)) is not None] if len(nodes) <= 12 else None
        got = [nodes.index(next(n for n in nodes if n.start() == m.start())) for m in ocr.longest_chain(marked)]
        if every is not None:
            assert (score(got) if got else None) == (max(every) if every else None)


def exam_text(n, damaged=False):
    one = lambda k: f"\n{k}. ¿Cuál es la norma de la red número {k} de que se trata?\na) uno\nb) dos\nc) tres\n{'0d.' if damaged else 'd)'} cuatro"
    return "".join(one(k) for k in range(1, n + 1))


def test_chain_looks_at_few_prompts(monkeypatch):
    seen, quality = [], ocr.quality
    monkeypatch.setattr(ocr, "quality", lambda *a: seen.append(a) or quality(*a))
    text = exam_text(60).replace("\na)", "\naj)").replace("\nb)", "\nhb").replace("\nc)", "\n€)")
    assert [q.number for q in ocr.chain(text)] == [*range(1, 61)]
    assert len(seen) < 150  # of some 240 line marks with a span that could be a question


def test_several_readings_at_once(spark):
    docs = spark.createDataFrame([(1, exam_text(3)), (2, None)], "doc_id long, text string")
    names = ["embedded", "chain", "relaxed"]
    every = {(r["reading"], r["priority"], r["number"], r["prompt"]) for r in ocr.extract_each(docs, names).collect()}
    assert every == {(n, i, r["number"], r["prompt"]) for i, n in enumerate(names) for r in ocr.extract(docs, n).collect()} and len(every) == 9


def test_transcripts_are_parsed_in_slices(spark, monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, run, schema: seen.append(run) or df)
    E.parse_txt(spark.createDataFrame([(1, "x")], "exam_id long, text string"))
    text = "PRIMERA PARTE — Preguntas 1 a 80\n1. what is it\n  A) a\n  B) b\n  C) c\n  D) d\n  RESPUESTA CORRECTA: A)"
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([text] * 500)], names=["exam_id", "text"])
    out = [*seen[0]([batch])]
    assert max(b.num_rows for b in out) <= 64 and sum(b.num_rows for b in out) == 500


def test_only_some_columns_are_parsed(spark):
    docs = spark.createDataFrame([(1, "PRIMERA PARTE — Preguntas 1 a 80\n1. what\n  A) a\n  RESPUESTA CORRECTA: A)"), (2, None)], "exam_id long, text string")
    some = E.parse_txt(docs, only=["section", "answer"])
    assert some.columns == ["exam_id", "section", "answer"] and [tuple(r) for r in some.collect()] == [(1, "first", "a")]
