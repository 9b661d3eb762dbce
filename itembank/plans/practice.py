"""More queries over the fixture tables: transcripts, practice, audits and uploads, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from itembank.functions import stage
from itembank.functions import text as T
from itembank.operators import audit as A
from itembank.operators import exam as E
from itembank.operators import layout as L
from itembank.operators import practice as P
from itembank.operators import store as W
from itembank.operators import uploads as U
from itembank.plans.queries import ACT, KEYED, LEXICON, SECTIONS, activity, items, keyed, query, sql_fold, sql_status, statuses, table
from itembank.operators import bank as B

# Transcripts: lines of documents dressed as an exam's, a section every 56 lines, answers on most.

HEADERS = ["PRIMERA PARTE — Preguntas 1 a 80", "PRIMERA PARTE - Preguntas de reserva", "SUPUESTO I – Preguntas 1 a 20", "SUPUESTO I — Preguntas de reserva", "SUPUESTO II — Preguntas 1 a 20", "see SUPUESTO II — Preguntas de reserva"]
SQL_SCRIPT = (
    "script as (select doc_id as exam_id, array_to_string(list_transform(w, lambda l, i: case when (i - 1) % 56 = 3 then ["
    + ", ".join(f"'{h}'" for h in HEADERS)
    + "][1 + ((i - 1) // 56) % 6] when (i - 1) % 7 = 0 then ((i - 1) // 7 + 1) || '. ' || l when (i - 1) % 7 between 1 and 4 then '  ' || ['A', 'B', 'C', 'D'][(i - 1) % 7] || ') ' || l"
    " when (i - 1) % 7 = 6 and i % 5 <> 0 then '  RESPUESTA CORRECTA: ' || ['A', 'B', 'C', 'D'][1 + i % 4] || ')' when (i - 1) % 7 = 5 and i % 4 = 0 then '-----' else l end), chr(10)) as text"
    " from (select doc_id, string_split(text, ' ') as w from documents))"
)


def scripts(spark, d, *also):
    heads, letters = F.array(*[F.lit(h) for h in HEADERS]), F.array(*[F.lit(x) for x in "ABCD"])
    dressed = lambda w, i: (
        F.when(i % 56 == 3, F.get(heads, (F.floor(i / 56) % 6).cast("int"))).when(i % 7 == 0, F.concat((F.floor(i / 7) + 1).cast("string"), F.lit(". "), w)).when((i % 7).between(1, 4), F.concat(F.lit("  "), F.get(letters, i % 7 - 1), F.lit(") "), w))
        .when((i % 7 == 6) & ((i + 1) % 5 != 0), F.concat(F.lit("  RESPUESTA CORRECTA: "), F.get(letters, (i + 1) % 4), F.lit(")"))).when((i % 7 == 5) & ((i + 1) % 4 == 0), "-----").otherwise(w)
    )
    return table(spark, d, "documents").select(F.col("doc_id").alias("exam_id"), F.array_join(F.transform(F.split("text", " "), dressed), "\n").alias("text"), *also)


def sql_patterns() -> str:
    at = " ".join(f"when regexp_matches(line, '{p}') then '{k}'" for k, p, *_ in E.SECTIONS)
    return f"""{SQL_SCRIPT},
  ln as (select exam_id, unnest(range(0, len(l))) as no, unnest(l) as line from (select exam_id, string_split(text, chr(10)) as l from script)),
  kd as (select *, case {at} end as sec, case when regexp_matches(line, '{E.HEADER}') then 'header' when regexp_matches(trim(line), '{E.SEPARATOR}') then 'separator' when regexp_matches(line, '{E.ANSWER}') then 'answer'
    when regexp_matches(line, '{E.OPTION}') then 'option' when regexp_matches(line, '{E.START}') then 'start' when regexp_replace(line, '\\s', '', 'g') = '' then 'blank' else 'text' end as kind from ln),"""


SQL_QUESTIONS = sql_patterns() + f"""
  sp as (select *, last_value(sec ignore nulls) over (partition by exam_id order by no rows between unbounded preceding and 1 preceding) as above,
    coalesce(sum((kind in ('header', 'answer'))::int) over (partition by exam_id order by no rows between unbounded preceding and 1 preceding), 0) as span from kd),
  st as (select exam_id, span, max(no) filter (kind = 'start') as s, any_value(case when kind = 'answer' then lower(regexp_extract(line, '{E.ANSWER}', 1)) end) as answer from sp group by 1, 2 having s is not null),
  pt as (select sp.exam_id, sp.span, no, kind, line, st.s, st.answer, sum((kind = 'option')::int) over (partition by sp.exam_id, sp.span order by no) as o from sp join st on st.exam_id = sp.exam_id and st.span = sp.span and no >= s and kind in ('start', 'option', 'text')),
  pc as (select exam_id, span, o, string_agg(case kind when 'start' then regexp_extract(line, '{E.START}', 2) when 'option' then regexp_extract(line, '{E.OPTION}', 2) else trim(line) end, ' ' order by no) as t from pt group by 1, 2, 3),
  q as (select st.exam_id, regexp_extract(h.line, '{E.START}', 1)::int as number, h.above as section, (select trim(regexp_replace(t, '\\s+', ' ', 'g')) from pc where pc.exam_id = st.exam_id and pc.span = st.span and o = 0) as prompt,
    coalesce((select list(trim(t) order by o) from pc where pc.exam_id = st.exam_id and pc.span = st.span and o > 0), []) as options, st.answer, row_number() over (partition by st.exam_id order by st.s) - 1 as position from st join sp h on h.exam_id = st.exam_id and h.no = st.s)
"""


def questions(spark, d, only=None):
    return E.parse_txt(scripts(spark, d), only=only)


@query("with " + SQL_QUESTIONS + "select exam_id, number, section, md5(prompt) as prompt, array_to_string(options, '|') as options, answer from q")
def parse_txt(spark, d):
    return questions(spark, d).select("exam_id", "number", "section", F.md5("prompt").alias("prompt"), F.array_join("options", "|").alias("options"), "answer")


@query("with " + sql_patterns() + " x as (select 1) select exam_id, kind, count(*) as n, count(sec) as announced from kd group by 1, 2")
def transcript_lines(spark, d):
    lines = scripts(spark, d).select("exam_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("exam_id", E.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"), F.count(E.section_of(F.col("line"))).alias("announced"))


@query("with " + SQL_QUESTIONS + """select exam_id, number, section, array_to_string(list_filter([case when section is null then 'no section' end, case when len(options) <> 4 then len(options) || ' options' end,
  case when len(list_filter(options, lambda o: trim(o) = '')) > 0 then 'empty option' end, case when trim(prompt) = '' then 'empty prompt' end, case when answer not in ('a', 'b', 'c', 'd') then 'answer' end], lambda x: x is not null), '; ') as issues from q""")
def import_contract(spark, d):
    return E.accepted(questions(spark, d)).select("exam_id", "number", "section", "issues")


SQL_SPECS = "specs as (select * from (values " + ", ".join(f"('{k}', {n})" for k, n in E.EXPECTED) + ") v(section, expected))"


@query("with " + SQL_QUESTIONS + f""", {SQL_SPECS}, c as (select exam_id, section, count(*) as n, count(answer) as a from q where section is not null group by 1, 2),
  g as (select e.exam_id, s.section, s.expected from (select distinct exam_id from q) e cross join specs s), m as (select g.exam_id, g.section, unnest(range(1, g.expected + 1)) as number from g),
  gap as (select m.exam_id, string_agg(m.section || ':' || m.number, ',' order by m.section, m.number) as missing from m anti join q on q.exam_id = m.exam_id and q.section = m.section and q.number = m.number group by 1),
  t as (select g.exam_id, sum(g.expected)::bigint as expected, coalesce(sum(n), 0)::bigint as extracted, coalesce(sum(a), 0)::bigint as answered, coalesce(string_agg(c.section || ':' || n, ',' order by c.section), '') as section_counts from g left join c on c.exam_id = g.exam_id and c.section = g.section group by 1)
  select t.*, coalesce(missing, '') as missing from t left join gap using (exam_id)""")
def coverage_txt(spark, d):
    return E.coverage(questions(spark, d, ["number", "section", "answer"]))


@query("with " + SQL_QUESTIONS + f", {SQL_SPECS} select e.exam_id, s.section, (select count(*) from q where q.exam_id = e.exam_id and q.section = s.section) as n, s.expected::bigint as expected, (select count(*) from q where q.exam_id = e.exam_id and q.section = s.section) = s.expected as ok from (select distinct exam_id from q) e cross join specs s")
def section_integrity(spark, d):
    return A.section_integrity(questions(spark, d, ["section"]))


@query("with " + SQL_QUESTIONS + "select exam_id, count(*) as questions, count(answer) as answered, " + ", ".join(f"count(*) filter (section = '{k}') as {k}" for k, _ in E.EXPECTED) + " from q group by 1")
def exam_summaries(spark, d):
    return E.exam_summary(questions(spark, d, ["section", "answer"]))


# Practice: a customer's orders are attempts, their line items the questions (parts) with an answer.

LETTERS = "['a', 'b', 'c', 'd']"
SQL_ATTEMPTS = f"""att as (select l_orderkey as attempt_id, list_distinct(list(l_partkey)) as ids, map_from_entries(list_distinct(list(struct_pack(k := l_partkey, v := {LETTERS}[1 + l_partkey % 4]) ) filter (l_partkey % 5 <> 0))) as answers from lineitem group by 1),
  it as (select p_partkey as item_id, p_brand as topic, case when p_partkey % 11 = 0 then 'anulada' when p_partkey % 13 = 0 then null else {LETTERS}[1 + p_size % 4] end as answer from part),
  o1 as (select attempt_id, unnest(list_sort(ids)) as item_id, unnest(range(0, len(ids))) as pos, answers from att),
  oc as (select attempt_id, pos, o1.item_id, topic, case when answers[o1.item_id] is null then 'blank' when answers[o1.item_id] = it.answer then 'correct' else 'wrong' end as outcome from o1 join it on it.item_id = o1.item_id)
"""


def parts(spark, d):
    key = F.when(F.col("p_partkey") % 11 == 0, "anulada").when(F.col("p_partkey") % 13 == 0, F.lit(None)).otherwise(F.get(F.array(*map(F.lit, "abcd")), (F.col("p_size") % 4).cast("int")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("topic"), key.alias("answer"))


def attempts(spark, d):
    pair = F.struct(F.col("l_partkey").alias("k"), F.get(F.array(*map(F.lit, "abcd")), (F.col("l_partkey") % 4).cast("int")).alias("v"))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.sort_array(F.collect_set("l_partkey")).alias("item_ids"), F.collect_set(F.when(F.col("l_partkey") % 5 != 0, pair)).alias("a"))
    return g.select("attempt_id", "item_ids", F.map_from_entries("a").alias("answers"))


@query("with " + SQL_ATTEMPTS + "select attempt_id, pos::int as pos, item_id, topic, outcome from oc")
def attempt_outcomes(spark, d):
    return P.outcomes(attempts(spark, d), parts(spark, d)).select("attempt_id", "pos", "item_id", "topic", "outcome")


@query("with " + SQL_ATTEMPTS + "select attempt_id, topic, count(*) filter (outcome = 'correct') as correct, count(*) filter (outcome = 'wrong') as wrong, count(*) filter (outcome = 'blank') as blank, count(*) as maximum, 3 * count(*) filter (outcome = 'correct') - count(*) filter (outcome = 'wrong') as thirds from oc group by 1, 2")
def attempt_results(spark, d):
    return P.results(P.outcomes(attempts(spark, d), parts(spark, d)), ["attempt_id", "topic"])


@query("with " + SQL_ATTEMPTS + """, t as (select attempt_id, topic, count(*) filter (outcome = 'correct') as c, count(*) filter (outcome = 'wrong') as w, count(*) filter (outcome = 'blank') as b from oc group by 1, 2)
  select attempt_id, '{"correct":' || sum(c) || ',"wrong":' || sum(w) || ',"blank":' || sum(b) || ',"thirds":' || (3 * sum(c) - sum(w)) || ',"maximum":' || sum(c + w + b) || ',"by_topic":[' || string_agg('{"topic":"' || topic || '","correct":' || c || ',"wrong":' || w || ',"blank":' || b || '}', ',' order by topic) || ']}' as result from t group by 1""")
def attempt_records(spark, d):
    return P.attempt_record(attempts(spark, d), parts(spark, d))


@query("with " + SQL_ATTEMPTS + "select attempt_id, item_id, row_number() over (partition by attempt_id order by pos) as place from oc where outcome = 'wrong'")
def review_wrong(spark, d):
    return P.review(P.outcomes(attempts(spark, d), parts(spark, d)), "wrong").select("attempt_id", "item_id", "place")


SQL_WRITES = ACT + """, wr as (select user_id, event_id // 3 as attempt_id, max(ts) as finished, list(struct_pack(item_id := repeat('q', case when question % 50 = 7 then 181 else 1 end) || question, outcome := outcome) order by event_id) as outcomes from act where outcome <> 'toggle' group by 1, 2),
  ck as (select *, case when len(outcomes) > 150 then 'too many outcomes' when len(list_filter(outcomes, lambda o: length(o.item_id) > 180)) > 0 then 'question id' end as issue from wr)"""


def writes(spark, d):
    name = F.concat(F.when(F.col("question") % 50 == 7, F.repeat(F.lit("q"), 181)).otherwise("q"), F.col("question").cast("string"))
    a = activity(spark, d).where("outcome <> 'toggle'")
    return a.groupBy("user_id", F.floor(F.col("event_id") / 3).alias("attempt_id")).agg(F.max("ts").alias("finished"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", name.alias("item_id"), "outcome"))), lambda x: F.struct(x["item_id"].alias("item_id"), x["outcome"].alias("outcome"))).alias("outcomes"))


@query(SQL_WRITES + "select user_id, attempt_id, len(outcomes)::bigint as n, issue from ck")
def attempt_caps(spark, d):
    return P.checked_attempts(writes(spark, d)).select("user_id", "attempt_id", F.size("outcomes").cast("long").alias("n"), "issue")


@query(SQL_WRITES + ", o as (select user_id, finished, unnest(outcomes) as o from ck where issue is null) select user_id, o.item_id as item_id, count(*) as seen, count(*) filter (o.outcome = 'correct') as correct, count(*) filter (o.outcome = 'wrong') as wrong, max(finished) as last_seen from o group by 1, 2")
def attempts_recorded(spark, d):
    w = writes(spark, d)
    return P.recorded(w.unionByName(w))  # every write is sent twice


def full_items(spark, d):
    """Items with all that the filters look at."""
    i = statuses(spark, d, "txt")
    return i.select("item_id", "seq", "prompt", "options", "answer", "exam", "block", "topic", "section", "status", "active", "units", (2015 + F.col("item_id") % 10).cast("int").alias("year"), F.when(F.col("item_id") % 3 == 0, "promocion_interna").otherwise("libre").alias("access"), F.when(F.col("item_id") % 4 == 0, "uploaded").alias("origin"), F.col("section").endswith("reserve").alias("reserve"), (F.col("item_id") % 30 + 1).alias("number"), (F.col("item_id") % 12).alias("page"), F.col("exam").alias("source"))


SQL_FULL = sql_status("txt") + ", fi as (select item_id, seq, prompt, options, answer, exam, block, topic, section, status, status = 'valid' as active, units, (2015 + item_id % 10)::int as year, case when item_id % 3 = 0 then 'promocion_interna' else 'libre' end as access, case when item_id % 4 = 0 then 'uploaded' end as origin, section like '%reserve' as reserve, item_id % 30 + 1 as number, item_id % 12 as page, exam as source from st)"
SQL_PROGRESS = ACT.replace("with act", ", act") + ", pg as (select question as item_id, sum(seen)::bigint as seen, sum(wrong)::bigint as wrong, bool_or(favorite) as favorite from prog group by 1), pu as (select user_id, question as item_id, seen, wrong, favorite from prog)"


def progress(spark, d):
    return B.fold_progress(activity(spark, d)).withColumnRenamed("question", "item_id")


@query(SQL_FULL + f"select item_id from fi where contains({sql_fold('prompt || array_to_string(options, chr(32))').replace('replace(lower', 'replace(lower')}, 'ing') and block in ('I', 'III') and topic in ('I.1', 'I.2', 'III.1') and year in (2016, 2018, 2020) and access = 'libre' and coalesce(origin, 'official') = 'official' order by seq limit 200")
def explorer_page(spark, d):
    return P.explorer_page(full_items(spark, d), text="Ing", blocks=["I", "III"], topics=["I.1", "I.2", "III.1"], years=[2016, 2018, 2020], access=["libre"], origins=["official"]).select("item_id")


@query(SQL_FULL + "select f as facet, count(*) as n from (select unnest(list_filter(['all', case when active then 'active' end, case when answer is not null and answer <> 'anulada' then 'historical' end, case when status in ('missing_official_answer', 'classification_review', 'ocr_review') then 'pending' end], lambda x: x is not null)) as f from fi) group by 1")
def status_facets(spark, d):
    i = full_items(spark, d)
    one = i.agg(*[F.count_if(P.filters(status=s)).alias(s) for s in ("all", "active", "historical", "pending")])
    return one.unpivot([], ["all", "active", "historical", "pending"], "facet", "n")


@query(SQL_FULL + SQL_PROGRESS + " select item_id, 'failed' as pool from fi join pg using (item_id) where wrong > 0 and block in ('I', 'II') and not reserve union all select item_id, 'favorite' from fi join pg using (item_id) where favorite and coalesce(origin, 'official') = 'official' union all select fi.item_id, 'unseen' from fi left join pg using (item_id) where coalesce(seen, 0) = 0 and topic in ('I.1', 'IV.1') and not reserve")
def pools(spark, d):
    i = full_items(spark, d)
    p = progress(spark, d).groupBy("item_id").agg(F.sum("seen").alias("seen"), F.sum("wrong").alias("wrong"), F.bool_or("favorite").alias("favorite"))
    some = lambda kind, **k: P.pool(i, p, kind, **k).select("item_id", F.lit(kind).alias("pool"))
    return some("failed", blocks=["I", "II"]).union(some("favorite", origins=["official"], reserves=True)).union(some("unseen", topics=["I.1", "IV.1"]))


@query(SQL_FULL + ", r as (select item_id, row_number() over (order by md5('t3:' || item_id), item_id) as rank from fi where block = 'I' and not reserve) select * from r where rank <= 25")
def custom_test(spark, d):
    i = full_items(spark, d)
    nothing = spark.createDataFrame([], "item_id long, seen long, wrong long, favorite boolean")
    return P.custom_test(P.pool(i, nothing, "all", blocks=["I"]), "t3", 25)


@query("with s as (select l_orderkey as k, list_distinct(list('t' || l_linenumber)) as sel from lineitem group by 1) select k, array_to_string(list_sort(case when list_has_all(sel, ['t1', 't2', 't3']) then list_filter(sel, lambda x: x not in ('t1', 't2', 't3')) else list_distinct(list_concat(sel, ['t1', 't2', 't3'])) end), ',') as selected from s")
def toggle_block(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.concat(F.lit("t"), F.col("l_linenumber").cast("string"))).alias("sel"))
    return s.select("k", F.array_join(P.toggled_block(F.col("sel"), F.array(F.lit("t1"), F.lit("t2"), F.lit("t3"))), ",").alias("selected"))


@query(SQL_FULL + "select exam, array_to_string(list(item_id order by number, seq), ',') as ids from fi where section in ('first', 'case_iii') group by 1")
def section_tests(spark, d):
    return P.section_test(full_items(spark, d), ["first", "case_iii"]).select("exam", F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(SQL_FULL + SQL_PROGRESS + " select user_id, item_id, wrong, row_number() over (partition by user_id order by wrong desc, item_id) as rank from pu where wrong > 0 and item_id in (select item_id from fi where active)")
def mistakes_active(spark, d):
    return P.mistakes(progress(spark, d), full_items(spark, d))


@query(SQL_FULL + SQL_PROGRESS + " select user_id, count(*) filter (wrong > 0) as failed, count(*) filter (favorite) as favorites, count(*) filter (seen > 0) as seen, (select count(*) from fi where active) - count(*) filter (seen > 0) as unseen from pu where item_id in (select item_id from fi where active) group by 1")
def progress_cards(spark, d):
    return P.cards(progress(spark, d), full_items(spark, d))


@query("select event_id, ts from events order by ts desc, event_id limit 1000")
def newest_events(spark, d):
    return P.newest(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id")


@query("select l_orderkey, l_linenumber, greatest(l_linenumber * 10 * 60 - l_partkey, 0)::bigint as left_s, greatest(l_linenumber * 10 * 60 - l_partkey, 0) < 600 as urgent, count(*) as n from lineitem group by all")
def countdowns(spark, d):
    c = P.countdown(F.col("l_linenumber") * 10, F.col("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("c")).groupBy("l_orderkey", "l_linenumber", F.col("c.left").alias("left_s"), F.col("c.urgent").alias("urgent")).agg(F.count("*").alias("n"))


@query(SQL_FULL + """, tt as (select *, 's' || (item_id % 7) as test_id, row_number() over (partition by item_id % 7 order by item_id) as position from fi),
  ow as (select item_id, 's' || (item_id % 7) as test_id, ['a', 'b'][1 + item_id % 2] as own from fi where item_id % 4 <> 1)
  select tt.test_id, position, coalesce(upper(answer), '—') as answer, coalesce(upper(own), '—') as own, topic, case when origin = 'uploaded' then 'source: ' || source || ' · ' || number else year || ' · ' || access || ' · ' || section || ' ' || number || ' · p. ' || page end as provenance,
  reserve or ((position - 1 between 80 and 84) or position - 1 >= 105) as reserve from tt left join ow using (test_id, item_id)""")
def solution_sheet(spark, d):
    i = full_items(spark, d).withColumns({"test_id": F.concat(F.lit("s"), (F.col("item_id") % 7).cast("string")), "sitting": F.col("access")})
    from pyspark.sql import Window

    i = i.withColumn("position", F.row_number().over(Window.partitionBy("test_id").orderBy("item_id")).cast("long"))
    own = i.where("item_id % 4 <> 1").select("test_id", "item_id", F.get(F.array(F.lit("a"), F.lit("b")), (F.col("item_id") % 2).cast("int")).alias("answer"))
    s = P.solutions(i, own)
    res = i.select("test_id", "position", P.reserve(F.col("reserve"), F.lit("simulation"), F.col("position") - 1).alias("reserve"))
    return s.join(res, ["test_id", "position"])


# Answer keys, inventories and audits

SQL_WORDS = "kw as (select doc_id as doc, unnest(range(0, len(w))) as i, unnest(w) as token from (select doc_id, list_transform(string_split(text, ' '), lambda x, i: case when i % 3 = 0 then (i % 80) || '.' when i % 3 = 1 and i % 4 = 0 then 'ANULADA' when i % 3 = 1 then ['A', 'b', 'C', 'd'][1 + i % 4] when i % 5 = 0 then (i % 90) || ').' || 'B' when i % 7 = 0 then (i % 90) || '.c' else x end) as w from documents))"


def key_words(spark, d):
    w = F.transform(F.split("text", " "), lambda x, j: F.when((j + 1) % 3 == 0, F.concat(((j + 1) % 80).cast("string"), F.lit("."))).when(((j + 1) % 3 == 1) & ((j + 1) % 4 == 0), "ANULADA").when((j + 1) % 3 == 1, F.get(F.array(*map(F.lit, "AbCd")), (j + 1) % 4))
                    .when((j + 1) % 5 == 0, F.concat(((j + 1) % 90).cast("string"), F.lit(").B"))).when((j + 1) % 7 == 0, F.concat(((j + 1) % 90).cast("string"), F.lit(".c"))).otherwise(x))
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(w).alias("i", "token")).select("doc", "i", (F.col("i") % 6 * 50).cast("double").alias("x"), F.floor(F.col("i") / 6).cast("double").alias("y"), "token")


@query("with " + SQL_WORDS + f""", nx as (select *, trim(token) as t, lead(token) over (partition by doc order by i) as nt, lead(i // 6) over (partition by doc order by i) as ny from kw),
  pr as (select doc, i, case when regexp_matches(t, '^(\\d{{1,3}})[.)]\\s*({A.KEY_ANSWER})$') then regexp_extract(t, '^(\\d{{1,3}})', 1) when regexp_matches(t, '^(\\d{{1,3}})[.)]$') and regexp_matches(nt, '^(?:{A.KEY_ANSWER})$') and abs(ny - i // 6) <= 3 then regexp_extract(t, '^(\\d{{1,3}})', 1) end as number,
    case when regexp_matches(t, '^(\\d{{1,3}})[.)]\\s*({A.KEY_ANSWER})$') then regexp_extract(t, '[.)]\\s*({A.KEY_ANSWER})$', 1) else nt end as answer from nx)
  select doc, lower(answer) as answer, count(*) as n, sum(number::int)::bigint as total from pr where number is not null group by 1, 2""")
def answer_pairs(spark, d):
    return A.answer_pairs(key_words(spark, d)).groupBy("doc", "answer").agg(F.count("*").alias("n"), F.sum("number").cast("long").alias("total"))


@query("with kk as (select doc_id as doc, list_transform(range(0, 140 - (doc_id % 9)::int), lambda i: ['a', 'B', 'c', 'D', 'ANULADA'][1 + (i * (1 + doc_id % 4)) % 5]) as k from documents), e as (select doc, unnest(k) as a, unnest(range(0, len(k))) as p from kk), r as (select * from (values " + ", ".join(f"('{n}', {c}, {sum(x for _, x in SECTIONS[:i])})" for i, (n, c) in enumerate(SECTIONS)) + ") v(section, n, lo)) select doc, section, (p - lo + 1)::bigint as number, lower(a) as answer from e join r on p >= lo and p < lo + n")
def literal_key(spark, d):
    n = (140 - F.col("doc_id") % 9).cast("int")
    letter = lambda i: F.get(F.array(F.lit("a"), F.lit("B"), F.lit("c"), F.lit("D"), F.lit("ANULADA")), ((i * (1 + F.col("doc_id") % 4)) % 5).cast("int"))
    keys = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), letter), " ").alias("text"))
    return A.literal_key(keys, spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(SECTIONS)], "ord int, section string, n long"))


@query("with s as (select c_custkey % 40 as doc, row_number() over (partition by c_custkey % 40 order by c_custkey) as pos from customer), n as (select doc, pos, case when pos <= 20 then pos when pos <= 30 and doc % 3 > 0 then pos - 20 else 99 end as number from s where pos <= 30 - (case when doc % 5 = 0 then 1 else 0 end)), g as (select doc, count(*) as have, count(*) filter (number <> case when pos <= 20 then pos when pos <= 30 then pos - 20 else -1 end) as odd from n group by 1) select doc, case when have <> 30 then 'length' when odd > 0 then 'numbers' end as issue from g where have <> 30 or odd > 0")
def key_issues(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("doc"), "c_custkey").withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy("c_custkey")).cast("long"))
    s = s.withColumn("number", F.when(F.col("pos") <= 20, F.col("pos")).when((F.col("pos") <= 30) & (F.col("doc") % 3 > 0), F.col("pos") - 20).otherwise(99)).where(F.col("pos") <= 30 - F.when(F.col("doc") % 5 == 0, 1).otherwise(0))
    return A.key_issues(s, spark.createDataFrame([(0, 20), (1, 10)], "ord int, n long"))


@query("select doc_id % 50 as doc, md5(string_agg(left(text, 40), chr(10) || chr(12) || chr(10) order by doc_id) || chr(10)) as text from documents group by 1")
def joined_pages(spark, d):
    return A.joined_pages(table(spark, d, "documents").select((F.col("doc_id") % 50).alias("doc"), F.col("doc_id").alias("page"), F.substring("text", 1, 40).alias("text"))).select("doc", F.md5("text").alias("text"))


SQL_PATHS = "fp as (select doc_id, case doc_id % 4 when 0 then 'A/Cuestionário ' || (2010 + doc_id % 9) when 1 then 'B/Plantilla' || doc_id when 2 then 'c/Convocatoria ' || (1990 + doc_id % 30) else 'd/otro' || doc_id end || '.psm6.txt' as path, n_chars as chars, doc_id % 5 as pages from documents)"


def paths(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, F.concat(F.lit("A/Cuestionário "), (2010 + i % 9).cast("string"))).when(i % 4 == 1, F.concat(F.lit("B/Plantilla"), i.cast("string"))).when(i % 4 == 2, F.concat(F.lit("c/Convocatoria "), (1990 + i % 30).cast("string"))).otherwise(F.concat(F.lit("d/otro"), i.cast("string")))
    return table(spark, d, "documents").select("doc_id", F.concat(name, F.lit(".psm6.txt")).alias("path"), F.col("n_chars").alias("chars"), (i % 5).alias("pages"))


@query("with " + SQL_PATHS + ", im as (select distinct path from fp where doc_id % 10 = 0) select left(sha1(fp.path), 12) as document_id, fp.path, pages, try_cast(nullif(regexp_extract(fp.path, '20\\d{2}'), '') as int) as year, case when contains(f, 'convocatoria') then 'convocatoria' when contains(f, 'respuesta') or contains(f, 'plant') then 'plantilla' when contains(f, 'cuestionario') then 'cuestionario' else 'recopilatorio' end as role, case when im.path is not null then 'imported' else 'reviewed_reference' end as status, case when pages > 2 and chars < 5000 then 'ocr_cache' else 'embedded' end as text_mode, replace(fp.path, '.psm6.txt', '.layout.json') as layout, not (contains(lower(fp.path), '2007 libre') or contains(lower(fp.path), '2008 pi') or contains(lower(fp.path), '2014 pi')) as high from (select *, " + sql_fold("string_split(path, '/')[-1]") + " as f from fp) fp left join im on im.path = fp.path")
def inventory(spark, d):
    p = paths(spark, d)
    return A.inventory(p, p.where("doc_id % 10 = 0")).withColumns({"layout": A.sidecar(F.col("path"), "layout"), "high": A.needs_high_accuracy(F.col("path"))})


@query("with " + SQL_PATHS + " select case when doc_id % 10 = 0 then 'imported' else 'reviewed_reference' end as status, count(*) as n, sum(chars)::bigint as chars from fp group by 1")
def document_histogram(spark, d):
    p = paths(spark, d).withColumn("status", F.when(F.col("doc_id") % 10 == 0, "imported").otherwise("reviewed_reference"))
    return p.groupBy("status").agg(F.count("*").alias("n"), F.sum("chars").cast("long").alias("chars"))


@query("with p as (select l_suppkey as doc, l_quantity::int as page, count(*) as n from lineitem group by 1, 2), f as (select doc, coalesce(min(page) filter (n >= 3), min(page)) as first_page from p group by 1) select p.doc, first_page, sum(n)::bigint as questions from p join f using (doc) where page >= first_page group by 1, 2")
def page_counts(spark, d):
    return A.page_counts(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_quantity").cast("int").alias("page")), 3)


SQL_TOPICS = "tp as (select * from (values " + ", ".join(f"('{t}', {i})" for i, (t, _) in enumerate(LEXICON)) + ") v(topic, topic_ord))"


def topic_table(spark):
    return spark.createDataFrame([(t, i) for i, (t, _) in enumerate(LEXICON)], "topic string, topic_ord int")


@query(SQL_FULL + f""", {SQL_TOPICS}, so as (select 'src' || i as source, 5 + i % 9 as pages from range(0, 19) r(i)),
  j as (select fi.*, tp.topic as t, so.source as s, so.pages, concat_ws(' ', prompt, array_to_string(options, ' ')) as whole from fi left join tp on tp.topic = fi.topic left join so on so.source = fi.source)
  select unnest(['id', 'options', 'blank_option', 'answer', 'block', 'topic', 'source', 'page', 'active_status', 'active_answer', 'active_confidence', 'active_footer', 'active_nested', 'active_length']) as rule,
  unnest([count(*) - count(distinct item_id), count(*) filter (len(options) <> 4), count(*) filter (len(list_filter(options, lambda o: trim(o) = '')) > 0), count(*) filter (answer not in ('a', 'b', 'c', 'd', 'anulada')), count(*) filter (not starts_with(topic, block || '.')),
    count(*) filter (t is null), count(*) filter (s is null), count(*) filter (not coalesce(page between 1 and pages, false)), count(*) filter (active and status <> 'valid'), count(*) filter (active and not coalesce(answer in ('a', 'b', 'c', 'd'), false)), count(*) filter (active and units < 13600),
    count(*) filter (active and regexp_matches(whole, '{A.PAGE_MARK}')), count(*) filter (active and len(list_filter(options, lambda o: regexp_matches(o, '{A.OPTION_MARK}'))) > 0), count(*) filter (active and (length(prompt) > 2400 or len(list_filter(options, lambda o: length(o) > 1200)) > 0))]) as n from j""")
def validator(spark, d):
    sources = spark.createDataFrame([(f"src{i}", 5 + i % 9) for i in range(19)], "source string, pages int")
    return A.violations(full_items(spark, d), topic_table(spark), sources)


@query("with " + SQL_QUESTIONS + f", {SQL_SPECS}, g as (select e.exam_id, sum(expected) as expected, (select count(*) from q where q.exam_id = e.exam_id and section is not null) as extracted from (select distinct exam_id from q) e cross join specs group by 1) select unnest(['sum', 'gaps', 'stored']) as rule, unnest([((select sum(extracted) from g) <> (select count(*) from q))::bigint, (select count(*) from g), 0]) as n")
def coverage_rules(spark, d):
    receipt = W.put(questions(spark, d), stage.new_dir(spark, "questions"))
    stored, _ = W.read_back(spark, receipt, questions(spark, d).schema)
    return A.coverage_rules(E.coverage(stored), spark.range(receipt.rows), stored)


@query("select unnest(['count', 'pending', 'call', 'version', 'topics', 'blocks']) as rule, unnest([((select count(*) from documents) <> 49)::bigint, (select count(*) from documents where doc_id % 17 = 0), 0, 1, ((select count(*) from nation) <> 33)::bigint, 0]) as n")
def head_rules(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 17 == 0, "reviewed_ocr_required").otherwise("imported").alias("status"))
    meta = spark.createDataFrame([("call", 1)], "official_call string, schema_version int")
    program = table(spark, d, "nation").groupBy((F.col("n_regionkey") + 1).alias("ord")).agg(F.collect_set("n_name").alias("topics")).withColumn("block", F.get(F.array(*map(F.lit, ["I", "II", "III", "IV", "V"])), (F.col("ord") - 1).cast("int")))
    return A.document_rules(docs, 49).union(A.config_issues(meta, program, "call", 33, ["I", "II", "III", "IV", "V"]))


@query(SQL_FULL + f", {SQL_TOPICS}, r as (select 1 as part, '' as name, 0 as no, printf('Questions: %d, active: %d', count(*), count(*) filter (active)) as line from fi union all select 2, status, 0, printf('- %s: %d', status, count(*)) from fi group by status union all select 3, '', topic_ord, printf('- %s: %d', tp.topic, count(fi.item_id)) from tp left join fi on fi.topic = tp.topic and active group by topic_ord, tp.topic) select row_number() over (order by part, name, no) as line_no, line from r")
def report(spark, d):
    return A.report(full_items(spark, d), topic_table(spark)).select(F.row_number().over(Window.orderBy("ord")).cast("long").alias("line_no"), "line")  # a report's lines are few


# Layouts: six words of a document to a line, five lines to a question, thirty lines to a page; every
# fourth number is unreadable, some options too

PLAN = [("first", 12), ("reserve", 5), ("second", 8)]


def layouts(spark, d):
    i, w, count = F.col("doc_id"), F.col("w"), F.col("count")
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("w")).withColumn("count", F.ceil(F.size("w") / 6).cast("int"))

    def line(k):
        at = (k % 5).cast("int")
        q = F.floor(k / 5).cast("int")
        n = F.when(q % 4 == 2, "%").otherwise(F.concat((q % 12 + 1).cast("string"), F.lit(".")))
        letter = F.get(F.array(*map(F.lit, ["a)", "b.", "€", "d)"])), at - 1)
        lead = F.when(at == 0, n).when((i + q) % 9 == 4, F.lit("O)")).otherwise(letter)
        y = (k % 30 * 31 + 100).cast("double")
        word = lambda x, left: F.struct(left.cast("double").alias("left"), y.alias("top"), x.alias("text"))
        six = F.slice(w, k * 6 + 1, 6)
        words = F.concat(F.array(word(lead, F.when(at == 0, 40).otherwise(90))), F.transform(six, lambda x, j: word(x, j * 100 + 120)))
        return F.struct(y.alias("top"), F.concat_ws(" ", lead, six).alias("text"), words.alias("words"))

    last = F.floor((count - 1) / 30).cast("int")
    page = lambda p: F.struct((p + 1).alias("page"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"), F.transform(F.sequence(p * 30, F.least(p * 30 + 29, count - 1)), line).alias("lines"))
    return docs.select("doc_id", F.transform(F.sequence(F.lit(0), last), page).alias("pages"))


@query()
def layout_questions(spark, d):
    return L.layout_questions(layouts(spark, d))


@query()
def section_alignment(spark, d):
    q = L.layout_questions(layouts(spark, d)).withColumn("seq", F.col("order"))
    once = B.candidate_dedup(q.withColumn("page", F.struct("doc_id", "page"))).select("page.doc_id", "page.page", "order", "number", "segment")
    return L.aligned(once, PLAN, "doc_id", "order")


# Uploads: conversations as sources, each turn a question

SQL_SOURCES = """us as (select conv_id as source_no, list(struct_pack(id := case when turn % 6 = 5 then 'Q ' || turn when turn % 4 = 3 then 'q-0' else 'q-' || turn end, topicId := case when role = 'user' then 't1' when turn % 5 = 1 then 't2' else 't9' end, prompt := case when turn % 7 = 6 then '   ' else ' ' || text end,
  options := ['1', case when turn % 9 = 4 then ' ' else '2' end, '3', role], correctAnswer := case when turn % 8 = 2 then 'e' else 'b' end) order by turn, role, text) as qs, max(turn) as m from conversations group by 1)"""


def sources(spark, d):
    t = F.col("turn")
    q = F.struct(
        F.when(t % 6 == 5, F.concat(F.lit("Q "), t.cast("string"))).when(t % 4 == 3, "q-0").otherwise(F.concat(F.lit("q-"), t.cast("string"))).alias("id"), F.when(F.col("role") == "user", "t1").when(t % 5 == 1, "t2").otherwise("t9").alias("topicId"),
        F.when(t % 7 == 6, "   ").otherwise(F.concat(F.lit(" "), F.col("text"))).alias("prompt"), F.array(F.lit("1"), F.when(t % 9 == 4, " ").otherwise("2"), F.lit("3"), F.col("role")).alias("options"), F.when(t % 8 == 2, "e").otherwise("b").alias("correctAnswer"))
    g = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("source_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", q.alias("q")))), lambda x: x["q"]).alias("questions"), F.max("turn").alias("m"))
    s = F.struct(F.when(F.col("m") == 0, 2).otherwise(1).alias("schemaVersion"), F.concat(F.lit("conv-"), F.col("source_no").cast("string")).alias("sourceId"), F.when(F.col("source_no") % 10 == 0, " ").otherwise(" A title ").alias("title"), "questions")
    return U.parsed(g.select("source_no", F.to_json(s).alias("json"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("source_no") * 86400).alias("uploaded_at")))


def up_topics(spark):
    return U.topics_of(spark.createDataFrame([("I", [("t1", "first")]), ("II", [("t2", "second"), ("t3", "third")])], "block string, topics array<struct<id:string,name:string>>"))


def sql_upload_issues(bare: str, length: str) -> str:
    size = lambda x: length.format(x=x, b=bare.format(x=x))
    return f"""with {SQL_SOURCES}, h as (select source_no, -1 as question_no, case when m = 0 then 'schemaVersion' when source_no % 10 = 0 then 'title' when len(qs) not between 1 and 200 then 'questions' end as issue from us),
  q as (select source_no, (unnest(range(0, len(qs))))::int as question_no, unnest(qs) as q, qs from us),
  i as (select source_no, question_no, case when not regexp_matches(q.id, '^[a-z0-9][a-z0-9-]{{0,79}}$') then 'id' when len(list_filter(qs[1:question_no], lambda o: o.id = q.id)) > 0 then 'repeated id' when q.topicId not in ('t1', 't2', 't3') then 'topicId' when {size('q.prompt')} not between 1 and 3000 then 'prompt'
    when len(list_filter(q.options, lambda o: {size('o')} not between 1 and 1500)) > 0 then 'options' when q.correctAnswer not in ('a', 'b', 'c', 'd') then 'correctAnswer' end as issue from q)
  select * from (select * from h union all select * from i) where issue is not null"""


@query(sql_upload_issues("regexp_replace({x}, '^[\\s ]+|[\\s ]+$', '', 'g')", "(case when {b} = '' then 0 else length({x}) end)"))
def upload_issues_client(spark, d):
    return U.issues(sources(spark, d), up_topics(spark))


@query(sql_upload_issues("trim({x})", "length({b})"))
def upload_issues_server(spark, d):
    return U.issues(sources(spark, d), up_topics(spark), "server")


@query(f"with {SQL_SOURCES}, q as (select source_no, unnest(range(0, len(qs))) as p, unnest(qs) as q from us) select 'uploaded:conv-' || source_no || ':' || q.id as item_id, (p + 1)::bigint as number, year(to_timestamp(1700000000 + source_no * 86400) at time zone 'UTC')::int as year, md5(trim(q.prompt)) as prompt, case q.topicId when 't1' then 'I' when 't2' then 'II' else '' end as block, coalesce(case q.topicId when 't1' then 'first' when 't2' then 'second' end, q.topicId) as topic_name, q.correctAnswer as answer from q")
def upload_questions(spark, d):
    t = up_topics(spark)
    return U.with_names(U.canonical(sources(spark, d), t), t).select("item_id", "number", "year", F.md5("prompt").alias("prompt"), "block", "topic_name", "answer")


@query(SQL_FULL + f", {SQL_SOURCES}, u as (select 'official' as origin, count(*) as n, count(distinct exam) as sources from fi union all select 'uploaded', sum(len(qs))::bigint, count(*) from us) select * from u")
def bank_and_uploads(spark, d):
    bank = full_items(spark, d).select(F.col("item_id").cast("string").alias("item_id"), "exam", F.lit("official").alias("origin"), "units")
    every = U.united(bank, U.canonical(sources(spark, d), up_topics(spark)))
    return every.groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("exam").alias("sources"))


@query(f"with {SQL_SOURCES} select count(*) as sources, sum(len(qs))::bigint as questions from us")
def upload_totals(spark, d):
    return U.totals(sources(spark, d))


@query("select event_id, true as is_object, event_id % 3 = 0 and event_id % 2 = 0 as snapshot from events")
def snapshot_guard(spark, d):
    j = F.concat(F.lit('{"schemaVersion":'), F.when(F.col("event_id") % 3 == 0, "1").otherwise("2"), F.lit(',"attempts":[],"progress":'), F.when(F.col("event_id") % 2 == 0, "[1]").otherwise("{}"), F.lit("}"))
    return table(spark, d, "events").select("event_id", U.is_object(j).alias("is_object"), U.snapshot_ok(j).alias("snapshot"))


@query("select o_orderkey, strftime(o_orderdate, '%-d/%-m/%Y') as day, split_part(o_orderpriority, '-', 1) as block from orders")
def dates_es(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.date_es(F.col("o_orderdate")).alias("day"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("block"))
