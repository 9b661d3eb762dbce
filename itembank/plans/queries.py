"""Queries over the fixture tables, each with equivalent SQL where SQL can express it.

``items`` are documents: the first line is the prompt, the next four the options, the source is the
exam, the language the block, ``doc_id % 10`` gives the section; labels are the answer key.
Outcomes are line items by return flag, activity is events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itembank.functions import text as T
from itembank.operators import bank as B
from itembank.operators import classify as C
from itembank.operators import segment as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The fixtures' lexicon (a parameter of the operators): topics of blocks I to IV in order.
LEXICON = [
    ("I.1", ["the thing", "tion", "with"]), ("I.2", ["thether", "ingest", "and that"]), ("II.1", ["ciónes", "mente", "que los"]), ("II.2", ["llado", "osque"]),
    ("III.1", ["eaux", "ment que"]), ("III.2", ["éelle", "tre de"]), ("IV.1", ["keit", "ung der"]), ("IV.2", ["schaft", "heiten", "über"]),
]
OUTDATED = [("ley 6/1997", "repealed"), ("trash", "withdrawn"), ("stupid", "withdrawn too")]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    sec = F.col("doc_id") % 10
    block = F.when(F.col("lang") == "en", "I").when(F.col("lang") == "es", "II").when(F.col("lang") == "fr", "III").otherwise("IV")
    section = F.when(sec <= 5, "first").when(sec == 6, "first_reserve").when(sec == 7, "case_iii").when(sec == 8, "case_iv").otherwise("case_iv_reserve")
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("seq"), F.col("source").alias("exam"), block.alias("block"), section.alias("section"), F.get(lines, F.lit(0)).alias("prompt"), F.slice(lines, 2, 4).alias("options"), "text", "n_chars")


ITEMS = """with items as (select doc_id as item_id, doc_id as seq, source as exam, case lang when 'en' then 'I' when 'es' then 'II' when 'fr' then 'III' else 'IV' end as block,
  case when doc_id % 10 <= 5 then 'first' when doc_id % 10 = 6 then 'first_reserve' when doc_id % 10 = 7 then 'case_iii' when doc_id % 10 = 8 then 'case_iv' else 'case_iv_reserve' end as section,
  string_split(text, chr(10))[1] as prompt, string_split(text, chr(10))[2:5] as options, text, n_chars from documents),
"""


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Items with the answer of the labels: toxic is annulled, else quality 0 and 1 are a and b."""
    key = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, "anulada").when(F.col("quality") == 0, "a").otherwise("b").alias("answer"))
    return items(spark, d).join(key, "item_id", "left")


KEYED = ITEMS + """keyed as (select i.*, case when l.doc_id is null then null when toxic = 1 then 'anulada' when quality = 0 then 'a' else 'b' end as answer from items i left join labels l on l.doc_id = i.item_id),
"""


def sql_fold(x: str) -> str:
    return f"strip_accents(replace(lower({x}), 'ß', 'ss'))"


def sql_sig(x: str) -> str:
    return f"regexp_replace({sql_fold(x)}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = F.when(F.col("l_returnflag") == "A", "correct").when(F.col("l_returnflag") == "R", "wrong").otherwise("blank")
    return table(spark, d, "lineitem").withColumn("outcome", o)


def activity(spark: SparkSession, d: str) -> DataFrame:
    o = F.when(F.col("event_type") == "click", "correct").when(F.col("event_type") == "error", "wrong").when(F.col("event_type") == "view", "blank").when(F.col("event_type") == "purchase", "toggle")
    return table(spark, d, "events").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("question"), o.alias("outcome")).where("outcome is not null")


ACT = """with act as (select event_id, ts, user_id, (props->>'k')::bigint as question, case event_type when 'click' then 'correct' when 'error' then 'wrong' when 'view' then 'blank' when 'purchase' then 'toggle' end as outcome
  from events where event_type in ('click', 'error', 'view', 'purchase')),
prog as (select user_id, question, count(*) filter (outcome in ('correct', 'wrong', 'blank')) as seen, count(*) filter (outcome = 'correct') as correct, count(*) filter (outcome = 'wrong') as wrong,
  max(ts) filter (outcome in ('correct', 'wrong', 'blank')) as last, count(*) filter (outcome = 'toggle') % 2 = 1 as favorite from act group by 1, 2)
"""


# Scalars


@query(f"select doc_id, md5({sql_fold('text')}) as folded from documents")
def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query(f"select doc_id, md5({sql_sig('text')}) as sig from documents")
def signature_full(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.signature(F.col("text"))).alias("sig"))


@query(f"select doc_id, left({sql_sig('text')}, 160) as sig from documents")
def signature_160(spark, d):
    return table(spark, d, "documents").select("doc_id", T.signature(F.col("text"), "txt").alias("sig"))


@query(ITEMS + "x as (select 1) select item_id, regexp_replace(regexp_replace(regexp_replace(prompt, '\u00ad', '', 'g'), '[\\s\u00a0]+', ' ', 'g'), '^[ \\-–]+|[ \\-–]+$', '', 'g') as prompt from items")
def clean_prompt(spark, d):
    return items(spark, d).select("item_id", T.clean(F.col("prompt")).alias("prompt"))


@query("select page_id, md5(array_to_string(list_filter(string_split(html, chr(10)), lambda l: not regexp_matches(lower(l), '^\\s*(?:-?\\s*\\d+\\s*-?|page \\d+.*|https?://\\S+)\\s*$')), chr(10))) as kept from pages")
def strip_noise_lines(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_noise_lines(F.col("html"))).alias("kept"))


@query("select doc_id, (length(left(text, n_chars // 2)) - length(replace(left(text, n_chars // 2), chr(10), '')) + 1)::bigint as page from documents")
def page_of_offset(spark, d):
    return table(spark, d, "documents").select("doc_id", T.page_of_offset(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int"), "\n").alias("page"))


@query("select doc_id, left(sha1(source || ':' || doc_id), 12) as document_id, left(sha256(text), 16) as cache_key from documents")
def hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.document_id(F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("document_id"), T.cache_key(F.col("text").cast("binary")).alias("cache_key"))


@query("select l_orderkey, l_partkey, chr((97 + l_linenumber % 4)::int) as letter, printf('%02d:%02d', (l_partkey // 60)::bigint, (l_partkey % 60)::bigint) as clock, count(*) as n from lineitem group by all")
def letters_and_clock(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", T.option_letter(F.col("l_linenumber") % 4).alias("letter"), T.mmss(F.col("l_partkey")).alias("clock")).groupBy("l_orderkey", "l_partkey", "letter", "clock").agg(F.count("*").alias("n"))


@query(ITEMS + f"x as (select 1) select item_id, regexp_replace(regexp_replace({sql_fold('prompt')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from items")
def slug(spark, d):
    return items(spark, d).select("item_id", T.slug(F.col("prompt")).alias("slug"))


@query("with p as (select o_orderkey, printf('%.2f', o_totalprice::decimal(18, 2)::double) as s from orders), w as (select o_orderkey, split_part(s, '.', 1) as w, split_part(s, '.', 2) as f from p) select o_orderkey, case when length(w) >= 5 then left(w, -3) || '.' || right(w, 3) else w end || ',' || f as price from w")
def format_score(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.number_es(F.col("o_totalprice").cast("decimal(18,2)").cast("double")).alias("price"))


# Segments


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
  t as (select doc_id, case when regexp_matches(line, '^\\s*$') then 'blank' when regexp_matches(line, '(?i)^\\s*(?:section|part|block)\\b') then 'header' when regexp_matches(line, '(?i)^\\s*answer\\s*:\\s*[a-d]') then 'answer'
    when regexp_matches(line, '(?i)^\\s*[a-d]\\s*[).]\\s') then 'option' when regexp_matches(line, '^\\s*\\d{1,3}\\s*[.)-]\\s') then 'start' else 'text' end as kind from l)
  select doc_id, kind, count(*) as n from t group by 1, 2""")
def line_types(spark, d):
    return S.lines_of(table(spark, d, "documents")).groupBy("doc_id", S.line_type(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


TURNS = "with l as (select conv_id as doc_id, turn as line_no, role, text as line from conversations)\n"


def turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), "role", F.col("text").alias("line"))


@query(TURNS + "select doc_id, line_no, sum((role = 'user')::bigint) over (partition by doc_id order by line_no, line rows unbounded preceding)::bigint as segment from l")
def line_segments(spark, d):
    return S.segments(turns(spark, d), F.col("role") == "user").select("doc_id", "line_no", "segment")


@query(TURNS + "select doc_id, line_no, last_value(case when role = 'user' then line end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as section from l")
def asof_section(spark, d):
    return S.section_as_of(turns(spark, d), F.col("role") == "user").select("doc_id", "line_no", "section")


NUMS = "with n as (select l_suppkey as k, l_orderkey as o, max(l_linenumber) as number from lineitem group by 1, 2)\n"


def numbers(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("o")).agg(F.max("l_linenumber").alias("number"))


@query(NUMS + ", f as (select *, (number <= lag(number) over w and (number <= 5 or number < lag(number) over w - 10)) as fresh from n window w as (partition by k order by o)) select k, o, sum(coalesce(fresh, false)::bigint) over (partition by k order by o rows unbounded preceding)::bigint as segment from f")
def restart_segments(spark, d):
    return S.restart_segments(numbers(spark, d), "k", ["o"], "number").select("k", "o", "segment")


@query("with p as (select distinct l_suppkey as k, l_partkey as number from lineitem), w as (select *, lead(number) over (partition by k order by number) as before from p) select k, number as after, before from w where before > number + 1")
def gap_detect(spark, d):
    return S.gaps(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("number")), "k", "number")


@query()
def number_repair(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_suppkey").cast("int"))).alias("numbers"))
    return g.select("l_orderkey", F.to_json(S.repaired(F.col("numbers"))).alias("repaired"))


@query("""with t as (select doc_id, unnest(string_split(text, ' ')) as token from documents), n as (select *, lower(trim(regexp_replace(trim(token), '[.),/;:]+$', ''))) as t from t),
  m as (select doc_id, case when t in ('a','b','c','d') then t when t in ('aj','bj','cj','dj') then left(t, 1) when t in ('hb','bh') then 'b' when t in ('ec','e','€','£','<','¢','ç','ce','cc','cl') then 'c' when t in ('dd','od','0d') then 'd' else '?' end as label from n)
  select doc_id, label, count(*) as n from m group by 1, 2""")
def marker_labels(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token"))
    return t.select("doc_id", S.marker_label(F.col("token")).alias("label")).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@query("select doc_id, sum(t.n)::bigint as total, count(*) as numbers from (select doc_id, try_cast(regexp_extract(regexp_replace(trim(token), '[.),;:]+$', ''), '^[0-9]{1,9}$') as int) as n from (select doc_id, unnest(string_split(text, ' ')) as token from documents)) t where n is not null group by 1")
def marker_numbers(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token"))
    return t.select("doc_id", S.marker_number(F.col("token")).alias("n")).where("n is not null").groupBy("doc_id").agg(F.sum("n").cast("long").alias("total"), F.count("*").alias("numbers"))


def boxes(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).cast("int").alias("page"), (F.col("l_partkey") % 400).cast("int").alias("x"), (F.col("l_orderkey") % 600).cast("int").alias("y"), F.col("l_returnflag").alias("token")).distinct()


@query()
def cluster_columns(spark, d):
    return S.column_clusters(boxes(spark, d))


@query("""with b as (select distinct (l_suppkey % 50)::int as page, (l_partkey % 400)::int as x, (l_orderkey % 600)::int as y, l_returnflag as token from lineitem)
  select page, y as line, min(x) as "left", min(y) as top, string_agg(token, ' ' order by x, token) as text from b group by 1, 2""")
def layout_lines(spark, d):
    return S.layout_lines(boxes(spark, d).select("page", F.col("y").alias("line"), F.col("x").alias("left"), F.col("y").alias("top"), F.col("token").alias("word")))


# Classification and status


def sql_scores() -> str:
    parts = []
    for i, (topic, terms) in enumerate(LEXICON):
        s = " + ".join(f"case when contains(p, '{t}') then {60 + min(40, len(t))} when contains(a, '{t}') then 20 else 0 end" for t in map(C.T_fold_py, terms))
        parts.append(f"select item_id, '{topic}' as topic, {i} as topic_ord, ({s})::int as score from f")
    folded = f"f as (select item_id, {sql_fold('prompt')} as p, {sql_fold(chr(34) + 'all' + chr(34))} as a from (select item_id, prompt, prompt || ' ' || array_to_string(options, ' ') as \"all\" from items)),\n"
    return folded + "scores as (" + " union all ".join(parts) + "),\n"


RANKED = ITEMS + sql_scores() + """ranked as (select item_id, topic, score, score - lead(score) over w as margin, row_number() over w as k from scores window w as (partition by item_id order by score desc, topic_ord)),
best as (select item_id, topic, score, margin, case when score > 0 then least(19600, 11200 + 35 * score + 25 * coalesce(margin, 0)) else 6000 end::int as units, case when score > 0 then 'rules' else 'fallback' end as method from ranked where k = 1)
"""


@query(ITEMS + sql_scores() + "x as (select 1) select * from scores")
def classify_scores(spark, d):
    return C.score_topics(items(spark, d), LEXICON)


@query(RANKED + "select item_id, topic, score, margin from best")
def classify_top1(spark, d):
    return C.ranked(items(spark, d), LEXICON).select("item_id", "topic", "score", "margin")


@query(RANKED + "select item_id, topic, units, method from best")
def classify_confidence(spark, d):
    return C.classify(items(spark, d), LEXICON)


@query(RANKED + ", dec as (select doc_id as item_id, 'IV.2' as topic from labels where toxic = 1), ov as (select doc_id as item_id, 'I.2' as topic from labels where quality = 0) select item_id, coalesce(dec.topic, ov.topic, best.topic) as topic, case when dec.topic is null and ov.topic is null then units else 20000 end::int as units, case when dec.topic is not null then 'decision' when ov.topic is not null then 'override' else method end as method from best left join dec using (item_id) left join ov using (item_id)")
def manual_override(spark, d):
    lab = table(spark, d, "labels")
    dec = lab.where("toxic = 1").select(F.col("doc_id").alias("item_id"), F.lit("IV.2").alias("topic"))
    ov = lab.where("quality = 0").select(F.col("doc_id").alias("item_id"), F.lit("I.2").alias("topic"))
    return C.classify(items(spark, d), LEXICON, dec, ov)


SQL_OUTDATED = "case " + " ".join(f"when contains({sql_fold('text')}, '{t}') then '{r}'" for t, r in OUTDATED) + " end"


@query(ITEMS + f"x as (select 1) select item_id, {SQL_OUTDATED} as reason from items")
def outdated_reason(spark, d):
    return items(spark, d).select("item_id", C.outdated_reason(T.fold(F.col("text")), OUTDATED).alias("reason"))


SQL_ISSUES = """array_to_string(list_filter([case when len(options) <> 4 then 'options' end, case when len(list_filter(options, lambda o: trim(o) = '')) > 0 then 'empty option' end,
  case when trim(prompt) = '' then 'empty prompt' end, case when answer is not null and answer not in ('a','b','c','d') then 'answer' end, case when section is null then 'section' end], lambda x: x is not null), '; ')"""


@query(KEYED + f"x as (select 1) select item_id, {SQL_ISSUES} as issues from keyed")
def validate_issues(spark, d):
    return keyed(spark, d).select("item_id", C.issues(F.col("prompt"), F.col("options"), F.col("answer"), F.col("section")).alias("issues"))


@query(KEYED + f"x as (select item_id, {SQL_ISSUES} as issues, left(prompt, 100) as preview from keyed) select * from x where issues <> ''")
def rejected_rows(spark, d):
    return keyed(spark, d).select("item_id", C.issues(F.col("prompt"), F.col("options"), F.col("answer"), F.col("section")).alias("issues"), F.substring("prompt", 1, 100).alias("preview")).where("issues <> ''")


SQL_QUALITY = """case when regexp_matches(prompt, '(?i)\\bpage \\d+ of \\d+') then 'page_leak' when len(list_filter(options, lambda o: regexp_matches(o, '(?i)(?:^|\\s)[a-d]\\)\\s'))) > 0 then 'nested_option'
  when regexp_matches(prompt, '[*#%]{3,}') then 'noise' when length(prompt) > 2400 or len(list_filter(options, lambda o: length(o) > 1200)) > 0 then 'too_long' end"""


@query(ITEMS + f"x as (select 1) select item_id, {SQL_QUALITY} as reason from items")
def quality_reason(spark, d):
    return items(spark, d).select("item_id", C.quality_reason(F.col("prompt"), F.col("options")).alias("reason"))


def statuses(spark, d, profile):
    i = C.classified(keyed(spark, d), LEXICON)
    s = C.status(profile, F.col("answer"), C.quality_reason(F.col("prompt"), F.col("options")), C.outdated_reason(T.fold(F.col("text")), OUTDATED), F.col("units"))
    return i.withColumn("status", s).withColumn("active", F.col("status") == "valid")


def sql_status(profile: str) -> str:
    pdf = f"when answer = 'anulada' then 'annulled' when {SQL_QUALITY} is not null then 'ocr_review'" if profile == "pdf" else ""
    body = RANKED.replace(ITEMS, KEYED)
    return body + f", st as (select k.*, b.topic, b.units, case when answer is null then 'missing_official_answer' {pdf} when {SQL_OUTDATED} is not null then 'outdated' when units < {C.THRESHOLD[profile]} then 'classification_review' else 'valid' end as status from keyed k join best b using (item_id))\n"


@query(sql_status("pdf") + "select item_id, status, status = 'valid' as active from st")
def status_pdf(spark, d):
    return statuses(spark, d, "pdf").select("item_id", "status", "active")


@query(sql_status("txt") + "select item_id, status, status = 'valid' as active from st")
def status_txt(spark, d):
    return statuses(spark, d, "txt").select("item_id", "status", "active")


@query(sql_status("txt") + "select status, count(*) as n from st group by 1")
def status_counts(spark, d):
    return statuses(spark, d, "txt").groupBy("status").agg(F.count("*").alias("n"))


@query("select doc_id, case when contains(lower(source), 'src1') then 'key' else 'compendium' end as role, n_chars < 5000 as ocr from documents")
def document_roles(spark, d):
    return table(spark, d, "documents").select("doc_id", C.document_role(F.regexp_replace("source", "src1", "plantilla")).alias("role"), C.needs_ocr(F.lit(3), F.col("n_chars"), F.lit(2020)).alias("ocr"))


# Duplicates, joins and merges


@query(ITEMS + f"s as (select length(prompt) % 3 as page, n_chars % 5 as number, left({sql_sig('prompt')}, 160) as sig, item_id from items) select page::bigint as page, number::bigint as number, sig, min(item_id) as item_id from s where length(sig) >= 4 group by 1, 2, 3")
def candidate_dedup(spark, d):
    rows = items(spark, d).select((F.length("prompt") % 3).cast("long").alias("page"), (F.col("n_chars") % 5).alias("number"), "prompt", "seq", "item_id")
    return B.candidate_dedup(rows).select("page", "number", "sig", "item_id")


def sql_dup(profile: str) -> str:
    sig = sql_sig("prompt || ' ' || array_to_string(options, ' ')")
    sig = f"left({sig}, 160)" if profile == "txt" else sig
    return ITEMS + f"s as (select item_id, first_value(item_id) over (partition by {sig} order by seq) as f from items) select item_id, case when f < item_id then f end as duplicate_of from s"


@query(sql_dup("pdf"))
def mark_duplicates_full(spark, d):
    return B.mark_duplicates(items(spark, d), "pdf").select("item_id", "duplicate_of")


@query(sql_dup("txt"))
def mark_duplicates_160(spark, d):
    return B.mark_duplicates(items(spark, d), "txt").select("item_id", "duplicate_of")


GRID = "select distinct source as exam, section, unnest(range(1, 31)) as number from (select distinct source from documents) cross join (values ('first'), ('case_iii')) s(section)"


def specs(spark, d):
    e = table(spark, d, "documents").select(F.col("source").alias("exam")).distinct()
    return e.select("exam", F.explode(F.array(F.lit("first"), F.lit("case_iii"))).alias("section"), F.lit(30).alias("n"))


@query(ITEMS + f"g as ({GRID}), h as (select distinct exam, section, 1 + item_id % 37 as number from items) select exam, section, number::int as number from g anti join h using (exam, section, number)")
def expected_grid_missing(spark, d):
    have = items(spark, d).select("exam", "section", (1 + F.col("item_id") % 37).cast("int").alias("number"))
    return B.missing(B.expected_grid(specs(spark, d)), have)


@query("with u as (select doc_id as id, text, 1 as s from documents union all select item_id, text, 0 from benchmark), r as (select *, row_number() over (partition by id order by s, text) as k from u) select id, s::int as source_no, md5(text) as body from r where k = 1")
def priority_union(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return B.priority_union([a, b], ["id"]).select("id", "source_no", F.md5("text").alias("body"))


@query("select coalesce(d.doc_id, b.item_id) as id, md5(coalesce(b.text, d.text)) as body, case when d.doc_id is null then 'insert' when b.item_id is null then 'keep' else 'update' end as action from documents d full join benchmark b on b.item_id * 7 = d.doc_id".replace("coalesce(d.doc_id, b.item_id)", "coalesce(d.doc_id, b.item_id * 7)"))
def supplement_merge(spark, d):
    extra = table(spark, d, "benchmark").select((F.col("item_id") * 7).alias("id"), "text")
    return B.merge_supplement(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), extra, "id", ["text"]).select("id", F.md5("text").alias("body"), "action")


@query("with e as (select doc_id * 3 as id, ['a', 'b', 'c'][1 + doc_id % 3] as answer from labels), i as (select doc_id as id, case when doc_id % 5 <> 0 then ['a', 'b'][1 + doc_id % 2] end as mine from documents), r as (select e.id, case when i.id is null then 'unknown' when mine <> answer then 'contradicts' end as issue from e left join i using (id) where e.id is not null) select id, issue from r where issue is not null")
def supplement_issues(spark, d):
    letter = lambda n: F.substring(F.lit("abc"), (1 + F.col("doc_id") % n).cast("int"), F.lit(1))
    extra = table(spark, d, "labels").select((F.col("doc_id") * 3).alias("id"), letter(3).alias("answer"))
    have = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, letter(2)).alias("answer"))
    return B.supplement_issues(have, extra, "id", "answer")


@query(KEYED + "x as (select 1) select item_id, section, answer from keyed")
def answer_key_join(spark, d):
    return keyed(spark, d).select("item_id", "section", "answer")


SECTIONS = [("first", 80), ("first_reserve", 5), ("case_iii", 20), ("case_iii_reserve", 5), ("case_iv", 20), ("case_iv_reserve", 5)]


@query("with s as (select * from (values " + ", ".join(f"({i}, '{n}', {c})" for i, (n, c) in enumerate(SECTIONS)) + ") v(ord, section, n)), r as (select *, coalesce(sum(n) over (order by ord rows between unbounded preceding and 1 preceding), 0) as lo from s), p as (select source as exam, row_number() over (partition by source order by doc_id) as pos, quality as answer from labels join documents using (doc_id)) select exam, section, (pos - lo)::bigint as number, answer from p join r on pos > lo and pos <= lo + n")
def split_key(spark, d):
    key = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("exam")), "doc_id")
    stream = key.select("exam", F.row_number().over(Window.partitionBy("exam").orderBy("doc_id")).cast("long").alias("pos"), F.col("quality").alias("answer"))
    sec = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(SECTIONS)], "ord int, section string, n long")
    return B.split_key(stream, sec)


# Aggregates


@query(KEYED + "x as (select 1) select exam, count(*) as extracted, count(answer) as answered, count(distinct section) as sections from keyed group by 1")
def coverage_by_exam(spark, d):
    return keyed(spark, d).groupBy("exam").agg(F.count("*").alias("extracted"), F.count("answer").alias("answered"), F.countDistinct("section").alias("sections"))


@query(ITEMS + "x as (select 1) select exam, " + ", ".join(f"count(*) filter (section = '{s}') as {s}" for s in ("first", "first_reserve", "case_iii", "case_iv", "case_iv_reserve")) + " from items group by 1")
def section_counts(spark, d):
    return items(spark, d).groupBy("exam").agg(*[F.count_if(F.col("section") == s).alias(s) for s in ("first", "first_reserve", "case_iii", "case_iv", "case_iv_reserve")])


@query("select n_nationkey, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by 1")
def topic_distribution(spark, d):
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "nation").select("n_nationkey").join(n, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("select r_name, n_name, count(c_custkey) as n from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by rollup (r_name, n_name)")
def block_rollup(spark, d):
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    dim = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return dim.join(n, "n_nationkey", "left").rollup("r_name", "n_name").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


SCORE = "count(*) filter (l_returnflag = 'A') as correct, count(*) filter (l_returnflag = 'R') as wrong, count(*) filter (l_returnflag not in ('A', 'R')) as blank, count(*) as total, 3 * count(*) filter (l_returnflag = 'A') - count(*) filter (l_returnflag = 'R') as thirds"


@query(f"with s as (select l_orderkey, {SCORE} from lineitem group by 1) select *, thirds * 100.0::double / (3 * total) as percentage from s")
def score_test(spark, d):
    return B.score(outcomes(spark, d), ["l_orderkey"])


@query(f"with s as (select p_brand, {SCORE} from lineitem join part on p_partkey = l_partkey group by 1) select *, thirds * 100.0::double / (3 * total) as percentage from s")
def score_by_topic(spark, d):
    return B.score(outcomes(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"), ["p_brand"])


@query("with r as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as position from orders) select o_custkey, o_orderkey, position, coalesce(upper(nullif(o_orderstatus, 'P')), '—') as answer, (position - 1) between 80 and 84 or position - 1 >= 105 as reserve from r")
def solution_rows(spark, d):
    o = table(spark, d, "orders").withColumn("position", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long"))
    i = F.col("position") - 1
    return o.select("o_custkey", "o_orderkey", "position", F.coalesce(F.upper(F.nullif("o_orderstatus", F.lit("P"))), F.lit("—")).alias("answer"), (i.between(80, 84) | (i >= 105)).alias("reserve"))


@query(ACT + "select * from prog")
def progress_fold(spark, d):
    return B.fold_progress(activity(spark, d))


@query(ACT + ", r as (select *, row_number() over (partition by user_id, question order by event_id) as k from act) select user_id, question, event_id, outcome from r where k = 1")
def record_idempotent(spark, d):
    return B.record_once(activity(spark, d).select("user_id", "question", "event_id", "outcome"), ["user_id", "question"], ["event_id"])


@query(ACT + "select user_id, count(*) filter (seen > 0) as distinct_seen, sum(correct)::double * 100 / greatest(1, sum(correct + wrong)) as accuracy, count(*) filter (wrong > 0) as failed, count(*) filter (favorite) as favorites from prog group by 1")
def dashboard(spark, d):
    p = B.fold_progress(activity(spark, d))
    return p.groupBy("user_id").agg(F.count_if(F.col("seen") > 0).alias("distinct_seen"), (F.sum("correct").cast("double") * 100 / F.greatest(F.lit(1), F.sum(F.col("correct") + F.col("wrong")))).alias("accuracy"), F.count_if(F.col("wrong") > 0).alias("failed"), F.count_if("favorite").alias("favorites"))


@query(ACT + ", r as (select *, row_number() over (partition by user_id order by wrong desc, question) as rank from prog where wrong > 0) select user_id, question, wrong, rank from r")
def mistakes_queue(spark, d):
    p = B.fold_progress(activity(spark, d)).where("wrong > 0")
    return p.select("user_id", "question", "wrong", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("wrong"), "question")).cast("long").alias("rank"))


@query(ACT + "select user_id, max(event_id) as event_id, arg_max(outcome, event_id) as outcome from act group by 1")
def last_attempt(spark, d):
    return activity(spark, d).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("outcome", "event_id").alias("outcome"))


@query(ACT + "select distinct year(ts)::int as year from act")
def year_facet(spark, d):
    return activity(spark, d).select(F.year("ts").alias("year")).distinct()


@query("select user_id, event_id, (props->>'k')::bigint as k, json_type(props) as kind from events".replace(", json_type(props) as kind", ""))
def json_props(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


# Exploring and sampling


@query(sql_status("txt") + f"select item_id, block, status from st where contains({sql_fold('prompt')}, 'the') and block in ('I', 'IV') and status in ('missing_official_answer', 'classification_review', 'ocr_review')")
def explorer_filter(spark, d):
    return B.explore(statuses(spark, d, "txt"), text="the", blocks=["I", "IV"], status="pending").where(T.fold(F.col("prompt")).contains("the")).select("item_id", "block", "status")


@query(ITEMS + ACT.replace("with act", "act") + ", q as (select question as item_id, sum(seen) as seen, sum(wrong) as wrong from prog group by 1) select item_id from items left join q using (item_id) where coalesce(seen, 0) = 0")
def eligible_unseen(spark, d):
    p = B.fold_progress(activity(spark, d)).groupBy(F.col("question").alias("item_id")).agg(F.sum("seen").alias("seen"), F.sum("wrong").alias("wrong"), F.bool_or("favorite").alias("favorite"))
    return B.eligible(items(spark, d), p, "unseen").select("item_id")


@query("with r as (select doc_id as item_id, row_number() over (order by md5('seed:' || doc_id), doc_id) as rank from documents) select * from r where rank <= 20")
def sample_seeded(spark, d):
    return B.sample(table(spark, d, "documents").select(F.col("doc_id").alias("item_id")), "seed", 20)


STRATA = [("first", 80), ("first_reserve", 5), ("case_iii", 20), ("case_iv_reserve", 5)]


@query(ITEMS + "o as (select item_id, section, md5('sim:' || item_id) as h from items), r as (select *, row_number() over (partition by section order by h, item_id) as k from o), s as (select item_id, h, case section " + " ".join(f"when '{n}' then {i}" for i, (n, _) in enumerate(STRATA)) + " end as block from r where " + " or ".join(f"(section = '{n}' and k <= {c})" for n, c in STRATA) + "), f as (select item_id, h, 4 as block, row_number() over (order by h, item_id) as k from o anti join s using (item_id)), u as (select item_id, h, block, false as filler from s union all select item_id, h, block, true from f where k <= 110 - (select count(*) from s)) select item_id, block::int as block, filler, row_number() over (order by block, h, item_id) as position from u")
def simulation(spark, d):
    return B.simulation(items(spark, d), "sim", STRATA, "section")


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as position from orders) select * from r")
def historical_order(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")).cast("long").alias("position"))


@query("with s as (select unnest([5, 3, 999999999, 8]) as item_id, unnest([0, 1, 2, 3]) as pos) select s.pos::int as pos, s.item_id::bigint as item_id, d.source from s join documents d on d.doc_id = s.item_id")
def resolve_spec(spark, d):
    spec = spark.createDataFrame([([5, 3, 999999999, 8],)], "ids array<bigint>")
    return B.resolve_spec(spec, table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source"))


# Imports and synchronisation


def uploads(spark, d):
    q = F.struct(F.concat(F.lit("q-"), F.col("turn").cast("string")).alias("id"), F.when(F.col("role") == "user", "t1").otherwise("t9").alias("topic"), F.col("text").alias("prompt"), F.array(F.lit("1"), F.lit("2"), F.lit("3"), F.col("role")).alias("options"), F.lit("a").alias("answer"))
    schema = "struct<id:string,topic:string,prompt:string,options:array<string>,answer:string>"
    return table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.lit("title").alias("title"), F.from_json(F.to_json(q), schema).alias("q"))


@query("with u as (select conv_id as source_id, 'q-' || turn as id, role, text, count(*) over (partition by conv_id, turn) as n from conversations) select source_id, id, array_to_string(list_filter([case when n > 1 then 'repeated id' end, case when role <> 'user' then 'topic' end, case when length(regexp_replace(text, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')) not between 1 and 3000 then 'prompt' end], lambda x: x is not null), '; ') as issues from u")
def upload_validate(spark, d):
    return B.validate_uploads(uploads(spark, d), spark.createDataFrame([("t1",), ("t2",)], "topic string"))


@query("select 'uploaded:' || conv_id || ':q-' || turn as item_id, row_number() over (partition by conv_id order by turn) as ordinal from conversations")
def upload_unnest(spark, d):
    g = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("source_id")).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return g.select("source_id", F.posexplode("turns").alias("p", "turn")).select(F.concat(F.lit("uploaded:"), F.col("source_id").cast("string"), F.lit(":q-"), F.col("turn").cast("string")).alias("item_id"), (F.col("p") + 1).cast("long").alias("ordinal"))


HALVES = "with c as (select user_id, max(ts) as updated, max(event_id) as payload from events where event_type in ('click', 'view') group by 1), s as (select user_id, max(ts) as updated, max(event_id) as payload from events where event_type = 'error' and value > 30 group by 1)"


@query(HALVES + ", j as (select coalesce(c.user_id, s.user_id) as user_id, least(c.updated, timestamp '2024-01-15 00:05:00') as cu, s.updated as su, c.payload as cp, s.payload as sp, c.user_id is null as noc, s.user_id is null as nos from c full join s on c.user_id = s.user_id), a as (select *, case when noc then 'downloaded' when nos then 'created' when cu > su then 'uploaded' else 'downloaded' end as action from j) select user_id, action, case when action = 'downloaded' then sp else cp end as payload from a")
def lww_sync(spark, d):
    e = table(spark, d, "events")
    half = lambda x: e.where(x).groupBy("user_id").agg(F.max("ts").alias("updated"), F.max("event_id").alias("payload"))
    return B.sync_lww(half("event_type in ('click', 'view')"), half("event_type = 'error' and value > 30"), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("user_id", "action", "payload")


@query("with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) select user_id, event_type, event_id, value from r where k = 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return B.upsert_latest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("with i as (select user_id, event_id from events where event_type = 'click'), n as (select user_id, count(*) as n from i group by 1) select i.user_id, event_id, case when n > 15 then 'too many items' when i.user_id in (select user_id from events where event_type = 'error' and value > 60) then 'the account has progress' end as refused from i join n using (user_id)")
def import_guard(spark, d):
    e = table(spark, d, "events")
    return B.import_guard(e.where("event_type = 'click'").select("user_id", "event_id"), e.where("event_type = 'error' and value > 60"), most=15)


@query("select event_id, value from events where user_id = 7")
def row_scope(spark, d):
    return table(spark, d, "events").where("user_id = 7").select("event_id", "value")


@query(sql_status("txt") + "select unnest(['id', 'options', 'answer', 'block', 'active']) as rule, unnest([count(*) - count(distinct item_id), count(*) filter (len(options) <> 4), count(*) filter (answer not in ('a', 'b', 'c', 'd')), count(*) filter (not starts_with(topic, block || '.')), count(*) filter (status = 'valid' and (answer is null or units < 13600))]) as n from st")
def dq_violations(spark, d):
    s = statuses(spark, d, "txt")
    one = s.agg(
        (F.count("*") - F.countDistinct("item_id")).alias("id"), F.count_if(F.size("options") != 4).alias("options"), F.count_if(~F.col("answer").isin("a", "b", "c", "d")).alias("answer"),
        F.count_if(~F.col("topic").startswith(F.concat("block", F.lit(".")))).alias("block"), F.count_if(F.col("active") & (F.col("answer").isNull() | (F.col("units") < 13600))).alias("active"))
    return one.unpivot([], ["id", "options", "answer", "block", "active"], "rule", "n")
