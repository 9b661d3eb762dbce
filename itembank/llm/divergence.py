"""Quality by distribution divergence, with DataFrame functions only.

A document's histograms of character classes and of its language's most common words are compared
with those of the language as a whole by the Jensen-Shannon distance. Languages' common words and
histograms are counted over all documents. Short documents give noisy histograms, so each
comparison has a least length, and its limit a term that falls with the length.

Spark's SQL functions alone do the work on texts; each text is split twice, once to count words and
once to be judged, and what is joined afterwards are a few dozen numbers a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Common words of a language, and the least number of its documents that make a reference.
COMMON, LEAST_DOCUMENTS = 32, 30
#: Least length, in characters and words, to be compared.
LEAST_CHARS, LEAST_WORDS = 200, 100
#: Largest distances from the language's histograms for texts without end. What chance adds to the
#: square of a distance falls with a text's length: about (common words) / (5.5 * words) for words
#: drawn as the language draws them, and more than that for characters, which come in runs.
MOST_CHARS, MOST_WORDS = 0.20, 0.20
CHANCE_CHARS, CHANCE_WORDS = 30.0, 0.25
#: Shares are added up as whole numbers of this part, so that no order of adding matters.
UNIT = 1_000_000

#: Classes of characters, taken out of a text one after the other; the rest is the last class.
BLANKS = r"\x20\x09-\x0D"
CLASSES = [("lower", "[a-z]+"), ("blank", f"[{BLANKS}]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", r"[#*$%&|<>]+"), ("mark", r"[\x21-\x7E]+"), ("other", None)]


def spent(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{BLANKS}]+", -1), "")


def classed(df: DataFrame) -> DataFrame:
    """``df`` (``text``) with ``chars``, the number of characters of each class of :data:`CLASSES`."""
    left = "text"
    for name, pattern in CLASSES[:-1]:
        # each length is that of what is left, so that the classes share one pass over the whole text
        df = df.withColumn(f"after_{name}", F.regexp_replace(left, pattern, "")).withColumn(f"n_{name}", F.length(left) - F.length(f"after_{name}"))
        left = f"after_{name}"
    df = df.withColumn("chars", F.array(*[F.col(f"n_{n}") for n, _ in CLASSES[:-1]], F.length(left)))
    return df.drop(*[f"{p}_{n}" for n, _ in CLASSES[:-1] for p in ("after", "n")])


def repeated_words(df: DataFrame) -> DataFrame:
    """``df`` (``w``, words) with ``n_repeat_words``: words inside a window of three words that the text has twice.

    Windows whose hashes are alike in 33 bits are found by sorting numbers that end in the window's
    place; only those are sorted by their words, so the count is exact.
    """
    bits = 31
    hashed = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(F.lit(-1 << bits)).bitwiseOR(i.cast("long")))
    df = df.withColumn("packed", F.sort_array(hashed))
    # neighbours whose hashes are alike, as pairs; few texts have many
    twins = F.zip_with("packed", F.slice("packed", F.lit(2), F.size("packed")), lambda x, y: F.when(F.shiftrightunsigned(x.bitwiseXOR(y), bits) == 0, F.array(x, y)))
    alike = F.array_distinct(F.flatten(F.array_compact(twins)))
    place = F.transform(alike, lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
    df = df.withColumn("windows", F.sort_array(F.transform(place, lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c"), i.alias("i")))))

    def same(x, y):
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    twice = F.filter("windows", lambda x, i: F.coalesce(same(x, F.get("windows", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("windows", i + 1)), F.lit(False)))
    df = df.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("places", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - i, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long")).drop("packed", "windows", "places")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang`` and base figures of every row: words, their characters, symbols, repeats; ``w`` and ``chars``."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), spent(F.col("text")).alias("text"))
    df = classed(df.withColumn("w", words(F.col("text"))))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]"))
    df = df.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    df = repeated_words(df.drop("text", "lines"))
    kind = {n: F.get("chars", i).cast("long") for i, (n, _) in enumerate(CLASSES)}
    every = sum((kind[n] for n, _ in CLASSES), F.lit(0).cast("long"))
    df = df.withColumns({"n_words": F.size("w").cast("long"), "word_chars": every - kind["blank"], "n_symbols": kind["symbol"]})
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def common_words(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """``lang``, ``common``: the words that most of its documents have (equals by their bytes), and ``longest``,
    the bytes of the longest of them."""
    each = docs.select(F.col("lang").cast("string").alias("lang"), F.explode(F.array_distinct(words(spent(F.col("text"))))).alias("word")).where("lang is not null")
    counts = each.groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("k", rank).where(F.col("k") <= most)
    return top.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("common"), F.max(F.octet_length("word")).alias("longest"))


def shares(counts: Column, total: Column) -> Column:
    """Counts as whole parts of :data:`UNIT`."""
    return F.transform(counts, lambda c: F.when(total > 0, F.floor(c.cast("long") * UNIT / total)).otherwise(F.lit(0)).cast("long"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def distance(p: Column, q: Column, n: Column | None = None, m: Column | None = None) -> Column:
    """The Jensen-Shannon distance (base 2, so between 0 and 1) of two histograms of counts or shares.

    ``n`` and ``m`` are their sums; as columns they aren't added up for every place again.
    """
    n, m = total(p) if n is None else n, total(q) if m is None else m

    def term(x, y):
        x, y = x / n, y / m
        mid = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.log2(v / mid)).otherwise(F.lit(0.0))
        return (part(x) + part(y)) / 2

    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))))


def summed(df: DataFrame, keys: list[str], arrays: dict[str, int]) -> DataFrame:
    """Sums of arrays of ``arrays[name]`` numbers, place by place, with the rows as ``n``."""
    sums = [F.array(*[F.sum(F.get(a, F.lit(i))) for i in range(size)]).alias(a) for a, size in arrays.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def judged(docs: DataFrame, common: int = COMMON, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``char_distance``, ``word_distance``, ``kept``, ``reason`` of every row.

    Base: fewer than 50 words, or more than half of the words in repeated windows of three, fails.
    Of the rest, a document is kept unless it has ``LEAST_CHARS`` characters or more and the distance of
    its character classes from its language's has a square over ``MOST_CHARS ** 2 + CHANCE_CHARS / chars``,
    or has ``LEAST_WORDS`` words or more and that of its common words a square over
    ``MOST_WORDS ** 2 + CHANCE_WORDS * common / n_words``. References are the mean shares of a language's
    documents that pass the base. A language with fewer than
    ``least_documents`` of those, and a null one, has the mean of all documents for its characters and
    isn't judged by words. Null texts are empty ones; rows that repeat an id are judged alike.
    """
    spark = docs.sparkSession
    known = shared.written(common_words(docs, common), "common-words")
    counted = measured(docs.select("doc_id", "lang", "text")).join(known, "lang", "left")
    # words that could be common become their ranks; what is counted then are small numbers
    rank = F.transform(F.filter("w", lambda x: F.octet_length(x) <= F.col("longest")), lambda x: F.array_position("common", x).cast("int"))
    counted = counted.withColumn("ranks", F.array_remove(rank, 0))
    of_word = F.transform(F.sequence(F.lit(1), F.size("common")), lambda k: F.size("ranks") - F.size(F.array_remove("ranks", k)))
    counted = counted.withColumn("hits", F.coalesce(of_word, F.array().cast("array<int>")))
    counted = counted.withColumn("hits", F.concat("hits", F.array((F.size("w") - F.aggregate("hits", F.lit(0), lambda a, b: a + b)))))
    counted = counted.withColumn("n_chars", total(F.col("chars")))
    counted = shared.written(counted.select("doc_id", "lang", "n_words", "n_chars", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars", "hits", shares(F.col("chars"), F.col("n_chars")).alias("char_share"), shares(F.col("hits"), F.col("n_words")).alias("word_share")), "histograms")
    good = counted.where("not base_failed")
    sizes = {"char_share": len(CLASSES), "word_share": common + 1}
    by_lang = summed(good.where("lang is not null"), ["lang"], sizes).where(F.col("n") >= least_documents)
    # a language of fewer common words has nothing in the last places
    by_lang = by_lang.select("lang", F.col("n").alias("n_docs"), F.col("char_share").alias("of_chars"), F.filter("word_share", lambda x: x.isNotNull()).alias("of_words"))
    refs = shared.written(by_lang.withColumns({"sum_chars": total(F.col("of_chars")), "sum_words": total(F.col("of_words"))}), "references")
    pooled = summed(good, [], {"char_share": len(CLASSES)}).first()["char_share"]
    all_chars = F.array(*[F.lit(x).cast("long") for x in pooled])
    out = counted.join(refs, "lang", "left").withColumns({"of_chars": F.coalesce("of_chars", all_chars), "sum_chars": F.coalesce("sum_chars", F.lit(sum(x or 0 for x in pooled)).cast("long"))})
    chars, w = distance(F.col("chars"), F.col("of_chars"), F.col("n_chars"), F.col("sum_chars")), distance(F.col("hits"), F.col("of_words"), F.col("n_words"), F.col("sum_words"))
    long_enough = (F.col("n_chars") >= LEAST_CHARS, F.col("n_words") >= LEAST_WORDS)
    out = out.withColumn("char_distance", F.when(long_enough[0], chars)).withColumn("word_distance", F.when(long_enough[1], w))
    far = lambda d, most, chance: d * d > most * most + chance
    reason = (
        F.when(F.col("base_failed"), "base").when(far(F.col("char_distance"), MOST_CHARS, CHANCE_CHARS / F.nullif("n_chars", F.lit(0))), "characters")
        .when(far(F.col("word_distance"), MOST_WORDS, CHANCE_WORDS * common / F.nullif("n_words", F.lit(0))), "words")
    )
    out = out.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept", "reason")


def oracle_sql(common: int = COMMON, least_documents: int = LEAST_DOCUMENTS) -> str:
    """The query's columns for DuckDB: windows of words and common words as rows instead of arrays."""
    gone, lengths = "text", []
    for name, pattern in CLASSES[:-1]:
        lengths.append(f"length({gone})")
        gone = f"regexp_replace({gone}, '{pattern}', '', 'g')"
    lengths.append(f"length({gone})")
    counts = [f"{a} - {b}" for a, b in zip(lengths, lengths[1:], strict=False)] + [lengths[-1]]
    share = lambda c, n: f"case when {n} > 0 then ({c})::bigint * {UNIT} // {n} else 0 end"
    part = "case when {0} > 0 then {0} * log2({0} / (({0} + {1}) / 2)) else 0 end"
    jsd = f"sqrt(greatest(sum(({part.format('x', 'y')} + {part.format('y', 'x')}) / 2), 0))"
    blank = next(i for i, (n, _) in enumerate(CLASSES) if n == "blank") + 1
    symbol = next(i for i, (n, _) in enumerate(CLASSES) if n == "symbol") + 1
    return f"""
        with d as materialized (select row_number() over () as r, doc_id, lang, coalesce(text, '') as text from documents),
             w as materialized (select r, doc_id, lang, text, list_filter(regexp_split_to_array(text, '[{BLANKS}]+'), lambda x: x <> '') as w, [{", ".join(counts)}] as chars from d),
             g as (select r, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) as g from w where len(w) > 2),
             t as (select r, i from g qualify count(*) over (partition by r, g) > 1),
             n as (select r, sum(least(3, coalesce(nxt - i, 3))) as n from (select r, i, lead(i) over (partition by r order by i) as nxt from t) group by r),
             b as materialized (select w.r, doc_id, lang, w, chars, len(w) as n_words, list_sum(chars) as n_chars, coalesce(n.n, 0) as n_repeat_words,
                          len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{BLANKS}]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{BLANKS}]')))) as n_dup_lines
                   from w left join n on n.r = w.r),
             f as materialized (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b),
             e as (select lang, unnest(list_distinct(w)) as word from b where lang is not null),
             top as materialized (select lang, word, k from (select lang, word, row_number() over (partition by lang order by count(*) desc, encode(word)) as k from e group by lang, word) where k <= {common}),
             h as (select u.r, k, count(*) as c from (select r, lang, unnest(w) as word from b) u join top on top.lang = u.lang and top.word = u.word group by all),
             places as (select lang, k from top union all select distinct lang, {common + 1} from top),
             hits as materialized (select f.r, f.lang, p.k, f.n_words, f.base_failed,
                             case when p.k <= {common} then coalesce(h.c, 0) else f.n_words - coalesce((select sum(c) from h where h.r = f.r), 0) end as c
                      from f join places p on p.lang = f.lang left join h on h.r = f.r and h.k = p.k),
             big as materialized (select lang from f where not base_failed and lang is not null group by lang having count(*) >= {least_documents}),
             wref as (select lang, k, sum({share("c", "n_words")}) as s from hits where not base_failed and lang in (select lang from big) group by lang, k),
             wn as (select lang, sum(s) as n from wref group by lang),
             wd as (select r, {jsd} as wd from (select hits.r, c / n_words as x, s / n as y from hits join wref using (lang, k) join wn using (lang) where n_words >= {LEAST_WORDS} and n > 0) group by r),
             c as materialized (select r, lang, base_failed, n_chars, unnest(range({len(CLASSES)})) as k, unnest(chars) as c from f),
             cref as (select lang, k, sum({share("c", "n_chars")}) as s from c where not base_failed and lang in (select lang from big) group by lang, k
                      union all select null, k, sum({share("c", "n_chars")}) from c where not base_failed group by k),
             cn as (select lang, sum(s) as n from cref group by lang),
             cd as (select r, {jsd} as cd from (select c.r, c / n_chars as x, s / n as y from c left join big on big.lang = c.lang
                      join cref on cref.lang is not distinct from big.lang and cref.k = c.k join cn on cn.lang is not distinct from big.lang where n_chars >= {LEAST_CHARS} and n > 0) group by r),
             v as (select f.*, case when base_failed then 'base' when cd * cd > {MOST_CHARS} * {MOST_CHARS} + {CHANCE_CHARS} / n_chars then 'characters'
                          when wd * wd > {MOST_WORDS} * {MOST_WORDS} + {CHANCE_WORDS} * {common} / n_words then 'words' end as reason
                   from f left join wd on wd.r = f.r left join cd on cd.r = f.r)
        select doc_id, n_words::bigint as n_words, (n_chars - chars[{blank}])::bigint as word_chars, chars[{symbol}]::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
               n_repeat_words::bigint as n_repeat_words, base_failed, reason is null as kept, reason from v"""
