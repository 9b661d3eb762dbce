"""Language identification by fusing evidence.

log P(lang | all) is the sum of: the text's likelihood under hashed character trigrams, how often
a language comes with the declared markup language and with the address suffix, and the prior of
the host. Host priors are counts of the languages that texts alone suggest, smoothed towards
those of the registered domain, the suffix and the whole corpus in turn.

Labels serve to fit the trigrams only; what markup declares, the suffix and the host are evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Trigrams of UTF-8 bytes are hashed into so many features.
FEATURES = 1 << 15
#: The classifier is fitted on about so many labelled rows of each language at most, chosen by a hash.
MOST_LABELLED = 5000
#: Hashes run to 2 ** 62, so that a share of any table, however large, is not rounded to nothing.
HASH_RANGE = 1 << 62
#: A trigram counts as this much of an independent one, and a text has at most so much weight.
TEMPER, MOST_WEIGHT = 0.25, 200.0
#: Strength of the smoothing towards the coarser level, in documents, and the weight of a language
#: in evidence that never came with it.
STRENGTH, UNSEEN = 20.0, 1.0
#: A document is rejected if it has no letter or no language is this likely.
LEAST_LETTERS, LEAST_POSTERIOR = 1, 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, two or three letters in lower case; else null.

    This bounds the number of languages whatever a column holds."""
    return F.nullif(F.lower(F.regexp_extract(tag.cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_][^\s]*)?\s*$", 1)), F.lit(""))


def declared_in(html: Column) -> Column:
    """The language that a page's ``html`` tag declares; null if it doesn't."""
    return primary(F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1), F.lit("")))


def visible(html: Column) -> Column:
    """A page's text: without scripts, styles, comments, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>|&#?[0-9A-Za-z]+;", " ")


def features(text: bytes) -> np.ndarray:
    """Counts of hashed trigrams of the text's bytes, lower-cased; all but letters are blanks."""
    a = np.frombuffer(text.lower(), np.uint8)
    a = np.where(_LETTER[a], a, 0x20).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(FEATURES, np.int64)
    code = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761) >> np.uint32(32 - FEATURES.bit_length() + 1)
    blank = (a[:-2] == 0x20) & (a[1:-1] == 0x20)
    return np.bincount(code[~blank], minlength=FEATURES)


def thresholds(counts: dict[str, int], most: int = MOST_LABELLED) -> dict[str, int]:
    """For each language the hash below which its rows are taken: about ``most`` of them, or all."""
    return {k: HASH_RANGE if n <= most else max(1, HASH_RANGE * most // n) for k, n in counts.items()}


def fit(rows: DataFrame, most: int = MOST_LABELLED) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihoods (``FEATURES`` x languages).

    ``rows`` has ``doc_id``, ``text``, ``label``; rows with a null text or label are left out, and
    no rows give no languages. Every language that occurs is modelled, on a bounded sample of its
    rows (see :data:`MOST_LABELLED`). Each task sums its counts, Spark the tasks'; what comes to
    the driver is one table of the model's size.
    """
    shared.ready(rows.sparkSession)
    rows = rows.where("label is not null and text is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # at most 26 ** 2 + 26 ** 3
    if not counts:
        return [], np.zeros((FEATURES, 0))
    below = F.create_map(*[F.lit(x) for k, v in thresholds(counts, most).items() for x in (k, v)])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(HASH_RANGE)) < below[F.col("label")])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in shared.slices(batches):
            for text, lang in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                # a document counts by its shares, so that long ones don't outweigh the rest
                x = features(text)
                total[lang] = total.get(lang, 0) + x * min(1.0, 2000 / max(1, x.sum()))
                docs[lang] = docs.get(lang, 0) + 1
        for lang, x in total.items():
            i = np.nonzero(x)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(i) + 1)), pa.array([-1, *i.tolist()], pa.int32()), pa.array([float(docs[lang]), *x[i].tolist()])], names=["lang", "feature", "n"])

    grams = sample.select("text", "label").mapInArrow(run, "lang string, feature int, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    grams = shared.written(grams, "trigrams")
    langs = sorted(counts)
    at = {k: i for i, k in enumerate(langs)}
    table = np.full((FEATURES, len(langs)), 0.1)
    for r in grams.where(F.col("feature") >= 0).toLocalIterator():
        table[r["feature"], at[r["lang"]]] += r["n"]
    shared.dropped(grams)
    return langs, np.log(table / table.sum(axis=0))


def text_scores(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``rows`` without the text: ``scores`` (log-likelihoods, tempered) and ``letters``.

    A null or empty text has the score 0 for each language and no letters.
    """
    shared.ready(rows.sparkSession)
    others = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others) + ", scores array<double>, letters long"
    shared_table = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # FEATURES x languages, fixed by parameters

    def run(batches):
        t = shared_table.value
        for b in shared.slices(batches):
            scores, letters = [], []
            for text in b.column(0).cast(pa.binary()).to_pylist():
                x = features(text or b"")
                i = np.nonzero(x)[0]
                n = float(x.sum())
                w = min(TEMPER, MOST_WEIGHT / n) if n else 0.0
                scores.append(((x[i].astype(np.float64) @ t[i]) * w).tolist() if n else [0.0] * t.shape[1])
                letters.append(int(_LETTER[np.frombuffer((text or b"").lower(), np.uint8)].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores, pa.list_(pa.float64())), pa.array(letters, pa.int64())], names=[*others, "scores", "letters"])

    return rows.select("text", *others).mapInArrow(run, schema)


def _softmax(x):
    """An array of log weights as probabilities."""
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(docs: DataFrame, text: str = "text", label: str | None = "lang", declared: str | None = None, host: str | None = "source", most: int = MOST_LABELLED, fit_on: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``lang``, ``posterior``, ``letters``, ``kept`` of every row of ``docs``.

    ``label`` is the column of known languages, used to fit and not as evidence; ``fit_on`` is a
    table with ``doc_id``, ``text`` and ``lang`` to fit on instead. ``declared`` is the column of
    the markup's language, ``host`` that of the host name, whose last label is the address suffix
    and whose last two are the registered domain. Missing, null or malformed evidence says
    nothing. ``kept`` is false for a document with hardly any letters (null and empty texts among
    them) or whose most likely language isn't likely enough; ties go to the first language by
    name. Without any label nothing is identified. Repeated rows come out repeated, an empty table
    gives none.
    """
    null = F.lit(None).cast("string")
    known = fit_on.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), primary(F.col("lang")).alias("label")) if fit_on is not None else docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (primary(F.col(label)) if label else null).alias("label"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        (primary(F.col(declared)) if declared else null).alias("declared"), F.nullif(F.lower(F.col(host).cast("string")), F.lit("")).alias("host") if host else null.alias("host"),
    )
    langs, table = fit(known, most)
    if not langs:
        return rows.select(F.col("doc_id").alias(id_col), null.alias("lang"), F.lit(0.0).alias("posterior"), F.lit(0).cast("long").alias("letters"), F.lit(False).alias("kept"))
    scored = shared.written(text_scores(rows, langs, table), "scores")
    p = scored.withColumn("p", _softmax(F.col("scores"))).withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)))
    k = len(langs)

    def counts(by: str):
        return p.where(F.col(by).isNotNull() & (F.col("letters") >= LEAST_LETTERS)).groupBy(by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias("n"))

    whole = p.where(F.col("letters") >= LEAST_LETTERS).agg(F.array(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(k)]).alias("n")).first()["n"]
    base = [(x + 1.0) / (sum(whole) + k) for x in whole]

    def smooth(n, prior):
        total = F.aggregate(n, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(n, prior, lambda x, q: (x + q * STRENGTH) / (total + STRENGTH))

    flat = F.array(*[F.lit(x) for x in base])
    suffix = counts("suffix").select("suffix", smooth(F.col("n"), flat).alias("suffix_p"))
    domain = counts("domain").withColumn("suffix", F.when(F.col("domain").contains("."), F.substring_index("domain", ".", -1))).join(suffix, "suffix", "left").select("domain", smooth(F.col("n"), F.coalesce("suffix_p", flat)).alias("domain_p"))
    hosts = counts("host").withColumn("domain", F.substring_index("host", ".", -2)).join(domain, "domain", "left").select("host", smooth(F.col("n"), F.coalesce("domain_p", flat)).alias("host_p"))

    # how often a language comes with what is declared, and with a suffix: P(evidence | language)
    def given(by: str, name: str):
        share = lambda i: F.log((F.col("n")[i] + UNSEEN) / F.lit(whole[i] + STRENGTH))
        return counts(by).select(by, F.array(*[share(i) for i in range(k)]).alias(name))

    flat_log = F.array(*[F.lit(0.0)] * k)
    said = given("declared", "declared_s")
    at = given("suffix", "suffix_s")
    f = p.join(hosts, "host", "left").join(said, "declared", "left").join(at, "suffix", "left")
    parts = [F.col("scores"), F.coalesce("declared_s", flat_log), F.coalesce("suffix_s", flat_log), F.transform(F.coalesce("host_p", flat), lambda x: F.log(x))]
    total = parts[0]
    for x in parts[1:]:
        total = F.zip_with(total, x, lambda a, b: a + b)
    f = f.withColumn("q", _softmax(total))
    best = F.array_max("q")
    names = F.array(*[F.lit(x) for x in langs])
    kept = (F.col("letters") >= LEAST_LETTERS) & (best >= LEAST_POSTERIOR)
    return f.select(F.col("doc_id").alias(id_col), names[F.array_position("q", best).cast("int") - 1].alias("lang"), best.alias("posterior"), "letters", kept.alias("kept"))


def identify_pages(pages: DataFrame, labelled: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``page_id``, ``lang``, ``posterior``, ``letters``, ``kept``, for every page.

    The text is what the html shows, the declared language that of its ``html`` tag, the host that
    of the url. Null html or urls give no evidence. Fitted on ``labelled`` documents.
    """
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    host = F.nullif(F.regexp_extract(url, r"(?s)\A.*?://([^/?#:]*)", 1), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), visible(html).alias("text"), declared_in(html).alias("declared"), host.alias("host"))
    return identify(rows, declared="declared", host="host", most=most, fit_on=labelled, id_col="page_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without those that :func:`identify` rejects; rows are told apart by their id.

    A row without an id is kept; of an id's repeated rows all are kept if one is.
    """
    kept = identify(docs)
    rejected = kept.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept and doc_id is not null").select("doc_id")
    rejected = shared.written(rejected, "rejected")  # its size is known then, so few ids don't cost a shuffle of the texts
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)
