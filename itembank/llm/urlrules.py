"""URL filters: written rules first, and rules mined from labelled URLs for all others.

FP-growth finds combinations of URL tokens that are frequent among labelled pages; those whose
confidence for a label is high enough become rules. A rule is filed in an inverted index under
its rarest token, so a URL is held only against the rules of the tokens it has.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Mining: least share of labelled pages, least confidence, most tokens a rule asks for. Support
#: bounds the rules: no more than so many itemsets can be frequent, whatever the input's size.
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.002, 0.6, 3
#: What a rule has to add to its label's share of all labelled pages: so many times that share (or half
#: of what is left to certainty, where that is less), and so many standard deviations above it. Of the
#: hundreds of combinations tried, some are over three by chance alone.
LIFT, DEVIATIONS = 1.25, 4.0
BLOCK, ALLOW = "label=block", "label=allow"
#: So many mined rules at most are matched from an index that every worker holds; more are joined.
MOST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def written_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule ``(verdict, host, path)`` that fits, as a struct of rule and verdict."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        val = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, val) if out is None else out.when(fits, val)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: host suffixes, the words of the host's labels, the path's first folder and ending."""
    labels = F.split(host, r"\.")
    words = F.transform(F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, r"[^a-z0-9]+"))), lambda w: w != ""), lambda w: F.concat(F.lit("word="), w))
    folder = F.regexp_extract(path, r"^/([^/]+)/", 1)
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    more = F.array(
        F.when(host != "", F.concat(F.lit("host="), host)),
        F.when(folder != "", F.concat(F.lit("folder="), folder)),
        F.when(ending != "", F.concat(F.lit("ending="), F.lower(ending))),
    )
    return F.array_distinct(F.array_compact(F.concat(words, more)))


def tells(freq: Column, whole: Column, share: Column, lift: float, deviations: float) -> Column:
    """Whether ``freq`` of ``whole`` pages with a label is more than its ``share`` of all pages explains."""
    least = F.least(share * lift, (1 + share) / 2)
    chance = whole * share * (1 - share)
    return (freq >= least * whole) & (freq - whole * share >= deviations * F.sqrt(chance))


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, most: int = MAX_TOKENS, lift: float = 0.0, deviations: float = 0.0) -> DataFrame:
    """``rule_tokens``, ``verdict``, ``confidence``, ``support``, ``key`` (the rarest token).

    ``labelled`` has ``tokens`` and ``label`` (:data:`BLOCK` or :data:`ALLOW`). FP-growth runs in
    Spark over all of it; a rule has to have ``confidence`` and, by ``lift`` and ``deviations``, to be
    more than its label's share explains (:func:`tells`; zero asks for nothing). One that a shorter
    one with the same label and at least its confidence covers is dropped. No labelled rows give no rules; repeated ones count each time,
    null tokens or labels have to be left out before.
    """
    spark = labelled.sparkSession
    empty = "rule_tokens array<string>, verdict string, confidence double, support double, key string"
    if labelled.isEmpty():
        return spark.createDataFrame([], empty)
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(labelled.select(F.concat("tokens", F.array("label")).alias("items"))).freqItemsets
    of_label = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n = sum(of_label.values())
    sets = sets.where(F.size("items") <= most + 1).select("freq", "items", F.filter("items", lambda x: x.startswith("label=")).alias("label"), F.sort_array(F.filter("items", lambda x: ~x.startswith("label="))).alias("rule_tokens"))
    sets = shared.written(sets, "itemsets")
    alone = sets.where((F.size("label") == 0)).select("rule_tokens", F.col("freq").alias("all"))
    telling = sets.where((F.size("label") == 1) & (F.size("rule_tokens") > 0)).join(alone, "rule_tokens")
    if lift or deviations:
        share = F.coalesce(*[F.when(F.col("label")[0] == k, v / n) for k, v in of_label.items()])
        telling = telling.where(tells(F.col("freq"), F.col("all"), share, lift, deviations))
    rules = telling.select("rule_tokens", F.regexp_replace(F.col("label")[0], "label=", "").alias("verdict"), (F.col("freq") / F.col("all")).alias("confidence"), (F.col("freq") / n).alias("support")).where(F.col("confidence") >= confidence)
    single = alone.where(F.size("rule_tokens") == 1).select(F.col("rule_tokens")[0].alias("token"), "all")
    subs = rules.select("rule_tokens", "verdict", "confidence", F.explode("rule_tokens").alias("token"))
    shorter = rules.where(F.size("rule_tokens") < most).select(F.col("rule_tokens").alias("s"), F.col("verdict").alias("sv"), F.col("confidence").alias("sc"), F.col("rule_tokens")[0].alias("token"))
    covered = subs.join(shorter, "token").where((F.size("s") < F.size("rule_tokens")) & (F.size(F.array_except("s", "rule_tokens")) == 0) & (F.col("sv") == F.col("verdict")) & (F.col("sc") >= F.col("confidence"))).select("rule_tokens", "verdict").distinct()
    keys = subs.join(single, "token").groupBy("rule_tokens", "verdict").agg(F.min(F.struct("all", "token")).alias("k")).select("rule_tokens", "verdict", F.col("k.token").alias("key"))
    return rules.join(covered, ["rule_tokens", "verdict"], "left_anti").join(keys, ["rule_tokens", "verdict"])


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = 0.0, deviations: float = 0.0) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``confidence`` for every page.

    A written rule decides where one fits. Else the mined rule with the highest confidence, then
    support, does; a URL that no rule matches gets the verdict of most labels (allow if there are
    none). A label counts as block if it is toxic or of low quality; labels are held against
    pages by id, null ids and null labels are ignored, a repeated label counts once for each.
    Null URLs and those without ``://`` have an empty host and path. Repeated pages stay repeated.
    """
    p = pages.select(F.col("page_id").cast("long"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    lab = labels.select(F.col("doc_id").cast("long").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(BLOCK)).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), F.lit(ALLOW)).alias("label")).where("page_id is not null and label is not null")
    labelled = shared.written(p.join(lab, "page_id").select(tokens_of(F.col("host"), F.col("path")).alias("tokens"), "label"), "labelled")
    mined = mine(labelled, support, confidence, lift=lift, deviations=deviations)
    most = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    default = most["label"].removeprefix("label=") if most else "allow"
    t = p.withColumn("w", written_rule(F.col("host"), F.col("path"), rules))
    t = t.withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    mined = shared.written(mined, "rules")
    n_rules = mined.count()
    judged = matched(t, mined) if n_rules <= MOST_RULES else joined(t, mined)
    return judged.select("page_id", "host", "path", F.col("w.rule").alias("rule"), F.coalesce("w.verdict", "best.verdict", F.lit(default)).alias("verdict"), F.col("best.confidence").alias("confidence"), F.col("best.rule_tokens").alias("mined_rule"))


BEST = "struct<confidence:double,support:double,verdict:string,rule_tokens:array<string>>"


def matched(t: DataFrame, mined: DataFrame) -> DataFrame:
    """``t`` with ``best``, the mined rule that decides a row no written rule (``w``) does, or null.

    The inverted index (rules by their rarest token, at most :data:`MOST_RULES`) is broadcast, so
    rows stay where they are, however many share a host.
    """
    shared.ready(t.sparkSession)
    index: dict[str, list] = {}
    for r in mined.collect():
        index.setdefault(r["key"], []).append((r["confidence"], r["support"], r["verdict"], r["rule_tokens"]))
    for rules in index.values():
        rules.sort(reverse=True)
    held = t.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for b in shared.slices(batches, 4096):
            best = []
            for tokens, decided in zip(b.column("tokens").to_pylist(), b.column("w").is_valid().to_pylist(), strict=True):
                top, have = None, set(tokens)
                for key in () if decided else tokens:
                    for rule in held.value.get(key, ()):
                        if top is not None and rule <= top:
                            break
                        if have.issuperset(rule[3]):
                            top = rule
                            break
                best.append(top and dict(zip(("confidence", "support", "verdict", "rule_tokens"), top, strict=True)))
            kind = pa.struct([("confidence", pa.float64()), ("support", pa.float64()), ("verdict", pa.string()), ("rule_tokens", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("page_id", "host", "path", "w")], pa.array(best, kind)], names=["page_id", "host", "path", "w", "best"])

    return t.select("page_id", "host", "path", "w", "tokens").mapInArrow(run, f"page_id long, host string, path string, w struct<rule:string,verdict:string>, best {BEST}")


def joined(t: DataFrame, mined: DataFrame) -> DataFrame:
    """As :func:`matched`, by joins: equal token sets are judged once, and the rows of a set are dealt
    over as many keys as it has thousands of rows."""
    sets = t.where("w is null").groupBy("tokens").agg(F.count("*").alias("rows"))
    hit = (
        sets.select("tokens", "rows", F.explode("tokens").alias("key")).join(mined, "key")
        .where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
        .groupBy("tokens").agg(F.max(F.struct("confidence", "support", "verdict", "rule_tokens")).alias("best"), F.max("rows").alias("rows"))
    )
    hot = hit.where("rows > 1000")
    salts = 64
    spread = hot.select("tokens", "best", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).union(hit.where("rows <= 1000").select("tokens", "best", F.lit(-1)))
    warm = F.broadcast(hot.select("tokens").withColumn("hot", F.lit(True))) if hot.count() <= 10_000 else hot.select("tokens").withColumn("hot", F.lit(True))
    # rows that a written rule decides get keys of their own, spread out, that meet nothing
    own = F.array(F.concat(F.lit("#"), F.pmod(F.xxhash64("page_id", "path"), F.lit(4096)).cast("string")))
    left = t.withColumn("tokens", F.when(F.col("w").isNull(), F.col("tokens")).otherwise(own)).join(warm, "tokens", "left")
    left = left.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")).otherwise(-1))
    return left.join(spread, ["tokens", "salt"], "left").select("page_id", "host", "path", "w", "best")
