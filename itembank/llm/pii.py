"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from patterns; labelers (shape, gazetteer, context for, context against,
neighbourhood, variety) vote for or against each or abstain. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is. Its posteriors are the soft labels
of a final logistic classifier over spans, which sees more than the votes: a span's length, its
share of digits and capitals, its first character and the hashed word before it.

EM sees a table of counts whose size depends on the number of kinds and labelers, never on the
input; the classifier is fitted on a bounded sample of candidates of each kind. Valid matches of
the base patterns always stay and invalid ones never do, though they train the model as well; the
classifier decides about candidates of the other kinds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Kinds in the order of the output; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "local_phone", "national_id", "person", "secret", "iban"]
BASE = 4

#: Titles, given names, country codes, address endings and context words.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?"
NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Thomas|Charles|Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Jessica|Sarah|Karen|"
    "Hans|Peter|Wolfgang|Klaus|Monika|Petra|Jean|Pierre|Michel|Marie|Nathalie|Carlos|Juan|Antonio|Carmen|Ana"
)
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl"
CODES = "1|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|5[1-8]|6[0-6]|7|81|82|86|9[0-58]"
KEY_STARTS = "sk[-_]|pk[-_]|gh[opsu]_|github_pat_|xox[abprs]-|AKIA|ASIA|AIza|eyJ|glpat-"
IBAN_COUNTRIES = "DE|FR|ES|IT|NL|AT|CH|BE|GB|IE|PT|LU|PL|SE|DK|FI|NO|CZ"
CONTEXT_FOR = [
    r"(?i)(e-?mail|mail|contact|write|reach)", r"(?i)(\bip\b|address|server|host|login)", r"(?i)(card|visa|master|credit|karte|carte|tarjeta)",
    r"(?i)(call|phone|tel|fax|mobile|contact)", r"(?i)(call|phone|tel|fax|mobile|contact)", r"(?i)(ssn|social|security|passport|\bid\b)", r"(?i)(name|dear|regards|sincerely|from|by)",
    r"(?i)(token|secret|passw(?:or)?d|passwd|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)", r"(?i)(iban|account|konto|compte|cuenta|bank)",
]
CONTEXT_AGAINST = r"(?i)(version|release|build|isbn|issn|order|invoice|section|chapter|doi|part no)\W*$"
CONTEXT_NO_SECRET = r"(?i)(sha-?\d*|md5|digest|checksum|commit|hash|etag|uuid|href|src|https?:/[^\s]*|/)\W*$"

#: Equal to the leftmost greedy base patterns: a run of characters is entered at its start (or
#: where the last match ended) and never given back, so that long runs cost no second scan.
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    rf"\b(?:(?:{TITLES})\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?|(?:{NAMES})\x20[A-Z][a-z]+)\b",
    r"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_+/=@-])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
]
#: A cheap look at the whole text that a match of the pattern implies.
IMPLIES = [
    lambda t: t.contains("@"), lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\."), lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    lambda t: t.contains("+"), lambda t: t.rlike(r"[0-9]{3}[-.\x20][0-9]{4}"), lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), lambda t: F.lit(True), lambda t: t.rlike(r"[A-Za-z0-9_+/-]{16}"), lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
]
LABELERS = ["shape", "gazetteer", "context_for", "context_against", "neighbours", "variety"]
CONTEXT_CHARS = 32
#: Features of a span besides kind and votes: blocks of one-hot bins, in this order.
LENGTH_BINS, DIGIT_BINS, UPPER_BINS, FIRST_BINS, WORD_BINS = 6, 5, 4, 4, 64
FEATURE_BINS = LENGTH_BINS + DIGIT_BINS + UPPER_BINS + FIRST_BINS + WORD_BINS
#: The classifier is fitted on about so many candidates of each kind at most, chosen by a hash.
MOST_CANDIDATES = 5000


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass Luhn's check."""
    d = F.split(F.reverse(digits(x)), "")
    val = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(val, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number passes its check: moved on by four, letters as 10 to 35, 1 modulo 97."""
    y = F.upper(F.regexp_replace(x, " ", ""))
    chars = F.split(F.concat(F.substring(y, 5, 64), F.substring(y, 1, 4)), "")
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).when(c.rlike("^[A-Z]$"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc)
    return F.aggregate(chars, F.lit(0), lambda a, c: step(a, c).cast("int")) == 1


def passes(kind: Column, m: Column) -> Column:
    """Whether a match of a base pattern is valid."""
    part = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))))
        .when(kind == 2, luhn(m))
        .when(kind == 3, F.length(digits(m)).between(9, 15))
        .otherwise(F.lit(False))
    )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``cands``: array of kind, start, end (code points), base, votes and feature bins.

    A pattern's matches and the text between them give the offsets. Candidates outside the base
    that overlap a base span are left out. Null and empty texts have none; repeated rows come out
    repeated.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("_t", t)
    df = df.withColumns({f"_y{k}": implied(F.col("_t")) for k, implied in enumerate(IMPLIES)})
    none = F.array().cast("array<string>")
    df = df.withColumns({f"_m{k}": F.when(F.col(f"_y{k}"), F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(none) for k, p in enumerate(PATTERNS)})
    df = df.withColumns({f"_g{k}": F.when(F.size(f"_m{k}") > 0, F.split("_t", p, -1)).otherwise(none) for k, p in enumerate(PATTERNS)})

    def spans(k: int) -> Column:
        pairs = F.zip_with(F.slice(F.col(f"_g{k}"), F.lit(1), F.size(f"_m{k}")), F.col(f"_m{k}"), lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<kind:int,start:int,end:int,m:string>>").alias("out"))

        def step(acc, x):
            a = acc["pos"] + x["g"]
            b = a + F.length(x["m"])
            return F.struct(b.alias("pos"), F.concat(acc["out"], F.array(F.struct(F.lit(k).alias("kind"), a.alias("start"), b.alias("end"), x["m"].alias("m")))).alias("out"))

        return F.when(F.size(f"_m{k}") > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,m:string>>"))

    df = df.withColumn("_c", F.concat(*[spans(k) for k in range(len(PATTERNS))]))

    def voted(c):
        before = F.substring(F.col("_t"), F.greatest(c["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT_CHARS)))
        left, right = F.substring(before, -1, 1), F.substring(F.col("_t"), c["end"] + 1, F.lit(1))
        k, m = c["kind"], c["m"]
        base = passes(k, m)
        n = F.length(m)
        n_digits, n_upper = n - F.length(F.regexp_replace(m, "[0-9]", "")), n - F.length(F.regexp_replace(m, "[A-Z]", ""))
        hexadecimal = m.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
        shape = (
            F.when(base, 1).when(k < BASE, -1).when(k == 5, F.when(m.rlike("^(000|666|9)|-00-|-0000$"), -1).otherwise(1))
            .when(k == 7, F.when(hexadecimal & n.isin(32, 40, 48, 56, 64, 96, 128), 1).when(m.rlike(r"^/|/.*/|^[A-Z]{2}[0-9]{2}[0-9A-Z]+$|^[0-9-]+$|^(?:[A-Za-z]+[-_/])+(?:[A-Za-z]+|[0-9]{1,4})"), -1).when(m.rlike(r"[a-z]") & m.rlike(r"[A-Z]") & (n_digits >= 2), 1).otherwise(0))
            .when(k == 8, F.when(mod97(m), 1).otherwise(-1)).otherwise(0)
        )
        known = F.element_at(
            F.array(
                F.when(m.rlike(rf"(?i)\.(?:{ENDINGS})$"), 1).otherwise(0), F.when(m.rlike(r"^(0|127|255)\."), -1).otherwise(0), F.when(m.rlike("^(4|5[1-5]|3[47]|6)"), 1).otherwise(-1),
                F.when(m.rlike(rf"^\+(?:{CODES})"), 1).otherwise(-1), F.when(m.rlike(r"^\(?[2-9]"), 1).otherwise(-1), F.lit(0), F.when(m.rlike(rf"\b(?:{NAMES})\b"), 1).otherwise(0),
                F.when(m.rlike(rf"^(?:{KEY_STARTS})"), 1).otherwise(0), F.when(m.rlike(rf"^(?:{IBAN_COUNTRIES})"), 1).otherwise(-1),
            ), k + 1)
        hint = F.lit(False)
        for i, words in enumerate(CONTEXT_FOR):
            hint = F.when(k == i, before.rlike(words)).otherwise(hint)
        context_for = F.when(hint, 1).otherwise(0)
        context_against = F.when(before.rlike(CONTEXT_AGAINST) | ((k == 7) & before.rlike(CONTEXT_NO_SECRET)), -1).otherwise(0)
        quoted = left.isin("'", '"', "`") & (left == right)
        around = F.when(k == 7, F.when(quoted | before.rlike(r"[=:]\s?[\"']?$"), 1).otherwise(-1)).when(F.concat(left, right).rlike("[A-Za-z0-9_]"), -1).otherwise(1)
        # how many different characters there are among the first ones: words repeat few
        seen = F.size(F.array_distinct(F.split(F.substring(F.lower(m), 1, 24), "")))
        variety = F.when((k != 7) & (k != 8), 0).when(seen >= 11, 1).when(seen <= 7, -1).otherwise(0)
        word = F.lower(F.regexp_extract(before, r"([\p{L}]+)[^\p{L}]*$", 1))
        share = lambda x, bins: F.least(F.floor(x * (bins - 1) / F.greatest(n, F.lit(1))) + F.when(x > 0, 1).otherwise(0), F.lit(bins - 1)).cast("int")
        first = F.when(m.rlike("^[0-9]"), 0).when(m.rlike("^[A-Z]"), 1).when(m.rlike("^[a-z]"), 2).otherwise(3)
        bins = [F.least(F.floor(F.log2(F.greatest(n, F.lit(1)))), F.lit(LENGTH_BINS + 1)).cast("int") - 2, share(n_digits, DIGIT_BINS), share(n_upper, UPPER_BINS), first, F.pmod(F.xxhash64(word), F.lit(WORD_BINS)).cast("int")]
        at, features = 0, []
        for b, size in zip(bins, (LENGTH_BINS, DIGIT_BINS, UPPER_BINS, FIRST_BINS, WORD_BINS), strict=True):
            features.append((F.greatest(b, F.lit(0)) + at).cast("int"))
            at += size
        votes = F.array(*[v.cast("int") for v in (shape, known, context_for, context_against, around, variety)])
        return F.struct(k.alias("kind"), c["start"].alias("start"), c["end"].alias("end"), base.alias("base"), votes.alias("votes"), F.array(*features).alias("features"))

    df = df.withColumn("_v", F.transform("_c", voted)).withColumn("_b", F.filter("_v", lambda c: c["base"]))
    overlaps = lambda c: F.exists("_b", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    df = df.withColumn("cands", F.filter("_v", lambda c: c["base"] | ~overlaps(c)))
    return df.select(*docs.columns, "cands")


def estimate(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[list[float], dict[int, list[list[dict[int, float]]]]]:
    """Posterior that a vote pattern ``(kind, votes, n)`` is personal data, by EM, and by kind each
    labeler's chances of its votes where it is not and where it is.

    A Dawid-Skene model for each kind: a prior, and for each labeler a chance of each vote given
    the truth. A weak belief that labelers are better than chance, and that most candidates are
    not personal data, tells the two classes apart where the votes don't.
    """
    post = [min(0.95, max(0.05, 0.5 + sum(v) / (2.0 * len(v)))) for _, v, _ in counts]
    tables: dict[int, list] = {}
    for kind in sorted({k for k, *_ in counts}):
        mine = [(i, v, n) for i, (k, v, n) in enumerate(counts) if k == kind]
        total = sum(n for *_, n in mine)
        weak = max(1.0, total / 500)
        for _ in range(rounds):
            prior = [2 * weak, weak]
            labs = [[{-1: 4 * weak, 0: 3 * weak, 1: weak}, {-1: weak, 0: 3 * weak, 1: 4 * weak}] for _ in mine[0][1]]
            for i, votes, n in mine:
                p = post[i]
                prior[0] += n * (1 - p)
                prior[1] += n * p
                for lab, v in zip(labs, votes, strict=True):
                    lab[0][v] += n * (1 - p)
                    lab[1][v] += n * p
            for i, votes, _ in mine:
                log_odds = math.log(prior[1] / prior[0])
                for lab, v in zip(labs, votes, strict=True):
                    log_odds += math.log(lab[1][v] / sum(lab[1].values())) - math.log(lab[0][v] / sum(lab[0].values()))
                post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds))))
        tables[kind] = [[{v: n / sum(t.values()) for v, n in t.items()} for t in lab] for lab in labs]
    return post, tables


def design(rows: list[tuple[int, tuple[int, ...], tuple[int, ...]]]) -> np.ndarray:
    """Kinds one-hot, votes, and feature bins one-hot, as a matrix."""
    x = np.zeros((len(rows), len(KINDS) + len(LABELERS) + FEATURE_BINS))
    for i, (kind, votes, bins) in enumerate(rows):
        x[i, kind] = 1
        x[i, len(KINDS) : len(KINDS) + len(LABELERS)] = votes
        x[i, [len(KINDS) + len(LABELERS) + b for b in bins]] = 1
    return x


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, step: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on soft labels ``y``, by gradient descent."""
    w, total = np.zeros(x.shape[1]), weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= step * (x.T @ ((p - y) * weight) / total + ridge * w)
    return w


def fit(cands: DataFrame, most: int = MOST_CANDIDATES) -> list[float]:
    """The classifier's weights: kinds, labelers, feature bins.

    EM sees the counts of all candidates' vote patterns. The classifier sees the candidates of a
    kind whose hash falls below the share that makes about ``most`` of them; each kind weighs the
    same. Without any candidate the weights reject everything.
    """
    every = cands.select(F.explode("cands").alias("c")).select("c.kind", "c.votes", "c.features", F.xxhash64("c").alias("h"))
    counts = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in every.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect())
    if not counts:
        return [-1.0] * len(KINDS) + [0.0] * (len(LABELERS) + FEATURE_BINS)
    post = {(k, v): p for (k, v, _), p in zip(counts, estimate(counts)[0], strict=True)}
    per_kind: dict[int, int] = {}
    for k, _, n in counts:
        per_kind[k] = per_kind.get(k, 0) + n
    whole = 1 << 62
    below = F.create_map(*[F.lit(x) for k, n in per_kind.items() for x in (k, whole if n <= most else whole * most // n)])
    # the hash is of the span's place, kind, votes and features; equal ones are counted, not repeated
    sample = every.where(F.pmod("h", F.lit(whole)) < below[F.col("kind")]).groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).collect()
    rows = sorted((r["kind"], tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in sample)
    if not rows:
        return [-1.0] * len(KINDS) + [0.0] * (len(LABELERS) + FEATURE_BINS)
    of_kind = np.zeros(len(KINDS))
    for k, *_, n in rows:
        of_kind[k] += n
    weight = np.array([n / of_kind[k] for k, *_, n in rows])
    w = train(design([r[:3] for r in rows]), np.array([post[r[0], r[1]] for r in rows]), weight)
    return w.tolist()


def decided(cands: Column, model: list[float]) -> Column:
    """Spans that stay: base ones, and those of other kinds that the classifier takes; by kind, then start."""
    kinds, labs, bins = (F.array(*[F.lit(float(w)) for w in ws]) for ws in (model[: len(KINDS)], model[len(KINDS) : len(KINDS) + len(LABELERS)], model[len(KINDS) + len(LABELERS) :]))
    add = lambda a, b: a + b
    score = lambda c: F.element_at(kinds, c["kind"] + 1) + F.aggregate(F.zip_with(labs, c["votes"], lambda w, v: w * v), F.lit(0.0), add) + F.aggregate(F.transform(c["features"], lambda i: F.element_at(bins, i + 1)), F.lit(0.0), add)
    kept = F.filter(cands, lambda c: c["base"] | ((c["kind"] >= BASE) & (score(c) > 0)))
    return F.array_sort(F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))))


def _spelt(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"], c["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256``, ``spans``, ``n_added`` and ``n_spans`` of every row.

    Candidates are written once without their texts; the classifier is fitted on all of them and
    applied to each row. Texts without personal data have empty spans; repeated rows come out
    repeated, an empty table gives none.
    """
    cands = shared.written(candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("doc_id", "cands"), "candidates")
    model = fit(cands)
    df = cands.withColumn("s", decided(F.col("cands"), model)).withColumn("b", F.filter("s", lambda c: c["base"]))

    def of_kind(i: int) -> Column:
        return F.size(F.filter("b", lambda c: c["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return df.select("doc_id", *map(of_kind, range(BASE)), F.sha2(_spelt(F.col("b")).cast("binary"), 256).alias("base_sha256"), _spelt(F.col("s")).alias("spans"), (F.size("s") - F.size("b")).cast("long").alias("n_added"), F.size("s").cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets and ``n_chars`` counted anew.

    Spans that overlap are replaced as one, under the kind of the first. Null texts stay null. The
    rows are written once with their candidates, so that texts are searched once and stored once.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    found = shared.written(candidates(packed).select("row", "cands"), "candidates")
    model = fit(found.select("cands"))
    df = found.withColumn("text", F.col("row")["text"].cast("string")).withColumn("_s", F.array_sort(F.transform(decided(F.col("cands"), model), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc, c):
        fresh = c["start"] >= acc["pos"]
        gap = F.concat(F.substring(F.col("text"), acc["pos"] + 1, c["start"] - acc["pos"]), F.element_at(names, c["kind"] + 1))
        return F.struct(F.greatest(acc["pos"], c["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).alias("out"))

    df = df.withColumn("_r", F.when(F.size("_s") > 0, F.aggregate("_s", start, step)))
    text = F.when(F.col("_r").isNull(), F.col("text")).otherwise(F.concat(F.array_join("_r.out", ""), F.expr("substring(text, _r.pos + 1)")))
    df = df.withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
