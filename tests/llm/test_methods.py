"""The methods behind the corpus operators: models against brute force, hot keys, odd ids."""

import collections
import hashlib
import io
import itertools
import math
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from itembank.llm import covertree, langid, packing, pii, queries, shared, simhash, sstable, urlrules, warc

SF = "/root/testdata/sf0.001"


# 1


def brute(rows, cosine=0.93):
    """n_links and component by (position), over (vec_id, embedding, label)."""
    x = np.array([r[1] for r in rows], np.float64)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = (x @ x.T >= cosine) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(near, False)
    low = [r[0] for r in rows]
    while True:
        new = [min([low[i], *(low[j] for j in np.nonzero(near[i])[0])]) for i in range(len(rows))]
        if new == low:
            return near.sum(axis=1).tolist(), low
        low = new


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_ties_repeats_and_doubles(spark, kind, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(25, 6))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.1])
    # pairs just above and below the threshold, by an angle that floats can't tell apart
    edge = [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.93 + 1e-9, math.sqrt(1 - (0.93 + 1e-9) ** 2), 0.0, 0.0, 0.0, 0.0], [0.93 - 1e-9, -math.sqrt(1 - (0.93 - 1e-9) ** 2), 0.0, 0.0, 0.0, 0.0]]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, v, 1) for i, v in enumerate(edge if kind == "double" else edge[:1])]
    rows += [(3, x[40].tolist(), 0), (2000, [0.0, -0.0, 5.0, 0.0, 0.0, 0.0], 2), (2001, [0.0, 0.0, 5.0, 0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame(rows + [(None, x[0].tolist(), 0)], f"vec_id long, embedding array<{kind}>, label int").withColumns({"first": F.lit(1), "n": F.lit(2)})
    stored = [(i, np.array(v, np.float32).tolist() if kind == "float" else v, k) for i, v, k in rows]
    links, comp = brute(stored)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in covertree.near_duplicates(df, block_rows=block).where("vec_id is not null").collect())
    assert got == sorted((r[0], n, c, r[0] == c) for r, n, c in zip(stored, links, comp, strict=True))
    lone = covertree.near_duplicates(df, block_rows=block).where("vec_id is null").first()
    assert (lone["n_links"], lone["component_id"]) == (0, None)


def test_trees_survive_flattening():
    rng = np.random.default_rng(2)
    x = covertree.unit(rng.normal(size=(400, 5)))
    order, table = covertree.flatten(covertree.build(x))
    y, root = x[order], covertree.restored(table)
    assert sorted(order.tolist()) == list(range(400))
    todo = [root]
    while todo:
        n = todo.pop()
        assert covertree.distances(y[n.members], y[[n.centre]]).max() <= n.radius + 1e-9
        assert not n.children or sorted(np.concatenate([c.members for c in n.children]).tolist()) == n.members.tolist()
        todo += n.children
    tops = covertree.uppermost(root)
    assert len(tops) <= covertree.TOPS and sorted(np.concatenate([n.members for n in tops]).tolist()) == list(range(400))


def test_far_blocks_are_pruned(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(8)
    x = np.concatenate([c + rng.normal(size=(60, 8)) * 0.02 for c in centres])
    rows = [(i, v.tolist(), 1, "a", 0) for i, v in enumerate(x)]
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "vec_id long, embedding array<double>, label int")
    assert {r["n_links"] for r in covertree.near_duplicates(df, block_rows=20, most_pivots=64).collect()} == {59}
    points = df.select(F.col("label").cast("string"), F.size("embedding").alias("dim"), F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("n"), "embedding")
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    pivots = covertree._pivots(points, sizes, 20, 64)
    cells = covertree.placed_points(points, pivots).groupBy("label", "dim", "cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius"))
    n = cells.count()
    assert covertree.near_cells(cells, pivots, math.sqrt(2 - 2 * 0.93)).count() < n * (n + 1) / 2


# 2


def test_many_null_and_equal_ids(spark, tmp_path):
    from itembank.llm.tokens import Encoder

    path = queries.public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, f"text {i}") for i in range(40)] + [(7, f"other {i % 5}") for i in range(40)] + [(8, None)]
    manifest = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, 1, shared.new_dir(spark, "many"))
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    enc = Encoder(path)
    assert collections.Counter(r["n_tokens"] for r in got) == collections.Counter(len(enc.ids(t)) + 1 for _, t in rows)


# 3


def record(i, n, url="http://x"):
    body = np.random.default_rng(i).bytes(n)
    return warc.build_record(i, url, body, hashlib.sha256(body).hexdigest(), None)


@pytest.mark.parametrize("zipped", [True, False])
def test_members_at_every_offset_of_a_read(monkeypatch, zipped):
    monkeypatch.setattr(warc, "CHUNK", 4096)
    pack = warc.gzip_member if zipped else bytes
    tail = pack(record(2, 300))
    for shift in range(1, 201):
        size = 4096 - shift - len(pack(record(1, 3000))) + 3000
        first = pack(record(1, size))
        for _ in range(4):  # compressed sizes aren't exact
            size += 4096 - shift - len(first)
            first = pack(record(1, size))
        data = first + tail
        assert abs(len(first) - (4096 - shift)) <= 8
        assert [(g[0], g[3]["x-page-id"]) for g in warc.salvage(io.BytesIO(data), len(data))] == [("record", "1"), ("record", "2")]


@pytest.mark.parametrize("zipped", [True, False])
def test_addresses_of_any_length(zipped):
    pack = warc.gzip_member if zipped else bytes
    data = pack(record(1, 50, "http://x/" + "a" * 200_000)) + pack(record(2, 50, "http://y/" + "b" * 3_000_000)) + pack(record(3, 50))
    assert [(g[0], g[3]["x-page-id"]) for g in warc.salvage(io.BytesIO(data), len(data))] == [("record", "1"), ("record", "2"), ("record", "3")]


def test_a_version_line_in_rubbish_is_no_header():
    data = record(1, 50) + b"WARC/1.1\r\nno header here\r\n" + b"x" * 5000 + record(2, 50)
    assert [g[0] for g in warc.salvage(io.BytesIO(data), len(data))] == ["record", "gap", "record"]


def test_archives_of_several_mib(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"http://h/{i}" + ("u" * 200_000 if i == 77 else ""), "".join(map(chr, rng.integers(33, 2000, int(n))))) for i, n in enumerate(rng.integers(0, 9000, 1900))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(pages, shared.new_dir(spark, "big"))
    assert archives.agg(F.max("n_bytes")).first()[0] > 3 << 20
    got = warc.read_archives(archives, complete=True)
    assert got.where("kind = 'gap'").count() == 0
    assert sorted((r["page_id"], r["payload_digest"]) for r in got.collect()) == sorted((i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    with pytest.raises(Exception, match="records read"):
        warc.read_archives(archives.withColumn("n_records", F.col("n_records") + 1), complete=True).collect()


# 4


def test_mined_rules_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(8)]
    rows = []
    for _ in range(300):
        have = sorted(rng.choice(words, int(rng.integers(1, 6)), replace=False).tolist())
        bad = ("t1" in have and "t2" in have) or rng.random() < 0.2
        rows.append((have, urlrules.BLOCK if bad else urlrules.ALLOW))
    rows += rows[:20]  # repeated labels count each time
    got = {(tuple(r["rule_tokens"]), r["verdict"]): (r["confidence"], r["support"], r["key"]) for r in urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.6, 3).collect()}
    n, every = len(rows), {}
    for size in (1, 2, 3):
        for c in itertools.combinations(words, size):
            with_c = [lab for have, lab in rows if set(c) <= set(have)]
            for lab in (urlrules.BLOCK, urlrules.ALLOW):
                k = with_c.count(lab)
                if k and k >= math.ceil(0.05 * n - 1e-9) and k / len(with_c) >= 0.6:
                    every[c, lab.split("=")[1]] = (k / len(with_c), k / n)
    covered = {(c, v) for (c, v), (conf, _) in every.items() for (s, sv), (sc, _) in every.items() if sv == v and len(s) < len(c) and set(s) <= set(c) and sc >= conf}
    alone = {w: sum(w in have for have, _ in rows) for w in words}
    want = {k: (*x, min(k[0], key=lambda w: (alone[w], w))) for k, x in every.items() if k not in covered}
    assert got == want and len(got) > 5


@pytest.mark.parametrize("most", [100_000, -1])
def test_matching_is_that_of_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(urlrules, "MOST_RULES", most)
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "labels"))
    pages = pages.unionByName(spark.createDataFrame([(10**6 + i, "http://www.hot.net/p/1", "") for i in range(1200)] + [(None, None, None)], pages.schema))
    got = urlrules.judge(pages, labels, queries.URL_RULES).collect()
    t = pages.select("page_id", urlrules.host_of(F.col("url")).alias("host"), urlrules.path_of(F.col("url")).alias("path"))
    t = t.withColumn("tokens", urlrules.tokens_of(F.col("host"), F.col("path")))
    lab = {r["doc_id"]: urlrules.BLOCK if r["toxic"] == 1 or r["quality"] == 0 else urlrules.ALLOW for r in labels.collect()}
    labelled = [(r["tokens"], lab[r["page_id"]]) for r in t.collect() if r["page_id"] in lab]
    rules = [(r["confidence"], r["support"], r["verdict"], list(r["rule_tokens"])) for r in urlrules.mine(spark.createDataFrame(labelled, "tokens array<string>, label string")).collect()]
    default = collections.Counter(v for _, v in labelled).most_common(1)[0][0].split("=")[1]
    tokens = {r["page_id"]: r["tokens"] for r in t.collect()}
    assert len(got) == pages.count() and len(rules) > 3
    for r in got:
        if r["rule"] is None:
            best = max((x for x in rules if set(x[3]) <= set(tokens[r["page_id"]])), default=None)
            assert (r["verdict"], r["mined_rule"]) == ((best[2], best[3]) if best else (default, None))


# 5


def test_padding_against_best_fit():
    rng = np.random.default_rng(1)
    for limit in (4096, 4032):
        sizes = [(int(n), int(n * rng.random() * 0.4)) for n in np.minimum(4032, rng.lognormal(5.5, 1.2, 1500).astype(int) + 2)]
        seqs, rest = packing.fill([packing.Piece(("d", None), 0, n, f) for n, f in sizes], 4096, 256, limit)
        assert not rest and sum(p.length for s in seqs for p in s) == sum(n for n, _ in sizes)
        bins: list[list[int]] = []  # best fit, whole documents, by decreasing size
        for n, f in sorted(sizes, reverse=True):
            fits = [b for b in bins if b[0] + n <= 4096 and b[1] + n - f <= limit and b[2] < 256]
            b = max(fits, key=lambda b: b[0], default=None)
            if b is None:
                bins.append(b := [0, 0, 0])
            b[0], b[1], b[2] = b[0] + n, b[1] + n - f, b[2] + 1
        # no more than best fit takes, but for the last ones of powers of two
        assert len(seqs) <= len(bins) + 12
        padding = sum(4096 - sum(p.length for p in s) for s in seqs if sum(p.length for p in s) & (sum(p.length for p in s) - 1))
        assert padding <= 0.001 * 4096 * len(seqs)


def test_loss_decides():
    # two pieces of equal length: the one whose loss suits what is left is taken
    p = [packing.Piece((i, None), 0, 32, f) for i, f in ((0, 0), (1, 32), (2, 16), (3, 16))]
    seqs, _ = packing.fill(p, 64, 4, 32)
    assert sorted(sum(x.loss for x in s) for s in seqs) == [32, 32]
    assert {frozenset(x.doc[0] for x in s) for s in seqs} == {frozenset((0, 1)), frozenset((2, 3))}


# 6


def test_null_and_repeated_ids_link_by_fingerprint(spark):
    def text(start, n=40):
        return " ".join(f"w{start}x{i}" for i in range(n))

    # texts whose fingerprints are one bit apart are found by trying
    from test_llm import plain_fingerprint

    a = text(1, 300)
    near = next(t for k in range(3000) if (plain_fingerprint(t := a + f" end{k}") ^ plain_fingerprint(a)).bit_count() == 1)
    rows = [(10, a), (None, near), (3, text(5)), (5, a), (5, text(9))]
    got = [(r["doc_id"], r["component_id"]) for r in simhash.fingerprint_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(10, 5), (None, 5), (3, 3), (5, 5), (5, 5)]))


def test_repeated_ids_in_near_duplicates(spark):
    base = " ".join(f"v{i}" for i in range(100))
    other = " ".join(f"o{i}" for i in range(100))
    rows = [(3, base, "x"), (5, base + " more", "x"), (5, other, "x"), (5, other, "a"), (9, other + " end", "x"), (None, base, "x"), (1, "lone", "x"), (2, None, "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(str, ((r["doc_id"], r["component_id"]) for r in simhash.near_duplicate_groups(df).collect())))
    assert got == sorted(map(str, [(3, 3), (5, 3), (5, 5), (5, 5), (9, 5), (1, 1), (2, 2), (4, 2)]))
    kept = sorted(map(str, (tuple(r) for r in simhash.one_of_each(df).collect())))
    # of the rows of id 5 the least one stays, column by column
    assert kept == sorted(map(str, [(3, base, "x"), (5, other, "a"), (None, base, "x"), (1, "lone", "x"), (2, None, "x")]))


def shuffled_bytes(spark):
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_of_near_duplicates_stay_where_they_lie(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{x:016x}" for x in rng.integers(0, 1 << 62, 2000).tolist()) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[7] + " more"), (201, texts[7]), (None, texts[7])]
    path = shared.new_dir(spark, "texts")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more ids than a broadcast takes
    try:
        before = shuffled_bytes(spark)
        kept = shared.written(simhash.one_of_each(spark.read.parquet(path)), "kept")
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == 201 and set(got) == set(rows) - {(200, texts[7] + " more"), (201, texts[7])}
    assert 0 < moved < sum(map(len, texts)) / 4


# 9


def test_samples_of_any_table():
    n = {"en": 10**12, "xx": 3, "de": 25 * 10**9}
    t = langid.thresholds(n, 5000)
    assert t["xx"] == langid.HASH_RANGE
    assert all(abs(n[k] * t[k] / langid.HASH_RANGE - 5000) < 1 for k in ("en", "de"))


def test_rare_languages_are_modelled(spark):
    en = [(i, f"the thing with that and those of them number {i} the other", "en") for i in range(9999)]
    rare = [(10**6, "zxq vwk qqj zzx kwv jqx zqk wvx", "ku"), (10**6 + 1, "zxq vwk qqj zzx kwv", None)]
    odd = [(10**6 + 2, "the thing with that", "not a language"), (10**6 + 3, "the thing", "EN-gb")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(en + rare + odd, "doc_id long, text string, lang string"), host=None).where("doc_id >= 1000000").collect()}
    assert [got[10**6 + i]["lang"] for i in range(4)] == ["ku", "ku", "en", "en"]


def plain_features(text):
    """Trigrams of letters, spelt out: bytes a-z and those beyond ASCII are letters, all else is blank."""
    b = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode().lower())
    out = collections.Counter()
    for i in range(len(b) - 2):
        if b[i : i + 2] != b"  ":
            out[((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 17] += 1
    return out


def test_fusion_is_that_of_plain_bayes(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], None if r["doc_id"] % 5 == 0 else r["lang"] if r["doc_id"] % 7 else "fr", f"h{r['doc_id'] % 9}.site.{r['lang']}" if r["doc_id"] % 4 else None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, said string, host string")
    got = {r["doc_id"]: r for r in langid.identify(df, declared="said", host="host").collect()}
    langs = sorted({r[2] for r in rows})
    counts = {k: collections.Counter() for k in langs}
    feats = {r[0]: plain_features(r[1]) for r in rows}
    for d, _, k, *_ in rows:
        w = min(1.0, 2000 / max(1, sum(feats[d].values())))
        for f, n in feats[d].items():
            counts[k][f] += n * w
    mass = {k: sum(counts[k].values()) + 0.1 * langid.FEATURES for k in langs}
    norm = lambda x: [v / sum(x) for v in x]
    score, post = {}, {}
    for d, *_ in rows:
        n = sum(feats[d].values())
        w = min(langid.TEMPER, langid.MOST_WEIGHT / n) if n else 0
        score[d] = [w * sum(c * math.log((counts[k][f] + 0.1) / mass[k]) for f, c in feats[d].items()) for k in langs]
        post[d] = norm([math.exp(s - max(score[d])) for s in score[d]])
    ok = [r for r in rows if any(97 <= c <= 122 or c >= 128 for c in r[1].encode().lower())]
    total = [sum(post[r[0]][i] for r in ok) for i in range(len(langs))]
    flat = norm([t + 1 for t in total])

    def grouped(key):
        out = {}
        for r in ok:
            if key(r) is not None:
                out[key(r)] = [a + b for a, b in zip(out.get(key(r), [0.0] * len(langs)), post[r[0]], strict=True)]
        return out

    suffix_of, domain_of = (lambda r: r[4] and r[4].split(".")[-1]), (lambda r: r[4] and ".".join(r[4].split(".")[-2:]))
    smooth = lambda n, q: [(a + langid.STRENGTH * b) / (sum(n) + langid.STRENGTH) for a, b in zip(n, q, strict=True)]
    suffixes, said = grouped(suffix_of), grouped(lambda r: r[3])
    sp = {k: smooth(n, flat) for k, n in suffixes.items()}
    dp = {k: smooth(n, sp[k.split(".")[-1]]) for k, n in grouped(domain_of).items()}
    hp = {k: smooth(n, dp[".".join(k.split(".")[-2:])]) for k, n in grouped(lambda r: r[4]).items()}
    given = lambda table, k: [math.log((a + langid.UNSEEN) / (t + langid.STRENGTH)) for a, t in zip(table[k], total, strict=True)] if k in table else [0.0] * len(langs)
    for r in rows:
        z = [a + b + c + math.log(p) for a, b, c, p in zip(score[r[0]], given(said, r[3]), given(suffixes, suffix_of(r)), hp.get(r[4], flat), strict=True)]
        q = norm([math.exp(v - max(z)) for v in z])
        assert got[r[0]]["lang"] == langs[q.index(max(q))] and abs(got[r[0]]["posterior"] - max(q)) < 1e-3


def test_pages_evidence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(1, "http://a.b/x", "<HTML class=x LANG='fr-FR'><script>var the = that</script><p>la maison de la</p>"), (2, None, None), (3, "no", "<p lang=es>x</p>"), (None, "http://c", "<html lang=en>the thing with</html>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in langid.identify_pages(pages, docs).collect()}
    assert len(got) == 4 and not got[2]["kept"] and got[2]["letters"] == 0 and got[1]["letters"] == 12
    said = pages.select("page_id", langid.declared_in(F.col("html")).alias("d")).collect()
    assert {r["page_id"]: r["d"] for r in said} == {1: "fr", 2: None, 3: None, None: "en"}
    assert langid.identify_pages(pages.limit(0), docs).count() == 0 and langid.identify_pages(pages, docs.limit(0)).where("kept").count() == 0


# 10


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(6)
    # chances of votes -1, 0, 1 where it isn't personal data, and where it is
    truth = [((0.7, 0.2, 0.1), (0.1, 0.1, 0.8)), ((0.5, 0.45, 0.05), (0.1, 0.5, 0.4)), ((0.3, 0.6, 0.1), (0.05, 0.35, 0.6)), ((0.6, 0.3, 0.1), (0.2, 0.3, 0.5)), ((0.4, 0.4, 0.2), (0.2, 0.4, 0.4))]
    counts = collections.Counter()
    real = collections.Counter()
    for _ in range(40_000):
        kind = int(rng.integers(0, 2))
        y = int(rng.random() < (0.3, 0.6)[kind])
        votes = tuple(int(rng.choice((-1, 0, 1), p=t[y])) for t in truth)
        counts[kind, votes] += 1
        real[kind, votes] += y
    rows = [(k, v, n) for (k, v), n in sorted(counts.items())]
    post, tables = pii.estimate(rows)
    for kind in (0, 1):
        for lab, t in zip(tables[kind], truth, strict=True):
            for y in (0, 1):
                assert all(abs(lab[y][v] - p) < 0.05 for v, p in zip((-1, 0, 1), t[y], strict=True))
    right = sum(max(real[k, v], n - real[k, v]) if (p > 0.5) == (2 * real[k, v] > n) else min(real[k, v], n - real[k, v]) for (k, v, n), p in zip(rows, post, strict=True))
    assert right / 40_000 > 0.99 * sum(max(real[k, v], n - real[k, v]) for k, v, n in rows) / 40_000


def iban(country, digits):
    rest = digits + "".join(str(ord(c) - 55) for c in country) + "00"
    return f"{country}{98 - int(rest) % 97:02d}{digits}"


def test_added_spans_held_out(spark):
    rng = np.random.default_rng(8)
    some = lambda alphabet, n: "".join(alphabet[int(i)] for i in rng.integers(0, len(alphabet), n))
    hexa, mixed, digit = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", "0123456789"
    words = lambda n: " ".join(f"{some('abcdefghij', int(k))}" for k in rng.integers(2, 9, n))
    rows, truth = [], {}
    for i in range(600):
        what = i % 8
        piece, real = {
            0: (f'token = "{some(hexa, 40)}"', ("secret", 40)), 1: (f"api_key: {some(mixed, 32)}", ("secret", 32)), 2: (f"commit {some(hexa, 40)}", None), 3: (f"see /path/{some(hexa, 32)}/img", None),
            4: (f"IBAN {iban('DE', some(digit, 18))} bank", ("iban", 22)), 5: (f"part {'AB' + some(digit, 2) + some(digit, 12)} stock", None), 6: ("the release-candidate-2024-notes file", None), 7: (f"password='{some(mixed, 20)}'", ("secret", 20)),
        }[what]
        rows.append((i, f"{words(20)} {piece} {words(20)}"))
        truth[i] = real
    got = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = wrong = 0
    for i, real in truth.items():
        added = [(k, int(b) - int(a)) for k, a, b in got[i] if k in pii.KINDS[pii.BASE :]]
        hit += real is not None and real in added
        wrong += sum(x != real for x in added)
    wanted = sum(v is not None for v in truth.values())
    assert hit / wanted >= 0.95 and hit / (hit + wrong) >= 0.95


def test_secrets_are_redacted_and_clash_with_nothing(spark):
    row = [(1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', 1, "c"), (2, None, 2, "c"), (3, "", 3, "c")]
    noise = [(10 + i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and {hashlib.sha1(b"a%d" % i).hexdigest()[:17]}', 0, "c") for i in range(30)]
    out = {r["doc_id"]: r for r in pii.redacted(spark.createDataFrame(row + noise, "doc_id long, text string, cands int, _t string")).collect()}
    assert out[1]["text"] == 'x token = "[SECRET]" y' and (out[1]["cands"], out[1]["_t"]) == (1, "c") and out[2]["text"] is None and out[3]["text"] == ""


def test_redacted_stores_texts_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "write to a@b.org", 16), (2, None, None)], "doc_id long, text string, n_chars long")
    stored, write = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, tag: stored.append(df.schema) or write(df, tag))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redacted(docs).collect()} == {1: ("write to [EMAIL]", 16), 2: (None, None)}
    assert [x.simpleString().count("text:string") for x in stored] == [1]


# Shared


@pytest.mark.parametrize("most_bits", [shared.MOST_BITS, 1 << 15])
def test_sifted_loses_no_key(spark, most_bits):
    keys = spark.range(0, 60_000, 3).select((F.col("id") * 7919 - 1000).alias("place"))
    rows = spark.range(60_000).select((F.col("id") * 7919 - 1000).alias("place"), F.col("id").alias("map")).unionByName(spark.sql("select cast(null as long) place, -1L map"))
    apart, perhaps = shared.sifted(rows, keys, "place", most_bits)
    assert apart.columns == ["place", "map"] and sorted(r["map"] for r in apart.union(perhaps).collect()) == list(range(-1, 60_000))
    assert apart.where("map % 3 = 0").count() == 0
    assert perhaps.count() <= (22_500 if most_bits > 1 << 15 else 50_000)
    none, no_rows = shared.sifted(rows, keys.limit(0), "place", most_bits)
    assert (none.count(), no_rows.count()) == (60_001, 0)


def test_the_session_stays_as_it_was(spark):
    before = {k: v for k, v in spark.conf.getAll.items() if "arrow" in k}
    simhash.fingerprint_components(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert before == {k: v for k, v in spark.conf.getAll.items() if "arrow" in k}


def test_slices_are_bounded():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 100 + ["y" * 50_000] * 3})
    parts = list(shared.slices([b, b.slice(0, 0)], 40, 20_000))
    assert sum(p.num_rows for p in parts) == 103 and all(p.num_rows == 1 or p.nbytes <= 20_000 for p in parts)


# salvage in linear time


class Counted(io.BytesIO):
    """A file that counts the bytes read of it."""

    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("length", ["999999999999", "1500000", "0"])
@pytest.mark.parametrize("zipped", [True, False])
def test_a_damaged_length_costs_no_more_than_the_file(monkeypatch, zipped, length):
    recs = [record(i, 1000) for i in range(3000)]
    bad = re.sub(rb"(Content-Length: )\d+(\r\n\r\nHTTP)", rb"\g<1>" + length.encode() + rb"\2", recs[0])
    pack = warc.gzip_member if zipped else bytes
    data = b"".join([pack(bad), *map(pack, recs[1:])])
    f = Counted(data)
    tracemalloc.start()
    got = [(g[0], g[3]["x-page-id"]) if g[0] == "record" else (g[0], g[1], g[2]) for g in warc.salvage(f, len(data))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [("gap", 0, len(pack(bad))), *[("record", str(i)) for i in range(1, 3000)]]
    assert f.taken < 2 * len(data) + (4 << 20) and peak < 16 << 20


def test_large_records_pass_in_pieces():
    body = b"0123456789abcdef" * (1 << 21)  # 32 MiB, compressed to a few KiB
    large = warc.build_record(1, "u", body, hashlib.sha256(body).hexdigest(), None)
    data = warc.gzip_member(large) + warc.gzip_member(record(2, 50))
    del large
    tracemalloc.start()
    got = [(g[3]["x-page-id"], g[4].payload_bytes, g[4].payload_sha256) for g in warc.salvage(io.BytesIO(data), len(data))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == ("1", len(body), hashlib.sha256(body).hexdigest()) and got[1][0] == "2" and peak < 8 << 20
    with pytest.raises(ValueError, match="header block"):
        warc.build_record(1, "x" * (warc.MOST_HEADER + 1), b"", "", None)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 64])
def test_pieces_of_any_size(monkeypatch, size):
    """Headers, the blank line before a payload and a record's end may be cut anywhere."""
    monkeypatch.setattr(warc, "PIECE", size)
    body = b"\r\n\r\n<p>\r\n\r\n"
    one = warc.build_record(1, "http://x", body, hashlib.sha256(body).hexdigest(), None)
    for data in (one + record(2, 30), warc.gzip_member(one) + warc.gzip_member(record(2, 30))):
        got = [g[4] for g in warc.salvage(io.BytesIO(data), len(data), payloads=True)]
        assert [(bytes(r.payload), r.payload_bytes) for r in got][0] == (body, len(body)) and got[0].payload_sha256 == hashlib.sha256(body).hexdigest() and b"Content-Length: 11" in got[0].http
        assert len(got) == 2


# groups whose members aren't all similar to the smallest one


@pytest.mark.parametrize("block", [2, 256])
def test_members_unlike_their_lead_are_compared(spark, block):
    """Chains, in which each text is similar to its neighbours only, and stars around a lead."""
    words = [f"w{i}" for i in range(700)]
    texts = [" ".join(words[i * 15 : i * 15 + 300]) for i in range(12)]  # neighbours share 281 of 311 shingles
    texts += [" ".join([f"s{i}" for i in range(200)] + [f"x{k}"] * (k % 2)) for k in range(30)] + ["a b c d e f"]
    sets = [set(simhash.shingles([w.encode() for w in t.split()], 5)) for t in texts]
    rows = list(enumerate(texts))
    nodes = spark.createDataFrame([(i, 0 if i < 12 else 12) for i in range(42)], "node long, component long")
    shingle = [(i, np.unique(simhash.shingle_hashes([w.encode() for w in t.split()], 5)).tobytes()) for i, t in rows]
    links = simhash._exact_links(nodes, spark.createDataFrame(shingle, "node long, shingles binary"), block)
    got = {r["node"]: r["component"] for r in shared.connected_components(links).collect()}
    root = list(range(42))
    for i in range(42):
        for j in range(i):
            if (i < 12) == (j < 12) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert len(sets[0] & sets[5]) < 0.8 * len(sets[0] | sets[5])
    assert [got.get(i, i) for i in range(42)] == root


# rules that decide


def addresses(rng, n, first=0):
    """Pages of which those on a spam host, or in a folder of a shop, are bad nine times in ten, others one in five."""
    rows, labels = [], []
    for i in range(first, first + n):
        host, folder = f"h{rng.integers(0, 12)}.example.net", f"f{rng.integers(0, 12)}"
        spam = host.startswith("h3.") or (host.startswith("h5.") and folder == "f7")
        rows.append((i, f"http://{host}/{folder}/p{i}.html"))
        labels.append((i, int(rng.random() < (0.9 if spam else 0.2)), spam))
    return rows, labels


def test_only_rules_that_tell_something_decide(spark):
    rng = np.random.default_rng(11)
    rows, labels = addresses(rng, 6000)
    held, truth = addresses(rng, 3000, 6000)
    pages = spark.createDataFrame(rows + held, "page_id long, url string")
    lab = spark.createDataFrame([(i, 1, bad) for i, bad, _ in labels], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urlrules.judge(pages, lab, [], lift=urlrules.LIFT, deviations=urlrules.DEVIATIONS).collect()}
    blocked = {i for i, _, _ in truth if got[i]["verdict"] == "block"}
    spam = {i for i, _, s in truth if s}
    assert len(blocked & spam) >= 0.95 * len(spam) and len(blocked & spam) >= 0.95 * len(blocked)
    # what chance alone makes is no rule: without a signal every page gets the default
    noise = spark.createDataFrame([(i, 1, int(rng.random() < 0.3)) for i, _, _ in labels], "doc_id long, quality int, toxic int")
    assert {r["verdict"] for r in urlrules.judge(pages, noise, [], lift=urlrules.LIFT, deviations=urlrules.DEVIATIONS).collect()} == {"allow"}
    assert urlrules.judge(pages, noise, []).where("mined_rule is not null").count() > 1000
