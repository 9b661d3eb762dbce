"""Clusters, manifest and quality against plain Python; their hard cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from itembank.llm import divergence, kdmeans, merkle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def same(got, want):
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# clusters


def lloyd(rows, k=40, rounds=5, dim=64):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for _, v in kept], dtype=np.int64).reshape(-1, dim)
    c = [v for _, v in sorted((sha(f"2:{i}"), v) for i, v in kept if i is not None)[:k]]

    def nearest():
        d = ((x[:, None, :] - np.array(c, np.int64)[None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        at, _ = nearest()
        c = [[int(s) // int((at == j).sum()) for s in x[at == j].sum(0)] if (at == j).any() else c[j] for j in range(len(c))]
    at, far = nearest()
    return [(i, int(at[n]), int(far[n]), int(far[at == at[n]].sum()), int(far.sum()), sha(",".join(map(str, c[at[n]])))) for n, (i, _) in enumerate(kept)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.2, (300, 64)))]
    rows += [(300 + i, [float(x) for x in rng.integers(-2, 3, 64)]) for i in range(200)]
    rows += [(600 + i, rows[7][1]) for i in range(150)] + [(5, rows[5][1])] * 3 + [(None, rows[9][1]), (None, [0.0] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [math.inf] + [1.0] * 63), (905, [math.nan] * 64), (906, [1.0] * 65), (907, [-0.0] * 64), (908, [1000.0] * 64)]
    return rows


def test_clusters_are_those_of_plain_rounds(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit(1), "v": F.lit("clash"), "ids": F.lit(0)}).repartition(3)
    assert same(kdmeans.cluster(df, block_rows=100).collect(), lloyd(vectors))


def test_large_components_stay_exact(spark):
    rows = [(i, [float((i * 7919 + j * 104729) % 100_003 - 50_000) * 8 for j in range(64)]) for i in range(120)]
    assert max(abs(x) for _, v in rows for x in v) * 256 > kdmeans.MOST_IN_DOUBLE
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert same(kdmeans.cluster(df).collect(), lloyd(rows))
    with pytest.raises(Exception, match="too large"):
        kdmeans.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert same(kdmeans.cluster(df).collect(), lloyd(rows))
    assert kdmeans.cluster(df.where("vec_id < 0")).collect() == []
    assert kdmeans.cluster(df.where("vec_id < 0")).columns == kdmeans.cluster(df).columns
    unknown = kdmeans.cluster(df.select(F.lit(None).cast("long").alias("vec_id"), "embedding")).collect()
    assert [tuple(r) for r in unknown] == [(None,) * 6] * 3


def test_pruning_assigns_whole_nodes(spark):
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([rng.normal(m, 0.02, (500, 64)) for m in rng.normal(0, 1, (8, 1, 64))])).astype(np.int64)
    tree, c = kdmeans.Tree(x), x[::500]
    n, s, looked = kdmeans.round_sums(tree, x, c)
    at = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
    assert n.tolist() == np.bincount(at, minlength=8).tolist() and (s == np.stack([x[at == k].sum(0) for k in range(8)])).all()
    assert looked < len(x) / 5


def test_equal_vectors_make_one_leaf():
    x = np.ones((1000, 64), np.int64)
    tree = kdmeans.Tree(x)
    assert len(tree.start) == 1
    assert kdmeans.round_sums(tree, x, np.stack([x[0], x[0], x[0] + 1]))[0].tolist() == [1000, 0, 0]


# manifest


def manifest(rows, arity=2):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, add=0: sha(enc(r["doc_id"]) + enc(r["source"]) + enc(r["lang"]) + enc(None if r["n_chars"] is None else r["n_chars"] + add) + enc(r["text"]))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
        return out

    def others(levels, i):
        for level in levels[:-1]:
            r = i // arity * arity
            yield "".join(level[r:i]), "".join(level[i + 1 : r + arity])
            i //= arity

    by = collections.defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    names = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        by[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in by[k]]) for k in names}
    top = tree([trees[k][-1][0] for k in names])
    for j, k in enumerate(names):
        for i, r in enumerate(by[k]):
            path = [*others(trees[k], i), *others(top, j)]
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            d = leaf(r, int(bad))
            for a, b in path:
                d = sha(a + d + b)
            yield r["doc_id"], leaf(r), trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), d, d == top[-1][0]


def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 0


@pytest.mark.parametrize("arity", [2, 3])
def test_proofs_are_those_of_plain_trees(spark, arity):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hard = [(None, None, None, None, None), (None, None, None, None, None), (5, "", "de", "s", None), (5, "", "de", "s", None), (14, "ü", "", "", -3), (2, "x", None, "", 9), (7, "y" * 20000, "-", "s", 1), (7, "y" * 20000, "=", "s", 1)]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(hard, DOCS)).withColumns({"tree": F.lit(1), "index": F.lit("clash"), "digest": F.lit(0)})
    got = merkle.verified(docs, tampered(), arity).collect()
    assert same(got, manifest(docs.collect(), arity))
    assert 0 < sum(not r["verified"] for r in got) < len(got)


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "t", None, "s", 1)], DOCS)
    (r,) = merkle.verified(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == sha("")
    assert merkle.verified(one.where("false"), tampered()).collect() == []


def test_node_table_has_each_node_once(spark):
    leaves = spark.range(777).select(F.lit("=a").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    m = merkle.build(leaves, ["id"], span=3)
    nodes = m.forest.nodes()
    want, n = 0, 777
    while n > 1:
        want, n = want + n, -(-n // 2)
    assert nodes.count() == nodes.select("tree", "level", "index").distinct().count() == want + 1
    assert merkle.proofs(m, ["id"]).where(F.size("path") != 10).count() == 0


# quality


def figures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


HARD = ["", None, " \n\t ", "one", "naïve ÇA l'été! #", "a" * 9000, "word " * 30000, "日本語 text " * 60, "x y z x y z x", "a\x0bb\x1cc\x85d", "l\nl \nl\n\nl", "a b a b a b a", "|<>|" * 99, "𝄞 # 𝄞\r\n" * 70]


def test_base_figures(spark):
    docs = spark.createDataFrame([(i, t, None if i % 3 else "en", "s", 1) for i, t in enumerate([*HARD, HARD[4]])], DOCS)
    docs = docs.union(spark.read.parquet(f"{SF}/documents.parquet").select(*docs.columns)).withColumns({"w": F.lit("clash"), "chars": F.lit(1), "common": F.lit(2), "n_words": F.lit(3), "kept": F.lit(4)})
    got = divergence.judged(docs).collect()
    of = collections.defaultdict(set)
    for r in docs.collect():
        of[r["doc_id"]].add(figures(r["text"]))
    assert len(got) == docs.count()
    assert all(tuple(r)[1:7] in of[r["doc_id"]] for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert divergence.judged(docs.where("false")).collect() == []


def test_words_that_collide_in_part_are_told_apart(spark):
    text = " ".join(f"w{i % 997}" for i in range(40000)) + " " + " ".join(f"v{i}" for i in range(40000))
    docs = spark.createDataFrame([(1, text, "en", "s", 1)], DOCS)
    assert tuple(divergence.judged(docs).first())[1:7] == figures(text)


def plain_distance(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    m = (p + q) / 2
    part = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_distance(spark):
    cases = [([1, 2, 3], [3, 2, 1]), ([1, 0], [0, 1]), ([5, 5], [50, 50]), ([0, 7, 1], [2, 0, 0])]
    rows = spark.createDataFrame(cases, "p array<long>, q array<long>").select("p", "q", divergence.distance(F.col("p"), F.col("q")).alias("d")).collect()
    for r in rows:
        assert abs(r["d"] - plain_distance(r["p"], r["q"])) < 1e-9
    assert spark.createDataFrame([([0, 0], [1, 1])], "p array<long>, q array<long>").select(divergence.distance(F.col("p"), F.col("q"))).first()[0] is None


def test_common_words_are_those_of_most_documents(spark):
    docs = spark.createDataFrame([(i, t, la, "s", 1) for i, (t, la) in enumerate([("a a a b", "x"), ("b c", "x"), ("b a", "x"), ("z", None), ("é", "y")])], DOCS)
    assert {r["lang"]: r["common"] for r in divergence.common_words(docs, 2).collect()} == {"x": ["b", "a"], "y": ["é"]}


def test_verdicts_on_made_documents(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["the", "of", "and", "to", "in", "is", *(f"w{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(500))]
    share = np.array([0.1] * 6 + [0.4 / 500] * 500)
    prose = lambda n: " ".join(rng.choice(vocabulary, n, p=share))
    bare = lambda n: " ".join(rng.choice(vocabulary[6:], n))
    rows = [(i, prose(300), "en", "s", 1) for i in range(100)] + [(200 + i, bare(300), "en", "s", 1) for i in range(5)]
    rows += [(300 + i, re.sub(r"(\w+)", r"\1#$%", prose(300)), "en", "s", 1) for i in range(5)] + [(400 + i, prose(80), "en", "s", 1) for i in range(20)]
    rows += [(500, bare(300), "rare", "s", 1), (501, bare(300), None, "s", 1)]
    got = {r["doc_id"]: r for r in divergence.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["kept"] for i in got if i < 200 or 400 <= i)
    assert all(got[i]["reason"] == "words" for i in range(200, 205))
    assert all(got[i]["reason"] == "characters" for i in range(300, 305))
    assert got[500]["word_distance"] is None and got[501]["word_distance"] is None


def test_no_python_on_the_main_path(spark):
    plan = divergence.judged(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|MapInPandas", plan)
