"""The corpus operators against brute force, round trips and held-out accuracy; hard cases of each."""

import collections
import hashlib
import io
import math
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from itembank.llm import covertree, decontaminate, langid, licenses, packing, pii, queries, shared, simhash, sstable, urlrules, warc
from itembank.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = ["", None, " \n\t ", "one", "one two", "naïve ÇA, l'été!", "a" * 9000, "word " * 30000, "日本語 text", "x<|endoftext|>y", "same words here now", "same words here now", "Same  words here NOW"]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "h.example.org", 1) for i, t in enumerate(HARD)]
    rows += [(5, HARD[5], "en", "s", 1), (None, "no id at all", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit("clash"), "component_id": F.lit(1), "node": F.lit(2), "start": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def components(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck().execute(queries.ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(repr([r[c] for c in sorted(cols)]) for r in got.collect()) == sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in want.fetchall())


ROWS_OF = {"op1_cover_tree": "embeddings", "op3_warc": "pages", "op4_url_rules": "pages", "op9_language": "pages", "op2_sstable": "documents", "op6_simhash": "documents", "op10_pii": "documents", "language_of_documents": "documents"}


@pytest.mark.parametrize("name", sorted(ROWS_OF))
def test_a_row_for_each_of_the_table(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{ROWS_OF[name]}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - ROWS_OF.keys()))
def test_every_other_query_finds_something(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


# 1


@pytest.mark.parametrize("block", [2048, 20])
def test_cover_tree(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.1, base[:9], base[:5] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 30 % 3)) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] + [1.0] * 7, 1), (905, [None] * 8, 1), (906, x[0].tolist(), None), (907, [1e-30] * 8, 2), (908, [1e30] * 8, 2)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df, block_rows=block).collect()}
    every = rows + [r for r in bad if r[0] > 906]
    u = covertree.unit(np.array([r[1] for r in every]))
    near = (u @ u.T >= 0.93) & (np.array([r[2] for r in every])[:, None] == np.array([r[2] for r in every]))
    np.fill_diagonal(near, False)
    comp = components(len(every), zip(*np.nonzero(near), strict=True))
    for i, r in enumerate(every):
        g = got[r[0]]
        assert (g["n_links"], g["component_id"], g["kept"]) == (near[i].sum(), every[comp[i]][0], comp[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 907))
    assert covertree.near_duplicates(df.limit(0)).count() == 0


# 2


def test_encoder_is_the_librarys():
    enc, lib = Encoder(WORDS), Tokenizer.from_file(WORDS)
    for t in [*HARD, "it's we'll !'s ''s don't", "ª²½ Ÿ ſ ŉ", "a\x85b\x0bc", "İ", "“q” …€ 12"]:
        assert enc.ids(t).tolist() == lib.encode(t or "", add_special_tokens=False).ids
    for other in ("byte_bpe_50k.json",):
        assert Encoder(public_tokenizers.path(other)).ids("Hello wörld 😀").tolist() == Tokenizer.from_file(public_tokenizers.path(other)).encode("Hello wörld 😀", add_special_tokens=False).ids


def test_sstable(spark, hard):
    manifest = sstable.write_shards(hard, WORDS, 1, shared.new_dir(spark, "t"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sstable.read_shards(manifest).collect())
    lib, at = Tokenizer.from_file(WORDS), 0
    want = sorted(((r["doc_id"], lib.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in hard.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for (start, doc_id, n, crc), (want_id, ids) in zip(got, want, strict=True):
        assert (start, doc_id, n, crc) == (at, want_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert sstable.write_shards(hard.limit(0), WORDS, 1, shared.new_dir(spark, "t")).count() == 0


def test_sstable_lookup_and_damage():
    out = io.BytesIO()
    w = sstable.Writer(out, 2)
    for i in range(-500, 3000, 2):
        w.add(sstable.key_of(i), np.arange(i % 90, dtype="<u2").tobytes())
    w.close()
    r = sstable.Reader(out)
    assert len(r.blocks) > 1 and [sstable.id_of(k) for k, _ in r] == list(range(-500, 3000, 2))
    assert r.lookup(448)[0].tolist() == list(range(448 % 90)) and r.lookup(449) == [] and r.lookup(None) == []
    data = bytearray(out.getvalue())
    data[10] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(io.BytesIO(bytes(data))))
    runs = sstable.Runs(most=500)
    for i in range(50, 0, -1):
        runs.add(sstable.key_of(i), b"x")
    assert [sstable.id_of(k) for k, _ in runs.in_order()] == list(range(1, 51))


# 3


def test_warc(spark):
    long = "é" * 80
    rows = [(3, "u", long), (1, "u\r\nx", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "x" * 99), (7, "u", "x" * 99), (None, "u", long), (1, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.read_archives(warc.write_archives(pages, shared.new_dir(spark, "w"))).collect()
    want = []
    for i, _, h in rows:
        revisit = h == long and i != 1
        want.append((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert sorted(map(repr, want)) == sorted(repr((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert warc.read_archives(warc.write_archives(pages.limit(0), shared.new_dir(spark, "w"))).count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    recs = [warc.build_record(i, "http://x", b"payload %d " % i * 50, hashlib.sha256(b"%d" % i).hexdigest(), None) for i in range(5)]
    parts = [warc.gzip_member(r) if zipped else r for r in recs]
    for damage in ("flip", "cut", "junk", "tail"):
        p = list(parts)
        if damage == "flip":
            p[2] = p[2][:-40] + bytes([p[2][-40] ^ 255]) + p[2][-39:]
        elif damage == "cut":
            p[2] = p[2][: len(p[2]) // 2]
        elif damage == "junk":
            p[2] = b"\x1f\x8b\x08junk WARC/1.0 more" * 3
        else:
            p[4] = p[4][:-9]
        data = b"".join(p)
        got = list(warc.salvage(io.BytesIO(data), len(data)))
        assert [g[3]["x-page-id"] for g in got if g[0] == "record"] == [str(i) for i in range(5) if i != (4 if damage == "tail" else 2)]
        assert sum(g[2] for g in got) == len(data) and [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got]])[:-1].tolist()
        assert [g[1] for g in got if g[0] == "gap"] == [sum(map(len, p[: 4 if damage == "tail" else 2]))]


def test_salvage_across_reads(monkeypatch):
    def archive(sizes):
        rng = np.random.default_rng(1)
        recs = [warc.build_record(i, "http://x", rng.bytes(n), hashlib.sha256(b"%d" % i).hexdigest(), None) for i, n in enumerate(sizes)]
        return b"".join(map(warc.gzip_member, recs))

    for chunk, sizes in ((1 << 20, [(1 << 20) - 440 - d for d in range(0, 90, 15)]), (1000, range(300, 1700))):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        for part in [[n, 500] for n in sizes] if chunk > 1000 else [sizes]:
            data = archive(part)
            assert [(g[0], g[3]["x-page-id"]) for g in warc.salvage(io.BytesIO(data), len(data))] == [("record", str(i)) for i in range(len(part))]


def test_long_address():
    data = warc.gzip_member(warc.build_record(1, "http://x/" + "a" * 100_000, b"text", "0", None))
    assert [g[0] for g in warc.salvage(io.BytesIO(data), len(data))] == ["record"]


# 4


def test_url_rules(spark):
    urls = ["http://A.Example.ORG/es/1?q", "http://example.org/en/12", "http://example.org/en/2", "ftp://b.com/fr/", "http://b.com/de/x", "http://xorg/", "http://org/", "http://org", None, "no scheme", "", "http://casino.net/p/1#f", "http://good.net/p/1", "http://h.net?x/de/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (11, urls[11])]
    rows += [(100 + i, f"http://casino.net/p/{i}") for i in range(30)] + [(200 + i, f"http://good.net/p/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("tokens", F.lit("clash"))
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(30)] + [(200 + i, 1, 0) for i in range(60)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urlrules.judge(pages, labels, queries.URL_RULES).collect()}
    want = {0: ("example.org/es/", "block"), 1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: ("com/fr/", "allow"), 4: ("com/de/", "block"), 6: ("org/", "allow"), 11: (None, "block"), 12: (None, "allow")}
    assert all((got[i]["rule"], got[i]["verdict"]) == w for i, w in want.items())
    assert all(got[i]["rule"] is None for i in (5, 7, 8, 9, 10, 13)) and (got[13]["host"], got[13]["path"]) == ("h.net", "") and got[9]["host"] == "" == got[8]["path"]
    assert got[0]["host"] == "a.example.org" and got[0]["path"] == "/es/1"
    assert urlrules.judge(pages, labels.limit(0), queries.URL_RULES).count() == len(rows) and urlrules.judge(pages.limit(0), labels, []).count() == 0


# 5


@pytest.mark.parametrize("limits", [{}, {"tokens": 64, "segments": 3, "loss": 40}])
def test_packing(spark, hard, limits):
    rows = packing.pack(hard, WORDS, 2, with_ids=True, **limits).collect()
    lim = {"tokens": 4096, "segments": 256, "loss": 4032} | limits
    seqs: dict = {}
    whole: dict = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0, *[r["length"] for r in s]])[:-1].tolist()
        assert len(s) <= lim["segments"] and sum(r["length"] for r in s) <= lim["tokens"] and sum(r["loss_length"] for r in s) <= lim["loss"]
    lib = Tokenizer.from_file(WORDS)
    want = sorted(len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in hard.collect())
    assert sum(r["length"] for r in rows) == sum(want)
    # no text of several lines here, so every token bears loss and limits the sequences
    full = sorted((sum(r["length"] for r in s) for s in seqs.values()), reverse=True)
    assert sum(n == min(lim["tokens"], lim["loss"]) for n in full) >= len(full) - 13 * spark.sparkContext.defaultParallelism or limits
    assert packing.pack(hard.limit(0), WORDS, 2).count() == 0


def test_packing_with_prompts():
    p = [packing.Piece(("d", None), 0, n, f) for n, f in ((50, 40), (30, 0), (20, 20), (64, 10), (5, 0))]
    seqs, rest = packing.fill(p, 64, 4, 32)
    assert not rest and sum(x.length for s in seqs for x in s) == 169
    assert all(sum(x.length for x in s) <= 64 and sum(x.loss for x in s) <= 32 and len(s) <= 4 for s in seqs)


# 6


def test_covering_masks():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        rng = np.random.default_rng(0)
        for _ in range(300):
            diff = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(m & diff == 0 for m in masks)


def plain_fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, hard, docs):
    df = docs.unionByName(hard.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10**6), allowMissingColumns=True)
    rows = sorted({(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}, key=lambda r: r[0])
    fp = [plain_fingerprint(t) for _, t in rows]
    comp = components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2])
    got = {r["doc_id"]: r for r in simhash.fingerprint_components(df).collect()}
    for i, (d, _) in enumerate(rows):
        assert (got[d]["fingerprint"], got[d]["component_id"]) == (f"{fp[i]:016x}", rows[comp[i]][0])
    assert simhash.fingerprint_components(hard).count() == len(HARD) + 2 and simhash.fingerprint_components(hard.limit(0)).count() == 0


def test_large_buckets_are_exact(spark):
    rng = np.random.default_rng(3)
    fps = {int(rng.integers(0, 1 << 12)) << 3 for _ in range(400)} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    nodes = sorted(fps)
    df = spark.createDataFrame(list(enumerate(nodes)), "node long, fp long")
    want = components(len(nodes), [(i, j) for i in range(len(nodes)) for j in range(i) if (nodes[i] ^ nodes[j]).bit_count() <= 2])
    for small in (2, 32):
        got = {r["node"]: r["component"] for r in shared.connected_components(simhash.covering_links(df, 2, small)).collect()}
        assert [got.get(i, i) for i in range(len(nodes))] == want


def test_near_duplicates(spark, docs, hard):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs).collect()}
    rows = sorted((r["doc_id"], set(simhash.shingles((r["text"] or "").encode().lower().split(), 5))) for r in docs.collect())
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(rows[i][1] & rows[j][1]) >= 0.8 * len(rows[i][1] | rows[j][1])])
    assert [got[d] for d, _ in rows] == [rows[c][0] for c in comp]
    kept = simhash.one_of_each(hard.select("doc_id", "text", "lang", "source", "n_chars"))
    assert {10, 0} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id in (11, 12, 1, 2)").count() == 0 and kept.where("doc_id = 5").count() == 1


def test_near_duplicates_of_any_kind(spark):
    rng = np.random.default_rng(5)
    rows, pairs = [], []
    for kind in ("longer", "shorter", "repeated"):
        for size in [60, 200, 1000] * 8:
            w = [f"w{int(x)}" for x in rng.zipf(1.3, size) % 50_000]
            more = [f"rare{int(x)}" for x in rng.integers(0, 10**9, size // 5)]
            text = {"longer": w + more, "shorter": w[: size * 5 // 6], "repeated": w + w[:20] * (size // 6)}[kind]
            a, b = (set(simhash.shingles([x.encode() for x in t], 5)) for t in (w, text))
            if len(a & b) >= 0.8 * len(a | b):
                pairs.append(len(rows))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(text))]
    assert len(pairs) > 50
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i + 1] for i in pairs] == pairs


def test_near_duplicates_by_fingerprints(spark):
    # no table's key is shared, so only fingerprints can join these: 3 with 5 (2 bits), 5 with 9 (2 others), 9 with none of 11's 40 bits
    prints = {3: 0, 5: 0b11, 9: 0b1111, 11: (1 << 40) - 1}
    cols = ["node", "fp", *simhash.SIGN_COLS, *simhash.KEY_COLS]
    rows = [(n, fp, *[n] * len(simhash.SIGN_COLS), *[n * 100 + j for j in range(len(simhash.KEY_COLS))]) for n, fp in prints.items()]
    reps = simhash._with_sim(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in cols)))
    assert {r["node"]: r["sim"] for r in reps.collect()} == {3: 3, 5: 3, 9: 3, 11: 11}
    assert {r["node"]: r["component"] for r in shared.connected_components(simhash._candidate_links(reps)).collect()} == {3: 3, 5: 3, 9: 3}


def test_members_of_a_bucket_meet(spark):
    # those in the middle are close to the first of their bucket and to the last ones; the last ones aren't close to the first
    rows = []
    for start, n in ((0, 1), (1000, 400)):
        for i in range(1 + 2 * n):
            unlike = 0 if i == 0 else 40 if i <= n else 80
            nibbles = "1" * unlike + "0" * (128 - unlike)
            rows.append((start + i, *[int(nibbles[j : j + 16], 16) for j in range(0, 128, 16)], start, *[-(start + i) * 100 - j - 1 for j in range(len(simhash.KEY_COLS) - 1)]))
    reps = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["node", *simhash.SIGN_COLS, *simhash.KEY_COLS]))
    got = {r["node"]: r["component"] for r in shared.connected_components(simhash._candidate_links(reps)).collect()}
    assert got == {r[0]: 1000 * (r[0] >= 1000) for r in rows}


# 7


def test_licenses(spark, hard):
    mit = "Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software and associated\n * documentation files"
    rows = [
        (1, "a longer intro here\nReleased under the MIT license\nbye then"), (2, "Released under the the licence of MIT men"), (3, "ALL RIGHTS RESERVED"), (3, "ALL RIGHTS RESERVED"), (4, None),
        (5, f"/*\n * {mit} and more\n */ code"), (6, "Acme 2020. Released under the MIT License. Then more words than that."), (7, "word " * 9000 + "all rights reserved by us"), (8, "Licensed under CC BY 4.0."),
        (None, "Licensed under the MIT License."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license": F.lit("clash"), "m": F.lit(1), "norm": F.lit(2), "w": F.lit(3)})
    got = sorted((str(r["doc_id"]), r["license"], r["unit"], r["position"]) for r in licenses.scan(df).collect())
    assert got == [
        ("1", "MIT", "line", 2), ("3", "proprietary", "line", 1), ("3", "proprietary", "line", 1), ("5", "MIT", "window", 0), ("6", "MIT", "window", 2), ("7", "proprietary", "window", 9000),
        ("8", "CC-BY-4.0", "line", 1), ("None", "MIT", "line", 1),
    ]
    assert licenses.scan(hard).count() == 0 and licenses.scan(df.limit(0)).count() == 0


def test_every_template_is_found_in_itself(spark):
    df = spark.createDataFrame([(i, t.replace(", ", ",\n")) for i, (_, t) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    got = {(r["doc_id"], r["template_no"]): r["dice"] for r in licenses.scan(df).collect()}
    assert all(got.get((i, i)) == 1.0 for i in range(len(licenses.TEMPLATES)))
    parts = licenses.telling([licenses.template_bigrams(t) for _, t in licenses.TEMPLATES])
    for _, t in licenses.TEMPLATES:
        s = licenses.template_bigrams(t)
        assert sum(not any(p in b for p in parts) for b in s) < 0.8 * len(s) / 1.2


# 8


def plain_weights(items):
    """Shingles of each item, and the weight of any shingle."""
    every = {}
    for i, t in items:
        w = (t or "").lower().encode().split()
        k = min(5, len(w))
        if w and i is not None:
            every[i] = (len(w), k, [b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)])
    n, df = len(every), {}
    for _, _, g in every.values():
        for x in set(g):
            df[x] = df.get(x, 0) + 1
    return every, lambda x: round(math.log(1 + n / df[x] if x in df else 1 + n) * 2**20) / 2**20


def plain_similarity(a, b, weight):
    ca, cb = collections.Counter(a), collections.Counter(b)
    both, either = (sum(weight(x) * f(ca[x], cb[x]) for x in ca.keys() | cb.keys()) for f in (min, max))
    return both / either


def plain_simhash(grams, weight):
    import xxhash

    total = sum(map(weight, grams))
    hs = [(xxhash.xxh64_intdigest(g, 42), weight(g)) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(w for h, w in hs if h >> b & 1) > total)


def test_decontamination(spark, docs, hard):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda df: sorted((r["doc_id"], r["item_id"], r["start_word"], r["hamming"], round(r["similarity"], 9)) for r in df.collect())
    got = rows(decontaminate.leaks(docs, bench))
    assert got == rows(decontaminate.leaks(docs, bench, block_chars=2000))  # weights don't depend on the blocks
    every, weight = plain_weights([(r["item_id"], r["text"]) for r in bench.collect()])
    near, all_similar = set(), set()
    for d in docs.collect():
        w = (d["text"] or "").lower().encode().split()
        for item, (size, k, grams) in every.items():
            have, prints = set(grams), plain_simhash(grams, weight)
            for s in range(max(1, len(w) - size + 1)):
                mine = [b" ".join(w[j : j + k]) for j in range(s, min(s + size, len(w)) - k + 1)]
                if mine and len(have.intersection(mine)) > 0.5 * len(have) and plain_similarity(mine, grams, weight) >= 0.8:
                    all_similar.add((d["doc_id"], item))
                    if (plain_simhash(mine, weight) ^ prints).bit_count() <= decontaminate.RADIUS:
                        near.add((d["doc_id"], item))
    assert {g[:2] for g in got} == near and near and len(near) >= 0.99 * len(all_similar)
    few = spark.createDataFrame([(1, "One two"), (2, None), (None, "one"), (3, ""), (4, "same words here now")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(hard, few).collect()} == {(4, 1), (10, 4), (11, 4), (12, 4)}
    assert decontaminate.leaks(hard, few.limit(0)).count() == 0 == decontaminate.leaks(hard.limit(0), few).count()


def test_recall_of_the_radius_at_the_threshold():
    # windows right at the threshold: a few words of an item replaced, so that 0.8 is just reached
    rng = np.random.default_rng(11)
    items = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 3000, int(n)))) for i, n in enumerate(rng.integers(30, 90, 300))]
    every, weight = plain_weights(items)
    index = decontaminate.Index(items)
    tried = found = 0
    for i, t in items:
        w = t.split()
        for cut in range(1, 4):
            changed = [f"new{j}" if j < cut else x for j, x in enumerate(w)] + ["tail"] * 3  # from the start on, so that few shingles change
            grams = [b" ".join(x.encode() for x in changed[j : j + 5]) for j in range(len(w) - 4)]
            if 0.8 <= plain_similarity(grams, every[i][2], weight) < 0.88:
                tried += 1
                found += i in {r[0] for r in index.search([x.encode() for x in changed])}
    assert tried > 100 and found >= 0.99 * tried


def test_documents_shorter_than_an_item(spark):
    words = [f"w{i}" for i in range(37)]
    items = spark.createDataFrame([(i, " ".join(f"{i}x{w}" for w in words)) for i in range(40)], "item_id long, text string")
    cuts = {1: slice(0, 36), 2: slice(1, 37), 3: slice(0, 31), 4: slice(0, 29), 5: slice(0, 3)}
    docs = spark.createDataFrame([(d, " ".join(f"7x{w}" for w in words[c])) for d, c in cuts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["start_word"], r["n_words"], round(r["similarity"], 6)) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {d: (7, 0, n, round((n - 4) / 33, 6)) for d, n in ((1, 36), (2, 36), (3, 31))}


def test_exact_copies_have_the_items_fingerprint():
    for n in range(2, 140):
        items = [(i, " ".join(f"{i}x{j}" for j in range(10))) for i in range(n)]
        index = decontaminate.Index(items)
        for i, text in items:
            words = decontaminate.words_of(text)
            assert index.search([b"a", b"b", b"c"] + words) == [(i, 3, 10, 0, 1.0)]


# 9


def test_language(spark, hard):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = d.withColumn("known", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.col("lang")))
    got = {r["doc_id"]: r for r in langid.identify(held, label="known", host=None).collect()}
    test = [r for r in held.collect() if r["known"] is None]
    assert sum(got[r["doc_id"]]["lang"] == r["lang"] for r in test) / len(test) > 0.97
    assert sum(r["kept"] for r in got.values()) / len(got) > 0.99
    few = {(r["doc_id"], r["kept"]) for r in langid.identify(hard).collect()}
    assert {(0, False), (1, False), (2, False), (3, True)} <= few
    assert langid.identify(hard.limit(0)).count() == 0 and langid.identify(hard.withColumn("lang", F.lit(None).cast("string"))).where("kept").count() == 0


# 10


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def plain_base(t):
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= sum(c.isdigit() for c in m) <= 19 and luhn(m)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]


def test_pii(spark, docs, hard):
    more = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "+49 (0)30 1234567 tel 555-123-4567 Mr. James Smith", "é@x.yy 😀 j@k.lm 4111 1111-1111 1111 and 4111111111111112", "+1+2 3 4 5 6 7 8 9 10 11", "4111111111111111 4111111111111111", "x@" + "a." * 9000 + "b"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string")).unionByName(hard.where("doc_id is not null and doc_id <> 5").select(F.col("doc_id") + 10**7, "text").toDF("doc_id", "text"))
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for r in df.collect():
        want, g = plain_base(r["text"] or ""), got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [g["n_email"], g["n_ip"], g["n_card"], g["n_phone"]] == [sum(x.startswith(k + ":") for x in want) for k in pii.KINDS[:4]]
        assert set(want) <= set(g["spans"].split(",")) | {""} or not want
    assert "local_phone" in got[10**6 + 2]["spans"] and "person" in got[10**6 + 2]["spans"]
    red = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert red[10**6] == "[EMAIL][EMAIL] x@y" and red[10**6 + 3].startswith("é@x.yy 😀 [EMAIL] [CARD] and 4") and red[10**7] == "" and red[10**7 + 1] is None
    assert pii.find(df.limit(0)).count() == 0 and pii.find(hard).count() == len(HARD) + 2


# The pipeline


def test_pipeline(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    d = docs
    sizes = [d.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = shared.written(stage(spark, d, SF), "stage")
        assert d.columns == docs.columns
        sizes.append(d.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    # each document's ids, put together from its pieces, are those of its text
    pieces = corpus_pipeline.packing.pack(d, WORDS, 2, with_ids=True).collect()
    whole: dict = {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        assert r["start"] == len(whole.setdefault(r["doc_id"], []))
        whole[r["doc_id"]] += r["ids"]
    lib = Tokenizer.from_file(WORDS)
    assert whole == {r["doc_id"]: lib.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in d.collect()}
    ran = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"]: (r["n"], r["m"]) for r in ran} == {k: (len(v), len(v)) for k, v in whole.items()}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_hard_rows(spark, hard, stage):
    d = hard.select("doc_id", "text", "lang", "source", "n_chars")
    out = stage(spark, d, SF)
    assert stage(spark, d.limit(0), SF).count() == 0
    if stage is corpus_pipeline.STAGES[-1][1]:
        assert out.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()
    else:
        assert out.columns == d.columns and out.where("doc_id is null").count() == 1
