"""SimHash near-duplicates with covering locality-sensitive hashing.

Every bit position gets a non-zero vector of ``radius + 1`` bits; table ``v`` keeps the positions
whose vector has an odd product with ``v``. At most ``radius`` differing positions span less than
the whole space, so some ``v`` is orthogonal to all of them: the pair collides in that table.

:func:`fingerprint_components` links fingerprints by Hamming distance alone.
:func:`near_duplicate_groups` finds candidates by the fingerprints first and, where these lie further
apart, by MinHash signatures of the sets of five-word shingles; it decides by the exact Jaccard
similarity of those sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Words of the shingles and the seed of their XXH64, as the fingerprint's definition has them.
SHINGLE_WORDS = 3
SEED = 42
#: Near-duplicate groups: hash functions of a MinHash signature over the set of shingles, how many of
#: them make a table's key, how many must agree for a candidate, words of a shingle, and the
#: similarity that decides. A pair of similarity 0.8 shares no table in ``(1 - 0.8 ** 4) ** 32``, one
#: of twenty million, and has less than 78 of 128 agree (four bits of each are compared) in fewer;
#: this holds for each pair, however the one text came from the other.
HASHES = 128
KEY_HASHES = 4
LEAST_AGREEING = 78
NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The ``2 ** (radius + 1) - 1`` masks (unsigned) of a covering family for ``radius``."""
    n = 2 ** (radius + 1) - 1
    owner = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (owner[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """All runs of ``k`` words, space-joined, repeats included; the whole of fewer words."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [text[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(s, SEED) for s in shingles(words, k)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half the hashes; none: 0."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # sums of bytes stay bytes
        total += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(total * 2 > n).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (long, the 64 bits) of every row.

    Texts are taken whole, A-Z lower-cased, words are runs without ASCII white space. Null and
    empty texts get fingerprint zero. Repeated rows stay repeated; other columns are ignored.
    """
    shared.ready(docs.sparkSession)

    def run(batches):
        for b in shared.slices(batches):
            fps = [signed(majority(shingle_hashes((t or b"").lower().split(), SHINGLE_WORDS))) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_links(nodes: DataFrame, radius: int = 2, small: int = 32) -> DataFrame:
    """Links ``a``, ``b`` between all rows (``node``, ``fp``, both unique) within ``radius`` bits.

    Buckets of up to ``small`` members are compared within their row. In larger ones, members
    are dealt by every value within ``radius / 2`` bits of theirs: rows that meet there are at
    most ``radius`` bits apart, and all such rows meet, so each meeting links to its smallest
    node; no bucket is capped and none is compared pair by pair. ``radius`` is even therefore.
    """
    if radius not in (0, 2):
        raise ValueError("radius 0 or 2")
    masks = covering_masks(radius)
    keys = nodes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("node", "fp", "x.t", "x.k")
    full = keys.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    hits = shared.written(keys.join(full, ["t", "k"]), "buckets")
    few = (
        hits.where(F.col("n") <= small).groupBy("t", "k").agg(F.collect_list(F.struct("node", "fp")).alias("m"))
        .select(F.explode(F.expr(f"flatten(transform(m, x -> transform(filter(m, y -> y.node < x.node and bit_count(x.fp ^ y.fp) <= {radius}), y -> struct(x.node as a, y.node as b))))")).alias("e")).select("e.a", "e.b")
    )
    flips = F.array(*[F.array(*[F.lit(signed(1 << j)) for j in range(64) if not m >> j & 1 and radius], F.lit(0).cast("long")) for m in masks])
    many = (
        hits.where(F.col("n") > small).select("node", "t", "fp", F.explode(flips[F.col("t")]).alias("x"))
        .select("node", "t", F.col("fp").bitwiseXOR(F.col("x")).alias("near"))
        .groupBy("t", "near").agg(F.sort_array(F.collect_set("node")).alias("m")).where("size(m) > 1")  # at most 65 differ from a value by a bit
        .select(F.explode(F.expr("slice(m, 2, size(m) - 1)")).alias("a"), F.col("m")[0].alias("b"))
    )
    links = shared.written(few.union(many).distinct(), "links")
    shared.dropped(hits)
    return links


def fingerprint_components(docs: DataFrame, radius: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex), ``component_id`` of every row of ``docs``.

    Rows link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest id that links reach. Fingerprints themselves are the linked nodes, so copies make no
    pairs, rows that repeat an id with several texts stay apart, and a row with a null id takes
    part like any other (it just is no id to report; a component without any has null).
    An empty table gives no rows.
    """
    by_row = _components_of(shared.written(fingerprints(docs), "fingerprints"), radius)
    return by_row.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components_of(fps: DataFrame, radius: int) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` of every row of ``fps`` (``doc_id``, ``fp``; a written table)."""
    nodes = shared.written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    links = covering_links(nodes.select(F.col("fp").alias("node"), "fp"), radius)
    comp = shared.connected_components(links)
    shared.dropped(links)
    ends = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "first", F.col("n").alias("copies"), F.coalesce("component", "fp").alias("component"))
    ends = shared.written(ends, "ends")
    least = ends.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    by_fp = shared.looked_up(ends, least, ["component"], ends.count()).select("fp", "component_id", F.col("copies").alias("n"))
    by_fp = shared.written(by_fp, "components")
    shared.dropped(comp)
    shared.dropped(ends)
    return shared.looked_up(fps, by_fp, ["fp"], fps.count()).select("doc_id", "fp", "component_id")


# Groups of near-duplicates: candidates by the tables, decisions by exact similarity.


TABLES = HASHES // KEY_HASHES
SIGN_COLS = [f"s{i}" for i in range(HASHES // 16)]
KEY_COLS = [f"k{i}" for i in range(TABLES)]
_MULTIPLY, _ADD = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 32, (2, HASHES), dtype=np.uint32) | np.array([[1], [0]], np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the hash functions; repeats don't matter."""
    h, low = (hashes >> np.uint64(32)).astype(np.uint32), np.full(HASHES, (1 << 32) - 1, np.uint32)
    for i in range(0, len(h), 256):
        np.minimum(low, (h[i : i + 256, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    return low


def sign_row(low: np.ndarray) -> list[int]:
    """A signature as the values of :data:`SIGN_COLS` (four bits a function) and :data:`KEY_COLS`."""
    x = low * np.uint32(0x9E3779B1)
    x = ((x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(28)).astype(np.uint8)
    signs = (x[::2] << 4 | x[1::2]).view("<i8")
    k = np.arange(TABLES, dtype=np.uint64)
    for m in low.reshape(TABLES, KEY_HASHES).T.astype(np.uint64):
        k = (k ^ m) * _MIX
        k ^= k >> np.uint64(29)
    return signs.tolist() + k.view("<i8").tolist()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h1``, ``h2`` (hash of the words in order), ``n_words``, ``fp`` (of five-word shingles), signs and keys."""
    shared.ready(docs.sparkSession)
    names = ["doc_id", "h1", "h2", "n_words", "fp", *SIGN_COLS, *KEY_COLS]

    def run(batches):
        for b in shared.slices(batches):
            rows = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = (t or b"").lower().split()
                h = xxhash.xxh128_intdigest(b" ".join(words), SEED)
                grams = shingle_hashes(words, NEAR_WORDS)
                rows.append([signed(h >> 64), signed(h & (1 << 64) - 1), len(words), signed(majority(grams)), *sign_row(signature(grams))])
            cols = list(zip(*rows)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``pairs`` (``node``, ``lead``; a written table) with ``close``: enough of their signatures agree.

    Very many nodes may have one lead; a node has as many leads as there are tables, or as few
    buckets hold.
    """
    unlike = F.lit(0)
    for c in SIGN_COLS:
        d = F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        unlike = unlike + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    leads = pairs.groupBy("lead").agg(F.count("*").alias("n")).join(reps.select(F.col("node").alias("lead"), F.struct(*SIGN_COLS).alias("y")), "lead")
    both = shared.looked_up(pairs.select("node", "lead"), leads, ["lead"], pairs.count(), "inner").join(reps.select("node", F.struct(*SIGN_COLS).alias("x")), "node")
    return both.select("node", "lead", (unlike <= HASHES - LEAST_AGREEING).alias("close"))


def _crossing(group):
    """Links found between two blocks of a bucket (or within one): each joins two components."""
    node, comp, side = (group.column(c).to_numpy() for c in ("node", "component", "side"))
    signs = np.stack([group.column(c).to_numpy() for c in SIGN_COLS], axis=1).view(np.uint64)
    x, y = (side == 0, side == 1) if side.any() else (side == 0, side == 0)
    unlike = np.zeros((int(x.sum()), int(y.sum())), np.uint8)
    for a, b in zip(signs[x].T, signs[y].T, strict=True):
        d = a[:, None] ^ b[None, :]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        unlike += np.bitwise_count(d & np.uint64(0x1111111111111111))
    i, j = np.nonzero((unlike <= HASHES - LEAST_AGREEING) & (comp[x][:, None] != comp[y][None, :]))
    links = {(max(a, b), min(a, b)) for a, b in zip(comp[x][i].tolist(), comp[y][j].tolist(), strict=True)}
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _dealt(members: DataFrame, *cols: str) -> DataFrame:
    """``cols`` and ``p``, ``q``, ``side``: block ``i`` of ``blocks`` meets every block ``j``, as ``(i, j)``
    with ``i <= j``; ``side`` tells which of the two a row belongs to."""
    met = members.select(*cols, "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    return met.select(*cols, F.least("i", "o").alias("p"), F.greatest("i", "o").alias("q"), (F.col("i") > F.col("o")).cast("int").alias("side"))


def _candidate_links(reps: DataFrame, small: int = 32, block: int = 256) -> DataFrame:
    """Links that join all documents which collide in a table and are close.

    Documents that fingerprints join (``sim``, the smallest node of the fingerprints' component, if
    ``reps`` has it) are joined already. A bucket's members are held against its smallest one first, which joins nearly all copies.
    Where the others then belong to several components, those of different components are held
    against each other: pair by pair for up to ``small`` members, by pairs of blocks for more. So
    every pair that collides is decided, unless it is joined already, and no bucket is capped.
    """
    sim = F.col("sim") if "sim" in reps.columns else F.col("node")
    keys = reps.select("node", sim.alias("sim"), F.explode(F.array(*KEY_COLS)).alias("k"))
    full = keys.groupBy("k").agg(F.min(F.struct("node", "sim")).alias("first"), F.count("*").alias("n")).where("n > 1")
    full = full.select("k", "n", F.col("first.node").alias("lead"), F.col("first.sim").alias("lead_sim"))
    bucket = shared.looked_up(keys, full, ["k"], TABLES * reps.count(), "inner").where("node > lead")
    bucket = shared.written(bucket.select("k", "node", "lead", "n", (F.col("sim") != F.col("lead_sim")).alias("apart")), "buckets")
    first = shared.written(bucket.where("apart").select("node", "lead").distinct(), "pairs")
    close = _close(first, reps).where("close").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    known = shared.connected_components(close.union(reps.where(sim < F.col("node")).select("node", sim)))
    rest = bucket.where("n > 2").join(known, "node", "left").select("k", "node", F.coalesce("component", "node").alias("component"))
    split = rest.groupBy("k").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("k", "n")
    rest = shared.written(shared.looked_up(rest, split, ["k"], bucket.count(), "inner").withColumnRenamed("n", "members"), "split")
    few = rest.where(F.col("members") <= small).select("k", "node", "component")
    pairs = few.join(few.select("k", F.col("node").alias("lead"), F.col("component").alias("other")), "k").where("component > other")
    pairs = shared.written(pairs.select("node", "lead", "component", "other").distinct(), "pairs")
    one = _close(pairs.select("node", "lead"), reps).where("close").join(pairs, ["node", "lead"]).select(F.col("component").alias("a"), F.col("other").alias("b"))
    many = rest.where(F.col("members") > small).withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    two = _dealt(many, "k", "node", "component").join(reps.select("node", *SIGN_COLS), "node").groupBy("k", "p", "q").applyInArrow(_crossing, "a long, b long")
    links = shared.written(known.where("node > component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(one).union(two), "links")
    for t in (bucket, first, known, rest, pairs):
        shared.dropped(t)
    return links


def _linked(group):
    """Links found among one block pair's documents; pairs that are linked already aren't compared."""
    ids = group.column("node").to_pylist()
    sides = group.column("side").to_pylist()
    sets = [_set_of(x) for x in group.column("shingles").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (sides[i], ids[i]))
    cross = len(set(sides)) > 1
    clusters: list[list[int]] = []
    out = []
    for i in order:
        mine, rest = None, []
        for c in clusters:
            hit = None
            for j in c:
                if cross and sides[i] == sides[j]:
                    continue
                if _similar(sets[i], sets[j]):
                    hit = j
                    break
            if hit is None:
                rest.append(c)
            else:
                out.append((max(ids[i], ids[hit]), min(ids[i], ids[hit])))
                mine = c + mine if mine else [*c]
        clusters = [*rest, [*(mine or []), i]]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h1``, ``h2``, ``shingles``: the set of hashes, 8 bytes each, in order."""
    shared.ready(docs.sparkSession)

    def run(batches):
        for b in shared.slices(batches):
            rows = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = (t or b"").lower().split()
                h = xxhash.xxh128_intdigest(b" ".join(words), SEED)
                rows.append((signed(h >> 64), signed(h & (1 << 64) - 1), np.unique(shingle_hashes(words, NEAR_WORDS)).tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["doc_id", "h1", "h2", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, h1 long, h2 long, shingles binary")


def _similar(a: set, b: set) -> bool:
    """Whether two sets of shingles have the similarity that decides; empty ones have none."""
    if min(len(a), len(b)) < NEAR_SIMILARITY * max(len(a), len(b)):
        return False
    both = len(a & b)
    return bool(a or b) and both >= NEAR_SIMILARITY * (len(a) + len(b) - both)


def _set_of(x: bytes) -> set:
    return set(np.frombuffer(x, "<u8").tolist())


def _against_leads(batches):
    """``node``, ``component``, ``close``: whether a node's shingles are similar to those of its component's lead."""
    last, lead = None, set()
    for b in shared.slices(batches, 200):
        near = []
        for c, x, y in zip(*[b.column(n).to_pylist() for n in ("component", "shingles", "lead")], strict=True):
            if c != last:
                last, lead = c, _set_of(y)
            near.append(_similar(_set_of(x), lead))
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("component"), pa.array(near, pa.bool_())], names=["node", "component", "close"])


def _to_joined(group):
    """Links of a block's documents that aren't joined (side 1) to one of a block's that are (side 0)."""
    ids, sides = group.column("node").to_pylist(), group.column("side").to_pylist()
    sets = [_set_of(x) for x in group.column("shingles").to_pylist()]
    joined = [i for i, s in enumerate(sides) if s == 0]
    hits = [(i, next((j for j in joined if _similar(sets[i], sets[j])), None)) for i, s in enumerate(sides) if s == 1]
    found = [sorted((ids[i], ids[j])) for i, j in hits if j is not None]
    return pa.table({"a": pa.array([y for _, y in found], pa.int64()), "b": pa.array([x for x, _ in found], pa.int64())})


def _exact_links(groups: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links ``a``, ``b`` that join just what exact similarity joins within groups of candidates.

    ``groups``: node, component (its smallest node, the lead); ``sets``: node, shingles. Members are held
    against their lead first, which joins nearly all copies, so a group costs about its size. Only
    the others are held against each other and against those joined, in pairs of blocks.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    total = groups.count()
    mine = shared.written(groups.where("node > component").join(sets, "node"), "members")
    leads = shared.written(sizes.join(sets.select(F.col("node").alias("component"), F.col("shingles").alias("lead")), "component"), "leads")
    held = shared.looked_up(mine, leads, ["component"], total, "inner").select("node", "component", "shingles", "lead")
    held = shared.written(held.mapInArrow(_against_leads, "node long, component long, close boolean"), "held")
    links = held.where("close").select(F.col("node").alias("a"), F.col("component").alias("b"))
    counts = held.groupBy("component").agg(F.count_if(~F.col("close")).alias("others"), (F.count_if("close") + 1).alias("joined"), F.count("*").alias("n")).where("others > 0")
    counts = shared.written(counts.withColumns({"ob": F.ceil(F.col("others") / block).cast("int"), "jb": F.ceil(F.col("joined") / block).cast("int")}), "split-groups")
    if not counts.isEmpty():
        every = held.unionByName(counts.select(F.col("component").alias("node"), "component", F.lit(True).alias("close")))
        every = shared.looked_up(every, counts, ["component"], total, "inner").withColumn("i", F.pmod(F.xxhash64("node"), F.when(F.col("close"), F.col("jb")).otherwise(F.col("ob"))).cast("int"))
        among = _dealt(every.where("not close").withColumn("blocks", F.col("ob")), "node", "component")
        many = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        a = every.where("close").select("node", "component", many(F.col("ob")).alias("p"), F.col("i").alias("q"), F.lit(0).alias("side"))
        b = every.where("not close").select("node", "component", F.col("i").alias("p"), many(F.col("jb")).alias("q"), F.lit(1).alias("side"))
        across = a.unionByName(b).join(sets, "node").groupBy("component", "p", "q").applyInArrow(_to_joined, "a long, b long")
        links = links.union(among.join(sets, "node").groupBy("component", "p", "q").applyInArrow(_linked, "a long, b long")).union(across)
    links = shared.written(links, "exact-links")
    for t in (mine, leads, held, counts):
        shared.dropped(t)
    return links


def _with_sim(reps: DataFrame) -> DataFrame:
    """``reps`` with ``sim``: the smallest node that links between fingerprints reach."""
    fps = shared.written(reps.select(F.col("node").alias("doc_id"), "fp"), "fingerprints")
    sim = shared.written(_components_of(fps, 2).select(F.col("doc_id").alias("node"), F.col("component_id").alias("sim")), "by-fingerprint")
    shared.dropped(fps)
    return reps.join(sim, "node")


def near_duplicate_groups(docs: DataFrame, block: int = 256) -> DataFrame:
    """``doc_id``, ``component_id`` of every row of ``docs`` with an id.

    Documents link when their words are equal or the Jaccard similarity of their sets of
    five-word shingles is at least 0.8 (fewer words: the whole is one shingle). Candidates are joined
    by SimHash fingerprints of the shingles that lie within two bits, by covering tables. A pair at 0.8
    differs in some ten bits, so what fingerprints leave apart is held against each other where MinHash
    signatures of the sets meet, so that a pair's chance to be found depends on that similarity only
    (see :data:`HASHES`); groups of candidates are compared exactly, with their
    smallest member first and then, where that isn't enough, in blocks of about ``block`` documents.
    Distinct texts are the linked nodes, so an id that repeats with several texts is decided text
    by text. Documents without words form one group. Null ids are left out; repeated rows come out
    repeated. Texts stay where they lie: only the sets of shingles that a group needs are moved.
    """
    return _groups(docs, block)[0]


def _groups(docs: DataFrame, block: int = 256) -> tuple[DataFrame, list[DataFrame]]:
    """What :func:`near_duplicate_groups` returns, and the written tables that it reads."""
    sk = shared.written(signatures(docs.where("doc_id is not null")), "signatures")
    nodes = sk.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("n_words", "fp", *SIGN_COLS, *KEY_COLS)])
    reps = shared.written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so the numbers are fixed
    groups = shared.connected_components(_candidate_links(_with_sim(reps.where("n_words > 0"))))
    wanted = groups.select("node").join(reps.select("node", "h1", "h2", F.col("first").alias("doc_id")), "node")
    wanted = shared.written(wanted, "wanted")
    _, some = shared.sifted(docs.select("doc_id", "text"), wanted.select("doc_id"), "doc_id")
    sets = shingle_sets(some).dropDuplicates(["doc_id", "h1", "h2"]).join(wanted, ["doc_id", "h1", "h2"]).select("node", "shingles")  # a node has one id and text
    sets = shared.written(sets, "shingle-sets")
    links = _exact_links(groups, sets, block)
    comp = shared.connected_components(links)
    for t in (wanted, groups, sets, links):
        shared.dropped(t)
    ends = reps.select("h1", "h2", "first", "copies", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = shared.written(ends, "ends")
    least = ends.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    by_text = shared.looked_up(ends, least, ["component"], ends.count()).select("h1", "h2", "component_id", F.col("copies").alias("n"))
    by_text = shared.written(by_text, "components")
    for t in (comp, ends, reps):
        shared.dropped(t)
    return shared.looked_up(sk.select("doc_id", "h1", "h2"), by_text, ["h1", "h2"], sk.count(), "inner").select("doc_id", "component_id"), [sk, by_text]


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest id.

    Rows that repeat an id count once; if their columns differ, the least row (column by column)
    stays. Documents without an id are kept as they are. Only rows whose id is likely to go or to be
    repeated are moved.
    """
    groups, read = _groups(docs)
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("copies"), F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    ids = shared.written(ids.where("not first or copies > 1"), "not-kept-as-they-are")
    for t in read:
        shared.dropped(t)
    apart, perhaps = shared.sifted(docs, ids.select("doc_id"), "doc_id")
    out = apart.unionByName(perhaps.join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns))
    again = ids.where("first").select("doc_id")
    if not again.isEmpty():
        least = perhaps.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in docs.columns])
        out = out.unionByName(least)
    return out
