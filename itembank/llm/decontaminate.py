"""Benchmark decontamination: item-sized windows of documents held against benchmark items.

A window of as many words as an item has (the whole document, if it has fewer) is fingerprinted by
SimHash over its weighted word shingles. Fingerprints are looked up in an index of Hamming blocks,
one for each size of window: ``radius + 1`` blocks of the 64 bits, so that by the pigeonhole
principle every item within ``radius`` bits agrees with the window in some block. Candidates within
the radius are verified by the exact weighted Jaccard similarity of the shingles.

A window that shares no shingle with an item has similarity zero with it, so only windows over a
position where some item's shingle stands are fingerprinted, for the sizes of those items.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .simhash import SEED

WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8 about 10 of 64 bits differ, with a standard deviation of 3.
RADIUS = 20
#: Items are held against all documents in blocks of so many characters, which are broadcast; the
#: index takes some 40 bytes for each.
BLOCK_CHARS = 2_000_000

LEAKS = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def exact(weight: float) -> float:
    """The nearest multiple of 2 ** -20: sums of these are exact in any order, so ties are ties."""
    return round(weight * (1 << 20)) / (1 << 20)


class Index:
    """The items' shingles, weights, fingerprints and Hamming blocks.

    Weights are by the frequencies of shingles over all items: ``total`` items, of which
    ``frequency`` (by the space-joined words) have a shingle. Without them, over ``items`` alone.
    """

    def __init__(self, items: list[tuple[int, str | None]], radius: int = RADIUS, k: int = WORDS, similarity: float = SIMILARITY, total: int | None = None, frequency: dict[str, int] | None = None):
        self.windows = self.candidates = 0  # fingerprints looked up, and items of their size met in some block
        self.radius, self.k, self.similarity = radius, k, similarity
        self.vocab: dict[bytes, int] = {}
        self.items: list[tuple[int, int, int]] = []  # item, words, words of its shingles
        grams: list[list[tuple]] = []
        for item_id, text in items:
            w = words_of(text)
            if w and item_id is not None:
                ids = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w]
                n = min(k, len(w))
                self.items.append((item_id, len(w), n))
                grams.append([tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)])
        self.names = {i: w for w, i in self.vocab.items()}
        df = Counter(g for gs in grams for g in set(gs))
        if frequency is not None:
            df = {g: frequency[b" ".join(self.names[i] for i in g).decode()] for g in df}
        total = len(grams) if total is None else total
        self.idf = {g: exact(math.log(1 + total / n)) for g, n in df.items()}
        self.rare = exact(math.log(1 + total))  # the weight of a shingle that no item has
        self.grams = [Counter(gs) for gs in grams]
        self.owners: dict[tuple, list[int]] = defaultdict(list)
        for i, gs in enumerate(self.grams):
            for g in gs:
                self.owners[g].append(i)
        self.fp = [self.fingerprint([(self._hash_ids(g), self.weight(g) * c) for g, c in gs.items()]) for gs in self.grams]
        edges = np.linspace(0, 64, radius + 2).round().astype(int).tolist()
        self.blocks = [(a, (1 << b - a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        # only items of a window's size can match it, so each size has blocks of its own
        self.tables: dict[tuple[int, int], list[dict[int, list[int]]]] = {}
        for i, f in enumerate(self.fp):
            tables = self.tables.setdefault(self.items[i][1:], [defaultdict(list) for _ in self.blocks])
            for (a, m), t in zip(self.blocks, tables, strict=True):
                t[f >> a & m].append(i)
        # codes of the shingles of full length, to find where they stand in a document
        self.codes = np.unique(np.array([self._code(g) for g in df if len(g) == k], dtype=np.uint64))
        self.short = sorted({n for _, _, n in self.items if n < k})
        self.least = min((n for _, _, n in self.items), default=1)

    def weight(self, gram: tuple) -> float:
        return self.idf.get(gram, self.rare)

    def _hash_ids(self, gram: tuple) -> int:
        return xxhash.xxh64_intdigest(b" ".join(self.names[i] for i in gram), SEED)

    @staticmethod
    def _code(gram: tuple) -> int:
        h = 0
        for x in gram:
            h = (h * 1_000_003 + x) & (1 << 64) - 1
        return h

    @staticmethod
    def fingerprint(hashes: list[tuple[int, float]]) -> int:
        h = np.array([x for x, _ in hashes], dtype="<u8")
        w = np.array([y for _, y in hashes])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        return int(np.packbits(w @ bits * 2 > w.sum()).view("<u8")[0])

    def hits(self, ids: np.ndarray) -> list[int]:
        """Positions at which some item's shingle starts."""
        out: list[int] = []
        n, k = len(ids), self.k
        if n >= k and len(self.codes):
            known = ids > 0
            run = np.convolve(known, np.ones(k, np.int64), "valid") == k
            at = np.nonzero(run)[0]
            if len(at):
                h = np.zeros(len(at), np.uint64)
                for j in range(k):
                    h = h * np.uint64(1_000_003) + ids[at + j].astype(np.uint64)
                p = np.minimum(np.searchsorted(self.codes, h), len(self.codes) - 1)
                out = at[self.codes[p] == h].tolist()
        for s in self.short:
            for i in np.nonzero(np.convolve(ids > 0, np.ones(s, np.int64), "valid") == s)[0].tolist() if n >= s else []:
                if tuple(ids[i : i + s].tolist()) in self.owners:
                    out.append(i)
        return sorted(set(out))

    def search(self, words: list[bytes]) -> list[tuple[int, int, int, int, float]]:
        """``item, start, words, hamming, similarity`` of the best window for each item found."""
        ids = np.fromiter(map(self.vocab.get, words, _zeros()), np.int64, len(words)) if len(words) >= self.least else np.zeros(0, np.int64)
        starts = self.hits(ids)
        if not starts:
            return []
        n = len(words)
        spans: dict[tuple[int, int], set[int]] = defaultdict(set)  # window size and shingle length to starts
        for p in starts:
            for s in {self.k, *self.short}:
                for i in self.owners.get(tuple(ids[p : p + s].tolist()), ()):
                    size, k = self.items[i][1:]
                    if k == s:
                        spans[size, k].update(range(max(0, p + k - size), min(p, max(0, n - size)) + 1))
        best: dict[int, tuple] = {}
        for (size, k), windows in spans.items():
            order = sorted(windows)
            # shingles of every stretch of neighbouring windows, with running sums of their weights
            first = 0
            while first < len(order):
                last = first
                while last + 1 < len(order) and order[last + 1] - order[last] <= size:
                    last += 1
                self._stretch(words, ids, order[first : last + 1], size, k, best)
                first = last + 1
        return [(self.items[i][0], s, min(self.items[i][1], n), d, sim) for i, (sim, s, d) in sorted(best.items())]

    def _stretch(self, words, ids, windows, size, k, best) -> None:
        lo, hi = windows[0], min(windows[-1] + size, len(words))
        grams = [tuple(ids[i : i + k].tolist()) if (ids[i : i + k] > 0).all() else b" ".join(words[i : i + k]) for i in range(lo, hi - k + 1)]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(lo, hi - k + 1)], dtype="<u8")
        w = np.array([self.weight(g) if isinstance(g, tuple) else self.rare for g in grams])
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.concatenate([np.zeros((1, 64)), np.cumsum(bits * w[:, None], axis=0)])
        mass = np.concatenate([[0.0], np.cumsum(w)])
        m = min(size, len(words)) - k + 1
        for s in windows:
            a, b = s - lo, s - lo + m
            f = int(np.packbits((sums[b] - sums[a]) * 2 > mass[b] - mass[a]).view("<u8")[0])
            near = {i for (at, mask), t in zip(self.blocks, self.tables[size, k], strict=True) for i in t.get(f >> at & mask, ())}
            self.windows += 1
            self.candidates += len(near)
            near = [i for i in near if (self.fp[i] ^ f).bit_count() <= self.radius]
            if not near:
                continue
            have = Counter(grams[a:b])
            for i in near:
                sim = self.jaccard(have, self.grams[i])
                if sim >= self.similarity and (-sim, s) < (-best.get(i, (0,))[0], best.get(i, (0, n_max))[1]):
                    best[i] = (sim, s, (self.fp[i] ^ f).bit_count())

    def jaccard(self, a: Counter, b: Counter) -> float:
        both = either = 0.0
        for g in a.keys() | b.keys():
            w = self.weight(g) if isinstance(g, tuple) else self.rare
            both += w * min(a[g], b[g])
            either += w * max(a[g], b[g])
        return both / either if either else 0.0


n_max = 1 << 62


def _zeros():
    while True:
        yield 0


def _item_grams(batches):
    """For each item with words a row with a null, and one for each of its distinct shingles."""
    for b in batches:
        blocks, out = [], []
        for text, block in zip(b.column("text").to_pylist(), b.column("block").to_pylist(), strict=True):
            w = words_of(text)
            if w:
                n = min(WORDS, len(w))
                mine = [None, *{b" ".join(w[i : i + n]).decode() for i in range(len(w) - n + 1)}]
                out += mine
                blocks += [block] * len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(out, pa.string())], names=["block", "gram"])


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item that some window of it is similar to.

    Windows have as many words (lower-cased, split at white space) as the item, a shorter document
    is one window; similarity is the
    weighted Jaccard of five-word shingles (fewer words: the whole item), at least 0.8, among the
    windows within ``radius`` bits of the item's SimHash. The best window is reported, the first
    of equals. Items and documents without words, and null ids of items, find nothing. The items
    are a query set: they are held against all documents block by block, a block being broadcast;
    shingles weigh the same in each block. Repeated rows come out repeated; null and empty texts
    find nothing.
    """
    spark = docs.sparkSession
    shared.ready(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").dropDuplicates(["item_id", "text"])
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-chars // block_chars))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int"))
    grams = items.mapInArrow(_item_grams, "block int, gram string")
    total = grams.where("gram is null").count()
    frequency = shared.written(grams.where("gram is not null").groupBy("gram").agg(F.count("*").alias("n"), F.collect_set("block").alias("blocks")), "frequencies")
    out = None
    for block in range(n_blocks):
        part = items.where(F.col("block") == block).orderBy("item_id", "text").collect()
        counts = {r["gram"]: r["n"] for r in frequency.where(F.array_contains("blocks", block)).select("gram", "n").collect()}  # as many as the block's words
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in part], radius, total=total, frequency=counts))

        def run(batches, index=index):
            x = index.value
            for b in shared.slices(batches):
                found = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in x.search(words_of(t))]
                cols = list(zip(*found, strict=True)) or [()] * 6
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[n.split()[0] for n in LEAKS.split(", ")])

        one = rows.mapInArrow(run, LEAKS)
        out = one if out is None else out.union(one)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that :func:`leaks` finds; documents without an id are kept."""
    found = shared.written(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
