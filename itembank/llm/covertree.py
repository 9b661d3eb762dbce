"""Near-duplicate embeddings by dual traversal of cover trees.

Unit vectors are held in nested levels: a node's members lie within its radius of its centre, and
its children's radii are half of its own. Two trees are walked together; a pair of nodes whose
centres are further apart than both covering radii and the threshold is pruned, so the pairs that
are left at the leaves are exact.

Over a cluster the top of the tree is a set of pivots for each label, found on a bounded sample;
every vector goes to the cell of its nearest pivot, and cells are split into blocks of bounded
size. Each block's tree is built once and stored with its vectors. Pairs of cells that their
covering radii rule out are never made; pairs of blocks are pruned by the radii of the uppermost
nodes of both trees, and only what is left brings two blocks together in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

COSINE = 0.93
#: Rows of a block, and the most pivots of all labels together (these are broadcast).
BLOCK_ROWS, MOST_PIVOTS = 2048, 4096
LEAF = 16
EPS = 1e-9
#: So many of the uppermost nodes of a block's tree go with it to prune pairs of blocks.
TOPS = 16


class Node:
    __slots__ = ("centre", "radius", "members", "children", "centres", "radii", "single", "lo", "hi")

    def __init__(self, x: np.ndarray, members: np.ndarray, centre: int, radius: float):
        self.centre, self.radius, self.members = centre, radius, members
        self.children: list[Node] = []
        self.centres = self.radii = self.single = None


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances between the rows of two arrays of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ c.T)))


def build(x: np.ndarray, members: np.ndarray | None = None, scale: float = 2.0, centre: int | None = None) -> Node:
    """A cover tree over rows ``members`` of ``x`` whose root covers ``scale``."""
    members = np.arange(len(x)) if members is None else members
    centre = int(members[0]) if centre is None else centre
    far = distances(x[members], x[centre : centre + 1])[:, 0]
    node = Node(x, members, centre, float(far.max()))
    if len(members) <= LEAF or node.radius <= EPS:
        return node
    while scale / 2 >= node.radius:
        scale /= 2
    half = scale / 2
    left, first = members, centre
    while len(left):
        d = distances(x[left], x[first : first + 1])[:, 0]
        inside = d <= half
        inside[left == first] = True
        node.children.append(build(x, left[inside], half, first))
        left = left[~inside]
        first = int(left[0]) if len(left) else -1
    node.centres = np.array([c.centre for c in node.children])
    node.radii = np.array([c.radius for c in node.children])
    node.single = np.array([len(c.members) == 1 for c in node.children])
    return node


def descend(x: np.ndarray, rows: np.ndarray, y: np.ndarray, node: Node, cosine: float, found) -> None:
    """:func:`dual` for single vectors: all that a node may hold links of go down its tree together."""
    limit = np.sqrt(2.0 - 2.0 * cosine) + EPS
    stack = [(rows, node)]
    while stack:
        rows, node = stack.pop()
        if not node.children:
            i, j = np.nonzero(x[rows] @ y[node.members].T >= cosine)
            if len(i):
                found(rows[i], node.members[j])
            continue
        alone, branches = np.nonzero(node.single)[0], np.nonzero(~node.single)[0]
        if len(alone):
            i, j = np.nonzero(x[rows] @ y[node.centres[alone]].T >= cosine)
            if len(i):
                found(rows[i], node.centres[alone[j]])
        if len(branches):
            near = distances(x[rows], y[node.centres[branches]]) <= node.radii[branches] + limit
            stack += [(rows[near[:, k]], node.children[c]) for k, c in enumerate(branches.tolist()) if near[:, k].any()]


def dual(x: np.ndarray, a: Node, y: np.ndarray, b: Node, cosine: float, found) -> None:
    """Calls ``found(i, j)`` with arrays of rows of ``x`` and ``y`` that are at least ``cosine`` alike.

    If ``a is b``, each pair comes once and none of a row with itself.
    """
    limit = np.sqrt(2.0 - 2.0 * cosine) + EPS
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if p is not q and float(distances(x[p.centre : p.centre + 1], y[q.centre : q.centre + 1])[0, 0]) > p.radius + q.radius + limit:
            continue
        if not p.children and not q.children:
            hit = x[p.members] @ y[q.members].T >= cosine
            if p is q:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            if len(i):
                found(p.members[i], q.members[j])
            continue
        (ps, pc, pr, p1), (qs, qc, qr, q1) = _sides(p, q)
        alone, other = {}, {}  # rows of single vectors, by the node of the other side that they are near
        for at in range(0, len(ps), 512):
            near = distances(x[pc[at : at + 512]], y[qc]) <= pr[at : at + 512, None] + qr[None, :] + limit
            if p is q:
                near &= np.arange(at, min(at + 512, len(ps)))[:, None] <= np.arange(len(qs))[None, :]
            i, j = np.nonzero(near)
            i += at
            # single vectors are settled together or go down the other side's tree, other pairs go on
            one = p1[i] & q1[j]
            s, t = pc[i[one]], qc[j[one]]
            if p is q:
                s, t = s[i[one] != j[one]], t[i[one] != j[one]]
            hit = np.einsum("ij,ij->i", x[s], y[t]) >= cosine
            if hit.any():
                found(s[hit], t[hit])
            for side, mask, key, rows in ((alone, p1[i] & ~q1[j], j, pc[i]), (other, ~p1[i] & q1[j], i, qc[j])):
                for k in np.unique(key[mask]).tolist():
                    side.setdefault(k, []).append(rows[mask & (key == k)])
            rest = ~(p1[i] | q1[j])
            stack += [(ps[k], qs[m]) for k, m in zip(i[rest].tolist(), j[rest].tolist(), strict=True)]
        for k, rows in alone.items():
            descend(x, np.concatenate(rows), y, qs[k], cosine, found)
        for k, rows in other.items():
            descend(y, np.concatenate(rows), x, ps[k], cosine, lambda i, j: found(j, i))


def _sides(p: Node, q: Node) -> tuple[tuple, tuple]:
    """What of a pair of nodes is compared next: nodes, centres, radii and which are single vectors.

    The side with the larger radius is split, both if their radii are within a factor of two.
    """
    parts = lambda n: (n.children, n.centres, n.radii, n.single)
    whole = lambda n: ([n], np.array([n.centre]), np.array([n.radius]), np.array([len(n.members) == 1]))
    if p is q:
        return parts(p), parts(p)
    if p.children and (not q.children or p.radius >= q.radius):
        return parts(p), parts(q) if q.children and q.radius * 2 >= p.radius else whole(q)
    return parts(p) if p.children and p.radius * 2 >= q.radius else whole(p), parts(q)


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small parts stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _rows(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1))


def flatten(root: Node) -> tuple[np.ndarray, np.ndarray]:
    """A tree as an order of its rows in which every node's members are neighbours, and a table of
    centre, radius, first and last member, first child, number of children by node (root first)."""
    order: list[int] = []

    def walk(node: Node) -> None:
        node.lo = len(order)
        if node.children:
            for c in node.children:
                walk(c)
        else:
            order.extend(node.members.tolist())
        node.hi = len(order)

    walk(root)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    nodes, rows = [root], []
    for node in nodes:  # grows while it is read
        rows.append((place[node.centre], node.radius, node.lo, node.hi, len(nodes), len(node.children)))
        nodes += node.children
    return np.array(order), np.array(rows, np.float64)


def restored(table: np.ndarray) -> Node:
    """The tree of :func:`flatten`, over rows in its order."""
    nodes = [Node.__new__(Node) for _ in table]
    whole = table[:, [0, 2, 3, 4, 5]].astype(np.int64).tolist()
    for node, radius, (centre, lo, hi, first, n) in zip(nodes, table[:, 1].tolist(), whole, strict=True):
        node.centre, node.radius, node.members, node.children = centre, radius, np.arange(lo, hi), nodes[first : first + n]
        node.centres = node.radii = node.single = None
        if n:
            below = table[first : first + n]
            node.centres, node.radii, node.single = below[:, 0].astype(np.int64), below[:, 1], below[:, 3] - below[:, 2] == 1
    return nodes[0]


def uppermost(root: Node, most: int = TOPS) -> list[Node]:
    """At most ``most`` nodes that cover all members: the deepest whole level that is that small."""
    level = [root]
    while True:
        below = [c for n in level for c in (n.children or [n])]
        if len(below) > most or len(below) == len(level):
            return level
        level = below


ID = "label string, dim int, cell int, block int"


def _build_blocks(group):
    """One row of a block: its rows in the order of its tree, the tree, and its uppermost nodes."""
    raw = group.column("embedding").combine_chunks()
    flat = raw.flatten().to_numpy(zero_copy_only=False).reshape(len(raw), -1)
    x = unit(flat)
    root = build(x)
    order, table = flatten(root)
    tops = uppermost(root)
    cols = {
        "nodes": group.column("node").to_numpy()[order].tobytes(), "copies": group.column("n").to_numpy()[order].tobytes(), "vectors": flat[order].tobytes(),
        "tree": table.tobytes(), "tops": x[[n.centre for n in tops]].tobytes(), "radii": np.array([n.radius for n in tops]).tobytes(),
    }
    first = {c: group.column(c)[0].as_py() for c in ("label", "dim", "cell", "block")}
    kinds = {"label": pa.string(), "dim": pa.int32(), "cell": pa.int32(), "block": pa.int32()}
    return pa.table({**{c: pa.array([v], kinds[c]) for c, v in first.items()}, **{c: pa.array([v], pa.binary()) for c, v in cols.items()}})


BLOCKS = ID + ", nodes binary, copies binary, vectors binary, tree binary, tops binary, radii binary"
FOUND = "kind int, a long, b long"


def _links_of(one: dict, two: dict | None, cosine: float, dtype) -> pa.RecordBatch:
    """Counts of links (kind 0) and a spanning forest of them (kind 1) within a block or between two."""
    sides = [one] if two is None else [one, two]
    xs = [unit(np.frombuffer(s["vectors"], dtype).reshape(-1, s["dim"])) for s in sides]
    trees = [restored(np.frombuffer(s["tree"], np.float64).reshape(-1, 6)) for s in sides]
    ids, copies = (np.concatenate([np.frombuffer(s[c], np.int64) for s in sides]) for c in ("nodes", "copies"))
    base = len(xs[0]) if two is not None else 0
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def found(i, j):
        j = j + base
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            for k in (i, j, before[i], before[j]):
                np.minimum.at(root, k, low)
            while (root[root] != root).any():
                root[:] = root[root]
            if (root == before).all():
                return

    dual(xs[0], trees[0], xs[-1], trees[-1], cosine, found)
    some, tied = np.nonzero(links)[0], np.nonzero(root != np.arange(len(ids)))[0]
    return pa.RecordBatch.from_arrays([
        pa.array([0] * len(some) + [1] * len(tied), pa.int32()), pa.array(np.concatenate([ids[some], ids[tied]]), pa.int64()),
        pa.array(np.concatenate([links[some], ids[root[tied]]]), pa.int64())], names=["kind", "a", "b"])


def _pivots(rows: DataFrame, sizes: DataFrame, block_rows: int, most: int) -> dict[tuple, np.ndarray]:
    """Pivots of the classes larger than a block: centres of a cover tree's level over a sample.

    The sample has about four rows for each pivot, and there are about ``most`` pivots at most.
    """
    big = sizes.where(F.col("rows") > block_rows)
    total = big.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("t")).first()["t"]
    if not total:
        return {}
    cell = max(block_rows, -(-total // most))
    share = min(1.0, 4.0 / cell)
    picked = rows.join(F.broadcast(big.where(F.col("rows") > cell).select("label", "dim")), ["label", "dim"], "left_semi")  # fewer than ``most`` classes
    picked = picked.where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 62)) < int(share * (1 << 62))).select("label", "dim", "node", "embedding").orderBy("label", "dim", "node")
    by: dict[tuple, list] = {}
    for r in picked.toLocalIterator():
        by.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    out = {}
    for key, vs in by.items():
        x = unit(np.array(vs))
        want = max(1, len(x) // 4)
        level = [build(x)]
        while len(level) < want and any(n.children for n in level):
            level = [c for n in level for c in (n.children or [n])]
        out[key] = x[[n.centre for n in level[: 2 * want]]]
    return out


def placed_points(points: DataFrame, pivots: dict[tuple, np.ndarray]) -> DataFrame:
    """``points`` with ``cell``, that of the nearest pivot of their class (0 without any), and ``far``,
    the distance to it."""
    held = points.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in shared.slices(batches, 4096):
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            cell, far = np.zeros(len(keys), np.int32), np.zeros(len(keys))
            emb = b.column(4)
            for key in set(keys) & held.value.keys():
                at = np.array([i for i, k in enumerate(keys) if k == key])
                d = distances(_rows(emb.take(pa.array(at))), held.value[key])
                cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=["label", "dim", "node", "n", "embedding", "cell", "far"])

    kind = points.schema["embedding"].dataType.simpleString()
    return points.select("label", "dim", "node", "n", "embedding").mapInArrow(assign, f"label string, dim int, node long, n long, embedding {kind}, cell int, far double")


def near_cells(cells: DataFrame, pivots: dict[tuple, np.ndarray], limit: float) -> DataFrame:
    """``label``, ``dim``, ``cell``, ``other`` (not before ``cell``) for cells that may hold a link.

    ``cells`` has ``radius`` and ``rows``. Only cells of classes with pivots, a bounded number, are
    held against each other, each in the task that has its row; the others pair with themselves.
    """
    spark = cells.sparkSession
    if not pivots:
        return cells.select("label", "dim", "cell", F.col("cell").alias("other"))
    some = spark.createDataFrame([(k[0], k[1]) for k in pivots], "label string, dim int")
    at: dict[tuple, list] = {}
    for r in cells.join(F.broadcast(some), ["label", "dim"], "left_semi").select("label", "dim", "cell", "radius").collect():  # as many as pivots
        at.setdefault((r["label"], r["dim"]), []).append((r["cell"], r["radius"]))
    held = spark.sparkContext.broadcast({k: (np.array([c for c, _ in v]), np.array([r for _, r in v]), pivots[k]) for k, v in at.items()})

    def run(batches):
        for b in shared.slices(batches, 64):
            out = []
            for label, dim, cell, radius in zip(*[c.to_pylist() for c in b.columns], strict=True):
                others = [cell]
                if (label, dim) in held.value:
                    names, radii, p = held.value[label, dim]
                    near = distances(p[[cell]], p[names])[0] <= radius + radii + limit
                    others = sorted({cell, *names[near & (names > cell)].tolist()})
                out += [(label, dim, cell, o) for o in others]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:]]], names=["label", "dim", "cell", "other"])

    return cells.select("label", "dim", "cell", "radius").mapInArrow(run, "label string, dim int, cell int, other int")


def near_blocks(pairs: DataFrame, blocks: DataFrame, limit: float) -> DataFrame:
    """``label``, ``dim``, ``cell``, ``block``, ``other``, ``other_block``, ``near`` for pairs of blocks.

    ``near`` is false where all pairs of the two trees' uppermost nodes are too far apart. A block's
    pair with itself isn't among them.
    """
    a = blocks.select("label", "dim", "cell", "block", "tops", "radii")
    b = blocks.select("label", "dim", F.col("cell").alias("other"), F.col("block").alias("other_block"), F.col("tops").alias("tops2"), F.col("radii").alias("radii2"))
    both = pairs.join(a, ["label", "dim", "cell"]).join(b, ["label", "dim", "other"]).where((F.col("cell") < F.col("other")) | (F.col("block") < F.col("other_block")))

    def run(batches):
        for part in shared.slices(batches, 512):
            near = []
            for dim, t, r, t2, r2 in zip(*[part.column(c).to_pylist() for c in ("dim", "tops", "radii", "tops2", "radii2")], strict=True):
                x, y = (np.frombuffer(v, np.float64).reshape(-1, dim) for v in (t, t2))
                near.append(bool((distances(x, y) <= np.frombuffer(r)[:, None] + np.frombuffer(r2)[None, :] + limit).any()))
            names = ["label", "dim", "cell", "block", "other", "other_block"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(near)], names=[*names, "near"])

    return both.mapInArrow(run, ID + ", other int, other_block int, near boolean")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row of ``vectors``.

    Rows with equal, non-null labels link when the cosine of their embeddings, in double
    precision, is at least ``cosine``. A null, empty or zero vector, or one with null or non-finite
    parts, links with nothing; neither do vectors of different lengths, nor a row with a null id.
    Equal vectors of a label are one point with a count, so copies make no pairs, and within a
    block pair only counts and a spanning forest of its links are kept. Rows that repeat an id are
    copies like any other. ``component_id`` is the smallest id that links reach, ``kept`` whether
    it is the row's own.
    """
    spark = vectors.sparkSession
    shared.ready(spark)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    dtype = np.float32 if kind == "array<float>" else np.float64
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.cast(kind).alias("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col("label").isNotNull() & F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))
    # zeros of both signs are equal, so a vector's hash is that of its parts plus zero
    same = F.transform(e, lambda x: x + F.lit(0.0).cast(kind[6:-1]))
    rows = rows.withColumn("good", good).withColumns({"h1": F.xxhash64(same), "h2": F.xxhash64(F.lit(1), same)})
    points = rows.where("good and vec_id is not null").groupBy("label", "h1", "h2").agg(F.min(F.struct("vec_id", "embedding")).alias("p"), F.count("*").alias("n"))
    points = points.select("label", "h1", "h2", F.monotonically_increasing_id().alias("node"), F.col("p.vec_id").alias("first"), "n", F.col("p.embedding").alias("embedding"), F.size("p.embedding").alias("dim"))
    points = shared.written(points, "points")  # so the numbers of nodes are fixed
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    pivots = _pivots(points, sizes, block_rows, most_pivots)
    placed = shared.written(placed_points(points, pivots), "cells")
    cells = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius")).withColumn("blocks", F.ceil(F.col("rows") / (2 * block_rows)).cast("int"))
    cells = shared.written(cells, "cell-sizes")
    limit = float(np.sqrt(2 - 2 * cosine)) + EPS
    member = placed.join(cells.select("label", "dim", "cell", "blocks"), ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = member.select("label", "dim", "cell", "block", "node", "n", "embedding")
    blocks = shared.written(member.groupBy("label", "dim", "cell", "block").applyInArrow(_build_blocks, BLOCKS), "blocks")
    pairs = near_blocks(near_cells(cells, pivots, limit), blocks, limit).where("near").drop("near")

    def within(batches):
        for b in shared.slices(batches, 1):
            yield _links_of(b.to_pylist()[0], None, cosine, dtype)

    def between(batches):
        for b in shared.slices(batches, 1):
            r = b.to_pylist()[0]
            yield _links_of(r["x"], r["y"], cosine, dtype)

    side = F.struct("dim", "nodes", "copies", "vectors", "tree")
    x = blocks.select("label", "dim", "cell", "block", side.alias("x"))
    y = blocks.select("label", "dim", F.col("cell").alias("other"), F.col("block").alias("other_block"), side.alias("y"))
    two = pairs.join(x, ["label", "dim", "cell", "block"]).join(y, ["label", "dim", "other", "other_block"]).select("x", "y")
    out = blocks.select("dim", "nodes", "copies", "vectors", "tree").mapInArrow(within, FOUND).union(two.mapInArrow(between, FOUND))
    out = shared.written(out, "vector-links")
    for t in (placed, cells, blocks):
        shared.dropped(t)
    links = out.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    comp = shared.connected_components(out.where("kind = 1").select("a", "b"))
    ends = points.select("label", "h1", "h2", "node", "first", "n").join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ends.groupBy("component").agg(F.min("first").alias("least"))
    by_point = ends.join(least, "component").select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.col("least").alias("component"))
    found = rows.where("good").select("vec_id", "label", "h1", "h2").join(by_point, ["label", "h1", "h2"], "left").select("vec_id", "links", "component")
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    both = found.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("links")).otherwise(F.lit(0)).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.col("component")).alias("component_id")).union(rest)
    return both.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
