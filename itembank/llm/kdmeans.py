"""Centroid clustering by kd-tree filtering, in whole numbers throughout.

Each partition's vectors are held in kd-trees of bounded size, made and stored once: a node has the
count, the integer sums and the bounding box of its vectors. In a round a node is given the
centroids that may be nearest to something in its box; a centroid is dropped where another one is
strictly nearer to every point of the box. A node with one centroid left is assigned as a whole,
by its count and sums; leaves are resolved vector by vector. All arithmetic is on integers that
``float64`` (or, for large components, ``int64``) holds exactly, so pruning never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

DIM, K, ROUNDS, SCALE = 64, 40, 5, 256
#: Vectors of one tree, and of a leaf.
BLOCK_ROWS, LEAF = 4096, 32
#: Components up to here keep every squared distance within a long, and up to there within a double's whole numbers.
MOST, MOST_IN_DOUBLE = 1 << 27, 1 << 22


class Tree:
    """A kd-tree over rows of whole numbers, as arrays: node ``i`` covers ``order[start[i]:stop[i]]``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        lo, hi, sums, start, stop, low = [], [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            rows = self.order[a:b]
            v = x[rows]
            lo.append(v.min(axis=0))
            hi.append(v.max(axis=0))
            sums.append(v.sum(axis=0))
            start.append(a)
            stop.append(b)
            low.append([-1, -1])
            node = len(low) - 1
            if parent >= 0:
                low[parent][low[parent][0] >= 0] = node
            wide = hi[-1] - lo[-1]
            axis = int(wide.argmax())
            if b - a > leaf and wide[axis] > 0:
                by = np.argsort(v[:, axis], kind="stable")
                self.order[a:b] = rows[by]
                s = v[by, axis]
                # cut next to the middle between unlike values, so that equal vectors stay together
                mid = (b - a) // 2
                cut = int(np.searchsorted(s, s[mid], "left")) or int(np.searchsorted(s, s[mid], "right"))
                todo += [(a + cut, b, node), (a, a + cut, node)]
        self.lo, self.hi, self.sums = np.array(lo), np.array(hi), np.array(sums)
        self.start, self.stop, self.children = np.array(start), np.array(stop), np.array(low)

    def to_bytes(self) -> list[bytes]:
        return [a.astype(np.int64).tobytes() for a in (self.order, self.lo, self.hi, self.sums, self.start, self.stop, self.children)]

    @classmethod
    def from_bytes(cls, parts: list[bytes], dim: int) -> Tree:
        out = cls.__new__(cls)
        order, lo, hi, sums, start, stop, children = (np.frombuffer(p, np.int64) for p in parts)
        out.order, out.start, out.stop, out.children = order, start, stop, children.reshape(-1, 2)
        out.lo, out.hi, out.sums = lo.reshape(-1, dim), hi.reshape(-1, dim), sums.reshape(-1, dim)
        return out


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``x`` and ``c`` in a type in which their squared distances are exact."""
    most = max(int(np.abs(a).max()) if a.size else 0 for a in (x, c))
    if most > MOST:
        raise ValueError(f"components of {most} are too large: squared distances would not fit a long (at most {MOST})")
    return np.float64 if most <= MOST_IN_DOUBLE else np.int64


def nearest(x: np.ndarray, c: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the number of the nearest of the centroids ``c[numbers]``, ascending, and its squared distance."""
    z = c[numbers]
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ z.T) + (z * z).sum(axis=1)  # every term is a whole number held exactly
    at = d.argmin(axis=1)  # the first of equals, so the smaller number
    return numbers[at], d[np.arange(len(x)), at]


def candidates(c: np.ndarray, numbers: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """``numbers`` without the centroids to which one of them is strictly nearer all over the box.

    ``z`` is dominated by ``s`` where it is further from the box's corner that lies most in the direction
    from ``s`` to ``z``. Centroids that are equally near somewhere stay, so ties go on to the vectors.
    """
    z = c[numbers]
    middle = 2 * z - (lo + hi)
    s = z[int((middle**2).sum(axis=1).argmin())]
    corner = np.where(z > s, hi, lo)
    return numbers[((z - corner) ** 2).sum(axis=1) <= ((s - corner) ** 2).sum(axis=1)]


def filtered(tree: Tree, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes that together cover every vector once, each with its centroids: one, or a leaf's or a point's."""
    todo = [(0, np.arange(len(c)))]
    while todo:
        node, numbers = todo.pop()
        if len(numbers) > 1:
            numbers = candidates(c, numbers, tree.lo[node], tree.hi[node])
        if len(numbers) == 1 or tree.children[node, 0] < 0:
            yield node, numbers
        else:
            todo += [(int(k), numbers) for k in tree.children[node]]


def round_sums(tree: Tree, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts and integer sums of each centroid's vectors, and how many vectors were looked at one by one."""
    kind = exact(x, c)
    count, sums, looked = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), 0
    box = Tree.__new__(Tree)
    box.__dict__ |= tree.__dict__ | {"lo": tree.lo.astype(kind), "hi": tree.hi.astype(kind)}
    y = c.astype(kind)
    for node, numbers in filtered(box, y):
        a, b = tree.start[node], tree.stop[node]
        if len(numbers) > 1:
            if (tree.lo[node] == tree.hi[node]).all():  # copies of one vector
                numbers, _ = nearest(box.lo[node : node + 1], y, numbers)
            else:
                rows = tree.order[a:b]
                at, _ = nearest(x[rows].astype(kind), y, numbers)
                np.add.at(sums, at, x[rows])
                count += np.bincount(at, minlength=len(c))
                looked += b - a
                continue
        count[numbers[0]] += b - a
        sums[numbers[0]] += tree.sums[node]
    return count, sums, int(looked)


def assigned(tree: Tree, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row of ``x``."""
    kind = exact(x, c)
    box = Tree.__new__(Tree)
    box.__dict__ |= tree.__dict__ | {"lo": tree.lo.astype(kind), "hi": tree.hi.astype(kind)}
    y, at, far = c.astype(kind), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for node, numbers in filtered(box, y):
        rows = tree.order[tree.start[node] : tree.stop[node]]
        at[rows], far[rows] = nearest(x[rows].astype(kind), y, numbers)
    return at, far


PARTS = ["order", "lo", "hi", "sums", "start", "stop", "children"]
TREES = "ids binary, known binary, vectors binary, " + ", ".join(f"{p} binary" for p in PARTS)


def whole(embedding: Column, scale: int, dim: int) -> Column:
    """The components as whole numbers, ``floor(scale * x)``; null for other than ``dim`` finite components."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    finite = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    # a component that no long can hold is raised for by exact(), not here
    return F.when(finite, F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(1 << 40))), F.lit(-float(1 << 40)))).cast("long")))


def trees(rows: DataFrame, dim: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:data:`TREES` over ``vec_id`` and ``v`` of ``rows``, up to ``block_rows`` a tree, where the rows lie."""

    def block(ids: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        ids, x = pa.concat_arrays(ids), np.concatenate(vectors)
        exact(x, x[:0])
        known = np.array(ids.is_valid().to_numpy(zero_copy_only=False), dtype=np.uint8)
        cols = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), known.tobytes(), x.tobytes(), *Tree(x).to_bytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=["ids", "known", "vectors", *PARTS])

    def run(batches):
        ids, vectors, n = [], [], 0
        for part in shared.slices(batches, block_rows):
            ids.append(part.column("vec_id"))
            vectors.append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64))
            n += part.num_rows
            if n >= block_rows:
                yield block(ids, vectors)
                ids, vectors, n = [], [], 0
        if n:
            yield block(ids, vectors)

    return rows.select("vec_id", "v").mapInArrow(run, TREES)


def _opened(batches, dim: int):
    for b in shared.slices(batches, 1):
        r = {name: b.column(name)[0].as_py() for name in b.schema.names}
        yield np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], np.uint8) == 0, np.frombuffer(r["vectors"], np.int64).reshape(-1, dim), Tree.from_bytes([r[p] for p in PARTS], dim)


def moved(stored: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The centroids after one round: componentwise ``floor(sum / count)``; one without vectors stays.

    Each task sends one row for each centroid and component; so many, ``k * dim``, reach the driver.
    """

    def run(batches):
        c, count, sums = np.array(centroids, np.int64), None, None
        for _, _, x, tree in _opened(batches, dim):
            n, s, _ = round_sums(tree, x, c)
            count, sums = (n, s) if count is None else (count + n, sums + s)
        if count is not None:
            k, d = np.nonzero(np.repeat(count[:, None] > 0, dim, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (k, d, count[k], sums[k, d])], names=["k", "d", "n", "s"])

    total = stored.mapInArrow(run, "k long, d long, n long, s long").groupBy("k", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [list(c) for c in centroids]
    for r in total.collect():
        out[r["k"]][r["d"]] = int(r["s"]) // r["n"]
    return out


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of salt and id; equal ids by their components."""
    chosen = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r["v"]) for r in chosen.collect()]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = "2:", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of each kept row.

    Kept are rows whose embedding has ``dim`` components, none null or not finite; rows that repeat an
    id or a vector count each. With fewer than ``k`` kept rows there are so many centroids; rows with a
    null id are clustered but start none, and where no row has an id the other columns are null. Equal
    distances go to the smaller number. No kept rows give no rows. Raises where a component is beyond
    ``MOST``, since no long would hold the distances.
    """
    spark = vectors.sparkSession
    shared.ready(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale, dim).alias("v")).where("v is not null")
    centroids = first_centroids(rows, k, salt)
    if not centroids:
        null = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in null.items()])
    stored = shared.written(trees(rows, dim, block_rows), "kd-trees")
    for _ in range(rounds):
        centroids = moved(stored, centroids, dim)

    def run(batches):
        c = np.array(centroids, np.int64)
        for ids, unknown, x, tree in _opened(batches, dim):
            at, far = assigned(tree, x, c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=unknown), pa.array(at, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = shared.written(stored.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    shared.dropped(stored)
    # one row for each of at most k clusters: small at any size, and so for the broadcast
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of = [(i, inertia[i], sum(inertia.values()), ",".join(map(str, c))) for i, c in enumerate(centroids) if i in inertia]
    values = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, c string").withColumn("centroid_sha256", F.sha2("c", 256)).drop("c")
    return found.join(F.broadcast(values), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = "2:") -> str:
    """The same for DuckDB: every vector against every centroid, round by round."""
    near = """select r, k, d::bigint as distance from (select v.r, c.k, v.q - 2 * list_inner_product(v.x, c.x) + c.q as d from v, c{0} c) qualify row_number() over (partition by r order by d, k) = 1"""
    steps = [f"""v as materialized (select row_number() over () as r, vec_id, x, list_inner_product(x, x) as q from
                    (select vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)) as x from embeddings
                     where len(embedding) = {dim} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)),
                 c0 as materialized (select row_number() over (order by sha256('{salt}' || vec_id), x) - 1 as k, x, q from v where vec_id is not null order by k limit {k})"""]  # fmt: skip
    for i in range(rounds):
        steps.append(f"""a{i} as materialized ({near.format(i)}),
                 s{i} as (select a.k, u.j, sum(u.e)::bigint as s, count(*) as n from a{i} a join (select r, unnest(x)::bigint as e, unnest(range({dim})) as j from v) u using (r) group by all),
                 m{i} as (select k, list(((s - ((s % n) + n) % n) // n)::double order by j) as x from s{i} group by k),
                 c{i + 1} as materialized (select k, x, list_inner_product(x, x) as q from (select c.k, coalesce(m.x, c.x) as x from c{i} c left join m{i} m using (k)))""")
    return f"""
        with {", ".join(steps)}, f as materialized ({near.format(rounds)})
        select v.vec_id, f.k::int as cluster, f.distance, sum(f.distance) over (partition by f.k)::bigint as cluster_inertia, sum(f.distance) over ()::bigint as inertia,
               sha256(array_to_string(list_transform(c.x, lambda e: e::bigint::varchar), ',')) as centroid_sha256
        from f join v using (r) join c{rounds} c on c.k = f.k"""
