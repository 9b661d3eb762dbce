"""A Merkle manifest of a dataset, with proofs by coordinate lookup.

Each row is a leaf; the leaves of a tree (here: a language), in order, are hashed in runs of
``arity`` until one node is left, and the trees' roots likewise give the dataset's root. Nodes are
a table of their own: tree, level, index, digest. The siblings that a leaf's proof needs follow
from its index, the tree's size and the arity alone, so they are made as coordinates, joined to
the node table, put in order and folded.

A tree is worked on in tiers of ``SPAN`` levels. A node of one tier needs only nodes below the same
node of the next tier, so each node of the table is looked up by at most ``arity ** SPAN`` others
of its tier, however large a tree is, and the path above is looked up once for all of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

ARITY = 2
#: Levels of a tier.
SPAN = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, and else the value's length in UTF-8 bytes, ``:`` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def div(a: Column, b: Column | int) -> Column:
    """Whole division of a count."""
    return ((a - a % b) / b).cast("long")


def leaf(values: list[Column]) -> Column:
    return digest(*map(encoded, values))


def numbered(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` with ``index`` (from 0, within ``tree`` by ``order``) and ``size``, the tree's rows.

    Rows are dealt by ranges of (``tree``, ``order``), so a tree may be of any size; only counts
    for each range and tree are summed up. Rows that are alike in these get any order.
    """
    by = ["tree", *order]
    spread = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
    placed = shared.written(spread.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), tag)
    ranges = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before, whole = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("tree")
    ranges = ranges.select("tree", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size"))
    # written, so that its size is known when Spark chooses how to join
    both = placed.join(shared.written(ranges, f"{tag}-ranges"), ["tree", "part"])
    return both.withColumn("index", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def risen(digests: list[str], size: int, arity: int, span: int) -> list[list[str]]:
    """The levels above consecutive nodes of a level of ``size``, at most ``span`` of them."""
    out = []
    while size > 1 and len(out) < span:
        digests = [hashlib.sha256("".join(digests[i : i + arity]).encode()).hexdigest() for i in range(0, len(digests), arity)]
        size = -(-size // arity)
        out.append(digests)
    return out


NODES = "tree string, level int, index long, size long, digest string"


@dataclass(frozen=True)
class Forest:
    """Written trees: ``leaves`` and, for each tier, the nodes above its lowest level (:data:`NODES`)."""

    leaves: DataFrame
    tiers: list[DataFrame]
    arity: int
    span: int

    def nodes(self) -> DataFrame:
        """The node table: every node of every tree once, leaves at level 0."""
        out = self.leaves.select("tree", F.lit(0).alias("level"), "index", "size", "digest")
        for t in self.tiers:
            out = out.unionByName(t)
        return out

    def roots(self) -> DataFrame:
        """``tree``, ``digest`` of the node that is left of each tree."""
        return self.nodes().where("size = 1").select("tree", "digest")


def grown(leaves: DataFrame, arity: int = ARITY, span: int = SPAN) -> Forest:
    """Trees over ``leaves`` (``tree``, ``index``, ``size``, ``digest``, each index once)."""
    if arity < 2:
        raise ValueError("arity must be at least 2")
    shared.ready(leaves.sparkSession)
    tiers, members, width = [], leaves, arity**span
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        base = len(tiers) * span
        block = members.where("size > 1").groupBy("tree", div(F.col("index"), width).alias("block")).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("m"))

        def rise(batches, base=base):
            for part in shared.slices(batches, 256):
                cols = [[], [], [], [], []]
                for r in part.to_pylist():
                    size, first = r["size"], r["m"][0]["index"]
                    for level, row in enumerate(risen([m["digest"] for m in r["m"]], size, arity, span), base + 1):
                        size, first = -(-size // arity), first // arity
                        for c, v in zip(cols, ([r["tree"]] * len(row), [level] * len(row), range(first, first + len(row)), [size] * len(row), row), strict=True):
                            c.extend(v)
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["tree", "level", "index", "size", "digest"])

        tiers.append(shared.written(block.select("tree", "size", "m").mapInArrow(rise, NODES), "nodes"))
        members = tiers[-1].where(F.col("level") == base + span)
        largest = -(-largest // width)
    return Forest(leaves, tiers, arity, span)


def needed(members: DataFrame, arity: int, span: int, base: int) -> DataFrame:
    """``tree``, ``block``, ``index`` of each member with the coordinates ``level``, ``sibling`` that
    its path through this tier needs: the others of its run on each level of more than one node."""
    a = F.lit(arity).cast("long")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.struct((k + base).alias("level"), F.pow(a, k).cast("long").alias("w"))))
    at = members.where("size > 1").select("tree", "block", "index", "size", up.alias("u"))
    at = at.select("tree", "block", "index", F.col("u.level").alias("level"), div(F.col("index"), F.col("u.w")).alias("own"), div(F.col("size") + F.col("u.w") - 1, F.col("u.w")).alias("width")).where("width > 1")
    first = F.col("own") - F.col("own") % a
    run = F.sequence(first, F.least(first + a, F.col("width")) - 1)
    return at.withColumn("sibling", F.explode(F.array_remove(run, F.col("own")))).drop("width")


STEPS = "array<struct<left:string,right:string>>"


def paths(forest: Forest, carried: list[str]) -> DataFrame:
    """``tree``, ``index``, ``carried`` of each leaf, and ``path``: from its level to the root the
    digests of the run's others, those to the left and those to the right each as one string."""
    arity, span, width = forest.arity, forest.span, forest.arity**forest.span
    upper = None
    for t in range(max(1, len(forest.tiers)) - 1, -1, -1):
        base = t * span
        if t == 0:
            members = forest.leaves.withColumn("mine", F.struct(*carried))
        else:
            members = forest.tiers[t - 1].where((F.col("level") == base) & (F.col("size") > 1)).withColumn("mine", F.struct("size"))
        members = members.withColumn("block", div(F.col("index"), width))
        level0 = members.select("tree", F.lit(base).alias("level"), F.col("index").alias("sibling"), "digest")
        lookup = level0
        if t < len(forest.tiers):
            lookup = lookup.unionByName(forest.tiers[t].where(F.col("level") < base + span).select("tree", "level", F.col("index").alias("sibling"), "digest"))
        found = needed(members, arity, span, base).join(lookup, ["tree", "level", "sibling"])
        one = found.select("tree", "block", "index", F.struct("level", "sibling", (F.col("sibling") < F.col("own")).alias("left"), "digest").alias("s"), F.lit(None).cast(members.schema["mine"].dataType).alias("mine"), F.lit(None).cast("long").alias("size"))
        own = members.select("tree", "block", "index", F.lit(None).cast(one.schema["s"].dataType).alias("s"), "mine", "size")
        # by tree and block, so that the path above is joined without moving these rows again
        dealt = one.unionByName(own).repartition("tree", "block")
        rows = dealt.groupBy("tree", "block", "index").agg(F.sort_array(F.collect_list("s")).alias("s"), F.max("mine").alias("mine"), F.max("size").alias("size"))
        levels = F.filter(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.pow(F.lit(arity), k) < F.col("size"))

        def side(k, left, base=base):
            mine = F.filter("s", lambda x: (x["level"] == k + base) & (x["left"] == F.lit(left)))
            return F.array_join(F.transform(mine, lambda x: x["digest"]), "")

        rows = rows.withColumn("path", F.transform(levels, lambda k: F.struct(side(k, True).alias("left"), side(k, False).alias("right"))).cast(STEPS))
        if upper is not None:
            rows = rows.join(upper, ["tree", "block"], "left").withColumn("path", F.concat("path", F.coalesce("above", F.array().cast(STEPS)))).drop("above")
        if t:
            upper = shared.written(rows.select("tree", F.col("index").alias("block"), F.col("path").alias("above")), "paths")
    return rows.select("tree", "index", *[F.col(f"mine.{c}").alias(c) for c in carried], "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, start, lambda d, s: digest(s["left"], d, s["right"]))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """``forest`` of the trees, ``top`` over their roots, and ``trees``: ``tree``, ``n`` (its leaves),
    ``subroot``, ``above`` (the path from it to the root), ``root``."""

    forest: Forest
    top: Forest
    trees: DataFrame


def build(leaves: DataFrame, order: list[str], arity: int = ARITY, span: int = SPAN) -> Manifest:
    """The manifest of ``leaves``: rows with ``tree`` (not null, by whose bytes trees are ordered),
    ``digest`` and whatever else they carry."""
    rows = shared.written(numbered(leaves, order, "leaves"), "numbered")
    forest = grown(rows, arity, span)
    subroots = shared.written(forest.roots(), "subroots")
    top = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], "trees")
    top = grown(shared.written(top, "numbered-trees"), arity, span)
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n"))
    up = paths(top, ["name", "digest"]).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("above"))
    trees = up.join(sizes, "tree").withColumn("root", folded(F.col("subroot"), F.col("above")))
    return Manifest(forest, top, shared.written(trees, "trees"))


def proofs(manifest: Manifest, carried: list[str]) -> DataFrame:
    """Each leaf with ``carried`` columns, ``subroot``, ``root`` and the ``path`` from it to the root."""
    low = paths(manifest.forest, carried)
    total = manifest.trees.agg(F.sum("n")).first()[0] or 0
    return shared.looked_up(low, manifest.trees, ["tree"], total).withColumn("path", F.concat("path", "above")).drop("above", "n")


def verified(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of each row.

    A tree for each ``lang`` (null is one of its own, the first), its leaves by ``doc_id`` (nulls first,
    then by digest). The root is recomputed for every row from its proof; where ``tampered`` holds,
    from a leaf whose ``n_chars`` has one added (null stays). Rows that repeat an id, or are equal in
    everything, are leaves of their own. Empty texts are values like others. No rows give no rows.
    ``proof_sha256`` of a row without siblings is the digest of nothing.
    """
    cols = {c: F.col(c) for c in FIELDS}
    changed = cols | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf(list(changed.values()))) if tampered is not None else F.lit(None).cast("string")
    lang = F.col("lang").cast("string")
    tree = F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))  # '-' is before '='
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(list(cols.values())).alias("digest"), other.alias("other"))
    # written first: dealing rows by ranges samples them, which would hash all texts twice
    leaves = shared.written(leaves.withColumn("tie", F.monotonically_increasing_id()), "hashed")
    manifest = build(leaves, ["doc_id", "digest", "tie"], arity)
    out = proofs(manifest, ["doc_id", "digest", "other"])
    out = out.withColumn("folded_root", folded(F.coalesce("other", "digest"), F.col("path")))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql() -> str:
    """The same for DuckDB: levels as lists, CRC-32 bit by bit, paths as steps marked L or R."""
    enc = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
    fields = " || ".join(enc.format(c) for c in FIELDS)
    changed = " || ".join(enc.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)
    rise = "list_transform(range(1, len({0}) + 1, 2), lambda i: sha256({0}[i] || coalesce({0}[i + 1], '')))"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(1, 9)), lambda x, k: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"
    nodes = "select {0} as tree, level, unnest(nodes) as d, unnest(range(0, len(nodes))) as i, len(nodes) as n from {1}"
    steps = """select l.r, list(case when s.d is null then '-' when l.i >> t.level & 1 = 1 then 'L' || s.d else 'R' || s.d end order by t.level) as steps
               from {0} l join {1} t on t.tree = l.tree and t.n > 1 and t.i = l.i >> t.level left join {1} s on s.tree = t.tree and s.level = t.level and s.i = xor(t.i, 1) group by l.r"""
    return f"""
        with recursive h as materialized (select row_number() over () as r, doc_id, coalesce('=' || lang, '-') as tree, sha256({fields}) as leaf,
                             case when doc_id is not null and {crc} % 7 = 0 then sha256({changed}) end as other from documents),
             l as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as i from h),
             up(tree, level, nodes) as (select tree, 0, list(leaf order by i) from l group by tree union all select tree, level + 1, {rise.format("nodes")} from up where len(nodes) > 1),
             tn as materialized ({nodes.format("tree", "up")}),
             sub as materialized (select tree as r, d as subroot, '' as tree, row_number() over (order by encode(tn.tree)) - 1 as i from tn where n = 1),
             top(level, nodes) as (select 0, list(subroot order by i) from sub union all select level + 1, {rise.format("nodes")} from top where len(nodes) > 1),
             pn as materialized ({nodes.format("''", "top")}),
             low as ({steps.format("l", "tn")}), high as ({steps.format("sub", "pn")}),
             p as (select l.doc_id, l.leaf, l.other, sub.subroot, (select d from pn where n = 1) as root, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) as steps
                   from l join sub on sub.r = l.tree left join low on low.r = l.r left join high on high.r = l.tree),
             f as (select *, list_reduce(list_prepend(coalesce(other, leaf), steps), lambda a, s: sha256(case s[1] when 'L' then s[2:] || a when 'R' then a || s[2:] else a end)) as folded_root from p)
        select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from f"""
