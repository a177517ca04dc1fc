"""Embedding near-duplicates: dual traversal of cover trees over unit vectors.

A tree's levels have radii 1/2, 1/4 and 1/8; wider ones prune next to nothing on a sphere.
Each level's centres include those of the level above, and every vector belongs to a
centre within the level's radius. Two trees are walked together: a pair of centres further
apart than both covering radii plus the wanted distance is pruned with all below; a pair
so close that all below must be linked is counted without a look at its vectors; the other
pairs go down a level, at last to exact products. Cosine ``c`` of unit vectors is the
distance ``sqrt(2 - 2c)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import stored
from pagelake.llm.components import components

RADII = (0.5, 0.25, 0.125)
LEVELS = [f"above_{n}" for n in range(len(RADII))]
BLOCK = 4096  # vectors in one tree, about
SAMPLE = 2048  # vectors the upmost levels are fitted on
LEAVES = 1024  # most leaves of the upmost levels
PAIRS = 1 << 20  # pairs expanded at once
SLACK = 1e-9


def unit(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of length one in double precision; shorter vectors end in zeros."""
    sizes = vectors.map(len).to_numpy(np.int64)
    out = np.zeros((len(vectors), width))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at, :size] = np.stack(vectors.to_numpy()[at]) if size else 0.0
    out /= np.abs(out).max(axis=1, initial=1e-320, keepdims=True)  # squares neither vanish nor overflow
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def distance(product: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * product))


def net(x: np.ndarray, radius: float, centres: list[int]) -> list[int]:
    """``centres`` and further points, until every point has one within ``radius``."""
    least = 1.0 - radius * radius / 2.0
    left = np.arange(len(x))
    out, new = [], list(centres)
    while len(left):
        out += new
        if new:
            uncovered = [(x[part] @ x[new].T).max(axis=1) < least for part in np.array_split(left, len(left) // 1024 + 1)]
            left = np.setdiff1d(left[np.concatenate(uncovered)], new)
        some, new = left[:256], []
        near = x[some] @ x[some].T >= least
        free = np.ones(len(some), bool)
        for n in range(len(some)):
            if free[n]:
                new.append(int(some[n]))
                free &= ~near[n]
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest row of ``centres`` for each row of ``x``."""
    parts = [np.argmax(x[s : s + 1024] @ centres.T, axis=1) for s in range(0, len(x), 1024)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def levels(x: np.ndarray) -> np.ndarray:
    """For each radius and point, the point that is its centre: nested from top to bottom."""
    nets, centres = [], []
    for radius in RADII:
        centres = net(x, radius, centres)
        nets.append(np.array(centres, np.int64))
    out = np.empty((len(RADII), len(x)), np.int64)
    below = np.arange(len(x))
    for level in reversed(range(len(RADII))):
        # A point's centre is that of its centre one level below.
        own = np.full(len(x), -1)
        own[nets[level]] = nets[level]
        members = np.unique(below)
        members = members[own[members] < 0]
        own[members] = nets[level][nearest(x[members], x[nets[level]])]
        below = out[level] = own[below]
    return out


class Tree:
    """Points with their levels: centres, covering radii, children and counts."""

    def __init__(self, x: np.ndarray, above: np.ndarray, copies: np.ndarray):
        self.x = x
        chain = [*above, np.arange(len(x))]
        self.nodes, self.radius, self.weight, self.first, self.last, self.kids = [], [], [], [], [], []
        self.points, self.point_first, self.point_last = [], [], []
        for level, centre in enumerate(chain):
            nodes, at = np.unique(centre, return_inverse=True)
            gap = distance(np.einsum("ij,ij->i", x, x[centre]))
            radius = np.zeros(len(nodes))
            np.maximum.at(radius, at, gap)
            self.nodes.append(nodes)
            self.radius.append(radius if level < len(above) else np.zeros(len(nodes)))
            self.weight.append(np.bincount(at, copies, len(nodes)).astype(np.int64))
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=len(nodes)))
            self.points.append(order)
            self.point_first.append(np.r_[0, ends[:-1]].astype(np.int64))
            self.point_last.append(ends)
            if level + 1 < len(chain):
                lower = np.unique(chain[level + 1])
                parent = at[lower]
                order = np.argsort(parent, kind="stable")
                ends = np.cumsum(np.bincount(parent, minlength=len(nodes)))
                self.kids.append(order)
                self.first.append(np.r_[0, ends[:-1]].astype(np.int64))
                self.last.append(ends)

    def members(self, level: int, node: int) -> np.ndarray:
        return self.points[level][self.point_first[level][node] : self.point_last[level][node]]


class Found:
    """Numbers of links per point, and labels that connect linked points."""

    def __init__(self, sizes: tuple[int, int]):
        self.count = [np.zeros(n, np.int64) for n in sizes]
        self.shift = sizes[0]
        self.label = np.arange(sum(sizes))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Give both ends of every pair the smaller of their labels, until nothing changes."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while True:  # point at roots
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def dual(a: Tree, b: Tree, copies: tuple[np.ndarray, np.ndarray], least: float, same: bool) -> Found:
    """All links between two trees' points, ``same`` if both are one tree."""
    found = Found((len(a.x), 0 if same else len(b.x)))
    shift = 0 if same else found.shift
    wide = float(np.sqrt(max(0.0, 2.0 - 2.0 * least)))
    bottom = len(RADII)

    def settle(level: int, ia: np.ndarray, ib: np.ndarray, product: np.ndarray):
        """Take what is decided at this level; the pairs that go on."""
        if level == bottom:
            near = product >= least
            if same:
                near &= ia != ib
            ia, ib = ia[near], ib[near]
            np.add.at(found.count[0], ia, copies[1][ib])
            if not same:
                np.add.at(found.count[1], ib, copies[0][ia])
            found.join(ia, ib + shift)
            return ia[:0], ib[:0]
        gap = distance(product)
        reach = a.radius[level][ia] + b.radius[level][ib]
        inside = gap + reach <= wide - 1e-6
        for i, j in zip(ia[inside].tolist(), ib[inside].tolist()):
            left, right = a.members(level, i), b.members(level, j)
            found.count[0][left] += b.weight[level][j]
            if same and i == j:
                found.count[0][left] -= copies[0][left]
            if not same:
                found.count[1][right] += a.weight[level][i]
            found.join(left, np.full(len(left), right[0] + shift))
            found.join(right + shift, np.full(len(right), left[0]))
        on = ~inside & (gap <= reach + wide + 1e-6)
        return ia[on], ib[on]

    def descend(level: int, ia: np.ndarray, ib: np.ndarray) -> None:
        """Walk down the pairs ``(ia, ib)`` of nodes, some at a time."""
        na = a.last[level][ia] - a.first[level][ia]
        nb = b.last[level][ib] - b.first[level][ib]
        begin = 0
        while begin < len(ia):
            total = np.cumsum(na[begin:] * nb[begin:])
            end = begin + max(1, int(np.searchsorted(total, PAIRS, "right")))
            pick = slice(begin, end)
            begin = end
            sizes = na[pick] * nb[pick]
            which = np.repeat(np.arange(len(sizes)), sizes)
            nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            wide_b = nb[pick][which]
            ka = a.kids[level][a.first[level][ia[pick]][which] + nth // wide_b]
            kb = b.kids[level][b.first[level][ib[pick]][which] + nth % wide_b]
            pa, pb = a.nodes[level + 1][ka], b.nodes[level + 1][kb]
            product = np.empty(len(ka))
            for s in range(0, len(ka), 4096):
                product[s : s + 4096] = np.einsum("ij,ij->i", a.x[pa[s : s + 4096]], b.x[pb[s : s + 4096]])
            ka, kb = settle(level + 1, ka, kb, product)
            if len(ka):
                descend(level + 1, ka, kb)

    # All pairs of upmost centres: by single precision and a margin first, then exactly.
    top_a, top_b = a.x[a.nodes[0]], b.x[b.nodes[0]]
    short_a, short_b = top_a.astype(np.float32), top_b.astype(np.float32)
    groups_b = [at for at in (np.flatnonzero(b.radius[0] == 0), np.flatnonzero(b.radius[0])) if len(at)]
    for some_a in (np.flatnonzero(a.radius[0] == 0), np.flatnonzero(a.radius[0])):
        for start in range(0, len(some_a), 512):
            part = some_a[start : start + 512]
            for some_b in groups_b:
                ra, rb = a.radius[0][part], b.radius[0][some_b]
                # Most centres stand alone: then one number is the bound for the whole tile.
                reach = ra[:, None] + rb[None, :] if ra.any() or rb.any() else np.zeros((1, 1))
                bound = 1.0 - np.minimum(reach + wide, 2.0) ** 2 / 2.0 - 1e-4
                ia, ib = np.nonzero(short_a[part] @ short_b[some_b].T >= bound.astype(np.float32))
                ia, ib = part[ia], some_b[ib]
                ia, ib = settle(0, ia, ib, np.einsum("ij,ij->i", top_a[ia], top_b[ib]))
                if len(ia):
                    descend(0, ia, ib)
    return found


def _links(batches: Iterator[pd.DataFrame], width: int, least: float) -> Iterator[pd.DataFrame]:
    """Counts and links for each pair of blocks: runs of ``(one, two)`` in a sorted partition."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = int(rows["one"].iloc[0]), int(rows["two"].iloc[0])
        sides = []
        for block in (one, two)[: 1 if one == two else 2]:
            part = rows[rows["block"] == block].sort_values("place")
            above = part[LEVELS].to_numpy(np.int64).T
            copies = part["copies"].to_numpy(np.int64)
            sides.append((Tree(unit(part["embedding"], width), above, copies), part["node"].to_numpy(), copies))
        if any(not len(s[1]) for s in sides):
            return pd.DataFrame({"node": [], "links": [], "near": []}).astype("int64")
        (a, na, ca), (b, nb, cb) = sides[0], sides[-1]
        found = dual(a, b, (ca, cb), least, one == two)
        names = na if one == two else np.r_[na, nb]
        counts = found.count[0] if one == two else np.r_[found.count[0], found.count[1]]
        near = names[found.label]
        at = np.flatnonzero((counts > 0) | (near != names))
        return pd.DataFrame({"node": names[at], "links": counts[at], "near": near[at]})

    held: list[pd.DataFrame] = []
    key = None
    for batch in batches:
        runs = batch["one"].to_numpy(np.int64) << 32 | batch["two"].to_numpy(np.int64)
        edges = np.r_[0, np.flatnonzero(np.diff(runs)) + 1, len(runs)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if held and runs[lo] != key:
                yield solve(pd.concat(held))
                held = []
            key = runs[lo]
            held.append(batch.iloc[lo:hi])
    if held:
        yield solve(pd.concat(held))


def _with_levels(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    rows = rows.sort_values("node", ignore_index=True)
    above = levels(unit(rows["embedding"], width))
    rows["place"] = np.arange(len(rows))
    for name, centre in zip(LEVELS, above):
        rows[name] = centre
    return rows


def near_vectors(vectors: DataFrame, least: float = 0.9, name: str = "covertree") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``.

    Vectors are linked from cosine ``least`` on, in double precision. Null, empty and zero
    vectors and those with null or non-finite components link with nothing; shorter ones
    count as ending in zeros. Equal vectors are one node with a number of copies, and a
    node's links count copies. A row without an id is a node's copy like any other, its
    component the smallest id reachable. Extra columns are ignored.

    Upmost levels are fitted on a bounded sample and only decide which vectors share a
    tree; radii are measured on all vectors. Pairs of trees that their radii do not
    prune are walked in a task each; a leaf with many vectors is dealt out over several
    trees. Tasks return at most one row per vector, never the pairs.
    """
    value = F.col("embedding")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    sound = F.coalesce(value.isNotNull() & ~bad & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id"), value, sound.alias("sound"))
    plain = rows.filter("sound").select("vec_id", "embedding")
    nodes = stored(
        plain.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()), f"{name}-nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    count, width = size["n"], max(1, size["width"] or 0)

    picked = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").toPandas()
    x = unit(picked["embedding"], width)
    most, centres = min(LEAVES, max(1, count // BLOCK)), [0] if len(x) else []
    for radius in RADII:
        finer = net(x, radius, centres)
        if len(finer) > most:
            break
        centres = finer
    shared = vectors.sparkSession.sparkContext.broadcast(x[centres])  # at most LEAVES vectors

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops = shared.value
        for batch in batches:
            points = unit(batch["embedding"], width)
            batch["leaf"] = nearest(points, tops).astype("int32")
            batch["gap"] = distance(np.einsum("ij,ij->i", points, tops[batch["leaf"]]))
            yield batch

    wide_schema = T.StructType([*nodes.schema, T.StructField("leaf", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    placed = stored(nodes.mapInPandas(leaves, wide_schema), f"{name}-leaves")
    per_leaf = {r["leaf"]: (r["n"], r["gap"]) for r in placed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap")).collect()}  # at most LEAVES rows
    blocks = {leaf: -(-n // BLOCK) for leaf, (n, _) in per_leaf.items()}
    first, total = {}, 0
    for leaf in sorted(blocks):
        first[leaf] = total
        total += blocks[leaf]
    far = float(np.sqrt(max(0.0, 2.0 - 2.0 * least)))
    apart = distance(x[centres] @ x[centres].T) if centres else np.empty((0, 0))
    partners = {
        leaf: [o for o in sorted(blocks) if apart[leaf, o] <= per_leaf[leaf][1] + per_leaf[o][1] + far + 1e-6]
        for leaf in blocks
    }
    spark = vectors.sparkSession
    table = spark.createDataFrame(
        [(leaf, first[leaf], blocks[leaf], [[first[o], first[o] + blocks[o] - 1] for o in partners[leaf]]) for leaf in sorted(blocks)],
        "leaf int, first long, blocks long, ranges array<array<long>>")
    in_block = F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = placed.join(F.broadcast(table), "leaf").select("node", "copies", "embedding", in_block.alias("block"))
    tree_schema = T.StructType([*dealt.schema, *(T.StructField(n, T.LongType()) for n in ("place", *LEVELS))])
    trees = stored(dealt.groupBy("block").applyInPandas(lambda g: _with_levels(g, width), tree_schema), f"{name}-trees")

    ranges = F.flatten(F.transform("ranges", lambda r: F.sequence(r[0], r[1])))
    owner = table.select(F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block"), "ranges")
    # One row per tree; trees hold thousands of vectors each.
    other = F.explode(ranges).alias("other")
    pairs = trees.join(owner, "block").select("*", other).drop("ranges").select(
        F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        "block", "node", "copies", "embedding", "place", *LEVELS)
    work = pairs.repartition("one", "two").sortWithinPartitions("one", "two")
    found = stored(
        work.mapInPandas(lambda b: _links(b, width, least), "node long, links long, near long"), f"{name}-links")
    counts = stored(found.groupBy("node").agg(F.sum("links").alias("links")), f"{name}-counts")
    joined = components(found.filter("node <> near").select(F.col("node").alias("u"), F.col("near").alias("v")), name)
    labelled = nodes.select("node", "rep", "copies", "embedding").join(counts, "node", "left").join(joined, "node", "left").select(
        "embedding", "rep", F.coalesce("component", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    labelled = stored(labelled, f"{name}-labelled")
    smallest = stored(labelled.groupBy("component").agg(F.min("rep").alias("component_id")), f"{name}-smallest")
    named = stored(labelled.join(smallest, "component").select("embedding", "n_links", "component_id"), f"{name}-named")
    linked = plain.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as u, b.vec_id as w from v a join v b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, other) as (
  select vec_id, vec_id from embeddings
  union
  select r.vec_id, l.w from reach r join links l on r.other = l.u),
roots as (select vec_id, min(other) as component_id from reach group by vec_id),
degrees as (select u, count(*) as n from links group by u)
select r.vec_id, coalesce(n, 0) as n_links, component_id, r.vec_id = component_id as kept
from roots r left join degrees d on d.u = r.vec_id"""
