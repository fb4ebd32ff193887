"""Space-partitioning cells and the Barnes-Hut repulsion.

Level L cuts the root cell into 2**L parts along each axis; a point's cell is found by a floor held inside the root, so
no point is lost on its border.  A cell is a leaf if all its points coincide; other cells are cut on, down to LEVELS, where
their width is below the rounding of positions.  A target takes a cell as a whole if it is a leaf or half-width / distance
< theta; in a leaf that holds the target itself that one is not counted.  As theta goes to 0 the sums become those over
all pairs.

Over DataFrames part of the tree is on the driver and broadcast.  In few dimensions that is a grid, all cells down to a
depth, which are one aggregate of no more than CELLS rows.  From the dimension on where a grid that small would have
fewer than GRID levels it is a linear tree: cells are named by their paths, one digit of as many bits as there are axes
for each level, and level by level an aggregate over the paths finds the cells of more than CROWD points, which alone are
cut on.  Their number goes with points / CROWD in any dimension, and sparse parts of space have none.

Where a target needs more of a cell than the tree holds, it asks the points of that cell that are in none of its cells
further down, in a second step.  They are dealt into buckets of POINTS by a hash, so that no task holds more whatever the
dimension; a bucket's points, as distinct positions with their numbers, become a tree of their own, and many asking
targets are split over several tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators.layout import coordinates
from nearfold.sources.folders import once

#: Cells that may be broadcast: about 50 bytes each.
CELLS = 1 << 20
#: Levels of a tree at most; levels that a grid has at least.
LEVELS, GRID = 50, 3
#: Points of a cell of a linear tree beyond which it is cut on; points of a bucket.
CROWD, POINTS = 2048, 16_384
#: Targets that walk a tree together: so many that what they look at stays in the processor's cache.
TARGETS = 4096
#: Targets that ask one bucket in one task.
ASKS = 50_000


def default_depth(dims: int) -> int:
    """The most levels, up to 12, whose cells are at most CELLS; 0, the root alone, beyond 20 dimensions."""
    depth = 0
    while depth < 12 and sum(2 ** (dims * k) for k in range(depth + 2)) <= CELLS:
        depth += 1
    return depth


def root_cell(y: DataFrame) -> DataFrame:
    """One row: c0, w0, c1, w1, ...: mean and half-width along each axis."""
    out = []
    for k, c in enumerate(coordinates(y)):
        mean = F.avg(c)
        out += [mean.alias(f"c{k}"), (F.greatest(F.max(c) - mean, mean - F.min(c)) + 2.2250738585072014e-308).alias(f"w{k}")]
    return y.agg(*out)


def cell_table(y: DataFrame, depth: int) -> DataFrame:
    """(level, k..., n, m..., w, leaf): the cells that hold points: place along each axis, points, center of mass,
    largest half-width.  One pass, one shuffle of at most as many rows as there are cells and tasks."""
    names = coordinates(y)
    dims = range(len(names))
    placed = y.join(F.broadcast(root_cell(y))).select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    part = F.pow(F.lit(2.0), F.col("level"))
    key = [F.least(F.greatest(F.floor((F.col(c) - (F.col(f"c{k}") - F.col(f"w{k}"))) * part / (2 * F.col(f"w{k}"))), F.lit(0)), part - 1).cast("long").alias(f"k{k}") for k, c in enumerate(names)]
    placed = placed.select("level", *names, (F.greatest(*(F.col(f"w{k}") for k in dims)) if len(names) > 1 else F.col("w0")).alias("w"), *key)
    same = F.lit(True)
    for c in names:
        same = same & (F.min(c) == F.max(c))
    cells = placed.groupBy("level", *(f"k{k}" for k in dims)).agg(F.count("*").alias("n"), *(F.when(same, F.min(c)).otherwise(F.avg(c)).alias(f"m{k}") for k, c in enumerate(names)), (F.first("w") / F.pow(F.lit(2.0), F.first("level"))).alias("w"), same.alias("same"))
    return cells.withColumn("leaf", F.col("same")).drop("same")


@dataclass
class CellTree:
    """The cells as arrays, children of a cell together, a cell with only one child left out for that child."""

    n: np.ndarray
    mass: np.ndarray
    width: np.ndarray  # largest half-width; of a leaf, how far its points may be from its mass
    leaf: np.ndarray
    first: np.ndarray  # first child
    children: np.ndarray
    cell: np.ndarray  # number of a cell with points that are in none of its children here, else -1

    @classmethod
    def build(cls, y: np.ndarray, weight: np.ndarray | None = None) -> CellTree:
        """Of positions (points x dims), each counted `weight` times, down to single ones."""
        weight = np.ones(len(y)) if weight is None else weight.astype(float)
        center = np.average(y, axis=0, weights=weight)
        half = np.maximum(y.max(axis=0) - center, center - y.min(axis=0)) + 2.2250738585072014e-308
        scaled = np.clip((y - (center - half)) / (2 * half), 0, 1 - 2.0**-53)
        order, bounds = np.arange(len(y)), np.array([0, len(y)])  # points by cell of this level
        node = np.zeros(1, dtype=np.int64)  # number of each cell of this level
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("n", "mass", "width", "leaf")}
        links = []
        made = 0

        def add(order: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            """New cells; says which are leaves."""
            own, w, at = y[order], weight[order], bounds[:-1]
            n = np.add.reduceat(w, at)
            same = (np.minimum.reduceat(own, at) == np.maximum.reduceat(own, at)).all(axis=1)
            mass = np.where(same[:, None], own[at], np.add.reduceat(own * w[:, None], at) / n[:, None])
            for k, x in (("n", n), ("mass", mass), ("width", np.zeros(len(n))), ("leaf", same)):
                parts[k].append(x)
            return same

        leaf = add(order, bounds)
        made = 1
        widths = [(node, 0)]
        for level in range(1, LEVELS + 1):
            size = np.diff(bounds)
            order, node, size = order[np.repeat(~leaf, size)], node[~leaf], size[~leaf]
            if not len(node):
                break
            parent = np.repeat(np.arange(len(node)), size)
            code = parent
            bit = np.floor(scaled[order] * 2.0**level).astype(np.int64) & 1
            for a in range(0, bit.shape[1], 20):  # 20 axes at a time keep the numbers small
                some = bit[:, a : a + 20] @ (1 << np.arange(bit[:, a : a + 20].shape[1]))
                code = np.unique(code << 20 | some, return_inverse=True)[1]
            by = np.argsort(code, kind="stable")
            order, parent, code = order[by], parent[by], code[by]
            bounds = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
            up = parent[bounds[:-1]]
            several = np.bincount(up, minlength=len(node))
            split = several[up] > 1
            # a cell with one child becomes that child: the same points in a narrower cell
            child = node[up]
            new_bounds, keep = bounds, np.repeat(split, np.diff(bounds))
            leaf = np.zeros(len(up), dtype=bool)
            if split.any():
                lengths = np.diff(bounds)[split]
                leaf[split] = add(order[keep], np.r_[0, np.cumsum(lengths)])
                child = child.copy()
                child[split] = made + np.arange(split.sum())
                heads = np.flatnonzero(split & np.r_[True, up[1:] != up[:-1]])
                links.append((node[up[heads]], child[heads], several[up[heads]]))
                made += int(split.sum())
            widths.append((child[~leaf], level))
            node, bounds = child, new_bounds
        n, mass, width, is_leaf = (np.concatenate(parts[k]) for k in ("n", "mass", "width", "leaf"))
        for own, level in widths:
            width[own] = half.max() / 2.0**level
        first, children = np.zeros(made, dtype=np.int64), np.zeros(made, dtype=np.int64)
        for own, begin, many in links:
            first[own], children[own] = begin, many
        last = ~is_leaf & (children == 0)  # at the last level: points that rounding cannot tell apart
        width[last] *= 2 * y.shape[1] ** 0.5
        width[is_leaf] = 0
        return cls(n, mass, width, is_leaf | last, first, children, np.full(made, -1))

    @classmethod
    def of(cls, level, key, n, mass, width, leaf) -> CellTree:
        """Of a cell table; cells under a leaf do not count."""
        order = np.lexsort((*reversed((key >> 1).T), level))
        level, key, n, mass, width, leaf = (x[order] for x in (level, key, n, mass, width, leaf))
        last = level.max(initial=0)
        first, children = np.zeros(len(level), dtype=np.int64), np.zeros(len(level), dtype=np.int64)
        begin = np.searchsorted(level, np.arange(last + 2))
        for lv in range(1, last + 1):
            above, own = np.arange(begin[lv - 1], begin[lv]), np.arange(begin[lv], begin[lv + 1])
            # both sides numbered by their keys; a level's cells come in the order of their parents' keys
            _, code = np.unique(np.concatenate([key[above], key[own] >> 1]), axis=0, return_inverse=True)
            code = code.ravel()
            where = np.full(code.max(initial=0) + 1, -1)
            where[code[: len(above)]] = above
            parent = where[code[len(above) :]]
            heads = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            first[parent[heads]] = own[heads]
            children[parent[heads]] = np.diff(np.r_[heads, len(own)])
        children[leaf] = 0
        cell = np.where(~leaf & (level == last), np.arange(len(level)) - begin[last], -1)
        return cls(n.astype(float), mass, np.where(leaf, 0.0, width), leaf, first, children, cell)

    def repulsion(self, y: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the cells that each target takes: N q^2 (y - center of mass), and N q."""
        force, total, point, _ = self.walk(y, theta)
        if len(point):
            raise ValueError("the tree does not go down to single points")
        return force, total

    def walk(self, y: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sums, and the targets and cells where more than the tree holds is needed."""
        force, total = np.zeros_like(y), np.zeros(len(y))
        masses = [np.ascontiguousarray(c) for c in self.mass.T]
        open_point, open_cell = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        deeper = bool((self.cell >= 0).any())
        for a in range(0, len(y), TARGETS):
            own = [np.ascontiguousarray(c) for c in y[a : a + TARGETS].T]
            size = len(own[0])
            point, cell = np.arange(size), np.zeros(size, dtype=np.int64)
            while len(point):
                diff = [c.take(point) - m.take(cell) for c, m in zip(own, masses, strict=True)]
                d2 = diff[0] * diff[0]
                for d in diff[1:]:
                    d2 += d * d
                take = self.width.take(cell) < theta * np.sqrt(d2)
                take |= self.leaf.take(cell)
                at = np.flatnonzero(take)
                p, c, near = point.take(at), cell.take(at), d2.take(at)
                n = self.n.take(c) - (self.leaf.take(c) & (near <= self.width.take(c) ** 2))  # a leaf that holds the target
                q = 1 / (1 + near)
                w = n * q
                total[a : a + size] += np.bincount(p, weights=w, minlength=size)
                w *= q
                for k, d in enumerate(diff):
                    force[a : a + size, k] += np.bincount(p, weights=w * d.take(at), minlength=size)
                at = np.flatnonzero(~take)
                point, cell = point.take(at), cell.take(at)
                if deeper and (below := self.cell.take(cell) >= 0).any():
                    open_point.append(a + point[below])
                    open_cell.append(self.cell[cell[below]])
                many = self.children.take(cell)
                past = np.cumsum(many)
                cell = np.repeat(self.first.take(cell) - (past - many), many) + np.arange(past[-1] if len(past) else 0)
                point = np.repeat(point, many)
        return force, total, np.concatenate(open_point), np.concatenate(open_cell)


@dataclass
class InGrid:
    number: dict[bytes, int]  # of the cells of the last level, by their keys
    open: np.ndarray
    depth: int

    def __call__(self, y: np.ndarray, center: np.ndarray, half: np.ndarray) -> np.ndarray:
        at = np.array([self.number.get(k.tobytes(), -1) for k in _keys(y, center, half, self.depth)], dtype=np.int64)
        return np.where(self.open[at], at, -1) if len(self.open) else at


@dataclass
class InPaths:
    below: list[dict[tuple[int, bytes], int]]  # of each level from 1, cells by the cell above and the digit
    cell: np.ndarray  # numbers of open cells

    def __call__(self, y: np.ndarray, center: np.ndarray, half: np.ndarray) -> np.ndarray:
        node, on = np.zeros(len(y), dtype=np.int64), np.arange(len(y))
        for level, below in enumerate(self.below, 1):
            digit = (_keys(y[on], center, half, level) & 1).astype(np.uint8)
            down = np.array([below.get((a, b.tobytes()), -1) for a, b in zip(node[on].tolist(), digit, strict=True)], dtype=np.int64)
            on, down = on[down >= 0], down[down >= 0]
            node[on] = down
        return self.cell[node]


@dataclass
class Partial:
    """A tree, and how the points that it does not hold one by one are dealt: each of its open cells has some buckets."""

    tree: CellTree
    center: np.ndarray
    half: np.ndarray
    buckets: np.ndarray  # of each open cell
    where: InGrid | InPaths  # the open cell of each position, -1 for one in a leaf

    def __post_init__(self):
        self.begin = np.cumsum(self.buckets) - self.buckets

    def asked(self, point: np.ndarray, cell: np.ndarray, targets: int) -> list[np.ndarray]:
        """The buckets that each target asks."""
        many = self.buckets[cell]
        past = np.cumsum(many)
        bucket = np.repeat(self.begin[cell] - (past - many), many) + np.arange(past[-1] if len(past) else 0)
        point = np.repeat(point, many)
        return np.split(bucket[np.argsort(point, kind="stable")], np.cumsum(np.bincount(point, minlength=targets))[:-1])

    def bucket(self, y: np.ndarray) -> np.ndarray:
        """The bucket of each position, -1 for one in a leaf; equal positions have the same."""
        cell = self.where(y, self.center, self.half)
        mixed = np.array([zlib.crc32(r.tobytes()) for r in y], dtype=np.int64)
        return np.where(cell < 0, -1, self.begin[cell] + mixed % np.maximum(self.buckets[cell], 1)) if len(self.buckets) else cell


def _several(table: pa.Table, c: str, dims: int) -> np.ndarray:
    return np.stack([table.column(f"{c}{k}").to_numpy() for k in range(dims)], axis=1)


def grid_tree(y: DataFrame, depth: int) -> Partial:
    """The cell table of positions as a tree, whose size the depth bounds; its cells of the last level that are no leaves
    are open."""
    dims = len(coordinates(y))
    if depth and sum(2 ** (dims * k) for k in range(depth + 1)) > CELLS:
        raise ValueError(f"depth {depth} may have more than {CELLS} cells in {dims} dimensions")
    root = root_cell(y).first()
    t = cell_table(y, depth).toArrow()
    center, half = (np.array([root[f"{c}{k}"] for k in range(dims)]) for c in "cw")
    level, key, n, leaf = t.column("level").to_numpy(), _several(t, "k", dims), t.column("n").to_numpy(), t.column("leaf").to_numpy().astype(bool)
    tree = CellTree.of(level, key, n, _several(t, "m", dims), t.column("w").to_numpy(), leaf)
    order = np.lexsort((*reversed((key >> 1).T), level))
    last = order[level[order] == level.max(initial=0)]
    number = {k.tobytes(): at for at, k in enumerate(key[last])}
    return Partial(tree, center, half, np.ceil(n[last] / POINTS).astype(np.int64), InGrid(number, ~leaf[last], depth))


def linear_tree(y: DataFrame) -> Partial:
    """The cells of more than CROWD points, and the root: one job for each level that has some."""
    names = coordinates(y)
    dims = len(names)
    root = root_cell(y).first()
    center, half = (np.array([root[f"{c}{k}"] for k in range(dims)]) for c in "cw")
    same = reduce(lambda a, b: a & b, (F.min(c) == F.max(c) for c in names))
    sums = [F.count("*").alias("n"), *(F.when(same, F.min(c)).otherwise(F.avg(c)).alias(f"m{k}") for k, c in enumerate(names)), same.alias("leaf")]
    live, level = y.select(*names, F.lit("").alias("path")), 0
    levels: list[pa.Table] = []
    crowd = 0  # the root counts whatever it holds
    while True:
        t = live.groupBy("path").agg(*sums).where(F.col("n") > crowd).orderBy("path").toArrow()  # n / CROWD rows at most
        if not t.num_rows:
            break
        levels.append(t)
        crowd = crowd or max(CROWD, t.column("n")[0].as_py() // (CELLS // 8))
        open_ = t.filter(pa.compute.invert(t.column("leaf"))).select(["path"])
        if not open_.num_rows or level == LEVELS:
            break
        level += 1
        part = 2.0**level
        bits = [F.least(F.greatest(F.floor((F.col(c) - float(center[k] - half[k])) * part / float(2 * half[k])), F.lit(0)), F.lit(int(part) - 1)).bitwiseAND(1).cast("string") for k, c in enumerate(names)]
        live = live.join(F.broadcast(y.sparkSession.createDataFrame(open_)), "path", "left_semi").withColumn("path", F.concat("path", *bits))
    size = np.array([t.num_rows for t in levels])
    first_of = np.cumsum(size) - size
    n, mass, leaf = (np.concatenate(x) for x in zip(*((t.column("n").to_numpy(), _several(t, "m", dims), t.column("leaf").to_numpy(zero_copy_only=False)) for t in levels), strict=True))
    width = np.where(leaf, 0.0, half.max() / 2.0 ** np.repeat(np.arange(len(levels)), size))
    first, children, left = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64), n.copy()
    child: list[dict[tuple[int, bytes], int]] = []
    paths = [t.column("path").to_pylist() for t in levels]
    for lv in range(1, len(levels)):
        above = {path: first_of[lv - 1] + k for k, path in enumerate(paths[lv - 1])}
        child.append({})
        for k, path in enumerate(paths[lv]):  # in the order of their parents
            up, own = above[path[:-dims]], first_of[lv] + k
            first[up] = first[up] if children[up] else own
            children[up] += 1
            left[up] -= n[own]
            child[-1][int(up), bytes(map(int, path[-dims:]))] = int(own)
    open_ = ~leaf & (left > 0)
    cell = np.where(open_, np.cumsum(open_) - 1, -1)

    return Partial(CellTree(n.astype(float), mass, width, leaf, first, children, cell), center, half, np.ceil(left[open_] / POINTS).astype(np.int64), InPaths(child, cell))


def _keys(y: np.ndarray, center: np.ndarray, half: np.ndarray, level: int) -> np.ndarray:
    part = 2.0**level
    return np.clip(np.floor((y - (center - half)) * part / (2 * half)), 0, part - 1).astype(np.int64)


def repulsion(y: DataFrame, theta: float, depth: int | None = None, keep: Callable[[DataFrame], DataFrame] = once) -> DataFrame:
    """(id, r0, r1, ..., q) of every position: map-only over a broadcast tree, and a second step, dealt by bucket, for
    what it does not hold.  depth: of a grid in any case."""
    if not theta > 0:
        raise ValueError("theta must be positive")
    names = coordinates(y)
    dims = len(names)
    spark = y.sparkSession
    part = linear_tree(y) if depth is None and default_depth(dims) < GRID else grid_tree(y, default_depth(dims) if depth is None else depth)
    held = spark.sparkContext.broadcast(part)
    forces = ", ".join(f"{c} double" for c in (*(f"r{k}" for k in range(dims)), "q"))
    kinds = ", ".join(f"{c} double" for c in names)

    def run(batches):
        part = held.value
        for b in batches:
            own = np.stack([b.column(c).to_numpy() for c in names], axis=1)
            force, q, point, cell = part.tree.walk(own, theta)
            asks = part.asked(point, cell, len(own))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, force.T), pa.array(q), pa.array(asks, pa.list_(pa.int64()))], names=["id", *names, *(f"r{k}" for k in range(dims)), "q", "asks"])

    first = y.select("id", *names).mapInArrow(run, f"id long, {kinds}, {forces}, asks array<long>")
    sums = ["id", *(f"r{k}" for k in range(dims)), "q"]
    if not (part.tree.cell >= 0).any():
        return first.select(sums)
    first = keep(first)
    asked = first.select("id", *names, F.explode("asks").alias("cell"))
    counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))  # a row for each bucket

    def place(batches):
        part = held.value
        for b in batches:
            own = np.stack([b.column(c).to_numpy() for c in names], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.bucket(own))], names=[*names, "cell"])

    points = y.select(*names).mapInArrow(place, f"{kinds}, cell long").groupBy("cell", *names).agg(F.count("*").alias("n"))
    points = points.join(F.broadcast(counts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("id"), *names, "n")
    asked = asked.join(F.broadcast(counts), "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", *names, F.lit(0).cast("long").alias("n"))
    both = points.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("n") == 0)

    def near(batches):
        at, parts, tree = None, [], None  # the bucket at work: its points so far, and the tree once targets come
        for b in batches:
            cell, part, n = (b.column(c).to_numpy() for c in ("cell", "part", "n"))
            own = np.stack([b.column(c).to_numpy() for c in names], axis=1)
            cut = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | ((n[1:] == 0) != (n[:-1] == 0)), True])
            for x, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if at != (cell[x], part[x]):
                    at, parts, tree = (cell[x], part[x]), [], None
                if n[x]:
                    parts.append((own[x:z], n[x:z]))
                    continue
                tree = tree or CellTree.build(np.concatenate([p for p, _ in parts]), np.concatenate([m for _, m in parts]))
                force, q = tree.repulsion(own[x:z], theta)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(x, z - x), *map(pa.array, force.T), pa.array(q)], names=sums)

    more = both.mapInArrow(near, f"id long, {forces}")
    return first.select(sums).unionByName(more).groupBy("id").agg(*(F.sum(c).alias(c) for c in sums[1:]))
