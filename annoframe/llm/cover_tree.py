"""All cosine links above a threshold within each label, by a cover tree and a traversal of its node pairs.

Unit vectors have the distance sqrt(2 - 2 cos), so a cosine threshold is a radius. Equal vectors are first
made one node.

*Tree.* Levels have the radii 2, 1, 1/2, ...; a node at one level covers the rows within its radius, and
its own centre goes on as the first centre of the next level. The tree is fitted on a sample of
``SAMPLE`` vectors, the smallest by hash; only centres that cover ``LEAST`` of the sample become nodes, so
the tree has at most SAMPLE / LEAST nodes a level, whatever the input is. Every row goes down it as
far as some node's radius covers it. The rows that end at one node are its cell. A row that no node
covers ends at the root of its label, so nothing is left out, also for labels that the sample missed.

*Pairs.* Two nodes and all below them are apart if the distance of their centres less both radii is
more than the threshold radius, and wholly linked if the distance and both radii are not more. What
neither holds for is split: first into cells, then into blocks of ``BLOCK`` rows, and blocks are compared
as matrices. A block pair gives counts and each row's smallest row of its component there, so a large
group of near copies makes rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import runtime
from annoframe.llm.components import components

THRESHOLD = 0.93
SAMPLE = 2048
LEAST = 8
BLOCK = 1024
SMALLEST = 1 / 32
_SLACK = 1e-9


class Tree:
    """Nodes of one label: centre, radius, parent (node 0 is the root and covers everything)."""

    def __init__(self, points: np.ndarray):
        self.centres, self.radius, self.parent = [points[0]], [2.0], [-1]
        self._grow(0, points)
        self.centres = np.array(self.centres)
        self.children: list[list[int]] = [[] for _ in self.parent]
        for i, p in enumerate(self.parent[1:], 1):
            self.children[p].append(i)

    def _grow(self, node: int, points: np.ndarray) -> None:
        radius = self.radius[node] / 2
        if len(points) < LEAST or radius < SMALLEST:
            return
        near = distances(points, points) <= radius
        own = distances(points, self.centres[node][None, :])[:, 0] <= radius
        left = np.ones(len(points), bool)
        first = True
        while True:
            # The node's own centre first, then the centre that covers most of what is left.
            if first:
                centre, covered, first = self.centres[node], own, False
            else:
                held = np.where(left, (near & left).sum(axis=1), 0)
                best = int(held.argmax())
                if held[best] < LEAST:
                    return
                centre, covered = points[best], near[best] & left
            if covered.sum() >= LEAST:
                left &= ~covered
                self.centres.append(centre)
                self.radius.append(radius)
                self.parent.append(node)
                self._grow(len(self.parent) - 1, points[covered])
            elif not left.any():
                return

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the lowest node that covers it on the way down to the nearest, and the distance to its centre."""
        cell, apart = np.zeros(len(points), np.int64), distances(points, self.centres[:1])[:, 0]
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below or not len(rows):
                continue
            far = distances(points[rows], self.centres[below])
            best = far.argmin(axis=1)
            least = far[np.arange(len(rows)), best]
            inside = least <= self.radius[below[0]]
            for j, child in enumerate(below):
                mine = rows[inside & (best == j)]
                cell[mine], apart[mine] = child, least[inside & (best == j)]
                todo.append((child, mine))
        return cell, apart

    def pairs(self, reach: float, wide: dict[int, float]) -> list[tuple[int, int, bool]]:
        """Cell pairs (a <= b) that may hold links, and whether all of their pairs are links.

        ``wide`` has the largest distance of a cell's rows from its centre, for cells that have rows.
        """
        out: list[tuple[int, int, bool]] = []
        under = [self._under(i) for i in range(len(self.parent))]
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            if a != b and self._apart(a, b) - self.radius[a] - self.radius[b] > reach + _SLACK:
                continue
            # The own cells of both, then each one's cell with what is below the other, then below with below.
            for c in [b] if a == b else [b, *under[b]]:
                self._cells(a, c, reach, wide, out)
            if a != b:
                for c in under[a]:
                    self._cells(b, c, reach, wide, out)
            else:
                for c in under[a]:
                    self._cells(a, c, reach, wide, out)
            below_a, below_b = self.children[a], self.children[b]
            todo += [(c, d) for c in below_a for d in below_b if a != b or c <= d]
        return sorted(set(out))

    def _under(self, node: int) -> list[int]:
        return [x for c in self.children[node] for x in (c, *self._under(c))]

    def _apart(self, a: int, b: int) -> float:
        return float(np.linalg.norm(self.centres[a] - self.centres[b]))

    def _cells(self, a: int, b: int, reach: float, wide: dict[int, float], out: list) -> None:
        if a in wide and b in wide:
            apart = 0.0 if a == b else self._apart(a, b)
            if apart - wide[a] - wide[b] <= reach + _SLACK:
                out.append((min(a, b), max(a, b), apart + wide[a] + wide[b] <= reach - _SLACK))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, unit): the unit vector as bytes of doubles; null for vectors that link with nothing."""
    for batch in batches:
        ok = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        units = []
        for i, v in enumerate(batch.column(2)):
            unit = None
            if ok[i] and v.is_valid and len(v.values):
                x = np.asarray(v.values.cast(pa.float64()).fill_null(np.nan), np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top
                    unit = (x / np.sqrt((x * x).sum())).astype("<f8").tobytes()
            units.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], ["vec_id", "label", "unit"])


def _matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<f8").reshape(len(cells), -1)


def _blocks(found: pa.Table) -> pa.Table:
    """One row for a block: its nodes, their copies and vectors."""
    found = found.sort_by("node")
    one = [found.column(c)[0].as_py() for c in ("label", "size", "cell", "block")]
    nodes, copies = (np.asarray(found.column(c), np.int64) for c in ("node", "copies"))
    row = [*one, int(nodes[0]), nodes.tobytes(), copies.tobytes(), b"".join(found.column("unit").to_pylist())]
    schema = pa.schema([("label", pa.string()), ("size", pa.int32()), ("cell", pa.int64()), ("block", pa.int64()), ("id", pa.int64()), ("nodes", pa.binary()), ("copies", pa.binary()), ("units", pa.binary())])
    return pa.table([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


_COMPARED = "node long, links long, root long"


def compare(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of x and y (y None: within x), and for each row of both its component's first row."""
    linked = (x @ (x if y is None else y).T) >= threshold
    if y is None:
        np.fill_diagonal(linked, False)
    n = len(x)
    roots = np.arange(n if y is None else n + len(y))
    while True:
        a, b = (roots, roots) if y is None else (roots[:n], roots[n:])
        big = len(roots)
        low_a = np.minimum(a, np.where(linked, b[None, :], big).min(axis=1, initial=big))
        if y is None:
            new = low_a
        else:
            new = np.concatenate([low_a, np.minimum(b, np.where(linked, low_a[:, None], big).min(axis=0, initial=big))])
        new = new[new]
        if (new == roots).all():
            return linked, roots
        roots = new


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            a, ca = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["copies"], np.int64)
            x = np.frombuffer(row["units"], "<f8").reshape(len(a), -1)
            if row["id"] == row["id2"]:
                linked, roots = compare(x, None, threshold)
                nodes, counts = a, linked @ ca
            else:
                b, cb = np.frombuffer(row["nodes2"], np.int64), np.frombuffer(row["copies2"], np.int64)
                linked, roots = compare(x, np.frombuffer(row["units2"], "<f8").reshape(len(b), -1), threshold)
                nodes, counts = np.concatenate([a, b]), np.concatenate([linked @ cb, ca @ linked])
            some = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(counts[some]), pa.array(nodes[roots[some]])], ["node", "links", "root"])


def links(vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Rows are linked if their labels are equal and the cosine in double precision is at least
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components, those whose
    label is null, and those of different lengths link with nothing. Equal vectors are linked.
    ``component_id`` is the smallest id reachable by links; rows that repeat an id with another vector are
    vectors of their own. A null id is never the smallest. Other columns are not read.
    """
    spark = vectors.sparkSession
    runtime.ship(spark)
    reach = float(np.sqrt(2 - 2 * threshold))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    rows = runtime.table(rows.mapInArrow(_units, "vec_id long, label string, unit binary"))
    good = rows.filter("unit is not null")
    nodes = good.groupBy("label", "unit").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = nodes.withColumns({"node": F.monotonically_increasing_id(), "size": F.octet_length("unit")})
    nodes = runtime.table(nodes)

    sample = nodes.select("label", "size", "unit").orderBy(F.xxhash64("unit"), "label").limit(SAMPLE).toArrow().to_pylist()
    held: dict[tuple[str, int], list[bytes]] = {}
    for r in sample:
        held.setdefault((r["label"], r["size"]), []).append(r["unit"])
    trees = {k: tree for k, v in held.items() if len((tree := Tree(_matrix(v))).parent) > 1}
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist(), strict=True))
            cell, apart = np.zeros(len(keys), np.int64), np.full(len(keys), 2.0)
            for key in set(keys) & set(shared.value):
                mine = np.array([i for i, k in enumerate(keys) if k == key])
                cell[mine], apart[mine] = shared.value[key].cells(_matrix(batch.column("unit").take(pa.array(mine)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(apart)], [*batch.schema.names, "cell", "apart"])

    placed = nodes.select("node", "label", "size", "copies", "unit").mapInArrow(place, "node long, label string, size int, copies long, unit binary, cell long, apart double")
    placed = runtime.table(placed)
    cells = runtime.table(placed.groupBy("label", "size", "cell").agg(F.count("*").alias("rows"), F.sum("copies").alias("all"), F.max("apart").alias("wide"), F.min("node").alias("first")))
    # Which cells to compare. Only labels that have a tree, at most SAMPLE / LEAST, are looked at here.
    wide: dict[tuple[str, int], dict[int, float]] = {}
    if trees:
        keys = spark.createDataFrame(list(trees), "label string, size int")
        for r in cells.join(F.broadcast(keys), ["label", "size"]).select("label", "size", "cell", "wide").toLocalIterator():
            wide.setdefault((r.label, r.size), {})[r.cell] = r.wide
    plan = [(*k, a, b, whole) for k, tree in trees.items() for a, b, whole in tree.pairs(reach, wide.get(k, {}))]
    plan = spark.createDataFrame(plan, "label string, size int, cell long, other long, whole boolean")
    own = cells.join(plan.select("label", "size").distinct(), ["label", "size"], "left_anti").select("label", "size", "cell", F.col("cell").alias("other"))
    todo = plan.filter("not whole").drop("whole").unionByName(own)

    parts = cells.select("label", "size", "cell", F.ceil(F.col("rows") / BLOCK).alias("parts"))
    dealt = placed.join(parts, ["label", "size", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.select("label", "size", "cell", "block", "node", "copies", "unit")
    schema = "label string, size int, cell long, block long, id long, nodes binary, copies binary, units binary"
    blocks = runtime.table(dealt.groupBy("label", "size", "cell", "block").applyInArrow(_blocks, schema))
    key = blocks.select("label", "size", "cell", "id")
    pairs = key.join(todo, ["label", "size", "cell"]).join(key.select("label", "size", F.col("cell").alias("other"), F.col("id").alias("id2")), ["label", "size", "other"])
    pairs = pairs.filter("cell <> other or id <= id2").select("id", "id2")
    pairs = runtime.table(pairs)
    cut = max(1, -(-pairs.count() // 64))
    left = blocks.select("id", "nodes", "copies", "units")
    right = blocks.select(F.col("id").alias("id2"), F.col("nodes").alias("nodes2"), F.col("copies").alias("copies2"), F.col("units").alias("units2"))
    joined = pairs.repartition(cut, F.xxhash64("id", "id2")).join(left, "id").join(right, "id2")
    found = runtime.table(joined.mapInArrow(lambda b: _compare(b, threshold), _COMPARED))

    # Cells that are wholly linked: each row gets the other cell's rows, and all hang on the cells' first nodes.
    whole = plan.filter("whole")
    both = whole.select("label", "size", "cell", "other").union(whole.filter("cell <> other").select("label", "size", "other", "cell"))
    totals = both.join(cells.select("label", "size", F.col("cell").alias("other"), "all", F.col("first").alias("hook")), ["label", "size", "other"])
    self_ = F.col("cell") == F.col("other")
    totals = totals.groupBy("label", "size", "cell").agg(F.sum("all").alias("all"), F.max(self_.cast("int")).alias("self"), F.collect_set("hook").alias("hooks"))
    more = placed.join(totals, ["label", "size", "cell"])
    counts = found.select("node", "links").union(more.select("node", (F.col("all") - F.when(F.col("self") == 1, F.col("copies")).otherwise(0)).alias("links")))
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select(F.col("node").alias("a"), F.explode("hooks").alias("b")))
    roots = components(edges)
    named = nodes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("label", "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = good.join(named, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.filter("unit is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
