"""Near-duplicate vectors: exact range join in metric space, by pivots.

Vectors are scaled to length 1; cosine >= c is then distance <= eps = sqrt(2 - 2c).  Pivots are a sample of the vectors,
about one for ``CELL`` of them; a vector is native to the cell of its nearest pivot.  If x, native to cell i, has a
partner y native to cell j at distance d, the triangle inequality gives |x pj| - |x pi| <= 2d, and for Euclidean distance
the sharper (|x pj|^2 - |x pi|^2) / (2 |pi pj|) <= d.  So x is replicated to the later cells where that holds for eps, and
each pair is met exactly once.  Cells join independently: natives in blocks of about ``BLOCK`` (by a hash), with everything
else of the cell streaming past in Arrow batches, so no task holds more than a block and a batch.  A block gives sums of links and
a forest that spans its links, never the pairs.

Equal vectors are one class before that; a class counts with its size and costs one row.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths never link; a null vec_id takes no part (component_id null, kept true); rows that repeat a vec_id with
its vector count as further vectors; a cosine that double precision gives as exactly the limit is a link; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .scratch import Scratch

CELL, BLOCK, PIVOTS = 4096, 4096, 4096
_SLACK = 1e-6
#: Vectors are short, so their Arrow batches may be longer than those of texts.
_ROWS = {"spark__sql__execution__arrow__maxRecordsPerBatch": "2048"}


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # components may be tiny or huge: scale by the largest first
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _assign(reps: DataFrame, pivots: np.ndarray, eps: float) -> DataFrame:
    """(cell, native, rep, members, unit vector) for each vector's own cell and the later ones it must reach."""
    gap = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"))
            square = np.maximum(0, 2 - 2 * x @ pivots.T)
            own = square.argmin(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = (square - square[np.arange(len(x)), own][:, None]) <= 2 * (eps + _SLACK) * gap[own] + _SLACK
            reach &= np.arange(len(pivots)) > own[:, None]
            reach[np.arange(len(x)), own] = True
            row, cell = np.nonzero(reach)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(cell == own[row]), batch.column("rep").take(take), batch.column("members").take(take), _packed(x).take(take)], names=["cell", "native", "rep", "members", "x"]
            )

    return reps.mapInArrow(run, "cell int, native boolean, rep long, members long, x binary")


class _Block:
    """Natives of one unit; ``compare`` counts the links of a batch with them and records edges that span them."""

    def __init__(self, rep: np.ndarray, members: np.ndarray, x: np.ndarray, least: float) -> None:
        self.rep, self.members, self.x, self.least = rep, members, x, least
        self.coarse = x.astype(np.float32)
        self.links = np.zeros(len(rep), dtype=np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.root = np.arange(len(rep))

    def _roots(self, k: np.ndarray) -> np.ndarray:
        at = self.root[k]
        while ((up := self.root[at]) != at).any():
            at = up
        self.root[k] = at
        return at

    def _merge(self, p: np.ndarray, q: np.ndarray) -> None:
        """Joins the components of each p and q; every root that goes gives one edge to the smallest root that it meets."""
        while True:
            a, b = self._roots(p), self._roots(q)
            differ = a != b
            if not differ.any():
                return
            p, q, high, low = p[differ], q[differ], np.maximum(a, b)[differ], np.minimum(a, b)[differ]
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            first = np.r_[True, high[1:] != high[:-1]]
            self.root[high[first]] = low[first]
            self.edges.append((self.rep[high[first]], self.rep[low[first]]))

    def compare(self, rep: np.ndarray, members: np.ndarray, x: np.ndarray, same: bool = False) -> np.ndarray:
        i, j = np.nonzero(x.astype(np.float32) @ self.coarse.T >= self.least - 1e-4)
        if same:
            i, j = i[i < j], j[i < j]
        found = np.zeros(len(rep), dtype=np.int64)
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            hit = np.einsum("ab,ab->a", x[p], self.x[q]) >= self.least
            p, q = p[hit], q[hit]
            np.add.at(found, p, self.members[q])
            np.add.at(self.links, q, members[p])
            if same:
                self._merge(p, q)
            else:
                first = np.unique(p, return_index=True)[1]
                self.edges.append((rep[p[first]], self.rep[q[first]]))
                lead = q[first][np.searchsorted(p[first], p)]
                self._merge(q[q != lead], lead[q != lead])
        return found


_UNIT = "rep long, links long, other long"


def _join_units(rows: DataFrame, least: float) -> DataFrame:
    """Rows of a partition come sorted by unit, natives first; the result has link sums (other null) and edges (links 0)."""

    def out(rep: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = links > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.nulls(int(some.sum()), pa.int64())], names=["rep", "links", "other"])

    def close(block: _Block) -> Iterator[pa.RecordBatch]:
        yield from out(block.rep, block.links)
        if block.edges:
            a, b = (np.concatenate(side) for side in zip(*block.edges))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.zeros(len(a), np.int64)), pa.array(b)], names=["rep", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, block = None, [], None

        def build() -> _Block:
            rep, members, x = (np.concatenate(c) for c in zip(*held))
            made = _Block(rep, members, x, least)
            made.links += made.compare(rep, members, x, same=True)
            return made

        for batch in batches:
            units, native = batch.column("unit").to_numpy(), batch.column("native").to_numpy(zero_copy_only=False)
            rep, members = batch.column("rep").to_numpy(), batch.column("members").to_numpy()
            raw = batch.column("x")
            cut = np.flatnonzero(np.r_[True, (units[1:] != units[:-1]) | (native[1:] != native[:-1])]).tolist() + [len(units)]
            for a, b in zip(cut, cut[1:]):
                x = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), dtype=np.float64).reshape(b - a, -1)
                if units[a] != unit:
                    if block is None and held:
                        block = build()
                    if block is not None:
                        yield from close(block)
                    unit, held, block = units[a], [], None
                if native[a]:
                    held.append((rep[a:b], members[a:b], x))
                elif held:
                    if block is None:
                        block = build()
                    yield from out(rep[a:b], block.compare(rep[a:b], members[a:b], x))
        if block is None and held:
            block = build()
        if block is not None:
            yield from close(block)

    return rows.mapInArrow(run, _UNIT)


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding; other columns are ignored)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda c: c != 0), F.lit(False))
    usable = plain.where(good)
    classes = scratch.save(usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members")), "classes")
    widths = [r[0] for r in classes.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]

    parts = []
    for width in widths:
        reps = classes.where(F.size("embedding") == width)
        n = reps.count()
        count = min(PIVOTS, max(1, math.ceil(n / CELL)))
        picked = reps.orderBy(F.xxhash64("rep"), "rep").select("embedding").limit(count).toPandas()["embedding"]
        pivots = _matrix(pa.array([list(map(float, v)) for v in picked], pa.list_(pa.float64())))
        rows = scratch.save(_assign(reps, pivots, math.sqrt(max(0.0, 2 - 2 * cosine))), f"assigned-{width}", **_ROWS)
        cells = rows.where("native").groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        # at most PIVOTS rows
        own = rows.join(F.broadcast(cells), "cell").withColumn("own", F.when(F.col("native"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
        # natives are held by their own block and pass the later ones; replicas pass all blocks of the cell
        placed = own.withColumn("block", F.explode(F.sequence(F.coalesce("own", F.lit(0)), F.col("blocks") - 1)))
        units = placed.select((F.col("cell").cast("long") * (1 << 31) + F.col("block")).alias("unit"), (F.col("native") & (F.col("block") == F.col("own"))).alias("native"), "rep", "members", "x")
        spread = units.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * count), "unit").sortWithinPartitions("unit", F.desc("native"))
        parts.append(scratch.save(_join_units(spread, cosine), f"joined-{width}", **_ROWS))
        scratch.drop(f"assigned-{width}")

    empty = spark.createDataFrame([], _UNIT)
    joined = empty
    for part in parts:
        joined = joined.unionByName(part)
    components = scratch.save(connected_components(scratch, joined.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), "cc"), "components")
    sums = joined.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(sums, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("embedding", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = plain.where(~good)
    out = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
