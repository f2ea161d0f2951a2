"""Near-duplicate vectors by an exact range join in the metric of unit vectors.

Cosine similarity s of unit vectors is the distance sqrt(2 - 2 s). Every vector's home is the
cell of its nearest pivot. If x with home h is within r of a vector with home j, the triangle
inequality gives d(x, p_j) <= d(x, p_h) + 2 r, and also d(x, p_j)^2 - d(x, p_h)^2 <= 2 r d(p_h, p_j),
since the boundary between the cells is the pivots' bisector. x is copied to every cell j < h for
which both hold, so that each pair within r meets in exactly one cell, the lower of its homes.
Cells are joined independently of each other. A large cell is split: each share of its own vectors meets
each share of the whole cell in a task of its own, so that no task holds more than two shares. Nothing is approximate and no partner is left out.

Pairs of a cluster grow as its square. `range_classes` gives the same links without listing these: vectors with the same
links, themselves included, are a class, and links lead from class to class. Tasks add up what a vector meets, so that no pair is sent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.tables import BROADCAST_BYTES, long_ids
from voxlake.operators.components import cut

MIN_COSINE = 0.95
#: A share of a cell has about so many vectors of its own.
SHARE = 4096
#: Columns of two independent 64-bit hashes of an id.
MARKS = ("mark1", "mark2")
_SLACK = 1e-4
_BLOCK = 1024


def radius(min_cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * min_cosine))


def unit_rows(ids: pa.Array, vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and float64 unit vectors of the rows that have an id and a finite, non-zero vector of this size."""
    length = pc.list_value_length(vectors)
    fits = pc.fill_null(pc.and_(pc.and_(ids.is_valid(), vectors.is_valid()), pc.equal(length, size)), False)
    ids, vectors = ids.filter(fits), vectors.filter(fits)
    # a null element is no number
    a = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), size)
    with np.errstate(all="ignore"):
        norm = np.sqrt((a * a).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        # lengths whose squares are beyond what a double holds
        odd = np.isfinite(a).all(axis=1) & a.any(axis=1) & ~good
        if odd.any():
            a[odd] /= np.abs(a[odd]).max(axis=1, keepdims=True)
            norm[odd] = np.sqrt((a[odd] * a[odd]).sum(axis=1))
            good |= odd
    return ids.to_numpy().astype(np.int64)[good], a[good] / norm[good, None]


class _Pairs:
    """What a task finds, as pairs of ids."""

    schema = "id_a long, id_b long"

    def __init__(self, table: pa.Table):
        self.ids, self.found = table.column("id").to_numpy(), []

    def add(self, u: np.ndarray, w: np.ndarray) -> None:
        self.found.append((self.ids[u], self.ids[w]))

    def result(self) -> pa.Table:
        a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*self.found, strict=True) if self.found else ((), ())))
        return pa.table({"id_a": np.minimum(a, b), "id_b": np.maximum(a, b)})


class _Links:
    """What a task finds, added up by id: the number of its partners, and two sums without carry of their marks.

    A pair of ids with one row each is found once, so it is added up here. Others may be found again
    in another task: these are told one by one, with the partner in `other`.
    """

    schema = "id long, other long, links long, mark1 long, mark2 long"

    def __init__(self, table: pa.Table):
        self.ids, self.single = table.column("id").to_numpy(), table.column("single").to_numpy(zero_copy_only=False)
        self.marks = [table.column(c).to_numpy() for c in MARKS]
        self.links, self.sums = np.zeros(len(self.ids), np.int64), [np.zeros(len(self.ids), np.int64) for _ in MARKS]
        self.u, self.w = [], []

    def add(self, u: np.ndarray, w: np.ndarray) -> None:
        once = self.single[u] & self.single[w]
        self.u += [u[~once], w[~once]]
        self.w += [w[~once], u[~once]]
        u, w = u[once], w[once]
        for x, y in ((u, w), (w, u)):
            if not len(x):
                continue
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            self.links[x[first]] += np.diff(np.append(first, len(x)))
            for total, mark in zip(self.sums, self.marks, strict=True):
                total[x[first]] ^= np.bitwise_xor.reduceat(mark[y], first)

    def result(self) -> pa.Table:
        met = np.flatnonzero(self.links)
        u, w = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (self.u, self.w))
        other = pa.concat_arrays([pa.nulls(len(met), pa.int64()), pa.array(self.ids[w])])
        sums = [np.concatenate([total[met], mark[w]]) for total, mark in zip(self.sums, self.marks, strict=True)]
        return pa.table({"id": np.concatenate([self.ids[met], self.ids[u]]), "other": other, "links": np.concatenate([self.links[met], np.ones(len(u), np.int64)]), "mark1": sums[0], "mark2": sums[1]})


def placed(vectors: DataFrame, size: int, pivots: np.ndarray, r: float) -> DataFrame:
    """(cell, home, id, single, vector): each vector in its home cell and in those that it is copied to."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
        rank = np.arange(len(p))
        for batch in batches:
            at, x = unit_rows(pa.array(np.arange(batch.num_rows)), batch.column(1), size)
            ids, once = batch.column(0).to_numpy()[at], batch.column(2).to_numpy(zero_copy_only=False)[at]
            for low in range(0, len(ids), _BLOCK):
                own, part = ids[low : low + _BLOCK], x[low : low + _BLOCK]
                square = np.maximum(0, 2 - 2 * part @ p.T)
                home = square.argmin(axis=1)
                near = square[np.arange(len(own)), home][:, None]
                goes = (rank < home[:, None]) & (np.sqrt(square) <= np.sqrt(near) + 2 * r + _SLACK) & (square - near <= 2 * r * between[home] + _SLACK)
                row, cell = np.nonzero(goes)
                row, cell = np.concatenate([np.arange(len(own)), row]), np.concatenate([home, cell])
                data = [v.tobytes() for v in part]
                single = once[low : low + _BLOCK][row]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.arange(len(row)) < len(own)), pa.array(own[row]), pa.array(single), pa.array([data[k] for k in row.tolist()], pa.binary())], ["cell", "home", "id", "single", "vector"])

    return vectors.mapInArrow(place, "cell long, home boolean, id long, single boolean, vector binary")


def range_pairs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE, share: int = SHARE, pivots: int | None = None) -> DataFrame:
    """(id_a, id_b) with id_a < id_b for each pair of ids with vectors of cosine min_cosine or more.

    Rows with a null id, or a null, empty or zero vector or one with a null, NaN or infinite element are in no
    pair, nor are vectors of different sizes compared. Rows that repeat an id all count, but an id is no
    partner of itself, and a pair is one row however often it is found; one of cosine min_cosine itself is in. Very long vectors are
    compared whole. Ids may be of any type that has an order. Other columns, whatever their names, are ignored; an empty table
    gives no rows.
    """
    rows, restored = _long_rows(vectors, id_col, vector_col)
    pairs = _found(rows.withColumn("single", F.lit(True)), _Pairs, min_cosine, share, pivots)
    return restored(pairs.distinct(), ["id_a", "id_b"])


def range_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE, share: int = SHARE, pivots: int | None = None) -> DataFrame:
    """(kind, id, class_id, links): the pairs of `range_pairs`, without those within a class written out.

    Ids that are linked to the same ids, if each counts as linked to itself, are a class, called by its least id; so any two
    ids of a class are a pair. A row of kind "member" tells an id's class and how many ids it is linked to; every id
    that isn't null has one, also an id in no pair, which is its own class with 0 links. A row of kind "link" says that
    all of the class `id` are linked to all of the greater class `class_id`, which makes `links` pairs. Two ids are a pair of `range_pairs` just if they are of
    one class or their classes are linked. Classes are told apart by their number of links and 128 bits of hash.
    """
    rows, restored = _long_rows(vectors, id_col, vector_col)
    usable = rows.where("size(v) > 0")
    several = cut(usable.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(False).alias("one")))
    flagged = usable.join(_sent(several, several.count()), "id", "left").select("id", "v", F.coalesce("one", F.lit(True)).alias("single"))
    told = _found(flagged, _Links, min_cosine, share, pivots).groupBy("id", "other").agg(F.sum("links").alias("links"), *[f(m).alias(f"{m}_{name}") for m in MARKS for name, f in (("all", F.bit_xor), ("one", F.max))])
    again = F.col("other").isNotNull()
    told = told.select("id", F.when(again, F.lit(1).cast("long")).otherwise(F.col("links")).alias("links"), *[F.when(again, F.col(f"{m}_one")).otherwise(F.col(f"{m}_all")).alias(m) for m in MARKS])
    told = told.groupBy("id").agg(F.sum("links").alias("links"), *[F.bit_xor(m).alias(m) for m in MARKS])
    told = cut(told.select("id", "links", *[F.col(m).bitwiseXOR(_mark(m)).alias(m) for m in MARKS]))
    classes = told.groupBy("links", *MARKS).agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    linked = cut(told.join(classes, ["links", *MARKS]).select("id", "class_id", "links", "size"))
    out = rows.select("id").distinct().join(linked, "id", "left").select(F.lit("member").alias("kind"), "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    # classes with links to others, by their least ids; these are joined again, alone
    outer = linked.where("id = class_id and links >= size").select("id", "size")
    n = outer.count()
    if n:
        least = usable.join(_sent(outer.select("id"), n), "id").select("id", "v", F.lit(True).alias("single"))
        pairs = _found(least, _Pairs, min_cosine, share, pivots).distinct()
        for c in ("id_a", "id_b"):
            pairs = pairs.join(_sent(outer.select(F.col("id").alias(c), F.col("size").alias(f"{c}_size")), n), c)
        out = out.union(pairs.select(F.lit("link"), "id_a", "id_b", F.col("id_a_size") * F.col("id_b_size")))
    return restored(out, ["id", "class_id"])


def _mark(name: str) -> Column:
    return F.xxhash64(F.lit(MARKS.index(name)), "id")


def _sent(keys: DataFrame, count: int) -> DataFrame:
    return F.broadcast(keys) if count * 48 <= BROADCAST_BYTES else keys


def _long_rows(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, Callable[[DataFrame, list[str]], DataFrame]]:
    rows, restored = long_ids(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "id")
    return rows.where("id is not null"), restored


def _found(rows: DataFrame, kind: type[_Pairs] | type[_Links], min_cosine: float, share: int, pivots: int | None) -> DataFrame:
    """What tasks tell of rows (id, v, single), each size of vectors by itself."""
    rows = rows.where("size(v) > 0")
    out = rows.sparkSession.createDataFrame([], kind.schema)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()
    for size, n in sorted((x["size"], x["n"]) for x in sizes):
        out = out.unionByName(_met(rows.where(F.size("v") == size), kind, size, n, min_cosine, share, pivots))
    return out


def _met(rows: DataFrame, kind: type[_Pairs] | type[_Links], size: int, n: int, min_cosine: float, share: int, pivots: int | None) -> DataFrame:
    count = pivots or max(1, round(math.sqrt(n) / 4))
    sample = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(count).toArrow()
    _, p = unit_rows(sample.column("id").combine_chunks(), sample.column("v").combine_chunks(), size)
    if not len(p):
        p = np.eye(1, size)
    cells = cut(placed(rows, size, p, radius(min_cosine)))
    up = lambda c: F.greatest(F.ceil(c / share), F.lit(1))
    shares = cells.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("own"), up(F.count("*")).alias("rights")).where("own > 0")
    split = cells.join(shares.select("cell", up(F.col("own")).alias("lefts"), "rights"), "cell")
    # a task compares a share of the cell's own vectors, on the left, with a share of all of them
    place = lambda n: F.pmod(F.xxhash64("id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ["home", "id", "vector"] if kind is _Pairs else ["home", "id", "vector", "single", *[_mark(m).alias(m) for m in MARKS]]
    left = split.where("home").select("cell", place(F.col("lefts")).alias("i"), every(F.col("rights")).alias("j"), F.lit(True).alias("left"), *columns)
    right = split.select("cell", every(F.col("lefts")).alias("i"), place(F.col("rights")).alias("j"), F.lit(False).alias("left"), *columns)
    tasks = left.union(right)

    def join(table: pa.Table) -> pa.Table:
        ids, home, left = (table.column(c).to_numpy() for c in ("id", "home", "left"))
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(ids), size)
        small, mine, others = x.astype(np.float32), np.flatnonzero(left), np.flatnonzero(~left)
        found = kind(table)
        for low in range(0, len(mine), _BLOCK):
            a = mine[low : low + _BLOCK]
            for lo in range(0, len(others), 16 * _BLOCK):
                b = others[lo : lo + 16 * _BLOCK]
                near_a, near_b = np.nonzero(small[a] @ small[b].T >= min_cosine - _SLACK)
                near_a, near_b = a[near_a], b[near_b]
                keep = (ids[near_a] != ids[near_b]) & (~home[near_b] | (ids[near_a] < ids[near_b]))
                near_a, near_b = near_a[keep], near_b[keep]
                for k in range(0, len(near_a), 1 << 16):
                    u, w = near_a[k : k + (1 << 16)], near_b[k : k + (1 << 16)]
                    sure = np.einsum("ij,ij->i", x[u], x[w]) >= min_cosine
                    found.add(u[sure], w[sure])
        return found.result()

    return tasks.groupBy("cell", "i", "j").applyInArrow(join, kind.schema)
