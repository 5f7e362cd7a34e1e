"""Near-duplicate vectors: exact cosine links, looked for in cones around pivots, tile by tile."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from hashlib import blake2b
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemill.llm.common import components, forest, tidy
from tidemill.plans.session import cut_lineage, drop_stored

# Vectors in a tile, and their bytes, at most; two tiles meet at a time. Where these make fewer tiles than a few per core, tiles are smaller.
TILE = 16384
TILE_BYTES = 8 << 20
LEAST_TILE = 1024
# Vectors per pivot, about; pivots of a dimension and their bytes, at most, since all tasks get them.
MEMBERS = 256
PIVOTS = 16384
PIVOT_BYTES = 32 << 20
# Neighbours of a pivot that are compared at a time, and how many others with them.
BLOCK = 64
OTHERS = 512
# Pivots whose distances to a tile are held at a time.
CELLS = 256
# Groups of tasks whose sums of products reach the driver.
GROUPS = 32
# Numbers of leading components that may be multiplied to test a bound, and those by which tiles are told apart.
STEPS = (7, 15, 23, 31, 47, 63)
SIDES = 4
# Room for rounding in single precision, of products and angles; what it lets through is recomputed in double precision.
SLACK = 1e-4
TURN = 1e-2
# Double precision products of whole blocks are recomputed pair by pair this close to the threshold.
EDGE = 1e-9
# Partitions of stored tiles have so many bytes at most, about, and as many pairs as make some tasks per core: each pair reads its two again.
READ_BYTES = 64 << 20
TASKS = 8
# Links of two tiles, and linked vectors of a task, that are held before they are summed up.
HELD = 500_000


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values, dimension and a key of the exact values; none for unusable vectors."""
    for batch in batches:
        lists = batch.column("vector")
        dims = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(dims) - dims
        keys, kept = [None] * len(dims), [None] * len(dims)
        for d in np.unique(dims[dims > 0]):
            at = np.flatnonzero(dims == d)
            x = values[starts[at][:, None] + np.arange(d)].astype(np.float64)
            good = np.isfinite(x).all(1) & x.any(1)
            at, x = at[good], x[good]
            with np.errstate(over="ignore", under="ignore"):
                size = np.sqrt(_dots(x, x))
            # also vectors whose squares overflow or vanish have a direction
            odd = ~((size > 1e-140) & (size < 1e140))
            x[odd] /= np.abs(x[odd]).max(1, keepdims=True)
            for k, row, stored in zip(at, x + 0.0, x.astype(values.dtype)):
                keys[k], kept[k] = blake2b(row.tobytes(), digest_size=16).digest(), stored.tobytes()
        cols = [batch.column("id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "dim", "x"])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _units(data: bytes | pa.Buffer, d: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(data, kind).reshape(-1, d).astype(np.float64)
    return x / np.sqrt(_dots(x, x))[:, None]


def _by_dim(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each dimension: the rows that have it, and their unit vectors."""
    dims, x = batch.column("dim").to_numpy(), batch.column("x").to_pylist()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, _units(b"".join(x[k] for k in at), d, kind)


def _moments(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of vectors and sum of x x' over a partition, by dimension; partitions are dealt into groups."""
        group = TaskContext.get().partitionId() % GROUPS
        sums: dict[int, list] = {}
        for batch in batches:
            for d, at, x in _by_dim(batch, kind):
                n, m = sums.get(d, (0, 0))
                sums[d] = [n + len(at), m + x.T @ x]
        for d, (n, m) in sums.items():
            yield _moment_row(d, group, n, m)

    return run


def _moment_row(d: int, part: int, n: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([m.tobytes()], pa.binary())], names=["dim", "part", "n", "sum"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum per dimension and group."""
    sums: dict[tuple, tuple] = {}
    for batch in batches:
        for d, part, n, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "part", "n", "sum"))):
            k, m = sums.get((d, part), (0, 0))
            sums[d, part] = (k + n, m + np.frombuffer(data))
    for (d, part), (n, m) in sums.items():
        yield _moment_row(d, part, n, m)


def _chosen(rates: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose keys, which are as good as random, lie below the dimension's rate."""
        for batch in (b for b in batches if b.num_rows):
            keys = np.frombuffer(b"".join(k[:8] for k in batch.column("key").to_pylist()), np.uint64)
            least = np.array([rates[d] for d in batch.column("dim").to_pylist()])
            yield batch.filter(pa.array(keys / 2.0**64 < least)).select(["dim", "x"])

    return run


class Model(NamedTuple):
    """What tasks know of a dimension: its number of vectors, leading principal directions and unit pivots, neighbours next to each other."""

    size: int
    basis: np.ndarray
    pivots: np.ndarray


def models(classes: DataFrame, kind: str, least: float) -> dict[int, Model]:
    """For each dimension, principal directions and pivots (about one vector in ``MEMBERS``; any would do, they only affect speed).

    Tasks add up their own vectors, then groups of tasks; the driver gets one sum per group, ``GROUPS`` at most.
    """
    sums: dict[int, tuple] = {}
    schema = "dim int, part int, n long, sum binary"
    for row in classes.select("dim", "x").mapInArrow(_moments(kind), schema).repartition("dim", "part").mapInArrow(_add_up, schema).collect():
        d = row["dim"]
        n, m = sums.get(d, (0, 0))
        sums[d] = (n + row["n"], m + np.frombuffer(row["sum"], np.float64).reshape(d, d))
    rates = {d: min(n / MEMBERS, PIVOTS, max(1, PIVOT_BYTES // (4 * d))) / n for d, (n, _) in sums.items()}
    drawn: dict[int, list] = {d: [] for d in sums}
    for row in classes.select("key", "dim", "x").mapInArrow(_chosen(rates), "dim int, x binary").collect():
        drawn[row["dim"]].append(row["x"])
    out = {}
    for d, (n, m) in sums.items():
        values, basis = (x[..., ::-1] for x in np.linalg.eigh(m / n))
        lead = basis[:, : depth(values, least)].copy()
        pivots = _units(b"".join(sorted(drawn[d])), d, kind) if drawn[d] else basis[:, :1].T
        out[d] = Model(n, lead, pivots[side_by_side(pivots @ lead)].astype(np.float32))
    return out


def depth(values: np.ndarray, least: float) -> int:
    """How many leading components to multiply, given the squares' means: few pairs should pass that don't link."""
    lead, spread = np.cumsum(values), np.sqrt(np.cumsum(values**2))
    for k in STEPS:
        if k >= len(values):
            break
        if lead[k - 1] - (1 - least) >= 4 * spread[k - 1] or 1 - lead[k - 1] <= (1 - least) / 2:
            return k
    return min(len(values), STEPS[-1])


def side_by_side(points: np.ndarray) -> np.ndarray:
    """An order of points in which neighbours follow each other: halved again and again along the widest coordinate."""
    if len(points) < 3:
        return np.arange(len(points))
    order = np.argsort(points[:, np.argmax(np.ptp(points, axis=0))], kind="stable")
    halves = np.array_split(order, 2)
    return np.concatenate([half[side_by_side(points[half])] for half in halves])


def _assign(sent, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add each vector's nearest pivot and the angle to it."""
        for batch in batches:
            cell, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.float32)
            for d, at, x in _by_dim(batch, kind):
                flat, pivots = x.astype(np.float32), sent.value[d].pivots
                for s in range(0, len(at), OTHERS):
                    cosines = flat[s : s + OTHERS] @ pivots.T
                    best = cosines.argmax(1)
                    cell[at[s : s + OTHERS]] = best
                    angle[at[s : s + OTHERS]] = np.arccos(np.clip(cosines[np.arange(len(best)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "dim", "x")), pa.array(cell), pa.array(angle)], names=["node", "n", "dim", "x", "cell", "angle"])

    return run


PACKED = "dim int, tile long, node binary, n binary, cell binary, angle binary, x binary, " + ", ".join(f"{n}{k} double" for k in range(SIDES) for n in ("lo", "hi"))


def _pack(sent, kind: str, size: dict[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's vectors in tiles of about equal size, one row each: dealt by pivot, sorted by angle; also their box in ``SIDES`` leading components."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        dim, node, n, cell, angle = (rows.column(c).to_numpy() for c in ("dim", "node", "n", "cell", "angle"))
        x = rows.column("x").to_pylist()
        for d in np.unique(dim).tolist():
            at = np.flatnonzero(dim == d)
            at = at[np.lexsort((node[at], angle[at], cell[at]))]
            for some in np.array_split(at, -(-len(at) // size[d])):
                some = some[np.lexsort((node[some], angle[some]))]
                data = b"".join(x[k] for k in some)
                lead = _units(data, d, kind) @ sent.value[d].basis[:, :SIDES]
                box = [v for k in range(SIDES) for v in ((lead[:, k].min(), lead[:, k].max()) if k < lead.shape[1] else (0.0, 0.0))]
                cols = [d, int(node[some].min()), *(v[some].tobytes() for v in (node, n, cell, angle)), data, *map(float, box)]
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, cols))], schema=LAYOUT)

    return run


LAYOUT = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[c.split()[1]]) for c in PACKED.split(", ")])
NAMES = LAYOUT.names


def meetings(packed: DataFrame, least: float, parts: int) -> DataFrame:
    """Pairs of tiles, each pair once, whose boxes are near enough for a link.

    Unit vectors with a cosine of at least ``least`` lie within sqrt(2 - 2 least), also in any components. Nothing is
    shuffled: tasks read the stored tiles of a pair of partitions (``parts`` at most), so the pairs take no disk.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    left, right = (packed.coalesce(parts).toDF(*[f"{side}_{c}" for c in NAMES]) for side in "ab")
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"))
    near = reduce(add, [gap(k) * gap(k) for k in range(SIDES)]) <= reach * reach
    pairs = left.join(right.hint("shuffle_replicate_nl"), (F.col("a_dim") == F.col("b_dim")) & (F.col("a_tile") <= F.col("b_tile")) & near)
    return pairs.select(*[f"{side}_{c}" for side in "ab" for c in NAMES[:7]])


class Side:
    """Unit vectors, and in single precision with their leading components and the norm of the others."""

    def __init__(self, unit: np.ndarray, basis: np.ndarray | None = None):
        lead = unit[:, : STEPS[0]] if basis is None else unit @ basis
        self.unit, self.flat = unit, unit.astype(np.float32)
        self.lead = np.column_stack([lead, np.sqrt(np.maximum(0, 1 - _dots(lead, lead)))]).astype(np.float32)


class Tile(Side):
    def __init__(self, batch: pa.RecordBatch, row: int, side: str, sent: dict[int, Model], kind: str):
        data = lambda c, t: np.frombuffer(batch.column(f"{side}_{c}")[row].as_buffer(), t)
        self.name = batch.column(f"{side}_tile")[row].as_py()
        self.dim = batch.column(f"{side}_dim")[row].as_py()
        self.node, self.n, self.cell, self.angle = data("node", np.int64), data("n", np.int64), data("cell", np.int32), data("angle", np.float32)
        super().__init__(_units(batch.column(f"{side}_x")[row].as_buffer(), self.dim, kind), sent[self.dim].basis)


def cones(a: Tile, b: Tile, pivots: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of vectors of ``a`` with a common pivot, and the vectors of ``b`` that may link to one at a smaller or equal angle.

    A vector that links to one at the angle t from a pivot is itself at most t and the angle of ``least`` away from it.
    Both are sorted by angle.
    """
    turn = np.arccos(np.clip(least, -1, 1)) + TURN
    order = np.argsort(a.cell, kind="stable")
    cells, starts = np.unique(a.cell[order], return_index=True)
    members = np.split(order, starts[1:])
    for k in range(0, len(cells), CELLS):
        cosines = pivots[cells[k : k + CELLS]] @ b.flat.T
        for row, own in zip(cosines, members[k : k + CELLS]):
            least_cosine = lambda k: np.cos(min(np.pi, a.angle[k] + turn))
            wide = np.flatnonzero(row >= least_cosine(own[-1]))
            near, angle = row[wide], b.angle[wide]
            for block in np.split(own, range(BLOCK, len(own), BLOCK)):
                low = np.searchsorted(angle, a.angle[block[0]])
                at = wide[low:][near[low:] >= least_cosine(block[-1])]
                if len(at):
                    yield block, at


def compare(a: Side | np.ndarray, b: Side | np.ndarray, least: float, blocks: Iterable[tuple] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of unit rows with a dot product of at least ``least`` in double precision, block by block.

    ``blocks`` are up to ``BLOCK`` rows of ``a`` each, with the rows of ``b`` that they are compared with, else all. The leading components
    are multiplied first; what the others can add is at most the product of their norms. The same sum decides on a pair in any block.
    """
    a, b = (x if isinstance(x, Side) else Side(x) for x in (a, b))
    if blocks is None:
        blocks = ((np.arange(s, min(len(a.unit), s + BLOCK)), np.arange(len(b.unit))) for s in range(0, len(a.unit), BLOCK))
    bound = np.float32(least - SLACK - a.unit.shape[1] * float(np.finfo(np.float32).eps))
    room = np.empty(OTHERS * BLOCK, np.float32)
    for rows, at in blocks:
        lead = np.ascontiguousarray(a.lead[rows].T)
        for t in range(0, len(at), OTHERS):
            some = at[t : t + OTHERS]
            part = np.matmul(b.lead[some], lead, out=room[: len(some) * len(rows)].reshape(len(some), -1))
            if part.max() < bound:
                continue
            j, i = np.nonzero(part >= bound)
            if len(i) > part.size // 64:
                whole = b.unit[some] @ a.unit[rows].T  # cheaper than picking so many
                links = whole >= least
                j, i = np.nonzero(np.abs(whole - least) <= EDGE)
                links[j, i] = _dots(a.unit[rows[i]], b.unit[some[j]]) >= least
                j, i = np.nonzero(links)
            else:
                keep = _dots(a.unit[rows[i]], b.unit[some[j]]) >= least
                i, j = i[keep], j[keep]
            if len(i):
                yield rows[i], some[j]


class Links:
    """Links between the rows of two tiles, or of one with itself: how many rows each row links to, and the first one it reaches."""

    def __init__(self, a: Tile, b: Tile):
        self.node, self.n = (a.node, a.n) if a is b else (np.concatenate([a.node, b.node]), np.concatenate([a.n, b.n]))
        self.links, self.label = np.zeros(len(self.node), np.int64), np.arange(len(self.node))
        self.held, self.count = [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i, j))
        self.count += len(i)
        if self.count > HELD:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        i, j = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.count = [], 0
        for x, y in ((i, j), (j, i)):
            self.links += np.bincount(x, weights=self.n[y], minlength=len(self.node)).astype(np.int64)
        new = self.label[i] != self.label[j]
        if new.any():
            self.label = forest(np.concatenate([i[new], np.arange(len(self.node))]), np.concatenate([j[new], self.label]), len(self.node))

    def rows(self) -> tuple[np.ndarray, ...]:
        self.settle()
        at = np.flatnonzero(self.links)
        return self.node[at], self.links[at], self.node[self.label[at]]


def _sum_up(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Rows (node, links, reach) of several pairs of tiles as one for each node."""
    node, links, reach = (np.concatenate(x) for x in zip(*rows))
    nodes, at = np.unique(np.concatenate([node, reach]), return_inverse=True)
    own, root = np.split(at, 2)
    return nodes, np.bincount(own, weights=links, minlength=len(nodes)).astype(np.int64), nodes[forest(own, root, len(nodes))]


def _links(sent, kind: str, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For all pairs of tiles of a task together: how many vectors each one links to, and one that it reaches there, the same for all that it reaches."""
        rows, count, a = [], 0, None
        for batch in batches:
            for row in range(batch.num_rows):
                if a is None or a.name != batch.column("a_tile")[row].as_py():
                    a = Tile(batch, row, "a", sent.value, kind)
                same = a.name == batch.column("b_tile")[row].as_py()
                b = a if same else Tile(batch, row, "b", sent.value, kind)
                found = Links(a, b)
                for x, y, turned in [(a, b, False)] if same else [(a, b, False), (b, a, True)]:
                    for i, j in compare(x, y, least, cones(x, y, sent.value[x.dim].pivots, least)):
                        # a link is seen from the end at the smaller angle, for equal angles from the smaller node
                        once = (x.angle[i] < y.angle[j]) | ((x.angle[i] == y.angle[j]) & (x.node[i] < y.node[j]))
                        i, j = i[once], j[once]
                        found.add(i + len(a.node) * turned, j + len(a.node) * (not same and not turned))
                rows.append(found.rows())
                count += len(rows[-1][0])
                if count > HELD:
                    rows, count = [_sum_up(rows)], 0
        for s in range(0, len((state := _sum_up(rows))[0]) if rows else 0, 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 65536]) for x in state], names=["node", "links", "reach"])

    return run


def link_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per row of ``vectors``: (key, n_links, component_id, kept).

    Two rows link if their vectors have the same length and a cosine of at least ``least`` in double
    precision. Vectors that are null, empty, zero, or have null or non-finite components link with nothing.
    Equal vectors are compared once and count as often as they occur. ``component_id`` is the smallest key
    reachable by links, itself included (null keys come last); ``kept`` says whether that is the row's own
    key. Repeated keys are rows of their own. Other columns are dropped. An empty table gives no rows.

    Vectors are written as they are and moved twice; a stored copy goes as soon as the next one is written.
    """
    spark = vectors.sparkSession
    cores = spark.sparkContext.defaultParallelism
    kind = vectors.schema[vector].dataType
    kind = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    code = {"float": "<f4", "double": "<f8"}[kind]
    stored = cut_lineage(
        vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("vector")).mapInArrow(
            tidy(_points), f"id {vectors.schema[key].dataType.simpleString()}, key binary, dim int, x binary"
        )
    )
    points = cut_lineage(stored.select("id", "key"))
    groups = stored.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.first("dim").alias("dim"), F.first("x").alias("x"))
    whole = cut_lineage(groups.withColumn("node", F.monotonically_increasing_id()))
    drop_stored(stored)
    classes = cut_lineage(whole.select("key", "node", "n", "low"))
    known = models(whole, code, least)
    sent = spark.sparkContext.broadcast(known)
    near = cut_lineage(whole.select("node", "n", "dim", "x").mapInArrow(tidy(_assign(sent, code)), "node long, n long, dim int, x binary, cell int, angle float"))
    drop_stored(whole)
    width = {d: d * int(code[-1]) for d in known}
    size = {d: max(1, min(TILE, TILE_BYTES // width[d], max(LEAST_TILE, -(-m.size // (4 * cores))))) for d, m in known.items()}
    heaps = sum(-(-m.size // (4 * size[d])) for d, m in known.items())
    packed = cut_lineage(near.repartitionByRange(max(1, heaps), "dim", "cell", "angle", "node").mapInArrow(tidy(_pack(sent, code, size)), PACKED))
    drop_stored(near)
    parts = max(int(np.ceil(np.sqrt(TASKS * cores))), sum(m.size * width[d] for d, m in known.items()) // READ_BYTES)
    found = cut_lineage(meetings(packed, least, parts).mapInArrow(tidy(_links(sent, code, least)), "node long, links long, reach long"))
    drop_stored(packed)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("reach").alias("b")))
    member = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = member.groupBy("root").agg(F.min("low").alias("component"))
    info = member.join(lows, "root").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    component = F.coalesce("component", "id")
    return points.join(info, "key", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
