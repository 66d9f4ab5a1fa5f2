"""Near-duplicate vectors: a forest of random-projection trees, compared within leaves.

Vectors are compared only if their labels are equal. A tree divides vectors at the median of their
projections on a random direction, again and again until ``LEAF`` are left; those near the median go
to both sides (spill). Within a leaf all are compared by cosine in double precision, and pairs of at
least ``threshold`` are linked. A node in which a tenth of a sample of pairs are links is not divided
further: comparing it costs no more than ten times its links.

Equal vectors of a label are one node with a weight. A label with more than ``part`` nodes is first
divided by the top levels of several trees, whose medians come from a sample of ``_FIT`` vectors for
each part; all of a part's further trees grow in one task, so that vectors are not copied for every
tree. The number of trees follows from the levels and the chance that a level parts a pair at the
threshold. Linked pairs are never emitted: a pair is counted in the first leaf that holds both, and
a task returns a count for each node and links that connect what is connected in its part.

Recall is below one by method; a test measures it. Near, not equal, vectors in numbers above
``part`` under one label are divided too, so that links across parts that no tree joins are missing.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label, link with nothing, and neither do vectors of different lengths; repeated rows are
equal vectors; components are named by their smallest key (null if all are null); an empty table
gives an empty table. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmend.llm.neardup import components
from wordmend.runtime import join_by_key, salted_join, stage

THRESHOLD = 0.93
LEAF = 256
PART = 100_000

_FIT = 32  # vectors of the sample for each part
_SPILL = 0.5  # half width of the overlap, in deviations of a pair at the threshold
_OVERLAP = 0.1  # of a node to each side of the median at most
_KEPT = 0.95  # chance that a level leaves a pair at the threshold together
_MISSED = 0.01  # chance that all trees part it
_DENSE, _TRIALS = 0.1, 256
_BLOCK = 1024
_PAIRS = 1 << 18
_CELLS = 1 << 18  # memberships compared at once
_ROWS = 8192  # vectors made units at once
_NONE = np.iinfo(np.int64).max

_FOUND = "kind int, a binary, b binary, n long"
_COUNT, _LINK = 0, 1


def _units(vectors: np.ndarray) -> np.ndarray:
    rows = vectors / np.abs(vectors).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class Vectors:
    """Vectors as they are stored, whose unit rows in double precision are made when they are asked for."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.shape = vectors, vectors.shape

    def __len__(self) -> int:
        return len(self.vectors)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return _units(self.vectors[rows].astype(float))


def trees(levels: int) -> int:
    """How many trees of so many levels miss a pair at the threshold with ``_MISSED`` at most."""
    together = _KEPT**levels
    return 1 if together == 1 else math.ceil(math.log(_MISSED) / math.log(1 - together))


def margin(threshold: float, dimensions: int) -> float:
    """Half width of the overlap on a unit direction."""
    return _SPILL * math.sqrt(max(0.0, 2 - 2 * threshold) / dimensions)


def _sides(projected: np.ndarray, width: float) -> tuple[float, float]:
    """The lower side ends at the second value, the upper side begins above the first."""
    low, middle, high = np.quantile(projected, [0.5 - _OVERLAP, 0.5, 0.5 + _OVERLAP])
    return max(low, middle - width), min(high, middle + width)


def _dense(
    units: np.ndarray | Vectors, rows: np.ndarray, threshold: float, random: np.random.Generator
) -> bool:
    a, b = random.integers(0, len(rows), (2, _TRIALS))
    cosines = (units[rows[a]] * units[rows[b]]).sum(1)[a != b]
    return len(cosines) > 0 and (cosines >= threshold).mean() >= _DENSE


def _projected(units: np.ndarray | Vectors, rows: np.ndarray, direction: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i in range(0, len(rows), _ROWS):
        out[i : i + _ROWS] = units[rows[i : i + _ROWS]] @ direction
    return out


def leaves(
    units: np.ndarray | Vectors, threshold: float, random: np.random.Generator
) -> list[np.ndarray]:
    """The leaves of one random tree, as rows of ``units``."""
    width = margin(threshold, units.shape[1])
    open_nodes, done = [np.arange(len(units), dtype=np.int32)], []
    while open_nodes:
        rows = open_nodes.pop()
        if len(rows) <= LEAF or _dense(units, rows, threshold, random):
            done.append(rows)
            continue
        direction = random.standard_normal(units.shape[1])
        projected = _projected(units, rows, direction / np.linalg.norm(direction))
        low, high = _sides(projected, width)
        sides = rows[projected <= high], rows[projected > low]
        if max(map(len, sides)) == len(rows):
            done.append(rows)
        else:
            open_nodes.extend(sides)
    return done


class Lists(NamedTuple):
    """Ascending numbers of each row, one row after the other."""

    starts: np.ndarray
    numbers: np.ndarray


def _members(of: list[np.ndarray], size: int) -> Lists:
    """The numbers of the leaves that hold each row."""
    rows = np.concatenate(of)
    numbers = np.repeat(np.arange(len(of), dtype=np.int32), [len(x) for x in of])
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=size))])
    return Lists(starts, numbers[np.argsort(rows, kind="stable")])


def _listed(table: np.ndarray) -> Lists:
    """The rows of a table that is filled up with -1."""
    held = table >= 0
    return Lists(np.concatenate([[0], np.cumsum(held.sum(1))]), table[held])


def _first_common(lists: Lists, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that both rows of each pair hold, or ``_NONE``."""
    starts, numbers = lists
    if len(numbers) == len(starts) - 1 and (np.diff(starts) == 1).all():
        return np.where(numbers[a] == numbers[b], numbers[a], _NONE)
    out = np.full(len(a), _NONE)
    width = starts[b + 1] - starts[b]
    cells = (starts[a + 1] - starts[a]) * width
    ends = np.cumsum(cells)
    first = 0
    while first < len(a):
        begun = ends[first] - cells[first]
        last = max(first + 1, int(np.searchsorted(ends, begun + _CELLS, "right")))
        pair = np.repeat(np.arange(first, last), cells[first:last])
        cell = np.arange(len(pair)) + begun - (ends - cells)[pair]
        left = numbers[starts[a[pair]] + cell // width[pair]]
        same = left == numbers[starts[b[pair]] + cell % width[pair]]
        np.minimum.at(out, pair[same], left[same])
        first = last
    return out


def _pairs(
    units: np.ndarray | Vectors, rows: np.ndarray, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs within a leaf, block by block."""
    for i in range(0, len(rows), _BLOCK):
        left = units[rows[i : i + _BLOCK]]
        for j in range(i, len(rows), _BLOCK):
            a, b = np.nonzero(left @ units[rows[j : j + _BLOCK]].T >= threshold)
            if i == j:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), _PAIRS):
                yield rows[i + a[k : k + _PAIRS]], rows[j + b[k : k + _PAIRS]]


class Union:
    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.parent[a] != self.parent[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = self._root(x), self._root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while (self.parent != self.parent[self.parent]).any():
            self.parent = self.parent[self.parent]
        return self.parent


def links_of_part(
    units: np.ndarray | Vectors,
    weights: np.ndarray,
    homes: np.ndarray | Lists,
    home: int,
    threshold: float,
    seed: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the links of each row that belong to this part, and the least row it is connected to.

    ``homes`` has the parts of each row; a pair belongs to the first that holds both.
    """
    random = np.random.default_rng(seed)
    counts, union = np.zeros(len(units), np.int64), Union(len(units))
    levels = max(0, math.ceil(math.log2(max(1, len(units) / LEAF))))
    if not isinstance(homes, Lists):
        homes = _listed(homes)
    earlier: list[Lists] = []
    for _ in range(trees(levels)):
        grown = leaves(units, threshold, random)
        own = _members(grown, len(units))
        for number, rows in enumerate(grown):
            for a, b in _pairs(units, rows, threshold):
                new = _first_common(own, a, b) == number
                for lists in earlier:
                    new[new] = _first_common(lists, a[new], b[new]) == _NONE
                a, b = a[new], b[new]
                union.join(a, b)
                here = _first_common(homes, a, b) == home
                np.add.at(counts, a[here], weights[b[here]])
                np.add.at(counts, b[here], weights[a[here]])
        if len(grown) == 1:
            break
        earlier.append(own)
    return counts, union.roots()


# --- Spark -----------------------------------------------------------------------------


def _prepare(wide: bool):
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, labels = batch.column("_vector"), batch.column("_label").to_pylist()
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)
            ends = np.cumsum(sizes)
            nodes: list[bytes | None] = [None] * len(batch)
            vectors: list[bytes | None] = [None] * len(batch)
            for size in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == size)
                these = flat[(ends[rows] - size)[:, None] + np.arange(size)]
                fine = np.isfinite(these).all(1) & (these != 0).any(1)
                for row, vector in zip(rows[fine].tolist(), these[fine], strict=True):
                    if labels[row] is not None:
                        vectors[row] = vector.tobytes()
                        named = repr(labels[row]).encode() + vectors[row]
                        nodes[row] = hashlib.blake2b(named, digest_size=16).digest()
            groups = [f"{s}:{v}" if n else None for s, v, n in zip(sizes.tolist(), labels, nodes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    pa.array(nodes, pa.binary()),
                    pa.array(groups, pa.string()),
                    pa.array(vectors, pa.binary()),
                ],
                names=["_key", "node", "label", "vector"],
            )

    return run


def _stored(column: pa.Array, wide: bool) -> np.ndarray:
    """Vectors of one length."""
    kind = np.float64 if wide else np.float32
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _matrix(column: pa.Array, wide: bool) -> np.ndarray:
    """Unit rows of vectors of one length."""
    return _units(_stored(column, wide).astype(float))


def _directions(tree: int, levels: int, dimensions: int) -> np.ndarray:
    drawn = np.random.default_rng([tree, levels, dimensions]).standard_normal((levels, dimensions))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def _levels(nodes: int, part: int) -> int:
    return max(0, math.ceil(math.log2(nodes / part)))


def _fit(wide: bool, threshold: float, part: int):
    """Both sides of every node of the top trees, from the sampled vectors of a label."""

    def run(table: pa.Table) -> pa.Table:
        units = _matrix(table.column("vector").combine_chunks(), wide)
        levels = _levels(table.column("nodes")[0].as_py(), part)
        width = margin(threshold, units.shape[1])
        cuts: list[list[float]] = []
        for tree in range(trees(levels)):
            projected = units @ _directions(tree, levels, units.shape[1]).T
            bounds = np.zeros((2, 1 << levels))
            held = [np.arange(len(units))]
            for level in range(levels):
                below = []
                for nth, rows in enumerate(held):
                    values = projected[rows, level] if len(rows) else projected[:, level]
                    low, high = bounds[:, (1 << level) + nth] = _sides(values, width)
                    middle = (low + high) / 2
                    inside = projected[rows, level] <= middle
                    below += [rows[inside], rows[~inside]]
                held = below
            cuts.append(bounds.ravel().tolist())
        label = table.column("label")[0].as_py()
        return pa.table({"label": pa.array([label]), "cuts": pa.array([cuts])})

    return run


def parts(units: np.ndarray, cuts: list[list[float]], levels: int) -> list[list[int]]:
    """The parts each row belongs to, in order of the trees."""
    out: list[list[int]] = [[] for _ in units]
    for tree, flat in enumerate(cuts):
        low, high = np.array(flat).reshape(2, -1)
        projected = units @ _directions(tree, levels, units.shape[1]).T
        rows, node = np.arange(len(units)), np.ones(len(units), np.int64)
        for level in range(levels):
            values = projected[rows, level]
            down, up = values <= high[node], values > low[node]
            rows = np.concatenate([rows[down], rows[up]])
            node = np.concatenate([2 * node[down], 2 * node[up] + 1])
        for row, number in zip(rows.tolist(), (node + (tree << 40)).tolist(), strict=True):
            out[row].append(number)
    return [sorted(numbers) for numbers in out]


def _route(cuts: dict[str, list[list[float]]], wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), object)
            homes: list[list[int]] = [[0]] * len(batch)
            for label in set(labels) & set(cuts):
                rows = np.flatnonzero(labels == label)
                units = _matrix(batch.column("vector").take(pa.array(rows)), wide)
                levels = int(math.log2(len(cuts[label][0]) // 2))
                for row, home in zip(rows.tolist(), parts(units, cuts[label], levels), strict=True):
                    homes[row] = home
            yield batch.append_column("homes", pa.array(homes, pa.list_(pa.int64())))

    return run


def _compare(wide: bool, threshold: float):
    def part(held: list[pa.RecordBatch], label: str, home: int) -> Iterator[pa.RecordBatch]:
        size = sum(map(len, held))
        if size < 2:
            return
        weights = np.concatenate([batch.column("weight").to_numpy() for batch in held])
        nodes = pa.concat_arrays([batch.column("node") for batch in held])
        sizes = [pc.list_value_length(batch.column("homes")).to_numpy() for batch in held]
        homes = Lists(
            np.concatenate([[0], np.cumsum(np.concatenate(sizes))]),
            np.concatenate([batch.column("homes").flatten().to_numpy() for batch in held]),
        )
        # A batch is let go as soon as its vectors are copied.
        vectors, filled = None, 0
        while held:
            some = _stored(held.pop(0).column("vector"), wide)
            if vectors is None:
                vectors = np.empty((size, some.shape[1]), some.dtype)
            vectors[filled : filled + len(some)] = some
            filled += len(some)
        seed = int.from_bytes(hashlib.blake2b(f"{label} {home}".encode(), digest_size=8).digest(), "big")
        counts, roots = links_of_part(Vectors(vectors), weights, homes, home, threshold, seed)
        linked, joined = np.flatnonzero(counts), np.flatnonzero(roots != np.arange(len(roots)))
        none = pa.nulls(len(linked), pa.binary())
        kinds = np.repeat([_COUNT, _LINK], [len(linked), len(joined)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds),
                nodes.take(pa.array(np.concatenate([linked, joined]))),
                pa.concat_arrays([none, nodes.take(pa.array(roots[joined]))]),
                pa.array(np.concatenate([counts[linked], np.zeros(len(joined), np.int64)])),
            ],
            names=["kind", "a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple[str, int] | None = None
        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(batch.column("label").to_pylist(), batch.column("home").to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for first, last in zip(edges, edges[1:], strict=False):
                if now is not None and keys[first] != now:
                    yield from part(held, *now)
                    held = []
                now = keys[first]
                held.append(batch.slice(first, last - first))
        if held:
            yield from part(held, *now)

    return run


def _found(nodes: DataFrame, wide: bool, threshold: float, part: int) -> DataFrame:
    """Counts of links by node, and links that connect the same nodes."""
    large = nodes.groupBy("label").agg(F.count("*").alias("nodes")).where(F.col("nodes") > part)
    drawn = nodes.where(F.pmod(F.xxhash64("node"), F.lit(part)) < 2 * _FIT)
    sample = join_by_key(drawn, large, "label", "nodes", [F.col("node")])
    fitted = (
        sample.groupBy("label")
        .applyInArrow(_fit(wide, threshold, part), "label string, cuts array<array<double>>")
        .collect()
    )
    cuts = {row.label: row.cuts for row in fitted}
    kept = nodes.select("node", "label", "vector", "weight")
    homes = T.StructField("homes", T.ArrayType(T.LongType()))
    routed = kept.mapInArrow(_route(cuts, wide), T.StructType([*kept.schema, homes]))
    dealt = routed.withColumn("home", F.explode("homes"))
    sorted_parts = dealt.repartition("label", "home").sortWithinPartitions("label", "home", "node")
    return sorted_parts.mapInArrow(_compare(wide, threshold), _FOUND)


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    part: int = PART,
) -> DataFrame:
    """``key, n_links, component_id, kept``: one row for each vector.

    A task holds about ``part`` vectors of one label.
    """
    kind = vectors.schema[vector].dataType
    wide = not isinstance(kind.elementType, T.FloatType)
    element = "double" if wide else "float"
    named = vectors.select(
        F.col(key).alias("_key"),
        F.col(label).cast("string").alias("_label"),
        F.col(vector).cast(f"array<{element}>").alias("_vector"),
    )
    schema = T.StructType(
        [
            T.StructField("_key", vectors.schema[key].dataType),
            T.StructField("node", T.BinaryType()),
            T.StructField("label", T.StringType()),
            T.StructField("vector", T.BinaryType()),
        ]
    )
    rows = stage(named.mapInArrow(_prepare(wide), schema), "vectors")
    nodes = stage(
        rows.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
            F.count("*").alias("weight"),
            F.min("_key").alias("least"),
        ),
        "vector-nodes",
    )
    found = stage(_found(nodes, wide, threshold, part), "vector-links")
    counts = found.where(F.col("kind") == _COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where(F.col("kind") == _LINK).select("a", "b"))
    named_nodes = (
        nodes.drop("vector", "label")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .select(
            "node",
            "weight",
            "least",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    joined = stage(named_nodes, "vector-classes")
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    known = salted_join(joined, names, ["root"], "_n", [F.col("node")]).select(
        "node", "weight", "n_links", "component_id"
    )
    usable = salted_join(
        rows.where("node IS NOT NULL").select("node", "_key"), known, ["node"], "weight", [F.col("_key")]
    )
    alone = rows.where("node IS NULL").select(
        "_key", F.lit(0).cast("bigint").alias("n_links"), F.col("_key").alias("component_id")
    )
    out = usable.select("_key", "n_links", "component_id").unionByName(alone)
    return out.select(
        F.col("_key").alias(key),
        "n_links",
        "component_id",
        F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"),
    )
