"""Approximate nearest neighbours by cosine, with an adaptive scan of dimensions.

Vectors are scaled to length 1 and rotated by a random orthogonal matrix, so that any few of the
rotated dimensions are a random projection. They are divided into lists by the nearest of a set of
centres, which are fitted on a sample of ``SAMPLE`` vectors; every vector is in a list. A query
probes its nearest lists and scans each of them in blocks of ``COLUMNS`` dimensions. After a
block, the partial distance, scaled up to all dimensions, is tested against the k-th smallest
distance among the vectors of the sample in the probed lists: a candidate whose partial distance is
too large to be explained by chance (``CONFIDENCE``) is abandoned, and its other dimensions are not
read. The k nearest so far always stay, so a query has k results, or all other rows if these are
fewer. Survivors are ranked by the exact cosine of the original vectors in double precision.

How many lists are probed follows from the data: ``TRIALS`` vectors are searched among all rows,
and the probes are as many as ``RECALL`` of their neighbours need.

Lists and their queries meet in groups of about ``PART`` vectors and ``PART`` queries, so one
vector that very many rows share does not make a group large.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows with a null id or with another number of components than most rows have; rows
with a query's id are no candidates for it; repeated query rows are searched once; an empty table
gives an empty table. Only the named columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmend.runtime import stage

SAMPLE = 20_000
MAX_LISTS = 1024
LIST_SIZE = 800
TRIALS = 64
RECALL = 0.98
COLUMNS = 16
CONFIDENCE = 2.5
PART = 4096

_ROUNDS = 10
_RESULT = "query_id long, query_key long, vec_id long, score double"


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as double precision rows, and which rows they are."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    fine = np.isfinite(rows).all(1) & (rows != 0).any(1)
    return rows[fine], np.flatnonzero(fine)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal rows have equal results wherever they stand."""
    return (_unit(rows) * _unit(query[None, :])).sum(1)


class Index:
    """Centres and rotation, fitted on a sample."""

    def __init__(
        self, sample: np.ndarray, lists: int, seed: int = 7, ids: np.ndarray | None = None
    ) -> None:
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((size, size)))[0].astype(np.float32)
        self.sample = self.rotated(sample)
        self.centres = self.sample[rng.choice(len(sample), lists, replace=False)]
        for _ in range(_ROUNDS):
            nearest = self.order(self.sample, 1)[:, 0]
            for k in range(lists):
                mine = self.sample[nearest == k]
                if len(mine):
                    self.centres[k] = mine.mean(0)
            lengths = np.sqrt((self.centres**2).sum(1, keepdims=True))
            self.centres /= np.maximum(lengths, 1e-12)
        self.ids = np.full(len(sample), np.iinfo(np.int64).min) if ids is None else ids
        self.list = self.order(self.sample, 1)[:, 0]

    def rotated(self, rows: np.ndarray) -> np.ndarray:
        return _unit(rows).astype(np.float32) @ self.rotation

    def order(self, rotated: np.ndarray, n: int | None = None) -> np.ndarray:
        """The nearest lists of every vector, nearest first."""
        near = -(rotated @ self.centres.T)
        return near.argmin(1)[:, None] if n == 1 else np.argsort(near, 1, kind="stable")

    def radius(self, rotated: np.ndarray, names: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which every vector has ``k`` rows with other ids than its own
        in its wanted lists: the one to the ``k``-th nearest such row of the sample."""
        if len(self.sample) < k:
            return np.full(len(rotated), np.inf)
        found = np.empty(len(rotated), np.float32)
        for at in range(0, len(rotated), 256):
            some = slice(at, at + 256)
            near = rotated[some] @ self.sample.T
            near[~wanted[some][:, self.list] | (names[some, None] == self.ids[None, :])] = -np.inf
            found[some] = 2 - 2 * np.partition(near, -k, 1)[:, -k] + 1e-5
        return found


def adaptive_scan(
    vectors: np.ndarray, query: np.ndarray, radius: float, k: int
) -> np.ndarray:
    """Rows of ``vectors`` that may be among the ``k`` nearest to ``query``, all rotated; ``k`` of
    them at least, if there are so many."""
    size = vectors.shape[1]
    alive = np.arange(len(vectors))
    partial = np.zeros(len(vectors), np.float32)
    for first in range(0, size, COLUMNS):
        last = min(size, first + COLUMNS)
        gap = vectors[alive, first:last] - query[first:last]
        partial = partial + (gap * gap).sum(1)
        if last < size:
            # The test of the hypothesis that the whole distance is within the radius.
            limit = radius * last / size * (1 + CONFIDENCE / np.sqrt(last)) ** 2
            keep = partial <= limit
        else:
            keep = partial <= min(radius, np.inf if len(partial) <= k else float(np.partition(partial, k)[k]) + 1e-5)
        if np.count_nonzero(keep) < k and len(keep):
            keep = partial <= np.partition(partial, min(k, len(partial)) - 1)[min(k, len(partial)) - 1]
        alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    return alive


def _scan_group(k: int):
    def scan(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(index) and len(queries):
            ids = index.column("id").to_numpy()
            turned, _ = _matrix(index.column("rotated").combine_chunks())
            turned = np.ascontiguousarray(turned, np.float32)
            exact, _ = _matrix(index.column("vector").combine_chunks())
            theirs, _ = _matrix(queries.column("vector").combine_chunks())
            rotated, _ = _matrix(queries.column("rotated").combine_chunks())
            radius = queries.column("radius").to_numpy()
            names = queries.column("query_id").to_numpy()
            keys = queries.column("query_key").to_numpy()
            for i in range(len(queries)):
                own = ids == names[i]
                others = np.flatnonzero(~own) if own.any() else slice(None)
                near = adaptive_scan(turned[others], rotated[i].astype(np.float32), radius[i], k)
                near = near if isinstance(others, slice) else others[near]
                if not len(near):
                    continue
                score = cosines(exact[near], theirs[i])
                best = np.lexsort((ids[near], -score))[:k]
                out.extend((names[i], keys[i], ids[near[j]], score[j]) for j in best)
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
            names=["query_id", "query_key", "vec_id", "score"],
        )

    return scan


def _probes(stored: DataFrame, index: Index, trials: np.ndarray, ids: np.ndarray, k: int) -> int:
    """Lists that hold ``RECALL`` of the trials' true neighbours among all rows."""
    spark = stored.sparkSession
    sent = spark.sparkContext.broadcast((index.rotated(trials), ids))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names = sent.value
        for batch in batches:
            rows, _ = _matrix(batch.column("rotated"))
            mine, lists = batch.column("id").to_numpy(), batch.column("list").to_numpy()
            near = queries @ rows.astype(np.float32).T
            near[names[:, None] == mine[None, :]] = -np.inf
            n = min(k, len(rows))
            best = np.argpartition(-near, n - 1, 1)[:, :n] if n else np.zeros((len(queries), 0), int)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(queries)), n)),
                    pa.array(lists[best].ravel()),
                    pa.array(np.take_along_axis(near, best, 1).ravel().astype(float)),
                ],
                names=["trial", "list", "score"],
            )

    found = stored.select("id", "list", "rotated").mapInArrow(
        nearest, "trial long, list int, score double"
    )
    rank = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).toPandas()
    if best.empty:
        return 1
    place = np.argsort(index.order(index.rotated(trials)), 1)
    needed = np.sort(place[best["trial"], best["list"]]) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)])


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for the rows that fulfil
    ``queries``; equal cosines go to the smaller id."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id).isNotNull()).select(
        F.col(id).cast("bigint").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    )
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("n")).count()
    common = sizes.orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    rows = rows.where(F.size("vector") == common.n)
    total = common["count"]
    order = F.xxhash64("id", "vector")
    # About twice the sample first, so that no task sends more of it than its share.
    share = F.pmod(order, F.lit(1 << 20)) <= 2.0 * SAMPLE * (1 << 20) / total
    sampled = rows.where(share).orderBy(order).limit(SAMPLE)
    sample = sampled.select("id", "vector").toArrow().combine_chunks().to_batches()
    if not sample:
        return empty
    fit, places = _matrix(sample[0].column("vector"))
    if not len(fit):
        return empty
    lists = int(min(MAX_LISTS, len(fit), max(1, total // LIST_SIZE)))
    ids = sample[0].column("id").to_numpy()[places]
    index = Index(fit, lists, ids=ids)
    sent = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, fine = _matrix(batch.column("vector"))
            turned = sent.value.rotated(exact) if len(exact) else np.zeros((0, common.n), np.float32)
            nearest = sent.value.order(turned, 1)[:, 0]
            offsets = pa.array(np.arange(len(fine) + 1) * common.n, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(fine)),
                    batch.column("asks").take(pa.array(fine)),
                    batch.column("vector").take(pa.array(fine)),
                    pa.ListArray.from_arrays(offsets, pa.array(turned.ravel(), pa.float32())),
                    pa.array(nearest, pa.int32()),
                ],
                names=["id", "asks", "vector", "rotated", "list"],
            )

    stored = stage(
        rows.mapInArrow(
            assign, "id long, asks boolean, vector array<double>, rotated array<float>, list int"
        ),
        "vector-lists",
    )
    probes = _probes(stored, index, fit[:TRIALS], ids[:TRIALS], k)
    counts = {row.list: row["count"] for row in stored.groupBy("list").count().collect()}
    sizes_of = np.array([counts.get(i, 0) for i in range(lists)])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned, _ = _matrix(batch.column("rotated"))
            turned = turned.astype(np.float32)
            order = sent.value.order(turned)
            # At least ``probes`` lists, and more until they hold enough vectors of other rows.
            held = np.cumsum(sizes_of[order], 1) - sizes_of[order]
            own = batch.column("own").to_numpy()
            wanted = (np.arange(lists)[None, :] < probes) | (held < k + own[:, None])
            row, nth = np.nonzero(wanted)
            probed = np.zeros(wanted.shape, bool)
            probed[row, order[row, nth]] = True
            names = batch.column("id").to_numpy()
            radius = sent.value.radius(turned, names, probed, k).astype(float)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [
                    *(taken.column(c) for c in ("id", "query_key", "vector", "rotated")),
                    pa.array(radius[row]),
                    pa.array(order[row, nth], pa.int32()),
                ],
                names=["query_id", "query_key", "vector", "rotated", "radius", "list"],
            )

    # Rows with a query's id, which are no candidates for it.
    own = stored.groupBy("id").agg(F.count("*").alias("own"))
    asked = (
        stored.where("asks")
        .withColumn("query_key", F.xxhash64("id", "vector"))
        .dropDuplicates(["id", "query_key"])
        .join(own, "id")
        .select("id", "query_key", "vector", "rotated", "own")
    )
    probing = stage(
        asked.mapInArrow(
            probe,
            "query_id long, query_key long, vector array<double>, rotated array<float>, "
            "radius double, list int",
        ),
        "vector-probes",
    )
    # Both sides of a list are cut into parts; every part of one meets every part of the other.
    asking = {row.list: row["count"] for row in probing.groupBy("list").count().collect()}
    shape = [
        (i, -(-counts[i] // PART), -(-asking[i] // PART)) for i in counts if i in asking
    ]  # one row for each list, MAX_LISTS at most

    def parts() -> DataFrame:
        return F.broadcast(spark.createDataFrame(shape, "list int, _v int, _q int"))

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (
        stored.select("id", "vector", "rotated", "list")
        .join(parts(), "list")
        .withColumn("v", F.pmod(F.xxhash64("id"), F.col("_v")).cast("int"))
        .withColumn("q", every(F.col("_q")))
    )
    right = (
        probing.join(parts(), "list")
        .withColumn("q", F.pmod(F.xxhash64("query_id", "query_key"), F.col("_q")).cast("int"))
        .withColumn("v", every(F.col("_v")))
    )
    group = ["list", "v", "q"]
    found = (
        left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_scan_group(k), _RESULT)
    )
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
