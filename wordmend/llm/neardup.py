"""Near-duplicate documents: consistent weighted sampling of TF-IDF shingles, banded, verified.

A text is a weighted set of shingles (five words). The weight is ``(1 + ln tf) * ln(1 + idf)`` with
``idf = min(documents / document frequency, IDF_CAP)``. Frequencies are exact for all shingles in
more than one in ``IDF_CAP`` documents; rarer ones, which are most, weigh the same, so that the table
of frequencies does not grow with the number of documents. In a large family of copies the edits weigh
more than what its members share. Improved consistent weighted sampling draws ``BANDS * ROWS``
samples of a text; two texts agree on a sample with the probability of their weighted Jaccard
similarity. Texts that agree on all samples of a band are candidates, and candidates are linked if
their weighted Jaccard similarity, computed from the whole texts, is at least ``THRESHOLD``.

Equal texts are one node. A bucket (band and samples) is never expanded into all pairs. First, its
members are compared with the node in its middle, which links most of a family. The members of
buckets that then still hold several classes are joined exactly, by prefix filtering: shingles are
ordered by how many of these texts have them, rarest first, and two texts can only be alike if they
share a shingle in the first 0.2 of their weight (the first 0.11 of the smaller one). Texts that
have a common core but much of their own never meet, and texts of one class are not compared. So
no link between members of a bucket is lost.

Defined results: null texts are no duplicates of anything; texts without words are duplicates only
of equal texts; repeated rows are equal texts; the class of a document is the smallest key in it
(null keys last); an empty table gives an empty table. Only the named columns are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmend.llm.columns import numbered, restored
from wordmend.llm.held import forget
from wordmend.llm.words import mixed, shingles, slices, words
from wordmend.runtime import salted_join, shuffle_tasks, stage, two_sided_join

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 15, 5
IDF_CAP = 256.0
_LETTERS = 6  # bytes of a word, about
_FILTERS = 1 << 12, 1 << 22  # least and most cells of the frequency filter
_CELLS = 1 << 12  # cells that are summed together
_SAMPLES = BANDS * ROWS
_BLOCK = 1 << 15  # values worked on at a time
_TABLE = 1 << 16


# --- shingle weights -------------------------------------------------------------------


def _distinct(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(found, SHINGLE), return_counts=True)


def _cells(cells: int):
    """How many texts have shingles of each cell, in blocks of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = np.zeros(cells, np.int32)
        for batch in slices(batches):
            found = words(batch.column("text"))
            for row in range(len(batch)):
                np.add.at(counts, (_distinct(found.of(row))[0] % cells).astype(np.int64), 1)
        blocks = counts.reshape(-1, _CELLS)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array([blocks[i].tobytes() for i in used], pa.binary())],
            names=["block", "counts"],
        )

    return run


def _frequent(limit: float):
    """The cells of a block that more than ``limit`` texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(_CELLS, np.int64), 0
        for batch in batches:
            first = batch.column("block")[0].as_py() * _CELLS if len(batch) else first
            for counts in batch.column("counts"):
                total += np.frombuffer(counts.as_buffer(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(first + np.flatnonzero(total > limit))], names=["cell"])

    return run


def common_shingles(texts: DataFrame, documents: int, size: int) -> dict[int, int]:
    """Document frequency of the shingles in more than ``documents / IDF_CAP`` documents, and in
    more than one; ``size`` is the bytes of a text, on the average.

    All shingles are counted, in two passes: first by a hash into cells, several times as many as
    such shingles can be, then those of cells that reach the limit exactly. There are at most
    ``IDF_CAP`` times as many such shingles as a document has on average, at any number of documents.
    """
    limit = max(1.0, documents / IDF_CAP)
    wanted = 4 * size / _LETTERS * min(IDF_CAP, documents)
    least, most = _FILTERS
    cells = int(min(most, max(least, 2 ** np.ceil(np.log2(max(1.0, wanted))))))
    blocks = texts.mapInArrow(_cells(cells), "block long, counts binary").groupBy("block")
    frequent = blocks.applyInArrow(_frequent(limit), "cell long").toArrow()
    kept = np.zeros(cells, bool)
    kept[frequent.column("cell").to_numpy()] = True
    if not kept.any():
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = words(batch.column("text"))
            parts = [_distinct(found.of(row))[0] for row in range(len(batch))]
            parts = [part[kept[part % cells]] for part in parts] or [np.zeros(0, np.uint64)]
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), pa.array(n)], names=["shingle", "n"]
            )

    exact = texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = exact.where(F.col("n") > limit).toArrow()
    return dict(zip(found.column("shingle").to_pylist(), found.column("n").to_pylist(), strict=True))


class Weights:
    """Weights of shingles, from the documents' number and the common shingles."""

    def __init__(self, documents: int, common: dict[int, int]) -> None:
        self.rare = float(np.log1p(min(IDF_CAP, documents)))
        keys = np.array([*common], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        n = np.array([*common.values()], float)[order]
        self.values = np.log1p(np.minimum(IDF_CAP, documents / np.maximum(n, 1)))

    def of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of a text's words, ascending, with their weights."""
        values, tf = _distinct(found)
        weights = np.full(len(values), self.rare)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
            weights = np.where(self.keys[at] == values, self.values[at], weights)
        return values, weights * (1 + np.log(tf))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with ascending keys."""
    _, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][left], b[1][right]).sum()
    return float(shared / max(a[1].sum() + b[1].sum() - shared, 1e-300))


def corpus_weights(texts: DataFrame) -> Weights:
    texts = texts.select("text")
    documents, size = texts.agg(F.count("*"), F.coalesce(F.avg(F.octet_length("text")), F.lit(0.0))).first()
    return Weights(documents, common_shingles(texts, documents, size))


# --- samples ---------------------------------------------------------------------------


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of the three random variables of a sample: Gamma(2, 1) for the step, the
    logarithm of Gamma(2, 1), and uniform; 16 bits of a hash choose one each."""
    p = (np.arange(_TABLE) + 0.5) / _TABLE
    x = np.linspace(0, 40, 400_001)
    gamma = np.interp(p, 1 - (1 + x) * np.exp(-x), x)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32), p.astype(np.float32)


_quantiles: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
_SEEDS = mixed(np.arange(1, _SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def samples(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples: one 64-bit value for each of the draws."""
    if not _quantiles:
        _quantiles.append(_draws())
    step, scale, uniform = _quantiles[0]
    low = np.uint64(_TABLE - 1)
    logs = np.log(weights).astype(np.float32)
    out = np.empty(_SAMPLES, np.uint64)
    rows = max(1, _BLOCK // len(values))
    for first in range(0, _SAMPLES, rows):
        seeds = _SEEDS[first : first + rows]
        bits = values[None, :] ^ seeds[:, None]
        bits *= np.uint64(0xD6E8FEB86659FD93)
        bits ^= bits >> np.uint64(32)
        r = step[bits & low]
        beta = uniform[(bits >> np.uint64(16)) & low]
        t = logs / r
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= np.float32(1)
        beta *= r
        beta += scale[bits >> np.uint64(48)]
        best = np.argmin(beta, 1)
        steps = t[np.arange(len(seeds)), best].astype(np.int64).view(np.uint64)
        out[first : first + rows] = values[best] ^ mixed(steps)
    return out


def _signatures(weights: Weights):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        base = np.uint64(0x9E3779B97F4A7C15)
        for batch in slices(batches):
            found = words(batch.column("text"))
            nodes, bands = [], []
            for row in range(len(batch)):
                text = found.data[found.offsets[row] : found.offsets[row + 1]]
                nodes.append(hashlib.md5(text.tobytes(), usedforsecurity=False).hexdigest())
                mine = found.of(row)
                if len(mine) == 0:
                    bands.append(None)
                    continue
                drawn = samples(*weights.of(mine)).reshape(BANDS, ROWS)
                value = np.arange(BANDS, dtype=np.uint64)
                for column in drawn.T:
                    value = mixed(value * base + column)
                bands.append(value.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(nodes, pa.string()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["key", "node", "bands"],
            )

    return sign


# --- verified links --------------------------------------------------------------------


def _verify(weights: Weights):
    """Rows come ordered by pivot and part, the pivot's own text first."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot = None, None
        for batch in slices(batches):
            found = words(batch.column("text"))
            keys = list(
                zip(batch.column("pivot").to_pylist(), batch.column("part").to_pylist(), strict=True)
            )
            nodes = batch.column("node").to_pylist()
            a, b, s = [], [], []
            for row, key in enumerate(keys):
                if key != at:
                    at, pivot = key, weights.of(found.of(row))
                    if key[0] == nodes[row]:
                        continue
                    raise ValueError("the text of a pivot is missing")
                a.append(key[0])
                b.append(nodes[row])
                s.append(similarity(pivot, weights.of(found.of(row))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(s, pa.float64())],
                names=["a", "b", "similarity"],
            )

    return check


_PART = 500  # pairs of one pivot checked in a row


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """``(a, b, similarity)`` of the distinct pairs ``(pivot, node)``, from ``texts (node, text)``.

    Every pair ships one text, and a pivot's text goes along once for each part of its pairs.
    """
    part = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    counted = pairs.groupBy("pivot").agg(F.count("*").alias("_n"))
    numbered = salted_join(pairs, counted, ["pivot"], "_n", [F.col("node")]).select(
        "pivot", "node", F.ceil(F.col("_n") / _PART).cast("int").alias("_parts")
    )
    # Read by each of the next steps; otherwise the pairs would be joined again for every one.
    numbered = stage(numbered.withColumn("part", part).drop("_parts"), "numbered-pairs")
    own = numbered.select("pivot", "part").distinct().withColumn("node", F.col("pivot"))
    needed = numbered.withColumn("own", F.lit(1)).unionByName(own.withColumn("own", F.lit(0)))
    uses = needed.groupBy("node").agg(F.count("*").alias("_n"))
    with_text = salted_join(
        needed, texts.join(uses, "node"), ["node"], "_n", [F.col("pivot"), F.col("part")]
    ).select("pivot", "part", "own", "node", "text")
    tasks = shuffle_tasks(pairs.sparkSession)
    return (
        with_text.repartition(tasks, "pivot", "part")
        .sortWithinPartitions("pivot", "part", "own")
        .select("pivot", "part", "node", "text")
        .mapInArrow(_verify(weights), "a string, b string, similarity double")
    )


# --- classes ---------------------------------------------------------------------------


def _is_star(edges: DataFrame) -> bool:
    """Does every node lead to one that leads nowhere?"""
    many = edges.groupBy("a").count().where("count > 1")
    inner = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a")
    return not many.select("a").unionByName(inner.select("a")).head(1)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes of ``links (a, b)`` that are not the smallest of their
    component; the root is the smallest one.

    Alternating stars: every node links its larger neighbours, then all smaller ones, to the
    smallest it knows, until only stars are left.
    """
    edges = stage(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    while not _is_star(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(
            F.least("a", F.min("b")).alias("root"), F.count("*").alias("_n")
        )
        large = salted_join(both, lowest, ["a"], "_n", [F.col("b")]).where("b > a")
        large = stage(
            large.select(F.col("b").alias("a"), F.col("root").alias("b")).distinct(), "links"
        )
        smallest = large.groupBy("a").agg(F.min("b").alias("root"), F.count("*").alias("_n"))
        small = salted_join(large, smallest, ["a"], "_n", [F.col("b")])
        edges = stage(
            small.select(F.col("b").alias("a"), F.col("root").alias("b"))
            .where("a != b")
            .unionByName(smallest.select("a", F.col("root").alias("b")))
            .distinct(),
            "links",
        )
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` with the classes joined that ``links (a, b)`` connect."""
    ends = links
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    moved = components(ends).withColumnRenamed("root", "_to")
    sizes = roots.groupBy("root").agg(F.count("*").alias("_n")).join(
        moved.withColumnRenamed("node", "root"), "root"
    )
    kept = salted_join(roots, sizes, ["root"], "_n", [F.col("node")], "left")
    return stage(
        kept.select("node", F.coalesce("_to", "root").alias("root")).unionByName(
            moved.select("node", F.col("_to").alias("root"))
        ),
        "roots",
    )


def _linked(pairs: DataFrame, texts: DataFrame, weights: Weights, roots: DataFrame) -> DataFrame:
    """``roots`` after the pairs ``(pivot, node)`` were verified."""
    near = stage(pairs.distinct(), "pairs")
    if near.head(1):
        found = verified(near, texts, weights).where(F.col("similarity") >= THRESHOLD)
        found = stage(found, "verified").select("a", "b")
        if found.head(1):
            return _merged(roots, found)
    return roots


def _by_middle(members: DataFrame) -> DataFrame:
    """Every member of a bucket with the one in its middle, as pairs.

    The members of a family are nearer to its original than to each other, and the original
    shares its samples with most of them: the middle is the node whose buckets hold most members.
    """
    central = members.groupBy("node").agg(F.sum("size").alias("_central"))
    order = F.struct("_central", F.xxhash64("node").alias("_hash"), "node")
    middle = (
        members.join(central, "node")
        .groupBy("bucket")
        .agg(F.count("*").alias("_n"), F.max(order).alias("_top"))
    )
    paired = salted_join(members, middle, ["bucket"], "_n", [F.col("node")])
    return paired.where(F.col("node") != F.col("_top.node")).select(
        F.col("_top.node").alias("pivot"), "node"
    )


def _open_nodes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, root)`` of the members of buckets that hold several classes."""
    here = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = (
        here.groupBy("bucket")
        .agg(F.count("*").alias("_n"), (F.min("root") != F.max("root")).alias("_open"))
        .where("_open")
    )
    found = salted_join(here, several, ["bucket"], "_n", [F.col("node")])
    return found.select("node", "root").distinct()


_POSTINGS = "shingle bigint, node string, root string, weight double, total double"
_SLACK = 1e-9  # sums of weights differ by their order
# The weight before a shingle, as a share of the text's, up to which two alike texts share one.
_LARGER, _SMALLER = 1 - THRESHOLD, 1 - 2 * THRESHOLD / (1 + THRESHOLD)


def _weighed(weights: Weights):
    """The distinct shingles of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            found = words(batch.column("text"))
            sets = [weights.of(found.of(row)) for row in range(len(batch))]
            rows = np.repeat(np.arange(len(batch)), [len(v) for v, _ in sets])
            totals = np.array([w.sum() for _, w in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([v for v, _ in sets]).view(np.int64)),
                    batch.column("node").take(pa.array(rows)),
                    batch.column("root").take(pa.array(rows)),
                    pa.array(np.concatenate([w for _, w in sets])),
                    pa.array(totals[rows]),
                ],
                names=["shingle", "node", "root", "weight", "total"],
            )

    return run


def _prefixes(texts: DataFrame, weights: Weights) -> DataFrame:
    """The shingles in the first fifth of the weight of every text of ``texts (node, root, text)``.

    Shingles that no other text has come first, and are left out. ``rest`` is the weight from the
    shingle on; ``small``: it is in the first ninth.
    """
    rows = stage(texts.mapInArrow(_weighed(weights), _POSTINGS), "shingles")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    shared = salted_join(rows, counts, ["shingle"], "n", [F.col("node")])
    of_text = Window.partitionBy("node")
    so_far = of_text.orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("total") - F.sum("weight").over(of_text)
    before = own + F.coalesce(F.sum("weight").over(so_far), F.lit(0.0))
    share = F.col("_before") / F.col("total") - _SLACK
    return (
        shared.withColumn("_before", before)
        .where(share <= _LARGER)
        .select(
            "shingle",
            "node",
            "root",
            "total",
            (F.col("total") - F.col("_before")).alias("rest"),
            (share <= _SMALLER).alias("small"),
        )
    )


def _by_prefix(open_texts: DataFrame, weights: Weights) -> DataFrame:
    """Pairs of texts of different classes that may be alike.

    The class that has most texts of a shingle is the main one there; only texts of others are
    compared, with all.
    """
    postings = stage(_prefixes(open_texts, weights), "prefixes")
    classes = postings.groupBy("shingle", "root").agg(F.count("*").alias("_n"))
    several = (
        classes.groupBy("shingle")
        .agg(
            F.max_by("root", F.struct("_n", "root")).alias("_main"),
            F.sum("_n").alias("_all"),
            F.count("*").alias("_classes"),
        )
        .where("_classes > 1")
        .drop("_classes")
    )
    kept = stage(salted_join(postings, several, ["shingle"], "_all", [F.col("node")]), "candidates")
    left = kept.where("root != _main").drop("_main", "_all")
    right = kept.drop("_all").select(
        "shingle", *(F.col(c).alias(f"_{c}") for c in ("node", "root", "total", "rest", "small")), "_main"
    )
    size, other = F.col("total"), F.col("_total")
    small = F.when(size <= other, F.col("small")).otherwise(F.col("_small"))
    needed = (size + other) * (THRESHOLD / (1 + THRESHOLD))
    may_be = (
        (F.col("root") != F.col("_root"))
        & ((F.col("_root") == F.col("_main")) | (F.col("node") < F.col("_node")))
        & (small | (size == other))
        & (F.least("total", "_total") >= F.greatest("total", "_total") * (THRESHOLD - _SLACK))
        & (F.least("rest", "_rest") >= needed * (1 - _SLACK))
    )
    met = two_sided_join(left, right, "shingle", [F.col("node")], [F.col("_node")])
    return met.where(may_be).select(F.col("node").alias("pivot"), F.col("_node").alias("node"))


def near_links(members: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """``(node, root)`` as ``components`` gives it, from ``members (bucket, node, size)``."""
    roots = members.sparkSession.createDataFrame([], "node string, root string")
    roots = _linked(_by_middle(members), texts, weights, roots)
    left = stage(_open_nodes(members, roots), "open-nodes")
    if not left.head(1):
        return roots
    return _linked(_by_prefix(texts.join(left, "node"), weights), texts, weights, roots)


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, node, class_id, class_size)`` for every document; ``node`` is the MD5 of its text."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    real = rows.where(F.col("text").isNotNull())
    weights = corpus_weights(real)
    signed = stage(
        real.mapInArrow(
            _signatures(weights),
            T.StructType(
                [
                    T.StructField("key", documents.schema[key].dataType),
                    T.StructField("node", T.StringType()),
                    T.StructField("bands", T.ArrayType(T.LongType())),
                ]
            ),
        ),
        "signatures",
    )
    # One row for every different text.
    nodes = stage(
        signed.groupBy("node").agg(
            F.min("key").alias("least_key"),
            F.min(F.coalesce(F.col("key").cast("string"), F.lit(""))).alias("shown"),
            F.count("*").alias("copies"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    buckets = nodes.select("node", "shown", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stage(shared, "shared")
    members = salted_join(buckets, shared, ["bucket"], "size", [F.col("node")])
    members = stage(members, "bucket-members")
    chosen = members.select("node", "shown").distinct()
    one = Window.partitionBy("node", "shown").orderBy(F.lit(1))
    texts = (
        real.withColumn("node", F.md5(F.col("text").cast("binary")))
        .withColumn("shown", F.coalesce(F.col("key").cast("string"), F.lit("")))
        .join(chosen.hint("merge"), ["node", "shown"])  # too many to be sent to all tasks
        .withColumn("_nth", F.row_number().over(one))
        .where("_nth = 1")
        .select("node", "text")
    )
    texts = stage(texts, "candidate-texts")
    roots = near_links(members.drop("shown"), texts, weights)

    placed = stage(
        nodes.drop("bands")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node")),
        "placed",
    )
    classes = placed.groupBy("root").agg(
        F.min("least_key").alias("class_id"),
        F.sum("copies").alias("class_size"),
        F.count("*").alias("_n"),
    )
    of_node = salted_join(placed, classes, ["root"], "_n", [F.col("node")]).select(
        "node", "class_id", "class_size", "copies"
    )
    of_node = stage(of_node, "classes")
    found = salted_join(
        signed.select("key", "node"), of_node, ["node"], "copies", [F.col("key").cast("string")]
    )
    alone = rows.where(F.col("text").isNull()).select(
        "key",
        F.lit(None).cast("string").alias("node"),
        F.col("key").alias("class_id"),
        F.lit(1).cast("bigint").alias("class_size"),
    )
    return (
        found.select("key", "node", "class_id", "class_size")
        .unionByName(alone)
        .withColumnRenamed("key", key)
    )


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: of every class, the one that gives it its id."""
    shown = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found = near_duplicates(documents, key, text)
    kept = found.where(F.col(key).eqNullSafe(F.col("class_id")) & F.col("node").isNotNull())
    kept = kept.select(shown.alias("_shown"), F.col("node").alias("_node")).distinct()
    # The smallest key may belong to several texts of a class, or to repeated rows.
    one = Window.partitionBy("_shown", "_node").orderBy(F.lit(1))
    plain, names = numbered(documents)
    named = plain.withColumns(
        {
            "_shown": F.coalesce(F.col(names[key]).cast("string"), F.lit("")),
            "_node": F.md5(F.col(names[text]).cast("binary")),
        }
    )
    return (
        named.join(kept, ["_shown", "_node"])
        .withColumn("_nth", F.row_number().over(one))
        .where("_nth = 1")
        .select(*restored(names))
        .unionByName(documents.where(F.col(text).isNull()))
    )
