"""Prefix trie of conversations, with totals of its subtrees by time-forward processing.

A node is a distinct sequence of first turns (role and text); conversations that begin with it are
its members. A prefix is known by 128 bits: the exclusive or of hashes of its turns, each taken with
its place, so that long conversations are hashed in blocks.

Totals go from children to parents. The nodes of a shard are sorted by reverse level order
(Spark's sort spills), and a node sends its total ahead to its parent through a priority queue in
that order, which writes sorted runs to a scratch file when it is full. Shards hold whole subtrees: a
node is *heavy* if its members have more than ``limit`` turns from there on; the light children of
heavy nodes are the shard roots, and shards are dealt by them. Their totals, summed by heavy
parent, then go the same way through the heavy nodes above, of which each level has fewer than
``turns / limit``.

Conversations of any length are placed by ranges of (key, turn) and hashed by blocks, so that no task
needs a whole one. The list of the members that end in a node is hashed as a stream of sorted pieces.

Defined results: null roles and texts are empty; ties in a turn are in the order of a digest of
role and text; repeated rows are turns of their own; rows without a key belong to no
conversation; a key without turns is a member of the root alone; without any key there is no node.
Other columns are not used.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmend.llm.mixing import text_size
from wordmend.runtime import is_small, salted_join, stage

LIMIT = 100_000
SHARDS = 4096  # with more turns than that many times LIMIT, the limit grows
QUEUE = 500_000  # messages held in memory

_BLOCK = 1024  # turns hashed by one task
_PIECE = 256  # keys in a piece of a list of members
_NODE, _MESSAGE = 0, 1


# --- sequences -------------------------------------------------------------------------


def digest(role: Column, text: Column) -> Column:
    """What tells turns apart."""
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def ordered(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``key, place, digest, words``: the turns of each conversation, placed from 0.

    Turns are ranged by key and turn. At most one conversation of each range goes on from ranges
    before it, and the number of its turns there is added.
    """
    role_text = [F.coalesce(F.col(name), F.lit("")) for name in (role, text)]
    read = stage(
        turns.where(F.col(key).isNotNull()).select(
            F.col(key).alias("key"),
            F.col(turn).alias("turn"),
            digest(*role_text).alias("digest"),
            text_size(role_text[1]).alias("words"),
        ),
        "turns",
    )
    by = ["key", F.asc_nulls_first("turn"), "digest"]
    ranged = stage(
        read.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "turn-ranges"
    )
    earlier = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.groupBy("key", "_part")
        .agg(F.count("*").alias("_n"))
        .select("key", "_part", F.sum("_n").over(earlier).alias("_before"))
        .where("_before IS NOT NULL")
    )
    inside = Window.partitionBy("key", "_part").orderBy(*by[1:])
    return (
        ranged.join(F.broadcast(carried), ["key", "_part"], "left")
        .withColumn("place", F.row_number().over(inside) - 1 + F.coalesce("_before", F.lit(0)))
        .select("key", F.col("place").cast("bigint").alias("place"), "digest", "words")
    )


def _prefixes(steps: DataFrame) -> DataFrame:
    """``key, depth, x1, x2, p1, p2, words``: the prefix that ends with each turn and the one before."""
    own = [F.xxhash64("place", "digest"), F.xxhash64("digest", "place", F.lit(1))]
    blocks = steps.select(
        "key",
        "place",
        "words",
        F.floor(F.col("place") / _BLOCK).alias("_block"),
        own[0].alias("h1"),
        own[1].alias("h2"),
    )
    group = ["key", "_block"]
    before = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.groupBy(*group)
        .agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
        .select(*group, *(F.bit_xor(h).over(before).alias(f"_{h}") for h in ("h1", "h2")))
    )
    so_far = Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    x = {
        f"x{i}": F.bit_xor(f"h{i}").over(so_far).bitwiseXOR(F.coalesce(f"_h{i}", F.lit(0)))
        for i in (1, 2)
    }
    return (
        blocks.join(carried, group)
        .withColumns(x)
        .select(
            "key",
            (F.col("place") + 1).alias("depth"),
            "x1",
            "x2",
            F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"),
            F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"),
            "words",
        )
    )


# --- time-forward processing -----------------------------------------------------------


class SpillingQueue:
    """A priority queue that holds at most ``size`` messages in memory; the rest are in sorted runs
    of a scratch file, which goes when it is closed or its process ends."""

    def __init__(self, size: int = QUEUE) -> None:
        self.size, self.heap = size, []
        self.file, self.runs, self.spilled = None, [], 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.size:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        places = []
        rows = sorted(self.heap)
        for i in range(0, len(rows), 1 << 12):
            places.append(self.file.tell())
            pickle.dump(rows[i : i + (1 << 12)], self.file)
        self.heap = []
        run = self._read(places)
        self.spilled += 1
        heapq.heappush(self.runs, (next(run), self.spilled, run))

    def _read(self, places: list[int]) -> Iterator[tuple]:
        for place in places:
            self.file.seek(place)
            yield from pickle.load(self.file)

    def first(self) -> tuple | None:
        """The least message, which stays."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        message, number, run = self.runs[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, number, run))
        return message

    def close(self) -> None:
        if self.file:
            self.file.close()


_SENT = ("kind", "depth", "x1", "x2", "leaves", "saved")
_SENT_SCHEMA = "kind int, depth bigint, x1 bigint, x2 bigint, leaves bigint, saved bigint"


def totals(rows: Iterator[tuple], size: int = QUEUE) -> Iterator[tuple]:
    """Totals of nodes in reverse level order, and messages to parents that are not among them.

    A row is ``kind, depth, x1, x2, p1, p2, leaves, saved, root``; messages come before their node.
    """
    queue = SpillingQueue(size)
    try:
        for kind, depth, x1, x2, p1, p2, leaves, saved, root in rows:
            if kind == _MESSAGE:
                queue.push((-depth, x1, x2, leaves, saved))
                continue
            while (first := queue.first()) is not None and first[:3] == (-depth, x1, x2):
                _, _, _, more_leaves, more_saved = queue.pop()
                leaves, saved = leaves + more_leaves, saved + more_saved
            yield _NODE, depth, x1, x2, leaves, saved
            if root:
                yield _MESSAGE, depth - 1, p1, p2, leaves, saved
            elif depth:
                queue.push((1 - depth, p1, p2, leaves, saved))
    finally:
        queue.close()


def _forward(size: int):
    kinds = [pa.int32(), *[pa.int64()] * 5]
    read = ("kind", "depth", "x1", "x2", "p1", "p2", "leaves", "saved", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for row in zip(*(batch.column(name).to_pylist() for name in read), strict=True)
        )
        out = []
        for row in totals(rows, size):
            out.append(row)
            if len(out) == 1 << 14:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=list(_SENT))

    return run


def _sums(nodes: DataFrame, rows: DataFrame, limit: int, size: int) -> DataFrame:
    """``x1, x2, n_leaves, saved_tokens`` of every node."""
    heavy = (F.col("weight") > limit) | (F.col("depth") == 0)
    tops = nodes.where(heavy)
    marked = _marked(rows, tops)
    roots = (
        marked.where("_n IS NULL")
        .groupBy("key")
        .agg(F.min_by(F.struct("x1", "x2"), "depth").alias("_root"))
        .withColumnRenamed("key", "conv_id")
    )
    message = {
        "kind": F.lit(_NODE),
        "leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"),
        "saved": (F.col("n_convs") - 1) * F.col("words"),
    }
    columns = ["kind", "depth", "x1", "x2", "p1", "p2", "leaves", "saved", "root"]
    order = [F.desc("depth"), "x1", "x2", F.desc("kind")]
    light = (
        nodes.where(~heavy)
        .join(roots, "conv_id")
        .withColumns(message | {"root": F.struct("x1", "x2") == F.col("_root")})
        .select(*columns, F.col("_root.x1").alias("_r1"), F.col("_root.x2").alias("_r2"))
    )
    sharded = light.repartition("_r1", "_r2").select(*columns).sortWithinPartitions(*order)
    low = stage(sharded.mapInArrow(_forward(size), _SENT_SCHEMA), "trie-shards")
    sent = (
        low.where(F.col("kind") == _MESSAGE)
        .groupBy("kind", "depth", "x1", "x2")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        .withColumns({"p1": F.lit(0), "p2": F.lit(0), "root": F.lit(False)})
    )
    above = tops.withColumns(message | {"root": F.lit(False)}).select(*columns)
    joined = above.unionByName(sent.select(*columns)).repartition(1).sortWithinPartitions(*order)
    high = joined.mapInArrow(_forward(size), _SENT_SCHEMA)
    return (
        low.where(F.col("kind") == _NODE)
        .unionByName(high)
        .select("x1", "x2", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    )


def _marked(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows with the number ``_n`` of members of the heavy node they belong to, else null."""
    tops = tops.select("x1", "x2", F.col("n_convs").alias("_n"))
    if is_small(tops):
        return rows.join(F.broadcast(tops), ["x1", "x2"], "left")
    return salted_join(rows, tops, ["x1", "x2"], "_n", [F.col("key")], "left")


# --- nodes -----------------------------------------------------------------------------


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None

    def done(node: tuple, found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node[0]]), pa.array([node[1]]), pa.array([found.hexdigest()])],
            names=["x1", "x2", "ends_sha256"],
        )

    for batch in batches:
        names = ("x1", "x2", "_piece")
        for x1, x2, piece in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if (x1, x2) != now:
                if now is not None:
                    yield done(now, state)
                now, state = (x1, x2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
    if now is not None:
        yield done(now, state)


def _ends(last: DataFrame) -> DataFrame:
    """Hash of the keys that end in each node, ascending."""
    pieces = (
        last.groupBy("x1", "x2", F.floor(F.col("key") / _PIECE).alias("_nth"))
        .agg(F.array_sort(F.collect_list("key")).alias("_keys"))
        .withColumn("_piece", F.array_join(F.transform("_keys", lambda k: k.cast("string")), ","))
    )
    single = pieces.groupBy("x1", "x2").agg(F.count("*").alias("_n"), F.first("_piece").alias("_piece"))
    alone = single.where("_n = 1").select("x1", "x2", F.sha2("_piece", 256).alias("ends_sha256"))
    many = pieces.join(single.where("_n > 1").select("x1", "x2"), ["x1", "x2"])
    streamed = many.select("x1", "x2", "_nth", "_piece").repartition("x1", "x2")
    return alone.unionByName(
        streamed.sortWithinPartitions("x1", "x2", "_nth").mapInArrow(
            _hash_pieces, "x1 bigint, x2 bigint, ends_sha256 string"
        )
    )


def trie(
    steps: DataFrame, keys: DataFrame, limit: int | None = None, queue: int = QUEUE
) -> DataFrame:
    """The nodes of sequences ``steps`` (key, place from 0, digest, words); ``keys`` has every key once.

    One row for each node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    lengths = steps.groupBy("key").agg(F.count("*").alias("_length"))
    counted = keys.select("key").join(lengths, "key", "left")
    none = [F.lit(0).cast("bigint").alias(name) for name in ("depth", "x1", "x2", "p1", "p2", "words")]
    length = F.coalesce("_length", F.lit(0)).alias("_length")
    rows = stage(
        _prefixes(steps)
        .withColumn("words", F.col("words").cast("bigint"))
        .join(lengths, "key")
        .unionByName(counted.select("key", *none, length)),
        "trie-rows",
    )
    bare = (
        rows.groupBy("x1", "x2", "depth")
        .agg(
            F.min("key").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.first("words").alias("words"),
            F.first("p1").alias("p1"),
            F.first("p2").alias("p2"),
            F.sum(F.col("_length") - F.col("depth") + 1).alias("weight"),
        )
    )
    nodes = stage(bare, "trie-nodes")
    below = nodes.where("depth > 0")
    children = below.groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    named = children.select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), "n_children")
    whole = stage(
        nodes.join(named, ["x1", "x2"], "left").fillna(0, ["n_children"]), "trie-children"
    )
    parents = whole.where("n_children > 0").select(
        F.col("x1").alias("p1"),
        F.col("x2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("_n"),
    )
    with_parent = salted_join(
        whole.where("depth > 0"), parents, ["p1", "p2"], "_n", [F.col("x1")]
    ).drop("_n")
    root = whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    turns = nodes.agg(F.sum(F.when(F.col("depth") > 0, F.col("n_convs")))).first()[0] or 0
    limit = max(LIMIT, turns // SHARDS) if limit is None else limit
    sums = _sums(whole, rows.select("key", "depth", "x1", "x2"), limit, queue)
    ends = _ends(rows.where("depth = _length").select("x1", "x2", "key"))
    return (
        with_parent.unionByName(root)
        .join(sums, ["x1", "x2"])
        .join(ends, ["x1", "x2"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def prefix_trie(turns: DataFrame, key: str = "conv_id", **columns: str) -> DataFrame:
    """The trie of whole conversations."""
    keys = turns.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    return trie(stage(ordered(turns, key, **columns), "trie-steps"), keys)
