"""Substring dedup by sliding sentence spans.

A sentence ends at ``. ! ? ; :`` or a line end, before a word with a capital first letter, and, so
that text without any of these has sentences too, after words that their hash chooses (one of
``_CHOSEN``). Where ``_WINDOW`` neighbouring places have none of these ends, the place with the
least hash of the two words around it is one, so no sentence is longer than ``_WINDOW`` words. All
of this depends on the words nearby only, so a passage has the same sentences wherever it stands.
Every sentence starts and ends a span: the shortest run of at least two sentences and ``MIN_WORDS``
words. A passage of 50 words holds a whole span wherever it stands; up to ``_WINDOW`` words at an
end that lies inside a sentence of the other text may stay. Spans with
the same words (A-Z as a-z, without punctuation) are joined over all documents by a 64-bit hash,
and sentences of any span but the first, by key and place, are removed.

Spans that occur again in the rows a task reads together are resolved there; what is shuffled by
hash is one row for each span and such block, so a passage that very many documents share does
not meet in one task.

Defined results: null texts stay null; texts without a repeated span are unchanged; a null key is
before all others; repeated rows (key and text) count as one place and are cut alike; an empty
table gives an empty table. Input columns named like an output column are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmend.llm.columns import numbered, restored
from wordmend.llm.held import forget
from wordmend.llm.words import Words, mixed, slices, words

MIN_WORDS = 26
OUTPUT = ("removed", "removed_words")

_CHOSEN = 32
_WINDOW = 8
_BASE = 0xD6E8FEB86659FD93
_ENDERS = np.isin(np.arange(256), np.frombuffer(b".!?;:\n\r", np.uint8))
_powers: list[np.ndarray] = []


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        found = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            found.append(np.cumprod(powers, dtype=np.uint64))
        _powers[:] = found
    return _powers[0], _powers[1]


def sentence_starts(found: Words) -> np.ndarray:
    """Numbers of the words that begin a sentence."""
    n = len(found.starts)
    if n == 0:
        return np.zeros(0, np.int64)
    enders = np.concatenate([[0], np.cumsum(_ENDERS[found.data])])
    begins = np.zeros(n, bool)
    begins[1:] = enders[found.starts[1:]] > enders[found.ends[:-1]]
    initial = found.data[found.starts]
    second = found.data[np.minimum(found.starts + 1, len(found.data) - 1)]
    begins |= (initial >= ord("A")) & (initial <= ord("Z"))
    begins |= (initial == 0xC3) & (second >= 0x80) & (second <= 0x9E)  # À to Þ in UTF-8
    begins[1:] |= found.hashes[:-1] % np.uint64(_CHOSEN) == 0
    begins[found.first[:-1][np.diff(found.first) > 0]] = True
    if n > _WINDOW:
        pair = mixed(found.hashes[:-1] * np.uint64(_BASE) + found.hashes[1:])
        ended = np.concatenate([[0], np.cumsum(begins[1:])])
        bare = np.flatnonzero(ended[_WINDOW:] == ended[:-_WINDOW])
        windows = np.lib.stride_tricks.sliding_window_view(pair, _WINDOW)
        for some in np.array_split(bare, len(bare) // (1 << 18) + 1):
            begins[some + windows[some].argmin(1) + 1] = True
    return np.flatnonzero(begins)


def spans(found: Words, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Of every span: its text, first and last byte in the text, words and hash."""
    starts = sentence_starts(found)
    n = len(found.starts)
    edges = np.append(starts, n)
    text = np.searchsorted(found.first, edges, "right") - 1
    number = np.arange(len(starts))
    end = np.maximum(number + 2, np.searchsorted(edges, starts + min_words, "left"))
    ahead = end <= len(starts)
    first = [number[ahead]]
    last = [end[ahead]]
    to = np.arange(1, len(edges))
    begin = np.minimum(to - 2, np.searchsorted(edges, edges[1:] - min_words, "right") - 1)
    back = begin >= 0
    first.append(begin[back])
    last.append(to[back])
    pair = np.unique(np.concatenate(first) * (len(edges) + 1) + np.concatenate(last))
    first, last = pair // (len(edges) + 1), pair % (len(edges) + 1)
    inside = text[first] == text[np.maximum(last - 1, 0)]
    first, last = first[inside], last[inside]
    a, b = edges[first], edges[last]
    powers, inverses = _scales(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(found.hashes * powers[:n], out=sums[1:])
    value = mixed((sums[b] - sums[a]) * inverses[a] ^ (b - a).astype(np.uint64))
    owner = text[first]
    # A sentence reaches to the next one, or to the end of its text.
    next_start = np.append(found.starts, len(found.data))[b]
    stop = np.minimum(next_start, found.offsets[owner + 1])
    return owner, found.starts[a] - found.offsets[owner], stop - found.offsets[owner], b - a, value


def _spans_of(min_words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            rank = np.empty(len(whole), np.int64)
            keys = pc.rank(whole.column("key"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
            rank[:] = keys.to_numpy(zero_copy_only=False)
            parts, base = [], 0
            for batch in slices(iter([whole])):
                owner, *others = spans(words(batch.column("text")), min_words)
                parts.append((owner + base, *others))
                base += len(batch)
            if not parts:
                continue
            owner, start, end, _, value = map(np.concatenate, zip(*parts, strict=True))
            version = whole.column("version").to_numpy(zero_copy_only=False)[owner]
            order = np.lexsort((start, version, rank[owner], value))
            owner, start, end, value, version = (x[order] for x in (owner, start, end, value, version))
            place = np.stack([rank[owner], version, start], 1)
            head = np.ones(len(value), bool)
            head[1:] = value[1:] != value[:-1]
            lead = np.maximum.accumulate(np.where(head, np.arange(len(value)), 0))
            later = (place != place[lead]).any(1)
            # The same place again (a repeated row) says nothing new. Rows go out by text, which
            # compresses well, and repeats as the stretches they make together.
            new = np.flatnonzero(head & ~later)
            new = new[np.lexsort((start[new], owner[new]))]
            again = np.flatnonzero(later)
            again = again[np.lexsort((start[again], owner[again]))]
            reach = np.maximum.accumulate((owner[again] << 32) + end[again])
            begins = np.ones(len(again), bool)
            begins[1:] = (owner[again][1:] << 32) + start[again][1:] > reach[:-1]
            ends = np.append(begins[1:], True)[: len(again)]
            again, reach = again[begins], reach[ends] & 0xFFFFFFFF
            rows = np.concatenate([new, again])
            yield pa.RecordBatch.from_arrays(
                [
                    whole.column("key").take(pa.array(owner[rows])),
                    pa.array(version[rows]),
                    pa.array(np.append(value[new].view(np.int64), np.zeros(len(again), np.int64))),
                    pa.array(start[rows], pa.int32()),
                    pa.array(np.append(end[new], reach), pa.int32()),
                    pa.array(np.arange(len(rows)) >= len(new)),
                ],
                names=["key", "version", "hash", "start", "end", "later"],
            )

    return find


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by hash and place; all but the first place of a hash are repeats."""
    forget()
    carried_hash = carried_place = None  # the last hash of the batch before, and its first place
    for batch in batches:
        later = batch.column("later").to_numpy(zero_copy_only=False).copy()
        rows = np.flatnonzero(~later)
        if len(rows):
            columns = batch.take(pa.array(rows))
            value, version, start = (
                columns.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "version", "start")
            )
            keys = columns.column("key")
            codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy()
            head = np.ones(len(rows), bool)
            head[0] = value[0] != carried_hash
            head[1:] = value[1:] != value[:-1]
            lead = np.maximum.accumulate(np.where(head, np.arange(len(rows)), -1))
            place = np.stack([codes, version, start], 1)
            later[rows] = (place != place[lead]).any(1)
            for i in np.flatnonzero(lead < 0):
                here = (keys[i].as_py(), int(version[i]), int(start[i]))
                later[rows[i]] = here != carried_place
            if lead[-1] >= 0:
                i = lead[-1]
                carried_hash = value[i]
                carried_place = (keys[i].as_py(), int(version[i]), int(start[i]))
        yield batch.select(["key", "version", "start", "end"]).filter(pa.array(later))


def repeated_spans(
    documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``(key, version, start, end)``: bytes of ``text`` that repeat earlier ones; ``version`` is
    the XXH64 of the text."""
    rows = documents.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.col(text).alias("text")
    )
    place = [
        T.StructField("key", documents.schema[key].dataType),
        T.StructField("version", T.LongType()),
    ]
    span = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    found = rows.mapInArrow(
        _spans_of(min_words),
        T.StructType(
            [
                *place,
                T.StructField("hash", T.LongType()),
                *span,
                T.StructField("later", T.BooleanType()),
            ]
        ),
    )
    to = F.when(F.col("later"), F.xxhash64("key", "start")).otherwise(F.col("hash"))
    return (
        found.repartition(to)
        .sortWithinPartitions("hash", "key", "version", "start")
        .mapInArrow(_mark, T.StructType([*place, *span]))
    )


def _cut(schema: T.StructType, text: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts, gone, counts = [], [], []
            values = batch.column(text).cast(pa.binary())
            for value, ranges in zip(values, batch.column("_spans"), strict=True):
                raw, spans_here = value.as_py(), ranges.as_py() or []
                merged: list[list[int]] = []
                for span in sorted((s["start"], s["end"]) for s in spans_here):
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append([*span])
                kept, at, removed = [], 0, 0
                for start, end in merged:
                    kept.append(raw[at:start])
                    removed += len(words(pa.array([raw[start:end].decode()])).hashes)
                    at = end
                texts.append(raw if raw is None or not merged else b"".join([*kept, raw[at:]]))
                gone.append([{"start": a, "end": b} for a, b in merged])
                counts.append(removed)
            columns = {
                text: pa.array(texts, pa.binary()).cast(pa.string()),
                "removed": pa.array(
                    gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                ),
                "removed_words": pa.array(counts, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(
                [columns[n] if n in columns else batch.column(n) for n in schema.names],
                names=schema.names,
            )

    return cut


def without_repeats(
    documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``documents`` without repeated spans, with ``removed`` (byte ranges of the original text)
    and ``removed_words``."""
    rows, names = numbered(documents.drop(*OUTPUT))
    key, text = names[key], names[text]
    found = repeated_spans(rows, key, text, min_words)
    by_row = found.groupBy("key", "version").agg(
        F.collect_list(F.struct("start", "end")).alias("_spans")
    )
    by_row = by_row.withColumnsRenamed({"key": "_key", "version": "_version"})
    marked = rows.join(
        by_row,
        rows[key].eqNullSafe(by_row["_key"]) & (F.xxhash64(rows[text]) == by_row["_version"]),
        "left",
    ).select(*rows.columns, "_spans")
    schema = T.StructType(
        [
            *rows.schema.fields,
            T.StructField(
                "removed",
                T.ArrayType(
                    T.StructType(
                        [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
                    )
                ),
            ),
            T.StructField("removed_words", T.LongType()),
        ]
    )
    return marked.mapInArrow(_cut(schema, text), schema).select(*restored(names), *OUTPUT)
