"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text; a template is a short license notice. A block matches a template if it
holds at least ``THRESHOLD`` of the template's distinct words. Words are in global order, rarest in
all documents first. A match must then share one of the first ``size - needed + 1`` words of the
template (prefix filter), have at least ``needed`` words (length filter), and have enough template
words left from the first shared one on (positional filter). What passes is counted exactly.

A notice is found where it stands, over line ends: the same filters and containment on every window
of ``words of the template / THRESHOLD`` words, which must also hold the words that tell the template
from similar ones (``REQUIRED``), without a word of another license among these (``EXCLUDED``).
Matching windows that overlap are one notice, the fullest and first of them. So the words of a
notice that are scattered over a long line are a matching block, but not a notice.

Beside that join, phrases are found where their words stand next to each other.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z as a-z. Templates and phrases are
parameters and small, so their words and the counts of these in all documents are broadcast.

Defined results: a null or empty text has no words, places or blocks; a template without words
matches nothing; repeated rows are scanned each; an empty table gives an empty table. Only the named
columns are used, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmend.llm.words import Words, slices, words

THRESHOLD = 0.8
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2.0"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met"
    ],
    "cc-by-4.0": ["this work is licensed under a creative commons attribution 4.0 license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4.0"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files"
    ],
    "mit-notice": ["released under the mit license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license"],
    "proprietary": ["all rights reserved"],
}
REQUIRED = {
    "apache-2.0": "apache 2",
    "cc-by-4.0": "creative commons attribution 4",
    "cc-by-nc-4.0": "cc nc 4",
    "gpl-3.0": "gnu general public 3",
    "mit-grant": "associated",
    "mit-notice": "mit",
    "mpl-2.0": "mozilla",
}
EXCLUDED = {
    "cc-by-4.0": "nc nd sa non no share noncommercial noderivatives noderivs sharealike",
    "cc-by-nc-4.0": "nd sa",
    "gpl-3.0": "affero lesser library",
}
_NEWLINE = ord("\n")


def _hashes(text: str) -> np.ndarray:
    return words(pa.array([text])).hashes


@dataclass
class Template:
    label: str
    tokens: np.ndarray  # ranks of the distinct words, rarest first
    needed: int
    window: int
    required: np.ndarray  # places in ``tokens``
    excluded: np.ndarray  # hashes

    @property
    def prefix(self) -> np.ndarray:
        return self.tokens[: len(self.tokens) - self.needed + 1]


def _ranked_templates(
    templates: Mapping[str, Sequence[str]],
    threshold: float,
    counts: Mapping[int, int],
    required: Mapping[str, str] = {},
    excluded: Mapping[str, str] = {},
) -> tuple[np.ndarray, np.ndarray, list[Template]]:
    """All template words as sorted hashes, the rank of each, and the templates."""
    spelled = [(label, _hashes(text)) for label, texts in templates.items() for text in texts]
    sets = [(label, np.unique(found)) for label, found in spelled]
    vocabulary = np.unique(np.concatenate([s for _, s in sets] or [np.zeros(0, np.uint64)]))
    frequency = np.array([counts.get(int(v.view(np.int64)), 0) for v in vocabulary], np.int64)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, frequency))] = np.arange(len(vocabulary))
    ready = []
    for (label, own), (_, all_words) in zip(sets, spelled, strict=True):
        if len(own):
            tokens = np.sort(rank[np.searchsorted(vocabulary, own)])
            must = np.intersect1d(_hashes(required.get(label, "")), own)
            ready.append(
                Template(
                    label,
                    tokens,
                    max(1, math.ceil(threshold * len(own) - 1e-9)),
                    math.ceil(len(all_words) / threshold - 1e-9),
                    np.searchsorted(tokens, rank[np.searchsorted(vocabulary, must)]),
                    np.setdiff1d(_hashes(excluded.get(label, "")), own),
                )
            )
    return vocabulary, rank, ready


def _known(found: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that are in the vocabulary: their numbers and places in it."""
    if not len(vocabulary) or not len(found.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, found.hashes), len(vocabulary) - 1)
    mine = np.flatnonzero(vocabulary[at] == found.hashes)
    return mine, at[mine]


def token_counts(texts: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often the words of the vocabulary (sorted hashes) occur in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in slices(batches):
            total += np.bincount(_known(words(batch.column("text")), vocabulary)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(vocabulary.view(np.int64)), pa.array(total)], names=["word", "n"]
        )

    counted = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {row.word: row.n for row in counted.collect()}


def _blocks(found: Words) -> np.ndarray:
    """The block of every word: they change with lines and texts."""
    lines = np.concatenate([[0], np.cumsum(found.data == _NEWLINE)])[found.starts]
    text = np.searchsorted(found.first, np.arange(len(found.starts)), "right") - 1
    change = np.ones(len(lines), bool)
    change[1:] = (lines[1:] != lines[:-1]) | (text[1:] != text[:-1])
    return np.cumsum(change) - 1


def matching_blocks(
    found: Words, vocabulary: np.ndarray, rank: np.ndarray, templates: list[Template]
) -> Iterator[tuple[str, int, int, float]]:
    """``(label, first word, words, containment)`` of every block that reaches a template."""
    mine, at = _known(found, vocabulary)
    if not len(mine):
        return
    block = _blocks(found)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    length = np.diff(np.append(first, len(block)))
    # The template words of every block as a set, rarest first.
    width = len(vocabulary)
    pairs = np.unique(block[mine] * width + rank[at])
    owner, token = pairs // width, pairs % width
    ends = np.searchsorted(owner, owner, "right")
    for template in templates:
        in_prefix = np.flatnonzero(np.isin(token, template.prefix))
        in_prefix = in_prefix[length[owner[in_prefix]] >= template.needed]
        # The first shared word of each block, and what may still be shared from there on.
        blocks, lead = np.unique(owner[in_prefix], return_index=True)
        start = in_prefix[lead]
        place = np.searchsorted(template.tokens, token[start])
        rest = np.minimum(len(template.tokens) - place, ends[start] - start)
        for b, i in zip(blocks[rest >= template.needed], start[rest >= template.needed], strict=True):
            shared = int(np.isin(token[i : ends[i]], template.tokens).sum())
            if shared >= template.needed:
                yield template.label, int(first[b]), int(length[b]), shared / len(template.tokens)


def matching_windows(
    found: Words, vocabulary: np.ndarray, rank: np.ndarray, templates: list[Template]
) -> Iterator[tuple[str, int, int, float]]:
    """``(label, first word, words, containment)`` of every notice."""
    mine, at = _known(found, vocabulary)
    token = rank[at]
    for template in templates:
        size = len(template.tokens)
        place = np.full(len(vocabulary), -1)
        place[template.tokens] = np.arange(size)
        own = place[token] >= 0
        word, which = mine[own], place[token[own]]
        # Windows end at a word of the template: the number of the first such word in each.
        text = found.first[np.searchsorted(found.first, word, "right") - 1]
        low = np.searchsorted(word, np.maximum(word - template.window + 1, text))
        nth = np.arange(len(word))
        rare = np.concatenate([[0], np.cumsum(which < len(template.prefix))])
        end = np.flatnonzero((nth - low + 1 >= template.needed) & (rare[1:] > rare[low]))
        if not len(end):
            continue
        before = np.full(len(word), -1)
        order = np.argsort(which, kind="stable")
        same = which[order[1:]] == which[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        low = low[end]
        shared = np.zeros(len(end), np.int64)
        for back in range(template.window):
            inside = end - back >= low
            shared += inside & (before[np.maximum(end - back, 0)] < low)
        fits = shared >= template.needed
        if len(template.required):
            last = np.stack(
                [np.maximum.accumulate(np.where(which == t, nth, -1))[end] for t in template.required]
            )
            fits &= (last >= low).all(0)
            if len(template.excluded) and fits.any():
                other = np.concatenate([[0], np.cumsum(np.isin(found.hashes, template.excluded))])
                from_, to = word[np.maximum(last.min(0), 0)], word[np.maximum(last.max(0), 0)]
                fits &= other[to] == other[from_]
        end, low, shared = end[fits], low[fits], shared[fits]
        if not len(end):
            continue
        # Both ends of the windows ascend, so windows that overlap follow one another.
        group = np.cumsum(np.concatenate([[0], low[1:] > end[:-1]]))
        best = np.lexsort((end, -shared, group))
        best = best[np.unique(group[best], return_index=True)[1]]
        for i in best:
            first = int(word[low[i]])
            yield template.label, first, int(word[end[i]]) - first + 1, shared[i] / size


def _places(found: Words, phrases: list[tuple[str, np.ndarray]]) -> Iterator[tuple[str, int]]:
    """``(label, word)`` for every phrase at every word it starts at, inside one text."""
    n = len(found.hashes)
    for label, phrase in phrases:
        if not len(phrase) or n < len(phrase):
            continue
        hit = np.flatnonzero(found.hashes[: n - len(phrase) + 1] == phrase[0])
        for k in range(1, len(phrase)):
            hit = hit[found.hashes[hit + k] == phrase[k]]
        text = np.searchsorted(found.first, hit, "right")
        for word in hit[found.first[text] >= hit + len(phrase)]:
            yield label, int(word)


_PLACES = T.ArrayType(
    T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
)
_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("word", T.LongType()),
            T.StructField("words", T.LongType()),
            T.StructField("containment", T.DoubleType()),
        ]
    )
)


def scan(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    required: Mapping[str, str] = REQUIRED,
    excluded: Mapping[str, str] = EXCLUDED,
) -> DataFrame:
    """``(key, n_words, places, blocks, notices)``: all places of phrases, all blocks that hold
    enough of a template, and all notices, with their first word (from 0) in the text."""
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    vocabulary = _ranked_templates(templates, threshold, {})[0]
    counts = token_counts(texts.select("text"), vocabulary)
    vocabulary, rank, ready = _ranked_templates(templates, threshold, counts, required, excluded)
    spelled = [(label, _hashes(phrase)) for label, phrase in phrases.items()]
    schema = T.StructType(
        [
            T.StructField("key", documents.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("places", _PLACES),
            T.StructField("blocks", _FOUND),
            T.StructField("notices", _FOUND),
        ]
    )
    place_kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block_kind = pa.list_(
        pa.struct(
            [
                ("label", pa.string()),
                ("word", pa.int64()),
                ("words", pa.int64()),
                ("containment", pa.float64()),
            ]
        )
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = words(batch.column("text"))
            places: list[list[dict]] = [[] for _ in range(len(batch))]
            blocks: list[list[dict]] = [[] for _ in range(len(batch))]
            notices: list[list[dict]] = [[] for _ in range(len(batch))]

            def text_of(word: int, first: np.ndarray = found.first) -> int:
                return int(np.searchsorted(first, word, "right")) - 1

            for label, word in _places(found, spelled):
                row = text_of(word)
                places[row].append({"label": label, "word": word - int(found.first[row])})
            for rows, matching in ((blocks, matching_blocks), (notices, matching_windows)):
                for label, word, n, share in matching(found, vocabulary, rank, ready):
                    row = text_of(word)
                    rows[row].append(
                        {"label": label, "word": word - int(found.first[row]), "words": n, "containment": share}
                    )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(np.diff(found.first)),
                    pa.array(places, place_kind),
                    pa.array(blocks, block_kind),
                    pa.array(notices, block_kind),
                ],
                names=schema.names,
            )

    return texts.mapInArrow(find, schema).withColumnRenamed("key", key)
