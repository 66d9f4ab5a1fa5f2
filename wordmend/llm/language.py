"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for every language. A text is parsed from left to
right into the longest pieces that occur in a language's text; the language that needs the fewest
pieces, each weighed by the logarithm of the length of its text, wins. The labelled text is a
sample of bounded size (``documents_per_language`` documents, ``letters_per_document`` letters of
each, ``letters`` for all languages together); every whole text is parsed. The automaton of a language
is built in a task of its own; the driver gets the transitions only.

Every letter of the samples has a symbol. An automaton is a row of its transitions, found by a set of
symbols of each state, or by bisection if a language has more than ``SYMBOLS``; its size is that
of the transitions. Many stretches of text step through it together in numpy. Texts are cut into
stretches of ``_STRETCH`` letters, so the time does not depend on the longest text; a cut adds at
most one piece to the parse of a language.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
text if there is no labelled text; equal results go to the first language by code point;
repeated rows are predicted each; an empty table gives an empty table. Input columns named like an
output column are replaced, others are kept.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmend.llm.columns import numbered, restored
from wordmend.llm.held import forget, held
from wordmend.runtime import stage

UNKNOWN = "und"
DOCUMENTS_PER_LANGUAGE = 300
LETTERS_PER_DOCUMENT = 1000
LETTERS = 2_000_000  # of all languages together: bounds the model with any number of languages
SYMBOLS = 62

_STRETCH = 256
_GAP, _OTHER = 0, 1  # symbols: anything that is no letter; letters that no sample has


def _letters_only(column: pa.Array) -> pa.Array:
    """Lower case, one blank for every run of anything but letters."""
    lowered = pc.utf8_lower(pc.fill_null(column, ""))
    letters = pc.utf8_trim(pc.replace_substring_regex(lowered, r"[^\pL\pM]+", " "), " ")
    return pc.if_else(pc.match_substring_regex(letters, r"\pL"), letters, "")


class SuffixAutomaton:
    """The automaton of all substrings of a sequence of symbols, as a transition table."""

    def __init__(self, sequence: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in sequence:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at != -1 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = link[at]
            if at != -1:
                target = self.next[at][symbol]
                if length[target] == length[at] + 1:
                    link[new] = target
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    while at != -1 and self.next[at].get(symbol) == target:
                        self.next[at][symbol] = copy
                        at = link[at]
                    link[target] = link[new] = copy
            last = new

    def edges(self) -> np.ndarray:
        """``(state, symbol, next state)`` of every transition."""
        return np.fromiter(
            (
                number
                for state, row in enumerate(self.next)
                for symbol, to in row.items()
                for number in (state, symbol, to)
            ),
            np.int32,
        ).reshape(-1, 3)


@dataclass
class Model:
    """``letters`` as symbols from 2 on; per language its edges, states and cost of a piece."""

    letters: str
    languages: list[str]
    edges: list[np.ndarray]
    states: list[int]
    costs: list[float]

    def symbols(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, and the symbols before each text."""
        text = _letters_only(column)
        lengths = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = "".join(text.to_pylist())
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = 0x110000 if any(ord(c) >= 0x10000 for c in self.letters) or (len(codes) and codes.max() >= 0x10000) else 0x10000
        table = np.full(size, _OTHER, np.uint8 if len(self.letters) < 254 else np.int32)
        table[ord(" ")] = _GAP
        for symbol, letter in enumerate(self.letters, 2):
            table[ord(letter)] = symbol
        return table[codes], np.concatenate([[0], np.cumsum(lengths)])

    def tables(self) -> list[Table]:
        width = len(self.letters) + 2
        return [Table(*each, width) for each in zip(self.edges, self.states, strict=True)]


class Table:
    """Transitions of a language: ``4 * next state + pieces begun`` by state and symbol.

    Nearly all states have one or two transitions, so only those that exist take room: they stand in a
    row by state and symbol. A state has the place of its first one and a set of its symbols as bits;
    how many smaller symbols are in the set gives the place. More symbols than a set has bits are
    looked up by bisection. Without a transition the next piece starts at the root with the same
    symbol; a symbol that the language never has (0 in ``own``) is a piece of its own.
    """

    def __init__(self, edges: np.ndarray, states: int, symbols: int) -> None:
        used = np.unique(edges[:, 1])
        self.width = len(used) + 1
        few = len(used) <= SYMBOLS + 1
        self.own = np.zeros(symbols, np.uint8 if few else np.int32)
        self.own[used] = np.arange(1, self.width)
        self.dtype = np.int32 if states * 4 < 1 << 31 else np.int64
        from_root = edges[:, 0] == 0
        self.root = np.ones(self.width, self.dtype)
        self.root[self.own[edges[from_root, 1]]] = edges[from_root, 2].astype(self.dtype) * 4 + 1
        others = edges[~from_root]
        at = others[:, 0].astype(np.int64) * self.width + self.own[others[:, 1]]
        order = np.argsort(at)
        self.to = np.append(others[order, 2].astype(self.dtype) * 4, self.dtype(0))
        self.sets = self.keys = None
        if few:
            state, symbol = np.divmod(at[order], self.width)
            count = np.bincount(state, minlength=states)
            self.first = (np.cumsum(count) - count).astype(self.dtype)
            self.sets = np.zeros(states, np.uint64)
            some = np.flatnonzero(count)
            if len(some):
                bits = np.uint64(1) << symbol.astype(np.uint64)
                self.sets[some] = np.bitwise_or.reduceat(bits, self.first[some])
            self.bit = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        else:
            self.keys = np.append(at[order], -1)

    def after(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.keys is None:
            found, bit = self.sets.take(state), self.bit.take(symbol)
            place = np.bitwise_count(found & (bit - np.uint64(1))) + self.first.take(state)
            value = self.to.take(place)
            none = np.flatnonzero(found & bit == 0)
            value[none] = self.root.take(symbol.take(none))
            return value
        key = state * self.width + symbol
        place = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[place] == key, self.to[place], self.root[symbol])


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    documents_per_language: int = DOCUMENTS_PER_LANGUAGE,
    letters_per_document: int = LETTERS_PER_DOCUMENT,
    letters: int = LETTERS,
) -> Model:
    """Automata from a sample of ``labelled``: per language, the documents that are first by a
    hash of their text, and fewer of them if all languages together had more than ``letters``."""
    known = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.substring(text, 1, 2 * letters_per_document).alias("text")
    )
    order = F.xxhash64("text")
    # Copies have one hash and fall together, so different texts are counted, about. A share of twice
    # the sample of them first, so that the ranking is over few rows of any language. There is one
    # count for each language: it is broadcast, and no text is shuffled by language.
    counts = known.groupBy("lang").agg(F.approx_count_distinct(order, 0.02).alias("n"))
    counts = stage(counts, "language-counts")
    most = letters // (letters_per_document * max(1, counts.count()))
    taken = max(1, min(documents_per_language, most))
    share = F.pmod(order, F.lit(1 << 20)) <= F.lit(2.0 * taken * (1 << 20)) / F.col("n")
    few = known.join(F.broadcast(counts), "lang").where(share | (F.col("n") <= 2 * taken))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    sample = (
        few.select("lang", "text").distinct().withColumn("rank", rank).where(F.col("rank") <= taken)
    )
    built = sample.groupBy("lang").applyInArrow(_build(letters_per_document), _BUILT).collect()
    built = sorted(built, key=lambda row: row.lang)
    counted: Counter[str] = Counter()
    for row in built:
        counted.update(dict(zip(row.letters, row.counts, strict=True)))
    common = sorted(counted, key=lambda c: (-counted[c], c))
    code = {letter: symbol for symbol, letter in enumerate(common, 2)}
    edges = []
    for row in built:
        symbols = np.array([_GAP, _OTHER, *(code[c] for c in row.letters)], np.int32)
        own = np.frombuffer(row.edges, np.int32).reshape(-1, 3).copy()
        own[:, 1] = symbols[own[:, 1]]
        edges.append(own)
    return Model(
        "".join(common),
        [row.lang for row in built],
        edges,
        [row.states for row in built],
        [float(np.log2(row.length + 1)) for row in built],
    )


_BUILT = (
    "lang string, letters string, counts array<bigint>, edges binary, states bigint, length bigint"
)


def _build(letters_per_document: int):
    """The automaton of one language, as edges over symbols of its own letters from 2 on."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        rows = table.sort_by("rank")
        texts = _letters_only(rows.column("text").combine_chunks()).to_pylist()
        joined = " ".join(text[:letters_per_document] for text in texts if text.strip())
        counted = Counter(joined)
        own = sorted(set(joined) - {" "})
        code = {letter: symbol for symbol, letter in enumerate(own, 2)} | {" ": _GAP}
        automaton = SuffixAutomaton([code[c] for c in joined])
        found = {
            "lang": pa.array([str(rows.column("lang")[0].as_py())], pa.string()),
            "letters": pa.array(["".join(own)], pa.string()),
            "counts": pa.array([[counted[c] for c in own]], pa.list_(pa.int64())),
            "edges": pa.array([automaton.edges().tobytes()], pa.binary()),
            "states": pa.array([len(automaton.next)], pa.int64()),
            "length": pa.array([len(joined)], pa.int64()),
        }
        whole = pa.table(found)
        return whole if joined else whole.slice(0, 0)

    return run


def costs(model: Model, tables: list[Table], column: pa.Array) -> np.ndarray:
    """Bits per letter of every text in every language; not a number if it has no letter."""
    symbols, offsets = model.symbols(column)
    lengths = np.diff(offsets)
    stretches = -(-lengths // _STRETCH)
    owner = np.repeat(np.arange(len(lengths)), stretches)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    begin = offsets[:-1][owner] + nth * _STRETCH
    sizes = np.minimum(_STRETCH, offsets[1:][owner] - begin)
    # Stretches by length, so that each step works on the ones that are not over.
    by_size = np.argsort(-sizes, kind="stable")
    owner, begin, sizes = owner[by_size], begin[by_size], sizes[by_size]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), "right")
    bits = np.full((len(lengths), len(model.languages)), np.nan)
    seen = lengths > 0
    for k, table in enumerate(tables):
        own = table.own[symbols]
        state = np.zeros(len(owner), np.int64)
        pieces = np.zeros(len(owner), np.int32)
        for step in range(steps):
            n = alive[step]
            value = table.after(state[:n], own.take(begin[:n] + step))
            pieces[:n] += value & 3
            state[:n] = value >> 2
        total = np.bincount(owner, pieces, len(lengths))
        bits[seen, k] = total[seen] * model.costs[k] / lengths[seen]
    return bits


def predict(
    documents: DataFrame, model: Model, text: str = "text", keep_text: bool = True
) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``: how much cheaper the best language is than
    the next one, as a share; 1 if there is only one."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)
    plain, names = numbered(documents)
    left_out = ["lang_pred", "score", *([] if keep_text else [text])]
    kept = [new for old, new in names.items() if old not in left_out]
    name = uuid.uuid4().hex

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        tables = held(f"language-{name}", learned.tables)
        for whole in batches:
            for batch in _small(whole):
                column = batch.column(len(kept))
                found, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
                if learned.languages:
                    bits = costs(learned, tables, column)
                    for row in np.flatnonzero(~np.isnan(bits[:, 0])):
                        order = np.argsort(bits[row], kind="stable")
                        found[row] = learned.languages[order[0]]
                        score[row] = 1.0
                        if len(order) > 1:
                            score[row] = 1.0 - bits[row, order[0]] / bits[row, order[1]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(kept))), pa.array(found), pa.array(score)],
                    names=[*kept, "lang_pred", "score"],
                )

    schema = plain.select(*kept).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    labelled = plain.select(*kept, F.col(names[text]).alias("_text")).mapInArrow(label, schema)
    return labelled.select(*restored(names, left_out), "lang_pred", "score")


def _small(batch: pa.RecordBatch, letters: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of about so many bytes of text, the last column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)
    sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // letters
    for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
        if len(part):
            yield batch.slice(int(part[0]), len(part))


def fold(key: Column, parts: int) -> Column:
    """The part of a row: its key's CRC-32 modulo ``parts``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts
