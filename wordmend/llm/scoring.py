"""Language-model scoring: the likelihood of all segmentations into subwords.

A text is a sequence of words (A-Z as a-z) and an end. A word, with a blank before it, is spelled
by pieces of an existing vocabulary; its probability is the sum over all segmentations, from a
forward recursion over the lattice of pieces in log space. The vocabulary's scores (ranks, read as
a Zipf law) are the weights to begin with; ``ROUNDS`` of expectation and maximization over all
training words, with these weights as a weak prior, make them probabilities of this corpus. Bytes are
pieces too, so every word has a probability. Pieces do not cross words, so the likelihood of
a text is the product over its words, and the lattice is built once for each different word.

Counts of words come from all training texts. Words with at least one in ``2 ** 21`` of all tokens
(so at most that many words) are broadcast with their counts and scores; all other occurrences are
joined with the table of words by a 64-bit hash.

Beside it stands the base score, of the words' own counts with one added.

Defined results: a null text is empty, which is the end alone; without training texts every
word has count 0 and the weights stay as they are; repeated rows are scored each; an empty table
gives an empty table. Only the named columns are used, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmend.llm.words import _LOWER, BLANKS, mixed, slices, words
from wordmend.runtime import stage

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 1
PRIOR = 1000.0  # occurrences that the vocabulary's own weights count for

_BROADCAST = 1 << 21
_CHUNK = 1 << 17
_RANK_SHIFT = 10.0
_BASE = 0x9E3779B97F4A7C15


# --- pieces ----------------------------------------------------------------------------


@dataclass
class Pieces:
    """Pieces as bytes (a blank for the word mark), with natural log weights."""

    spellings: list[bytes]
    weights: np.ndarray

    @classmethod
    def load(cls, name: str = VOCABULARY) -> Pieces:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        spellings, ranks = [], []
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                spellings.append(bytes([int(piece[3:-1], 16)]))
                ranks.append(np.inf)
            else:
                spellings.append(piece.replace("▁", " ").encode())
                ranks.append(-model.get_score(i))
        rank = np.array(ranks)
        rank[~np.isfinite(rank)] = max(len(rank), 1)  # bytes: like the rarest pieces
        weight = 1 / (rank + _RANK_SHIFT)
        return cls(spellings, np.log(weight / weight.sum()))


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        found.append(np.cumprod(powers, dtype=np.uint64))
    return found[0], found[1]


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64))


class Lattice:
    """Edges of the lattices of many words, found by the pieces' hashes."""

    def __init__(self, pieces: Pieces) -> None:
        self.lengths = sorted({len(s) for s in pieces.spellings})
        powers, _ = _scales(max(self.lengths, default=1))
        keys = np.empty(len(pieces.spellings), np.uint64)
        for i, spelling in enumerate(pieces.spellings):
            codes = _BYTE_CODES[np.frombuffer(spelling, np.uint8)]
            keys[i] = (codes * powers[: len(codes)]).sum(dtype=np.uint64) ^ np.uint64(len(codes))
        keys = mixed(keys)
        # Two pieces may be spelled alike (a byte and its letter): one edge with both weights.
        self.keys, self.group = np.unique(keys, return_inverse=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys & np.uint64(len(self.maybe) - 1)] = True

    def weights(self, pieces: Pieces) -> np.ndarray:
        total = np.bincount(self.group, np.exp(pieces.weights), len(self.keys))
        return np.log(total)

    def edges(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place, length, spelling)`` of every piece in ``data``; one that begins at a place is
        no longer than its ``room``. ``length`` is a number in ``lengths``."""
        powers, inverses = _scales(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * powers[:-1], out=sums[1:])
        mask = np.uint64(len(self.maybe) - 1)
        places, lengths, spelled = [], [], []
        at = np.arange(len(data))
        for number, length in enumerate(self.lengths):
            at = at[room[at] >= length]
            if not len(at):
                break
            key = mixed((sums[at + length] - sums[at]) * inverses[at] ^ np.uint64(length))
            near = np.flatnonzero(self.maybe[key & mask])
            key = key[near]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[found] == key
            places.append(at[near][same])
            lengths.append(np.full(int(same.sum()), number))
            spelled.append(found[same])
        return np.concatenate(places), np.concatenate(lengths), np.concatenate(spelled)


def _log_sum(terms: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the first axis; some term of each is finite."""
    top = terms.max(0)
    return top + np.log(np.exp(terms - top).sum(0))


def likelihoods(
    lattice: Lattice, weights: np.ndarray, spelled_words: list[bytes], counts: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of every word; with ``counts``, also how often each spelling is
    expected in so many occurrences of the words. Words of one length go together."""
    sizes = np.array([len(w) for w in spelled_words])
    by_size = np.argsort(sizes, kind="stable")
    data = np.frombuffer(b"".join([spelled_words[i] for i in by_size]), np.uint8)
    sizes = sizes[by_size]
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(data))
    place, length, spelling = lattice.edges(data, room)
    order = np.argsort(place, kind="stable")
    place, length, spelling = place[order], length[order], spelling[order]
    all_lengths = np.array(lattice.lengths)
    total = np.empty(len(sizes))
    expected = np.zeros(len(weights))
    first = 0
    while first < len(sizes):
        size = int(sizes[first])
        last = int(np.searchsorted(sizes, size, "right"))
        begin = int(ends[first]) - size
        own = slice(*np.searchsorted(place, [begin, int(ends[last - 1])]))
        word, at = np.divmod(place[own] - begin, size)
        steps = all_lengths[all_lengths <= size]
        # By place in the word, length of the piece, and word.
        weight = np.full((size, len(steps), last - first), -np.inf)
        weight[at, length[own], word] = weights[spelling[own]]
        forward = np.zeros((size + 1, last - first))
        for j in range(1, size + 1):
            k = np.flatnonzero(steps <= j)
            forward[j] = _log_sum(forward[j - steps[k]] + weight[j - steps[k], k])
        mine = by_size[first:last]
        total[mine] = forward[size]
        if counts is not None:
            backward = np.zeros((size + 1, last - first))
            for i in range(size - 1, -1, -1):
                k = np.flatnonzero(steps <= size - i)
                backward[i] = _log_sum(backward[i + steps[k]] + weight[i, k])
            gain = (
                forward[at, word]
                + weights[spelling[own]]
                + backward[at + all_lengths[length[own]], word]
                - forward[size, word]
            )
            expected += np.bincount(spelling[own], np.exp(gain) * counts[mine][word], len(weights))
        first = last
    return total, None if counts is None else expected


def _with_blank(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Words with a blank before each, in pieces of about ``_CHUNK`` bytes."""
    texts = column.to_pylist()
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < _CHUNK):
            size += len(texts[last]) + 1
            last += 1
        yield first, last, [b" " + text.encode() for text in texts[first:last]]
        first = last


# --- counts and training ---------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _halves(batch):
            found = words(part.column("text"), BLANKS)
            trains = part.column("trains").to_numpy(zero_copy_only=False)
            of_training = np.repeat(trains, np.diff(found.first))
            _, at, back, n = np.unique(
                found.hashes, return_index=True, return_inverse=True, return_counts=True
            )
            trained = np.bincount(back[of_training], minlength=len(at)) if len(at) else n
            low = _LOWER[found.data].tobytes()
            spelled = [low[a:b].decode() for a, b in zip(found.starts[at], found.ends[at], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(spelled, pa.string()), pa.array(trained), pa.array(n)],
                names=["word", "trained", "n"],
            )


def _halves(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return slices(iter([batch]), 1 << 25)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, trained, n)``: occurrences in training texts and in all, from ``texts (text,
    trains)``."""
    return (
        texts.mapInArrow(_count, "word string, trained long, n long")
        .groupBy("word")
        .agg(F.sum("trained").alias("trained"), F.sum("n").alias("n"))
    )


def train(counted: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the lattice's spellings after ``rounds`` rounds over all training words."""
    spark = counted.sparkSession
    lattice = Lattice(pieces)
    prior = np.exp(lattice.weights(pieces))
    weights = np.log(prior)
    words_of = counted.where("trained > 0").select("word", "trained")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, weights))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces, weights = sent.value
            lattice = Lattice(pieces)
            total = np.zeros(len(weights))
            for batch in batches:
                n = batch.column("trained").to_numpy().astype(float)
                for first, last, chunk in _with_blank(batch.column("word")):
                    total += likelihoods(lattice, weights, chunk, n[first:last])[1]
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(total[used])], names=["piece", "n"]
            )

        sums = words_of.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        expected = np.zeros(len(prior))
        for row in sums.collect():  # one row for each piece at most
            expected[row.piece] = row.n
        weights = np.log((expected + PRIOR * prior) / (expected.sum() + PRIOR))
    return weights


def word_scores(counted: DataFrame, pieces: Pieces, weights: np.ndarray) -> DataFrame:
    """``(word_hash, trained, n, spelling)``; ``spelling`` is the log10 probability."""
    sent = counted.sparkSession.sparkContext.broadcast((pieces, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weights = sent.value
        lattice = Lattice(pieces)
        for batch in batches:
            column = batch.column("word")
            total = np.empty(len(batch))
            for first, last, chunk in _with_blank(column):
                total[first:last] = likelihoods(lattice, weights, chunk)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(words(column, BLANKS).hashes.view(np.int64)),
                    batch.column("trained"),
                    batch.column("n"),
                    pa.array(total / np.log(10)),
                ],
                names=["word_hash", "trained", "n", "spelling"],
            )

    return counted.mapInArrow(score, "word_hash long, trained long, n long, spelling double")


# --- scores ----------------------------------------------------------------------------


def score(
    documents: DataFrame,
    trains: Column,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)``; rows that fulfil ``trains``
    are learned from, all are scored."""
    spark = documents.sparkSession
    rows = documents.select(
        F.col(key).alias("key"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(trains, F.lit(False)).alias("trains"),
    )
    counted = stage(word_counts(rows.select("text", "trains")), "word-counts")
    pieces = Pieces.load(vocabulary)
    table = stage(word_scores(counted, pieces, train(counted, pieces)), "word-scores")
    sums = table.agg(F.sum("trained"), F.sum("n"), F.count_if(F.col("trained") > 0)).first()
    texts, endings = rows.agg(F.count("*"), F.count_if("trains")).first()
    train_tokens = (sums[0] or 0) + endings
    types = sums[2] + (1 if endings else 0)
    everything = train_tokens + types + 1
    end = np.log10((endings + 1) / (train_tokens + 2))  # of the end after any word
    more = np.log10((train_tokens - endings + 1) / (train_tokens + 2))

    frequent = table.where(F.col("n") * _BROADCAST >= (sums[1] or 0) + texts)
    known = frequent.select("word_hash", "trained", "spelling").toPandas()
    hashes = known["word_hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    sent = spark.sparkContext.broadcast(
        (
            hashes[order],
            known["trained"].to_numpy(np.int64)[order],
            known["spelling"].to_numpy(float)[order],
        )
    )
    end_base = float(np.log10((endings + 1) / everything))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, trained, spelling = sent.value
        base = np.log10((trained + 1) / everything)
        for batch in slices(batches):
            found = words(batch.column("text"), BLANKS)
            n = np.diff(found.first)
            row = np.repeat(np.arange(len(batch)), n)
            here = np.zeros(len(found.hashes), bool)
            at = np.zeros(len(found.hashes), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, found.hashes), len(hashes) - 1)
                here = hashes[at] == found.hashes
            mine, place = row[here], at[here]
            total = lambda w, row=mine: np.bincount(row, w, len(n))  # noqa: E731,B023
            rest = found.hashes[~here].view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[~here], minlength=len(n)))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(n + 1),
                    pa.array(np.bincount(mine[trained[place] > 0], minlength=len(n)) + (endings > 0)),
                    pa.array(total(base[place]) + end_base),
                    pa.array(total(spelling[place]) + n * more + end),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rest)),
                ],
                names=["key", "n_tokens", "known", "base", "spelled", "rest"],
            )

    schema = T.StructType(
        [
            T.StructField("key", documents.schema[key].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("known", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("spelled", T.DoubleType()),
            T.StructField("rest", T.ArrayType(T.LongType())),
        ]
    )
    partly = stage(
        rows.select("key", "text")
        .mapInArrow(look_up, schema)
        .withColumn("row", F.monotonically_increasing_id()),
        "partly-scored",
    )
    # The rare words: none has more than one in 2 ** 21 of all tokens.
    rare = (
        partly.select("row", F.explode("rest").alias("word_hash"))
        .join(table.select("word_hash", "trained", "spelling"), "word_hash")
        .groupBy("row")
        .agg(
            F.count_if(F.col("trained") > 0).alias("rare_known"),
            F.sum(F.log10((F.col("trained") + 1) / float(everything))).alias("rare_base"),
            F.sum("spelling").alias("rare_spelled"),
        )
    )
    none = F.lit(0.0)
    return partly.drop("rest").join(rare, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", none)).alias("base_score"),
        (F.col("spelled") + F.coalesce("rare_spelled", none)).alias("score"),
    )
