"""Best-fit packing: documents into as few training sequences as possible.

Documents become token ids; those longer than a sequence are cut into full pieces and a rest.
Best-two-fit fills a sequence greedily, longest piece first, then replaces its shortest piece by
two others that fill the room better. As only lengths matter, the plan is made from the counts of
the lengths: a filling is repeated until one of its lengths runs out, so the plan has a few
thousand rows for any number of documents. Pieces then find their place by their rank among the
pieces of their length.

Defined results: a null or empty text is the end id alone; repeated rows are separate documents;
an empty table gives an empty table. Only the named columns are used, so others may have any name.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmend.llm.held import held
from wordmend.llm.ranks import ranked
from wordmend.llm.words import BLANKS, cuts, hashed, mixed, slices, texts
from wordmend.runtime import stage

SEQUENCE = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"

# --- token ids -------------------------------------------------------------------------

# Items that a Python worker remembers; beyond that it starts anew.
_REMEMBERED = 1_000_000
_BLANK, _LETTER, _DIGIT, _MARK, _ODD = range(5)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte that is no visible character as one above 255."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _ODD, np.uint8)
    kinds[0x21:0x7F] = _MARK
    kinds[[ord(c) for c in " \t\n\r\f\v"]] = _BLANK
    for first, last, kind in (("A", "Z", _LETTER), ("a", "z", _LETTER), ("0", "9", _DIGIT)):
        kinds[ord(first) : ord(last) + 1] = kind
    kinds[ord("'")] = _ODD  # contractions
    return kinds


_KINDS = _byte_kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CODES = mixed(np.arange(1, 257, dtype=np.uint64))
_WHOLE = np.uint64(0x5851F42D4C957F2D)


def _items(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the vocabulary's rule makes of a text: ``(starts, ends, hashes, whole, lowered)``.

    Runs of letters, single digits and runs of marks are items; ``edges`` are places where texts
    begin. Letters are A-Z and À-ÿ, in lower case. A chunk between blanks with anything else in it
    is an item as it is (``whole``).
    """
    kind = _KINDS[data]
    before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
    lowered = _LOWER[data]
    second = (before == 0xC3) & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    kind[second] = _LETTER
    kind[np.flatnonzero(second) - 1] = _LETTER
    lowered[second & (data <= 0x9E)] += 0x20
    kind[(before == ord("<")) & (data == ord("|"))] = _ODD  # might be a special token
    first = np.zeros(len(data), bool)
    first[edges] = True
    inside = kind != _BLANK
    opens = inside & (first | np.concatenate([[True], ~inside[:-1]]))
    chunk = np.cumsum(opens) - 1
    odd = np.zeros(chunk[-1] + 2, bool)
    odd[chunk[kind == _ODD]] = True
    kind[odd[chunk] & inside] = _ODD
    new = opens | (kind != np.concatenate([[_BLANK], kind[:-1]])) | (kind == _DIGIT)
    starts = np.flatnonzero(new & inside)
    closes = np.append(new[1:] | ~inside[1:] | first[1:], True)
    ends = np.flatnonzero(inside & closes) + 1
    whole = kind[starts] == _ODD
    shown = np.where(kind == _ODD, data, lowered)
    hashes = hashed(_CODES[shown], starts, ends)
    hashes[whole] ^= _WHOLE
    return starts, ends, hashes, whole, shown


class Encoder:
    """Token ids of many texts at once.

    The vocabulary drops white space and never joins what its rule for words separates, so the
    ids of a text are those of its items one after the other. Each different item (by a 64-bit
    hash) is encoded once: plain ones by the model itself, others by the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self._number: dict[int, int] = {}
        self._flat = np.zeros(0, np.uint32)
        self._begin = np.zeros(1, np.int64)

    def _encode(self, item: bytes, whole: bool) -> list[int]:
        text = item.decode()
        if whole:
            return self._tokenizer.encode(text, add_special_tokens=False).ids
        letters = text if text.isascii() else "".join([self._letters[b] for b in item])
        return [token.id for token in self._model.tokenize(letters)]

    def _known(self, hashes: np.ndarray, items: Callable[[int], list[int]]) -> np.ndarray:
        """Numbers of the items, encoding those not seen before."""
        if len(self._number) > _REMEMBERED:
            self._forget()
        values = hashes.tolist()
        numbers = np.array([self._number.get(v, -1) for v in values], np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            encoded = [items(i) for i in new.tolist()]
            count = len(self._begin) - 1
            numbers[new] = np.arange(count, count + len(new))
            self._number.update(zip([values[i] for i in new], numbers[new].tolist(), strict=True))
            ends = self._begin[-1] + np.cumsum([len(ids) for ids in encoded])
            self._begin = np.concatenate([self._begin, ends])
            self._flat = np.concatenate(
                [self._flat, np.fromiter(itertools.chain.from_iterable(encoded), np.uint32)]
            )
        return numbers

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the first id of each text."""
        data, offsets = texts(column)
        found = []
        for begin, end in cuts(data, BLANKS):
            low, high = np.searchsorted(offsets[:-1], [begin, end])
            starts, ends, *others = _items(data[begin:end], offsets[low:high] - begin)
            found.append((starts + begin, ends + begin, *others))
        first = np.zeros(len(offsets), np.int64)
        if not found:
            return np.zeros(0, "<u4"), first
        starts, ends, hashes, whole, shown = map(np.concatenate, zip(*found, strict=True))
        _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        raw = shown.tobytes()
        numbers = self._known(
            hashes[at], lambda i: self._encode(raw[starts[at[i]] : ends[at[i]]], bool(whole[at[i]]))
        )[back]
        length = self._begin[numbers + 1] - self._begin[numbers]
        total = np.concatenate([[0], np.cumsum(length)])
        place = np.arange(total[-1]) + np.repeat(self._begin[numbers] - total[:-1], length)
        first = total[np.searchsorted(starts, offsets)]
        return self._flat[place].astype("<u4"), first


def pieces(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    end: int = END,
    vocabulary: str = VOCABULARY,
    with_ids: bool = False,
) -> DataFrame:
    """``(key, piece, start, length, ids_crc32[, ids])`` of every document's token ids."""
    fields = [
        T.StructField(key, documents.schema[key].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        encoder = held(f"packing-{path}", lambda: Encoder(path))
        last, width = np.array([end], "<u4").tobytes(), 4 * sequence
        for batch in slices(batches):
            rows, out = [], []
            flat, first = encoder.ids(batch.column("text"))
            raw = flat.tobytes()
            for row in range(len(batch)):
                ids = raw[4 * first[row] : 4 * first[row + 1]] + last
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append(row)
                    out.append((piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(columns[0], pa.int32()),
                    *(pa.array(column, pa.int64()) for column in columns[1:4]),
                    *([pa.array(columns[4], pa.binary())] if with_ids else []),
                ],
                names=[field.name for field in fields],
            )

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, T.StructType(fields))


# --- plan ------------------------------------------------------------------------------


def _fill(left: np.ndarray, sequence: int) -> dict[int, int]:
    """One sequence, as ``{length: pieces}``, from the counts ``left`` of unpacked pieces."""
    lengths = np.flatnonzero(left)
    taken: dict[int, int] = {}
    room, upto = sequence, len(lengths)
    while True:
        upto = int(np.searchsorted(lengths[:upto], room, "right"))
        if upto == 0:
            break
        length = int(lengths[upto - 1])
        taken[length] = min(int(left[length]), room // length)
        room -= taken[length] * length
        upto -= 1
    shortest = min(taken)
    if room:
        # Two pieces instead of the shortest one, if they fill the room better.
        rest = left.copy()
        for length, n in taken.items():
            rest[length] -= n
        lengths = np.flatnonzero(rest[: room + shortest]) if room + shortest <= sequence else np.flatnonzero(rest)
        if len(lengths):
            other = np.searchsorted(lengths, room + shortest - lengths, "right") - 1
            same = (other >= 0) & (lengths[other] == lengths) & (rest[lengths] < 2)
            other = np.where(same, other - 1, other)
            total = np.where(other >= 0, lengths + lengths[other], 0)
            best = int(np.argmax(total))
            if total[best] > shortest:
                taken[shortest] -= 1
                for length in (int(lengths[best]), int(lengths[other[best]])):
                    taken[length] = taken.get(length, 0) + 1
    return {length: n for length, n in taken.items() if n}


def best_two_fit(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, dict[int, int]]]:
    """The plan: ``(times, {length: pieces})``, from the number of pieces of every length.

    Every step uses up a length or leaves less of it than one sequence takes, so the steps are
    bounded by the sequence length, not by the number of pieces.
    """
    left = np.zeros(sequence + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        filling = _fill(left, sequence)
        times = min(int(left[length]) // n for length, n in filling.items())
        for length, n in filling.items():
            left[length] -= n * times
        plan.append((times, filling))
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For every length, rows ``(first rank, pieces per sequence, first sequence, offset)``."""
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, filling in plan:
        offset = 0
        for length, n in sorted(filling.items(), reverse=True):
            places.setdefault(length, []).append((used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return {length: np.array(rows, np.int64) for length, rows in places.items()}


def place(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; needs the column ``length`` (1 to sequence)."""
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = cut.sparkSession.sparkContext.broadcast(_places(best_two_fit(counts, sequence)))
    others = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    order = F.xxhash64(*(c for c in others if c != "ids"))
    with_rank = ranked(cut.select(*others), ["length"], order, "_rank")
    schema = T.StructType(
        [
            *(with_rank.schema[c] for c in others),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False)
            ids, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                rows = places.value[int(length)]
                at = rows[np.searchsorted(rows[:, 0], ranks[mine], "right") - 1]
                nth = ranks[mine] - at[:, 0]
                ids[mine] = at[:, 2] + nth // at[:, 1]
                offsets[mine] = at[:, 3] + nth % at[:, 1] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(ids), pa.array(offsets)],
                names=schema.names,
            )

    return with_rank.select(*others, "_rank").mapInArrow(find, schema)


def pack(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    end: int = END,
    vocabulary: str = VOCABULARY,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its place: ``(key, piece, start, length, ids_crc32,
    [ids,] sequence_id, offset)``."""
    cut = pieces(documents, key, text, sequence, end, vocabulary, with_ids)
    return place(stage(cut, "pieces"), sequence)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences, from ``pack(…, with_ids=True)``.

    A sequence has at most as many pieces as tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
