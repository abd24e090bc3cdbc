"""Best-fit packing: documents as token pieces in sequences of bounded length, by best-two-fit on the length histogram.

Only the histogram of piece lengths decides how sequences are filled, and it has at most as many entries as a sequence
has tokens. The driver plans *patterns* (lengths that share a sequence) with multiplicities: a sequence is filled
greedily with the longest unpacked documents that fit; then its smallest document is replaced with two unpacked ones
that together fit the expanded gap more tightly. Pieces then find their places by their rank within their length, which
is counted per partition and summed up across partitions, so no length, however common, gathers in one task.

Tokenising is exact: texts of plain Latin characters are split here and their words looked up in a bounded cache of the
tokenizer's own answers; every other text goes to the tokenizer whole.

Odd input: a null text counts as the empty text, which is the end token alone; repeated rows are packed each; ids may be
null and of any type. An empty table gives no pieces. Pieces of equal length tie and take places in the order of partitions
and rows. A very long text is tokenised whole in one worker and cut; only its pieces go on. Extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.runtime import Scratch, ship_package

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Rows of the list of lengths by partition up to which it is broadcast.
BROADCAST_ROWS = 200_000
#: Words whose token ids a worker keeps; beyond it the cache is emptied.
CACHE_WORDS = 500_000


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters_and_numbers(last: int) -> tuple[str, str]:
    letters = "".join(chr(c) for c in range(last + 1) if unicodedata.category(chr(c))[0] == "L")
    numbers = "".join(chr(c) for c in range(last + 1) if unicodedata.category(chr(c))[0] == "N")
    return letters, numbers


_L, _N = _letters_and_numbers(0x24F)
#: Characters for which splitting here equals the tokenizer's own: no combining marks, no odd white space.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: The tokenizer's split pattern with its Unicode classes spelled out for those characters.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(0x100 + k) for k, b in enumerate(others)}}


_BYTES = str.maketrans({chr(b): c for b, c in _byte_alphabet().items()})


class PieceIds(dict):
    """pre-token -> its token ids as little-endian unsigned 32-bit bytes, asked of the tokenizer's model once."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(_BYTES)
        ids = np.array([token.id for token in self.model.tokenize(spelled)], "<u4").tobytes()
        self[piece] = ids
        return ids


class WordIds(dict):
    """lower-cased word between white space -> its token ids as bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.pieces = PieceIds(path)

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.pieces.__getitem__, _SPLIT.findall(word)))
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.pieces.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids_of(self, text: str) -> bytes:
        lower = text.lower()  # can leave the range: some capitals in it have small letters beyond it
        if not text.isascii() and (_ODD.search(text) or _ODD.search(lower)) or "<|" in text or _CONTROL.search(text):
            return self.whole(text)
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, lower.split()))


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def cut(ids: bytes, capacity: int = CAPACITY) -> list[bytes]:
    """The pieces; only documents longer than a sequence are cut."""
    width = 4 * capacity
    return [ids[k : k + width] for k in range(0, len(ids), width)]


def _pieces(path: str | None, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path or tokenizer_path())
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, piece, length, crc, ordinal, whole = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for k, part_ids in enumerate(cut(words.ids_of(text or "") + end, capacity)):
                    size = len(part_ids) // 4
                    rows.append(row)
                    piece.append(k)
                    length.append(size)
                    crc.append(zlib.crc32(part_ids))
                    if with_ids:
                        whole.append(np.frombuffer(part_ids, "<i4"))
                    ordinal.append(int(seen[size]))
                    seen[size] += 1
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            numbers = [pa.array(x, t) for x, t in ((piece, pa.int32()), (length, pa.int64()), (crc, pa.int64()), ([part] * len(rows), pa.int32()), (ordinal, pa.int64()))]
            columns = dict(zip(("doc_id", "piece", "length", "ids_crc32", "part", "ordinal"), [ids, *numbers]))
            if with_ids:
                columns["ids"] = pa.array(whole, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths, greatest first) and how many sequences each fills; every piece is in exactly one."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    places = np.arange(capacity + 1)
    patterns = []
    top = capacity
    while True:
        fitting = np.maximum.accumulate(np.where(left > 0, places, 0))  # the longest unpacked length up to each
        top = int(fitting[capacity])
        if not top:
            return patterns
        taken: dict[int, int] = {}
        gap = capacity

        def longest(room: int) -> int:
            size = int(fitting[room]) if room > 0 else 0
            while size and left[size] <= taken.get(size, 0):
                size = int(fitting[size - 1])
            return size

        while size := longest(gap):
            more = max(1, min(gap // size, int(left[size]) - taken.get(size, 0)))
            taken[size] = taken.get(size, 0) + more
            gap -= size * more
        if gap and sum(taken.values()) > 1:
            smallest = min(taken)
            free = left.copy()
            for size, n in taken.items():
                free[size] -= n
            free[smallest] += 1
            room = gap + smallest
            below = np.maximum.accumulate(np.where(free > 0, places, 0))
            first = np.flatnonzero(free[: room + 1] > 0)
            first = first[first > 0]
            second = below[room - first]
            clash = (second == first) & (free[first] < 2)
            second = np.where(clash, below[np.maximum(np.minimum(first, room - first) - 1, 0)], second)
            both = np.where(second > 0, first + second, 0)
            k = int(np.argmax(both)) if len(both) else 0
            if len(both) and both[k] > smallest:
                taken[smallest] -= 1
                for size in (int(first[k]), int(second[k])):
                    taken[size] = taken.get(size, 0) + 1
                taken = {size: n for size, n in taken.items() if n}
        times = min(int(left[size]) // n for size, n in taken.items())
        for size, n in taken.items():
            left[size] -= n * times
        patterns.append(([size for size in sorted(taken, reverse=True) for _ in range(taken[size])], times))


def _places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) with, for each, the first sequence, pieces of that length in one, and offset."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for size in dict.fromkeys(lengths):
            n = lengths.count(size)
            rows.append(((size << 44) + used.get(size, 0), sequence, n, offset))
            used[size] = used.get(size, 0) + n * times
            offset += size * n
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, the token ids."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "packing")
    id_type = docs.schema["doc_id"].dataType
    fields = [("doc_id", id_type), ("piece", T.IntegerType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("ordinal", T.LongType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])
    pieces = scratch.table(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, with_ids), schema), "pieces")
    counts = scratch.table(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {row[0]: row[1] for row in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        keys, sequence, per, offset = shared.value
        size, number = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        k = np.searchsorted(keys, (size << 44) + number, side="right") - 1
        inside = number - (keys[k] - (size << 44))
        fields = [pa.array(sequence[k] + inside // per[k]), pa.array(offset[k] + inside % per[k] * size)]
        return pa.StructArray.from_arrays(fields, names=["sequence_id", "offset"])

    before = F.sum("n").over(_by_length()) - F.col("n")
    bases = counts.select(F.col("length").alias("__length"), F.col("part").alias("__part"), before.alias("__before"))
    # a row for each length in each partition: no key holds more pieces than one partition gave
    bases = F.broadcast(bases) if counts.count() <= BROADCAST_ROWS else bases.hint("merge")
    ranked = pieces.join(bases, (F.col("length") == F.col("__length")) & (F.col("part") == F.col("__part")))
    at = place(F.col("length"), F.col("__before") + F.col("ordinal"))
    ids = ["ids"] if with_ids else []
    out = ranked.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length", "ids_crc32", at.alias("at"), *ids)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *ids)


def _by_length():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
