"""Removal of repeated byte strings through a sampled cover of positions and names of what stands around them.

A byte goes if a string of LENGTH bytes covers it that also starts earlier (in a smaller document, or earlier in the same).

The classic scheme sorts the suffixes at a difference cover of positions, recurses on their names and merges the remaining
suffixes with them. This operator keeps the idea of a cover and gives up the order of suffixes, which nothing here needs: only
equal strings of LENGTH bytes matter. No suffix is sorted and nothing recurses. The cover is taken from the content: of the
positions in a string, the one whose ANCHOR bytes hash least. Any two equal strings meet it after the same shift, and one
position in some 25 is sampled instead of two in three. The steps are

1. anchors: names of the sampled substrings are counted; those that occur only once in the corpus cannot lie in a repeated
   string and are dropped;
2. triples: an anchor is named together with what stands before and after it, which spans every string that has this
   anchor. Equal triples are grouped: all but the first repeat with all their strings, and need no more work;
3. strings: where one anchor has different triples, the strings of the first of each triple are named one by one and
   grouped; all but the first of equal ones repeat;
4. the strings found are united per document and cut out.

Before anything is shuffled each task settles what it can alone: of equal triples or names in a block only the first goes
on, and an anchor with many different triples is known to have several without sending them. So a passage that a third
of all documents share reaches its shard as a few rows per task.

Triples and strings are named by 128 bits (two polynomials): two different ones of n share a name with a chance of n^2 /
2^129. Anchors are named by 64 bits, which only choose what is looked at. No step pairs the members of a group, and no text
is shuffled. The number of shards follows from the bytes of the texts, so that one shard's rows fit a worker.

Odd input: a null text counts as empty; rows of one id and text are one document, so each gets the same result; texts under
one id are ordered by their hash; null ids come after all others. Ids that are no integers are ordered by a hash of their
text. A text shorter than LENGTH bytes is kept whole. A very long text is read in pieces. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.elias_fano import U64, EliasFano
from heddle.llm.shards import BYTE_CODES, Blocks, Store, grouped, merged, mixed, packed_rows, powers_for, release, sequence, shard_of_hash
from heddle.runtime import Scratch, ship_package

LENGTH = 100
ANCHOR = 51
#: Bytes sampled at once; a longer text is taken in pieces that overlap by what a string's context needs.
PIECE = 1 << 17
_PLACE = U64((1 << 20) - 1)
_LAST = np.iinfo(np.int64).max
_SCALE = U64(0x9E3779B97F4A7C15)

#: Bytes of text to a shard: a shard is compared in memory, so they are kept small.
SHARD_BYTES = 8 << 20
#: Triples of one anchor in a block of one task from which they bypass the anchor's shard.
CROWD = 64

#: One sampled position: its anchor's and its triple's name, the document, the anchor's start, and the first and last start
#: of the strings that have this anchor.
SAMPLE = np.dtype([("anchor", "<u8"), ("triple", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("key", "<u8"), ("at", "<u4"), ("low", "<u4"), ("high", "<u4")])
STRING = np.dtype([("name", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("key", "<u8"), ("at", "<u4")])
RANGE = np.dtype([("key", "<u8"), ("at", "<u4"), ("low", "<u4"), ("high", "<u4")])
PACKED = "shard int, rows binary"


class Names:
    """Names of substrings of a byte array from running sums of one of the two polynomials."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = powers_for(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODES[which][data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = (stop - start).astype(U64)
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + size * _SCALE)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def sample(data: np.ndarray, bounds: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
    """The cover of the strings that start in [first, last) and lie within one text (``bounds`` are the texts' edges).

    Arrays: number of the text, anchor's start, first and last string start, anchor's name, triple's name and its check.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64, U64, U64))
    last = min(last, len(data) - LENGTH + 1)
    if last <= first:
        return none
    names = Names(data)
    at = np.arange(first, last + LENGTH - ANCHOR, dtype=np.int64)
    anchors = names(at, at + ANCHOR)
    # equal hashes go to the leftmost, so the choice depends on the string alone
    chosen = _least((anchors & ~_PLACE) | (at - first).astype(U64), LENGTH - ANCHOR + 1)
    chosen = (chosen & _PLACE).astype(np.int64) + first
    starts = np.arange(first, last, dtype=np.int64)
    text = np.searchsorted(bounds, starts, side="right") - 1
    inside = np.flatnonzero(starts + LENGTH <= bounds[np.minimum(text + 1, len(bounds) - 1)])
    if not len(inside):
        return none
    starts, chosen, text = starts[inside], chosen[inside], text[inside]
    edges = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    low, high = starts[edges], starts[np.append(edges[1:], len(starts)) - 1]
    place, text = chosen[edges], text[edges]
    own = anchors[place - first]
    left = np.maximum(place - (LENGTH - ANCHOR), bounds[text])
    right = np.minimum(place + LENGTH, bounds[text + 1])
    triple = mixed(mixed(names(left, place) + _SCALE * own) + names(place + ANCHOR, right) * _SCALE)
    other = Names(data, 1)
    check = mixed(mixed(other(left, place) + _SCALE * other(place, place + ANCHOR)) + other(place + ANCHOR, right) * _SCALE)
    return text, place, low, high, own, triple, check


def sampled(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """``sample`` over whole texts: short ones together, long ones in overlapping pieces."""
    run: list[int] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        bounds = np.concatenate([[0], np.cumsum([len(texts[k]) for k in run])])
        data = np.frombuffer(b"".join(texts[k] for k in run), np.uint8)
        text, place, low, high, *names = sample(data, bounds, 0, len(data))
        begin = bounds[text]
        return np.array(run, np.int64)[text], place - begin, low - begin, high - begin, *names

    for k, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > PIECE:
            for first in range(0, len(text), PIECE):
                begin = max(0, first - LENGTH)
                stop = min(len(text), first + PIECE + 3 * LENGTH)
                data = np.frombuffer(text, np.uint8)[begin:stop]
                # an edge that is not the text's lies beyond any context of these strings
                found = sample(data, np.array([0, len(data)]), first - begin, first - begin + PIECE)
                yield np.full(len(found[0]), k), found[1] + begin, found[2] + begin, found[3] + begin, *found[4:]
            continue
        if size + len(text) > PIECE and run:
            yield joined()
            run, size = [], 0
        run.append(k)
        size += len(text)
    if run:
        yield joined()


def _texts(column: pa.Array) -> list[bytes]:
    return [raw or b"" for raw in column.cast(pa.binary()).to_pylist()]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _order(docs: DataFrame) -> Column:
    """The id, or where ids are no integers the hash of its text."""
    own = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return own.cast("long")
    return F.when(own.isNotNull(), F.xxhash64(own.cast("string")))


def doc_keys(ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
    whole = np.fromiter(map(xxhash.xxh64_intdigest, texts), U64, len(texts))
    return mixed(whole + ids.astype(U64) * _SCALE)


def _packed(rows: np.ndarray, shards: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows by shard, each column of a shard's rows one after another."""
    order = np.argsort(shards, kind="stable")
    rows, shards = rows[order], shards[order]
    edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(rows) else []
    stops = np.append(edges[1:], len(rows)).astype(int) if len(rows) else []
    return [(int(shards[a]), b"".join(np.ascontiguousarray(rows[a:b][name]).tobytes() for name in rows.dtype.names)) for a, b in zip(edges, stops)]


def _unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        n, at = len(blob) // kind.itemsize, 0
        part = np.empty(n, kind)
        for name in kind.names:
            field = kind.fields[name][0]
            part[name] = np.frombuffer(blob, field, n, at)
            at += n * field.itemsize
        parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, kind)


class _Sender:
    """Gathers rows, settles what one task can settle alone, and sends the rest in packed blocks.

    Shards from 0 on hold rows to compare, by the hash of a name; from ``shards`` on ranges to cut, from ``2 * shards`` on
    open ranges, both by document."""

    LIMIT = 1 << 17

    def __init__(self, shards: int, by: str, combine: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.shards, self.by, self.combine, self.parts, self.size = shards, by, combine, [], 0

    def add(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(rows)
        self.size += len(rows)
        if self.size >= self.LIMIT:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            send, cut, unsure = self.combine(np.concatenate(self.parts))
            self.parts, self.size = [], 0
            out = _packed(send, shard_of_hash(send[self.by], self.shards))
            for k, ranges in enumerate((_ranges(cut), _ranges(unsure)), 1):
                out += _packed(ranges, k * self.shards + shard_of_hash(ranges["key"], self.shards))
            del send, cut, unsure
            yield from packed_rows(out, ("shard", "rows"))
            del out
            release()


def _settled(shard: int, shards: int, table: pa.Table) -> list[tuple] | None:
    """Ranges that a sender settled, as rows (shard, kind, rows); None for a shard of rows to compare."""
    kind = shard // shards
    return [(shard % shards, ("cut", "open")[kind - 1], blob) for blob in table.column("rows").to_pylist()] if kind else None


def _distinct(rows: np.ndarray, names: list[str]) -> np.ndarray:
    """Sorted by the named columns, without repeats."""
    rows = rows[np.lexsort([rows[name] for name in reversed(names)])]
    if len(rows):
        rows = rows[np.concatenate([[True], rows[1:] != rows[:-1]])]
    return rows


def _triples(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rows, marks of those at the place of their triple's first, each row's anchor, and its triple's number within
    the anchor."""
    rows = _distinct(rows, ["anchor", "triple", "check", "doc", "key", "at", "low", "high"])
    if not len(rows):
        return rows, np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh_anchor = np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]])
    fresh = fresh_anchor | np.concatenate([[True], (rows["triple"][1:] != rows["triple"][:-1]) | (rows["check"][1:] != rows["check"][:-1])])
    head = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
    leading = (rows["key"] == head["key"]) & (rows["at"] == head["at"])
    anchor, nth = np.cumsum(fresh_anchor) - 1, np.cumsum(fresh) - 1
    return rows, leading, anchor, nth - nth[np.flatnonzero(fresh_anchor)][anchor]


def compare_triples(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, open) of the samples of whole anchors: where a triple stood before, all its strings repeat; the first of
    each triple of an anchor that has several is open."""
    rows, leading, anchor, nth = _triples(rows)
    several = np.zeros(int(anchor[-1]) + 1 if len(rows) else 0, bool)
    several[anchor[nth > 0]] = True
    return rows[~leading], rows[leading & several[anchor]]


def combine_triples(rows: np.ndarray, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(to send, repeated, open) of one task's samples: only the first of equal triples goes on; and of an anchor with
    more than ``crowd`` triples here, which is then known to have several, two go on for all, and all are open."""
    rows, leading, anchor, nth = _triples(rows)
    crowded = np.zeros(int(anchor[-1]) + 1 if len(rows) else 0, bool)
    crowded[anchor[nth >= crowd]] = True
    many = crowded[anchor]
    return rows[leading & (~many | (nth < 2))], rows[~leading], rows[leading & many]


def compare_strings(rows: np.ndarray) -> np.ndarray:
    """The strings whose name stood before."""
    return combine_strings(rows)[1]


def combine_strings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first of each name, the others, none open)."""
    rows = _distinct(rows, ["name", "check", "doc", "key", "at"])
    again = np.concatenate([[False], (rows["name"][1:] == rows["name"][:-1]) & (rows["check"][1:] == rows["check"][:-1])]) if len(rows) else np.zeros(0, bool)
    return rows[~again], rows[again], rows[:0]


def _ranges(rows: np.ndarray) -> np.ndarray:
    """Samples or single strings as ranges of string starts."""
    out = np.empty(len(rows), RANGE)
    single = "low" not in rows.dtype.names
    out["key"], out["at"] = rows["key"], 0 if single else rows["at"]
    out["low"], out["high"] = (rows["at"], rows["at"]) if single else (rows["low"], rows["high"])
    return out


def _by_document(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted document keys, where each one's ranges begin, and the ranges."""
    rows = _distinct(rows, ["key", "low", "high", "at"])
    fresh = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    return {"keys": rows["key"][fresh].copy(), "begin": np.append(fresh, len(rows)), "low": rows["low"].copy(), "high": rows["high"].copy()}


def _look_up(store: Store, kind: str, shards: int, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | None]:
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for key, shard in zip(keys, shard_of_hash(keys, shards).tolist()):
        arrays = store.open(f"{kind}-{shard}")
        k = int(np.searchsorted(arrays["keys"], key)) if arrays else 0
        if not arrays or k == len(arrays["keys"]) or arrays["keys"][k] != key:
            out.append(None)
        else:
            a, b = int(arrays["begin"][k]), int(arrays["begin"][k + 1])
            out.append((arrays["low"][a:b], arrays["high"][a:b]))
    return out


def united(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start in the ranges [low, high]."""
    order = np.argsort(low, kind="stable")
    begin, stop = low[order].astype(np.int64), high[order].astype(np.int64) + LENGTH
    reach = np.maximum.accumulate(stop)
    cuts = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return list(zip(begin[cuts].tolist(), reach[np.append(cuts[1:], len(begin)) - 1].tolist()))


def cut_out(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """(bytes, removed bytes, runs, SHA-256 of what is left)."""
    digest, at, removed = hashlib.sha256(), 0, 0
    for begin, stop in runs:
        digest.update(text[at:begin])
        removed += stop - begin
        at = stop
    digest.update(text[at:])
    return len(text), removed, len(runs), digest.hexdigest()


def repeated(docs: DataFrame, scratch: Scratch, shards: int | None = None) -> tuple[Store, int]:
    """Finds all repeated strings of (doc_id, text); the store has each document's ranges under ``cut``."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(_order(docs).alias("doc_id"), "text")
    if shards is None:
        shards = -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES) or 1
    store = Store(scratch.root)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(shards, 1 << 18)
        for batch in batches:
            for found in sampled(_texts(batch.column(1))):
                yield from blocks.add(found[4])
        yield from blocks.flush()

    def twice(shard: int, table: pa.Table) -> list[tuple]:
        keys, counts = merged(table)
        keys = keys[counts > 1]
        if not len(keys):
            return []
        return [(shard, store.put(f"anchor-{shard}", {"first": keys[:1]} | EliasFano.build(keys - keys[0]).parts("keys")))]

    made = "shard int, file string"
    scratch.table(grouped(docs.mapInArrow(anchors, Blocks.SCHEMA), twice, made, shards), "anchors")

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(shards, "anchor", combine_triples)
        for batch in batches:
            texts, ids = _texts(batch.column(1)), _ids(batch.column(0))
            keys = doc_keys(ids, texts)
            found = list(sampled(texts))
            if found:  # the whole batch at once, so that each shard is asked once
                text, at, low, high, own, triple, check = (np.concatenate(x) for x in zip(*found))
                kept = np.zeros(len(own), bool)
                of = shard_of_hash(own, shards)
                order = np.argsort(of, kind="stable")
                edges = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(order) else []
                for a, b in zip(edges, np.append(edges[1:], len(order)).astype(int) if len(order) else []):
                    arrays = store.open(f"anchor-{of[order[a]]}")
                    if arrays:
                        kept[order[a:b]] = sequence(arrays, "keys").find(own[order[a:b]] - U64(arrays["first"][0])) >= 0
                rows = np.empty(int(kept.sum()), SAMPLE)
                for name, values in (("anchor", own), ("triple", triple), ("check", check), ("doc", ids[text]), ("key", keys[text]), ("at", at), ("low", low), ("high", high)):
                    rows[name] = values[kept]
                yield from sender.add(rows)
        yield from sender.flush()

    def triples(shard: int, table: pa.Table) -> list[tuple]:
        settled = _settled(shard, shards, table)
        if settled is not None:
            return settled
        again, unsure = compare_triples(_unpacked(table.column("rows").to_pylist(), SAMPLE))
        out = [(s, "cut", b) for s, b in _packed(_ranges(again), shard_of_hash(again["key"], shards))]
        return out + [(s, "open", b) for s, b in _packed(_ranges(unsure), shard_of_hash(unsure["key"], shards))]

    sorted_triples = scratch.table(grouped(docs.mapInArrow(samples, PACKED), triples, "shard int, kind string, rows binary", 3 * shards), "triples")

    def filed(kind: str):
        def run(shard: int, table: pa.Table) -> list[tuple]:
            rows = _unpacked(table.column("rows").to_pylist(), RANGE)
            return [(shard, store.put(f"{kind}-{shard}", _by_document(rows)))]

        return run

    scratch.table(grouped(sorted_triples.where("kind = 'open'").select("shard", "rows"), filed("open"), made, shards), "open")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(shards, "name", combine_strings)
        for batch in batches:
            texts, ids = _texts(batch.column(1)), _ids(batch.column(0))
            keys = doc_keys(ids, texts)
            for k, found in enumerate(_look_up(store, "open", shards, keys)):
                if found is None:
                    continue
                low, high = found[0].astype(np.int64), found[1].astype(np.int64)
                for a in range(0, len(low), 2048):
                    parts = [texts[k][x : y + LENGTH] for x, y in zip(low[a : a + 2048].tolist(), high[a : a + 2048].tolist())]
                    begin = np.cumsum([0, *map(len, parts)])[:-1]
                    n = high[a : a + 2048] - low[a : a + 2048] + 1
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start = np.repeat(begin, n) + inner
                    rows = np.empty(len(start), STRING)
                    data = np.frombuffer(b"".join(parts), np.uint8)
                    rows["name"], rows["check"] = (Names(data, which)(start, start + LENGTH) for which in (0, 1))
                    rows["doc"], rows["key"], rows["at"] = ids[k], keys[k], np.repeat(low[a : a + 2048], n) + inner
                    yield from sender.add(rows)
        yield from sender.flush()

    def names(shard: int, table: pa.Table) -> list[tuple]:
        settled = _settled(shard, shards, table)
        if settled is not None:
            return settled
        again = _ranges(compare_strings(_unpacked(table.column("rows").to_pylist(), STRING)))
        return [(s, "cut", b) for s, b in _packed(again, shard_of_hash(again["key"], shards))]

    sorted_strings = scratch.table(grouped(docs.mapInArrow(strings, PACKED), names, "shard int, kind string, rows binary", 3 * shards), "strings")
    cuts = sorted_triples.unionByName(sorted_strings).where("kind = 'cut'").select("shard", "rows")
    scratch.table(grouped(cuts, filed("cut"), made, shards), "cuts")
    return store, shards


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    store, shards = repeated(docs, Scratch(docs.sparkSession, "suffix-dedup"))

    @F.arrow_udf(f"struct<{DIGEST.replace(' long', ':bigint').replace(' string', ':string')}>")
    def digest(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        texts = _texts(text)
        found = _look_up(store, "cut", shards, doc_keys(_ids(doc_id), texts))
        rows = [cut_out(t, united(*f) if f else []) for t, f in zip(texts, found)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select("doc_id", digest(_order(docs), F.col("text")).alias("d")).select("doc_id", "d.*")


def removed_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, stop) of every maximal run of repeated bytes."""
    store, shards = repeated(docs, Scratch(docs.sparkSession, "suffix-dedup"))

    @F.arrow_udf("array<struct<begin:bigint,stop:bigint>>")
    def runs(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        found = _look_up(store, "cut", shards, doc_keys(_ids(doc_id), _texts(text)))
        rows = [[{"begin": a, "stop": b} for a, b in united(*f)] if f else [] for f in found]
        return pa.array(rows, pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])))

    return docs.select("doc_id", F.explode(runs(_order(docs), F.col("text"))).alias("r")).select("doc_id", "r.begin", "r.stop")
