"""Names of substrings, packed blocks of them for shuffles, and shard files that workers map."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from heddle.llm.elias_fano import U64, EliasFano

try:  # arrays of a megabyte or more go back to the system when freed, so a worker's memory follows its live arrays
    _LIBC = ctypes.CDLL(None)
    _LIBC.mallopt(-3, 1 << 20)
    _LIBC.malloc_trim(0)
    pa.set_memory_pool(pa.system_memory_pool())
except (AttributeError, OSError):
    _LIBC = None  # another C library


def keep_arrays() -> None:
    """Let a worker reuse the memory of freed arrays of up to 32 MB, for work that takes many of a like size."""
    if _LIBC is not None:
        _LIBC.mallopt(-3, 32 << 20)
        _LIBC.mallopt(-1, 64 << 20)


def drop_arrays() -> None:
    """The opposite: freed arrays of a megabyte or more go back at once, and what was kept goes back now."""
    if _LIBC is not None:
        _LIBC.mallopt(-3, 1 << 20)
    release()


def release() -> None:
    """Give what small freed objects held back to the system; called after each block."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


#: Keys summed at once in a worker.
BLOCK_KEYS = 1 << 20
#: Bytes of a batch that a worker sends.
BATCH_BYTES = 1 << 21
#: Files, and bytes of files, that a worker keeps mapped.
OPEN_SHARDS, OPEN_BYTES = 512, 1 << 26

#: Two polynomials, so that names have 128 bits: a base and a number for each byte value.
_BASES = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)
BYTE_CODES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1) for seed in (20, 21)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers_for(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base up to at least the n-th, and of its inverse."""
    if which not in _POWERS or n > len(_POWERS[which][0]):
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _POWERS[which] = _powers(_BASES[which], size), _powers(pow(_BASES[which], -1, 1 << 64), size)
    return _POWERS[which]


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.diff(np.append(starts, len(keys))) if counts is None else np.add.reduceat(counts, starts)
    return keys[starts], total.astype(np.int64)


def shard_of_hash(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hashes' high halves, so sorted hashes are grouped by shard."""
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def packed_rows(rows: list[tuple], names: tuple[str, ...] = ("shard", "keys", "counts")) -> Iterator[pa.RecordBatch]:
    """Rows of a number and binary blobs, in batches of about BATCH_BYTES."""
    start, size = 0, 0
    for k, row in enumerate(rows, 1):
        size += sum(map(len, row[1:]))
        if size >= BATCH_BYTES or k == len(rows):
            part = rows[start:k]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], pa.binary() if j else pa.int32()) for j in range(len(names))], names=list(names))
            start, size = k, 0


class Blocks:
    """Sums (shard, key) in bounded blocks and yields them as packed rows."""

    SCHEMA = "shard int, keys binary, counts binary"

    def __init__(self, shards: int, limit: int = BLOCK_KEYS):
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.shards, self.limit = shards, limit

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(keys)
        self.size += len(keys)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, counts = summed(np.concatenate(self.parts))
        self.parts, self.size = [], 0
        shards = shard_of_hash(keys, self.shards)
        edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
        rows = []
        for a, b in zip(edges, np.append(edges[1:], len(keys))):
            deltas = np.diff(keys[a:b], prepend=U64(0))
            rows.append((int(shards[a]), deltas.tobytes(), np.minimum(counts[a:b], (1 << 32) - 1).astype("<u4").tobytes()))
        yield from packed_rows(rows)
        del rows, keys, counts
        release()


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.cumsum(np.frombuffer(x, U64), dtype=U64) for x in table.column("keys").to_pylist()]
    counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("counts").to_pylist()]
    return summed(np.concatenate(keys), np.concatenate(counts))


class Store:
    """Files of arrays in the shared folder. Workers write and read them themselves: on a mounted folder they map them,
    elsewhere they read a file through ``pyarrow.fs`` into memory when it is first asked for. Nothing passes the driver."""

    def __init__(self, root: str):
        self.mounted = root.startswith("file:") or "://" not in root
        self.root = re.sub("^file:/*", "/", root) if self.mounted else root
        self.name = "store-" + uuid.uuid4().hex

    def pack(self, arrays: dict[str, np.ndarray]) -> bytes:
        """Eight-byte aligned arrays after a line that names them."""
        head, at = [], 0
        for name, array in arrays.items():
            head.append(f"{name} {array.dtype.str} {len(array)} {at}")
            at += -(-array.nbytes // 8) * 8
        line = ";".join(head).encode()
        line += b" " * (-(len(line) + 8) % 8)
        body = b"".join(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())
        return len(line).to_bytes(8, "little") + line + body

    def path(self, file: str) -> str:
        return f"{self.root}/{self.name}/{file}"

    def put(self, file: str, arrays: dict[str, np.ndarray]) -> str:
        """Writes the file under another name and then moves it, so that a task that is lost or run twice leaves either
        nothing or the whole file; its name."""
        system, target = (fs.LocalFileSystem(), self.path(file)) if self.mounted else fs.FileSystem.from_uri(self.path(file))
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        part = f"{target}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(self.pack(arrays))
        system.move(part, target)
        return file

    def _raw(self, file: str) -> np.ndarray | None:
        if self.mounted:
            return np.memmap(self.path(file), np.uint8, "r") if os.path.exists(self.path(file)) else None
        system, target = fs.FileSystem.from_uri(self.path(file))
        if system.get_file_info(target).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(target) as source:
            return np.frombuffer(source.read(), np.uint8)

    def open(self, file: str) -> dict[str, np.ndarray]:
        """The file's arrays; none where there is no such file, as for a shard without rows."""
        key = self.path(file)
        if key in _OPEN:
            _OPEN.move_to_end(key)
            return _OPEN[key]
        arrays: dict[str, np.ndarray] = {}
        raw = self._raw(file)
        if raw is not None:
            size = int(raw[:8].view("<u8")[0])
            body = np.asarray(raw[8 + size :])
            for entry in raw[8 : 8 + size].tobytes().decode().strip().split(";"):
                name, kind, n, at = entry.split(" ")
                kind = np.dtype(kind)
                arrays[name] = body[int(at) : int(at) + int(n) * kind.itemsize].view(kind)
        _OPEN[key] = arrays
        _SIZES[key] = 0 if raw is None else len(raw)
        while len(_OPEN) > OPEN_SHARDS or len(_OPEN) > 1 and sum(_SIZES.values()) > OPEN_BYTES:
            gone, _ = _OPEN.popitem(last=False)
            del _SIZES[gone]
        return arrays


_OPEN: OrderedDict[str, dict] = OrderedDict()
_SIZES: dict[str, int] = {}


def sequence(arrays: dict, name: str) -> EliasFano:
    if f"{name}!" not in arrays:
        arrays[f"{name}!"] = EliasFano.from_parts(arrays, name)
    return arrays[f"{name}!"]


def grouped(rows: DataFrame, build: Callable[[int, pa.Table], list[tuple]], schema: str, shards: int) -> DataFrame:
    """``build`` on the rows of each shard. There are as many partitions as shards, so a task's share does not grow with the
    data."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        drop_arrays()
        made = build(key[0].as_py(), table)
        release()
        kinds = [pa.int32() if k == "shard" else pa.int64() if t == "long" else pa.string() if t == "string" else pa.binary() for k, t in (x.split() for x in schema.split(", "))]
        return pa.table([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.repartition(max(1, shards), "shard").groupBy("shard").applyInArrow(run, schema)
