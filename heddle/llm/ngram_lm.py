"""LM scoring: an Elias-Fano n-gram trie with quantised smoothed probabilities in memory-mapped levels.

Words are numbered by shard and, within a shard, by the 128-bit hash of their bytes. Level 1 of a shard is the sorted high
halves of the hashes in Elias-Fano form, the low halves as a check, and exact counts. Level k > 1 holds for each
(k-1)-gram a range of following word numbers. Ranges are bounded by monotone pointers and the numbers are made monotone by
adding the number of all words for each context, both in Elias-Fano form. A word is found by successor search relative to
its context: the value at which the context's range begins, plus the word's number.

Each n-gram has its absolutely discounted share of its context and, as a context, the weight it leaves to shorter ones,
both as one-byte codes of a code book; a token's probability interpolates them from single words up. Every n-gram seen in
training is kept; ``keep_from`` above 1 prunes those of two or more words seen less often.

All n-grams of the greatest order are counted once, over all training documents; shorter ones are their beginnings (texts
are padded after the end for that). Each task sorts and sums blocks of its own n-grams, which are shuffled as packed trees
by shard and merged. An n-gram's shard is that of its first word. A word that alone fills more than a shard is dealt over as
many shards as it fills, by its second word. The number of shards follows from the bytes of the training texts.

The shards are files in the shared folder that workers map, so memory holds only what queries touch; the n-grams of a run
of texts are looked up once each and in order.

Odd input: a null text counts as empty, which is the end token alone; null ids are not held out and not learned from;
repeated rows are learned as often as they occur; without training rows N, V and all counts are 0. Extra columns are not
read. A very long text is one row of word numbers in a worker's memory, four bytes each. Equal texts score equally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.elias_fano import U64, EliasFano, quantise
from heddle.llm.shards import Store, drop_arrays, grouped, keep_arrays, packed_rows, release, sequence, shard_of_hash
from heddle.runtime import Scratch, ship_package

ORDER = 3
LONGEST_ORDER = 5
KEEP_FROM = 1
DISCOUNT = 0.75
#: Bytes of training text to a shard (some million tokens), which bounds what one task merges.
SHARD_BYTES = 6 << 20
#: Bytes of text split at once, tokens counted or looked up at once, and words gathered before they are summed and sent.
CHUNK_BYTES = 1 << 22
CHUNK_TOKENS = 1 << 18
BLOCK_WORDS = 1 << 20
#: The end token; words are never empty.
END = b""
_UNKNOWN = np.iinfo(np.uint32).max


def encoded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens, all tokens as their numbers there, and the tokens of each text: words between ASCII white space with
    A-Z lower-cased, then the end token (the last of the distinct ones)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string(), safe=False).fill_null("")))
    words = lists.flatten()
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at either end gives empty pieces
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes = np.diff(np.concatenate([[0], np.cumsum(some)])[bounds])
    coded = words.filter(pa.array(some)).dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary())
    data = (names.buffers()[2] or b"") and names.buffers()[2].to_pybytes()
    edges = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1].tolist() if len(names) else []
    distinct = [data[a:b] for a, b in zip(edges, edges[1:])]
    out = np.full(len(coded) + len(sizes), len(distinct), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = coded.indices.to_numpy(zero_copy_only=False)
    return [*distinct, END], out, sizes + 1


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(U64)
    return raw[::2], raw[1::2]


def _edges(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    begins = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return begins, np.append(begins[1:], len(sorted_values)) if len(begins) else begins


class Trie:
    """Where the levels are, and the few words that are dealt over several shards; small enough for every task."""

    def __init__(self, store: Store, bases: np.ndarray, total: int, order: int, hot: np.ndarray, hot_counts: np.ndarray, shard_tokens: float):
        self.store, self.bases, self.total, self.order = store, bases, total, order
        self.shards = len(bases) - 1
        self.hot, self.hot_counts, self.hot_left = hot, hot_counts, np.ones(len(hot))
        self.hot_spread = np.minimum(np.ceil(hot_counts / max(1.0, shard_tokens)).astype(np.int64), self.shards)

    @property
    def distinct(self) -> int:
        return int(self.bases[-1])

    def shard_of_word(self, numbers: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.bases, numbers, side="right") - 1, self.shards - 1)

    def _hot_place(self, numbers: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.hot, numbers), max(0, len(self.hot) - 1))
        return np.where(self.hot[place] == numbers, place, -1) if len(self.hot) else np.full(len(numbers), -1, np.int64)

    def shard_of_pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        shards = self.shard_of_word(first)
        if len(self.hot):
            place = self._hot_place(first)
            rows = np.flatnonzero(place >= 0)
            shards[rows] = (shards[rows] + self.shard_of_word(second[rows]) * self.hot_spread[place[rows]] // self.shards) % self.shards
        return shards

    def hot_of(self, shard: int) -> np.ndarray:
        """The dealt words that have n-grams in ``shard``, in order."""
        return self.hot[(shard - self.shard_of_word(self.hot)) % self.shards < self.hot_spread] if len(self.hot) else self.hot

    def contexts_of(self, shard: int, first: np.ndarray) -> np.ndarray:
        """Places of words as contexts in a shard: its own by rank, then the dealt ones."""
        out = first - self.bases[shard]
        if len(self.hot):
            dealt = np.flatnonzero(self._hot_place(first) >= 0)
            out[dealt] = self.bases[shard + 1] - self.bases[shard] + np.searchsorted(self.hot_of(shard), first[dealt])
        return out

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1 if unseen) and counts of distinct words."""
        high, low = word_hashes(words)
        numbers, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        order = np.argsort(high)
        shards = shard_of_hash(high[order], self.shards)
        for a, b in zip(*_edges(shards)):
            arrays = self.store.open(f"words-{shards[a]}")
            if not arrays:
                continue
            rows = order[a:b]
            place = sequence(arrays, "words").find(high[rows] - U64(arrays["first"][0]))
            seen = np.flatnonzero(place >= 0)
            rows, place = rows[seen], place[seen]
            for step in range(int(arrays["ties"][0])):  # words that share the high half stand together
                at = np.minimum(place + step, len(arrays["check"]) - 1)
                same = np.flatnonzero(arrays["check"][at] == low[rows])
                numbers[rows[same]] = at[same] + self.bases[shards[a]]
                counts[rows[same]] = arrays["counts"][at[same]]
        return numbers, counts

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of sorted word numbers; unknown ones (-1) have 0."""
        counts = np.zeros(len(numbers), np.int64)
        known = np.searchsorted(numbers, 0)
        shards = self.shard_of_word(numbers[known:])
        for a, b in zip(*_edges(shards)):
            counts[known + a : known + b] = self.store.open(f"words-{shards[a]}")["counts"][numbers[known + a : known + b] - self.bases[shards[a]]]
        return counts

    def share(self, counts: np.ndarray) -> np.ndarray:
        """A word's smoothed share, from its count."""
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def left_by_word(self, numbers: np.ndarray) -> np.ndarray:
        """What each of the sorted word numbers, as a context, leaves to single words."""
        out = np.ones(len(numbers))
        known = np.searchsorted(numbers, 0)
        shards = self.shard_of_word(numbers[known:])
        for a, b in zip(*_edges(shards)):
            arrays = self.store.open(f"grams-{shards[a]}")
            if arrays:
                own = numbers[known + a : known + b] - self.bases[shards[a]]
                out[known + a : known + b] = arrays["left1.book"][arrays["left1.codes"][own]]
        if len(self.hot):
            place = self._hot_place(numbers)
            out[place >= 0] = self.hot_left[place[place >= 0]]
        return out

    def step(self, level: int, shards: np.ndarray, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, share, weight left) in ``level`` of the n-grams (context's place in the level below, word), best given
        in order; -1, 0 and 1 where there is none. For level 2 the contexts are word numbers."""
        places, share, left = np.full(len(words), -1, np.int64), np.zeros(len(words)), np.ones(len(words))
        order = None
        if len(shards) and (shards[1:] < shards[:-1]).any():
            order = np.argsort(shards, kind="stable")
            shards, contexts, words = shards[order], contexts[order], words[order]
        for a, b in zip(*_edges(shards)):
            arrays = self.store.open(f"grams-{shards[a]}")
            if not arrays:
                continue
            at = contexts[a:b] if level > 2 else self.contexts_of(int(shards[a]), contexts[a:b])
            found = _successors(arrays, level, at, words[a:b])
            hit = np.flatnonzero(found >= 0)
            rows = a + hit if order is None else order[a + hit]
            found = found[hit]
            places[rows] = found
            share[rows] = arrays[f"share{level}.book"][arrays[f"share{level}.codes"][found]]
            if level < self.order:
                left[rows] = arrays[f"left{level}.book"][arrays[f"left{level}.codes"][found]]
        return places, share, left

    def score(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each token; ``starts`` marks the first tokens of texts."""
        own, back = np.unique(numbers, return_inverse=True)
        chance = self.share(self.counts_of(own))[back]
        if not self.total:
            return np.log10(chance)
        n = len(own)
        open_ = np.flatnonzero(~starts & (numbers >= 0) & np.concatenate([[False], numbers[:-1] >= 0]))
        # a context counts even where the next word is unknown
        after = np.flatnonzero(~starts & np.concatenate([[False], numbers[:-1] >= 0]))
        chance[after] *= self.left_by_word(own)[back[after - 1]]
        keys, at = np.unique(back[open_ - 1] * n + back[open_], return_inverse=True)
        first, second = own[keys // n], own[keys % n]
        shards = self.shard_of_pair(first, second)
        places, share, left = self.step(2, shards, first, second)
        chance[open_] += share[at]
        gram = np.full(len(numbers), -1, np.int64)  # number of the n-gram of the last level that ends at a token
        gram[open_] = np.where(places >= 0, np.arange(len(keys)), -1)[at]
        for level in range(3, self.order + 1):
            before = np.concatenate([[-1], gram[:-1]])
            before[starts] = -1
            after = np.flatnonzero(before >= 0)
            chance[after] *= left[before[after]]
            open_ = after[numbers[after] >= 0]
            keys, at = np.unique(before[open_] * n + back[open_], return_inverse=True)
            under = keys // n
            shards_, contexts = shards[under], places[under]
            places, share, left = self.step(level, shards_, contexts, own[keys % n])
            shards = shards_
            chance[open_] += share[at]
            gram = np.full(len(numbers), -1, np.int64)
            gram[open_] = np.where(places >= 0, np.arange(len(keys)), -1)[at]
        return np.log10(chance)


def _successors(arrays: dict, level: int, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the words in their contexts' ranges, -1 where they are not."""
    pointers, grams, width = sequence(arrays, f"pointers{level}"), sequence(arrays, f"grams{level}"), int(arrays["width"][0])
    out = np.full(len(words), -1, np.int64)
    if not grams.n:
        return out
    order = None
    if (contexts[1:] < contexts[:-1]).any():
        order = np.argsort(contexts, kind="stable")
        contexts, words = contexts[order], words[order]
    begins, stops = _edges(contexts)  # each context's range is fetched once
    begin, end = pointers.ranges(contexts[begins])
    some = np.repeat(end > begin, stops - begins)
    found = np.full(len(words), -1, np.int64)
    found[some] = grams.find((contexts[some] * width + words[some]).astype(U64))
    found[found >= np.repeat(end, stops - begins)] = -1
    if order is None:
        return found
    out[order] = found
    return out


# --- trees of n-grams ---------------------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers by byte place, which compresses well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(blob: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n).reshape(4, n).T).reshape(-1).view("<u4")


def _packed_tree(first: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray) -> bytes:
    """First words of the pairs, then (parents, words) of each level, parents as children per parent."""
    head = np.array([len(levels), *[len(words) for _, words in levels]], "<i8").tobytes()
    parts = [head, _planes(np.diff(first, prepend=0))]
    above = len(first)
    for k, (parents, words) in enumerate(levels):
        if k:
            parts.append(_planes(np.bincount(parents, minlength=above)))
        parts.append(_planes(words))
        above = len(words)
    parts.append(_planes(np.minimum(counts, _UNKNOWN)))
    return b"".join(parts)


def _unpacked_tree(blob: bytes) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    view = memoryview(blob)
    depth = int(np.frombuffer(view, "<i8", 1)[0])
    sizes = np.frombuffer(view, "<i8", depth, 8).tolist()
    at = 8 * (depth + 1)

    def take(n: int) -> np.ndarray:
        nonlocal at
        out = _from_planes(view[at : at + 4 * n], n)
        at += 4 * n
        return out

    first = np.cumsum(take(sizes[0]), dtype="<u4").astype(np.int64)
    levels: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, "<u4"), take(sizes[0]))]
    for k in range(1, depth):
        parents = np.repeat(np.arange(sizes[k - 1], dtype="<u4"), take(sizes[k - 1]))
        levels.append((parents, take(sizes[k])))
    return first, levels, take(sizes[-1])


def _counted(numbers: np.ndarray, sizes: np.ndarray, trie: Trie) -> Iterator[tuple[int, bytes]]:
    """A run of texts as one packed tree for each shard. Texts end with the end token; after it comes padding, the number
    behind the last word's, so that every n-gram begins one of the greatest order."""
    order = trie.order
    ends = np.cumsum(sizes)
    padded = np.full(len(numbers) + len(sizes) * (order - 2), trie.distinct, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(numbers)) + text * (order - 2)
    padded[place] = numbers
    begins = np.delete(place, ends - 1)  # the end token begins nothing
    if not len(begins):
        return
    own, back = np.unique(padded, return_inverse=True)
    n = len(own)
    keys, rank = np.unique(back[begins] * n + back[begins + 1], return_inverse=True)
    first, words = own[keys // n], own[keys % n]
    shards = trie.shard_of_pair(first, words)
    if (shards[1:] < shards[:-1]).any():
        by_shard = np.argsort(shards, kind="stable")
        first, words, shards = first[by_shard], words[by_shard], shards[by_shard]
        moved = np.empty(len(by_shard), np.int64)
        moved[by_shard] = np.arange(len(by_shard))
        rank = moved[rank]
    levels = [(np.arange(len(words)), words)]
    for level in range(3, order + 1):
        keys, rank = np.unique(rank * n + back[begins + level - 1], return_inverse=True)
        levels.append((keys // n, own[keys % n]))
    counts = np.bincount(rank)
    for a, b in zip(*_edges(shards)):
        shard, part, low, high = int(shards[a]), [(np.arange(b - a), words[a:b])], a, b
        for parents, following in levels[1:]:
            base = low
            low, high = np.searchsorted(parents, [low, high])
            part.append((parents[low:high] - base, following[low:high]))
        yield shard, _packed_tree(first[a:b], part, counts[low:high])


def _merged(blobs: list[bytes], contexts_of) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """One tree of many: (contexts or parents, words) of each level in order, and the counts of the last."""
    trees = [_unpacked_tree(blob) for blob in blobs]
    blobs.clear()
    depth = len(trees[0][1])
    out, rank = [], contexts_of(np.concatenate([tree[0] for tree in trees])).astype("<u4")
    for level in range(depth):
        if level:
            sizes = [len(tree[1][level - 1][1]) for tree in trees]
            offsets = np.cumsum([0, *sizes[:-1]])
            rank = np.concatenate([rank[o : o + n][tree[1][level][0]] for tree, o, n in zip(trees, offsets, sizes)])
        keys = rank.astype(U64)
        keys <<= U64(32)
        keys |= np.concatenate([tree[1][level][1] for tree in trees])
        order = np.argsort(keys)
        keys = keys[order]
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank = np.empty(len(keys), "<u4")
        rank[order] = np.cumsum(fresh, dtype="<u4") - np.uint32(1)
        del order
        keys = keys[fresh]
        out.append(((keys >> U64(32)).astype(np.int64), (keys & U64(_UNKNOWN)).astype(np.int64)))
        del keys, fresh
    counts = np.bincount(rank, np.concatenate([tree[2] for tree in trees])).astype(np.int64)
    return out, counts


def _built(levels: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, word_counts: np.ndarray, own: int, padding: int, keep_from: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Arrays of a shard's levels from 2 on, and what the n-grams of each dealt word hold of its count.

    ``word_counts`` are the counts of the contexts of level 2; the first ``own`` of them are the shard's own words.
    """
    by_level = [counts]
    for parents, _ in reversed(levels[1:]):
        by_level.insert(0, np.bincount(parents, by_level[0]).astype(np.int64))
    arrays = {"width": np.array([padding])}
    totals, kept_above = word_counts, None
    dealt = np.zeros(0)
    for level, ((parents, words), seen) in enumerate(zip(levels, by_level), 2):
        keep = (words != padding) & (seen >= keep_from)
        if kept_above is not None:  # places of the kept contexts
            place = np.cumsum(kept_above) - 1
            keep &= kept_above[parents]
            parents = place[parents]
        parents, words, kept = parents[keep], words[keep], seen[keep]
        share = (kept - DISCOUNT) / totals[parents]
        held = np.bincount(parents, share, minlength=len(totals))
        left = np.clip(1 - held, 1e-9, 1.0)
        if level == 2:
            left, dealt = left[:own], held[own:]
        per = np.bincount(parents, minlength=len(totals))
        pointers = np.concatenate([[0], np.cumsum(per)])
        grams = parents * padding + words  # the padding's number is that of all words
        arrays |= EliasFano.build(pointers).parts(f"pointers{level}") | EliasFano.build(grams).parts(f"grams{level}")
        for name, values in ((f"left{level - 1}", left), (f"share{level}", share)):
            arrays[f"{name}.codes"], book = quantise(np.log10(values))
            arrays[f"{name}.book"] = 10 ** book.astype(np.float64)
        totals, kept_above = kept, keep
    return arrays, dealt


# --- jobs ---------------------------------------------------------------------------------------------------------------


def _token_runs(column: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """``encoded`` of runs of whole texts of about CHUNK_BYTES."""
    begin, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for k, n in enumerate(lengths.tolist(), 1):
        size += n
        if size >= CHUNK_BYTES or k == len(lengths):
            yield encoded(column.slice(begin, k - begin))
            begin, size = k, 0


def _number_runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """(batches, word numbers or -1, tokens of each text) of runs of batches of about CHUNK_TOKENS tokens."""
    held: list[pa.RecordBatch] = []
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def joined() -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]:
        numbers = np.concatenate(parts).astype(np.int64)
        numbers[numbers == _UNKNOWN] = -1
        return held, numbers, np.concatenate(sizes)

    for batch in batches:
        if not batch.num_rows:
            continue
        packed = batch.column(column).cast(pa.large_binary())
        offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
        parts.append(np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view("<u4"))
        sizes.append(np.diff(offsets) // 4)
        held.append(batch)
        if sum(map(len, parts)) >= CHUNK_TOKENS:
            yield joined()
            held, parts, sizes = [], [], []
    if held:
        yield joined()


def build(docs: DataFrame, training: Column, scratch: Scratch, order: int = ORDER, keep_from: int = KEEP_FROM, shards: int | None = None) -> tuple[Trie, DataFrame]:
    """The trie learned from the rows where ``training`` holds, and all rows as word numbers:
    (doc_id, learned, n_tokens, n_known, base_score, numbers)."""
    spark = docs.sparkSession
    ship_package(spark)
    if not 2 <= order <= LONGEST_ORDER:
        raise ValueError(f"order is 2 to {LONGEST_ORDER}")
    learned = docs.where(training).select("text")
    size = int(learned.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0)
    shards = shards or -(-size // SHARD_BYTES) or 1
    store = Store(scratch.root)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            held.clear()
            words, numbers = table.column("word").to_pylist(), table.column("n_sum").to_numpy()
            high, _ = word_hashes(words)
            by_shard = np.argsort(high)
            of = shard_of_hash(high[by_shard], shards)
            rows = []
            for a, b in zip(*_edges(of)):
                picked = by_shard[a:b]
                rows.append((int(of[a]), b" ".join(map(words.__getitem__, picked.tolist())), numbers[picked].tobytes()))
            yield from packed_rows(rows)
            release()

        for batch in batches:
            for words, codes, _ in _token_runs(batch.column(0)):
                held.append(pa.table({"word": pa.array(words, pa.binary()), "n": np.bincount(codes, minlength=len(words))}))
                if sum(map(len, held)) >= BLOCK_WORDS:
                    yield from flush()
        if held:
            yield from flush()

    def words_of(shard: int, table: pa.Table) -> list[tuple]:
        total: dict[bytes, int] = {}
        for names, raw in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
            for word, n in zip(names.split(b" "), np.frombuffer(raw, np.int64).tolist()):
                total[word] = total.get(word, 0) + n
        words, counts = list(total), np.fromiter(total.values(), np.int64, len(total))
        high, low = word_hashes(words)
        by_hash = np.lexsort([low, high])
        high, low, counts = high[by_hash], low[by_hash], counts[by_hash]
        begins, stops = _edges(high)
        arrays = {"first": high[:1], "ties": np.array([(stops - begins).max()]), "check": low, "counts": counts}
        arrays |= EliasFano.build(high - high[0]).parts("words")
        big = np.flatnonzero(counts > size // (16 * shards))  # a few for each shard
        hot = np.stack([big, counts[big]]).astype(np.int64).tobytes()
        return [(shard, len(counts), int(counts.sum()), store.put(f"words-{shard}", arrays), hot)]

    schema = "shard int, n long, total long, file string, hot binary"
    blocks = learned.mapInArrow(count_words, "shard int, keys binary, counts binary")
    made = scratch.table(grouped(blocks, words_of, schema, shards), "words").select("shard", "n", "total", "hot").collect()  # a row per shard
    held = np.zeros(shards, np.int64)
    for row in made:
        held[row["shard"]] = row["n"]
    bases = np.concatenate([[0], np.cumsum(held)]).astype(np.int64)
    if bases[-1] >= _UNKNOWN - 1:
        raise ValueError("more than 2^32 distinct words")
    total = sum(row["total"] for row in made)
    big = [np.frombuffer(row["hot"], np.int64).reshape(2, -1) + np.array([[bases[row["shard"]]], [0]]) for row in sorted(made, key=lambda r: r["shard"])]
    hot, hot_counts = np.concatenate(big, axis=1) if big else np.zeros((2, 0), np.int64)
    filling = hot_counts > total / shards
    trie = Trie(store, bases, total, order, hot[filling], hot_counts[filling], total / shards)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arrays()
        for batch in batches:
            n_tokens, n_known, base, packed = [], [], [], []
            for words, codes, sizes in _token_runs(batch.column(2)):
                own, counts = trie.words(words)
                starts = np.cumsum(sizes) - sizes
                n_tokens.append(sizes)
                n_known.append(np.add.reduceat((counts > 0).astype(np.int64)[codes], starts))
                base.append(np.add.reduceat(np.log10(trie.share(counts))[codes], starts))
                numbers = np.where(own < 0, _UNKNOWN, own).astype("<u4")[codes].tobytes()
                packed += [numbers[4 * s : 4 * (s + n)] for s, n in zip(starts.tolist(), sizes.tolist())]
            if packed:
                columns = [pa.array(np.concatenate(x)) for x in (n_tokens, n_known, base)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(packed, pa.binary())], names=["doc_id", "learned", "n_tokens", "n_known", "base_score", "numbers"])
        drop_arrays()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("learned"), "text").mapInArrow(numbered, f"doc_id {id_type}, learned boolean, n_tokens long, n_known long, base_score double, numbers binary")
    rows = scratch.table(rows, "numbers")

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arrays()
        for _, numbers, sizes in _number_runs(batches, 0):
            yield from packed_rows(list(_counted(numbers, sizes, trie)), ("shard", "tree"))
        drop_arrays()

    def grams_of(shard: int, table: pa.Table) -> list[tuple]:
        levels, counts = _merged(table.column("tree").to_pylist(), lambda first: trie.contexts_of(shard, first))
        words, hot = store.open(f"words-{shard}"), trie.hot_of(shard)
        own = words["counts"].astype(np.int64) if words else np.zeros(0, np.int64)
        of_hot = trie.hot_counts[np.searchsorted(trie.hot, hot)]
        arrays, dealt = _built(levels, counts, np.concatenate([own, of_hot]), len(own), trie.distinct, keep_from)
        return [(shard, len(counts), int(counts.sum()), store.put(f"grams-{shard}", arrays), np.stack([hot.astype(np.float64), dealt]).tobytes())]

    trees = rows.where("learned").select("numbers").mapInArrow(count_grams, "shard int, tree binary")
    grams = scratch.table(grouped(trees, grams_of, schema, shards), "grams").select("hot").collect()  # a row per shard
    held_by = np.zeros(len(trie.hot))
    for row in grams:
        of, part = np.frombuffer(row["hot"], np.float64).reshape(2, -1)
        np.add.at(held_by, np.searchsorted(trie.hot, of.astype(np.int64)), part)
    trie.hot_left = np.clip(1 - held_by, 1e-9, 1.0)
    return trie, rows


def score(trie: Trie, rows: DataFrame) -> DataFrame:
    """``rows`` of ``build`` with ``score``, the text's log10 probability, in place of the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arrays()
        for held, numbers, sizes in _number_runs(batches, 5):
            begins = np.cumsum(sizes) - sizes
            starts = np.zeros(len(numbers), bool)
            starts[begins] = True
            totals = np.add.reduceat(trie.score(numbers, starts), begins)
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            at = 0
            for batch in table:
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(5)], pa.array(totals[at : at + batch.num_rows])], names=["doc_id", "learned", "n_tokens", "n_known", "base_score", "score"])
                at += batch.num_rows
        drop_arrays()

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, learned boolean, n_tokens long, n_known long, base_score double, score double")
