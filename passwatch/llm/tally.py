"""Word counts and pair counts of texts, combined in each task before they are shuffled.

Pairs are counted by direct address: words have numbers in the order of their frequency, so that frequent pairs lie in a few square tiles of
SIDE x SIDE counters, which numpy's bincount fills. A tile is made once a slice of text brings it DENSE pairs, TILES of them at most in a
task (32 MB); the pairs of all other tiles are kept as sorted codes with counts. What exceeds a bound goes out and is summed by Spark, so that a
task's memory has a bound and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import LOWER, joined_bytes, mix, prefix_hash, range_hash, slices, small_batches, words_of

BITS = 9
SIDE = 1 << BITS
TILES = 32
DENSE = 4096
MOST_CODES = 1 << 20
MOST_WORDS = 1 << 19
MOST_SEEN = 1 << 30
SLICE = 1 << 22
CHUNK = 1 << 17
FILTER_BITS = 1 << 25
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Tally:
    """Counts of pairs of numbers below 2**31. others: the tallies of the same task, itself among them, that share TILES and MOST_CODES."""

    def __init__(self, others: list[Tally] | None = None) -> None:
        self.others = [] if others is None else others
        self.others.append(self)
        self.clear()

    def clear(self) -> None:
        self.tiles: dict[int, np.ndarray] = {}
        self.loose: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.seen = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Count every (a[i], b[i])."""
        edge = 255  # no tile beyond this row or column of tiles is dense
        tile = (np.minimum(a >> BITS, edge) << 8 | np.minimum(b >> BITS, edge)).astype(np.uint16)
        sizes = np.bincount(tile, minlength=1 << 16)
        for t in np.flatnonzero(sizes >= DENSE).tolist():
            if t not in self.tiles and t >> 8 != edge and t & 255 != edge and sum(len(x.tiles) for x in self.others) < TILES:
                self.tiles[t] = np.zeros(SIDE * SIDE, np.int32)
        order, ends = np.argsort(tile, kind="stable"), np.cumsum(sizes)
        rest = np.ones(len(a), bool)
        for t, counts in self.tiles.items():
            if sizes[t]:
                own = order[ends[t] - sizes[t] : ends[t]]
                counts += np.bincount((a[own] & (SIDE - 1)) << BITS | b[own] & (SIDE - 1), minlength=SIDE * SIDE).astype(np.int32)
                rest[own] = False
        self.seen += len(a)
        if rest.any():
            self.merge(a[rest].astype(np.int64) << 32 | b[rest], np.ones(int(rest.sum()), np.int64))

    def merge(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.loose.append((codes, counts))
        self.held += len(codes)
        if self.held > MOST_CODES * 3 // 2:
            self.sort()

    def sort(self) -> None:
        codes, counts = (np.concatenate(c) for c in zip(*self.loose))
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
        self.loose = [(codes[first], np.add.reduceat(counts, first) if len(first) else counts)]
        self.held = len(first)

    @property
    def full(self) -> bool:
        """Whether the tallies of the task hold so much that they should go out."""
        return sum(x.held for x in self.others) > MOST_CODES or self.seen > MOST_SEEN

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs and their counts; the tally is empty afterwards."""
        for t, counts in self.tiles.items():
            at = np.flatnonzero(counts)
            a, b = (t >> 8 << BITS) + (at >> BITS), ((t & 255) << BITS) + (at & (SIDE - 1))
            self.loose.append((a << 32 | b, counts[at].astype(np.int64)))
        if self.loose:
            self.sort()
        codes, counts = self.loose[0] if self.loose else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.clear()
        return codes >> 32, codes & 0xFFFFFFFF, counts


def hash_of(group: str, word: bytes) -> int:
    """A 64-bit hash of a word of a group (a language)."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(group.encode()))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _FACTOR + mix(b))


#: The bits of a hash that its two slots in a filter begin at.
SHIFTS = (0, 32)


def filter_of(seed: DataFrame) -> np.ndarray:
    """A Bloom filter (64-bit words) of the column `seed`: 64 bits a seed, FILTER_BITS in all at most (4 MB). Its words are combined in Spark."""
    size = min(max(1 << 12, 1 << (64 * seed.count()).bit_length()), FILTER_BITS)
    slot = [F.shiftrightunsigned("seed", k).bitwiseAND(F.lit(size - 1)) for k in SHIFTS]
    words = seed.select(F.explode(F.array(*slot)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(size // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold: all that it was made of, and few others while it is not full."""
    out = np.ones(len(hashes), bool)
    for shift in SHIFTS:
        slot = ((hashes >> np.uint64(shift)) & np.uint64(len(bits) * 64 - 1)).astype(np.int64)
        out &= ((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return out


class Lexicon:
    """Numbers of the words of a group: first the given ones in their order, then others as they come; -1 for words that `alive` refuses."""

    def __init__(self, group: str, head: pa.Array, alive: Callable[[np.ndarray], np.ndarray]) -> None:
        self.group, self.alive, self.head = group, alive, head
        self.ids: dict[bytes, int] = {}
        self.words = bytes_of(head)
        self.hashes = [hash_of(group, w) for w in self.words]

    def __len__(self) -> int:
        return len(self.words) + len(self.ids)

    def of(self, words: pa.Array) -> np.ndarray:
        out = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rest, ids = np.flatnonzero(out < 0), self.ids
        names = bytes_of(words.take(pa.array(rest)))
        if new := [w for w in names if w not in ids]:
            hashes = [hash_of(self.group, w) for w in new]
            for w, h, keep in zip(new, hashes, self.alive(np.array(hashes, np.uint64)).tolist()):
                if keep:
                    ids[w] = len(self.words)
                    self.words.append(w)
                    self.hashes.append(h)
                else:
                    ids[w] = -1
        out[rest] = np.fromiter((ids[w] for w in names), np.int64, len(names))
        return out

    def texts(self, at: np.ndarray) -> pa.Array:
        used, back = np.unique(at, return_inverse=True)
        return pa.array([self.words[k] for k in used.tolist()], pa.binary()).cast(pa.string()).take(pa.array(back))


def by_group(batch: pa.RecordBatch, column: int) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each value of a string column, which holds no nulls."""
    coded = batch.column(column).dictionary_encode()
    at = coded.indices.to_numpy()
    for k, group in enumerate(coded.dictionary.to_pylist()):
        yield group, batch if len(coded.dictionary) == 1 else batch.take(pa.array(np.flatnonzero(at == k)))


def bytes_of(words: pa.Array) -> list[bytes]:
    """The values of a large binary array without nulls."""
    edge = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    body = words.buffers()[2].to_pybytes() if len(words) else b""
    return [body[a:z] for a, z in zip(edge, edge[1:])]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a binary array without nulls."""
    data, edge = joined_bytes(words)
    return range_hash(prefix_hash(data), edge[:-1], edge[1:])


class Words:
    """The lower-cased words of an Arrow column: number in `dictionary`, owner (row), start and end in `data`."""

    def __init__(self, column: pa.Array, is_word: np.ndarray) -> None:
        data, offsets = joined_bytes(column)
        self.data = LOWER[data]
        self.start, self.end, self.owner = words_of(self.data, offsets, is_word)
        edge = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=edge[1:])
        body = np.ascontiguousarray(self.data[is_word[self.data]])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(edge), pa.py_buffer(body)]).dictionary_encode()
        self.at, self.dictionary = coded.indices.to_numpy(), coded.dictionary

    def places(self, known: pa.Array, default: int) -> np.ndarray:
        """The place in `known` (large binary) of each word of the dictionary."""
        return pc.fill_null(pc.index_in(self.dictionary, value_set=known), default).to_numpy(zero_copy_only=False).astype(np.int64)


def word_counts(texts: DataFrame, is_word: np.ndarray) -> DataFrame:
    """lang, word, n; a row without a word has the number of all words of lang. texts: lang (no nulls), __text."""

    def merged(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        coded = pa.concat_arrays([words for words, _ in parts]).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), np.concatenate([c for _, c in parts]), len(coded.dictionary))
        return coded.dictionary, n.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in state.items():
                words, n = merged(parts)
                names = pa.concat_arrays([pa.array([None], pa.string()), words.cast(pa.large_string()).cast(pa.string())])
                yield from pieces([pa.array([lang] * len(names)), names, pa.array(np.append(n.sum(), n))], ["lang", "word", "n"])
            state.clear()

        held = 0
        for batch in slices(batches, "__text", SLICE):
            for lang, rows in by_group(batch, 0):
                words = Words(rows.column(1), is_word)
                state.setdefault(lang, []).append((words.dictionary, np.bincount(words.at, minlength=len(words.dictionary))))
                held += len(words.dictionary)
            if held > MOST_WORDS:
                for lang, parts in state.items():
                    state[lang] = [merged(parts)]
                held = sum(len(words) for parts in state.values() for words, _ in parts)
                if held > MOST_WORDS // 2:
                    yield from out()
                    held = 0
        yield from out()

    found = small_batches(texts).mapInArrow(run, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, names: list[str], most: int) -> pa.Table:
    """lang and names of the `most` most frequent rows of a table of counts, the most frequent first. At most `most` rows reach the driver."""
    return counts.orderBy(F.desc("n"), "lang", *names).limit(most).select("lang", *names).toArrow().combine_chunks()


def of_group(rank: pa.Table, group: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Of the ranked rows those of a group, in their order: their places in the table, and each further column as large binary."""
    if not rank.num_rows:
        return np.zeros(0, np.int64), [pa.array([], pa.large_binary()) for _ in rank.column_names[1:]]
    at = np.flatnonzero(pc.equal(rank.column(0), group).to_numpy(zero_copy_only=False))
    own = rank.take(pa.array(at))
    return at, [pa.concat_arrays(own.column(k).cast(pa.large_string()).chunks or [pa.array([], pa.large_string())]).cast(pa.large_binary()) for k in range(1, own.num_columns)]


def pieces(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A record batch for each CHUNK rows."""
    whole = pa.record_batch(columns, names)
    for a in range(0, whole.num_rows, CHUNK):
        yield whole.slice(a, CHUNK)


def counted(ranks: list[np.ndarray], columns: list[np.ndarray], texts: Callable[[np.ndarray], list[pa.Array]], group: str, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows code, words, n of a tally's two columns: a pair of ranked numbers by the ranks of all groups, any other by its group and words."""
    known = (columns[0] < len(ranks[0])) & (columns[1] < len(ranks[1]))
    a, b = (r[c[known]] for r, c in zip(ranks, columns))
    yield from pieces([pa.array(a << 32 | b), pa.nulls(len(a), pa.list_(pa.string())), pa.array(n[known])], ["code", "words", "n"])
    rest = np.flatnonzero(~known)
    for k in range(0, len(rest), CHUNK):
        own = rest[k : k + CHUNK]
        parts = [pa.array([group] * len(own), pa.string()), *texts(own)]
        flat = pa.concat_arrays(parts).take(pa.array(np.arange(len(parts) * len(own)).reshape(len(parts), -1).T.ravel()))
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(own) + 1) * len(parts)).astype(np.int32)), flat)
        yield pa.record_batch([pa.nulls(len(own), pa.int64()), lists, pa.array(n[own])], ["code", "words", "n"])


def seeds(counts: DataFrame, names: list[str]) -> DataFrame:
    """The hash of each word or pair, as the tasks that count know it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            own = [np.array([hash_of(x, w.encode()) for x, w in zip(langs, batch.column(k).to_pylist())], np.uint64) for k in range(1, len(names) + 1)]
            yield pa.record_batch([pa.array((own[0] if len(own) == 1 else pair_hash(*own)).view(np.int64))], ["seed"])

    return counts.select("lang", *names).mapInArrow(run, "seed long")
