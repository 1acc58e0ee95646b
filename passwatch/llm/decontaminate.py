"""Benchmark decontamination with spaced seeds.

A fixed mask looks at five of up to eight consecutive words and ignores the rest. The hashes of the test items under every mask are a table,
(seed, part, place); those of the documents are joined with it. Each hit names an item and a diagonal (item word 0 against document word d).
The words around the hit are then compared along that diagonal, substitutions counting as misses, and the overlap holds where some window of
WINDOW item words (the whole item, if that is shorter) has at least 80 % of its words equal. Items of 5 to 9 words must agree word for
word; an item of fewer than five words is too short to tell and never matches.

The masks are chosen so that ten aligned words with any two substitutions keep one mask whole, and every window that holds has
such ten words: no overlap is lost. Words are runs of letters, digits and non-ASCII characters, lower-cased.

Documents are cut into tiles of TILE words; a tile with hits carries the words that windows around its hits can reach, so a verification
reads a bounded number of words however long the document, and a long item is cut into parts of PART words that overlap by a window. Before
the join a Bloom filter of the items' seeds, of at most FILTER_BITS bits whatever the benchmark's size, keeps documents' seeds that no item
has from being shuffled; it loses none. All joins are left to Spark, which broadcasts a side only by its size. Texts meet by a
64-bit hash, so that copies are verified once, and no text is shuffled unless the overlaps found are too many to broadcast.

Edge cases: null texts and items are empty and match nothing; repeated documents and items match each for itself; a document's
words never run on into the next document; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import joined_bytes, map_arrow, mix, prefix_hash, range_hash, small_batches, words_of, written

WINDOW = 13
SIMILARITY = 0.8
LEAST_WORDS = 5
TOLERANT_WORDS = 10
TILE = 32
PART = 512
FILTER_BITS = 1 << 27
#: The words that each mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
#: Words before and behind a tile that a window around one of its hits can reach.
BEFORE = WINDOW - 1
BEHIND = WINDOW - 1
SPAN = BEFORE + TILE + BEHIND

_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_WORD[128:] = True
_FACTOR = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(8)]


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each word of all texts, and where each text's words begin (n + 1 bounds)."""
    data, offsets = joined_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    start, end, owner = words_of(data, offsets, _WORD)
    return range_hash(prefix_hash(data), start, end), np.searchsorted(owner, np.arange(len(offsets)))


def seeds(codes: np.ndarray, bounds: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The hash under a mask at each word position, and whether the mask stays within one text there."""
    n, span = len(codes), mask[-1] + 1
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n - span + 1, np.uint64)
    for k, offset in enumerate(mask):
        out += codes[offset : offset + len(out)] * _FACTOR[k]
    room = np.repeat(bounds[1:], np.diff(bounds))[: len(out)] - np.arange(len(out))
    return mix(out), room >= span


def hits_of(codes: np.ndarray, bounds: np.ndarray, mask: tuple[int, ...], bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of every seed that lies within one text and, with a filter, passes it."""
    found, whole = seeds(codes, bounds, mask)
    if bits is not None:
        for shift in SHIFTS:
            slot = slots(found, shift, len(bits))
            whole = whole & ((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    at = np.flatnonzero(whole)
    return at, found[at].view(np.int64)


#: The bits of a seed's hash that the two slots of the filter begin at.
SHIFTS = (0, 32)


def slots(found: np.ndarray, shift: int, words: int) -> np.ndarray:
    return ((found >> np.uint64(shift)) & np.uint64(words * 64 - 1)).astype(np.int64)


def parts_of(benchmark: DataFrame, item_text: str) -> DataFrame:
    """part (a number), item (hash of the text), first (its first word in the item), size (words of the item), codes, and its seeds."""
    stride = PART - WINDOW + 1

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, bounds = word_codes(batch.column(1))
        out = []
        for item, a, z in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            for first in range(0, max(z - a - WINDOW + 1, 1), stride):
                own = codes[a + first : min(a + first + PART, z)]
                hits = [hits_of(own, np.array([0, len(own)]), mask) for mask in MASKS]
                out.append((item, first, z - a, own.tobytes(), np.concatenate([h[1] for h in hits]).tolist(), np.concatenate([h[0] for h in hits]).tolist()))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        cols = list(zip(*out)) or [[]] * 6
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["item", "first", "size", "codes", "seed", "place"])

    texts = benchmark.select(F.xxhash64(item_text).alias("item"), F.col(item_text).alias("__text")).where("__text is not null").distinct()
    return map_arrow(texts, kernel, "item long, first int, size int, codes binary, seed array<long>, place array<int>", "__text")


def filter_of(seed: DataFrame) -> np.ndarray:
    """A Bloom filter (64-bit words) of the column `seed`: 256 bits a seed, FILTER_BITS in all at most. Its words are combined in Spark."""
    n = seed.count()
    size = min(max(1 << 12, 1 << (256 * n).bit_length()), FILTER_BITS)
    slot = [F.shiftrightunsigned("seed", k).bitwiseAND(F.lit(size - 1)) for k in SHIFTS]
    words = seed.select(F.explode(F.array(*slot)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    set_ = words.agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toPandas()  # at most FILTER_BITS / 64 rows
    out = np.zeros(size // 64, np.int64)
    out[set_["word"].to_numpy(np.int64)] = set_["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def tiles_of(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc (hash of the text), tile, codes and known (words that exist) of the tiles with seeds that pass the filter, and these. docs: doc, __text."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, bounds = word_codes(batch.column(1))
        hits = [hits_of(codes, bounds, mask, shared.value) for mask in MASKS]
        at, seed = (np.concatenate(c) for c in zip(*hits))
        owner = np.searchsorted(bounds, at, side="right") - 1
        place = at - bounds[owner]
        order = np.lexsort([place, owner])
        owner, place, seed = owner[order], place[order], seed[order]
        tile = place // TILE
        start = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (owner[1:] != owner[:-1]))[: len(tile)])
        edge = pa.array(np.append(start, len(tile)).astype(np.int32))
        first = bounds[owner[start]] + tile[start] * TILE - BEFORE
        there = first[:, None] + np.arange(SPAN)
        known = (there >= bounds[owner[start]][:, None]) & (there < bounds[owner[start] + 1][:, None])
        around = np.where(known, codes[np.clip(there, 0, max(len(codes) - 1, 0))] if len(codes) else np.uint64(0), np.uint64(0))
        lists = [pa.ListArray.from_arrays(edge, pa.array(c)) for c in (seed, place.astype(np.int32))]
        rows = [pa.array([r.tobytes() for r in c], pa.binary()) for c in (around, known)]
        return pa.record_batch([batch.column(0).take(pa.array(owner[start])), pa.array(tile[start].astype(np.int32)), *rows, *lists], ["doc", "tile", "codes", "known", "seed", "place"])

    return map_arrow(docs, kernel, "doc long, tile int, codes binary, known binary, seed array<long>, place array<int>", "__text")


def verified(cases: DataFrame) -> DataFrame:
    """doc, item, start (document word), matched and window of the best window of each case: a tile against a part on a diagonal."""
    names = ["doc", "item", "start", "matched", "window"]

    def check(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint64).reshape(-1, SPAN)
            known = np.frombuffer(b"".join(batch.column("known").to_pylist()), bool).reshape(-1, SPAN)
            part = [np.frombuffer(x, np.uint64) for x in batch.column("part").to_pylist()]
            size, shift, tile = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "shift", "tile"))
            edge = np.concatenate([[0], np.cumsum([len(p) for p in part])])
            words = np.concatenate([*part, np.zeros(1, np.uint64)])
            within = (tile * TILE - BEFORE - shift)[:, None] + np.arange(SPAN)  # word of the part at each word of the tile
            inside = (within >= 0) & (within < np.diff(edge)[:, None])
            equal = inside & known & (words[np.where(inside, edge[:-1][:, None] + within, 0)] == codes)
            zero = np.zeros((len(part), 1), np.int64)
            run, room = (np.concatenate([zero, np.cumsum(x, axis=1)], axis=1) for x in (equal, inside))
            for width in np.unique(np.minimum(size, WINDOW)).tolist():
                own = np.flatnonzero(np.minimum(size, WINDOW) == width)
                if width < LEAST_WORDS:
                    continue
                hits = run[own, width:] - run[own, :-width]
                hits[room[own, width:] - room[own, :-width] < width] = -1
                best = hits.argmax(axis=1)
                matched = hits[np.arange(len(own)), best]
                need = np.where(size[own] >= TOLERANT_WORDS, np.ceil(SIMILARITY * width - 1e-9), width)
                good = matched >= need
                rows = own[good]
                start = tile[rows] * TILE - BEFORE + best[good]
                yield pa.record_batch([batch.column("doc").take(pa.array(rows)), batch.column("item").take(pa.array(rows)), pa.array(start), pa.array(matched[good]), pa.array(np.full(len(rows), width))], names)

    return small_batches(cases).mapInArrow(check, "doc long, item long, start long, matched long, window long")


def overlaps(texts: DataFrame, benchmark: DataFrame, item_text: str) -> DataFrame:
    """doc and item (hashes of texts), start, matched and window of the best window of each overlap. texts: doc, __text."""
    parts = written(parts_of(benchmark, item_text), "items")
    places = parts.select("item", "first", F.explode(F.arrays_zip("seed", "place")).alias("s")).select("item", "first", F.col("s.seed").alias("seed"), F.col("s.place").alias("at"))
    tiles = written(tiles_of(texts, filter_of(places.select("seed").distinct())), "tiles")
    hits = tiles.select("doc", "tile", F.explode(F.arrays_zip("seed", "place")).alias("s")).select("doc", "tile", F.col("s.seed").alias("seed"), F.col("s.place").alias("place")).distinct()
    diagonals = hits.join(places, "seed").select("doc", "tile", "item", "first", (F.col("place") - F.col("at")).alias("shift")).distinct()
    held = tiles.join(diagonals.select("doc", "tile").distinct(), ["doc", "tile"], "left_semi").select("doc", "tile", "codes", "known").dropDuplicates(["doc", "tile"])
    cases = diagonals.join(held, ["doc", "tile"]).join(parts.select("item", "first", "size", F.col("codes").alias("part")), ["item", "first"])
    best = verified(cases.select("doc", "item", "tile", "shift", "size", "codes", "known", "part")).groupBy("doc", "item")
    one = best.agg(F.max(F.struct("matched", (-F.col("start")).alias("back"), "window")).alias("one"))
    return written(one.select("doc", "item", (-F.col("one.back")).alias("start"), "one.matched", "one.window"), "overlaps")


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that overlap: key, item, start_word, matched_words, window_words, similarity (of the best window)."""
    found = overlaps(docs.select(F.xxhash64(text).alias("doc"), F.col(text).alias("__text")), benchmark, item_text)
    items = benchmark.select(F.col(item).alias("__item"), F.xxhash64(item_text).alias("item"))
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("doc"))
    return rows.join(found.join(items, "item"), "doc").select(
        F.col("__key").alias(key),
        F.col("__item").alias(item),
        F.col("start").alias("start_word"),
        F.col("matched").alias("matched_words"),
        F.col("window").alias("window_words"),
        (F.col("matched") / F.col("window")).alias("similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text overlaps with an item."""
    found = overlaps(docs.select(F.xxhash64(text).alias("doc"), F.col(text).alias("__text")), benchmark, item_text)
    named = docs.withColumn("__doc", F.xxhash64(text))
    return named.join(found.select(F.col("doc").alias("__doc")).distinct(), "__doc", "left_anti").select(*docs.columns)
