"""SimHash near-duplicates: fingerprints, and a binary-trie self-join within a Hamming budget.

Fingerprints: A-Z lower-cased, words between ASCII blanks, shingles of `width` words (repeats count, joined by one blank;
fewer words: the whole sequence; none: fingerprint 0), XXH64 with seed 42, and a bit is 1 where over half the hashes have it.

Join: equal fingerprints are one class, so copies never meet each other. Classes are dealt by pieces: 64 bits are cut into
`budget` + 2 pieces, and two fingerprints within the budget agree on two pieces at least, so they share the bucket of some
pair of pieces. Within a bucket the trie of the sorted fingerprints is walked by pairs of nodes from the root down; a pair
carries the bits in which its two prefixes differ and is dropped once they exceed the budget. A bucket beyond BLOCK classes is cut into
blocks, and pairs of blocks are dealt out instead. A bucket gives a spanning set of its links, not all of them.

Two bits apart means a similarity of about 0.98, so a budget of two misses most near copies at a similarity of 0.8. near() serves that
similarity: each text's set of shingle hashes is kept, and a pair is linked by the sets themselves, by whole numbers (a similarity of exactly
0.8 counts). Classes meet by the prefix principle: sets of n and m hashes at a similarity of 4/5 share one of
the first n - ceil(4n/5) + 1 (and m - ceil(4m/5) + 1) hashes in any order common to all, so that no pair is lost; rare hashes come first.

Edge cases: null and blank texts have fingerprint 0 and link with each other and with near fingerprints like any other;
repeated rows of one id stay rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import LOWER, SPACE, components, discard, joined_bytes, map_arrow, small_batches, star_of, words_of, written

SEED = 42
BLOCK = 1024
SAMPLE = 40_000
OFTEN = 1 << 20
CELLS = 512
PAIRS_AT_ONCE = 1 << 14
FEW = 256  # pairs below two nodes that are compared at once
KEPT = 1 << 12  # pairs that leave across() without a forest
#: The bits of each byte as eight 8-bit counters of a 64-bit word.
COUNTERS = np.zeros(256, np.uint64)
for _bit in range(8):
    COUNTERS |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def fingerprint_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The majority fingerprint of each run hashes[bounds[i]:bounds[i + 1]]; an empty run gives 0.

    Bits are counted 255 hashes at a time in eight-bit counters, eight to a word, and these sums are then added up.
    """
    out = np.zeros(len(bounds) - 1, np.uint64)
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    parts = -(-size[full] // 255)
    begin = np.cumsum(parts) - parts
    first = np.repeat(bounds[:-1][full], parts) + 255 * (np.arange(parts.sum()) - np.repeat(begin, parts))
    sums = np.empty((len(first), 64), np.uint8)
    a = 0
    while a < len(first):
        b = int(np.searchsorted(first, first[a] + (1 << 15)))
        end = first[b] if b < len(first) else len(hashes)
        counted = COUNTERS[hashes[first[a] : end].view(np.uint8).reshape(-1, 8)]
        sums[a:b] = np.add.reduceat(counted, first[a:b] - first[a], axis=0).view(np.uint8)
        a = b
    ones = np.add.reduceat(sums, begin, axis=0, dtype=np.int64)
    out[full] = np.packbits(ones * 2 > size[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingled(data: np.ndarray, offsets: np.ndarray, width: int):
    """Hashes and bounds of the shingles of each text; the words, each followed by one blank, with their starts and owners."""
    start, end, owner = words_of(data, offsets, ~SPACE)
    n = len(offsets) - 1
    at = np.concatenate([[0], np.cumsum(end - start + 1)])
    flat = np.full(at[-1], 0x20, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    flat[inside] = LOWER[data[~SPACE[data]]]
    words = np.bincount(owner, minlength=n)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    first = np.concatenate([[0], np.cumsum(words)])
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    which = np.repeat(np.arange(n), shingles)
    begin = first[which] + np.arange(bounds[-1]) - bounds[which]
    stop = np.minimum(begin + width, first[which + 1])
    text, digest = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[stop] - 1).tolist())), np.uint64, bounds[-1])
    return hashes, bounds, flat, at, owner


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of each text of a joined byte array."""
    hashes, bounds, *_ = shingled(data, offsets, width)
    return fingerprint_bits(hashes, bounds)


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of shingle hashes of each text, and the bounds of the sets."""
    hashes, bounds, *_ = shingled(data, offsets, width)
    n = len(offsets) - 1
    return distinct(hashes, np.repeat(np.arange(n), np.diff(bounds)), n)


def prefixes(hashes: np.ndarray, bounds: np.ndarray, often: tuple[np.ndarray, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The first hashes of each set, in an order that all sets share, and their bounds: two sets at num / den have one of these in common.

    Any order will do. In this one the hashes of `often` (sorted, with their ranks from 1) come after all others.
    """
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), size)
    rank = np.zeros(len(hashes), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], hashes), len(often[0]) - 1)
        hit = often[0][at] == hashes
        rank[hit] = often[1][at[hit]]
    hashes = hashes[np.lexsort([rank, text])]
    least = np.where(size > 0, size - -(-size * num // den) + 1, 0)
    keep = np.arange(len(hashes)) - bounds[text] < least[text]
    return hashes[keep], np.concatenate([[0], np.cumsum(least)])


def often_met(df: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several texts of about SAMPLE have, at most OFTEN, and their ranks by counts. They only order the work: no result depends on them."""

    def shingle(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(sets_of(*joined_bytes(batch.column(0)), width)[0].view(np.int64))], ["hash"])

    every = max(1, df.count() // SAMPLE)
    some = df.select(F.col(text).alias("__text")).where(F.pmod(F.xxhash64("__text"), F.lit(every)) == 0).dropDuplicates()
    counted = map_arrow(some, shingle, "hash long", "__text").groupBy("hash").count().where("count >= 4")
    found = counted.orderBy(F.desc("count"), "hash").limit(OFTEN).select("hash").toArrow()["hash"].to_numpy()
    hashes = np.ascontiguousarray(found[::-1]).view(np.uint64)
    by = np.argsort(hashes)
    return hashes[by], by.astype(np.int32) + 1


def distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different hashes of each of n owners, and their bounds."""
    order = np.lexsort([hashes, owner])
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
    return hashes[new], np.searchsorted(owner[new], np.arange(n + 1))


def fingerprints(df: DataFrame, text: str, keep: list[str], width: int = 3, name: str = "fingerprint") -> DataFrame:
    """The columns `keep` and the fingerprint of `text` as a long (the same 64 bits)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{name}` long"])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprints_of(*joined_bytes(batch.column(len(keep))), width)
        return pa.record_batch([*batch.columns[: len(keep)], pa.array(found.view(np.int64))], [*keep, name])

    return map_arrow(df.select(*keep, F.col(text).alias("__text")), kernel, schema, "__text")


def trie_pairs(prints: np.ndarray, group: np.ndarray, other: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs within the budget, over many tries at once.

    group is sorted, and prints within each of its runs; each run is a trie. `other` names the trie that a run is joined with:
    its own number for a self-join, -1 or an absent one for none.
    """
    runs = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)
    lo, hi = runs[:-1], runs[1:]
    mate = np.minimum(np.searchsorted(group[lo], other[lo]), max(len(lo) - 1, 0))
    met = group[lo[mate]] == other[lo]
    a0, a1, b0, b1 = lo[met], hi[met], lo[mate[met]], hi[mate[met]]
    gap = np.zeros(len(a0), np.int64)
    done = []
    for depth in range(63, -1, -1):
        if not len(a0):
            break
        bit = ((prints >> np.uint64(depth)) & np.uint64(1)).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(1 - bit)])
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]  # where the 1-children begin
        same = (a0 == b0) & (a1 == b1)
        next_ = []
        for x0, x1, y0, y1, differs, fine in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (gap + differs <= budget)
            if fine is not None:
                ok &= fine
            ok &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 == 1))  # a leaf with itself
            next_.append((x0[ok], x1[ok], y0[ok], y1[ok], gap[ok] + differs))
        a0, a1, b0, b1, gap = (np.concatenate(c) for c in zip(*next_))
        small = (a1 - a0) * (b1 - b0) <= FEW
        done += compared(prints, a0[small], a1[small], b0[small], b1[small], budget)
        a0, a1, b0, b1, gap = (c[~small] for c in (a0, a1, b0, b1, gap))
    done += compared(prints, a0, a1, b0, b1, budget)  # leaves of many equal prints
    return tuple(np.concatenate(c) for c in zip((np.zeros(0, np.int64),) * 2, *done))


def compared(prints: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pairs within the budget below pairs of small nodes, by all their bits at once."""
    out = []
    wide = b1 - b0
    total = (a1 - a0) * wide
    step = np.cumsum(total) >> 19
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(total)]
    for x, y in zip(edges, edges[1:]):
        of = np.repeat(np.arange(x, y), total[x:y])
        place = np.arange(len(of)) - np.repeat(np.cumsum(total[x:y]) - total[x:y], total[x:y])
        i, j = a0[of] + place // wide[of], b0[of] + place % wide[of]
        near_ = (np.bitwise_count(prints[i] ^ prints[j]) <= budget) & ((a0[of] != b0[of]) | (i < j))
        out.append((i[near_], j[near_]))
    return out


def pieces(budget: int) -> list[tuple[int, int]]:
    """(shift, bits) of budget + 2 pieces of 64 bits."""
    n = budget + 2
    edge = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def bucketed(classes: DataFrame, budget: int) -> DataFrame:
    """bucket, fingerprint: each class under every pair of its pieces."""
    cut = pieces(budget)
    part = [F.shiftrightunsigned("fingerprint", a).bitwiseAND(F.lit((1 << bits) - 1)) for a, bits in cut]
    keys = [F.xxhash64(F.lit(i), part[x], part[y]) for i, (x, y) in enumerate(combinations(range(len(cut)), 2))]
    return classes.select("fingerprint", F.explode(F.array(*keys)).alias("bucket"))


def in_blocks(dealt: DataFrame, node: str, columns: list[str], block: int) -> DataFrame:
    """Rows of buckets with two classes or more, once for each pair of blocks that holds theirs: task, side, sides and `columns`.

    A bucket of at most `block` classes is one task. The sizes are counted with map-side sums, and the join that brings them is one whose
    skew AQE can split; a task holds two blocks at most.
    """
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = dealt.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("own", "k"), F.greatest("own", "k")
    placed = rows.select(F.xxhash64("bucket", x, y).alias("task"), F.when(F.col("own") == x, 0).otherwise(1).alias("side"), F.when(x == y, 1).otherwise(2).alias("sides"), *columns)
    return placed.repartition("task").sortWithinPartitions("task")


def links(classes: DataFrame, budget: int = 2, block: int = BLOCK) -> DataFrame:
    """Links a, b between fingerprints (a column of distinct longs) within `budget` bits: a spanning set of every bucket's."""

    def join(batches):
        for task, side, sides, prints in carried(batches):
            u = prints.view(np.uint64)
            a, b = task_pairs(task, side, sides, u, budget)
            yield pa.record_batch(star_of(u[a].view(np.int64), u[b].view(np.int64)), ["a", "b"])

    return in_blocks(bucketed(classes, budget), "fingerprint", ["fingerprint"], block).mapInArrow(join, "a long, b long")


def task_pairs(task: np.ndarray, side: np.ndarray, sides: np.ndarray, prints: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs within the budget: within a task of one side, and between the sides of a task of two."""
    order = np.lexsort([prints, side, task])
    where = np.unique(task[order], return_inverse=True)[1] * 2
    side, sides = side[order], sides[order]
    a, b = trie_pairs(prints[order], where + side, np.where(side == 1, -1, where + sides - 1), budget)
    return order[a], order[b]


def shared_needed(m, n, num: int, den: int):
    """The fewest common shingles of sets of m and n at a similarity of num / den."""
    return -(-num * (m + n) // (num + den))


def cells_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many hashes of each set fall into each of CELLS cells, 255 at most."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    counts = np.bincount(text * CELLS + (hashes % np.uint64(CELLS)).astype(np.int64), minlength=(len(bounds) - 1) * CELLS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, CELLS)


def most_shared(x, y, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A certain upper bound of the common shingles of pairs of sets, from their cells and sizes."""
    x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, CELLS) for c in (x, y))
    over = np.minimum(m - x.sum(axis=1, dtype=np.int64), n - y.sum(axis=1, dtype=np.int64))  # beyond 255 in a cell
    return np.minimum(x, y).sum(axis=1, dtype=np.int64) + over


def shared(x, y, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The common shingles of pairs of sets."""
    out = np.zeros(len(x), np.int64)
    for i, (u, v) in enumerate(zip(x, y)):
        both = np.concatenate([np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)])
        both.sort(kind="stable")
        out[i] = np.count_nonzero(both[1:] == both[:-1])
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int, column: str) -> DataFrame:
    """The pairs x, y of nodes whose sets of shingles may have a similarity of num / den by their cells, or have it by their hashes."""
    count = {"cells": most_shared, "hashes": shared}[column]

    def check(batches):
        for batch in batches:
            if batch.num_rows:
                x, y, m, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns[2:])
                good = pa.array(count(x, y, m, n) >= shared_needed(m, n, num, den))
                yield pa.record_batch([c.filter(good) for c in batch.columns[:2]], ["x", "y"])
        pa.default_memory_pool().release_unused()

    def side(c):  # only the sets that pairs name are moved
        named = sets.join(pairs.select(F.col(c).alias("node")).distinct(), "node", "left_semi")
        return named.select(F.col("node").alias(c), F.col(column).alias("set_" + c), F.col("n").alias("n_" + c))

    joined = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "set_x", "set_y", "n_x", "n_y")
    return written(small_batches(joined).mapInArrow(check, "x long, y long"), "pairs")


def whole_sets(df: DataFrame, text: str, width: int, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, n and hashes (the whole set) of the nodes of pairs, made from their texts, which `rows` names by a hash (body)."""

    def shingle(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = sets_of(*joined_bytes(batch.column(1)), width)
        body = [hashes[x:y].tobytes() for x, y in zip(bounds.tolist(), bounds[1:].tolist())]
        return pa.record_batch([batch.column(0), pa.array(body, pa.binary())], ["body", "hashes"])

    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    named = written(rows.join(nodes, "node", "left_semi").select("node", "n", "body"), "named")
    texts = df.select(F.xxhash64(text).alias("body"), F.col(text).alias("__text")).join(named.select("body").distinct(), "body", "left_semi").dropDuplicates(["body"])
    return written(named.join(map_arrow(texts, shingle, "body long, hashes binary", "__text"), "body").select("node", "n", "hashes"), "whole")


def firsts(batches):
    """Rows bucket, node (whole buckets) of buckets with two nodes or more, with the bucket's first node."""
    for bucket, node in carried(batches):
        order = np.lexsort([node, bucket])
        bucket, node = bucket[order], node[order]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(start, len(bucket)))
        keep = np.repeat(size > 1, size)
        yield pa.record_batch([bucket[keep], node[keep], np.repeat(node[start], size)[keep]], ["bucket", "node", "pivot"])


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of a heaviest spanning forest of the edges (a, b): each group takes its heaviest edge outwards, until none is left."""
    label = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    a, b, at, taken = label[: len(a)], label[len(a) :], np.arange(len(a)), []
    while len(at):
        order = np.lexsort([at, -weight])  # one order of all edges, so that no circle closes
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        best = np.full(int(max(a.max(), b.max())) + 1, len(at))
        np.minimum.at(best, a, place)
        np.minimum.at(best, b, place)
        some = np.unique(best[best < len(at)])
        taken.append(at[order[some]])
        up = np.arange(len(best))
        nodes, roots = star_of(a[order[some]], b[order[some]])
        up[nodes] = roots
        a, b = up[a], up[b]
        apart = a != b
        a, b, at, weight = a[apart], b[apart], at[apart], weight[apart]
    return np.concatenate([np.zeros(0, np.int64), *taken])


def across(num: int, den: int, whole: bool):
    """A kernel from the tasks of in_blocks() to pairs x < y of different roots, none a bucket's first node, that their sizes and cells allow.

    The pairs of a task are looked at PAIRS_AT_ONCE at a time where they lie. With `whole`, or where they are at most KEPT, all that may be links leave it,
    else those of a spanning forest of the roots, by the shingles that the cells allow beyond those needed; `cut` tells that this left some out.
    """

    def pairs(batches):
        for task, side, sides, node, root, n, pivot, cells in carried(batches, 1 << 13):
            order = np.lexsort([side, task])
            task, side, sides, node, root, n, pivot, cells = (c[order] for c in (task, side, sides, node, root, n, pivot, cells))
            cells = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, CELLS)
            over = n - cells.sum(axis=1, dtype=np.int64)  # beyond 255 in a cell
            start = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            group = np.cumsum(np.append(0, task[1:] != task[:-1]))
            own = np.unique(np.stack([group, root]), axis=1, return_inverse=True)[1].ravel()  # a root in a task
            end = np.append(start[1:], len(task))
            cut = start + np.add.reduceat((side == 0).astype(np.int64), start)
            two = sides[start] == 2
            a0, a1, b0, b1 = start, np.where(two, cut, end), np.where(two, cut, start), end
            wide = b1 - b0
            total = (a1 - a0) * wide
            ends = np.cumsum(total)
            held, cut_some = np.zeros((3, 0), np.int64), False
            for lo in range(0, int(ends[-1]), PAIRS_AT_ONCE):
                at = np.arange(lo, min(lo + PAIRS_AT_ONCE, int(ends[-1])))
                of = np.searchsorted(ends, at, "right")
                place = at - (ends[of] - total[of])
                i, j = a0[of] + place // wide[of], b0[of] + place % wide[of]
                ok = (root[i] != root[j]) & (two[of] | (i < j)) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
                ok &= (node[i] != pivot[i]) & (node[j] != pivot[j])
                i, j = i[ok], j[ok]
                spare = np.minimum(cells[i], cells[j]).sum(axis=1, dtype=np.int64) + np.minimum(over[i], over[j]) - shared_needed(n[i], n[j], num, den)
                held = np.concatenate([held, np.stack([i, j, spare])[:, spare >= 0]], axis=1)
                last = lo + PAIRS_AT_ONCE >= int(ends[-1])
                if not whole and held.shape[1] > (KEPT if last else 1 << 17):
                    held, cut_some = held[:, forest(own[held[0]], own[held[1]], held[2])], True
                if whole and held.shape[1] > 1 << 17 or last:
                    x, y = node[held[0]], node[held[1]]
                    found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                    held = held[:, :0]
                    yield pa.record_batch([np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1]), np.full(len(found), cut_some)], ["x", "y", "cut"])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task without what this one held

    return pairs


def near(df: DataFrame, key: str, text: str, width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """key and component_id, the smallest key reachable by links between texts of at least this similarity of shingle sets.

    Texts of one set of shingles are one class, whose node is the number of one of its rows. Each bucket's classes are first compared with the
    bucket's smallest node. Pairs of what these links leave apart are looked at inside tasks, by their cells; those that may be links are settled by
    the sets, and that ends it where no task has many. Else a task gives a spanning forest of them, and again for the groups it leaves, until a forest
    brings no link. Then all pairs left that may be links are settled, so that none is lost. Groups that no such pair touches are left out of later rounds.
    """
    num, den = Fraction(str(similarity)).as_integer_ratio()
    often = df.sparkSession.sparkContext.broadcast(often_met(df, text, width))

    def shingle(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = sets_of(*joined_bytes(batch.column(3)), width)
        buckets, edge = prefixes(hashes, bounds, often.value, num, den)
        digest = pa.array([xxhash.xxh3_128_digest(hashes[x:y].tobytes()) for x, y in zip(bounds.tolist(), bounds[1:].tolist())], pa.binary())
        cells = pa.array([c.tobytes() for c in cells_of(hashes, bounds)], pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(buckets.view(np.int64)))
        return pa.record_batch([*batch.columns[:3], digest, pa.array(np.diff(bounds)), cells, lists], ["key", "node", "body", "digest", "n", "cells", "buckets"])

    def labelled(edges: DataFrame, x: str, y: str) -> DataFrame:
        """classes with the root of each node, written once so that the plans of a round stay small."""
        root = components(edges, x, y)
        out = written(classes.join(root.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "labels")
        discard(root)
        spent.append(out)
        return out

    def settle(pairs: DataFrame) -> DataFrame:
        sets = whole_sets(df, text, width, rows, pairs)
        out = confirmed(pairs, sets, num, den, "hashes")
        discard(sets)
        return out

    kind = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    numbered = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("node"), F.xxhash64(text).alias("body"), F.col(text).alias("__text"))
    rows = written(map_arrow(numbered, shingle, f"key {kind}, node long, body long, digest binary, n long, cells binary, buckets array<long>", "__text"), "sets")
    often.destroy()
    classes = written(rows.groupBy("digest").agg(F.min("key").alias("least"), F.min("node").alias("node"), F.first("n").alias("n")), "classes")
    dealt = rows.join(classes.select("node"), "node", "left_semi").select(F.explode("buckets").alias("bucket"), "node")
    met = written(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(firsts, "bucket long, node long, pivot long"), "met")
    first = written(met.where("node <> pivot").select(F.col("pivot").alias("x"), F.col("node").alias("y")).distinct(), "pairs")
    some = settle(confirmed(first, rows, num, den, "cells"))
    spent = [met, first, some]
    labels, active, whole = labelled(some, "x", "y"), None, False
    while True:
        # joins of ids alone go by a shuffle: what is broadcast passes the driver, small as it may be
        named = met.join(labels.select("node", F.col("n").alias("words"), "root").hint("merge"), "node")
        if active is not None:
            named = named.join(labels.join(active.hint("merge"), "node", "left_semi").select("root").distinct().hint("merge"), "root", "left_semi")
        apart = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where(F.expr("low <> high") & (F.col("size") > (2 if active is None else 1))).select("bucket")
        open_ = written(named.join(apart.hint("merge"), "bucket").select("bucket", "node", "root", "words", "pivot"), "open")
        cells = rows.select("node", "cells").join(open_.select("node").distinct(), "node", "left_semi")
        dealt = in_blocks(open_.join(cells, "node"), "node", ["node", "root", "words", "pivot", "cells"], block)
        pairs = written(small_batches(dealt).mapInArrow(across(num, den, whole), "x long, y long, cut boolean").groupBy("x", "y").agg(F.max("cut").alias("cut")), "pairs")
        spent += [open_, pairs]
        cut = pairs.agg(F.max("cut")).first()[0]
        if cut is None:  # no pair left may be a link
            break
        found = settle(pairs)
        spent.append(found)
        none = found.isEmpty()
        if not none:
            labels = labelled(labels.select("node", "root").unionByName(found.select(F.col("x").alias("node"), F.col("y").alias("root"))), "node", "root")
        if whole or not cut:  # all pairs that might be links are settled
            break
        whole = none
        active = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    out = written(rows.select("key", "digest").join(labels.join(least.hint("merge"), "root").select("digest", "component_id").hint("merge"), "digest").select(F.col("key").alias(key), "component_id"), "groups")
    for done in (rows, classes, *spent):
        discard(done)
    return out


def carried(batches, rows: int = 1 << 14):
    """Columns of whole tasks (runs of the first column), about `rows` at a time; the last, cut task is carried on."""
    held: list[list[np.ndarray]] = []
    count = 0

    def flush(keep_last: bool):
        nonlocal held, count
        if not held:
            return None
        cols = [np.concatenate(c) for c in zip(*held)]
        differs = np.flatnonzero(cols[0] != cols[0][-1]) if keep_last else [len(cols[0]) - 1]
        cut = int(differs[-1]) + 1 if len(differs) else 0
        held = [[c[cut:] for c in cols]] if cut < len(cols[0]) else []
        count = len(cols[0]) - cut
        return [c[:cut] for c in cols] if cut else None

    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            count += batch.num_rows
        if count >= rows and (out := flush(True)):
            yield out
    if out := flush(False):
        yield out


def grouped(prints: DataFrame, key: str, budget: int = 2) -> DataFrame:
    """prints (key, fingerprint) with component_id: the smallest key reachable by links of at most `budget` bits."""
    classes = prints.groupBy("fingerprint").agg(F.min(key).alias("least"))
    found = components(links(classes.select("fingerprint"), budget))
    in_class = classes.join(found.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    first = in_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = in_class.join(first, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint")
