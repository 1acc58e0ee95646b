"""Removal of every byte that a repeated string of `window` bytes covers.

Suffixes are dealt by content: a window's key is the smallest hash of its strings of GRAMS[0] bytes, so equal windows have equal keys wherever
they lie, and consecutive windows of one key form one segment. A key that occurs once, and whose string
stands once in its windows, has no repeated window. Segments of
one key with equal bytes are copies, and all their windows are repeated. The different segments of a key that are left
meet in one task, which builds the Burrows-Wheeler transform of the collection of its segments column by column: each round
inserts one symbol for each segment, from the right, into the transform and updates the common prefixes of neighbouring suffixes. A window is
repeated where its suffix shares `window` bytes with a neighbour.

The transform, the common prefixes and the piles of first symbols are two sequential streams that each round reads and rewrites from front to
back, as the method's files are; a collection is bounded by COLLECTION segments (or one key's) of at most STRIDE + window bytes, so the streams
stay in the task, where no lost executor takes a file with it. A key with more than MOST different segments is dealt anew by longer strings, the
next of GRAMS, and its smaller segments go the same way. The last is the window itself: then only runs of one byte leave a key with
more than one segment, fewer than STRIDE of them, so no key is left too large for a task.

Edge cases: a null text is empty; texts shorter than the window are kept whole; windows never run across texts; equal rows
are documents of their own, so all they hold is repeated; a text is walked CHUNK bytes at a time, however long it is; other columns are not
read. Rows of one id (or of none) are told apart by a 64-bit hash of their texts. Equality of segments is equality of two 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import discard, joined_bytes, map_arrow, mix, powers, prefix_hash, written
from passwatch.llm.embeddings import runs

WINDOW = 200
GRAMS = (96, 160, WINDOW)
STRIDE = 200  # most windows in a segment
MOST = 2048
COLLECTION = 512
CHUNK = 1 << 21
END = 0xFF  # never a byte of UTF-8
NO_ID = -(1 << 63)


def segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each segment of the texts of a joined byte array, and whether its key's string
    leaves one of its windows and stands in the next: only then can windows of the segment equal each other."""
    gram = min(gram, window)
    n, wide = len(data), window - gram + 1
    count = n - window + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    prefix = prefix_hash(data)
    down = powers(n + 1)[1]
    grams = mix((prefix[gram:] - prefix[: n - gram + 1]) * down[: n - gram + 1])
    # the least of every `wide` consecutive hashes, from running minima of blocks in both directions
    block = np.concatenate([grams, np.full(-len(grams) % wide, np.iinfo(np.uint64).max)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[wide - 1 : wide - 1 + count])
    end = np.repeat(offsets[1:], np.diff(offsets))[:count]
    whole = np.arange(count) + window <= end
    cut = np.ones(count + 1, bool)
    cut[1:count] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1]) | (end[1:] != end[:-1])
    twice = np.concatenate([[0, 0], np.cumsum((grams[: count - 1] == least[:-1]) & ~cut[1:count])])  # up to and with each window
    edge = np.flatnonzero(cut)
    start, stop = edge[:-1], edge[1:]
    keep = whole[start]
    start, stop = start[keep], stop[keep]
    parts = -(-(stop - start) // STRIDE)
    of = np.repeat(np.arange(len(start)), parts)
    first = start[of] + STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    last = np.minimum(first + STRIDE, stop[of])
    return first, last - first, least[first], twice[last] > twice[first + 1]


def walked(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """segments() of CHUNK windows at a time, so that its memory doesn't follow the longest text."""
    parts = []
    for a in range(0, max(len(data) - window + 1, 1), CHUNK):
        part = data[a : a + CHUNK + window - 1]
        start, *rest = segments(part, np.clip(offsets - a, 0, len(part)), window, gram)
        parts.append((start + a, *rest))
    return tuple(np.concatenate(c) for c in zip(*parts))


#: A row of the transform is label << 8 | symbol; an entry of the piles is first symbol << PILE | label << 8 | common prefix, where the label is
#: that of the suffix behind the first symbol. Labels ascend in the order of the suffixes and leave room between each other.
PILE = 54
LABELS = 1 << 46


def spread(n: int) -> np.ndarray:
    """n labels at even distances, in place."""
    return (np.arange(1, n + 1) * (LABELS // (n + 1))) << 8


def transform(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of the collection (END: a piece has no symbol left) and the common prefixes of its suffixes, each with the row before
    and never above the window. The first rows are the empty suffixes, in the order of the pieces.

    Row r holds a suffix, and entry r of the piles that suffix cut into its first symbol and the label of the rest, so a new suffix finds its
    place among the piles by the symbol before an old one and the old one's label. Neighbours in a pile lead back to the rows between
    which the common prefix is the least of a range.
    """
    n = len(pieces)
    size = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    first = np.cumsum(size) - size
    last = first + size - 1
    rows = np.append(spread(n) | text[last], LABELS << 8 | END)  # the last row and entry only bound the others
    piles = np.append(np.full(n, -256), np.iinfo(np.int64).max)
    live, at, length = np.arange(n), np.arange(n), 0
    while m := len(live):
        length += 1
        symbol = rows[at] & 255
        entry = symbol << PILE | rows[at] & -256
        by = np.argsort(entry)
        place = piles.searchsorted(entry[by])
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        many, gap = np.diff(start, append=m), place[start]
        if (((rows[gap] >> 8) - (rows[gap - 1] >> 8)) <= many).any():  # no room for new labels
            order = np.argsort((rows[:-1] & 255).astype(np.uint8), kind="stable")
            extended = rows[:-1] & 255 != END
            extended[at] = False
            order = order[extended[order]]
            rows[:-1] = spread(len(rows) - 1) | rows[:-1] & 255
            piles[n:-1] = (rows[order] & 255) << PILE | rows[order] & -256 | piles[n:-1] & 255
            entry = symbol << PILE | rows[at] & -256
        entry, symbol = entry[by], symbol[by]
        low = rows[gap - 1] >> 8
        step = ((rows[gap] >> 8) - low) // (many + 1)
        label = np.repeat(low, many) + np.repeat(step, many) * (np.arange(1, m + 1) - np.repeat(start, many))
        new = place + np.arange(m)
        old = np.ones(len(rows) + m, bool)
        old[new] = False
        common = piles.view(np.uint8)[::8].copy()
        piles = merged(piles, entry, old, new)
        # for each old row, in their order: the row that leads to the neighbour before, itself, the row that leads to the one behind
        edge = np.empty((m, 3), np.int64)
        before, behind = piles[new - 1], piles[new + 1]
        has_before, has_behind = before >> PILE == symbol, behind >> PILE == symbol
        edge[:, 1] = at + 1
        edge[by, 0] = np.where(has_before, rows.searchsorted(before & ((LABELS - 1) << 8)) + 1, at[by])
        edge[by, 2] = np.where(has_behind, rows.searchsorted(behind & ((LABELS - 1) << 8)) + 1, at[by] + 2)
        least = np.minimum.reduceat(common, np.minimum(edge.ravel(), len(common) - 1)).reshape(m, 3)[by]
        shared = np.minimum(least, window - 1).astype(np.int64) + 1
        piles[new[has_before]] |= shared[has_before, 0]
        next_ = new[has_behind] + 1
        piles[next_] = piles[next_] & -256 | shared[has_behind, 1]
        live = live[by]
        more = length < size[live]
        rows = merged(rows, label << 8 | np.where(more, text[np.maximum(last[live] - length, 0)], END), old, new)
        live, at = live[more], new[more]
    return (rows[:-1] & 255).astype(np.uint8), piles[:-1].view(np.uint8)[::8]


def merged(stream: np.ndarray, added: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """A stream written anew with rows added."""
    out = np.empty(len(old), stream.dtype)
    out[old] = stream
    out[new] = added
    return out


def window_runs(pieces: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each piece the runs [a, b) of window starts whose window occurs once more in the collection."""
    n = len(pieces)
    b, common = transform(pieces, window)
    order = np.argsort(b, kind="stable")
    rank = np.empty(len(b), np.int64)
    rank[order] = np.arange(n, n + len(b))
    shared = np.append(common >= window, False)
    shared[:-1] |= shared[1:]
    # from each piece's empty suffix back to its front, one symbol a step
    size = np.array([len(p) for p in pieces])
    end = np.cumsum(size)
    here = np.arange(n)
    repeated = np.zeros(end[-1], bool)
    for step in range(int(size.max())):
        on = size > step
        here[on] = rank[here[on]]
        repeated[end[on] - 1 - step] = shared[here[on]]
    out = []
    for z, m in zip(end.tolist(), size.tolist()):
        edge = np.flatnonzero(np.diff(repeated[z - m : z - m + max(m - window + 1, 0)].astype(np.int8), prepend=0, append=0))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


def tag_of(body: bytes) -> int:
    """64 bits that tell rows of one id apart."""
    return xxhash.xxh3_64_intdigest(body) - (1 << 63)


def hashes_of(body: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each body[start:end]."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(body[a:z]) for a, z in zip(start.tolist(), end.tolist())), np.uint64, len(start)).view(np.int64)


def keyed(docs: DataFrame, window: int, with_content: bool) -> DataFrame:
    """key, and with_content also content (a hash), doc, tag and place (inner, first window, windows - 1) of every segment."""
    schema = "key long" + ", content long, doc long, tag long, place long" * with_content

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = joined_bytes(batch.column(1))
        start, windows, key, inner = walked(data, offsets, window, GRAMS[0])
        if not with_content:
            key = np.concatenate([key, key[inner]])  # a key that may repeat within one segment counts as one that does
            return pa.record_batch([pa.array(key.view(np.int64))], ["key"])
        body = memoryview(np.ascontiguousarray(data))
        content = hashes_of(body, start, start + windows + window - 1)
        tags = np.array([tag_of(body[a:z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)
        owner = np.searchsorted(offsets, start, side="right") - 1
        place = (inner.astype(np.int64) << 39) | ((start - offsets[owner]) << 8) | (windows - 1)
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(content), batch.column(0).take(pa.array(owner)), pa.array(tags[owner]), pa.array(place)], ["key", "content", "doc", "tag", "place"])

    return map_arrow(docs, kernel, schema, "text")


def packed(docs: DataFrame) -> DataFrame:
    """doc, tag and the compressed text, for a shuffle by doc and tag."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=1)
        bodies = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([tag_of(t) for t in bodies], pa.int64()), pa.array([press.compress(t) for t in bodies], pa.binary())], ["doc", "tag", "body"])

    return map_arrow(docs, kernel, "doc long, tag long, body binary", "text")


def pieces_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """key, content, copies, rivals, longest and piece (bytes) of the segments `wanted` (also doc, tag, place), cut from their texts."""
    lists = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "content", "copies", "rivals", "longest", "place")).alias("parts"))
    joined = packed(docs).join(lists, ["doc", "tag"]).select("body", "parts")
    names = ["key", "content", "copies", "rivals", "longest"]

    def cut(batches):
        for batch in batches:
            for body, parts in zip(batch.column(0), batch.column(1)):
                text = zstandard.ZstdDecompressor().decompress(body.as_py())
                rows = [(*(p[c] for c in names), text[(a := p["place"] >> 8 & 0x7FFFFFFF) : a + (p["place"] & 255) + window]) for p in parts.as_py()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(),) * 5 + (pa.binary(),))], [*names, "piece"])

    return joined.mapInArrow(cut, "key long, content long, copies long, rivals long, longest long, piece binary").dropDuplicates(["key", "content"])


def rivals_of(contents: DataFrame) -> DataFrame:
    """key, rivals (different segments) and longest of the keys whose windows aren't settled yet. contents: key, content, copies, inner, windows."""
    own = F.col("inner") & (F.col("copies") == 1)
    keys = contents.groupBy("key").agg(F.count("*").alias("rivals"), F.min("copies").alias("fewest"), F.max(own).alias("inner"), F.max("windows").cast("long").alias("longest"))
    return keys.where("fewest = 1 and (rivals > 1 or inner)").select("key", "rivals", "longest")


RUNS = "array<struct<a:int,b:int>>"


def constructed(pieces: DataFrame, window: int) -> DataFrame:
    """key, content and runs (window starts from, to) of the pieces without a copy that share some window with a rival.

    Keys are taken by the length of their segments, so that the segments of a collection end in about the same round."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def build(batches):
        held: list[tuple] = []

        def flush():
            rows = [(k, c, r) for (k, c, copies, _), r in zip(held, window_runs([p for *_, p in held], window)) if r and copies == 1]
            held.clear()
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in r[2]] for r in rows], kind)], ["key", "content", "runs"])

        for group in runs(batches):
            rows = list(zip(*(group[c].to_pylist() for c in ("key", "content", "copies", "piece"))))
            if held and len(held) + len(rows) > COLLECTION:
                yield flush()
            held.extend(rows)
        if held:
            yield flush()

    return pieces.repartition("key").sortWithinPartitions("longest", "key").select("key", "content", "copies", "piece").mapInArrow(build, f"key long, content long, runs {RUNS}")


def finer(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """key and content of the pieces, and their segments by longer strings: sub, part (key and content), copies, start, windows, inner, body."""
    names = ["key", "content", "sub", "part", "copies", "start", "windows", "inner", "body"]

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["piece"], np.uint8)
                start, windows, key, inner = segments(data, np.array([0, len(data)]), window, gram)
                sub = mix(key ^ np.uint64(row["key"] & ((1 << 64) - 1))).view(np.int64)
                end = start + windows + window - 1
                same = [pa.array(np.full(len(start), row[c]), pa.int64()) for c in ("key", "content", "copies")]
                body = pa.array([row["piece"][a:z] for a, z in zip(start.tolist(), end.tolist())], pa.binary())
                yield pa.record_batch([same[0], same[1], pa.array(sub), pa.array(hashes_of(row["piece"], start, end)), same[2], pa.array(start.astype(np.int32)), pa.array(windows), pa.array(inner), body], names)

    return pieces.mapInArrow(cut, "key long, content long, sub long, part long, copies long, start int, windows long, inner boolean, body binary")


def settled(pieces: DataFrame, window: int, rung: int = 0) -> DataFrame:
    """key, content and runs of the pieces without a copy that share some window with a rival; keys with very many rivals by longer strings."""
    if rung + 1 == len(GRAMS):
        return constructed(pieces, window)
    few, many = constructed(pieces.where(F.col("rivals") <= MOST), window), pieces.where(F.col("rivals") > MOST)
    if many.isEmpty():
        return few
    subs = written(finer(many, window, GRAMS[rung + 1]), "subs")
    contents = subs.groupBy(F.col("sub").alias("key"), F.col("part").alias("content")).agg(F.sum("copies").alias("copies"), F.max("inner").alias("inner"), F.max("windows").alias("windows"), F.min("body").alias("piece"))
    contents = written(contents, "parts")
    partly = settled(contents.join(rivals_of(contents), "key"), window, rung + 1)
    found = contents.where("copies > 1").select("key", "content", F.lit(None).cast(RUNS).alias("runs")).unionByName(partly)
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").cast("int").alias("b")))
    shifted = F.transform(F.coalesce("runs", whole), lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"]).alias("b")))
    joined = subs.where("copies = 1").join(found.select(F.col("key").alias("sub"), F.col("content").alias("part"), "runs"), ["sub", "part"])
    return few.unionByName(joined.groupBy("key", "content").agg(F.flatten(F.collect_list(shifted)).alias("runs")))


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, tag and runs (window starts from, to) of every text that has a repeated window. docs: doc, text."""
    often = keyed(docs, window, False).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = written(keyed(docs, window, True).join(often, "key", "left_semi"), "segments")
    counted = shared.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "tag", "place")).alias("one"))
    place = F.col("one.place")
    contents = written(counted.select("key", "content", "copies", "one", (F.shiftright(place, 39) != 0).alias("inner"), (place.bitwiseAND(F.lit(255)) + 1).alias("windows")), "contents")
    wanted = contents.join(rivals_of(contents), "key").select("key", "content", "copies", "rivals", "longest", "one.doc", "one.tag", "one.place")
    pieces = written(pieces_of(docs, wanted, window), "pieces")
    whole = contents.where("copies > 1").select("key", "content", F.lit(None).cast(RUNS).alias("runs"))
    found = written(whole.unionByName(settled(pieces, window)), "repeats")
    start, all_of = F.shiftright("place", 8).bitwiseAND(F.lit(0x7FFFFFFF)), F.col("place").bitwiseAND(F.lit(255)) + 1
    placed = shared.join(found, ["key", "content"]).select(
        "doc",
        "tag",
        F.when(F.col("runs").isNull(), F.array(F.struct(start.alias("a"), (start + all_of).alias("b")))).otherwise(F.transform("runs", lambda r: F.struct((start + r["a"]).alias("a"), (start + r["b"]).alias("b")))).alias("runs"),
    )
    # a set: the segments of rows that are equal in id and text come once, however many such rows there are
    out = written(placed.groupBy("doc", "tag").agg(F.flatten(F.collect_set("runs")).alias("runs")), "spans")
    for done in (shared, contents, pieces, found):
        discard(done)
    return out


def removed(size: int, runs_: list[dict], window: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The byte spans that the windows cover, merged, and the spans that are left."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"] - 1 + window) for r in runs_):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    edges = [0, *(x for s in spans for x in s), size]
    return spans, [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b > a]


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_bytes, removed (array of byte spans a, b) and kept (the bytes that are left) of every row. The key is a long."""
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    joined = packed(docs).join(repeated(docs, window), ["doc", "tag"], "left").select("doc", "body", "runs")

    def cut(batches):
        for batch in batches:
            ids, sizes, spans, kept = [], [], [], []
            for doc, body, found in zip(*(batch.column(i) for i in range(3))):
                data = zstandard.ZstdDecompressor().decompress(body.as_py())
                gone, left = removed(len(data), found.as_py() or [], window)
                ids.append(None if doc.as_py() == NO_ID else doc.as_py())
                sizes.append(len(data))
                spans.append([{"a": a, "b": b} for a, b in gone])
                kept.append(b"".join(data[a:b] for a, b in left))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())], [key, "n_bytes", "removed", "kept"])

    return joined.mapInArrow(cut, f"`{key}` long, n_bytes long, removed array<struct<a:long,b:long>>, kept binary")
