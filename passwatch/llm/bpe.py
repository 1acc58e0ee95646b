"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's merges are taken in order of rank, leftmost first within a rank. The queue holds one bucket of linked-list
positions per rank that is pending, and two levels of bitmap words above the ranks; find-first-set in the top word
and then in the low word that it names gives the next rank. A merge leaves the entries of the pairs that it broke in their
buckets: they are stale and skipped when they surface. n bytes thus cost O(n log n) however long the pre-token is.
Short pre-tokens run the same queue many at a time, in lanes of arrays; long ones run it one by one.

Edge cases: a null text is an empty one; an empty text has no tokens and decodes to no bytes; repeated rows are encoded
each for itself; other columns are not read, so their names cannot clash (the two outputs replace columns of their name).
"""

from __future__ import annotations

import base64
import re
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import map_arrow, texts_of

#: A worker keeps the ids of at most about three times this many different pre-tokens, each of at most CACHED_LENGTH characters.
CACHE_SIZE = 150_000
CACHED_LENGTH = 48
#: Pre-tokens of at most LANE_BYTES bytes are merged LANES at a time in lock-step; longer ones one by one.
LANES = 4096
LANE_BYTES = 64
WORD = 8  # bits of a rank that a low word of the bitmap holds
BIT = [1 << i for i in range(1 << WORD)]
ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)


def latin_form(pattern: str) -> str:
    """The pattern for texts of Latin-1 characters only, with its classes written out: the standard engine runs it faster."""
    members = {c: "".join(re.escape(x) for x in map(chr, range(256)) if regex.match(c, x)) for c in (r"\p{L}", r"\p{N}", r"\s")}

    def spelled(found: re.Match) -> str:
        text, inside = found[0], found[0].startswith("[")
        if text == r"\S":
            return f"[^{members[chr(92) + 's']}]"
        for name, some in members.items():
            text = text.replace(name, some if inside else f"[{some}]")
        return text

    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", spelled, pattern)


def first_set(words: np.ndarray) -> np.ndarray:
    """The number of the lowest bit that is set in each 64-bit word."""
    return np.bitwise_count((words & (~words + np.uint64(1))) - np.uint64(1)).astype(np.int64)


class Lanes:
    """The rank queue of many short pre-tokens in lock-step, one lane each.

    A lane has three levels of 64-bit bitmap words over the ranks, a linked list of its parts, and the pending rank of the pair
    that starts at each part; the positions of a rank's bucket are those that have it pending. A rank whose bucket has no
    position left is stale and only cleared.
    """

    def __init__(self, ranks: dict[bytes, int], n_ranks: int):
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        self.n = n_ranks
        both = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    both[a * n_ranks + b] = rank
        self.keys = np.array(sorted(both) or [-1], np.int64)
        self.merged = np.array([both.get(k, -1) for k in self.keys.tolist()], np.int64)
        self.span = ((n_ranks >> 6) + 1, (n_ranks >> 12) + 1)
        self.low, self.mid, self.top = (np.zeros(LANES * k, np.uint64) for k in (*self.span, 1))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def push(self, lane: np.ndarray, rank: np.ndarray) -> None:
        """One rank for each of some different lanes."""
        word, level = lane * self.span[0] + (rank >> 6), lane * self.span[1] + (rank >> 12)
        self.low[word] |= ONE[rank & 63]
        self.mid[level] |= ONE[rank >> 6 & 63]
        self.top[lane] |= ONE[rank >> 12]

    def clear(self, lane: np.ndarray, rank: np.ndarray) -> None:
        word = lane * self.span[0] + (rank >> 6)
        self.low[word] = left = self.low[word] & ~ONE[rank & 63]
        empty = left == 0
        lane, rank = lane[empty], rank[empty]
        level = lane * self.span[1] + (rank >> 12)
        self.mid[level] = left = self.mid[level] & ~ONE[rank >> 6 & 63]
        empty = left == 0
        lane, rank = lane[empty], rank[empty]
        self.top[lane] &= ~ONE[rank >> 12]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (int32 bytes) of at most LANES pieces of 1 to LANE_BYTES bytes."""
        size = np.array([len(p) for p in pieces])
        wide, n = int(size.max()), len(pieces)
        inside = np.arange(wide) < size[:, None]
        # flat arrays of n rows of wide + 1 cells: the id of the part that starts at a cell (-1: none), its neighbours, its pair's rank
        row = wide + 1
        part = np.full((n, row), -1, np.int64)
        part[:, :wide][inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, row + 1, dtype=np.int64), n)
        before = np.tile(np.arange(-1, wide, dtype=np.int64), n)
        pending = np.full((n, row), -1, np.int64)
        lane, at = np.nonzero(inside[:, 1:])
        pending[lane, at] = self.pair(part[lane, at], part[lane, at + 1])
        for column in range(wide):
            lane = np.flatnonzero(pending[:, column] >= 0)
            self.push(lane, pending[lane, column])
        flat, waiting = part.ravel(), pending.ravel()
        lane = np.flatnonzero(self.top[:n])
        while len(lane):
            level = first_set(self.top[lane])
            word = (level << 6) + first_set(self.mid[lane * self.span[1] + level])
            rank = (word << 6) + first_set(self.low[lane * self.span[0] + word])
            hit = pending[lane] == rank[:, None]
            i = hit.argmax(axis=1)
            live = hit[np.arange(len(lane)), i]
            last = hit.sum(axis=1) < 2
            self.clear(lane[last], rank[last])
            own, i, rank = lane[live], i[live], rank[live]
            base = own * row
            gone = after[base + i]
            end = after[base + gone]
            flat[base + i] = rank
            flat[base + gone] = -1
            waiting[base + gone] = -1
            waiting[base + i] = -1
            after[base + i] = end
            before[base + np.minimum(end, wide)] = i
            left = before[base + i]
            more, less = end < size[own], left >= 0
            found = self.pair(np.concatenate([rank[more], flat[(base + left)[less]]]), np.concatenate([flat[(base + end)[more]], rank[less]]))
            right_rank, left_rank = found[: more.sum()], found[more.sum() :]
            for k, at, got in ((own[more], (base + i)[more], right_rank), (own[less], (base + left)[less], left_rank)):
                waiting[at] = got
                new = got >= 0
                self.push(k[new], got[new])
            lane = lane[self.top[lane] != 0]
        alive = part >= 0
        ids, edge = part[alive].astype(np.int32).tobytes(), (4 * np.concatenate([[0], np.cumsum(alive.sum(axis=1))])).tolist()
        return [ids[a:b] for a, b in zip(edge, edge[1:])]


class Codec:
    """Encodes and decodes texts by one vocabulary; keeps ids of pre-tokens in two generations, of which the older is dropped when one is full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.young: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.wide = regex.compile(pattern).findall
        self.latin = re.compile(latin_form(pattern)).findall
        size = max(ranks.values(), default=0) + 1
        self.lanes = Lanes(ranks, size)
        self.low = [0] * ((size >> WORD) + 1)
        self.token = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.first = [None] * (1 << 16)  # ranks of pairs of bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = rank

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.latin(text)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        buckets: positions by pending rank. low: a bitmap of the ranks that have a bucket; top: a bitmap of its words that
        aren't 0. Both are empty again at the end.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        low, first, top = self.low, self.first, 0
        buckets: dict[int, list[int]] = {}
        n = len(piece)
        after = list(range(1, n + 2))  # the start of the next part; n is the end
        before = list(range(-1, n))
        pending = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]  # the rank of the pair that starts here
        pending.append(None)
        for i, rank in enumerate(pending):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> WORD
                    top |= 1 << word
                    low[word] |= BIT[rank & 255]
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << WORD) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                i = bucket[0]
                del buckets[rank]
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            else:
                i = heappop(bucket)
            if pending[i] != rank:
                continue  # stale: the pair was broken or has grown
            gone = after[i]
            end = after[gone]
            pending[gone] = None
            after[i] = end
            if end < n:
                before[end] = i
                found = get(piece[i : after[end]])
            else:
                found = None
            pending[i] = found
            if found is not None:
                if found in buckets:
                    heappush(buckets[found], i)
                else:
                    buckets[found] = [i]
                    word = found >> WORD
                    top |= 1 << word
                    low[word] |= BIT[found & 255]
            left = before[i]
            if left >= 0:
                found = get(piece[left:end])
                if found != pending[left]:
                    pending[left] = found
                    if found is not None:
                        if found in buckets:
                            heappush(buckets[found], left)
                        else:
                            buckets[found] = [left]
                            word = found >> WORD
                            top |= 1 << word
                            low[word] |= BIT[found & 255]
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : after[i]]))
            i = after[i]
        return out

    def ids_of(self, new: list[str]) -> dict[str, bytes]:
        """The ids of each of some different pre-tokens, as int32 bytes."""
        out, short = {}, []
        packed = lambda ids: np.array(ids, np.int32).tobytes()
        for text in new:
            piece = text.encode()
            whole = self.ranks.get(piece)
            if whole is not None:
                out[text] = packed([whole])
            elif len(piece) <= LANE_BYTES:
                short.append((len(piece), text, piece))
            else:
                out[text] = packed(self.merge(piece))
        short.sort()
        for a in range(0, len(short), LANES):
            run = short[a : a + LANES]
            out.update(zip((text for _, text, _ in run), self.lanes.encode([piece for _, _, piece in run])))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Memory follows the texts given at once."""
        split = list(map(self.split, texts))
        absent = set().union(*split).difference(self.young)
        known = {p: self.older[p] for p in absent if p in self.older}
        known |= self.ids_of([p for p in absent if p not in known])
        long = {p: known.pop(p) for p in [p for p in known if len(p) > CACHED_LENGTH]}
        self.young.update(known)
        get = (self.young | long if long else self.young).__getitem__
        out = [np.frombuffer(b"".join(map(get, pieces)), np.int32) for pieces in split]
        if len(self.young) > CACHE_SIZE:
            self.older, self.young = self.young, {}
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file of base64 tokens and ranks, once for each Python worker."""
    if (path, pattern) not in _CODECS:
        with open(path, "rb") as file:
            _CODECS[path, pattern] = Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}, pattern)
    return _CODECS[path, pattern]


def encode(df: DataFrame, text: str, vocabulary: str, pattern: str, keep: list[str], ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns `keep`, the token ids of `text` (array<int>), and their decoded bytes where `decoded` names a column.

    `vocabulary` is the path of a rank file that every executor has. Rows are independent: no shuffle.
    """
    kept = df.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{ids}` array<int>"] + [f"`{decoded}` binary"] * bool(decoded))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary, pattern)
        rows = own.encode(texts_of(batch.column(len(keep))))
        edge = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        out = [*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))]
        if decoded:
            out.append(pa.array(list(map(own.decode, rows)), pa.binary()))
        return pa.record_batch(out, [*keep, ids] + [decoded] * bool(decoded))

    return map_arrow(df.select(*keep, F.col(text).alias("__text")), kernel, schema, "__text")


def decode(df: DataFrame, ids: str, vocabulary: str, pattern: str, keep: list[str], decoded: str = "decoded") -> DataFrame:
    """The columns `keep` and the bytes of an array of ids; a null array gives no bytes."""
    kept = df.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{decoded}` binary"])

    def run(batches):
        for batch in batches:
            own = codec(vocabulary, pattern)
            rows = [own.decode(np.array(r or [], np.int32)) for r in batch.column(len(keep)).to_pylist()]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(rows, pa.binary())], [*keep, decoded])

    return df.select(*keep, ids).mapInArrow(run, schema)
