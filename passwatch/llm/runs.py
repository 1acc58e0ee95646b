"""Periodic runs of words, by an online sparse diagonal program.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends and that is long enough: LEAST words and
EXPONENT times its period. The words of a text are read from left to right. Each word's earlier occurrences, at a distance d, belong to
the diagonal (lag) d; a match lengthens its lag's diagonal, and when a diagonal ends it gives its run at once if it has become long enough.

Frequent words would have as many earlier occurrences as the square of their number, so a word is looked up together with its context:
for lags from m to 2m - 1 (m a power of two) an occurrence counts when the last m words agree. That loses no run. The stretches of m words within a
run of smallest period q >= m can't all have a period of m / 2 or less (the run would have it, too), and one that has none recurs at
distances over m / 2 only, so that at most three earlier occurrences lie within 2m. It occurs at i, i - q and i - 2q in every run of four
periods, so that lags without such a triple stay idle. A context that a text holds fewer than three times goes before m is doubled. Contexts
are named by pairs of names, without hashes, so that nothing depends on chance, and time grows with the words times the logarithm of the text.

Edge cases: null and empty texts have no words, no runs and an empty collapsed text; no run crosses two texts; repeated rows are read each
for itself; columns that aren't named in `keep` go. A text is never cut: a worker holds some 60 bytes for each word of the slice or text in hand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import SPACE, joined_bytes, map_arrow, words_of

LEAST = 6
EXPONENT = 4
WORD = ~SPACE


def symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, pa.Array]:
    """The number of each word in a dictionary, and that dictionary. The words are all maximal runs of word bytes of data."""
    edge = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=edge[1:])
    body = np.ascontiguousarray(data[is_word[data]])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(body)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def lags_of(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (ascending) and lags at which a word in its context has occurred one and two lags before."""
    n = len(names)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    first, size = bounds[owner], size[owner]
    place = np.flatnonzero(size >= max(LEAST, EXPONENT))
    key = owner[place] * (int(names.max(initial=0)) + 1) + names[place]
    out, m = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 1
    context = np.full(n, -1, np.int64)
    while len(place):
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        group = np.cumsum(new) - 1
        often = (np.bincount(group) >= EXPONENT - 1)[group]
        at, group, new = place[order][often], group[often], new[often]
        context[place] = -1
        context[at] = group
        clumped = np.append(False, np.diff(at) <= m // 2) & ~new
        once, own = at[~clumped], group[~clumped]
        for back in (1, 2, 3):
            lag = once[back:] - once[:-back]
            lag[own[back:] != own[:-back]] = 0
            hit = np.flatnonzero((lag >= m) & (lag < 2 * m) & (once[back:] >= 2 * lag))
            i, lag = once[back:][hit], lag[hit]
            again = context[i - 2 * lag] == own[back:][hit]
            out.append((i[again], lag[again]))
        place = np.sort(at)
        place = place[(place - m >= first[place]) & (size[place] >= EXPONENT * 2 * m)]
        place = place[context[place - m] >= 0]
        key = context[place - m] * (int(group.max(initial=0)) + 1) + context[place]
        m *= 2
    i, lag = (np.concatenate(c) for c in zip(*out))
    order = np.argsort(i, kind="stable")
    return i[order], lag[order]


def diagonal(names: np.ndarray, low: int, high: int, i: int, lag: int) -> tuple[int, int]:
    """The ends of the diagonal through i: names[k] == names[k - lag] for k from its start up to its end; the text is names[low:high]."""
    end, step = i + 1, 64
    while end < high:
        differ = names[end : end + step][: high - end] != names[end - lag : end - lag + step][: high - end]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = end + len(differ), step * 2
    start, step = i, 64
    while start - lag > low:
        a = max(start - step, low + lag)
        differ = names[a:start] != names[a - lag : start - lag]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, step = a, step * 2
    return start, end


def runs_of(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of every run of all texts, ordered by text, start and period. bounds: where each text begins, and the end."""
    places, lags = lags_of(names, bounds)
    owner = np.searchsorted(bounds, places, side="right") - 1
    out, text, active = [], -1, {}
    for i, lag, of in zip(places.tolist(), lags.tolist(), owner.tolist()):
        if of != text:
            text, active = of, {}
        if i < active.get(lag, 0):
            continue  # the lag's diagonal already reaches beyond this word
        start, end = diagonal(names, int(bounds[of]), int(bounds[of + 1]), i, lag)
        active[lag] = end
        if end - start + lag >= max(LEAST, EXPONENT * lag):
            out.append((of, start - lag - int(bounds[of]), end - start + lag, lag))
    found = np.array(sorted(out), np.int64).reshape(-1, 4)  # of equal stretches that with the smallest period comes first
    found = found[np.append(True, (found[1:, :3] != found[:-1, :3]).any(axis=1))[: len(found)]]
    return found[np.lexsort([found[:, 3], found[:, 1], found[:, 0]])]


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The words of each of n texts, joined by one space."""
    size = end - start + 1
    edge = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=edge[1:])
    body = np.append(data, np.uint8(0x20))
    source = np.repeat(start - edge[:-1], size) + np.arange(edge[-1])
    source[edge[1:] - 1] = len(data)  # a space behind each word
    bounds = edge[np.searchsorted(owner, np.arange(n + 1))]
    body = body[source]
    last = bounds[1:][np.diff(bounds) > 0] - 1  # but not behind the last of a text
    body = np.delete(body, last)
    bounds -= np.append(0, np.cumsum(np.diff(bounds) > 0))
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body)))


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of each row with n_words, runs (start, length, period; by start, then period) and collapsed.

    collapsed is the text's words joined by one space without those that a run has after its first period.
    """
    names = ["doc_id"] if keep is None else keep
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = joined_bytes(batch.column(len(names)))
        start, end, owner = words_of(data, offsets, WORD)
        n = batch.num_rows
        bounds = np.searchsorted(owner, np.arange(n + 1))
        found = runs_of(symbols(data, start, end)[0], bounds)
        step = np.zeros(len(start) + 1, np.int32)
        begin = bounds[found[:, 0]] + found[:, 1]
        np.add.at(step, begin + found[:, 3], 1)
        np.add.at(step, begin + found[:, 2], -1)
        kept = np.cumsum(step[:-1]) == 0
        rows = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(n + 1)).astype(np.int32)), rows)
        text_out = joined(data, start[kept], end[kept], owner[kept], n).cast(pa.string())
        return pa.record_batch([*batch.columns[: len(names)], pa.array(np.diff(bounds)), lists, text_out], [*names, "n_words", "runs", "collapsed"])

    return map_arrow(docs.select(*names, F.col(text).alias("__text")), kernel, schema, "__text")
