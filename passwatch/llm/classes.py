"""Language-model scores by a class-based n-gram model with exchange clustering.

A text's tokens are its words, lower-cased, and one end. Every word of the training texts has a class; the probability of a token is that of
its class behind the class before it (Witten-Bell smoothing by the classes' own shares) times the word's share of its class. Words with
fewer than FEW occurrences and unknown words are one class, which keeps one place for a word not seen. The end is a class of its own, and
stands before the first word, too. All probabilities behind a class add up to one.

Clustering is the exchange algorithm, run by rounds. The CORE most frequent words begin in classes dealt by rank; a round moves every
second one to the class in which the likelihood of the training texts' class pairs is largest, given all others, and the best round
counts. The tasks that decide get each word's neighbours (of a table), and the matrix of class pairs; at most CORE classes and the
matrix pass the driver. All other words with FEW occurrences or more then go, once, where their neighbours are grouped, to the class with
the largest gain, taken as linear since each has few occurrences against a class's.

A word's count and class reach a text in two ways: the HEAD most frequent words travel to every task; the others are listed by text, joined
with the table of words and brought together again by the row of the text, so that no vocabulary has to fit in memory and a frequent word is no
key of a join.

Edge cases: a null text is empty and has one token, the end; without training texts every token has a base probability of 1 and
all classes are alike; repeated rows are learned and scored each for itself; columns that aren't named in `keep` go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import SPACE, discard, slices, small_batches, written
from passwatch.llm.tally import SLICE, Tally, Words, filter_of, of_group, passes, ranked, word_counts, word_hashes

CLASSES = 128  # besides the end and the few
END = CLASSES
RARE = CLASSES + 1
SIZE = CLASSES + 2
HOLE = 255
CORE = 1 << 14
HEAD = 1 << 18
FEW = 10
ROUNDS = 8
WORD = ~SPACE


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def gains(matrix: np.ndarray, of_matrix: np.ndarray, before: np.ndarray, behind: np.ndarray, own: int = 0) -> np.ndarray:
    """What the likelihood gains when a word joins each of the CLASSES classes. before and behind: its neighbours by class; own: pairs with itself.

    matrix: pairs of classes without the word; of_matrix: xlogx of it.
    """
    move = np.arange(CLASSES)
    x, y = np.flatnonzero(before), np.flatnonzero(behind)
    rows = xlogx(matrix[:CLASSES, y] + behind[y]) - of_matrix[:CLASSES, y]
    cols = xlogx(matrix[x, :CLASSES] + before[x, None]) - of_matrix[x, :CLASSES]
    gain = rows.sum(axis=1) + cols.sum(axis=0)
    # a class's pairs with itself get both kinds of neighbours, and the word's pairs with itself
    diagonal = matrix[move, move]
    gain -= xlogx(diagonal + behind[:CLASSES]) + xlogx(diagonal + before[:CLASSES]) - 2 * of_matrix[move, move]
    gain += xlogx(diagonal + behind[:CLASSES] + before[:CLASSES] + own) - of_matrix[move, move]
    for side, n in ((matrix.sum(axis=1) + before, behind.sum() + own), (matrix.sum(axis=0) + behind, before.sum() + own)):
        gain -= xlogx(side[:CLASSES] + n) - xlogx(side[:CLASSES])
    return gain


def likelihood(matrix: np.ndarray) -> float:
    return float(xlogx(matrix).sum() - xlogx(matrix.sum(axis=1)).sum() - xlogx(matrix.sum(axis=0)).sum())


def tokens(words: Words, ids: np.ndarray, end: int, n: int) -> np.ndarray:
    """The ids of all tokens of n texts, in one row: an end, and then each text's words and its end."""
    size = np.bincount(words.owner, minlength=n) + 1
    out = np.full(int(size.sum()) + 1, end, np.int64)
    out[np.arange(len(ids)) + words.owner + 1] = ids
    return out


def core_pairs(texts: DataFrame, core: pa.Array) -> DataFrame:
    """a, b, n of all neighbouring tokens: places in the core, len(core) for any other word and len(core) + 1 for the end."""
    shared = texts.sparkSession.sparkContext.broadcast(core)
    rare, end = len(core), len(core) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def out() -> pa.RecordBatch:
            a, b, n = tally.take()
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

        for batch in slices(batches, "__text", SLICE):
            words = Words(batch.column(0), WORD)
            row = tokens(words, words.places(shared.value, rare)[words.at], end, batch.num_rows)
            tally.add(row[:-1], row[1:])
            if tally.full:
                yield out()
        yield out()

    return small_batches(texts).mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def summed(parts: DataFrame) -> np.ndarray:
    """The matrix of class pairs that parts (a, b, n) add up to; at most SIZE * SIZE rows reach the driver."""
    out = np.zeros((SIZE, SIZE))
    for a, b, n in parts.groupBy("a", "b").agg(F.sum("n")).collect():
        out[a, b] = n
    return out


def cells(matrix: np.ndarray) -> pa.RecordBatch:
    a, b = np.nonzero(matrix)
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(matrix[a, b].astype(np.int64))], ["a", "b", "n"])


def exchange(pairs: DataFrame, n_core: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each core word, of other words and of the end; matrix of class pairs). pairs: as core_pairs() gives it.

    A word's row holds at most 2 * (n_core + 2) neighbours, which the core bounds.
    """
    sides = pairs.select(F.col("b").alias("w"), F.lit(0).alias("side"), F.col("a").alias("other"), "n").unionByName(pairs.select(F.col("a").alias("w"), F.lit(1).alias("side"), F.col("b").alias("other"), "n"))
    rows = written(sides.groupBy("w").agg(F.collect_list(F.struct("side", "other", "n")).alias("o")).select("w", "o.side", "o.other", "o.n"), "neighbours")
    spark = pairs.sparkSession

    def neighbours(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        edge = batch.column(1).offsets.to_numpy()
        side, other, n = (batch.column(k).values.to_numpy() for k in (1, 2, 3))
        for w, a, z in zip(batch.column(0).to_pylist(), edge[:-1].tolist(), edge[1:].tolist()):
            yield w, side[a:z], other[a:z], n[a:z]

    def matrix_of(classes: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, out = shared.value, np.zeros((SIZE, SIZE))
            for batch in batches:
                for w, side, other, n in neighbours(batch):
                    out[of[w]] += np.bincount(of[other[side == 1]], n[side == 1], SIZE)
            yield cells(out)

        return summed(rows.mapInArrow(run, "a long, b long, n long"))

    classes = np.append(np.arange(n_core) % CLASSES, [RARE, END]).astype(np.int64)
    matrix = matrix_of(classes)
    best = (likelihood(matrix), classes, matrix)
    for turn in range(rounds if n_core else 0):
        shared = spark.sparkContext.broadcast((classes, matrix))

        def moves(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            of, m = shared.value
            logs = xlogx(m)
            at, to = [], []
            for batch in batches:
                for w, side, other, n in neighbours(batch):
                    if w >= n_core or (w + turn) % 2:
                        continue
                    own = int(n[(other == w) & (side == 1)].sum())
                    before, behind = (np.bincount(of[other[s]], n[s], SIZE) for s in ((side == 0) & (other != w), (side == 1) & (other != w)))
                    a = of[w]
                    row, col, log_row, log_col = m[a].copy(), m[:, a].copy(), logs[a].copy(), logs[:, a].copy()
                    m[a] -= behind
                    m[:, a] -= before
                    m[a, a] -= own
                    logs[a], logs[:, a] = xlogx(m[a]), xlogx(m[:, a])
                    gain = gains(m, logs, before, behind, own)
                    m[a], logs[a] = row, log_row
                    m[:, a], logs[:, a] = col, log_col
                    if gain.max() > gain[a] + 1e-6:
                        at.append(w)
                        to.append(int(gain.argmax()))
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(to, pa.int64())], ["w", "to"])

        found = rows.mapInArrow(moves, "w long, to long").collect()  # at most n_core rows
        if not found:
            if turn % 2:
                break
            continue
        classes = classes.copy()
        for w, to in found:
            classes[w] = to
        matrix = matrix_of(classes)
        if (now := likelihood(matrix)) > best[0]:
            best = (now, classes, matrix)
    discard(rows)
    return best[1], best[2]


def hashed(words: DataFrame) -> DataFrame:
    """words (word, n) with hash, the hash that the tasks know a word by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(word_hashes(batch.column(0)).view(np.int64))], ["word", "n", "hash"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, hash long")


def class_of_others(texts: DataFrame, core: pa.Array, classes: np.ndarray, matrix: np.ndarray, others: DataFrame) -> DataFrame:
    """word, n, class of the words `others` (word, n), which aren't in the core.

    Neighbours are grouped by the words' hashes; should two hashes agree, both words get the class of their neighbours together.
    """
    named = written(hashed(others), "others")
    shared = texts.sparkSession.sparkContext.broadcast((core, classes, filter_of(named.select(F.col("hash").alias("seed")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of, bits = shared.value
        for batch in slices(batches, "__text", SLICE):
            words = Words(batch.column(0), WORD)
            kind = of[words.places(known, len(known))]
            hashes = word_hashes(words.dictionary)
            number = np.where((kind == RARE) & passes(bits, hashes), np.arange(len(kind)), -1)
            row, own = (tokens(words, x[words.at], e, batch.num_rows) for x, e in ((kind, END), (number, -1)))
            at = np.flatnonzero(own >= 0)
            code, n = np.unique(np.concatenate([own[at] * (2 * SIZE) + row[at - 1], own[at] * (2 * SIZE) + SIZE + row[at + 1]]), return_counts=True)
            yield pa.record_batch([pa.array(hashes[code // (2 * SIZE)].view(np.int64)), pa.array((code % (2 * SIZE)).astype(np.int32)), pa.array(n)], ["hash", "code", "m"])

    logs = np.log(matrix + 0.5)
    left, right = np.log(matrix.sum(axis=1) + 0.5)[:CLASSES], np.log(matrix.sum(axis=0) + 0.5)[:CLASSES]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edge = batch.column(1).offsets.to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(edge))
            code, m = (batch.column(k).values.to_numpy()[edge[0] : edge[-1]] for k in (1, 2))
            both = np.bincount(owner * (2 * SIZE) + code, m, batch.num_rows * 2 * SIZE).reshape(-1, 2 * SIZE)
            before, behind = both[:, :SIZE], both[:, SIZE:]
            gain = before @ logs[:, :CLASSES] + behind @ logs[:CLASSES].T - before.sum(axis=1, keepdims=True) * right - behind.sum(axis=1, keepdims=True) * left
            yield pa.record_batch([batch.column(0), pa.array(gain.argmax(axis=1))], ["hash", "class"])

    # dealt by the word once: both groupings stay where the rows are; a word has at most 2 * SIZE codes
    near = small_batches(texts).mapInArrow(run, "hash long, code int, m long").repartition("hash").groupBy("hash", "code").agg(F.sum("m").alias("m"))
    near = near.groupBy("hash").agg(F.collect_list(F.struct("code", "m")).alias("o")).select("hash", "o.code", "o.m").mapInArrow(choose, "hash long, class long")
    return named.join(near, "hash").select("word", "n", "class")


def word_classes(texts: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """word, n, class of every word of the training texts. counts: lang, word, n of them."""
    _, (core,) = of_group(ranked(counts.where(F.col("n") >= FEW), ["word"], CORE), "")
    pairs = written(core_pairs(texts, core), "pairs")
    classes, matrix = exchange(pairs, len(core), rounds)
    spark = texts.sparkSession
    settled = spark.createDataFrame(pa.table({"word": core.cast(pa.large_string()).cast(pa.string()), "class": classes[: len(core)]}))
    others = counts.where(F.col("n") >= FEW).join(settled, "word", "left_anti")
    return (
        counts.join(settled, "word")
        .select("word", "n", "class")
        .unionByName(class_of_others(texts, core, classes, matrix, others))
        .unionByName(counts.where(F.col("n") < FEW).select("word", "n", F.lit(RARE).cast("long").alias("class")))
    )


def score(docs: DataFrame, learn: Column, text: str = "text", keep: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The columns `keep` of each row with n_tokens, n_known, train_tokens, base_score and score (both log10). The rows where `learn` is true train the model."""
    names = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    rows = docs.select(*names, F.coalesce(learn, F.lit(False)).alias("__learn"), F.col(text).alias("__text"))
    texts = rows.where("__learn").select("__text")
    counted = written(word_counts(texts.select(F.lit("").alias("lang"), "__text"), WORD), "words")
    ends = texts.count()
    total = (counted.where("word is null").agg(F.sum("n")).first()[0] or 0) + ends
    counts = counted.where("word is not null")
    kinds = counts.count() + (ends > 0)
    table = written(word_classes(texts, counts, rounds), "classes")
    sums = np.zeros((2, SIZE))
    for c, n, v in table.groupBy("class").agg(F.sum("n"), F.count("*")).collect():  # at most SIZE rows
        sums[:, c] = n, v
    sums[:, END] = max(ends, 1), 1
    frequent = table.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()  # at most HEAD rows
    last = frequent.slice(max(frequent.num_rows - 1, 0)).to_pylist()
    head = spark.sparkContext.broadcast(tuple(frequent.column(c).combine_chunks() for c in ("word", "n", "class")))
    below = np.log10(total + kinds + 1)

    def emission(n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; a word not seen has n = 0 and the class RARE."""
        rare = of == RARE
        return np.log10(np.where(rare, n + 1, n) / np.where(rare, sums[0, RARE] + sums[1, RARE] + 1, np.maximum(sums[0], 1)[of]))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value[0].cast(pa.large_string()).cast(pa.large_binary())
        n_of, class_of = (np.append(head.value[k].to_numpy(), x) for k, x in ((1, 0), (2, HOLE)))
        for batch in slices(batches, "__text", SLICE):
            words, n = Words(batch.column(len(names) + 1), WORD), batch.num_rows
            place = words.places(known, len(known))
            count, of = n_of[place], class_of[place]
            hole = of == HOLE
            own = np.where(hole, 0.0, emission(count, np.where(hole, RARE, of)))
            base = np.where(hole, 0.0, np.log10(count + 1.0) - below)
            size = np.bincount(words.owner, minlength=n)
            row = np.full(int(size.sum()) + n, END, np.uint8)
            row[np.arange(len(words.at)) + words.owner] = of[words.at]
            edge = np.append(0, np.cumsum(size + 1))
            # the words that only the table of words knows: each once a text, and which of them stands in each hole
            at, kinds_of = np.flatnonzero(hole[words.at]), max(len(place), 1)
            pairs, back = np.unique(words.owner[at] * kinds_of + words.at[at], return_inverse=True)
            begin = np.searchsorted(pairs // kinds_of, np.arange(n + 1))
            spare = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), words.dictionary.take(pa.array(pairs % kinds_of)).cast(pa.large_string()).cast(pa.string()))
            holes = np.searchsorted(words.owner[at], np.arange(n + 1))
            which = pa.ListArray.from_arrays(pa.array(holes.astype(np.int32)), pa.array((back - begin[pairs[back] // kinds_of]).astype(np.int32)))
            body = row.tobytes()
            seq = pa.array([body[a:z] for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())
            sums_of = [np.bincount(words.owner, x[words.at], n).astype(np.float64) for x in (own, base, ~hole)]  # of no words numpy counts in whole numbers
            yield pa.record_batch(
                [*batch.columns[: len(names) + 1], seq, pa.array(sums_of[0]), pa.array(sums_of[1] + (np.log10(ends + 1.0) - below)), pa.array(sums_of[2].astype(np.int64) + (ends > 0)), spare, which],
                [*names, "__learn", "__seq", "__own", "__base", "__known", "__spare", "__which"],
            )

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*names])
    coded = small_batches(rows).mapInArrow(code, f"{kept}, __learn boolean, __seq binary, __own double, __base double, __known long, __spare array<string>, __which array<int>")
    coded = written(coded.withColumn("__row", F.monotonically_increasing_id()), "coded")
    asked = coded.select("__row", F.posexplode("__spare").alias("__j", "word"))
    rest = table.where((F.col("n") < last[0]["n"]) | ((F.col("n") == last[0]["n"]) & (F.col("word") > last[0]["word"]))) if last else table
    got = asked.join(rest, "word").groupBy("__row").agg(F.collect_list(F.struct("__j", "n", "class")).alias("o")).select("__row", F.col("o.__j").alias("__j"), F.col("o.n").alias("__n"), F.col("o.class").alias("__class"))
    joined = coded.withColumn("__n_spare", F.size("__spare")).drop("__spare").join(got, "__row", "left").drop("__row")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            out = []
            for seq, own, base, seen, which, n_spare, j, n, of in zip(*(col[c].to_pylist() if c in ("__seq", "__own", "__base", "__known", "__n_spare") else lists(col[c]) for c in ("__seq", "__own", "__base", "__known", "__which", "__n_spare", "__j", "__n", "__class"))):
                if n_spare:
                    count, kind = np.zeros(n_spare, np.int64), np.full(n_spare, RARE, np.int64)
                    count[j], kind[j] = n, of
                    row = np.frombuffer(seq, np.uint8).copy()
                    row[row == HOLE] = kind[which]
                    seq = row.tobytes()
                    own += float(emission(count, kind)[which].sum())
                    base += float((np.log10(count + 1.0) - below)[which].sum())
                    seen += int((count > 0)[which].sum())
                out.append((seq, own, base, seen))
            cols = list(zip(*out)) or [[]] * 4
            kinds_of = (pa.binary(), pa.float64(), pa.float64(), pa.int64())
            yield pa.record_batch([*(col[c] for c in names), col["__learn"], *(pa.array(c, k) for c, k in zip(cols, kinds_of))], [*names, "__learn", "__seq", "__own", "__base", "__known"])

    filled = written(joined.mapInArrow(fill, f"{kept}, __learn boolean, __seq binary, __own double, __base double, __known long"), "filled")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SIZE * SIZE)
        for batch in batches:
            row = np.frombuffer(bytes([END]) + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            out += np.bincount(row[:-1] * SIZE + row[1:], minlength=SIZE * SIZE)
        yield cells(out.reshape(SIZE, SIZE))

    step = np.log10(transitions(summed(filled.where("__learn").select("__seq").mapInArrow(follow, "a long, b long, n long"))))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("__seq").to_pylist()
            size = np.array([len(x) for x in seqs], np.int64)
            row = np.frombuffer(bytes([END]) + b"".join(seqs), np.uint8).astype(np.int64)
            way = np.bincount(np.repeat(np.arange(len(seqs)), size), step[row[:-1], row[1:]], len(seqs)).astype(np.float64)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(size), batch.column("__known"), pa.array(np.full(len(seqs), total)), batch.column("__base"), pa.array(way + batch.column("__own").to_numpy())], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return filled.mapInArrow(walk, f"{kept}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The values of each list of a list array, empty for a null."""
    edge, values = column.offsets.to_numpy(), column.values.to_numpy()
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield values[a:z]


def transitions(pairs: np.ndarray) -> np.ndarray:
    """The probability of each class (column) behind each class (row): Witten-Bell, with one more occurrence of each class in their own shares."""
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + SIZE)
    n, kinds = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True)
    return (pairs + np.maximum(kinds, 1) * share) / (n + np.maximum(kinds, 1))
