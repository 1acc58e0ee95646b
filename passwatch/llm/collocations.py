"""Phrase collocations: frequent phrases of two and three words whose parts seldom stand apart.

Everything is by language. Words are counted, those with LEAST or more occurrences live on; the HEAD most frequent of them are ranked and sent
to the tasks, the others pass a Bloom filter of bounded size, which only spares work. Pairs of living neighbours are counted by tiles of
ranks (tally.py). Then the frequent pairs are ranked in turn and take the words' place: a phrase of three words is a frequent pair and a word
behind it, counted by the same tiles. All counts are summed by Spark and every bound that follows is exact.

A phrase counts once for each place where it stands within a piece, overlapping ones too. With a its count, a cut behind its first k
words gives l and r, the counts of both parts, and the score floor(1000000 * a * a / (l * r)); the least score of all cuts counts, of equal
ones that with the least k. A phrase within a longer candidate that has half its occurrences or more isn't reported.

Edge cases: null texts are empty, a null language is `und`, other columns are not read, repeated rows count again, an empty table has no
phrases. No group is gathered: a task holds at most its tiles and MOST_CODES codes, and the frequent words travel in joins that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passwatch.llm.common import slices, small_batches, written
from passwatch.llm.tally import MOST_WORDS, SLICE, Lexicon, Tally, Words, by_group, counted, filter_of, of_group, pair_hash, passes, ranked, seeds, word_counts

LEAST = 10
TOP = 2000
COVER = 50  # a longer candidate with this share (in percent) of a phrase's occurrences covers it
SCALE = 1_000_000
HEAD = 1 << 17  # ranked words, and ranked pairs, of all languages together

#: What ends a piece, and what parts words.
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False


def neighbours(words: Words) -> np.ndarray:
    """Whether each word but the last and the next one stand in one piece of one text."""
    breaks = np.zeros(len(words.data) + 1, np.int32)
    np.cumsum(BREAK[words.data], out=breaks[1:])
    return (words.owner[1:] == words.owner[:-1]) & (breaks[words.start[1:]] == breaks[words.end[:-1]])


def pair_counts(texts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, n of neighbours that stand together `least` times or more; words: those with as many occurrences."""
    head = ranked(words, ["word"], HEAD)
    shared = texts.sparkSession.sparkContext.broadcast((head, filter_of(seeds(words, ["word"]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, bits = shared.value
        state: dict[str, tuple[np.ndarray, Lexicon, Tally]] = {}
        tallies: list[Tally] = []

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (rank, lexicon, tally) in state.items():
                a, b, n = tally.take()
                yield from counted([rank, rank], [a, b], lambda own: [lexicon.texts(a[own]), lexicon.texts(b[own])], lang, n)
            state.clear()
            tallies.clear()

        for batch in slices(batches, "__text", SLICE):
            for lang, rows in by_group(batch, 0):
                if lang not in state:
                    rank, (own,) = of_group(heads, lang)
                    state[lang] = rank, Lexicon(lang, own, lambda h: passes(bits, h)), Tally(tallies)
                _, lexicon, tally = state[lang]
                found = Words(rows.column(1), WORD)
                ids = lexicon.of(found.dictionary)[found.at]
                at = np.flatnonzero(neighbours(found) & (ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) else np.zeros(0, np.int64)
                tally.add(ids[at], ids[at + 1])
            if sum(len(x) for _, x, _ in state.values()) > HEAD + MOST_WORDS or any(x.full for x in tallies):
                yield from out()
        yield from out()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, known = (one(shared.value[0].column(k)) for k in (0, 1))
        for batch in batches:
            code, n = batch.column(0), batch.column(2)
            at = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
            a = code.take(pa.array(at)).to_numpy()
            yield pa.record_batch([langs.take(pa.array(a >> 32)), known.take(pa.array(a >> 32)), known.take(pa.array(a & 0xFFFFFFFF)), n.take(pa.array(at))], ["lang", "w1", "w2", "n"])
            yield listed(batch, 3)

    found = small_batches(texts).mapInArrow(run, "code long, words array<string>, n long")
    out = written(found.groupBy("code", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least).mapInArrow(name, "lang string, w1 string, w2 string, n long"), "pairs")
    shared.destroy()
    return out


def listed(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """The rows (code, words, n) without a code, their `width` words as columns."""
    rest = batch.filter(batch.column(0).is_null())
    flat = rest.column(1).flatten()
    cols = [flat.take(pa.array(np.arange(k, len(flat), width))) for k in range(width)]
    return pa.record_batch([*cols, rest.column(2)], ["lang", *(f"w{k}" for k in range(1, width)), "n"])


class Units:
    """Numbers of pairs of a lexicon's words: the ranked ones in their order, then others as they come."""

    def __init__(self, lexicon: Lexicon, first: pa.Array, second: pa.Array) -> None:
        self.codes = (lexicon.of(first) << 32 | lexicon.of(second)).tolist()
        self.ids = {c: i for i, c in enumerate(self.codes)}

    def of(self, codes: np.ndarray) -> np.ndarray:
        used, back = np.unique(codes, return_inverse=True)
        for c in used.tolist():
            if c not in self.ids:
                self.ids[c] = len(self.codes)
                self.codes.append(c)
        return np.fromiter((self.ids[c] for c in used.tolist()), np.int64, len(used))[back]


def triple_counts(texts: DataFrame, words: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, w3, n of three neighbours that stand together `least` times or more; pairs: those with as many occurrences.

    The first pair is one unit, ranked among the pairs, and is counted with the third word by tiles of ranks.
    """
    head, units = ranked(words, ["word"], HEAD), ranked(pairs, ["w1", "w2"], HEAD)
    shared = texts.sparkSession.sparkContext.broadcast((head, units, filter_of(seeds(words, ["word"])), filter_of(seeds(pairs, ["w1", "w2"]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, known, word_bits, pair_bits = shared.value
        state: dict[str, list] = {}
        tallies: list[Tally] = []

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (rank, rank_of_units, lexicon, unit, tally, _) in state.items():
                a, b, n = tally.take()

                def names(own: np.ndarray) -> list[pa.Array]:
                    code = np.array(unit.codes, np.int64)[a[own]]
                    return [lexicon.texts(code >> 32), lexicon.texts(code & 0xFFFFFFFF), lexicon.texts(b[own])]

                yield from counted([rank_of_units, rank], [a, b], names, lang, n)
            state.clear()
            tallies.clear()

        for batch in slices(batches, "__text", SLICE):
            for lang, rows in by_group(batch, 0):
                if lang not in state:
                    rank, (own,) = of_group(heads, lang)
                    rank_of_units, both = of_group(known, lang)
                    lexicon = Lexicon(lang, own, lambda h: passes(word_bits, h))
                    state[lang] = [rank, rank_of_units, lexicon, Units(lexicon, *both), Tally(tallies), np.zeros(0, np.uint64)]
                _, _, lexicon, unit, tally, hashes = state[lang]
                found = Words(rows.column(1), WORD)
                ids = lexicon.of(found.dictionary)[found.at]
                if len(lexicon.hashes) > len(hashes):
                    hashes = state[lang][5] = np.array(lexicon.hashes, np.uint64)
                if len(ids) < 3 or not len(hashes):
                    continue
                good = np.flatnonzero(neighbours(found) & (ids[:-1] >= 0) & (ids[1:] >= 0))
                good = good[passes(pair_bits, pair_hash(hashes[ids[good]], hashes[ids[good + 1]]))]
                at = good[:-1][np.diff(good) == 1]
                tally.add(unit.of(ids[at] << 32 | ids[at + 1]), ids[at + 2])
            if sum(len(x[2]) + len(x[3].codes) for x in state.values()) > 2 * HEAD + MOST_WORDS or any(x.full for x in tallies):
                yield from out()
        yield from out()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, known = (x.combine_chunks() for x in shared.value[:2])
        for batch in batches:
            code, n = batch.column(0), batch.column(2)
            at = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
            a = code.take(pa.array(at)).to_numpy()
            pair, third = known.take(pa.array(a >> 32)), heads.take(pa.array(a & 0xFFFFFFFF))
            cols = [pair.column(c) for c in ("lang", "w1", "w2")] + [third.column("word")]
            yield pa.record_batch([*(one(c.combine_chunks()) for c in cols), n.take(pa.array(at))], ["lang", "w1", "w2", "w3", "n"])
            yield listed(batch, 4)

    found = small_batches(texts).mapInArrow(run, "code long, words array<string>, n long")
    out = written(found.groupBy("code", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least).mapInArrow(name, "lang string, w1 string, w2 string, w3 string, n long"), "triples")
    shared.destroy()
    return out


def one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    return column.combine_chunks() if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def scored(a: str, left: str, right: str) -> F.Column:
    """floor(SCALE * a * a / (left * right)) in whole numbers of 38 digits."""
    big = lambda c: f"cast({c} as decimal(18, 0))"
    return F.expr(f"cast(({big(a)} * {big(a)} * cast({SCALE} as decimal(7, 0))) as decimal(38, 0)) div cast({big(left)} * {big(right)} as decimal(38, 0))")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` phrases of each language."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("__text"))
    known = written(word_counts(texts, WORD).where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    total = known.where("word is null").select("lang", F.col("n").alias("n"))
    words = known.where("word is not null")
    pairs = pair_counts(texts, words, least)
    triples = triple_counts(texts, words, pairs, least)

    f = lambda out, *on: (words if len(on) == 1 else pairs).select("lang", *(F.col(c).alias(x) for c, x in zip(["word"] if len(on) == 1 else ["w1", "w2"], on)), F.col("n").alias(out))
    covered = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "n")
    covered = covered.groupBy("lang", "p.w1", "p.w2").agg(F.max("n").alias("longer"))
    two = pairs.withColumnRenamed("n", "a").join(covered, ["lang", "w1", "w2"], "left").where(f"longer is null or 100 * longer < {COVER} * a")
    two = two.join(f("l", "w1"), ["lang", "w1"]).join(f("r", "w2"), ["lang", "w2"]).withColumn("score", scored("a", "l", "r"))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
    three = triples.withColumnRenamed("n", "a").join(f("l1", "w1"), ["lang", "w1"]).join(f("r2", "w3"), ["lang", "w3"]).join(f("l2", "w1", "w2"), ["lang", "w1", "w2"]).join(f("r1", "w2", "w3"), ["lang", "w2", "w3"])
    three = three.withColumns({"s1": scored("a", "l1", "r1"), "s2": scored("a", "l2", "r2")})
    cut = F.when(F.col("s1") <= F.col("s2"), F.struct(F.col("l1").alias("l"), F.col("r1").alias("r"), F.col("s1").alias("s"))).otherwise(F.struct(F.col("l2").alias("l"), F.col("r2").alias("r"), F.col("s2").alias("s")))
    three = three.withColumn("cut", cut).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", F.col("cut.s").alias("score"))
    # phrases of two and of three words are different texts, so that the order has no ties
    best = two.unionByName(three).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
