"""The training-data operators against brute force, other libraries, round trips and held-out rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from passwatch.llm import bpe, common, decontaminate, embeddings, html, licenses, pii, quality, queries, repeats, simhash, warc
from tests.oracle import SF, connect, same

TEXTS = ["", None, " \n\t", "A b", "one two three four five", "word " * 3000, "é ü 漢字 🎉 x", "a" * 5000, "one two three four five"]


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({"score": F.lit("x"), "key": F.lit("y"), "fingerprint": F.lit(1), "ids": F.lit(2)}) if extra else df


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_duckdb(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


# op 1


def test_window_runs():
    r = random.Random(5)
    for _ in range(25):
        w, letters = r.choice([3, 5, 8]), r.choice([b"ab", b"abcd"])
        pieces = [bytes(r.choice(letters) for _ in range(r.randrange(w, 40))) for _ in range(r.randrange(1, 12))]
        seen = Counter(p[i : i + w] for p in pieces for i in range(len(p) - w + 1))
        for p, runs in zip(pieces, repeats.window_runs(pieces, w)):
            assert [seen[p[i : i + w]] > 1 for i in range(len(p) - w + 1)] == [any(a <= i < b for a, b in runs) for i in range(len(p) - w + 1)]


def cut_plainly(texts, w):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + w] for b in bodies for i in range(len(b) - w + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = True
        out.append((len(b), int(gone.sum()), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_repeats(spark, monkeypatch):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared, near = word(320), word(700)
    texts = [*TEXTS, shared + word(90), word(150) + shared, shared[:150] + word(40) + shared[150:], near, near[:300] + "#" + near[300:], near[:500] + "#" + near[501:], near, "xyz" * 300, word(199), word(1000)]
    for most in (repeats.MOST, 1, 0):  # 1 and 0: keys with rivals are dealt anew by longer strings, down to the window itself
        monkeypatch.setattr(repeats, "MOST", most)
        got = {r_.doc_id: (r_.n_bytes, sum(s.b - s.a for s in r_.removed), bytes(r_.kept)) for r_ in repeats.deduplicate(docs_of(spark, texts, True)).collect()}
        assert [got[i] for i in range(len(texts))] == cut_plainly(texts, 200)
    assert repeats.deduplicate(docs_of(spark, texts).limit(0)).count() == 0


def test_repeats_of_one_id(spark):
    """Rows without an id, or with the same id, keep their own texts apart."""
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = word(400)
    texts = [word(300) + shared, shared[100:] + word(500), word(900), word(250) + shared[:250], None, shared, shared]
    for ids in ([None] * 7, [5] * 7, [None, 5, 5, None, 5, 1, 1]):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
        got = sorted((str(x.doc_id), x.n_bytes, sum(s.b - s.a for s in x.removed), bytes(x.kept)) for x in repeats.deduplicate(df).collect())
        assert got == sorted((str(i), *c) for i, c in zip(ids, cut_plainly(texts, 200)))


def test_repeats_of_a_long_text(spark):
    """A text longer than a chunk, with a passage on a chunk's edge that stands elsewhere, too."""
    r = np.random.default_rng(6)
    body = r.integers(97, 123, 5_000_000).astype(np.uint8)
    body[4_000_000:4_000_600] = body[repeats.CHUNK - 300 : repeats.CHUNK + 300]
    text = body.tobytes().decode()
    got = repeats.deduplicate(docs_of(spark, [text, "short"])).orderBy("doc_id").first()
    assert [(s.a, s.b) for s in got.removed] == [(repeats.CHUNK - 300, repeats.CHUNK + 300), (4_000_000, 4_000_600)]
    assert got.n_bytes == len(text) and len(got.kept) == len(text) - 1200


def test_repeats_query(spark):
    rows = connect().execute("SELECT doc_id, text FROM documents").fetchall()
    want = {i: (n, gone, hashlib.sha256(kept).hexdigest()) for (i, _), (n, gone, kept) in zip(rows, cut_plainly([t for _, t in rows], 200))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in queries.op1_repeats(spark, SF).collect()}
    assert got == want


# op 2


def test_embeddings_edges_and_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = r.standard_normal((12, 16))
    rows = [(int(i), [float(x) for x in base[i % 12] + 0.08 * r.standard_normal(16)], int(i % 2)) for i in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, rows[0][1], None), (205, rows[0][1], 0), (206, rows[0][1], 0), (207, [1.0, 2.0], 0), (208, [], 0), (209, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("node", F.lit("x"))

    def plain():
        ok = {i: np.array(e) for i, e, l in rows if l is not None and e and None not in e and np.isfinite(e).all() and np.any(e)}
        label = {i: l for i, _, l in rows}
        link = {i: set() for i, _, _ in rows}
        for a, b in combinations(ok, 2):
            if label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.93:
                link[a].add(b)
                link[b].add(a)
        out = {}
        for i in link:
            seen, todo = {i}, [i]
            while todo:
                new = link[todo.pop()] - seen
                seen |= new
                todo += new
            out[i] = (len(link[i]), min(seen), min(seen) == i)
        return out

    assert found(embeddings.grouped(df)) == plain()
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    classes = embeddings.classes_of(df, "vec_id", "embedding", "label")
    by_blocks = embeddings.linked(classes, block=7).groupBy("node").agg(F.sum("links").alias("n"))
    want = embeddings.linked(classes).groupBy("node").agg(F.sum("links").alias("n"))
    assert found(by_blocks) == found(want)


def test_embeddings_blocks_lose_nothing(spark):
    """A label of fifteen blocks gives the sums of links that one block gives."""
    r = np.random.default_rng(3)
    base = r.standard_normal((60, 32))
    rows = [(int(i), [float(x) for x in base[i % 60] + 0.2 * r.standard_normal(32)], 0) for i in range(600)]
    classes = embeddings.classes_of(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), "vec_id", "embedding", "label")
    exact = found(embeddings.linked(classes).groupBy("node").agg(F.sum("links").alias("n")))
    assert exact and found(embeddings.linked(classes, block=40).groupBy("node").agg(F.sum("links").alias("n"))) == exact


def test_embeddings_of_a_large_label_lose_no_link(spark):
    """The sums of links of many blocks are those of all products."""
    r = np.random.default_rng(4)
    base = r.standard_normal((60, 32))
    rows = [(int(i), [float(x) for x in base[i % 60] + 0.27 * r.standard_normal(32)], 0) for i in range(1200)]
    x = np.array([e for _, e, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: (int(n),) for i, n in enumerate((x @ x.T >= 0.93).sum(axis=1) - 1) if n}
    classes = embeddings.classes_of(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), "vec_id", "embedding", "label")
    assert found(embeddings.linked(classes, block=200).groupBy("node").agg(F.sum("links").alias("n"))) == want


def test_estimates_are_unbiased():
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ embeddings.rotation(64).T
    factor = np.abs(turned).sum(axis=1) / 8
    estimate = np.where(turned > 0, 1, -1) @ turned.T / 8 / factor[:, None]
    off = ~np.eye(400, dtype=bool)
    assert abs((estimate - x @ x.T)[off].mean()) < 2e-3


# op 3


def test_licenses(spark):
    s = licenses.SENTENCES
    mit = "# Copyright (c) 2020 X\n#\n# " + s["mit-grant"].replace(" to use", "\n# to use") + "\n#\n# " + s["mit-notice"] + "\n\n" + s["mit-warranty"] + " IN NO EVENT SHALL X."
    texts = [mit, "hello\nReleased under the MIT License. More", None, "", "It is licensed under something. permission", "; ".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")), s["bsd-source"], "Licensed under CC BY-NC 4.0", "x " * 50000 + "\nLicensed under the Apache License, Version 2.0.\n" + "y " * 50000]
    df = licenses.scan(docs_of(spark, texts).withColumn("licenses", F.lit("clash")))
    got = {r.doc_id: (r.n_sentences, r.licenses, r.unmatched) for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == [(3, "MIT", ""), (1, "MIT", ""), (0, "", ""), (0, "", ""), (0, "", ""), (4, "BSD-3-Clause", ""), (1, "", "bsd-source"), (1, "CC-BY-NC-4.0", ""), (1, "Apache-2.0", "")]
    assert all(re.search(licenses.TRIGGERS, sentence) for sentence in licenses.known())


# op 4


@pytest.fixture(scope="module")
def codecs():
    path = P.path("byte_bpe_50k.tiktoken")
    own = bpe.codec(path, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_equals_tiktoken(codecs):
    own, other = codecs
    r = random.Random(6)
    texts = [t or "" for t in TEXTS] + ["<|endoftext|>", "ab" * 20000, "  \n\n x  ", "I'll they've"] + ["".join(r.choice("abcé漢🎉 \t\n1.'s\x1c\xa0\x85²") for _ in range(r.randrange(3000))) for _ in range(40)]
    texts += [t for (t,) in connect().execute("SELECT text FROM documents").fetchall()]
    for ids, t in zip(own.encode(texts), texts):
        assert ids.tolist() == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bpe_lanes_equal_scalar(codecs):
    own, _ = codecs
    r = random.Random(7)
    pieces = [bytes(r.randrange(97, 123) for _ in range(r.randrange(1, 64))) for _ in range(500)]
    assert [np.frombuffer(x, np.int32).tolist() for x in own.lanes.encode(pieces)] == [own.merge(p) if p not in own.ranks else [own.ranks[p]] for p in pieces] or all(p in own.ranks for p in pieces)


def test_bpe_query(spark, codecs):
    _, other = codecs
    got = found(queries.op4_bpe(spark, SF))
    for i, t in connect().execute("SELECT doc_id, text FROM documents").fetchall():
        ids = other.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    rows = bpe.encode(docs_of(spark, TEXTS, True), "text", queries.VOCABULARY, P.PATTERN, ["doc_id", "ids"], ids="out").collect()
    assert len(rows) == len(TEXTS) and rows[0].out == []
    back = bpe.decode(spark.createDataFrame([(1, [0, 1]), (2, None)], "k int, ids array<int>"), "ids", queries.VOCABULARY, P.PATTERN, ["k"]).collect()
    assert back[1].decoded == b""


# op 5


def test_quality(spark):
    rows = connect("/root/testdata/sf0.01").execute("SELECT d.doc_id, text, quality FROM documents d JOIN labels USING (doc_id)").fetchall()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows])
    mark = np.array([q for *_, q in rows])
    x = quality.features(*common.joined_bytes(pa.array([t for _, t, _ in rows])))
    score = quality.fit(x[~held], mark[~held]).score(x[held])
    good, bad = score[mark[held] == 1], score[mark[held] == 0]
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert (good >= quality.THRESHOLD).mean() > 0.97 and (bad < quality.THRESHOLD).mean() > 0.85
    edge = docs_of(spark, TEXTS, True)
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 0), (99, 1), (3, None)], "doc_id bigint, quality int")
    got = found(quality.score(edge, quality.train(edge, labels), "text", ["doc_id"]))
    assert len(got) == len(TEXTS) and all(0 <= s <= 1 for (s,) in got.values())
    assert found(quality.score(edge, quality.train(edge, labels.limit(0)), "text", ["doc_id"]))[0] == (1.0,)


# op 6


def test_masks_lose_nothing():
    for gone in combinations(range(10), 2):
        assert any(not {s + o for o in m} & set(gone) for m in decontaminate.MASKS for s in range(10 - m[-1]))


def overlaps(doc, item):
    d, i = re.findall(r"\w+", (doc or "").lower()), re.findall(r"\w+", (item or "").lower())
    n, w = len(i), min(len(i), 13)
    if n < 5:
        return False
    need = -(-w * 4 // 5) if n >= 10 else w
    for s in range(-n, len(d) + 1):
        e = [0 <= s + k < len(d) and d[s + k] == i[k] for k in range(n)]
        if any(sum(e[k : k + w]) >= need for k in range(n - w + 1)):
            return True
    return False


def test_decontaminate(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    items = [" ".join(r.choice(words) for _ in range(r.choice([3, 5, 7, 9, 10, 12, 13, 20, 40]))) for _ in range(30)] + ["", None]

    def damaged(item):
        w = item.split()
        for _ in range(r.randrange(0, 1 + len(w) // 4)):
            w[r.randrange(len(w))] = "zz"
        return w[r.randrange(0, max(1, len(w) // 2)) if r.random() < 0.4 else 0 :]

    texts = [" ".join([r.choice(words) for _ in range(r.randrange(20))] + damaged(r.choice(items[:30])) + [r.choice(words) for _ in range(r.randrange(20))]) for _ in range(120)] + TEXTS
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    docs = docs_of(spark, texts, True)
    want = {(a, b) for a, t in enumerate(texts) for b, i in enumerate(items) if overlaps(t, i)}
    for bits in (decontaminate.FILTER_BITS, 1 << 12):  # a filter that lets nearly all seeds through changes nothing
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        assert {(x.doc_id, x.item_id) for x in decontaminate.find(docs, bench).collect()} == want
    assert {x.doc_id for x in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {a for a, _ in want}
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.find(docs.limit(0), bench).count() == 0


def test_decontaminate_query(spark):
    con = connect()
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = {(a, b) for a, t in con.execute("SELECT doc_id, text FROM documents").fetchall() for b, i in items if overlaps(t, i)}
    got = queries.op6_decontaminate(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.similarity == r.matched_words / r.window_words >= 0.8 for r in got)


def test_decontaminate_long_items(spark):
    """An item longer than a part, a document longer than a tile, and the place of the best window."""
    r = random.Random(4)
    item = [f"i{r.randrange(10**6)}" for _ in range(1500)]
    docs = [[f"d{k}" for k in range(700)] + item[a : a + 13] + [f"e{k}" for k in range(50)] for a in (0, 495, 500, 505, 1487)]
    docs.append([f"d{k}" for k in range(90)] + item[600:605] + ["x"] + item[606:609] + ["y"] + item[610:613])
    docs.append([f"d{k}" for k in range(90)] + item[600:610])
    bench = spark.createDataFrame([(None, " ".join(item)), (2, "short one here")], "item_id bigint, text string")
    got = decontaminate.find(docs_of(spark, [" ".join(d) for d in docs]), bench).orderBy("doc_id").collect()
    assert [(x.doc_id, x.item_id, x.start_word, x.matched_words, x.window_words) for x in got] == [*((k, None, 700, 13, 13) for k in range(5)), (5, None, 90, 11, 13)]


# op 7


def fingerprint(text, width):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, budget=2):
    group = {i: i for i in prints}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= budget:
            x, y = sorted((top(a), top(b)))
            group[y] = x
    return {i: top(i) for i in prints}


@pytest.mark.parametrize("width", [3, 5])
def test_fingerprints(width):
    rows = [t for (t,) in connect().execute("SELECT text FROM documents").fetchall()] + TEXTS
    got = simhash.fingerprints_of(*common.joined_bytes(pa.array(rows, pa.string())), width)
    assert [int(x) for x in got] == [fingerprint(t, width) for t in rows]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {" ".join(words)}


def test_near_copies(spark, monkeypatch):
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts, family = list(TEXTS), [0, 0, 0, 1, 2, 3, 4, 5, 2]
    common_part = fresh(60)  # a passage that unlike texts share
    for k in range(40):
        base = fresh(r.randrange(40, 300)) + (common_part if k % 2 else [])
        for copy in range(3):
            words = list(base)
            for _ in range(len(words) * copy // 100):
                words[r.randrange(len(words))] = "x"
            texts.append(" ".join(words))
            family.append(100 + k)
    first = {f: family.index(f) for f in family}
    for block in (simhash.BLOCK, 6):
        got = found(simhash.near(docs_of(spark, texts, True), "doc_id", "text", block=block))
        assert [got[i][0] for i in range(len(texts))] == [first[f] for f in family]
    assert simhash.near(docs_of(spark, texts).limit(0), "doc_id", "text").count() == 0


def test_near_copies_are_exact(spark):
    """Pairs at a similarity of exactly 0.8 are linked, pairs just below are not."""
    texts = []
    for k in range(40):
        for common_, own in ((80, 10), (800, 100), (776, 112), (80, 11)):  # shingles in both, and in each alone
            stem = [f"p{k}c{common_}o{own}w{i}" for i in range(common_ + 4)]
            texts += [" ".join(stem + [f"{side}{i}" for i in range(own)]) for side in "ab"]
    got = [r.component_id for r in simhash.near(docs_of(spark, texts), "doc_id", "text").orderBy("doc_id").collect()]
    assert [got[i] == got[i + 1] for i in range(0, len(texts), 2)] == [True, True, False, False] * 40


def test_near_copies_of_short_texts(spark, monkeypatch):
    """Every pair at 0.8 or more meets, also in texts without an inner end of a run of words, and with frequent shingles."""
    texts = []
    for k in range(60):
        for n in (8, 13, 20, 30):
            stem = [f"s{k}n{n}w{i}" for i in range(n)]
            texts += [" ".join(stem), " ".join(stem + ["more"])]
    texts += [" ".join([f"line{i}" for i in range(12)] + [f"t{k}x{i}" for i in range(4 + k % 3)]) for k in range(60)]
    sets = [shingles(t, 5) for t in texts]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root = [root[i] if r == root[j] else r for r in root] if root[i] < root[j] else [root[j] if r == root[i] else r for r in root]
    assert all(root[i] == root[i + 1] for i in range(0, 480, 2))
    for block in (simhash.BLOCK, 6):
        got = [r.component_id for r in simhash.near(docs_of(spark, texts), "doc_id", "text", block=block).orderBy("doc_id").collect()]
        assert got == root


def test_trie_pairs_of_equal_first_words():
    prints = np.sort(np.array([5] * 300 + [7] * 20 + [1 << 60], np.uint64))
    zero = np.zeros(len(prints), np.int64)
    a, b = simhash.trie_pairs(prints, zero, zero, 2)
    assert sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) == list(combinations(range(320), 2))
    side = np.repeat([0, 1], [300, 21])  # a leaf of 300 against one of 20
    a, b = simhash.trie_pairs(prints, side, np.where(side == 0, 1, -1), 2)
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i in range(300) for j in range(300, 320)]


def test_simhash_query(spark):
    prints = {i: fingerprint(t, 3) for i, t in connect().execute("SELECT doc_id, text FROM documents").fetchall()}
    roots = linked(prints)
    assert found(queries.op7_simhash(spark, SF)) == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


def test_simhash_join_blocks(spark, monkeypatch):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = {i: base[i % 6] ^ sum(1 << r.randrange(64) for _ in range(r.randrange(3))) & (1 << 64) - 1 for i in range(150)}
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()], "doc_id bigint, fingerprint bigint")
    for block in (simhash.BLOCK, 5):
        monkeypatch.setattr(simhash.links, "__defaults__", (2, block))
        assert {r_.doc_id: r_.component_id for r_ in simhash.grouped(df, "doc_id").collect()} == linked(prints)
    assert simhash.grouped(df.limit(0), "doc_id").count() == 0


def test_components(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + k) for k in range(1, 50)]
    mixed = [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    edges = spark.createDataFrame(chain + star + mixed + [(5, 5)], "a bigint, b bigint").repartition(7)
    want = {}
    for a, b in chain + star + mixed:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        if want[a] is not want[b]:
            want[a] |= want[b]
            for x in list(want[a]):
                want[x] = want[a]
    want = {k: (min(v),) for k, v in want.items() if len(v) > 1}
    assert found(common.components(edges)) == want
    assert common.components(edges.limit(0)).count() == 0


# op 8

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_pii_equals_patterns(spark):
    r = random.Random(1)
    texts = [t for (t,) in connect().execute("SELECT text FROM documents").fetchall()] + [t or "" for t in TEXTS]
    texts += ["".join(r.choice("01234567899..--++  @@a.()é") for _ in range(r.randrange(60))) for _ in range(20000)] + ["".join(r.choice("0123456789 -") for _ in range(r.randrange(22))) for _ in range(5000)]
    assert all([s for s in pii.spans(t) if s[0] < pii.BASE] == base_spans(t) for t in texts)
    got = found(queries.op8_pii(spark, SF))
    for i, t in connect().execute("SELECT doc_id, text FROM documents").fetchall():
        want = base_spans(t or "")
        assert got[i][:5] == (*[sum(k == s[0] for s in want) for k in range(4)], hashlib.sha256(pii.digest_text(want).encode()).hexdigest())
    out = found(pii.redact(docs_of(spark, ["Mail é.a@b.co or http://x.y/z?q=1, iban: DE44 ok", None, ""], True)))
    assert out[0][0] == "Mail é[EMAIL] or [URL], iban: DE44 ok" and out[1][0] is None and out[2][0] == ""


# op 9


def test_html_cases():
    page = """<html><body><header><h1>Site</h1></header><nav><a href=x>a</a></nav><div id="cookie-notice">We use cookies, ok.</div><div class="wrap"><div class="content"><h2>T</h2>
<p>One, two, three, four, five words of text here to count &lt;b&gt;&nbsp;x.<p>Second, para<br>here with more, words, and commas for good measure.</div><div class="sidebar"><p>Side, text that is long, with, commas, and, more, so, on.</p></div></div>
<div class="comments"><article class="comment"><p>Nice, post, really, long, comment, with, many, commas, in, it.</p></article></div><form><p>Name, address, and, more, of, it, please, here.</p></form><footer>f</footer>"""
    assert html.main_text(page) == "T\nOne, two, three, four, five words of text here to count <b> x.\nSecond, para here with more, words, and commas for good measure."
    assert [html.main_text(x) for x in ("", "hello <b>x</b>", "<p>short", "<script>x", "<p>cut <b", "a &am")] == ["", "hello x", "short", "", "cut", "a &am"]
    assert html.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"
    long = "<article>" + "".join(f"<p>Paragraph {i}.</p>" for i in range(5000)) + "</article>"
    assert html.main_text(long).count("\n") == 4999


PROSE = "Text, with some commas, in it, that is long enough to score here."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><h1>T</h1><p>{PROSE}</p><ul><li><a href=x>one link</a></li><li><a href=y>two links</a></li></ul></article>", ["T", PROSE, "one link", "two links"]),
        (f"<article><p>{PROSE}</p><div class='social impact'>On impact.</div><p class='notice'>A notice.</p><div class='cookie-notice'>Cookies!</div></article>", [PROSE, "On impact.", "A notice."]),
        (f"<nav><a href=x>a</a></nav><article><p>{PROSE}</p></article><article><p>Second.</p></article><footer>f</footer>", [PROSE, "Second."]),
        (f"<div class=top><a href=a>Home</a> <a href=b>More</a></div><div><p>{PROSE}</p><p>{PROSE}</p></div><div>A short end.</div><p>Bye</p><div>Site X</div>", [PROSE, PROSE, "A short end.", "Bye"]),
        (f"<article><h1>T</h1><div><div><p>{PROSE}</p></div></div><section id=comments><p>{PROSE}</p></section></article>", ["T", PROSE]),
        (f"<div><h2>Links</h2><ul><li><a>aaaa</a><li><a>bbbb</a></ul></div><h1>Head</h1><div><p>{PROSE}</p></div>", ["Head", PROSE]),
    ],
)
def test_html_keeps_the_article(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>") == "\n".join(want)


STORY = "<p>One, two, three, four, five words of text here, to count.</p><p>A second paragraph, with more words, and commas for good measure.</p>"
TOLD = ["One, two, three, four, five words of text here, to count.", "A second paragraph, with more words, and commas for good measure."]


@pytest.mark.parametrize(
    "page, want",
    [
        # a wrapper that mentions a part among its words is the article's
        (f'<div class="layout with-sidebar"><div class="story">{STORY}</div><div class="sidebar"><p>Read this, and that, too, and more of it here.</p></div></div>', TOLD),
        (f'<div class="post has-comments">{STORY}<div class="comments"><p>{"I say, this is a long comment, longer than the text. " * 20}</p></div></div>', TOLD),
        (f'<div class="elementor-widget-container">{STORY}</div>', TOLD),
        (f'<form id="aspnetForm"><div class="story">{STORY}</div></form>', TOLD),
        (f'<form id="aspnetForm"><article>{STORY}</article></form>', TOLD),
        (f'<div class="story">{STORY}</div><form><p>Your mail, please, and your name, and all that.</p></form>', TOLD),
        (f'<div class="story">{STORY}</div><div class="site-footer-links"><p>Imprint, contact, and terms of use, as ever.</p></div>', TOLD),
        # headings in a box of their own, formulas
        (f'<div class="title"><h1>The title</h1></div><div class="story">{STORY}</div>', ["The title", *TOLD]),
        (f"<article>{STORY}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", [*TOLD, "So x=2 holds."]),
        # comments and calls inside an article
        (f'<article>{STORY}<div id="comments-section-2" class="thread-view"><p>I say, this is, well, a comment of a reader.</p></div></article>', TOLD),
        (f'<article>{STORY}<p class="newsletter-signup">Sign up, now, for our letter, every week.</p></article>', TOLD),
    ],
)
def test_html_wrappers(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>") == "\n".join(want)


def test_html_score_decides(spark):
    """The best container of random pages, with and without <article>, is that of the plain definition of the score."""
    r = random.Random(2)

    def block(depth):
        if depth == 0 or r.random() < 0.3:
            text = "words, " * r.randrange(12) + "x" * r.randrange(60)
            return f"<p>{text}</p>" if r.random() < 0.7 else f"<p><a href=x>{text}</a> {text[:20]}</p>"
        tag = r.choice(["div", "div class=content", "section", "article", "blockquote", "span"])
        return f"<{tag}>" + "".join(block(depth - 1) for _ in range(r.randrange(1, 4))) + f"</{tag.split()[0]}>"

    def below(node):
        return [x for c in node.children if isinstance(c, html.Node) for x in (c, *below(c))]

    def text(node):
        return "".join(c if isinstance(c, str) else text(c) for c in node.children)

    def size(node):
        return sum(len(c.strip()) if isinstance(c, str) else size(c) for c in node.children)

    def linked(node):
        return size(node) if node.tag == "a" else sum(linked(c) for c in node.children if isinstance(c, html.Node))

    def plain(root):
        nodes, points = [root, *below(root)], {}
        for node in nodes:
            if node.tag in html.SCORED and size(node) >= 25 and not any(x.tag in html.BLOCK for x in below(node)):
                worth = (1 + text(node).count(",") + min(len(text(node)) // 100, 3)) * (1 - linked(node) / size(node))
                above = node.parent
                for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
                    if above is not None:
                        points[above] = points.get(above, 0) + worth * share
                        above = above.parent
        weigh = lambda n: 1.25 if n.tag in ("article", "main") or n.words & html.BODY_WORDS else 1
        return [points.get(n, 0) * (1 - linked(n) / max(size(n), 1)) * weigh(n) for n in nodes]

    for _ in range(300):
        root = html.tree("<body>" + "".join(block(3) for _ in range(3)) + "</body>")
        want = plain(root)
        nodes = html.score(root)
        assert [round(n.points, 9) for n in nodes] == [round(x, 9) for x in want]
        best = max(nodes, key=lambda n: n.points)
        got = "\n".join(line for run, article in html.kept(best) for line in html.lines(run, article))
        if best.points and not any(html.is_menu(x) for x in [best, *below(best)]):
            assert "".join(text(best).split()) in "".join(got.split())


@pytest.mark.parametrize("parts", [["<div>", "x</span>"], ["<b>", "<p>", "x"], ["<div>", "Deep text, long enough, to be scored."], ["<b><table><td>", "<i>", "</b>", "x"], ["<ul><li>", "x"], ["<div><span>", "Deep text, long enough."]])
def test_html_is_linear_in_depth(parts):
    """100,000 open elements: a quadratic reader would take minutes."""
    page = "".join(p * (1 if p == parts[-1] or p.startswith("<b><") else 100_000) for p in parts)
    began = time.process_time()
    assert html.main_text(page)
    assert time.process_time() - began < 30


def test_html_query(spark):
    pages = connect().execute("SELECT page_id, url, html FROM pages").fetchall()
    got = found(queries.op9_html(spark, SF))
    for i, url, page in pages:
        inner = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", page, re.S)[1])
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)) if x)
        assert got[i] == (url, want, len(want))
    edge = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "page_id bigint, html string, text string")
    assert found(html.extract(edge, "html", ["page_id"])) == {1: ("",), 2: ("",)}


# op 10


def test_warc(spark, tmp_path):
    r = random.Random(2)
    pages = [(i, f"http://x/{i}", r.choice(["same", None, "", f"page {i} " * r.randrange(200), "é" * 50])) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))
    table = warc.write(df, "page_id", "url", "html")
    got = {x.key: x for x in warc.read(table).collect()}
    body = {i: (h or "").encode() for i, _, h in pages}
    last = {b: max(i for i in body if body[i] == b) for b in body.values()}
    for i, b in body.items():
        row = got[i]
        assert row.payload_bytes == len(b) and row.payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (row.record_type, row.refers_to) == (("response", None) if last[b] == i else ("revisit", last[b]))
        assert row.payload is None if row.record_type == "revisit" else bytes(row.payload) == b
    few = {x.key: x.record_type for x in warc.read(warc.write(df, "page_id", "url", "html", least_bytes=10)).collect()}
    assert all(few[i] == "response" for i, b in body.items() if len(b) < 10)
    warc.files(table, str(tmp_path / "out"))
    assert sum(len(list(warc.read_archive(p.read_bytes()))) for p in (tmp_path / "out").iterdir()) == len(pages)
    assert warc.read(warc.write(df.limit(0), "page_id", "url", "html")).count() == 0
    odd = spark.createDataFrame([(None, "u", "same"), (1, None, "same"), (2, "a\r\nb", "same"), (2, "c", "other"), (3, "d", "same"), (None, None, None)], "page_id bigint, url string, html string")
    got = sorted(((x.key, x.url, x.record_type, x.refers_to) for x in warc.read(warc.write(odd, "page_id", "url", "html")).collect()), key=str)
    assert got == sorted([(None, "u", "response", None), (1, None, "revisit", 3), (2, "a%0D%0Ab", "revisit", 3), (2, "c", "response", None), (3, "d", "response", None), (None, None, "response", None)], key=str)


def test_warc_moves_no_payload(spark):
    """Pages are shuffled without their payloads: these stand only on the side that isn't exchanged."""
    plan = warc.deduplicated(spark.read.parquet(f"{SF}/pages.parquet"), "page_id", "url", "html")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


# pipeline


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = common.written(stages["quality classifier"](spark, docs, SF), "t")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    assert sum(i in left for i, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(i not in left for i, q in labels.items() if q == 0) >= 0.8 * sum(q == 0 for q in labels.values())
    rows = {r.doc_id: r for r in kept.collect()}
    one = common.written(stages["SimHash near-dedup"](spark, kept, SF), "t")
    sets = {i: shingles(r.text, 5) for i, r in rows.items()}
    stay = {r.doc_id for r in one.collect()}
    close = {(a, b): len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}
    assert not [p for p, j in close.items() if j >= 0.8 and stay.issuperset(p)]
    assert all(any(close.get((min(i, k), max(i, k)), 0) >= 0.65 and k < i for k in sets) for i in sets.keys() - stay)
    items = [t for (t,) in connect().execute("SELECT text FROM benchmark").fetchall()]
    clean = common.written(stages["benchmark decontamination"](spark, one, SF), "t")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not any(overlaps(r.text, i) for i in items)}
    private = common.written(stages["PII"](spark, clean, SF), "t")
    assert not any(base_spans(r.text) for r in private.collect()) and private.columns == corpus_pipeline.COLUMNS
    last = stages["byte-level BPE encoding and decoding"](spark, private, SF).collect()
    assert len(last) == private.count() and all(r.exact for r in last)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in last)


def test_pipeline_edges(spark):
    docs = docs_of(spark, TEXTS, True).withColumn("source", F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_copies_without_ids(spark):
    """Rows with a null id stay unless they are copies; of copies without an id one stays."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    rows = [(7, text["a"]), (None, text["a"]), (None, text["b"]), (None, text["c"]), (None, text["c"]), (None, text["c"] + " more"), (3, text["d"]), (5, text["d"] + " more"), (None, text["d"] + " last")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text[0]) for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect()]
    assert sorted(got, key=str) == [(3, "d"), (7, "a"), (None, "b"), (None, "c")]


def test_pipeline_links_by_fingerprints(spark):
    """Texts whose fingerprints agree in all but two bits are near copies for the pipeline, though their sets of shingles are less alike."""
    again = " ".join(["one two three four five six seven eight nine"] * 60)
    texts = {1: again + " " + " ".join(f"x{i}" for i in range(8)), 2: again + " " + " ".join(f"y{i}" for i in range(8)), 3: " ".join(f"z{i}" for i in range(80))}
    prints = {i: int.from_bytes(simhash.fingerprints_of(*common.joined_bytes(pa.array([t], pa.string())), 3).tobytes(), "little") for i, t in texts.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= 2
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect()) == [1, 3]


def test_near_copies_take_few_jobs(spark, monkeypatch):
    """The driver holds every job of a stage: a small table takes few, and a round that leaves no pair out is the last; with forests the groups are the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.sparkContext.setJobGroup("near copies", "")
    kept = sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, SF).select("doc_id").collect())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near copies")) <= 110
    monkeypatch.setattr(simhash, "KEPT", 0)
    assert kept == sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, SF).select("doc_id").collect())


def test_components_of_many_partitions(spark, monkeypatch):
    """A path and a hub dealt over many partitions, whose tasks hold few edges at once."""
    monkeypatch.setattr(common, "EDGES", 8)
    r = random.Random(3)
    path = [r.sample(range(1000), 300)]
    edges = [(a, b) for p in path for a, b in zip(p, p[1:])] + [(5000 + k, 4000 if k else 3999) for k in range(200)] + [(3999, 4000)]
    edges = [x if r.random() < 0.5 else x[::-1] for x in edges + edges[:40]]
    got = found(common.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(23)))
    assert got == {x: (min(path[0]),) for x in path[0]} | {x: (3999,) for x in [3999, 4000, *range(5000, 5200)]}
