"""The registered queries of the training-data operators, and their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passwatch.llm import bpe, classes, collocations, decontaminate, embeddings, html, licenses, pii, quality, repeats, runs, simhash, warc
from passwatch.llm.common import table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.deduplicate(table(spark, sf_dir, "documents"), window=200)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return done.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.grouped(table(spark, sf_dir, "embeddings"), threshold=0.93)


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.y, r.root FROM reach r JOIN pairs p ON p.x = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, r.root AS component_id, r.root = e.vec_id AS kept
FROM embeddings e JOIN roots r ON r.node = e.vec_id LEFT JOIN links l ON l.x = e.vec_id
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), "text", VOCABULARY, public_tokenizers.PATTERN, ["doc_id"], decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    ranker = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs, ranker, "text", ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(simhash.fingerprints(table(spark, sf_dir, "documents"), "text", ["doc_id"], width=3), "simhash")
    return simhash.grouped(prints, "doc_id", budget=2).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.extract(table(spark, sf_dir, "pages"), "html", ["page_id", "url"])
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), "page_id", "url", "html", least_bytes=0)
    return warc.read(archives).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; with h the crc32 of the id, in texts with h % 10 = 0 the words from a on repeat the p words that begin there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    n = F.size("words")
    rows = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", n).withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    length = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(length / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), length)), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    done = classes.score(docs, learn=~held_out)
    return done.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
f1 AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY lang, x),
f2 AS (SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) AS x FROM w) GROUP BY lang, x HAVING count(*) >= 10),
f3 AS (SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS x FROM w) GROUP BY lang, x HAVING count(*) >= 10),
c AS (SELECT lang, w1, w2, max(n) AS longer FROM (SELECT lang, w1, w2, n FROM f3 UNION ALL SELECT lang, w2, w3, n FROM f3) GROUP BY ALL),
two AS (SELECT a.lang, a.w1 || ' ' || a.w2 AS phrase, a.n AS a, l.n AS l, r.n AS r FROM f2 a LEFT JOIN c ON c.lang = a.lang AND c.w1 = a.w1 AND c.w2 = a.w2
  JOIN f1 l ON l.lang = a.lang AND l.x = a.w1 JOIN f1 r ON r.lang = a.lang AND r.x = a.w2 WHERE c.longer IS NULL OR 100 * c.longer < 50 * a.n),
cuts AS (SELECT lang, phrase, a, l, r, 1 AS k FROM two
  UNION ALL SELECT a.lang, a.w1 || ' ' || a.w2 || ' ' || a.w3, a.n, l.n, r.n, 1 FROM f3 a JOIN f1 l ON l.lang = a.lang AND l.x = a.w1 JOIN f2 r ON r.lang = a.lang AND r.w1 = a.w2 AND r.w2 = a.w3
  UNION ALL SELECT a.lang, a.w1 || ' ' || a.w2 || ' ' || a.w3, a.n, l.n, r.n, 2 FROM f3 a JOIN f2 l ON l.lang = a.lang AND l.w1 = a.w1 AND l.w2 = a.w2 JOIN f1 r ON r.lang = a.lang AND r.x = a.w3),
s AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM s) WHERE best = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one)
SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, CAST(n.n AS BIGINT) AS n, t.score FROM t JOIN (SELECT lang, sum(n) AS n FROM f1 GROUP BY lang) n ON n.lang = t.lang WHERE t.rank <= 2000
"""


#: The digest in base32: of each five hex digits, four groups of five bits.
OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k:
   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((list_sum(list_transform(range(0, 5), lambda j:
   (instr('0123456789ABCDEF', substr(h, CAST(g * 5 + j + 1 AS INT), 1)) - 1) * CAST(power(16, 4 - j) AS BIGINT))) // CAST(power(32, 3 - k) AS BIGINT)) % 32)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM m
"""

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_embeddings": op2_embeddings,
    "op3_licenses": op3_licenses,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_html": op9_html,
    "op10_warc": op10_warc,
    "op11_runs": op11_runs,
    "op12_lm": op12_lm,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op2_embeddings": OP2_SQL, "op3_licenses": licenses.oracle_sql(), "op10_warc": OP10_SQL, "op13_collocations": OP13_SQL}
