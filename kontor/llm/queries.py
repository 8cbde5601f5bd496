"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm.common import n_words, read_table
from kontor.llm.decontaminate import find_benchmark
from kontor.llm.fill_middle import fill_in_middle, restore
from kontor.llm.lattice import score_likelihood
from kontor.llm.merkle import fold_proof, merkle_manifest
from kontor.llm.mixing import mix_sources
from kontor.llm.neighbours import nearest
from kontor.llm.ngram_join import jaccard_components
from kontor.llm.pii import KINDS, pseudonymise
from kontor.llm.sharding import shuffle_into_shards
from kontor.llm.simhash import simhash_components
from kontor.llm.substring_dedup import find_repeats, keep_words
from kontor.llm.toxicity import fit_toxicity, score_toxicity
from kontor.llm.url_filter import judge_pages

N_SHARDS = 24
PII_KEY = "an example key; a real one comes from the caller's secrets"
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents are dealt out; sizes and checksums are those of the texts that arrive."""
    placed = shuffle_into_shards(read_table(spark, sf_dir, "documents"), N_SHARDS, seed=1, stable_input=True)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    mixed = mix_sources(rows, F.col("size"), key=("doc_id", "text_hash"), seed=6, stable_input=True)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).cast("long").alias("taken"), "source", "repeats")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_pages(read_table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, PII_KEY, stable_input=True).select("doc_id", "text", "n_pii", *[F.col("pii")[k].alias(f"n_{k}") for k in KINDS])


def held_out(folds: int) -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds) == 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(5))
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(5), F.lit(False)).alias("held_out"), "score", "predicted")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    c = find_benchmark(docs, read_table(spark, sf_dir, "benchmark"), window=10)
    items = F.col("contamination.items")
    return c.select("doc_id", "contamination.n_words", "contamination.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("contamination.n_hit") > 0).alias("contaminated"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = keep_words(find_repeats(docs, window=35, stable_input=True))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, n=4, percent=85, stable_input=True, keep=("doc_id",)).select("doc_id", "n_shingles", "component_id")


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(held_out(10), F.lit(False)).alias("held_out"))
    return score_likelihood(docs, ~F.col("held_out"), stable_input=True).drop("text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row is tampered with where 7 divides its key's checksum: its claim then counts one character more."""
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    rows = merkle_manifest(docs, fields=("doc_id", "source", "lang", "n_chars", "text"), tree="lang", order="doc_id", keep=("doc_id",), probe=claim)
    proof = F.sha2(F.concat_ws("", F.transform("proof", lambda s: s["hash"])), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold_proof(F.col("probe"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_components(docs, n=3, keep=("doc_id",))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1, percent=90, suffix_first_percent=20)
    fim = F.col("fim")
    digests = [F.sha2(fim["output"], 256).alias("output_sha256"), F.sha2(restore(fim["output"], fim["form"]), 256).alias("restored_sha256")]
    return docs.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_neighbours": op4_neighbours,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_lattice": op10_lattice,
    "op11_merkle": op11_merkle,
    "op12_simhash": op12_simhash,
    "op13_fill_middle": op13_fill_middle,
}

OP5_SQL = """
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
part AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM part),
start AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT s.doc_id, s.i, s.k, win.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM start) s JOIN win ON win.g = s.g AND win.k = s.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP8_SQL = """
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
start AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM start),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (g)),
lost AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY 1)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN lost.n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM doc LEFT JOIN lost USING (doc_id)"""

OP9_SQL = """
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
part AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0),
gram AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS g FROM part),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT doc.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, m.component_id
FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) m USING (doc_id)"""

OP11_SQL = """
WITH RECURSIVE bits AS (SELECT *, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))) AS b FROM documents),
claim AS (SELECT *, CASE WHEN xor(list_reduce(b, lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS told FROM bits),
leaf AS (SELECT doc_id, lang, sha256(f(doc_id) || f(source) || f(lang) || f(n_chars) || f(text)) AS leaf, sha256(f(doc_id) || f(source) || f(lang) || f(told) || f(text)) AS probe FROM claim),
placed AS (SELECT *, coalesce('1' || lang, '0') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf),
up AS (
  SELECT g, 0 AS lvl, list(leaf ORDER BY i) AS h FROM placed GROUP BY g
  UNION ALL SELECT g, lvl + 1, list_transform(range(0, (len(h) + 1) // 2), lambda k: sha256(h[2 * k + 1] || coalesce(h[2 * k + 2], ''))) FROM up WHERE len(h) > 1),
sub AS (SELECT g, h[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS j FROM up WHERE len(h) = 1),
over_all AS (
  SELECT 0 AS lvl, list(subroot ORDER BY j) AS h FROM sub
  UNION ALL SELECT lvl + 1, list_transform(range(0, (len(h) + 1) // 2), lambda k: sha256(h[2 * k + 1] || coalesce(h[2 * k + 2], ''))) FROM over_all WHERE len(h) > 1),
path AS (SELECT g, list(h ORDER BY lvl) AS lanes FROM up WHERE len(h) > 1 GROUP BY g),
top AS (SELECT coalesce(list(h ORDER BY lvl) FILTER (len(h) > 1), []) AS lanes, any_value(h[1]) FILTER (len(h) = 1) AS root FROM over_all),
proof AS (
  SELECT doc_id, leaf, probe, subroot, root, list_concat(
    list_transform(range(0, len(coalesce(path.lanes, []))), lambda l: {'h': coalesce(path.lanes[l + 1][xor(i >> l, 1) + 1], ''), 'a': (i >> l) & 1}),
    list_transform(range(0, len(top.lanes)), lambda l: {'h': coalesce(top.lanes[l + 1][xor(j >> l, 1) + 1], ''), 'a': (j >> l) & 1})) AS p
  FROM placed JOIN sub USING (g) LEFT JOIN path USING (g), top),
fold AS (SELECT *, list_reduce(list_concat([{'h': probe, 'a': 0}], p), lambda x, y: {'h': sha256(CASE WHEN y.a = 1 THEN y.h || x.h ELSE x.h || y.h END), 'a': 0}).h AS folded_root FROM proof)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s.h), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM fold"""
for _f in ("doc_id", "source", "lang", "n_chars", "text", "told"):
    OP11_SQL = OP11_SQL.replace(f"f({_f})", f"coalesce(strlen({_f}::VARCHAR) || ':' || {_f}, '-')")

OP13_SQL = """
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM cut),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS x FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s"""

ORACLE_SQL: dict[str, str] = {"op11_merkle": OP11_SQL, "op13_fill_middle": OP13_SQL, "op5_decontamination": OP5_SQL, "op8_substring_dedup": OP8_SQL, "op9_ngram_join": OP9_SQL}
