"""Queries and SQL of ingest, matching, categorisation, labelling, evaluation, jobs and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions import text
from kontor.functions.vectors import hash_embedding
from kontor.operators import active, cascade, evaluate, jobs, knn, maintenance, matching
from kontor.operators import labels as lb
from kontor.plans import tables as t
from kontor.plans.report_queries import add, spine
from kontor.scratch import scratch_path, scratch_table
from kontor.sources import files
from kontor.streaming import jobs as streams

VEC = """, vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), train AS (SELECT id, v, category_id FROM vec JOIN latest_user ON expense_id = id), test AS (SELECT id, v FROM vec WHERE id NOT IN (SELECT id FROM train)),
near AS (SELECT test.id, train.id AS neighbour, category_id, round(list_cosine_similarity(test.v, train.v), 12) AS sim FROM test, train QUALIFY row_number() OVER (PARTITION BY test.id ORDER BY sim DESC, train.id) <= 5),
votes AS (SELECT id, category_id, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, category_id) AS r FROM near GROUP BY 1, 2)
"""


def split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors without and with a user label, and the labels."""
    v = t.vectors(spark, d).select("id", "vector")
    truth = lb.latest_labels(t.labels(spark, d), "user").select(F.col("expense_id").alias("id"), "category_id")
    truth = truth.join(v.select("id"), "id", "left_semi")
    return v.join(truth, "id", "left_anti"), v.join(truth, "id", "left_semi"), truth


@add("d12_g3_knn_join", VEC + "SELECT id, neighbour, round(sim, 6) AS similarity FROM near")
def _(spark, d):  # noqa: ANN001, ANN202
    test, train, _ = split(spark, d)
    return knn.knn_join(test, train, 5).select("id", "neighbour", "similarity")


@add("h6_knn_vote", VEC + "SELECT a.id, a.category_id, a.n AS votes, b.category_id AS runner_up, coalesce(b.n, 0) AS runner_up_votes FROM votes a LEFT JOIN votes b ON b.id = a.id AND b.r = 2 WHERE a.r = 1")
def _(spark, d):  # noqa: ANN001, ANN202
    test, train, truth = split(spark, d)
    return knn.knn_vote(knn.knn_join(test, train, 5), truth).select("id", "category_id", "votes", "runner_up", "runner_up_votes")


@add("d13_nearest_category", VEC + "SELECT id, category_id FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) = 1")
def _(spark, d):  # noqa: ANN001, ANN202
    return knn.nearest_category(*split(spark, d))


@add("d14_neighbour_context", VEC + "SELECT near.id, neighbour, date, counterparty, cents, category FROM near JOIN s ON s.id = neighbour")
def _(spark, d):  # noqa: ANN001, ANN202
    test, train, _ = split(spark, d)
    return knn.neighbour_context(test, train, spine(spark, d)).select("id", "neighbour", "date", "counterparty", "cents", "category")


def candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return t.transactions(spark, d), t.secondary(spark, d).withColumn("description", text.secondary_memo(F.col("name"), F.col("email")))


#: Every candidate in turn, all amounts at once: what is used and tied so far goes along.
GREEDY = """WITH RECURSIVE """ + t.PREFIX.removeprefix("WITH ") + """, rec AS (SELECT 'R' || o_orderkey AS ref, o_orderdate::DATE + (o_orderkey % 9 - 4)::INT AS day, round(o_totalprice * 100)::BIGINT AS a FROM orders WHERE o_orderkey % 7 = 0),
rs AS (SELECT a, list({'ref': ref, 'day': day}) AS rs FROM rec GROUP BY a), cs AS (SELECT a, list({'id': id, 'day': date} ORDER BY date, id) AS cs FROM tx GROUP BY a),
turn AS (
  SELECT a, rs, cs, 0 AS i, []::VARCHAR[] AS used, []::VARCHAR[] AS tied, NULL::BIGINT AS id, NULL::VARCHAR AS ref, NULL::INT AS days FROM rs JOIN cs USING (a)
  UNION ALL
  SELECT a, rs, cs, i, CASE WHEN len(near) = 1 THEN list_append(used, near[1].ref) ELSE used END, CASE WHEN len(near) > 1 THEN list_concat(tied, list_transform(near, lambda r: r.ref)) ELSE tied END,
    CASE WHEN len(near) = 1 THEN cs[i].id END, CASE WHEN len(near) = 1 THEN near[1].ref END, CASE WHEN len(near) = 1 THEN abs(near[1].day - cs[i].day)::INT END
  FROM (SELECT *, list_filter(free, lambda r: abs(r.day - cs[i].day) = list_min(list_transform(free, lambda q: abs(q.day - cs[i].day)))) AS near
    FROM (SELECT a, rs, cs, i + 1 AS i, used, tied, list_filter(rs, lambda r: abs(r.day - cs[i + 1].day) <= 5 AND NOT list_contains(used, r.ref)) AS free FROM turn WHERE i < len(cs)))),
last AS (SELECT * FROM turn WHERE i = len(cs)), matched AS (SELECT id, ref, days, 'matched' AS outcome FROM turn WHERE id IS NOT NULL), ties AS (SELECT DISTINCT unnest(tied) AS ref FROM last),
said AS (FROM matched UNION ALL SELECT NULL, ref, NULL, 'ambiguous' FROM ties UNION ALL SELECT NULL, ref, NULL, 'unmatched' FROM rec WHERE ref NOT IN (SELECT ref FROM matched) AND ref NOT IN (FROM ties))
"""
add("d10_match_secondary", GREEDY + "SELECT id, ref, days, outcome FROM said", prefix=False)(lambda s, d: matching.match_secondary(*candidates(s, d)))
PAIRS = """, rec AS (SELECT 'R' || o_orderkey AS ref, o_orderdate::DATE + (o_orderkey % 9 - 4)::INT AS day, round(o_totalprice * 100)::BIGINT AS a FROM orders WHERE o_orderkey % 7 = 0),
one AS (SELECT a FROM tx GROUP BY a HAVING count(*) = 1 INTERSECT SELECT a FROM rec GROUP BY a HAVING count(*) = 1)
"""


@add("d10_single_pairs", PAIRS + "SELECT tx.id, ref, abs(day - date)::INT AS days FROM rec JOIN tx USING (a) WHERE a IN (FROM one) AND abs(day - date) <= 5")
def _(spark, d):  # noqa: ANN001, ANN202
    tx, rec = candidates(spark, d)
    single = lambda df: df.groupBy(F.abs("cents").alias("a")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("a")
    both = single(tx).join(single(rec), "a")
    m = matching.match_secondary(tx, rec).where("outcome = 'matched'").join(tx.select("id", F.abs("cents").alias("a")), "id")
    return m.join(both, "a", "left_semi").select("id", "ref", "days")


CROWDED = GREEDY.replace("round(o_totalprice * 100)::BIGINT AS a FROM orders WHERE", "round(o_totalprice * 100)::BIGINT // 100000 AS a FROM orders WHERE").replace("cs AS (SELECT a, list", "cs AS (SELECT a // 100000 AS a, list").replace("FROM tx GROUP BY a)", "FROM tx GROUP BY a // 100000)")


@add("d10_crowded_amounts", CROWDED + "SELECT id, ref, days, outcome FROM said", prefix=False)
def _(spark, d):  # noqa: ANN001, ANN202
    """Amounts in whole thousands, so that many candidates and records compete for each other."""
    whole = F.floor(F.abs("cents") / 100_000).cast("long")
    return matching.match_secondary(*[df.withColumn("cents", whole) for df in candidates(spark, d)])


add("d10_match_report", GREEDY + "SELECT count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'unmatched') AS unmatched FROM said", prefix=False)(lambda s, d: matching.match_report(matching.match_secondary(*candidates(s, d))))


@add("d11_b32_best_name_match", None)
def _(spark, d):  # noqa: ANN001, ANN202
    """All vendors and, as exports spell them, all payees, against the vendors with a user label, whether or not they share a word."""
    party = text.counterparty_of(F.col("payee"), F.lit(""))
    tx = scratch_table(t.raw_transactions(spark, d).select("id", text.normalize_counterparty(party).alias("vendor"), F.lower("payee").alias("payee")), "name-facts")
    names = tx.where("vendor <> ''").select("vendor").union(tx.where("payee <> ''").select("payee"))
    return matching.best_name_match(names, lb.labelled_vendors(tx, t.labels(spark, d)), shared_word=False)


add("d9_vendors_to_look_up", "SELECT DISTINCT vendor FROM tx WHERE vendor <> '' AND regexp_extract(vendor, 'v([0-9]+)$', 1)::BIGINT % 3 <> 0")(lambda s, d: jobs.vendors_to_look_up(t.transactions(s, d), t.vendor_cache(s, d)))
FRESH = "(DATE '2001-01-01' + (regexp_extract(vendor, 'v([0-9]+)$', 1)::BIGINT % 400)::INT)"
add("c8_cache_freshness", f"SELECT DISTINCT vendor FROM tx WHERE vendor <> '' AND (regexp_extract(vendor, 'v([0-9]+)$', 1)::BIGINT % 3 <> 0 OR {FRESH} < DATE '2001-06-01')")(lambda s, d: jobs.vendors_to_look_up(t.transactions(s, d), t.vendor_cache(s, d), "2001-06-01"))
CACHE = f"""SELECT DISTINCT v.vendor, ['Supermarkt', 'Reisen', 'Sonstige', 'Telekommunikation'][n % 4 + 1] AS industry, 'About ' || regexp_replace(v.vendor, ' v[0-9]+$', '') AS summary, (DATE '2001-01-01' + (n % 400)::INT) AS fetched_at
FROM (SELECT {list(t.SHOP_KEYS)}[(o_custkey // 5) % 10 + 1] || ' v' || (o_custkey // 5) AS vendor, o_custkey // 5 AS n FROM orders WHERE o_custkey // 5 % 3 = 0) v"""
add("c9_vendor_list", f"SELECT * FROM ({CACHE}) WHERE industry = 'Reisen' ORDER BY fetched_at DESC, vendor LIMIT 20")(lambda s, d: jobs.vendor_list(t.vendor_cache(s, d), "reis", 20))
INDUSTRY = "['Sonstige', 'Sonstige', 'Supermarkt', 'Versorgung', 'Streaming', 'Gesundheit', 'Verkehr', 'Versicherung', 'Telekommunikation', 'Reisen']"
add("l11_d17_vendor_dimension", f"""SELECT vendor, industry, summary FROM ({CACHE}) UNION ALL SELECT DISTINCT vendor, {INDUSTRY}[list_position({list(t.SHOP_KEYS)}, regexp_replace(vendor, ' v[0-9]+$', ''))], '' FROM tx WHERE vendor <> '' AND regexp_extract(vendor, 'v([0-9]+)$', 1)::BIGINT % 3 <> 0""")(
    lambda s, d: jobs.vendor_dimension(t.transactions(s, d), t.vendor_cache(s, d), t.vendor_cache(s, d)))
add("d16_full_outer_periods", """SELECT coalesce(p.vendor, q.vendor) AS vendor, coalesce(p.n, 0) AS n_1997, coalesce(q.n, 0) AS n_1998 FROM (SELECT vendor, count(*) AS n FROM tx WHERE year(date) = 1997 GROUP BY 1) p FULL JOIN (SELECT vendor, count(*) AS n FROM tx WHERE year(date) = 1998 GROUP BY 1) q USING (vendor)""")(
    lambda s, d: t.transactions(s, d).where(F.year("date").isin(1997, 1998)).groupBy("vendor").agg(F.count(F.when(F.year("date") == 1997, 1)).alias("n_1997"), F.count(F.when(F.year("date") == 1998, 1)).alias("n_1998")))

# secondary source and maintenance
add("c7_candidates", "SELECT id FROM tx WHERE payer LIKE '%PayPal%'")(lambda s, d: t.transactions(s, d).where(F.lower("payer").contains("paypal")).select("id"))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    tx, rec = candidates(spark, d)
    return jobs.enrich(tx, rec, rec.where("ref like '%0'"), "paypal", "paypal")[0]


add("l1_enrich", PAIRS + """SELECT tx.id, CASE WHEN m.ref IS NOT NULL THEN 'paypal' END AS enrichment_source, m.ref AS enrichment_ref, CASE WHEN m.ref IS NOT NULL THEN 'Shop ' || (substr(m.ref, 2)::BIGINT % 10) || CASE WHEN substr(m.ref, 2)::BIGINT % 2 = 0 THEN ' (a@example.com)' ELSE '' END ELSE memo END AS memo
FROM tx LEFT JOIN (SELECT tx.id, ref FROM rec JOIN tx USING (a) WHERE payer <> '' AND ref NOT LIKE '%0' AND abs(day - date) <= 5 QUALIFY count(*) OVER (PARTITION BY tx.id) = 1 AND count(*) OVER (PARTITION BY ref) = 1) m USING (id)""")(lambda s, d: enriched(s, d).select("id", "enrichment_source", "enrichment_ref", "memo"))
add("l2_enrichment_preview", PAIRS + """SELECT tx.id, m.ref AS enrichment_ref, memo AS memo_before, 'Shop ' || (substr(m.ref, 2)::BIGINT % 10) || CASE WHEN substr(m.ref, 2)::BIGINT % 2 = 0 THEN ' (a@example.com)' ELSE '' END AS memo
FROM tx JOIN (SELECT tx.id, ref FROM rec JOIN tx USING (a) WHERE payer <> '' AND ref NOT LIKE '%0' AND abs(day - date) <= 5 QUALIFY count(*) OVER (PARTITION BY tx.id) = 1 AND count(*) OVER (PARTITION BY ref) = 1) m USING (id)""")(lambda s, d: jobs.enrichment_preview(enriched(s, d)))
add("l3_reflag_own", "SELECT id, (coalesce(self, 0) = 1 AND iban IN (SELECT iban FROM own WHERE right(label, 1) <> '3'))::INT AS iban_is_known_self, (coalesce(self, 0) = 1 AND iban NOT IN (SELECT iban FROM own WHERE right(label, 1) <> '3'))::INT AS changed FROM tx")(
    lambda s, d: jobs.reflag_own(t.transactions(s, d), t.own_ibans(s, d).where(F.col("label").rlike("[^3]$"))).select("id", "iban_is_known_self", "changed"))
NATION_ONE = "SELECT " + t._IBAN.format(k="c_custkey") + " AS iban, c_name AS label FROM customer WHERE c_nationkey = 1"


def accounts(spark: SparkSession, d: str, nation: int) -> DataFrame:
    """Numbers as a user types them, with blanks."""
    number = t.own_ibans(spark, d, nation)
    return number.withColumn("iban", F.concat(F.substring("iban", 1, 4), F.lit(" "), F.substring("iban", 5, 40)))


add("l3_add_own", f", more AS ({NATION_ONE}) SELECT (SELECT count(*) FROM more) + (SELECT count(*) FROM own) AS accounts, count(*) FILTER (iban IN (SELECT iban FROM more)) AS changed, count(*) FILTER (self = 1) + count(*) FILTER (iban IN (SELECT iban FROM more)) AS flagged FROM tx")(
    lambda s, d: (lambda own, tx, report, bad: own.agg(F.count(F.lit(1)).alias("accounts")).crossJoin(report).crossJoin(tx.agg(F.count(F.when(F.col("iban_is_known_self") == 1, 1)).alias("flagged"))))(*maintenance.add_own(t.own_ibans(s, d), accounts(s, d, 1).unionByName(accounts(s, d, 1).limit(2).withColumn("iban", F.lit("DE00 1"))), t.transactions(s, d))))
add("l3_remove_own", "SELECT (SELECT count(*) FROM own WHERE right(label, 1) <> '3') AS accounts, count(*) FILTER (self = 1 AND iban IN (SELECT iban FROM own WHERE right(label, 1) = '3')) AS changed, count(*) FILTER (iban IN (SELECT iban FROM own WHERE right(label, 1) <> '3')) AS flagged FROM tx")(
    lambda s, d: (lambda own, tx, report: own.agg(F.count(F.lit(1)).alias("accounts")).crossJoin(report).crossJoin(tx.agg(F.count(F.when(F.col("iban_is_known_self") == 1, 1)).alias("flagged"))))(*maintenance.remove_own(t.own_ibans(s, d), accounts(s, d, 0).where("label like '%3'").unionByName(accounts(s, d, 1)), t.transactions(s, d))))
add("l3_relabel_own", "SELECT iban, CASE WHEN right(label, 1) = '3' THEN 'Konto ' || label ELSE label END AS label FROM own")(
    lambda s, d: maintenance.relabel_own(t.own_ibans(s, d), accounts(s, d, 0).where("label like '%3'").withColumn("label", F.concat(F.lit(" Konto "), "label")).unionByName(accounts(s, d, 1)))[0])
RESET = "SELECT 'labels' AS \"table\", (SELECT count(*) FROM lab) AS n_rows UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings) UNION ALL SELECT 'notes', (SELECT count(DISTINCT event_id) FROM events WHERE event_id % 10 = 0) UNION ALL SELECT 'transactions', (SELECT count(*) FROM tx)"


def snapshot(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"transactions": t.transactions(spark, d), "labels": t.labels(spark, d), "embeddings": t.vectors(spark, d), "notes": t.notes(spark, d), "categories": t.categories(spark, d), "own_ibans": t.own_ibans(spark, d)}


def after_reset(spark: SparkSession, d: str, everything: bool) -> DataFrame:
    """What went, and what is left of each table."""
    left, report = maintenance.reset(snapshot(spark, d), everything=everything)
    rows = None
    for name, df in left.items():
        one = df.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(name).alias("table"), "n_left")
        rows = one if rows is None else rows.unionByName(one)
    return rows.join(report, "table", "left").select("table", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_left")


add("l6_reset_data", f"SELECT *, 0 AS n_left FROM ({RESET}) UNION ALL SELECT 'categories', 0, (SELECT count(*) FROM cat) UNION ALL SELECT 'own_ibans', 0, (SELECT count(*) FROM own)")(lambda s, d: after_reset(s, d, False))
add("l6_reset_all", f"SELECT *, 0 AS n_left FROM ({RESET} UNION ALL SELECT 'categories', (SELECT count(*) FROM cat) UNION ALL SELECT 'own_ibans', (SELECT count(*) FROM own))")(lambda s, d: after_reset(s, d, True))
add("l6_delete_user_labels", "SELECT (SELECT count(*) FROM lab WHERE source = 'user') AS deleted, count(*) AS n_left FROM lab WHERE source <> 'user'")(
    lambda s, d: (lambda left, report: report.crossJoin(left.agg(F.count(F.lit(1)).alias("n_left"))))(*maintenance.delete_user_labels(t.labels(s, d))))
add("b17_invalid_ibans", "SELECT id, iban FROM tx WHERE iban NOT LIKE 'DE%'")(lambda s, d: jobs.invalid_ibans(t.transactions(s, d).select("id", "iban")))


def changes(spark: SparkSession, d: str) -> DataFrame:
    o = t.read(spark, d, "orders").where("o_orderstatus = 'P'")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("set_user", "set_model", "clear", "promote")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("expense_id"), kind.alias("action"), F.lit(7).alias("category_id"), F.lit(0.9).alias("confidence"), F.lit("2002-01-01").cast("timestamp").alias("created_at"))


CHANGED = """, ch AS (SELECT o_orderkey AS expense_id, o_orderkey % 4 AS k FROM orders WHERE o_orderstatus = 'P'),
nl AS (SELECT expense_id, category_id, source, confidence FROM lab WHERE expense_id NOT IN (SELECT expense_id FROM ch WHERE k = 2) UNION ALL SELECT expense_id, 7, 'user', NULL FROM ch WHERE k = 0 UNION ALL SELECT expense_id, 7, 'model', 0.9 FROM ch WHERE k = 1 UNION ALL SELECT expense_id, category_id, 'user', NULL FROM ch JOIN latest USING (expense_id) WHERE k = 3)
"""
add("l5_apply_changes", CHANGED + "SELECT expense_id, category_id, source, confidence, count(*) AS n FROM nl GROUP BY ALL")(
    lambda s, d: jobs.apply_changes(t.labels(s, d), changes(s, d)).groupBy("expense_id", "category_id", "source", "confidence").agg(F.count(F.lit(1)).alias("n")))
add("l4_append_labels", "SELECT count(*) AS n, count(DISTINCT label_id) AS ids, max(label_id) AS last FROM (SELECT label_id FROM lab UNION ALL SELECT (SELECT max(label_id) FROM lab) + row_number() OVER () FROM orders WHERE o_orderstatus = 'P')")(
    lambda s, d: jobs.log_numbers(jobs.append_labels(t.labels(s, d), changes(s, d).select("expense_id", "category_id", F.lit("user").alias("source"), F.lit(None).cast("double").alias("confidence"), "created_at"))))
add("l6_delete_category", "SELECT source, count(*) AS n FROM lab WHERE category_id <> 3 GROUP BY 1")(lambda s, d: jobs.delete_category(t.labels(s, d), t.categories(s, d), 3)[0].groupBy("source").agg(F.count(F.lit(1)).alias("n")))
add("l6_clear_labels", "SELECT source, count(*) AS n FROM lab WHERE NOT (source = 'user' AND expense_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) GROUP BY 1")(lambda s, d: jobs.clear_labels(t.labels(s, d), changes(s, d), "user").groupBy("source").agg(F.count(F.lit(1)).alias("n")))
add("l7_collapse_whitespace", """SELECT count(*) FILTER (k > 0) AS rows_changed, sum(k)::BIGINT AS fields_changed FROM (SELECT (memo LIKE '%  %')::INT + (counterparty LIKE '%  %')::INT AS k FROM tx)""")(lambda s, d: jobs.collapse_whitespace(t.transactions(s, d))[1])
add("l8_upsert", "SELECT category_id, CASE WHEN category_id % 2 = 0 THEN lower(name) ELSE name END AS name, is_savings FROM cat WHERE category_id <> 4 UNION ALL SELECT 100, 'new', 0")(
    lambda s, d: jobs.upsert(
        t.categories(s, d).select("category_id", "name", "is_savings"),
        t.categories(s, d).where("category_id % 2 = 0").select("category_id", F.lower("name").alias("name"), F.lit(9).alias("is_savings")).unionByName(t.categories(s, d).where("category_id = 0").select(F.lit(100).alias("category_id"), F.lit("new").alias("name"), F.lit(0).alias("is_savings"))),
        "category_id", keep=("is_savings",), delete=F.col("category_id") == 4))
add("l9_simplify_memos", f"SELECT id, CASE WHEN payer <> '' THEN {list(t.SHOP_KEYS)}[list_position({list(t.SHOPS)}, regexp_replace(split_part(memo, 'bei ', 2), ' 24$', ''))] || ' 24' ELSE vendor END AS vendor, (payer <> '')::INT AS changed FROM tx")(lambda s, d: jobs.simplify_memos(t.transactions(s, d)).select("id", "vendor", "changed"))


# ingest and files
def parsed(spark: SparkSession, d: str) -> DataFrame:
    return t.raw_transactions(spark, d).withColumns({"value_date": F.col("date"), "source_file": F.concat(F.lit("f"), (F.col("id") % 3).cast("string")), "source_row": F.col("id")})


def ingested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = parsed(spark, d)
    again = rows.where("id % 4 = 0").withColumn("source_file", F.lit("g"))
    store = jobs.derive(rows.where("id % 5 = 1"), t.own_ibans(spark, d)).select("dedup_hash")
    return jobs.ingest(rows.unionByName(again), store, t.own_ibans(spark, d))


HASH = """, h AS (SELECT id, sha256(concat(date, '|', date, '|', cents, '|', iban, '|', CASE WHEN vendor = '' THEN CASE WHEN payer <> '' THEN 'europe' ELSE '' END ELSE vendor END, '|', """
MEMO_KEY = f"""CASE WHEN payer <> '' THEN 'pp 1234 ihr einkauf bei ' || {list(t.SHOP_KEYS)}[list_position({list(t.SHOPS)}, regexp_replace(split_part(memo, 'bei ', 2), ' 24$', ''))] || ' 24' ELSE trim(regexp_replace(regexp_replace(lower(memo), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) END)) AS h FROM tx)
"""
add("a9_dedup_hash", HASH + MEMO_KEY + "SELECT id, h AS dedup_hash FROM h")(lambda s, d: jobs.derive(parsed(s, d), t.own_ibans(s, d)).select("id", "dedup_hash"))
add("a9_ingest_report", HASH + MEMO_KEY + "SELECT *, parsed - new AS duplicate FROM (SELECT (SELECT count(*) + count(*) FILTER (id % 4 = 0) FROM tx) AS parsed, (SELECT count(DISTINCT h) FROM h WHERE h NOT IN (SELECT h FROM h WHERE id % 5 = 1)) AS new)")(lambda s, d: ingested(s, d)[1])
add("a10_derive_rows", """SELECT id, vendor, is_income, (a %% 500 = 0 AND a > 0)::INT AS is_round, coalesce(self, 0) AS iban_is_known_self, concat_ws(' | ', nullif(CASE WHEN vendor = '' AND payer <> '' THEN 'europe' ELSE vendor END, ''), m) AS combined FROM (SELECT *, CASE WHEN payer <> '' THEN %s[list_position(%s, regexp_replace(split_part(memo, 'bei ', 2), ' 24$', ''))] || ' 24' ELSE trim(regexp_replace(regexp_replace(lower(memo), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) END AS m FROM tx)""" % (list(t.SHOP_KEYS), list(t.SHOPS)))(
    lambda s, d: jobs.derive(parsed(s, d), t.own_ibans(s, d)).select("id", F.when(F.col("payee") == "", "").otherwise(F.col("vendor")).alias("vendor"), "is_income", "is_round", "iban_is_known_self", "combined"))


def german(cents: Column) -> Column:
    whole = F.replace(F.format_number(F.floor(F.abs(cents) / 100), 0), F.lit(","), F.lit("."))
    return F.concat(F.when(cents < 0, "-").otherwise(""), whole, F.lit(","), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))


def quoted(*cells: Column, sep: str = ";") -> Column:
    return F.concat_ws(sep, *[F.concat(F.lit('"'), c, F.lit('"')) for c in cells])


FILE_IDS = 1000  # order keys to a file, so that files grow in number and not in size


def write_lines(lines: DataFrame, path: str) -> None:
    """(f, at, line) as one text file for each f, lines in the order of ``at``.

    The files are many and small, so that tasks are made by number, not by size, and put their files in place themselves, which else the driver does one by one.
    """
    rows = lines.repartition(4 * lines.sparkSession.sparkContext.defaultParallelism, "f").sortWithinPartitions("f", "at").select("f", F.col("line").alias("value"))
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("f").text(path)


def bank_files(spark: SparkSession, d: str, broken: bool = False) -> DataFrame:
    path = scratch_path(spark, "bank-files")
    write_bank_files(spark, d, path, broken)
    return files.read_files(spark, path).where(F.length("content") > 0)


def write_bank_files(spark: SparkSession, d: str, path: str, broken: bool = False) -> None:
    """The transactions written as bank exports, some after a preamble and in another column order.

    Memos of every seventh row hold a line break. ``broken``: a few rows have no date or amount, and one file no header.
    """
    r = t.raw_transactions(spark, d).withColumn("f", F.floor(F.col("id") / FILE_IDS))
    day, cents = F.date_format("date", "dd.MM.yyyy"), german(F.col("cents"))
    if broken:
        day, cents = F.when(F.col("id") % 5000 == 7, "99.99.2000").otherwise(day), F.when(F.col("id") % 5000 == 8, "viel").otherwise(cents)
    memo = F.concat(F.col("memo"), F.when(F.col("id") % 7 == 0, "\n").otherwise(" "), F.lit("#"), F.col("id").cast("string"))
    one = quoted(day, F.lit(""), F.col("payer"), F.col("payee"), memo, F.col("kind"), F.col("iban"), cents, *[F.lit("")] * 40)
    two = quoted(day, cents, memo, F.col("iban"), F.col("payee"))
    body = r.select("f", F.col("id").alias("at"), F.when(F.col("f") % 2 == 0, one).otherwise(two).alias("line"))
    wide = '"Buchungsdatum";"Wertstellung";"Zahlungspflichtige*r";"Zahlungsempfänger*in";"Verwendungszweck";"Umsatztyp";"IBAN";"Betrag (€)"' + "".join(f';"Zusatz {i}"' for i in range(40))
    head = F.when(F.col("f") % 2 == 0, F.lit(wide)).otherwise(F.lit("Konto;12\n\nBuchungsdatum;Betrag (€);Verwendungszweck;IBAN;Zahlungsempfänger*in"))
    ends = body.select("f").distinct().select("f", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("at"), head.alias("line")), F.struct(F.lit(2**62).alias("at"), F.lit(";;").alias("line")))).alias("x")).select("f", "x.*")
    lines = body.unionByName(ends)
    if broken:
        lines = lines.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("f"), F.lit(0).cast("long").alias("at"), F.lit("no;bank;file").alias("line")))
    write_lines(lines, path)


add("a1_a3_bank_files", "SELECT id, date, cents, CASE WHEN iban LIKE 'FR%' THEN 'fr' || substr(iban, 3) ELSE iban END AS iban FROM tx")(
    lambda s, d: files.bank_rows(bank_files(s, d))[0].select(F.regexp_extract("memo", r"#(\d+)$", 1).cast("long").alias("id"), "date", "cents", "iban"))


@add("a1_split_bank_files", "SELECT id, date, cents, CASE WHEN iban LIKE 'FR%' THEN 'fr' || substr(iban, 3) ELSE iban END AS iban FROM tx")
def _(spark, d):  # noqa: ANN001, ANN202
    """The same exports, record by record over splits of their files."""
    path = scratch_path(spark, "bank-files")
    write_bank_files(spark, d, path)
    good, _ = files.bank_rows(files.read_records(spark, path))
    return good.select(F.regexp_extract("memo", r"#(\d+)$", 1).cast("long").alias("id"), "date", "cents", "iban")


REJECTS = "SELECT id FROM tx WHERE id % 5000 IN (7, 8)"
add("a6_rejects", f"SELECT (SELECT count(*) + 1 FROM ({REJECTS})) AS rejects, count(*) AS n FROM tx WHERE id // {FILE_IDS} NOT IN (SELECT id // {FILE_IDS} FROM ({REJECTS}))")(
    lambda s, d: (lambda good, bad: bad.agg(F.count(F.lit(1)).alias("rejects")).crossJoin(files.whole_files_only(good, bad).agg(F.count(F.lit(1)).alias("n"))))(*files.bank_rows(bank_files(s, d, broken=True))))


def activity_files(spark: SparkSession, d: str) -> DataFrame:
    """The secondary records written as activity exports with three separators, and read back."""
    r = t.secondary(spark, d).withColumn("at", F.substring("ref", 2, 20).cast("long")).withColumn("f", F.floor(F.col("at") / FILE_IDS))
    sep = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t")), (F.col("f") % 3 + 1).cast("int"))
    joined = lambda *cells: F.array_join(F.transform(F.array(*cells), lambda c: F.concat(F.lit('"'), c, F.lit('"'))), "\u0001")
    head = joined(*[F.lit(x) for x in ("Datum", "Netto", "Name", "Absender E-Mail-Adresse", "Transaktionscode")])
    line = joined(F.date_format("txn_date", "dd.MM.yyyy"), german(F.col("cents")), F.col("name"), F.col("email"), F.col("ref"))
    lines = r.select("f", "at", line.alias("line")).unionByName(r.select("f").distinct().select("f", F.lit(-1).cast("long").alias("at"), head.alias("line")))
    path = scratch_path(spark, "activity-files")
    write_lines(lines.withColumn("line", F.replace("line", F.lit("\u0001"), sep)), path)
    return files.read_files(spark, path).where(F.length("content") > 0)


add("a7_activity_files", "SELECT 'R' || o_orderkey AS ref, o_orderdate::DATE + (o_orderkey % 9 - 4)::INT AS txn_date, round(o_totalprice * 100)::BIGINT AS cents, 'Shop ' || (o_orderkey % 10) || CASE WHEN o_orderkey % 2 = 0 THEN ' (a@example.com)' ELSE '' END AS description FROM orders WHERE o_orderkey % 7 = 0")(
    lambda s, d: files.activity_rows(activity_files(s, d)).select("ref", "txn_date", "cents", "description"))
add("a8_m2_classify_files", f"SELECT 'bank' AS kind, count(DISTINCT id // {FILE_IDS}) AS n FROM tx UNION ALL SELECT 'paypal', count(DISTINCT o_orderkey // {FILE_IDS}) FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT NULL, 1")(
    lambda s, d: files.classify_files(bank_files(s, d, broken=True).unionByName(activity_files(s, d))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
add("a11_missing_embeddings", "SELECT tx.id FROM tx WHERE id NOT IN (SELECT vec_id FROM embeddings)")(lambda s, d: jobs.missing_embeddings(t.transactions(s, d), t.vectors(s, d), "given", hash_embedding(F.col("vendor"))).select("id"))
add("a12_load_embeddings", "SELECT vec_id AS id, len(embedding)::INT AS dim FROM embeddings WHERE vec_id IN (SELECT id FROM tx)")(
    lambda s, d: jobs.load_embeddings(t.vectors(s, d).unionByName(t.vectors(s, d).limit(3).withColumn("vector", F.slice("vector", 1, 3))), "given", t.transactions(s, d)).select("id", "dim"))
add("a13_purge_embeddings", "SELECT 'given' AS model, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'old', count(*) FROM embeddings WHERE vec_id % 2 = 1")(
    lambda s, d: (lambda kept, gone: kept.groupBy("model").agg(F.count(F.lit(1)).alias("n")).unionByName(gone))(*jobs.purge_embeddings(t.vectors(s, d).withColumn("model", F.when(F.col("id") % 2 == 1, "old").otherwise("given")), "given")))


def letter_counts():  # noqa: ANN201
    """A stand-in for a user's encoder: counts of eight letters."""
    import numpy as np

    return lambda texts: np.array([[x.count(c) for c in "aehilnor"] for x in texts], dtype=np.float32)


add("m1_embed_rows", "SELECT id, [length(vendor) - length(replace(vendor, c, '')) FOR c IN ['a', 'e', 'h', 'i', 'l', 'n', 'o', 'r']]::VARCHAR AS vector FROM tx")(
    lambda s, d: jobs.embed_rows(t.transactions(s, d), "letters", letter_counts, column="vendor").select("id", F.concat(F.lit("["), F.array_join(F.col("vector").cast("array<int>"), ", "), F.lit("]")).alias("vector")))
MATCHED = """, m AS (SELECT tx.id, ref FROM rec JOIN tx USING (a) WHERE payer <> '' AND ref NOT LIKE '%0' AND abs(day - date) <= 5 QUALIFY count(*) OVER (PARTITION BY tx.id) = 1 AND count(*) OVER (PARTITION BY ref) = 1),
said AS (SELECT id, 'shop ' || (substr(ref, 2)::BIGINT % 10) || CASE WHEN substr(ref, 2)::BIGINT % 2 = 0 THEN ' a example com' ELSE '' END AS memo FROM m),
texts AS (SELECT tx.id, coalesce(tx.vendor || ' | ' || said.memo, tx.vendor) AS t FROM tx LEFT JOIN said USING (id) WHERE tx.vendor <> '' AND tx.payer <> '')
"""


def refreshed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of the vendors' names alone, and after enrichment those of the enriched rows of all their text."""
    tx, rec = candidates(spark, d)
    tx = tx.where("vendor <> '' and payer <> ''")
    old = jobs.embed_rows(tx, "letters", letter_counts, column="vendor")
    _, vectors, _, report = jobs.enrich_and_embed(tx, rec, rec.where("ref like '%0'"), "paypal", "paypal", old, "letters", letter_counts)
    return vectors, report


add("l1_refreshed_vectors", PAIRS.rstrip() + MATCHED + "SELECT id, [length(t) - length(replace(t, c, '')) FOR c IN ['a', 'e', 'h', 'i', 'l', 'n', 'o', 'r']]::VARCHAR AS vector FROM texts")(
    lambda s, d: refreshed(s, d)[0].select("id", F.concat(F.lit("["), F.array_join(F.col("vector").cast("array<int>"), ", "), F.lit("]")).alias("vector")))
add("l1_enrichment_report", PAIRS.rstrip() + MATCHED + "SELECT count(*) AS candidates, count(*) FILTER (ref LIKE '%0') AS skipped, (SELECT count(*) FROM m WHERE id IN (SELECT id FROM texts)) AS matched, (SELECT count(*) FROM m WHERE id IN (SELECT id FROM texts)) AS embedded, 0 AS ambiguous, count(*) FILTER (ref NOT LIKE '%0') - (SELECT count(*) FROM m WHERE id IN (SELECT id FROM texts)) AS unmatched FROM rec")(
    lambda s, d: refreshed(s, d)[1])
add("a13_embedding_inventory", "SELECT 'given' AS model, len(embedding)::INT AS dim, count(*) AS n FROM embeddings GROUP BY 2")(lambda s, d: jobs.embedding_inventory(t.vectors(s, d)))
NOTES = ", notes AS (SELECT event_id * 4 AS expense_id, max(event_type) AS text FROM events WHERE event_id % 10 = 0 GROUP BY 1)\n"


@add("a14_export", NOTES + "SELECT s.id, s.date, counterparty, memo, iban, cents, category, label_source, confidence, text AS note FROM s LEFT JOIN notes n ON n.expense_id = s.id")
def _(spark, d):  # noqa: ANN001, ANN202
    return scratch_table(jobs.export(spine(spark, d), t.notes(spark, d)), "export")


add("a14_labels_only", "SELECT iban, category FROM s WHERE label_source = 'user'")(lambda s, d: spine(s, d).where("label_source = 'user'").select("iban", "category"))
EXPORT = "id long, date date, counterparty string, memo string, iban string, cents long, category string, label_source string, confidence double, note string"


@add("a14_export_csv", NOTES + "SELECT s.id, s.date, counterparty, memo, iban, cents, category, label_source, confidence, text AS note FROM s LEFT JOIN notes n ON n.expense_id = s.id")
def _(spark, d):  # noqa: ANN001, ANN202
    """Written as CSV in order of date, with a mark, and read back."""
    path = scratch_path(spark, "export-csv")
    maintenance.write_export(jobs.export(spine(spark, d), t.notes(spark, d)), path, "csv", ("date", "id"))
    back = maintenance.read_export(spark, path, EXPORT)
    return back.withColumns({c: F.coalesce(c, F.lit("")) for c in ("counterparty", "memo", "iban")})


add("a14_labels_handoff", "SELECT expense_id, latest.category_id, cat.name AS category, source, confidence FROM latest LEFT JOIN cat USING (category_id)")(lambda s, d: maintenance.labels_handoff(t.labels(s, d), t.categories(s, d)))
add("a16_profile_all", """, n AS (""" + " UNION ALL ".join(f"SELECT '{x}' AS \"table\", count(*) AS n_rows FROM {x}" for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")) + """)
SELECT "table", column_name AS "column", n_rows, 0 AS n_nulls FROM n JOIN (SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN (SELECT "table" FROM n)) ON table_name = "table" WHERE n_rows > 0""")(
    lambda s, d: jobs.profile({x: t.read(s, d, x) for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")}).where("n_rows > 0").select("table", "column", "n_rows", "n_nulls"))
add("a16_profile", """SELECT 'customer' AS "table", (SELECT count(*) FROM customer) AS n_rows, 'c_custkey' AS "column", (SELECT count(*) - count(c_custkey) FROM customer) AS n_nulls UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 'n_name', 0""")(
    lambda s, d: jobs.profile({n: t.read(s, d, n) for n in ("customer", "nation")}).where("column in ('c_custkey', 'n_name')").select("table", "n_rows", "column", "n_nulls"))


# categorisation
@add("h5_vendor_exact_match", """, d AS (SELECT vendor, category_id, count(*) AS n FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' AND vendor <> '' GROUP BY 1, 2), dv AS (SELECT *, sum(n) OVER (PARTITION BY vendor) AS t, row_number() OVER (PARTITION BY vendor ORDER BY n DESC, category_id) AS r FROM d),
e AS (SELECT iban, category_id, count(*) AS n FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' AND iban <> '' GROUP BY 1, 2), di AS (SELECT *, sum(n) OVER (PARTITION BY iban) AS t, row_number() OVER (PARTITION BY iban ORDER BY n DESC, category_id) AS r FROM e)
SELECT tx.id, coalesce(dv.category_id, di.category_id) AS category_id, round(CASE WHEN dv.n IS NOT NULL THEN dv.n / dv.t ELSE di.n / di.t END, 6) AS confidence FROM tx LEFT JOIN dv ON dv.vendor = tx.vendor AND dv.r = 1 AND dv.n / dv.t >= 0.2 LEFT JOIN di ON di.iban = tx.iban AND di.r = 1 AND di.n / di.t >= 0.2 WHERE coalesce(dv.category_id, di.category_id) IS NOT NULL""")
def _(spark, d):  # noqa: ANN001, ANN202
    tx = t.transactions(spark, d)
    return cascade.vendor_stage(tx, tx, t.labels(spark, d), 0.2).select("id", "category_id", "confidence")


add("h1_h2_feature_frame", "SELECT id, round(ln(1 + a / 100.0), 6) AS log_abs_amount, is_income, year(date)::INT AS year, month(date)::INT AS month, quarter(date)::INT AS quarter, CASE WHEN iban <> '' THEN (iban NOT LIKE 'DE%')::INT END AS iban_is_foreign, coalesce(self, 0) AS iban_is_known_self, 0 AS has_glaeubiger_id, 0 AS mandatsreferenz_present FROM tx")(
    lambda s, d: cascade.feature_frame(t.transactions(s, d), t.vectors(s, d)).select("id", "log_abs_amount", "is_income", "year", "month", "quarter", "iban_is_foreign", "iban_is_known_self", "has_glaeubiger_id", "mandatsreferenz_present"))


def labelled_vectors(spark: SparkSession, d: str) -> DataFrame:
    return t.vectors(spark, d).select("id", "vector", "category_id")


def embedded_rows(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return labelled_vectors(spark, d).withColumn("x", array_to_vector(F.col("vector").cast("array<double>")))


@add("h3_h7_classifier", None)
def _(spark, d):  # noqa: ANN001, ANN202
    rows = embedded_rows(spark, d)
    fit, rest = rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")
    return cascade.classifier_stage(cascade.class_probabilities(cascade.fit_classifier(fit, forest=False), rest), 0.0)


@add("h4_calibrated_probabilities", None)
def _(spark, d):  # noqa: ANN001, ANN202
    rows = embedded_rows(spark, d)
    out = cascade.calibrated_probabilities(rows.where("id % 3 <> 2"), rows.where("id % 3 = 2"), forest=False)
    return out.select("id", F.col("ranked")[0]["category_id"].alias("category_id"), F.col("ranked")[0]["p"].alias("p"))


@add("h8_d15_category_similarity", None)
def _(spark, d):  # noqa: ANN001, ANN202
    rows = t.transactions(spark, d).select("id", text.combined_text(F.col("vendor"), text.normalize_memo(F.col("memo"))).alias("combined")).withColumn("vector", hash_embedding(F.col("combined")))
    return cascade.similarity_stage(rows, t.categories(spark, d))


WORDS_OF = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 4))"
BYTES_OF = "list_transform(range(64), lambda i: (('0x' || sha256({x})[(i % 32) * 2 + 1:(i % 32) * 2 + 2])::INT - 127.5)::DOUBLE)"
LIKENESS = f""", known AS (SELECT vendor, CASE WHEN industry <> 'Sonstige' THEN industry ELSE '' END AS industry FROM ({CACHE})),
texts AS (SELECT tx.id, concat_ws(' | ', nullif(tx.vendor, ''), replace(lower(kind), '-', ' ')) AS c, coalesce(known.industry, '') AS industry FROM tx LEFT JOIN known USING (vendor)),
r AS (SELECT id, {BYTES_OF.format(x="c")} AS v, {WORDS_OF.format(x="c || ' ' || industry")} AS w FROM texts),
c AS (SELECT category_id, {BYTES_OF.format(x="name")} AS a, {BYTES_OF.format(x="CASE WHEN description <> '' THEN name || ': ' || description ELSE name END")} AS b, {WORDS_OF.format(x="name || ' ' || description")} AS w FROM cat),
liked AS (SELECT id, category_id, round(greatest(list_cosine_similarity(r.v, c.a), list_cosine_similarity(r.v, c.b)) + least(0.15::DOUBLE, 0.05::DOUBLE * len(list_intersect(r.w, c.w))), 12) AS s FROM r, c),
two AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, category_id) AS k, lead(s) OVER (PARTITION BY id ORDER BY s DESC, category_id) AS next FROM liked)
"""


@add("h8_vendor_industry", LIKENESS + "SELECT id, category_id, round(s, 6) AS confidence FROM two WHERE k = 1 AND s >= 0.25 AND round(s - next, 12) >= 0.03")
def _(spark, d):  # noqa: ANN001, ANN202
    """Likeness to the categories' texts, the industries of the vendor cache included."""
    tx, config = t.transactions(spark, d).withColumn("memo", F.col("kind")), cascade.CascadeConfig()
    rows = cascade.similarity_rows(cascade.row_texts(tx, t.vendor_cache(spark, d), config), config)
    return cascade.similarity_stage(rows, t.categories(spark, d)).select("id", "category_id", "confidence")


def keyword_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a model: rows that name an hotel are category 1, railways 2, all others abstain."""
    hit = batch["premise"].map(lambda p: 1 if "hotel" in p else 2 if "bahn" in p else None)
    return batch.assign(category_id=hit.astype("Int32"), confidence=0.6)


add("h9_m1_zeroshot_hook", "SELECT id, CASE WHEN vendor LIKE 'hotel%' OR memo LIKE '%Hotel%' THEN 1 ELSE 2 END AS category_id, 0.6::DOUBLE AS confidence FROM tx WHERE vendor LIKE 'hotel%' OR vendor LIKE 'bahn%' OR memo LIKE '%Hotel%' OR memo LIKE '%Bahn%'")(
    lambda s, d: cascade.zeroshot_stage(t.transactions(s, d).select("id", text.combined_text(F.col("vendor"), text.normalize_memo(F.col("memo"))).alias("premise")), keyword_scorer).select("id", "category_id", "confidence"))


def all_stages(**other) -> cascade.CascadeConfig:  # noqa: ANN003
    """All four stages that need no model from outside; thresholds at which the synthetic labels, which are drawn at random, are not all too weak."""
    return cascade.CascadeConfig(vendor_agreement=0.2, knn_agreement=2, classifier_threshold=0.2, zeroshot_below=0.15, classifier={"forest": False, "max_iter": 10}, **other)


def written(spark: SparkSession, d: str) -> DataFrame:
    """The transactions made once, for jobs that read them again and again."""
    return scratch_table(t.transactions(spark, d), "transactions")


def predictions(spark: SparkSession, d: str, config: cascade.CascadeConfig | None = None) -> DataFrame:
    tx, labels = written(spark, d), t.labels(spark, d)
    return cascade.predict(lb.without_label(tx, labels), tx, labels, t.categories(spark, d), t.vectors(spark, d), config or all_stages(), vendors=t.vendor_cache(spark, d))


add("h10_h12_cascade", None)(predictions)
#: The first two stages and the sign's veto: vendors' and accounts' majorities, then neighbours' votes for what is left.
TWO_STAGES = VEC.rstrip() + """, d AS (SELECT vendor, category_id, count(*) AS n FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' AND vendor <> '' GROUP BY 1, 2), dv AS (SELECT *, sum(n) OVER (PARTITION BY vendor) AS t, row_number() OVER (PARTITION BY vendor ORDER BY n DESC, category_id) AS r FROM d),
e AS (SELECT iban, category_id, count(*) AS n FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' AND iban <> '' GROUP BY 1, 2), di AS (SELECT *, sum(n) OVER (PARTITION BY iban) AS t, row_number() OVER (PARTITION BY iban ORDER BY n DESC, category_id) AS r FROM e),
open AS (SELECT * FROM tx WHERE id NOT IN (SELECT expense_id FROM latest_user)),
one AS (SELECT open.id, coalesce(dv.category_id, di.category_id) AS category_id, 'vendor_exact_match' AS stage FROM open LEFT JOIN dv ON dv.vendor = open.vendor AND dv.r = 1 AND dv.n / dv.t >= 0.25 LEFT JOIN di ON di.iban = open.iban AND di.r = 1 AND di.n / di.t >= 0.25 WHERE coalesce(dv.category_id, di.category_id) IS NOT NULL),
two AS (SELECT votes.id, category_id, 'knn' AS stage FROM votes JOIN open USING (id) WHERE r = 1 AND n >= 2 AND votes.id NOT IN (SELECT id FROM one)),
sc AS (SELECT lab.category_id, count(*) FILTER (cents > 0) AS p, count(*) FILTER (cents < 0) AS n FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' GROUP BY 1), g AS (SELECT category_id, CASE WHEN p >= n THEN 1 ELSE -1 END AS sg FROM sc WHERE greatest(p, n) / (p + n) >= 0.95 AND p + n >= 5),
said AS (FROM one UNION ALL FROM two), final AS (SELECT open.id, CASE WHEN sg IS NULL OR sign(cents) = sg THEN said.category_id END AS category_id, CASE WHEN said.id IS NULL OR sign(cents) <> sg THEN 'unknown' ELSE stage END AS stage FROM open LEFT JOIN said USING (id) LEFT JOIN g ON g.category_id = said.category_id)
"""


def two_stages(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d, cascade.CascadeConfig(enabled=cascade.STAGES[:2], vendor_agreement=0.25, knn_agreement=2))


add("h10_vendor_and_neighbours", TWO_STAGES + "SELECT id, category_id, stage FROM final")(lambda s, d: two_stages(s, d).select("id", "category_id", "stage"))
add("e34_two_stage_counts", TWO_STAGES + "SELECT stage, count(*) AS n FROM final GROUP BY 1")(lambda s, d: two_stages(s, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n")))
add("e34_stage_counts", None)(lambda s, d: predictions(s, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n")))


@add("h12_predict_job", None)
def _(spark, d):  # noqa: ANN001, ANN202
    """The model labels that a run adds: each with the next number of the log."""
    tx, labels = written(spark, d), t.labels(spark, d)
    _, log = cascade.predict_job(tx, labels, t.categories(spark, d), t.vectors(spark, d), "2002-01-01", all_stages(), threshold=0.3)
    return log.where("created_at = timestamp '2002-01-01'")


@add("h11_sign_guardrail", """, sc AS (SELECT lab.category_id, count(*) FILTER (cents > 0) AS p, count(*) FILTER (cents < 0) AS n FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' GROUP BY 1), g AS (SELECT category_id, CASE WHEN p >= n THEN 1 ELSE -1 END AS sg FROM sc WHERE greatest(p, n) / (p + n) >= 0.9 AND p + n >= 5)
SELECT tx.id, CASE WHEN sg IS NULL OR sign(cents) = sg THEN latest.category_id END AS category_id FROM tx JOIN latest ON expense_id = id LEFT JOIN g ON g.category_id = latest.category_id""")
def _(spark, d):  # noqa: ANN001, ANN202
    tx, labels = t.transactions(spark, d), t.labels(spark, d)
    p = cascade.prediction(lb.latest_labels(labels).select(F.col("expense_id").alias("id"), "category_id").join(tx.select("id"), "id", "left_semi"), "knn", F.lit(1.0))
    return cascade.sign_guardrail(p, tx, lb.sign_consistency(tx, labels), support=5, least=0.9).select("id", "category_id")


add("h13_pca_projection", None)(lambda s, d: cascade.pca_projection(labelled_vectors(s, d)))

# labelling
LOWEST = "SELECT id FROM st WHERE u = 0 AND ls = 'model' AND (cf IS NULL OR cf < 0.4) ORDER BY coalesce(cf, 0), id LIMIT 50"
add("j2_low_confidence", LOWEST)(lambda s, d: active.select_low_confidence(t.transactions(s, d), t.labels(s, d), 50).select("id"))
add("j1_uncertain", "SELECT id FROM st WHERE ls = 'model' ORDER BY cf, id LIMIT 40")(
    lambda s, d: active.select_uncertain(lb.label_state(t.transactions(s, d), t.labels(s, d)).where("label_source = 'model'").withColumn("runner_up_confidence", F.lit(0.0)), 40).select("id"))
def walk_of(pool: str, name: str, n: int) -> str:
    """The farthest-first walk over (id, v) of ``pool``, as recursive SQL."""
    return f"""{name}_c AS (SELECT list(m ORDER BY k) AS m FROM (SELECT k, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS k FROM {pool}) GROUP BY k)),
{name} AS (
  SELECT 1 AS pos, f.id AS id, [f.id] AS ids, [f.v] AS vs FROM (SELECT arg_max({{'id': id, 'v': v}}, list_distance(v, m)) AS f FROM {pool}, {name}_c) WHERE f IS NOT NULL
  UNION ALL
  SELECT pos + 1, f.id, list_append(ids, f.id), list_append(vs, f.v) FROM (SELECT pos, ids, vs, arg_max({{'id': p.id, 'v': p.v}}, list_min(list_transform(vs, lambda q: list_distance(q, p.v)))) AS f FROM {name}, {pool} p WHERE pos < {n} AND NOT list_contains(ids, p.id) GROUP BY pos, ids, vs))"""


WALK = "WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),\n" + walk_of("v", "walk", 12) + "\n"
add("j3_farthest_first", WALK + "SELECT id, pos FROM walk", prefix=False)(lambda s, d: active.farthest_first(t.vectors(s, d), 12))


STRATIFIED = "WITH RECURSIVE " + t.PREFIX.removeprefix("WITH ") + VEC.rstrip() + f""", few AS (SELECT category_id FROM cat WHERE category_id NOT IN (SELECT category_id FROM lab WHERE source = 'user' GROUP BY 1 HAVING count(*) >= 130)),
best AS (SELECT id FROM near WHERE category_id IN (FROM few) AND neighbour = (SELECT arg_max(n.neighbour, (n.sim, -n.neighbour)) FROM near n WHERE n.id = near.id)),
first_pool AS (SELECT id, v FROM test WHERE id IN (FROM best)), other_pool AS (SELECT id, v FROM test WHERE id NOT IN (FROM best)),
{walk_of("first_pool", "one", 8)},
{walk_of("other_pool", "two", 8)}
SELECT id, pos FROM (SELECT id, pos FROM one UNION ALL SELECT id, 8 + pos FROM two) ORDER BY pos LIMIT 8"""


@add("j4_stratified_diversity", STRATIFIED, prefix=False)
def _(spark, d):  # noqa: ANN001, ANN202
    test, train, truth = split(spark, d)
    return active.select_diverse(test, train, truth, lb.undercovered(t.labels(spark, d), t.categories(spark, d), 130), 8)


add("j5_g4_mixed", f"SELECT id FROM ({LOWEST}) UNION SELECT id FROM (SELECT id FROM st WHERE u = 0 AND m = 0 ORDER BY id LIMIT 20)")(
    lambda s, d: active.in_turn(active.select_low_confidence(t.transactions(s, d), t.labels(s, d), 50), active.numbered(lb.label_state(t.transactions(s, d), t.labels(s, d)).where("has_user = 0 and has_model = 0").orderBy("id").limit(20), "id"), n=70).select("id"))
add("j5_pick_low_confidence", LOWEST)(
    lambda s, d: active.pick_candidates("low-confidence-first", 50, tx=t.transactions(s, d), labels=t.labels(s, d), predictions=lb.label_state(t.transactions(s, d), t.labels(s, d)).where("has_user = 0 and has_model = 0").select("id", F.lit(0.9).alias("confidence"), F.lit(0.1).alias("runner_up_confidence")), rows=t.vectors(s, d), train=t.vectors(s, d), train_labels=t.labels(s, d)).select("id"))
add("j7_review_batch", "SELECT id FROM st WHERE u = 0 AND ls = 'model' AND cf >= 0.4 AND cf < 0.7 ORDER BY cf, id LIMIT 30")(
    lambda s, d: active.review_batch(t.transactions(s, d), t.labels(s, d), active.select_low_confidence(t.transactions(s, d), t.labels(s, d), 30), 30).select("id"))
add("g5_set_difference", "SELECT id FROM tx EXCEPT SELECT expense_id FROM latest WHERE source = 'model' AND confidence > 0.5")(
    lambda s, d: t.transactions(s, d).select("id").subtract(lb.latest_labels(t.labels(s, d)).where("label_source = 'model' and confidence > 0.5").select("expense_id")))


# evaluation: what the latest model label says against the latest user label
REC = """, rec AS (SELECT t.expense_id AS id, t.category_id AS truth, m.category_id AS predicted, CASE WHEN m.confidence >= 0.7 THEN 'knn' WHEN m.confidence IS NOT NULL THEN 'classifier' ELSE 'unknown' END AS stage FROM latest_user t LEFT JOIN (SELECT * FROM lab WHERE source = 'model' QUALIFY row_number() OVER (PARTITION BY expense_id ORDER BY label_id DESC) = 1) m USING (expense_id)),
sup AS (SELECT truth AS category_id, count(*) AS support, count(*) FILTER (truth = predicted) AS hit FROM rec GROUP BY 1), sd AS (SELECT predicted AS category_id, count(*) AS said FROM rec WHERE predicted IS NOT NULL GROUP BY 1),
pc AS (SELECT category_id, CASE WHEN said > 0 THEN coalesce(hit, 0) / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r, 2 * coalesce(hit, 0) / (coalesce(said, 0) + coalesce(support, 0)) AS f, coalesce(support, 0) AS support FROM sup FULL JOIN sd USING (category_id))
"""


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    labels = t.labels(spark, d)
    truth = lb.latest_labels(labels, "user").select(F.col("expense_id").alias("id"), F.col("category_id").alias("truth"))
    said = lb.latest_labels(labels, "model").select(F.col("expense_id").alias("id"), F.col("category_id").alias("predicted"), "confidence")
    return truth.join(said, "id", "left").withColumn("stage", F.when(F.col("confidence") >= 0.7, "knn").when(F.col("confidence").isNotNull(), "classifier").otherwise("unknown"))


add("k3_scores", REC + "SELECT count(*) AS n, round(count(*) FILTER (truth = predicted) / count(*), 6) AS accuracy, round(count(*) FILTER (truth = predicted) / count(predicted), 6) AS covered_accuracy, round(count(predicted) / count(*), 6) AS coverage FROM rec")(lambda s, d: evaluate.scores(evaluated(s, d)))
add("k4_per_category", REC + "SELECT category_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM pc")(lambda s, d: evaluate.per_category(evaluated(s, d)))
add("k4_f1_summary", REC + "SELECT round(avg(f), 6) AS macro_f1, round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM pc")(lambda s, d: evaluate.f1_summary(evaluated(s, d)))
add("k5_confusion", REC + "SELECT truth, predicted, count(*) AS n FROM rec GROUP BY 1, 2")(lambda s, d: evaluate.confusion(evaluated(s, d)))
add("k6_stage_breakdown", REC + "SELECT stage, count(*) AS n_predicted, count(*) FILTER (truth = predicted) AS n_correct, round(count(*) FILTER (truth = predicted) / count(*), 6) AS accuracy FROM rec GROUP BY 1")(lambda s, d: evaluate.stage_breakdown(evaluated(s, d)))
add("d18_misclassified", REC + "SELECT rec.id, date, cents, x.name AS truth_name, y.name AS predicted_name FROM rec JOIN tx USING (id) LEFT JOIN cat x ON x.category_id = truth LEFT JOIN cat y ON y.category_id = predicted WHERE truth IS DISTINCT FROM predicted")(
    lambda s, d: evaluate.misclassified(evaluated(s, d), t.transactions(s, d), t.categories(s, d)).select("id", "date", "cents", "truth_name", "predicted_name"))


def truth_rows(spark: SparkSession, d: str) -> DataFrame:
    return lb.latest_labels(t.labels(spark, d), "user").select(F.col("expense_id").alias("id"), "category_id")


add("k2_fold_sizes", "SELECT f AS fold, count(*) AS test, sum(count(*)) OVER ()::BIGINT - count(*) AS train FROM (SELECT (row_number() OVER (PARTITION BY category_id ORDER BY expense_id) - 1)::INT % 4 AS f FROM latest_user) GROUP BY 1")(lambda s, d: evaluate.fold_sizes(evaluate.stratified_folds(truth_rows(s, d), 4)))


def store(spark: SparkSession, d: str, n_folds: int) -> DataFrame:
    return cascade.stage_store(evaluate.stratified_folds(truth_rows(spark, d), n_folds), written(spark, d), t.labels(spark, d), t.categories(spark, d), t.vectors(spark, d), all_stages(), vendors=t.vendor_cache(spark, d))


add("k1_cross_validate", None)(lambda s, d: evaluate.records(store(s, d, 3), all_stages().enabled))
add("k7_ablation", None)(lambda s, d: evaluate.ablation(store(s, d, 2), all_stages().enabled))


@add("j6_label_batch_impact", None)
def _(spark, d):  # noqa: ANN001, ANN202
    """What the labels of the later half of the orders add."""
    folds, tx = evaluate.stratified_folds(truth_rows(spark, d), 2), written(spark, d)
    batch = tx.where("date >= '1998-01-01'").select("id")
    return evaluate.cascade_batch_impact(folds, batch, tx, t.labels(spark, d), t.categories(spark, d), t.vectors(spark, d), all_stages())


add("j6_batch_impact", REC + """, f1 AS (SELECT avg(f) AS f FROM pc), rec2 AS (SELECT * FROM rec WHERE stage <> 'unknown'),
f2 AS (SELECT avg(f) AS f FROM (SELECT 2 * count(*) FILTER (truth = c AND predicted = c) / (count(*) FILTER (truth = c) + count(*) FILTER (predicted = c)) AS f FROM rec2, (SELECT truth AS c FROM rec2 UNION SELECT predicted FROM rec2) GROUP BY c))
SELECT round(a, 6) AS before, round(b, 6) AS after, round(b - a, 6) AS delta, round((SELECT f FROM f1), 6) AS before_macro_f1, round((SELECT f FROM f2), 6) AS after_macro_f1
FROM (SELECT count(*) FILTER (truth = predicted) / count(*) AS a, (SELECT count(*) FILTER (truth = predicted) / count(*) FROM rec2) AS b FROM rec)""")(lambda s, d: evaluate.batch_impact(evaluated(s, d), evaluated(s, d).where("stage <> 'unknown'")))


# streams over the events table, run to their end: what the watermark, two days behind the last event, has passed
def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(t.read(spark, d, "events").schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@add("s1_continuous_ingest", "SELECT DISTINCT sha256(concat(event_id, '|', user_id)) AS dedup_hash FROM events")
def _(spark, d):  # noqa: ANN001, ANN202
    rows = event_stream(spark, d).select(F.sha2(F.concat_ws("|", "event_id", "user_id"), 256).alias("dedup_hash"))
    store = scratch_path(spark, "store")
    some = rows.where("dedup_hash < '8'")
    for part in (some, rows, rows):  # each run has a new checkpoint: the second adds what the first left out, the third nothing
        streams.continuous_ingest(part, store, scratch_path(spark, "ingest-checkpoint")).awaitTermination()
    return spark.read.parquet(store).select("dedup_hash")


@add("s1_ingest_exports", "SELECT id, date, cents, CASE WHEN iban LIKE 'FR%' THEN 'FR' || substr(iban, 3) ELSE iban END AS iban, is_income, CASE WHEN counterparty = '' AND id // 1000 % 2 = 0 THEN payer ELSE replace(counterparty, '  ', ' ') END AS counterparty FROM raw JOIN (SELECT id, is_income FROM tx) USING (id)")
def _(spark, d):  # noqa: ANN001, ANN202
    """Every export arrives twice under different names, a third of the files a trigger: each row is stored once."""
    path, landing = scratch_path(spark, "exports"), streams.Landing(scratch_path(spark, "landing"))
    for name in ("one", "two"):
        write_bank_files(spark, d, f"{path}/{name}")
        streams.ingest_exports(spark, path, landing, t.own_ibans(spark, d), files_per_trigger=max(1, t.read(spark, d, "orders").count() * 4 // FILE_IDS // 3))
    return spark.read.parquet(landing.store).select(F.regexp_extract("memo", r"#(\d+)$", 1).cast("long").alias("id"), "date", "cents", "iban", "is_income", "counterparty")


PASSED = ", last AS (SELECT epoch_ms(max(ts)) - 2 * 86400000 AS ms FROM events)\n"
for unit in ("day", "week"):
    add(f"s2_spend_by_{unit}" if unit != "day" else "s2_running_spend", PASSED + f"SELECT date_trunc('{unit}', ts)::TIMESTAMP AS start, event_type, sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(*) AS n FROM events, last GROUP BY 1, 2 HAVING epoch_ms(date_trunc('{unit}', any_value(ts))::TIMESTAMP + INTERVAL 1 {unit}) <= any_value(last.ms)")(
        lambda s, d, unit=unit: streams.finish(streams.running_spend(event_stream(s, d), unit), s, "spend").withColumn("start", F.col("start").cast("timestamp_ntz")))


@add("s2_spend_by_month", """, last AS (SELECT max(o_orderdate::TIMESTAMP) - INTERVAL 2 DAY AS t FROM orders)
SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS start, o_orderstatus AS event_type, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, count(*) AS n FROM orders, last GROUP BY 1, 2 HAVING date_trunc('month', any_value(o_orderdate))::TIMESTAMP + INTERVAL 1 MONTH <= any_value(last.t)""")
def _(spark, d):  # noqa: ANN001, ANN202
    """The orders as a stream: they reach over years."""
    o = spark.readStream.schema(t.read(spark, d, "orders").schema).parquet(f"{d}/orders*.parquet")
    rows = o.select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderstatus").alias("event_type"), F.col("o_totalprice").alias("value"))
    return streams.finish(streams.running_spend(rows, "month"), spark, "spend").withColumn("start", F.col("start").cast("timestamp_ntz"))


add("s3_vendor_anomalies", PASSED.strip() + """, e AS (SELECT event_id, user_id, value, count(*) OVER w AS n, avg(value) OVER w AS m, avg(value * value) OVER w AS q FROM events, last WHERE epoch_ms(ts) < last.ms WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, value, round((value - m) / sqrt(q - m * m), 6) AS zscore FROM e WHERE n >= 5 AND q - m * m > 0 AND (value - m) / sqrt(q - m * m) > 3""")(
    lambda s, d: streams.finish(streams.vendor_anomalies(event_stream(s, d)), s, "anomalies").withColumn("zscore", F.round("zscore", 6)))
