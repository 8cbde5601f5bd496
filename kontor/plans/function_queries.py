"""Queries and SQL of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions import amounts, dates, iban, text, vectors
from kontor.plans import tables as t
from kontor.plans.report_queries import add
from kontor.plans.tables import SHOP_KEYS


def raw(spark, d):  # noqa: ANN001, ANN201
    return t.raw_transactions(spark, d)


add("b1_collapse_spaces", "SELECT id, regexp_replace(memo, '\\s+', ' ', 'g') AS memo FROM tx")(lambda s, d: raw(s, d).select("id", text.collapse_spaces(F.col("memo")).alias("memo")))
add("b2_iban_clean", "SELECT id, iban FROM tx")(lambda s, d: raw(s, d).select("id", iban.clean(F.col("iban")).alias("iban")))
add("b3_b7_normalize_counterparty", "SELECT id, counterparty, vendor FROM tx")(lambda s, d: t.transactions(s, d).select("id", "counterparty", "vendor"))
MEMO = """, folded AS (SELECT doc_id AS id, replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss') AS x FROM documents),
nolink AS (SELECT id, regexp_replace(x, 'https?://\\S+', ' ', 'g') AS x FROM folded),
noiban AS (SELECT id, {twice_iban} AS x FROM nolink),
nosepa AS (SELECT id, regexp_replace(x, '(?i)\\bSEPA[-\\s]?(?:LASTSCHRIFT|UEBERWEISUNG)\\b', ' ', 'g') AS x FROM noiban),
nodigits AS (SELECT id, lower({twice_digits}) AS x FROM nosepa)
SELECT id, trim(regexp_replace(regexp_replace(x, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS memo FROM nodigits"""
# RE2 has no Unicode word boundary: what stands around is matched, and twice, as neighbours share it
OUTSIDE = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"
ONCE = lambda x, inner: f"regexp_replace({x}, '{OUTSIDE[0]}{inner}{OUTSIDE[1]}', '\\1 \\2', 'g')"
TWICE = lambda inner: ONCE(ONCE("x", inner), inner)
MEMO = MEMO.format(twice_iban=TWICE("[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}"), twice_digits=TWICE("[0-9]{6,}"))
add("b4_normalize_memo", MEMO)(
    lambda s, d: t.read(s, d, "documents").select(F.col("doc_id").alias("id"), text.normalize_memo(F.col("text")).alias("memo")))
NAME_OF = "coalesce(source, '') || ' GmbH & Co. KG, PayPal 1234567 ' || coalesce(text, '')"
add("b3_names_of_documents", f""", f AS (SELECT doc_id AS id, lower(replace(replace(replace(replace(replace(replace(replace({NAME_OF}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss')) AS x FROM documents),
p AS (SELECT id, regexp_replace(x, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g') AS x FROM f), g AS (SELECT id, {TWICE("[0-9]{6,}")} AS x FROM p), h AS (SELECT id, {TWICE("(?:visa|mastercard|maestro|paypal|klarna|sofort|sumup|adyen|stripe)")} AS x FROM g)
SELECT id, array_to_string(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w NOT IN ('', 'gmbh', 'ag', 'kg', 'ohg', 'ug', 'se', 'co', 'ltd', 'limited', 'inc', 'bv', 'sa', 'mbh', 'kgaa', 'ev')), ' ') AS vendor FROM h""")(
    lambda s, d: t.read(s, d, "documents").select(F.col("doc_id").alias("id"), text.normalize_counterparty(F.concat(F.coalesce("source", F.lit("")), F.lit(" GmbH & Co. KG, PayPal 1234567 "), F.coalesce("text", F.lit("")))).alias("vendor")))
add("b5_combined_text", "SELECT id, concat_ws(' | ', nullif(vendor, ''), kind) AS combined FROM tx")(lambda s, d: t.transactions(s, d).select("id", text.combined_text(F.col("vendor"), F.col("kind")).alias("combined")))
add("b6_simplify_paypal_memo", "SELECT id, CASE WHEN payer <> '' THEN trim(split_part(memo, 'Ihr Einkauf bei ', 2)) ELSE memo END AS memo FROM tx")(lambda s, d: raw(s, d).select("id", text.simplify_paypal_memo(F.col("memo"), F.col("payer"), F.col("payee")).alias("memo")))
add("b8_b11_amounts", """SELECT id, is_income, (cents <> 0 AND a % 500 = 0)::INT AS is_round, CASE WHEN a < 1000 THEN '<10' WHEN a < 5000 THEN '10-50' WHEN a < 20000 THEN '50-200' WHEN a < 100000 THEN '200-1000' ELSE '>1000' END AS bucket, round(ln(1 + a / 100.0), 6) AS log_abs FROM tx""")(
    lambda s, d: raw(s, d).select("id", amounts.is_income(F.col("cents")).alias("is_income"), amounts.is_round(F.col("cents")).alias("is_round"), amounts.bucket(F.col("cents")).alias("bucket"), amounts.log_abs(F.col("cents")).alias("log_abs")))
add("b12_calendar", """SELECT id, year(date)::INT AS year, month(date)::INT AS month, quarter(date)::INT AS quarter, weekofyear(date)::INT AS week, day(date)::INT AS day_of_month, (isodow(date) - 1)::INT AS day_of_week, (isodow(date) >= 6)::INT AS is_weekend, (day(date) >= 25)::INT AS is_month_end FROM tx""")(
    lambda s, d: raw(s, d).select("id", *[c.alias(k) for k, c in dates.calendar_features(F.col("date")).items()]))
add("b13_b15_date_keys", "SELECT id, strftime(date, '%Y-%m') AS ym, strftime(date, '%Y-W%W') AS yw, (date - DATE '1998-01-01')::INT AS days FROM tx")(
    lambda s, d: raw(s, d).select("id", dates.month_key(F.col("date")).alias("ym"), dates.week_key(F.col("date")).alias("yw"), F.datediff("date", F.lit("1998-01-01").cast("date")).alias("days")))
add("b16_b17_classify_iban", """SELECT id, CASE WHEN iban <> '' THEN iban[1:2] END AS iban_country, CASE WHEN iban LIKE 'DE%' THEN iban[5:12] END AS iban_blz, (iban LIKE 'DE%')::INT AS iban_is_valid, CASE WHEN iban <> '' THEN (iban NOT LIKE 'DE%')::INT END AS iban_is_foreign FROM tx""")(
    lambda s, d: raw(s, d).select("id", *[c.alias(k) for k, c in iban.classify(F.col("iban")).items()]))
# numbers of four countries and one that does not exist, every second with its right check digits
COUNTRIES = (("DE", 18, "1314", ""), ("AT", 16, "1029", ""), ("CH", 17, "1217", ""), ("NL", 10, "2321", "ABNA"), ("XX", 18, "3333", ""))
NUMBERS = f"""SELECT *, CASE WHEN k % 2 = 0 THEN lpad((98 - (spelt || '00')::HUGEINT % 97)::VARCHAR, 2, '0') ELSE lpad((k * 31 % 97 + 2)::VARCHAR, 2, '0') END AS digits FROM (
SELECT c_custkey AS k, {[c[0] for c in COUNTRIES]}[c_custkey % 5 + 1] AS country, {[c[3] for c in COUNTRIES]}[c_custkey % 5 + 1] AS bank, lpad((c_custkey * 7919)::VARCHAR, {[c[1] for c in COUNTRIES]}[c_custkey % 5 + 1], '0') AS account,
CASE WHEN c_custkey % 5 = 3 THEN '10112310' ELSE '' END || account || {[c[2] for c in COUNTRIES]}[c_custkey % 5 + 1] AS spelt FROM customer)"""
add("b16_check_digits", f""", n AS ({NUMBERS}) SELECT k AS id, country AS iban_country, (country <> 'XX' AND (spelt || digits)::HUGEINT % 97 = 1)::INT AS iban_is_valid, CASE WHEN country = 'DE' AND (spelt || digits)::HUGEINT % 97 = 1 THEN account[1:8] END AS iban_blz, (country <> 'DE')::INT AS iban_is_foreign FROM n""")(
    lambda s, d: numbers(s, d).select("id", *[c.alias(k) for k, c in iban.classify(F.col("iban")).items()]))


def numbers(spark, d):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in COUNTRIES]), (k % 5 + 1).cast("int"))
    account = F.lpad((k * 7919).cast("string"), pick(1), F.lit("0"))
    spelt = F.concat(F.when(k % 5 == 3, "10112310").otherwise(""), account, pick(2))
    right = F.lpad((F.lit(98) - F.concat(spelt, F.lit("00")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")
    digits = F.when(k % 2 == 0, right).otherwise(F.lpad((k * 31 % 97 + 2).cast("string"), 2, "0"))
    return t.read(spark, d, "customer").select(k.alias("id"), F.lower(F.concat(pick(0), digits, F.lit(" "), pick(3), account)).alias("iban"))


add("b18_secondary_memo", "SELECT 'R' || o_orderkey AS ref, 'Shop ' || (o_orderkey % 10) || CASE WHEN o_orderkey % 2 = 0 THEN ' (a@example.com)' ELSE '' END AS memo FROM orders WHERE o_orderkey % 7 = 0")(
    lambda s, d: t.secondary(s, d).select("ref", text.secondary_memo(F.col("name"), F.col("email")).alias("memo")))
TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 4))"
def token_overlap(tx: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, category_id, bonus) of every row with every category: words are taken from a row and from a category once, before they meet."""
    a = tx.select("id", text.long_tokens(F.concat_ws(" ", "memo", "v", F.lit("reisen strom"))).alias("a"))
    b = categories.select("category_id", text.long_tokens(F.concat_ws(" ", "name", "description")).alias("b"))
    return a.crossJoin(F.broadcast(b)).select("id", "category_id", text.overlap_bonus(F.col("a"), F.col("b")).alias("bonus"))  # the category dimension


add("b19_b20_token_overlap", f"""SELECT tx.id, cat.category_id, round(least(0.15::DOUBLE, 0.05::DOUBLE * len(list_intersect({TOKENS.format(x="memo || ' ' || vendor || ' reisen strom'")}, {TOKENS.format(x="name || ' ' || description")}))), 6) AS bonus FROM tx, cat""")(
    lambda s, d: token_overlap(raw(s, d).withColumn("v", text.normalize_counterparty(F.col("payee"))), t.categories(s, d)))


def other_name():  # noqa: ANN201
    """The vendor (words, then v and a number) within a longer name, with w for its v, or with vx for its last word."""
    v = F.col("vendor")
    return F.when(F.col("id") % 3 == 0, F.concat(F.lit("filiale "), v, F.lit(" "))).when(F.col("id") % 3 == 1, F.regexp_replace(v, " v([0-9]+)$", " w$1")).otherwise(F.regexp_replace(v, " v[0-9]+$", " vx"))


INDUSTRY = "['Sonstige', 'Sonstige', 'Supermarkt', 'Versorgung', 'Streaming', 'Gesundheit', 'Verkehr', 'Versicherung', 'Telekommunikation', 'Reisen']"
add("b21_heuristic_industry", f"""SELECT id, CASE WHEN vendor = '' THEN 'Sonstige' ELSE {INDUSTRY}[list_position({list(SHOP_KEYS)}, regexp_replace(vendor, ' v[0-9]+$', ''))] END AS industry FROM tx""")(
    lambda s, d: t.transactions(s, d).select("id", text.heuristic_industry(F.col("vendor")).alias("industry")))
BY_WORDS = " ".join("WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + f" THEN '{label}'" for label, words in text.INDUSTRIES)
add("b21_industry_of_documents", f"""SELECT id, CASE {BY_WORDS} ELSE 'Sonstige' END AS industry FROM (SELECT doc_id AS id, lower(coalesce(source, '') || ' ' || coalesce(text, '')) AS x FROM documents)""")(
    lambda s, d: t.read(s, d, "documents").select(F.col("doc_id").alias("id"), text.heuristic_industry(F.col("source"), F.col("text")).alias("industry")))
add("b22_translate_industry", """SELECT DISTINCT o_custkey // 5 AS v, ['Supermarkt', 'Reisen', 'Sonstige', 'Telekommunikation'][o_custkey // 5 % 4 + 1] AS industry, o_custkey // 5 % 4 <> 2 AS meaningful FROM orders WHERE o_custkey // 5 % 3 = 0""")(
    lambda s, d: t.vendor_cache(s, d).select(F.substring_index("vendor", " v", -1).cast("long").alias("v"), text.translate_industry(F.col("industry")).alias("industry"), text.is_meaningful_industry(text.translate_industry(F.col("industry"))).alias("meaningful")))
add("b23_premise", """SELECT doc_id AS id, 'rechnung. Branche: ' || source || '. ' || CASE WHEN length(x) > 60 THEN regexp_replace(CASE WHEN contains(c, ' ') AND length(c) - position(' ' IN reverse(c)) > 36 THEN c[:length(c) - position(' ' IN reverse(c))] ELSE c END, '[ ,.;:]+$', '') || '…' ELSE x END AS premise
FROM (SELECT *, x[:60] AS c FROM (SELECT *, trim(text, ' ') AS x FROM documents)) WHERE x <> ''""")(
    lambda s, d: t.read(s, d, "documents").where(F.trim("text") != "").select(F.col("doc_id").alias("id"), text.premise(F.lit("rechnung"), F.col("source"), F.col("text"), 60).alias("premise")))
add("b24_cosine", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")(
    lambda s, d: t.vectors(s, d).select(F.col("id").alias("a"), "vector").join(t.vectors(s, d).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("vector").alias("w")), "a").select("a", "b", vectors.cosine(F.col("vector"), F.col("w")).alias("cosine")))
add("b25_hash_embedding", """SELECT id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM (SELECT id, i::INT AS i, (('0x' || h[(i % 32) * 2 + 1:(i % 32) * 2 + 2])::INT - 127.5)::DOUBLE AS x FROM (SELECT p_partkey AS id, sha256(p_name) AS h, unnest(range(64)) AS i FROM part))""")(
    lambda s, d: t.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(vectors.hash_embedding(F.col("p_name"), 64)).alias("i", "x")))
add("b26_cadence", """SELECT id, cadence FROM (SELECT id, cadence, row_number() OVER (PARTITION BY id ORDER BY abs(ln(gap / days)), o) AS r FROM (SELECT o_orderkey AS id, (o_orderkey % 500)::DOUBLE AS gap FROM orders WHERE o_orderkey % 500 > 0), (VALUES ('weekly', 7.0::DOUBLE, 1), ('bi-weekly', 14.0::DOUBLE, 2), ('monthly', 30.4::DOUBLE, 3), ('quarterly', 91.3::DOUBLE, 4), ('semi-annual', 182.6::DOUBLE, 5), ('annual', 365.25::DOUBLE, 6)) b(cadence, days, o)) WHERE r = 1""")(
    lambda s, d: raw(s, d).withColumn("k", dates.cadence((F.col("id") % 500).cast("double"))).where("k is not null").select("id", F.col("k.label").alias("cadence")))
add("b32_token_set_ratio", """SELECT id, round(CASE WHEN vendor = '' THEN 0.0::DOUBLE WHEN id % 3 = 0 THEN 100.0::DOUBLE WHEN id % 3 = 1 THEN 100.0::DOUBLE * (n - 1) / n
ELSE greatest(200.0::DOUBLE * b / (b + n), 200.0::DOUBLE * b / (2 * b + 3), 200.0::DOUBLE * (b + 2) / (n + b + 3)) END, 6) AS score FROM (SELECT *, length(vendor) AS n, length(regexp_replace(vendor, ' v[0-9]+$', '')) AS b FROM tx)""")(
    lambda s, d: t.transactions(s, d).select("id", F.round(F.when(F.col("vendor") == "", 0.0).otherwise(text.token_set_ratio(F.col("vendor"), other_name())), 6).alias("score")))
add("a4_a5_german_cells", """SELECT id, a AS cents, date FROM tx""")(
    lambda s, d: raw(s, d).select("id", amounts.to_cents(amounts.parse_german_amount(F.concat(F.regexp_replace(F.format_number(F.floor(F.abs("cents") / 100), 0), ",", "."), F.lit(","), F.lpad((F.abs("cents") % 100).cast("string"), 2, "0"), F.lit(" €")))).alias("cents"), dates.parse_german_date(F.date_format("date", "d.M.yy")).alias("date")))
