"""The library's tables, derived by Spark from the given ones; :data:`PREFIX` is the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions import amounts, iban, text

SHOPS = ("Bäckerei", "Müller", "REWE Markt", "Stadtwerke", "Netflix", "Apotheke", "Bahn", "Versicherung", "Telekom", "Hotel Süd")
SHOP_KEYS = ("baeckerei", "mueller", "rewe markt", "stadtwerke", "netflix", "apotheke", "bahn", "versicherung", "telekom", "hotel sued")
DESCRIPTIONS = ("Lebensmittel und Haushalt", "Strom und Wasser", "Reisen, Hotel und Bahn", "Apotheke und Arzt", "")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a bank would export them: names with legal forms and numbers, grouped IBANs, memos."""
    o = read(spark, sf_dir, "orders")
    key, vendor = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 5)
    shop = F.element_at(F.array(*[F.lit(s) for s in SHOPS]), (vendor % 10 + 1).cast("int"))
    suffix = F.element_at(F.array(F.lit(""), F.lit(" GmbH"), F.lit(" GmbH & Co. KG 1234567")), (key % 3 + 1).cast("int"))
    name = F.when(key % 97 == 0, "").otherwise(F.concat(shop, F.lit("  V"), vendor.cast("string"), suffix))
    cents = F.round(F.col("o_totalprice") * 100).cast("long") * F.when(F.col("o_orderstatus") == "P", 1).otherwise(-1)
    account = F.lpad(F.col("o_custkey").cast("string"), 18, "0")
    check = F.lit(98) - F.concat(account, F.lit("131400")).cast("decimal(38,0)") % 97
    number = F.concat(F.lit("DE"), F.lpad(check.cast("int").cast("string"), 2, "0"), account)
    number = F.when(key % 11 == 0, F.concat(F.lit("fr00 "), account)).when(key % 13 == 0, F.lit("")).otherwise(number)
    memo = F.when(key % 5 == 0, F.concat(F.lit("PP.1234 . Ihr Einkauf bei "), shop, F.lit(" 24"))).otherwise(F.concat(F.lit("Rechnung  "), key.cast("string"), F.lit(" vom "), F.col("o_orderpriority")))
    payer = F.when(key % 5 == 0, "PayPal Europe").otherwise("")
    day = F.to_date("o_orderdate")
    return o.select(key.alias("id"), day.alias("date"), name.alias("payee"), payer.alias("payer"), memo.alias("memo"), number.alias("iban"), cents.alias("cents"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("custkey"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = raw_transactions(spark, sf_dir)
    own = own_ibans(spark, sf_dir).withColumn("iban_is_known_self", F.lit(1))
    number = iban.clean(F.col("iban"))
    party = text.counterparty_of(F.col("payee"), F.lit(""))
    t = t.withColumns({"counterparty": party, "vendor": text.normalize_counterparty(party), "iban": number, "is_income": amounts.is_income(F.col("cents")), "imported_at": F.to_timestamp(F.col("date"))})
    return t.join(own.select("iban", "iban_is_known_self"), "iban", "left").select("id", "date", "counterparty", "vendor", "payee", "payer", "memo", "iban", "cents", "kind", "is_income", "iban_is_known_self", "imported_at")


def own_ibans(spark: SparkSession, sf_dir: str, nation: int = 0) -> DataFrame:
    c = read(spark, sf_dir, "customer").where(F.col("c_nationkey") == nation)
    account = F.lpad(F.col("c_custkey").cast("string"), 18, "0")
    check = F.lit(98) - F.concat(account, F.lit("131400")).cast("decimal(38,0)") % 97
    return c.select(F.concat(F.lit("DE"), F.lpad(check.cast("int").cast("string"), 2, "0"), account).alias("iban"), F.col("c_name").alias("label"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")
    label_id = ((day * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    user = F.col("l_returnflag") == "R"
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        label_id.alias("label_id"), F.col("l_orderkey").alias("expense_id"), F.col("s_nationkey").alias("category_id"), F.when(user, "user").otherwise("model").alias("source"),
        F.when(~user, F.round(F.col("l_discount") * 10, 1)).alias("confidence"), F.to_timestamp(F.to_date("l_shipdate")).alias("created_at"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    about = F.element_at(F.array(*[F.lit(d) for d in DESCRIPTIONS]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return n.select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("name"), about.alias("description"), F.concat(F.lit("#"), F.lpad(F.hex(F.col("n_nationkey") * 9973), 6, "0")).alias("color"), (F.col("n_regionkey") == 0).cast("int").alias("is_savings"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_id % 10 = 0").groupBy((F.col("event_id") * 4).alias("expense_id")).agg(F.max("event_type").alias("text"), F.to_timestamp(F.to_date(F.max("ts"))).alias("updated_at"))


def secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a second source: every seventh transaction, its date up to four days off."""
    o = read(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    return o.select(
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 9 - 4).cast("int")).alias("txn_date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.concat(F.lit("Shop "), (F.col("o_orderkey") % 10).cast("string")).alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("a@example.com")).otherwise("").alias("email"), F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("ref"),
    )


def vendor_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known vendors: those whose number is divisible by three."""
    o = read(spark, sf_dir, "orders")
    v = o.select(F.floor(F.col("o_custkey") / 5).alias("v")).distinct().where("v % 3 = 0")
    shop = F.element_at(F.array(*[F.lit(s) for s in SHOP_KEYS]), (F.col("v") % 10 + 1).cast("int"))
    industry = F.element_at(F.array(*[F.lit(x) for x in ("supermarket", "Reisen", "other", "telco")]), (F.col("v") % 4 + 1).cast("int"))
    return v.select(F.concat(shop, F.lit(" v"), F.col("v").cast("string")).alias("vendor"), industry.alias("industry"), F.concat(F.lit("About "), shop).alias("summary"), F.date_add(F.lit("2001-01-01").cast("date"), (F.col("v") % 400).cast("int")).alias("fetched_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.lit("given").alias("model"), F.size("embedding").alias("dim"), F.col("embedding").alias("vector"), F.col("label").alias("category_id"))


_IBAN = "'DE' || lpad((98 - (lpad({k}::VARCHAR, 18, '0') || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || lpad({k}::VARCHAR, 18, '0')"
_LIST = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"

PREFIX = f"""WITH own AS (SELECT {_IBAN.format(k="c_custkey")} AS iban, c_name AS label FROM customer WHERE c_nationkey = 0),
raw AS (SELECT o_orderkey AS id, o_orderdate::DATE AS date,
  CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE {_LIST(SHOPS)}[(o_custkey // 5) % 10 + 1] || '  V' || (o_custkey // 5) || ['', ' GmbH', ' GmbH & Co. KG 1234567'][o_orderkey % 3 + 1] END AS counterparty,
  CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE {_LIST(SHOP_KEYS)}[(o_custkey // 5) % 10 + 1] || ' v' || (o_custkey // 5) END AS vendor,
  CASE WHEN o_orderkey % 5 = 0 THEN 'PayPal Europe' ELSE '' END AS payer,
  CASE WHEN o_orderkey % 5 = 0 THEN 'PP.1234 . Ihr Einkauf bei ' || {_LIST(SHOPS)}[(o_custkey // 5) % 10 + 1] || ' 24' ELSE 'Rechnung  ' || o_orderkey || ' vom ' || o_orderpriority END AS memo,
  CASE WHEN o_orderkey % 11 = 0 THEN 'FR00' || lpad(o_custkey::VARCHAR, 18, '0') WHEN o_orderkey % 13 = 0 THEN '' ELSE {_IBAN.format(k="o_custkey")} END AS iban,
  (round(o_totalprice * 100)::BIGINT * CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END)::BIGINT AS cents, o_orderpriority AS kind FROM orders),
tx AS (SELECT raw.*, (cents > 0)::INT AS is_income, CASE WHEN own.iban IS NOT NULL THEN 1 END AS self, abs(cents) AS a FROM raw LEFT JOIN own ON own.iban = raw.iban),
lab AS (SELECT (((l_shipdate::DATE - DATE '1970-01-01')::BIGINT * 1000000 + l_partkey) * 100000 + l_suppkey) * 10 + l_linenumber AS label_id, l_orderkey AS expense_id, s_nationkey AS category_id,
  CASE WHEN l_returnflag = 'R' THEN 'user' ELSE 'model' END AS source, CASE WHEN l_returnflag <> 'R' THEN round(l_discount * 10, 1) END AS confidence, l_shipdate::DATE AS created FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
cat AS (SELECT n_nationkey AS category_id, n_name AS name, {_LIST(DESCRIPTIONS)}[n_nationkey % 5 + 1] AS description, '#' || lpad(printf('%X', n_nationkey * 9973), 6, '0') AS color, (n_regionkey = 0)::INT AS is_savings FROM nation),
latest AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY expense_id ORDER BY label_id DESC) = 1),
latest_user AS (SELECT * FROM lab WHERE source = 'user' QUALIFY row_number() OVER (PARTITION BY expense_id ORDER BY label_id DESC) = 1),
s AS (SELECT tx.*, l.category_id, l.source AS label_source, l.confidence, cat.name AS category, cat.color, cat.is_savings, cat.category_id AS known FROM tx LEFT JOIN latest l ON l.expense_id = tx.id LEFT JOIN cat ON cat.category_id = l.category_id),
st AS (SELECT tx.id, tx.date, coalesce(max((lab.source = 'user')::INT), 0) AS u, coalesce(max((lab.source = 'model')::INT), 0) AS m, any_value(s.label_source) AS ls, any_value(s.confidence) AS cf FROM tx LEFT JOIN lab ON lab.expense_id = tx.id JOIN s ON s.id = tx.id GROUP BY 1, 2)
"""
