"""Table-to-table jobs: what changes rows reads a snapshot and gives the next one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from kontor.functions import amounts, iban, text
from kontor.operators.matching import match_secondary
from kontor.scratch import scratch_table

TEXT_COLUMNS = ("payee", "payer", "memo", "kind")
HASH_PREFIX = 120


def derive(rows: DataFrame, own: DataFrame) -> DataFrame:
    """All columns that follow from a parsed row (date, payee, payer, memo, iban, cents): names, texts, flags, account."""
    if "dedup_hash" not in rows.columns:
        rows = with_dedup_hash(rows)
    number, party = iban.clean(F.col("iban")), text.counterparty_of(F.col("payee"), F.col("payer"))
    memo = text.simplify_paypal_memo(F.col("memo"), F.col("payer"), F.col("payee"))
    out = rows.withColumns({"iban": number, "counterparty": party, "vendor": text.normalize_counterparty(party), "memo": memo, "memo_normalized": text.normalize_memo(memo)})
    out = out.withColumns({
        "combined": text.combined_text(F.col("vendor"), F.col("memo_normalized")), "is_income": amounts.is_income(F.col("cents")), "is_round": amounts.is_round(F.col("cents")),
        "bucket": amounts.bucket(F.col("cents")), **{k: v for k, v in iban.classify(F.col("iban")).items()},
    })
    return out.join(own.select(F.col("iban"), F.lit(1).alias("self")).distinct(), "iban", "left").withColumn("iban_is_known_self", F.coalesce("self", F.lit(0))).drop("self")


def with_dedup_hash(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``dedup_hash``: SHA-256 over dates, cents, account, vendor and the beginning of the original memo; nulls count as empty."""
    parts = [F.col("date").cast("string"), F.col("value_date").cast("string"), F.col("cents").cast("string"), iban.clean(F.col("iban")), text.normalize_counterparty(text.counterparty_of(F.col("payee"), F.col("payer"))), F.substring(text.normalize_memo(F.col("memo")), 1, HASH_PREFIX)]
    return rows.withColumn("dedup_hash", F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256))


def ingest(rows: DataFrame, store: DataFrame | None, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows of ``rows`` (also: source_file and source_row, which name a row), each content once and none that ``store`` (dedup_hash) has, and a report: parsed, new, duplicate.

    The hash is computed once for every row and written with its name alone; which rows are new, and the report, follow from that, and all other columns for the new rows only.
    """
    name = ("source_file", "source_row")
    hashed = scratch_table(with_dedup_hash(rows).select(*name, "dedup_hash"), "ingest-hashes")
    first = hashed.groupBy("dedup_hash").agg(F.min(F.struct(*name)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    known = first.withColumn("_known", F.lit(None).cast("boolean")) if store is None else first.join(store.select("dedup_hash", F.lit(True).alias("_known")).distinct(), "dedup_hash", "left")
    known = scratch_table(known, "ingest-contents")
    counts = known.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("parsed"), F.count(F.when(F.col("_known").isNull(), 1)).alias("new"))
    new = rows.join(known.where("_known is null").select("_first.*", "dedup_hash"), list(name))
    return derive(new, own), counts.withColumn("duplicate", F.col("parsed") - F.col("new"))


def missing_embeddings(rows: DataFrame, embeddings: DataFrame, model: str, embed: Column) -> DataFrame:
    """(id, model, dim, vector) of the rows that have no vector of ``model`` yet."""
    return rows.join(embeddings.where(F.col("model") == model).select("id"), "id", "left_anti").select("id", F.lit(model).alias("model"), embed.alias("vector")).withColumn("dim", F.size("vector"))


def embed_rows(rows: DataFrame, model: str, encode: Callable[[], Callable[[np.ndarray], np.ndarray]], *, column: str = "combined", batch_size: int = 256) -> DataFrame:
    """(id, model, dim, vector) of ``rows`` by a user's encoder: ``encode`` gives, once a worker, a function from a batch of texts to their vectors."""
    vector = predict_batch_udf(encode, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return rows.select("id", F.lit(model).alias("model"), vector(text.or_empty(F.col(column))).alias("vector")).withColumn("dim", F.size("vector"))


def embed_again(embeddings: DataFrame, changed: DataFrame, model: str, encode: Callable[[], Callable[[np.ndarray], np.ndarray]], *, column: str = "combined") -> DataFrame:
    """``embeddings`` with the vectors of ``model`` for the rows of ``changed`` (id and text), such as enriched ones, made anew."""
    kept = embeddings.join(changed.select("id", F.lit(model).alias("model")), ["id", "model"], "left_anti").select("id", "model", "dim", "vector")
    return kept.unionByName(embed_rows(changed, model, encode, column=column).select("id", "model", "dim", "vector"))


def load_embeddings(embeddings: DataFrame, model: str, ids: DataFrame | None = None) -> DataFrame:
    """The vectors of ``model`` whose length is the most common one (the smaller on ties)."""
    rows = embeddings.where(F.col("model") == model)
    usual = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    rows = rows.join(F.broadcast(usual.select("d")), F.size("vector") == F.col("d"), "left_semi")
    return rows if ids is None else rows.join(ids.select("id"), "id", "left_semi")


def embedding_inventory(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n"))


def purge_embeddings(embeddings: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """The vectors of ``keep`` alone, and how many went, by model."""
    gone = embeddings.where(~F.col("model").eqNullSafe(keep))
    return embeddings.where(F.col("model") == keep), gone.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, position, column, type, n_rows, n_nulls, about_distinct) of every column; one aggregate per table."""
    out = None
    for name, df in tables.items():
        cols = [c for c, k in df.dtypes]
        stats = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (F.count(F.col(c)).alias(f"c{i}"), F.approx_count_distinct(F.col(c).cast("string")).alias(f"d{i}"))])
        rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(k).alias("type"), (F.col("n") - F.col(f"c{i}")).alias("n_nulls"), F.col(f"d{i}").alias("about_distinct")) for i, (c, k) in enumerate(df.dtypes)])
        one = stats.select(F.lit(name).alias("table"), F.col("n").alias("n_rows"), F.explode(rows).alias("r")).select("table", "n_rows", "r.*")
        out = one if out is None else out.unionByName(one)
    return out


def export(spine: DataFrame, notes: DataFrame) -> DataFrame:
    return spine.join(notes.select(F.col("expense_id").alias("id"), F.col("text").alias("note")), "id", "left").select("id", "date", "counterparty", "memo", "iban", "cents", F.col("category"), "label_source", "confidence", "note")


def enrich(tx: DataFrame, records: DataFrame, used: DataFrame, source: str, keyword: str, window: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows with a matched record's memo, source and reference, and the matches. ``records``: ref, txn_date, cents, description; ``used``: refs of earlier runs."""
    fresh = records.join(used.select("ref"), "ref", "left_anti")
    theirs = tx.where(F.lower(text.or_empty(F.col("payee"))).contains(keyword) | F.lower(text.or_empty(F.col("payer"))).contains(keyword))
    matches = match_secondary(theirs, fresh, window)
    hit = matches.where("outcome = 'matched'").join(fresh.select("ref", "description"), "ref").select("id", "ref", "description")
    out = tx.join(hit, "id", "left").withColumns({"enrichment_source": F.when(F.col("ref").isNotNull(), source), "enrichment_ref": F.col("ref"), "memo_before": F.col("memo"), "memo": F.coalesce("description", "memo")})
    out = out.withColumn("memo_normalized", text.normalize_memo(F.col("memo"))).withColumn("combined", text.combined_text(F.col("vendor"), F.col("memo_normalized")))
    return out.drop("ref", "description"), matches


def enrich_and_embed(
    tx: DataFrame, records: DataFrame, used: DataFrame, source: str, keyword: str, embeddings: DataFrame, model: str, encode: Callable[[], Callable[[np.ndarray], np.ndarray]], window: int = 5
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """:func:`enrich`, the vectors with those of the enriched rows made anew from their new text, the matches, and one row: candidates, matched, ambiguous, unmatched, skipped (used before), embedded."""
    out, matches = enrich(tx, records, used, source, keyword, window)
    out, matches = scratch_table(out, "enriched"), scratch_table(matches, "enrich-matches")
    changed = out.where("enrichment_ref is not null")
    said = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    one = matches.agg(said("matched"), said("ambiguous"), said("unmatched")).crossJoin(changed.agg(F.count(F.lit(1)).alias("embedded")))
    seen = records.join(used.select("ref").distinct().withColumn("_used", F.lit(True)), "ref", "left").agg(F.count(F.lit(1)).alias("candidates"), F.count("_used").alias("skipped"))
    return out, embed_again(embeddings, changed, model, encode), matches, one.crossJoin(seen)  # one row each


def enrichment_preview(enriched: DataFrame) -> DataFrame:
    return enriched.where("enrichment_ref is not null").select("id", "enrichment_ref", "memo_before", "memo")


def reflag_own(tx: DataFrame, own: DataFrame) -> DataFrame:
    """``tx`` with iban_is_known_self anew from ``own``, and ``changed``."""
    old = F.coalesce("iban_is_known_self", F.lit(0))
    out = tx.join(own.select("iban", F.lit(1).alias("self")).distinct(), "iban", "left").withColumn("_new", F.coalesce("self", F.lit(0)))
    return out.withColumn("changed", (F.col("_new") != old).cast("int")).withColumn("iban_is_known_self", F.col("_new")).drop("self", "_new")


def invalid_ibans(own: DataFrame) -> DataFrame:
    return own.where(~iban.is_valid(iban.clean(F.col("iban"))))


#: Numbers of a log that one task tells apart or puts in order at once.
NUMBERS_PER_TASK = 1_000_000


def append_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """The log with ``new`` (expense_id, category_id, source, confidence, created_at) after it, numbered on in order of expense, category and source.

    The new rows are dealt out by ranges, as many as their number asks for, and numbered within each; only the ranges' sizes are added up in one place.
    """
    order, new = ("expense_id", "category_id", "source"), scratch_table(new, "new-labels")
    dealt = new.repartitionByRange(new.count() // NUMBERS_PER_TASK + 1, *order).sortWithinPartitions(*order)
    dealt = scratch_table(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "ranged-labels")
    last = labels.agg(F.coalesce(F.max("label_id"), F.lit(0)).alias("last"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("k"), F.min("_at").alias("first")).select("_range", (before - F.col("first")).alias("start")).crossJoin(last)
    numbered = dealt.join(F.broadcast(starts), "_range").withColumn("label_id", F.col("last") + F.col("start") + F.col("_at") + 1)
    return labels.unionByName(numbered.select(*labels.columns))


def log_numbers(labels: DataFrame) -> DataFrame:
    """One row: the log's rows ``n``, its distinct numbers ``ids`` and the ``last`` one. Numbers are dealt out before they are told apart, over as many tasks as the log's length asks for, so that what a task holds does not grow with it."""
    numbers = labels.select("label_id")
    dealt = numbers.repartition(numbers.count() // NUMBERS_PER_TASK + 1, "label_id")
    return dealt.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label_id").alias("ids"), F.max("label_id").alias("last"))


def apply_changes(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: expense_id, action (set_user, set_model, clear, promote), category_id, confidence, created_at. Clears drop an expense's labels; promote makes its latest label the user's."""
    kept = labels.join(changes.where("action = 'clear'").select("expense_id"), "expense_id", "left_anti").select(*labels.columns)
    last = labels.groupBy("expense_id").agg(F.max_by("category_id", "label_id").alias("latest"))
    made = changes.where("action <> 'clear'").join(last, "expense_id", "left")
    made = made.select("expense_id", F.when(F.col("action") == "promote", F.col("latest")).otherwise(F.col("category_id")).alias("category_id"), F.when(F.col("action") == "set_model", "model").otherwise("user").alias("source"), F.when(F.col("action") == "set_model", F.col("confidence")).alias("confidence"), "created_at")
    return append_labels(kept, made.where("category_id is not null"))


def delete_category(labels: DataFrame, categories: DataFrame, category_id: int) -> tuple[DataFrame, DataFrame]:
    return labels.where(F.col("category_id") != category_id), categories.where(F.col("category_id") != category_id)


def clear_labels(labels: DataFrame, ids: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """The log without the labels of ``ids`` (expense_id), of ``source``, or of both; of all if neither is given."""
    gone = F.lit(True) if source is None else F.col("source") == source
    if ids is None:
        return labels.where(~gone)
    marked = labels.join(ids.select("expense_id", F.lit(True).alias("_gone")).distinct(), "expense_id", "left")
    return marked.where(~(gone & F.coalesce("_gone", F.lit(False)))).select(*labels.columns)


def collapse_whitespace(tx: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """``tx`` with collapsed white space, and one row: rows_changed, fields_changed."""
    changed = {c: (~text.collapse_spaces(F.col(c)).eqNullSafe(F.col(c))).cast("int") for c in columns}
    n = sum(changed.values(), F.lit(0))
    report = tx.agg(F.count(F.when(n > 0, 1)).alias("rows_changed"), F.coalesce(F.sum(n), F.lit(0)).alias("fields_changed"))
    return tx.withColumns({c: text.collapse_spaces(F.col(c)) for c in columns}), report


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = (), delete: Column | None = None) -> DataFrame:
    """``old`` with ``new``'s rows by ``key``; columns in ``keep`` stay as they were where the key existed; rows of ``new`` with ``delete`` remove theirs."""
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n_"), (delete if delete is not None else F.lit(False)).alias("n_delete"))
    both = old.withColumn("o_", F.lit(True)).join(n, F.col(key) == F.col(f"n_{key}"), "full").where(~F.coalesce("n_delete", F.lit(False)))
    value = lambda c: F.when(F.col("n_").isNull() | (F.lit(c in keep) & F.col("o_").isNotNull()), F.col(c)).otherwise(F.col(f"n_{c}")) if c in new.columns else F.col(c)
    return both.select(*[value(c).alias(c) for c in old.columns])


def simplify_memos(tx: DataFrame) -> DataFrame:
    """Memos of processor payments simplified in place and all that follows from them, the vendor included; ``changed``."""
    memo = text.simplify_paypal_memo(F.col("memo"), F.col("payer"), F.col("payee"))
    out = tx.withColumn("_memo", memo).withColumn("changed", (~F.col("_memo").eqNullSafe(F.col("memo"))).cast("int"))
    out = out.withColumn("vendor", F.when(F.col("changed") == 1, text.normalize_counterparty(F.col("_memo"))).otherwise(F.col("vendor")))
    out = out.withColumn("memo", F.col("_memo")).drop("_memo").withColumn("memo_normalized", text.normalize_memo(F.col("memo")))
    return out.withColumn("combined", text.combined_text(F.col("vendor"), F.col("memo_normalized")))


def vendors_to_look_up(tx: DataFrame, cache: DataFrame, fresh_since: str | None = None) -> DataFrame:
    """Distinct vendors without a cached row, or without one fetched since a day."""
    known = cache if fresh_since is None else cache.where(F.col("fetched_at") >= F.lit(fresh_since).cast("date"))
    return tx.where("vendor <> ''").select("vendor").distinct().join(known.select("vendor"), "vendor", "left_anti")


def vendor_dimension(tx: DataFrame, cache: DataFrame, summaries: DataFrame) -> DataFrame:
    """The cache with a row for each new vendor: its summary where one is supplied, and its industry by keywords."""
    new = vendors_to_look_up(tx, cache).join(summaries.select("vendor", "summary"), "vendor", "left")
    new = new.select("vendor", text.heuristic_industry(F.col("vendor"), F.col("summary")).alias("industry"), text.or_empty(F.col("summary")).alias("summary"))
    return cache.select("vendor", text.translate_industry(F.col("industry")).alias("industry"), "summary").unionByName(new)


def vendor_list(cache: DataFrame, industry: str, limit: int) -> DataFrame:
    rows = cache.where(F.lower(text.translate_industry(F.col("industry"))).contains(industry.lower()))
    return rows.orderBy(F.desc("fetched_at"), "vendor").limit(limit).select("vendor", text.translate_industry(F.col("industry")).alias("industry"), F.substring("summary", 1, 80).alias("summary"), "fetched_at")
