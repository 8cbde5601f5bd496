"""What a task holds and what a job moves, where it grew faster than the input."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kontor.operators import knn


def vectors(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def test_block_is_searched_in_bounded_pieces() -> None:
    rng = np.random.default_rng(0)
    t, q = rng.normal(size=(16384, 8)), rng.normal(size=(256, 8))
    t[::3], q[::4] = t[0], t[0]  # a third of the rows are equally near
    ids = rng.permutation(len(t))
    block = pa.table({"t": ids, "t_vector": vectors(t), "t_apart": ids % 2, "cell": pa.array(np.zeros(len(t), np.int32))})
    asking = pa.table({"q": np.arange(len(q)), "q_vector": vectors(q), "q_apart": np.full(len(q), 1), "cells": pa.array([[0]] * len(q))})
    tracemalloc.start()
    found = knn.top_of_block(asking, block, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64e6  # was 107 MB
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = np.round(unit(q) @ unit(t).T, 12)
    s[:, ids % 2 == 1] = -np.inf
    s[np.arange(len(q))[:, None] == ids] = -np.inf
    want = [(i, int(ids[j])) for i in range(len(q)) for j in np.lexsort((ids, -s[i]))[:5]]
    assert list(zip(found["id"].to_pylist(), found["neighbour"].to_pylist(), strict=True)) == want


def test_pieces_of_a_batch_follow_the_number_of_cells() -> None:
    batch = pa.record_batch({"a": np.arange(10000)})
    for cells in (1, 4096, 2**21):
        parts = list(knn.slices(batch, cells))
        assert sum(len(p) for p in parts) == len(batch)
        assert max(len(p) for p in parts) <= max(1, knn.ENTRIES // cells)


def test_calibrated_probabilities_shuffle_nothing_of_what_they_score(spark) -> None:  # noqa: ANN001
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from kontor.operators import cascade

    base = spark.range(90).select("id", (F.col("id") % 3).cast("int").alias("category_id"), array_to_vector(F.array((F.col("id") % 3 + F.col("id") / 200.0).cast("double"), F.lit(1.0))).alias("x"))
    out = cascade.calibrated_probabilities(base, base.select("id", "x"), forest=False, max_iter=3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 90
    for r in rows:
        p = [x["p"] for x in r["ranked"]]
        assert sorted(p, reverse=True) == p and abs(sum(p) - 1) < 1e-9 and {x["category_id"] for x in r["ranked"]} == {0, 1, 2}
    assert sum(r["ranked"][0]["category_id"] == r["id"] % 3 for r in rows) > 60


def test_token_overlap_takes_words_before_rows_meet_categories(spark) -> None:  # noqa: ANN001
    import __spark_entry__

    plan = __spark_entry__.queries()["b19_b20_token_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "regexp_extract_all" not in above and below.count("regexp_extract_all") == 2


def test_hash_embedding_reads_each_byte_once(spark) -> None:  # noqa: ANN001
    import hashlib

    from pyspark.sql import functions as F

    from kontor.functions.vectors import hash_embedding

    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    plan = df.select(hash_embedding(F.col("t"), 70))._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, 31" in plan and "sequence(0, 69" not in plan
    for r in df.select("t", hash_embedding(F.col("t"), 70).alias("v")).collect():
        x = np.resize(np.frombuffer(hashlib.sha256(r["t"].encode()).digest(), np.uint8), 70) - 127.5
        assert np.allclose(r["v"], x / np.sqrt((x * x).sum()), atol=1e-12)


def test_ngram_join_lets_shuffle_files_go(spark, monkeypatch) -> None:  # noqa: ANN001
    from kontor.llm import ngram_join

    name, seen, write = "spark.sql.shuffleDependency.fileCleanup.enabled", [], ngram_join.scratch_table
    setting = spark.conf.get(name)
    monkeypatch.setattr(ngram_join, "scratch_table", lambda df, to: seen.append((to, spark.conf.get(name))) or write(df, to))
    ngram_join.jaccard_components(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string"))
    assert len(seen) > 5 and {v for _, v in seen} == {"true"} and spark.conf.get(name) == setting


def test_history_makes_only_what_is_asked(spark, monkeypatch) -> None:  # noqa: ANN001
    from kontor.operators import temporal

    rows = [(i, f"v{i % 3}", f"DE{i % 2}", f"2020-0{1 + i % 6}-01", -100 - i % 4) for i in range(60)]
    tx = spark.createDataFrame(rows, "id long, vendor string, iban string, date string, cents long").withColumn("date", F.to_date("date"))
    every = {r["id"]: r for r in temporal.temporal_features(tx).collect()}
    made = []
    for name in ("vendor_history", "similar_amounts", "iban_history"):
        monkeypatch.setattr(temporal, name, lambda tx, name=name, f=getattr(temporal, name): made.append(name) or f(tx))
    for features, history in ((temporal.VENDOR_FEATURES, "vendor_history"), (temporal.SIMILAR_FEATURES, "similar_amounts"), (temporal.IBAN_FEATURES, "iban_history")):
        made.clear()
        some = temporal.temporal_features(tx, features=features).collect()
        assert made == [history] and len(some) == 60
        assert all(r[f] == every[r["id"]][f] for r in some for f in features)


def test_log_numbers_are_told_apart_in_pieces(spark, monkeypatch) -> None:  # noqa: ANN001
    from kontor.operators import jobs

    monkeypatch.setattr(jobs, "NUMBERS_PER_TASK", 100)
    log = spark.range(1000).select((F.col("id") % 600).alias("label_id"))
    out = jobs.log_numbers(log)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(label_id" in plan and ", 11)" in plan and plan.count("hashpartitioning") == 1  # told apart only where they were dealt to
    assert tuple(out.first()) == (1000, 600, 599)


def test_appended_labels_are_numbered_over_ranges(spark, monkeypatch) -> None:  # noqa: ANN001
    from kontor.operators import jobs

    monkeypatch.setattr(jobs, "NUMBERS_PER_TASK", 100)
    log = spark.range(5).select((F.col("id") + 1).alias("label_id"), F.col("id").alias("expense_id"), F.lit(1).alias("category_id"), F.lit("user").alias("source"))
    new = spark.range(1000).select((F.col("id") * 37 % 1000).alias("expense_id"), F.lit(2).alias("category_id"), F.lit("user").alias("source"))
    out = jobs.append_labels(log, new)
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()  # which would sort what of several ranges meets in a task
    got = {r["expense_id"]: r["label_id"] for r in out.where("category_id = 2").collect()}
    assert got == {i: 6 + i for i in range(1000)} and out.count() == 1005


def test_diverse_rows_are_searched_once_and_only_for_undercovered_categories(spark, monkeypatch) -> None:  # noqa: ANN001
    from kontor.operators import active

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=(40, 3))
    frame = lambda v, at: spark.createDataFrame([(at + i, r.tolist()) for i, r in enumerate(v)], "id long, vector array<double>")
    rows, train = frame(x, 0), frame(y, 1000)
    truth = spark.createDataFrame([(1000 + i, i % 4) for i in range(40)], "id long, category_id int")
    searched, search = spark.sparkContext.accumulator(0), active.nearest_category

    def count(batches):  # noqa: ANN001, ANN202
        for b in batches:
            searched.add(len(b))
            yield b

    monkeypatch.setattr(active, "nearest_category", lambda *a: search(*a).mapInArrow(count, "id long, category_id int"))
    few = lambda *c: spark.createDataFrame([(i, 0) for i in c], "category_id int, n_labels long")
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = (unit(x) @ unit(y).T).argmax(axis=1) % 4

    def walk(of: np.ndarray) -> list[int]:
        return [int(of[i]) for i in active.greedy(of, x[of], 6, x[of].mean(axis=0))]

    def got(few) -> list[tuple[int, int]]:  # noqa: ANN001
        out = active.select_diverse(rows, train, truth, few, 6)
        assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()  # no Python worker for rows that the driver holds
        return sorted((r["pos"], r["id"]) for r in out.collect())

    assert got(few(2)) == list(enumerate(walk(np.flatnonzero(near == 2)), 1))
    assert searched.value == 200  # was 400: once for each walk
    assert got(few()) == list(enumerate(walk(np.arange(200)), 7))
    assert searched.value == 200  # was 800
    assert got(few(9)) == list(enumerate(walk(np.arange(200)), 7))


def test_vectors_of_digests_are_hash_embeddings(spark) -> None:  # noqa: ANN001
    from kontor.functions.vectors import hash_embedding, vectors_of_digests

    df = spark.range(50).select(F.concat(F.lit("täxt "), "id").alias("t"))
    rows = df.select(F.unhex(F.sha2("t", 256)).alias("d"), *[hash_embedding(F.col("t"), n).alias(f"v{n}") for n in (20, 64)]).collect()
    for n in (20, 64):
        assert (vectors_of_digests(pa.array([bytes(r["d"]) for r in rows]), n) == np.array([r[f"v{n}"] for r in rows])).all()


def test_likeness_to_categories_makes_no_vectors_in_expressions(spark) -> None:  # noqa: ANN001
    from kontor.functions.vectors import hash_embedding
    from kontor.operators import cascade

    texts = spark.range(400).select("id", F.concat(F.lit("markt v"), F.col("id") % 90).alias("combined"), F.when(F.col("id") % 3 == 0, "laden essen").otherwise("").alias("industry"), F.lit("").alias("summary"))
    categories = spark.createDataFrame([(i, f"art {i}", w) for i, w in enumerate(["laden markt", "essen", "", "reise", "laden essen markt kauf"])], "category_id int, name string, description string")
    given = cascade.similarity_rows(texts, cascade.CascadeConfig())
    assert given.columns == ["id", "combined", "industry"]
    said = [{tuple(r) for r in cascade.similarity_stage(rows, categories, least=0.0, margin=0.0).collect()} for rows in (given, given.withColumn("vector", hash_embedding(F.col("combined"))))]
    assert len(said[0]) > 100 and said[0] == said[1]


def test_calibration_adds_up_equal_probabilities_in_the_tasks(spark, monkeypatch) -> None:  # noqa: ANN001
    from kontor.operators import cascade

    rows = spark.range(3000).select((F.col("id") % 3 * 4).cast("int").alias("category_id"), F.array(*[((F.col("id") * k) % 97 / 96.0).cast("double") for k in (7, 11, 13)]).alias("p"))
    plain = rows.toPandas()
    for most in (1 << 19, 10):
        monkeypatch.setattr(cascade, "CURVE_POINTS", most)
        got = cascade.calibration_curves(rows, [0, 4, 8])
        for j, c in enumerate((0, 4, 8)):
            p, hit = np.round(np.stack(plain["p"])[:, j], 6), (plain["category_id"] == c).to_numpy()
            points = np.unique(p)
            x, y = cascade.isotonic(points, np.array([hit[p == v].sum() for v in points], float), np.array([(p == v).sum() for v in points], float))
            assert np.allclose(got[c][0], x, atol=1e-12) and np.allclose(got[c][1], y)


def test_cascade_queries_make_the_transactions_once(spark, monkeypatch) -> None:  # noqa: ANN001
    from kontor.operators import cascade
    from kontor.plans import job_queries

    seen = []
    monkeypatch.setattr(cascade, "stage_store", lambda folds, tx, *a, **kw: seen.append(tx) or tx)
    job_queries.store(spark, "/root/testdata/sf0.001", 2)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
