"""The pipeline's stages against plain versions on small tables."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import WORDS, components, text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, repeats int, size string, contamination string, id int, _row string"


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path, rows, labels = random.Random(11), str(tmp_path_factory.mktemp("tables")), [], []
    passage = text(rng, 14)
    for i in range(400):
        w = rng.choices(WORDS, k=rng.randint(12, 80))
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["awful", "nasty", "vile"])
        rows.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, rows[3 * i + 1][1], "s0") for i in range(10)]  # copies, also of toxic ones
    rows += [(1100 + i, rows[3 * i + 2][1] + " more", None) for i in range(10)]
    rows += [(1200 + i, text(rng, 9) + " " + passage + " " + text(rng, 9), "s2") for i in range(5)]
    rows += [(1300, None, "s0"), (1301, "", None), (1302, " \n ", "s1"), (None, "no key here", "s1"), (1303, "the same row", "s0"), (1303, "the same row", "s0"), (1304, text(rng, 5000), "s1")]
    docs = [(i, t, "en", s, len(t or ""), "x", "y", 9, "z", "c", 5, "r") for i, t, s in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, text(rng, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs, steps, columns = spark.read.parquet(f"{folder}/documents.parquet"), {}, None
    columns = docs.columns
    steps["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = docs.collect()
        assert docs.columns == columns + (["shard", "slot"] if name == "sharding" else [])
        assert {(r["score"], r["component_id"], r["repeats"], r["size"], r["contamination"], r["id"], r["_row"]) for r in steps[name]} == {("x", "y", 9, "z", "c", 5, "r")}
    key = lambda r: (r["doc_id"], r["text"], r["source"])
    # toxicity: what has several toxic words goes, all else stays
    bad = lambda t: len(set(words(t)) & {"awful", "nasty", "vile"}) > 0
    want = collections.Counter(key(r) for r in steps["input"] if not bad(r["text"]))
    got = collections.Counter(key(r) for r in steps["toxicity"])
    assert sum(bad(r["text"]) for r in steps["input"]) >= 80
    assert sum((got - want).values()) <= 4 and sum((want - got).values()) <= 4
    # near duplicates: one of each group of brute force
    before = steps["toxicity"]
    sets = []
    for r in before:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = components(sets, 80)
    groups = collections.defaultdict(collections.Counter)
    for i, r in enumerate(before):
        groups[root[i]][key(r)] += 1
    left = collections.Counter(key(r) for r in steps["near_duplicates"])
    assert sum(left.values()) == len(groups)
    assert all(sum(left[k] > 0 for k in g) >= 1 for g in groups.values())
    # decontamination: the passage's words go
    items = [words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(v[i : i + min(10, len(v))]) for v in items if v for i in range(len(v) - min(10, len(v)) + 1)}
    want = collections.Counter()
    for r in steps["near_duplicates"]:
        w, hit = words(r["text"]), set()
        for i in range(len(w) - 9):
            if tuple(w[i : i + 10]) in windows:
                hit |= set(range(i, i + 10))
        if not hit or len(hit) < len(w):
            want[(r["doc_id"], tuple(x for i, x in enumerate(w) if i not in hit))] += 1
    assert collections.Counter((r["doc_id"], tuple(words(r["text"]))) for r in steps["decontamination"]) == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in steps["decontamination"])
    # mixing: no more than twice, each source near its target
    times, size = collections.Counter(key(r) for r in steps["mixing"]), collections.Counter()
    n = lambda t: len((t or "").split())
    have = collections.Counter(key(r) for r in steps["decontamination"])
    for r in steps["decontamination"]:
        size[r["source"]] += n(r["text"])
    assert all(k in have and times[k] <= 2 * have[k] for k in times)
    order = [*sorted(s for s in size if s is not None), *([None] if None in size else [])]
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        share = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * share >= 2 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        taken = sum(n(t) * k for (_, t, x), k in times.items() if x == s)
        assert abs(taken - (2 * size[s] if s in full else weight[s] * share)) <= max(n(r["text"]) for r in steps["decontamination"] if r["source"] == s) / 2 + 1e-6
    # sharding: the same rows, equal shards, slots without gaps
    assert collections.Counter(key(r) for r in steps["sharding"]) == times
    shards = collections.defaultdict(list)
    for r in steps["sharding"]:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) <= set(range(24)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    # run() is the stages one after another
    assert collections.Counter((key(r), r["shard"]) for r in corpus_pipeline.run(spark, folder).collect()) == collections.Counter((key(r), r["shard"]) for r in steps["sharding"])


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).where(F.lit(True)).count() == 0, name


def test_shuffle_files_go_while_stages_run(spark, folder, monkeypatch):
    """Stages run under the setting, which is as before when the pipeline is done, also after an error."""
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(spark.conf.get(corpus_pipeline.SHUFFLES_GO))
        if len(seen) == 3:
            raise ValueError("a stage that fails")
        return docs.repartition(2, "doc_id")

    before = spark.conf.get(corpus_pipeline.SHUFFLES_GO)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage)])
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert corpus_pipeline.run(spark, folder).count() == n
    assert seen == ["true", "true"] and spark.conf.get(corpus_pipeline.SHUFFLES_GO) == before
    with pytest.raises(ValueError, match="a stage that fails"):
        corpus_pipeline.run(spark, folder)
    assert spark.conf.get(corpus_pipeline.SHUFFLES_GO) == before
