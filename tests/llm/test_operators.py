"""The training-data operators against brute force on small tables, edge cases included."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, source string, n_chars long, shard string, size string"


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = [text(rng, rng.randint(1, 90)) for _ in range(30)]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    out += [(100 + i, base[i], "s0") for i in range(8)]  # exact copies
    for i in range(10):  # near copies, and shared passages
        w = base[i].split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        out.append((200 + i, " ".join(w), None))
        out.append((300 + i, text(rng, 20) + " " + base[20] + "\t\n" + text(rng, 9), "s1"))
    out += [(400, None, "s0"), (401, "", "s1"), (402, " \t ", None), (None, "alone and short", "s2"), (403, "a " * 200, "s1")]
    out += [(500, "twice the same row", "s0")] * 3
    return [(*r, 0, "x", "y") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, empty, rows):
    from kontor.llm.sharding import hypergeometric, shuffle_into_shards

    out = shuffle_into_shards(docs, 5, seed=3, rows_per_chunk=4, stable_input=True).collect()
    n = collections.Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(n.values()) - min(n.values()) <= 1
    for s in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n[s]))
    assert collections.Counter(r["text"] for r in out) == collections.Counter(r[1] for r in rows)
    assert shuffle_into_shards(empty, 5).count() == 0
    rng = np.random.default_rng(0)
    x = [hypergeometric(rng, 3 * 10**9, 5 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(x) - 375_000) < 150 and 300 < np.std(x) < 700


def test_sharding_law():
    """Rows of the communication matrix follow the hypergeometric law, and add up to the columns."""
    from kontor.llm.sharding import matrix_row

    offsets, columns = np.array([0, 3, 5, 9]), np.array([2, 4, 3])
    seen = collections.Counter()
    for seed in range(4000):
        m = np.array([matrix_row(offsets, columns, i, seed) for i in range(3)])
        assert (m.sum(axis=1) == np.diff(offsets)).all() and (m.sum(axis=0) == columns).all()
        seen[int(m[0, 0])] += 1
    for k in range(3):
        p = math.comb(2, k) * math.comb(7, 3 - k) / math.comb(9, 3)
        assert abs(seen[k] / 4000 - p) < 4 * math.sqrt(p * (1 - p) / 4000)


WORKING = "id class key n ranges token at component a b row place value kind new block hash word c lp shard_ chunk order start segments anchor content spans _row _row_ part salt rest whole src dst w rank z level before".split()


def test_clashing_names(spark):
    """Columns that are named like an operator's own working columns stay as they are."""
    from kontor.llm.decontaminate import find_benchmark
    from kontor.llm.lattice import score_likelihood
    from kontor.llm.mixing import mix_sources
    from kontor.llm.ngram_join import jaccard_components
    from kontor.llm.pii import pseudonymise
    from kontor.llm.sharding import shuffle_into_shards
    from kontor.llm.substring_dedup import find_repeats, keep_words
    from kontor.llm.url_filter import judge_pages

    rng = random.Random(12)
    df = spark.createDataFrame([(i, text(rng, 30) + " 10.20.30.40", f"s{i % 2}") for i in range(12)] * 2 + [(None, None, None)], "doc_id long, text string, source string")
    df = df.withColumns({c: F.lit("x") for c in WORKING}).withColumns({"url": F.lit("http://h/p"), "html": F.lit("")})
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    runs = {
        "shuffle_into_shards": lambda d: shuffle_into_shards(d, 3), "mix_sources": lambda d: mix_sources(d, F.length("text")), "find_benchmark": lambda d: find_benchmark(d, bench),
        "find_repeats": lambda d: keep_words(find_repeats(d, window=9, anchor=3)), "jaccard_components": jaccard_components, "score_likelihood": lambda d: score_likelihood(d, F.col("doc_id") > 3),
        "pseudonymise": lambda d: pseudonymise(d, "k"), "judge_pages": lambda d: judge_pages(d, {"h/": "allow"}),
    }
    for name, run in runs.items():
        out = run(df).collect()
        assert len(out) == 25, name
        gone = {"judge_pages": {"rank"}}.get(name, set())
        for c in set(WORKING) - gone:
            assert {r[c] for r in out} == {"x"}, (name, c)
        assert run(df.limit(0)).count() == 0, name


def test_mixing_many_ties(spark):
    """All rows of a source agree in key and size: the mix's end falls between rows that only their places tell apart."""
    from kontor.llm.mixing import mix_sources

    df = spark.createDataFrame([(7, "a b", "s")] * 101 + [(8, "c d", "t")] * 40, "doc_id long, text string, source string").repartition(5)
    for few in (50_000, 3):
        out = mix_sources(df, F.lit(2).cast("long"), few=few).collect()
        for s in "st":
            taken, target = sum(r["repeats"] * 2 for r in out if r["source"] == s), next(r["target"] for r in out if r["source"] == s)
            assert abs(taken - target) <= 1


def test_mixing(docs, empty):
    from kontor.llm.common import n_words
    from kontor.llm.mixing import mix_sources

    def run():
        return sorted(((r["doc_id"], r["size"], r["source"], r["source_size"], r["target"], r["repeats"]) for r in mix_sources(docs, n_words(F.col("text")), key=("doc_id",), few=few, stable_input=True).collect()), key=repr)

    few = 50_000
    out = run()
    assert out == run()
    few = 1  # narrowed down to single rows
    assert out == run()
    size = collections.Counter()
    for r in out:
        size[r[2]] += r[1]
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full, target = 1.5 * sum(size.values()), set(), {}
    while True:  # the plain form of water-filling
        left = budget - sum(2 * size[s] for s in full)
        share = left / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * share >= 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * size[s] if s in full else weight[s] * share for s in order}
    taken = collections.Counter()
    for d, n, s, total, t, k in out:
        assert total == size[s] and math.isclose(t, target[s]) and 0 <= k <= 2
        taken[s] += n * k
    for s in order:
        assert abs(taken[s] - target[s]) <= max(n for _, n, x, *_ in out if x == s) / 2 + 1e-6
    assert mix_sources(empty, n_words(F.col("text"))).count() == 0


def test_decontamination(spark, docs, empty, rows):
    from kontor.llm.decontaminate import find_benchmark, remove_spans

    items = [(1, rows[20][1]), (2, rows[5][1].upper()), (3, "twice, the SAME"), (4, None), (5, "!!"), (None, "alone and")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    for block in (1 << 22, 40):  # one block, and several
        out = remove_spans(find_benchmark(docs, bench, block_bytes=block)).collect()
        source = collections.defaultdict(list)
        for r in rows:
            source[r[0]].append(r[1])
        for r in out:
            w, hit, found = words(source[r["doc_id"]][0]), set(), set()
            for i, t in items:
                v = words(t)
                k = min(10, len(v))
                for a in range(len(v) - k + 1) if k else ():
                    for b in range(len(w) - k + 1):
                        if w[b : b + k] == v[a : a + k]:
                            hit |= set(range(b, b + k))
                            found.add("null" if i is None else str(i))
            c = r["contamination"]
            assert (c["n_words"], c["n_hit"], c["items"]) == (len(w), len(hit), sorted(found))
            assert words(r["text"]) == [x for i, x in enumerate(w) if i not in hit]
    assert find_benchmark(empty, bench).count() == 0
    assert find_benchmark(docs, bench.limit(0)).where("contamination.n_hit > 0").count() == 0


def test_substring_dedup(docs, empty):
    from kontor.llm.substring_dedup import find_repeats, keep_words

    for hot in (2000, 1):  # with and without splitting hot anchors
        out = keep_words(find_repeats(docs, window=9, anchor=3, hot_segments=hot, stable_input=True)).collect()
        count = collections.Counter()
        for r in out:
            w = (r["text"] or "").encode().split()
            count.update(tuple(w[i : i + 9]) for i in range(len(w) - 8))
        for r in out:
            w, gone = (r["text"] or "").encode().split(), set()
            for i in range(len(w) - 8):
                if count[tuple(w[i : i + 9])] > 1:
                    gone |= set(range(i, i + 9))
            kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
            assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(gone), kept)
    assert find_repeats(empty, window=9).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_repeats_of_a_shard_are_those_of_a_plain_count(seed):
    """Words of few kinds, passages pasted at many offsets, a self-repeating row, rows of one window, and weights."""
    from kontor.llm.substring_dedup import repeated_in_shard

    rng, window = random.Random(seed), (3, 8, 35)[seed % 3]
    kinds = [f"w{i}" for i in range(rng.choice([2, 5, 200]))]
    passages = [[rng.choice(kinds) for _ in range(rng.randint(window - 1, 3 * window))] for _ in range(4)]
    rows = []
    for _ in range(60):
        row = [rng.choice(kinds) for _ in range(rng.randint(0, 2 * window))]
        for _ in range(rng.randint(0, 3)):
            row += rng.choice(passages)[rng.randint(0, 2) :] + [rng.choice(kinds) for _ in range(rng.randint(0, 5))]
        rows.append(row + [rng.choice(kinds) for _ in range(max(0, window - len(row)))])
    rows += [["same"] * (4 * window), ["one", *(f"u{i}" for i in range(window - 1))]]
    weight = np.array([rng.choice([1, 1, 1, 2]) for _ in rows])
    count = collections.Counter()
    for row, k in zip(rows, weight.tolist(), strict=True):
        for i in range(len(row) - window + 1):
            count[tuple(row[i : i + window])] += k
    want = {(r, j) for r, row in enumerate(rows) for i in range(len(row) - window + 1) if count[tuple(row[i : i + window])] > 1 for j in range(i, i + window)}
    which, begin, end = repeated_in_shard(pa.array([" ".join(r) for r in rows]), np.array([len(r) - window + 1 for r in rows]), weight, window)
    got = [(r, j) for r, a, b in zip(which.tolist(), begin.tolist(), end.tolist(), strict=True) for j in range(a, b)]
    assert len(got) == len(set(got)) and set(got) == want


def test_substring_dedup_leaves_no_name(docs, spark):
    from kontor.llm.substring_dedup import find_repeats

    before = {t.name for t in spark.catalog.listTables()}
    out = find_repeats(docs, window=9, anchor=3)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert out.count() == docs.count()


def test_substring_dedup_hot_passage(spark, monkeypatch, tmp_path):
    from kontor.llm import substring_dedup

    rng, real, folder = random.Random(9), substring_dedup.repeated_in_shard, str(tmp_path)
    passage = text(rng, 12)

    def seen(texts, *args):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(texts)))
        return real(texts, *args)

    monkeypatch.setattr(substring_dedup, "repeated_in_shard", seen)
    df = spark.createDataFrame([(i, f"{text(rng, 9)} {passage} {text(rng, 9)}") for i in range(300)], "doc_id long, text string")
    out = substring_dedup.find_repeats(df, window=9, anchor=3, hot_segments=50).collect()
    windows = lambda r: [tuple(r["text"].split()[i : i + 9]) for i in range(22)]
    count = collections.Counter(w for r in out for w in windows(r))
    for r in out:  # brute force, over the whole result
        gone = {j for i, w in enumerate(windows(r)) if count[w] > 1 for j in range(i, i + 9)}
        assert {j for a in r["repeats"] for j in range(a["start"], a["end"])} == gone
    assert len(out) == 300 and all(any(a["start"] <= 9 and a["end"] >= 21 for a in r["repeats"]) for r in out)
    # the windows of the shared passage do not fill a shard, once a document
    assert max((int(f.read_text()) for f in tmp_path.iterdir()), default=0) < 300


def components(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_ngram_join(docs, empty):
    from kontor.llm.ngram_join import jaccard_components

    out = jaccard_components(docs, n=4, percent=85, stable_input=True).collect()
    sets = []
    for r in out:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = components(sets, 85)
    for i, r in enumerate(out):
        ids = [out[j]["doc_id"] for j in range(len(out)) if root[j] == root[i] and out[j]["doc_id"] is not None]
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), min(ids) if ids else None)
    firsts = collections.Counter(root[i] for i, r in enumerate(out) if r["first_in_component"])
    assert set(firsts.values()) == {1} and len(firsts) == len(set(root))
    assert jaccard_components(empty).count() == 0


def test_ngram_join_large_group(spark):
    """A few hundred near copies, most pairs of which do not link, and columns of working names."""
    from kontor.llm.ngram_join import jaccard_components

    rng, rows = random.Random(7), []
    base = text(rng, 100).split()
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"changed{rng.random()}"
        rows.append((1000 - i, " ".join(w), "x", 5, "y", None))
    rows.append((7, text(rng, 300_000), "x", 5, "y", None))
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, class int, component string, n_shingles string")
    out = jaccard_components(df, n=4, percent=85).collect()
    sets = []
    for r in out:
        w = r["text"].encode().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    root = components(sets, 85)
    for i, r in enumerate(out):
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), min(out[j]["doc_id"] for j in range(len(out)) if root[j] == root[i]))
        assert (r["id"], r["class"], r["component"]) == ("x", 5, "y")


def test_lattice(docs, empty):
    from kontor.llm.lattice import VOCABULARY, arcs, forward, load_pieces, long_word, score_likelihood

    v = load_pieces(VOCABULARY)
    word = "▁thinör".encode()
    total = {0: 1.0}
    for b in range(1, len(word) + 1):  # all segmentations, in plain probabilities
        total[b] = sum(total[a] * math.exp(v.log_p[v.index[word[a:b]]]) for a in range(b) if word[a:b] in v.index)
    block = np.frombuffer(word, np.uint8)[None, :]
    assert math.isclose(forward(v, arcs(v, block), 1, len(word))[-1][0], math.log(total[len(word)]), rel_tol=1e-9)
    assert math.isclose(long_word(v, word), math.log(total[len(word)]), rel_tol=1e-9)
    from kontor.llm.lattice import expected_counts

    counts = np.zeros(len(v.pieces))
    long_word(v, word, counts)
    assert np.allclose(counts, expected_counts(v, arcs(v, block), np.ones(1), len(word)), rtol=1e-9)
    out = score_likelihood(docs, F.col("doc_id") % 2 == 0, stable_input=True, rows_per_block=4).collect()
    c = collections.Counter()
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] % 2 == 0:
            c.update([*(r["text"] or "").encode().lower().split(), b"\0end"])
    n, kinds = sum(c.values()), len(c)
    for r in out:
        tokens = [*(r["text"] or "").encode().lower().split(), b"\0end"]
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (kinds + 1))) for t in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    assert score_likelihood(empty, F.lit(True)).count() == 0
    # the model's score against the same sums in plain Python: known words by discounted counts and the lattice, others by the lattice alone
    from kontor.llm.lattice import train_pieces, word_log_p

    train = sorted({w for r in out if r["doc_id"] is not None and r["doc_id"] % 2 == 0 for w in (r["text"] or "").encode().lower().split()})
    pieces = train_pieces(docs.sparkSession.createDataFrame([(bytearray(w),) for w in train], "word binary"), v)
    only = {w: k for w, k in c.items() if w != b"\0end"}
    once, twice, tokens = sum(k == 1 for k in only.values()), sum(k == 2 for k in only.values()), sum(only.values())
    d, ends = min(0.95, max(0.05, once / max(1, once + 2 * twice))), c[b"\0end"]
    p_end = (ends + 0.5) / (n + 1)
    for r in out[:25]:
        total = math.log10(p_end)
        for w in (r["text"] or "").encode().lower().split():
            lattice = math.exp(word_log_p(pieces, pa.array([w], pa.binary()))[0])
            total += math.log10((max(only.get(w, 0) - d, 0) / tokens + d * len(only) / tokens * lattice) * (1 - p_end))
        assert math.isclose(r["score"], total, rel_tol=1e-6)
    long = docs.sparkSession.createDataFrame([(1, "a" * 3000 + " b"), (2, "c d " * 30_000)], "doc_id long, text string")
    assert {r["n_tokens"] for r in score_likelihood(long.withColumn("score", F.lit("x")), F.lit(True)).collect()} == {3, 60_001}
    assert score_likelihood(docs, F.lit(False)).where("n_known > 0 or isnan(score)").count() == 0


def test_toxicity(spark):
    from kontor.llm.toxicity import fit_toxicity, score_toxicity

    rng, rows, labels = random.Random(2), [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = rng.choices(WORDS, k=rng.randint(20, 60))
        for _ in range(3 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["awful", "nasty", "vile"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (901, None), (5000, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in score_toxicity(df, fit_toxicity(df, lab.where("doc_id % 5 <> 0"))).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert np.mean([out[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[900]["score"] == out[901]["score"]
    assert {r["predicted"] for r in score_toxicity(df, fit_toxicity(df, lab.limit(0))).collect()} == {0}
    assert score_toxicity(df.limit(0), fit_toxicity(df, lab)).count() == 0
    more = score_toxicity(df.withColumns({c: F.lit("x") for c in ("score", "z", "key", "toxic", "_z")}), fit_toxicity(df, lab)).collect()
    assert {r["_z"] for r in more} == {"x"} and all(0 <= r["score"] <= 1 for r in more)


def test_toxicity_against_plain_model(spark):
    """The gains of the four levels against the same recursion in plain Python."""
    from kontor.llm.toxicity import ToxicityModel, count_expressions, expression_gains

    rng, docs = random.Random(3), []
    words = ["nastiest", "nastiestly", "nasty", "good", "goodness", "a", "of", "thing", "things", "thingsome"]
    for i in range(120):
        toxic = i % 3 == 0
        docs.append((" ".join(rng.choices(words, k=rng.randint(1, 12), weights=[6 if toxic else 1] * 3 + [2] * 7)), toxic))
    counts = [collections.defaultdict(lambda: [0, 0]) for _ in range(4)]

    def levels(w, before):
        return [w[:4] if len(w) > 4 else None, w[:7] if len(w) > 7 else None, w, (before, w)]

    for t, toxic in docs:
        ws = t.split()
        for level in range(4):
            for x in {levels(w, ws[i - 1] if i else None)[level] for i, w in enumerate(ws)} - {None}:
                counts[level][x][toxic] += 1
    # below the pairs: how many expressions of a class back off to each, in place of its documents
    documents, kinds = [{x: sum(c) for x, c in level.items()} for level in counts], [collections.defaultdict(lambda: [0, 0]) for _ in range(4)]
    for level in range(1, 4):
        for x, c in counts[level].items():
            lower = levels(x[1] if level == 3 else x, None)
            lv = next((i for i in range(min(level, 3) - 1, -1, -1) if lower[i] is not None), None)
            if lv is not None:
                for s in (0, 1):
                    kinds[lv][lower[lv]][s] += c[s] > 0
    counts = [{x: [max(kinds[level][x][s], min(1, c[s])) for s in (0, 1)] if level < 3 else c for x, c in counts[level].items()} for level in range(4)]
    known = [{}, {}, {}, {}]
    for level in range(4):
        both = [sum(c) for c in counts[level].values()]
        d = both.count(1) / (both.count(1) + 2 * both.count(2)) if both.count(1) else 0.5
        for x, c in counts[level].items():
            word = x[1] if level == 3 else x
            up = next((known[lv][y] for lv in range(level - 1, -1, -1) if (y := levels(word, None)[lv]) is not None and lv < 3), (1.0, 1.0))
            peers = [v for y, v in counts[level].items() if level < 3 or y[0] == x[0]]
            k, share, total = documents[level][x], sum(c), [sum(v[s] for v in peers) for s in (0, 1)]
            p = []
            for s in (0, 1):
                own = max(c[s] - d, 0) / total[s] / (share / sum(total)) + d * sum(v[s] > 0 for v in peers) / total[s] * up[s] if total[s] else up[s]
                p.append(k / (k + 2.0) * own + 2.0 / (k + 2.0) * up[s] if total[s] else up[s])
            known[level][x] = tuple(p)
    df = spark.createDataFrame(docs, "text string, toxic boolean")
    gains = expression_gains(count_expressions(df), strength=2.0, margin=0.1).toPandas()
    keys = gains["key"].to_numpy(np.int64).view(np.uint64)
    model = ToxicityModel(keys[np.argsort(keys)], gains["gain"].to_numpy()[np.argsort(keys)], 1.0, 0.0)
    for t in ("nasty things of nastiestly good", "goodnesses things", "unheard"):
        want, ws = [], t.split()
        for i, w in enumerate(ws):
            p = next((known[lv][x] for lv in (3, 2, 1, 0) if (x := levels(w, ws[i - 1] if i else None)[lv]) in known[lv]), (1.0, 1.0))
            r = math.log(p[1] / p[0])
            want.append(math.copysign(max(abs(r) - 0.1, 0.0), r))
        assert math.isclose(model.difference(pa.array([t]))[0], sum(want) / len(ws), rel_tol=1e-9, abs_tol=1e-12)


def test_neighbours(spark):
    from kontor.llm.neighbours import nearest

    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 12))
    x[300:400] = x[300]  # ties
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [None, *[1.0] * 11]), (None, [1.0] * 12)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>")
    out = nearest(df, F.col("vec_id") % 20 == 0, block_rows=100, query_rows=10).collect()
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 700, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(700), -np.round(s, 12)))[:20]
        hits += len({i for i, _ in got[q]} & set(best))
        assert all(math.isclose(s[i], y) for i, y in got[q]) and len(got[q]) == 20
    assert set(got) == set(range(0, 700, 20)) and hits / (35 * 20) >= 0.9
    # groups: a query goes to few partitions, and still finds 20 where its partition has fewer
    centre = rng.normal(size=(12, 12)) * 4
    y = centre[np.arange(1500) % 12] + rng.normal(size=(1500, 12)) * 0.3
    y /= np.linalg.norm(y, axis=1)[:, None]
    from kontor.llm.neighbours import fit_router

    router = fit_router(y, 1.0, parts=12, k=20, target_recall=0.96)
    assert router.probes <= 6 and len(router.bias) == 12
    clustered = spark.createDataFrame([(i, [float(a) for a in v], "x", 1) for i, v in enumerate(y)], "vec_id long, embedding array<double>, part string, q int")
    got = collections.Counter(r["query_id"] for r in nearest(clustered, F.col("vec_id") % 20 == 0, k=200).collect())
    assert set(got) == set(range(0, 1500, 20)) and set(got.values()) == {200}
    few = nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4
    assert nearest(df.where("vec_id >= 1000"), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_repeated_rows(spark):
    """Every row twice, and ids with two vectors, as queries and as candidates: an id is found once, with its best score."""
    from kontor.llm.neighbours import nearest

    rng = np.random.default_rng(9)
    x = rng.normal(size=(45, 8))
    twice = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] * 2, "vec_id long, embedding array<double>")
    for df, vectors in ((twice, {i: [v] for i, v in enumerate(x)}), (twice.union(spark.createDataFrame([(i, [float(y) for y in 2 * x[i - 1]]) for i in (20, 21, 22)], twice.schema)), {i: [v, *([2 * x[i - 1]] if i in (20, 21, 22) else [])] for i, v in enumerate(x)})):
        for block_rows in (16384, 7):
            out = nearest(df, F.col("vec_id") % 20 == 0, block_rows=block_rows, query_rows=2).collect()
            for q in (0, 20, 40):
                score = {i: max(float(a @ b) for a in vectors[q] for b in v) for i, v in vectors.items() if i != q}
                want = sorted(score, key=lambda i: (-score[i], i))[:20]
                got = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
                assert [r["vec_id"] for r in got] == want and [r["rank"] for r in got] == list(range(1, 21))
                assert [r["score"] for r in got] == pytest.approx([score[i] for i in want])


def test_neighbours_uneven_norms():
    """With norms over several orders no partition holds twice its share, and the neighbours are found."""
    from kontor.llm.neighbours import fit_router, neighbour_graph

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)) * np.exp(rng.normal(size=(3000, 1)))
    fit, rest = x[:1500], x[1500:]
    largest = float(np.linalg.norm(x, axis=1).max())
    router = fit_router(fit, largest, parts=19, k=20, target_recall=0.96)
    n = len(router.bias)
    assert n == 19 and np.bincount(router.place(rest), minlength=n).max() <= 2 * len(rest) / n
    graph = neighbour_graph(router.lift(rest, query=True), router.lift(rest, query=False), 20)
    asked, part = router.rank(rest, query=True)[:, : router.probes], router.place(rest)
    hits = np.mean([[p in set(a) for p in part[g]] for a, g in zip(asked.tolist(), graph, strict=True)])
    assert hits >= 0.9, (hits, router.probes)


def test_pii(spark):
    from kontor.llm.pii import pseudonymise

    def luhn(d):
        return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    texts = ["card 4111 1111 1111 1111 and 4111111111111111.", "no card 4111111111111112", "call +1 (297) 555-8151 or 10.20.30.40, not 300.1.2.3", "born 1984-02-29 and 31.12.1999, not 2023-02-30", "ssn 123-45-6789, mail ann.lee7@example.com", 'token = "08813ad77930c5f69132"', "", None, "clean text 2024 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = [(r["text"], r["n_pii"]) for r in pseudonymise(df, "k").orderBy("doc_id").collect()]
    assert [n for _, n in out] == [2, 0, 2, 2, 2, 1, 0, 0, 0]
    assert [out[i][0] for i in (1, 6, 7, 8)] == [texts[i] for i in (1, 6, 7, 8)]
    a, b = re.findall(r"\d[\d ]{14,}\d", out[0][0])
    assert luhn(a.replace(" ", "")) and a.replace(" ", "") == b and a != "4111 1111 1111 1111" and len(a) == 19
    assert re.fullmatch(r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or (\d{1,3}\.){3}\d{1,3}, not 300.1.2.3", out[2][0])
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d and \d\d\.\d\d\.\d{4}, not 2023-02-30", out[3][0])
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}, mail [a-z]{3}\.[a-z]{3}\d@example.com", out[4][0])
    assert re.fullmatch(r'token = "[0-9a-f]{20}"', out[5][0]) and out[5][0] != texts[5]
    many = spark.range(2000).select(F.format_string("x 123-45-%04d", (F.col("id") + 1).cast("int")).alias("text"))
    assert pseudonymise(many, "k").select("text").distinct().count() == 2000  # a bijection


def test_pii_against_plain_feistel(spark):
    import hashlib
    import hmac

    from kontor.llm.pii import pseudonymise

    subkey = hmac.new(b"k", b"pseudonyms", hashlib.sha256).hexdigest()

    def plain(left, right, sizes, kind):
        half = [left, right]
        for i in range(8):
            mine, other = (0, 1) if i % 2 == 0 else (1, 0)
            h = hashlib.sha256("|".join(map(str, (subkey, kind, i, *sizes, half[other]))).encode()).hexdigest()
            half[mine] = (half[mine] + int(h[:14], 16)) % sizes[mine]
        return half

    values = ["10.20.30.40", "255.0.0.1", "4111111111111111", "123-45-6789", "899-99-9999", "+1 (017) 155-0000", "+1 (297) 555-8151", "1984-02-29"]
    df = spark.createDataFrame([(v, i, "mine", 7) for i, v in enumerate(values)], "text string, pii int, value string, row int")
    plan = pseudonymise(df, "a very secret key")._jdf.queryExecution().toString()
    assert "a very secret key" not in plan and "Python" not in plan and "Arrow" not in plan
    out = pseudonymise(df, "k")
    assert out.columns == ["text", "value", "row", "pii", "n_pii"]  # extra columns of working names stay
    named = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id int, text string")
    got = {values[r["doc_id"]]: r["text"] for r in pseudonymise(named, "k").collect()}
    a, b = plain(10 * 256 + 20, 30 * 256 + 40, (65536, 65536), "address")
    assert got["10.20.30.40"] == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    a, b = plain(122, 44 * 9999 + 6788, (898, 99 * 9999), "social")
    a += 2 if a >= 665 else 1
    assert got["123-45-6789"] == f"{a:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    a, b = plain(17 * 200 + 155, 0, (200 * 200, 10000), "phone")
    assert got["+1 (017) 155-0000"] == f"+1 ({a // 200:03d}) {a % 200:03d}-{b:04d}"
    a, b = plain(97 * 800 + 355, 8151, (800 * 800, 10000), "phone")
    assert got["+1 (297) 555-8151"] == f"+1 ({a // 800 + 200:03d}) {a % 800 + 200:03d}-{b:04d}"
    a, b = plain(4111111, 11111111, (10**7, 10**8), "card")
    assert got["4111111111111111"][:15] == f"{a:07d}{b:08d}"
    # phones, cards, addresses: bijections on a full or large range
    for form, n in (("+1 (017) 155-%04d", 10000), ("10.20.%d.7", 256), ("19%02d-03-01", 100)):
        many = spark.range(n).select(F.format_string(form, F.col("id").cast("int")).alias("text"))
        assert pseudonymise(many, "k").select("text").distinct().count() == n
    long = "ab " * 600_000 + "mail " + "x" * 300 + "1@example.com and token=" + "0a" * 100
    r = pseudonymise(spark.createDataFrame([(long,), (long,)], "text string"), "k").collect()
    assert r[0] == r[1] and r[0]["n_pii"] == 2 and len(r[0]["text"]) == len(long) and "x" * 20 not in r[0]["text"] and "0a0a0a" not in r[0]["text"]
    assert pseudonymise(named.limit(0), "k").count() == 0


def test_url_filter(spark):
    from kontor.llm.url_filter import judge_pages

    rules = {"org/": "allow", "example.org/es/": "block", "com/de/": "block"}
    link = lambda h: f'<a class="x" href="http://{h}/p">x</a>'
    rows = [(1, "http://A.example.org/en/1?x", ""), (2, "https://b.example.org/es/9", ""), (3, "http://bad.com/de/1", ""), (4, "http://linker.net/", link("bad.com")), (5, "http://fine.net", link("good.org")), (6, "http://good.org/x", link("fine.net")), (7, None, None), (8, "nonsense", ""), (9, "x://notorg/", "")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    out = {r["page_id"]: r for r in judge_pages(df, rules).collect()}
    assert [out[i]["verdict"] for i in range(1, 10)] == ["allow", "block", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert [out[i]["rule"] for i in (1, 2, 3, 4, 9)] == ["org/", "example.org/es/", "com/de/", None, None]
    assert (out[1]["host"], out[1]["path"], out[7]["host"], out[8]["path"]) == ("a.example.org", "/en/1", "", "")
    assert judge_pages(df.limit(0), rules).count() == 0


def test_url_filter_many_seeds(spark):
    from kontor.llm.url_filter import host_edges, judge_pages, personalised_rank

    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(f"http://bad{i}.com/de/1", "") for i in range(2500)] + [(f"http://bad{i}.com/other", "") for i in range(2500)]
    rows += [(f"http://linker{i}.net/", link(f"bad{i}.com")) for i in range(1, 50)]
    rows += [(f"http://chain{i}.net/", link(f"chain{i - 1}.net" if i else "bad0.com")) for i in range(15)]
    out = judge_pages(spark.createDataFrame(rows, "url string, html string").coalesce(2), {"com/de/": "block"}).collect()
    assert len(out) == len(rows) and {r["verdict"] for r in out} == {"block"}
    # a host's score is the same beside 2,500 seeds as beside one
    assert all(math.isclose(r["distrust"], 0.15 * 0.85, abs_tol=1e-6) for r in out if r["host"].startswith("linker"))
    # against the linear system; a cycle, hosts without links, and two seeds
    pages = spark.createDataFrame([("x://a/", link("b", "c")), ("x://b/", link("a")), ("x://c/", link("d")), ("x://e/", link("a", "d"))], "url string, html string")
    got = {r["host"]: r["rank"] for r in personalised_rank(host_edges(pages), spark.createDataFrame([("a",), ("e",)], "host string"), damping=0.4).collect()}
    m = np.zeros((5, 5))
    for i, to in enumerate(((1, 2), (0,), (3,), (), (0, 3))):
        m[list(to), i] = 1 / max(1, len(to))
    want = np.linalg.solve(np.eye(5) - 0.4 * m, 0.6 * np.array([1, 0, 0, 0, 1]))
    assert np.allclose([got[h] for h in "abcde"], want, rtol=0, atol=1e-6)


def test_fm_index():
    from kontor.llm.fm_index import FMIndex

    rng = np.random.default_rng(5)
    for t in range(40):
        v, s = rng.integers(0, 5, rng.integers(0, 120)), 5
        p, n = rng.integers(1, s, (15, 6)), rng.integers(1, 7, 15)
        for depth in (None, 6):
            fm = FMIndex(v, s, depth=depth)
            for row, k, a, b in zip(p, n, *fm.search(p, n), strict=True):
                want = [i for i in range(len(v) - k + 1) if (v[i : i + k] == row[6 - k :]).all()]
                assert len(want) == max(0, b - a)
                if depth is None and want:
                    assert sorted(fm.locate(np.arange(a, b))) == want


def test_words_match_regex():
    from kontor.llm.words import ALNUM_OR_HIGH, cut_words

    texts = ["Ab c", None, "", "é-x\u00a0y 9", "  tail "]
    got = {}
    for w in cut_words(pa.array(texts), ALNUM_OR_HIGH, fold=True, chunk_bytes=4):
        for r, a, b in zip(w.row, w.start, w.end, strict=True):
            got.setdefault(w.first + int(r), []).append(bytes(w.data[a:b]).decode())
    assert got == {0: ["Ab", "c"], 3: ["é", "x\u00a0y", "9"], 4: ["tail"]}

