"""Merkle manifest, SimHash components and fill-in-middle against plain versions, edge cases included."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, fim string, _text string, leaf string, proof string, fingerprint string, _x long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(40)]
    out = [(i, t, f"s{i % 3}", ["en", "de", None][i % 7 % 3], len(t)) for i, t in enumerate(base)]
    out += [(100 + i, base[i % 4], "s0", "en", None) for i in range(12)]
    for i in range(60):  # near copies in a chain
        w = base[i % 5].split()
        w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append((200 + i, " ".join(w), None, "en", 3))
    out += [(400, None, "s0", "xx", 0), (401, "", "s1", "en", 0), (402, " \t ", None, None, 3), (None, "alone and short", "s2", "en", 15), (None, "Two WORDS", None, "en", None)]
    out += [(500, "twice the same row", "s0", "en", 18)] * 3
    out += [(501, "é" * 40 + "日本 Straße 😀 a<b> \n\r\x00 z", "s0", "fr", 1), (502, "has <P> in it", "s0", "fr", 1), (503, "<" * 30 + "S>" * 9, "s0", "fr", 1), (504, "x" * 50, "s0", "fr", 1)]
    out.append((505, "Long " + " ".join(rng.choices(WORDS, k=300_000)) + " é<b>", "s0", "fr", 9))
    return [(*r, "a", "b", "c", "d", "e", 7) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The root, and each leaf's siblings as (hash, left)."""
    paths, at, lane = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(lane) > 1:
        for i, p in enumerate(paths):
            k = at[i] ^ 1
            p.append((lane[k] if k < len(lane) else None, bool(at[i] & 1)))
            at[i] >>= 1
        lane = [sha(*lane[i : i + 2]) for i in range(0, len(lane), 2)]
    return lane[0], paths


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(field, (r[0], r[2], r[3], r[4], r[1])))
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    done = {g: plain_tree([x[2] for x in sorted(trees[g], key=lambda x: x[:3])]) for g in names}
    root, over = plain_tree([done[g][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for x, path in zip(sorted(trees[g], key=lambda x: x[:3]), done[g][1], strict=True):
            out.append((x[3][0], x[2], done[g][0], root, path + over[i]))
    return out


@pytest.mark.parametrize("digits", [None, (1, 2), (2, 1)])
def test_merkle(spark, docs, rows, monkeypatch, digits):
    """Whole trees in one block, and in blocks of four nodes over several levels."""
    from kontor.llm import merkle

    if digits:
        bits, n = digits
        for k, v in {"DIGIT_BITS": bits, "DIGITS": n, "BLOCK_BITS": bits * n, "BLOCK": 1 << bits * n}.items():
            monkeypatch.setattr(merkle, k, v)
    kw = {"fields": ("doc_id", "source", "lang", "n_chars", "text"), "tree": "lang", "order": "doc_id", "keep": ("doc_id",)}
    made = merkle.merkle_manifest(docs, probe={"n_chars": F.col("n_chars") + 1}, **kw)
    made = made.withColumns({"folded": merkle.fold_proof(F.col("leaf"), F.col("proof")), "claimed": merkle.fold_proof(F.col("probe"), F.col("proof"))}).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], str(x[4]))
    got = sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["hash"], s["left"]) for s in r["proof"]]) for r in made], key=key)
    assert got == sorted(plain_manifest(rows), key=key)
    assert all(r["folded"] == r["root"] for r in made)
    unchanged = {r[0] for r in rows if r[4] is None}
    assert all((r["claimed"] == r["root"]) == (r["probe"] == r["leaf"]) for r in made)
    assert {r["doc_id"] for r in made if r["probe"] == r["leaf"]} <= unchanged


def test_merkle_small(spark, docs):
    from kontor.llm.merkle import merkle_manifest

    kw = {"fields": ("doc_id", "text"), "tree": "lang", "order": "doc_id", "keep": ("doc_id", "source")}
    one = merkle_manifest(docs.where("doc_id = 400"), **kw).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == sha("3:400", "-") and one[0]["proof"] == []
    nothing = merkle_manifest(docs.limit(0), **kw)
    assert nothing.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof", "probe"] and nothing.count() == 0


def plain_fingerprint(text, n=3):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    if not words:
        return 0
    runs = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Smallest key reached over fingerprints at two bits or fewer."""
    distinct = sorted(set(p for _, p in prints))
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if (x ^ y).bit_count() <= 2:
                parent[root(x)] = root(y)
    least = {}
    for k, p in prints:
        if k is not None:
            least[root(p)] = min(k, least.get(root(p), k))
    return [(k, f"{p:016x}", least.get(root(p))) for k, p in prints]


ORDER = staticmethod(lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("cell", [1 << 16, 2])
def test_simhash(spark, docs, rows, monkeypatch, cell):
    from kontor.llm import simhash

    monkeypatch.setattr(simhash, "LEAST_CELL", cell)
    got = sorted([tuple(r) for r in simhash.simhash_components(docs.drop("fingerprint"), keep=("doc_id",)).collect()], key=ORDER)
    assert got == sorted(plain_components([(r[0], plain_fingerprint(r[1])) for r in rows]), key=ORDER)
    whole = simhash.simhash_components(docs.withColumn("component_id", F.lit("x")))
    assert sorted(whole.columns) == sorted([*docs.columns, "component_id"]) and whole.count() == len(rows)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_simhash_dense_group(spark):
    """Fingerprints that lie close together, most of them at home at one anchor, against brute force; and a crowded anchor in a square of cells."""
    from kontor.llm import simhash
    from kontor.llm.components import connected_components

    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(300)}
    middle = rng.getrandbits(64)
    while len(prints) < 1300:
        x = middle
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 9])):
            x ^= 1 << b
        prints.add(x)
    prints |= {middle ^ (i << 46) for i in range(1 << 9)}  # one home for all
    want = {int(h, 16): k for k, h, c in plain_components([(x, x) for x in prints]) for k in [c]}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "x long").withColumn("home", simhash.home_udf()(F.col("x")))
    for least in (1 << 16, 50):
        simhash.LEAST_CELL, before = least, simhash.LEAST_CELL
        try:
            parts = {r["node"] % (1 << 64): r["component"] for r in connected_components(simhash.near_links(df)).collect()}
        finally:
            simhash.LEAST_CELL = before
        groups = {}
        for x in prints:
            groups.setdefault(parts.get(x, x), set()).add(x)
        wanted = {}
        for x in prints:
            wanted.setdefault(want[x], set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_covering_code():
    """Every word is within three bits of exactly one anchor in each block, and whatever links meets at a home."""
    from kontor.llm import simhash

    single, nearest, to, far = simhash.code_tables()
    assert len(set(nearest.tolist())) == 2048 and max(int(x).bit_count() for x in nearest) == 3
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    home = simhash.homes(x)
    assert all((int(h) ^ int(v) & (1 << 46) - 1).bit_count() <= 6 for h, v in zip(home, x, strict=True))
    who, where = simhash.visits(x)
    seen = [set(where[who == i].tolist()) for i in range(len(x))]
    assert 50 < len(where) / len(x) < 70
    for flip in rng.choice(simhash.flips(), 60, replace=False):
        assert all(int(h) in s for h, s in zip(simhash.homes(x ^ flip), seen, strict=True))
    few, many = np.unique(x[:50]), np.unique(np.concatenate([x[:50] ^ np.uint64(6), rng.integers(0, 1 << 64, 3000, dtype=np.uint64)]))
    pairs = {(int(a), int(b)) for u, v in simhash.near_pairs(many, few) for a, b in zip(u, v, strict=True)}
    assert pairs == {(int(a), int(b)) for a in few for b in many if (int(a) ^ int(b)).bit_count() <= 2} and len(pairs) >= 50


def test_long_text_in_pieces():
    from kontor.llm.simhash import fingerprint, pieces

    text = "One two\tTHREE four\x0bfive é six " * 50
    assert [w for p in pieces(text.encode(), 64) for w in p] == text.encode().lower().split()
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_fill_in_middle(spark, docs, rows):
    from kontor.llm.fill_middle import fill_in_middle, restore

    unit = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
    out = fill_in_middle(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    got = out.select("doc_id", "fim.*", restore(F.col("fim.output"), F.col("fim.form")).alias("again"), "_text").collect()
    want = []
    for r in rows:
        t = r[1] or ""
        u = unit.findall(t)
        h = hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        low, high = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        output = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append((r[0], len(u), form, *((None, None) if form == "plain" else (len(p), len(m))), output, t, "b"))
    assert sorted(map(tuple, got), key=lambda r: str(r)) == sorted(want, key=lambda r: str(r))
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_skip_list():
    from kontor.llm import fill_middle

    rng = random.Random(0)
    unit = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
    for n in (0, 1, 31, 32, 33, 1023, 1024, 1025, 40_000):
        text = "".join(rng.choices(["ab", "c", " ", "é", "😀", "\n", "K", "K"], k=n))
        lanes = fill_middle.SkipList(text)
        ends = [0, *[m.end() for m in unit.finditer(text)]]
        assert lanes.units == len(ends) - 1
        assert [lanes.code_points(i) for i in range(0, len(ends), max(1, len(ends) // 200))] == ends[:: max(1, len(ends) // 200)] and lanes.code_points(lanes.units) == len(text)


def test_skip_list_in_chunks(monkeypatch):
    from kontor.llm import fill_middle

    monkeypatch.setattr(fill_middle, "CHUNK", 7)
    text = "abcdefgh ij é klmnopqrstuvwxyz" * 30
    ends = [0, *[m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]]
    lanes = fill_middle.SkipList(text)
    assert [lanes.code_points(i) for i in range(len(ends))] == ends
