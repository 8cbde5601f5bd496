"""SimHash near duplicates by anchor points: fingerprints meet at the words of a covering code."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import drop_scratch, fresh, scratch_table
from kontor.llm.components import connected_components

CHUNK_BYTES = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Links differ in at most so many bits.
THRESHOLD = 2

# The generator of the binary Golay code, of 23 bits, of which 12 are free; every word is within 3 bits of exactly one code word.
GENERATOR, LENGTH, CHECKS, RADIUS = 0b110001110101, 23, 11, 3
BLOCKS = 2
ANCHOR_BITS = BLOCKS * LENGTH

#: Homes that one cell of an anchor has at most, before their number is more than a 65,536th of all.
LEAST_CELL = 1 << 16
MOST_SPLIT = 1 << 16
#: Pairs that are compared at once, and links that are gathered before they are made a forest.
PAIRS = 1 << 20
GATHERED = 1 << 21
#: Rows of an output batch.
BATCH = 1 << 16


def pieces(text: bytes, chunk_bytes: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, folded, in pieces that end between words."""
    at = 0
    while at < len(text):
        end = SPACE.search(text, at + chunk_bytes)
        stop = end.start() if end else len(text)
        yield text[at:stop].lower().split()
        at = stop


def shingle_hashes(words: list[bytes], n: int) -> list[int]:
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip((end - size)[: len(words) - n + 1].tolist(), end[n - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """64 bits, each 1 if it is in more than half of the hashes of all runs of ``n`` words (of all words, if they are fewer); 0 without words."""
    ones, total, last = np.zeros(64, np.int64), 0, []
    for words in pieces(text or b""):
        last = last + words
        if len(last) >= n:
            hashes = np.array(shingle_hashes(last, n), ">u8")
            for i in range(0, len(hashes), BATCH):
                ones += np.unpackbits(hashes[i : i + BATCH].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            total, last = total + len(hashes), last[len(last) - n + 1 :]
    if not total:
        if not last:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(last), 42)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint_udf(n: int):  # noqa: ANN201
    @F.pandas_udf("long")
    def apply(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, n) for t in text], np.uint64).view(np.int64))

    return apply


def remainders(x: np.ndarray) -> np.ndarray:
    """Of polynomials over two elements divided by the generator."""
    x = x.copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        x ^= ((x >> bit) & 1) * (GENERATOR << (bit - CHECKS))
    return x


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """By remainder: what leads to the code word within the radius; and of all code words within the radius plus the threshold, what leads there and by how many bits they are beyond the radius.

    The first of the four arrays is the remainder of every single byte of a block, to be added up.
    """
    single = np.stack([remainders(np.arange(256, dtype=np.int64) << (8 * i) & ((1 << LENGTH) - 1)) for i in range(3)])
    masks = np.array([sum(1 << b for b in bits) for k in range(RADIUS + THRESHOLD + 1) for bits in combinations(range(LENGTH), k)], np.int64)
    beyond = np.maximum(np.bitwise_count(masks).astype(np.int64) - RADIUS, 0)
    rest = remainders(masks)
    order = np.lexsort((masks, beyond, rest))
    cuts = np.searchsorted(rest[order], np.arange((1 << CHECKS) + 1))
    to = [masks[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    far = [beyond[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return single, np.array([t[0] for t in to]), to, far


def block_of(x: np.ndarray, i: int) -> np.ndarray:
    return ((x >> np.uint64(i * LENGTH)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)


def rest_of(block: np.ndarray) -> np.ndarray:
    single = code_tables()[0]
    return single[0][block & 255] ^ single[1][block >> 8 & 255] ^ single[2][block >> 16]


def homes(x: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius: the nearest code word of each block."""
    nearest = code_tables()[1]
    blocks = [block_of(x, i) for i in range(BLOCKS)]
    return sum((b ^ nearest[rest_of(b)]) << (i * LENGTH) for i, b in enumerate(blocks))


def visits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``x``, anchor): all anchors at which a fingerprint within the threshold can be at home.

    In each block that is a code word within the radius plus the bits in which the two differ there, and these add up to the threshold at most.
    """
    _, _, to, far = code_tables()
    first, second = block_of(x, 0), block_of(x, 1)
    r, s = rest_of(first), rest_of(second)
    kind = (r << CHECKS) | s
    order = np.argsort(kind, kind="stable")
    cuts = np.flatnonzero(np.diff(kind[order], prepend=-1))
    who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        at = order[a:b]
        p, q = r[at[0]], s[at[0]]
        i, j = np.nonzero(far[p][:, None] + far[q][None, :] <= THRESHOLD)
        change = to[p][i] | (to[q][j] << LENGTH)
        whole = first[at] | (second[at] << LENGTH)
        who.append(np.repeat(at, len(change)))
        where.append((whole[:, None] ^ change[None, :]).ravel())
    return np.concatenate(who), np.concatenate(where)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same connected parts, one for each node but the smallest of its part."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, label[u], label[v])
        np.minimum.at(low, label[v], label[u])
        low = low[low[label]]
        if np.array_equal(low, label):
            break
        label = low
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[some], nodes[label[some]]


@cache
def flips() -> np.ndarray:
    one = [np.uint64(1) << np.uint64(i) for i in range(64)]
    return np.array([0, *one, *[x | y for x, y in combinations(one, 2)]], np.uint64)


def near_pairs(home: np.ndarray, visitor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (visitor, home) that differ in at most ``THRESHOLD`` bits: by comparing, or where homes (sorted) are more, by looking up what is so near to a visitor."""
    if len(home) <= len(flips()):
        step = max(1, PAIRS // len(home))
        for i in range(0, len(visitor), step):
            some = visitor[i : i + step]
            a, b = np.nonzero(np.bitwise_count(some[:, None] ^ home[None, :]) <= THRESHOLD)
            yield some[a], home[b]
    else:
        for i in range(0, len(visitor), PAIRS):
            some = visitor[i : i + PAIRS]
            for flip in flips():
                want = some ^ flip
                at = np.minimum(np.searchsorted(home, want), len(home) - 1)
                hit = home[at] == want
                yield some[hit], want[hit]


class Cell:
    """One cell's homes, and a forest of the links found there so far."""

    def __init__(self) -> None:
        self.home: list[np.ndarray] = []
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.gathered = 0

    def add(self, kind: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the cell, homes first; gives links where very many have come together."""
        n = int(np.searchsorted(kind, 1))
        if n:
            self.home.append(x[:n])
        if n == len(x) or not self.home:
            return
        self.home = [np.unique(np.concatenate(self.home))]
        for a, b in near_pairs(self.home[0], x[n:]):
            keep = a != b
            if not keep.any():
                continue
            self.a.append(a[keep])
            self.b.append(b[keep])
            self.gathered += len(self.a[-1])
            if self.gathered > GATHERED:
                yield from self.links(GATHERED // 2)

    def links(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.a:
            return
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.gathered = [a], [b], len(a)
        if len(a) > keep:
            self.a, self.b, self.gathered = [], [], 0
            yield a, b


def compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (cell, kind, x) in order of cell and kind, a partition's batches one after another."""
    cell, current, found, size = Cell(), None, [], 0

    def out() -> pa.RecordBatch:
        a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        key, kind = batch.column("cell").to_numpy(zero_copy_only=False), batch.column("kind").to_numpy(zero_copy_only=False)
        x = batch.column("x").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(key):
            continue
        cuts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        ends = np.append(cuts[1:], len(key))
        here = np.add.reduceat((kind == 0).astype(np.int64), cuts)
        useful = (here > 0) & (ends - cuts - here > 1)  # beside a home's own visit
        useful[[0, -1]] = True
        for a, b in zip(cuts[useful], ends[useful], strict=True):
            if key[a] != current:
                found.extend(cell.links())
                cell, current = Cell(), key[a]
            found.extend(cell.add(kind[a:b], x[a:b]))
        size = sum(len(f[0]) for f in found)
        if size > BATCH:
            yield out()
            found = []
    found.extend(cell.links())
    if found:
        yield out()


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b) from (x, home), one row a fingerprint: links that connect all fingerprints which differ in at most ``THRESHOLD`` bits, as far as these links lead.

    Anchors are the words of a covering code over 46 of the 64 bits: the Golay code in two blocks, of radius 3 each. A fingerprint is at home at the anchor nearest to it, and
    visits every anchor within the radius plus the threshold, the threshold being shared by the blocks: some 61 of 16.7 million. Two fingerprints that link meet
    at the home of either. An anchor with very many homes is cut into a square of cells: homes go to a row of them, visitors to a column.
    """
    n = prints.count()
    cell_size = max(LEAST_CELL, n // MOST_SPLIT)
    crowded = prints.groupBy("home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_size)
    sides = {r["home"]: int(np.ceil(np.sqrt(r["n"] / cell_size))) for r in crowded.collect()}  # fewer than 65,536
    shared = prints.sparkSession.sparkContext.broadcast((np.array(sorted(sides), np.int64), np.array([sides[k] for k in sorted(sides)], np.int64)))

    def cells(anchor: np.ndarray, x: np.ndarray, kind: int) -> list[np.ndarray]:
        """Rows (cell, kind, x), one for most, one for each of a row or column of cells for those of crowded anchors."""
        names, side = shared.value
        if not len(names):
            return [anchor, np.full(len(x), kind, np.int8), x]
        at = np.minimum(np.searchsorted(names, anchor), len(names) - 1)
        width = np.where(names[at] == anchor, side[at], 1)
        mine = (x % np.uint64(1_000_003)).astype(np.int64) % width
        row = np.repeat(np.arange(len(x)), width)
        other = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
        i, j = (mine[row], other) if kind == 0 else (other, mine[row])
        return [anchor[row] | ((i * width[row] + j) << ANCHOR_BITS), np.full(len(row), kind, np.int8), x[row]]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("x").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), 4096):
                x = every[i : i + 4096]
                who, where = visits(x)
                both = [np.concatenate(c) for c in zip(cells(homes(x), x, 0), cells(where, x[who], 1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(both[2].view(np.int64))], ["cell", "kind", "x"])

    placed = prints.select("x").mapInArrow(spread, "cell long, kind byte, x long")
    return placed.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(compare_cells, "a long, b long")


def home_udf():  # noqa: ANN201
    @F.pandas_udf("long")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(homes(x.to_numpy(np.int64).view(np.uint64)))

    return apply


def simhash_components(df: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 3, keep: tuple[str, ...] | None = None) -> DataFrame:
    """All rows of ``df`` with its columns (or those of ``keep``) plus ``fingerprint`` (16 hex digits) and ``component_id``.

    The fingerprint of a text: bit i is 1 if it is in more than half of the 64-bit hashes (XXH64 of seed 42) of its runs of ``n`` words (between ASCII spaces, A-Z folded), each
    counted as often as it comes. Fingerprints link at ``THRESHOLD`` or fewer differing bits; ``component_id`` is the smallest ``key`` that links reach, the row's own included.
    Only distinct fingerprints are compared, and within a component only as many links are returned by a task as connect it. The columns that are kept are written to the scratch folder.

    Edge cases: with fewer words than ``n`` they are one run; without words, or with null text, the fingerprint is zero, which links like any other. Repeated rows share
    a fingerprint; null keys count only where a component has no other. An empty table gives no rows. Columns of the two names are replaced, any other names are kept.
    """
    df = df.drop("fingerprint", "component_id")
    columns = [c for c in df.columns if keep is None or c in keep]
    x_, key_, least_ = fresh(df, "_x", "_key", "_least")
    described = scratch_table(df.select(*columns, F.col(key).alias(key_), fingerprint_udf(n)(F.col(text).cast("binary")).alias(x_)), "simhash-prints")
    of_print = described.groupBy(F.col(x_).alias("x")).agg(F.min(key_).alias("least"))
    prints = scratch_table(of_print.withColumn("home", home_udf()(F.col("x"))), "simhash-distinct")
    links = scratch_table(near_links(prints).distinct(), "simhash-links")
    parts = scratch_table(connected_components(links).withColumnRenamed("node", "x"), "simhash-parts")
    drop_scratch(links)
    named = prints.select("x", "least").join(parts, "x", "left").withColumn("component", F.coalesce("component", "x"))
    smallest = named.groupBy("component").agg(F.min("least").alias(least_))
    final = named.select("x", "component").join(smallest, "component").select(F.col("x").alias(x_), least_)
    out = described.join(final.hint("merge"), x_)
    return out.select(*columns, F.lower(F.lpad(F.hex(x_), 16, "0")).alias("fingerprint"), F.col(least_).alias("component_id"))
