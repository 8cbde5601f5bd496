"""The most alike of very many names, whether or not two names share a word: exact, in blocks of names against blocks of known ones."""

from __future__ import annotations

import bisect
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.scratch import scratch_table

#: Known names, and names at most, that one task compares; names that a task goes through at once, for each 64 characters of the longest.
KNOWN_ROWS, NAME_ROWS, AT_ONCE = 32_768, 32_768, 4096
#: Parts into which names are cut where they are few.
LEAST_PARTS = 32


def sorted_words(c: Column) -> Column:
    """The distinct words of a name in order, a blank between them."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))), " ")


class Asking:
    """Names that are gone through together: ``at``, their places among all of the task; where each character is in them, as bits; and their scores so far."""

    def __init__(self, at: np.ndarray, n: np.ndarray, places: dict[str, np.ndarray]) -> None:
        self.at, self.n, self.places, self.as_of, self.best, self.most = at, n, places, -1, np.zeros(0), {}

    def some(self, keep: np.ndarray) -> Asking:
        return Asking(self.at[keep], self.n[keep], {c: p[:, keep] for c, p in self.places.items()})

    def refresh(self, best: np.ndarray, as_of: int) -> None:
        if self.as_of != as_of:
            self.as_of, self.best, self.most = as_of, best[self.at], {}

    def most_left(self, m: int, bits: int) -> np.ndarray:
        """How many of the bits may be left over by a known name of ``m`` characters that is as good as the best so far."""
        if m not in self.most:
            left = bits - np.maximum(0, -(-self.best * (self.n + m) // 200))
            self.most[m] = np.maximum(left, -1).astype(np.int8 if bits == 64 else np.int32)
        return self.most[m]


def places_of(texts: list[str], limbs: int) -> dict[str, np.ndarray]:
    """For each character, its places in the texts: bits in (limbs, texts) numbers of 64."""
    width = 64 * limbs
    codes = np.full((len(texts), width), 2**32 - 1, np.uint32)
    for i, t in enumerate(texts):
        codes[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {chr(c): np.ascontiguousarray(np.packbits(codes == c, axis=1, bitorder="little").view("<u8").T) for c in np.unique(codes) if c != 2**32 - 1}


def one_more(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The bits of the longest common subsequence after one more character, which is at ``p``: a bit is 0 where the subsequence grows."""
    hit = v & p
    if len(v) == 1:
        return (v + hit) | (v ^ hit)
    out, carry = np.empty_like(v), np.zeros(v.shape[1], np.uint64)
    for i in range(len(v)):
        s = v[i] + hit[i]
        over = s < hit[i]
        t = s + carry
        carry, out[i] = (over | (t < s)).astype(np.uint64), t
    return out | (v ^ hit)


def left_over(v: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(v)
    return ones[0].view(np.int8) if len(v) == 1 else ones.sum(axis=0, dtype=np.int32)


def most_alike(texts: list[str], best: np.ndarray, holder: np.ndarray, known: list[str], ranks: np.ndarray) -> None:
    """Raises ``best``, whole numbers of 0 to 100 (-1: none), and sets ``holder`` to the rank of the known text that a text is most alike, ties to the lowest rank.

    Likeness is twice the longest common subsequence in both lengths; texts that share a word are no pair here. ``known``, in order, is gone through as a tree of beginnings, all
    texts at once; below a beginning go on those that could still reach their best.
    """
    words = [set(t.split(" ")) for t in texts]
    lengths = np.array([len(t) for t in texts])
    sizes = np.array([len(k) for k in known])
    by_limbs = np.maximum(1, -(-lengths // 64))
    changes = 0
    for limbs in np.unique(by_limbs):
        mine, step, bits = np.flatnonzero(by_limbs == limbs), max(1, AT_ONCE // int(limbs)), 64 * int(limbs)
        for at in (mine[i : i + step] for i in range(0, len(mine), step)):
            every = Asking(at, lengths[at], places_of([texts[i] for i in at], int(limbs)))
            todo = [(0, len(known), 0, np.full((int(limbs), len(at)), 2**64 - 1, np.uint64), every)]
            while todo:
                lo, hi, depth, v, asking = todo.pop()
                first, last = known[lo], known[hi - 1]
                common = len(commonprefix((first, last)))
                for ch in first[depth:common]:
                    if ch in asking.places:
                        v = one_more(v, asking.places[ch])
                asking.refresh(best, changes)
                if hi - lo >= 16:
                    longest, got = int(sizes[lo:hi].max()), bits - left_over(v).astype(np.int64)
                    top = np.minimum(got + longest - common, asking.n)
                    # the likest that may follow is as long as what it needs for ``top``
                    could = 200 * top >= asking.best * (asking.n + np.maximum(int(sizes[lo:hi].min()), common + top - got))
                    some = np.count_nonzero(could)
                    if not some:
                        continue
                    if hi - lo >= 128 and some < 0.6 * len(could):
                        keep = np.flatnonzero(could)
                        v, asking = v[:, keep], asking.some(keep)
                        asking.refresh(best, changes)
                if len(first) == common:
                    left = left_over(v)
                    hits = np.flatnonzero(left <= asking.most_left(common, bits))
                    if len(hits):
                        who, score = asking.at[hits], 200 * (bits - left[hits].astype(np.int64)) // np.maximum(1, asking.n[hits] + common)
                        better = (score > best[who]) | ((score == best[who]) & (ranks[lo] < holder[who]))
                        its = set(first.split(" "))
                        better[better] = [words[i].isdisjoint(its) or not first for i in who[better]]
                        if better.any():
                            best[who[better]], holder[who[better]] = score[better], ranks[lo]
                            changes += 1
                    lo += 1
                while lo < hi:
                    end = bisect.bisect_right(known, known[lo][common], lo, hi, key=lambda t: t[common])  # noqa: B023
                    todo.append((lo, end, common, v, asking))
                    lo = end


def best_of_block(names: pa.Table, known: pa.Table) -> pa.Table:
    """(name, match, score) of the names for which a known one of the block is better than the match that they have."""
    schema = pa.schema([("name", pa.string()), ("match", pa.string()), ("score", pa.float64())])
    if not len(names) or not len(known):
        return schema.empty_table()
    pairs = sorted(zip(known["known_text"].to_pylist(), known["known"].to_pylist(), strict=True))
    order = sorted(m for _, m in pairs)
    rank = {m: 2 * i + 1 for i, m in enumerate(order)}
    rows = sorted(zip(*[names[c].to_pylist() for c in ("text", "name", "match", "score")], strict=True))
    best = np.array([-1 if s is None else int(s) for *_, s in rows], np.int64)
    holder = np.array([0 if m is None else rank.get(m, 2 * bisect.bisect_left(order, m)) for *_, m, _ in rows], np.int64)
    before = best.copy(), holder.copy()
    most_alike([r[0] for r in rows], best, holder, [x for x, _ in pairs], np.array([rank[m] for _, m in pairs]))
    new = np.flatnonzero((best != before[0]) | (holder != before[1]))
    return pa.table([[rows[i][1] for i in new], [order[(holder[i] - 1) // 2] for i in new], best[new].astype(float)], schema=schema)


def in_ranges(df: DataFrame, by: str, parts: int, name: str) -> DataFrame:
    """``df`` plus ``name``, the number of its range of ``by``."""
    return scratch_table(df.repartitionByRange(parts, by).withColumn(name, F.spark_partition_id()), "likeness-ranges")


def against_all(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, match, score): ``names`` (name, match, score; null: none yet) with the known name (``match``) that is more alike, or as alike and earlier in the alphabet, among those that share no word with it.

    Every name meets every known one: ranges of names and of known names, by their words in order, meet in one task each, where both have a bounded number of rows.
    """
    x = names.select("name", "match", "score", sorted_words(F.col("name")).alias("text"))
    y = known.groupBy(sorted_words(F.col("match")).alias("known_text")).agg(F.min("match").alias("known"))
    x, y = scratch_table(x, "likeness-names"), scratch_table(y, "likeness-known")
    n = x.count()
    parts, chunks = max(-(-n // NAME_ROWS), min(LEAST_PARTS, n // 1024 + 1)), y.count() // KNOWN_ROWS + 1
    x, y = in_ranges(x, "text", parts, "part"), in_ranges(y, "known_text", chunks, "chunk")
    sides = x.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))), y.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    a, b = (df.repartition(4 * parts * chunks, "part", "chunk").groupBy("part", "chunk") for df in sides)
    found = a.cogroup(b).applyInArrow(best_of_block, "name string, match string, score double")
    both = found.unionByName(x.where("match is not null").select("name", "match", "score"))
    return both.groupBy("name").agg(F.min_by(F.struct("match", "score"), F.struct(-F.col("score"), "match")).alias("m")).select("name", "m.match", "m.score")
