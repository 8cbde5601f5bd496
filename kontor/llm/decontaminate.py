"""Benchmark decontamination with an FM-index per training shard.

A shard is one Arrow batch of documents. Its words become numbers of the benchmark's vocabulary; words outside it cannot
be part of a match and act as separators, and runs shorter than the shortest phrase are left out, so that the index holds
what could match. All phrases are searched backwards at once, their places located by sampled suffixes, and the spans of
overlapping and adjacent matches merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm.common import fresh
from kontor.llm.fm_index import FMIndex
from kontor.llm.words import ALNUM_OR_HIGH, cut_words

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("word_spans", SPAN), T.StructField("byte_spans", SPAN),
])


class Phrases:
    """The windows of some benchmark items: distinct word sequences, and which items hold each."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int) -> None:
        words = [x for w in cut_words(pa.array(texts, pa.string()), ALNUM_OR_HIGH, fold=True) for x in np.split(w.hash, w.rows()[1:-1])]
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, w in enumerate(words):
            if len(w):
                number = (np.searchsorted(self.vocabulary, w) + 1).astype(np.int32)
                view = np.lib.stride_tricks.sliding_window_view(number, min(window, len(w)))
                rows.append(np.pad(view, ((0, 0), (window - view.shape[1], 0))))
                owner.append(np.full(len(view), item))
        self.windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        which, owner = np.asarray(which).ravel(), np.concatenate(owner)
        self.lengths = (self.windows > 0).sum(axis=1)
        by = np.argsort(which, kind="stable")
        self.owners, self.owner_cuts = owner[by], np.searchsorted(which[by], np.arange(len(self.windows) + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1; 0 for other words."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0) if len(self.vocabulary) else np.zeros(len(hashes), np.int64)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of ``start[i], start[i] + 1, ...``, ``n[i]`` of each."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)


def find_phrases(texts: pa.Array, phrases: Phrases) -> list[dict]:
    """:data:`HITS` for each text: one FM-index over all of them."""
    n = len(texts)
    shortest = int(phrases.lengths.min()) if len(phrases.lengths) else 0
    n_words = np.zeros(n, np.int64)
    kept: list[tuple[np.ndarray, ...]] = []  # numbers, row, place in the row, begin and end byte; a separator before each run
    for w in cut_words(texts, ALNUM_OR_HIGH, fold=True):
        cuts = w.rows()
        n_words[w.first : w.first + w.n_rows] = np.diff(cuts)
        if not shortest:
            continue
        number = phrases.numbers(w.hash)
        known = np.concatenate([[False], number > 0, [False]])
        new = known[1:-1].copy()
        new[1:] &= ~known[1:-2] | (w.row[1:] != w.row[:-1])
        last = known[1:-1].copy()
        last[:-1] &= ~known[2:-1] | (w.row[1:] != w.row[:-1])
        begin, end = np.flatnonzero(new), np.flatnonzero(last) + 1
        begin, end = begin[end - begin >= shortest], end[end - begin >= shortest]
        if len(begin):
            take = spread(begin - 1, end - begin + 1)
            gap = np.zeros(len(take), bool)
            gap[np.concatenate([[0], np.cumsum(end - begin + 1)[:-1]])] = True
            row = w.row[take]
            # byte places count from the row's own first byte
            byte = w.at[row]
            kept.append((np.where(gap, 0, number[take]), row + w.first, take - cuts[row], w.start[take] - byte, w.end[take] - byte))
    out = [{"n_words": int(c), "n_hit": 0, "items": [], "word_spans": [], "byte_spans": []} for c in n_words]
    if not kept:
        return out
    number, row, place, start, end = (np.concatenate(x) for x in zip(*kept, strict=True))
    index = FMIndex(number, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.windows, phrases.lengths)
    found = np.flatnonzero(high > low)
    count = (high - low)[found]
    at = index.locate(spread(low[found], count))
    which = np.repeat(found, count)
    cover = np.zeros(len(number) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[which], -1)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    new = np.ones(len(hit), bool)
    new[1:] = (row[hit[1:]] != row[hit[:-1]]) | (place[hit[1:]] != place[hit[:-1]] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(hit)]])[: len(first)] - 1
    for a, b in zip(hit[first], hit[last], strict=True):
        r = out[row[a]]
        r["n_hit"] += int(place[b] - place[a] + 1)
        r["word_spans"].append({"start": int(place[a]), "end": int(place[b]) + 1})
        r["byte_spans"].append({"start": int(start[a]), "end": int(end[b])})
    n_owned = np.diff(phrases.owner_cuts)[which]
    pairs = np.unique(np.stack([np.repeat(row[at], n_owned), phrases.owners[spread(phrases.owner_cuts[which], n_owned)]]), axis=1)
    for r, item in pairs.T:
        out[r]["items"].append(phrases.ids[item])
    return out


def merge_hits(a: dict, b: dict) -> dict:
    """The hits of two blocks of items in one document."""
    out = {"n_words": a["n_words"], "items": [*a["items"], *b["items"]]}
    for kind in ("word_spans", "byte_spans"):
        spans: list[dict] = []
        for s in sorted([*a[kind], *b[kind]], key=lambda s: (s["start"], s["end"])):
            if spans and s["start"] <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], s["end"])
            else:
                spans.append(dict(s))
        out[kind] = spans
    return out | {"n_hit": sum(s["end"] - s["start"] for s in out["word_spans"])}


def find_benchmark(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """All rows and columns of ``df`` plus ``contamination``: n_words, n_hit, items (ids as strings) and merged spans in words and bytes.

    Words are runs of digits, letters a-z (A-Z folded) and non-ASCII characters. A phrase is ``window`` consecutive words of an item; an
    item of fewer words, but not none, is one phrase. ``byte_spans`` are places in the UTF-8 text, from the first to behind
    the last hit word. Words are compared by 64-bit hashes.

    Items are broadcast in blocks of at most ``block_bytes`` of text (an item larger than that is a block of its own); each
    further block is one more pass over the documents' columns. No shuffle.

    Edge cases: null and empty texts have no words and no hits; items without words, or with null text, match nothing; a null item id is the
    string ``null``; several items of one id count once; an empty benchmark gives no hits; an empty ``df`` gives no rows;
    an existing column ``contamination`` is replaced.
    """
    df = df.drop("contamination")
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    schema = T.StructType([*df.schema.fields, T.StructField("contamination", HITS)])
    out = df
    for b in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        rows = some.collect()
        phrases = df.sparkSession.sparkContext.broadcast(Phrases([r[0] for r in rows], [r[1] for r in rows], window))
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))] + [(k, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) for k in ("word_spans", "byte_spans")])

        def scan(batches: Iterator[pa.RecordBatch], phrases=phrases, again=b > 0, kind=kind) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = find_phrases(batch.column(batch.schema.get_field_index(text)), phrases.value)
                columns = batch.columns
                if again:
                    hits = [merge_hits(x, y) for x, y in zip(columns[-1].to_pylist(), hits, strict=True)]
                    columns = columns[:-1]
                for h in hits:
                    h["items"] = sorted(set(h["items"]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, kind)], names=[f.name for f in schema.fields])

        out = out.mapInArrow(scan, schema)
    return out


def remove_spans(df: DataFrame, *, text: str = "text", spans: str = "contamination.byte_spans") -> DataFrame:
    """``df`` with the bytes of ``spans`` cut out of ``text``; what stood on both sides is parted by one space. Built-in functions."""
    data = F.col(text).cast("binary")
    (ends,) = fresh(df, "_ends")
    whole = F.concat(F.array(F.lit(0).cast("long")), F.col(f"{spans}.end"))
    upto = F.concat(F.col(f"{spans}.start"), F.array(F.octet_length(text).cast("long")))
    part = F.zip_with(whole, upto, lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return df.withColumn(ends, F.when(F.size(F.col(spans)) > 0, F.array_join(part, " ")).otherwise(F.col(text))).drop(text).withColumnRenamed(ends, text)
