"""Substring deduplication: word windows that occur more than once anywhere, by an FM-index per shard.

Shards are dealt by content, so that no shard must see all documents. Every window of ``window`` words has an anchor, the
smallest hash of the ``anchor`` words long runs in it; equal windows have equal anchors. A document is cut into segments, the
maximal runs of windows of one anchor, and a segment goes to its anchor's shard if that anchor occurs again at all. Equal
segments travel once, with their number. In its shard, each segment is streamed against an FM-index of all of them: the
backward search gives for a word how long a match ends there that occurs twice or more (a matching statistic). Where
that is a window or longer, the match is reported, and with it all its windows; where it is shorter, the windows around it are unique. Windows that this
decides are not searched for.

An anchor with very many different segments (a passage that many documents share, in as many surroundings) would fill one
shard with surroundings. Its segments' windows are added up by their hash first: what comes once is no repeat, and of all others, the same few in most documents, each
goes to the shard once, with its number. The shard's index then decides as it does for all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from kontor.llm.common import bucketed_table, forget_name, fresh, scratch_table
from kontor.llm.decontaminate import spread
from kontor.llm.fm_index import FMIndex
from kontor.llm.words import GOLDEN, NOT_SPACE, Words, cut_words, gram_hashes, mix64, powers

MOST_BUCKETS = 100_000  # what Spark allows for a table
LONGEST = 64  # windows in a segment; a longer run of one anchor (a text that repeats itself) makes several


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def cut_segments(w: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Segments of the rows of ``w``: anchor, hash of all the segment's words, row, first word in the row, number of windows, how often the anchor is in it."""
    m = len(w.hash) - window + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    grams, at = gram_hashes(w, anchor)
    value = np.full(len(w.hash) - anchor + 1, np.iinfo(np.uint64).max, np.uint64)
    value[at] = grams
    low = sliding_min(value, window - anchor + 1)
    whole = w.row[:m] == w.row[window - 1 :]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (low[1:] != low[:-1]) | (w.row[1:m] != w.row[: m - 1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | new[1:]
    begin, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    pieces = -(-(end - begin) // LONGEST)
    begin, end = spread(np.zeros(len(begin), np.int64), pieces) * LONGEST + np.repeat(begin, pieces), np.repeat(end, pieces)
    end = np.minimum(end, begin + LONGEST)
    up, down = powers(len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * up[: len(w.hash)], out=total[1:])
    content = mix64((total[end + window - 1] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * GOLDEN)
    row = w.row[begin]
    n_grams = end - begin + window - anchor
    same = value[spread(begin, n_grams)] == np.repeat(low[begin], n_grams)
    times = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(n_grams)[:-1]])) if len(begin) else begin
    return low[begin], content, row, begin - w.rows()[row], end - begin, times


SEGMENT = "anchor long, content long, id long, start int, n int, times int"


def segments(df: DataFrame, id_: str, text: str, window: int, anchor: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in cut_words(batch.column(1)):
                low, content, row, start, n, times = cut_segments(w, window, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[w.first + row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(times.astype(np.int32))], names=["anchor", "content", "id", "start", "n", "times"])

    return df.select(id_, text).mapInArrow(scan, SEGMENT)


def repeated_in_shard(texts: pa.Array, n_windows: np.ndarray, weight: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and word spans (from, to) covered by windows whose sequence occurs twice or more, ``weight`` times each row, over all rows."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for w in cut_words(texts):
        hashes.append(w.hash)
        rows.append(w.row + w.first)
    hashed, row = np.concatenate(hashes), np.concatenate(rows)
    kinds, number = np.unique(hashed, return_inverse=True)
    first = np.searchsorted(row, np.arange(len(texts)))
    place = np.arange(len(row)) + row + 1  # a separator before each row
    symbols, own = np.zeros(len(row) + len(texts), np.int64), np.zeros(len(row) + len(texts) + 1, np.int64)
    symbols[place], own[place] = number + 1, weight[row]
    index = FMIndex(symbols, len(kinds) + 1, depth=window + int(n_windows.max(initial=0)))
    upto = np.concatenate([[0], np.cumsum(own[index.suffixes])])  # all that the suffixes' places are needed for
    del index.suffixes
    cover = np.zeros(len(symbols) + 1, np.int64)
    # Runs of windows not yet decided: first and last one's place, and the one probed, which is extended backwards from its end, one
    # word a step, while it occurs twice. If the longest match is shorter than a window, each window from the probed one to the
    # last that holds the match and the word before it is unique; else all windows in the match are repeats. What is left on either side is probed next.
    begin = place[first] if len(place) else np.zeros(0, np.int64)
    left, right = begin, begin + n_windows - 1
    probe = right
    length, low, high = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), np.full(len(left), index.size, np.int64)
    while len(left):
        a, b = index.extend(symbols[probe + window - 1 - length], low, high)
        again = upto[b] - upto[a] >= 2
        length, low, high = length + again, np.where(again, a, low), np.where(again, b, high)
        ended = ~again | (probe + window - length == left)
        l, r, s, n = left[ended], right[ended], probe[ended], length[ended]
        repeat, start = n >= window, s + window - n
        np.add.at(cover, start[repeat], 1)
        np.add.at(cover, s[repeat] + window, -1)
        before = np.where(repeat, start, s) - 1
        behind = np.where(repeat, s + 1, start)
        # a unique stretch is likely followed by more of it: the next probe is as far on as this match was short
        probes = np.concatenate([np.where(repeat, before, np.maximum(l, before + 1 - (window - n))), np.where(repeat, (behind + r) // 2, behind)])
        l, r = np.concatenate([l, behind]), np.concatenate([before, r])
        more, on = l <= r, ~ended
        n_new = int(more.sum())
        left, right, probe = (np.concatenate([x[on], y[more]]) for x, y in ((left, l), (right, r), (probe, probes)))
        length, low = (np.concatenate([x[on], np.zeros(n_new, np.int64)]) for x in (length, low))
        high = np.concatenate([high[on], np.full(n_new, index.size, np.int64)])
    inside = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    which = np.searchsorted(begin, starts, side="right") - 1
    return which, starts - begin[which], ends - begin[which]


def find_repeats(df: DataFrame, *, text: str = "text", window: int = 35, anchor: int = 8, shard_words: int = 400_000, hot_segments: int = 2000, stable_input: bool = False) -> DataFrame:
    """All rows and columns of ``df`` plus ``repeats``: merged spans (first word, word behind the last) of words to remove.

    Words are what stands between ASCII spaces, unchanged, compared by 64-bit hashes. A word is removed if a window of
    ``window`` words of its row covers it whose word sequence also starts anywhere else, in the same row too; all
    occurrences are reported, and windows are judged on the input alone.

    Shuffles: anchors' counts; segments of anchors that occur again; their texts, by segment; and the rows by number, once, into a table in
    as many buckets as there are shuffle partitions, to cut those texts and to get the spans. A shard holds about ``shard_words`` words. Of anchors with over
    ``hot_segments`` different segments, what can be repeated is told by the windows' hashes first, each added up before its exchange; the result does not depend on it. ``stable_input``: ``df`` reads files, and each partition gives
    the same rows again; else it is written to the shared scratch folder first.

    Edge cases: null and empty texts, and texts of fewer words than a window, have no spans; repeated rows are each other's
    repeats; an empty table gives no rows; an existing column ``repeats`` is replaced.
    """
    df = df.drop("repeats")
    if not stable_input:
        df = scratch_table(df, "substring-input")
    (id_,) = fresh(df, "_row")
    rows = df.withColumn(id_, F.monotonically_increasing_id())
    found = segments(rows, id_, text, window, anchor)
    again = found.groupBy("anchor").agg(F.sum("times").alias("k")).where("k > 1").select("anchor")
    candidates = scratch_table(found.drop("times").join(again, "anchor", "left_semi"), "substring-candidates")
    kinds = candidates.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "start", "n")).alias("first"))
    kinds = scratch_table(kinds.select("anchor", "content", "k", "first.*"), "substring-segments")
    per_anchor = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    hot = scratch_table(per_anchor.where(F.col("kinds") > hot_segments).select("anchor", F.lit(True).alias("hot")), "substring-hot")
    size = kinds.join(hot, "anchor", "left_anti").agg(F.coalesce(F.sum(F.col("n") + window), F.lit(0))).first()[0]
    n_shards = max(1, -(-size // shard_words))
    wanted = kinds.join(hot, "anchor", "left").select("id", F.struct("start", "n", "anchor", "content", "k", F.coalesce("hot", F.lit(False)).alias("hot")).alias("s"))
    wanted = wanted.groupBy("id").agg(F.collect_list("s").alias("segments"))
    # the texts move once: both joins by number find them in their buckets
    buckets = min(MOST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    moved = forget_name(bucketed_table(rows, "substring_rows", id_, buckets))
    of_row, segments_of, spans_of = fresh(moved, "_of_row", "_segments", "_spans_of")
    wanted = wanted.toDF(of_row, segments_of)
    names = [*moved.columns, of_row, segments_of]
    texts_at, segments_at = names.index(text), len(names) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(texts_at), batch.column(segments_at)
            for i in range(batch.num_rows):
                words = texts[i].as_py().encode().split()
                anchors, contents, ns, ks, parts, windows = [], [], [], [], [], []
                for s in lists[i].as_py():
                    part = words[s["start"] : s["start"] + s["n"] + window - 1]
                    anchors.append(s["anchor"])
                    contents.append(s["content"])
                    ns.append(s["n"])
                    ks.append(s["k"])
                    parts.append(b" ".join(part))
                    windows.append([xxh3_64_intdigest(b" ".join(part[j : j + window])) - (1 << 63) for j in range(s["n"])] if s["hot"] else None)
                yield pa.RecordBatch.from_arrays([pa.array(windows, pa.list_(pa.int64())), pa.array(anchors, pa.int64()), pa.array(contents, pa.int64()), pa.array(ns, pa.int32()), pa.array(ks, pa.int64()), pa.array(parts, pa.binary()).cast(pa.string())], names=["windows", "anchor", "content", "n", "k", "body"])

    bodies = moved.join(wanted, F.col(id_) == F.col(of_row)).select(*names).mapInArrow(cut, "windows array<long>, anchor long, content long, n int, k long, body string")
    any_hot = not hot.isEmpty()
    if any_hot:
        bodies = scratch_table(bodies, "substring-bodies")

    def search(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        row, begin, end = repeated_in_shard(shard["body"], shard["n"].to_numpy().astype(np.int64), shard["k"].to_numpy(), window)
        return pa.table({"anchor": shard["anchor"].to_numpy()[row], "content": shard["content"].to_numpy()[row], "begin": pa.array(begin, pa.int32()), "end": pa.array(end, pa.int32())})

    def decided(texts: DataFrame, n_shards: int) -> DataFrame:
        """(anchor, content, begin, end): the repeats in rows (anchor, content, n, k, body), each anchor's in its shard."""
        dealt = texts.select("anchor", "content", "n", "k", "body", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).alias("shard"))
        return dealt.groupBy("shard").applyInArrow(search, "anchor long, content long, begin int, end int")

    hits = decided(bodies.where("windows is null"), n_shards)
    if any_hot:
        crowded = bodies.where("windows is not null")
        single = crowded.select("anchor", "content", "k", F.posexplode("windows").alias("start", "window"))
        # equal windows have one anchor, so all of them are here; one of each stands for all
        twice = single.groupBy("window").agg(F.sum("k").alias("k"), F.min(F.struct("anchor", "content", "start")).alias("one")).where("k > 1")
        twice = scratch_table(twice.select("window", "k", "one.*"), "substring-windows")
        words = F.slice(F.split("body", " "), F.col("start") + 1, window)
        texts = twice.join(crowded.select("anchor", "content", "body"), ["anchor", "content"]).select("anchor", F.col("window").alias("content"), F.lit(1).alias("n"), "k", F.array_join(words, " ").alias("body"))
        again = decided(texts, max(1, -(-twice.count() * (window + 1) // shard_words))).select(F.col("content").alias("window"))
        hits = hits.unionByName(single.join(again, "window", "left_semi").select("anchor", "content", F.col("start").alias("begin"), (F.col("start") + window).alias("end")))
    spans = candidates.join(hits, ["anchor", "content"]).select("id", F.struct((F.col("start") + F.col("begin")).cast("long").alias("start"), (F.col("start") + F.col("end")).cast("long").alias("end")).alias("s"))
    spans = spans.groupBy("id").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
            F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(s))),
    )
    spans = spans.select(F.col("id").alias(spans_of), merged.alias("repeats"))
    out = moved.join(spans, F.col(id_) == F.col(spans_of), "left").drop(id_, spans_of)
    return out.withColumn("repeats", F.coalesce("repeats", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")))


def keep_words(df: DataFrame, *, text: str = "text", spans: str = "repeats") -> DataFrame:
    """``df`` plus n_words, n_removed (long) and ``kept``: the words outside ``spans``, joined by one space. Null text: no words."""
    df = df.drop("n_words", "n_removed", "kept")
    schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(names.index(text)).to_pylist(), batch.column(names.index(spans)).to_pylist()
            n, removed, kept = [], [], []
            for t, cuts in zip(texts, lists, strict=True):
                words = (t or "").encode().split()
                n.append(len(words))
                for c in reversed(cuts or []):
                    del words[c["start"] : c["end"]]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    return df.mapInArrow(scan, schema)
