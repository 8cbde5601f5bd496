"""Language-model scoring by subword lattices.

A word's probability is the sum over all its segmentations into pieces of an existing vocabulary, by a forward recursion
in log space over the word's bytes. The vocabulary and the order of its scores are given; the pieces' probabilities start from a power law over
that order and become expected counts over all segmentations of the training words, each distinct word once, as known words
rarely need the lattice (two forward-backward passes). Words
seen in training also have an arc of their own over the whole word, by absolute discounting; what the discount takes is
what the lattice shares out. Text probability is the product over the words and an end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm.common import fresh, scratch_table
from kontor.llm.words import BYTE_VALUE, FOLD, GOLDEN, NOT_SPACE, cut_words, powers

START = "▁".encode()
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FILTER_BITS = 22
LN10 = float(np.log(10.0))


def piece_hash(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    up, _ = powers(256)
    for i, p in enumerate(pieces):
        b = np.frombuffer(p, np.uint8)
        out[i] = (int((BYTE_VALUE[b] * up[: len(b)]).sum(dtype=np.uint64)) + len(b) * int(GOLDEN)) % (1 << 64)
    return out


@dataclass
class Pieces:
    """A vocabulary as bytes: ``log_p`` of each piece; single bytes are pieces too, so every word has a segmentation."""

    pieces: list[bytes]
    log_p: np.ndarray

    def __post_init__(self) -> None:
        hashed = piece_hash(self.pieces)
        order = np.argsort(hashed)
        self.keys, self.ids = hashed[order], order
        self.longest = max(map(len, self.pieces))
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.index = {p: i for i, p in enumerate(self.pieces)}
        begins = np.array([p.startswith(START) for p in self.pieces])
        self.log_begin = float(np.log(np.exp(self.log_p[begins]).sum()))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are pieces, and those pieces' numbers."""
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        same = self.keys[at] == hashes[maybe]
        return maybe[same], self.ids[at[same]]


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model; probabilities by a power law over the order of its scores (bytes last)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    n = model.get_piece_size()
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        text = model.id_to_piece(i)
        b = bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.encode()
        if b.find(START, 1) < 0:
            found.setdefault(b, float(n) if model.is_byte(i) else min(float(n), -model.get_score(i)))
    for x in range(256):
        found.setdefault(bytes([x]), float(n))
    found.setdefault(START, float(n))
    p = 1 / (np.array(list(found.values())) + 3.0)
    return Pieces(list(found), np.log(p / p.sum()))


def arcs(v: Pieces, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The lattice of words of one length (a row of bytes each): begin, end, the rows that have a piece there, and which."""
    n, length = words.shape
    up, down = powers(length + 1)
    total = np.zeros((n, length + 1), np.uint64)
    np.cumsum(BYTE_VALUE[words] * up[:length], axis=1, out=total[:, 1:])
    out = []
    for end in range(1, length + 1):
        for begin in range(max(0, end - v.longest), end):
            rows, ids = v.find((total[:, end] - total[:, begin]) * down[begin] + np.uint64((end - begin) * int(GOLDEN) % (1 << 64)))
            if len(rows):
                out.append((begin, end, rows, ids))
    return out


def forward(v: Pieces, lattice: list[tuple[int, int, np.ndarray, np.ndarray]], n: int, length: int) -> np.ndarray:
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0.0
    for begin, end, rows, ids in lattice:
        alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[begin, rows] + v.log_p[ids])
    return alpha


def expected_counts(v: Pieces, lattice: list[tuple[int, int, np.ndarray, np.ndarray]], weight: np.ndarray, length: int) -> np.ndarray:
    """How often each piece is expected over all segmentations, words counted ``weight`` times."""
    n = len(weight)
    alpha = forward(v, lattice, n, length)
    beta = np.full((length + 1, n), -np.inf)
    beta[length] = 0.0
    out = np.zeros(len(v.pieces))
    for begin, end, rows, ids in sorted(lattice, key=lambda a: (-a[0], -a[1])):
        step = v.log_p[ids] + beta[end, rows]
        np.add.at(out, ids, np.exp(alpha[begin, rows] + step - alpha[length, rows]) * weight[rows])
        beta[begin, rows] = np.logaddexp(beta[begin, rows], step)
    return out


def long_word(v: Pieces, word: bytes, counts: np.ndarray | None = None) -> float:
    """The forward recursion of one word, in memory in proportion to its length; ``counts`` gets its expected pieces added. Arcs are looked up again on the way back."""
    n = len(word)

    def ending(b: int) -> list[tuple[int, int]]:
        return [(a, i) for a in range(max(0, b - v.longest), b) if (i := v.index.get(word[a:b])) is not None]

    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0.0
    for b in range(1, n + 1):
        alpha[b] = np.logaddexp.reduce([alpha[a] + v.log_p[i] for a, i in ending(b)])
    if counts is not None:
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0.0
        for b in range(n, 0, -1):  # all arcs that begin at b have been added to beta[b]
            for a, i in ending(b):
                step = v.log_p[i] + beta[b]
                counts[i] += np.exp(alpha[a] + step - alpha[n])
                beta[a] = np.logaddexp(beta[a], step)
    return float(alpha[-1])


LONG, LONG_TEXT = 192, 1 << 16


def by_length(words: pa.Array, step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray | bytes]]:
    """Rows of equal length with their bytes after the word-start mark, some thousand at a time; longer ones than LONG one by one."""
    start, cut, data = np.frombuffer(START, np.uint8), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(words.buffers()[2] or b"", np.uint8)
    length = np.diff(cut)
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-2))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        size = int(length[order[a]])
        for low in range(a, b, step if size <= LONG else 1):
            rows = order[low : min(b, low + (step if size <= LONG else 1))]
            if size > LONG:
                yield rows, START + data[cut[rows[0]] : cut[rows[0]] + size].tobytes()
            else:
                body = data[cut[rows][:, None].astype(np.int64) + np.arange(size)]
                yield rows, np.concatenate([np.tile(start, (len(rows), 1)), body], axis=1)


def word_log_p(v: Pieces, words: pa.Array) -> np.ndarray:
    """Natural log of each word's marginal probability: a first piece that begins a word, then others, until one would begin the next word."""
    out = np.zeros(len(words))
    for rows, block in by_length(words):
        if isinstance(block, bytes):
            out[rows] = long_word(v, block)
        else:
            out[rows] = forward(v, arcs(v, block), *block.shape)[-1]
    # conditioned on beginning a word (-), ended by the next beginning (+): the two cancel
    return out


def train_pieces(words: DataFrame, v: Pieces, *, rounds: int = 2, prior: float = 100.0) -> Pieces:
    """``v`` with the expected counts of the pieces over the distinct words of ``words`` (word binary), plus ``prior`` counts by the old probabilities."""
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(v)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, total = shared.value, None
            for batch in batches:
                total = np.zeros(len(v.pieces)) if total is None else total
                for rows, block in by_length(batch.column(0)):
                    if isinstance(block, bytes):
                        long_word(v, block, total)
                    else:
                        total += expected_counts(v, arcs(v, block), np.ones(len(rows)), block.shape[1])
            if total is not None:
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

        got = words.select("word").mapInArrow(count, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.exp(v.log_p) * prior
        for r in got:
            n[r["piece"]] += r["n"]
        v = Pieces(v.pieces, np.log(n / n.sum()))
    return v


def block_words(df: DataFrame, block: str, train: str, text: str) -> DataFrame:
    """(block, hash, word, c): the distinct words of each block of rows, with how often its training rows have them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, trains = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            edges = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1, append=blocks[-1:] + 1)) if len(blocks) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                hashes, counts, bodies = [], [], []
                for w in cut_words(batch.column(2).slice(a, b - a), NOT_SPACE, fold=True):
                    h, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
                    hashes.append(h)
                    counts.append(np.bincount(which, weights=trains[a + w.first + w.row], minlength=len(h)).astype(np.int64))
                    body = FOLD[w.data].tobytes()
                    bodies += [body[s:e] for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
                if not hashes:
                    continue
                h, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
                c = np.bincount(which, weights=np.concatenate(counts), minlength=len(h)).astype(np.int64)
                for low in range(0, len(h), 50_000):
                    part = slice(low, low + 50_000)
                    words = pa.array([bodies[i] for i in first[part].tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), blocks[a])), pa.array(h[part].view(np.int64)), words, pa.array(c[part])], names=["block", "hash", "word", "c"])

    return df.select(block, train, text).mapInArrow(scan, "block long, hash long, word binary, c long")


def score_likelihood(df: DataFrame, train: Column, *, text: str = "text", vocabulary: str = VOCABULARY, rows_per_block: int = 2048, stable_input: bool = False) -> DataFrame:
    """All rows and columns of ``df`` plus n_tokens, n_known, train_tokens (long), base_score and score (double, log10).

    Tokens: words between ASCII spaces, A-Z folded, and one end. ``train`` marks the rows to learn from (null: not).
    ``base_score`` is the add-0.1 estimate of single tokens; ``score`` the model's log-probability.

    Every ``rows_per_block`` consecutive rows of an input partition are a block, texts of over 64 KB one each, so that a block's size is bounded. A block's distinct words are one row each: added up by word
    they are the corpus counts, and sent back to the block they are all that scoring it needs, so that no dictionary is broadcast
    and no word, however common, has more rows than there are blocks. The text moves once. ``stable_input``: ``df`` reads files, and each
    partition gives the same rows again; else it is written to the shared scratch folder first.

    Edge cases: null and empty texts are the end alone; repeated rows count each; without training rows all words have the lattice's
    probability and the base is uniform; an empty table gives no rows; existing columns of the five names are replaced.
    """
    df = df.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    train_col, block = fresh(df, "_train", "_block")
    df = df.withColumn(train_col, F.coalesce(train, F.lit(False)))
    if not stable_input:
        df = scratch_table(df, "lattice-input")
    bits = max(0, int(rows_per_block).bit_length() - 1)
    place = F.monotonically_increasing_id()
    df = df.withColumn(block, F.when(F.octet_length(text) > LONG_TEXT, -1 - place).otherwise(F.shiftright(place, bits)))
    seen = scratch_table(block_words(df, block, train_col, text), "lattice-block-words")
    words = scratch_table(seen.groupBy("hash").agg(F.min("word").alias("word"), F.sum("c").alias("c")), "lattice-words")
    ends = df.where(train_col).count()
    r = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("n1"), F.count(F.when(F.col("c") == 2, 1)).alias("n2")).first()
    n_total, kinds = r["n"] + ends, r["v"] + (ends > 0)
    discount = min(0.95, max(0.05, r["n1"] / max(1, r["n1"] + 2 * r["n2"])))
    pieces = train_pieces(words.where("c > 0"), load_pieces(vocabulary))
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(word_log_p(shared.value, batch.column(1)))], names=["hash", "c", "log_p"])

    lattice = F.exp(F.col("log_p"))
    p_end = (ends + 0.5) / (n_total + 1)
    own = (F.greatest(F.col("c") - discount, F.lit(0.0)) + discount * r["v"] * lattice) / max(1, r["n"])
    log_word = F.when(F.lit(r["n"] == 0) | (F.col("c") == 0), F.col("log_p") + (float(np.log(discount * r["v"] / r["n"])) if r["n"] else 0.0)).otherwise(F.log(own))
    log_word = (log_word + float(np.log(1 - p_end))) / LN10
    stats = words.mapInArrow(weigh, "hash long, c long, log_p double").select("hash", "c", log_word.alias("lp"))
    # a block that two batches share may send a word twice, which changes nothing
    stats = seen.select("block", "hash").join(stats, "hash").select("block", "hash", "c", "lp")
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in (train_col, block)], *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]])
    keep, floor = len(schema) - 5, float(n_total + 0.1 * (kinds + 1))

    def score(rows: pa.Table, stats: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        h, c, lp = (stats.column(i).to_numpy() for i in (1, 2, 3))
        order = np.argsort(h.view(np.uint64))
        h, c, lp = h.view(np.uint64)[order], c[order], lp[order]
        out = [np.zeros(len(rows)) for _ in range(4)]
        if len(rows):
            for w in cut_words(rows.column(rows.schema.get_field_index(text)), NOT_SPACE, fold=True):
                at = np.searchsorted(h, w.hash)
                part = slice(w.first, w.first + w.n_rows)
                cc = c[at] if len(at) else np.zeros(0)
                values = (np.ones(len(at)), cc > 0, np.log10((cc + 0.1) / floor), lp[at] if len(at) else np.zeros(0))
                for o, x in zip(out, values, strict=True):
                    o[part] = np.bincount(w.row, weights=x, minlength=w.n_rows)
        n, known, base, model = out
        more = [pa.array((n + 1).astype(np.int64)), pa.array((known + (ends > 0)).astype(np.int64)), pa.array(np.full(len(rows), n_total)), pa.array(base + np.log10((ends + 0.1) / floor)), pa.array(model + np.log10(p_end))]
        return pa.Table.from_arrays([*rows.columns[:keep], *more], names=schema.names)

    ordered = df.select(*schema.names[:keep], block)
    return ordered.groupBy(block).cogroup(stats.groupBy("block")).applyInArrow(score, schema)
