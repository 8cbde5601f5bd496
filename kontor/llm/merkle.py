"""A dataset's Merkle manifest: hash trees as nested structs, and every row's proof out of them.

Nodes in order have ranks, and a rank has digits. Within a block of ``BLOCK`` ranks the last digit's column is grouped away first, its nodes becoming children of one
struct, then the next; blocks' roots are nodes of the level above. What a level above knows is put beside the blocks below by the last grouping, and one transform and
explode hand every child its proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import drop_scratch, fresh, scratch_table

DIGIT_BITS, DIGITS = 4, 3
#: Binary levels and nodes of a block.
BLOCK_BITS = DIGIT_BITS * DIGITS
BLOCK = 1 << BLOCK_BITS


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def record_digest(*fields: Column) -> Column:
    """Of a row's fields: each its UTF-8 length, ``:`` and its text, or ``-`` for null."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def pairs_up(lane: Column) -> Column:
    """The level above: digests of every two consecutive nodes; a last single one is digested alone."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lane) - 1) / 2).cast("int")), lambda i: digest(F.get(lane, 2 * i), F.coalesce(F.get(lane, 2 * i + 1), F.lit(""))))


def group_away(rows: DataFrame, keys: list[str], digit: str, below: int) -> DataFrame:
    """Nodes that differ in ``digit`` alone become one: struct(hash, lanes, kids); ``below``: binary levels under these nodes; a tree has ``depth`` in all."""
    kids = F.array_sort(F.collect_list(F.struct(digit, "node")))
    return with_lanes(rows.groupBy("g", "block", "depth", *keys).agg(F.transform(kids, lambda k: k["node"]).alias("kids")), below).select("g", "block", "depth", *keys, F.struct("hash", "lanes", "kids").alias("node"))


def with_lanes(rows: DataFrame, below: int) -> DataFrame:
    """The binary levels over ``kids``: their digests and those of the levels above within one digit, and of the one node at the top."""
    names = [f"_lane{j}" for j in range(DIGIT_BITS + 1)]
    rows = rows.withColumn(names[0], F.transform("kids", lambda k: k["hash"]))
    for j in range(DIGIT_BITS):
        rows = rows.withColumn(names[j + 1], F.when(F.col("depth") > below + j, pairs_up(F.col(names[j]))).otherwise(F.col(names[j])))
    lanes = F.array(*names[:-1]).alias("lanes")
    return rows.withColumns({"lanes": lanes, "hash": F.get(names[-1], F.lit(0))}).drop(*names)


def siblings(lanes: Column, at: Column, depth: Column, below: int) -> Column:
    """What stands beside the nodes over child ``at``, level by level, null where nothing does; ``left``: it goes before."""
    one = lambda j: F.struct(F.get(F.get(lanes, F.lit(j)), F.shiftright(at, j).bitwiseXOR(F.lit(1))).alias("hash"), (F.shiftright(at, j).bitwiseAND(F.lit(1)) == 1).alias("left"))
    return F.slice(F.array(*[one(j) for j in range(DIGIT_BITS)]), F.lit(1), F.greatest(F.lit(0), F.least(F.lit(DIGIT_BITS), depth - below)))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` within ``g`` (from 0) and ``n``, the size of ``g``, by ranges of (g, order): a group of most rows lies in many of them."""
    placed = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id())
    placed = scratch_table(placed.withColumn("part", F.shiftright("at", 33)), "merkle-placed")
    counts = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
    of_group = Window.partitionBy("g")  # one row a range
    before = F.coalesce(F.sum("k").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch_table(counts.select("g", "part", (before - F.col("first")).alias("start"), F.sum("k").over(of_group).alias("n")), "merkle-starts")
    return placed.join(starts, ["g", "part"]).withColumn("rank", F.col("start") + F.col("at")).drop("part", "at", "start")


def roll_up(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Nested tables, one a level of blocks, and (g, hash), the trees' roots, from (g, rank, n, node); ``most``: nodes of the largest tree."""
    depth = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    nodes = nodes.withColumn("depth", depth.cast("int"))
    tables, below = [], 0
    while True:
        places = [f"d{i}" for i in range(DIGITS)]
        digits = {p: F.shiftright("rank", DIGIT_BITS * i).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int") for i, p in enumerate(places)}
        rows = nodes.withColumns(digits | {"block": F.shiftright("rank", BLOCK_BITS)}).repartition("g", "block")
        for i in range(DIGITS - 1):
            rows = group_away(rows, places[i + 1 :], places[i], below + DIGIT_BITS * i)
        tables.append(scratch_table(rows, "merkle-nested"))
        light = tables[-1].select("g", "block", "depth", places[-1], F.struct(F.col("node.hash").alias("hash")).alias("node"))
        tops = scratch_table(group_away(light, [], places[-1], below + BLOCK_BITS - DIGIT_BITS).select("g", "block", "depth", "node.hash"), "merkle-roots")
        below += BLOCK_BITS
        if most <= 1 << below:
            return tables, tops.select("g", "hash")
        nodes = tops.select("g", "depth", F.col("block").alias("rank"), F.struct("hash", F.col("block").alias("carry")).alias("node"))


def hand_down(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, hash, carry, path, tops) of every node of the first table, from (g, path, tops), what stands over each tree."""
    upper = above.withColumn("block", F.lit(0).cast("long"))
    for level in reversed(range(len(tables))):
        table, last, below = tables[level], f"d{DIGITS - 1}", BLOCK_BITS * level
        kid = F.struct(last, "node")
        here = table.select("g", "block", "depth", kid.alias("kid")).unionByName(upper.select("g", "block", F.struct("path", "tops").alias("upper")), allowMissingColumns=True)
        whole = here.groupBy("g", "block").agg(F.max("depth").alias("depth"), F.transform(F.array_sort(F.collect_list("kid")), lambda k: k["node"]).alias("kids"), F.first("upper", ignorenulls=True).alias("upper"))
        whole = with_lanes(whole, below + BLOCK_BITS - DIGIT_BITS)
        depth, top = F.col("depth"), F.col("upper")

        def paths(kids: Column, lanes: Column, digit: int, over: Column, below: int = below, depth: Column = depth) -> Column:
            def of(kid: Column, at: Column) -> Column:
                path = F.concat(siblings(lanes, at, depth, below + DIGIT_BITS * digit), over)
                return paths(kid["kids"], kid["lanes"], digit - 1, path) if digit else F.struct(kid["hash"].alias("hash"), kid["carry"].alias("carry"), path.alias("path"))

            nested = F.transform(kids, of)
            return F.flatten(nested) if digit else nested

        rows = whole.select("g", F.col("upper.tops").alias("tops"), F.explode(paths(F.col("kids"), F.col("lanes"), DIGITS - 1, top["path"])).alias("x"))
        upper = rows.select("g", "tops", "x.*")
        if level:
            upper = upper.select("g", "tops", "path", F.col("carry").alias("block"))
    return upper


def merkle_manifest(df: DataFrame, *, fields: tuple[str, ...], tree: str, order: str, keep: tuple[str, ...] = (), probe: dict[str, Column] | None = None) -> DataFrame:
    """Every row's ``leaf``, its tree's ``subroot``, the ``root`` over the trees and its ``proof``, with the columns of ``keep``.

    A leaf is the digest of the row's ``fields`` (``record_digest``). The rows of one value of ``tree`` make a tree, in the order of ``order``: while more than one node is
    left, every two consecutive ones become their digest, a last single one the digest of itself. The subroots, by ``tree`` (null first, then by bytes), make the tree over
    them. ``proof``: array of struct(hash, left) from the leaf to the root; ``hash`` is null where a node stands alone. Texts are read once; only digests, ``keep`` and the order move on.
    ``probe``: other values for some fields; ``probe`` in the result is the leaf of the row with these, for what claims to be that row.

    Edge cases: nulls are fields like others; null keys come first; ties in ``order`` are put in order of their digests, equal rows as leaves beside each other; a tree of one row has it as
    its subroot, and a single tree's subroot is the root. An empty table gives no rows. Columns of the result's names are not kept from ``df``.
    """
    g = F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0"))
    changed = [(probe or {}).get(f, F.col(f)) for f in fields]
    own = ("leaf", "subroot", "root", "proof", "probe")
    carry = F.struct(*[F.col(c) for c in keep if c not in own], (record_digest(*changed) if probe else F.lit(None).cast("string")).alias("_probe"))
    rows = df.select(g.alias("g"), F.col(order).alias("o"), record_digest(*[F.col(f) for f in fields]).alias("leaf"), carry.alias("carry"), F.monotonically_increasing_id().alias("row"))
    rows = scratch_table(rows, "merkle-leaves")
    nodes = ranked(rows, ["o", "leaf", "row"])
    nodes = nodes.select("g", "rank", "n", F.struct(F.col("leaf").alias("hash"), "carry").alias("node"))
    most = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    tables, subroots = roll_up(nodes, most[0] or 0)
    drop_scratch(rows)
    trees = ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("tree"), "hash"), ["tree"])
    trees = trees.select("g", "rank", "n", F.struct("hash", F.col("tree").alias("carry")).alias("node"))
    over, roots = roll_up(trees, most[1])
    none = F.array().cast("array<struct<hash:string,left:boolean>>")
    down = hand_down(over, roots.select("g", none.alias("path"), F.struct(F.col("hash").alias("root")).alias("tops")))
    above = scratch_table(down.select(F.col("carry").alias("g"), "path", F.struct(F.col("hash").alias("subroot"), "tops.root").alias("tops")), "merkle-above")
    out = hand_down(tables, above)
    return out.select(*[F.col("carry")[c].alias(c) for c in keep if c not in own], F.col("hash").alias("leaf"), F.col("tops.subroot").alias("subroot"), F.col("tops.root").alias("root"), F.col("path").alias("proof"), F.col("carry._probe").alias("probe"))


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` lead to."""
    beside = lambda acc, s: digest(F.when(s["left"], F.coalesce(s["hash"], F.lit(""))).otherwise(F.lit("")), acc, F.when(s["left"], F.lit("")).otherwise(F.coalesce(s["hash"], F.lit(""))))
    return F.aggregate(proof, leaf, beside)
