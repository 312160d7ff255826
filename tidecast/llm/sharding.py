"""K-d tree sharding by bytes, as DataFrame operations only.

A node with several shards is split along its widest metadata dimension (language, source or
text length) at the weighted median of the bytes, until each leaf is one shard of near the
target bytes. The width of a dimension is the entropy of the node's bytes over its values
(lengths: over half octaves), which puts names and numbers on one scale. Medians are found by a distributed radix selection: histograms of 2^16 values,
pre-aggregated before the shuffle, narrow the cut digit by digit, so no task sees a whole node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, table

DIMS = ("lang", "source", "length")
_TOP = 2**63 - 1
_SHIFTS = (48, 32, 16, 0)


def _table(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A literal table of a few whole numbers for each node of the tree."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'{int(x)}L' for x in r) + ')' for r in rows)} AS t({names})")


def weighted_cut(rows: DataFrame, key: Column, targets: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """By node: the smallest key at which the bytes of the node reach its target, the bytes of
    smaller keys and the bytes of this key.

    rows: node, size and what ``key`` (0 to 2^63 - 1) needs; targets: by node, 1 at least. The
    driver gets one row for each node and digit.
    """
    keyed = rows.select("node", "size", key.alias("key"))
    state = {node: (0, 0, 0) for node in targets}
    by = Window.partitionBy("node", "cut", "need").orderBy("digit")
    for shift in _SHIFTS:
        now = _table(rows.sparkSession, "node, cut, need", [(n, cut, targets[n] - below) for n, (cut, below, _) in state.items()])
        mine = keyed.join(F.broadcast(now), "node")
        if shift < _SHIFTS[0]:
            mine = mine.where(F.shiftright("key", shift + 16) == F.shiftright("cut", shift + 16))
        digits = mine.groupBy("node", "cut", "need", F.shiftright("key", shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")).agg(F.sum("size").alias("s"))
        found = digits.withColumn("upto", F.sum("s").over(by)).where("upto >= need and upto - s < need")
        for r in found.select("node", "digit", "s", "upto").collect():
            cut, below, _ = state[r.node]
            state[r.node] = (cut + (r.digit << shift), below + r.upto - r.s, r.s)
    return state


def kd_shards(docs: DataFrame, shards: int, slack: float = 0.03, pins: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``.

    Sizes (UTF-8 bytes of the text plus 1; null text counts as empty) are near equal over the
    shards. Equal texts stay together: a group at the cut goes whole to the nearer side where
    that moves at most slack x the target bytes, else it is pinned whole to a side and the cut
    is made again among the other rows to make up for it. A group larger than either side, or
    one met after ``pins`` pinned groups of the same node, is split by hashed id. Rows
    equal in id and text stay together. Null language or source is a value of its own. Slots
    count from 0 without gaps within a shard. Empty tables give an empty result; other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(docs["text"], F.lit(""))
    code = lambda c: F.shiftrightunsigned(F.xxhash64(docs[c]), 40)
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select(
        docs["doc_id"],
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        code("lang").alias("lang"),
        code("source").alias("source"),
        F.least(F.lit(2**24 - 1), F.floor(F.log2(size) * 2**19)).cast("long").alias("length"),
        F.shiftrightunsigned(F.xxhash64(text), 25).alias("hash"),
        F.shiftrightunsigned(F.xxhash64(docs["doc_id"], text), 1).alias("tie"),
        F.lit(0).cast("long").alias("node"),
    )
    rows = scratch.write(rows, "rows")
    # a group of equal texts has one place in the space: the least codes of its rows
    group = rows.groupBy("hash", "text_crc32", "size").agg(F.count("*").alias("n"), *[F.min(d).alias(f"g_{d}") for d in ("lang", "source")]).where("n > 1").drop("n")
    moved = [F.coalesce(f"g_{d}", d).alias(d) for d in ("lang", "source")]
    rows = rows.join(group, ["hash", "text_crc32", "size"], "left").select(*[c for c in rows.columns if c not in ("lang", "source")], *moved)
    rows = scratch.write(rows, "grouped")
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("rows")).first()
    loose = max(1, int((total["size"] or 0) / shards * slack))
    nodes = [(0, shards)]
    while any(n > 1 for _, n in nodes):
        rows = _split_level(rows, [x for x in nodes if x[1] > 1], loose, pins, scratch)
        nodes = [y for lo, n in nodes for y in ([(lo, n // 2), (lo + n // 2, n - n // 2)] if n > 1 else [(lo, 1)])]
    return _slots(rows.withColumn("shard", F.col("node").cast("int")), max(1, -(-(total["rows"] or 0) // 50_000)))


def _widest(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """By node: its bytes and the dimension over whose values they spread most (entropy in bits)."""
    value = {d: F.col(d) for d in DIMS} | {"length": F.shiftright("length", 18)}
    values = F.array(*[F.struct(F.lit(i).alias("dim"), value[d].alias("value")) for i, d in enumerate(DIMS)])
    held = rows.select("node", "size", F.inline(values)).groupBy("node", "dim", "value").agg(F.sum("size").alias("held"))
    bits = F.log2(F.sum("held")) - F.sum(F.col("held") * F.log2("held")) / F.sum("held")
    wide = held.groupBy("node", "dim").agg(F.sum("held").alias("held"), F.round(bits, 6).alias("bits"))
    best = wide.groupBy("node").agg(F.max("held").alias("held"), F.max(F.struct("bits", "dim")).alias("top"))
    return {r.node: (r.held, r.top.dim) for r in best.collect()}


def _split_level(rows: DataFrame, nodes: list[tuple[int, int]], loose: int, pins: int, scratch: Scratch) -> DataFrame:
    """``rows`` with the node of the next level. nodes: (first shard, number of shards) of those to split."""
    spark = rows.sparkSession
    shards = dict(nodes)
    wide = {n: x for n, x in _widest(rows).items() if n in shards}
    if not wide:
        return rows
    dim = {n: d for n, (_, d) in wide.items()}
    code = F.when(F.col("dim") == 0, F.col("lang")).when(F.col("dim") == 1, F.col("source")).otherwise(F.col("length"))
    key = F.shiftleft(code, 39).bitwiseOR(F.col("hash"))
    keyed = rows.join(F.broadcast(_table(spark, "node, dim", list(dim.items()))), "node").select("node", "size", "tie", key.alias("key"))
    need = {n: max(1, held * (shards[n] // 2) // shards[n]) for n, (held, _) in wide.items()}  # bytes that go left
    free = {n: held for n, (held, _) in wide.items()}
    pinned: dict[tuple[int, int], int] = {}  # (node, key of a group): 1 where it goes right
    cut_at, ties = {n: -1 for n in wide}, {n: _TOP for n in wide}
    todo = set(wide)
    for turn in range(pins + 1):
        todo = {n for n in todo if need[n] > 0}
        if not todo:
            break
        left = keyed.join(F.broadcast(_table(spark, "node, key", list(pinned))), ["node", "key"], "left_anti") if pinned else keyed
        cuts = weighted_cut(left, F.col("key"), {n: need[n] for n in todo})
        at = _table(spark, "node, cut", [(n, c[0]) for n, c in cuts.items()])
        group = left.join(F.broadcast(at), "node").where("key = cut")
        single = {r.node for r in group.groupBy("node").agg((F.min("tie") == F.max("tie")).alias("one")).collect() if r.one}
        split = {}
        for n, (cut, below, here) in cuts.items():
            before, after = need[n] - below, below + here - need[n]
            fits = [here <= need[n], here <= free[n] - need[n]]  # whole on the left, on the right
            cut_at[n] = cut
            if min(before, after) > loose and turn < pins and any(fits):
                right = int(not fits[0] or (fits[1] and after > before))
                pinned[n, cut] = right
                free[n] -= here
                need[n] -= 0 if right else here
                cut_at[n] = -1
                continue
            todo.discard(n)
            if min(before, after) <= loose or n in single:  # the whole group goes to the nearer side
                ties[n] = _TOP if after <= before else -1
            else:
                split[n] = before
        if split:
            part = group.join(F.broadcast(_table(spark, "node, need", list(split.items()))), "node")
            ties |= {n: c[0] for n, c in weighted_cut(part, F.col("tie"), split).items()}
    out = rows.join(F.broadcast(_table(spark, "node, left, dim, cut, tie_cut", [(n, shards[n] // 2, dim[n], cut_at[n], ties[n]) for n in wide])), "node", "left")
    right = (key > F.col("cut")) | ((key == F.col("cut")) & (F.col("tie") > F.col("tie_cut")))
    if pinned:
        out = out.withColumn("key", key).join(F.broadcast(_table(spark, "node, key, pin", [(*k, p) for k, p in pinned.items()])), ["node", "key"], "left")
        right = F.when(F.col("pin").isNull(), right).otherwise(F.col("pin") == 1)
    node = F.col("node") + F.when(right, F.col("left")).otherwise(0)
    return scratch.write(out.select(*[c for c in rows.columns if c != "node"], node.alias("node")), "level")


def _slots(rows: DataFrame, parts: int) -> DataFrame:
    """Number the rows of each shard: by hashed part, then within the part (bounded groups)."""
    rows = rows.select("doc_id", "size", "text_crc32", "shard", "tie", F.pmod("tie", F.lit(parts)).alias("part"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    begin = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("begin"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("tie", "doc_id"))
    return rows.withColumn("nth", nth).join(begin, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("nth") - 1).alias("slot"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
