"""Mixing sources to target weights, as DataFrame operations only.

A token budget flows down a tree (domain, language, source): each node shares its budget among
its children by weight, no child gets more than its subtree can supply, and what a child cannot
take goes to its siblings before it can leave the parent. Each leaf then takes the prefix of
its budget from seeded epochs: whole epochs first, then the head of one more in hashed order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, table

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixSpec:
    """weights: by level and value, others 1; 0 takes nothing. share: of all tokens to select."""

    share: float = 0.7
    max_epochs: int = 2
    seed: int = 17
    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {"lang": {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 2.0}})


def domain_of(source: Column) -> Column:
    """The domain of a source where no table names it: one of four, by the source's checksum."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(source.cast("binary")), F.lit(4)))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"{prefix}{k}"])
    return cond


def _weight(key: str, spec: MixSpec) -> Column:
    w = F.lit(1.0)
    for value, weight in spec.weights.get(key, {}).items():
        w = F.when(F.col(key) == value, float(weight)).otherwise(w)
    return w


def _share_out(children: DataFrame, parents: list[str], key: str, spec: MixSpec) -> DataFrame:
    """Adds ``budget`` to children (parents, key, cap, given): given is shared by weight up to cap.

    Children are filled in the order of cap / weight; the first whose fair share is below its
    cap fixes the level that all later ones get.
    """
    rows = children.withColumn("w", _weight(key, spec)).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(float("inf")))
    by = Window.partitionBy(*parents).orderBy("ratio", key) if parents else Window.partitionBy(F.lit(0)).orderBy("ratio", key)
    all_of = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", F.when(left > 0, (F.col("given") - before) / left).otherwise(0.0))
    rows = rows.withColumn("full", (F.col("w") > 0) & (F.col("cap") <= F.col("level") * F.col("w")))
    rows = rows.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(all_of))
    budget = F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.least("cap", F.col("level") * F.col("w"))).cast("double"))
    return rows.withColumn("budget", budget).drop("w", "ratio", "level", "full")


def budgets(leaves: DataFrame, spec: MixSpec) -> DataFrame:
    """domain, lang, source, supply, rows, budget: tokens each leaf is to give.

    A node's cap counts only what its children may give: a subtree of weight 0 gives nothing, and
    the budget it cannot take goes on to siblings, then to the ancestors' siblings.
    """
    leaves = leaves.withColumn("cap", F.col("supply").cast("double") * spec.max_epochs)
    given = leaves.agg(F.floor(F.sum("supply") * spec.share).cast("double").alias("given"))
    gives = [_weight(key, spec) > 0 for key in LEVELS]
    open_below = {1: gives[2], 0: gives[1] & gives[2]}
    nodes = {k: leaves.groupBy(*LEVELS[: k + 1]).agg(F.sum(F.when(below, F.col("cap")).otherwise(0.0)).alias("cap")) for k, below in open_below.items()} | {2: leaves}
    top = nodes[0].withColumn("one", F.lit(1)).join(given.withColumn("one", F.lit(1)), "one").drop("one")
    shared = _share_out(top, [], LEVELS[0], spec)
    for k in (1, 2):
        up = list(LEVELS[:k])
        above = shared.select(*[F.col(c).alias(f"up_{c}") for c in up], F.col("budget").alias("given"))
        rows = nodes[k].join(above, _same(nodes[k], above, up, "up_")).drop(*[f"up_{c}" for c in up])
        shared = _share_out(rows, up, LEVELS[k], spec)
    return shared.select(*LEVELS, "supply", "rows", "budget")


def _place(spec: MixSpec) -> Column:
    """Place of a row in its leaf's partial epoch, 0 to 2^63 - 1; every epoch has an order of its own."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(spec.seed), F.col("whole"), F.col("doc_id")), 1)


def _bucket(place: Column) -> Column:
    return F.shiftright(F.shiftright(place, 32) * F.col("buckets"), 31)


def plan(rows: DataFrame, spec: MixSpec, scratch: Scratch) -> DataFrame:
    """t_domain, t_lang, t_source, whole, buckets, cut, last: which rows of each leaf to take.

    rows: domain, lang, source, doc_id, tokens. A leaf gives ``whole`` full epochs and, of the
    next, the rows of buckets before ``cut`` and of bucket ``cut`` up to place ``last``: the
    longest prefix within the budget. Only about 4,096 rows of a leaf are ever sorted.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"), F.count("*").alias("rows"))
    b = scratch.write(budgets(scratch.write(leaves, "leaves"), spec), "budgets")
    whole = F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(0).cast("long")
    b = b.withColumn("whole", whole).withColumn("rest", F.col("budget").cast("long") - F.col("whole") * F.col("supply"))
    b = b.select(*[F.col(c).alias(f"t_{c}") for c in LEVELS], "whole", "rest", F.greatest(F.lit(1), F.ceil(F.col("rows") / 4096)).cast("long").alias("buckets"))
    placed = rows.join(b, _same(rows, b, list(LEVELS), "t_")).withColumn("place", _place(spec)).withColumn("bucket", _bucket(F.col("place")))
    leaf = [f"t_{c}" for c in LEVELS]
    sums = placed.groupBy(*leaf, "whole", "rest", "buckets", "bucket").agg(F.sum("tokens").alias("t"))
    run = sums.withColumn("upto", F.sum("t").over(Window.partitionBy(*leaf).orderBy("bucket")))
    over = run.where("upto > rest")
    cut = over.groupBy(*leaf).agg(F.min("bucket").alias("cut"), F.min("upto").alias("upto"))
    c = cut.select(*[F.col(x).alias(f"c_{x}") for x in leaf], "cut", "upto")
    edge = placed.join(c, _same(placed, c, leaf, "c_") & (placed["bucket"] == c["cut"]))
    by = Window.partitionBy(*leaf)
    edge = edge.withColumn("before", F.col("upto") - F.sum("tokens").over(by)).withColumn("run", F.sum("tokens").over(by.orderBy("place")))
    last = edge.groupBy(*leaf).agg(F.max("cut").alias("cut"), F.max(F.when(F.col("before") + F.col("run") <= F.col("rest"), F.col("place"))).alias("last"))
    last = last.select(*[F.col(x).alias(f"l_{x}") for x in leaf], "cut", "last")
    out = b.join(last, _same(b, last, leaf, "l_"), "left")
    return scratch.write(out.select(*leaf, "whole", "rest", "buckets", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("last", F.lit(-1)).alias("last")), "plan")


def _selected(docs: DataFrame, columns: list[Column], spec: MixSpec) -> DataFrame:
    """``columns`` of the selected rows, with domain, lang, source, doc_id and epoch."""
    scratch = Scratch(docs.sparkSession, "mix")
    source = docs["source"]
    keys = [domain_of(source).alias("domain"), docs["lang"].alias("lang"), source.alias("source"), docs["doc_id"].alias("doc_id")]
    rows = scratch.write(docs.select(*keys, tokens_of(docs["text"]).alias("tokens")), "tokens")
    leaf = plan(rows, spec, scratch)
    wide = docs.select(*keys, *columns)
    wide = wide.join(leaf, _same(wide, leaf, list(LEVELS), "t_"))
    place = _place(spec)
    ahead = (_bucket(place) < F.col("cut")) | ((_bucket(place) == F.col("cut")) & (place <= F.col("last")))
    copies = F.col("whole") + F.when((F.col("rest") > 0) & ahead, 1).otherwise(0)
    return wide.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


def mixed(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """domain, lang, source, doc_id, tokens, epoch: one row for each time a row is taken.

    Tokens are words (runs of characters other than space and \\t to \\r); null text has none
    and is taken with its neighbours in the order. Null languages and sources are leaves of
    their own; rows with the same id are taken together. Empty tables give an empty result.
    """
    out = _selected(docs, [tokens_of(docs["text"]).alias("tokens")], spec)
    return out.select(*LEVELS, "doc_id", "tokens", "epoch")


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The selected rows of ``docs``, repeated for each epoch, with the columns of ``docs``."""
    doc = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    return _selected(docs, [doc], spec).select("doc.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
