"""MinHash near-dedup of texts.

One-permutation hashing with optimal densification gives each text a signature; bands of the
signature are buckets; each bucket emits star-shaped candidate edges (every member to one
centre), which are confirmed on the full shingle sets. Buckets that still hold pairs nobody
compared (a shared template fills them) are settled exactly, by what sets their
members apart from each other. Connected components of the confirmed links are the groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, mix, shingle_set, table, word_hashes
from tidecast.llm.components import connected_components


@dataclass(frozen=True)
class NearDupSpec:
    """words per shingle; link when 100 * shared >= percent * union; bands x rows of the signature.

    64 bands of 5 rows: a pair at similarity 0.8 shares no bucket with probability 1e-11 (with 32
    bands 3e-6); a pair at 0.3 shares one with probability 0.14 and is refuted afterwards.
    """

    words: int = 5
    percent: int = 80
    bands: int = 64
    rows: int = 5


_SIG = "struct<n:bigint,a:bigint,b:bigint,bands:array<bigint>>"


def _donors(bins: int) -> np.ndarray:
    """For every bin, all bins in a random order: an empty bin takes the first that is not empty."""
    return np.argsort(np.random.default_rng(11).random((bins, bins)), axis=1)


def signature_udf(spec: NearDupSpec):
    bins = spec.bands * spec.rows
    donors = _donors(bins)
    odd = np.random.default_rng(13).integers(1, 2**63, bins, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(shingles: np.ndarray) -> np.ndarray:
        # the bin is the leading part of the hash, so the first of each bin in sorted order is its minimum
        at = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        first = np.searchsorted(at, np.arange(bins, dtype=np.uint64))
        full = first < len(at)
        full[full] = at[first[full]] == np.flatnonzero(full)
        take = np.arange(bins)
        if not full.all():
            empty = np.flatnonzero(~full)
            order = donors[empty]
            take[empty] = order[np.arange(len(empty)), full[order].argmax(axis=1)]
        values = shingles[first[take]] * odd
        keys = mix(values).reshape(spec.bands, spec.rows).sum(axis=1, dtype=np.uint64)
        return mix(keys + np.arange(spec.bands, dtype=np.uint64))

    @F.arrow_udf(_SIG)
    def sign(text: pa.Array) -> pa.Array:
        n, a, b, off, keys = [], [], [], [0], []
        for _, words, at in word_hashes(text):
            for i in range(len(at) - 1):
                s = shingle_set(words[at[i] : at[i + 1]], spec.words)
                n.append(len(s))
                a.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
                b.append(mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64))
                if len(s):
                    keys.append(signature(s).view(np.int64))
                off.append(off[-1] + (spec.bands if len(s) else 0))
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), bands], ["n", "a", "b", "bands"])

    return sign


def shingles_udf(k: int):
    @F.arrow_udf("array<bigint>")
    def shingles(text: pa.Array) -> pa.Array:
        off, parts = [0], []
        for _, words, at in word_hashes(text):
            for i in range(len(at) - 1):
                parts.append(shingle_set(words[at[i] : at[i + 1]], k).view(np.int64))
                off.append(off[-1] + len(parts[-1]))
        flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))

    return shingles


#: Rows and shingles of a block of rows that one task compares with another block.
BLOCK_ROWS, BLOCK_ITEMS = 1 << 10, 1 << 19


def most_apart(size, percent: int):
    """Largest symmetric difference of two sets that are similar enough; size: items of both together."""
    return size - 2 * -(-size * percent // (100 + percent))


def shared_items(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many items each set of ``a`` shares with each of ``b``, by the rows that meet in an item."""
    out = np.zeros(len(a) * len(b), np.int64)
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b)]
    row = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (a, b)]
    order = [np.argsort(v, kind="stable") for v in flat]
    items, mine = flat[1][order[1]], flat[0][order[0]]
    lo, hi = np.searchsorted(items, mine), np.searchsorted(items, mine, "right")
    met = np.flatnonzero(hi > lo)
    upto = np.cumsum((hi - lo)[met])
    at = 0
    while at < len(met):  # a bounded number of meetings at a time
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 22), "right")))
        k = met[at:to]
        n = hi[k] - lo[k]
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[k], n)
        out += np.bincount(np.repeat(row[0][order[0][k]], n) * len(b) + row[1][order[1][pos]], minlength=len(out))
        at = to
    return out.reshape(len(a), len(b))


def linked(sets: list[np.ndarray], first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of rows marked ``first``, of the others; of all rows if none is left) of all links.

    With D = set Δ centre, two sets differ by |Da| + |Db| - 2 |Da ∩ Db|, whatever the centre. The
    centre is what most of these sets hold, so a template that they share is in no D, and the
    items to be compared are those that set the rows apart.
    """
    items, times = np.unique(np.concatenate(sets), return_counts=True)
    centre = items[times * 2 > len(sets)]
    apart = [np.setxor1d(s, centre, assume_unique=True) for s in sets]
    n, m = (np.array([len(x) for x in y]) for y in (sets, apart))
    a = np.flatnonzero(first)
    b = np.flatnonzero(~first) if not first.all() else a
    shared = shared_items([apart[i] for i in a], [apart[i] for i in b])
    near = m[a][:, None] + m[b] - 2 * shared <= most_apart(n[a][:, None] + n[b], percent)
    x, y = np.nonzero(near)
    return a[x], b[y]


def merged(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, smallest root joined to it) of the groups that links between rows a and b join."""
    names, code = np.unique(roots, return_inverse=True)
    x, y = code[a], code[b]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _open_rows(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(c, row, root) of the rows of buckets, with their centre, that hold a pair of two groups without a centre in it."""
    far = buckets.where("m > 2 and row != c1 and row != c2").join(roots.withColumnRenamed("node", "row"), "row", "left")
    far = far.select("key", "row", F.col("c1").alias("c"), F.coalesce("root", "row").alias("root"))
    spans = far.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    return far.join(spans, "key", "left_semi").select("c", "row", "root").distinct()


def _settled(open_rows: DataFrame, sets: DataFrame, spec: NearDupSpec, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between groups that hold a link between rows of one centre: all of them, compared exactly.

    The rows of a centre are dealt into blocks of a bounded size; every two blocks meet in a
    task, which returns the groups that its links join, so its output is never larger than
    its input, however many rows are just above or below the limit.
    """
    rows = scratch.write(open_rows.join(sets.select("row", F.size("s").alias("n")), "row"), "open-sizes")
    plan = rows.groupBy("c").agg(F.count("*").alias("rows"), F.sum("n").alias("items"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("items") / BLOCK_ITEMS))
    dealt = rows.join(plan.select("c", blocks.alias("blocks")), "c").withColumn("own", F.pmod(F.xxhash64("row"), "blocks"))
    dealt = dealt.select("c", "row", "root", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("c", "row", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own") <= F.col("other"))
    dealt = dealt.toDF("c", "row", "root", "i", "j", "first")

    def settle(part: pa.Table) -> pa.Table:
        found = np.empty(0, np.int64), np.empty(0, np.int64)
        roots = part["root"].to_numpy()
        first = part["first"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        if (roots != roots[0]).any() and first.any():
            held = [v.values.to_numpy(zero_copy_only=False) for chunk in part["s"].chunks for v in chunk]
            found = merged(roots, *linked(held, first, spec.percent))
        return pa.table({"a": found[0], "b": found[1]})

    both = dealt.join(sets, "row")
    return scratch.write(both.groupBy("c", "i", "j").applyInArrow(settle, "a long, b long").distinct(), "edges3")


def _confirmed(sets: DataFrame, edges: DataFrame, spec: NearDupSpec, scratch: Scratch) -> DataFrame:
    """The edges (a, b) whose full shingle sets (row, s) are similar enough."""
    left = sets.select(F.col("row").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("row").alias("b"), F.col("s").alias("sb"))
    both = edges.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - F.col("shared")
    return scratch.write(both.withColumn("shared", shared).where(F.col("shared") * 100 >= union * spec.percent).select("a", "b"), "links")


def _groups(signed: DataFrame, spec: NearDupSpec, scratch: Scratch) -> DataFrame:
    """(row, root) of every row of ``signed`` (row, id, text, sig): root is the group's first row.

    1. Equal sets (128-bit hash of the whole set) are one class, so thousands of copies enter a
       bucket once. 2. Each bucket links its members to its smallest row. 3. Buckets that still
       span several groups link members of other groups to a second centre, picked by another
       order in each bucket, so a centre that happens to be unlike the others hides no link.
    4. Members of buckets that still hold two groups besides the centres are compared block by
    block, by what sets them apart from their template, which finds every link between them.
    """
    own = signed.select("row", "sig.n", F.col("sig.a").alias("ha"), F.col("sig.b").alias("hb"))
    classes = scratch.write(own.where("n > 0").groupBy("ha", "hb", "n").agg(F.min("row").alias("rep")), "classes")
    members = own.join(classes, ["ha", "hb", "n"], "left").select("row", F.coalesce("rep", "row").alias("rep"))
    members = scratch.write(members, "members")
    reps = signed.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    keys = scratch.write(reps.select("row", F.explode("sig.bands").alias("key")), "keys")
    order = F.xxhash64("key")
    centres = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("row").alias("c1"), F.min(F.col("row").bitwiseXOR(order)).alias("x"))
    centres = centres.where("m > 1").select("key", "m", "c1", F.col("x").bitwiseXOR(order).alias("c2"))
    buckets = scratch.write(keys.join(centres, "key").select("key", "m", "row", "c1", "c2"), "buckets")
    scratch.drop(keys)
    first = scratch.write(buckets.where("row != c1").select(F.col("row").alias("a"), F.col("c1").alias("b")).distinct(), "edges")
    # texts move once for both rounds, by a shuffle at every size: the list of bucket members grows with the corpus
    ends = buckets.select("row").distinct().hint("merge")
    sets = scratch.write(signed.join(ends, "row", "left_semi").select("row", shingles_udf(spec.words)("text").alias("s")), "sets")
    links = _confirmed(sets, first, spec, scratch)
    roots = scratch.write(connected_components(links, scratch), "roots")
    pairs = buckets.where("row != c2").select(F.col("row").alias("a"), F.col("c2").alias("b")).distinct()
    ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    pairs = pairs.join(first, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
    second = scratch.write(pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "edges2")
    if not second.isEmpty():
        links = links.union(_confirmed(sets, second, spec, scratch))
        roots = scratch.write(connected_components(links, scratch), "roots2")
    rest = scratch.write(_open_rows(buckets, roots), "open")
    if not rest.isEmpty():
        links = links.union(_settled(rest, sets, spec, scratch))
        roots = scratch.write(connected_components(links, scratch), "roots3")
    scratch.drop(sets)
    out = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("row", F.coalesce("root", "rep").alias("root"))
    return scratch.write(out, "groups")


def _signed(docs: DataFrame, text: Column, doc_id: Column, spec: NearDupSpec, scratch: Scratch, keep: bool) -> DataFrame:
    doc = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")] if keep else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("id"), text.alias("text"), *doc)
    return scratch.write(rows.withColumn("sig", signature_udf(spec)("text")), "signed")


def _labelled(signed: DataFrame, groups: DataFrame) -> DataFrame:
    rows = signed.select("row", "id", F.col("sig.n").alias("n")).join(groups, "row")
    least = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(least, "root")


def near_duplicates(docs: DataFrame, spec: NearDupSpec = NearDupSpec(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), kept, for every row.

    Null, empty or blank text: an empty set, linked with nothing. Repeated rows and rows with a
    repeated id are rows of their own; equal texts always share a group. A null id never names a
    group that has another id. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near-dup")
    signed = _signed(docs, docs[f"`{text}`"], docs[f"`{doc_id}`"], spec, scratch, keep=False)
    out = _labelled(signed, _groups(signed, spec, scratch))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, spec: NearDupSpec = NearDupSpec(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one row of each group: its smallest id (its first row if repeated).

    Columns are those of ``docs``, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "near-dup")
    signed = _signed(docs, docs[f"`{text}`"], docs[f"`{doc_id}`"], spec, scratch, keep=True)
    rows = _labelled(signed, _groups(signed, spec, scratch))
    first = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("row"))
    return signed.join(first.select("row"), "row", "left_semi").select("doc.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDupSpec(words=3, percent=85, bands=64))
