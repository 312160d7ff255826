"""Embedding near-dedup by an epsilon grid order join.

Unit vectors at a cosine of c or more lie within eps = sqrt(2 - 2c) of each other, also after
projection to leading principal dimensions. Vectors are sorted by the grid cells (side eps) of
those dimensions and cut into blocks of some MB, which are written once. Each task reads two
groups of blocks from there, so no vector is shuffled for a comparison and the disk in use
grows with the vectors, not with their pairs. Blocks and leaves whose boxes are more than eps
apart are skipped. In the others the product of the leading dimensions and of the lengths of
the rest bounds the cosine from above; pairs which that does not rule out are compared in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidecast.llm.common import Scratch, table
from tidecast.llm.components import connected_components

LEADING = 8
#: Rows of a block at most, its bytes, those of a file of blocks, of the files that one side of a task reads, and of an Arrow batch.
BLOCK = 8192
BLOCK_BYTES = 2 << 20
FILE_BYTES = 8 << 20
GROUP_BYTES = 32 << 20
BATCH_BYTES = 16 << 20
LEAF = 256
#: Columns of a product at a time, and numbers of leading dimensions that bound the cosine.
STRIP = 1024
BOUNDS = (8, 12, 16, 20, 24, 28, 32, 40, 48, 64)
#: What single precision may take from a bound.
SLACK = 2e-5
#: Pairs that get a second look at a time, keys of a task and edges of a task that are held.
LOOKED_AT = 1 << 15
SEEN = 1 << 18
EDGES = 1 << 20


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles, padded with zeros to the longest, and their lengths (0: not usable)."""
    n = len(column)
    if not n:
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    off = np.asarray(column.offsets).astype(np.int64)
    size = np.diff(off)
    size[np.asarray(column.is_null())] = 0
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is read as NaN
    if off[-1] - off[0] == n * size.max() == size.sum():
        x = flat[off[0] : off[-1]].reshape(n, -1)
    else:
        x = np.zeros((n, int(size.max())))
        mask = np.arange(x.shape[1]) < size[:, None]
        x[mask] = flat[np.repeat(off[:-1], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
    usable = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x, np.where(usable, size, 0)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keyed(frames: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows with a 128-bit key of the unit vector; of equal ones in a task mostly the first has the numbers."""
    seen: set[bytes] = set()
    for f in frames:
        x, size = _padded(f.column("embedding"))
        ok = np.flatnonzero(size)
        unit, raw = _units(x[ok]) + 0.0, x[ok].astype(kind)  # + 0.0: one zero only
        keys: list[bytes | None] = [None] * len(size)
        first: list[bytes | None] = [None] * len(size)
        for at, i in enumerate(ok):
            keys[i] = key = blake2b(unit[at, : size[i]].tobytes(), digest_size=16).digest()
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                first[i] = raw[at, : size[i]].tobytes()
        yield pa.RecordBatch.from_arrays([f.column("row"), f.column("vec_id"), pa.array(keys, pa.binary()), pa.array(size.astype(np.int32)), pa.array(first, pa.binary())], ["row", "id", "key", "size", "raw"])


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """The rows of a binary column without nulls, padded with zeros to ``width``."""
    n, item = len(column), np.dtype(kind).itemsize
    off = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    off = off[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
    if (np.diff(off) == width * item).all():
        return np.frombuffer(flat.tobytes(), kind).reshape(n, width)
    x = np.zeros((n, width * item), np.uint8)
    x[np.arange(width * item) < np.diff(off)[:, None]] = flat
    return x.view(kind)


def _moments(frames: Iterator[pa.RecordBatch], width: int, kind: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width + 1, width + 1))
    for f in frames:
        x = np.ones((f.num_rows, width + 1))
        x[:, :width] = _units(_matrix(f.column("raw"), width, kind))
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])


def principal(raw: DataFrame, width: int, kind: str, leading: int) -> np.ndarray:
    """The leading principal dimensions (width x leading) of the unit vectors of ``raw``.

    The sums of products are added up over the cluster; the driver gets (width + 1)^2 numbers.
    """
    parts = raw.select("raw").mapInArrow(lambda it: _moments(it, width, kind), "m array<double>")
    cells = parts.select(F.posexplode("m").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((width + 1) ** 2)
    for r in cells:
        m[r.k] = r.v
    m = m.reshape(width + 1, width + 1)
    mean = m[:width, width] / max(m[width, width], 1.0)
    values, vectors = np.linalg.eigh(m[:width, :width] / max(m[width, width], 1.0) - np.outer(mean, mean))
    return np.ascontiguousarray(vectors[:, np.argsort(-values)[:leading]])


def _near(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Squared least distance of boxes."""
    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return (gap * gap).sum(axis=-1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over the links (i, j)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _blocks(frames: Iterator[pa.RecordBatch], width: int, kind: str, axes: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Classes in grid order as blocks: nodes, multiplicities, sizes, vectors and the box of each.

    Of a key first comes the row of its class (node and copies), then one or more that hold its
    numbers, of which the first counts.
    """
    part, seq = TaskContext.get().partitionId(), 0
    names = ["node", "copies", "size", "raw"]
    held = pa.table({"node": pa.array([], pa.int64()), "copies": pa.array([], pa.int64()), "size": pa.array([], pa.int32()), "raw": pa.array([], pa.binary())})
    before: tuple = (None, None, None)

    def cut(t: pa.Table) -> pa.RecordBatch:
        nonlocal seq
        t = t.combine_chunks()
        x = _matrix(t.column("raw").chunk(0), width, kind)
        y = _units(x) @ axes
        lists = [pa.array([t.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in names[:3]]
        box = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (y.min(axis=0), y.max(axis=0))]
        out = pa.RecordBatch.from_arrays([pa.array([part << 24 | seq], pa.int64()), *lists, pa.array([x.tobytes()], pa.binary()), *box], ["block", *names[:3], "x", "lo", "hi"])
        seq += 1
        return out

    for f in frames:
        if not f.num_rows:
            continue
        key, raw = f.column("key"), f.column("raw")
        node, copies = (np.concatenate([[v or 0], f.column(c).fill_null(0).to_numpy(zero_copy_only=False)]).astype(np.int64) for c, v in zip(names[:2], before[1:], strict=True))
        head = np.concatenate([[before[1] is not None], np.asarray(raw.is_null())])  # of a class; the row before comes first
        at = np.flatnonzero(head[:-1] & ~head[1:])
        last = pa.concat_arrays([pa.array([before[0]], key.type), key])
        at = at[np.asarray(pc.equal(last.take(pa.array(at)), key.take(pa.array(at))).fill_null(False)).astype(bool)]
        chosen = pa.array(at)
        new = pa.table({"node": pa.array(node[at]), "copies": pa.array(copies[at]), "size": f.column("size").take(chosen), "raw": raw.take(chosen)})
        is_head = not raw[-1].is_valid
        before = (key[-1].as_py(), int(node[-1]) if is_head else None, int(copies[-1]) if is_head else None)
        held = pa.concat_tables([held, new])
        while held.num_rows >= block:
            yield cut(held.slice(0, block))
            held = held.slice(block)
        held = held.combine_chunks()
    if held.num_rows:
        yield cut(held)


class _Side:
    """A block as a task compares it: boxes of its leaves, links so far, and for each row the least node known to be linked to it."""

    def __init__(self, f: pa.RecordBatch, r: int, s: str, width: int, kind: str, axes: np.ndarray, leading: int, leaf: int):
        self.node, self.copies, self.size = (np.frombuffer(f.column(f"{s}_{c}")[r].as_py(), np.int64) for c in ("node", "copies", "size"))
        self.x = np.frombuffer(f.column(f"{s}_x")[r].as_py(), kind).reshape(-1, width)
        self.y = _units(self.x) @ axes
        cut = range(0, len(self.x), leaf)
        self.lo, self.hi = (np.array([g(self.y[i : i + leaf, :leading], axis=0) for i in cut]) for g in (np.min, np.max))
        self.links, self.label = np.zeros(len(self.x)), self.node.copy()

    def bounds(self, k: int) -> np.ndarray:
        """The k first dimensions and, as one more, the length of the rest: products of such rows are no less than the cosine."""
        rest = np.sqrt(np.maximum(0.0, 1.0 - (self.y[:, :k] ** 2).sum(axis=1)) + 1e-12)
        return np.column_stack([self.y[:, :k], rest]).astype(np.float32)

    def settle(self, k: int) -> None:
        self.bound = self.bounds(k)
        del self.y


def _dimensions(a: _Side, b: _Side, cosine: float) -> int:
    """The number of leading dimensions for which products and second looks together cost least; it changes no result."""
    i, j = (np.linspace(0, len(s.x) - 1, min(len(s.x), 512)).astype(np.int64) for s in (a, b))
    ks = [k for k in BOUNDS if k < a.y.shape[1]] + [a.y.shape[1]]
    cost = []
    for k in ks:
        passed = np.mean(a.bounds(k)[i] @ b.bounds(k)[j].T >= cosine - SLACK)
        cost.append(0.02 * k + 32.0 * a.x.shape[1] * passed)  # nanoseconds
    return ks[int(np.argmin(cost))]


def _set(flags: np.ndarray) -> np.ndarray:
    """Indices of the true ones, of which few are expected: words of eight are looked at first."""
    if len(flags) % 8:
        return np.flatnonzero(flags)
    words = np.flatnonzero(flags.view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return at[flags[at]]


def _linked(a: _Side, b: _Side, cosine: float, reach: float, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b at ``cosine`` or more, each pair once."""
    least, product, above = np.float32(cosine - SLACK), np.empty(leaf * STRIP, np.float32), np.empty(leaf * STRIP, bool)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0

    def fitting(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = a.size[x] == b.size[y]
        if a is b:
            ok &= x < y
        return x[ok], y[ok]

    def looked_at() -> tuple[np.ndarray, np.ndarray]:
        x, y = fitting(*(np.concatenate(v) for v in zip(*held, strict=True)))
        ok = np.einsum("ij,ij->i", _units(a.x[x]), _units(b.x[y])) >= cosine
        return x[ok], y[ok]

    for at, i in enumerate(range(0, len(a.x), leaf)):
        close = np.flatnonzero(_near(a.lo[at], a.hi[at], b.lo, b.hi) <= reach)
        if a is b:
            close = close[close >= at]
        cols = (close[:, None] * leaf + np.arange(leaf)).ravel()
        cols = cols[cols < len(b.x)]
        left = a.bound[i : i + leaf]
        for c in range(0, len(cols), STRIP):
            j = cols[c : c + STRIP]
            run = slice(j[0], j[-1] + 1) if j[-1] - j[0] + 1 == len(j) else j
            n = len(left) * len(j)
            np.matmul(left, b.bound[run].T, out=product[:n].reshape(-1, len(j)))
            hit = _set(np.greater_equal(product[:n], least, out=above[:n]))
            if len(hit) * 16 > n:
                x, y = np.divmod(_set((_units(a.x[i : i + leaf]) @ _units(b.x[run]).T >= cosine).ravel()), len(j))
                yield fitting(x + i, j[y])
            elif len(hit):
                x, y = np.divmod(hit, len(j))
                held.append((x + i, j[y]))
                many += len(hit)
                if many > LOOKED_AT:
                    yield looked_at()
                    held, many = [], 0
    if held:
        yield looked_at()


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (u, v) that is not the least of its component, in order, and that least one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = _roots(len(ids), at[: len(u)], at[len(u) :])
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


def _compare(frames: Iterator[pa.RecordBatch], width: int, kind: str, axes: np.ndarray, leading: int, cosine: float, reach: float, leaf: int) -> Iterator[pa.RecordBatch]:
    """Over all pairs of blocks of a task: links by node (copies counted; b is the node), and edges that join what is linked."""
    sides: dict[int, _Side] = {}
    most = 3 * GROUP_BYTES // (width * np.dtype(kind).itemsize)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    many, k = 0, 0

    def out(a: np.ndarray, links: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(links.astype(np.int64)), pa.array(b)], ["a", "links", "b"])

    def links() -> Iterator[pa.RecordBatch]:
        for s in sides.values():
            hit = s.links > 0
            if hit.any():
                yield out(s.node[hit], s.links[hit], s.node[hit])
        sides.clear()

    for f in frames:
        for r in range(f.num_rows):
            ids = [f.column(s)[r].as_py() for s in "ab"]
            if not sides.keys() >= set(ids) and sum(len(s.x) for s in sides.values()) > most:
                yield from links()
            new = [block for block in dict.fromkeys(ids) if block not in sides]
            sides |= {block: _Side(f, r, "ab"[ids.index(block)], width, kind, axes, leading, leaf) for block in new}
            a, b = (sides[block] for block in ids)
            k = k or _dimensions(a, b, cosine)
            for block in new:
                sides[block].settle(k)
            for i, j in _linked(a, b, cosine, reach, leaf):
                a.links += np.bincount(i, b.copies[j], len(a.links))
                b.links += np.bincount(j, a.copies[i], len(b.links))
                u, v = a.label[i], b.label[j]
                if (u == v).all():
                    continue
                node, root = _forest(u[u != v], v[u != v])
                for s, rows in ((a, i), (b, j)):
                    at = np.minimum(np.searchsorted(node, s.label[rows]), len(node) - 1)
                    moved = node[at] == s.label[rows]
                    s.label[rows[moved]] = root[at[moved]]
                edges.append((node, root))
                many += len(node)
                if many > EDGES:
                    node, root = _forest(*(np.concatenate(e) for e in zip(*edges, strict=True)))
                    edges, many = [(node, root)], len(node)
                    if many > EDGES // 2:
                        yield out(node, np.zeros(many), root)
                        edges, many = [], 0
    yield from links()
    if edges:
        node, root = _forest(*(np.concatenate(e) for e in zip(*edges, strict=True)))
        yield out(node, np.zeros(len(node)), root)


def _block_pairs(blocks: DataFrame, groups: int, leading: int, reach: float) -> DataFrame:
    """Every two blocks whose boxes are within reach, once, and each block with itself.

    A Cartesian product of partitions: its tasks read both sides from the written blocks, so it
    takes no disk. Which of (a, b) and (b, a) is taken goes by the parity of a + b, so that no
    task has much more than half of its pairs to compare.
    """
    a, b = (blocks.coalesce(groups).select(*[F.col(c).alias(s if c == "block" else f"{s}_{c}") for c in blocks.columns]) for s in "ab")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col("a_lo")[d] - F.col("b_hi")[d], F.col("b_lo")[d] - F.col("a_hi")[d]), F.lit(2.0)) for d in range(leading)), F.lit(0.0))
    once = (F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) & ((F.col("a") + F.col("b")) % 2 == 0)) | ((F.col("a") > F.col("b")) & ((F.col("a") + F.col("b")) % 2 == 1))
    both = a.hint("shuffle_replicate_nl").crossJoin(b).where(once & (gap <= reach))
    return both.select("a", "b", *[f"{s}_{c}" for s in "ab" for c in ("node", "copies", "size", "x")])


@contextmanager
def _short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows: a row is two blocks, of which a full batch would take some hundred MB of a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, leading: int = LEADING) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable), kept for every row of (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite numbers, link with nothing;
    vectors of different lengths do not link. Equal vectors are compared once, with their
    number. Repeated rows are vectors of their own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    reach = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    of = vectors.schema["embedding"].dataType
    kind = "f4" if isinstance(of, ArrayType) and isinstance(of.elementType, FloatType) else "f8"
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast(f"array<{'float' if kind == 'f4' else 'double'}>").alias("embedding"))
    units = scratch.write(rows.mapInArrow(lambda it: _keyed(it, kind), "row long, id long, key binary, size int, raw binary"), "units")
    first = units.agg(F.max("size").alias("width"), F.count("raw").alias("n")).first()
    width = max(1, first.width or 0)
    leading = min(leading, width)
    held = units.where("raw is not null")
    axes = principal(held, width, kind, min(width, max(leading, BOUNDS[-1])))
    top, side = axes[:, :leading], float(np.sqrt(reach))

    @F.arrow_udf("bigint")
    def cell(raw: pa.Array) -> pa.Array:
        y = np.clip(np.floor(_units(_matrix(raw, width, kind)) @ top / side), -128, 127).astype(np.int64) + 128
        return pa.array((y << (8 * np.arange(leading - 1, -1, -1))).sum(axis=1)) if leading < 8 else pa.array(((y - 128 + 64) << (7 * np.arange(leading - 1, -1, -1))).sum(axis=1))

    rows = scratch.write(units.select("row", "id", "key"), "rows")
    held = scratch.write(held.select("key", cell("raw").alias("cell"), "size", "raw"), "held")
    scratch.drop(units)
    classes = rows.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    classes = scratch.write(classes.join(held.groupBy("key").agg(F.min("cell").alias("cell")), "key"), "classes")

    line = width * np.dtype(kind).itemsize
    block = max(1, min(BLOCK, BLOCK_BYTES // line))
    groups = max(-(-first.n * line // GROUP_BYTES), min(-(-first.n // block), int(np.ceil(3 * np.sqrt(spark.sparkContext.defaultParallelism)))), 1)
    files = max(-(-first.n * line // FILE_BYTES), groups)
    both = classes.select("cell", "key", "node", "copies", F.lit(0).alias("size"), F.lit(None).cast("binary").alias("raw"))
    both = both.unionByName(held.select("cell", "key", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("copies"), "size", "raw"))
    ordered = both.repartitionByRange(files, "cell", "key").sortWithinPartitions("cell", "key", F.col("raw").isNotNull())
    kept = "block long, node binary, copies binary, size binary, x binary, lo array<double>, hi array<double>"
    blocks = scratch.write(ordered.mapInArrow(lambda it: _blocks(it, width, kind, top, block), kept), "blocks")
    scratch.drop(held)
    leaf = LEAF
    pairs = _block_pairs(blocks, groups, leading, reach)
    found = pairs.mapInArrow(lambda it: _compare(it, width, kind, axes, leading, cosine, reach, leaf), "a long, links long, b long")
    with _short_batches(spark, max(1, BATCH_BYTES // (2 * block * line))):
        found = scratch.write(found, "found")
    scratch.drop(blocks)
    roots = scratch.write(connected_components(found.select("a", "b"), scratch), "roots")
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    known = classes.join(links, "node", "left").join(roots, "node", "left")
    known = scratch.write(known.select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "known")
    out = rows.join(known, "key", "left").select("id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("root", "row").alias("root"))
    out = scratch.write(out, "labelled")
    least = out.groupBy("root").agg(F.min("id").alias("component_id"))
    return out.join(least, "root").select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
