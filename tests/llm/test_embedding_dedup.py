"""Embedding near-dedup: disk by vectors and not by pairs, bounds, blocks and tasks of any size against brute force."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest

from tidecast.llm import embedding_dedup as e


def expected(x, copies=None):
    """Links and roots (least index) of each row at a cosine of 0.9."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T) >= 0.9
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(root[i], *root[link[i]]) if link[i].any() else root[i] for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    return link.sum(axis=1), root


def groups_of_near(rng, n, width, spread=0.05):
    x = rng.normal(size=(n, width))
    of = rng.integers(0, n // 4, n // 2)
    x[n // 2 :] = x[of] * rng.choice([1.0, 3.0], (n - n // 2, 1)) + rng.normal(size=(n - n // 2, width)) * rng.choice([0.0, spread, 0.3], (n - n // 2, 1))
    return x


def answers(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in e.near_vectors(df).collect()}


def local_bytes(spark):
    """Shuffle files of this process."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = (os.path.join(d, f) for top in dirs for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_"))
    return sum(os.path.getsize(f) for f in files)


def test_vectors_are_not_shuffled_for_each_pair_of_blocks(spark):
    """Twelve thousand vectors in all directions: every pair of blocks is compared, the shuffled bytes stay below 3 times the input."""
    x = np.random.default_rng(1).normal(size=(12000, 64)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")  # as if the blocks were many
    try:
        before = local_bytes(spark)
        assert sum(v == (0, k, True) for k, v in answers(df).items()) == len(x)
        assert local_bytes(spark) - before < 3 * x.nbytes
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_small_blocks_files_and_groups(spark, monkeypatch, kind):
    for name, value in (("BLOCK", 32), ("FILE_BYTES", 4096), ("GROUP_BYTES", 16384), ("LEAF", 8)):
        monkeypatch.setattr(e, name, value)
    rng = np.random.default_rng(2)
    x = groups_of_near(rng, 400, 20)
    x[350:] = x[5] + rng.normal(size=(50, 20)) * 0.02  # over more than a block
    x[340:350] = x[17]  # exact copies
    x = x.astype(np.float32 if kind == "float" else float).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(5)
    links, root = expected(x)
    assert answers(df) == {i: (links[i], root[i], root[i] == i) for i in range(len(x))}


def test_lengths_and_holes(spark):
    """Shorter vectors link among themselves only, though padded they are near others; rows with a hole link with nothing."""
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (1, [*v, 0.0]), (2, v), (3, [2.0, 4.0, 6.0]), (4, [*v, 0.01]), (5, [1.0, None, 3.0]), (6, [1.0, None, 3.0]), (7, [-1.0, -2.0, -3.0]), (8, None), (9, [])]
    got = answers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got == {0: (2, 0, True), 1: (1, 1, True), 2: (2, 0, False), 3: (2, 0, False), 4: (1, 1, False), **{i: (0, i, True) for i in range(5, 10)}}


def record(x, copies, blocks, i, j):
    d = {}
    for s, k in (("a", i), ("b", j)):
        at = np.flatnonzero(blocks == k)
        d[s] = pa.array([k])
        for c, v in (("node", at), ("copies", copies[at]), ("size", np.full(len(at), x.shape[1]))):
            d[f"{s}_{c}"] = pa.array([v.astype(np.int64).tobytes()], pa.binary())
        d[f"{s}_x"] = pa.array([x[at].tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(list(d.values()), list(d))


@pytest.mark.parametrize(("group", "edges"), [(1 << 25, 1 << 20), (16 * 8 * 20, 1 << 20), (1 << 25, 4)])
def test_tasks_that_forget_give_the_same(monkeypatch, group, edges):
    """Links and edges of a task agree with brute force, whether or not it must let go of blocks or edges between."""
    monkeypatch.setattr(e, "GROUP_BYTES", group)
    monkeypatch.setattr(e, "EDGES", edges)
    rng = np.random.default_rng(3)
    x = groups_of_near(rng, 300, 16)
    x[250:] = x[0] + rng.normal(size=(50, 16)) * 0.01  # dense: the whole product is made again
    copies, blocks = rng.integers(1, 4, 300), np.sort(rng.integers(0, 6, 300))
    frames = [record(x, copies, blocks, i, j) for i in range(6) for j in range(6) if i == j or (i < j) == ((i + j) % 2 == 0)]
    axes = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    out = pa.Table.from_batches(list(e._compare(iter(frames), 16, "f8", axes, 8, 0.9, 0.2 + 1e-9, 16)))
    a, links, b = (out.column(c).to_numpy() for c in ("a", "links", "b"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T) >= 0.9
    np.fill_diagonal(link, False)
    assert (np.bincount(a, links, 300) == (link * copies).sum(axis=1)).all()
    _, root = expected(x)
    assert (e._roots(300, a, b) == root).all()


def test_bounds_are_never_below_the_cosine():
    rng = np.random.default_rng(4)
    x = groups_of_near(rng, 300, 40).astype(np.float32)
    axes = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    side = e._Side(record(x, np.ones(300), np.zeros(300), 0, 0), 0, "a", 40, "f4", axes, 8, 64)
    u = e._units(x)
    for k in (1, 8, 24, 39, 40):
        y = side.bounds(k)
        assert (y @ y.T >= u @ u.T - e.SLACK / 4).all()
