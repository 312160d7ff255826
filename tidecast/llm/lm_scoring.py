"""Hidden Markov language model over word classes.

A word's class is itself for the most frequent words, and one of a fixed number of classes by
its last three bytes for the rest; within its class a word has its add-one probability from
exact corpus counts. A hidden Markov model over the classes is trained by Baum-Welch: each
partition adds up expected counts, which Spark adds up over partitions. Scaled forward
recursion then gives the exact log-likelihood of every whole text.

What is broadcast is bounded by parameters (states x classes, and the counts of known_words
frequent words); the counts of all other words are joined as a table, and grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import PIECE, Scratch, _hash_piece, mix, table, texts, word_hashes

#: Stands for the end of a text among the word hashes.
END = 1


@dataclass(frozen=True)
class HmmSpec:
    """segment: longest run of tokens that training takes as one sequence (scoring takes whole texts)."""

    states: int = 8
    rounds: int = 4
    own_classes: int = 2048
    shared_classes: int = 1024
    known_words: int = 1 << 15
    segment: int = 128
    prior: float = 20.0
    seed: int = 5

    @property
    def classes(self) -> int:
        return self.own_classes + self.shared_classes


def _words(column: pa.Array, spec: HmmSpec) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of rows as (first row, token hashes, shared classes, token offsets); every text ends with END."""
    data, off = texts(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + PIECE, "right")) - 1)
        if off[last] - off[row] <= PIECE:
            part = data[off[row] : off[last]]
            h, begin, end = _hash_piece(part, off[row:last] - off[row])
            at = np.searchsorted(begin, off[row : last + 1] - off[row])
            shared = _shared(part, begin, end, spec)
        else:
            hs, cs, pos = [], [], int(off[row])
            for _, h, _ in word_hashes(column.slice(row, 1)):
                hs.append(h)
            while pos < off[last]:
                to = _after_word(data, min(pos + PIECE, int(off[last])), int(off[last]))
                _, begin, end = _hash_piece(data[pos:to], np.zeros(1, np.int64))
                cs.append(_shared(data[pos:to], begin, end, spec))
                pos = to
            h, shared = np.concatenate(hs), np.concatenate(cs)
            at = np.array([0, len(h)])
        where = at[1:]
        yield row, np.insert(h, where, np.uint64(END)), np.insert(shared, where, 0), at + np.arange(len(at))
        row = last


def _after_word(data: np.ndarray, at: int, end: int) -> int:
    while at < end and not (data[at] == 0x20 or 0x09 <= data[at] <= 0x0D):
        at += 1
    return at


def _shared(data: np.ndarray, begin: np.ndarray, end: np.ndarray, spec: HmmSpec) -> np.ndarray:
    """Class among the shared ones by the last three bytes of the lower-cased word."""
    low = data.astype(np.uint64)
    low[(data >= 65) & (data <= 90)] += np.uint64(32)
    code = np.zeros(len(begin), np.uint64)
    for back in (1, 2, 3):
        at = end - back
        code = code * np.uint64(257) + np.where(at >= begin, low[np.maximum(at, 0)] + np.uint64(1), np.uint64(0))
    return (mix(code) % np.uint64(spec.shared_classes)).astype(np.int64)


def _count_words(frames: Iterator[pa.RecordBatch], spec: HmmSpec) -> Iterator[pa.RecordBatch]:
    """(h, shared, n): occurrences of words, added up within a bounded amount of text."""
    held: list[np.ndarray] = []
    kinds: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if held:
            h, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            kind = np.concatenate(kinds)[first]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "shared", "n"])
            held.clear()
            kinds.clear()
            size = 0

    for f in frames:
        for _, h, kind, _ in _words(f.column("text"), spec):
            held.append(h)
            kinds.append(kind)
            size += len(h)
            if size >= 4_000_000:
                yield from flush()
    yield from flush()


@dataclass
class Vocabulary:
    """Counts the tasks need: of the frequent words (sorted by hash) and of the shared classes."""

    hashes: np.ndarray
    counts: np.ndarray
    own: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int


def _vocabulary(counts: DataFrame, spec: HmmSpec) -> Vocabulary:
    # a histogram of the counts finds a floor, so tasks send the driver few more words than it keeps
    level = F.floor(F.log2(F.col("c")) * 8).cast("int")
    floor = upto = 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        floor, upto = r.level, upto + r.n
        if upto >= spec.known_words:
            break
    top = counts.where(level >= floor).orderBy(F.desc("c"), "h").limit(spec.known_words).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    c = top["c"].to_numpy(np.int64)
    shared = top["shared"].to_numpy(np.int64)
    own = np.full(len(h), -1, np.int64)
    own[: spec.own_classes] = np.arange(len(own))[: spec.own_classes]
    if len(h) and (at := np.flatnonzero(h == np.uint64(END))).size and own[at[0]] < 0:
        own[at[0]] = own[0]
        own[0] = -1
        own[at[0]] = 0
    sums = counts.groupBy("shared").agg(F.sum("c").alias("c"), F.count("*").alias("w")).toPandas()
    tokens, words = np.zeros(spec.classes, np.int64), np.zeros(spec.classes, np.int64)
    tokens[spec.own_classes + sums["shared"].to_numpy(np.int64)] = sums["c"]
    words[spec.own_classes + sums["shared"].to_numpy(np.int64)] = sums["w"]
    mine = own >= 0
    np.subtract.at(tokens, spec.own_classes + shared[mine], c[mine])
    np.subtract.at(words, spec.own_classes + shared[mine], 1)
    total, distinct = int(sums["c"].sum()), int(sums["w"].sum())
    tokens[own[mine]] = c[mine]
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], own[order], tokens, words, total, distinct)


def _encoded(frames: Iterator[pa.RecordBatch], spec: HmmSpec, v: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Each text as classes, with the parts of its scores that the frequent words decide."""
    share = np.log10(v.class_tokens + v.class_words + 1.0)
    for f in frames:
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "within", "classes", "rare", "times")}
        for _, h, shared, at in _words(f.column("text"), spec):
            if len(v.hashes):
                pos = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
                known = v.hashes[pos] == h
                own = np.where(known, v.own[pos], -1)
                gain = np.where(known, np.log10(v.counts[pos] + 1.0), 0.0)
            else:
                known, own, gain = np.zeros(len(h), bool), np.full(len(h), -1), np.zeros(len(h))
            cls = np.where(own >= 0, own, spec.own_classes + shared)
            within = np.where(own >= 0, 0.0, gain - share[cls])
            run = [np.concatenate([[0], np.cumsum(x)]) for x in (known, gain, within)]
            ends = [r[at] for r in run]
            out["n_tokens"] += np.diff(at).tolist()
            out["n_known"] += np.diff(ends[0]).astype(int).tolist()
            out["base"] += (np.diff(ends[1]) - np.diff(at) * np.log10(v.tokens + v.words + 1.0)).tolist()
            out["within"] += np.diff(ends[2]).tolist()
            small = cls.astype(np.int16)
            rare = ~known
            for a, b in zip(at, at[1:], strict=False):
                out["classes"].append(small[a:b].tobytes())
                ids, n = np.unique(h[a:b][rare[a:b]], return_counts=True)
                out["rare"].append(ids.view(np.int64))
                out["times"].append(n)
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "within": pa.float64(), "classes": pa.binary(), "rare": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([*[f.column(c) for c in ("row", "id", "held_out")], *[pa.array(out[k], t) for k, t in kinds.items()]], ["row", "id", "held_out", *kinds])


@dataclass
class Hmm:
    """start: of a text (row 0) and of a later segment (row 1); move: states x states; emit: states x classes."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _segments(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of segments, long ones first: classes (segments x length), lengths, whether not the first of a text."""
    parts, later, size = [], [], 0
    for raw in column:
        x = np.frombuffer(raw.as_py(), np.int16)
        for at in range(0, len(x), length):
            parts.append(x[at : at + length])
            later.append(at > 0)
            size += 1
            if size == 2048:
                yield _stacked(parts, later, length)
                parts, later, size = [], [], 0
    if parts:
        yield _stacked(parts, later, length)


def _stacked(parts: list, later: list, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(p) for p in parts])
    order = np.argsort(-n, kind="stable")
    out = np.zeros((len(parts), length), np.int64)
    for r, k in enumerate(order):
        out[r, : n[k]] = parts[k]
    return out, n[order], np.array(later, np.int64)[order]


def expected_counts(x: np.ndarray, n: np.ndarray, later: np.ndarray, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of the segments ``x`` (lengths n, in falling order)."""
    rows, steps = len(x), int(n[0])
    k, classes = m.emit.shape
    live = [int(np.searchsorted(-n, -t, "left")) for t in range(steps)]  # segments longer than t
    emit = np.ascontiguousarray(m.emit.T)
    a = np.zeros((steps, rows, k))
    scale = np.ones((steps, rows))
    for t in range(steps):
        r = live[t]
        now = m.start[later[:r]] if t == 0 else a[t - 1, :r] @ m.move
        now = now * emit[x[:r, t]]
        scale[t, :r] = now.sum(axis=1)
        a[t, :r] = now / scale[t, :r, None]
    move = np.zeros((k, k))
    back = np.ones((rows, k))
    for t in range(steps - 1, -1, -1):
        r = live[t + 1] if t + 1 < steps else 0
        if r:
            ahead = emit[x[:r, t + 1]] * back[:r] / scale[t + 1, :r, None]
            move += a[t, :r].T @ ahead
            back[:r] = ahead @ m.move.T
            a[t, :r] *= back[:r]
    mask = np.arange(steps) < n[:, None]
    start = np.zeros((2, k))
    np.add.at(start, later, a[0])
    codes = x[:, :steps][mask]
    post = a.transpose(1, 0, 2)[mask]
    out = np.stack([np.bincount(codes, post[:, s], classes) for s in range(k)])
    return start, move * m.move, out


def _partition_counts(frames: Iterator[pa.RecordBatch], m: Hmm, length: int) -> Iterator[pa.RecordBatch]:
    k, classes = m.emit.shape
    total = [np.zeros((2, k)), np.zeros((k, k)), np.zeros((k, classes))]
    for f in frames:
        for x, n, later in _segments(f.column("classes"), length):
            for t, got in zip(total, expected_counts(x, n, later, m), strict=True):
                t += got
    flat = np.concatenate([t.ravel() for t in total])
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["at", "v"])


def train(sequences: DataFrame, class_tokens: np.ndarray, spec: HmmSpec) -> Hmm:
    """Baum-Welch over all sequences (column ``classes``); the driver holds states x classes numbers."""
    rng = np.random.default_rng(spec.seed)
    k, prior = spec.states, (class_tokens + 0.5) / (class_tokens + 0.5).sum()
    emit = prior * rng.gamma(1.0, 1.0, (k, spec.classes))
    move = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))
    m = Hmm(np.full((2, k), 1.0 / k), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    sizes = [2 * k, k * k, k * spec.classes]
    for _ in range(spec.rounds):
        now = m
        parts = sequences.select("classes").mapInArrow(lambda it, now=now: _partition_counts(it, now, spec.segment), "at int, v double")
        flat = np.zeros(sum(sizes))
        sums = parts.groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        flat[sums["at"].to_numpy()] = sums["v"].to_numpy()
        start, move, emit = (x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), ((2, k), (k, k), (k, spec.classes)), strict=True))
        start, move = start + 0.1, move + 0.1
        emit = emit + spec.prior * prior
        m = Hmm(*(x / x.sum(axis=1, keepdims=True) for x in (start, move, emit)))
    return m


def log_likelihoods(sequences: list[np.ndarray], m: Hmm) -> np.ndarray:
    """log10 probability of each whole class sequence by scaled forward recursion."""
    n = np.array([len(s) for s in sequences], np.int64)
    out = np.zeros(len(n))
    emit = np.ascontiguousarray(m.emit.T)
    order = np.argsort(-n, kind="stable")
    begin = np.cumsum(n) - n
    flat = np.concatenate(sequences).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    n, begin = n[order], begin[order]
    state = np.tile(m.start[0], (len(n), 1))
    total = np.zeros(len(n))
    for t in range(int(n[0]) if len(n) else 0):
        r = int(np.searchsorted(-n, -t, "left"))
        now = state[:r] if t == 0 else state[:r] @ m.move
        now = now * emit[flat[begin[:r] + t]]
        s = now.sum(axis=1)
        total[:r] += np.log10(s)
        state[:r] = now / s[:, None]
    out[order] = total
    return out


def lm_scores(docs: DataFrame, spec: HmmSpec = HmmSpec()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of (doc_id, text).

    held_out: crc32 of the id as text, modulo 7, is 2 (a null id is not); these rows are scored
    and not learnt from. Null, empty or blank text: its end token alone. Repeated rows count
    each. Without training rows every token is unknown, and scores follow the same formulas.
    An empty table gives an empty result. Words are told apart by 64-bit hash.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    seen = rows.where("not held_out").select("text").mapInArrow(lambda it: _count_words(it, spec), "h long, shared int, n long")
    counts = scratch.write(seen.groupBy("h").agg(F.first("shared").alias("shared"), F.sum("n").alias("c")), "counts")
    v = _vocabulary(counts, spec)
    coded = "row long, id long, held_out boolean, n_tokens long, n_known long, base double, within double, classes binary, rare array<long>, times array<long>"
    texts_ = scratch.write(rows.mapInArrow(lambda it: _encoded(it, spec, v), coded), "coded")
    model = train(texts_.where("not held_out"), v.class_tokens, spec)

    def forward(classes: pa.Array) -> pa.Array:
        found, row = np.zeros(len(classes)), 0
        while row < len(classes):  # a bounded number of texts at a time
            part = [np.frombuffer(x.as_py(), np.int16) for x in classes.slice(row, 1024)]
            found[row : row + len(part)] = log_likelihoods(part, model)
            row += len(part)
        return pa.array(found)

    rare = texts_.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("n"))
    met = rare.join(counts.select("h", "c"), "h")
    met = met.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain"))
    out = texts_.select("row", "id", "held_out", "n_tokens", "n_known", "base", "within", F.arrow_udf(forward, "double")("classes").alias("hmm"))
    out = out.join(met, "row", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    return out.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("hmm") + F.col("within") + gain).alias("score"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
