"""Spelling variant grouping by a frequency-vector trie.

A word's frequency vector holds how many of its letters fall in each of a fixed number of
letter groups; the counts, one after the other, are its path in a trie. One inserted letter
raises one count by one, a deleted one lowers one, a replaced one does both or neither. So a
depth-first search that walks the trie with a budget of one surplus and one deficit reaches
every leaf that can hold a word one edit away, and the words of these leaves are verified.

The trie is dealt out by the counts of its first levels: each task holds the words below one
top node, and words are sent as queries to the top nodes that their budget can reach. How many
levels are the top comes from the sizes of the nodes; a leaf that is too large for a task
is dealt out in blocks that meet its queries block by block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import _BYTE, Scratch, _powers, mix, table


@dataclass(frozen=True)
class VariantSpec:
    """Words of min_length letters or more that occur min_count times or more; a word's form is ratio times as frequent.

    typos: if not 0, a run whose crc32 (of doc_id, colon and run) it divides loses one letter.
    groups: levels of the trie. max_words, max_queries: rows of a task, from which blocks are cut.
    """

    min_length: int = 5
    min_count: int = 3
    ratio: int = 2
    typos: int = 0
    groups: int = 16
    max_words: int = 1 << 15
    max_queries: int = 1 << 17


#: Bits of a count in a packed vector. Larger counts are cut to TOP, which keeps a difference of one at one or nought.
BITS = 3
TOP = (1 << BITS) - 1
_RUN = re.compile("[a-zÀ-ÿ]+")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
#: Characters of a text worked on at a time.
PIECE = 1 << 20
#: Widest word compared in a matrix; longer ones are compared one by one.
WIDE = 40


# ---------------------------------------------------------------- counting words


def _pieces(text: str) -> Iterator[str]:
    """Parts of at most PIECE characters, or one run; no run is cut."""
    at = 0
    while len(text) - at > PIECE:
        gap = _BREAK.search(text, at + PIECE)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def _with_typo(run: str, crc: int, typos: int) -> str:
    h = zlib.crc32(run.encode(), crc)
    if h % typos:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _count_runs(frames: Iterator[pa.RecordBatch], typos: int) -> Iterator[pa.RecordBatch]:
    """(word, n): occurrences, added up over a bounded number of distinct words."""
    held: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for f in frames:
        for doc, text in zip(f.column(0), f.column(1), strict=True):
            crc = zlib.crc32(f"{doc.as_py()}:".encode()) if doc.is_valid else zlib.crc32(b":")
            for piece in _pieces(text.as_py() or ""):
                runs = Counter(_RUN.findall(piece.encode().lower().decode()))  # bytes.lower: A-Z only
                if typos:
                    for run, n in runs.items():
                        held[_with_typo(run, crc, typos)] += n
                else:
                    held.update(runs)
                if len(held) > 200_000:
                    yield flush()
    if held:
        yield flush()


def count_words(docs: DataFrame, spec: VariantSpec = VariantSpec()) -> DataFrame:
    """(word, n): lower-cased (A-Z) runs of letters of the whole texts, long and frequent enough."""
    rows = docs.select(F.col("doc_id").cast("string"), "text").where("text is not null")
    parts = rows.mapInArrow(lambda it: _count_runs(it, spec.typos), "word string, n long")
    # short words go before the shuffle
    sums = parts.where(F.length("word") >= spec.min_length).groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= spec.min_count)


def letter_groups(words: DataFrame, groups: int) -> dict[str, int]:
    """Group of each letter: frequent letters first, each to the group that is lightest so far.

    The driver gets one row for each letter of the alphabet, 90 at most.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").groupBy("c").count().collect()
    load, group = [0] * groups, {}
    for r in sorted(letters, key=lambda r: (-r["count"], r["c"])):
        at = min(range(groups), key=lambda g: (load[g], g))
        group[r["c"]] = at
        load[at] += r["count"]
    return group


# ---------------------------------------------------------------- words as arrays


class Words:
    """Letters (one byte each), packed vectors and half hashes of an array of words."""

    def __init__(self, words: pa.Array, group: np.ndarray, groups: int):
        self.words = words
        self.n = np.asarray(pc.utf8_length(words).to_numpy(zero_copy_only=False), np.int64)
        # all letters are below U+0100, so Latin-1 has one byte for each
        text = b"".join(w.encode("latin-1") for w in words.to_pylist())
        self.codes = np.frombuffer(text, np.uint8)
        self.end = np.cumsum(self.n)
        self.begin = self.end - self.n
        row = np.repeat(np.arange(len(words)), self.n)
        counts = np.bincount(row * groups + group[self.codes], minlength=len(words) * groups).reshape(-1, groups)
        self.key = np.zeros(len(words), np.int64)
        for g in range(groups):
            self.key = (self.key << BITS) | np.minimum(counts[:, g], TOP)
        up, self._down = _powers(len(text) + 1)
        self._run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.codes] * up[: len(text)], dtype=np.uint64)])

    def part(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the letters from begin to end, whatever stands around them."""
        return (self._run[end] - self._run[begin]) * self._down[begin]

    def halves(self, longer: bool) -> list[np.ndarray]:
        """Hashes of the first and last half; for the longer word of a pair, of the halves of the shorter one's length."""
        n = self.n - 1 if longer else self.n
        return [self.part(self.begin, self.begin + n // 2), self.part(self.end - (n - n // 2), self.end)]

    def matrix(self, rows: np.ndarray, width: int, skip: int = 0) -> np.ndarray:
        """Letters of some words from their letter number ``skip`` on, one row each, 0 after the end."""
        at = self.begin[rows, None] + np.arange(skip, width + skip)
        inside = at < self.end[rows, None]
        return np.where(inside, self.codes[np.minimum(at, len(self.codes) - 1)], 0)


def _one_edit(a: str, b: str) -> bool:
    """Whether b, as long as a or one longer, comes from a by one replaced or inserted letter."""
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :])


def verified(a: Words, b: Words, ia: np.ndarray, ib: np.ndarray, longer: bool) -> np.ndarray:
    """Which of the pairs (a[ia], b[ib]) are one replaced letter (or, if ``longer``, one more letter of b) apart."""
    good = b.n[ib] == a.n[ia] + int(longer)
    narrow = good & (b.n[ib] <= WIDE)
    for at in np.flatnonzero(good & ~narrow):
        good[at] = _one_edit(a.words[ia[at]].as_py(), b.words[ib[at]].as_py())
    rows = np.flatnonzero(narrow)
    for lo in range(0, len(rows), 1 << 16):
        at = rows[lo : lo + (1 << 16)]
        width = int(b.n[ib[at]].max())
        x, y = a.matrix(ia[at], width), b.matrix(ib[at], width)
        if longer:
            head = np.logical_and.accumulate(x == y, axis=1)
            good[at] = (head | (x == b.matrix(ib[at], width, skip=1))).all(axis=1)
        else:
            good[at] = (x != y).sum(axis=1) == 1
    return good


# ---------------------------------------------------------------- search


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position): every position from lo to hi of each row."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _full(keys: np.ndarray, groups: int) -> np.ndarray:
    """A bit for each count that has reached TOP and may have been cut."""
    ones = sum(1 << (BITS * g) for g in range(groups))
    out = keys
    for k in range(1, BITS):
        out = out & (keys >> k)
    return out & ones


def leaf_pairs(a: np.ndarray, b: np.ndarray, groups: int, block: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(leaf of a, leaf of b, whether b's words can be as long, or one letter longer) within the budget.

    a, b: sorted distinct packed vectors. A node is the packed counts down to it. Blocks of
    node pairs are taken from a stack, so the search goes down before it goes on and holds
    little more than a block for each level. Two counts cut at the same level may hide a
    surplus or a deficit, so such leaves are kept for both lengths.
    """
    shifts = [BITS * (groups - 1 - g) for g in range(groups)]
    nodes = [(np.unique(a >> s), np.unique(b >> s)) for s in shifts]
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool), np.zeros(1, bool))] if len(a) and len(b) else []
    while stack:
        level, pa_, pb, surplus, deficit = stack.pop()
        if level == groups:
            blurred = (_full(pa_, groups) & _full(pb, groups)) != 0
            alike, longer = (surplus == deficit) | blurred, (surplus & ~deficit) | blurred
            keep = alike | longer
            yield pa_[keep], pb[keep], alike[keep], longer[keep]
            continue
        na, nb = nodes[level]
        row, at = _spans(np.searchsorted(na, pa_ << BITS), np.searchsorted(na, (pa_ + 1) << BITS))
        child = na[at]
        count = child & TOP
        base = (pb[row] << BITS) + count
        for diff in (-1, 0, 1):
            fits = (count + diff >= 0) & (count + diff <= TOP)
            if diff:
                fits &= ~(surplus if diff > 0 else deficit)[row]
            to = base + diff
            found = np.minimum(np.searchsorted(nb, to), len(nb) - 1)
            r = np.flatnonzero(fits & (nb[found] == to))
            for lo in range(0, len(r), block):
                k = r[lo : lo + block]
                stack.append((level + 1, child[k], to[k], surplus[row[k]] | (diff > 0), deficit[row[k]] | (diff < 0)))


def near_words(a: Words, b: Words, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of a, of b) of the words one edit apart, b as long or one letter longer; of two as long, one direction."""
    order = np.argsort(a.key, kind="stable")
    sorted_key = a.key[order]
    own = a.halves(False)
    # words of b by (leaf, half): a pair one edit apart has an equal first or last half
    index = []
    for longer in (False, True):
        for half in b.halves(longer):
            k = mix(half + mix(b.key.view(np.uint64)))
            by = np.argsort(k, kind="stable")
            index.append((k[by], by))
    whole_a, whole_b = a.part(a.begin, a.end), b.part(b.begin, b.end)
    for la, lb, *lengths in leaf_pairs(np.unique(sorted_key), np.unique(b.key), groups):
        row, at = _spans(np.searchsorted(sorted_key, la), np.searchsorted(sorted_key, la, "right"))
        words, leaf = order[at], mix(lb.view(np.uint64))[row]
        for side in (False, True):
            mine = np.flatnonzero(lengths[side][row])
            for half in (0, 1):
                keys, by = index[2 * side + half]
                for lo in range(0, len(mine), 1 << 18):
                    m = mine[lo : lo + (1 << 18)]
                    k = mix(own[half][words[m]] + leaf[m])
                    r, pos = _spans(np.searchsorted(keys, k), np.searchsorted(keys, k, "right"))
                    ia, ib = words[m][r], by[pos]
                    if half:  # met by the first half already
                        n = a.n[ia] // 2
                        fresh = a.part(a.begin[ia], a.begin[ia] + n) != b.part(b.begin[ib], b.begin[ib] + n)
                        ia, ib = ia[fresh], ib[fresh]
                    if not side:
                        ha, hb = whole_a[ia], whole_b[ib]
                        first = ha < hb
                        for t in np.flatnonzero(ha == hb):
                            first[t] = a.words[ia[t]].as_py() < b.words[ib[t]].as_py()
                        ia, ib = ia[first], ib[first]
                    good = verified(a, b, ia, ib, side)
                    yield ia[good], ib[good]


def near_pairs(words: DataFrame, spec: VariantSpec, scratch: Scratch) -> DataFrame:
    """(a, na, b, nb): every two near words of ``words`` (word, n) once, found by the dealt-out trie."""
    group = letter_groups(words, spec.groups)
    code = np.zeros(256, np.int64)
    for c, g in group.items():
        code[ord(c)] = g

    def packed(word: pa.Array) -> pa.Array:
        return pa.array(Words(word, code, spec.groups).key if len(word) else np.empty(0, np.int64))

    paths = scratch.write(words.select("word", "n", F.arrow_udf(packed, "long")("word").alias("path")), "paths")
    depth = _top_levels(paths, spec)
    shift = BITS * (spec.groups - depth)
    homes = paths.select(F.shiftright("path", shift).alias("node"), "word", "n")
    asks = paths.select(F.explode(_reach(F.shiftright("path", shift), depth)).alias("node"), "word", "n")
    sizes = homes.groupBy("node").agg(F.count("*").alias("words"))
    asks = asks.join(sizes.select("node"), "node", "left_semi")
    asked = asks.groupBy("node").agg(F.count("*").alias("queries"))
    # a node is a grid of (block of words) x (block of queries), mostly one by one
    plan = sizes.join(asked, "node").select("node", F.ceil(F.col("words") / spec.max_words).alias("wide"), F.ceil(F.col("queries") / spec.max_queries).alias("tall"))
    plan = scratch.write(plan, "nodes")
    deal = F.xxhash64("word")
    homes = homes.join(plan, "node").select("node", F.pmod(deal, "wide").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tall") - 1)).alias("j"), F.lit(True).alias("home"), "word", "n")
    asks = asks.join(plan, "node").select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("i"), F.pmod(deal, "tall").alias("j"), F.lit(False).alias("home"), "word", "n")

    def search(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        home = part["home"]
        b, a = part.filter(home), part.filter(pc.invert(home))
        wa, wb = (Words(_one(t["word"]), code, spec.groups) for t in (a, b))
        found = [np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*near_words(wa, wb, spec.groups), strict=True)] or [np.empty(0, np.int64)] * 2
        left, right = a.take(found[0]), b.take(found[1])
        return pa.table({"a": left["word"], "na": left["n"], "b": right["word"], "nb": right["n"]})

    return homes.unionByName(asks).groupBy("node", "i", "j").applyInArrow(search, "a string, na long, b string, nb long")


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())


def _top_levels(paths: DataFrame, spec: VariantSpec) -> int:
    """Fewest levels below which no node holds more than max_words words (all levels if one leaf does)."""
    leaves = paths.groupBy("path").agg(F.count("*").alias("n"))
    level = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("path", BITS * (spec.groups - d)).alias("node")) for d in range(1, spec.groups + 1)]))
    nodes = leaves.select("n", level.alias("at")).groupBy("at.depth", "at.node").agg(F.sum("n").alias("n"))
    fit = [r.depth for r in nodes.groupBy("depth").agg(F.max("n").alias("most")).collect() if r.most <= spec.max_words]
    return min(fit, default=spec.groups)


def _reach(node, depth: int):
    """The top nodes that a budget of one surplus and one deficit can reach, the own one included."""
    steps = [1 << (BITS * i) for i in range(depth)]

    def count(i: int):
        return F.shiftright(node, BITS * i).bitwiseAND(TOP)

    up = [F.when(count(i) < TOP, F.lit(s).cast("long")) for i, s in enumerate(steps)]
    down = [F.when(count(i) > 0, F.lit(-s).cast("long")) for i, s in enumerate(steps)]
    both = [u + d for i, u in enumerate(up) for j, d in enumerate(down) if i != j]
    return F.array_compact(F.array(node, *[node + x for x in (*up, *down, *both)]))


# ---------------------------------------------------------------- forms and roots


def spelling_variants(docs: DataFrame, spec: VariantSpec = VariantSpec()) -> DataFrame:
    """word, form, root, n, n_near, form_n for every long and frequent enough word of ``docs`` (doc_id, text).

    form: the most frequent word one edit away (ties: smallest in code-point order), if it is
    ratio times as frequent as the word, else null. root: the last of the forms from the word
    on, itself without one. Null or empty texts hold no words, a null doc_id counts as an empty
    one, repeated rows count each. An empty table gives an empty result; other columns are
    ignored. Texts are read in pieces, so their length does not matter.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.write(count_words(docs, spec), "words")
    pairs = near_pairs(words, spec, scratch)
    ends = F.array(
        F.struct(F.col("a").alias("word"), (-F.col("nb")).alias("less"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), (-F.col("na")).alias("less"), F.col("a").alias("near")),
    )
    links = pairs.select(F.explode(ends).alias("e")).groupBy(F.col("e.word").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct("e.less", "e.near")).alias("best"))
    form_n = F.when(-F.col("best.less") >= F.col("n") * spec.ratio, -F.col("best.less"))
    found = words.join(links, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"), F.when(form_n.isNotNull(), F.col("best.near")).alias("form"))
    found = scratch.write(found, "forms")
    roots = _roots(found.where("form is not null").select("word", F.col("form").alias("root")), scratch)
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """Every (word, root) followed to its end. A form is at least ratio times as frequent, so chains
    are short and have no circle; each round doubles the way that is done."""
    now = scratch.write(steps, "steps")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.write(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new.drop("moved")
        now.scratch_path = new.scratch_path


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the words of ``documents``, with planted typos; see ``spelling_variants`` for nulls, ties and repeats."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), VariantSpec(typos=97))
