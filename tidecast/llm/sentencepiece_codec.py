"""SentencePiece encoding and decoding with a max-plus scan for giant documents.

Ordinary texts are cut at word starts, where no piece of the vocabulary reaches over, and each
distinct word is encoded once per batch. A giant text is split into chunks of any cut: each
chunk yields a transfer matrix in max-plus algebra, from the states at its left boundary (how
far the token there reaches, and which it is) to those at its right one. Matrices combine
associatively, the best path through the boundaries follows, and every chunk is then
backtraced on its own.

For a unigram model the weights are the piece scores (Viterbi). For a BPE model the weights are
0 or minus infinity: a path is allowed where every two neighbouring tokens are what the merges
make of their joint text, and exactly one path through a text is allowed, its encoding.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, table, texts
from tidecast.llm.pieces import PieceTable

SPACE = "▁"
CHUNK_CHARS = 1 << 15
#: Chunk matrices combined by one task; texts of 2 GB have at most 256 such blocks.
BLOCK = 256
BATCH_BYTES = 1 << 20

#: A boundary state: how many characters the token reaches beyond the boundary, and the token.
State = tuple[int, str]
Matrix = dict[State, dict[State, float]]


class Model:
    """A SentencePiece model file: its vocabulary, and its library object for whole words."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.id = {self.names[i]: i for i in plain}
        self.longest = max(map(len, self.id))
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.unigram = self._kind(path) == 1
        probe = "  a\tb  Åﬁ "
        same = sp.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        inner = any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.id)
        if not same or inner or len(self.byte_id) < 256:
            raise ValueError("the model needs identity normalisation, byte pieces and pieces that keep to one word")

    @staticmethod
    def _kind(path: str) -> int:
        """model_type of the trainer's settings (1 unigram, 2 BPE), read from the protobuf fields."""
        with open(path, "rb") as f:
            data = f.read()

        def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
            at = 0

            def number() -> int:
                nonlocal at
                n = shift = 0
                while True:
                    x = b[at]
                    at += 1
                    n |= (x & 127) << shift
                    shift += 7
                    if x < 128:
                        return n

            while at < len(b):
                tag = number()
                if tag & 7 == 0:
                    yield tag >> 3, number()
                else:
                    n = {1: 8, 5: 4}.get(tag & 7) or number()
                    yield tag >> 3, b[at : at + n]
                    at += n

        trainer = next((v for k, v in fields(data) if k == 2), b"")
        return next((v for k, v in fields(trainer) if k == 3), 1)

    def ids(self, token: str) -> list[int]:
        """The ids of a token of a path; a character outside the vocabulary is spelt in bytes."""
        i = self.id.get(token)
        return [i] if i is not None else [self.byte_id[b] for b in token.encode("utf-8", "surrogatepass")]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Encodings of pieces that begin with a space or follow a line feed."""
        bare = [w[0] == " " and len(w) > 1 for w in words]  # the library puts a space before any text that is not empty
        found = self.lib.encode([w[1:] if b else "\n" + w for w, b in zip(words, bare, strict=True)], num_threads=1)
        return [x if b else x[2:] for x, b in zip(found, bare, strict=True)]

    @lru_cache(maxsize=1 << 16)  # noqa: B019  one model lives as long as its worker
    def allowed(self, left: str, right: str) -> bool:
        """Whether the merges of BPE leave ``left`` (may be empty) and ``right`` as they are, side by side."""
        parts = list(left + right)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in self.score), default=None)
            if best is None:
                return parts == ([left, right] if left else [right])
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def tokens_at(self, text: str, at: int) -> Iterator[str]:
        known = False
        for n in range(1, min(self.longest, len(text) - at) + 1):
            if (token := text[at : at + n]) in self.score:
                known |= n == 1
                yield token
        if not known:
            yield text[at]

    def paths(self, text: str, begin: dict[int, list[str]], end: int) -> dict[tuple[int, str], dict]:
        """Best weights from the tokens of ``begin`` (by end position) up to tokens that reach ``end``.

        Returns, by (position, token): {begin state: (weight, state before)}.
        """
        at: dict[int, dict[str, dict]] = defaultdict(dict)
        for pos, tokens in begin.items():
            for t in tokens:
                at[pos][t] = {(pos, t): (0.0, None)}
        done = {}
        for pos in range(min(begin, default=0), max(end, *begin) + self.longest + 1 if begin else 0):
            for token, reached in at.get(pos, {}).items():
                done[pos, token] = reached
                if pos >= end:
                    continue
                for nxt in self.tokens_at(text, pos):
                    if not (self.unigram or self.allowed(token, nxt)):
                        continue
                    gain = self.score.get(nxt, min(self.score.values(), default=0.0) - 10.0) if self.unigram else 0.0
                    to = at[pos + len(nxt)].setdefault(nxt, {})
                    for state, (w, _) in reached.items():
                        if state not in to or to[state][0] < w + gain:
                            to[state] = (w + gain, (pos, token))
        return done


_MODELS: dict[str, Model] = {}


def model_of(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _word_starts(text: str) -> tuple[int, int] | None:
    """First and last position where every path has a boundary: a space run after another character."""
    gap = re.compile(f"[^{SPACE}]{SPACE}")
    first = gap.search(text)
    if first is None:
        return None
    last = len(text)
    while True:
        last = text.rfind(SPACE, 0, last)
        if text[last - 1] != SPACE:
            return first.start() + 1, last


class Chunk:
    """Characters [0, size) of ``text`` after ``before`` characters of context and before more.

    Positions count from the chunk's left boundary. The text of a document's first chunk has
    no context; its only state there is (0, '').
    """

    def __init__(self, model: Model, text: str, before: int, size: int):
        self.model, self.text, self.before, self.size = model, text, before, size
        self.final = before + size == len(text)
        inner = _word_starts(text[before : before + size])
        self.sure = inner and (before + inner[0], before + inner[1])

    def entries(self) -> list[State]:
        """Every token of the vocabulary that could cover or end at the left boundary."""
        if not self.before:
            return [(0, "")]
        out = set()
        for start in range(max(0, self.before - self.model.longest), self.before):
            out |= {(start + len(t) - self.before, t) for t in self.model.tokens_at(self.text, start) if start + len(t) >= self.before}
        return sorted(out)

    def _begin(self, states: list[State]) -> dict[int, list[str]]:
        begin = defaultdict(list)
        for reach, token in states:
            begin[self.before + reach].append(token)
        return begin

    def _ends(self, done: dict) -> dict[State, dict]:
        edge = self.before + self.size
        limit = 0 if self.final else self.model.longest
        return {(pos - edge, t): to for (pos, t), to in done.items() if edge <= pos <= edge + limit and pos <= len(self.text)}

    def matrix(self) -> Matrix:
        out: Matrix = defaultdict(dict)
        edge = self.before + self.size
        states = self.entries()
        first = self.sure[0] if self.sure else None
        short = [s for s in states if first is None or self.before + s[0] <= first]
        if first is None:
            for end, to in self._ends(self.model.paths(self.text, self._begin(short), edge)).items():
                for (pos, t), (w, _) in to.items():
                    out[pos - self.before, t][end] = w
            return out
        # every path meets the first and the last sure boundary: one weight in, one out
        head = self.model.paths(self.text[:first], self._begin(short), first)
        middle = self._middle_weight()
        tail = self._ends(self.model.paths(self.text, {self.sure[1]: [""]}, edge))
        for (pos, _), to in head.items():
            if pos == first:
                for (p, t), (w, _) in to.items():
                    for end, back in tail.items():
                        out[p - self.before, t][end] = w + middle + max(x for x, _ in back.values())
        return out

    def _middle_weight(self) -> float:
        if not self.model.unigram:
            return 0.0
        return float(sum(self.model.score.get(self.model.names[i], min(self.model.score.values()) - 10.0) for i in self._middle()))

    def _middle(self) -> list[int]:
        words = re.findall(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n", self.text[self.sure[0] : self.sure[1]])
        distinct = list(dict.fromkeys(words))
        table = dict(zip(distinct, self.model.encode_words([w.replace(SPACE, " ") for w in distinct]), strict=True))
        return list(itertools.chain.from_iterable(table[w] for w in words))

    def _trace(self, done: dict, to: tuple[int, str], origin: tuple[int, str]) -> list[int]:
        tokens = []
        while to != origin:
            tokens.append(to[1])
            to = done[to][origin][1]
        return [i for t in reversed(tokens) for i in self.model.ids(t)]

    def ids(self, entry: State, end: State) -> list[int]:
        """The ids of the tokens after the entry state up to the end state."""
        origin = (self.before + entry[0], entry[1])
        goal = (self.before + self.size + end[0], end[1])
        if self.sure is None:
            return self._trace(self.model.paths(self.text, self._begin([entry]), self.before + self.size), goal, origin)
        first, last = self.sure
        head = self.model.paths(self.text[:first], self._begin([entry]), first)
        meet = max((p for p in head if p[0] == first), key=lambda p: head[p][origin][0])
        tail = self.model.paths(self.text, {last: [""]}, self.before + self.size)
        return self._trace(head, meet, origin) + self._middle() + self._trace(tail, goal, (last, ""))


def times(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product: the best weight over the states at the common boundary."""
    out: Matrix = defaultdict(dict)
    for s, row in a.items():
        for mid, w in row.items():
            for e, x in b.get(mid, {}).items():
                if out[s].get(e, -np.inf) < w + x:
                    out[s][e] = w + x
    return out


def through(matrices: list[Matrix], entry: State, end: State | None) -> list[State]:
    """The boundary states, entry and end included, of the best path through a row of matrices."""
    best: list[dict[State, tuple[float, State | None]]] = [{entry: (0.0, None)}]
    for m in matrices:
        nxt: dict[State, tuple[float, State | None]] = {}
        for s, (w, _) in best[-1].items():
            for e, x in m.get(s, {}).items():
                if e not in nxt or nxt[e][0] < w + x:
                    nxt[e] = (w + x, s)
        best.append(nxt)
    at = end if end is not None else max(best[-1], key=lambda s: (best[-1][s][0], s))
    path = [at]
    for layer in reversed(best[1:]):
        path.append(layer[path[-1]][1])
    return path[::-1]


def _dump(m: Matrix) -> str:
    return json.dumps([[*s, *e, w] for s, row in m.items() for e, w in row.items()])


def _load(text: str) -> Matrix:
    out: Matrix = defaultdict(dict)
    for a, t, b, u, w in json.loads(text):
        out[a, t][b, u] = w
    return out


def _chunks(text: str, longest: int) -> list[dict]:
    """Chunks of the normalised text with a context of the longest piece on either side."""
    norm = SPACE + text.replace(" ", SPACE)
    out = []
    for k, at in enumerate(range(0, len(norm), CHUNK_CHARS)):
        size = min(CHUNK_CHARS, len(norm) - at)
        before = min(longest, at)
        out.append({"k": k, "part": norm[at - before : at + size + longest], "before": before, "size": size})
    return out


_CHUNK = "struct<k:int,part:string,before:int,size:int>"
_ENCODED = f"struct<ids:array<int>,chunks:array<{_CHUNK}>>"


def encode_udf(path: str, chunk: int):
    """Ids of ordinary texts, chunks of giant ones (more than ``chunk`` characters)."""

    def ordinary(pieces: PieceTable, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and where each begins."""
        import pyarrow.compute as pc

        marked = pc.replace_substring(column, SPACE, " ")
        full = pc.greater(pc.binary_length(marked), 0)
        data, off = texts(pc.if_else(full, pc.binary_join_element_wise(" ", marked, ""), marked))
        space = data == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        feeds = np.flatnonzero(data == 0x0A)
        cut = np.unique(np.concatenate([np.flatnonzero(start), feeds, feeds + 1, off]))
        if len(cut) < 2:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        index = pieces.look_up(data, cut)
        n = np.concatenate([[0], np.cumsum(pieces.lengths[index])])
        return pieces.ids_of(index), n[np.searchsorted(cut, off)]

    @F.arrow_udf(_ENCODED)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc

        model = model_of(path)
        pieces = PieceTable(model.encode_words, keep_ids=True, remember=200_000)
        for column in batches:
            column = column.fill_null("")
            giant = pc.greater(pc.utf8_length(column), chunk)
            small = pc.if_else(giant, "", column)
            _, off = texts(small)
            ids, begin, row = [], [np.zeros(1, np.int64)], 0
            while row < len(column):
                last = max(row + 1, int(np.searchsorted(off, off[row] + BATCH_BYTES, "right")) - 1)
                flat, at = ordinary(pieces, small.slice(row, last - row))
                ids.append(flat)
                begin.append(begin[-1][-1] + at[1:])
                row = last
            offsets = np.concatenate(begin).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            lists = pc.if_else(giant, pa.scalar(None, lists.type), lists)
            parts = pa.array([_chunks(x.as_py(), model.longest) if g else None for x, g in zip(column, giant.to_pylist(), strict=True)], pa.list_(pa.struct([("k", pa.int32()), ("part", pa.string()), ("before", pa.int32()), ("size", pa.int32())])))
            yield pa.StructArray.from_arrays([lists, parts], ["ids", "chunks"])

    return encode


def _giant_ids(chunks: DataFrame, path: str, scratch: Scratch) -> DataFrame:
    """(row, ids) of giant texts from their chunks (row, k, part, before, size)."""
    chunks = scratch.write(chunks.repartition("row", "k").withColumn("block", F.floor(F.col("k") / BLOCK).cast("int")), "chunks")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(path)
        for f in frames:
            m = [_dump(Chunk(model, t, b, n).matrix()) for t, b, n in zip(f["part"], f["before"], f["size"], strict=True)]
            yield f[["row", "block", "k"]].assign(matrix=m)

    def combine(f: pd.DataFrame) -> pd.DataFrame:
        total = None
        for text in f.sort_values("k")["matrix"]:
            total = _load(text) if total is None else times(total, _load(text))
        return pd.DataFrame({"row": f["row"][:1], "block": f["block"][:1], "matrix": [_dump(total)]})

    def between(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        path_ = through([_load(x) for x in f["matrix"]], (0, ""), None)
        return pd.DataFrame({"row": f["row"], "block": f["block"], "enter": [json.dumps(s) for s in path_[:-1]], "leave": [json.dumps(s) for s in path_[1:]]})

    def within(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        path_ = through([_load(x) for x in f["matrix"]], tuple(json.loads(f["enter"].iloc[0])), tuple(json.loads(f["leave"].iloc[0])))
        return pd.DataFrame({"row": f["row"], "k": f["k"], "enter": [json.dumps(s) for s in path_[:-1]], "leave": [json.dumps(s) for s in path_[1:]]})

    def backtrace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(path)
        for f in frames:
            out = []
            for t, b, n, x, y in zip(f["part"], f["before"], f["size"], f["enter"], f["leave"], strict=True):
                out.append(Chunk(model, t, b, n).ids(tuple(json.loads(x)), tuple(json.loads(y))))
            yield f[["row", "k"]].assign(ids=out)

    each = scratch.write(chunks.mapInPandas(matrices, "row long, block int, k int, matrix string"), "matrices")
    blocks = each.groupBy("row", "block").applyInPandas(combine, "row long, block int, matrix string")
    ends = blocks.groupBy("row").applyInPandas(between, "row long, block int, enter string, leave string")
    states = each.join(ends, ["row", "block"]).groupBy("row", "block").applyInPandas(within, "row long, k int, enter string, leave string")
    ids = chunks.join(states, ["row", "k"]).mapInPandas(backtrace, "row long, k int, ids array<int>")
    return ids.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str, chunk: int = CHUNK_CHARS, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """struct ``doc`` (all columns of ``docs``, or those of ``keep``) and ``ids`` (array of int) for every row.

    path: a .model file at the same place on all machines. Ids are those of the library, without
    begin and end; null or empty text has none. Repeated rows are encoded alike; an empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "sentencepiece")
    model_of(path)
    doc = F.struct(*[docs[f"`{c}`"] for c in keep or docs.columns]).alias("doc")
    rows = docs.select(doc, F.monotonically_increasing_id().alias("row"), docs[f"`{text}`"].alias("t"))
    rows = rows.select("doc", "row", encode_udf(path, chunk)("t").alias("e"))
    rows = scratch.write(rows.select("doc", "row", "e.ids", "e.chunks"), "encoded")
    giants = rows.where("chunks is not null")
    long = _giant_ids(giants.select("row", F.inline("chunks")), path, scratch)
    return rows.where("chunks is null").select("doc", "ids").unionByName(giants.select("doc", "row").join(long, "row").select("doc", "ids"))


def decode_udf(path: str):
    """Text of a column of ids, as the library decodes them."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(path)
        raw = [p.encode() for p in model.names]
        for i, b in model.byte_of.items():
            raw[i] = bytes([b])
        for i in range(len(raw)):
            if model.lib.is_control(i):
                raw[i] = b""
            elif model.lib.is_unknown(i):
                raw[i] = " ⁇ ".encode()
        raw = [r.replace(SPACE.encode(), b" ") for r in raw]
        width = np.array([len(r) for r in raw], np.int64)
        start = np.cumsum(width) - width
        pool = np.frombuffer(b"".join(raw), np.uint8)
        for column in batches:
            yield pa.array(_decoded(column, pool, start, width), pa.string())

    def _decoded(column: pa.Array, pool: np.ndarray, start: np.ndarray, width: np.ndarray) -> Iterator[str | None]:
        off = np.asarray(column.offsets)
        flat = column.values.to_numpy(zero_copy_only=False)
        for i, null in enumerate(column.is_null().to_pylist()):
            if null:
                yield None
                continue
            ids = flat[off[i] : off[i + 1]]
            n = width[ids]
            at = np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            text = pool[at].tobytes().decode("utf-8", "replace")
            yield text[1:] if text.startswith(" ") else text

    return decode


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` plus ``ids``; the pipeline's last stage. A column ``ids`` of docs is replaced."""
    out = encode(docs, path)
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c != "ids"], "ids")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, n_chars and crc32 of the text decoded from the ids, for every document."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, path, keep=("doc_id",)).select("doc.doc_id", "ids")
    out = out.withColumn("decoded", decode_udf(path)("ids"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.length("decoded").cast("long").alias("n_chars"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))
