"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and texts are split at boundaries that the byte-level
pre-tokenizer makes anyway (a single space or line feed between two characters that are not
white space), so counts add up and no call sees more than a bounded amount of text. Equal
pieces are encoded once per worker while they stay in a bounded table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, table, texts
from tidecast.llm.pieces import PieceTable, single_breaks

#: Bytes of text worked on at a time.
BATCH_BYTES = 1 << 21


class Counter:
    """Token counts for one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.splits = False
            encode = lambda parts: model.encode(parts, num_threads=1)
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.splits = self._adds_up(model)
            encode = lambda parts: model.encode_batch_fast(parts, add_special_tokens=False)
        self.pieces = PieceTable(encode, keep_ids=False)

    @staticmethod
    def _adds_up(model) -> bool:
        """Whether the pre-tokenizer is byte-level without a prefix space and nothing reaches over spaces."""
        spec = json.loads(model.to_str())
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        return plain and not spec["normalizer"] and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])

    def _counts(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and tokens before each of them (one more for the end)."""
        cuts = [begin]
        if self.splits:
            spaces, feeds = single_breaks(data)
            cuts += [spaces, feeds, feeds + 1]
        cut = np.unique(np.concatenate([*cuts, [len(data)]]))
        if len(cut) < 2:
            return cut, np.zeros(len(cut), np.int64)
        index = self.pieces.look_up(data, cut)
        return cut, np.concatenate([[0], np.cumsum(self.pieces.lengths[index])])

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of every text of a string array; null counts as empty."""
        data, off = texts(column)
        out = np.zeros(len(column), np.int64)
        row = 0
        while row < len(column):
            last = max(row + 1, int(np.searchsorted(off, off[row] + BATCH_BYTES, "right")) - 1)
            part = data[off[row] : off[last]]
            if len(part) <= BATCH_BYTES or not self.splits:
                cut, before = self._counts(part, off[row:last] - off[row])
                out[row:last] = np.diff(before[np.searchsorted(cut, off[row : last + 1] - off[row])])
            else:  # one long text: slices that end at safe boundaries
                at = 0
                while at < len(part):
                    to, reach = len(part), at + BATCH_BYTES
                    while reach < len(part):
                        spaces, feeds = single_breaks(part[reach - 8 : reach + BATCH_BYTES])
                        ends = np.concatenate([spaces, feeds])
                        ends = ends[ends >= 8]
                        if len(ends):
                            to = reach - 8 + int(ends.min())
                            break
                        reach += BATCH_BYTES - 16
                    out[row] += int(self._counts(part[at:to], np.zeros(1, np.int64))[1][-1])
                    at = to
            row = last
        return out


def token_count_udf(path: str):
    """Token count of a string column; null counts as empty."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path)
        for column in batches:
            yield pa.array(counter.count(column))

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    path: a tokenizer file, .json (tokenizers) or .model (sentencepiece), at the same place on
    all machines. No begin, end or padding tokens, no truncation; strings of special tokens in
    a text are read as the library does. Null or empty text: 0 bytes and tokens. Repeated rows
    are counted alike; other columns are ignored.
    """
    Scratch(docs.sparkSession, "tokens")
    t = F.coalesce(docs[f"`{text}`"], F.lit(""))
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), token_count_udf(path)(t).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
