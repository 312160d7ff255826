"""Filter interaction audit: what each filter removes, in every order the filters can be applied in.

Five filters are applied to whole texts. Four look at a text alone; the fifth (E) is an
existential self-join: a left-semi join on hash, exact text and a smaller doc_id. The ids it
finds are joined by a union to those that fail the other filters, so a document is one
combination of five bits, and every figure of every order follows from the counts of the 32
combinations of a part.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, table

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_WORD = r"([^\x20\x09-\x0D]+)"
_ID = ("doc_id", "part", "h", "h2")


@dataclass(frozen=True)
class AuditSpec:
    """A: fewer words. B: a smaller percentage of distinct words. C: a larger one of A-Z. D: holds a symbol. E: a copy."""

    min_words: int = 200
    distinct_percent: int = 50
    upper_percent: int = 3
    symbols: str = "[#$%&*|]"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("t"))


def own_failures(docs: DataFrame, spec: AuditSpec) -> DataFrame:
    """doc_id, part, h, h2 (hashes of the text) and the bits of the filters that look at one text."""
    words = F.regexp_extract_all("t", F.lit(_WORD), F.lit(1))
    q = _keyed(docs).select(*_ID, "t", words.alias("w"))
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    fails = {
        "A": n < spec.min_words,
        "B": distinct * 100 < n * spec.distinct_percent,
        "C": F.regexp_count("t", F.lit("[A-Z]")) * F.lit(100).cast("long") > F.length("t") * F.lit(spec.upper_percent).cast("long"),
        "D": F.col("t").rlike(spec.symbols),
    }
    bits: Column = F.lit(0)
    for f, failed in fails.items():
        bits = bits + F.when(failed, BIT[f]).otherwise(0)
    return q.select(*_ID, bits.alias("bits"))


def copies(docs: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part, h, h2 of the rows whose text is that of a smaller doc_id.

    Texts whose hash occurs under two ids are found by one shuffle, at every size the same
    (how many there are grows with the corpus, so they are never broadcast), and written. The
    right side of the semi join is the smallest id of each text, added up before the shuffle,
    so a text with any number of copies meets one row; its copies on the left are dealt out
    by the skew join.
    """
    ids = own.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    rows = scratch.write(_keyed(docs).join(ids.hint("merge"), "h", "left_semi"), "repeated")
    first = rows.groupBy(F.col("h").alias("fh"), F.col("t").alias("ft")).agg(F.min("doc_id").alias("first"))
    same = (F.col("h") == F.col("fh")) & (F.col("t") == F.col("ft")) & (F.col("first") < F.col("doc_id"))
    return rows.join(first, same, "left_semi").select(*_ID)


def combinations(docs: DataFrame, labels: DataFrame, spec: AuditSpec = AuditSpec()) -> DataFrame:
    """part, bits (the set of failed filters) and the number of rows: n, good, toxic."""
    scratch = Scratch(docs.sparkSession, "filter-audit")
    own = scratch.write(own_failures(docs, spec), "own")
    marked = copies(docs, own, scratch).select(*_ID, F.lit(BIT["E"]).alias("bits"), F.lit(0).alias("rows"))
    failed = own.select(*_ID, "bits", F.lit(1).alias("rows")).unionByName(marked)
    rows = failed.groupBy(*_ID).agg(F.bit_or("bits").alias("bits"), F.sum("rows").alias("rows"))
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rows.join(marks, F.col("doc_id") == F.col("label_id"), "left")

    def where(mark: str) -> Column:
        return F.sum(F.when(F.col(mark) == 1, F.col("rows")).otherwise(0))

    out = rows.groupBy("part", "bits").agg(F.sum("rows").alias("n"), where("quality").alias("good"), where("toxic").alias("bad"))
    return scratch.write(out, "combinations")


def filter_audit(docs: DataFrame, labels: DataFrame, spec: AuditSpec = AuditSpec()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part (``lang``; null: empty string), order of the five filters and step.
    Null or empty text: no words, so A fails and B, C and D do not; empty texts are copies of
    each other. Repeated rows count each and are no copies of themselves (no smaller id); a
    null doc_id is never a copy. A repeated label counts once, by its largest value. An empty
    table gives an empty result; other columns are ignored.
    """
    combos = combinations(docs, labels, spec)
    q = combos.select("*", F.explode(F.lit(ORDERS)).alias("filter_order"))
    letters = F.split("filter_order", "")
    q = q.select("*", F.posexplode(letters).alias("k", "letter"), letters.alias("letters"))

    def bit(letter: Column) -> Column:
        return F.pow(F.lit(2), F.ascii(letter) - ord(FILTERS[0])).cast("int")

    before = F.aggregate(F.slice("letters", F.lit(1), F.col("k")), F.lit(0), lambda m, x: m + bit(x))
    q = q.select("part", "filter_order", (F.col("k") + 1).alias("step"), "bits", "n", "good", "bad", bit(F.col("letter")).alias("bit"), before.alias("before"))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("bits").bitwiseAND(F.col("before")) != 0

    def total(of: Column | str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(of) if isinstance(of, str) else of).otherwise(F.lit(0))).cast("long")

    share = F.col("n") * (F.lit(len(ORDERS)) / F.greatest(F.bit_count("bits"), F.lit(1))).cast("long")  # 120 / 1 to 5: whole numbers
    return q.groupBy("part", "filter_order", "step").agg(
        total("n", ~fails & ~earlier).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", F.col("bits") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"),
        total("bad", fails & ~earlier).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of ``documents``, losses by ``labels``; see ``filter_audit`` for nulls, ties and repeats."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
