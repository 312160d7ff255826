"""Quality rules with thresholds learned from the corpus, as DataFrame expressions only.

Every rule is a ratio in thousandths (0 to 1000), so the histogram of its integer values is a
quantile sketch: it merges by addition, has at most 1,001 bins, exact ranks and a value error
below 1/1000. One sketch is kept per language and source; sketches of small groups are merged
with those of their language, and of small languages with the whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, table


@dataclass(frozen=True)
class QualitySpec:
    """A rule's fence is quartile + reach * max(interquartile range, least spread).

    With clean_half each fence is taken from the half of the sketch away from it: for the upper
    one, twice the way from the first quartile to the median stands for the interquartile range
    and the median plus half of that for the third quartile (the same in a symmetric group), so
    that bad rows do not widen it while they are less than half of a group.
    least_spread keeps a uniform group from rejecting its own normal rows; a group with fewer
    than min_rows measured rows uses the merged sketch above it.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    reach: int = 6
    clean_half: bool = False
    min_rows: int = 100
    least_spread: dict[str, int] = field(default_factory=lambda: {"symbols": 5, "upper": 10, "repeats": 80, "dup_lines": 100, "density": 10})
    #: Rules that also have a lower fence.
    two_sided: tuple[str, ...] = ("density",)


_WORD = r"([^\x20\x09-\x0D]+)"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(rows: DataFrame, spec: QualitySpec) -> DataFrame:
    """``rows`` (with a column ``text``) plus a struct ``m`` of counts, base_failed and rules.

    Words are runs of characters other than space and \\t to \\r. Null text has no words. Equal
    3-word windows are found by 64-bit hash; positions are looked at only in texts that have
    two equal windows.
    """
    text = F.coalesce("text", F.lit(""))
    kept = list(rows.columns)
    q = rows.select(*kept, F.regexp_extract_all(text, F.lit(_WORD), F.lit(1)).alias("__w"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD)).alias("__l"))
    n = F.size("__w")
    windows = F.when(n >= 3, F.transform(F.slice("__w", F.lit(1), F.greatest(n - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2))))
    q = q.select("*", F.coalesce(windows, F.array().cast("array<bigint>")).alias("__h"))
    q = q.select("*", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))

    def again(x: Column, i: Column) -> Column:
        near = F.col("__s")
        return (x["h"] == F.get(near, i - 1)["h"]) | (x["h"] == F.get(near, i + 1)["h"])

    at = F.transform(F.filter("__s", again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    counts = {
        "n_words": n,
        "word_chars": F.aggregate("__w", F.lit(0), lambda a, w: a + F.length(w)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.coalesce(F.size(F.array_distinct(F.flatten(at))), F.lit(0)),
    }
    extra = {"n_upper": F.regexp_count(text, F.lit("[A-Z]")), "n_lines": F.size("__l")}
    q = q.select(*kept, F.struct(*[c.cast("long").alias(k) for k, c in (counts | extra).items()]).alias("m"))
    m = F.col("m")

    def share(part: str, whole: str) -> Column:
        return F.when(m[whole] > 0, F.floor(m[part] * 1000 / m[whole])).otherwise(0).cast("int")

    failed = (m["n_words"] < spec.min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * spec.max_repeat_percent)
    rules = {
        "symbols": share("n_symbols", "word_chars"),
        "upper": share("n_upper", "word_chars"),
        "repeats": share("n_repeat_words", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "density": share("n_words", "word_chars"),
    }
    struct = F.struct(*[m[k].alias(k) for k in COUNTS], failed.alias("base_failed"), *[c.alias(k) for k, c in rules.items()])
    return q.select(*kept, struct.alias("m"))


def sketches(rows: DataFrame, spec: QualitySpec) -> DataFrame:
    """lang, source, rule, bin, n: one histogram per group, over rows that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"m.{r}").alias("bin")) for r in spec.least_spread])
    return rows.where("not m.base_failed").select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("n"))


def _fences(bins: DataFrame, keys: list[str], spec: QualitySpec) -> DataFrame:
    """One row per group: n and the struct of fences, from histograms merged to ``keys``."""
    merged = bins.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "rule")
    run = merged.select(*keys, "rule", "bin", F.sum("n").over(by.orderBy("bin")).alias("upto"), F.sum("n").over(by).alias("total"))
    q = run.groupBy(*keys, "rule").agg(
        F.max("total").alias("n"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("bin"))).alias("q2"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"),
    )
    aggs = []
    for rule, least in spec.least_spread.items():
        q1, q2, q3 = F.col("q1"), F.col("q2"), F.col("q3")
        if spec.clean_half:
            hi = q2 * 2 - q1 + F.greatest((q2 - q1) * 2, F.lit(least)) * spec.reach
            lo = q2 * 2 - q3 - F.greatest((q3 - q2) * 2, F.lit(least)) * spec.reach
        else:
            reach = F.greatest(q3 - q1, F.lit(least)) * spec.reach
            hi, lo = q3 + reach, q1 - reach
        mine = F.col("rule") == rule
        aggs.append(F.max(F.when(mine, hi)).alias(f"hi_{rule}"))
        aggs.append(F.max(F.when(mine, lo if rule in spec.two_sided else F.lit(-1))).alias(f"lo_{rule}"))
    return q.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def thresholds(bins: DataFrame, spec: QualitySpec) -> DataFrame:
    """lang, source and the fences in force for each group (struct ``f``)."""
    names = [f"{s}_{r}" for r in spec.least_spread for s in ("hi", "lo")]

    def level(keys: list[str], name: str) -> DataFrame:
        f = _fences(bins, keys, spec)
        return f.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], "n", F.struct(*names).alias(name))

    top = level([], "whole").drop("n")
    lang = level(["lang"], "wide").where(F.col("n") >= spec.min_rows).drop("n")
    own = level(["lang", "source"], "own")
    own = own.join(lang, own["own_lang"].eqNullSafe(lang["wide_lang"]), "left").withColumn("one", F.lit(1)).join(top.withColumn("one", F.lit(1)), "one")
    pick = F.when(F.col("n") >= spec.min_rows, F.col("own")).otherwise(F.coalesce("wide", "whole"))
    return own.select(F.col("own_lang").alias("t_lang"), F.col("own_source").alias("t_source"), pick.alias("f"))


def judged(rows: DataFrame, spec: QualitySpec, scratch: Scratch) -> DataFrame:
    """``rows`` (lang, source, m, ...) plus ``kept``: base rules passed and no fence crossed."""
    limits = scratch.write(thresholds(scratch.write(sketches(rows, spec), "sketches"), spec), "thresholds")
    join = rows["lang"].eqNullSafe(limits["t_lang"]) & rows["source"].eqNullSafe(limits["t_source"])
    out = rows.join(limits, join, "left")
    crossed = F.lit(False)
    for rule in spec.least_spread:
        crossed = crossed | (F.col(f"m.{rule}") > F.col(f"f.hi_{rule}")) | (F.col(f"m.{rule}") < F.col(f"f.lo_{rule}"))
    return out.select(*rows.columns, F.when(F.col("m.base_failed") | F.col("f").isNull(), ~F.col("m.base_failed")).otherwise(~crossed).alias("kept"))


def quality_rules(docs: DataFrame, spec: QualitySpec = QualitySpec()) -> DataFrame:
    """doc_id, the five counts, base_failed and kept for every row of ``docs``.

    Null or empty text: all counts 0, base_failed. Null language or source is a group of its
    own. Repeated rows are judged alike. An empty table gives an empty result; other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = measured(docs.select("doc_id", "lang", "source", "text"), spec).drop("text")
    out = judged(scratch.write(rows, "measured"), spec, scratch)
    return out.select("doc_id", *[f"m.{c}" for c in COUNTS], "m.base_failed", "kept")


def keep_good(docs: DataFrame, spec: QualitySpec = QualitySpec()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``, whatever their names."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select("lang", "source", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    out = judged(scratch.write(measured(rows, spec).drop("text"), "measured"), spec, scratch)
    return out.where("kept").select("doc.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
