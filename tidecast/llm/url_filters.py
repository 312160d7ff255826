"""URL filters over redirect equivalence.

Rules decide the URLs they fit. Redirects and canonical links join URLs into components; a
component with a blocked URL blocks its URLs that no rule decides, unless a URL of the
component is explicitly allowed.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, table
from tidecast.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """Node of a URL: 64-bit hash without scheme, fragment and utm_ parameters; null without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^#]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?<=[?&])utm_[^&]*&?", ""), r"[?&]$", "")
    bare = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    return F.when(url.contains("://"), F.xxhash64(host_of(url), bare))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, r.host + r.path).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _target(tag: str) -> str | None:
    """The URL that a canonical link or a refresh tag names."""
    attrs = {m[1].lower(): html_lib.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]).strip() for m in _ATTR.finditer(tag)}
    if "canonical" in attrs.get("rel", "").lower().split():
        return attrs.get("href")
    if attrs.get("http-equiv", "").lower() == "refresh":
        m = re.search(r"(?i)url\s*=\s*['\"]?([^'\"]+)", attrs.get("content", ""))
        return m and m[1].strip()
    return None


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs of canonical links and refresh redirects, outside comments and scripts."""
    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script", "")
    tags = F.regexp_extract_all(clean, F.lit(r"(?is)(<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>)"), F.lit(1))
    may = pages.where(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://"))
    found = may.select("url", F.explode(tags).alias("tag"))

    def resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for url, tag in zip(f["url"], f["tag"], strict=True):
                to = _target(tag)
                if to:
                    try:
                        out.append((url, urljoin(url, to)))
                    except ValueError:  # not a URL
                        continue
            yield pd.DataFrame(out, columns=["src", "dst"])

    return found.mapInPandas(resolve, "src string, dst string")


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html).

    redirects: more (src, dst) URLs. A URL without :// or null: host and path empty, no rule,
    allow. Null html has no links. URLs that differ in scheme, fragment or utm_ parameters are
    one. Repeated rows are judged alike; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    pages = pages.select("page_id", "url", "html")
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("src", "dst"))
    links = scratch.write(links.distinct(), "links")
    edges = links.select(key_of(F.col("src")).alias("a"), key_of(F.col("dst")).alias("b"))
    nodes = connected_components(edges, scratch)
    urls = pages.select("url").union(links.select("src")).union(links.select("dst")).distinct()
    named = urls.select(key_of(F.col("url")).alias("node"), ruled(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("says"))
    named = named.where("node is not null and says is not null").join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tainted = named.groupBy("root").agg(F.max((F.col("says") == "block")).alias("block"), F.max((F.col("says") == "allow")).alias("allow"))
    tainted = scratch.write(tainted.where("block and not allow").select("root", F.lit("block").alias("passed_on")), "blocked")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    out = pages.select("page_id", host.alias("host"), path.alias("path"), key_of(F.col("url")).alias("node")).join(nodes, "node", "left")
    out = out.select("page_id", "host", "path", F.coalesce("root", "node").alias("root")).join(tainted, "root", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "passed_on", F.lit("allow")).alias("verdict"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))
