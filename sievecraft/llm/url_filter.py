"""URL filters whose block decisions spread over redirects and canonical links.

A rule is (host, path, verdict). It fits its host and all subdomains where the url's path starts with the rule's; the
longest rule wins, of equally long ones the first by name. A url without a rule of its own takes the verdict of its class: urls that redirects or canonical
links connect. A class with an allowed url is allowed (explicit allow has precedence), else one with a blocked url is
blocked, else it is allowed. Classes are connected components, found without collecting any link.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and is linked to nothing. A
fragment isn't part of a url's identity. Repeated urls share a class. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..plans.lineage import materialise
from .common import small_batches

#: Rules up to this many are one expression; more are joined by host.
INLINE_RULES = 200


# An open end runs to the end of the page, and a name is read from its first character only: no page takes quadratic time.
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*+>|\Z)|<style\b.*?(?:</style\s*+>|\Z)", re.S | re.I)
_LINK = re.compile(r"<(?:link|meta)\b[^>]*(?:>|\Z)", re.I)
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_REFRESH = re.compile(r"url\s*=\s*['\"]?([^'\"]+)", re.I)


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def identity(url: Column) -> Column:
    """What names a url as a node: scheme and host in lower case, no fragment, no empty path; null without a host."""
    bare = F.regexp_replace(url, r"#[\s\S]*$", "")
    scheme = ascii_lower(F.regexp_extract(bare, r"^([\s\S]*?)://", 1))
    rest = F.regexp_extract(bare, r"^[\s\S]*?://[^/?#]*([\s\S]*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), rest))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def match_rules(urls: DataFrame, rules: Sequence[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """Append rule and rule_verdict: the longest rule that fits, else null. A short list is one expression in the scan's stage."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    if len(ranked) <= INLINE_RULES:
        none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"))
        named = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("rule_verdict"))
        pick = lambda u: reduce(lambda out, r: F.when(_fits(r, u["h"], u["p"]), named(r)).otherwise(out), reversed(ranked), none)
        best = F.transform(F.array(F.struct(F.col(host).alias("h"), F.col(path).alias("p"))), pick)  # binds host and path once
        return urls.withColumn("_best", F.get(best, F.lit(0))).withColumns({"rule": F.col("_best")["rule"], "rule_verdict": F.col("_best")["rule_verdict"]}).drop("_best")
    return match_rule_table(urls, urls.sparkSession.createDataFrame(ranked, "rule_host string, rule_path string, rule_verdict string"), host, path)


def match_rule_table(urls: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """The same for rule tables of any size: distinct (host, path) pairs are joined by each of their host's suffixes.

    Urls of one host share their rules, so a rule set is first gathered per host (a list as long as that host has
    rules), and no url is ever multiplied.
    """
    rules = rules.select("rule_host", F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("size"), F.concat("rule_host", "rule_path").alias("name"), "rule_path", "rule_verdict").alias("r"))
    labels = F.split(F.col("h"), r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    hosts = urls.select(F.col(host).alias("h")).distinct().withColumn("rule_host", F.explode(suffix))
    own = hosts.join(rules, "rule_host").groupBy("h").agg(F.sort_array(F.collect_list("r")).alias("_rules"))
    best = F.get(F.filter("_rules", lambda r: F.col(path).startswith(r["rule_path"])), F.lit(0))
    joined = urls.join(own, F.col(host) == F.col("h"), "left").withColumn("_best", best)
    return joined.withColumns({"rule": F.col("_best")["name"], "rule_verdict": F.col("_best")["rule_verdict"]}).drop("h", "_rules", "_best")


def link_targets(url: str | None, page: str | None) -> list[str]:
    """Targets of a page's canonical links and refresh redirects, resolved against its url."""
    out = []
    for tag in _LINK.findall(_SKIP.sub(" ", page or "")):
        if tag[-1] != ">":
            continue  # the page ends inside it
        own = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").strip() for m in _ATTRIBUTE.finditer(tag)}
        to = ""
        if tag[1:5].lower() == "link" and "canonical" in own.get("rel", "").lower().split():
            to = own.get("href", "")
        elif own.get("http-equiv", "").lower() == "refresh" and (found := _REFRESH.search(own.get("content", ""))):
            to = found[1].strip()
        if to:
            try:
                out.append(urljoin(url or "", to))
            except ValueError:  # not a url
                continue
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _link_targets(urls: pd.Series, pages: pd.Series) -> pd.Series:
    return pd.Series([link_targets(u, p) for u, p in zip(urls, pages, strict=True)], dtype=object)


def page_links(pages: DataFrame, url: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (src, dst) from pages' canonical links and refresh redirects. Pages that name neither aren't parsed."""
    small_batches(pages.sparkSession)
    rough = pages.where(F.col(html_col).rlike(r"(?i)canonical|http-equiv"))
    found = rough.select(F.col(url).alias("src"), F.explode(_link_targets(F.col(url), F.col(html_col))).alias("dst"))
    return _edges(found)


def _edges(links: DataFrame) -> DataFrame:
    return links.select(identity(F.col("src")).alias("src"), identity(F.col("dst")).alias("dst")).where("src is not null and dst is not null and src != dst").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[Rule], links: DataFrame | None = None, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: id, url, host, path, rule, verdict, class_id (null outside any class).

    ``links``: (src, dst) urls, redirects or canonical links; None: those in the pages' html.
    """
    links = page_links(pages, url) if links is None else _edges(links)
    own = pages.select(F.col(id_col), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), identity(F.col(url)).alias("_node"))
    own = match_rules(own, rules)
    links = materialise(links, "url-links")
    out = [id_col, "url", "host", "path", "rule"]
    if links.isEmpty():
        return own.select(*out, F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("class_id"))
    classes = materialise(connected_components(links).withColumnRenamed("component", "class_id"), "url-classes")
    known = classes.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))})
    known = match_rules(known, rules).groupBy("class_id").agg(F.min("rule_verdict").alias("_class"))  # "allow" sorts before "block"
    known = classes.join(known, "class_id").select("node", "class_id", "_class")
    joined = own.join(known, F.col("_node") == F.col("node"), "left")
    return joined.select(*out, F.coalesce("rule_verdict", "_class", F.lit("allow")).alias("verdict"), "class_id")
