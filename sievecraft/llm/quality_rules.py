"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets counts and rule failures of its own. Failures are summed by host, each host's failure rate is
shrunk towards the corpus with a beta prior fitted to all hosts by moments, and hosts whose shrunk rate is beyond a
threshold are rejected with all their documents. Small hosts lean on the prior, large ones on their own rows.

Nulls: a null text has no words; null hosts form one host of their own. Repeated rows are judged one by one. Columns
of the input whose names clash with an output are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialise
from .common import words_of


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    host_threshold: float = 0.5
    #: Rejected hosts are broadcast up to this many, else joined by shuffle.
    broadcast_hosts: int = 100_000


def _covered(starts: Column, width: int = 3) -> Column:
    """Positions that windows of ``width`` from these sorted starts cover."""
    zero = F.struct(F.lit(-width).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda s, p: F.struct(p.alias("at"), (s["n"] + F.least(F.lit(width), p - s["at"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda s: s["n"])


def add_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    n_repeat_words: words in three-word windows that occur twice or more in the text, the first included. Windows are
    compared by 64-bit hash within one document; only documents with a repeated hash sort their windows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    out = docs.drop(*own).withColumn("_words", words_of(F.col(text)))
    hashed = F.transform(
        F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({"_windows": hashed, "_lines": lines})
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ranked = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    out = out.withColumn("_ranked", F.when(repeated, ranked))
    at = lambda k: F.get("_ranked", k)
    twice = F.filter(
        F.sequence(F.lit(0), F.size("_ranked") - 1),
        lambda k: at(k)["h"].eqNullSafe(at(k - 1)["h"]) | at(k)["h"].eqNullSafe(at(k + 1)["h"]),
    )
    starts = F.when(F.col("_ranked").isNotNull(), F.sort_array(F.transform(twice, lambda k: at(k)["at"])))
    out = out.withColumn("_starts", starts)
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(_covered(F.col("_starts")), F.lit(0)).cast("long"),
        }
    ).drop("_words", "_windows", "_lines", "_ranked", "_starts")


def add_failures(counted: DataFrame, rules: QualityRules) -> DataFrame:
    """Append base_failed and any_failed (base or one of the symbol and repeated-line rules)."""
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    more = (100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
    return counted.withColumns({"base_failed": base, "any_failed": base | more})


def host_verdicts(judged: DataFrame, host: str, rules: QualityRules) -> DataFrame:
    """Per host: host, n_docs, n_failed, host_rate (shrunk), host_rejected.

    The beta prior has the mean and the between-host variance of the raw rates, by moments: with m the pooled rate and
    v the variance of the hosts' rates less what binomial noise explains, its strength is m(1-m)/v - 1, held within
    1 and 10000. One host, or hosts that don't differ, give the strongest prior.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("any_failed").cast("long")).alias("n_failed"))
    hosts = materialise(hosts, "quality-hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    fit = hosts.agg(
        F.coalesce(F.sum("n_failed") / F.sum("n_docs"), F.lit(0.0)).alias("m"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"),
        F.coalesce(F.avg(1 / F.col("n_docs")), F.lit(0.0)).alias("noise"),
    ).first()
    spread = fit["m"] * (1 - fit["m"])
    strength = min(max(spread / max(fit["v"] - spread * fit["noise"], 1e-12) - 1, 1.0), 10_000.0)
    mean = fit["m"]
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > rules.host_threshold).alias("host_rejected"))


def _with_verdict(judged: DataFrame, verdicts: DataFrame, host: str, rules: QualityRules) -> DataFrame:
    """Join rejected hosts back; kept: no base rule failed and the host isn't rejected. The list of rejected hosts is broadcast only while its checked size allows."""
    bad = verdicts.where("host_rejected").select(F.col("host").alias("_host"))
    if bad.limit(rules.broadcast_hosts + 1).count() <= rules.broadcast_hosts:
        bad = F.broadcast(bad)
    joined = judged.join(bad.withColumn("_bad", F.lit(True)), F.col(host).eqNullSafe(F.col("_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: id, counts, base_failed, any_failed, kept. The text is read once; counts are a narrow table."""
    narrow = docs.select(F.col(id_col), F.col(text).alias("_text"), F.col(host).alias("_source"))
    counted = materialise(add_failures(add_counts(narrow, "_text").drop("_text"), rules), "quality-counts")
    verdicts = host_verdicts(counted, "_source", rules)
    return _with_verdict(counted, verdicts, "_source", rules).drop("_source")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source") -> DataFrame:
    """The kept documents with the columns they came with. Texts are read and counted once, and never shuffled."""
    own = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), F.col(host).alias("_source"))
    judged = add_failures(add_counts(own, "_text"), rules).select("_row", "_source", "base_failed", "any_failed")
    judged = materialise(judged, "quality-rows")
    verdicts = host_verdicts(judged.select("_source", "any_failed"), "_source", rules)
    return _with_verdict(judged, verdicts, "_source", rules).where("kept").select("_row.*")
