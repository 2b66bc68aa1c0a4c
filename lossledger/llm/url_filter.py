"""URL filter: host and path rules first, character language models for the rest.

Two smoothed variable-order Markov models are learned from the table itself: one from the URLs
that a rule allows, one from those that a rule blocks. The probability of a character after its
context of up to three characters is interpolated with that after the next shorter context; a
context never seen leaves the shorter one's estimate as it is. A URL no rule fits is judged by the
difference of the two log-likelihoods, divided by its length. The threshold is calibrated on a
quarter of the ruled URLs, which the models do not learn from.

Only DataFrame functions. The models are a table of distinct four-character strings; positions
meet it in a join, whose hot strings adaptive execution splits.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is
scored as an empty text; repeated rows get equal verdicts; without URLs of both kinds to calibrate
on, the threshold is 0; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 4
PRIOR = 2.0  # weight of the shorter context, in observations
BINS = 100  # calibration bins per unit of score


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits as a struct of name and verdict; null where none fits."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def grams(text: Column) -> Column:
    """One string of ``ORDER`` characters for each position of ``text`` and its end."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def log_ratios(positions: DataFrame) -> DataFrame:
    """``gram`` and its log ratio, from positions with ``allow`` and ``block`` weights (0 or 1)."""
    level = positions.groupBy("gram").agg(F.sum("allow").alias("a"), F.sum("block").alias("b"))
    base = level.select("gram")
    tables = []
    for length in range(ORDER, 0, -1):
        context = level.groupBy(F.substring("gram", 1, length - 1).alias("context")).agg(
            F.sum("a").alias(f"ca{length}"), F.sum("b").alias(f"cb{length}"))
        tables.append((length, level.select(
            F.col("gram").alias("tail"), F.col("a").alias(f"a{length}"), F.col("b").alias(f"b{length}")), context))
        level = level.groupBy(F.substring("gram", 2, length - 1).alias("gram")).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratio = [F.lit(1.0 / 256), F.lit(1.0 / 256)]
    for length, counts, context in reversed(tables):
        base = base.withColumn("tail", F.substring("gram", ORDER - length + 1, length)).join(counts, "tail").drop("tail")
        base = base.withColumn("context", F.substring("gram", ORDER - length + 1, length - 1)).join(
            context, "context").drop("context")
        ratio = [(F.col(f"{c}{length}") + PRIOR * p) / (F.col(f"c{c}{length}") + PRIOR) for c, p in zip("ab", ratio)]
    return base.select("gram", (F.log(ratio[0]) - F.log(ratio[1])).alias("ratio"))


def calibrated_threshold(scored: DataFrame) -> float:
    """The score with the best balanced accuracy over ``score`` and ``verdict``: of the bins that
    could be the first to be allowed the least one, and the middle of the gap below it.

    The driver receives one row per bin of the score, whose range is bounded by the smoothing.
    """
    bins = sorted(
        scored.groupBy(F.floor(F.col("score") * BINS).alias("bin"))
        .agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
        .collect(), key=lambda r: r["bin"])
    allow, block = sum(r["allow"] for r in bins), sum(r["block"] for r in bins)
    if not allow or not block:
        return 0.0
    best, threshold, kept, dropped, below = -1.0, 0.0, allow, 0, bins[0]["bin"] - 1
    for row in bins:
        quality = kept / allow + dropped / block
        if quality > best:
            best, threshold = quality, (below + 1 + row["bin"]) / 2 / BINS
        below = row["bin"]
        kept, dropped = kept - row["allow"], dropped + row["block"]
    return threshold


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
               rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per page row: id, host, path, the rule that fits, the verdict and the method's score."""
    rest = rest_of(F.coalesce(F.col(url_col), F.lit("")))
    judged = (
        pages.select(F.col(id_col).cast("long").alias("page_id"), rest.alias("_rest"))
        .withColumn("host", host_of(F.col("_rest"))).withColumn("path", path_of(F.col("_rest")))
        .withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    )
    texts = judged.groupBy("_rest").agg(F.first("_rule.verdict").alias("verdict"), F.count(F.lit(1)).alias("n"))
    held_out = F.substring(F.md5("_rest"), 1, 1).isin("0", "1", "2", "3")
    texts = texts.withColumn("_learn", F.col("verdict").isNotNull() & ~held_out)
    positions = texts.select(
        "_rest", "verdict", "_learn",
        F.when(F.col("_learn") & (F.col("verdict") == "allow"), F.col("n")).otherwise(0).alias("allow"),
        F.when(F.col("_learn") & (F.col("verdict") == "block"), F.col("n")).otherwise(0).alias("block"),
        F.explode(grams(F.col("_rest"))).alias("gram"))
    scores = (
        positions.where(~F.col("_learn")).select("_rest", "verdict", "gram").join(log_ratios(positions), "gram")
        .groupBy("_rest").agg(F.round(F.avg("ratio"), 6).alias("score"), F.first("verdict").alias("verdict"))
    )
    threshold = calibrated_threshold(scores.where("verdict IS NOT NULL"))
    unruled = scores.where("verdict IS NULL").select("_rest", "score")
    return judged.join(unruled, "_rest", "left").select(
        "page_id", "host", "path", F.col("_rule.name").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        "score")
