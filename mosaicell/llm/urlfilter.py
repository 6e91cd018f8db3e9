"""URL filter: rules, and for the rest a ratio of character language models, with DataFrame functions only.

Two variable-order Markov models, smoothed by the next shorter context, are counted from the URLs that rules accept
and reject. The difference of the log-likelihoods, divided by the length, is held against a threshold that is
calibrated on rule-decided URLs which the models haven't seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values of the contract: rules and their verdicts.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Symbols of the models: fill before the start, end, lower-case letters, any digit, punctuation, and one for all else.
#: Their number bounds the table of grams (38 ** 4 rows of 12 bytes), which is broadcast.
SYMBOLS = "\x02\x03abcdefghijklmnopqrstuvwxyz0-._~/:@%"
BASE = len(SYMBOLS) + 1
ORDER = 3
ALPHA = 2.0
#: Of the rule-decided URLs, one in so many calibrates the threshold; the others are counted.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty if the url is null or has no ://."""
    at = F.instr(F.col(url_col), "://")
    after = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host, path = F.regexp_extract(after, r"^[^/?#]*", 0), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_for(rules=RULES) -> F.Column:
    """The longest rule that fits host and path as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _codes() -> F.Column:
    text = (f"concat(repeat(char(2), {ORDER}), translate(translate(concat(host, path), '{UPPER}', '{LOWER}'), '123456789', '000000000'), char(3))")
    symbols = "concat(char(2), char(3), '" + SYMBOLS[2:] + "')"
    return F.expr(f"transform(split({text}, ''), c -> instr({symbols}, c))")


def with_grams(urls: DataFrame) -> DataFrame:
    """A row for each gram: ORDER + 1 symbols, one gram ending at each character and one at the end, as an integer."""
    code = "+".join(f"c[i - {k}] * {BASE ** k}" for k in range(ORDER + 1))
    return (urls.withColumn("c", _codes())
            .withColumn("gram", F.explode(F.expr(f"transform(sequence({ORDER}, size(c) - 1), i -> int({code}))"))).drop("c"))


def ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio): log-probability of the gram's last symbol under the accepted model less that under the rejected.

    counts: (gram, allow, block). The context is the longest one after which the symbol was counted in either model;
    probabilities are smoothed by the next shorter context, the last by equal chances. All tables here are bounded.
    """
    table = None
    for k in range(ORDER + 1):  # k: symbols of context
        size = BASE ** (k + 1)
        seen = counts.groupBy((F.col("gram") % size).alias("g")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        after = seen.groupBy(F.floor(F.col("g") / BASE).alias("context")).agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
        seen = seen.join(after, F.floor(F.col("g") / BASE) == F.col("context"))
        if table is None:
            lower = seen.withColumns({"low_allow": F.lit(1.0 / BASE), "low_block": F.lit(1.0 / BASE)})
        else:
            short = table.select(F.col("g").alias("s"), F.col("p_allow").alias("low_allow"), F.col("p_block").alias("low_block"))
            lower = seen.join(short, F.col("g") % BASE**k == F.col("s"))
        table = written(lower.select("g", *(((F.col(v) + ALPHA * F.col(f"low_{v}")) / (F.col(f"all_{v}") + ALPHA)).alias(f"p_{v}") for v in ("allow", "block"))), "grams")
        ratio = table.select(F.col("g").alias(f"g{k}"), (F.log("p_allow") - F.log("p_block")).alias(f"r{k}"))
        wanted = wanted.join(ratio, F.col("gram") % size == F.col(f"g{k}"), "left").drop(f"g{k}")
    return wanted.select("gram", F.coalesce(*(f"r{k}" for k in range(ORDER, -1, -1)), F.lit(0.0)).alias("ratio"))


def scored(urls: DataFrame, table: DataFrame) -> DataFrame:
    """`urls` (url, host, path: no repeated rows) with their score: the mean ratio of their grams."""
    return (with_grams(urls).join(F.broadcast(table), "gram").groupBy("url").agg(F.avg("ratio").alias("score")))


def threshold(found: DataFrame) -> float:
    """The score at which the two classes of `found` (verdict, score, n) are told apart with fewest errors, weighed equally; 0 if one is missing."""
    totals = found.groupBy("verdict").agg(F.sum("n")).collect()
    totals = {v: n for v, n in totals}
    if len(totals) < 2:
        return 0.0
    bins = found.groupBy(F.round("score", 3).alias("cut")).pivot("verdict", ["allow", "block"]).agg(F.sum("n")).fillna(0)
    # A few thousand bins: log-ratios have bounded range.
    from pyspark.sql import Window as W

    below = W.orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    errors = bins.select("cut", (F.coalesce(F.sum("allow").over(below), F.lit(0)) / totals["allow"]
                                 + 1 - F.coalesce(F.sum("block").over(below), F.lit(0)) / totals["block"]).alias("errors"))
    # Halfway to the next lower score: the widest margin on both sides.
    errors = errors.withColumn("middle", (F.col("cut") + F.coalesce(F.lag("cut").over(W.orderBy("cut")), F.col("cut"))) / 2)
    return float(errors.orderBy("errors", F.abs("middle"), "middle").first()["middle"])


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (id, host, path, rule, verdict, score) per row of `pages`; score is null where a rule decided.

    Null urls and urls without :// have empty host and path; the models judge them by the end symbol alone. Repeated
    rows stay and are scored once. If rules decide no URL in one of the two ways, the threshold is 0. Other columns are
    ignored, an empty table gives an empty result. Urls are read whole.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = written(with_host_and_path(rows).withColumn("r", rule_for(rules)).select("id", "url", "host", "path", "r.rule", "r.verdict"), "urls")
    fold = F.pmod(F.crc32(F.concat("host", "path")), F.lit(FOLDS)) == 0
    decided = rows.where("rule is not null").groupBy("url", "host", "path", "verdict").agg(F.count("*").alias("n"))
    decided = written(decided.withColumn("held_out", fold), "decided")
    counts = written(with_grams(decided.where("not held_out")).groupBy("gram").agg(
        *(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block"))), "counts")
    urls = written(rows.where("rule is null").select("url", "host", "path").distinct(), "open")
    wanted = with_grams(decided.where("held_out").select("url", "host", "path").unionByName(urls)).select("gram").distinct()
    table = written(ratios(counts, wanted), "ratios")
    calibrating = decided.where("held_out")
    cut = threshold(calibrating.join(scored(calibrating.select("url", "host", "path"), table), "url").select("verdict", "score", "n"))
    method = scored(urls, table).select(F.coalesce("url", F.lit("")).alias("key"), F.col("url").isNull().alias("none"), "score")
    return (rows.join(method, rows["rule"].isNull() & (F.coalesce(rows["url"], F.lit("")) == method["key"]) & (rows["url"].isNull() == method["none"]), "left")
            .select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score"))
