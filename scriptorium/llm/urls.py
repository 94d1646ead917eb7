"""URL filter: rules first, then the ratio of two character language models.

Accepted and rejected URLs (those that a rule decides) train one variable-order Markov model each. A model predicts a
character from up to ``order`` characters before it, with Witten-Bell smoothing: every order is mixed with the next
shorter one, and contexts seen fewer than ``min_context`` times are passed over, so the order varies with what is
known. A URL's score is the mean over its characters of ``log p_accepted - log p_rejected``. The threshold is
calibrated on labelled URLs that were held out (crc32 of the URL modulo 3 is 1): where the scores of both classes,
seen as normal distributions, are the same number of deviations away from it.

All steps are column expressions, joins and counts. A URL is cut into grams (a character with the ``order`` before
it); equal grams are scored once; grams and contexts are spread by their own hash. Contexts of no or one character, which many
grams share, are repeated ``SALTS`` times (at most ``SALTS`` rows for each character there is), and a gram meets the copy that its hash
names, so no key takes more than about one row in 32 of those. Nothing is collected but the six calibration figures.

Defined cases: null URLs and URLs without ``://`` have empty host and path and fit no rule; where one class has no
training URL, or nothing is held out, the threshold is 0 and unseen things score 0, which means allow; equal URLs get
equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.base import saved

ORDER = 4
MIN_CONTEXT = 2
ALPHABET = 256.0
#: Copies of contexts and of their characters up to this length, for the joins.
SALTS, SALTED = 32, 1
#: (verdict, host, path) of the production filter
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before the first character of a URL.
_START = "\u0002"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _CAPITALS, _SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Of equal length the first in the list wins."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2]), reverse=True)[::-1]:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting = F.when(fits, found).otherwise(fitting)
    return fitting


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """(url, gram): every character of the lower-cased URL with the ``order`` characters before it."""
    padded = F.concat(F.lit(_START * order), F.lower("url"))
    return urls.withColumn("_padded", padded).select(
        *urls.columns,
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("_padded") - order), lambda i: F.substring(F.col("_padded"), i, F.lit(order + 1))
            )
        ).alias("gram"),
    )


def train(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(context, char, a, r): how often a character follows a context of 0 to ``order`` characters in each class.

    ``labelled`` has url and accepted (boolean).
    """
    grams = (
        _grams(labelled.select("url", "accepted").filter(F.length("url") > 0), order)
        .groupBy("gram")
        .agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(order)))
    return (
        grams.select("*", levels.alias("k"))
        .groupBy(
            F.substring(F.col("gram"), F.lit(order + 1) - F.col("k"), F.col("k")).alias("context"),
            F.substring(F.col("gram"), F.lit(order + 1), F.lit(1)).alias("char"),
        )
        .agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    )


def _mixed(levels: Column, n: str, total: str, kinds: str, min_context: int) -> Column:
    """Smoothed probability from the levels of a gram, shortest context first."""
    return F.aggregate(
        levels,
        F.lit(1 / ALPHABET),
        lambda p, x: F.when(
            F.coalesce(x[total], F.lit(0)) >= min_context,
            (F.coalesce(x[n], F.lit(0)) + x[kinds] * p) / (x[total] + x[kinds]),
        ).otherwise(p),
    )


def gram_scores(grams: DataFrame, model: DataFrame, order: int = ORDER, min_context: int = MIN_CONTEXT) -> DataFrame:
    """(gram, score) for distinct grams: log ratio of the two models."""
    short = F.length("context") <= SALTED
    copies = F.explode(F.sequence(F.lit(0), F.when(short, F.lit(SALTS - 1)).otherwise(F.lit(0)))).alias("salt")
    contexts = (
        model.groupBy("context")
        .agg(
            F.sum("a").alias("total_a"),
            F.sum("r").alias("total_r"),
            F.count_if(F.col("a") > 0).alias("kinds_a"),
            F.count_if(F.col("r") > 0).alias("kinds_r"),
        )
        .select("*", copies)
    )
    levels = grams.select("gram", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")).select(
        "gram",
        "k",
        F.substring(F.col("gram"), F.lit(order + 1) - F.col("k"), F.col("k")).alias("context"),
        F.substring(F.col("gram"), F.lit(order + 1), F.lit(1)).alias("char"),
        F.when(F.col("k") <= SALTED, F.pmod(F.xxhash64("gram"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)).alias("salt"),
    )
    seen = levels.join(contexts, ["context", "salt"])
    seen = seen.join(model.select("*", copies), ["context", "char", "salt"], "left")
    fields = ["k", "a", "r", "total_a", "total_r", "kinds_a", "kinds_r"]
    # at most order + 1 rows for each gram
    by_gram = seen.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("levels"))
    accepted = _mixed(F.col("levels"), "a", "total_a", "kinds_a", min_context)
    rejected = _mixed(F.col("levels"), "r", "total_r", "kinds_r", min_context)
    return by_gram.select(F.col("gram").alias("g"), (F.log(accepted) - F.log(rejected)).alias("score"))


def score(urls: DataFrame, model: DataFrame, order: int = ORDER, min_context: int = MIN_CONTEXT) -> DataFrame:
    """(url, score) for every distinct url: mean log ratio by character."""
    distinct = urls.select("url").filter(F.length("url") > 0).distinct()
    grams = _grams(distinct, order).groupBy("url", "gram").agg(F.count("*").alias("n"))
    scores = gram_scores(grams.select("gram").distinct(), model, order, min_context)
    return (
        grams.join(scores, F.col("gram") == F.col("g"), "left")
        .groupBy("url")
        .agg((F.sum(F.col("n") * F.coalesce("score", F.lit(0.0))) / F.sum("n")).alias("score"))
    )


def calibrate(scored: DataFrame) -> float:
    """Threshold from (score, accepted) of URLs the models have not seen."""
    row = scored.agg(
        *[
            f(F.when(F.col("accepted") == side, F.col("score"))).alias(f"{name}_{side}")
            for side in (True, False)
            for name, f in (("mean", F.avg), ("dev", F.stddev_pop), ("n", F.count))
        ]
    ).first()
    if not row["n_True"] or not row["n_False"]:
        return 0.0
    spread = row["dev_True"] + row["dev_False"]
    if spread == 0:
        return (row["mean_True"] + row["mean_False"]) / 2
    return (row["mean_True"] * row["dev_False"] + row["mean_False"] * row["dev_True"]) / spread


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """``pages`` (with a url) plus host, path, rule, verdict and score (null where a rule decides)."""
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    ruled = pages.drop("host", "path", "rule", "verdict", "score").withColumns({"host": host, "path": path})
    found = rule_of(F.col("host"), F.col("path"), rules)
    ruled = ruled.withColumn("rule", found["rule"]).withColumn("verdict", found["verdict"])
    labelled = saved(
        ruled.filter("verdict is not null").select("url", (F.col("verdict") == "allow").alias("accepted")).distinct(), "url-labels"
    )
    held_out = F.crc32(F.col("url").cast("binary")) % 3 == 1
    model = saved(train(labelled.filter(~held_out), order), "url-model")
    tested = labelled.filter(held_out)
    threshold = calibrate(score(tested, model, order).join(tested, "url"))
    scores = score(ruled.filter("verdict is null"), model, order).select(F.col("url").alias("_url"), "score")
    return (
        ruled.join(scores, F.col("verdict").isNull() & (F.col("url") == F.col("_url")), "left")
        .drop("_url")
        .withColumn(
            "verdict",
            F.coalesce("verdict", F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")),
        )
    )


def report(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
