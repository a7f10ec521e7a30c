"""Quality rules with risk-controlled thresholds.

Every document gets integer base counts, and every rule a score in thousandths that is high
for poor text. Rules are brought to one scale, on which SCALES, the share that web-text filters
commonly allow, is 1000; the score of a document is the largest of them. So the cutoffs of a
stratum are one ordered family of joint rule sets: a cutoff on the score is a cutoff for each
rule. For a stratum, the good documents of a labelled holdout say how many good ones a cutoff
would reject. Cutoffs are tested from the loosest down, each by the exact binomial tail: a cutoff
passes while P(Bin(n, limit) <= false rejections) is at most the level, and testing stops at the
first that fails (fixed sequence), so neither the grid nor the number of rules costs a
correction; over strata the level is divided by their number (Bonferroni). So a stratum falsely
rejects at most `limit` of its good documents, except with probability `delta` over all strata
together. Among cutoffs that pass, the one with the largest lead of rejected poor over rejected
good documents is taken, the loosest of equals; a stratum without such a lead rejects nothing.
With a limit of 2%, a level of 5% and four strata, 217 good documents in a stratum are enough.

Main path: DataFrame expressions only. A document's counts need no other rows, hence no
shuffle. A null text has no words; a null stratum is a stratum of its own; a stratum without
enough holdout has no cutoffs. Repeated rows count as often as they occur. Empty tables give
no rows. Lines of thousands of words cost n log n. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words

RULES = ("symbols", "dup_lines", "repeats", "shouting", "long_words")
#: Thousandths of a rule that count as 1000 on the common scale.
SCALES = {"symbols": 100, "dup_lines": 300, "repeats": 150, "shouting": 100, "long_words": 50}
MOST_SCORE = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(starts: Column, width: int) -> Column:
    """How many positions the windows of so many words at the ascending starts cover."""
    step = lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(width), s - acc["last"])).alias("n"))
    return F.aggregate(starts, F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def repeated_words(ws: Column, width: int = 5) -> Column:
    """Words in windows of width words that occur twice or more in ws, the first included.
    Windows are compared by 64-bit hashes."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - width + 1), lambda i: F.xxhash64(F.slice(ws, i, width)))

    def repeated(h):
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _covered(F.sort_array(F.transform(let(at, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])), width)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))
    return F.when(F.size(ws) <= width, F.lit(0)).otherwise(some)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id_col, stratum, the base counts, n_shout (words without a lower-case letter that end
    in ! or have two letters or more) and n_long (words of 30 characters or more)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col), F.col(stratum_col).cast("string").alias("stratum"), text.alias("__text"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"), words(F.col(text_col).cast("string")).alias("__words"))
    return slim.select(
        F.col(id_col),
        "stratum",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        F.regexp_count("__text", F.lit(r"(?<![^\x20\x09-\x0D])[^a-z\x20\x09-\x0D]*[A-Z][^a-z\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")).cast("long").alias("n_shout"),
        F.regexp_count("__text", F.lit(r"[^\x20\x09-\x0D]{30,}+")).cast("long").alias("n_long"),
    )


def _permille(part: str, whole: str) -> Column:
    return F.least(F.lit(1000), F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))).cast("int")


def scored(counted: DataFrame) -> DataFrame:
    """counted with one score in thousandths for each of RULES, on the common scale, and score,
    the largest of them."""
    parts = (("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_shout", "n_words"), ("n_long", "n_words"))
    got = counted.withColumns({f"score_{r}": F.floor(_permille(*p) * 1000 / SCALES[r]).cast("int") for r, p in zip(RULES, parts)})
    return got.withColumn("score", F.least(F.greatest(*[F.col(f"score_{r}") for r in RULES]), F.lit(MOST_SCORE)))


def tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in logarithms; 1 beyond the mean, where no cutoff
    passes anyway."""
    odds = F.log(F.lit(p / (1 - p)))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (F.greatest(acc["sum"], term) + F.log1p(F.exp(-F.abs(acc["sum"] - term)))).alias("sum"))

    start = n * F.log1p(F.lit(-p))
    total = F.aggregate(F.filter(F.sequence(F.lit(0), k.cast("int")), lambda i: i > 0), F.struct(start.alias("term"), start.alias("sum")), step, lambda acc: F.exp(acc["sum"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def cutoffs(holdout: DataFrame, limit: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, cutoff, n_good, n_false, n_poor and p (the tail at the cutoff) from scored rows
    with `good` (0 or 1; rows without are left out). A document is rejected where its score is
    above the cutoff.

    After the first aggregation there are at most MOST_SCORE + 1 rows for a stratum."""
    hist = holdout.filter("good in (0, 1)").groupBy("stratum", "score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("poor"))
    key = Window.partitionBy("stratum")
    above = key.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    strata = hist.select("stratum").distinct().agg(F.count(F.lit(1)).alias("n_strata"))
    hist = hist.withColumns({"n_good": F.sum("good").over(key), "n_false": F.coalesce(F.sum("good").over(above), F.lit(0)), "n_poor": F.coalesce(F.sum("poor").over(above), F.lit(0))}).join(F.broadcast(strata))
    hist = hist.withColumn("p", tail(F.col("n_good"), F.col("n_false"), limit))
    passes = F.min((F.col("p") <= delta / F.col("n_strata")).cast("int")).over(key.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    lead = F.col("n_poor") - F.col("n_false")
    best = hist.withColumn("ok", passes).filter((F.col("ok") == 1) & (lead > 0)).withColumn("at", F.row_number().over(key.orderBy(lead.desc(), F.desc("score"))))
    return best.filter("at = 1").select("stratum", F.col("score").alias("cutoff"), "n_good", "n_false", "n_poor", "p")


def judge(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Scored rows with base_failed, failed_rules (those above the cutoff of their stratum) and
    kept. cuts has at most one row for a stratum, and Spark broadcasts it by its size."""
    by = cuts.select(F.col("stratum").alias("__stratum"), F.col("cutoff").alias("__cutoff"))
    got = rows.join(by, F.col("stratum").eqNullSafe(F.col("__stratum")), "left").drop("__stratum")
    failed = F.filter(F.array(*[F.when(F.least(F.col(f"score_{r}"), F.lit(MOST_SCORE)) > F.col("__cutoff"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return got.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__cutoff")
