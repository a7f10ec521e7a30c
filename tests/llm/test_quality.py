"""Quality cutoffs against a plain binomial, where rules do reject."""

import math
import random
from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from spectrafold.llm import quality
from spectrafold.llm import queries as Q


def test_tail(spark):
    rows = [(n, k) for n in (1, 7, 300) for k in range(0, min(n, 6))]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", quality.tail(F.col("n"), F.col("k"), 0.02).alias("p")).collect()
    for r in got:
        want = 1.0 if r.k >= r.n * 0.02 else sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - want) < 1e-9


def plain_cutoffs(rows, limit=0.02, delta=0.05):
    """rows: (stratum, good, score)."""
    strata, out = {r[0] for r in rows}, {}
    for st in strata:
        own = [(g, x) for s, g, x in rows if s == st]
        n, best = sum(g for g, _ in own), None
        for c in sorted({x for _, x in own}, reverse=True):
            k, poor = (sum(g == v and x > c for g, x in own) for v in (1, 0))
            p = 1.0 if k >= n * limit else float(sum(comb(n, i) * Fraction(limit) ** i * (1 - Fraction(limit)) ** (n - i) for i in range(k + 1)))
            if p > delta / len(strata):
                break
            if poor - k > 0 and (best is None or poor - k > best[0]):
                best = (poor - k, c, n, k, poor)
        if best:
            out[st] = best[1:]
    return out


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "stratum string, good int, score int")


def test_labels_that_a_stratum_needs(spark):
    """With four strata a cutoff without false rejections takes 217 good documents."""
    sizes = {"a": 217, "b": 216, "c": 10, None: 400}
    rows = [(s, 1, 100) for s, n in sizes.items() for _ in range(n)] + [(s, 0, 900) for s in sizes for _ in range(20)]
    got = {r.stratum: (r.cutoff, r.n_false, r.n_poor) for r in quality.cutoffs(frame_of(spark, rows)).collect()}
    assert got == {"a": (100, 0, 20), None: (100, 0, 20)}
    assert quality.cutoffs(frame_of(spark, [])).collect() == []


def test_cutoffs_against_exact_fractions_and_false_rejection(spark):
    """Many draws: the share of strata whose true false rejection is above the limit stays
    within delta."""
    rng = random.Random(4)
    rows = [(f"s{k}", g, min(2000, int(rng.expovariate(1 / (150 if g else 400))))) for k in range(12) for g in [1] * 700 + [0] * 150]
    got = {r.stratum: (r.cutoff, r.n_good, r.n_false, r.n_poor) for r in quality.cutoffs(frame_of(spark, rows)).collect()}
    assert got and got == plain_cutoffs(rows)
    true = [math.exp(-(c + 1) / 150) for c, *_ in got.values()]  # of good scores above the cutoff
    assert sum(x > 0.02 for x in true) <= 1


def test_verdicts_of_the_query(spark):
    """Cutoffs for all four languages of sf0.1; kept follows from them."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    rows = quality.scored(quality.counts(spark.read.parquet(f"{sf}/documents.parquet")))
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"))
    own = rows.join(labels, "doc_id", "left").collect()
    cuts = plain_cutoffs([(r.stratum, r.good, r.score) for r in own if r.good is not None])
    assert set(cuts) == {"en", "de", "es", "fr"}
    got = {r.doc_id: r.kept for r in Q.op5_quality(spark, sf).collect()}
    assert got == {r.doc_id: not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words or r.score > cuts[r.stratum][0]) for r in own}
