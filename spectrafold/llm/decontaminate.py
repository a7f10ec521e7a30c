"""Benchmark decontamination by a broadcast set of hashed n-grams.

The windows of all benchmark items are hashed. The hashes travel as broadcast tables of at
most MOST_GRAMS each: one for most benchmarks, more of them, each with a scan of its own, for
larger ones, so the path is the same at any size and no broadcast grows. A document's windows
are scanned against them, hits are verified word by word, and spans or whole documents go.
Windows are made, hashed and looked up as they are generated; only hits are ever shuffled.

Words are runs of ASCII letters and digits and of any non-ASCII character, A-Z lower-cased.
A window is `width` consecutive words of an item; an item with fewer words, but not none, is
one window. Main path: DataFrame expressions only.

Nulls: a null text has no words and is never contaminated; a null item is ignored; null ids
are values like any other. Repeated rows of a document get the same result each; repeated
items count once. Empty tables: no hits, or no rows. Very long texts cost in proportion to
their length, in scan() and in clean(). Other columns are not read by scan() and pass through
clean() as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize, packed, unpacked

MOST_GRAMS = 1_000_000
#: what isn't a word of lower-cased text; frequent letters come first, where a match ends the search
GAP = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: words of text that isn't lower-cased yet
WORD = r"[a-z0-9A-Z\x{80}-\x{10FFFF}]+"
#: between a gap and the word after it
STARTS = r"(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[0-9A-Za-z\x{80}-\x{10FFFF}])"


def tokens(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP), lambda w: w != "")


def grams(items: DataFrame, width: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """h, len, gram (its words), item_ids: one row for each different window."""
    own = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), tokens(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    each = own.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("i"))
    each = each.select("item_id", F.slice("w", F.col("i"), F.lit(width)).alias("gram"))
    return each.groupBy("gram").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).select(F.xxhash64("gram").alias("h"), F.size("gram").alias("len"), "gram", "item_ids")


def scan(docs: DataFrame, items: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", most_grams: int = MOST_GRAMS) -> DataFrame:
    """id_col, text_hash, hits (array of (at, len), positions from 1, in order) and item_ids: one
    row for each different document row with a hit."""
    known = materialize(grams(items, width), "grams")
    # two numbers, and at most `width` lengths
    blocks = max(1, -(-known.select("h").distinct().count() // most_grams))
    lengths = sorted(r[0] for r in known.select("len").distinct().collect())
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), tokens(F.col(text_col)).alias("w"))
    found = []
    for n in lengths:
        each = slim.filter(F.size("w") >= n).select("id", "t", "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
        each = each.withColumn("h", F.xxhash64(F.slice("w", F.col("at"), F.lit(n))))
        for k in range(blocks):
            some = known.filter((F.col("len") == n) & (F.pmod("h", F.lit(blocks)) == k)).select(F.col("h").alias("gram_h")).distinct()
            hit = each.join(F.broadcast(some), F.col("h") == F.col("gram_h"))
            found.append(hit.select("id", "t", "at", F.lit(n).alias("len"), "h", F.slice("w", F.col("at"), F.lit(n)).alias("words")))
    if not found:
        found = [slim.filter(F.lit(False)).select("id", "t", F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("h"), F.col("w").alias("words"))]
    hits = reduce(DataFrame.unionAll, found).join(known.select("h", F.col("gram").alias("words"), "item_ids"), ["h", "words"])
    out = hits.groupBy("id", "t").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    return out.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), "hits", "item_ids")


def covered(hits: Column) -> Column:
    """How many words the hits cover."""

    def step(acc, x):
        end = x["at"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["at"]))).alias("n"))

    return F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"].cast("long"))


def report(docs: DataFrame, items: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", most_grams: int = MOST_GRAMS) -> DataFrame:
    """id_col, n_words, hits, item_ids, n_hit and contaminated (a twentieth of the words or more
    are hit) for every row of docs, repeated ones included."""
    got = scan(docs, items, width, id_col, text_col, most_grams).select(F.col(id_col).alias("hit_id"), "text_hash", "hits", "item_ids")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), F.xxhash64(F.col(text_col).cast("string")).alias("own_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    got = rows.join(got, F.col(id_col).eqNullSafe(F.col("hit_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    none = F.expr("cast(array() as array<string>)")
    got = got.select(id_col, "n_words", "hits", F.coalesce("item_ids", none).alias("item_ids"), F.coalesce(covered(F.col("hits")), F.lit(0)).cast("long").alias("n_hit"))
    return got.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _without(text: Column, hits: Column) -> Column:
    """text without the words that hits cover and the gap after each. The text is split once
    and words are taken by their number, so the cost is in proportion to the length."""
    gone = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))))
    # each part is a word with the gap after it, numbered as words are; one before them, a gap alone, is 0
    first = lambda p: F.when(F.get(p, F.lit(0)).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), 1).otherwise(0)
    keep = lambda p, a: F.transform(F.array_except(F.sequence(a, a + F.size(p) - 1), gone), lambda i: F.get(p, i - a))
    return let(F.split(text, STARTS), lambda p: let(first(p), lambda a: F.array_join(keep(p, a), "")))


def clean(docs: DataFrame, items: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", most_grams: int = MOST_GRAMS) -> DataFrame:
    """docs without contaminated documents; in others the words that were hit are cut out of
    the text, with what stands between them. Documents without a hit are unchanged."""
    got = scan(docs, items, width, id_col, text_col, most_grams).select(F.col(id_col).alias("hit_id"), "text_hash", "hits")
    rows = packed(docs, own_id=F.col(id_col), own_hash=F.xxhash64(F.col(text_col).cast("string")))
    both = rows.join(got, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    text = F.col("row").getField(text_col)
    bad = F.col("hits").isNotNull() & (20 * covered(F.col("hits")) >= F.regexp_count(text.cast("string"), F.lit(WORD)))
    cut = F.when(F.col("hits").isNull(), text).otherwise(_without(text.cast("string"), F.col("hits")))
    return unpacked(both.filter(~F.coalesce(bad, F.lit(False))), docs.columns, {text_col: cut})
