"""Quality rules: plain counts of each text, and a likelihood ratio of hashed n-grams; DataFrame functions throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, shielded, space_parts, word_array

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def repeated_words(hashes: Column, width: int = 3) -> Column:
    """How many words lie in a window of `width` words that the text holds twice or more, from the words' hashes.

    Windows' hashes are sorted with their places, equal neighbours kept, and the places' windows
    merged; texts whose windows all differ stop before the sort.
    """

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))

        def merged(p: Column) -> Column:
            own = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(width), F.get(p, k + 1) - x), F.lit(width)))
            return F.aggregate(own, F.lit(0), lambda a, x: a + x)

        found = let(let(pairs, twice), merged)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found).cast("long")

    n = F.size(hashes) - width + 1
    windows = F.transform(F.slice(hashes, 1, F.greatest(n, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, width)]))
    return let(windows, counted)


def ngram_buckets(words: Column, buckets: int) -> Column:
    """Hash buckets (from 0) of a text's words and of its pairs of neighbours."""
    place = lambda *w: F.pmod(F.xxhash64(*w), F.lit(buckets).cast("long")).cast("int")
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: place(w, F.get(words, i + 1)))
    return F.concat(F.transform(words, lambda w: place(w)), pairs)


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """doc_ids labelled of good quality and not toxic: all, or the `most` with the least hashes if there are more."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    own = good.select(F.col("doc_id").cast("long").alias("__trusted")).distinct()
    return own.orderBy(F.xxhash64("__trusted"), "__trusted").limit(most)


def log_ratios(docs: DataFrame, labels: DataFrame, *, buckets: int, most: int) -> tuple[list[float], int]:
    """log p(bucket | trusted) - log p(bucket | corpus) for each bucket, both multinomials smoothed by one.

    The corpus counts cover all documents. Documents of at most `most` trusted ids, a broadcast of
    that bound, make the target. What comes to the driver is one row a bucket. Also returns how many
    n-grams the target was counted from.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_array(F.col("text").cast("string")).alias("words"))
    marked = own.join(F.broadcast(trusted_ids(labels, most)), F.col("doc_id") == F.col("__trusted"), "left")
    each = marked.select(F.col("__trusted").isNotNull().cast("int").alias("trusted"), F.explode(let(F.col("words"), lambda w: ngram_buckets(w, buckets))).alias("bucket"))
    rows = each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("trusted").alias("t")).collect()
    n, t = [0] * buckets, [0] * buckets
    for r in rows:
        n[r["bucket"]], t[r["bucket"]] = r["n"], r["t"]
    if not sum(t):
        return [0.0] * buckets, 0
    shift = math.log(sum(n) + buckets) - math.log(sum(t) + buckets)
    return [math.log(a + 1) - math.log(b + 1) + shift for a, b in zip(t, n, strict=True)], sum(t)


def judge(docs: DataFrame, labels: DataFrame, *, buckets: int = 10_000, most: int = 100_000, threshold: float = -0.03, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """docs with a column `quality`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    score is the mean log-likelihood ratio of the text's hashed words and pairs between trusted and
    all documents; a document is kept if it passes the base rules (at least_words, at most
    most_repeated percent of words in repeated windows) and its score is not below threshold, less
    buckets / trusted n-grams: about what a text outside the target loses by the target's sampling
    noise. The ratios come as a constant array, so each text is read once, without a shuffle.

    Null and empty texts have zero counts, no score and are not kept. Null and repeated ids and rows
    stay; without trusted documents all scores are 0. A table may have a column named quality: it is
    replaced. An empty table gives an empty one.
    """
    ratios, seen = log_ratios(docs, labels, buckets=buckets, most=most)
    least = threshold - buckets / max(seen, 1)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gone = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)

    def of(w: Column, spaces: Column) -> Column:
        found = let(ngram_buckets(w, buckets), lambda b: F.aggregate(b, F.lit(0.0), lambda a, k: a + F.get(table, k)) / F.size(b))
        repeated = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: repeated_words(h))
        return F.struct(F.size(w).cast("long").alias("n_words"), (F.length(text) - spaces).cast("long").alias("word_chars"), repeated.alias("n_repeat_words"), F.when(F.size(w) > 0, found).alias("score"))

    # Splitting at each space gives one part more than there are spaces.
    both = F.struct(
        let(space_parts(text), lambda p: let(F.filter(p, lambda x: x != ""), lambda w: of(w, F.size(p) - 1))).alias("w"),
        gone(SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )

    def verdict(x: Column) -> Column:
        failed = (x["w"]["n_words"] < least_words) | (100 * x["w"]["n_repeat_words"] > most_repeated * x["w"]["n_words"])
        kept = ~failed & F.coalesce(x["w"]["score"] >= least, F.lit(False))
        return F.struct(x["w"]["n_words"].alias("n_words"), x["w"]["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"), x["w"]["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), x["w"]["score"].alias("score"), kept.alias("kept"))

    return docs.withColumn("quality", let(both, verdict))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that judge() keeps, columns unchanged whatever their names; an empty table gives an empty one."""
    own, back = shielded(docs, ("doc_id", "text"))
    return back(judge(own, labels, **options).filter(F.col("quality.kept")).drop("quality"))
