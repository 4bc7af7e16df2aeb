"""Spelling variants by asymmetric chunks.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's
form is its near word of the largest count (ties: the smallest in code-point order), if that
count is at least ``ratio`` times its own; its root is where the forms lead.

One word of a pair, the shorter, is cut into two disjoint chunks; one edit leaves at least one of them
whole. The other word contributes its grams by length and place; a whole chunk stands there
at its own place or, behind the edit, shifted by one. A half alone is shared by too many words (on half a
gigabyte of documents 500,000 words had 200 million such pairs), so the half that may hold the edit is cut in two
again, and again, until it has ``REST`` letters or ``PIECES`` pieces are reached: the key of a
join is a word without one piece. Of the gram word just the grams are made that stand where a chunk of a
word of its length, or of one letter less, could: at shift nought before the edit, and behind it
at the difference of the lengths, which is nought or one. Pairs that share a key are verified by their distance.

Keys are 64-bit hashes and only choose candidates. No pair is lost or made twice, and none but of words that share
all but one piece meet. Joins are sort-merge by hint: a table as small as the words' file would be sent to every worker,
and the plan does not see that the rows exploded from it are ten times as many.

Defined results: null words are dropped; a null count counts as nought; of repeated words the
counts are added; an empty table gives no rows; columns other than word and count play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.session import cut

#: Letters of the piece that may hold the edit, and the most pieces of a (very long) word.
REST, PIECES = 2, 64


def _pieces(length: Column) -> Column:
    """Number of pieces of a word: a power of two."""
    halvings = F.ceil(F.log2(F.greatest(length, F.lit(REST)) / REST))
    return F.least(F.pow(F.lit(2), halvings), F.lit(PIECES)).cast("int")


def _keys(word: Column, length: Column, other: Column) -> Column:
    """For each piece of a word of ``other`` letters: what stands before and behind it, in ``word`` of ``length`` letters.

    ``length`` is ``other`` or one more.
    """
    pieces = _pieces(other)

    def key(i: Column) -> Column:
        before = F.floor(i * other / pieces).cast("int")
        behind = other - F.floor((i + 1) * other / pieces).cast("int")
        return F.xxhash64(other, i, F.substring(word, F.lit(1), before), F.substring(word, length - behind + 1, behind))

    return F.transform(F.sequence(F.lit(0), pieces - 1), key)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of distinct (word, n) with one edit between them, once."""
    size = F.char_length("word").cast("int")
    own = words.select("word", "n", size.alias("length"))
    chunks = own.select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(_keys(F.col("word"), F.col("length"), F.col("length"))).alias("key")
    )
    grams = own.select(
        F.col("word").alias("b"), F.col("n").alias("n_b"),
        F.explode(F.concat(
            _keys(F.col("word"), F.col("length"), F.col("length")), _keys(F.col("word"), F.col("length"), F.col("length") - 1)
        )).alias("key"),
    )
    order = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    found = chunks.join(grams.hint("merge"), "key").filter(order & (F.levenshtein("a", "b", 1) == 1))
    return found.drop("key").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: doubling the steps each round."""
    paths = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = paths.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = cut(moved, "roots", paths)
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        paths = after


def variants(words: DataFrame, word: str = "word", count: str = "n", ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    own = words.select(F.col(word).alias("word"), F.coalesce(F.col(count), F.lit(0)).cast("long").alias("n")).filter("word is not null")
    own = cut(own.groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = cut(near_pairs(own), "near")
    both = pairs.unionAll(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("n_b"), "b")).alias("best"))
    named = own.join(best, "word", "left").withColumn("top", -F.col("best.col1"))
    led = F.col("top") >= ratio * F.col("n")
    found = cut(named.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(led, F.col("best.b")).alias("form"), F.when(led, F.col("top")).alias("form_n"),
    ), "forms")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
