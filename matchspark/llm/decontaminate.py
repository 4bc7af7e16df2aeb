"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased and cut into words, runs of letters and digits. An item's
shingles are its runs of five words, repeats included (fewer words: the whole
item). A window of a document has as many shingles as the item it is held
against, fewer where the document ends.

1. *Windows.* A window can only be similar to an item by ``threshold`` if that
   share of the item's shingles lies in it, and moving it to the first of these
   never lowers the similarity. So windows start at shingles that some item has,
   take the sizes of these items, and need so many benchmark shingles; no other
   window can qualify.
2. *SimHash.* Each distinct window and each item gets a 64-bit SimHash.
3. *Multi-index.* Fingerprints are cut into ``radius + 1`` blocks; two within the
   radius agree in one block at least, so equality joins on blocks, among windows
   and items of one size, find all of them. The window that counts for an item starts
   with one of its shingles, so the first shingle is part of the key: blocks of three bits alone
   would bring every window together with every item.
4. *Verification.* The exact similarity of the weighted shingles (sum of the
   smaller over sum of the larger multiplicities) decides.

At similarity 0.8 SimHashes differ in ten of 64 bits on average; the radius of 20
is 3.5 deviations above. Shingles are held as 64-bit hashes.

Defined results: null and empty texts and items match nothing; repeated rows
count once; an id that repeats with other texts has the best of them; a null id
is an id of its own. Rows of equal similarity: the first window. Either table
may be empty. Columns besides id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.text import fresh, sized, weighed
from matchspark.session import cut

WORDS, THRESHOLD, RADIUS = 5, 0.8, 20
#: Most bytes of benchmark shingles that are sent to every task.
BROADCAST_BYTES = 24 << 20


def words(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, r"[^\p{L}\p{M}\p{N}]+"), "")


def _rows(table: DataFrame, id: str, text: str) -> DataFrame:
    """(id, mark, words); ``mark`` tells rows of the same id apart."""
    text = F.coalesce(F.col(text), F.lit(""))
    return table.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), words(text).alias("words"))


def _runs(n: int) -> Column:
    """Array of structs: each run of n words; the last n - 1 are cut short by null."""
    tails = [F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))) for i in range(n)]
    return F.arrays_zip(*tails)


def _shingles(rows: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """(keep…, pos, h): one row per shingle of n words."""
    runs = rows.filter(F.size("words") >= n).select(*keep, F.posexplode(_runs(n)).alias("pos", "run"))
    full = runs.filter(F.col("run").getField(str(n - 1)).isNotNull())
    return full.select(*keep, "pos", F.xxhash64(*[F.col("run").getField(str(i)) for i in range(n)]).alias("h"))


def _hashes(n: int) -> Column:
    """Array of the hashes of a row's shingles, as :func:`_shingles` has them."""
    full = F.slice(_runs(n), 1, F.greatest(F.size("words") - (n - 1), F.lit(0)))
    return F.transform(full, lambda run: F.xxhash64(*[run.getField(str(i)) for i in range(n)]))


def _occurrences(sets: DataFrame, key: str) -> DataFrame:
    """(key, coded): hashes of shingle and occurrence number: set intersection of these is multiset intersection."""
    counted = sets.select(key, F.explode("hashes").alias("h")).groupBy(key, "h").agg(F.count(F.lit(1)).alias("n"))
    coded = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.xxhash64("h", i))
    return counted.select(key, coded.alias("part")).groupBy(key).agg(F.flatten(F.collect_list("part")).alias("coded"))


def _fingerprints(sets: DataFrame, key: str) -> DataFrame:
    """(key, fp): SimHash of the array ``hashes``."""
    each = sets.select(key, F.explode("hashes").alias("h"))
    ones = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]
    bits = each.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *ones)
    fp = F.lit(0).cast("long")
    for i in range(64):
        fp = fp.bitwiseOR(F.shiftleft((F.col(f"b{i}") * 2 > F.col("n")).cast("long"), i))
    return bits.select(key, fp.alias("fp"))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that cover 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _block(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)


def _indexed(table: DataFrame, radius: int) -> DataFrame:
    parts = [
        F.struct(F.lit(i).alias("block"), _block(F.col("fp"), *b).alias("value")) for i, b in enumerate(_blocks(radius))
    ]
    return table.select("*", F.inline(F.array(*parts)))


def _windows(docs: DataFrame, sets: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, mark, pos, size): windows that hold enough benchmark shingles to be similar to an item."""
    known = sets.select("size", F.explode("hashes").alias("h")).groupBy("h").agg(F.collect_set("size").alias("sizes"))
    known = weighed(cut(known, "shingles"), 32 + 4 * F.size("sizes"), BROADCAST_BYTES)
    hits = cut(_shingles(docs, n, ["id", "mark"]).join(known, "h").distinct(), "hits")
    order = Window.partitionBy("id", "mark").orderBy("pos")
    hits = cut(hits.select("id", "mark", "pos", "sizes", F.row_number().over(order).alias("nth")), "ranked")
    starts = hits.select("id", "mark", "pos", "nth", F.explode("sizes").alias("size"))
    # the last of the shingles that must lie in the window
    need = F.ceil(F.col("size") * threshold - 1e-9)
    starts = starts.withColumn("nth", F.col("nth") + F.greatest(need, F.lit(1)) - 1)
    ends = hits.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), F.col("nth").alias("nth2"), F.col("pos").alias("end"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")) & (F.col("nth") == F.col("nth2"))
    found = starts.join(ends, same).filter("end - pos < size")
    return found.select("id", "mark", "pos", "size")


def _with_hashes(docs: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Windows with the hashes of all their shingles."""
    named = found.withColumnsRenamed({"id": "id2", "mark": "mark2"})
    some = sized(cut(named.select("id2", "mark2").distinct(), "touched"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2"))
    touched = docs.join(some, same, "left_semi").dropDuplicates(["id", "mark"]).withColumn("all", _hashes(n))
    cuts = touched.join(named, same).select("id", "mark", "pos", "size", F.slice("all", F.col("pos") + 1, F.col("size")).alias("hashes"))
    return cuts.withColumn("window", F.sha2(F.concat_ws(",", "size", F.col("hashes").cast("array<string>")), 256))


def matches(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS,
) -> DataFrame:
    """(id, mark, item, similarity, pos, n_words): best window of each row for each item at or above the threshold.

    ``mark`` is xxhash64 of the row's text, ``pos`` the word where the window starts.
    """
    rows = _rows(docs, id, text)
    items = cut(_rows(benchmark, item, item_text).filter(F.size("words") > 0).distinct(), "items")
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(WORDS)).alias("n")).distinct().collect()]
    parts = [_matches(rows, items, n, threshold, radius) for n in sorted(lengths)]
    if not parts:
        kinds = f"id {rows.schema['id'].dataType.simpleString()}, mark long, item {items.schema['id'].dataType.simpleString()}"
        return docs.sparkSession.createDataFrame([], f"{kinds}, similarity double, pos int, n_words int")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _matches(rows: DataFrame, items: DataFrame, n: int, threshold: float, radius: int) -> DataFrame:
    sets = items.filter(F.least(F.size("words"), F.lit(WORDS)) == n).withColumn("hashes", _hashes(n))
    sets = sets.select(F.col("id").alias("item"), F.col("mark").alias("item_mark"), "hashes", F.size("hashes").alias("size"))
    sets = cut(sets.withColumn("row", F.monotonically_increasing_id()), "item-shingles")
    found = cut(_windows(rows, sets, n, threshold), "windows")
    windows = cut(_with_hashes(rows, found, n), "window-shingles")
    distinct = windows.dropDuplicates(["window"]).select("window", "size", "hashes")
    distinct = cut(distinct.join(_fingerprints(distinct, "window"), "window"), "window-prints")
    prints = sets.join(_fingerprints(sets, "row"), "row")
    left = _indexed(distinct.select("window", "size", F.get("hashes", F.lit(0)).alias("first"), "fp"), radius)
    heads = prints.select("row", "size", F.explode(F.array_distinct("hashes")).alias("first"), F.col("fp").alias("fp2"), "fp")
    right = _indexed(heads, radius).drop("fp")
    apart = F.col("fp").bitwiseXOR(F.col("fp2"))
    least = F.coalesce(*[F.when(_block(apart, *b) == 0, F.lit(i)) for i, b in enumerate(_blocks(radius))])
    pairs = left.join(right, ["size", "first", "block", "value"]).filter((F.bit_count(apart) <= radius) & (F.col("block") == least))
    coded = _occurrences(distinct, "window").withColumnRenamed("coded", "a")
    items_coded = sets.select("row", "item", "size").join(_occurrences(sets, "row"), "row").withColumnRenamed("coded", "b")
    both = pairs.select("window", "row").join(coded, "window").join(items_coded, "row")
    shared = F.size(F.array_intersect("a", "b"))
    similarity = shared / (F.size("a") + F.size("b") - shared)
    close = both.select("window", "item", "size", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    placed = windows.select("id", "mark", "pos", "window").join(close, "window")
    best = F.max(F.struct("similarity", (-F.col("pos")).alias("at"), "size"))
    best = placed.groupBy("id", "mark", "item").agg(best.alias("best"))
    return best.select(
        "id", "mark", "item", "best.similarity", (-F.col("best.at")).alias("pos"), (F.col("best.size") + n - 1).alias("n_words")
    )


def keep(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows without a match, with all columns of ``docs``."""
    i, m = fresh(docs, "leak_id_"), fresh(docs, "leak_mark_")
    found = cut(matches(docs, benchmark, id, text, **options).select(F.col("id").alias(i), F.col("mark").alias(m)).distinct(), "leaks")
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.join(sized(found), F.col(id).eqNullSafe(F.col(i)) & (own == F.col(m)), "left_anti")
