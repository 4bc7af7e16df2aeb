"""Exact de-duplication by skew-safe combining.

Three stages, each comparing full content and not only digests:

1. inside each partition, rows of equal text are folded to one (the map side of
   the first aggregation);
2. the folded rows meet by digest *and salt*, so a text that a third of all rows
   share is spread over ``salts`` tasks;
3. the winners of each salt, at most ``salts`` rows per text, meet by digest.

Only digests and ids move when the decision is carried back to the rows.

Defined results: null text counts as empty; equal means identical after
lower-casing A-Z; of equal texts the row with the largest id stays (a null id is
the smallest); of repeated rows with that id one stays, which one does not
matter as they are equal in id and text. An empty table gives no rows.
Columns of the input other than id and text are not looked at by :func:`mark`
and are carried unchanged by :func:`keep`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.text import ascii_lower, fresh
from matchspark.session import cut

SALTS = 16


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(id).alias("id"), ascii_lower(F.col(text)).alias("content"))
    return rows.withColumn("digest", F.unhex(F.sha2("content", 256)))


def winners(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """(digest, content, keep, size): one row per distinct text."""
    rows = _rows(docs, id, text).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    fold = (F.max("id").alias("id"), F.sum("n").alias("n"))
    salted = rows.withColumn("n", F.lit(1).cast("long")).groupBy("salt", "digest", "content").agg(*fold)
    whole = salted.groupBy("digest", "content").agg(*fold)
    return whole.select("digest", "content", F.col("id").alias("keep"), F.col("n").alias("size"))


def _decide(docs: DataFrame, id: str, text: str, salts: int) -> tuple[DataFrame, bool]:
    """Every row's decision, and whether some id and text repeat."""
    won = winners(docs, id, text, salts)
    brief = cut(won.drop("content"), "winners")
    rows, keys = cut(_rows(docs, id, text).drop("content"), "digests"), ["digest"]
    if not brief.groupBy("digest").count().filter("count > 1").isEmpty():
        # two texts share a digest: the text decides
        rows, brief, keys = _rows(docs, id, text), won, ["digest", "content"]
    repeats = rows.groupBy(*keys, "id").count().filter("count > 1")
    stays = F.col("id").eqNullSafe(F.col("keep")).alias("kept")
    found = rows.join(brief, keys).select("id", "keep", "size", "digest", stays)
    return found, not repeats.isEmpty()


def mark(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """(id, keep, size, kept, digest): every row with the decision about it; ``digest`` is SHA-256 of the text."""
    found, repeats = _decide(docs, id, text, salts)
    if not repeats:
        return found
    once = F.row_number().over(Window.partitionBy("digest", "id").orderBy("size")) == 1
    return found.filter("not kept").unionByName(found.filter("kept").withColumn("kept", once))


def keep(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all columns of ``docs``."""
    digest, i, d = (fresh(docs, x) for x in ("digest_", "keep_id_", "keep_digest_"))
    found, repeats = _decide(docs, id, text, salts)
    stays = found.filter("kept").select(F.col("id").alias(i), F.col("digest").alias(d))
    rows = docs.withColumn(digest, F.unhex(F.sha2(ascii_lower(F.col(text)), 256)))
    kept = rows.join(stays, (F.col(digest) == F.col(d)) & F.col(id).eqNullSafe(F.col(i)), "left_semi")
    if repeats:
        kept = kept.dropDuplicates([digest, id])
    return kept.drop(digest)
