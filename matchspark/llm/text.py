"""Small shared helpers: ASCII lower case, folds, Arrow batches."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of text that a Python worker holds as objects at once, by bytes.
SLICE_BYTES = 8 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null is the empty text. ``lower`` does the same on pure ASCII and is faster there."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def held_out(id: Column, folds: int, fold: int) -> Column:
    """Whether the row is in the fold kept from learning: crc32 of the id as text. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``size`` bytes, or one row."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def unsigned(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, dtype=np.int64).view(np.uint64)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Most rows of a side that is sent to every task: a few columns each, so a few tens of MB.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table if it was counted to be small; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space of each text, null being empty.

    Returns a number for each word of all texts, equal for equal words; the place of each text's
    first word, then the number of words in all; and the distinct words by their number.
    """
    split = pc.ascii_split_whitespace(column.cast(pa.large_binary()).fill_null(b"").cast(pa.large_string()))
    ends = np.asarray(split.offsets).astype(np.int64)
    flat = split.values.slice(ends[0], ends[-1] - ends[0])
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))  # white space at an end leaves an empty piece
    starts = np.concatenate(([0], np.cumsum(full)))[ends - ends[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices).astype(np.int64), starts, coded.dictionary


def weighed(df: DataFrame, bytes: Column, most: int) -> DataFrame:
    """Broadcast a written table if its rows, ``bytes`` each, are measured to be small; else leave the join to shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(bytes)).first()[0] or 0) <= most else df
