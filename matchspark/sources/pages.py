"""Records that one pass over each page emits, sent on in parts of bounded size.

A batch of pages is some 64 MB; its records as Python objects are many times that. So pages are opened one at a
time, and what they emit leaves the task whenever it adds up to ``PART``: a task holds one page and one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of records, about, that a task gathers before it sends them on, and bytes counted for a value besides its text.
PART, VALUE = 2 << 20, 16


def emitted(df: DataFrame, column: str, keep: Sequence[str], read: Callable[[str], Iterable[dict]], schema: str) -> DataFrame:
    """``keep`` with the records that ``read`` makes of each row's page; a field that a record lacks is null."""
    rows = df.select(*keep, F.col(column).cast("string").alias("__page"))
    fields = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), schema])
    return rows.mapInArrow(lambda batches: parts(batches, keep, read, fields), kinds)


def parts(batches: Iterator[pa.RecordBatch], keep: Sequence[str], read: Callable[[str], Iterable[dict]], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of records beside their pages' ``keep``, the first columns of ``batches``; the column after them is the page."""
    for batch in batches:
        pages, own = batch.column(len(keep)), pa.RecordBatch.from_arrays(batch.columns[: len(keep)], list(keep)) if keep else None
        owners, records, held = [], [], 0

        def part() -> pa.RecordBatch:
            kept = own.take(pa.array(owners, pa.int64())).columns if own else []
            columns = [arrow([r.get(f.name) for r in records], f.type) for f in fields]
            return pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *fields.names])

        for i in range(batch.num_rows):
            for record in read(pages[i].as_py() or ""):
                owners.append(i)
                records.append(record)
                held += weight(record)
                if held > PART:
                    yield part()
                    owners, records, held = [], [], 0
        if records:
            yield part()


def weight(record: dict) -> int:
    """About the bytes of a record: its texts, those of its lists of records, and something for each value."""
    size = 0
    for v in record.values():
        if isinstance(v, str):
            size += len(v)
        elif isinstance(v, list):
            size += sum(map(weight, v))
        size += VALUE
    return size


def arrow(values: list, kind: pa.DataType) -> pa.Array:
    """Values as a column; lists of records are laid out field by field."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    cells = list(chain.from_iterable(values))
    offsets = pa.array([0, *accumulate(map(len, values))], pa.int32())
    of = list(kind.value_type)
    inner = pa.StructArray.from_arrays([pa.array([c[f.name] for c in cells], f.type) for f in of], fields=of)
    return pa.ListArray.from_arrays(offsets, inner, type=kind)
