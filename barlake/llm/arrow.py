"""Columns computed in Python beside columns that stay in Arrow.

Ids are passed on as the Arrow arrays they came in, so a null among them changes no value and
no type: a long beside a null would become a rounded double in pandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROWS = 1000  # rows computed at a time: long texts and what is made of them are held for these only
Compute = Callable[[pa.RecordBatch], Sequence[object]]


def computed(rows: DataFrame, keep: Sequence[str], added: str, make: Callable[[], Compute]) -> DataFrame:
    """``keep`` columns of ``rows`` and the ``added`` ones (DDL).

    ``make`` runs once per task; what it returns gives for each batch the added columns, in
    order, as lists or arrays of the batch's length.
    """
    extra = T._parse_datatype_string(added)
    kinds = [to_arrow_type(f.dataType) for f in extra.fields]
    schema = T.StructType([*[rows.schema[c] for c in keep], *extra.fields])
    keep, names = list(keep), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            values = [pa.array(v, type=k) for v, k in zip(compute(batch), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *values], names)

    return rows.mapInArrow(run, schema)
