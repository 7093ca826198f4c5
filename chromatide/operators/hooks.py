"""User functions over batches of rows: declared columns in, declared columns out."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: pandas types that keep nulls of whole numbers and truth values
NULLABLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
            pa.bool_(): pd.BooleanDtype()}


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], inputs: list[str], outputs: str | StructType,
                keep: bool = True) -> DataFrame:
    """Run ``fn`` over Arrow batches of the ``inputs`` columns of ``df``.

    ``fn`` gets a pandas frame of exactly those columns (nullable types, so a
    null stays a null and a whole number whole) and returns one with the ``outputs``
    columns, a schema as Spark writes it (``"n long, first string"``).

    With ``keep`` there must be as many rows back, in order: the other columns
    of ``df`` never reach Python objects and stay as they are, a column with the
    name of an output (also by other case) is replaced. Without ``keep`` any
    number of rows may come back and only the outputs are returned. A column
    missing from the result, a wrong number of rows, or a value that does not fit
    its declared type raises an error. Empty batches are not given to ``fn``.
    """
    missing = [c for c in inputs if c not in df.columns]
    if missing:
        raise ValueError(f"no such input columns: {missing}")
    declared = StructType.fromDDL(outputs) if isinstance(outputs, str) else outputs
    new = {f.name.lower() for f in declared}
    if len(new) < len(declared):
        raise ValueError("two outputs have the same name")
    kept = [f for f in df.schema if f.name.lower() not in new] if keep else []
    wanted = to_arrow_schema(declared, timestamp_utc=True)
    places = {c: df.columns.index(c) for c in inputs}
    kept_places = [df.columns.index(f.name) for f in kept]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_arrays([batch.column(i) for i in places.values()], names=list(places))
            got = fn(table.to_pandas(types_mapper=NULLABLE.get))
            absent = [f.name for f in wanted if f.name not in got.columns]
            if absent:
                raise ValueError(f"the function returned no column {absent}")
            if keep and len(got) != batch.num_rows:
                raise ValueError(f"the function returned {len(got)} rows for {batch.num_rows}")
            columns = [pa.Array.from_pandas(got[f.name], type=f.type) for f in wanted]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            old = [batch.column(i) for i in kept_places]
            yield pa.RecordBatch.from_arrays(old + columns, [f.name for f in kept] + wanted.names)

    return df.mapInArrow(run, StructType([*kept, *declared]))
