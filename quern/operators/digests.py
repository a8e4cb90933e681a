"""Digests over long lists: SHA-256 of a group's values in order, in memory that does not grow with the group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _runs(columns: list[pa.Array], n: int) -> list[int]:
    """Where the rows of the next group begin, and the end."""
    ends = {n}
    for c in columns:
        ends.update(pc.run_end_encode(c).run_ends.to_pylist())
    return sorted(ends)


def _stream(batches: Iterator[pa.RecordBatch], n_keys: int, separator: bytes, trailing: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    key, running = None, None

    def row() -> pa.RecordBatch:
        if trailing:
            running.update(separator)
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip([*key, running.hexdigest()], schema, strict=True)], schema=schema)

    for batch in batches:
        columns, first = batch.columns[:n_keys], 0
        values = batch.column(n_keys).cast(pa.large_binary())
        for last in _runs(columns, batch.num_rows) if batch.num_rows else []:
            own = tuple(c[first].as_py() for c in columns)
            text = separator.join(values.slice(first, last - first).to_pylist())
            if running is not None and own == key:
                running.update(separator)
            else:
                if running is not None:
                    yield row()
                key, running = own, hashlib.sha256()
            running.update(text)
            first = last
    if running is not None:
        yield row()


def ordered_digest(
    rows: DataFrame, by: list[str], order: list[str], value: str, separator: str = "\n", trailing: bool = False, name: str = "digest"
) -> DataFrame:
    """(by..., ``name``): SHA-256, in hexadecimal, of each group's values joined in the order of the columns ``order``.

    A group's rows meet in one task, sorted there by Spark, which can spill;
    the task takes them batch by batch and keeps a running digest. Neither the
    list nor its length is held anywhere, and groups of any size have the
    digest that their whole list has. Null values are left out, and groups of
    them alone; a null key is a group.
    """
    places = {f"_by_{i}": F.col(o) for i, o in enumerate(order)}
    slim = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("string").alias("_value"), *[c.alias(n) for n, c in places.items()])
    sorted_rows = slim.repartition(*by).sortWithinPartitions(*by, *places).select(*by, "_value")
    out = T.StructType([*[T.StructField(b, slim.schema[b].dataType) for b in by], T.StructField(name, T.StringType())])
    n_keys, sep = len(by), separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _stream(batches, n_keys, sep, trailing, to_arrow_schema(out))

    return sorted_rows.mapInArrow(run, out)
