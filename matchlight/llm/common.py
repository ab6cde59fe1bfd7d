"""What the text operators share: reading documents and running Arrow kernels over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a kernel turns into Python objects at once.
CHUNK_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about CHUNK_BYTES in the column each, one row at least."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK_BYTES:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    yield batch.slice(first)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[str], tuple]], fields: str, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the kept columns, then the tuple that the kernel makes of the text.

    make() runs once per task and returns the kernel, which gets the text with
    null as an empty value. fields is the DDL of what it returns.
    """
    added = StructType.fromDDL(fields)
    schema = docs.select(*keep).schema
    for f in added:
        schema = schema.add(f)
    target = _arrow_schema(schema)
    n_keep = len(keep)
    empty = b"" if docs.schema[column].dataType.typeName() == "binary" else ""

    def run(batches):
        kernel = make()
        for batch in batches:
            for part in chunks(batch, column):
                rows = [kernel(empty if t is None else t) for t in part.column(column).to_pylist()]
                made = zip(*rows) if rows else [[]] * (len(target) - n_keep)
                columns = [part.column(i).cast(target.field(i).type) for i in range(n_keep)]
                columns += [pa.array(list(v), type=target.field(n_keep + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    picked = docs.select(*keep, F.col(column))
    return picked.mapInArrow(run, schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
