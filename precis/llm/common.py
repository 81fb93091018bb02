"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.sources.store import fresh_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet to the shared folder and read back.

    Cuts the lineage, so a lost executor costs a re-read and not the whole plan. Spark drops the
    shuffle files of this one job when it ends; a later job cannot need them, because it reads the
    written table.
    """
    return written_to(df, fresh_path(df.sparkSession, name))


def written_to(df: DataFrame, path: str) -> DataFrame:
    """:func:`written` to a path of one's own."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that no later job reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def map_arrow(
    df: DataFrame,
    columns: Sequence[str | Column],
    fields: Sequence[T.StructField],
    compute: Callable[[], Callable[[list[pa.Array]], list]],
    inputs: int,
    kept_inputs: int = 0,
) -> DataFrame:
    """Append computed columns to a selection, batch by batch.

    The first ``inputs`` of the selected ``columns`` are handed to the function that ``compute()``
    makes once for every task; it returns one list or array for every field. The other selected
    columns are kept as they are; of the inputs only the first ``kept_inputs`` are, so that a text need not be
    sent twice. A kept column that has the name of a new field gives way to it.
    """
    picked = df.select(*columns)
    new = {f.name for f in fields}
    kept = [i for i, f in enumerate(picked.schema.fields) if not kept_inputs <= i < inputs and f.name not in new]
    plain = picked.toDF(*[f"c{i}" for i in range(len(picked.columns))])
    schema = T.StructType([picked.schema.fields[i] for i in kept] + list(fields))
    names = schema.fieldNames()
    arrow = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = function([batch.column(i) for i in range(inputs)])
            arrays = [batch.column(i) for i in kept]
            arrays += [a if isinstance(a, pa.Array) else pa.array(a, kind) for a, kind in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return plain.mapInArrow(run, schema)


_PLAIN = {
    T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
    T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(),
}


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    return _PLAIN[type(kind)]
