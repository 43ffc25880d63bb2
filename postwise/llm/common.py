"""Shared helpers: column attachment over Arrow batches, stored steps, worker caches."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of an Arrow batch worked on at once; bounds the Python objects alive, not the rows.
SLICE_ROWS = 512
# Rows of a batch between Spark and Python unless the session names another number: texts are wide rows.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/postwise-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    frame = df.sparkSession.read.schema(df.schema).parquet(path)
    frame.stored_at = path
    return frame


def discard(frame: DataFrame) -> None:
    """Delete the folder of a frame of ``stored`` that nothing will read again."""
    path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
    path.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def whole_text(column: str) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def boxed(df: DataFrame, **columns: str) -> DataFrame:
    """Every row as one struct ``row``, beside copies of some short columns under names of the caller's.

    Work beside the struct cannot meet a column of the input, whatever its name;
    ``select("row.*")`` gives the rows back. ``inside`` names a text in the struct for ``attach``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(row, *[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def inside(df: DataFrame, column: str) -> tuple[str, int]:
    return "row", df.columns.index(column)


def worker_cache() -> dict:
    """Objects that live as long as the Python worker, such as compiled tables."""
    return sys.__dict__.setdefault("_postwise_llm_cache", {})


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    values = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    return [b"" if v is None else v for v in values.to_pylist()]


def narrow_batches(spark: SparkSession) -> None:
    """Smaller batches for wide rows, where the session has the default number of rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def attach(
    df: DataFrame,
    text: str | tuple[str, int],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list[bytes]], list]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with new columns computed from the whole texts of one column, Arrow batch by batch.

    ``make()`` runs once per task and returns a function from the UTF-8 texts of a
    batch to one Arrow-convertible column per field. ``keep`` names the input columns to
    pass on (all by default); one whose name equals a new field, in any case, is replaced.
    ``text`` may be a struct column and the place of the text in it.
    """
    narrow_batches(df.sparkSession)
    text, place = text if isinstance(text, tuple) else (text, None)
    new = {f.name.lower() for f in fields}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in names] + list(fields))
    wanted = list(dict.fromkeys([*names, text]))
    types = [_arrow_type(f.dataType) for f in fields]
    out_names = names + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            source = batch.column(wanted.index(text))
            made = score(text_bytes(source if place is None else source.field(place)))
            arrays = [batch.column(wanted.index(n)) for n in names]
            arrays += [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=out_names)
        give_back()

    return df.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    plain = {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.BooleanType: pa.bool_(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return plain[type(kind)]
