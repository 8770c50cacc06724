"""What the operators of this package have in common: the shared folder, stored tables and document batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_ALL: list[str] = []
_STORED: ContextVar[list[str]] = ContextVar("stored", default=_ALL)  # of the innermost `temporary` of this thread
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one of our own where it is unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.gettempdir() + "/sigilframe-" + uuid.uuid4().hex[:12])
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _STORED.get().append(path)
    return path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables stored by this process outside of `temporary`; only when no result that reads them is still wanted."""
    while _ALL:
        delete(spark, _ALL.pop())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside, by this thread, are deleted at the end; what is read from them must be written by then."""
    own: list[str] = []
    token = _STORED.set(own)
    try:
        yield
    finally:
        _STORED.reset(token)
        for path in own:
            delete(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts_for(spark: SparkSession, amount: int, each: int) -> int:
    """Partitions so that each gets about `each` of `amount`, and no fewer than there are cores for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that df has no column of, each close to the one wanted."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def fields(df: DataFrame, columns: list[str], ddl: str = "") -> StructType:
    """The types of some columns of df, and further fields."""
    return StructType([df.schema[c] for c in columns] + (StructType.fromDDL(ddl).fields if ddl else []))


def map_rows(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[dict], dict]], rows: int = 256, carry: tuple[str, ...] | list[str] = (), read: tuple[str, ...] = ()) -> DataFrame:
    """Applies a batch function in Arrow: make() runs once a task and returns a function from a dict of column lists
    (of at most `rows` rows) to a dict of column lists. Small slices bound the memory that long texts take. Columns
    in `carry` pass by the function and stay as they are; those in `read` are given to it besides."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, carry = to_arrow_schema(schema), list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                names = part.schema.names
                out = f({n: part.column(k).to_pylist() for k, n in enumerate(names) if n not in carry or n in read})
                cols = [part.column(names.index(x.name)) if x.name in carry else pa.array(out[x.name], type=x.type) for x in arrow]
                yield pa.RecordBatch.from_arrays(cols, names=arrow.names)

    return df.mapInArrow(run, schema)


def crc(column) -> F.Column:
    """crc32 of a value's text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
