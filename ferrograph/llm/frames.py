"""What the operators share: free column names, text kernels as columns, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferrograph.llm import grams


def free(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores after it while some column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ferrograph-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there, and a lost executor takes nothing with it."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Sieve:
    """A bitmap of fixed size (4 MB) of the upper bits of 64-bit hashes: says of each hash whether it may be among some, and never no to one that is.

    It saves shuffling rows that have no partner in a join; the join decides. The more hashes there are the more rows pass.
    """

    BITS = 25

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, hashes: DataFrame, name: str) -> Sieve:
        place = F.shiftrightunsigned(F.col(name), 64 - cls.BITS)
        bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
        found = hashes.select(place.alias("place")).groupBy((F.shiftright("place", 6)).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        words = np.zeros(1 << (cls.BITS - 6), np.int64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        return cls(words.view(np.uint64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes.astype(np.uint64) >> np.uint64(64 - self.BITS)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0

    def may_have(self, hashes: Column) -> Column:
        import pandas as pd

        def test(h: pd.Series) -> pd.Series:
            return pd.Series(self.has(h.to_numpy(np.int64)))

        test.__annotations__ = {"h": pd.Series, "return": pd.Series}
        return F.pandas_udf(test, "boolean")(hashes)


def without(docs: DataFrame, lost: DataFrame, column: str, name: str) -> DataFrame:
    """``docs`` without the rows whose ``column`` is among ``name`` of lost. Only rows of which a sieve can't tell that they stay are shuffled."""
    lost = staged(lost, "lost")
    maybe = Sieve.of(lost.select(F.xxhash64(name).alias("h")), "h").may_have(F.xxhash64(column))
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(lost, F.col(column) == F.col(name), "left_anti"))


Kernel = Callable[[np.ndarray, np.ndarray], Sequence]


def batch_kernel(batch: pa.RecordBatch, text: str, kernel: Kernel, types: Sequence[pa.DataType]) -> list[pa.ChunkedArray]:
    """The kernel's columns for all rows of a batch."""
    parts: list[list[pa.Array]] = [[] for _ in types]
    for _, _, data, off in grams.chunks(batch.column(text)):
        for part, values, kind in zip(parts, kernel(data, off), types, strict=True):
            part.append(values if isinstance(values, pa.Array) else pa.array(values, kind))
    return [pa.chunked_array(part, kind) for part, kind in zip(parts, types, strict=True)]


def text_columns(df: DataFrame, text: str, fields: Sequence[tuple[str, T.DataType]], kernel: Callable[[], Kernel] | Kernel, keep: str | None = None, only: Sequence[str] | None = None, drop: bool = False) -> DataFrame:
    """``df`` (or its columns ``only``) with the columns that ``kernel`` computes from whole texts, in one pass and without a shuffle.

    keep: a Boolean one of these; rows without it go. drop: none of the new columns is returned.
    """
    new = T.StructType([T.StructField(n, t) for n, t in fields])
    base = [f for f in df.schema.fields if only is None or f.name in only]
    schema = T.StructType(base + ([] if drop else new.fields))
    arrow, added = to_arrow_schema(schema), to_arrow_schema(new)
    kinds, names = [f.type for f in added], [f.name for f in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = batch_kernel(batch, text, kernel, kinds)
            out = [batch.column(n) for n in names] + ([] if drop else columns)
            table = pa.Table.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(out, arrow, strict=True)], schema=arrow)
            if keep is not None:
                table = table.filter(columns[added.get_field_index(keep)])
            yield from table.combine_chunks().to_batches()

    source = df if only is None else df.select(*dict.fromkeys([*names, text]))
    return source.mapInArrow(run, schema)
