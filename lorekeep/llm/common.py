"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import BROADCAST_ROWS, small_side, use_checkpoints
from ..operators.lineage import settle as cut

__all__ = ["BROADCAST_ROWS", "crc_mod", "cut", "dealt_anew", "drawn", "map_texts", "shared_folder", "small_side", "spread", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fixed folds."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share."""
    use_checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def drawn(key: Column, salt: str, wanted: int, rows: int) -> Column:
    """About twice the wanted number of so many rows, by the hash of their key: what a bounded sample is taken from.

    Without it every task would send its own best `wanted` rows to the driver.
    """
    share = 2.0 * wanted / max(rows, 1)
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(2**32)) < int(share * 2**32)


def dealt_anew(col: Column) -> Column:
    """The same value as an expression of its own, so that a join deals an aggregate's rows again.

    Without that both sides keep the aggregate's partitioning and Spark can't split the other side's hot keys.
    """
    return F.greatest(col, col)


def spread(docs: DataFrame) -> DataFrame:
    """Rows of a table in a few splits, dealt to all cores before costly work on each; any other table stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() * 2 <= cores else docs


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of schema for each row, from Arrow batches of whole texts; null texts count as empty.

    make() runs once a task and returns the function of a batch. Rows are independent, so nothing is shuffled and a
    lost executor repeats its own batches only.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    target = docs.sparkSession.createDataFrame([], f"doc_id long, {schema}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, function = to_arrow_schema(target), make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = function(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(made[n], type=arrow.field(n).type) for n in names)], schema=arrow)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))).mapInArrow(run, target)
