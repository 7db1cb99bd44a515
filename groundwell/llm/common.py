"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.session import ship_package
from groundwell.settings import shared_folder

#: Bytes of text that a Python task takes up at once; one longer text is taken alone. Words
#: and their hashes take some thirty times that.
PIECE_BYTES = 1 << 20

#: Fixed value: a word is a run of anything but a space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: computed once, lineage cut.

    ``checkpoint()`` keeps the rows where every executor can read them again, so that a lost
    executor costs nothing that was done before.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables written to the shared folder that an operator needs for a while.

    As Parquet they take less room than checkpoints. ``drop`` removes them once what was made
    from them has been saved itself.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.tables = 0

    def save(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ready(spark: SparkSession) -> None:
    """Make the package importable in Python workers and the shared folder known."""
    ship_package(spark)
    shared_folder(spark)


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 text, as ``WORD`` has them."""
    return text.split()


def pieces(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has about ``limit`` bytes of text, or one row."""
    for batch in batches:
        texts, start, held = batch.column(column), 0, 0
        sizes = pc.binary_length(texts).to_pylist()
        for row, size in enumerate(sizes):
            if row > start and held + (size or 0) > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size or 0
        if batch.num_rows > start:
            yield batch.slice(start)
        # Workers are used again and would keep the room of their largest batch.
        pa.default_memory_pool().release_unused()


def utf8_list(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, empty for null."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [b"" if x is None else x for x in texts.cast(kind).to_pylist()]


def n_words(text: Column | str) -> Column:
    """The number of words of a text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
