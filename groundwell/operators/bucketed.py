"""An index whose base and changes lie in the same buckets of the id.

:class:`groundwell.operators.index.Collection` broadcasts the list of changed ids while it is
small, and shuffles vectors where it is not. Here both tables are bucketed by ``chunk_id``, so that
a read, however many ids changed, joins bucket with bucket: only arriving changes are shuffled,
once, when they are written. Results are those of the plain collection.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators.index import (
    POINT_COLUMNS,
    POINT_SCHEMA,
    check_dimension,
    last_of,
)

_COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POINT_SCHEMA.fields)


@dataclass(frozen=True)
class BucketedIndex:
    """Points below ``root``: ``base`` with unique ids, ``changes`` by batch.

    The tables are external ones of the session's catalog, named after their folder, so that
    another session finds them again by :meth:`open` with the same number of buckets.
    """

    spark: SparkSession
    root: str
    dimension: int
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, root: str, dimension: int, buckets: int) -> BucketedIndex:
        """Create the tables if they are absent. Choose ``buckets`` so that one of them, with its
        vectors, fits a task; all readers and writers of an index need the same number."""
        if buckets < 1:
            raise ValueError("an index has at least one bucket")
        opened = cls(spark, root, dimension, buckets)
        for part in ("base", "changes"):
            path = spark._jvm.org.apache.hadoop.fs.Path(opened.folder(part))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        packed = "options (compression = 'zstd')"
        clustered = f"clustered by (chunk_id) sorted by (chunk_id) into {buckets} buckets"
        spark.sql(
            f"create table if not exists {opened.name('base')} ({_COLUMNS}) using parquet {packed} "
            f"{clustered} location '{opened.folder('base')}'"
        )
        spark.sql(
            f"create table if not exists {opened.name('changes')} "
            f"({_COLUMNS}, deleted int, batch bigint) using parquet {packed} partitioned by (batch) "
            f"{clustered} location '{opened.folder('changes')}'"
        )
        spark.catalog.recoverPartitions(opened.name("changes"))
        return opened

    def name(self, part: str) -> str:
        return f"points_{hashlib.sha1(self.root.encode()).hexdigest()[:16]}_{part}"

    def folder(self, part: str) -> str:
        return f"{self.root}/{part}"

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for part in ("base", "changes"):
            self.spark.sql(f"drop table if exists {self.name(part)}")

    def load(self, points: DataFrame, placed: bool = False) -> None:
        """Fill the base with points whose ids are unique, in place of what it held. ``placed``
        tells that they lie by bucket already, and saves the shuffle."""
        rows = check_dimension(points, self.dimension).select(*POINT_COLUMNS)
        rows = rows if placed else rows.repartition(self.buckets, "chunk_id")
        rows.write.insertInto(self.name("base"), overwrite=True)

    def write_batch(
        self, batch: int, points: DataFrame, order: str | None = None, unique: bool = False
    ) -> None:
        """Store upserts as batch ``batch``; later batches win. ``order`` and ``unique`` are
        those of :meth:`groundwell.operators.index.Collection.write_batch`."""
        last = points if unique else last_of(points, "chunk_id", order)
        self._write(
            batch,
            check_dimension(last, self.dimension).select(*POINT_COLUMNS, F.lit(0).alias("deleted")),
        )

    def delete_batch(self, batch: int, ids: DataFrame) -> None:
        """Store deletions of the ids in ``ids.chunk_id`` as batch ``batch``."""
        empty = (F.lit(None).cast(f.dataType).alias(f.name) for f in POINT_SCHEMA.fields[1:])
        gone = ids.select("chunk_id").distinct()
        self._write(batch, gone.select("chunk_id", *empty, F.lit(1).alias("deleted")))

    def points(self) -> DataFrame:
        """Current points. Neither base nor changes are shuffled.

        The newest change of an id is told from ids and batch numbers; both joins are merges of
        buckets that lie side by side. A null id is no point.
        """
        base = self.spark.table(self.name("base"))
        changes = self.spark.table(self.name("changes"))
        last = changes.groupBy("chunk_id").agg(F.max("batch").alias("last")).hint("merge")
        live = (
            changes.join(last, "chunk_id")
            # Not an equality, which would become a part of the join key and shuffle both sides.
            .where((F.col("batch") >= F.col("last")) & (F.col("deleted") == 0))
            .select(*POINT_COLUMNS)
        )
        kept = base.join(last.select("chunk_id").hint("merge"), "chunk_id", "left_anti")
        return kept.select(*POINT_COLUMNS).unionByName(live)

    def compact(self, root: str) -> BucketedIndex:
        """Write the current points as the base of a new index at ``root``."""
        if root == self.root:
            raise ValueError("compact into a new folder")
        compacted = BucketedIndex.open(self.spark, root, self.dimension, self.buckets)
        compacted.load(self.points(), placed=True)
        return compacted

    def _write(self, batch: int, changes: DataFrame) -> None:
        """One batch as a partition of its own, so that a replayed batch replaces itself."""
        rows = changes.where("chunk_id is not null").repartition(self.buckets, "chunk_id")
        view = f"{self.name('changes')}_batch_{int(batch)}"
        rows.createOrReplaceTempView(view)
        try:
            self.spark.sql(
                f"insert overwrite table {self.name('changes')} partition (batch = {int(batch)}) "
                f"select {', '.join(POINT_COLUMNS)}, deleted from {view}"
            )
        finally:
            self.spark.catalog.dropTempView(view)
