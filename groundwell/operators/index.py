"""The chunk index as a table of points: ``chunk_id, vector, chunk_text, metadata``.

In memory, points are merged as DataFrames (:func:`upsert`, :func:`insert`, :func:`delete`).
On disk, an index is a folder with an optional compacted ``base`` and change batches beside
it. An id occurs once in a batch, so that readers find the newest change from ids and batch
numbers alone; vectors and texts are not ranked. The text is a column of its own, which
searches by vector and metadata do not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)
from pyspark.sql.window import Window

from groundwell.functions.vectors import norm
from groundwell.operators.sizes import broadcast_if_small

POINT_SCHEMA = StructType(
    [
        StructField("chunk_id", StringType()),
        StructField("vector", ArrayType(FloatType())),
        StructField("chunk_text", StringType()),
        StructField("metadata", MapType(StringType(), StringType())),
    ]
)
POINT_COLUMNS = POINT_SCHEMA.fieldNames()
_CHANGE_SCHEMA = StructType(
    [*POINT_SCHEMA.fields, StructField("deleted", IntegerType()), StructField("batch", LongType())]
)


def last_of(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (null is least).

    A group limit runs before the shuffle, so copies of a hot key do not travel. Two rows of a
    key with the same ``order``, or any two without one, fail the job: which is later cannot
    be told.
    """
    place = F.lit(0) if order is None else F.col(order)
    ranks = Window.partitionBy(key).orderBy(place.desc())
    top = rows.withColumn("__rank", F.rank().over(ranks)).where(F.col("__rank") == 1)
    same = top.withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy(key)))
    message = F.concat(F.lit(f"no order tells the last row of {key} "), F.col(key).cast("string"))
    return same.where(
        F.when(F.col("__same") == 1, F.lit(True)).otherwise(
            F.raise_error(message).cast("boolean")
        )
    ).drop("__rank", "__same")


def upsert(
    points: DataFrame, changes: DataFrame, key: str = "chunk_id", order: str | None = None
) -> DataFrame:
    """Insert or replace by id; the whole row is replaced and an id then occurs once.

    ``order`` is a column of ``changes`` (and not of ``points``) that tells which of two
    changes of one batch is later; where it cannot tell, the job fails. Points of a document
    that now has fewer chunks stay, as only given ids are touched.
    """
    ids = broadcast_if_small(changes.select(key).distinct())
    last = last_of(changes, key, order)
    last = last if order is None else last.drop(order)
    return points.join(ids, key, "left_anti").unionByName(last)


def insert(points: DataFrame, rows: DataFrame) -> DataFrame:
    """Append without replacing: an id may then occur more than once."""
    return points.unionByName(rows)


def delete(points: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Remove by id. Unknown ids are no error."""
    return points.join(broadcast_if_small(ids.select(key).distinct()), key, "left_anti")


def count(points: DataFrame) -> DataFrame:
    """One row with the number of points."""
    return points.agg(F.count(F.lit(1)).alias("n_points"))


def audit(
    points: DataFrame, dimension: int, key: str = "chunk_id", vector: str = "vector",
    text: str = "chunk_text", tolerance: float = 1e-3,
) -> DataFrame:
    """One row of health figures: rows, ids, vectors of another width or not of length one,
    rows without text.

    Rows are counted per id first, so a hot id is folded before the shuffle.
    """
    checks = {
        "n_wrong_width": F.coalesce(F.size(vector), F.lit(-1)) != dimension,
        "n_not_unit": F.coalesce(F.abs(norm(F.col(vector)) - 1) > tolerance, F.lit(True)),
        "n_without_text": F.coalesce(text, F.lit("")) == "",
    }
    per_id = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_points"),
        *[F.count_if(check).alias(name) for name, check in checks.items()],
    )
    return per_id.agg(
        F.coalesce(F.sum("n_points"), F.lit(0)).alias("n_points"),
        F.count(F.lit(1)).alias("n_ids"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in checks],
    )


def check_dimension(points: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """The same rows, but the job fails at the first vector of another width."""
    width = F.coalesce(F.size(vector), F.lit(-1))
    message = F.concat(F.lit(f"vector width is not {dimension}: "), width.cast("string"))
    return points.withColumn(
        vector,
        F.when(width == dimension, F.col(vector)).otherwise(
            F.raise_error(message).cast("array<float>")
        ),
    )


@dataclass(frozen=True)
class Collection:
    """A stored index: where it lies and how wide its vectors are.

    ``root/about`` holds its description, ``root/base`` points with unique ids,
    ``root/changes/batch=N`` the changes since. A batch is written as a whole under its own
    number, so a replayed batch replaces itself.
    """

    spark: SparkSession
    root: str
    dimension: int

    @classmethod
    def create(cls, spark: SparkSession, root: str, dimension: int) -> Collection:
        """Create if absent. An existing collection is left alone, but its width must agree."""
        about = f"{root}/about"
        if not _has_data(spark, about):
            spark.createDataFrame(
                [(dimension, "cosine")], "dimension INT, metric STRING"
            ).coalesce(1).write.mode("errorifexists").parquet(about)
        return cls.open(spark, root, dimension)

    @classmethod
    def open(cls, spark: SparkSession, root: str, dimension: int | None = None) -> Collection:
        stored = spark.read.parquet(f"{root}/about").first()["dimension"]
        if dimension is not None and stored != dimension:
            raise ValueError(f"collection {root} has width {stored}, not {dimension}")
        return cls(spark, root, stored)

    def write_batch(
        self, batch: int, points: DataFrame, order: str | None = None, unique: bool = False
    ) -> None:
        """Store upserts as batch ``batch``; later batches win over earlier ones.

        ``order`` is a column that tells the last of two points with one id; without it, or
        where it ties, such points fail the job. ``unique`` vouches that there are none, and
        saves the shuffle that finds out.
        """
        last = points if unique else last_of(points, "chunk_id", order)
        self._write(
            batch,
            check_dimension(last, self.dimension).select(
                *POINT_COLUMNS, F.lit(0).alias("deleted")
            ),
        )

    def load(self, points: DataFrame) -> None:
        """Fill an empty collection with points whose ids are unique.

        They become the base, which readers take as it is: no batch has to be ranked.
        """
        for part in ("base", "changes"):
            if _has_data(self.spark, f"{self.root}/{part}"):
                raise ValueError(f"collection {self.root} is not empty")
        check_dimension(points, self.dimension).select(*POINT_COLUMNS).write.parquet(
            f"{self.root}/base"
        )

    def delete_batch(self, batch: int, ids: DataFrame) -> None:
        """Store deletions of the ids in ``ids.chunk_id`` as batch ``batch``."""
        gone = ids.select("chunk_id").distinct().select(
            "chunk_id",
            *(
                F.lit(None).cast(field.dataType).alias(field.name)
                for field in POINT_SCHEMA.fields[1:]
            ),
            F.lit(1).alias("deleted"),
        )
        self._write(batch, gone)

    def points(self) -> DataFrame:
        """Current points.

        Ids and batch numbers tell what is out of date: changes of an id that a later batch
        changes again, and base points of any changed id. These lists are broadcast while
        they are small, and then neither vectors nor texts are shuffled.
        """
        base = (
            self.spark.read.schema(POINT_SCHEMA).parquet(f"{self.root}/base")
            if _has_data(self.spark, f"{self.root}/base")
            else None
        )
        if not _has_data(self.spark, f"{self.root}/changes"):
            return base if base is not None else self.spark.createDataFrame([], POINT_SCHEMA)
        changes = self.spark.read.schema(_CHANGE_SCHEMA).parquet(f"{self.root}/changes")
        again = (
            changes.groupBy("chunk_id")
            .agg(F.max("batch").alias("last"), F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .drop("n")
        )
        live = (
            changes.where("deleted = 0")
            .join(broadcast_if_small(again), "chunk_id", "left")
            .where("last is null or batch = last")
            .select(*POINT_COLUMNS)
        )
        if base is None:
            return live
        ids = broadcast_if_small(changes.select("chunk_id").distinct())
        return base.join(ids, "chunk_id", "left_anti").unionByName(live)

    def compact(self, root: str) -> Collection:
        """Write the current points as the base of a new collection at ``root``.

        Never in place: a folder that is being read must not be overwritten.
        """
        if root == self.root:
            raise ValueError("compact into a new folder")
        compacted = Collection.create(self.spark, root, self.dimension)
        self.points().write.mode("overwrite").parquet(f"{root}/base")
        return compacted

    def _write(self, batch: int, changes: DataFrame) -> None:
        changes.write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch}")


def _has_data(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
