"""Tables as folders of Parquet files or in the catalogue: reading what may be absent, appending, and replacing by key."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import replace_keys


def exists(spark: SparkSession, name: str) -> bool:
    """Whether the catalogue has the table."""
    return spark.catalog.tableExists(name)


def read(spark: SparkSession, name: str, schema: StructType | str) -> DataFrame:
    """The table of the catalogue, or an empty one of the schema where it is absent."""
    return spark.table(name) if exists(spark, name) else spark.createDataFrame([], schema)


def read_path(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A folder's rows, or none of the schema where it is absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def append(rows: DataFrame, name: str) -> None:
    rows.write.mode("append").saveAsTable(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as the session names it; on one machine without such a name, one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skeinflow-checkpoint-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared folder: later plans read them and don't make them again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@dataclass(frozen=True)
class KeyedTable:
    """A table of unique keys that is replaced by key, bucket by bucket, and never lost.

    Rows lie in buckets of their keys' hash. A run writes the new state of the buckets that it touches into a folder of its own, and then one small
    file, the list of all buckets' folders, under the next number. Readers take the list of the highest number, so they see a run whole or not at all; a
    run that dies at any step leaves the table as it was, and what it left behind is never read. Keys match null-safely. One
    writer at a time: of two that start from one state the second fails.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _listed(self) -> tuple[int, dict[int, str]]:
        """The number of the current state, 0 before the first, and the folder of each bucket."""
        lists = read_path(self.spark, f"{self.path}/lists", "bucket int, folder string, n int")
        last = lists.agg(F.max("n")).first()[0] or 0
        return last, {r["bucket"]: r["folder"] for r in lists.where(F.col("n") == last).collect()}

    def _read(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/rows/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The current rows. They stay readable while later runs write."""
        return self._read(self._listed()[1])

    def upsert(self, rows: DataFrame) -> int:
        """Rows take the place of those with their keys, of repeated keys any one; gives the number of the new state. Only touched buckets are read and written."""
        last, folders = self._listed()
        columns = self.spark.createDataFrame([], self.schema).columns
        new = kept(rows.select(*columns).dropDuplicates(list(self.keys)))
        touched = [r[0] for r in new.select(self._bucket()).distinct().collect()]
        if not touched:
            return last
        before = self._read({b: folders[b] for b in touched if b in folders})
        folder = uuid.uuid4().hex
        after = replace_keys(before, new, self.keys).withColumn("bucket", self._bucket())
        after.repartition("bucket", *self.keys).write.partitionBy("bucket").parquet(f"{self.path}/rows/{folder}")
        listed = folders | dict.fromkeys(touched, folder)
        one_file = self.spark.createDataFrame(sorted(listed.items()), "bucket int, folder string").coalesce(1)
        one_file.write.mode("error").parquet(f"{self.path}/lists/n={last + 1}")
        return last + 1
