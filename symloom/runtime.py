"""Session helpers: table access, the shared working folder and written intermediate tables.

Intermediate results that are read more than once, or whose lineage must be cut, are written as
parquet under the folder the cluster names in ``spark.checkpoint.dir``; every executor can read
them again after another executor is lost.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def session(app: str = "symloom", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="symloom-")
    return "file://" + _local_dirs[sc.applicationId]


class Files:
    """Hadoop file system calls for small control files (commit markers, pointers)."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._root = spark._jvm, root
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def age_s(self, path: str) -> float:
        """Seconds since the newest change of a folder or of what lies in it."""
        here = self._path(path)
        newest = max(s.getModificationTime() for s in [self._fs.getFileStatus(here), *self._fs.listStatus(here)])
        return time.time() - newest / 1000

    def children(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def write_text(self, path: str, text: str) -> None:
        """A new file that appears whole: written elsewhere, then renamed. Never replaces one."""
        tmp = f"{self._root}/_tmp/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(tmp), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path(path).getParent())
        if not self._fs.rename(self._path(tmp), self._path(path)):
            raise OSError(f"cannot publish {path}")

    def publish(self, made: str, path: str) -> None:
        """Move a written folder to its place, unless another one has come there first."""
        self._fs.mkdirs(self._path(path).getParent())
        if self.exists(path) or not self._fs.rename(self._path(made), self._path(path)):
            self.delete(made)

    def create_text(self, path: str, text: str) -> None:
        """A new file under a name that one caller alone can take: whoever finds it taken gets an error.

        An empty one was left by a writer that died between the two steps; it gives way.
        """
        if self.exists(path) and not self.read_text(path):
            self.delete(path)
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


_made: list[Scratch] = []


def _drop_scratch() -> None:
    """Drop the folders of this process at its end: until then a lazy result may read them."""
    for s in _made:
        try:
            s.drop(s.root)
        except Exception:  # noqa: BLE001  the session may be gone already; sweep() takes what is left
            return


def sweep(spark: SparkSession, hours: int = 48) -> list[str]:
    """Drop scratch folders that processes which died left behind: those untouched for ``hours``."""
    root = f"{shared_dir(spark)}/symloom"
    files = Files(spark, root)
    old = [c for c in files.children(root) if c not in ("published", "_tmp") and files.age_s(f"{root}/{c}") > 3_600 * hours]
    for c in old:
        files.delete(f"{root}/{c}")
    return old


class Scratch:
    """Written intermediate tables of one query, in one folder below the shared one, dropped as the process ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/symloom/{label}-{uuid.uuid4().hex}"
        self.files = Files(spark, self.root)
        self._n = 0
        if not _made:
            atexit.register(_drop_scratch)
        _made.append(self)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the table read back: lineage ends at the files."""
        return self.read(self.path(df, name), df)

    def save_by(self, df: DataFrame, by: str, name: str = "t") -> DataFrame:
        """As :meth:`save`, one folder for each value of ``by``: a later filter on it reads only those."""
        return self.read(self.path_by(df, by, name), df)

    def path_by(self, df: DataFrame, by: str, name: str = "t") -> str:
        self._n += 1
        where = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").partitionBy(by).parquet(where)
        return where

    def path(self, df: DataFrame, name: str = "t") -> str:
        self._n += 1
        where = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(where)
        return where

    def read(self, paths: str | list[str], like: DataFrame) -> DataFrame:
        paths = [paths] if isinstance(paths, str) else paths
        return self.spark.read.schema(like.schema).parquet(*paths)

    def drop(self, path: str) -> None:
        self.files.delete(path)


def numbered(df: DataFrame, name: str, scratch: Scratch, *order: Column) -> DataFrame:
    """``df`` with its place from 1 in a total order: sorted by ranges and written, counted within each range."""
    ranges = scratch.save(df.orderBy(*order).withColumn("__part", F.spark_partition_id()), "sorted")
    sizes = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = ranges.withColumn("__at", within).join(sizes.select("__part", before.alias("__before")), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def input_mark(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """A mark of the state of tables: paths, lengths and times of their files."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = []
    for name in sorted(names):
        todo = [spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")]
        while todo:
            for f in fs.listStatus(todo.pop()):
                if f.isDirectory():
                    todo.append(f.getPath())
                seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def published(spark: SparkSession, name: str, mark: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from inputs in the state ``mark``: built and written once, then read by all.

    It lies in the shared folder under its name and mark, so other inputs never meet it, and appears whole by
    a rename; of two builders at once the later one's copy is dropped.
    """
    root = f"{shared_dir(spark)}/symloom/published"
    files, where = Files(spark, root), f"{root}/{name}-{mark}"
    if not files.exists(f"{where}/_SUCCESS"):
        part = f"{root}/_tmp/{uuid.uuid4().hex}"
        build().write.mode("overwrite").parquet(part)
        files.publish(part, where)
    return spark.read.parquet(where)


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for the cores before a stage of Python work: a small table is dealt out evenly.

    Small files come as few pieces however many cores there are. Goes by the size the plan states, so nothing
    runs here; a table that fills a split for every core stays where it is and is not shuffled. Rows are the same.
    """
    spark = df.sparkSession
    stated = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if stated < cores * split else df


def id_or_null(c: Column) -> Column:
    """Ids of 0 mean "no reference"."""
    return F.when(c != 0, c)
