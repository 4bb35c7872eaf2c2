"""The star as staged Parquet tables.

Each star table is derived from the order tables once per state of the source and written to a
folder that the cluster shares, so queries scan typed columnar files with pruning and pushdown
instead of repeating the derivation, and a lost executor re-reads files.  The folder's name holds
the source and its version and no application: a later application finds the tables and stages
nothing.  A table counts as staged once its writer has left a success marker.

Order lines are stored once, narrow, without what is worked out from them.  Jobs that read every
fact once, to check or to copy it, take the facts ``lazily``: one that nobody has stored is
derived from the lines as it is read, and not stored for that.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import pathlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starling.plans import star

_stars: dict[tuple, "Star"] = {}
_versions: dict[tuple, str] = {}
_lock = threading.RLock()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for what its executors share; without one an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir, or pass one")
    return folder


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path on any Hadoop file system."""
    p, fs = _file_system(spark, path)
    return fs.getContentSummary(p).getLength()


DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries run inside drop their shuffle files as they end, not when the driver collects garbage.

    For writes that run once: a frame that is run again shuffles again.
    """
    before = spark.conf.get(DROPS_SHUFFLES, None)
    spark.conf.set(DROPS_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROPS_SHUFFLES) if before is None else spark.conf.set(DROPS_SHUFFLES, before)


def lazily(tables):
    """A star's facts as ``Star.lazily`` gives them; any other set of tables as it is."""
    return tables.lazily() if isinstance(tables, Star) else tables


def source_version(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the names, sizes and times of the source files, taken once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _versions:
        seen = []
        for name in star.SOURCES:
            p, fs = _file_system(spark, f"{sf_dir}/{name}.parquet")
            files = fs.listFiles(p, True)
            while files.hasNext():
                f = files.next()
                seen.append((name, f.getPath().getName(), f.getLen(), f.getModificationTime()))
        _versions[key] = hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:16]
    return _versions[key]


@functools.cache
def code_version() -> str:
    """Digest of this library's sources: tables that another state of the code derived are not taken up."""
    files = sorted(pathlib.Path(__file__).resolve().parents[1].rglob("*.py"))
    return hashlib.sha256(b"".join(f.read_bytes() for f in files if "llm" not in f.parts)).hexdigest()[:16]


class Star:
    """Attribute access to star tables: ``Star.of(spark, sf_dir).store_sales``.

    ``by_day`` lays each fact out in a directory per day, for date filters on facts too large for
    file statistics alone; a rebalance splits a hot day over several files.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str, by_day: bool = False, stores: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.folder = folder
        self.by_day = by_day
        self.stores = stores
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, folder: str | None = None, version: str | None = None,
           by_day: bool = False) -> "Star":
        """The star of a data folder, staged below ``folder`` (the session's shared one).

        ``version`` names the state of the source; without it the state is read off the source
        files once per application.  Another version gives another star.
        """
        folder = folder or shared_folder(spark)
        version = version or source_version(spark, sf_dir)
        name = hashlib.sha256(repr((sf_dir, version, code_version(), by_day)).encode()).hexdigest()[:16]
        key = (f"{folder}/star-{name}", spark.sparkContext.applicationId, spark._jsparkSession.hashCode())
        with _lock:
            if key not in _stars:
                _stars[key] = cls(spark, sf_dir, key[0], by_day)
            return _stars[key]

    def in_session(self, spark: SparkSession) -> "Star":
        """The same star, its tables read by another session of the application."""
        return Star(spark, self.sf_dir, self.folder, self.by_day, self.stores)

    def lazily(self) -> "Star":
        """The same star for jobs that read every fact once: one that is not stored is derived as it is read."""
        return Star(self.spark, self.sf_dir, self.folder, self.by_day, False)

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derive(self, table: str) -> DataFrame:
        """The table as a lazy plan over the order tables."""
        sql = star.spark_sql(table)
        inputs = {f"src_{s}": self.source(s) for s in star.SOURCES if f"{{src_{s}}}" in sql}
        inputs |= {x: self._table(x) for x in ("lines", *star.KEPT) if f"{{{x}}}" in sql}
        return self.spark.sql(sql, **inputs)

    def _table(self, table: str) -> DataFrame:
        with _lock:
            if table not in self._tables:
                derived = table == "lines" or not self.stores and table in star.FROM_LINES and not self.staged(table)
                self._tables[table] = self.derive(table) if derived else self.spark.read.parquet(
                    self.once(table, lambda path: self._write(table, path)))
            return self._tables[table]

    def _write(self, table: str, path: str) -> None:
        df, day = self.derive(table), star.FACT_DATE.get(table)
        with shuffles_dropped(self.spark):
            if self.by_day and day:
                df.hint("rebalance", day).write.partitionBy(day).parquet(path)
            else:
                df.write.parquet(path)

    def staged(self, name: str) -> bool:
        """Whether a table or by-product is complete."""
        p, fs = _file_system(self.spark, f"{self.folder}/{name}/_DONE")
        return fs.exists(p)

    def once(self, name: str, write: Callable[[str], None]) -> str:
        """Path of a table or by-product in the star's folder, written by whoever needs it first.

        A writer works on a path of its own and moves the finished files into place, so a failed
        or concurrent writer never leaves half a table under the name.
        """
        path = f"{self.folder}/{name}"
        with _lock:
            if not self.staged(name):
                own = f"{path}.{uuid.uuid4().hex}"
                write(own)
                source, fs = _file_system(self.spark, own)
                target = _file_system(self.spark, path)[0]
                fs.mkdirs(source)
                fs.create(_file_system(self.spark, f"{own}/_DONE")[0]).close()
                if not self.staged(name):
                    fs.delete(target, True)  # what an interrupted writer left
                    fs.rename(source, target)
                else:  # another application was faster
                    fs.delete(source, True)
        return path

    def stored_bytes(self, table: str) -> int:
        """Bytes of a table's files, which are written first if nobody has read the table yet."""
        return stored_bytes(self.spark, self.once(table, lambda path: self._write(table, path)))

    def remove(self) -> None:
        """Deletes the star's folder; the next use stages again."""
        with _lock:
            p, fs = _file_system(self.spark, self.folder)
            fs.delete(p, True)
            self._tables.clear()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in star.TABLES:
            raise AttributeError(name)
        return self._table(name)

    def __getitem__(self, name: str) -> DataFrame:
        return self._table(name)
