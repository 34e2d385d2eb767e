"""Helpers shared by the corpus operators: tables, scratch storage, expressions."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the whitespace word rule: space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A small side may be broadcast when it has at most this many narrow rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a plain local master
    (tests) may go without: it gets a fresh temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return qualified(spark, found.rstrip("/"))
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, so that readers outside Spark take the same one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString()
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file://") else out


class Scratch:
    """Tables written to the shared folder; reading one back cuts the lineage.

    A lost executor costs only the tasks it held: the written tables stay. Results
    read them lazily, so they are deleted when the driver ends, or by ``drop_all``.
    """

    _roots: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[str] = []
        Scratch._roots.append((spark, self.root))

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` as Parquet and return the written table."""
        path = self.path(label)
        schema = df.schema
        self._paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)

    def drop_but(self, *dfs: DataFrame) -> None:
        """Delete all tables but those given."""
        stay = {getattr(df, "_scratch_path", None) for df in dfs}
        for path in self._paths:
            if path not in stay:
                _delete(self.spark, path)
        self._paths = [p for p in self._paths if p in stay]


def repeatable(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` if a second run over it deals the same rows to the same tasks in the same order, else a written copy."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    leaves = ("FileScan", "LocalTableScan")
    fixed = any(x in plan for x in leaves) and not any(x in plan for x in ("Exchange", "Join", "Aggregate", "Window", "rand(", "uuid("))
    return df if fixed else scratch.keep(df, "rows")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@atexit.register
def drop_all() -> None:
    """Deletes all tables written so far; results that still read them are lost."""
    while Scratch._roots:
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(*Scratch._roots.pop())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settle(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row and not inlined further up.

    A one-element explode keeps the optimizer from copying a costly expression
    into each place that uses it.
    """
    for name, expr in cols.items():
        df = df.select("*", F.explode(F.array(expr)).alias(name))
    return df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
