"""Pieces that several operators share: tables, shared storage and word patterns."""

from __future__ import annotations

import contextlib
import contextvars
import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java pattern class, and what words are made of.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or in a local session one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spandrel-")
        spark.sparkContext.setCheckpointDir(own)
    return own


#: Paths of the tables written in this context while a caller keeps a list of them.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    files = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        at = files.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more, before its context ends."""
    for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
        _delete(table.sparkSession, [path])


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written in this context are deleted at its end, also if it fails: for work whose result doesn't read them."""
    made: list[str] = []
    mark = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(mark)
        _delete(spark, made)


def settled(spark: SparkSession, name: str, make) -> DataFrame:
    """What make() returns, stored. The tables that were written on the way are deleted, as nothing reads them any more."""
    with scratch(spark) as made:
        out = stored(make(), name)
        kept = made.pop()
    if (outer := _made.get()) is not None:
        outer.append(kept)
    return out


class Shared:
    """A broadcast object of this package's own classes: its code travels with it, so executors need no copy of the package."""

    def __init__(self, spark: SparkSession, value):
        self.raw, self.kept = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"raw": self.raw, "kept": None}

    @property
    def value(self):
        if self.kept is None:
            self.kept = pickle.loads(self.raw.value)
        return self.kept


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
