"""Lines of text files, packed or not, told by their first bytes.

A plain file is Spark's own to read. So is a gzip file: one task unpacks it as it reads, whatever its size; where its name doesn't say
.gz it is read under a name that does.

A BGZF file is a run of gzip blocks of at most 64 KiB that all begin with the same bytes and say how long they are. Spark's reader can cut a file at
any delimiter, so the blocks are read as records between these bytes: the file is split into byte ranges like plain text, and every range's blocks
are unpacked in the task that reads them. A name that says .gz would keep the file in one task, so it is read under another one.
A line that crosses from one range into the next is put together from the few pieces that the ranges leave at their ends.

Other names are links of a view file system, made for one read by its options; nothing is copied.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What gzip files begin with, and the first bytes of a BGZF block up to its size (its extra field's tag is BC).
GZIP = b"\x1f\x8b"
BLOCK_HEAD, BLOCK_TAG = 16, b"\x42\x43\x02\x00"
#: Kinds of rows that a range gives: whole lines, and its text before the first and after the last end of a line (or all of it, where no line ends).
LINE, BEFORE, AFTER, ALL = range(4)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path or of a folder, without hidden ones."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(at) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [str(s.getPath()) for s in inside if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return sorted(found)


def first_bytes(spark: SparkSession, file: str, n: int) -> bytes:
    """The first n bytes of a file (fewer if it is shorter); no more of it is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def kind(spark: SparkSession, file: str) -> str:
    """plain, gzip or bgzf."""
    head = first_bytes(spark, file, BLOCK_HEAD)
    if head[:2] != GZIP:
        return "plain"
    return "bgzf" if len(head) == BLOCK_HEAD and head[3] & 4 and head[12:] == BLOCK_TAG else "gzip"


def _named(spark: SparkSession, files: list[str], suffix: str):
    """A reader, and other names under which it finds the files."""
    mount = f"m{uuid.uuid4().hex}"
    reader = spark.read.option("fs.viewfs.impl.disable.cache", "true")
    for k, file in enumerate(files):
        reader = reader.option(f"fs.viewfs.mounttable.{mount}.link./f{k}{suffix}", file)
    return reader, [f"viewfs://{mount}/f{k}{suffix}" for k in range(len(files))]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, start of the range, block without its first bytes), in a range's order, as lines and pieces of lines."""
    place, before, tail = None, None, b""

    def rows(kind: int, texts: list[bytes]) -> pa.RecordBatch:
        values = pa.array([t.rstrip(b"\r").decode("utf-8", "replace") if kind == LINE else None for t in texts], pa.string())
        raw = pa.array([None if kind == LINE else t for t in texts], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([place[0]] * len(texts), pa.string()), pa.array([place[1]] * len(texts), pa.int64()), pa.array([kind] * len(texts), pa.int32()), values, raw], names=["file", "start", "kind", "value", "piece"])

    def ended():
        if place is not None:
            yield rows(ALL, [tail]) if before is None else rows(AFTER, [tail])

    for batch in batches:
        for file, start, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (file, start) != place:
                yield from ended()
                place, before, tail = (file, start), None, b""
            if not block:  # before a file's first block
                continue
            if len(block) + BLOCK_HEAD != int.from_bytes(block[:2], "little") + 1:
                raise ValueError(f"a block of {file} after byte {start} isn't as long as it says")
            text = zlib.decompress(block[2:-8], wbits=-15)
            if len(text) != int.from_bytes(block[-4:], "little") or zlib.crc32(text) != int.from_bytes(block[-8:-4], "little"):
                raise ValueError(f"a block of {file} after byte {start} is damaged")
            *whole, tail = (tail + text).split(b"\n")
            if whole and before is None:
                before = whole.pop(0)
                yield rows(BEFORE, [before])
            if whole:
                yield rows(LINE, whole)
    yield from ended()


def _blocks(spark: SparkSession, files: list[str]) -> DataFrame:
    reader, names = _named(spark, files, "")
    head = first_bytes(spark, files[0], BLOCK_HEAD).decode("latin-1")
    raw = reader.option("encoding", "ISO-8859-1").option("lineSep", head).text(names)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("block"))


def _bgzf(spark: SparkSession, files: list[str]) -> DataFrame:
    parts = _blocks(spark, files).mapInArrow(_ranges, "file string, start long, kind int, value string, piece binary")
    # a few pieces a range: those between two ends of lines make one line
    pieces = parts.filter(F.col("kind") != LINE).select("file", "start", "kind", "piece")
    order = Window.partitionBy("file").orderBy("start", F.col("kind"))
    line = F.sum(F.when(F.col("kind") == AFTER, 1).otherwise(0)).over(order)
    joined = pieces.withColumn("line", line).groupBy("file", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", F.hex("piece").alias("hex")))), lambda p: p.hex).alias("hex"))
    whole = joined.select(F.unhex(F.array_join("hex", "")).cast("string").alias("value")).filter(F.col("value") != "")
    return parts.filter(F.col("kind") == LINE).select("value").unionByName(whole.select(F.regexp_replace("value", "\r$", "").alias("value")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a file, or of the files of a folder, which are all packed like the first. Empty lines at the ends of BGZF ranges are left out."""
    files = _files(spark, path)
    packed = kind(spark, files[0]) if files else "plain"
    if packed == "bgzf":
        return _bgzf(spark, files)
    if packed == "gzip" and not files[0].endswith(".gz"):
        reader, names = _named(spark, files, ".gz")
        return reader.text(names)
    return spark.read.text(path)
