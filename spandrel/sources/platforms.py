"""Reference catalogues by name, and their canonical form kept on disk."""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.motifs import Equivalence, with_canonical
from .catalogs import READERS, read_catalog
from .shared import shared_dir

CACHE_VERSION = 1


@dataclass(frozen=True)
class Platform:
    """annotation_only: its columns are added, but it has no vote in the combined verdict. assemblies: none means any."""

    name: str
    fmt: str
    assemblies: tuple[str, ...] = ()
    annotation_only: bool = False

    def serves(self, assembly: str) -> bool:
        return not self.assemblies or assembly in self.assemblies


# The platforms' names, formats and roles.
PLATFORMS = {
    p.name: p
    for p in (
        Platform("ucsc", "simplerepeat"),
        Platform("trexplorer", "bed", ("hg38",)),
        Platform("pathogenic", "trgt", ("hg38",), annotation_only=True),
        Platform("bed", "bed"),
    )
}


def platform(name: str) -> Platform:
    if name not in PLATFORMS:
        raise ValueError(f"unknown platform {name!r}: one of {', '.join(PLATFORMS)}")
    return PLATFORMS[name]


def listing(spark: SparkSession) -> DataFrame:
    """name, format, assemblies, role of every platform."""
    rows = [(p.name, p.fmt, ", ".join(p.assemblies) or "any", "annotation only" if p.annotation_only else "screening") for p in PLATFORMS.values()]
    return spark.createDataFrame(rows, "name string, format string, assemblies string, role string")


def load(spark: SparkSession, name: str, path: str, assembly: str = "hg38") -> DataFrame:
    p = platform(name)
    if not p.serves(assembly):
        raise ValueError(f"{name} has no catalogue for {assembly}, only {', '.join(p.assemblies)}")
    return read_catalog(spark, path, p.fmt if p.fmt in READERS else "auto")


def cached(spark: SparkSession, name: str, path: str, how: Equivalence = Equivalence(), assembly: str = "hg38") -> tuple[DataFrame, bool]:
    """The catalogue with its canonical motifs, and whether it was found ready. It is kept as Parquet in the shared folder under a name made of all it
    depends on: version, files with their times and sizes, equivalence, platform and format."""
    files = spark.read.format("binaryFile").load(path)
    stamp = files.agg(F.md5(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(",", "path", "modificationTime", "length")))))).first()
    key = hashlib.sha256(repr((CACHE_VERSION, stamp[0] if stamp else "", astuple(how), name, platform(name).fmt, assembly)).encode()).hexdigest()[:32]
    kept = f"{shared_dir(spark)}/catalogue-{key}"
    try:
        return spark.read.parquet(kept), True
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    with_canonical(load(spark, name, path, assembly), "motif", "canonical", how).write.mode("overwrite").option("compression", "zstd").parquet(kept)
    return spark.read.parquet(kept), False
