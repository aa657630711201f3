"""Serving: filters with a list of those that could not apply, named sorts, pages, funnels, and guarded SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import chrom_order, in_region
from .screen import agreement_as

PLI_CONSTRAINED = 0.9


def contains_ci(c: Column, text: str) -> Column:
    return F.contains(F.upper(c), F.upper(F.lit(text)))


#: name of a filter: (columns it needs, predicate of its value)
FILTERS = {
    "novel_only": (("novel",), lambda v: F.col("novel")),
    "disease_gene_only": (("disease_gene",), lambda v: F.col("disease_gene")),
    "genic_only": (("genic",), lambda v: F.col("genic")),
    "exonic_only": (("exonic",), lambda v: F.col("exonic")),
    "constrained_only": (("pli",), lambda v: F.col("pli") >= PLI_CONSTRAINED),
    "chrom": (("chrom",), lambda v: F.col("chrom") == v),
    "motif_class": (("motif_class",), lambda v: F.col("motif_class") == v),
    "gene": (("gene",), lambda v: F.col("gene") == v),
    "gene_region": (("region",), lambda v: F.col("region") == v),
    "novelty": (("novelty",), lambda v: F.col("novelty") == v),
    "strchive_status": (("strchive_status",), lambda v: F.col("strchive_status") == v),
    "min_motif_len": (("motif_len",), lambda v: F.col("motif_len") >= v),
    "min_samples": (("n_samples",), lambda v: F.col("n_samples") >= v),
    "min_purity": (("mean_purity",), lambda v: F.col("mean_purity") >= v),
    "min_insertion_purity": (("insertion_purity",), lambda v: F.col("insertion_purity") >= v),
    "region": (("chrom", "pos"), lambda v: in_region(F.col("chrom"), F.col("pos"), v)),
    "gene_query": (("gene",), lambda v: contains_ci(F.col("gene"), v)),
    "sample": (("sample",), lambda v: F.col("sample") == v),
    "platform_agreement": (("ucsc_novelty", "trexplorer_novelty"), lambda v: agreement_as(v, F.col("ucsc_novelty"), F.col("trexplorer_novelty"))),
    "genes": (("gene",), lambda v: F.upper(F.col("gene")).isin([x.upper() for x in v])),
}


def filtered(df: DataFrame, **wanted) -> tuple[DataFrame, list[str]]:
    """df under every given filter, and the names of filters that its columns can't answer. None and False mean no filter."""
    ignored = []
    for name, value in wanted.items():
        if value is None or value is False:
            continue
        needs, predicate = FILTERS[name]
        if set(needs) <= set(df.columns):
            df = df.filter(predicate(value))
        else:
            ignored.append(name)
    return df, ignored


SORTS = {
    "position": (lambda: [chrom_order(F.col("chrom")), F.col("pos")], "asc"),
    "novel": (lambda: [F.col("novel"), F.col("motif_len")], "desc"),
    "size": (lambda: [F.col("median_len")], "desc"),
    "support": (lambda: [F.col("n_samples")], "desc"),
    "motif_len": (lambda: [F.col("motif_len")], "desc"),
    "purity": (lambda: [F.col("mean_purity")], "desc"),
    "arrays": (lambda: [F.col("n_arrays")], "desc"),
}


def order_by(sort: str, direction: str | None = None) -> list[Column]:
    """Every primary key in the direction asked for, nulls last; then genomic order."""
    keys, natural = SORTS[sort]
    down = (direction or natural) == "desc"
    out = [k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys()]
    return out if sort == "position" else [*out, chrom_order(F.col("chrom")).asc_nulls_last(), F.col("pos").asc_nulls_last()]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def list_loci(loci: DataFrame, segs: DataFrame | None = None, sort: str = "position", direction: str | None = None, limit: int = 100, offset: int = 0, **wanted) -> dict:
    """rows (a DataFrame), total, ignored filters and the sort used: arrays falls back to position without a segment table."""
    from .rollup import array_counts

    used = sort if sort != "arrays" or segs is not None else "position"
    df, ignored = filtered(loci, **wanted)
    total = df.count()
    if used == "arrays":
        df = df.join(array_counts(segs), "locus_id", "left")
    return {"rows": page(df, order_by(used, direction if used == sort else None), limit, offset), "total": total, "ignored": ignored, "sort": used}


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, place, n: how many rows pass every stage up to each. One pass over df."""
    upto, counts = F.lit(True), []
    for name, condition in stages.items():
        upto = upto & condition
        counts.append((name, F.count_if(upto)))
    one = df.agg(*[c.alias(f"n{k}") for k, (_, c) in enumerate(counts)])
    stack = ", ".join(f"{k}, '{name}', n{k}" for k, (name, _) in enumerate(counts))
    return one.selectExpr(f"stack({len(counts)}, {stack}) as (place, stage, n)")


def priority(column: str, ranks: dict[str, int], rest: int = 99) -> Column:
    out = F.lit(rest)
    for value, rank in ranks.items():
        out = F.when(F.col(column) == value, rank).otherwise(out)
    return out


@dataclass
class Dataset:
    name: str
    view: str
    role: str = ""
    default_off: bool = False
    description: str = ""
    columns: dict[str, str] = field(default_factory=dict)


ROLE_COLUMNS = {
    "loci": "locus_id chrom pos motif motif_len motif_class n_samples median_len mean_purity novel".split(),
    "segments": "locus_id sample seg_index seg_type start end".split(),
}
READERS = {"parquet": {}, "csv": {"header": True, "inferSchema": True}, "tsv": {"header": True, "inferSchema": True, "sep": "\t"}, "json": {}}


class Registry:
    """Named tables with roles over temp views. A reload makes new views and then swaps, so a running query keeps the ones it has."""

    def __init__(self, spark: SparkSession):
        self.spark, self.datasets, self.generation = spark, {}, 0

    def register(self, name: str, source: DataFrame | str, fmt: str = "parquet", role: str = "", **more) -> Dataset:
        df = source if isinstance(source, DataFrame) else self.spark.read.format("csv" if fmt == "tsv" else fmt).options(**READERS[fmt]).load(source)
        needed = ROLE_COLUMNS.get(role, [])
        absent = set(needed).difference(map(str.lower, df.columns))
        if absent:
            raise ValueError(f"a {role} table needs {', '.join(sorted(absent, key=needed.index))}")
        self.generation += 1
        view = f"{name}__g{self.generation}"
        df.createOrReplaceTempView(view)
        df.createOrReplaceTempView(name)
        self.datasets[name] = Dataset(name, view, role, columns=dict(df.dtypes), **more)
        return self.datasets[name]

    def unregister(self, name: str) -> None:
        d = self.datasets.pop(name)
        for view in (d.view, name):
            self.spark.catalog.dropTempView(view)

    def available(self, off: set[str] = frozenset()) -> list[Dataset]:
        return [d for d in self.datasets.values() if d.name not in off]

    def table_for(self, role: str, off: set[str] = frozenset()) -> DataFrame | None:
        """The first table of a role that is on; one that is off by default only if there is no other."""
        found = sorted((d for d in self.available(off) if d.role == role), key=lambda d: d.default_off)
        return self.spark.table(found[0].view) if found else None

    def describe(self) -> str:
        return "\n".join(f"{d.name} ({d.role or 'no role'}): " + ", ".join(f"{c} {t}" for c, t in d.columns.items()) for d in self.datasets.values())

    def query(self, sql: str, max_rows: int = 500, off: set[str] = frozenset()) -> dict:
        """One SELECT or WITH over registered tables: columns, rows (at most max_rows) and whether there were more."""
        body = sql.strip().rstrip(";").strip()
        if ";" in re.sub(r"'[^']*'", "''", body) or not re.match(r"(?is)(select|with)\b", body):
            raise ValueError("one SELECT or WITH statement is allowed")
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
        if "Command" in plan.getClass().getSimpleName() or re.search(r"(?i)\bInsertInto", plan.toString()):
            raise ValueError("only queries are allowed")
        text = plan.toString()
        allowed = {d.name.lower() for d in self.available(off)} | {m.lower() for m in re.findall(r"(?i)CTE \[([^\]]*)\]", text) for m in re.split(r",\s*", m)}
        for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", text):
            if name.lower() not in allowed:
                raise ValueError(f"no such table: {name}")
        if "UnresolvedTableValuedFunction" in text and re.search(r"(?i)read_files|java_method|reflect", body):
            raise ValueError("that function is not allowed")
        df = self.spark.sql(body)
        rows = df.limit(max_rows + 1).collect()
        return {"columns": df.columns, "rows": [r.asDict() for r in rows[:max_rows]], "truncated": len(rows) > max_rows}


def inspect(df: DataFrame, rows: int = 5) -> dict:
    try:
        return {"columns": dict(df.dtypes), "n_rows": df.count(), "preview": [r.asDict() for r in df.limit(rows).collect()]}
    except Exception as e:  # an unreadable upload is reported, not raised
        return {"error": str(e)[:300]}
