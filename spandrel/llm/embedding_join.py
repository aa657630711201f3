"""Near-duplicate embeddings by quantised tile products.

Vectors are scaled to length 1 and quantised to int8: x = s q + e, with the length of the error e kept. For two vectors

    |x.y - s t (q.r)| <= |e| |t r| + |s q| |f| + |e| |f|

holds rigorously, so a product of int8 tiles tells which pairs could reach the threshold, and only those are
computed again in double precision from the given components.

Equal vectors of a label are brought together first and stand as one; their number weighs in the link counts. The rest of a
label is dealt by hash into tiles of about TILE vectors. Tiles meet tile against tile; each meeting is one bounded
task, whatever the label's share, and gives at most two rows per vector: its number of links there, and the edges of a spanning
forest of the links, from which components follow. Work grows with the square of a label, as an exact
comparison of vectors in many dimensions does; memory and the rows sent do not: a tile is sent once to each of its meetings.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those whose label is null, link with
nothing; vectors of different lengths don't link; repeated vec_ids are separate vectors, each with its own links and component; a null vec_id
is a vector like any other, but names no component (a component of such rows alone is null) and is never kept; ties (equal vectors) count as links; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

THRESHOLD = 0.93
TILE = 2048
EXACT = 1024
#: Allowance for the rounding of double-precision sums of unit vectors' products, far above it.
SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and length of the quantisation error of unit vectors (double)."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - scale[:, None] * codes) ** 2).sum(1))


def possible_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine could reach the threshold, by int8 products and their error bounds."""
    qa, sa, ea = quantise(a)
    qb, sb, eb = quantise(b)
    # products of int8 sum to less than 2**24 over EXACT dimensions, where single precision is exact
    product = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        product += qa[:, k : k + EXACT].astype(np.float32) @ qb[:, k : k + EXACT].astype(np.float32).T
    product *= sa[:, None] * sb[None, :]
    na, nb = np.sqrt(((sa[:, None] * qa) ** 2).sum(1)), np.sqrt(((sb[:, None] * qb) ** 2).sum(1))
    bound = ea[:, None] * nb[None, :] + na[:, None] * eb[None, :] + ea[:, None] * eb[None, :]
    return np.nonzero(product >= threshold - bound - SLACK)


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b with cosine >= threshold in double precision."""
    la, lb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    i, j = possible_pairs(a / la[:, None], b / lb[:, None], threshold)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        s = slice(k, k + (1 << 16))
        keep[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) / (la[i[s]] * lb[j[s]]) >= threshold
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label[v]: the smallest vertex connected to v by the edges i, j, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        label = new[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """One meeting of two tiles (or of a tile with itself): links per class and edges of a forest."""
    group = group.sort_values(["tile", "rep"])
    rep, n = group["rep"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    x = np.stack(group["vector"].to_list())
    tile = group["tile"].to_numpy()
    first = tile == tile[0]
    cut = int(first.sum())
    if group["low"].iloc[0] == group["high"].iloc[0]:
        i, j = linked_pairs(x, x, THRESHOLD)
        keep = i < j
        i, j = i[keep], j[keep]
    elif first.all():
        i = j = np.zeros(0, np.int64)
    else:
        i, j = linked_pairs(x[:cut], x[cut:], THRESHOLD)
        j = j + cut
    links = np.bincount(i, weights=n[j], minlength=len(x)) + np.bincount(j, weights=n[i], minlength=len(x))
    label = forest(len(x), i, j)
    some = np.flatnonzero(links)
    moved = np.flatnonzero(label != np.arange(len(x)))
    return pd.concat(
        [
            pd.DataFrame({"a": rep[some], "b": pd.array([None] * len(some), "Int64"), "links": links[some].astype(np.int64)}),
            pd.DataFrame({"a": rep[label[moved]], "b": pd.array(rep[moved], "Int64"), "links": np.zeros(len(moved), np.int64)}),
        ]
    )


def embedding_join(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    v = vectors.select(F.col(ident).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0)
    v = v.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("vec_id", F.col("vec_id").cast("long"))
    # -0.0 and 0.0 are the same component
    key = F.when(F.col("usable"), F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("vector", lambda x: (x + 0.0).cast("string")), ",")), 256))
    v = stored(v.withColumn("key", key), "vectors")
    # classes are told apart by numbers: ids may repeat or be missing
    classes = v.filter("usable").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    size = classes.groupBy("label", F.size("vector").alias("d")).agg(F.count("*").alias("many")).withColumn("tiles", F.ceil(F.col("many") / TILE).cast("int"))
    # a row for each label and length of vectors, with its number of tiles
    dealt = classes.withColumn("d", F.size("vector")).join(size, ["label", "d"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    sent = sent.select("label", "d", low.alias("low"), high.alias("high"), "tile", "rep", "n", "vector")
    met = sent.groupBy("label", "d", "low", "high").applyInPandas(_meet, "a long, b long, links long")
    met = stored(met, "meetings")
    links = met.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    linked = components(met.filter("b is not null").select("a", "b")).withColumnsRenamed({"node": "rep"})
    info = classes.join(links, "rep", "left").join(linked, "rep", "left")
    info = info.select("key", "first_id", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    named = info.groupBy("component").agg(F.min("first_id").alias("name"))
    out = v.select("vec_id", "key").join(info.join(named, "component"), "key", "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("name"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

