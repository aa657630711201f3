"""Search: nearest vectors, ontology neighbours, and ranking of text queries by mention coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mentions
from ..sources.shared import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest_vectors(index: DataFrame, query: list[float], k: int = 5, threshold: float = 0.0, ident: str = "id", vector: str = "vector") -> DataFrame:
    """The k most similar unit vectors by dot product, and whether each reaches the threshold."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = index.withColumn("score", dot(F.col(vector), q)).drop(vector)
    return scored.orderBy(F.col("score").desc(), ident).limit(k).withColumn("accepted", F.col("score") >= threshold)


TERM = r"^HP:[0-9]{7}$"


def phenotype_genes(index: DataFrame, query: DataFrame, terms: DataFrame, edges: DataFrame, genes: DataFrame, k: int = 5, threshold: float = 0.3) -> DataFrame:
    """gene_symbol of the genes tied to a query's terms and to their parents and children.

    index: id, vector (unit length); query: one row with a vector q; terms: id, obsolete; edges: child, parent; genes: hpo_id, gene_symbol. Of the k nearest ids
    those at or above the threshold count, if they have a term's form, exist and aren't obsolete.
    """
    scored = index.crossJoin(F.broadcast(query)).withColumn("score", dot(F.col("vector"), F.col("q"))).select("id", "score")  # one row
    near = scored.orderBy(F.col("score").desc(), "id").limit(k).filter((F.col("score") >= threshold) & F.col("id").rlike(TERM))
    known = near.join(terms.filter(~F.col("obsolete")), "id").select(F.col("id").alias("term"))
    every = known.unionByName(related_terms(known, edges).select(F.col("related").alias("term"))).distinct()
    return genes_for_terms(genes, every.select(F.col("term").alias("hpo_id")))


def related_terms(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents and children of the given terms. edges: child, parent."""
    up = terms.join(edges, F.col("term") == F.col("child")).select("term", F.lit("parent").alias("relation"), F.col("parent").alias("related"))
    down = terms.join(edges, F.col("term") == F.col("parent")).select("term", F.lit("child").alias("relation"), F.col("child").alias("related"))
    return up.unionByName(down).distinct()


def ancestors(edges: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, ancestor, depth (the fewest steps up) of the given terms, or of all that have a parent. edges: child, parent; circles do no harm.

    Semi-naive: a round goes one step up from the pairs that the round before found first, and keeps what no round had; so every edge of a pair's
    way is followed once. Rounds are as many as the longest of the shortest ways up.
    """
    # sort-merge joins throughout: these tables are small as files and large as hash tables, and there is a join each round
    up = written(edges.select("child", "parent").filter("child is not null and parent is not null").distinct(), "edges").hint("merge")
    start = up.select(F.col("child").alias("term")) if terms is None else terms.select("term")
    new = start.distinct().join(up, F.col("term") == F.col("child")).select("term", F.col("parent").alias("ancestor"))
    found, depth = [], 1
    while True:
        new = written(new.distinct().withColumn("depth", F.lit(depth)), "ancestors")
        if new.isEmpty():
            break
        found.append(new)
        step = new.join(up, F.col("ancestor") == F.col("child")).select("term", F.col("parent").alias("ancestor")).distinct()
        old = reduce(DataFrame.unionByName, found).select("term", "ancestor").hint("merge")
        new, depth = step.join(old, ["term", "ancestor"], "left_anti"), depth + 1
    return reduce(DataFrame.unionByName, found, new)


def genes_for_terms(edges: DataFrame, terms: DataFrame, gene: str = "gene_symbol", term: str = "hpo_id", placeholder: str = "-") -> DataFrame:
    return edges.join(terms.select(term).distinct(), term, "left_semi").filter(F.col(gene) != placeholder).select(gene).distinct()


def coverage(docs: DataFrame, text: str, must: list[str], reject: list[str] = ()) -> DataFrame:
    """n, and the share of documents that mention every must and no reject."""
    ok = F.lit(True)
    for t in must:
        ok = ok & mentions(F.col(text), t)
    for t in reject:
        ok = ok & ~mentions(F.col(text), t)
    return docs.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(ok, F.lit(False)).cast("double")), 6).alias("coverage"))


def ladder(docs: DataFrame, text: str, strategies: dict[str, list[str]], must: list[str]) -> DataFrame:
    """Per strategy (terms that must all occur): specificity (number of terms), hits, and the share of hits that mention every must. One pass."""
    needed = F.lit(True)
    for t in must:
        needed = needed & mentions(F.col(text), t)
    parts = []
    for k, terms in enumerate(strategies.values()):
        hit = F.lit(True)
        for t in terms:
            hit = hit & mentions(F.col(text), t)
        parts += [F.count_if(hit).alias(f"h{k}"), F.count_if(hit & needed).alias(f"m{k}")]
    one = docs.agg(*parts)
    stack = ", ".join(f"'{n}', {len(t)}, h{k}, m{k}" for k, (n, t) in enumerate(strategies.items()))
    out = one.selectExpr(f"stack({len(strategies)}, {stack}) as (strategy, specificity, hits, mentioning)")
    return out.withColumn("coverage", F.round(F.col("mentioning") / F.nullif(F.col("hits"), F.lit(0)), 6))


def best_strategy(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """The most specific strategy with hits and enough coverage; fewer hits win a tie."""
    return scored.filter((F.col("hits") > 0) & (F.col("coverage") >= least)).orderBy(F.col("specificity").desc(), "hits", "strategy").limit(1)
