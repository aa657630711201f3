"""Exact Jaccard self-join of documents on word n-grams, by vertical partitioning.

The n-grams have one global order: by the number of different sets that hold them, then by hash. Rare ones come first.

Finding candidates. Of two sets with Jaccard at least t, each holds at least t of its own n members in common with the
other, so their first n - ceil(t n) + 1 members in the global order share one. An n-gram that one set alone holds
leads to no partner, and a line, licence or passage that many documents share stands at the end of the order: a document
with enough n-grams of its own is no candidate at all. The order's counts take one exchange: the different n-grams
of a chunk of documents go, counted, to fragments of the hash space; a fragment answers with those that occur
twice or more (copies in other chunks count again, which leaves the order one and the same for all).

Grouping. Documents sorted by shared leading n-gram stream past; each bucket gives a star around its first document, so
groups of thousands of copies give as many rows as members. The components of the stars are clusters, and every
possible link lies within one.

Sieving. The more documents there are, the more groups hang together by an n-gram that two of them share by chance, and an exact comparison of a
cluster grows with its square. A set's sketch is the parity of its members in each of some bits: two sets differ in at least as many members as
their sketches in bits. Clusters that would cost much are parted first: their sketches meet, tile against tile, where sizes allow a link
(in one band of sizes or the next), and only pairs that may still reach the threshold stay together. No link is lost.

Counting. In a meeting of documents the order is cut into fragments; each fragment's overlaps of all the pairs are
counted separately, as a product of 0/1 matrices, and the counts are summed per pair. The sums decide exactly. A
meeting returns only a spanning forest of its links, at most one row per document; components of the forests are the
result. A cluster of up to TILE documents is one meeting. A larger one is first held against a pivot, every document
sent once: those linked to it are connected and need no comparison among each other. Jaccard distance is a metric, so one of them
and a document at distance d of the pivot can only be linked if their distances differ by no more than 1 - t: the
documents left over meet only those in that ring. This is repeated with a pivot among the left over ones.

Equal sets stand as one: nodes are the different sets, whatever the documents' ids.

Defined cases: null, empty and blank texts have an empty set and no link; texts with fewer than n words have one member,
their whole sequence; repeated rows, rows that share a doc_id and rows without one are documents of their own; a
component's id is the smallest doc_id in it, null if none has one; an empty table gives an empty result; other columns pass
through, but for those with the names of the results, which are replaced. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .components import components
from .embedding_join import forest
from .exchange import pack_sorted, runs, unpack_sorted
from .textops import Words, blocks, mix64, shingles, string_parts

#: The threshold as a fraction, for exact integer comparisons: 90 / 100.
THRESHOLD = (90, 100)
N_WORDS = 3
#: N-grams are counted and ordered by so many bits of their hash; equal ones of different n-grams only weaken the order.
ORDER_BITS = 48
#: Documents and bytes of text that send their n-grams together, and the n-grams of a fragment of the hash space.
CHUNK, CHUNK_BYTES = 4096, 4 << 20
FRAGMENT_GRAMS = 2_000_000
#: A tile has at most about so many documents, and so many n-grams.
TILE, TILE_GRAMS = 2048, 1 << 21
#: Clusters are sieved where documents times n-grams exceed the first; so many sketches are a tile, of at most so many bits.
SIEVED, SKETCHES, SKETCH_BITS = 1 << 27, 4096, 4096
#: Pairs of sketches that are compared at a time.
SKETCH_PAIRS = 1 << 18
#: Small clusters are dealt to meetings of about so many n-grams.
SHARE_GRAMS = 1 << 20
#: Cells of the 0/1 matrix of one fragment.
FRAGMENT_CELLS = 1 << 22
#: A large cluster is held against so many pivots, one after the other; what is left over meets tile against tile.
PIVOTS = 8


def _sets(texts: pa.Array, n_words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, sets laid end to end, first) of each block [a, b) of texts; each set is sorted."""
    offsets, raw = string_parts(texts)
    for a, b in blocks(offsets):
        w = Words(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]])
        h, doc = shingles(w, n_words)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
        h, doc = h[new], doc[new]
        yield a, b, h, np.searchsorted(doc, np.arange(b - a + 1))


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _bands(threshold: tuple[int, int], most: int = 1 << 40) -> np.ndarray:
    """Where bands of sizes begin: sets that reach the threshold are of one band or of two neighbours."""
    num, den = threshold
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] * den // num, edges[-1] * 11 // 10) + 1)
    return np.array(edges, np.int64)


def _bits(edges: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Bits of the sketches of each band: enough that those of sets without common members differ in more than the threshold admits."""
    num, den = threshold
    least = np.minimum(5 * (den - num) * edges[1:] // den, SKETCH_BITS)
    return np.array([1 << max(6, int(x - 1).bit_length()) for x in least.tolist()])


def describe(docs: DataFrame, text: str = "text", n_words: int = N_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with n_shingles, node, a digest of the set (null when it is empty), and the band of its size and its sketch."""
    at = docs.columns.index(text)
    edges = _bands(threshold)
    bits = _bits(edges, threshold)

    def run(batches):
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for a, b, h, first in _sets(batch.column(at), n_words):
                sizes.append(np.diff(first))
                width = bits[np.maximum(np.searchsorted(edges, sizes[-1], "right") - 1, 0)].tolist()
                sketches += [np.packbits(np.bincount(h[x:y] & np.uint64(w - 1), minlength=w) & 1).tobytes() if y > x else None for x, y, w in zip(first[:-1], first[1:], width, strict=True)]
                nodes += [int.from_bytes(hashlib.blake2b(h[x:y].tobytes(), digest_size=8).digest(), "little", signed=True) if y > x else None for x, y in zip(first[:-1], first[1:], strict=True)]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            more = [_int64(n), pa.array(nodes, pa.int64()), _int64(np.searchsorted(edges, n, "right") - 1), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "n_shingles", "node", "band", "sketch"])

    more = [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("band", T.LongType()), T.StructField("sketch", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def _sent(fragments: int, n_words: int):
    """Rows (node, text) to rows of chunks: to each fragment the chunk's different n-grams in its part of the hash space, with the number of the chunk's
    documents (those with equal sets count as one) that hold each, and the document where it is one; and to the chunk itself (fragment below 0) the documents' nodes and sizes (grams), and
    the documents of n-grams that several of its documents hold (counts)."""
    shift = np.uint64(64 - ORDER_BITS)

    def chunk(number, nodes, grams, docs, sizes):
        order = np.argsort(grams, kind="stable")
        grams, docs = grams[order], docs[order]
        at = runs(grams)
        held = np.diff(np.append(at, len(grams)))
        several = np.repeat(held > 1, held)
        own = np.bincount(docs, minlength=len(nodes))
        head = np.stack([nodes, sizes, own]).tobytes()
        rows = [(-1 - number, number, head, pack_sorted(grams[several], docs[several].astype(np.uint16)))]
        kinds, one = grams[at], np.where(held == 1, docs[at], 65535).astype(np.uint16)
        fragment = ((kinds >> np.uint64(ORDER_BITS - 32)) * np.uint64(fragments)) >> np.uint64(32)
        cut = np.searchsorted(fragment, np.arange(fragments + 1, dtype=np.uint64))
        rows += [(f, number, b"", pack_sorted(kinds[x:y], one[x:y], held[x:y].astype(np.uint16))) for f, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["fragment", "chunk", "head", "grams"])

    def run(batches):
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 28
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets, _ = string_parts(batch.column(1))
            for x, y in blocks(offsets, CHUNK_BYTES):
                for lo in range(x, y, CHUNK):
                    # equal sets once
                    _, at = np.unique(node[lo : min(lo + CHUNK, y)], return_index=True)
                    at = lo + np.sort(at)
                    grams, docs, sizes = [], [], []
                    for a, b, h, first in _sets(batch.column(1).take(pa.array(at)), n_words):
                        n = np.diff(first)
                        d = np.repeat(np.arange(a, b), n)
                        g = h >> shift
                        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
                        grams.append(g[new]), docs.append(d[new]), sizes.append(n)
                    yield chunk(number, node[at], np.concatenate(grams), np.concatenate(docs), np.concatenate(sizes))
                    number += 1

    return run


def _counted(group: pd.DataFrame) -> pd.DataFrame:
    """A fragment's answer to each chunk: its n-grams that two sets or more hold, with their numbers of sets. A chunk's own row passes through."""
    if group["fragment"].iloc[0] < 0:
        return group[["chunk", "head", "grams"]]
    parts = [unpack_sorted(g, "<u2", "<u2") for g in group["grams"]]
    size = [len(p[0]) for p in parts]
    gram = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[2] for p in parts]).astype(np.int64)
    order = np.argsort(gram, kind="stable")
    at = runs(gram[order])
    total = np.empty(len(gram), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], at), np.diff(np.append(at, len(gram)))) if len(at) else 0
    rows, end = [], np.cumsum(size)
    for chunk, (g, one, _), x, y in zip(group["chunk"], parts, end - size, end, strict=True):
        keep = total[x:y] > 1
        if keep.any():
            rows.append((chunk, None, pack_sorted(g[keep], one[keep], np.minimum(total[x:y][keep], 2**32 - 1).astype(np.uint32))))
    return pd.DataFrame(rows, columns=["chunk", "head", "grams"])


def _leading(threshold: tuple[int, int]):
    """A chunk's answers to (gram, node, mate) rows: the n-grams with which its documents lead, of those that other sets hold too. Each n-gram goes
    with its first node in the chunk; the others are linked to that one here, in rows with a mate, which may go anywhere."""
    num, den = threshold

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["head"].notna()].iloc[0]
        nodes, sizes, held = np.frombuffer(own["head"], np.int64).reshape(3, -1)
        parts = [unpack_sorted(g, "<u2", "<u4") for g, head in zip(group["grams"], group["head"], strict=True) if head is None]
        if not parts:
            return pd.DataFrame({"gram": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "mate": pd.array([], "Int64")})
        gram, one, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        # n-grams of several of the chunk's documents
        g2, d2 = unpack_sorted(own["grams"], "<u2")
        many = one == 65535
        order = np.argsort(gram[many])
        of, t2 = gram[many][order], total[many][order]
        gram, doc, total = np.concatenate([gram[~many], g2]), np.concatenate([one[~many], d2]).astype(np.int64), np.concatenate([total[~many], t2[np.searchsorted(of, g2)]])
        order = np.lexsort((gram, total, doc))
        gram, doc = gram[order], doc[order]
        shared = np.bincount(doc, minlength=len(nodes))
        place = np.arange(len(doc)) - (np.cumsum(shared) - shared)[doc]
        lead = sizes - (sizes * num + den - 1) // den + 1  # so many lead; those that no other set holds come first
        keep = place < (lead - (held - shared))[doc]
        gram, doc = gram[keep], doc[keep]
        order = np.lexsort((doc, gram))
        gram, doc = gram[order], doc[order]
        at = runs(gram)
        root = np.repeat(doc[at], np.diff(np.append(at, len(gram))))
        pairs = np.unique(np.stack([root, doc], 1)[root != doc], axis=0)
        a, b = nodes[pairs[:, 0]], nodes[pairs[:, 1]]
        anywhere = mix64(a.view(np.uint64) ^ mix64(b.view(np.uint64))).view(np.int64)
        mate = pd.array(np.concatenate([np.zeros(len(at), np.int64), b]), "Int64")
        mate[: len(at)] = pd.NA
        return pd.DataFrame({"gram": np.concatenate([gram[at].astype(np.int64), anywhere]), "node": np.concatenate([nodes[doc[at]], a]), "mate": mate})

    return lead


def _stars(batches):
    """Rows sorted by (gram, node) to (first node of the n-gram, other node), each once a batch; links found before pass through."""
    last, centre = None, None
    for batch in batches:
        found = batch.column(2).is_valid()
        linked, batch = batch.filter(found), batch.filter(pc.invert(found))
        if linked.num_rows:
            yield pa.RecordBatch.from_arrays([linked.column(1), linked.column(2)], names=["a", "b"])
        gram, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(gram):
            continue
        new = np.concatenate([[last is None or gram[0] != last], gram[1:] != gram[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(gram)), -1))
        root = np.where(begin >= 0, node[np.maximum(begin, 0)], centre if centre is not None else 0)
        last, centre = gram[-1], root[-1]
        apart = root != node
        if apart.any():
            pairs = np.unique(np.stack([root[apart], node[apart]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def candidates(texts: DataFrame, grams: int, n_words: int, threshold: tuple[int, int]) -> DataFrame:
    """a, b: links whose components hold every pair of nodes that could reach the threshold. texts: node, text; grams: about how many n-grams they have."""
    sent = texts.mapInArrow(_sent(max(1, -(-grams // FRAGMENT_GRAMS)), n_words), "fragment long, chunk long, head binary, grams binary")
    answers = sent.groupBy("fragment").applyInPandas(_counted, "chunk long, head binary, grams binary")
    leading = answers.groupBy("chunk").applyInPandas(_leading(threshold), "gram long, node long, mate long")
    return leading.repartition("gram").sortWithinPartitions("gram", "node").mapInArrow(_stars, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, counted fragment by fragment of the order and summed."""
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    # n-grams that only one side has can't overlap
    both = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return total
    at_a, at_b = np.minimum(np.searchsorted(both, a), len(both) - 1), np.minimum(np.searchsorted(both, b), len(both) - 1)
    in_a, in_b = both[at_a] == a, both[at_b] == b
    at_a, row_a, at_b, row_b = at_a[in_a], row_a[in_a], at_b[in_b], row_b[in_b]
    width = max(64, FRAGMENT_CELLS // max(len(left), len(right)))
    by_a, by_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, row_a, at_b, row_b = at_a[by_a], row_a[by_a], at_b[by_b], row_b[by_b]
    for lo in range(0, len(both), width):
        n = min(width, len(both) - lo)
        parts = []
        for at, row, size in ((at_a, row_a, len(left)), (at_b, row_b, len(right))):
            x, y = np.searchsorted(at, (lo, lo + n))
            m = np.zeros((size, n), np.float32)
            m[row[x:y], at[x:y] - lo] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total


def _read(grams) -> list[np.ndarray]:
    return [np.frombuffer(g, np.uint64) for g in grams]


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    num, den = threshold
    o = np.rint(overlaps(left, right)).astype(np.int64)
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    return np.nonzero((den * o >= num * (na[:, None] + nb[None, :] - o)) & (o > 0))


def _meet(threshold: tuple[int, int]):
    """Rows (cluster, side, node, grams) of a meeting to the edges of a forest of its links. Side 0 meets itself; 1 meets 2."""

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["cluster", "side", "node"])
        cluster, side, node = (group[c].to_numpy() for c in ("cluster", "side", "node"))
        sets = _read(group["grams"])
        edge = np.append(runs(cluster), len(cluster))
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            own = sets[x:y]
            if side[x] == 0:
                i, j = _linked(own, own, threshold)
                i, j = i[i < j], j[i < j]
            else:
                cut = int((side[x:y] == 1).sum())
                if cut in (0, y - x):
                    continue
                i, j = _linked(own[:cut], own[cut:], threshold)
                j = j + cut
            label = forest(y - x, i, j)
            moved = np.flatnonzero(label != np.arange(y - x))
            out_a.append(node[x + label[moved]]), out_b.append(node[x + moved])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return meet


def _against_pivot(group: pd.DataFrame) -> pd.DataFrame:
    """Rows of a cluster's tile and its pivot (side 1) to each node's overlap with the pivot and the size of their union."""
    is_pivot = (group["side"] == 1).to_numpy()
    pivot = group[is_pivot].iloc[0]
    rest = group[~is_pivot]
    sets, p = _read(rest["grams"]), np.frombuffer(pivot["grams"], np.uint64)
    both = overlaps(sets, [p])[:, 0].astype(np.int64) if sets else np.zeros(0, np.int64)
    union = np.array([len(x) for x in sets], np.int64) + len(p) - both
    return pd.DataFrame({"cluster": rest["cluster"], "node": rest["node"], "pivot": pivot["node"], "both": both, "total": union})


def _tile(count, salt: int = 0):
    return F.pmod(F.xxhash64("node", F.lit(salt)), count).cast("int")


def _met(left: DataFrame, right: DataFrame | None, tiles: DataFrame, meet) -> DataFrame:
    """Links of left rows with right ones (or among themselves) of the same cluster, tile against tile, as meet finds them. Rows: cluster, node and what is compared; tiles: cluster, l, r."""
    compared = [c for c in left.columns if c != "cluster"]
    there = lambda rows, own, other: rows.join(tiles, "cluster").withColumn("own", _tile(F.col(own))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    own = there(left, "l", "r" if right is not None else "l")
    if right is None:
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        rows = own.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"), *compared)
    else:
        rows = own.select("cluster", F.col("own").alias("low"), F.col("other").alias("high"), F.lit(1).alias("side"), *compared)
        met = there(right, "r", "l").select("cluster", F.col("other").alias("low"), F.col("own").alias("high"), F.lit(2).alias("side"), *compared)
        rows = rows.unionByName(met)
    return rows.groupBy("cluster", "low", "high").applyInPandas(meet, "a long, b long")


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all of the length of the shortest."""
    least = min(map(len, sketches))
    rows = []
    for s in sketches:
        x = np.frombuffer(s, np.uint64)
        rows.append(np.bitwise_xor.reduce(x.reshape(-1, least // 8)))
    return np.stack(rows)


def _sift(threshold: tuple[int, int]):
    """Rows (side, node, n, sketch) of a meeting to the edges of a forest of the pairs whose sketches admit the threshold. Side 0 meets itself; 1 meets 2."""
    num, den = threshold

    def sift(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "n", "node"])
        side, node, n = (group[c].to_numpy() for c in ("side", "node", "n"))
        words = _folded(group["sketch"].to_list())
        total, alone = len(n), side[0] == 0
        cut = total if alone else int((side == 1).sum())
        start = 0 if alone else cut
        label = np.arange(total)
        at = 0
        while at < cut and start < total:
            step = max(1, SKETCH_PAIRS // (total - start))
            rows = slice(at, min(at + step, cut))
            # those sizes that the block's smallest and largest set admit
            low = max(at if alone else start, start + int(np.searchsorted(n[start:], -(-n[at] * num // den))))
            high = max(low, start + int(np.searchsorted(n[start:], n[rows.stop - 1] * den // num, "right")))
            apart = np.zeros((rows.stop - at, high - low), np.int32)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(words[rows, w][:, None] ^ words[low:high, w][None, :])
            a, b = n[rows][:, None], n[low:high][None, :]
            # a union of u and an intersection of i differ by u - i, and u + i is the sum of the sizes
            i, j = np.nonzero((apart <= (a + b) * (den - num) // (den + num)) & (label[rows][:, None] != label[low:high][None, :]))
            label = forest(total, label[at + i], label[low + j])[label]
            at = rows.stop
        moved = np.flatnonzero(label != np.arange(total))
        return pd.DataFrame({"a": node[label[moved]], "b": node[moved]})

    return sift


def _sieved(clusters: DataFrame, sketches: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """clusters (node, cluster, n, row) with those parted that would cost much: no link is between the parts, and rows that can have none are left out. sketches: row, band, sketch."""
    size = clusters.groupBy("cluster").agg((F.count("*") * F.sum("n")).alias("cost")).filter(F.col("cost") > SIEVED).select("cluster")
    size = stored(size, "wide")
    if size.isEmpty():
        return clusters
    wide = clusters.join(size, "cluster").join(sketches, "row")
    # a meeting's number stands for its cluster and band; two of one number only meet in vain
    at = lambda k: wide.select(F.xxhash64("cluster", F.col("band") - k).alias("cluster"), "node", "n", "sketch")
    tiles = lambda k, name: wide.groupBy(F.xxhash64("cluster", F.col("band") - k).alias("cluster")).agg(F.ceil(F.count("*") / SKETCHES).cast("int").alias(name))
    links = _met(at(0), None, tiles(0, "l"), _sift(threshold)).unionByName(_met(at(0), at(1), tiles(0, "l").join(tiles(1, "r"), "cluster"), _sift(threshold)))
    part = components(links)
    part = part.union(part.select("component", "component").distinct())
    parted = clusters.drop("cluster").join(part.withColumnRenamed("component", "cluster"), "node").select(*clusters.columns)
    return stored(clusters.join(size, "cluster", "left_anti").select(*clusters.columns).unionByName(parted), "parts")


def _large(rows: DataFrame, threshold: tuple[int, int]) -> list[DataFrame]:
    """Links that connect what all the links of large clusters connect. rows: cluster, node, grams."""
    num, den = threshold
    tiles_of = lambda df, name: df.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.length("grams")) / (8 * TILE_GRAMS))).cast("int").alias(name))
    links, open_ = [], rows
    for turn in range(PIVOTS):
        sizes = stored(tiles_of(open_, "l"), "open")
        if sizes.filter("l > 1").isEmpty():
            break
        # one pivot for each cluster, to each of its tiles
        pivot = open_.groupBy("cluster").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("node"))
        sent = open_.join(sizes, "cluster").withColumn("tile", _tile(F.col("l"))).withColumn("side", F.lit(0))
        chosen = open_.join(pivot, ["cluster", "node"]).join(sizes, "cluster").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("l") - 1))).withColumn("side", F.lit(1))
        met = sent.unionByName(chosen).groupBy("cluster", "tile").applyInPandas(_against_pivot, "cluster long, node long, pivot long, both long, total long")
        rated = stored(met, "pivot")
        near = F.col("both") * den >= F.col("total") * num
        links.append(rated.filter(near).filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        # distances to the pivot that differ by more than 1 - t part a pair; in thousandths, rounded outwards
        far = F.ceil((F.col("total") - F.col("both")) * 1000 / F.col("total")).cast("int")
        width = -(-1000 * (den - num) // den) + 2
        rated = rated.withColumn("near", near).withColumn("far", far)
        rest = rated.filter(~F.col("near"))
        first = rest.groupBy("cluster").agg(F.min("far").alias("least"))
        ring = rated.filter("near").join(first, "cluster").filter(F.col("far") >= F.col("least") - width).select("cluster", "node")
        probe = rest.filter(F.col("far") <= 2 * width).select("cluster", "node")
        inner, outer = open_.join(ring, ["cluster", "node"], "left_semi"), open_.join(probe, ["cluster", "node"], "left_semi")
        both = stored(tiles_of(inner, "l").join(tiles_of(outer, "r"), "cluster"), "rings")
        links.append(_met(inner, outer, both, _meet(threshold)))
        open_ = stored(open_.join(rest.select("cluster", "node"), ["cluster", "node"], "left_semi"), "left")
    links.append(_met(open_, None, tiles_of(open_, "l"), _meet(threshold)))
    return links


def _links(sets: DataFrame, clusters: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """a, b: links that span the same components as all the links within clusters. sets: node, grams; clusters: node, n, cluster."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("many"), F.sum("n").alias("grams"))
    size = stored(size.withColumn("large", (F.col("many") > TILE) | (F.col("grams") > TILE_GRAMS)), "clusters")
    seen = size.agg(F.coalesce(F.sum(F.when(~F.col("large"), F.col("grams"))), F.lit(0)), F.coalesce(F.max("large"), F.lit(False))).first()
    rows = clusters.select("node", "cluster").join(size.select("cluster", "large"), "cluster").join(sets, "node").select("cluster", "node", "grams", "large")
    # clusters of one tile share meetings
    shares = max(1, -(-int(seen[0]) // SHARE_GRAMS))
    small = rows.filter(~F.col("large")).withColumn("side", F.lit(0)).withColumn("meeting", F.pmod(F.xxhash64("cluster"), F.lit(shares)))
    links = [small.groupBy("meeting").applyInPandas(_meet(threshold), "a long, b long")]
    if seen[1]:
        links += _large(stored(rows.filter("large").drop("large"), "large"), threshold)
    return reduce(DataFrame.unionByName, links)


def _grams(texts: DataFrame, n_words: int) -> DataFrame:
    """node, grams: the sorted set, as bytes."""

    def run(batches):
        for batch in batches:
            for a, b, h, first in _sets(batch.column(1), n_words):
                grams = [h[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(grams, pa.binary())], names=["node", "grams"])

    return texts.mapInArrow(run, "node long, grams binary")


def jaccard_join(docs: DataFrame, ident: str = "doc_id", text: str = "text", n_words: int = N_WORDS, threshold: tuple[int, int] = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (the ident when None) of every row, with n_shingles, component_id (the smallest ident reachable by links)
    and kept: true for one row of each component, that with the smallest ident, and for rows with an empty set."""
    carry = [c for c in ([ident] if carry is None else carry) if c not in ("n_shingles", "component_id", "kept")]
    given = docs.select(*[F.col(c).alias(f"in_{c}") for c in dict.fromkeys([*carry, ident, text])])
    # written at once, so that the rows' numbers stay
    marked = stored(describe(given, f"in_{text}", n_words, threshold).withColumn("row", F.monotonically_increasing_id()), "sets")
    i = F.col(f"in_{ident}")
    sized = marked.filter("node is not null").groupBy("node").agg(F.min(F.struct(i.isNull().alias("none"), i.alias("id"), F.col("row"))).alias("head"), F.max("n_shingles").alias("n"))
    classes = stored(sized, "classes")
    texts = marked.filter("node is not null").select("row", "node", F.col(f"in_{text}").alias("text"))
    grams = marked.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    near = components(candidates(texts.select("node", "text"), int(grams), n_words, threshold))
    # a component's own smallest member has no row of its own
    clusters = near.select("node", F.col("component").alias("cluster")).union(near.select("component", "component").distinct())
    clusters = stored(clusters.join(classes.select("node", "n", "head.row"), "node"), "near")
    clusters = _sieved(clusters, marked.select("row", "band", "sketch"), threshold)
    # one row for each different set that has a candidate
    sets = _grams(texts.join(clusters.select("row"), "row", "left_semi").select("node", "text"), n_words)
    linked = components(_links(sets, clusters, threshold))
    of = classes.join(linked, "node", "left").select("node", "head", F.coalesce("component", "node").alias("component"))
    first = of.groupBy("component").agg(F.min("head").alias("first"))
    out = marked.join(of.select("node", "component").join(first, "component").select("node", "first"), "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        *[F.col(f"in_{c}").alias(c) for c in carry],
        "n_shingles",
        F.when(alone, i).otherwise(F.col("first.id")).alias("component_id"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
    )
