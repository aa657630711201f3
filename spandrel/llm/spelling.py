"""Spelling variants: words one edit apart, each with the more frequent word it varies.

1. Runs of letters are counted over all texts (planted misspellings included).
2. A positional q-gram index finds words one edit apart. A word of n letters, padded, has n + Q - 1 q-grams, and one edit destroys at most Q of
   them. So two words one edit apart share all but Q q-grams of the longer (the count filter), at places that differ by one at most and by none
   where lengths are equal. They also share one of each one's Q + 1 rarest, so the index is cut there: a shard has the words of one length with a
   rare q-gram at one place, and those one letter longer that have it there or one place on.
3. In a shard, each word's postings are merged; words that occur in enough of them are candidates and are compared letter by letter. The postings of
   many words are merged at once, by sorting, where a heap would merge those of one word after the other.
4. A word's form is its most frequent near word, if that is at least twice as frequent. Forms lead to roots; as counts double at
   each step, doubling the steps needs at most six joins.

Only words travel, never their occurrences, so a frequent word is no larger than another. A shard grows with the number of words that
share their rarest q-grams with place and length.

Defined cases: a null or empty text has no words; a null doc_id counts as the empty string in the hash of planted misspellings; repeated
rows count as often as they stand; ties go to the first word in code-point order; an empty table gives an empty result; words of any length are
compared whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, ascii_lower, settled, stored
from .exchange import by_key, runs
from .textops import mix64, string_parts

#: Letters of words; the number of different ones, with the padding.
LETTERS = r"[A-Za-zÀ-ÿ]+"
ALPHABET = 26 + 64 + 1
#: Letters to a q-gram.
Q = 3
#: Words have so many letters and occurrences at least.
SHORTEST, LEAST = 5, 3
#: One run in so many loses a letter.
PLANTED = 97
#: So many entries of postings are counted at a time.
PAIRS = 2 << 20
#: A form is so many times as frequent as its variant.
TIMES = 2


def spelled(run: Column, ident: Column) -> Column:
    """A run as it is counted: where PLANTED divides the hash of its document and itself, one letter is missing."""
    h = F.crc32(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % PLANTED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word and n of every word with enough letters and occurrences."""
    runs = docs.select(F.col(ident).alias("of"), F.explode(F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.select(spelled(F.col("run"), F.col("of")).alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of padded words: every q-gram, its word, its place, and each word's length."""
    offsets, raw = string_parts(words)
    lead = (raw & 0xC0) != 0x80  # letters beyond ASCII are C3 80 to C3 BF
    letter = np.where(raw < 0x80, raw - np.uint8(96), 27 + (np.append(raw[1:], 0) & 0x3F)).astype(np.int64)[lead]
    size = np.diff(np.concatenate([[0], np.cumsum(lead)])[offsets])
    word = np.repeat(np.arange(len(size)), size)
    start = np.concatenate([[0], np.cumsum(size + 2 * (Q - 1))])
    padded = np.zeros(start[-1], np.int64)
    padded[start[word] + Q - 1 + np.arange(len(letter)) - np.repeat(np.cumsum(size) - size, size)] = letter
    gram = np.zeros(max(len(padded) - Q + 1, 0), np.int64)
    for k in range(Q):
        gram = gram * ALPHABET + padded[k : k + len(gram)]
    of = np.repeat(np.arange(len(size)), size + 2 * (Q - 1))[: len(gram)]
    place = np.arange(len(gram)) - start[of]
    there = place < (size + Q - 1)[of]
    return gram[there], of[there], place[there], size


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ALPHABET**Q, np.int64)
    for batch in batches:
        total += np.bincount(_grams(batch.column(0))[0], minlength=len(total))
    gram = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(total[gram], pa.int64())], names=["gram", "n"])


def _order(words: DataFrame) -> np.ndarray:
    """The place of each q-gram when sorted by frequency; there are no more than the alphabet allows."""
    rows = words.select("word").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(ALPHABET**Q, np.int64)
    total[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    order = np.empty(len(total), np.int32)
    order[np.argsort(total, kind="stable")] = np.arange(len(total))
    return order


def _shard(gram: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each q-gram, length and place. Two that meet only make a shard larger."""
    h = mix64(gram.astype(np.uint64))
    for x in (size, place):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    return h.view(np.int64)


def _dealt(order: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word for the shards of its rarest q-grams: of its own length (home), and of one letter less."""
    for batch in batches:
        gram, of, place, size = _grams(batch.column(0))
        by = np.lexsort((place, order[gram], of))
        first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(size)))])
        rare = by[np.arange(len(by)) - first[of[by]] <= Q]
        g, w, p = gram[rare], of[rare], place[rare]
        guest = size[w] > 1
        keys = [_shard(g, size[w], p), _shard(g[guest], size[w][guest] - 1, p[guest]), _shard(g[guest], size[w][guest] - 1, p[guest] - 1)]
        rows = np.concatenate([w, w[guest], w[guest]])
        home = np.arange(len(rows)) < len(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(home), *(c.take(pa.array(rows)) for c in batch.columns)], names=["shard", "home", "word", "n"])


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with one letter replaced or inserted; b is as long as a or one longer."""
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return k < len(a) and a[k + 1 :] == b[k + 1 :]
    return a[k:] == b[k + 1 :]


def _candidates(words: pa.Array, group: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (a home word, and a later home word or a guest of the same group) that share enough q-grams at fitting places."""
    gram, of, place, size = _grams(words)
    posting = lambda at, shift: group[of[at]] << 44 | gram[at] << 24 | (place[at] - shift)
    mine, other = np.flatnonzero(home[of]), np.flatnonzero(~home[of])
    later = other[place[other] > 0]
    key = np.concatenate([posting(mine, 0), posting(other, 0), posting(later, 1)])
    row = np.concatenate([of[mine], of[other], of[later]])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = runs(ordered)
    length = np.diff(np.append(begin, len(key)))
    run = np.empty(len(key), np.int64)
    run[order] = np.repeat(np.arange(len(begin)), length)
    run = run[: len(mine)]
    n = length[run]
    total = np.concatenate([[0], np.cumsum(n)])
    edge = np.concatenate([np.flatnonzero(np.diff(of[mine], prepend=-1)), [len(mine)]])  # where each home word's q-grams begin
    a = 0
    while a < len(edge) - 1:
        b = max(a + 1, int(np.searchsorted(total[edge], total[edge[a]] + PAIRS, "right")) - 1)
        x, y = edge[a], edge[b]
        i = np.repeat(of[mine[x:y]], n[x:y])
        j = row[order[np.arange(total[y] - total[x]) + np.repeat(begin[run[x:y]] - (total[x:y] - total[x]), n[x:y])]]
        some = ~home[j] | (j > i)
        pair, often = np.unique(i[some] * len(size) + j[some], return_counts=True)
        i, j = pair // len(size), pair % len(size)
        # of the longer word's q-grams, Q may be lost
        enough = often >= np.where(home[j], size[i] - 1, size[i])
        yield i[enough], j[enough]
        a = b


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways round, of rows sorted by shard."""
    for rows in by_key(batches, ["shard"]):
        shard, home = rows["shard"].to_numpy(), rows["home"].to_numpy()
        group = np.cumsum(np.diff(shard, prepend=shard[0]) != 0)
        # a shard without a home word, or with nothing else, has no pairs
        some = (np.bincount(group)[group] > 1) & (np.bincount(group, weights=home)[group] > 0)
        rows, group, home = rows.filter(pa.array(some)), group[some], home[some]
        words, n = rows["word"].combine_chunks(), rows["n"].to_numpy()
        if not len(group):
            continue
        for i, j in _candidates(words, group - group[0], home):
            a, b = words.take(pa.array(i)).to_pylist(), words.take(pa.array(j)).to_pylist()
            near = np.array([one_edit(x, y) for x, y in zip(a, b, strict=True)], bool)
            i, j = i[near], j[near]
            one, two = words.take(pa.array(i)), words.take(pa.array(j))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([one, two]), pa.concat_arrays([two, one]), pa.array(np.concatenate([n[j], n[i]]))], names=["word", "other", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, other and other's count n of all pairs of words that are one edit apart, both ways round. words: word and n, one row each."""
    spark = words.sparkSession
    order = Shared(spark, _order(words))
    dealt = words.select("word", "n").mapInArrow(lambda batches: _dealt(order.value, batches), "shard long, home boolean, word string, n long")
    pairs = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_paired, "word string, other string, n long")
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root: from each word, form after form to the last. forms: word and form, without circles."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not new.filter("moved").limit(1).count():
            return now
        now = new.drop("moved")


def spelling_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """word, n, form, form_n, n_near and root of every word."""

    def made() -> DataFrame:
        words = stored(word_counts(docs, ident, text, shortest, least), "spelling-words")
        best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best"))
        out = words.join(best, "word", "left")
        led = -F.col("best.n") >= times * F.col("n")
        out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best.other")).alias("form"), F.when(led, -F.col("best.n")).alias("form_n"))
        out = stored(out, "spelling-forms")
        ends = roots(out.filter(F.col("form").isNotNull()))
        return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

    return settled(docs.sparkSession, "spelling", made)
