"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point, and the frequent word that each belongs to.

Two words with one edit at a known place share what is before it and what is behind it.  For words of one
length and those that are one shorter, two orders are kept: of the words, and of the words read backwards.  The
words with a given head are an interval of the first, the words with a given tail one of the second; a wavelet matrix holds each word's place in
the second order by its place in the first, and reports the words in both intervals, level by level, for all
words and one edit place at a time.  Replaced signs are found from both words, a deleted one from the longer word, at the first of equal neighbours.

The words are dealt to shards so that two near words meet once: places of an edit fall into PARTS stretches of the
longer word, and all that lies outside the stretch is the same in both.  Shards are hashes of that, so their sizes do not follow common heads or tails, and their number
follows the size of the vocabulary.  A shard returns one row for each word with near ones: how many, and the most frequent.

Rows: a null or empty text has no runs; a null doc_id is written as an empty string before the colon; repeated rows count each; ties of frequency go to the
smallest word; an empty table gives an empty one; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, shared
from .fmindex import WaveletMatrix

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points and occurrences of a word, and how many times as frequent as a word its form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Stretches of a word in which an edit may lie; a shard's words agree outside of one.
PARTS = 3
#: Code points of a shard's words, on average.
SHARD_CHARS = 1 << 16


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id and run for every maximal run of letters of at least so many code points, lower-cased."""
    found = F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}+"), F.lit(0)))
    return docs.select("doc_id", found.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def misspelt(doc_id: Column, run: Column, every: int = 199) -> Column:
    """The run, without one code point where the checksum of its document and itself says so."""
    h, n = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary")), F.length(run)
    at = (h % n).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, n))).otherwise(run)


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of a table of occurrences (word)."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def shared_signs(words: np.ndarray) -> np.ndarray:
    """Signs that each of the sorted words shares with the one before it; -1 at both ends."""
    out = np.full(len(words) + 1, -1, dtype=np.int64)
    if len(words) > 1:
        table = words.view(np.uint32).reshape(len(words), -1)
        differ = table[1:] != table[:-1]
        out[1:-1] = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    return out


def intervals(shared_: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an order the interval of places that share so many signs with it."""
    edges = np.flatnonzero(shared_ < depth)
    at = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    return edges[at], edges[at + 1]


def reported(tree: WaveletMatrix, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two-dimensional range reporting: all (query, value) with a value from first up to last at a place from low up to high."""
    query, value = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)

    def ones(k: int, at: np.ndarray) -> np.ndarray:
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        return tree.ranks[k][block] + np.bitwise_count(tree.bits[k][block] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    for k, level in enumerate(range(tree.levels - 1, -1, -1)):
        a, b = ones(k, low), ones(k, high)
        query, value = np.concatenate([query, query]), np.concatenate([value, value + (1 << level)])
        low, high = np.concatenate([low - a, tree.zeros[k] + a]), np.concatenate([high - b, tree.zeros[k] + b])
        on = (low < high) & (value < last[query]) & (value + (1 << level) > first[query])
        query, value, low, high = query[on], value[on], low[on], high[on]
    return query, value


def stretch(length: int, part: int, parts: int = PARTS) -> tuple[int, int]:
    """First place of a stretch of a word and the place behind it."""
    return part * length // parts, (part + 1) * length // parts


def near(words: list[str], length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of near words of `length` signs and one less, with the edit at a place from low up to high of the longer one; each pair in both directions."""
    table = np.array(words, dtype=f"U{length}")
    back = np.array([w[::-1] for w in words], dtype=f"U{length}")
    order, back_order = np.argsort(table, kind="stable"), np.argsort(back, kind="stable")
    heads, tails = shared_signs(table[order]), shared_signs(back[back_order])
    place, back_place = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    place[order], back_place[back_order] = np.arange(len(words)), np.arange(len(words))
    tree = WaveletMatrix(back_place[order], max(1, (len(words) - 1).bit_length()))
    signs = table.view(np.uint32).reshape(len(words), -1)
    longer = signs[:, -1] != 0
    out = []
    for i in range(max(low, length - 1 - int(tails.max())), min(high, int(heads.max()) + 1)):
        begin, end = intervals(heads, i)
        first, last = intervals(tails, length - 1 - i)
        ask = np.flatnonzero(longer & (end[place] - begin[place] > 1) & (last[back_place] - first[back_place] > 1))
        if not len(ask):
            continue
        query, value = reported(tree, begin[place[ask]], end[place[ask]], first[back_place[ask]], last[back_place[ask]])
        a, b = ask[query], back_order[value]
        twice = (signs[a, i] == signs[a, i - 1]) if i else np.zeros(len(a), dtype=bool)
        replaced, deleted = longer[b] & (a != b), ~longer[b] & ~twice
        out += [(a[replaced], b[replaced]), (a[deleted], b[deleted]), (b[deleted], a[deleted])]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


_SHARD_SCHEMA = "word string, n_near bigint, best_n bigint, best string"


def _shard(table: pa.Table) -> pa.Table:
    """Near words of one shard (part, length, word, n): a row for each word that has some."""
    part = table.column("part")[0].as_py()
    lengths, counts, words = table.column("length").to_numpy(), table.column("n").to_numpy(), table.column("word").to_pylist()
    out: tuple[list, list, list, list] = ([], [], [], [])
    order = np.argsort(lengths, kind="stable")
    for of in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        length = int(lengths[of[0]])
        own, n = [words[k] for k in of], counts[of]
        if len(own) < 2 or max(map(len, own)) < length:
            continue
        a, b = near(own, length, *stretch(length, part))
        if not len(a):
            continue
        ranks = np.empty(len(own), np.int64)
        ranks[np.argsort(np.array(own, dtype=f"U{length}"), kind="stable")] = np.arange(len(own))
        by = np.lexsort((ranks[b], -n[b], a))
        which, at, times = np.unique(a[by], return_index=True, return_counts=True)
        best = b[by][at]
        for column, values in zip(out, ([own[k] for k in which], times.tolist(), n[best].tolist(), [own[k] for k in best]), strict=True):
            column += values
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Of a vocabulary (word, n): word, n_near, and the most frequent near word with its n, for words that have near ones."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    shards = 1 + 2 * PARTS * total // shard_chars
    roles = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("length"))
    roles = roles.select("*", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    low, high = F.expr(f"cast(part * length div {PARTS} as int)"), F.expr(f"cast((part + 1) * length div {PARTS} as int)")
    behind = F.col("length") - high
    outside = F.xxhash64("length", F.substring("word", F.lit(1), low), F.when(behind > 0, F.expr("substring(word, length(word) - (length - cast((part + 1) * length div %d as int)) + 1)" % PARTS)).otherwise(""))
    dealt = roles.select("part", F.pmod(outside, F.lit(shards)).alias("shard"), "length", "word", "n")
    found = dealt.groupBy("part", "shard").applyInArrow(_shard, _SHARD_SCHEMA)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("least")).select("word", "n_near", (-F.col("least.less")).alias("best_n"), F.col("least.best").alias("best"))


def variants(words: DataFrame, times: int = TIMES, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Of a vocabulary (word, n): word, n, n_near, form, form_n and root."""
    known = near_words(words, shard_chars)
    # Words are read before the join; every word has one row on either side.
    is_form = F.col("best_n") >= times * F.col("n")
    table = shared.written(
        words.join(known, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "variants"
    )
    roots = shared.written(table.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    # A form's frequency grows at least `times`-fold from step to step, so the doubled steps end after a few rounds.
    while True:
        hot = components.hot_keys(shared.written(roots.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > components.HOT).select("root"), "hot-roots"))
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = shared.written(components.joined(roots, onward, "root", hot).select("word", F.col("next").alias("root")), "roots")
        if not moved.limit(1).count():
            break
        new = shared.written(roots.join(moved.withColumnRenamed("root", "_to"), "word", "left").select("word", F.coalesce("_to", "root").alias("root")), "roots")
        shared.discard(roots, moved)
        roots = new
    return table.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's words: runs of letters, some with a code point left out, and their forms and roots."""
    words = runs(docs.select("doc_id", "text")).select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    return variants(shared.written(counted(words), "vocabulary"))
