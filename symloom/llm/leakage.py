"""Evaluation texts leaking into training text: Wu-Manber search over words, then comparison.

Patterns are all runs of ``PATTERN`` words of the test items. The shift table is keyed by blocks of
two words; positions whose block ends no pattern are skipped, the others select a bucket by the
block that ends the pattern and the first word, and the run itself is compared. A passage of 20
words of which two are changed or left out still holds a run of six, so each such passage is met.
Where an item's runs gather along one diagonal, the passage is compared word by word: the longest
common subsequence of an item window and the text beside it, by bit-parallel addition.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.words import words
from symloom.runtime import Scratch

PATTERN = 5
BLOCK = 2
# window of item words, words of it that must be there: one in eight may be changed or left out. A passage of any
# n >= 20 words with at most n // 8 changes holds one of these: 20 to 23, 24 to 31 and 32 to 39 words the first, second
# and third; in 40 or more, stretches of 20, 24 or 32 side by side would need more changes than the passage may have.
WINDOWS = ((20, 18), (24, 21), (32, 28))
MIN_RUNS = 4  # no more than the runs of five words that survive: 6 of 16, 5 of 20 and 8 of 28
BAND = 12  # words that a passage may drift from its diagonal by words left out or put in
BLOCK_WORDS = 2_000_000  # words of test items searched for in one pass over the documents


def opening(text: str | None) -> bytes:
    """Words of a text's first sentence."""
    return b" ".join(words(re.split(r"(?<=[.?!:])\s", (text or "").lstrip(), maxsplit=1)[0]))


def item_words(items: DataFrame) -> DataFrame:
    """item_id, words, n: the words, parted by blanks, of each (item_id, suite, text) without the sentence its suite opens with.

    A first sentence is an instruction if at least half of a suite's items, and at least two, have it.
    Repeated items count once (the greatest suite and text); items without id or words are left out.
    """
    once = items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max(F.struct("suite", "text")).alias("m")).select("item_id", "m.suite", "m.text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            first, all_words = [opening(t) for t in texts], [b" ".join(words(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(first, pa.binary()), pa.array(all_words, pa.binary())], ["item_id", "suite", "first", "words"])

    rows = once.mapInArrow(read, "item_id long, suite string, first binary, words binary").withColumn("suite", F.struct("suite"))
    per = rows.groupBy("suite", "first").agg(F.count(F.lit(1)).alias("k"))
    size = per.groupBy("suite").agg(F.sum("k").alias("all"))
    told = per.join(size, "suite").where("k >= 2 and 2 * k >= all").select("suite", "first", F.lit(True).alias("told"))
    rest = F.when(F.col("told"), F.expr("substring(words, length(first) + 2)")).otherwise(F.col("words"))
    out = rows.join(told, ["suite", "first"], "left").select("item_id", rest.alias("words")).where(F.octet_length("words") > 0)
    return out.withColumn("n", F.size(F.split(F.col("words").cast("string"), " ")))


class Searcher:
    """Shift and bucket tables of a set of items."""

    def __init__(self, items: dict[int, list[bytes]]):
        vocabulary: dict[bytes, int] = {}
        self.items = {i: [vocabulary.setdefault(w, len(vocabulary)) for w in ws] for i, ws in items.items()}
        self.vocabulary = vocabulary
        self.base = len(vocabulary) + 1  # unknown words are -1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = {}
        m, base, shift = PATTERN, self.base, self.shift
        for i, ids in self.items.items():
            for p in range(len(ids) - m + 1):
                run = tuple(ids[p : p + m])
                for q in range(BLOCK, m + 1):
                    block = run[q - 2] * base + run[q - 1]
                    if m - q < shift.get(block, m):
                        shift[block] = m - q
                self.buckets.setdefault(run[-2] * base + run[-1], {}).setdefault(run, []).append((i, p))

    def runs(self, ids: list[int]) -> dict[int, list[tuple[int, int]]]:
        """item -> (item position, text position) of every run of the item in the text."""
        found: dict[int, list[tuple[int, int]]] = {}
        shift, buckets, base, m = self.shift.get, self.buckets, self.base, PATTERN
        most, n, at = m - BLOCK + 1, len(ids), m - 1
        while at < n:
            block = ids[at - 1] * base + ids[at]
            step = shift(block, most)
            if step:
                at += step
                continue
            for i, p in buckets[block].get(tuple(ids[at - m + 1 : at + 1]), ()):
                found.setdefault(i, []).append((p, at - m + 1))
            at += 1
        return found

    def leaks(self, text: str | None) -> list[int]:
        """Items of which the text holds a passage."""
        return self.in_words(words(text))

    def in_words(self, text: list[bytes]) -> list[int]:
        get = self.vocabulary.get
        ids = [get(w, -1) for w in text]
        if len(ids) < WINDOWS[0][1]:
            return []
        out = []
        for i, hits in self.runs(ids).items():
            if len(hits) >= MIN_RUNS and self._passage(self.items[i], ids, hits):
                out.append(i)
        return out

    def _passage(self, item: list[int], ids: list[int], hits: list[tuple[int, int]]) -> bool:
        bands: dict[int, set[int]] = {}
        where: dict[int, list[tuple[int, int]]] = {}
        for p, q in hits:
            b = (q - p) // BAND
            for x in (b, b + 1):  # each band overlaps its neighbour by half
                bands.setdefault(x, set()).add(p)
                where.setdefault(x, []).append((p, q))
        for x, starts in bands.items():
            if len(starts) >= MIN_RUNS and self._compare(item, ids, sorted(where[x])):
                return True
        return False

    @staticmethod
    def _compare(item: list[int], ids: list[int], hits: list[tuple[int, int]]) -> bool:
        # item words that occur beside the hits at all bound what any window can share
        beside = set(ids[max(0, min(q for _, q in hits) - 40) : max(q for _, q in hits) + 40])
        upto = [0, *accumulate(x in beside for x in item)]
        diagonals: dict[int, set[int]] = {}
        for p, q in hits:
            diagonals.setdefault(p, set()).add(q - p)
        starts = sorted(diagonals)
        before = [0, *accumulate(p in diagonals for p in range(len(item)))]
        for size, needed in WINDOWS:
            for p in range(max(0, starts[0] + PATTERN - size), min(starts[-1], len(item) - size) + 1):
                # the runs in a window tell how many of its words can be there
                if before[p + size - PATTERN + 1] - before[p] < MIN_RUNS or upto[p + size] - upto[p] < needed:
                    continue
                inside = starts[bisect_left(starts, p) : bisect_right(starts, p + size - PATTERN)]
                for q in {p + x for s in inside for x in diagonals[s]}:
                    near = ids[max(0, q - size // 4) : q + size + size // 4]
                    if common_words(item[p : p + size], near) >= needed:
                        return True
        return False


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; unknown words (-1) match nothing."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        if y >= 0:
            places[y] = places.get(y, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        m = places.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def leaked_items(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, item_id: documents (doc_id, text) that hold a passage of an item (item_id, suite, text).

    The items are made words and dealt to blocks of about ``BLOCK_WORDS`` words by the executors; a block at
    a time passes the driver, which turns it into the tables that all tasks share. The documents are never
    shuffled, and are made words only once: written so where there are several blocks, each a pass over them.
    Null or short texts hold nothing; a null doc_id is left out.
    """
    listed = scratch.save(item_words(items), "items")
    n = -(-(listed.agg(F.sum("n")).collect()[0][0] or 0) // BLOCK_WORDS)
    if not n:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long")
    listed = listed.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
    texts, ready = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null"), False
    if n > 1:
        listed = scratch.save_by(listed, "block", "blocks")
        texts, ready = scratch.save(texts.mapInArrow(_folded, "doc_id long, words binary"), "words"), True
    out = None
    for at in range(n):
        block = {r.item_id: bytes(r.words).split() for r in listed.where(F.col("block") == at).toLocalIterator()}
        part = _pass(texts, Searcher(block), ready)
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["doc_id", "item_id"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [b" ".join(words(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["doc_id", "words"])


def _pass(texts: DataFrame, searcher: Searcher, ready: bool) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(searcher)  # about BLOCK_WORDS words
    split = bytes.split if ready else words

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaks = shared.value.in_words
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = leaks(split(text))
                ids += [doc] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

    return texts.mapInArrow(search, "doc_id long, item_id long")
