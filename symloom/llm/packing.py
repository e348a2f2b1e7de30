"""Filling fixed-capacity containers: hierarchical residual packing.

Each partition packs its items by best fit, largest first, and emits the bins that are nearly full.
The other bins travel on as items to fewer partitions, where they are packed again, up a tree of
merges that ends in one partition.

No task of the tree is unbounded, though no bin is withheld that could still be used. Best fit leaves
at most one bin of a partition that is half full or less, and only such a bin can be put into another
one. So where ``MERGE`` partitions meet, at most ``MERGE`` small bins look for room, and of the bins
of one size more than ``MERGE`` can never be needed: the others are final. A merge therefore takes at
most ``MERGE * MERGE`` bins of each size, whatever the number of items.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.runtime import Scratch

CAPACITY = 2_048
NEARLY_FULL = 0.995
MERGE = 4  # partitions merged into one, a round
TASK_ITEMS = 100_000  # items packed by one task before the merges, about


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The public byte-level BPE; ``path`` names another rank file."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, n: one row a text, or several of ``capacity`` tokens where it exceeds that.

    Null and empty texts have no tokens and need no room: they have no row. Rows of one doc_id are
    told apart by nothing, so doc_id must be unique; a null doc_id is left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total = len(encode(text.encode("utf-8", "replace").decode("utf-8")))
                rows += [(doc, k, at, min(capacity, total - at)) for k, at in enumerate(range(0, total, capacity))]
            cols = list(zip(*rows)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "n"])

    docs = docs.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(count, "doc_id long, piece int, start long, n int")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indexes: items by falling size, each into the fullest bin that still takes it."""
    room_bits = 0  # bit r is set while some bin has exactly r left
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = room_bits >> sizes[i]
        if fits:
            room = sizes[i] + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                room_bits &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - sizes[i]
        by_room.setdefault(left, []).append(b)
        room_bits |= 1 << left
    return bins


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY, tasks: int = 8) -> DataFrame:
    """doc_id, piece, start, n, bin_id, fill: every piece with its bin.

    ``bin_id`` is the smallest "doc_id:piece" of the bin, so it does not depend on the order of work.
    """
    schema = "node int, size int, home long, travels boolean, members array<struct<doc_id:bigint,piece:int,start:bigint,n:int>>"
    names = ["node", "size", "home", "travels", "members"]
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n", pa.int32())]))
    full = math.floor(capacity * NEARLY_FULL)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]  # one node's rows: bounded, see above
        if not rows:
            return
        node = rows[0][0]
        rows.sort(key=lambda r: (-r[1], r[2], r[3][0]["piece"]))
        out, same = [], Counter()
        for b in best_fit([r[1] for r in rows], capacity):
            size = sum(rows[i][1] for i in b)
            same[size] += 1
            out.append((node // MERGE, size, min(rows[i][2] for i in b), size < full and same[size] <= MERGE, [m for i in b for m in rows[i][3]]))
        for at in range(0, len(out), 10_000):
            cols = zip(*out[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), kind))], names)

    items = scratch.save(items, "pieces")
    parts = max(tasks, math.ceil(items.count() / TASK_ITEMS))
    node = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    rows = items.select(node.alias("node"), F.col("n").alias("size"), F.col("doc_id").alias("home"), F.array(F.struct("doc_id", "piece", "start", "n")).alias("members"))
    done = []
    while True:
        packed = scratch.save(rows.repartitionById(parts, F.col("node")).mapInArrow(pool, schema), "bins")
        if parts == 1:
            done.append(packed)
            break
        done.append(packed.where("not travels"))
        rows, parts = packed.where("travels").drop("travels"), math.ceil(parts / MERGE)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    lowest = F.array_min(F.transform("members", lambda m: F.struct(m.doc_id, m.piece)))
    bin_id = F.concat_ws(":", lowest.doc_id, lowest.piece)
    return out.select("size", bin_id.alias("bin_id"), F.explode("members").alias("m")).select("m.*", "bin_id", F.col("size").alias("fill"))
