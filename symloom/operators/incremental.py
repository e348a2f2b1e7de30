"""Processing only new or changed records: Merkle tree over key-range hashes.

A feed keeps, per committed run, a digest tree over equal ranges of the hashed key space and the
entries that the run changed. A run brings a view of all records or only the records it saw; the
digests of the leaves those lie in are worked out anew (combined before the shuffle), all others are
those of the saved tree. The run walks the saved and the current tree from the root, descends only
where their digests differ, extracts the rows of the differing leaves that differ from the saved
entries and publishes them and the new tree together: both lie in one version folder that counts
only once the commit file of its place in the order exists, which one writer alone can create.

A change of few keys reads the leaves of those keys. Changes spread evenly over more keys than there
are leaves touch every leaf, and then a run reads all saved entries. Entries are sorted by leaf, so
files skip what is outside, and every few runs they are compacted to the newest of each key.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.runtime import Files

def _digest(x: object) -> bytes:
    return hashlib.blake2b(repr(x).encode(), digest_size=16).digest()


ENTRY_SCHEMA = "key string, digest string, leaf long, op string, version long, seq long"
COMPACT_EVERY = 8  # commits


class MerkleFeed:
    """Exactly-once extraction of new, changed and removed records.

    ``root``: folder of the feed. ``fanout ** depth`` is the number of leaves; the tree is the only
    thing the driver holds, and at most 65,536 leaves are allowed. More keys mean more keys a leaf,
    never more leaves at the driver.

    Defined cases: a null key is no record and is left out; a null digest is a value of its own; a
    view with several rows of one key is a caller's error (reduce it with :func:`latest_versions`).
    A run that dies before its commit leaves a folder no reader looks at; the next run with the same
    or another number starts from the last committed state. A compaction that dies is done without. Committing a run number again is refused.
    """

    def __init__(self, spark: SparkSession, root: str, fanout: int = 16, depth: int = 3):
        if fanout & (fanout - 1) or fanout**depth > 65_536:
            raise ValueError("fanout must be a power of two and fanout ** depth at most 65,536")
        self.spark, self.root, self.fanout, self.depth = spark, root.rstrip("/"), fanout, depth
        self.bits = (fanout.bit_length() - 1) * depth
        self.step = fanout.bit_length() - 1
        self.files = Files(spark, self.root)

    # state -----------------------------------------------------------------------------------

    def committed(self) -> list[int]:
        """Run numbers in the order of their commits."""
        named = (self.files.read_text(f"{self.root}/commits/{name}") for name in self.files.children(f"{self.root}/commits"))
        return [int(text) for text in named if text]

    def _folder(self, version: int) -> str:
        return f"{self.root}/v{version:012d}"

    def _saved(self, version: int) -> dict:
        return json.loads(self.files.read_text(f"{self._folder(version)}/tree.json"))

    def saved_tree(self) -> dict[int, tuple[int, int, int]]:
        done = self.committed()
        return {leaf: (n, a, b) for leaf, n, a, b in self._saved(done[-1])["leaves"]} if done else {}

    def output(self) -> DataFrame:
        """All published rows of all committed runs: key, digest, leaf, op, version, seq (place of the run in the order)."""
        return self._entries([f"{self._folder(v)}/output" for v in self.committed()])

    def _entries(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self.spark.read.schema(ENTRY_SCHEMA).parquet(*paths)

    def live(self, leaves: list[int] | None = None) -> DataFrame:
        """key, digest, leaf of the records after the last commit, in the given leaves."""
        newest = self._newest(leaves).where("op <> 'removed'")
        return newest.select("key", "digest", "leaf")

    def _newest(self, leaves: list[int] | None = None) -> DataFrame:
        done = self.committed()
        upto = len(done) // COMPACT_EVERY * COMPACT_EVERY
        base = f"{self.root}/compact/{upto:08d}"
        if not (upto and self.files.exists(f"{base}/_SUCCESS")):
            upto = 0
        rows = self._entries([base] * bool(upto) + [f"{self._folder(v)}/output" for v in done[upto:]])
        rows = rows if leaves is None else self._in_leaves(rows, leaves)
        rest = [c for c in rows.columns if c not in ("key", "seq")]
        newest = rows.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("m"), F.max("seq").alias("seq"))
        return newest.select("key", *(F.col(f"m.{c}").alias(c) for c in rest), "seq")

    def _compact(self, n: int) -> None:
        """The newest entry of each key after ``n`` commits, sorted by leaf; a reader uses it once it is whole."""
        rows = self._newest().select(*(c.split()[0] for c in ENTRY_SCHEMA.split(", ")))
        rows.repartitionByRange("leaf").sortWithinPartitions("leaf").write.mode("overwrite").parquet(f"{self.root}/compact/{n:08d}")

    # tree ------------------------------------------------------------------------------------

    def with_leaf(self, view: DataFrame) -> DataFrame:
        """key, digest, leaf: the leaf is the key's range in the hashed key space."""
        return view.select(
            F.col("key").cast("string").alias("key"),
            F.col("digest").cast("string").alias("digest"),
        ).where(F.col("key").isNotNull()).withColumn("leaf", F.shiftrightunsigned(F.xxhash64("key"), 64 - self.bits))

    @staticmethod
    def leaf_digests(keyed: DataFrame) -> DataFrame:
        """Two independent order-free 64-bit sums a leaf, combined before the shuffle."""
        entry = F.xxhash64("key", F.coalesce("digest", F.lit("\0")), F.col("digest").isNull())
        return keyed.groupBy("leaf").agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(entry).alias("a"),
            F.sum(F.hash("key", "digest").cast("long")).alias("b"),
        )

    def tree_levels(self, leaves: dict[int, tuple[int, int, int]]) -> list[dict[int, bytes]]:
        """Node digests from the root (level 0) to the leaves, folded upward."""
        levels = [{leaf: _digest(v) for leaf, v in leaves.items()}]
        for _ in range(self.depth):
            parents: dict[int, list[tuple[int, bytes]]] = {}
            for node, digest in levels[0].items():
                parents.setdefault(node >> self.step, []).append((node, digest))
            levels.insert(0, {p: _digest(sorted(c)) for p, c in parents.items()})
        return levels

    def descend(self, saved: dict, current: dict) -> list[int]:
        """Leaves whose digests differ; a subtree with equal digests is never entered."""
        old, new = self.tree_levels(saved), self.tree_levels(current)
        open_nodes = [n for n in {*old[0], *new[0]} if old[0].get(n) != new[0].get(n)]
        for level in range(1, self.depth + 1):
            open_nodes = [
                child
                for node in open_nodes
                for child in range(node << self.step, (node + 1) << self.step)
                if old[level].get(child) != new[level].get(child)
            ]
        return sorted(open_nodes)

    # a run -----------------------------------------------------------------------------------

    def stage(self, version: int, view: DataFrame, whole: bool = True) -> int:
        """Write the run's output and tree, uncommitted; returns the number of leaves entered.

        ``whole``: the view holds all records, and those that it lacks were removed. Otherwise it holds
        only the records the run saw, and all others are as they were.
        """
        done, saved = self.committed(), self.saved_tree()
        if version in done:
            raise ValueError(f"run {version} is committed already")
        folder = self._folder(version)
        self.files.delete(folder)
        keyed, touched = self.with_leaf(view), None
        if not whole:
            touched = sorted(r.leaf for r in keyed.select("leaf").distinct().collect())  # at most fanout ** depth numbers
        was = self.live(touched).select(F.col("key").alias("was_key"), F.col("digest").alias("was_digest"), F.col("leaf").alias("was_leaf"))
        both = keyed.join(was, keyed.key == was.was_key, "full_outer").select(
            F.coalesce("key", "was_key").alias("key"), "digest", "was_digest", F.coalesce("leaf", "was_leaf").alias("leaf"),
            F.col("key").isNotNull().alias("seen"), F.col("was_key").isNotNull().alias("known"),
        )
        both.write.mode("overwrite").parquet(f"{folder}/compared")
        both = self.spark.read.schema(both.schema).parquet(f"{folder}/compared")
        now = both.where("seen") if whole else both
        now = now.select("key", F.when(F.col("seen"), F.col("digest")).otherwise(F.col("was_digest")).alias("digest"), "leaf")
        # at most fanout ** depth rows of four numbers
        fresh = {r.leaf: (r.n, r.a, r.b) for r in self.leaf_digests(now).collect()}
        current = fresh if touched is None else {k: v for k, v in saved.items() if k not in set(touched)} | fresh
        changed = self.descend(saved, current)
        op = (
            F.when(~F.col("known"), "new")
            .when(~F.col("seen"), F.lit("removed") if whole else F.lit(None))
            .when(~F.col("digest").eqNullSafe(F.col("was_digest")), "changed")
        )
        rows = self._in_leaves(both, changed).select("key", "digest", "leaf", op.alias("op"), F.lit(version).cast("long").alias("version"), F.lit(len(done)).cast("long").alias("seq"))
        rows.where("op is not null").sortWithinPartitions("leaf").write.mode("overwrite").parquet(f"{folder}/output")
        self.files.delete(f"{folder}/compared")
        self.files.write_text(f"{folder}/tree.json", json.dumps({"after": len(done), "leaves": [[k, *v] for k, v in sorted(current.items())]}))
        return len(changed)

    def commit(self, version: int) -> None:
        """Publish output and tree of a staged run in one step, as the next in the order.

        Of two runs that were staged after the same commit only one gets the place; the other is refused
        and must be staged again.
        """
        if not self.files.exists(f"{self._folder(version)}/tree.json"):
            raise ValueError(f"run {version} is not staged")
        n = len(self.committed())
        if self._saved(version)["after"] != n:
            raise ValueError(f"run {version} was staged before the last commit")
        self.files.create_text(f"{self.root}/commits/{n:08d}", str(version))
        if (n + 1) % COMPACT_EVERY == 0:
            self._compact(n + 1)

    def run(self, version: int, view: DataFrame, whole: bool = True) -> int:
        entered = self.stage(version, view, whole)
        self.commit(version)
        return entered

    def _in_leaves(self, df: DataFrame, leaves: list[int]) -> DataFrame:
        if len(leaves) == self.fanout**self.depth:
            return df
        ranges, start = [], None
        for leaf in leaves:  # successive leaves become one range: few predicates, pushed to the scan
            if start is not None and leaf == ranges[-1][1] + 1:
                ranges[-1][1] = leaf
            else:
                ranges.append([leaf, leaf])
            start = leaf
        if len(ranges) > 64:
            wanted = self.spark.createDataFrame([(x,) for x in leaves], "leaf long")
            return df.join(F.broadcast(wanted), "leaf", "left_semi").select(*df.columns)  # at most 65,536 numbers
        keep = F.lit(False)
        for a, b in ranges:
            keep = keep | F.col("leaf").between(a, b)
        return df.where(keep)


def latest_versions(rows: DataFrame, version: str, key: str, value: str, order: list[str]) -> DataFrame:
    """One row per (version, key): the one that is last by ``order``; the value becomes a digest.

    Null values count as empty text, as in the data's own definition. Combined before the shuffle, so
    a key that holds a large share of the rows leaves one row a partition.
    """
    digest = F.sha2(F.coalesce(F.col(value), F.lit("")), 256)
    picked = F.max(F.struct(*(F.col(c) for c in order), digest.alias("__digest")))
    return (
        rows.where(F.col(key).isNotNull() & F.col(version).isNotNull())
        .groupBy(F.col(version).alias("version"), F.col(key).alias("key"))
        .agg(picked.alias("__last"))
        .select("version", "key", F.col("__last.__digest").alias("digest"))
    )
