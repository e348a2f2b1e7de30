"""References to records that do not exist: keyed orphan state, maintained batch by batch.

The state has one row per referred key: the first arrival and the first deletion of its parent, and
the entries of the rows that refer to it, one per (table, field, period) and batch with their number
and first and last arrival. Those summaries combine by sum, min and max, so a key that holds a large
share of all rows leaves one small row a partition before any shuffle, and a key's row grows with the
batches, not with the rows.

A batch is reduced to such rows and merged with the state of the keys it touches: new references meet
the key's parent there, an arriving parent resolves the entries that wait, a deletion reopens them.
Only touched keys are written, as a new version; each few batches the versions are compacted into a
base that is split by the key's hash, of which a batch reads only the parts it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.runtime import Scratch

KEY = ["part", "target", "key"]
COMPACT_EVERY = 6  # batches
ENTRY = "array<struct<tab:string,field_name:string,period:string,n:long,first_at:timestamp,last_at:timestamp,missing:boolean,late:boolean,deleted:boolean>>"
STATE = f"part int, target string, key long, first_in timestamp, first_out timestamp, entries {ENTRY}, version int"
DAY_US = 86_400_000_000


def period_of(at: Column) -> Column:
    """The calendar month in UTC, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(F.unix_micros(at) / F.lit(DAY_US)).cast("int"))
    return F.substring(day.cast("string"), 1, 7)


def references(df: DataFrame, tab: str, field: str, target: str, at: str = "loaded_at") -> DataFrame:
    """Referring rows in one shape. Keys of 0 or null refer to nothing; rows without time are left out."""
    return df.select(
        F.lit(target).alias("target"), F.lit(tab).alias("tab"), F.lit(field).alias("field_name"),
        F.col(field).cast("long").alias("ref_key"), F.col(at).alias("loaded_at"),
    ).where("ref_key is not null and ref_key <> 0 and loaded_at is not null")


def parents(df: DataFrame, target: str, id_col: str = "id") -> DataFrame:
    """Parent rows in one shape. A parent row without loaded_at counts as there from the start."""
    return df.select(
        F.lit(target).alias("target"), F.col(id_col).cast("long").alias("id"),
        F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")).alias("loaded_at"), F.col("removed_at"),
    ).where("id is not null")


class OrphanState:
    """The maintained state; ``advance`` takes the references and parents of one batch."""

    def __init__(self, scratch: Scratch, parts: int | None = None):
        self.scratch, self.batch = scratch, 0
        self.parts = parts or max(8, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
        self.base: str | None = None
        self.versions: list[str] = []
        self._old: list[str] = []

    def reduced(self, refs: DataFrame, arrived: DataFrame, *by: str) -> DataFrame:
        """One row per key (and ``by``, columns of both sides): what the rows add to the key's state."""
        a = refs.select("target", F.col("ref_key").alias("key"), "tab", "field_name", period_of(F.col("loaded_at")).alias("period"), "loaded_at", F.lit(None).cast("timestamp").alias("removed_at"), *by)
        b = arrived.select("target", F.col("id").alias("key"), *(F.lit(None).cast("string").alias(c) for c in ("tab", "field_name", "period")), "loaded_at", "removed_at", *by)
        rows = a.unionByName(b).groupBy("target", "key", "tab", "field_name", "period", *by).agg(
            F.count(F.lit(1)).alias("n"), F.min("loaded_at").alias("first_at"), F.max("loaded_at").alias("last_at"), F.min("removed_at").alias("gone_at")
        )
        rows = rows.withColumn("part", F.pmod(F.xxhash64("target", "key"), F.lit(self.parts)).cast("int"))
        no = F.lit(None).cast("boolean")
        entry = F.struct("tab", "field_name", "period", "n", "first_at", "last_at", no.alias("missing"), no.alias("late"), no.alias("deleted"))
        parent = F.col("tab").isNull()
        return self._sent(rows).groupBy(*KEY, *by).agg(
            F.min(F.when(parent, F.col("first_at"))).alias("first_in"), F.min(F.when(parent, F.col("gone_at"))).alias("first_out"),
            F.collect_list(F.when(~parent, entry)).alias("entries"),
        )

    def advance(self, refs: DataFrame, arrived: DataFrame) -> None:
        """One batch. Every batch may hold rows of any time; order within it does not matter."""
        self.merge(self.scratch.save(self.reduced(refs, arrived), "batch"))

    def merge(self, batch: DataFrame, touched: list[int] | None = None) -> None:
        """Merge a written batch of :meth:`reduced` rows; ``touched`` names the parts it has rows of."""
        self.batch += 1
        if touched is None:
            touched = [r[0] for r in batch.select("part").distinct().collect()]  # at most ``parts`` numbers
        new = batch.select(*KEY, "first_in", "first_out", "entries", F.lit(self.batch).alias("version"))
        before = self._rows(touched)
        if before is not None:
            new = new.unionByName(before.join(batch.select(*KEY), KEY, "left_semi").select(*new.columns))
        fresh = F.col("version") == self.batch
        merged = self._sent(new).groupBy(*KEY).agg(
            F.min("first_in").alias("first_in"), F.min("first_out").alias("first_out"),
            F.max(F.when(~fresh, F.struct("version", "entries"))).alias("was"), F.max(F.when(fresh, F.struct("version", "entries"))).alias("now"),
        )
        none = F.array().cast(ENTRY)
        entries = F.concat(F.coalesce("was.entries", none), F.coalesce("now.entries", none))
        merged = merged.select(*KEY, "first_in", "first_out", F.transform(entries, self._state).alias("entries"), F.lit(self.batch).alias("version"))
        self.versions.append(self.scratch.path(merged, "version"))
        if len(self.versions) >= COMPACT_EVERY:
            self._compact()

    @staticmethod
    def _state(e: Column) -> Column:
        """An entry with its states: late before the first arrival, orphaned by a deletion that lies behind it."""
        first_in, first_out = F.col("first_in"), F.col("first_out")
        none = F.lit(False)
        return F.struct(
            *(e[c].alias(c) for c in ("tab", "field_name", "period", "n", "first_at", "last_at")), first_in.isNull().alias("missing"),
            F.coalesce(e["first_at"] < first_in, none).alias("late"),
            F.coalesce((e["last_at"] >= first_out) & (e["last_at"] >= first_in), none).alias("deleted"),
        )

    def _sent(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionById(self.parts, F.col("part"))

    def _rows(self, touched: list[int] | None = None) -> DataFrame | None:
        """All versions of the keys' rows since the last compaction, and the base."""
        out = None
        read = self.scratch.spark.read.schema(STATE)
        for paths in ([self.base] if self.base else [], self.versions):
            if paths:
                rows = read.parquet(*paths)
                rows = rows if touched is None else rows.where(F.col("part").isin(touched))
                out = rows if out is None else out.unionByName(rows)
        return out

    def _current(self) -> DataFrame:
        """The newest row of every key."""
        rows = self._rows()
        if rows is None:
            return self.scratch.spark.createDataFrame([], STATE)
        if not self.versions:
            return rows
        rest = [c for c in rows.columns if c not in KEY]
        newest = self._sent(rows).groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("m"))
        return newest.select(*KEY, *(F.col(f"m.{c}").alias(c) for c in rest))

    def _compact(self) -> None:
        base = self.scratch.path_by(self._current(), "part", "base")
        for path in self._old:  # those of the compaction before: nothing reads them now
            self.scratch.drop(path)
        self._old = [*self.versions, *([self.base] if self.base else [])]
        self.base, self.versions = base, []

    def found(self) -> DataFrame:
        """tab, field_name, ref_key, period, state: each orphan reference with each of its states."""
        states = lambda e: F.filter(F.array(*(F.when(e[s], F.lit(s)) for s in ("missing", "late", "deleted"))), lambda x: x.isNotNull())
        cases = F.flatten(F.transform("entries", lambda e: F.transform(states(e), lambda s: F.struct(e["tab"].alias("tab"), e["field_name"].alias("field_name"), e["period"].alias("period"), s.alias("state")))))
        rows = self._current().select("key", F.explode(F.array_distinct(cases)).alias("c"))
        return rows.select("c.tab", "c.field_name", F.col("key").alias("ref_key"), "c.period", "c.state")

    def snapshot(self) -> DataFrame:
        """Counts per table, field, period and state after the batches so far."""
        return self.found().groupBy("tab", "field_name", "period", "state").agg(F.count(F.lit(1)).alias("n_keys"))


def replay(refs: DataFrame, arrived: DataFrame, scratch: Scratch) -> OrphanState:
    """Feed both sides month by month of arrival; one batch a calendar month, all reduced in one pass."""
    state = OrphanState(scratch)
    month = period_of(F.col("loaded_at"))
    batches = scratch.save_by(state.reduced(refs.withColumn("month", month), arrived.withColumn("month", month), "month"), "month", "batches")
    months = batches.groupBy("month").agg(F.collect_set("part").alias("parts")).collect()  # one row a calendar month
    for r in sorted(months):
        state.merge(batches.where(F.col("month") == r.month).drop("month"), r.parts)
    return state
