"""Tables: a change log in immutable runs, resolved on demand."""

from __future__ import annotations

import functools
import itertools
import math
import re
import threading
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone import errors
from keelstone.config import TableConfig
from keelstone.functions.codecs import INT64, Codec
from keelstone.functions.resolvers import FIRST, Resolver
from keelstone.operators.session import Session
from keelstone.plans.resolve import LISTED, hot_keys, is_in, level_state, lookups, merged_log

#: A run holds fewer entries than this.
RUN_LIMIT = 1 << 40
#: From this many entries on, hot keys are looked for before a table is resolved.
HOT_ENTRIES = 10_000_000
#: Numbers of a batch's entries; the batch's own number stands above them.
BATCH_BITS = 40
BATCHES = 1 << 22
REF = "struct<run: string, seq: bigint>"


class BlobRef(NamedTuple):
    """Where a blob lies: its run's name and its entry there."""

    run: str
    seq: int


class LookupResult(NamedTuple):
    """Not found, found, or found with a blob."""

    found: bool
    value: Any = None
    blob: BlobRef | None = None


class Entry(NamedTuple):
    key: Any
    value: Any
    blob: BlobRef | None = None


@dataclass(frozen=True)
class Insert:
    value: Any
    blob: bytes | None = None


@dataclass(frozen=True)
class Upsert:
    value: Any


@dataclass(frozen=True)
class Delete:
    pass


@dataclass(frozen=True)
class Range:
    """Keys from low on; up to high, which is left out unless inclusive."""

    low: Any
    high: Any
    inclusive: bool = False


@dataclass(frozen=True)
class Run:
    """An immutable Parquet folder of entries (k, seq, op, v, ref); blobs lie in a folder beside it. low, high: its keys' bounds, if known."""

    name: str
    entries: int
    newest: int
    low: Any = None
    high: Any = None

    def may_hold(self, keys: Sequence[Any]) -> bool:
        return self.low is None or any(self.low <= k <= self.high for k in keys)


@dataclass(frozen=True, eq=False)
class Content:
    """What a table holds: runs, oldest first, above a union that may still be open, and below the entries not yet written.

    blobs: the folders of blobs that entries may refer to; streams: the last
    batch of each stream that is in; credits: what updates have brought towards
    the next merge.
    """

    runs: tuple[Run, ...] = ()
    union: Any = None
    batches: int = 0
    buffer: tuple[tuple, ...] = ()
    blobs: frozenset[str] = frozenset()
    streams: tuple[tuple[str, int], ...] = ()
    credits: int = 0

    @property
    def entries(self) -> int:
        return sum(r.entries for r in self.runs) + len(self.buffer)


@dataclass
class Table:
    """A table handle. Every update makes a new content; contents are never changed.

    key: the codec of keys; value_type: Spark's type of values; resolver: how
    upserts meet older values.

    Small batches wait in a buffer, which becomes a run once it holds
    ``config.write_buffer`` entries; DataFrames become a run each. A run's level
    is the power of ``size_ratio`` write buffers that holds it. As many runs as
    that ratio within a level are merged into one, which may fill the next
    level, so that the number of runs grows with the logarithm of the entries;
    the last level is a single run.
    """

    session: Session
    key: Codec = INT64
    value_type: str = "bigint"
    resolver: Resolver = FIRST
    config: TableConfig = field(default_factory=TableConfig)
    content: Content = field(default_factory=Content)
    closes_at = 1

    def __post_init__(self) -> None:
        self.session.check()
        self.ident, _ = self.session.fresh("table")
        self.closed, self._lock = False, threading.RLock()
        self.session.keep(self)
        self.trace("new_table")

    def trace(self, name: str, **details) -> None:
        self.session.trace("table", self.ident, name, **details)

    def check(self) -> None:
        self.session.check()
        if self.closed:
            raise errors.TableClosedError(self.ident)

    def close(self) -> None:
        """Data that no snapshot holds is gone; closing again does nothing."""
        if not self.closed:
            self.trace("close_table")
            self.closed = True

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # Reading

    @property
    def schema(self) -> str:
        return f"k {self.key.spark_type}, seq bigint, op string, v {self.value_type}, blob {REF}"

    def read_runs(self, runs: Sequence[Run]) -> DataFrame:
        return self.session.spark.read.schema(self.schema).parquet(*[self.session.run_path(r.name) for r in runs])

    def log(self, content: Content | None = None, keys: Sequence[Any] | None = None) -> DataFrame:
        """Every entry of the runs and the buffer, and of the union below them as inserts older than all.

        With keys: only their entries; runs whose bounds don't hold any are not opened.
        """
        content = content or self.content
        runs, held, parts = content.runs, content.buffer, []
        if keys is not None:
            runs, wanted = [r for r in runs if r.may_hold(keys)], set(keys)
            held = [r for r in held if plain(r[0]) in wanted]
        if runs:
            parts.append(self.read_runs(runs))
        if held:
            parts.append(self.session.spark.createDataFrame(list(held), self.schema))
        if content.union is not None:
            parts.append(content.union.log())
        if not parts:
            return self.session.spark.createDataFrame([], self.schema)
        if keys is not None:
            parts = [p.where(is_in("k", p, list(keys))) for p in parts]
        return functools.reduce(DataFrame.unionByName, parts)

    def hot(self, content: Content) -> list | None:
        """Hot keys of a large table, looked for once per set of runs."""
        if sum(r.entries for r in content.runs) < HOT_ENTRIES:
            return None
        names = tuple(r.name for r in content.runs)
        if names not in self.session.hot:
            self.session.hot[names] = hot_keys(self.read_runs(content.runs), entries=sum(r.entries for r in content.runs))
        return self.session.hot[names]

    def resolved(self, content: Content, where: Column | None = None, keys: Sequence[Any] | None = None) -> DataFrame:
        """(k, v, blob) of a content's live keys; a condition on k, or a list of keys, reaches the scan."""
        if content.union is not None and not content.runs and not content.buffer and keys is None:
            out = content.union.state()
            return out if where is None else out.where(where)
        log = self.log(content, keys)
        return level_state(log if where is None else log.where(where), self.resolver, self.hot(content))

    def state(self, content: Content | None = None) -> DataFrame:
        """(k, v, blob) of every live key, unordered; blob is a reference."""
        self.check()
        return self.resolved(content or self.content)

    def with_blobs(self, state: DataFrame | None = None, content: Content | None = None) -> DataFrame:
        """state with the blobs' bytes in the column ``bytes``; only here are they read. A reference without a blob is an error."""
        self.check()
        return blob_frame(self.session, self.state(content) if state is None else state, (content or self.content).blobs)

    def lookup_frame(self, keys: DataFrame) -> DataFrame:
        """(ordinal, k, found, v, blob) for keys(ordinal, k)."""
        self.check()
        self.trace("lookups")
        return lookups(self.log(), keys, self.resolver, self.hot(self.content))

    def lookups(self, keys: Sequence[Any]) -> list[LookupResult]:
        """Result i answers key i; keys may repeat."""
        self.check()
        wanted = list(dict.fromkeys(plain(k) for k in keys if k is not None))
        if not wanted:
            return [LookupResult(False)] * len(keys)
        self.trace("lookups")
        if len(wanted) > LISTED:
            frame = self.session.spark.createDataFrame(list(enumerate(wanted)), f"ordinal int, k {self.key.spark_type}")
            rows = collected(lookups(self.log(), frame, self.resolver, self.hot(self.content)).where("found"))
        else:
            rows = collected(self.resolved(self.content, keys=wanted))
        out = {plain(r["k"]): LookupResult(True, r["v"], _ref(r["blob"])) for r in rows}
        return [out.get(plain(k), LookupResult(False)) for k in keys]

    def lookup(self, key: Any) -> LookupResult:
        return self.lookups([key])[0]

    def members(self, keys: Sequence[Any]) -> list[bool]:
        return [r.found for r in self.lookups(keys)]

    def member(self, key: Any) -> bool:
        return self.members([key])[0]

    def range_frame(self, bounds: Range) -> DataFrame:
        """Live entries in key order; the bounds reach the scan."""
        self.check()
        self.trace("range_lookup", low=bounds.low, high=bounds.high)
        k = F.col("k")
        inside = self.key.at_least(k, bounds.low) & self.key.below(k, bounds.high, bounds.inclusive)
        return self.resolved(self.content, inside).orderBy(*self.key.order(k))

    def range_lookup(self, bounds: Range) -> list[Entry]:
        return [entry(r) for r in collected(self.range_frame(bounds))]

    def retrieve_blobs(self, refs: Sequence[BlobRef]) -> list[bytes]:
        """The blobs, in order; the first reference without one raises its index."""
        self.session.check()
        if self.closed:
            raise errors.BlobRefInvalidError(0)
        return retrieve_blobs(self.session, refs)

    # Writing

    def updates(self, batch: Iterable[tuple[Any, Insert | Upsert | Delete]] | DataFrame) -> None:
        """Apply a batch in its order: later entries win, as if applied one by one.

        A sequence goes to the buffer, and only its blobs are written at once.
        A DataFrame has the columns ordinal, k, op (I, U or D), v and blob, and
        is never collected: it becomes a run; ordinals are distinct and below
        2**40.
        """
        self.check()
        with self._lock:
            self.trace("updates")
            number = self.content.batches + 1
            if number >= BATCHES:
                raise errors.TableTooLargeError("too many batches")
            if isinstance(batch, DataFrame):
                self._write_batch(batch, number)
            else:
                self._hold([(i, k, *_row(u)) for i, (k, u) in enumerate(batch)], number)

    def _hold(self, rows: list[tuple], number: int) -> None:
        if not rows:
            return
        spark, content = self.session.spark, self.content
        _, name = self.session.fresh("batch")
        held = tuple((k, (number << BATCH_BITS) + i, op, v, (name, (number << BATCH_BITS) + i) if b is not None else None) for i, k, op, v, b in rows)
        spark.createDataFrame(list(held), self.schema)  # raises on keys and values of other types
        blobs = [((number << BATCH_BITS) + i, bytes(b)) for i, _, _, _, b in rows if b is not None]
        if blobs:
            spark.createDataFrame(blobs, "seq bigint, blob binary").coalesce(1).write.option("compression", "zstd").parquet(f"{self.session.run_path(name)}.blobs")
        self.content = replace(content, buffer=content.buffer + held, batches=number, blobs=content.blobs | ({name} if blobs else set()))
        self.trace("updated", entries=len(held))
        if len(self.content.buffer) >= self.config.write_buffer:
            self.flush()

    def _write_batch(self, batch: DataFrame, number: int) -> None:
        _, name = self.session.fresh("run")
        path = self.session.run_path(name)
        seq = F.lit(number << BATCH_BITS) + F.col("ordinal").cast("bigint")
        rows = batch.select("k", seq.alias("seq"), "op", F.col("v").cast(self.value_type).alias("v"), F.when(F.col("op") == "I", F.col("blob")).alias("bytes"))
        ref = F.when(F.col("bytes").isNotNull(), F.struct(F.lit(name).alias("run"), F.col("seq")))
        self._write(rows.select("k", "seq", "op", "v", ref.alias("blob")), path)
        rows.where(F.col("bytes").isNotNull()).select("seq", F.col("bytes").alias("blob")).write.option("compression", "zstd").parquet(f"{path}.blobs")
        self._add(self.made_run(name), number, frozenset({name}))

    def flush(self) -> None:
        """Write the buffer as a run, the newest."""
        self.check()
        with self._lock:
            held = self.content.buffer
            if not held:
                return
            _, name = self.session.fresh("run")
            self._write(self.session.spark.createDataFrame(list(held), self.schema).coalesce(1), self.session.run_path(name))
            self.trace("flush", entries=len(held))
            self.content = replace(self.content, buffer=())
            self._add(self.made_run(name), self.content.batches, frozenset())

    def _add(self, run: Run, number: int, blobs: frozenset[str]) -> None:
        """The run above all others, and its entries as credits towards merges."""
        content = self.content
        if run.entries:
            content = replace(content, runs=(*content.runs, run), blobs=content.blobs | blobs)
        self.content = replace(content, batches=number)
        self.trace("updated", entries=run.entries)
        self.migrate_union()
        self.supply_merge_credits(run.entries)

    def _write(self, rows: DataFrame, path: str) -> None:
        """Clustered by key within files, so that a file's bounds and filters tell which keys it holds."""
        rows.sortWithinPartitions("k", "seq").write.options(**self.config.write_options()).parquet(path)

    def made_run(self, name: str) -> Run:
        read = self.session.spark.read.schema(self.schema).parquet(self.session.run_path(name))
        n, newest, low, high = read.agg(F.count("*"), F.max("seq"), F.min("k"), F.max("k")).first()
        if n >= RUN_LIMIT:
            raise errors.TableTooLargeError(name)
        return Run(name, n, newest if newest is not None else -1, plain(low), plain(high))

    # Levels

    def level(self, run: Run) -> int:
        """1 for what a write buffer can hold, and one more for each factor of the size ratio beyond."""
        return 1 + max(0, math.ceil(math.log(max(1, run.entries) / self.config.write_buffer, self.config.size_ratio) - 1e-9))

    def due(self) -> int:
        """How many of the newest runs make a full level; 0: none is full.

        They are those up to the first of a higher level. A merge that leaves
        only the last level's run takes that along.
        """
        runs = self.content.runs[::-1]
        levels = [self.level(r) for r in runs]
        for x in sorted(set(levels)):
            n = next((i for i, y in enumerate(levels) if y > x), len(levels))
            if levels[:n].count(x) >= self.config.size_ratio:
                last = n == len(runs) - 1 and levels[n] <= x + 1 and self.content.union is None
                return n + last
        return 0

    def supply_merge_credits(self, credits: int) -> None:
        """Merge full levels: at once, or when credits have come for it, one for each entry of a share of 1 / size_ratio.

        A level is never left with twice the runs that make it full. States
        stay the same.
        """
        with self._lock:
            gained = self.content.credits + max(0, credits)
            while n := self.due():
                cost = sum(r.entries for r in self.content.runs[-n:]) // self.config.size_ratio
                if self.config.merge_schedule == "incremental" and gained < cost and n < 2 * self.config.size_ratio:
                    break
                gained = max(0, gained - cost)
                self._merge(n)
            self.content = replace(self.content, credits=gained if self.due() else 0)

    def _merge(self, n: int) -> None:
        own = self.content.runs
        rest, top = own[: len(own) - n], own[len(own) - n :]
        last_level = not rest and self.content.union is None
        _, name = self.session.fresh("run")
        entries = sum(r.entries for r in top)
        hot = hot_keys(self.read_runs(top), entries=entries) if entries >= HOT_ENTRIES else None
        merged = merged_log(self.read_runs(top), self.resolver, last_level, hot)
        small = entries <= self.config.write_buffer * self.config.size_ratio
        self._write(merged.coalesce(1) if small else merged.repartitionByRange("k"), self.session.run_path(name))
        made = self.made_run(name)
        self.content = replace(self.content, runs=(*rest, made) if made.entries else rest)
        self.trace("merged", runs=n, entries=made.entries)

    def migrate_union(self) -> None:
        """A union that is paid off becomes runs of inserts, older than all others."""
        with self._lock:
            union = self.content.union
            if union is not None and union.sizes and union.debt() == 0:
                self.content = replace(self.content, runs=(*union.as_runs(), *self.content.runs), union=None)
                self.trace("migrated_union")

    def insert(self, key: Any, value: Any, blob: bytes | None = None) -> None:
        self.updates([(key, Insert(value, blob))])

    def inserts(self, rows: Iterable[tuple]) -> None:
        self.updates([(r[0], Insert(*r[1:])) for r in rows])

    def upsert(self, key: Any, value: Any) -> None:
        self.updates([(key, Upsert(value))])

    def upserts(self, rows: Iterable[tuple[Any, Any]]) -> None:
        self.updates([(k, Upsert(v)) for k, v in rows])

    def delete(self, key: Any) -> None:
        self.updates([(key, Delete())])

    def deletes(self, keys: Iterable[Any]) -> None:
        self.updates([(k, Delete()) for k in keys])

    def update(self, key: Any, change: Insert | Upsert | Delete) -> None:
        self.updates([(key, change)])

    def compact(self, runs: int | None = None) -> None:
        """Merge the newest ``runs`` runs into one (all by default), the buffer being the newest; the state stays the same.

        Only a merge of everything, with no union below, may drop deletes. The
        output is range-partitioned by key, so that scans of a range skip files.
        """
        self.check()
        with self._lock:
            self.migrate_union()
            held = self.content.buffer
            if held:
                _, name = self.session.fresh("run")
                self._write(self.session.spark.createDataFrame(list(held), self.schema).coalesce(1), self.session.run_path(name))
                self.content = replace(self.content, buffer=(), runs=(*self.content.runs, self.made_run(name)))
            n = len(self.content.runs) if runs is None else min(runs, len(self.content.runs))
            if n >= 2:
                self._merge(n)
                self.trace("compacted", runs=n)

    # Copies

    def duplicate(self) -> Table:
        """An independent table that shares the runs written so far; no data is copied."""
        self.check()
        return Table(self.session, self.key, self.value_type, self.resolver, self.config, self.content)


def plain(key: Any) -> Any:
    return bytes(key) if isinstance(key, bytearray) else key


def collected(df: DataFrame) -> list:
    """The rows; a run that is missing or cut short is an error of its own."""
    try:
        return df.collect()
    except Exception as e:
        if re.search("FAILED_READ_FILE|FileNotFoundException|PATH_NOT_FOUND|is not a Parquet file", str(e)):
            raise errors.TableCorruptedError(str(e)[:500]) from e
        raise


def entry(r) -> Entry:
    return Entry(r["k"], r["v"], _ref(r["blob"]))


def _ref(r) -> BlobRef | None:
    return None if r is None else BlobRef(r["run"], r["seq"])


def _row(u: Insert | Upsert | Delete) -> tuple:
    if isinstance(u, Insert):
        return "I", u.value, u.blob
    return ("U", u.value, None) if isinstance(u, Upsert) else ("D", None, None)


def retrieve_blobs(session: Session, refs: Sequence[BlobRef]) -> list[bytes]:
    """Each run's blobs are asked once for all its references."""
    session.check()
    found: dict[BlobRef, bytes] = {}
    for run, own in itertools.groupby(sorted(set(refs)), key=lambda r: r.run):
        path = f"{session.run_path(run)}.blobs"
        if session.files.exists(path):
            blobs = session.spark.read.schema("seq bigint, blob binary").parquet(path)
            rows = blobs.where(is_in("seq", blobs, [r.seq for r in own])).collect()
            found |= {BlobRef(run, r["seq"]): bytes(r["blob"]) for r in rows}
    for i, r in enumerate(refs):
        if r not in found:
            raise errors.BlobRefInvalidError(i)
    return [found[r] for r in refs]


def blob_frame(session: Session, state: DataFrame, folders: Iterable[str]) -> DataFrame:
    """state with the blobs' bytes in the column ``bytes``, from the named folders; a reference without a blob is an error."""
    paths = [f"{session.run_path(n)}.blobs" for n in sorted(folders)]
    if paths:
        blobs = session.spark.read.schema("seq bigint, blob binary").parquet(*paths)
        run = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)\\.blobs/[^/]+$", 1)
        blobs = blobs.select(run.alias("_run"), F.col("seq").alias("_seq"), F.col("blob").alias("bytes"))
        at: Column = (F.col("blob.run") == F.col("_run")) & (F.col("blob.seq") == F.col("_seq"))
        state = state.join(blobs, at, "left").drop("_run", "_seq")
    else:
        state = state.withColumn("bytes", F.lit(None).cast("binary"))
    lost = F.raise_error(F.concat(F.lit("no blob for "), F.col("blob.run"))).cast("binary")
    return state.withColumn("bytes", F.when(F.col("blob").isNotNull() & F.col("bytes").isNull(), lost).otherwise(F.col("bytes")))
