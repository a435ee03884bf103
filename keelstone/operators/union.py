"""Unions of tables: at once, or paid off in steps."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone import errors
from keelstone.operators.table import Content, Run, Table
from keelstone.plans.resolve import union_state

#: Key buckets in which a union is paid off.
BUCKETS = 16


@dataclass
class Union:
    """The union of tables' contents as they were, resolved bucket by bucket.

    Buckets are shares of keys by hash. A paid bucket lies in a run of inserts;
    the others are resolved whenever they are read. Debt is the number of
    entries in unpaid buckets, and one more while any is unpaid. Tables that
    share a union share its progress.
    """

    owner: Table
    tables: list[tuple[Table, Content]]
    buckets: int = BUCKETS
    paid: dict[int, str] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lock = threading.RLock()

    def _bucket(self):
        return F.pmod(F.xxhash64("k"), F.lit(self.buckets))

    def _inputs(self) -> list[DataFrame]:
        return [t.resolved(c) for t, c in self.tables]

    def _counted(self) -> list[int]:
        if not self.sizes:
            counts = [0] * self.buckets
            for t, c in self.tables:
                for r in t.log(c).groupBy(self._bucket().alias("b")).count().collect():
                    counts[r["b"]] += r["count"]
            self.sizes = counts
        return self.sizes

    def log(self) -> DataFrame:
        """The state as inserts older than all other entries."""
        return self.state().select("k", F.lit(-1).cast("bigint").alias("seq"), F.lit("I").alias("op"), "v", "blob")

    def state(self) -> DataFrame:
        with self.lock:
            paid, parts = sorted(self.paid), []
            if self.runs:
                parts.append(self.owner.read_runs(self.runs).select("k", "v", "blob"))
            if len(paid) < self.buckets:
                ins = self._inputs()
                if paid:
                    left = ~self._bucket().isin(paid)
                    ins = [s.where(left) for s in ins]
                parts.append(union_state(ins, self.owner.resolver))
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def debt(self) -> int:
        with self.lock:
            sizes = self._counted()
            left = [b for b in range(self.buckets) if b not in self.paid and sizes[b]]
            return sum(sizes[b] for b in left) + 1 if left else 0

    def as_runs(self) -> list[Run]:
        """The runs of a union that is paid off."""
        return list(self.runs)

    def supply(self, credits: int) -> int:
        """Pay whole buckets worth at least ``credits``; what is left over once all is paid comes back."""
        with self.lock:
            if credits <= 0:
                return 0
            before, due, gained = self.debt(), [], 0
            for b, n in enumerate(self._counted()):
                if b not in self.paid and n and gained < credits:
                    due.append(b)
                    gained += n
            if due:
                _, name = self.owner.session.fresh("run")
                ins = self._inputs() if len(due) == self.buckets else [s.where(self._bucket().isin(due)) for s in self._inputs()]
                done = union_state(ins, self.owner.resolver)
                rows = done.select("k", F.lit(-1).cast("bigint").alias("seq"), F.lit("I").alias("op"), "v", "blob")
                self.owner._write(rows, self.owner.session.run_path(name))
                made = self.owner.made_run(name)
                if made.entries:
                    self.runs.append(made)
                self.paid |= dict.fromkeys(due, name)
            return max(0, credits - before) if self.debt() == 0 else 0


def incremental_unions(tables: Sequence[Table]) -> Table:
    """The union of the tables as they are now; the work is done when the result is read or paid for.

    Values meet by the tables' resolver, the first table being the newest;
    blobs come from the first table that holds the key. The result takes the
    last table's settings.
    """
    if not tables:
        raise ValueError("a union needs a table")
    first = tables[0]
    for i, t in enumerate(tables):
        t.check()
        if t.session is not first.session:
            raise errors.TableUnionNotCompatibleError("tables of different sessions", 0, i)
        if (t.key, t.value_type, t.resolver.name) != (first.key, first.value_type, first.resolver.name):
            raise errors.TableUnionNotCompatibleError("tables of different types", 0, i)
    if len(tables) == 1:
        return first.duplicate()
    out = Table(first.session, first.key, first.value_type, first.resolver, tables[-1].config)
    blobs = frozenset().union(*(t.content.blobs for t in tables))
    out.content = Content((), Union(out, [(t, t.content) for t in tables]), max(t.content.batches for t in tables), blobs=blobs)
    out.trace("incremental_unions", tables=len(tables))
    return out


def incremental_union(a: Table, b: Table) -> Table:
    return incremental_unions([a, b])


def unions(tables: Sequence[Table]) -> Table:
    """The same, with all work done now."""
    out = incremental_unions(tables)
    if out.content.union is not None and len(tables) > 1:
        supply_union_credits(out, max(1, out.content.union.debt()))
    return out


def union(a: Table, b: Table) -> Table:
    return unions([a, b])


def remaining_union_debt(t: Table) -> int:
    """Steps of merging that may be left, at most; 0 for a table that is no union."""
    t.check()
    return t.content.union.debt() if t.content.union is not None else 0


def supply_union_credits(t: Table, credits: int) -> int:
    """Do at least so many steps; returns the credits that weren't needed."""
    t.check()
    if t.content.union is None:
        return max(0, credits)
    left = t.content.union.supply(credits)
    t.migrate_union()
    return left
