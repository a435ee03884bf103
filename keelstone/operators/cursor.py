"""Cursors: a stable view of a table, read in key order."""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone import errors
from keelstone.operators.table import REF, Entry, Table, collected, entry


def _file() -> Column:
    return F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("file")


class Cursor:
    """Reads a table as it was when the cursor was made, from its least key or from ``at`` on.

    The first read resolves what is ahead once and writes it in key order, with
    the bounds and sizes of its files; a read opens only the files that hold
    its entries. A cursor outlives its table, not its session.
    """

    closes_at = 0

    def __init__(self, table: Table, at: Any = None) -> None:
        table.check()
        self.table, self.content, self.closed = table, table.content, False
        self.last, self.start, self._lock = None, at, threading.Lock()
        self._files: list[tuple[str, int]] | None = None
        table.session.keep(self)
        table.session.trace("cursor", id(self), "new_cursor", at=at)

    def _check(self) -> None:
        if self.closed:
            raise errors.CursorClosedError()
        self.table.session.check()

    def _ahead(self) -> DataFrame:
        """All that was ahead at the start."""
        inside = None if self.start is None else self.table.key.at_least(F.col("k"), self.start)
        return self.table.resolved(self.content, inside)

    def _view(self) -> list[tuple[str, int]]:
        """(name, entries) of the files of the written view, in key order."""
        if self._files is None:
            session, order = self.table.session, self.table.key.order(F.col("k"))
            _, name = session.fresh("cursor")
            path = f"{session.root}/active/{name}"
            self._schema = f"k {self.table.key.spark_type}, v {self.table.value_type}, blob {REF}"
            rows = self._ahead()
            rows.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**self.table.config.write_options()).parquet(path)
            read = session.spark.read.schema(self._schema).parquet(path)
            files = read.groupBy(_file()).agg(F.count("*").alias("n"), self._least().alias("least"))
            self._files, self._folder = [(r["file"], r["n"]) for r in collected(files.orderBy("least"))], path
        return self._files

    def _least(self) -> Column:
        return F.min(F.struct((F.col("k") < 0).alias("a") if self.table.key.signed else F.lit(0).alias("a"), F.col("k").alias("b")))

    def _page(self, n: int) -> DataFrame | None:
        """The entries after the last one read, from as many files as hold n of them for certain."""
        files, sure, paths = self._view(), 0, []
        for i, (name, m) in enumerate(files):
            # Some of the first file's entries are read already, nobody counts how many.
            sure += m if i else 0
            paths.append(f"{self._folder}/{name}")
            if sure >= n:
                break
        if not paths:
            return None
        page = self.table.session.spark.read.schema(self._schema).parquet(*paths)
        return page if self.last is None else page.where(self.table.key.above(F.col("k"), self.last))

    def frame(self) -> DataFrame:
        """All that is ahead, in order; the cursor stays where it is."""
        self._check()
        rows = self._ahead() if self._files is None else self._page(1 << 62)
        if rows is None:
            rows = self._ahead().limit(0)
        return rows.orderBy(*self.table.key.order(F.col("k")))

    def _take(self, n: int, holds: Column | None = None) -> list[Entry]:
        page = self._page(max(0, n)) if n > 0 else None
        if page is None:
            return []
        if holds is not None:
            page = prefix(page, holds, self.table)
        rows = collected(page.orderBy(*self.table.key.order(F.col("k"))).limit(n).select("k", "v", "blob", _file()))
        if rows:
            self._move(rows[-1])
        return [entry(r) for r in rows]

    def _move(self, row: Any) -> None:
        self.last = row["k"]
        at = next(i for i, (name, _) in enumerate(self._files) if name == row["file"])
        self._files = self._files[at:]

    def take(self, n: int) -> list[Entry]:
        """Up to n entries; the cursor moves behind them."""
        with self._lock:
            self._check()
            return self._take(n)

    def next(self) -> Entry | None:
        rows = self.take(1)
        return rows[0] if rows else None

    def take_while(self, n: int, holds: Callable[[Any], bool]) -> list[Entry]:
        """Up to n entries while ``holds`` is true of the key; stops before the first key it isn't true of.

        ``holds`` is tried on a column first: a column condition ends the read
        within Spark. Otherwise it is tried on the keys themselves.
        """
        with self._lock:
            self._check()
            test = holds(F.col("k"))
            if isinstance(test, Column):
                return self._take(n, test)
            page = self._page(max(0, n)) if n > 0 else None
            rows = [] if page is None else collected(page.orderBy(*self.table.key.order(F.col("k"))).limit(n).select("k", "v", "blob", _file()))
            good = list(itertools.takewhile(lambda r: holds(r["k"]), rows))
            if good:
                self._move(good[-1])
            return [entry(r) for r in good]

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def prefix(state: DataFrame, test: Column, table: Table) -> DataFrame:
    """The entries before the first key that fails the test."""
    order = F.min(F.struct((F.col("k") < 0).alias("a") if table.key.signed else F.lit(0).alias("a"), F.col("k").alias("b")))
    stop = state.where(~test).agg(order.alias("stop")).first()["stop"]
    return state if stop is None else state.where(table.key.below(F.col("k"), stop["b"]))
