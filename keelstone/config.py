"""Table settings. They change the cost of operations, never their results."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

#: Entries of a run's file, at most.
FILE_ENTRIES = 2_000_000


@dataclass(frozen=True)
class TableConfig:
    """merge_policy and size_ratio: lazy levelling with four runs to a level.

    write_buffer: entries of small batches that are held before they become a
    run. merge_schedule: ``one_shot`` merges a full level within the update that
    fills it, ``incremental`` once updates have brought enough credits. bloom:
    false-positive rate of the Parquet filters on keys, or ``bits:n``, the bits
    per entry that give it. fence_index: ``ordinary`` or ``compact``
    (Parquet's column index serves both). cache: ``all``, ``none`` or a number
    of levels; it is kept with the table, and Spark's readers decide by
    themselves. merge_batch: entries per merge step.
    """

    merge_policy: str = "lazy_levelling"
    size_ratio: int = 4
    write_buffer: int = 20_000
    merge_schedule: str = "incremental"
    bloom: float | str = 1e-3
    fence_index: str = "ordinary"
    cache: str | int = "all"
    merge_batch: int = 20_000

    def __post_init__(self) -> None:
        if self.merge_policy != "lazy_levelling" or self.size_ratio != 4:
            raise ValueError("the only merge policy is lazy levelling with size ratio four")
        if self.merge_schedule not in ("one_shot", "incremental") or self.fence_index not in ("ordinary", "compact"):
            raise ValueError("unknown merge schedule or fence index")
        if self.write_buffer < 1 or not 1 <= self.merge_batch <= self.write_buffer:
            raise ValueError("merge_batch lies between one and write_buffer")
        if not 0 < self.false_positives() < 1:
            raise ValueError("a false-positive rate lies between zero and one")

    def false_positives(self) -> float:
        """The rate, or that of a filter of blocks of eight bits an entry sets, with so many bits per entry."""
        if not isinstance(self.bloom, str):
            return float(self.bloom)
        kind, _, bits = self.bloom.partition(":")
        if kind != "bits" or not bits.replace(".", "", 1).isdigit() or float(bits) <= 0:
            raise ValueError("bloom is a rate or bits:n")
        return (1 - math.exp(-8 / float(bits))) ** 8

    def write_options(self) -> dict[str, str]:
        """Parquet writer options for a run: filters on keys, and files that one executor can read at once."""
        return {"compression": "zstd", "maxRecordsPerFile": str(FILE_ENTRIES), "parquet.bloom.filter.enabled#k": "true", "parquet.bloom.filter.fpp#k": str(self.false_positives())}


@dataclass(frozen=True)
class TableConfigOverride:
    """The two settings that may change when a snapshot is opened."""

    cache: str | int | None = None
    merge_batch: int | None = None

    def over(self, config: TableConfig) -> TableConfig:
        return replace(config, **{k: v for k, v in vars(self).items() if v is not None})
