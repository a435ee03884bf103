"""Key types: their bytes, and the order of those bytes as plain comparisons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    """A key type. Keys are ordered by their bytes, unsigned, shorter first on a tie.

    signed: the bytes of a negative number start with a set bit, so negative
    keys come after all others.
    """

    name: str
    spark_type: str
    width: int = 0
    signed: bool = False

    def to_bytes(self, k: Column) -> Column:
        if self.width:
            digits = F.hex(k.cast("bigint")) if self.name != "word64" else _hex_of_decimal(k)
            return F.unhex(F.right(F.lpad(digits, 16, "0"), F.lit(2 * self.width)))
        return k.cast("binary")

    def from_bytes(self, b: Column) -> Column:
        if not self.width:
            return b.cast(self.spark_type)
        wide = F.concat(F.when((F.lit(self.signed)) & (F.hex(b) >= "8"), F.lit("F" * (16 - 2 * self.width))).otherwise(""), F.hex(b))
        return F.conv(wide, 16, -10 if self.signed else 10).cast("decimal(20,0)").cast(self.spark_type)

    def value_to_bytes(self, v: Column) -> Column:
        """A value's bytes: numbers have the least byte first."""
        return self._turned(self.to_bytes(v))

    def value_from_bytes(self, b: Column) -> Column:
        return self.from_bytes(self._turned(b))

    def _turned(self, b: Column) -> Column:
        return F.concat(*[F.substring(b, i, 1) for i in range(self.width, 0, -1)]) if self.width else b

    def order(self, k: Column) -> list[Column]:
        """Sort columns that give the order of the bytes."""
        return [(k < 0).asc(), k.asc()] if self.signed else [k.asc()]

    def at_least(self, k: Column, low) -> Column:
        """k >= low in key order, as comparisons that reach the scan."""
        if not self.signed:
            return k >= F.lit(low)
        return (k >= F.lit(low)) & (k < 0) if low < 0 else (k >= F.lit(low)) | (k < 0)

    def above(self, k: Column, low) -> Column:
        return self.at_least(k, low) & (k != F.lit(low))

    def below(self, k: Column, high, inclusive: bool = False) -> Column:
        native = k <= F.lit(high) if inclusive else k < F.lit(high)
        if not self.signed:
            return native
        return (k >= 0) | native if high < 0 else (k >= 0) & native


def _hex_of_decimal(k: Column) -> Column:
    high = F.floor(k / F.lit(1 << 32)).cast("bigint")
    low = (k - high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint")
    return F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0"))


INT64 = Codec("int64", "bigint", 8, True)
INT32 = Codec("int32", "int", 4, True)
INT16 = Codec("int16", "smallint", 2, True)
INT8 = Codec("int8", "tinyint", 1, True)
WORD64 = Codec("word64", "decimal(20,0)", 8)
WORD32 = Codec("word32", "bigint", 4)
WORD16 = Codec("word16", "int", 2)
WORD8 = Codec("word8", "smallint", 1)
UTF8 = Codec("utf8", "string")
BYTES = Codec("bytes", "binary")
CODECS = {c.name: c for c in (INT64, INT32, INT16, INT8, WORD64, WORD32, WORD16, WORD8, UTF8, BYTES)}
