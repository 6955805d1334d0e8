"""Integer and bit functions as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1)))


def signed_slot(d: Column, limit: int) -> Column:
    """Signed values without zero interleaved: 1, -1, 2, -2 ... as 0, 1, 2, 3 ...; beyond limit, the escape 2 * limit; zero is an error."""
    slot = F.when(d > 0, 2 * (d - 1)).otherwise(2 * (-d - 1) + 1)
    return F.when(d == 0, F.raise_error(F.lit("zero has no slot")).cast("bigint")).when(slot >= 2 * limit, F.lit(2 * limit)).otherwise(slot).cast("bigint")


def bit_width(v: Column) -> Column:
    """Bits of a non-negative value, at least 1."""
    return F.greatest(F.lit(1), F.length(F.bin(v)))


def varint_length(v: Column) -> Column:
    """Bytes of a non-negative value at seven bits a byte."""
    return F.ceil(bit_width(v) / 7).cast("bigint")


def varint_hex(v: Column) -> Column:
    """The varint of a non-negative int as lower-case hexadecimal digits: seven bits a byte, low bits first, the top bit set on all but the last."""
    byte = lambda k: F.shiftrightunsigned(v, 7 * k).bitwiseAND(F.lit(127)) + F.when(F.shiftrightunsigned(v, 7 * k + 7) > 0, 128).otherwise(0)
    two = lambda k: F.lower(F.lpad(F.hex(byte(k)), 2, "0"))
    return F.concat(two(0), *[F.when(F.shiftrightunsigned(v, 7 * k) > 0, two(k)).otherwise(F.lit("")) for k in range(1, 5)])


def prefix_varint_length(v: Column) -> Column:
    """Bytes of a value whose first byte tells the length by its leading ones: seven bits a byte up to eight bytes, else nine."""
    return F.when(bit_width(v) > 56, F.lit(9)).otherwise(varint_length(v)).cast("bigint")


def signal_bytes(d: Column) -> Column:
    """Bytes of a difference that is a plain varint if positive, else a zero byte and the varint of its opposite."""
    return F.when(d <= 0, 1 + varint_length(-d)).otherwise(varint_length(d))


def byte_plane(v: Column, k: int) -> Column:
    return F.shiftright(v, 8 * k).bitwiseAND(F.lit(255))


def high_word(v: Column) -> Column:
    return F.shiftrightunsigned(v, 32)


def low_word(v: Column) -> Column:
    return v.bitwiseAND(F.lit(0xFFFFFFFF))


def packed_bytes(n: Column, width: Column) -> Column:
    """Bytes of n values of a width behind a width byte."""
    return (1 + F.ceil(n * width / 8)).cast("bigint")
