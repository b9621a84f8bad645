"""Scalar functions over Columns; all stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread_bits(n: Column) -> Column:
    """Bit i of n at place 2i, for n from 0 to 2**31 - 1; other numbers are an error."""
    n = n.cast("long")
    ok = n.isNull() | ((n >= 0) & (n < 1 << 31))
    # Halves, quarters and so on move apart; the masks hold the places kept at each width.
    steps = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]
    spread = reduce(lambda x, s: x.bitwiseOR(F.shiftleft(x, s[0])).bitwiseAND(F.lit(s[1])), steps, n)
    return F.when(ok, spread).otherwise(F.raise_error(F.lit("coordinate outside 0 .. 2**31 - 1")).cast("long"))


def morton(row: Column, col: Column) -> Column:
    """Z-order key: the row's bits in the odd places, the column's in the even ones."""
    return spread_bits(col) + F.shiftleft(spread_bits(row), 1)


def hash_keys(key: Column, shift: int, multiplier: int = 2654435769) -> Column:
    """Multiplicative hash of 32-bit keys: upper bits of key * multiplier mod 2**32."""
    return F.shiftright((key.cast("long") * multiplier).bitwiseAND(F.lit(0xFFFFFFFF)), shift)


def region_uri(parent: Column, op: Column, child: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``parent|op|child``."""
    return F.substring(F.sha2(F.concat_ws("|", parent, op, child.cast("string")), 256), 1, 16)


def probe_seed(a: Column, b: Column, level: int, seed: int) -> Column:
    """First four bytes, least significant first, of the SHA-256 of ``(a, b, level, seed)`` in text form."""
    d = F.sha2(F.format_string(f"(%d, %d, {level}, {seed})", a, b), 256)
    turned = F.concat(*[F.substring(d, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(turned, 16, 10).cast("long")


def quantize(value: Column, top: float) -> Column:
    """0 to 15 by half-even rounding of the clamped value."""
    x = F.least(F.greatest(value, F.lit(0.0)), F.lit(top))
    return F.bround(x / F.lit(top) * 15, 0).cast("int")


def pack(seam: Column, uncertainty: Column, mass: Column) -> Column:
    """12-bit signature of three nibbles."""
    return F.shiftleft(seam, 8).bitwiseOR(F.shiftleft(uncertainty, 4)).bitwiseOR(mass)


def nibble(sig: Column, place: int) -> Column:
    """Nibble 2: seam, 1: uncertainty, 0: mass."""
    return F.shiftright(sig, 4 * place).bitwiseAND(F.lit(15))


def hamming12(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(0xFFF)))


def component_diff(a: Column, b: Column) -> Column:
    return F.greatest(*[F.abs(nibble(a, k) - nibble(b, k)) for k in range(3)])


def is_dirty(a: Column, b: Column, bits: int = 3, diff: int = 4) -> Column:
    return (hamming12(a, b) >= bits) | (component_diff(a, b) >= diff)


def psnr(mse: Column, span: Column, floor: float = 1e-15) -> Column:
    return F.when(mse < floor, F.lit(100.0)).otherwise(10 * F.log10(span * span / mse))


def cosine_ramp(i: Column, n: int) -> Column:
    return 0.5 * (1 - F.cos(F.lit(3.141592653589793) * i / n))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def corridor_penalty(cost: Column, low: float, high: float) -> Column:
    """Twice what is above the corridor plus what is below it."""
    return 2 * F.greatest(cost - high, F.lit(0.0)) + F.greatest(low - cost, F.lit(0.0))


def phase_weight(step: Column, steps: int, start: float, end: float) -> Column:
    return start + (end - start) * step / max(1, steps - 1)
