"""File modes as labels, strings and directory-entry types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file types of st_mode, their labels, their letters and their d_type numbers.
TYPES = {
    0o100000: ("FILE", "-", 8),
    0o040000: ("DIR", "d", 4),
    0o120000: ("LINK", "l", 10),
    0o020000: ("CHR", "c", 2),
    0o060000: ("BLK", "b", 6),
    0o010000: ("FIFO", "p", 1),
    0o140000: ("SOCK", "s", 12),
}
# The letters of the inode flags, from the lowest of the sixteen positions up.
FLAGS = "sucSiadADBZEIijt"


def _by_type(mode: Column, k: int, default) -> Column:
    out = F.lit(default)
    for bits, row in TYPES.items():
        out = F.when(mode.bitwiseAND(0o170000) == bits, F.lit(row[k])).otherwise(out)
    return out


def type_label(mode: Column) -> Column:
    return _by_type(mode, 0, "UNKNOWN")


def d_type(mode: Column) -> Column:
    """DT_* number of a mode; 0 where the type is unknown."""
    return _by_type(mode, 2, 0)


def type_bits(dt: Column) -> Column:
    """The type bits of a mode, from a DT_* number."""
    out = F.lit(0)
    for bits, (_, _, number) in TYPES.items():
        out = F.when(dt == number, F.lit(bits)).otherwise(out)
    return out


def mode_string(mode: Column) -> Column:
    """``drwxr-xr-x``, with s and S, t and T for setuid, setgid and sticky."""

    def bit(b: int) -> Column:
        return mode.bitwiseAND(b) != 0

    parts = [_by_type(mode, 1, "?")]
    for shift, special, low, high in ((6, 0o4000, "s", "S"), (3, 0o2000, "s", "S"), (0, 0o1000, "t", "T")):
        parts.append(F.when(bit(4 << shift), "r").otherwise("-"))
        parts.append(F.when(bit(2 << shift), "w").otherwise("-"))
        x = bit(1 << shift)
        parts.append(F.when(bit(special), F.when(x, low).otherwise(high)).otherwise(F.when(x, "x").otherwise("-")))
    return F.concat(*parts)


def mode_octal(mode: Column) -> Column:
    """A zero and the permission bits in octal, without padding."""
    return F.concat(F.lit("0"), F.conv(mode.bitwiseAND(0o777).cast("string"), 10, 8))


def flag_string(flags: Column) -> Column:
    """Sixteen positions, a letter where the flag is set and a dash elsewhere."""
    return F.concat(*[F.when(flags.bitwiseAND(1 << k) != 0, letter).otherwise("-") for k, letter in enumerate(FLAGS)])
