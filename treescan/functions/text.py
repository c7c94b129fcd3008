"""Text: times, quoting, masks, names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """Seconds since 1970 as ``YYYY-MM-DD HH:MM:SS``."""
    return F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")


def local_clock(seconds: Column) -> Column:
    """The same in the session's time zone, which is the machine's unless it is set."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def csv_field(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def quoted(text: Column) -> Column:
    """In quotes as it is: quotes within are not escaped."""
    return F.concat(F.lit('"'), text, F.lit('"'))


def masked(path: Column) -> Column:
    """Each name of two or more characters as three stars and its last character."""
    return F.regexp_replace(path, "([^/]+)([^/])", "***$2")


def shortened(text: Column, width: int = 20) -> Column:
    """The last `width` characters after three dots, where it is longer."""
    return F.when(F.length(text) > width, F.concat(F.lit("..."), F.right(text, F.lit(width)))).otherwise(text)


def bounded(text: Column, size: int) -> Column:
    """What fits into `size` bytes with one for the end: at most ``size - 1`` bytes of UTF-8, and no part of a character."""
    if size < 1:
        raise ValueError("the end takes one byte")
    raw, n = text.cast("binary"), size - 1

    def goes_on(k: int) -> Column:  # whether byte k belongs to a character that began before
        return F.substring(raw, k, 1).between(F.lit(b"\x80"), F.lit(b"\xbf")) if k > 0 else F.lit(False)

    fit = F.when(~goes_on(n + 1), n).when(~goes_on(n), n - 1).when(~goes_on(n - 1), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(raw, F.lit(1), F.greatest(fit, F.lit(0))).cast("string"))


def elapsed(seconds: Column) -> Column:
    """Days, hours, minutes and seconds: ``1d 02:03:04``."""
    s = seconds.cast("bigint")
    return F.format_string("%dd %02d:%02d:%02d", F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)


def joined_path(parent: Column, name: Column) -> Column:
    """Parent, slash, name; the parent's own slashes stay."""
    return F.concat_ws("/", parent, name)


# The names of a scan's files beside its base name.
FILES = {
    "index": "%s.idx",
    "slice": "%s_%06d.pbin",
    "slice_index": "%s_%06d.idx",
    "frontier": "%s_%06d.fpbin",
    "archive": "%s.archive",
    "skipped": "%s.spbin",
}


def file_name(kind: str, base: Column, number: Column | None = None) -> Column:
    return F.format_string(FILES[kind], base, *([number] if "%06d" in FILES[kind] else []))


def setting(line: Column) -> tuple[Column, Column]:
    """Key and value of ``key=value``, parted at the first sign."""
    parts = F.split(line, "=", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def owner(name: Column, number: Column) -> Column:
    """``name(id)``, or the id where there is no name."""
    return F.coalesce(F.concat(name, F.lit("("), number.cast("string"), F.lit(")")), number.cast("string"))


def fingerprint(path: Column, dev: Column, ino: Column) -> Column:
    """Identity of an entry as a hex digest. The path belongs to it."""
    return F.md5(F.concat_ws("|", path, dev.cast("string"), ino.cast("string")))


def shard(digest: Column, bits: int = 6) -> Column:
    """The top bits of a digest's first byte (at most eight)."""
    return F.shiftright(F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"), 8 - bits)


def backoff(failures: Column, first: int = 5, most: int = 300) -> Column:
    """Seconds to the next probe: doubles with each failure up to a limit."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2), F.least(failures, F.lit(30)))).cast("bigint")
