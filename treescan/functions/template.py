"""Format templates, compiled to one string expression."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import modes, text

DEFAULT = "%p|%s|%m"
#: Columns of the CSV form.
CSV = "%i,%p,%s,%u,%g,%U,%G,%o,%O,%t,%m,%c"
NO_FLAGS = "[unsupported]   "


def _text(name: str) -> Column:
    return F.col(name).cast("string")


#: What each letter stands for; times are seconds until a clock is known.
FIELDS: dict[str, Callable[[], Column]] = {
    "p": lambda: F.col("path"),
    "s": lambda: _text("size"),
    "u": lambda: text.owner(F.col("user_name"), F.col("uid")),
    "g": lambda: text.owner(F.col("group_name"), F.col("gid")),
    "U": lambda: _text("uid"),
    "G": lambda: _text("gid"),
    "m": lambda: F.col("mtime"),
    "a": lambda: F.col("atime"),
    "c": lambda: F.col("ctime"),
    "t": lambda: modes.type_label(F.col("mode")),
    "i": lambda: _text("ino"),
    "o": lambda: modes.mode_string(F.col("mode")),
    "O": lambda: modes.mode_octal(F.col("mode")),
    "X": lambda: F.col("xattr"),
}
TIMES = {"m", "a", "c"}
#: Switches in the order in which they come, and their letters.
SWITCHES = {"size": "s", "user": "u", "group": "g", "mtime": "m", "atime": "a", "ctime": "c", "mode": "o", "inode": "i", "xattr": "X"}


def from_switches(**on: bool) -> str:
    """The template of a set of switches: the path, then each of them; the default if there is none."""
    if unknown := on.keys() - SWITCHES.keys():
        raise ValueError(f"unknown switches: {sorted(unknown)}")
    letters = [letter for name, letter in SWITCHES.items() if on.get(name)]
    return "|".join(["%p", *(f"%{x}" for x in letters)]) if letters else DEFAULT


def parts_of(template: str) -> list[tuple[str, str]]:
    """Pairs ``("field", letter)`` and ``("text", literal)``.

    An unknown letter and a doubled percent sign stay as they are written, a percent sign at the
    end goes, and backslashes mean nothing.
    """
    out: list[tuple[str, str]] = []
    for piece in re.findall(r"%.|%$|[^%]+", template, flags=re.S):
        if piece[0] == "%" and piece[1:] in FIELDS:
            out.append(("field", piece[1:]))
        elif piece != "%":
            if out and out[-1][0] == "text":
                piece = out.pop()[1] + piece
            out.append(("text", piece))
    return out


def letters_of(template: str) -> set[str]:
    return {x for kind, x in parts_of(template) if kind == "field"}


def compiled(template: str = DEFAULT, csv: bool = False, quote: bool = False, local: bool = False) -> Column:
    """The line of a row. local: times in the session's time zone, else UTC. csv puts each field in quotes and doubles quotes within; quote, over which csv
    goes, doesn't double them. Needs the columns that the template names."""
    wrap = text.csv_field if csv else text.quoted if quote else (lambda c: c)
    clock = text.local_clock if local else text.clock
    columns = [wrap(clock(FIELDS[x]()) if x in TIMES else FIELDS[x]()) if kind == "field" else F.lit(x) for kind, x in parts_of(template)]
    return F.concat(*columns) if columns else F.lit("")
