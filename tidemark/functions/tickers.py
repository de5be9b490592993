"""Ticker strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of share classes and their canonical form.
SHARE_CLASSES = {"BRK-B": "BRK.B", "BRKB": "BRK.B", "BF-B": "BF.B", "BFB": "BF.B"}


def normalize_ticker(c: Column) -> Column:
    """Trimmed, upper case, without a trailing ``.US``, ``_`` as ``-``, share classes in canonical form."""
    t = F.translate(F.regexp_replace(F.upper(F.trim(c)), r"\.US$", ""), "_", "-")
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SHARE_CLASSES.items() for x in pair))[t], t)


def vendor_ticker(c: Column) -> Column:
    """Upper case, ``.`` as ``-``."""
    return F.replace(F.upper(c), F.lit("."), F.lit("-"))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def ticker_from_member(c: Column) -> Column:
    """Basename without one extension, normalised."""
    return normalize_ticker(F.regexp_replace(basename(c), r"\.[^.]*$", ""))


def extension(c: Column) -> Column:
    """Lower-case suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(basename(c), r"[^.](\.[^.]+)$", 1))
