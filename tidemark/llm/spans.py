"""Matches of patterns as spans, in DataFrame expressions only.

``split`` gives the gaps between matches and ``regexp_extract_all`` the matches; their lengths, added up, give the
places. Lengths are in code points. Patterns must not match the empty string. Long repetitions are written
possessively, which Java's matcher runs as loops: no text can overflow its stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements summed up in one of the next level, as a power of two; spans cut out of the text together.
_SHIFT, _TOGETHER = 4, 64


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once even where f uses it many times."""
    return F.element_at(F.transform(F.array(x), f), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _before(x: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of numbers from 0 on, the merged ones before it (0 before the first).

    Long arrays are merged in levels, each with a sixteenth of the elements of the one below, so an element takes a
    few from each level and the whole grows little faster than the array.
    """

    def every(v: Column, first: Column, end: Column) -> Column:
        """The elements [first, end) merged. Places, not slices: a slice inside a lambda copies the array."""
        return F.when(end > first, F.aggregate(F.sequence(first, end - 1), F.lit(0), lambda a, j: merge(a, F.get(v, j)))).otherwise(0)

    def up(v: Column) -> Column:
        low = lambda b: F.shiftleft(b, _SHIFT)
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(v), _SHIFT)), lambda b: every(v, low(b), F.least(low(b) + (1 << _SHIFT), F.size(v))))

    def part(v: Column, i: Column, level: int) -> Column:
        """Elements of a level that lie before i and after what the next level has of it."""
        own = F.shiftright(i, _SHIFT * level)
        return every(v, F.shiftleft(F.shiftright(own, _SHIFT), _SHIFT), own)

    def long(a: Column, b: Column, c: Column) -> Column:
        return F.transform(x, lambda _, i: merge(merge(every(c, F.lit(0), F.shiftright(i, 3 * _SHIFT)), part(b, i, 2)), merge(part(a, i, 1), part(x, i, 0))))

    short = F.transform(x, lambda _, i: every(x, F.lit(0), i))
    return F.when(F.size(x) <= 2 << _SHIFT, short).otherwise(let(up(x), lambda a: let(up(a), lambda b: let(up(b), lambda c: long(a, b, c)))))


def sums_before(x: Column) -> Column:
    """For each element, the sum of those before it."""
    return let(x, lambda v: _before(v, lambda a, b: a + b))


def most_before(x: Column) -> Column:
    """For each element, the largest of those before it, 0 at least."""
    return let(x, lambda v: _before(v, lambda a, b: F.greatest(a, b)))


def cut(text: Column, spans: Column) -> Column:
    """The substrings at ``spans`` (start, end; ascending and apart). A place in a text is found from its begin, so runs
    of spans are cut out first and the spans out of these."""
    return let(spans, lambda v: _cut(text, v))


def _cut(text: Column, spans: Column) -> Column:
    run = lambda b: F.slice(spans, b * _TOGETHER + 1, F.lit(_TOGETHER))
    of = lambda t, at, s: F.substr(t, s["start"] - at + 1, s["end"] - s["start"])

    def parts(ss: Column) -> Column:
        low = F.element_at(ss, 1)["start"]
        return let(F.substr(text, low + 1, F.element_at(ss, -1)["end"] - low), lambda t: F.transform(ss, lambda s: of(t, low, s)))

    none = F.array().cast("array<string>")
    return F.when(F.size(spans) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _TOGETHER).cast("int")), lambda b: let(run(b), parts)))).otherwise(none)


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with every span (start, end, put) replaced by its ``put``; of overlapping spans the first counts, and the
    rest up to the last end goes with it."""

    def done(ss: Column) -> Column:
        ends = F.transform(ss, lambda s: s["end"])

        def apart_(before: Column) -> Column:
            kept = F.filter(F.zip_with(ss, before, lambda s, m: F.struct(m.alias("start"), s["start"].alias("end"), s["put"].alias("put"))), lambda g: g["end"] >= g["start"])
            gaps = lambda k: cut(text, F.concat(F.transform(k, lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"))), F.array(F.struct(F.array_max(ends).alias("start"), F.length(text).alias("end")))))
            return let(kept, lambda k: F.array_join(F.zip_with(gaps(k), F.transform(k, lambda g: g["put"]), lambda g, put: F.concat(g, F.coalesce(put, F.lit("")))), ""))

        return let(most_before(ends), apart_)

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), done)).otherwise(text)


SPAN = "array<struct<kind:string,start:int,end:int,value:string,part:string>>"


def matches(text: Column, kind: str, pattern: str, may: Column, keep: Callable[[Column], Column], group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (kind, start, end, value, part), part the value of ``group``.

    may: a cheap condition without which there is no match; keep: which matches count.
    """
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))

    def spans(v: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        parts = F.regexp_extract_all(text, p, F.lit(group)) if group else v
        # gaps are one more than matches: match i starts after gaps 0..i and matches 0..i-1
        starts = let(F.slice(gaps, F.lit(1), F.size(v)), lambda g: F.zip_with(let(F.zip_with(g, v, lambda a, x: a + F.length(x)), sums_before), g, lambda s, a: s + a))
        rows = F.zip_with(F.arrays_zip(v.alias("v"), parts.alias("part")), starts, lambda m, s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m["v"])).alias("end"), m["v"].alias("value"), m["part"].alias("part")))
        return F.filter(rows, keep)

    none = F.array().cast(SPAN)
    return F.when(may, let(found, lambda v: F.when(F.size(v) > 0, spans(v)).otherwise(none))).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``. Many others are looked at by runs of neighbours first."""
    return let(spans, lambda v: let(others, lambda o: _apart(v, o)))


def _apart(spans: Column, others: Column) -> Column:
    hit = lambda o, s: (s["start"] < o["end"]) & (o["start"] < s["end"])
    places = lambda v, b: F.sequence(b * _TOGETHER, F.least((b + 1) * _TOGETHER, F.size(v)) - 1)

    def up(v: Column) -> Column:
        """The reach of each run: (start, end)."""
        reach = lambda p: F.struct(F.array_min(F.transform(p, lambda j: F.get(v, j)["start"])).alias("start"), F.array_max(F.transform(p, lambda j: F.get(v, j)["end"])).alias("end"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _TOGETHER).cast("int")), lambda b: let(places(v, b), reach))

    def long(o: Column) -> Column:
        def none(a: Column, b: Column) -> Column:
            inside = lambda s, k: hit(F.get(a, k), s) & F.exists(places(o, k), lambda j: hit(F.get(o, j), s))
            every = F.sequence(F.lit(0), F.size(b) - 1)
            return F.filter(spans, lambda s: ~F.exists(every, lambda i: hit(F.get(b, i), s) & F.exists(places(a, i), lambda k: inside(s, k))))

        return let(up(o), lambda a: let(up(a), lambda b: none(a, b)))

    short = F.filter(spans, lambda s: ~F.exists(others, lambda o: hit(o, s)))
    return F.when((F.size(others) <= _TOGETHER) | (F.size(spans) == 0), short).otherwise(let(F.array_sort(F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end")))), long))
