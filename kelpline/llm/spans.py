"""Matches of a regular expression with their places, in built-in functions only.

A span is a struct (kind, start, end, text, before, after): code points from 0, end
exclusive, and some characters on each side. Kinds are numbers, so that arrays of spans sort
by kind as listed. The matches of one pattern don't overlap and are in order, which lets
places, overlaps and replacements be found by runs of 64: the work for a text grows little
faster than its length, however many spans it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN, _BLOCK = 64, 1024
#: Characters of context before and after a span.
BEFORE, AFTER = 24, 2
SPAN = "array<struct<kind:int,start:int,end:int,text:string,before:string,after:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def with_(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _runs(values: Column, fold: Callable[[Column], Column]) -> Column:
    """fold(run) for each run of 64 elements of an array that isn't empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _RUN).cast("int")), lambda k: fold(F.slice(values, k * _RUN + 1, _RUN)))


def _prefix(values: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], empty: Column, f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """f(upto), where upto(i) folds the first i elements of ``values``."""
    over = lambda part: F.when(F.size(part) > 0, fold(part)).otherwise(empty)

    def inner(v: Column) -> Column:
        before = with_(_runs(v, fold), lambda sums: F.transform(sums, lambda _, k: over(F.slice(sums, 1, k))))
        place = lambda i: F.floor(i / _RUN).cast("int")
        at = lambda b, i: F.coalesce(F.try_element_at(b, place(i) + 1), over(F.slice(v, 1, 0)))
        return with_(before, lambda b: f(lambda i: F.when(place(i) < F.size(b), join(at(b, i), over(F.slice(v, place(i) * _RUN + 1, i % _RUN)))).otherwise(over(v))))

    return with_(values, inner)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str, kind: int, test: Column) -> Column:
    """Leftmost non-overlapping matches of a Java pattern that has no empty match. ``test`` is a
    cheap condition that every text with a match fulfils. What lies before each match comes
    from ``split`` with the same pattern. The context of a span reaches back to the end of the
    last match but one, and on to the end of the next."""

    def spans(found: Column, between: Column) -> Column:
        steps = F.zip_with(F.transform(F.slice(between, 1, F.size(found)), lambda p: F.length(p)), F.transform(found, lambda m: F.length(m)), lambda a, b: a + b)
        part = lambda a, i: F.coalesce(F.try_element_at(a, i), F.lit(""))
        before = lambda i: F.right(F.concat(F.when(i > 0, F.concat(F.right(part(between, F.greatest(i, F.lit(1))), F.lit(BEFORE)), F.right(part(found, F.greatest(i, F.lit(1))), F.lit(BEFORE)))).otherwise(""), F.right(part(between, i + 1), F.lit(BEFORE))), F.lit(BEFORE))
        after = lambda i: F.left(F.concat(F.left(part(between, i + 2), F.lit(AFTER)), F.left(part(found, i + 2), F.lit(AFTER))), F.lit(AFTER))
        span = lambda upto: lambda m, i: with_(upto(i + 1), lambda end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("text"), before(i).alias("before"), after(i).alias("after")))
        return _prefix(steps, _sum, lambda a, b: a + b, F.lit(0), lambda upto: F.transform(found, span(upto)))

    some = lambda found: F.when(F.size(found) > 0, with_(F.split(text, pattern, -1), lambda between: spans(found, between))).otherwise(none())
    return F.when(test, with_(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)).otherwise(none())


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _meeting(taken: Column, f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """f(meet), where meet(c) are those of ``taken`` that overlap c. ``taken`` is in order and
    doesn't overlap itself, so they are neighbours: those that end after c's start, up to the
    last that starts before c's end."""

    def count(t: Column, heads: Column, passes: Callable[[Column], Column]) -> Column:
        """How many at the beginning of ``t`` pass; heads: the first of each run."""
        return with_(F.size(F.filter(heads, passes)), lambda k: F.when(k > 0, (k - 1) * _RUN + F.size(F.filter(F.slice(t, (k - 1) * _RUN + 1, _RUN), passes))).otherwise(0))

    def inner(t: Column) -> Column:
        def meet(heads: Column) -> Callable[[Column], Column]:
            def of(c: Column) -> Column:
                few = F.filter(t, lambda x: overlaps(x, c))
                many = with_(count(t, heads, lambda x: x["end"] <= c["start"]), lambda a: F.slice(t, a + 1, F.greatest(count(t, heads, lambda x: x["start"] < c["end"]) - a, F.lit(0))))
                return F.when(F.size(t) <= _RUN, few).otherwise(many)

            return of

        return with_(_runs(t, lambda run: run[0]), lambda heads: f(meet(heads)))

    return with_(taken, inner)


def _left(found: Column, taken: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """Those c of ``found`` that keep(those of ``taken`` that overlap c, c) holds for."""

    def left(found: Column) -> Column:
        kept = _meeting(taken, lambda meet: F.filter(found, lambda c: keep(meet(c), c)))
        return F.when((F.size(found) > 0) & (F.size(taken) > 0), kept).otherwise(found)

    return with_(found, left)


def apart(found: Column, taken: list[Column]) -> Column:
    """Those of ``found`` that overlap none of ``taken`` (arrays in order, none overlapping itself)."""
    for t in taken:
        found = _left(found, t, lambda met, _: F.size(met) == 0)
    return found


def best(found: Column, others: list[Column], better: Callable[[Column, Column], Column]) -> Column:
    """Those of ``found`` that overlap none of ``others`` that is better."""
    for t in others:
        found = _left(found, t, lambda met, c: ~F.exists(met, lambda o: better(o, c)))
    return found


def joined(found: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_start(found: Column) -> Column:
    """Sorted by start, then kind."""
    rest = ("end", "text", "before", "after")
    turned = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), *[s[c].alias(c) for c in rest])))
    return F.transform(turned, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), *[s[c].alias(c) for c in rest]))


def replaced(text: Column, found: Column, by: str) -> Column:
    """The text with every span, overlapping ones as one, replaced by a word. The text is cut into
    blocks once, so that no piece is looked for from the text's start."""

    def between(blocks: Column, a: Column, b: Column) -> Column:
        block = lambda i: F.floor(i / _BLOCK).cast("int")
        part = lambda i: F.coalesce(F.try_element_at(blocks, block(i) + 1), F.lit(""))
        inside = F.substring(part(a), a % _BLOCK + 1, b - a)
        across = F.concat(F.substring(part(a), a % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(blocks, block(a) + 2, F.greatest(block(b) - block(a) - 1, F.lit(0))), ""), F.substring(part(b), F.lit(1), b % _BLOCK))
        return F.when(block(a) == block(b), inside).otherwise(across)

    def cut(spans: Column, blocks: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])

        def pieces(upto: Callable[[Column], Column]) -> Column:
            each = F.transform(spans, lambda s, i: with_(upto(i), lambda before: F.when(s["start"] >= before, F.concat(between(blocks, before, s["start"]), F.lit(by))).otherwise("")))
            return F.concat(F.array_join(each, ""), between(blocks, upto(F.size(spans)), F.length(text)))

        return _prefix(ends, F.array_max, F.greatest, F.lit(0), pieces)

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0))
    return F.when(F.size(found) > 0, with_(by_start(found), lambda spans: with_(blocks, lambda b: cut(spans, b)))).otherwise(text)
