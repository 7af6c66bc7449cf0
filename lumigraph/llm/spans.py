"""Matches of patterns as spans of code points.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind: string, start: int, end: int, hit: string, part: string>>"


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, f, least) -> Column:
    """f folded over all elements up to each, in log2(n) passes that double their reach; f(x, least) is x.

    A fold that appends to an array would copy what it has for each element.
    """
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    shifted = lambda acc, k: F.concat(F.array_repeat(F.lit(least), F.pow(F.lit(2), k).cast("int")), acc)
    return F.aggregate(passes, values, lambda acc, k: F.slice(F.zip_with(acc, shifted(acc, k), f), 1, F.size(acc)))


def spans(text: Column, kind: str, pattern: str | Column, group: int = 0) -> Column:
    """All matches, leftmost and non-overlapping, of a pattern that never matches the empty string.

    `part` is the match's `group`.  Positions are running sums of the lengths
    of what the pattern parts and of the matches themselves.
    """
    how = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.struct(F.split(text, how, -1).alias("gaps"), F.regexp_extract_all(text, how, F.lit(0)).alias("hits"))

    def placed(x: Column) -> Column:
        ends = running(F.zip_with(F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda a, b: F.length(a) + F.length(b)), lambda a, b: a + b, 0)
        parts = F.regexp_extract_all(text, how, F.lit(group)) if group else x["hits"]

        def one(s: Column) -> Column:
            start = s["end"] - F.length(s["hit"])
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), s["part"].alias("part"))

        return F.transform(F.arrays_zip(x["hits"].alias("hit"), parts.alias("part"), ends.alias("end")), one)

    return F.when(F.rlike(text, how), let(found, placed)).otherwise(F.array().cast(SPAN))


def listed(of: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(of: Column, kind: str) -> Column:
    return F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long")


def ordered(of: Column, kinds: list[str], by_start: bool) -> Column:
    """Spans by start, then kind as listed, or by kind as listed, then start."""

    def rank(s: Column) -> Column:
        out = F.lit(len(kinds))
        for i, k in enumerate(kinds):
            out = F.when(s["kind"] == k, F.lit(i)).otherwise(out)
        return out

    def key(s: Column) -> Column:
        first, second = (s["start"], rank(s)) if by_start else (rank(s), s["start"])
        return F.struct(first.alias("a"), second.alias("b"), s["end"].alias("c"))

    return F.transform(F.array_sort(F.transform(of, lambda s: F.struct(key(s).alias("key"), s.alias("span")))), lambda x: x["span"])


def replaced(text: Column, of: Column, by) -> Column:
    """`text` with each span replaced by `by(span)`; overlapping spans go together, by what the first of them says."""
    spans = ordered(of, [], True)
    many = F.size(of) > 64  # then a text is cut into characters once instead of being walked through for each span

    def joined(x: Column) -> Column:
        s, high, chars = x["spans"], x["high"], x["chars"]
        heads = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["start"] >= F.get(high, i - 2)))
        piece = lambda a, n: F.when(many, F.array_join(F.slice(chars, a + 1, n), "")).otherwise(F.substring(text, a + 1, n))
        last = lambda h: F.when(h > 1, F.get(high, h - 2)).otherwise(0)  # noqa: E731  the end of what was replaced before
        start = lambda h: F.get(s, h - 1)["start"]
        body = F.transform(heads, lambda h: F.concat(piece(last(h), start(h) - last(h)), by(F.get(s, h - 1))))
        end = F.element_at(high, -1)
        return F.concat(F.array_join(body, ""), piece(end, F.greatest(F.length(text) - end, F.lit(0))))

    found = F.struct(spans.alias("spans"), running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0).alias("high"), F.when(many, F.split(text, "")).alias("chars"))
    return F.when(F.size(of) > 0, let(found, joined)).otherwise(text)
