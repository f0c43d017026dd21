"""Spans of regular expressions as DataFrame functions: every match with its place, in code points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One span. ``rank`` orders kinds that start together.
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"

#: A span with up to NEAR characters before and after it, whatever was matched there.
PLACED = "struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>"

NEAR = 256


@dataclass(frozen=True)
class Rule:
    """A kind of span: its pattern, what of a match decides, a cheap pattern that any match contains, and the version of all that."""

    kind: str
    pattern: str
    keep: Callable[[Column], Column] | None = None
    guard: str | None = None
    version: str = "1"


#: Elements that running() folds at a time, so that its arrays are not copied once per element.
STRETCH = 128


def once(value: Column, work: Callable[[Column], Column]) -> Column:
    """``work(value)`` with the value computed once: within a lambda an expression is computed again for each element."""
    return F.element_at(F.transform(F.array(value), work), 1)


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """The outputs (type ``out``) of ``step(state, item) -> (state, output)`` over an array, in order."""
    return once(items, lambda it: _running(it, start, step, out))


def _running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    none = F.array().cast(f"array<{out}>")
    last = F.floor((F.size(items) - 1) / STRETCH).cast("int")
    stretches = F.when(F.size(items) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def one(acc: Column, item: Column) -> Column:
        state, put = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(put.cast(out))).alias("out"))

    def stretch(acc: Column, i: Column) -> Column:
        # what is done stays outside the inner fold, which would hand it on with every element
        return F.aggregate(
            F.slice(items, i * STRETCH + 1, STRETCH),
            F.struct(acc["state"].alias("state"), none.alias("out")),
            one,
            lambda a: F.struct(a["state"].alias("state"), F.concat(acc["done"], F.array(a["out"])).alias("done")),
        )

    zero = F.struct(start.alias("state"), F.array().cast(f"array<array<{out}>>").alias("done"))
    return F.aggregate(stretches, zero, stretch, lambda a: F.flatten(a["done"]))


def found(text: Column, rule: Rule, rank: int, *, placed: bool = False) -> Column:
    """The kept matches of ``rule`` in ``text``, leftmost and non-overlapping; matches that are not kept still use their text up.

    The pattern never matches an empty string, so splitting by it gives one piece more than there are matches; the
    pieces' and matches' lengths add up to the places. With ``placed`` each match carries the text around it, handed on
    from match to match, so that a long text takes linear time.
    """
    kind = PLACED if placed else SPAN
    none = F.array().cast(f"array<{kind}>")

    def one(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        return end, F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), pair["match"].alias("value"))

    def one_before(state: Column, pair: Column) -> tuple[Column, Column]:
        near = F.right(F.concat(state["near"], pair["gap"]), F.lit(NEAR))
        end, span = one(state["at"], pair)
        return F.struct(end.alias("at"), F.right(F.concat(near, pair["match"]), F.lit(NEAR)).alias("near")), F.struct(span.alias("span"), near.alias("near"))

    def one_after(near: Column, pair: Column) -> tuple[Column, Column]:
        return F.left(F.concat(pair["gap"], pair["match"], near), F.lit(NEAR)), near

    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        F.split(text, rule.pattern, -1),
        lambda match, gap: F.struct(match.alias("match"), gap.alias("gap")),
    )

    def around(pairs: Column) -> Column:
        last, pairs = F.element_at(pairs, -1)["gap"], F.filter(pairs, lambda p: p["match"].isNotNull())
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("near"))
        befores = running(pairs, start, one_before, f"struct<span:{SPAN},near:string>")
        afters = F.reverse(running(F.reverse(pairs), F.left(last, F.lit(NEAR)), one_after, "string"))
        return F.zip_with(befores, afters, lambda b, after: F.struct(*[b["span"][c].alias(c) for c in ("start", "rank", "end", "kind", "value")], b["near"].alias("before"), after.alias("after")))

    everything = once(pairs, around) if placed else running(F.filter(pairs, lambda p: p["match"].isNotNull()), F.lit(0), one, SPAN)
    if rule.keep:
        everything = F.filter(everything, lambda s: rule.keep(s["value"]))
    return F.when(F.rlike(text, F.lit(rule.guard or rule.pattern)), everything.cast(f"array<{kind}>")).otherwise(none)


def all_found(text: Column, rules: list[Rule], *, placed: bool = False) -> Column:
    """The spans of all rules, by start, then in the order of the rules."""
    return F.sort_array(F.concat(*[found(text, r, i, placed=placed) for i, r in enumerate(rules)]))


def digest(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans of these kinds (default: all), joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, name: Callable[[Column], Column]) -> Column:
    """``text`` with each span (sorted by start; of overlapping ones the first and what it covers) replaced by its name."""

    def one(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0)))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.concat(gap, name(s))).otherwise(F.lit(""))

    tail = F.substring(text, F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)) + 1, F.length(text))
    return F.concat(F.array_join(running(spans, F.lit(0), one, "string"), ""), tail)
