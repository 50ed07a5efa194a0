"""Span algebra on columns: spans are arrays of structs (s, e), half-open offsets in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN, LINED = "struct<s:int,e:int>", "struct<s:int,e:int,line:int>"
SPANS = f"array<{SPAN}>"
#: Noncharacters, which mark matches.
MARKS = "\ufdd0\ufdd1\ufdd2"
#: Matches that are appended to one array; more are put together from blocks, as appending copies what is there.
BLOCK = 256
#: Elements that are looked at one by one rather than by halving.
FEW = 16


def empty(kind: str = SPANS) -> Column:
    return F.expr(f"cast(array() as {kind})")


def found(text: Column, pattern: str | Column) -> Column:
    """All matches of a JVM pattern."""
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))


def _pair(a: str, x: Column, b: str, y: Column) -> Column:
    """A struct whose names also hold beside a generator, where aliases inside of expressions get lost."""
    return F.named_struct(F.lit(a), x, F.lit(b), y)


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def scan(items: Column, state: Column, kind: str, step, last=None) -> Column:
    """A fold over an array that gives out elements of a kind on its way: step(state, x) is the next state and an array of what comes
    out, last(state) what comes out in the end. What has come out is appended block by block, so the time is about linear."""

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return _pair("state", after, "out", F.concat(acc["out"], out))

    def few(block: Column, before: Column) -> Column:
        return F.aggregate(block, _pair("state", before, "out", empty(f"array<{kind}>")), one)

    def ended(acc: Column) -> Column:
        return acc["out"] if last is None else F.concat(acc["out"], last(acc["state"]))

    def many(acc: Column, block: Column) -> Column:
        return once(few(block, acc["state"]), lambda r: _pair("state", r["state"], "out", F.concat(acc["out"], F.array(r["out"]))))

    def whole(all_: Column) -> Column:
        blocks = F.aggregate(_blocks(all_), _pair("state", state, "out", empty(f"array<array<{kind}>>")), many, lambda acc: _pair("state", acc["state"], "out", F.flatten(acc["out"])))
        return F.when(F.size(all_) <= BLOCK, ended(few(all_, state))).otherwise(once(blocks, ended))

    return once(items, whole)


def first_at(items: Column, place: Column, field: str = "s") -> Column:
    """How many elements of an array, sorted by a field, lie before a place."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + 1)).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        lower = F.element_at(items, F.least(mid + 1, F.size(items)))[field] < place
        return F.when(acc["lo"] >= acc["hi"], acc).when(lower, _pair("lo", mid + 1, "hi", acc["hi"])).otherwise(_pair("lo", acc["lo"], "hi", mid))

    halved = F.aggregate(steps, _pair("lo", F.lit(0), "hi", F.size(items)), halve, lambda acc: acc["lo"])
    return F.when(F.size(items) <= FEW, F.size(F.filter(items, lambda x: x[field] < place))).otherwise(halved)


def spans(text: Column, pattern: str | Column, lines: bool = False) -> Column:
    """Spans of all matches of a pattern that matches no empty string; with `lines` they have the number of line breaks before them too.

    One search marks the matches, and the pieces between the marks add up to places. The marks are code points that no text is to hold;
    in one that does, they stand for a third such code point."""
    first, last, other = MARKS
    clean = F.when(F.contains(text, F.lit(first)) | F.contains(text, F.lit(last)), F.translate(text, first + last, other * 2)).otherwise(text)
    marked = F.regexp_replace(clean, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(f"{first}$0{last}"))
    parts = F.split(marked, first, -1)  # what is before the first match, and each match with what follows it
    breaks = (lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))) if lines else (lambda x: F.lit(0))

    def pair(a: Column, b: Column) -> Column:
        return F.named_struct(F.lit("g"), F.length(a) - F.instr(a, last), F.lit("m"), F.instr(b, last) - 1, F.lit("n"), breaks(a))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s, line = at["s"] + x["g"], at["e"] + x["n"]
        span = F.named_struct(F.lit("s"), s, F.lit("e"), s + x["m"], F.lit("line"), line) if lines else _pair("s", s, "e", s + x["m"])
        return _pair("s", s + x["m"], "e", line), F.array(span)

    def one(a: Column, b: Column) -> Column:
        line = [F.lit("line"), breaks(a)] if lines else []
        return F.transform(F.array(F.length(a)), lambda n: F.named_struct(F.lit("s"), n, F.lit("e"), n + F.instr(b, last) - 1, *line))

    def of(all_: Column) -> Column:
        sizes = F.zip_with(F.slice(all_, F.lit(1), F.size(all_) - 1), F.slice(all_, F.lit(2), F.size(all_) - 1), pair)
        many = scan(sizes, _pair("s", F.lit(0), "e", F.lit(0)), LINED if lines else SPAN, step)
        return F.when(F.size(all_) <= 1, empty(f"array<{LINED if lines else SPAN}>")).when(F.size(all_) == 2, one(F.element_at(all_, 1), F.element_at(all_, 2))).otherwise(many)

    return F.when(text.isNull(), F.lit(None)).otherwise(once(parts, of))


def once(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def value(text: Column, span: Column) -> Column:
    return F.substring(text, span["s"] + 1, span["e"] - span["s"])


def before(text: Column, start: Column, n: int) -> Column:
    """Up to n characters before an offset."""
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def merged(sorted_spans: Column) -> Column:
    """Overlapping spans (touching ones not) become one."""

    def step(open_: Column, x: Column) -> tuple[Column, Column]:
        goes_on = open_.isNotNull() & (x["s"] < open_["e"])
        joined = _pair("s", open_["s"], "e", F.greatest(open_["e"], x["e"]))
        return F.when(goes_on, joined).otherwise(_pair("s", x["s"], "e", x["e"])), F.when(open_.isNull() | goes_on, empty()).otherwise(F.array(open_))

    return scan(sorted_spans, F.lit(None).cast(SPAN), SPAN, step, lambda open_: F.when(open_.isNull(), empty()).otherwise(F.array(open_)))


def disjoint(sorted_spans: Column, kind: str) -> Column:
    """Of spans sorted by their start, each that begins where or after the last one that stays has ended."""
    return scan(sorted_spans, F.lit(0), kind, lambda end, x: (F.when(x["s"] >= end, x["e"]).otherwise(end), F.when(x["s"] >= end, F.array(x)).otherwise(empty(f"array<{kind}>"))))


def free_of(taken: Column, x: Column) -> Column:
    """Whether a span overlaps none of disjoint, sorted ones."""
    n = first_at(taken, x["s"])
    clear = once(n, lambda k: ((k == 0) | (F.try_element_at(taken, F.greatest(k, F.lit(1)))["e"] <= x["s"])) & ((k == F.size(taken)) | (F.try_element_at(taken, k + 1)["s"] >= x["e"])))
    return F.when(F.size(taken) <= FEW, ~F.exists(taken, lambda y: overlaps(x, y))).otherwise(clear)


def ranked_claims(found: Column, kind: str, ranks: int, overlapping: tuple[int, ...] = ()) -> Column:
    """Of spans (s, e, r, ...) with a rank (r) those that overlap none of a lower rank that stays, sorted; those of a rank in `overlapping`
    may overlap each other, and the first of them stays. Where two have the same place, the lower rank decides for both. If what is left
    is disjoint, all of it stays; else a rank at a time, and each span is looked up among those that stay by halving."""

    def by_rank(all_: Column) -> Column:
        def step(taken: Column, rank: Column) -> Column:
            def of(new: Column) -> Column:
                left = F.filter(new, lambda x: free_of(taken, x))
                left = F.when(rank.isin(*overlapping), disjoint(F.sort_array(left), kind)).otherwise(left) if overlapping else left
                return F.when(F.size(new) == 0, taken).otherwise(F.sort_array(F.concat(taken, left)))

            return once(F.filter(all_, lambda x: x["r"] == rank), of)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ranks - 1)), empty(f"array<{kind}>"), step)

    def before(all_: Column, i: Column) -> Column:
        return F.element_at(all_, F.greatest(i, F.lit(1)))

    def placed(all_: Column) -> Column:
        return F.filter(all_, lambda x, i: (i == 0) | (before(all_, i)["s"] != x["s"]) | (before(all_, i)["e"] != x["e"]))

    def whole(all_: Column) -> Column:
        clashes = F.filter(all_, lambda x, i: (i > 0) & (before(all_, i)["e"] > x["s"]))
        return F.when(F.size(clashes) == 0, all_).otherwise(by_rank(all_))

    return once(once(F.sort_array(F.filter(found, lambda x: x["s"] < x["e"])), placed), whole)


def first_claim(ranked_spans: Column, kind: str) -> Column:
    """Keeps, in order, every span that overlaps none kept before. `ranked_claims` does so without the square of
    their number."""
    return F.aggregate(ranked_spans, empty(kind), lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def spliced(text: Column, sorted_spans: Column, mark) -> Column:
    """The text with mark(span) in the place of each span."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, mark(x)).alias("out"))

    return F.aggregate(sorted_spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def line_of(text: Column, offset: Column) -> Column:
    """Line breaks before an offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
