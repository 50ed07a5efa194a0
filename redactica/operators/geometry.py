"""Words, spans and rectangles. Pages stay apart, and on a page only what is near meets: offsets by bins, boxes by cells of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions import grid
from redactica.functions import spans as S
from redactica.functions.regex import java
from redactica.sources.scratch import stored

PAGE = ["doc_id", "page"]


def word_pages(words: DataFrame) -> DataFrame:
    """Adds start and end offsets to words (doc_id, page, block_no, line_no, word_no, text): blanks within a line, line breaks between."""
    w = Window.partitionBy(*PAGE).orderBy("block_no", "line_no", "word_no")
    same = (F.lag("block_no").over(w) == F.col("block_no")) & (F.lag("line_no").over(w) == F.col("line_no"))
    sep = F.when(F.lag("word_no").over(w).isNull(), "").when(same, " ").otherwise("\n")
    rows = words.withColumn("sep", sep).withColumn("end", F.sum(F.length("sep") + F.length("text")).over(w).cast("int"))
    return rows.withColumn("start", F.col("end") - F.length("text"))


def page_text(placed: DataFrame) -> DataFrame:
    """Rows (doc_id, page, text) of placed words."""
    parts = F.array_sort(F.collect_list(F.struct("start", "sep", "text")))
    return placed.groupBy(*PAGE).agg(F.concat_ws("", F.transform(parts, lambda x: F.concat(x["sep"], x["text"]))).alias("text"))


def confident(words: DataFrame, least: int = C.MIN_OCR_CONFIDENCE) -> DataFrame:
    """Recognised words that are not blank and sure enough; a confidence that is no number is none."""
    return words.filter((F.trim("text") != "") & (F.coalesce(F.expr("try_cast(conf as double)"), F.lit(-1.0)) >= least))


def renumbered_lines(words: DataFrame) -> DataFrame:
    """Adds line_no: lines of a block counted from 0 over its paragraphs."""
    w = Window.partitionBy(*PAGE, "block_no").orderBy("par_no", "ocr_line")
    return words.withColumn("line_no", F.dense_rank().over(w) - 1)


_HYPHEN = C.HYPHENS.replace("-", r"\-")
_PAD = "".join("\\" + c if c in r"[]\^-&" else c for c in C.SAFE_PADDING)


def safe_padding(text: Column, hyphen_at_start: bool) -> Column:
    """Whether what a span leaves of a word may be hidden with it: marks and blanks, or the rest of a hyphenated name."""
    plain = java(rf"^[\s{_PAD}]*$")
    rest = java(rf"[\p{{L}}{_HYPHEN}\s{_PAD}]+")
    name = f"^[{_HYPHEN}]{rest}$" if hyphen_at_start else f"^{rest}[{_HYPHEN}]$"
    return text.rlike(plain) | text.rlike(name)


def span_words(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (span_id, doc_id, page, label, *word) of the words under each span (span_id, doc_id, page, label, s, e) that maps to words."""
    spans = stored(spans, "spans")
    reach = spans.groupBy(*PAGE).agg(F.min("s").alias("_s"), F.max("e").alias("_e"))
    # words stay on their page's partition; those that no span of the page reaches are not dealt out over bins
    near = grid.apart(placed).join(grid.apart(reach), PAGE).filter("end > _s and start < _e").drop("_s", "_e")
    hit = grid.overlapping(spans, near, PAGE, ("s", "e"), ("start", "end"))
    w = Window.partitionBy(*PAGE, "span_id")
    first = F.min(F.struct("start", "end", "text")).over(w)
    last = F.max(F.struct("start", "end", "text")).over(w)
    hit = hit.withColumns({"first": first, "last": last})
    left = F.substring("first.text", F.lit(1), F.greatest(F.col("s") - F.col("first.start"), F.lit(0)))
    cut = F.greatest(F.col("last.end") - F.col("e"), F.lit(0))
    right = F.substring(F.col("last.text"), F.length("last.text") - cut + 1, cut)
    return hit.filter(safe_padding(left, False) & safe_padding(right, True)).drop("first", "last")


def line_rects(mapped: DataFrame) -> DataFrame:
    """Rows (span_id, doc_id, page, label, x0, y0, x1, y1): consecutive words on one line become one box."""
    w = Window.partitionBy(*PAGE, "span_id").orderBy("start")
    new = F.coalesce(((F.lag("block_no").over(w) != F.col("block_no")) | (F.lag("line_no").over(w) != F.col("line_no"))).cast("int"), F.lit(0))
    rows = mapped.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    box = [F.round(f(c), 2).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return rows.groupBy("span_id", *PAGE, "label", "run").agg(*box).drop("run")


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def page_rects(text: Column, words: Column, spans: Column) -> Column:
    """The boxes of `line_rects` of one page whose words (s, e, line, box), sorted, and spans (s, e) lie in one row: each span's words are
    found by halving. A crowded page is better left in rows."""

    def side(under: Column, name: str, f) -> Column:
        return F.round(f(F.transform(under, lambda w: w[name])), 2)

    def box(under: Column) -> Column:
        return F.named_struct(*[x for name, f in (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max)) for x in (F.lit(name), side(under, name, f))])

    def lines(under: Column) -> Column:
        several = F.transform(F.array_distinct(F.transform(under, lambda w: w["line"])), lambda n: S.once(F.filter(under, lambda w: w["line"] == n), box))
        return F.when(F.element_at(under, 1)["line"] == F.element_at(under, -1)["line"], F.array(box(under))).otherwise(several)

    def of(span: Column, words: Column) -> Column:
        first, end = S.first_at(words, span["s"] + 1, "e"), S.first_at(words, span["e"], "s")
        under = S.once(first, lambda k: F.slice(words, k + 1, F.greatest(end - k, F.lit(0))))

        def kept(under: Column) -> Column:
            start, stop = F.element_at(under, 1)["s"], F.element_at(under, -1)["e"]
            left = F.substring(text, start + 1, F.greatest(span["s"] - start, F.lit(0)))
            right = F.substring(text, span["e"] + 1, F.greatest(stop - span["e"], F.lit(0)))
            return safe_padding(left, False) & safe_padding(right, True)

        return S.once(under, lambda u: F.when(F.size(u) == 0, S.empty(f"array<{BOX}>")).when(kept(u), lines(u)).otherwise(S.empty(f"array<{BOX}>")))

    return S.once(words, lambda all_: F.flatten(F.transform(spans, lambda x: of(x, all_))))


RECT = ["doc_id", "page", "label", "x0", "y0", "x1", "y1"]


def resolved_rects(rects: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Distinct boxes without those a user removed; the smallest span id keeps a box."""
    left = rects if removed is None else rects.join(removed.select(RECT), RECT, "left_anti")
    return left.groupBy(RECT).agg(F.min("span_id").alias("span_id"))


def span_status(spans: DataFrame, rects: DataFrame, kept: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows (span_id, label, status): applied if a box is its own, removed if the user removed all its boxes, else unmapped."""
    own = kept.select("span_id").distinct().withColumn("applied", F.lit(True))
    left = rects.join(removed.select(RECT), RECT, "left_anti").select("span_id").distinct().withColumn("left", F.lit(True))
    any_ = rects.select("span_id").distinct().withColumn("any", F.lit(True))
    rows = spans.join(own, "span_id", "left").join(left, "span_id", "left").join(any_, "span_id", "left")
    return rows.select("span_id", "label", F.when(F.col("applied"), "applied").when(F.col("any") & F.col("left").isNull(), "removed").otherwise("unmapped").alias("status"))


def trimmed(rects: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Boxes (rect_id, ...) pulled back from glyphs that they graze, unless that would uncover a glyph they cover."""
    g = glyphs.select(*PAGE, *[F.col(c).alias(f"g{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = grid.meeting(rects, g, PAGE, "least(gx1, x1) > greatest(gx0, x0) and least(gy1, y1) > greatest(gy0, y0)", b_box=("gx0", "gy0", "gx1", "gy1"))
    mid, covered = "(gy0 + gy1) / 2", "(gy0 + gy1) / 2 between y0 and y1"
    edges = hit.groupBy("rect_id").agg(
        F.expr(f"count_if({covered})").alias("n"),
        F.expr(f"max(case when not {covered} and {mid} < y0 then gy1 end)").alias("top"),
        F.expr(f"min(case when not {covered} and {mid} > y1 then gy0 end)").alias("bottom"),
        F.expr(f"collect_list(case when {covered} then struct(gy0, gy1) end)").alias("own"),
    )
    rows = rects.join(grid.apart(edges), "rect_id", "left").withColumns({"ny0": F.greatest("y0", F.coalesce("top", "y0")), "ny1": F.least("y1", F.coalesce("bottom", "y1"))})
    share = F.forall("own", lambda o: F.least(o["gy1"], F.col("ny1")) - F.greatest(o["gy0"], F.col("ny0")) >= C.COVERED_GLYPH_SHARE * (o["gy1"] - o["gy0"]))
    ok = (F.coalesce("n", F.lit(0)) > 0) & share
    return rows.select(*[c for c in rects.columns if c not in ("y0", "y1")], F.when(ok, F.col("ny0")).otherwise(F.col("y0")).alias("y0"), F.when(ok, F.col("ny1")).otherwise(F.col("y1")).alias("y1"))


def overlapping(rects: DataFrame, areas: DataFrame) -> DataFrame:
    """Boxes that share a line with an area: overlap sideways, and over half of the lower height in common."""
    a = areas.select(*PAGE, *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    shorter = "least(y1 - y0, ay1 - ay0)"
    cond = f"x0 < ax1 and ax0 < x1 and {shorter} > 0 and least(y1, ay1) - greatest(y0, ay0) > 0.5 * {shorter}"
    sides = ["x0", "y0", "x1", "y1"]
    met = grid.meeting(rects.select(*PAGE, *sides).distinct(), a, PAGE, cond, b_box=("ax0", "ay0", "ax1", "ay1"))
    return rects.join(grid.apart(met.select(*PAGE, *sides).distinct()), [*PAGE, *sides], "left_semi")


def visible(automatic: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """What is hidden after manual edits: automatic boxes that were not removed, and added ones."""
    return automatic.select(RECT).join(removed.select(RECT), RECT, "left_anti").unionByName(added.select(RECT))


def apply_pending(removed: DataFrame, added: DataFrame, pending: DataFrame, automatic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, added) after pending removals: of an automatic box it is noted, of an added one the box goes."""
    auto = pending.select(RECT).join(automatic.select(RECT), RECT, "left_semi")
    return removed.select(RECT).unionByName(auto).distinct(), added.select(RECT).join(pending.select(RECT), RECT, "left_anti")


def in_scope(rows: DataFrame, pages: frozenset[int] | None) -> DataFrame:
    return rows if pages is None else rows.filter(F.col("page").isin(*pages))


def redaction_status(applied: Column, unmapped: Column) -> Column:
    return F.when(unmapped > 0, "completed_with_warnings").when(applied > 0, "completed").otherwise("no_matches")
