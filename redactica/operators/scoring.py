"""Quality scoring against answer keys: policy, coverage of characters, over-masking, baselines, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions import grid


def expectation(tag: Column, enabled: tuple[str, ...] = ()) -> Column:
    """must, optional or keep of a policy tag; raises on an unknown one."""
    names = F.create_map(*[F.lit(x) for pair in C.POLICY.items() for x in pair])
    opt_in = [t for t, c in C.POLICY_ONLY_WITH.items() if c not in enabled]
    known = F.coalesce(F.try_element_at(names, tag), F.raise_error(F.concat(F.lit("unknown policy tag "), tag)).cast("string"))
    return F.when(tag.isin(*opt_in), "optional").otherwise(known)


def invalid_keys(spans: DataFrame, chars: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (doc_id, span_id, reason) of keys that are not well formed."""
    dup = spans.groupBy("doc_id", "span_id").count().filter("count > 1").select("doc_id", "span_id", F.lit("duplicate id").alias("reason"))
    bare = spans.join(chars, ["doc_id", "span_id"], "left_anti").select("doc_id", "span_id", F.lit("no characters").alias("reason"))
    out = spans.join(pages, "doc_id", "left").filter("page < 1 or page > coalesce(page_count, 0)").select("doc_id", "span_id", F.lit("page out of range").alias("reason"))
    return dup.unionByName(bare).unionByName(out)


def inside(x: str, y: str, prefix: str, tolerance: float = C.POINT_TOLERANCE) -> Column:
    return F.expr(f"{x} between {prefix}x0 - {tolerance} and {prefix}x1 + {tolerance} and {y} between {prefix}y0 - {tolerance} and {prefix}y1 + {tolerance}")


def new_fills(source: DataFrame, output: DataFrame) -> DataFrame:
    """Filled boxes of the output that the source does not have, with multiplicity, white ones left out."""
    dark = lambda d: d.filter("not (r > 0.95 and g > 0.95 and b > 0.95)").select("doc_id", "page", *[F.round(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return dark(output).exceptAll(dark(source))


def _centred(chars: DataFrame) -> DataFrame:
    return chars.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


def char_status(chars: DataFrame, fills: DataFrame, glyphs: DataFrame | None = None) -> DataFrame:
    """Adds covered and leaked to key characters (doc_id, span_id, page, i, c, box).

    With the output's glyphs a character leaks if the same glyph is still there; without, if no fill covers its centre."""
    c = _centred(chars)
    f = fills.select("doc_id", "page", *[F.col(k).alias(f"f{k}") for k in ("x0", "y0", "x1", "y1")])
    key, centre = ["doc_id", "span_id", "i"], ("cx", "cy", "cx", "cy")
    cover = grid.meeting(c, f, ["doc_id", "page"], inside("cx", "cy", "f"), centre, ("fx0", "fy0", "fx1", "fy1"), C.POINT_TOLERANCE).select(key).distinct().withColumn("covered", F.lit(True))
    rows = c.join(grid.apart(cover), key, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    if glyphs is None:
        return rows.withColumn("leaked", ~F.col("covered"))
    g = glyphs.select("doc_id", "page", "c", *[F.col(k).alias(f"g{k}") for k in ("x0", "y0", "x1", "y1")])
    met = grid.meeting(c, g, ["doc_id", "page", "c"], inside("cx", "cy", "g", C.GLYPH_TOLERANCE), centre, ("gx0", "gy0", "gx1", "gy1"), C.GLYPH_TOLERANCE)
    still = met.select(key).distinct().withColumn("leaked", F.lit(True))
    return rows.join(grid.apart(still), key, "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)))


def leaks(centres: Column, boxes: Column, tolerance: float = C.POINT_TOLERANCE) -> Column:
    """How many centres (cx, cy) of characters lie in none of the boxes of their page, both in one row: `char_status` without a join, for
    pages of few boxes."""

    def within(c: Column, b: Column) -> Column:
        return c["cx"].between(b["x0"] - tolerance, b["x1"] + tolerance) & c["cy"].between(b["y0"] - tolerance, b["y1"] + tolerance)

    return F.size(F.filter(centres, lambda c: ~F.exists(boxes, lambda b: within(c, b))))


def span_scores(status: DataFrame) -> DataFrame:
    """Rows (doc_id, span_id, total, leaked, residue, status) of characters' status."""
    rows = status.groupBy("doc_id", "span_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("leaked")).alias("leaked"), F.count_if(F.col("leaked") & F.col("covered")).alias("residue"))
    return rows.withColumn("status", F.when(F.col("leaked") == 0, "covered").when(F.col("leaked") >= F.col("total"), "full").otherwise("partial"))


def layer(label: Column) -> Column:
    return F.when(label.startswith("NER_"), "ner").when(label.isin(*C.MANUAL_LABELS), "manual").otherwise("regex")


def over_redaction(fills: DataFrame, chars: DataFrame) -> DataFrame:
    """Fills that touch no key character."""
    c = _centred(chars).select("doc_id", "page", "cx", "cy").distinct()
    box = ["doc_id", "page", "x0", "y0", "x1", "y1"]
    met = grid.meeting(c, fills.select(box).distinct(), ["doc_id", "page"], inside("cx", "cy", ""), ("cx", "cy", "cx", "cy"), tolerance=C.POINT_TOLERANCE)
    return fills.join(grid.apart(met.select(box).distinct()), box, "left_anti")


def doc_summary(scores: DataFrame) -> DataFrame:
    """Per document, of span scores with `expect`: must, covered, partial, full, keep_redacted, residue."""
    must, keep = F.col("expect") == "must", F.col("expect") == "keep"
    return scores.groupBy("doc_id").agg(
        F.count_if(must).alias("must"),
        F.count_if(must & (F.col("status") == "covered")).alias("covered"),
        F.count_if(must & (F.col("status") == "partial")).alias("partial"),
        F.count_if(must & (F.col("status") == "full")).alias("full"),
        F.count_if(keep & (F.col("leaked") < F.col("total"))).alias("keep_redacted"),
        F.count_if(~keep & (F.col("residue") > 0)).alias("residue"),
    )


def words_under(over: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (doc_id, page, word): source words (doc_id, page, word, box) with their centre in a fill of over_redaction, once for each."""
    w = _centred(words).select("doc_id", "page", "word", "cx", "cy")
    boxes = over.select("doc_id", "page", "x0", "y0", "x1", "y1")
    return grid.meeting(w, boxes, ["doc_id", "page"], inside("cx", "cy", ""), ("cx", "cy", "cx", "cy"), tolerance=C.POINT_TOLERANCE).select("doc_id", "page", "word")


def doc_details(scores: DataFrame, layers: DataFrame, over: DataFrame) -> DataFrame:
    """Per document, of span scores with `expect`: must and covered, the sorted ids of spans that are partial, full, keep_redacted and
    residue, over_rects, and the map layers, which counts covered spans by the layers (doc_id, span_id, layer) that hid them; '?' if
    none is known. over has the fills of over_redaction."""
    must, keep, covered = F.col("expect") == "must", F.col("expect") == "keep", F.col("status") == "covered"
    ids = lambda c, name: F.array_sort(F.collect_list(F.when(c, F.col("span_id")))).alias(name)
    rows = scores.groupBy("doc_id").agg(F.count_if(must).alias("must"), F.count_if(must & covered).alias("covered"), ids(must & (F.col("status") == "partial"), "partial"), ids(must & (F.col("status") == "full"), "full"), ids(keep & (F.col("leaked") < F.col("total")), "keep_redacted"), ids(~keep & (F.col("residue") > 0), "residue"))
    hidden = scores.filter(must & covered).select("doc_id", "span_id").join(grid.apart(layers.select("doc_id", "span_id", "layer").distinct()), ["doc_id", "span_id"], "left")
    by_layer = hidden.groupBy("doc_id", F.coalesce("layer", F.lit("?")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))
    maps = by_layer.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n")))).alias("layers"))
    rects = over.groupBy("doc_id").agg(F.count(F.lit(1)).alias("over_rects"))
    none = F.expr("cast(map() as map<string,bigint>)")
    return rows.join(grid.apart(rects), "doc_id", "left").join(grid.apart(maps), "doc_id", "left").withColumns({"over_rects": F.coalesce("over_rects", F.lit(0).cast("long")), "layers": F.coalesce("layers", none)})


def recall(summary: DataFrame) -> DataFrame:
    return summary.agg(F.sum("must").alias("must"), F.sum("covered").alias("covered"), F.round(100 * F.sum("covered") / F.sum("must"), 1).alias("recall"))


def graded_suggestions(suggestions: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds verdict and duplicate to suggestions (doc_id, ord, finding_type, sentences); targets (doc_id, ord, expect, status) are the
    key spans each points at, none at all (expect null) for a place without any; a suggestion without target rows is unresolved."""
    t = targets.groupBy("doc_id", "ord").agg(F.max(F.coalesce((F.col("expect") == "must") & (F.col("status") != "covered"), F.lit(False))).alias("leak"), F.max(F.coalesce(F.col("expect") == "must", F.lit(False))).alias("must"), F.max(F.coalesce(F.col("expect") == "optional", F.lit(False))).alias("optional"))
    rows = suggestions.join(t, ["doc_id", "ord"], "left")
    verdict = (
        F.when(F.col("finding_type") == "unnecessary_redaction", F.when(F.col("must"), "unnecessary_wrong").otherwise("unnecessary"))
        .when(F.col("must").isNull(), "unresolved").when(F.col("leak"), "hit").when(F.col("must"), "already_redacted").when(F.col("optional"), "optional_only").otherwise("false_positive")
    )
    seen = F.row_number().over(Window.partitionBy("doc_id", "sentences").orderBy("ord")) > 1
    return rows.withColumns({"verdict": verdict, "duplicate": seen & (F.size("sentences") > 0)}).drop("leak", "must", "optional")


def baseline_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows (doc_id, span_id, change) between two tables of leaking spans (doc_id, span_id, status partial or full)."""
    b = before.withColumnRenamed("status", "was")
    rows = now.join(b, ["doc_id", "span_id"], "full")
    change = F.when(F.col("was").isNull(), "new leak").when(F.col("status").isNull(), "leak gone").when((F.col("status") == "full") & (F.col("was") == "partial"), "leak grew")
    return rows.select("doc_id", "span_id", change.alias("change")).filter("change is not null")


def _weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    return sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def _shape(value: Column, pattern: str, valid: Column) -> Column:
    return F.coalesce(F.when(value.rlike(pattern), valid), F.lit(False))


def pesel_valid(value: Column) -> Column:
    return _shape(value, "^[0-9]{11}$", (10 - _weighted(value, C.PESEL_WEIGHTS) % 10) % 10 == F.substring(value, 11, 1).cast("int"))


def nip_valid(value: Column) -> Column:
    digits = F.replace(value, F.lit("-"), F.lit(""))
    return _shape(digits, "^[0-9]{10}$", _weighted(digits, C.NIP_WEIGHTS) % 11 == F.substring(digits, 10, 1).cast("int"))


def regon_valid(value: Column) -> Column:
    return _shape(value, "^[0-9]{9}$", _weighted(value, C.REGON_WEIGHTS) % 11 % 10 == F.substring(value, 9, 1).cast("int"))


def iban_valid(value: Column) -> Column:
    compact = F.replace(value, F.lit(" "), F.lit(""))
    check = 98 - F.concat(F.substring(compact, 5, 24), F.lit("252100")).cast("decimal(38,0)") % 97
    return _shape(compact, "^PL[0-9]{26}$", F.substring(compact, 3, 2).cast("int") == check)


def line_boxes(chars: DataFrame) -> DataFrame:
    """Rows (doc_id, span_id, page, x0, y0, x1, y1): characters in order, a new box where the next centre leaves the line's height."""
    from redactica.functions.spans import empty

    boxes = F.transform(F.array_sort(F.collect_list(F.struct("i", "x0", "y0", "x1", "y1"))), lambda c: F.struct(*[c[k].cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")]))
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"

    def step(acc: Column, b: Column) -> Column:
        last, mid = F.try_element_at(acc, F.lit(-1)), (b["y0"] + b["y1"]) / 2
        same = (F.size(acc) > 0) & (mid >= last["y0"]) & (mid <= last["y1"])
        wider = F.struct(F.least(last["x0"], b["x0"]).alias("x0"), F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(b)))

    rows = chars.groupBy("doc_id", "span_id", "page").agg(boxes.alias("b"))
    return rows.select("doc_id", "span_id", "page", F.explode(F.aggregate("b", empty(kind), step)).alias("r")).select("doc_id", "span_id", "page", "r.*")
