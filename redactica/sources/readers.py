"""Sources: text, paged text, DOCX, PDF and images (through optional libraries), dictionaries, approved corpora, indexes, sidecars.

A reader never fails a batch: a file that cannot be read gives a row whose error_kind says why, and whose text is null.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactica.functions import catalogue as C

EXTENSIONS = ("txt", "docx", "pdf", "png", "jpg", "jpeg", "tif", "tiff")
READ = "path string, ext string, text string, error_kind string"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, ext, text, error_kind) of whole UTF-8 files; other bytes are an error, not replaced."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("path", F.lit("txt").alias("ext"), text.alias("text"), F.when(text.isNull(), "decode").alias("error_kind"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of the body, then cells of its tables, row by row; empty ones are skipped."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t"))
    parts = [said(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        parts += ["\n".join(said(p) for p in cell.findall(f"{_W}p")) for row in table.findall(f"{_W}tr") for cell in row.findall(f"{_W}tc")]
    return "\n".join(p for p in parts if p.strip())


def pdf_text(data: bytes) -> str:
    import pypdf  # optional

    pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]
    pages = [p for p in pages if p.strip()]
    if not pages:
        raise ValueError("empty_pdf")
    return C.PAGE_SEPARATOR.join(pages)


def image_text(data: bytes) -> str:
    import pytesseract  # optional
    from PIL import Image

    return pytesseract.image_to_string(Image.open(io.BytesIO(data)), lang="pol+eng")


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "pdf": pdf_text, **dict.fromkeys(EXTENSIONS[3:], image_text)}


def error_kind(error: Exception, ext: str) -> str:
    if isinstance(error, ImportError):
        return "dependency" if ext in ("docx", "pdf") else "ocr_unavailable"
    if isinstance(error, UnicodeDecodeError):
        return "decode"
    if isinstance(error, ValueError) and "empty_pdf" in str(error):
        return "empty_pdf"
    return "io" if isinstance(error, OSError) else "processing"


def files(spark: SparkSession, path: str) -> DataFrame:
    """All supported files below a folder, dispatched by their lower-cased extension; others are rows of kind 'unsupported'."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                try:
                    if kind not in EXTENSIONS:
                        out.append((name, kind, None, "unsupported"))
                    else:
                        out.append((name, kind, data.as_py().decode() if kind == "txt" else EXTRACTORS[kind](data.as_py()), None))
                except Exception as e:  # noqa: BLE001  any failure of a parser is a row
                    out.append((name, kind, None, error_kind(e, kind)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], ["path", "ext", "text", "error_kind"])

    return rows.select("path", ext.alias("ext"), "content").mapInArrow(each, READ)


def pages(docs: DataFrame, text_col: str = "text", keep_empty: bool = False) -> DataFrame:
    """Rows (doc_id, page, text), numbered from 1; the text path drops blank pages before it numbers them."""
    parts = F.split(text_col, "\n\f\n", -1)
    parts = parts if keep_empty else F.filter(parts, lambda p: F.trim(p) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("page"), "text")


def approved(spark: SparkSession, path: str) -> DataFrame:
    """Rows (source_file, text) of *_ANON.txt files, without a byte-order mark."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*_ANON.txt").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.regexp_replace(F.col("content").cast("string"), "^\\x{FEFF}", "").alias("text"))


def knowledge_index(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a written index; raises on missing fields and on source names that are paths."""
    rows = spark.read.schema("source_file string, chunk_id string, chunk_index int, text string").parquet(path)
    bad = rows["source_file"].isNull() | rows["chunk_id"].isNull() | rows["text"].isNull() | (F.coalesce("chunk_index", F.lit(0)) < 1) | rows["source_file"].rlike(r"[/\\]")
    checked = F.when(bad, F.raise_error(F.lit("malformed chunk")).cast("string")).otherwise(rows["source_file"])
    return rows.withColumn("source_file", checked)


def sidecar(text: Column, schema: str) -> Column:
    """A sidecar's JSON, leniently: what is malformed or of another type is null."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def ocr_words(boxes: DataFrame, zoom: float = 3.0) -> DataFrame:
    """Confident words of recognised boxes, in points of the page."""
    from redactica.operators.geometry import confident

    return confident(boxes).withColumns({c: F.col(c) / zoom for c in ("x0", "y0", "x1", "y1")})


def _typed(v: Column, path: str, kind: str) -> Column:
    """The value at a path if it is of that kind, as JSON has it: a number is no truth value, nor the other way round."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found).startswith(kind), found)


def selection(text: Column) -> Column:
    """Struct (labels, pages, strip_signatures) of a sidecar of selected categories.

    labels and pages are null, which means all, unless they are a list of strings, or of whole numbers from 1, that is not empty; one
    item of another type spoils its list. Signatures are stripped only where it says true. A sidecar that is no object selects nothing."""
    v = F.try_parse_json(text)

    def listed(name: str, kind: str) -> Column:
        items = F.try_variant_get(_typed(v, f"$.{name}", "ARRAY"), "$", "array<variant>")
        return F.when((F.size(items) > 0) & F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == kind, F.lit(False))), items)

    labels = F.transform(listed("active_labels", "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    pages = F.transform(listed("active_pages", "BIGINT"), lambda x: F.try_variant_get(x, "$", "bigint"))
    strip = F.coalesce(F.try_variant_get(_typed(v, "$.strip_signatures", "BOOLEAN"), "$", "boolean"), F.lit(False))
    in_order = lambda a: F.array_sort(F.array_distinct(a))
    return F.struct(in_order(labels).alias("labels"), F.when(F.forall(pages, lambda p: p >= 1), in_order(pages)).alias("pages"), strip.alias("strip_signatures"))


def manual_edits(text: Column) -> Column:
    """Struct (removed, added) of a sidecar of manual edits, each a list of boxes (page, label, x0, y0, x1, y1).

    A removed box is a list of six values, an added one an object; entries of another shape, or without a number where one belongs, are
    skipped. An added box of an unknown label, or of none, is a plain manual one."""
    v, names = F.try_parse_json(text), ("page", "label", "x0", "y0", "x1", "y1")

    def entries(name: str, kind: str, at: Callable[[int], str]) -> Column:
        items = F.coalesce(F.try_variant_get(_typed(v, f"$.{name}", "ARRAY"), "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))
        if kind == "ARRAY":
            items = F.filter(items, lambda x: F.coalesce(F.size(F.try_variant_get(x, "$", "array<variant>")) == 6, F.lit(False)))
        shaped = F.filter(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith(kind), F.lit(False)))
        kinds = ("bigint", "string", *["double"] * 4)
        boxes = F.transform(shaped, lambda x: F.struct(*[F.try_variant_get(x, at(i), k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]))
        return F.filter(boxes, lambda b: b["page"].isNotNull() & b["x0"].isNotNull() & b["y0"].isNotNull() & b["x1"].isNotNull() & b["y1"].isNotNull())

    known = F.transform(entries("added", "OBJECT", lambda i: f"$.{names[i]}"), lambda b: b.withField("label", F.when(b["label"].isin(*C.MANUAL_LABELS), b["label"]).otherwise(C.MANUAL_LABELS[0])))
    return F.struct(entries("removed", "ARRAY", lambda i: f"$[{i}]").alias("removed"), known.alias("added"))


def stored_suggestions(text: Column) -> Column:
    """Struct (comparison, narrative, fingerprint, resolved) of a sidecar of suggestions: two objects as JSON and a string, null if they
    are none, and the ids that were accepted or rejected; other entries are left out."""
    v = F.try_parse_json(text)
    said = F.coalesce(F.try_variant_get(_typed(v, "$.resolved", "OBJECT"), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    resolved = F.map_filter(F.transform_values(said, lambda k, x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda k, x: F.coalesce(x.isin("accepted", "rejected"), F.lit(False)))
    results = [F.to_json(_typed(v, f"$.{name}_result", "OBJECT")).alias(name) for name in ("comparison", "narrative")]
    return F.struct(*results, F.try_variant_get(_typed(v, "$.original_text_sha256", "STRING"), "$", "string").alias("fingerprint"), resolved.alias("resolved"))
