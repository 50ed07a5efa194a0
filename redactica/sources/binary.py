"""Binary outputs: masked DOCX by the standard library, PDF through PyMuPDF where it is installed.

Each function takes and gives bytes, so Spark reads the files, calls them in its tasks and writes through its own committers.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactica.operators import geometry
from redactica.sources.readers import _W, error_kind

Mask = Callable[[str], tuple[str, dict[str, int]]]
Rect = tuple[int, float, float, float, float]


def masked_docx(data: bytes, mask: Mask) -> tuple[bytes, dict[str, int]]:
    """A copy with every paragraph masked on its own. Runs keep their format where masking run by run says the same as masking the
    paragraph; else the paragraph's text goes to its first run."""
    source = zipfile.ZipFile(io.BytesIO(data))
    tree = ElementTree.fromstring(source.read("word/document.xml"))
    total: dict[str, int] = {}
    for paragraph in tree.iter(f"{_W}p"):
        texts = [t for run in paragraph.findall(f"{_W}r") for t in run.findall(f"{_W}t")]
        whole, counters = mask("".join(t.text or "" for t in texts))
        if not counters:
            continue
        for label, n in counters.items():
            total[label] = total.get(label, 0) + n
        parts = [mask(t.text or "")[0] for t in texts]
        if "".join(parts) != whole:
            parts = [whole] + [""] * (len(texts) - 1)
        for t, part in zip(texts, parts, strict=True):
            t.text = part
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in source.namelist():
            z.writestr(name, ElementTree.tostring(tree) if name == "word/document.xml" else source.read(name))
    return out.getvalue(), total


def masked_docx_files(files: DataFrame, mask: Mask) -> DataFrame:
    """Rows (path, content, counters, error_kind) of rows (path, content)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    content, counters = masked_docx(data.as_py(), mask)
                    out.append((path, content, list(counters.items()), None))
                except Exception as e:  # noqa: BLE001  a broken file is a row
                    out.append((path, None, None, error_kind(e, "docx")))
            kinds = [pa.string(), pa.binary(), pa.map_(pa.string(), pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["path", "content", "counters", "error_kind"])

    return files.select("path", "content").mapInArrow(each, "path string, content binary, counters map<string,bigint>, error_kind string")


def page_count(data: bytes) -> int | None:
    """Pages of a PDF; null on any failure."""
    try:
        import fitz

        with fitz.open(stream=data, filetype="pdf") as pdf:
            return pdf.page_count
    except Exception:  # noqa: BLE001
        return None


def burned_pdf(data: bytes, rects: list[Rect], pages: frozenset[int] | None = None, strip_signatures: bool = False) -> bytes:
    """A copy in which what lies under the boxes is gone and black; signature fields go only if asked, page by page, one at a time."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        for number, page in enumerate(pdf, 1):
            if pages is not None and number not in pages:
                continue
            if strip_signatures:
                while field := next((w for w in page.widgets() or () if w.field_type == fitz.PDF_WIDGET_TYPE_SIGNATURE), None):
                    page.delete_widget(field)
            own = [fitz.Rect(*r[1:]) for r in rects if r[0] == number]
            for r in own:
                page.add_redact_annot(r, fill=(0, 0, 0))
            if own:
                page.apply_redactions()
        return pdf.tobytes()


def found_text(data: bytes, values: list[str]) -> list[Rect]:
    """Boxes of exact texts on all pages."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        return [(n, r.x0, r.y0, r.x1, r.y1) for n, page in enumerate(pdf, 1) for v in values for r in page.search_for(v)]


def burn_list(rects: DataFrame, pages: frozenset[int] | None = None) -> DataFrame:
    """Rows (doc_id, rects): the boxes of each document that are to be burned, in scope."""
    box = F.struct("page", "x0", "y0", "x1", "y1")
    return geometry.in_scope(rects, pages).groupBy("doc_id").agg(F.array_sort(F.collect_set(box)).alias("rects"))
