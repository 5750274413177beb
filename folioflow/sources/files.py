"""Files to texts: TXT, HTML, EPUB, DOCX, with their metadata; uploads checked; PDF by whatever parser is installed.

Files are read by Spark's binaryFile source, so they may lie in any store; a file is parsed in the task that holds its bytes. One that can't be
parsed gives a row with an error instead of failing the job.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T

MOST_BYTES = 100 << 20
# Content types that go with an extension.
MIME_TYPES = {
    ".txt": ["text/plain", "application/octet-stream"],
    ".pdf": ["application/pdf"],
    ".docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/octet-stream"],
    ".epub": ["application/epub+zip", "application/octet-stream"],
}
EXTRACTED = "text string, parser string, page_count int, title string, author string, language string, publisher string, description string, published string, error string"
HIDDEN_TAGS = ("script", "style", "nav")


def files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows (path, file_name, extension, length, content, file_hash, error); the content of a larger file isn't read, its row says so."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    own = ["path", name.alias("file_name"), extension(name).alias("extension"), "length"]
    # The limit is pushed into the scan, so contents are read of the smaller files only.
    read = rows.where(F.col("length") <= most_bytes).select(*own, "content", F.sha2("content", 256).alias("file_hash"), F.lit(None).cast("string").alias("error"))
    large = rows.where(F.col("length") > most_bytes).select(*own, F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("file_hash"), F.concat(F.lit(f"larger than {most_bytes} bytes: "), "length").alias("error"))
    return read.unionByName(large)


def extension(name: Column | str) -> Column:
    found = F.regexp_extract(F.lower(T.col(name)), r"(\.[^./]+)$", 1)
    return F.nullif(found, F.lit(""))


def upload_error(name: Column | str, mime: Column | str) -> Column:
    """What is wrong with an upload's name and type; null if nothing is."""
    allowed = F.create_map(*(x for e, ms in MIME_TYPES.items() for x in (F.lit(e), F.array(*map(F.lit, ms)))))
    e, m = extension(name), F.nullif(F.lower(T.col(mime)), F.lit(""))
    return F.when(e.isNull() | ~F.coalesce(F.map_contains_key(allowed, e), F.lit(False)), "unsupported extension").when(m.isNotNull() & ~F.array_contains(allowed[e], m), "unsupported type")


def html_text(page: Column | str) -> Column:
    """A page's text in one line, without scripts, styles, menus and tags. Entities are decoded where they are common."""
    out = F.regexp_replace(F.coalesce(T.col(page), F.lit("")), r"(?s)<!--.*?-->|<![^>]*>", " ")
    for tag in HIDDEN_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return T.one_space(out)


def plain_html(page: str) -> str:
    """The same for a page inside an archive, with all entities."""
    out = re.sub(r"(?s)<!--.*?-->|<[!?][^>]*>", " ", page)
    for tag in HIDDEN_TAGS:
        out = re.sub(rf"(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\Z)", " ", out)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", out)).split())


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def epub(content: bytes) -> dict:
    """Text in the order of the spine, else of all pages; Dublin Core metadata."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        pages, about, opf = [], {}, None
        if "META-INF/container.xml" in names:
            opf = next((e.get("full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if local(e.tag) == "rootfile"), None)
        if opf in names:
            items, spine = {}, []
            for e in ET.fromstring(z.read(opf)).iter():
                tag = local(e.tag)
                if tag == "item":
                    items[e.get("id")] = e.get("href")
                elif tag == "itemref":
                    spine.append(e.get("idref"))
                elif tag in ("title", "creator", "language", "publisher", "date", "description") and (e.text or "").strip():
                    about.setdefault(tag, e.text.strip())
            pages = [posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[i])) for i in spine if items.get(i)]
        if not pages:
            pages = sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")) and not n.lower().startswith("meta-inf/"))
        texts = [plain_html(z.read(n).decode("utf-8", "replace")) for n in pages if n in names]
    keys = {"title": "title", "author": "creator", "language": "language", "publisher": "publisher", "description": "description", "published": "date"}
    return {"text": "\n\n".join(t for t in texts if t), "parser": "epub"} | {k: about.get(v) for k, v in keys.items()}


def docx(content: bytes) -> dict:
    """Paragraphs that aren't blank, then table rows with cells between bars; core properties."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
        about = {local(e.tag): (e.text or "").strip() for e in ET.fromstring(z.read("docProps/core.xml")).iter()} if "docProps/core.xml" in z.namelist() else {}
    words = lambda e: "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")
    tables = [e for e in body.iter() if local(e.tag) == "tbl"]
    inside = {p for t in tables for p in t.iter() if local(p.tag) == "p"}
    parts = [words(p) for p in body.iter() if local(p.tag) == "p" and p not in inside]
    for row in (r for t in tables for r in t.iter() if local(r.tag) == "tr"):
        parts.append(" | ".join(c for c in (" ".join(words(p) for p in cell.iter() if local(p.tag) == "p").strip() for cell in row if local(cell.tag) == "tc") if c))
    return {"text": "\n\n".join(p for p in parts if p.strip()), "parser": "docx", "title": about.get("title") or None, "author": about.get("creator") or None, "description": about.get("subject") or None, "published": about.get("created") or None}


def pdf(content: bytes) -> dict:
    """Pages behind [Page n] marks, by PyMuPDF in reading order, else by pypdf."""
    try:
        import fitz
    except ImportError:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("no PDF parser is installed") from e
        reader = PdfReader(io.BytesIO(content))
        texts = [p.extract_text() or "" for p in reader.pages]
        about = {str(k).lstrip("/").lower(): str(v) for k, v in (reader.metadata or {}).items()}
        parser = "pypdf"
    else:
        with fitz.open(stream=content, filetype="pdf") as doc:
            texts = ["\n".join(b[4].strip() for b in sorted(page.get_text("blocks"), key=lambda b: (round(b[1], 1), round(b[0], 1))) if b[4].strip()) for page in doc]
            about = dict(doc.metadata or {})
        parser = "pymupdf"
    marked = [f"[Page {i}]\n{t}" for i, t in enumerate(texts, 1)]
    return {"text": "\n\n".join(marked), "parser": parser, "page_count": len(texts), "title": about.get("title") or None, "author": about.get("author") or None}


PARSERS = {".txt": lambda content: {"text": content.decode("utf-8", "replace"), "parser": "text"}, ".epub": epub, ".docx": docx, ".pdf": pdf, ".html": lambda content: {"text": plain_html(content.decode("utf-8", "replace")), "parser": "html"}}


def extracted(found: DataFrame) -> DataFrame:
    """files() with the columns of EXTRACTED in place of the content."""
    keep = ["path", "file_name", "extension", "length", "file_hash"]
    names = [f.split()[0] for f in EXTRACTED.split(", ")]
    types = [pa.int32() if f.split()[1] == "int" else pa.string() for f in EXTRACTED.split(", ")]

    def parsed(kind: str | None, content: bytes | None, error: str | None) -> dict:
        try:
            if error is not None:
                return {"error": error}
            if kind not in PARSERS:
                raise ValueError(f"unsupported extension {kind}")
            return PARSERS[kind](content)
        except Exception as e:  # noqa: BLE001  a bad file is a row with an error
            return {"error": f"{type(e).__name__}: {e}"}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file's text at a time
                got = parsed(batch.column(2)[i].as_py(), batch.column(5)[i].as_py(), batch.column(6)[i].as_py())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(5)), *(pa.array([got.get(n)], t) for n, t in zip(names, types, strict=True))], [*keep, *names])

    return found.select(*keep, "content", "error" if "error" in found.columns else F.lit(None).cast("string").alias("error")).mapInArrow(run, f"path string, file_name string, extension string, length long, file_hash string, {EXTRACTED}")


def published_date(c: Column | str) -> Column:
    """A date of ISO form, else of its first ten characters."""
    text = T.stripped(T.col(c))
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")), F.try_to_timestamp(F.left(text, F.lit(10)), F.lit("yyyy-MM-dd"))).cast("date")


def with_request(found: DataFrame, asked: DataFrame, key: str = "path") -> DataFrame:
    """File metadata under what a request says: blank values of the request don't count."""
    fields = [c for c in asked.columns if c != key]
    joined = found.join(asked.select(key, *(F.col(c).alias(f"__{c}") for c in fields)), key, "left")
    over = {c: F.coalesce(F.nullif(T.one_space(f"__{c}"), F.lit("")), F.col(c) if c in found.columns else F.lit(None)) for c in fields}
    return joined.withColumns(over).drop(*(f"__{c}" for c in fields))
