"""Document readers: HTML and Markdown as column expressions, PDF over Arrow batches, files by extension."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import structured_text
from larkspur.session import ship_package

BLOCKS = "|".join("article aside blockquote br details div figcaption figure footer h[1-6] header hr li main nav ol p pre section summary table tr ul".split())
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))


def html_text(html: Column) -> Column:
    """Visible text of HTML: scripts, styles and comments out, blocks on lines of their own, blank lines out."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*|/)?>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for name, char in ENTITIES:
        t = F.regexp_replace(t, f"&{name};", char)
    lines = F.transform(F.split(t, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def markdown_text(markdown: Column) -> Column:
    """Plain text of Markdown: marks unwrapped, headings kept, list and quote signs and rules out."""
    t = F.regexp_replace(markdown, r"(?s)```[^\n]*\n(.*?)```", "$1")
    for pattern in (r"!\[([^\]]*)\]\([^)]+\)", r"\[([^\]]+)\]\([^)]+\)", r"`([^`]+)`", *(f"{sign}{{1,3}}(.+?){sign}{{1,3}}" for sign in (r"\*", "_")), r"~~(.+?)~~"):
        t = F.regexp_replace(t, pattern, "$1")
    t = F.regexp_replace(t, "<[^>]+>", "")

    def line(x: Column) -> Column:
        x = F.trim(x)
        bare = F.when(F.rlike(x, F.lit(r"^[-*+]\s+")), F.regexp_replace(x, r"^[-*+]\s+", "")).otherwise(F.regexp_replace(x, r"^\d+\.\s+", ""))
        bare = F.regexp_replace(bare, r"^>+\s*", "")
        return F.when(F.startswith(x, F.lit("#")), x).when(F.rlike(bare, F.lit(r"^[-*_]{3,}$")), F.lit("")).otherwise(bare)

    return F.array_join(F.filter(F.transform(F.split(t, r"\n"), line), lambda x: x != ""), "\n")


def title_of(text: Column, path: Column) -> Column:
    """The first level-one heading among ten lines, else the file's name without its extension."""
    head = F.filter(F.slice(F.split(text, r"\n"), 1, 10), lambda x: F.startswith(F.trim(x), F.lit("# ")))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(F.size(head) > 0, F.trim(F.substring(F.trim(F.try_element_at(head, F.lit(1))), F.lit(3), F.length(text)))).otherwise(name)


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_BLOCK = re.compile(rb"BT(.*?)ET", re.S)
_OPERATOR = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:\\.|[^\]])*\]\s*TJ|(-?[\d.]+)\s+(-?[\d.]+)\s+T[dD]|T\*", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)


def pdf_text(raw: bytes) -> str:
    """Text of simple PDFs: shown strings of every text block; a vertical move over 14 begins a paragraph."""
    pieces: list[str] = []

    def scan(content: bytes) -> None:
        for block in _BLOCK.findall(content):
            for m in _OPERATOR.finditer(block):
                if m.group(2) is not None:
                    down = abs(float(m.group(2)))
                    if pieces and down:
                        pieces.append("\n\n" if down > 14 else "\n")
                elif m.group() == b"T*":
                    pieces.append("\n")
                else:
                    for s in _STRING.findall(m.group()):
                        s = re.sub(rb"\\([nrt()\\])", lambda e: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(e.group(1), e.group(1)), s)
                        pieces.append(s.decode("latin-1"))

    for body in _STREAM.findall(raw):
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        scan(body)
    if not pieces:
        scan(raw)
    return re.sub(r"\n{3,}", "\n\n", "".join(pieces)).strip()


def read_pdfs(files: DataFrame) -> DataFrame:
    """(path, text) of rows (path, content)."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pdf_text(c or b"") for c in b.column(1).to_pylist()], pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


EXTENSIONS = {"html": "HTML", "htm": "HTML", "md": "MARKDOWN", "markdown": "MARKDOWN", "pdf": "PDF", "txt": "TEXT", "xml": "STRUCTURED", "json": "STRUCTURED"}
SKIPPED = (".git", "node_modules", "target", "build", "__pycache__")


def discover(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, content, extension, length) of files below a folder, without tool folders, in path order; contents are read only
    where they are asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    skipped = F.lit(False)
    for name in SKIPPED:
        skipped = skipped | F.contains("path", F.lit(f"/{name}/"))
    return files.select("path", "content", ext.alias("extension"), "length").where(ext.isin(*extensions) & ~skipped).orderBy("path")


def read_documents(files: DataFrame) -> DataFrame:
    """(path, format, title, text) by extension; an unknown extension has a null text and format UNKNOWN."""
    kind = F.lit("UNKNOWN")
    for ext, name in EXTENSIONS.items():
        kind = F.when(F.col("extension") == ext, F.lit(name)).otherwise(kind)
    text = F.decode("content", "UTF-8")
    typed = files.withColumn("format", kind)
    shown = F.when(F.col("format") == "HTML", html_text(text)).when(F.col("format") == "MARKDOWN", markdown_text(text)).when(F.col("format") == "STRUCTURED", structured_text(text)).when(F.col("format") == "TEXT", text)
    plain = typed.where("format <> 'PDF'").select("path", "format", shown.alias("text"))
    pdfs = read_pdfs(typed.where("format = 'PDF'")).select("path", F.lit("PDF").alias("format"), "text")
    every = plain.unionByName(pdfs)
    return every.select("path", "format", title_of(F.coalesce("text", F.lit("")), F.col("path")).alias("title"), "text")


def extract_with(files: DataFrame, extractor: Callable[[bytes, str], str]) -> DataFrame:
    """(path, text, error) by an injected extractor (images, audio, video, office files); failures stay rows."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    texts.append(extractor(content, path))
                    errors.append(None)
                except Exception as e:  # one file's failure is its row's result
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def office_extractor():
    """An extractor for office files where the optional library is installed."""
    try:
        from tika import parser
    except ImportError as e:
        raise NotImplementedError("office files need an extractor: pass one to extract_with") from e
    return lambda content, path: parser.from_buffer(content)["content"] or ""


def expand_attachments(memories: DataFrame) -> DataFrame:
    """Child records of rows (id, attachments array<struct<uri,text>>): ids are parent#attachment-n."""
    return memories.select("id", F.posexplode("attachments").alias("n", "a")).select(F.concat(F.col("id").cast("string"), F.lit("#attachment-"), F.col("n").cast("string")).alias("id"), F.col("id").alias("parent_id"), F.col("a.uri").alias("uri"), F.col("a.text").alias("text"))
