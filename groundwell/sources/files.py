"""Text, Markdown and PDF files as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported file endings, compared in lower case.
TEXT_ENDINGS = (".txt", ".md", ".markdown")
PDF_ENDING = ".pdf"

_FILE_SCHEMA = "path STRING, content BINARY"
_ENDING = r"(\.[^./]+)$"


def normal_path(path: Column) -> Column:
    """Path without the ``file:`` scheme; other schemes stay."""
    return F.regexp_replace(path, r"^file:(//)?(?=/)", "")


def decode_text(content: Column) -> Column:
    """UTF-8 text; bad bytes become U+FFFD and all line ends LF. A BOM is kept."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, _ENDING, 1))


def scan_files(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(found, missing)``: ``path, content`` of all files, and paths that do not exist.

    Folders are read recursively for supported endings; a path to a file is taken as it is. A
    file reached twice is read once. Names that begin with ``.`` or ``_`` inside a folder are
    skipped, as Spark does everywhere.
    """
    folders, files, missing = [], [], []
    for path in dict.fromkeys(p.rstrip("/") or "/" for p in paths):
        kind = _kind(spark, path)
        {"folder": folders, "file": files}.get(kind, missing).append(path)
    outer = [f for f in folders if not any(_inside(f, g) for g in folders if g != f)]
    # A supported file within a given folder is found there already.
    alone = [
        f for f in files
        if not (f.lower().endswith((*TEXT_ENDINGS, PDF_ENDING)) and _visible_in(f, outer))
    ]
    found = spark.createDataFrame([], _FILE_SCHEMA)
    if outer:
        # The glob is applied when files are listed, so others are never opened.
        found = found.unionByName(
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", _any_case_glob())
            .load([_literal(f) for f in outer])
            .select("path", "content")
        )
    if alone:
        found = found.unionByName(
            spark.read.format("binaryFile")
            .load([_literal(f) for f in alone])
            .select("path", "content")
        )
    absent = spark.createDataFrame([(m,) for m in missing], "path STRING")
    return (
        found.withColumn("path", normal_path(F.col("path"))),
        absent.select("path", F.lit("file not found").alias("reason")),
    )


def load_documents(
    spark: SparkSession,
    paths: Sequence[str],
    pdf_pages: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, rejected)``: ``path, text`` and ``path, reason``.

    ``pdf_pages`` turns a binary column into an array of page texts, null for a file it cannot
    read. Without it PDF files are rejected. One bad file never stops the others.
    """
    found, missing = scan_files(spark, paths)
    documents, rejected = split_documents(found, pdf_pages)
    return documents, rejected.unionByName(missing)


def split_documents(
    found: DataFrame, pdf_pages: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(documents, rejected)`` of files ``path, content``, as :func:`load_documents` has them."""
    kind = ending(F.col("path"))
    is_text = kind.isin(*TEXT_ENDINGS)
    is_pdf = kind == PDF_ENDING
    text = F.when(is_text, decode_text(F.col("content")))
    if pdf_pages is not None:
        pages = pdf_pages(F.when(is_pdf, F.col("content")))
        text = text.when(is_pdf, join_pages(pages))
    read = found.select("path", kind.alias("ending"), text.alias("text"))
    reason = F.when(
        is_pdf,
        F.lit("no PDF reader" if pdf_pages is None else "unreadable PDF"),
    ).otherwise(F.concat(F.lit("unsupported file ending: "), kind))
    rejected = (
        found.select("path") if pdf_pages is None else read.where(F.col("text").isNull())
    )
    if pdf_pages is None:
        # Known from the path alone, so no content is read for it.
        rejected = rejected.where(~is_text)
    return (
        read.where(F.col("text").isNotNull()).select("path", "text"),
        rejected.select("path", reason.alias("reason")),
    )


def join_pages(pages: Column) -> Column:
    """Page texts of one document in order, parted by a blank line; a null page is empty."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p, F.lit(""))), "\n\n")


def assemble_pages(pages: DataFrame) -> DataFrame:
    """``document_id, page_no, page_text`` to ``document_id, text``.

    The result is one value per document, so a document must fit in memory. To chunk paged
    documents of any length use :func:`groundwell.operators.chunking.chunk_pages`, which never
    assembles them.
    """
    # A page without a number comes first.
    page = F.struct(F.coalesce("page_no", F.lit(-1)).alias("page_no"), "page_text")
    return (
        pages.groupBy("document_id")
        .agg(F.array_sort(F.collect_list(page)).alias("pages"))
        .select(
            "document_id",
            join_pages(F.transform("pages", lambda p: p["page_text"])).alias("text"),
        )
    )


def _any_case_glob() -> str:
    def any_case(suffix: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)

    return "*{" + ",".join(any_case(e) for e in (*TEXT_ENDINGS, PDF_ENDING)) + "}"


def _literal(path: str) -> str:
    """Escape glob characters, as a given path is a name and not a pattern."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def _inside(path: str, folder: str) -> bool:
    return path.startswith(folder.rstrip("/") + "/")


def _visible_in(path: str, folders: Sequence[str]) -> bool:
    return any(
        _inside(path, f)
        and not any(part.startswith((".", "_")) for part in path[len(f):].split("/"))
        for f in folders
    )


def _kind(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return "missing"
    return "folder" if system.getFileStatus(target).isDirectory() else "file"
