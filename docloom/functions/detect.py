"""File-type detection as native columns: no Python, pushed down and pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OOXML = "application/vnd.openxmlformats-officedocument."
DOCX = _OOXML + "wordprocessingml.document"
# fixed values: extension -> MIME type, and file signatures in the order they are tried
MIME = {
    ".docx": DOCX, ".doc": "application/msword", ".xlsx": _OOXML + "spreadsheetml.sheet", ".xls": "application/vnd.ms-excel",
    ".pptx": _OOXML + "presentationml.presentation", ".ppt": "application/vnd.ms-powerpoint", ".pdf": "application/pdf", ".rtf": "application/rtf",
    ".odt": "application/vnd.oasis.opendocument.text", ".ods": "application/vnd.oasis.opendocument.spreadsheet", ".odp": "application/vnd.oasis.opendocument.presentation",
    ".html": "text/html", ".htm": "text/html", ".xml": "text/xml", ".css": "text/css", ".js": "text/javascript", ".json": "application/json",
    ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp", ".svg": "image/svg+xml",
    ".zip": "application/zip", ".rar": "application/x-rar-compressed", ".tar": "application/x-tar", ".gz": "application/gzip",
}
SIGNATURES = [
    ("504B0304", "application/zip", ".zip"), ("504B0708", "application/zip", ".zip"), ("25504446", "application/pdf", ".pdf"),
    ("D0CF11E0A1B11AE1", "application/msword", ".doc"), ("7B5C727466", "application/rtf", ".rtf"), ("FFD8FF", "image/jpeg", ".jpg"),
    ("89504E470D0A1A0A", "image/png", ".png"), ("47494638", "image/gif", ".gif"), ("424D", "image/bmp", ".bmp"),
]
OFFICE = [("word/", "document.xml", ".docx"), ("xl/", "workbook.xml", ".xlsx"), ("ppt/", "presentation.xml", ".pptx")]
SUPPORTED_MIME = [DOCX, "application/msword", "text/html", "text/plain", "text/markdown"]
SUPPORTED_EXT = [".docx", ".doc", ".html", ".htm", ".txt", ".md"]
# fixed values: what the listing of converters names
CONVERTER = "DocxConverter"
FEATURES = ["Tables", "Math equations (OMML to LaTeX)", "Headings and formatting", "Images with alt text", "Lists and structural elements", "Custom style mapping", "Batch processing"]
INFO = "struct<mimetype:string,extension:string>"


def _present(c: Column) -> Column:
    """An empty string counts as absent."""
    return F.nullif(c, F.lit(""))


def filename_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """From the last dot of the base name, with the dot; null without one."""
    return _present(F.regexp_extract(filename_of(path), r"\.[^.]*$", 0))


def stream_info(path: Column, mimetype: Column | None = None) -> Column:
    return F.struct((mimetype if mimetype is not None else F.lit(None).cast("string")).alias("mimetype"), extension_of(path).alias("extension"), filename_of(path).alias("filename"), path.alias("localPath"))


def mime_of(ext: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.try_element_at(pairs, F.lower(ext))


def ext_of(mime: Column) -> Column:
    """The first extension of a type wins."""
    first: dict[str, str] = {}
    for e, m in MIME.items():
        first.setdefault(m, e)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), mime)


def detect_type(content: Column) -> Column:
    """struct(mimetype, extension) from the first bytes, or null; zips are looked into."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    out = F.lit(None).cast(INFO)
    for sig, mime, ext in reversed(SIGNATURES):
        hit = F.startswith(content, F.unhex(F.lit(sig)))
        kind = F.struct(F.lit(mime).alias("mimetype"), F.lit(ext).alias("extension"))
        if ext == ".zip":
            for part, name, office in reversed(OFFICE):
                kind = F.when(head.contains(part) & head.contains(name), F.struct(F.lit(MIME[office]).alias("mimetype"), F.lit(office).alias("extension"))).otherwise(kind)
        out = F.when(hit, kind).otherwise(out)
    return out


def enhance_info(content: Column, mimetype: Column, extension: Column, path: Column) -> Column:
    """Detection fills only what is missing, then extension -> type, then type -> extension."""
    found = detect_type(content)
    m = F.coalesce(_present(mimetype), found["mimetype"])
    e = F.coalesce(_present(extension), found["extension"])
    mime = F.coalesce(m, mime_of(e))
    return F.struct(mime.alias("mimetype"), F.coalesce(e, ext_of(mime)).alias("extension"), filename_of(path).alias("filename"))


def recognised(mimetype: Column, extension: Column) -> Column:
    return F.coalesce(mimetype.isin(SUPPORTED_MIME), F.lit(False)) | F.coalesce(F.lower(extension).isin(SUPPORTED_EXT), F.lit(False))


def converter_of(content: Column, mimetype: Column, extension: Column) -> Column:
    """Which built-in converter takes a file, or null: ``docx`` by name, type or bytes, then ``html`` and ``text``
    by name or type. A file's name counts before a type that says nothing."""
    ext, kind = F.lower(extension), F.lower(mimetype)
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    inside = head.startswith("PK") & head.contains("word/") & head.contains("document.xml")
    any_of = lambda *c: F.greatest(*[F.coalesce(x, F.lit(False)) for x in c])
    return (
        F.when(any_of(ext == ".docx", F.startswith(kind, F.lit(DOCX)), inside), "docx")
        .when(any_of(kind == "text/html", ext.isin(".html", ".htm")), "html")
        .when(any_of(kind.isin("text/plain", "text/markdown"), ext.isin(".txt", ".md")), "text")
    )


def convertible(content: Column, mimetype: Column, extension: Column) -> Column:
    """Some converter takes it; ``convert`` goes by the same rule."""
    return converter_of(content, mimetype, extension).isNotNull()


def file_info(df: DataFrame) -> DataFrame:
    """path, content[, mimetype] -> size, detected, enhanced, supported, convertible."""
    mime = F.col("mimetype") if "mimetype" in df.columns else F.lit(None).cast("string")
    e = enhance_info(F.col("content"), mime, extension_of(F.col("path")), F.col("path"))
    out = df.select("path", F.length("content").alias("size"), detect_type(F.col("content")).alias("detected"), e.alias("enhanced"), "content")
    x = F.col("enhanced")
    return out.select("path", "size", "detected", "enhanced", recognised(x["mimetype"], x["extension"]).alias("supported"), convertible(F.col("content"), x["mimetype"], x["extension"]).alias("convertible"))


def supported_types(spark: SparkSession) -> DataFrame:
    """What the word-processor converter is listed with; HTML and text need no conversion and are not listed."""
    rows = [("converter", CONVERTER), ("extension", ".docx"), ("mimetype", DOCX)] + [("feature", f) for f in FEATURES]
    return spark.createDataFrame(rows, "kind string, value string")


def valid_pdf_upload(name: Column, mimetype: Column, size: Column) -> Column:
    """null when valid, else what is wrong."""
    pdf = F.coalesce(mimetype.contains("pdf"), F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))
    return F.when(~pdf, "not a PDF").when(size > 50 * 1024 * 1024, "larger than 50 MiB")
