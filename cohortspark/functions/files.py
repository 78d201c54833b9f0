"""Verdicts on files and on what was read from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values.
TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
FILE_BYTES, TEXT_CHARS, LEAST_CHARS = 8 * 1024 * 1024, 80_000, 15


def file_verdict(name: Column, size: Column, content: Column) -> Column:
    """empty_file, file_too_large, unsupported_file, invalid_file or the media type."""
    extension = F.lower(F.substring_index(name, ".", -1))
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    starts = lambda h: F.startswith(F.hex(F.substr(content, F.lit(1), F.lit(8))), F.lit(h))
    pdf = F.contains(F.hex(F.substr(content, F.lit(1), F.lit(1024))), F.lit("255044462D"))
    fits = F.when(extension == "pdf", pdf).when(extension == "docx", starts("504B")).when(extension == "png", starts("89504E470D0A1A0A")).when(extension.isin("jpg", "jpeg"), starts("FFD8FF")).otherwise(True)
    kind = F.try_element_at(kinds, extension)
    return F.when(size == 0, "empty_file").when(size > FILE_BYTES, "file_too_large").when(kind.isNull(), "unsupported_file").when(~F.coalesce(fits, F.lit(False)), "invalid_file").otherwise(kind)


def extraction_verdict(text: Column, is_text_file: Column) -> Column:
    """extraction_failed, empty_extraction, extraction_too_large or ready."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    content = trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^#{1,6}\s+.*$", ""), r"<[^>]*>", ""))
    return F.when(is_text_file & F.contains(text, F.lit("\0")), "extraction_failed").when(F.coalesce(F.length(content), F.lit(0)) < LEAST_CHARS, "empty_extraction").when(F.length(text) > TEXT_CHARS, "extraction_too_large").otherwise("ready")
