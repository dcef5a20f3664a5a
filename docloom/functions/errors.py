"""Error codes as native columns; failed rows keep their place with an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: codes, and the words of a message that lead to them, in order
CODES = ["FILE_NOT_FOUND", "FILE_ACCESS_DENIED", "FILE_CORRUPTED", "FILE_TOO_LARGE", "UNSUPPORTED_FORMAT", "INVALID_FILE_STRUCTURE", "MISSING_DEPENDENCY", "DEPENDENCY_VERSION_MISMATCH", "CONVERSION_FAILED", "HTML_PARSING_FAILED", "MARKDOWN_GENERATION_FAILED", "PREPROCESSING_FAILED", "NETWORK_ERROR", "TIMEOUT_ERROR", "UNKNOWN_ERROR", "INVALID_INPUT"]
WORDS = [
    (("no such file", "file not found"), "FILE_NOT_FOUND"),
    (("permission denied", "access denied"), "FILE_ACCESS_DENIED"),
    (("corrupted", "invalid zip"), "FILE_CORRUPTED"),
    (("too large", "file size"), "FILE_TOO_LARGE"),
    (("timeout",), "TIMEOUT_ERROR"),
    (("network", "fetch"), "NETWORK_ERROR"),
    (("html", "parse"), "HTML_PARSING_FAILED"),
    (("markdown",), "MARKDOWN_GENERATION_FAILED"),
]
PHASES = {"preprocessing": "PREPROCESSING_FAILED", "docx-to-html": "CONVERSION_FAILED", "html-to-markdown": "MARKDOWN_GENERATION_FAILED"}
RECOVERABLE = ["NETWORK_ERROR", "TIMEOUT_ERROR", "FILE_ACCESS_DENIED"]
ADVICE = {
    "FILE_NOT_FOUND": "Check the path: there is no such file.",
    "FILE_ACCESS_DENIED": "The file may not be read, or is in use.",
    "FILE_CORRUPTED": "The file is damaged.",
    "FILE_TOO_LARGE": "The file is over the size limit.",
    "UNSUPPORTED_FORMAT": "Nothing converts this format.",
    "TIMEOUT_ERROR": "It took too long; try again.",
    "NETWORK_ERROR": "The network failed; try again.",
}


def error_code(message: Column) -> Column:
    m, out = F.lower(message), F.lit("UNKNOWN_ERROR")
    for words, code in reversed(WORDS):
        hit = m.contains(words[0])
        for w in words[1:]:
            hit = hit | m.contains(w)
        out = F.when(hit, code).otherwise(out)
    return F.when(message.isNotNull(), out)


def phase_code(phase: Column) -> Column:
    out = F.lit("CONVERSION_FAILED")
    for p, code in PHASES.items():
        out = F.when(phase == p, code).otherwise(out)
    return out


def file_error_code(message: Column) -> Column:
    return F.when(message.contains("ENOENT"), "FILE_NOT_FOUND").when(message.contains("EACCES") | message.contains("EMFILE") | message.contains("ENFILE"), "FILE_ACCESS_DENIED").otherwise("UNKNOWN_ERROR")


def recoverable(code: Column) -> Column:
    return F.coalesce(code.isin(RECOVERABLE), F.lit(False))


def message_for(code: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), F.lit("The conversion failed."))


def error_struct(code: Column, phase: Column, message: Column, context: Column | None = None) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.when(code.isNotNull(), F.struct(code.alias("code"), phase.alias("phase"), message.alias("message"), (context if context is not None else empty).alias("context")))


# fixed values: what names a failure that may pass by itself
PASSING = ("rate limit", "timeout", "connection", "econnreset", "etimedout", "429", "503")


def passing(error: BaseException) -> bool:
    """A call with such a failure is worth repeating."""
    if isinstance(error, (TimeoutError, ConnectionError)):
        return True
    code = str(getattr(error, "status", None) or getattr(error, "code", None) or "").lower()
    return code in PASSING or any(x in str(error).lower() for x in PASSING)


def is_passing(message: Column) -> Column:
    """The same by an error's text."""
    return F.coalesce(F.lower(message).rlike("|".join(PASSING)), F.lit(False))


def retry_delay_ms(attempt: Column, base: int = 1000, factor: int = 2, most: int = 60_000) -> Column:
    """Exponential back-off, capped."""
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(factor), attempt)).cast("bigint"))
