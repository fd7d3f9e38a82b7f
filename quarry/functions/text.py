"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.paths import extension

#: File families and their comment marks (fixed values).
HASH_STYLE = [".py", ".pyw", ".sh", ".bash", ".zsh", ".rb", ".rbw", ".yml", ".yaml", ".toml", ".ini", ".cfg", ".dockerfile", ".env"]
SLASH_STYLE = [
    ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hh", ".hxx", ".js", ".jsx", ".ts", ".tsx", ".vue",
    ".java", ".kt", ".groovy", ".scala", ".cs", ".rs", ".go", ".php",
]
BLOCK_STYLE = [".css", ".scss", ".less"]
DASH_STYLE = [".lua", ".sql", ".pl"]
_S = r"[ \t\n\x0B\f\r]"


def normalize_whitespace(text: Column) -> Column:
    """Trimmed; runs of blanks become one space; runs of empty lines one line break."""
    trimmed = F.regexp_replace(text, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")
    spaced = F.regexp_replace(trimmed, r"[ \t\x0B\f\r]+", " ")
    return F.regexp_replace(spaced, rf"\n{_S}*\n", "\n")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_S}+|{_S}+\z", "")


def count_lines(text: Column) -> Column:
    """Number of line breaks."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def sanitize_utf8(data: Column) -> Column:
    """Bytes as text, each invalid sequence a question mark."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit("?"))


def is_binary(text: Column) -> Column:
    """A NUL anywhere, or over 30 % control characters in the first 1024 bytes."""
    head = F.substring(F.encode(text, "UTF-8"), 1, 1024)
    # control bytes are ASCII, so they may be counted after a lossless decoding byte by byte
    controls = F.regexp_count(F.decode(head, "ISO-8859-1"), F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return F.contains(text, F.lit("\0")) | ((F.octet_length(head) > 0) & (controls > 0.3 * F.octet_length(head)))


def comment_lines(code: Column, filename: Column) -> Column:
    """Each line that isn't blank between the comment marks of the file's family; unknown families unchanged."""
    ext = F.lower(extension(filename))
    prefix = (
        F.when(ext.isin(HASH_STYLE), "# ").when(ext.isin(SLASH_STYLE), "// ").when(ext.isin(BLOCK_STYLE), "/* ").when(ext.isin(DASH_STYLE), "-- ")
    )
    suffix = F.when(ext.isin(BLOCK_STYLE), " */").otherwise("")
    ended = F.endswith(code, F.lit("\n"))
    body = F.when(ended, F.left(code, F.length(code) - 1)).otherwise(code)
    lines = F.transform(F.split(body, "\n"), lambda x: F.when(F.rlike(x, F.lit(rf"[^ \t\n\x0B\f\r]")), F.concat(prefix, x, suffix)).otherwise(x))
    marked = F.concat(F.array_join(lines, "\n"), F.when(ended, "\n").otherwise(""))
    return F.when(prefix.isNull() | (code == ""), code).otherwise(marked)


def strip_code_fence(code: Column) -> Column:
    """The inside of a fenced block that is the whole text, else the text unchanged.

    Tests of the opening look at the trimmed text, all cuts at the text as it is.
    """
    whole = trimmed(code)
    from_third = F.instr(F.substring(code, 4, 2**31 - 1), "\n")
    first = F.when(from_third > 0, from_third + 3).otherwise(0)  # place of the line break, from 1
    last = F.length(code) - F.instr(F.reverse(code), "```\n") - 2  # place of the last line break before a fence
    has_last = F.contains(code, F.lit("\n```"))
    tail = F.substr(code, last + 4)
    inner = F.substr(code, first + 1, last - first - 1)
    one_line = F.when(F.endswith(code, F.lit("```")), F.substr(code, F.lit(4), F.greatest(F.length(code) - 6, F.lit(0)))).otherwise(code)
    fenced = F.when(has_last & (last > first) & ~F.rlike(tail, F.lit(r"[^ \t\n\x0B\f\r]")), inner).otherwise(code)
    return F.when((F.octet_length(whole) < 6) | ~F.startswith(whole, F.lit("```")), code).when(first == 0, one_line).otherwise(fenced)


def preview(text: Column, most: int = 200) -> Column:
    """The first ``most`` bytes, cut before a character that would be split, and dots if there is more."""
    head = F.substring(F.encode(text, "UTF-8"), 1, most)
    # an unfinished character at the end is dropped
    whole = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "�+\\z", "")
    return F.when(F.octet_length(text) > most, F.concat(whole, F.lit("..."))).otherwise(text)


def tidy_response(text: Column) -> Column:
    """Three or more line breaks become two; none at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def escape_html(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def bytes_to_size(n: Column) -> Column:
    """A rounded size in the largest fitting unit of 1024."""
    step = F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0))), F.lit(4)).cast("int")
    # rounding half up, as a size of 1536 bytes is 2 KB
    value = F.floor(n / F.pow(F.lit(1024.0), step) + 0.5).cast("long")
    unit = F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB", "TB"))), step + 1)
    return F.when(n == 0, "0 Byte").otherwise(F.concat_ws(" ", value.cast("string"), unit))


def uptime(seconds: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def temperature_label(t: Column) -> Column:
    return F.when(t <= 0.2, "Precise").when(t <= 0.5, "Balanced").when(t <= 0.8, "Creative").otherwise("Unpredictable")


def context_ratio(size: Column) -> Column:
    """Share of the context for a named size; 0.7 for others."""
    return F.when(size == "compact", 0.5).when(size == "balanced", 0.7).when(size == "detailed", 0.9).otherwise(0.7)


def leading_double(text: Column) -> Column:
    """The number that ``text`` begins with, else 0."""
    return F.coalesce(F.regexp_extract(text, r"\A[ \t\n\x0B\f\r]*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def leading_int(text: Column, default: int) -> Column:
    """The integer that ``text`` begins with, else ``default``."""
    return F.coalesce(F.regexp_extract(text, r"\A[ \t\n\x0B\f\r]*([+-]?\d+)", 1).try_cast("int"), F.lit(default))


def size_mb(n: Column) -> Column:
    return F.round(n / F.lit(1048576.0), 2)


def timestamp_label(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")
