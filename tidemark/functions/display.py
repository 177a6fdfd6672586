"""Display and parsing expressions: durations, sizes, costs, validation, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of messages of errors that may pass.
TRANSIENT = ("timeout", "timed out", "network", "econnrefused", "econnreset", "enotfound", "etimedout", "socket hang up", "rate limit", "too many requests", "429", "500", "502", "503", "504")
#: Messages by parts of an error's own, in order.
FRIENDLY = (
    (("econnrefused", "enotfound"), "Network connection failed. Check your internet connection."),
    (("timeout", "timed out"), "Operation timed out. Try again or check your network."),
    (("eacces", "permission denied"), "Permission denied. Try running with appropriate permissions."),
    (("enospc",), "Not enough disk space. Free up some space and try again."),
    (("enoent",), "File or directory not found."),
    (("401", "unauthorized"), "API authentication failed. Check your API key."),
    (("429", "rate limit"), "API rate limit exceeded. Wait a moment and try again."),
    (("500", "502", "503"), "Service temporarily unavailable. Try again in a moment."),
)
#: File endings of videos.
VIDEO_ENDINGS = ("mp4", "mov", "avi", "mkv", "webm", "flv", "m4v")


def _int(x: Column) -> Column:
    return F.floor(x).cast("long")


def _text(x: Column) -> Column:
    return x.cast("string")


def duration(s: Column) -> Column:
    """45s, 2m 30s, 1h 15m 30s; halves round up and seconds may round to 60."""
    h, m, sec = _int(s / 3600), _int(s % 3600 / 60), _int(s % 60 + 0.5)
    tail = F.when(sec > 0, F.concat(F.lit(" "), _text(sec), F.lit("s"))).otherwise("")
    minutes = F.concat(_text(m), F.lit("m"), tail)
    return F.when(s < 60, F.concat(_text(_int(s + 0.5)), F.lit("s"))).when(h > 0, F.concat(_text(h), F.lit("h "), minutes)).otherwise(minutes)


def clock(s: Column) -> Column:
    """45s, 2:30, 1:15:30."""
    h, m, sec = _int(s / 3600), _int(s % 3600 / 60), F.lpad(_text(_int(s % 60 + 0.5)), 2, "0")
    return F.when(s < 60, F.concat(_text(_int(s + 0.5)), F.lit("s"))).when(h > 0, F.concat(_text(h), F.lit(":"), F.lpad(_text(m), 2, "0"), F.lit(":"), sec)).otherwise(F.concat(_text(m), F.lit(":"), sec))


def time_range(start: Column, end: Column) -> Column:
    return F.concat(clock(start), F.lit(" - "), clock(end))


def file_size(n: Column, digits: int = 1) -> Column:
    """1.5 MB; bytes are not scaled, terabytes are the last unit."""
    out = F.concat(_text(n), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.{digits}f {unit}", n / float(1024**k))).otherwise(out)
    return out


def cost(x: Column) -> Column:
    return F.format_string("$%.2f", x)


def percentage(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def rate(count: Column, seconds: Column, minute: bool = False) -> Column:
    return F.format_string("%.1f/min" if minute else "%.1f/s", count / (seconds / (60 if minute else 1)))


def progress_bar(x: Column, width: int = 10) -> Column:
    full = _int(x * width + 0.5).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full), F.lit("] "), percentage(x, 0))


def bullets(items: Column, indent: str = "  ") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"{indent}• "), x)), "\n")


def padded(label: Column, width: int) -> Column:
    """A label filled up with blanks on the right; a longer one stays whole."""
    return F.when(F.length(label) < width, F.rpad(label, width, " ")).otherwise(label)


def error_summary(titles: Column, messages: Column) -> Column:
    """A numbered list of errors under their number; nothing for none, a single one without a number."""
    n = F.size(titles)
    rows = F.transform(titles, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n   "), F.get(messages, i)))
    one = F.concat(F.get(titles, F.lit(0)), F.lit("\n   "), F.get(messages, F.lit(0)))
    many = F.concat(n.cast("string"), F.lit(" errors found:\n"), F.array_join(rows, "\n"), F.lit("\nFix these issues and try again"))
    return F.when(n == 0, "").when(n == 1, one).otherwise(many)


def megabytes(n: Column, decimal: bool = False) -> Column:
    """Size in units of 1048576 bytes, or of a million, to two places."""
    return F.round(n / (1e6 if decimal else 1048576.0), 2)


def is_transient(message: Column) -> Column:
    return F.lower(message).rlike("|".join(TRANSIENT))


def friendly(message: Column) -> Column:
    out, low = message, F.lower(message)
    for parts, say in reversed(FRIENDLY):
        out = F.when(low.rlike("|".join(parts)), say).otherwise(out)
    return out


def retry_wait(message: Column, attempt: Column) -> Column:
    """Seconds the message asks for and one more, else twice two to the attempt."""
    asked = F.regexp_extract(message, r"try again in (\d+\.?\d*)s", 1)
    return F.coalesce(F.when(asked != "", asked.cast("double") + 1), 2.0 * F.pow(F.lit(2.0), attempt))


def backoff(delay: Column, factor: Column, attempt: Column) -> Column:
    return delay * F.pow(factor, attempt - 1)


def error_line(output: Column) -> Column:
    """The first line with Error: or Exception:, else the last that is not blank."""
    lines = F.filter(F.transform(F.split(output, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    named = F.filter(lines, lambda x: x.rlike("Error:|Exception:"))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(lines, F.lit(-1)))


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*VIDEO_ENDINGS)


def number_error(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null for a missing value or one in range, else what is wrong."""
    n = x.try_cast("double")
    out = F.when(x.isNull(), F.lit(None).cast("string")).when(n.isNull(), "not_a_number")
    out = out.when(n < low, "too_small") if low is not None else out
    return out.when(n > high, "too_large") if high is not None else out


def range_error(low: Column, high: Column) -> Column:
    return F.when(low >= high, "min_not_below_max")


def positions(text: Column) -> Column:
    """Numbers of a list such as 1,3,5; others are dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def config_kind(text: Column) -> Column:
    """bool, number (in its canonical form), json or string."""
    number = text.rlike(r"^-?(0|[1-9]\d*)(\.\d*[1-9])?$")
    shaped = text.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$") & F.try_parse_json(text).isNotNull()
    return F.when(text.isin("true", "false"), "bool").when(number, "number").when(shaped, "json").otherwise("string")
