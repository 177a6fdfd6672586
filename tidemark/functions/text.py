"""Text expressions: sentence ends, transitions, timestamps, slugs, file names, titles, hashtags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that begin a new thought.
TRANSITIONS = ("so", "now", "but", "however", "because", "and", "first", "second", "next", "finally", "also", "then", "therefore", "meanwhile", "additionally")


def sentence_end(text: Column) -> Column:
    """Ends with . ! or ?, or with a quote that is not all of it (whatever stands before the quote)."""
    t = F.trim(text)
    return t.rlike(r"[.!?]$") | (t.rlike("[\"']$") & (F.length(t) > 1))


def transition_start(text: Column) -> Column:
    """The first word, without punctuation around it, is a transition word."""
    first = F.regexp_extract(F.lower(F.trim(text)), r"^(\S+)", 1)
    return F.regexp_replace(first, r"^[.,!?;:]+|[.,!?;:]+$", "").isin(*TRANSITIONS)


def _whole(x: Column) -> Column:
    return F.floor(x).cast("int")


def mm_ss(seconds: Column) -> Column:
    """MM:SS, truncated; minutes are unbounded."""
    return F.format_string("%02d:%02d", _whole(seconds / 60), _whole(F.pmod(seconds, F.lit(60))))


def mm_ss_name(seconds: Column) -> Column:
    return F.format_string("%02dm%02ds", _whole(seconds / 60), _whole(F.pmod(seconds, F.lit(60))))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, truncated."""
    return F.format_string("%02d:%02d:%02d,%03d", _whole(seconds / 3600), _whole(seconds / 60) % 60, _whole(seconds) % 60, _whole(seconds * 1000) % 1000)


def slug(text: Column, most: int = 50) -> Column:
    """Lower case, letters, digits and underscores joined by single hyphens, cut at a hyphen beyond ``most``."""
    s = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[-\s]+", "-"), r"^-+|-+$", "")
    short = F.regexp_replace(F.substring(s, 1, most), r"-[^-]*$", "")
    s = F.when(F.length(s) > most, short).otherwise(s)
    return F.when(F.coalesce(s, F.lit("")) == "", "untitled").otherwise(s)


def clip_name(index: Column, title: Column, start: Column, end: Column) -> Column:
    """slug_NNN_range, or clip_NNN_range without a title."""
    lead = F.when(F.coalesce(title, F.lit("")) == "", "clip").otherwise(slug(title))
    return F.concat_ws("_", lead, F.format_string("%03d", index), F.concat(mm_ss_name(start), F.lit("-"), mm_ss_name(end)))


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of a cut text being dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def title(text: Column) -> Column:
    """A title of at most 60 characters."""
    return shorten(text, 60)


def title_case(name: Column) -> Column:
    """Words of a slug, each with a capital."""
    return F.array_join(F.transform(F.split(name, "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def hashtags(text: Column, most: int = 5) -> Column:
    """The first words, without leading #."""
    return F.transform(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, most), lambda w: F.regexp_replace(w, "^#+", ""))


def unquote(text: Column, pairs_only: bool = True) -> Column:
    """Without one pair of quotes around it, or without any quotes at its ends."""
    if pairs_only:
        return F.regexp_replace(text, "(?s)^\"(.*)\"$|^'(.*)'$", "$1$2")
    return F.regexp_replace(text, "^[\"']+|[\"']+$", "")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4)
