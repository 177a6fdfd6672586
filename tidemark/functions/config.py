"""Configuration values and options as columns: merging, checks, presets, masking, titles of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.display import number_error, range_error

#: Shortest and longest seconds of a clip by preset.
PRESETS = {"short": (15, 30), "medium": (30, 60), "long": (60, 120)}
#: Bounds of numeric options.
LIMITS = {"num_clips": (1, 100), "min_duration": (5, 600), "max_duration": (10, 1200), "padding": (0, 10)}
#: The beginning and least length of a key, and what is shown of it.
KEY_START, KEY_LENGTH, KEY_SHOWN = "sk-", 40, "sk-" + "•" * 18
#: Titles of error codes by class, and of other codes of the class.
TITLES = {
    "preflight": (
        {
            "VIDEO_NOT_FOUND": "Video file not found",
            "INVALID_VIDEO_FORMAT": "Invalid video format",
            "OUTPUT_DIR_NOT_WRITABLE": "Output directory is not writable",
            "PYTHON_NOT_FOUND": "Python not found",
            "DEPENDENCIES_MISSING": "Python dependencies missing",
            "API_KEY_MISSING": "OpenAI API key not set",
            "API_KEY_INVALID": "OpenAI API key is invalid",
            "INVALID_OPTION": "Invalid command option",
        },
        "Validation failed",
    ),
    "processing": (
        {
            "TRANSCRIPTION_FAILED": "Transcription failed",
            "ANALYSIS_FAILED": "Analysis failed",
            "CLIP_GENERATION_FAILED": "Clip generation failed",
            "API_RATE_LIMIT": "API rate limit exceeded",
            "API_ERROR": "API error",
            "TIMEOUT": "Processing timed out",
            "NO_CLIPS_GENERATED": "No clips generated",
        },
        "Processing failed",
    ),
    "system": (
        {
            "DISK_FULL": "Disk is full",
            "PERMISSION_DENIED": "Permission denied",
            "NETWORK_ERROR": "Network error",
            "OUT_OF_MEMORY": "Out of memory",
            "PYTHON_CRASHED": "Python process crashed",
        },
        "System error",
    ),
}
#: Names of colours, and the colour of any other name.
COLOURS, OTHER_COLOUR = {"white": "FFFFFF", "black": "000000", "yellow": "FFFF00", "red": "FF0000"}, "FFFFFF"


def merged(left: Column, right: Column) -> Column:
    """Two maps of settings as one; where both have a key, the right one's value."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def key_error(key: Column) -> Column:
    """Null for a key of the right form, else what is wrong."""
    return F.when(F.coalesce(key, F.lit("")) == "", "API_KEY_MISSING").when(~key.startswith(KEY_START) | (F.length(key) < KEY_LENGTH), "API_KEY_INVALID")


def masked(value: Column) -> Column:
    """A value as it may be shown: of a key only its beginning."""
    return F.when(value.startswith(KEY_START), KEY_SHOWN).otherwise(value)


def option_errors(**options: Column) -> Column:
    """What is wrong with text options named as in LIMITS, as an array of option:error; missing ones are fine. That the
    shortest length is not under the longest is said once both are in range."""
    own = {name: number_error(x, *LIMITS[name]) for name, x in options.items()}
    found = [F.when(e.isNotNull(), F.concat(F.lit(f"{name}:"), e)) for name, e in own.items()]
    if {"min_duration", "max_duration"} <= options.keys():
        low, high = (options[n].try_cast("double") for n in ("min_duration", "max_duration"))
        fine = own["min_duration"].isNull() & own["max_duration"].isNull()
        found.append(F.when(fine, F.concat(F.lit("duration:"), range_error(low, high))))
    return F.array_compact(F.array(*found))


def preset(name: Column) -> Column:
    """Shortest and longest seconds (a struct low, high) of a named preset; null for others."""
    out = F.lit(None).cast("struct<low:int,high:int>")
    for key, (low, high) in PRESETS.items():
        out = F.when(name == key, F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))).otherwise(out)
    return out


def _lookup(x: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x), F.lit(other))


def error_title(kind: Column, code: Column) -> Column:
    """The title of an error code of a class; null for an unknown class."""
    out = F.lit(None).cast("string")
    for name, (titles, other) in TITLES.items():
        out = F.when(kind == name, _lookup(F.coalesce(code, F.lit("")), titles, other)).otherwise(out)
    return out


def colour(name: Column) -> Column:
    """Six hexadecimal digits of a named colour."""
    return _lookup(F.lower(F.coalesce(name, F.lit(""))), COLOURS, OTHER_COLOUR)
