"""Names, addresses, colours and clock times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a stored file may be called.
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")


def clock(seconds: Column) -> Column:
    """mm:ss, rounded down, 0 at least."""
    whole = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.concat(F.lpad((whole / 60).cast("long").cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def colour_to_hex(blue: Column, green: Column, red: Column) -> Column:
    parts = [F.lower(F.lpad(F.hex(c.cast("int")), 2, "0")) for c in (red, green, blue)]
    return F.concat(F.lit("#"), *parts)


def hex_to_colour(code: Column) -> Column:
    """Blue, green, red of #rrggbb."""
    part = [F.conv(F.substring(code, at, 2), 16, 10).cast("int") for at in (6, 4, 2)]
    return F.array(*part)


def safe_filename(name: Column) -> Column:
    """Without folders, odd characters as one underscore, no leading dash or dot; video.mp4 if nothing is left.

    Of more than 200 characters, 180 of the stem and the extension stay, or the first 200 where there is none.
    """
    last = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    plain = F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._\- ()]+", "_"), r"^[-.]+", "")
    end = F.regexp_extract(plain, r"\.[^.]*$", 0)
    stem = F.left(plain, F.char_length(plain) - F.char_length(end))
    cut = F.when(end == "", F.left(plain, F.lit(200))).otherwise(F.concat(F.left(stem, F.lit(180)), end))
    return F.when(plain == "", "video.mp4").when(F.char_length(plain) > 200, cut).otherwise(plain)


def allowed_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1)).isin(*VIDEO_EXTENSIONS)


def name_from_url(url: Column, key: Column) -> Column:
    """Last path part without query, decoded; the first eight characters of key where there is none."""
    path = F.regexp_extract(url, r"^(?:[a-z]+://[^/]*)?([^?#]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.when(last != "", F.url_decode(last)), F.substring(key, 1, 8))


def storage_key(url: Column, host: str) -> Column:
    """Path of a URL of that host; null for other hosts."""
    return F.when(F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)) == host, F.regexp_extract(url, r"^https?://[^/]+/([^?#]+)", 1))


def time_left(elapsed: Column, done: Column) -> Column:
    """What is left to wait from the time elapsed and the share done."""
    return elapsed / done * (1 - done)
