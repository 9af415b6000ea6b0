"""Checks and routing of source addresses, pages and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PLATFORM_HOSTS = ("twitch.tv", "youtube.com", "youtu.be", "vimeo.com")
VOD_ID = r"twitch\.tv/videos/(\d+)"
SAFE_NAME = r"[^a-zA-Z0-9._-]+"
SNIFF_BYTES = 512
HTML_STARTS = ("<!doctype html", "<html")


def _scheme(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))


def reject_reason(url: Column) -> Column:
    """Why an address cannot be a source; null when it can."""
    clean = F.trim(F.coalesce(url, F.lit("")))
    malformed = (clean != "") & F.try_parse_url(clean, F.lit("PATH")).isNull() & host(clean).isNull()
    scheme = _scheme(clean)
    return (
        F.when(malformed, "invalid").when(scheme.isNull() | ~scheme.isin("http", "https"), "scheme")
        .when(host(clean).isNull(), "host")
    )


def needs_platform(url: Column) -> Column:
    name = F.coalesce(host(url), F.lit(""))
    out = F.lit(False)
    for part in PLATFORM_HOSTS:
        out = out | name.contains(part)
    return out


def vod_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, VOD_ID, 1), F.lit(""))


def file_suffix(url: Column) -> Column:
    """The last path component's extension, or ``.mp4``."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^.*[^.].*?(\.[^.]+)$", 1), F.lit("")), F.lit(".mp4"))


def looks_like_html(content: Column) -> Column:
    """Does the start of a download read like a page?  Only the first bytes decide."""
    start = F.lower(F.ltrim(F.substring(content, 1, SNIFF_BYTES)))
    return start.startswith(HTML_STARTS[0]) | start.startswith(HTML_STARTS[1])


def normalise_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def safe_name(value: Column, fallback: str) -> Column:
    clean = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), SAFE_NAME, "_")
    return F.when(clean == "", F.lit(fallback)).otherwise(clean)


def export_key(job: Column, candidate: Column) -> Column:
    return F.concat(
        F.lit("jobs/"), safe_name(job, "job"), F.lit("/exports/candidate-"), safe_name(candidate, "candidate"),
        F.lit(".mp4"),
    )
