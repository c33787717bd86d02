"""Small classifications of crawl rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlloom.functions.urls import trim

WARNING, ERROR = 0, 1
#: The resource types a page can have; '' is one of them.
RESOURCE_TYPES = ("", "html", "css", "script", "image", "font", "text", "other")


def resource_type(content_type: Column) -> Column:
    """The kind of resource of a content type, without its parameters."""
    ct = trim(F.substring_index(trim(F.lower(content_type)), ";", 1))
    return (
        F.when(ct == "", "")
        .when(ct == "text/html", "html")
        .when(ct == "text/css", "css")
        .when(ct.contains("javascript") | (ct == "application/json"), "script")
        .when(ct.startswith("image/"), "image")
        .when(ct.startswith("font/"), "font")
        .when(ct.startswith("text/"), "text")
        .otherwise("other")
    )


def is_html(content_type: Column) -> Column:
    return F.lower(content_type).startswith("text/html")


def status_text(code: Column) -> Column:
    return F.when(code == 0, "unreachable").otherwise(code.cast("string"))


def severity_name(severity: Column) -> Column:
    return F.when(severity == ERROR, "error").otherwise("warning")


def quoted(s: Column) -> Column:
    """In double quotes, with backslash, quote and the common control characters escaped."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), s, F.lit('"'))
