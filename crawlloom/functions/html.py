"""Anchors of raw HTML by regular expressions, in whole-table expressions.

The scan is deliberately plain: every < up to the next > is a tag, comments and scripts included, and entities
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W, N, U = r"[ \t\n\r\x0B\f]", r"[^ \t\n\r\x0B\f=/]", r"[^ \t\n\r\x0B\f/]"
TAG = r"<([^>]*)>"
ANCHOR = r"^[ \t\r\n]*a[ /]"
ATTRIBUTE = rf"""{N}*{W}*={W}*(?:"[^"]*"?|'[^']*'?|{U}*)|{N}+"""
HREF = rf"(?s)^(?i:href)({W}*=.*)?$"
HREF_NAME = rf"(?s)^(?i:href){W}*=?{W}*"
QUOTED = r"""(?s)^(?:"([^"]*)"?|'([^']*)'?)$"""


def anchor_tags(html: Column) -> Column:
    """The insides of all anchor tags; upper-case A doesn't count."""
    return F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAG), F.lit(1)), lambda t: t.rlike(ANCHOR))


def href_values(tag: Column) -> Column:
    """All href values of a tag, in order; '' for an href without a value."""
    attributes = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(HREF))
    return F.transform(attributes, lambda a: F.regexp_replace(F.regexp_replace(a, HREF_NAME, ""), QUOTED, "$1$2"))


def hrefs(html: Column) -> Column:
    """All href values of a page's anchors, in order."""
    return F.flatten(F.transform(anchor_tags(html), href_values))
