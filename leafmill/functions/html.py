"""HTML functions that pages allow without a parser."""

from __future__ import annotations

from pyspark.sql import Column


def has_script(html: Column) -> Column:
    """A script element, or an event attribute."""
    return html.rlike(r"(?i)<script[\s>]|<[a-z][^>]*\son[a-z]+\s*=")


def has_external_links(html: Column) -> Column:
    """A source or reference to another host in img, link, iframe or source."""
    return html.rlike(r"(?i)<(img|link|iframe|source)\s[^>]*(src|href)\s*=\s*[\"']?(https?:)?//")
