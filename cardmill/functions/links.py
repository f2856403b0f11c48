"""URL parts and the redirect rule of result cards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def has_query(href: Column) -> Column:
    return F.contains(href, F.lit("?"))


def redirect_target(href: Column) -> Column:
    """The URL a redirecting link points to; empty if the link has no query part.

    Takes what stands between the first and the second ``?``, drops every
    leading ``q`` and ``=`` and cuts at the first ``&``. A target with an
    unescaped query of its own therefore loses it, and escapes stay as they are.
    """
    query = F.split_part(href, F.lit("?"), F.lit(2))
    return F.split_part(F.regexp_replace(query, "^[q=]+", ""), F.lit("&"), F.lit(1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
