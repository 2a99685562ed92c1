"""Expressions on names, persons and urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of version-control urls.
KNOWN_SUFFIXES = ("git", "svn", "hg", "cvs", "CVS")


def parse_person(fullname: Column) -> Column:
    """Struct (fullname, name, email) of ``name <email>`` as bytes or text.

    Without an angle bracket the whole is the name and the email is null; an empty part is null.
    """
    text = fullname.cast("string")
    start = F.instr(text, "<")
    name = F.when(start > 0, F.rtrim(F.substring(text, F.lit(1), start - 1))).otherwise(text)
    rest = F.substring_index(F.substring(text, start + 1, F.length(text)), ">", 1)
    blank = lambda c: F.when(F.length(c) > 0, c)
    return F.struct(text.alias("fullname"), blank(name).alias("name"), F.when(start > 0, blank(rest)).alias("email"))


def url_candidates(url: Column) -> Column:
    """All rules that may apply to a url: itself, trimmed of slashes, without a known suffix, and every path prefix."""
    trimmed = F.regexp_replace(url, "/+$", "")
    bare = F.regexp_replace(trimmed, rf"\.({'|'.join(KNOWN_SUFFIXES)})$", "")
    parts = F.split(trimmed, "/")
    # scheme, an empty part and the host come first: prefixes begin with the host alone
    prefixes = F.when(F.size(parts) > 3, F.transform(F.sequence(F.lit(3), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.array_distinct(F.concat(F.array(url, trimmed, bare), F.coalesce(prefixes, F.array().cast("array<string>"))))
