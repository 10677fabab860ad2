"""Functions on strings, arrays and vectors, all of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def word_ngrams(text: Column, n: int) -> Column:
    """All runs of n words of a text, parted by one space."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(size != 0, size)


def mask_emails(text: Column) -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "<email>")


def tags_stripped(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


#: A URL's scheme, authority, path, query with its mark, and query.
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?"


def normal_url(url: Column) -> Column:
    """One spelling of a URL: scheme and host in lower case, no default port, no fragment, `/` for no path, parameters in order and none empty.

    Null for null; what has no `://` behind a scheme stays as it is.
    """
    part = lambda i: F.regexp_extract(url, _URL, i)
    scheme, path = F.lower(part(1)), part(3)
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443").otherwise(":")
    host = F.lower(part(2))
    host = F.when(host.endswith(port), F.left(host, F.length(host) - F.length(port))).otherwise(host)
    query = F.array_join(F.array_sort(F.filter(F.split(part(5), "&"), lambda x: x != "")), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(_URL), whole).otherwise(url)
