"""URL expressions. The three domain forms differ on purpose; see each one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.dims import HOST_PREFIXES
from broadsheet.functions.text import strip

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
_LEADING_JUNK = "".join(map(chr, range(0x21)))


def _authority(url: Column, skip: str = "") -> Column:
    """Authority part of a URL, less a prefix to skip; ``''`` if it has none.

    Port and user info stay.
    """
    clean = F.ltrim(F.translate(url, "\t\r\n", ""), F.lit(_LEADING_JUNK))
    return F.regexp_extract(clean, rf"{_SCHEME}(?:{skip})?([^/?#]*)", 1)


def url_netloc(url: Column) -> Column:
    """Authority part as written, or the whole value when there is none."""
    netloc = _authority(url)
    return F.when(netloc == "", url).otherwise(netloc)


def url_host(url: Column) -> Column:
    """Host of an absolute URL in lower case, without user info and port."""
    return F.regexp_replace(F.lower(_authority(url)), r"^.*@|:[0-9]*$", "")


def url_domain(url: Column) -> Column:
    """Lower case, without scheme and ``www.``, up to the first slash."""
    bare = F.regexp_replace(F.lower(url), r"^https?://", "")
    return F.split_part(F.regexp_replace(bare, r"^www\.", ""), F.lit("/"), F.lit(1))


def url_netloc_nowww(url: Column) -> Column:
    """Authority without ``www.``; ``''`` for bare domains and missing URLs.

    A lone square bracket makes the authority unreadable: null.
    """
    netloc = _authority(F.lower(strip(F.coalesce(url, F.lit("")))), r"www\.")
    readable = F.contains(netloc, F.lit("[")) == F.contains(netloc, F.lit("]"))
    return F.when(readable, netloc)


def source_url_norm(url: Column) -> Column:
    """Stripped lower-case URL. Nothing is cut, so only bare domains can match
    ``url_netloc_nowww``."""
    return F.lower(strip(url))


def domain_variants(domain: Column) -> Column:
    """Host names to look up for one domain, in order of preference."""
    base = F.lower(strip(domain))
    www = F.when(~F.startswith(base, F.lit("www.")), F.concat(F.lit("www."), base))
    prefixed = [F.concat(F.lit(f"{p}."), base) for p in HOST_PREFIXES]
    return F.array_compact(F.array(base, www, *prefixed))
