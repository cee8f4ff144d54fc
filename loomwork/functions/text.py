"""Text expressions: accents, titles, slugs, and normal forms of addresses, numbers and URLs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_map() -> tuple[str, str]:
    """Letters up to U+024F and U+1EFF that decompose to an ASCII letter and marks, and that letter."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accent_map()


def strip_accents(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"[̀-ͯ]", ""), _FROM, _TO)


def title_case(c: Column) -> Column:
    """First letter of each run of letters and marks upper, the rest lower; everything else as it is."""
    parts = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(strip_accents(c))


def slugify(c: Column, max_len: int = 80) -> Column:
    """ASCII slug; cut at a separator when it is longer than ``max_len``."""
    full = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(full, 1, max_len)
    at_gap = F.when(F.substring(full, max_len + 1, 1) == "-", head).otherwise(F.regexp_replace(head, "-[^-]*$", ""))
    return F.when(F.length(full) <= max_len, full).otherwise(F.regexp_replace(at_gap, "-+$", ""))


def normalize_email(c: Column, strip_tag: bool = True) -> Column:
    """Address without display name, lower case, without +tag; Gmail without dots and under one domain."""
    bare = F.lower(F.trim(F.when(c.contains("<"), F.regexp_extract(c, "<([^>]*)>", 1)).otherwise(c)))
    bare = F.regexp_replace(bare, "^mailto:", "")
    local, domain = F.substring_index(bare, "@", 1), F.substring_index(bare, "@", -1)
    if strip_tag:
        local = F.substring_index(local, "+", 1)
    gmail = domain.isin("gmail.com", "googlemail.com")
    local = F.when(gmail, F.replace(local, F.lit("."), F.lit(""))).otherwise(local)
    domain = F.when(gmail, "gmail.com").otherwise(domain)
    return F.when(bare.rlike(r"^[^@\s]+@[^@\s]+$"), F.concat_ws("@", local, domain))


#: Calling codes and national number lengths of the regions that numbers without a code may be from.
REGIONS = {"ES": ("34", 9), "FR": ("33", 9), "DE": ("49", 11), "US": ("1", 10), "GB": ("44", 10)}


def normalize_phone(c: Column, region: str = "ES") -> Column:
    """+ and digits; 00 is +, a national number gets the region's code."""
    code, length = REGIONS[region]
    raw = F.regexp_replace(c, "[^0-9+]", "")
    raw = F.regexp_replace(raw, "^00", "+")
    digits = F.replace(raw, F.lit("+"), F.lit(""))
    national = F.when(F.length(digits) == length, F.concat(F.lit(f"+{code}"), digits)).otherwise(F.concat(F.lit("+"), digits))
    return F.when(F.length(digits) >= 6, F.when(raw.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(national))


def domain_of(c: Column) -> Column:
    """Host of a URL or of an address, lower case, without port and www."""
    host = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(host, r"^([^/?#]*)", 1)
    host = F.regexp_replace(F.substring_index(host, "@", -1), r":\d+$", "")
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


#: Query parameters that only track a visitor.
TRACKING = "utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|ref"


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no tracking parameters, parameters sorted."""
    url = F.regexp_replace(F.trim(c), "#.*$", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.concat(scheme, F.lit("://"), host, path, tail)


def url_key(c: Column) -> Column:
    """Merge key: without scheme, www and a last slash."""
    return F.regexp_replace(F.regexp_replace(normalize_url(c), r"^[a-z]+://(www\.)?", ""), "/$", "")


def clean_text(c: Column) -> Column:
    """No invisible characters, single blanks, words joined over line-end hyphens, at most one blank line."""
    out = F.regexp_replace(c, "[\\u200b-\\u200f\\u2060\\ufeff\\u00ad]", "")
    out = F.regexp_replace(F.translate(out, " \t", "  "), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"([a-z])-\n([a-z])", "$1$2")
    out = F.regexp_replace(F.regexp_replace(out, " +", " "), " *\n *", "\n")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))
