"""Strings: UTM tags, domains, id parts and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlytics.params import BROWSER_ALIASES, BROWSER_FAMILIES, OTHER_LABEL

# URL parameter patterns.
UTM_MEDIUM_PATTERN = "utm_medium=([^&]+)"
UTM_SOURCE_PATTERN = "utm_source=([^&]+)"


def extract(value: Column, pattern: str) -> Column:
    """First group of the first match, NULL when nothing matches."""
    return F.nullif(F.regexp_extract(value, pattern, 1), F.lit(""))


def utm_medium(url: Column) -> Column:
    return extract(url, UTM_MEDIUM_PATTERN)


def utm_source(url: Column) -> Column:
    return extract(url, UTM_SOURCE_PATTERN)


def bare_domain(url: Column) -> Column:
    """Domain without scheme, ``www.`` and trailing slashes."""
    bare = url
    for part in ("http://", "https://", "www."):
        bare = F.replace(bare, F.lit(part), F.lit(""))
    return F.rtrim(bare, F.lit("/"))


def part(value: Column, index: int, separator: str = "|") -> Column:
    """Zero-based piece of a separated string, NULL past the end."""
    return F.get(F.split(value, f"[{separator}]"), F.lit(index))


def strip_leading(value: Column, characters: str) -> Column:
    """Remove any of the characters from the front: a set, not a prefix."""
    return F.ltrim(value, F.lit(characters))


def fingerprint(*parts: Column) -> Column:
    """Joined parts, NULL as soon as one part is NULL."""
    return F.concat(*parts)


def hashed_key(*parts: Column) -> Column:
    """MD5 of the parts joined by ``-``, missing parts counting as empty."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("-", *filled))


def micros_text(ts: Column) -> Column:
    """Timestamp as an engine-neutral key part."""
    return F.unix_micros(ts).cast("string")


def like_any(value: Column, patterns: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for pattern in patterns:
        test = test | value.like(pattern)
    return test


def browser_family(name: Column) -> Column:
    label = F.when(name.isin(*BROWSER_FAMILIES), name)
    for family in dict.fromkeys(BROWSER_ALIASES.values()):
        aliases = [alias for alias, target in BROWSER_ALIASES.items() if target == family]
        label = label.when(name.isin(*aliases), F.lit(family))
    return label.otherwise(F.lit(OTHER_LABEL))
