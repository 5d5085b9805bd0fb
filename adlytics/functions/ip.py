"""IP addresses as household prefixes, in plain column expressions.

IPv4 stays as it is; IPv6 is cut to its /64 network and written in canonical short form.
After the cut the last four groups are zero, so the longest run of zero groups is always
the trailing one and the short form is: leading groups, then ``::``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape tests of the two address kinds.
IPV4_SHAPE = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"
IPV6_SHAPE = r"^([A-Za-z0-9]*\:){1,7}[A-Za-z0-9]*$"

_GROUP = "^[0-9A-Fa-f]{1,4}$"


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def ipv6_network64(address: Column) -> Column:
    """Canonical /64 network of a full or shortened IPv6 text, NULL when it is invalid."""
    gap = F.instr(address, "::")
    shortened = gap > 0
    head = _groups(F.when(shortened, F.substring(address, F.lit(1), gap - 1)).otherwise(address))
    tail = _groups(F.when(shortened, F.substring(address, gap + 2, F.length(address))).otherwise(F.lit("")))
    given = F.size(head) + F.size(tail)
    # Shortening stands for at least one group; a second "::" leaves an empty group behind.
    well_formed = F.when(shortened, given <= 7).otherwise(given == 8) & F.forall(
        F.concat(head, tail), lambda g: g.rlike(_GROUP)
    )
    filled = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0))), tail)
    leading = F.transform(
        F.slice(filled, 1, 4),
        lambda g: F.coalesce(F.nullif(F.ltrim(F.lower(g), F.lit("0")), F.lit("")), F.lit("0")),
    )
    short = F.regexp_replace(F.array_join(leading, ":"), "(^0|:0)(:0)*$", "")
    return F.when(well_formed, F.concat(short, F.lit("::")))


def household_address(address: Column) -> Column:
    """The form household lookups are keyed by; NULL for anything else than an address."""
    return F.when(address.rlike(IPV4_SHAPE), address).when(address.rlike(IPV6_SHAPE), ipv6_network64(address))
