"""IP address type as a column expression: loopback, private, multicast, reserved, public, invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowvigil import dims

_OCTET = "(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_number(ip: Column) -> Column:
    """The 32 bits of a dotted IPv4 address as a number; null for any other text."""
    parts = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(ip.rlike(_IPV4), number)


def _network_pattern(network: str, bits: int) -> str:
    """A regular expression for the addresses of one network, octet by octet."""
    octets = network.split(".")
    whole, part = divmod(bits, 8)
    pieces = octets[:whole]
    if part:
        first = int(octets[whole])
        pieces.append("(" + "|".join(str(first + i) for i in range(2 ** (8 - part))) + ")")
    pattern = r"\.".join(pieces)
    return pattern + ("$" if bits == 32 else r"\.")


def _ipv4_type(ip: Column) -> Column:
    """First matching network in priority order.

    The table is fixed, so there is no join; and every test reads the column itself,
    so nothing is computed twice when the expression ends up in a filter.
    """
    groups: dict[tuple[int, str], list[str]] = {}
    for priority, network, bits, kind in sorted(dims.IPV4_TYPES):
        groups.setdefault((priority, kind), []).append(_network_pattern(network, bits))
    out = None
    for (_, kind), patterns in sorted(groups.items()):
        test = ip.rlike("^(" + "|".join(patterns) + ")")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("public")


def _ipv6_type(ip: Column) -> Column:
    text = F.lower(ip)
    halves = F.split(text, "::")
    groups = F.filter(F.split(text, ":"), lambda g: g != "")
    short = F.size(halves) == 2
    well_formed = (text.rlike("^[0-9a-f:]+$") & (F.size(halves) <= 2)
                   & F.forall(groups, lambda g: F.length(g) <= 4)
                   & F.when(short, F.size(groups) <= 7).otherwise(
                       (F.size(groups) == 8) & ~text.rlike("^:|:$")))
    first = F.when(text.startswith("::"), F.lit("0")).otherwise(F.get(groups, F.lit(0)))
    lead = F.conv(first, 16, 10).cast("int")
    second = F.when(F.get(F.split(text, ":"), F.lit(1)) == "", F.lit("0")).otherwise(F.get(groups, F.lit(1)))
    return (F.when(~well_formed, "invalid")
            .when(text.rlike("^(0{0,4}:){1,7}:?0{0,3}1$"), "loopback")
            .when((lead >= 0xfc00) & (lead <= 0xfdff), "private")
            .when((lead >= 0xfe80) & (lead <= 0xfebf), "private")
            .when((lead == 0x2001) & (F.conv(second, 16, 10).cast("int") == 0x0db8), "private")
            .when(lead >= 0xff00, "multicast")
            .when((lead < 0x2000) | (lead > 0x3fff), "reserved")
            .otherwise("public"))


def ip_type(ip: str | Column) -> Column:
    ip = F.col(ip) if isinstance(ip, str) else ip
    mapped = F.regexp_extract(F.lower(ip), r"^::ffff:([0-9.]+)$", 1)
    return (F.when(ip.rlike(_IPV4), _ipv4_type(ip))
            .when(ip.contains(":") & mapped.rlike(_IPV4), _ipv4_type(mapped))
            .when(ip.contains(":"), _ipv6_type(ip))
            .otherwise("invalid"))


def ip_location(kind: Column) -> Column:
    return (F.when(kind == "loopback", "Local Machine").when(kind == "private", "Local Network")
            .otherwise("Internet"))
