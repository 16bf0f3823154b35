"""IP addresses and networks as 128-bit keys, in 32 hexadecimal digits. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
#: IPv4 addresses are the IPv6 ones under this network of 96 bits.
_MAPPED = "0" * 20 + "ffff"


def _v4_hex(ip: Column) -> Column:
    """Eight digits of a dotted address, null for anything else."""
    octets = F.transform(F.split(ip, r"\."), lambda o: F.lpad(F.lower(F.hex(o.try_cast("bigint"))), 2, "0"))
    return F.when(ip.rlike(_V4), F.array_join(octets, ""))


def _v6_hex(ip: Column) -> Column:
    """32 digits of a colon-separated address, ``::`` and a dotted tail allowed; null for anything else."""
    # The dotted tail as two groups.
    tail = _v4_hex(F.regexp_extract(ip, r"([0-9.]+)$", 1))
    head = F.regexp_replace(ip, r"[0-9]+(\.[0-9]+){3}$", "")
    plain = F.when(~ip.contains("."), ip).otherwise(F.concat(head, F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)))
    groups = lambda text: F.filter(F.split(text, ":", -1), lambda g: g != "")
    sides = F.split(plain, "::", -1)
    left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    gap = F.lit(8) - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    hextet = r"[0-9A-Fa-f]{1,4}"
    run = rf"{hextet}(:{hextet})*"
    full = plain.rlike(rf"^{hextet}(:{hextet}){{7}}$")
    short = plain.rlike(rf"^({run})?::({run})?$") & (gap >= 1)
    return F.when(full | short, F.lower(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))


def address_key(ip: Column) -> Column:
    """The 32 digits of an IPv4 or IPv6 address; null for anything else. Mapped addresses equal their IPv4 form."""
    return F.coalesce(F.concat(F.lit(_MAPPED), _v4_hex(ip)), _v6_hex(ip))


def network_bits(network: Column) -> Column:
    """The prefix length of ``address/length``, of 128; an address alone is a network of its own. Null if out of range."""
    address, length = F.split_part(network, F.lit("/"), F.lit(1)), F.split_part(network, F.lit("/"), F.lit(2))
    four = address.rlike(_V4)
    given = F.when(length.rlike(r"^\d{1,3}$"), length.try_cast("int"))
    bits = F.when(~network.contains("/"), F.lit(128)).otherwise(F.when(four, given + 96).otherwise(given))
    return F.when((bits <= 128) & address_key(address).isNotNull(), bits)


def prefix(key: Column, bits: Column) -> Column:
    """The first ``bits`` of a key, as text that is equal for equal bits of one length."""
    digits, rest = (bits / 4).cast("int"), bits % 4
    digit = F.conv(F.substring(key, digits + 1, F.lit(1)), 16, 10).cast("int")
    cut = F.call_function("shiftright", digit, F.lit(4) - rest)
    return F.when(rest == 0, F.substring(key, F.lit(1), digits)).otherwise(
        F.concat(F.substring(key, F.lit(1), digits), F.lit("/"), cut.cast("string"))
    )
