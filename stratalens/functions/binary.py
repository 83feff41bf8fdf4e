"""Byte slices, big-endian integers and network addresses as native expressions.

Positions are 1-based, as in SQL ``substring``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_LEVELS = (3, 2, 1, 0)


def _pos(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are worked out once, whatever later filters and columns make of them.

    Predicates and projections don't cross the one-element generator, so they never repeat the expressions.
    """
    named = [value.alias(name) for name, value in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*named))))


def byte_slice(data: Column, pos, length: int) -> Column:
    return F.substring(data, _pos(pos), F.lit(length))


def be_int(data: Column, pos, length: int) -> Column:
    """Unsigned big-endian integer of up to 7 bytes; NULL past the end."""
    number = F.conv(F.hex(byte_slice(data, pos, length)), 16, 10).cast("bigint")
    return F.when(F.octet_length(data) >= _pos(pos) + (length - 1), number)


def low_nibble(data: Column, pos) -> Column:
    return be_int(data, pos, 1).bitwiseAND(F.lit(15).cast("bigint"))


def is_mapped(address: Column) -> Column:
    """IPv6 address that carries an IPv4 address in its last four bytes."""
    return (F.octet_length(address) == 16) & (
        byte_slice(address, 1, 12) == F.unhex(F.lit("00000000000000000000FFFF"))
    )


def plain_address(address: Column) -> Column:
    """Four bytes for IPv4 and mapped addresses, sixteen bytes otherwise."""
    return F.when(is_mapped(address), byte_slice(address, 13, 4)).otherwise(address)


def _dotted(address: Column) -> Column:
    return F.concat_ws(".", *[be_int(address, i, 1).cast("string") for i in range(1, 5)])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shortened(groups: Column) -> Column:
    """The leftmost longest run of two or more zero groups becomes ``::``; in and out begin and end with a colon."""
    runs = F.regexp_extract_all(groups, F.lit(":(0(?::0)+)(?=:)"), F.lit(1))
    longest = F.aggregate(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))

    def cut(run: Column) -> Column:
        needle = F.concat(F.lit(":"), run, F.lit(":"))
        before = F.call_function("substring_index", groups, needle, F.lit(1))
        after = F.substring(groups, F.length(before) + F.length(needle) + 1, F.length(groups))
        return F.when(run == "", groups).otherwise(F.concat(before, F.lit("::"), after))

    return bound(longest, cut)


def _compressed(address: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.hex(address)), "(.{4})", ":$1")
    groups = F.concat(F.regexp_replace(spaced, ":0{1,3}", ":"), F.lit(":"))
    return F.regexp_replace(bound(groups, _shortened), "^:(?!:)|(?<!:):$", "")


def ip_text(address: Column) -> Column:
    """Canonical address text; mapped IPv6 prints in dotted IPv4 form."""
    return bound(
        plain_address(address),
        lambda plain: F.when(F.octet_length(plain) == 4, _dotted(plain)).when(
            F.octet_length(plain) == 16, _compressed(plain)
        ),
    )


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED_RE = f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"
_EMBEDDED_RE = f"^(.*:){_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"


def _dotted_hex(text: Column) -> Column:
    parts = F.split(text, "\\.")
    return F.array_join(F.transform(parts, lambda p: F.lpad(F.hex(p.try_cast("bigint")), 2, "0")), "")


def ip_bin(text: Column) -> Column:
    """Address text to 4 or 16 bytes (mapped form to 4); NULL if unparsable."""
    embedded = F.regexp_extract(text, "([0-9.]+)$", 1)
    embedded_hex = _dotted_hex(embedded)
    widened = F.when(
        text.rlike(_EMBEDDED_RE),
        F.concat(
            F.regexp_extract(text, "^(.*:)[0-9.]+$", 1),
            F.substring(embedded_hex, 1, 4),
            F.lit(":"),
            F.substring(embedded_hex, 5, 4),
        ),
    ).otherwise(text)
    halves = F.split(widened, "::", -1)
    left = F.filter(F.split(F.get(halves, F.lit(0)), ":", -1), lambda g: g != "")
    right = F.filter(
        F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":", -1), lambda g: g != ""
    )
    given = F.size(left) + F.size(right)
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0))), right)
    digits = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    one_group = "[0-9A-Fa-f]{1,4}"
    body = f"({one_group}(:{one_group})*)?"
    valid = F.when(
        F.contains(widened, F.lit("::")),
        widened.rlike(f"^{body}::{body}$") & (given <= 7),
    ).otherwise(widened.rlike(f"^{one_group}(:{one_group}){{7}}$"))
    return F.when(text.rlike(_DOTTED_RE), F.unhex(_dotted_hex(text))).when(
        valid, plain_address(F.unhex(digits))
    )


def address_bucket(address: Column, level: int) -> Column:
    """The first ``level`` bytes of an IPv4 address, or twice as many of an IPv6 one, as a BIGINT; families never meet."""
    head = lambda size: be_int(address, 1, size) if size else F.lit(0).cast("bigint")
    return F.when(F.octet_length(address) == 4, head(level)).when(
        F.octet_length(address) == 16, head(2 * level) + F.lit(1 << 56)
    )
