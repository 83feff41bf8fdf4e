"""Distinct-count sketch expressions: register index, rank and estimate.

The hash, split and estimator are fixed values so that sketches made elsewhere
with the same definition merge with ours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_P = 14
MIN_P, MAX_P = 4, 16
HASH_BITS = 64


def check_precision(p: int) -> int:
    if not MIN_P <= p <= MAX_P:
        raise ValueError("precision must be between 4 and 16")
    return p


def _hex_int(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def register_index(key: Column, p: int = DEFAULT_P) -> Column:
    """Top ``p`` bits of the key's SHA-1."""
    head = _hex_int(F.substring(F.sha1(key), 1, 4))
    return F.shiftright(head, 16 - check_precision(p)).cast("int")


def register_rank(key: Column, p: int = DEFAULT_P) -> Column:
    """Leading zeros of the remaining ``64 - p`` bits, plus one."""
    rest_bits = HASH_BITS - check_precision(p)
    digest = F.sha1(key)
    head = _hex_int(F.substring(digest, 1, 4)).bitwiseAND(F.lit((1 << (16 - p)) - 1).cast("bigint"))
    rest = F.shiftleft(head, 48).bitwiseOR(_hex_int(F.substring(digest, 5, 12)))
    used = F.when(rest > 0, F.length(F.bin(rest))).otherwise(0)
    return (F.lit(rest_bits + 1) - used).cast("int")


def estimate(inverse_sum: Column, filled: Column, p: int = DEFAULT_P) -> Column:
    """Cardinality from sum(2^-rank) and count of the non-zero registers."""
    m = 1 << check_precision(p)
    alpha = 0.7213 / (1.0 + 1.079 / m)
    zeros = F.lit(m) - filled
    raw = F.lit(alpha * m * m) / (F.coalesce(inverse_sum, F.lit(0.0)) + zeros)
    small = F.lit(float(m)) * F.log(F.lit(float(m)) / zeros)
    return F.when((raw <= 2.5 * m) & (zeros > 0), small).otherwise(raw)
