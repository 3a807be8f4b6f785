"""Check digits of bank account numbers (ISO 7064, modulus 97-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import WS


def iban_valid(value: Column) -> Column:
    """Whether the check digits of an account number are right; white space and case do not matter."""
    clean = F.upper(F.regexp_replace(value, WS + "+", ""))
    turned = F.concat(F.substring(clean, 5, 64), F.substring(clean, 1, 4))
    # a letter is worth its place from A = 10 and moves the remainder by two digits
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0).cast("long"),
        lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + c.cast("long")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return F.coalesce(F.length(clean).between(15, 34) & (rest == 1), F.lit(False))
