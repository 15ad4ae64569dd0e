"""Addresses and networks as numbers, so that containment is a comparison."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"


def ipv4_number(c: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    p = F.split(c, r"\.")
    n = F.lit(0).cast("long")
    for i in range(4):
        n = n * 256 + p[i].try_cast("long")
    return F.when(c.rlike(rf"^({_OCTET}\.){{3}}{_OCTET}$"), n)


def cidr_bounds(c: Column) -> tuple[Column, Column, Column]:
    """`(first, last, prefix)` of an IPv4 network `a.b.c.d/n` (host bits may be set); null for anything else."""
    a, n = F.split(c, "/"), F.regexp_extract(c, r"/(\d{1,2})$", 1).try_cast("int")
    base = ipv4_number(a[0])
    size = F.pow(F.lit(2.0), 32 - n).cast("long")
    first = base - F.pmod(base, size)
    ok = n.between(0, 32)
    return F.when(ok, first), F.when(ok, first + size - 1), F.when(ok, n)


@F.pandas_udf(T.BinaryType())
def address_bytes(s: pd.Series) -> pd.Series:
    """An address of either version as 16 bytes (IPv4 mapped into IPv6), comparable as unsigned bytes; null if it is none."""

    def one(x):
        try:
            a = ipaddress.ip_address(str(x).strip())
        except ValueError:
            return None
        return (a.packed if a.version == 6 else b"\x00" * 10 + b"\xff\xff" + a.packed)

    return s.map(one, na_action="ignore")
