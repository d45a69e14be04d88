"""Record keys: a 64-bit BLAKE2b hash of the parts that name a record."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed value: what stands between the parts.
SEPARATOR = "\x1f"


def ledger_key_of(material: str) -> int:
    """The signed big-endian number of the 8-byte digest."""
    return int.from_bytes(hashlib.blake2b(material.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@F.pandas_udf(LongType())
def _keys(material: pd.Series) -> pd.Series:
    return material.map(lambda x: None if x is None else ledger_key_of(x)).astype("Int64")


def ledger_key(*parts: Column) -> Column:
    """No built-in has this digest, so batches go through hashlib; null parts read as empty."""
    return _keys(F.concat_ws(SEPARATOR, *(F.coalesce(p, F.lit("")) for p in parts)))


def root_identity(path: Column) -> Column:
    """The first 32 hex digits of a path's SHA-256."""
    return F.substring(F.sha2(F.encode(path, "UTF-8"), 256), 1, 32)


def group_id(identities: Column) -> Column:
    return F.substring(F.sha2(F.encode(F.array_join(F.array_sort(identities), "\n"), "UTF-8"), 256), 1, 32)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))
