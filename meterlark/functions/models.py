"""Model ids as columns: one key for the many spellings of a model, and a name to show."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Routing prefixes, taken off in this order, each at most once.
PREFIXES = ("us.anthropic.", "eu.anthropic.", "anthropic.", "anthropic/")
#: Ids that stand for another where they have no entry of their own.
ALIASES = {"gpt-5.6": "gpt-5.6-sol"}
#: Fixed value: the model of rows whose model isn't known yet.
PLACEHOLDER = "codex-unattributed"
SYNTHETIC = "<synthetic>"


def normalize_model(model: Column) -> Column:
    """Lower case, trimmed, without context marks, prefixes and date stamps; null and empty ids are ''."""
    m = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(model, F.lit("")))), r"\[\s*1m\s*\]", ""))
    m = F.regexp_replace(m, "^" + "".join(f"(?:{re.escape(p)})?" for p in PREFIXES), "")
    return F.trim(F.regexp_replace(F.regexp_replace(m, r"-\d{4}-\d{2}-\d{2}$", ""), r"-\d{6,8}$", ""))


def pretty_model(model: Column) -> Column:
    """`claude-family-4-8` as `Family 4.8`; an empty id as `(unknown)`; others as they are."""
    shape = r"^claude-([a-z]+)-(\d+)(?:-(\d+))?$"
    part = lambda i: F.regexp_extract(model, shape, i)
    named = F.concat(F.initcap(part(1)), F.lit(" "), part(2), F.when(part(3) != "", F.concat(F.lit("."), part(3))).otherwise(""))
    return F.when(model == "", "(unknown)").when(F.rlike(model, F.lit(shape)), named).otherwise(model)


def model_matches(model: Column, wanted: str) -> Column:
    """Whether the id or its shown name holds the text, in any case."""
    text = wanted.strip().lower()
    return F.contains(F.lower(model), F.lit(text)) | F.contains(F.lower(pretty_model(model)), F.lit(text))
