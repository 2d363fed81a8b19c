"""Stable 128-bit identifiers: hex digests over parts joined by the unit separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def stable_id(*parts: Column) -> Column:
    """32 lower-case hex characters; a null part counts as an empty one."""
    return F.md5(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def template_id(service: Column, severity: Column, headline: Column) -> Column:
    return stable_id(service, severity, headline, F.lit(""))


def event_id(run_id: Column, source: Column, offset: Column, raw_hash: Column) -> Column:
    return stable_id(run_id, source, offset, raw_hash)
