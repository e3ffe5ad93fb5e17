"""Claimed device fingerprint of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINGERPRINT_SCHEMA = "os string, browser string, screen string"


def claimed_fingerprint(spoofed_json: Column, registered: Column) -> Column:
    """The fingerprint in the event when it parses completely, else the registered one, else null."""
    parsed = F.from_json(spoofed_json, FINGERPRINT_SCHEMA, {"mode": "PERMISSIVE"})
    complete = parsed["os"].isNotNull() & parsed["browser"].isNotNull() & parsed["screen"].isNotNull()
    return F.when(complete, parsed).otherwise(registered)
