"""Column functions for frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_frame(frame: Column) -> Column:
    """Bytes of a base64 text with an optional data-URI prefix; null where the padding is missing."""
    body = F.when(F.contains(frame, F.lit(",")), F.element_at(F.split(frame, ",", 2), 2)).otherwise(frame)
    alphabet = F.regexp_replace(body, "[^A-Za-z0-9+/=]", "")
    return F.when(F.char_length(alphabet) % 4 == 0, F.unbase64(alphabet))
