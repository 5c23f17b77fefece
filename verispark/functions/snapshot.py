"""JSON columns compared and changed by value."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import VerifyConfig


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def is_stale(metadata: Column, cfg: VerifyConfig) -> Column:
    """True where an embedding was made under other settings, or under unknown ones."""
    return ~F.coalesce(canonical_json(metadata).eqNullSafe(canonical_json(F.lit(cfg.snapshot))), F.lit(False))


def json_object(text: Column) -> Column:
    """A JSON object's keys and values; null and JSON's null are the empty object, anything else is null."""
    v = F.try_parse_json(text)
    # an object comes first, so it is parsed once
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.when(text.isNull() | F.is_variant_null(v), F.expr("map()").cast("map<string,variant>")))


def set_json_key(text: Column, key: str, value: Column) -> Column:
    """JSON object text with one key set to a struct, its fields in their order; other keys keep their types, keys come sorted. Null where text is another JSON value or none."""
    # the struct is written as text, as a variant of it costs several times that
    new = F.concat(F.lit(json.dumps(key, ensure_ascii=False) + ":"), F.to_json(value, {"ignoreNullFields": "false"}))
    inside = lambda m: F.regexp_extract(F.to_json(m), r"(?s)^\{(.*)\}$", 1)

    def put(old: Column) -> Column:
        # a variant's keys come sorted, so the new one goes between those before and after it
        parts = F.array(inside(F.map_filter(old, lambda k, v: k < key)), new, inside(F.map_filter(old, lambda k, v: k > key)))
        return F.when(old.isNotNull(), F.concat(F.lit("{"), F.array_join(F.array_remove(parts, ""), ","), F.lit("}")))

    # a lambda's variable is computed once; written out, Spark parses the text for each place where old stands
    return F.get(F.transform(F.array(json_object(text)), put), F.lit(0))
