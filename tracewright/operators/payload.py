"""Open payloads: a VARIANT column beside the typed fields, so that keys nobody foresaw stay with their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a payload that operators read, and their columns.
FIELDS = {"content": "content", "query": "query", "doc_id": "doc_id", "answer": "answer", "to": "to_agent"}
ANY = "map<string,variant>"


def json_string(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def as_object(json: Column, name: str = "raw") -> Column:
    """VARIANT of a JSON object; what is no object or no JSON becomes the object {name: it}; null stays null."""
    v = F.try_parse_json(json)
    wrapped = F.try_parse_json(F.concat(F.lit(f'{{"{name}":'), F.when(v.isNotNull(), json).otherwise(json_string(json)), F.lit("}")))
    return F.when(json.isNull(), F.lit(None)).when(v.try_cast(ANY).isNotNull(), v).otherwise(wrapped)


def with_fields(events: DataFrame) -> DataFrame:
    """events with the typed columns taken from their payload: strings as they are, other values as JSON."""
    return events.withColumns({column: F.try_variant_get("payload", f"$.{key}", "string") for key, column in FIELDS.items()})


def payload_json(events: DataFrame) -> Column:
    """The payload of typed events as JSON: the fields that are there."""
    return F.to_json(F.struct(*(F.col(column).alias(key) for key, column in FIELDS.items())))


def has_payload(events: DataFrame) -> Column:
    """Whether an event has any key in its payload, or any typed field if events carry no payload."""
    if "payload" in events.columns:
        return F.coalesce(F.size(F.col("payload").try_cast(ANY)) > 0, F.lit(False))
    return F.coalesce(*FIELDS.values()).isNotNull()


def payload_state(events: DataFrame) -> Column:
    """'given', 'empty' ({} was sent), or 'missing' (nothing was sent)."""
    if "payload" not in events.columns:
        return F.when(has_payload(events), "given").otherwise("missing")
    return F.when(F.col("payload").isNull(), "missing").when(has_payload(events), "given").otherwise("empty")


def other_keys(events: DataFrame, *but: str) -> Column:
    """The payload without some keys as compact JSON, keys in order; null if nothing is left."""
    if "payload" in events.columns:
        load = F.to_json(F.map_filter(F.col("payload").try_cast(ANY), lambda k, v: ~k.isin(*but)))
    else:
        load = F.to_json(F.struct(*(F.col(column).alias(key) for key, column in FIELDS.items() if key not in but)))
    return F.when(load != "{}", load)
