"""JSON envelopes: event batches and column-manifest results, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.conversations import EVENT_FIELDS

RESULT_SCHEMA = (
    "statement_response struct<manifest:struct<schema:struct<columns:array<string>>>,"
    "result:struct<data_array:array<string>>>"
)

# Event fields and their JSON names.
_FIELDS = {
    "type": "type", "message_id": "messageId", "parent_message_id": "parentMessageId",
    "tool_call_id": "toolCallId", "role": "role", "delta": "delta", "content": "content",
    "error_code": "code", "error_message": "message",
}
_NAMES = ("toolCallName", "title", "stepName", "name")
_EVENT = ", ".join(f"{n} string" for n in (*_FIELDS.values(), *_NAMES)) + ", timestamp bigint"


def explode_event_envelopes(df: DataFrame, body: str = "body", base_seq: str = "base_seq") -> DataFrame:
    """One row per event of JSON envelopes ``{"events": [...]}``, batch or streaming.

    Nested run starts and finishes are dropped, as the outer run has its own. Null fields are missing
    fields. ``base_seq`` numbers the envelopes of a chat so that events keep their order:
    event number = base_seq + position.
    """
    rows = df.select(
        *[c for c in df.columns if c not in (body, base_seq)],
        F.col(base_seq).alias("__base"),
        F.posexplode(F.from_json(body, "events array<string>")["events"]).alias("__pos", "__text"),
    ).withColumn("__e", F.from_json("__text", _EVENT))
    delta = F.col("__e.delta")
    listed = F.when(F.col("__text").rlike(r'"delta"\s*:\s*\['), F.from_json(delta, "array<string>"))
    out = rows.withColumns(
        {
            **{c: F.col(f"__e.{n}") for c, n in _FIELDS.items()},
            "name": F.coalesce(*[F.col(f"__e.{n}") for n in _NAMES]),
            "delta_list": listed,
            "seq": F.col("__base") + F.col("__pos"),
            "ts": F.timestamp_millis("__e.timestamp"),
        }
    ).withColumn("delta", F.when(F.col("delta_list").isNull(), F.col("delta")))
    kept = out.filter(F.col("type").isNotNull() & ~F.col("type").isin("RUN_STARTED", "RUN_FINISHED"))
    return kept.select(*[c for c in EVENT_FIELDS if c in kept.columns])


def manifest_to_rows(df: DataFrame, body: str = "body", cap: int | None = None) -> DataFrame:
    """Rows of a column-manifest result as maps from column name to value, in order.

    A column without a name is ``column_<i>``; of columns with one name the last counts; a short row is
    padded with NULL; with ``cap``, that many rows are read; anything that is no such envelope gives no rows.
    """
    parsed = df.withColumn("__r", F.from_json(body, RESULT_SCHEMA)["statement_response"])
    columns = F.coalesce(F.col("__r.manifest.schema.columns"), F.array().cast("array<string>"))
    names = F.transform(
        columns,
        lambda c, i: F.coalesce(F.get_json_object(c, "$.name"), F.concat(F.lit("column_"), i.cast("string"))),
    )
    keep = [c for c in df.columns if c != body]
    data = F.col("__r.result.data_array")
    rows = parsed.select(
        *keep,
        names.alias("__names"),
        F.posexplode(data if cap is None else F.slice(data, 1, cap)).alias("row_number", "__row"),
    )
    values = F.from_json("__row", "array<string>")

    def last(n):
        return (F.size("__names") - F.array_position(F.reverse("__names"), n)).cast("int")

    cells = F.transform(
        F.array_distinct("__names"), lambda n: F.struct(n.alias("key"), F.get(F.col("__values"), last(n)).alias("value"))
    )
    return (
        rows.withColumn("__values", values)
        .filter(F.col("__values").isNotNull())
        .select(*keep, "row_number", F.map_from_entries(cells).alias("values"))
    )


def to_json_document(
    df: DataFrame, source: str, question: str, order: list[str], summary: str | None = None, cap: int | None = None
) -> DataFrame:
    """A result as one JSON document: source, question, summary, and its rows in order, with ``cap`` the first ones.

    A document is one value, so a result that is not small needs a ``cap``.
    """
    first = df if cap is None else df.orderBy(*order).limit(cap)
    position = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct(position.alias("o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"]
    )
    head = [F.lit(source).alias("source"), F.lit(question).alias("question")]
    if summary:
        head.append(F.lit(summary).alias("summary"))
    return first.agg(rows.alias("rows")).select(F.to_json(F.struct(*head, "rows")).alias("document"))
