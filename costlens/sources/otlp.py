"""OTLP JSON lines (traces and logs) to typed rows, with a quarantine frame.

One distributed plan per file set: every line is parsed once, to a VARIANT;
three ``posexplode`` levels (resource, scope, span/record) and a projection
of Column functions take what they need from it. ``raw_payload`` is the whole
span or record as JSON text, written from the same VARIANT (keys in order, no
blanks; the last of a repeated key counts). Nothing is collected; every row
carries an order key (line order, then positions inside the document) so that
"first wins" means file order, as it does for a sequential loader.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens import schemas
from costlens.config import EngineConfig
from costlens.functions import columns as C
from costlens.functions import rules

CORRUPT = "_corrupt_record"
TRACE_LEVELS = ("resourceSpans", "scopeSpans", "spans")
LOG_LEVELS = ("resourceLogs", "scopeLogs", "logRecords")
SPAN_FIELDS = "spanId:string,parentSpanId:string,traceId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string"
LOG_FIELDS = "timeUnixNano:string,body:struct<stringValue:string>"


class Parsed(NamedTuple):
    """What a parser makes of its lines. ``rows`` holds all of it in one frame:
    rows with their ``_reason`` (null: good), ``_raw`` text and identity. It can
    be written once and taken apart again (``split``)."""

    good: DataFrame
    quarantine: DataFrame
    identities: DataFrame  # (seq, ri, raw_developer_id, developer_email) as seen
    rows: DataFrame


#: Reason of a row that is neither good nor bad: a resource without items.
NOTHING = "nothing"
_OWN = ["_reason", "_raw", "raw_developer_id", "developer_email"]


def split(rows: DataFrame, source: str) -> Parsed:
    """Good rows, quarantine and identities of a parser's ``rows``."""
    good = rows.filter(F.col("_reason").isNull()).drop(*_OWN)
    bad = rows.filter(F.col("_reason").isNotNull() & (F.col("_reason") != NOTHING)).select(
        F.lit(source).alias("source"), F.col("_reason").alias("reason"), F.col("_raw").alias("raw"))
    nested = isinstance(rows.schema["_seq"].dataType, T.StructType) and "ri" in rows.schema["_seq"].dataType.fieldNames()
    who = rows if nested else rows.filter(F.col("_reason").isNull())
    seq, ri = (F.col("_seq.seq"), F.col("_seq.ri")) if nested else (F.col("_seq"), F.lit(0))
    names = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in _OWN[2:]]
    ids = who.select(seq.alias("seq"), ri.alias("ri"), *names).filter(F.col("ri").isNotNull())
    return Parsed(good, bad, ids, rows)


def _with_seq(lines: DataFrame) -> DataFrame:
    if "seq" in lines.columns:
        return lines
    return lines.withColumn("seq", F.monotonically_increasing_id())


def _once(c: Column) -> Column:
    """``c`` as a column that no later filter or projection computes again: the
    optimizer copies an expression into what is built on it, but not through a
    generator."""
    return F.explode(F.array(c))


def _documents(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Flat records: (value, seq, doc) of every line that is not blank; ``doc``
    has the raw line as its corrupt record where it cannot be parsed."""
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", with_corrupt, {"columnNameOfCorruptRecord": CORRUPT})
    return _with_seq(lines).filter(~_blank()).select("value", "seq", _once(parsed).alias("doc"))


def _blank() -> Column:
    value = F.col("value")
    return value.isNull() | (~value.startswith("{") & value.rlike(rules.BLANK_LINE_PATTERN))


def _list(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "array<variant>")


def _no_object(doc: str) -> str:
    """Something else than a JSON object stands here (JSON's null passes)."""
    return f"(not is_variant_null({doc}) and try_variant_get({doc}, '$', 'struct<>') is null)"


def _no_list(doc: str, path: str) -> str:
    """Something else than a list stands at ``path`` (nothing and null pass)."""
    there = f"try_variant_get({doc}, '{path}', 'variant')"
    return f"({there} is not null and not is_variant_null({there}) and try_variant_get({doc}, '{path}', 'array<variant>') is null)"


def _any(doc: str, path: str, each: str, test: str) -> str:
    return f"coalesce(exists(try_variant_get({doc}, '{path}', 'array<variant>'), {each} -> {test}), false)"


def _misshapen(doc: str, resources: str, scopes: str, items: str) -> Column:
    """A line with a broken part yields nothing but its quarantine row.

    A cast to the bare shape shows at once that every list is there and holds
    objects; only a line with something missing or odd is tested part by part."""
    bad_item = f"({_no_object('i')} or {_no_list('i', '$.attributes')})"
    bad_scope = f"({_no_object('s')} or {_no_list('s', f'$.{items}')} or {_any('s', f'$.{items}', 'i', bad_item)})"
    bad_resource = (f"({_no_object('r')} or {_no_list('r', f'$.{scopes}')} or {_no_list('r', '$.resource.attributes')} "
                    f"or {_any('r', f'$.{scopes}', 's', bad_scope)})")
    exact = f"({_no_object(doc)} or {_no_list(doc, f'$.{resources}')} or {_any(doc, f'$.{resources}', 'r', bad_resource)})"
    shape = (f"array<struct<resource:struct<attributes:array<struct<>>>,{scopes}:array<struct<{items}:"
             "array<struct<attributes:array<struct<>>>>>>>>")
    all_there = (
        f"forall(try_variant_get({doc}, '$.{resources}', '{shape}'), r -> r.resource.attributes is not null "
        f"and forall(r.{scopes}, s -> forall(s.{items}, i -> i.attributes is not null)))")
    return F.when(F.expr(f"coalesce({all_there}, false)"), False).otherwise(F.col(doc).isNull() | F.expr(exact))


_ATTRIBUTES = schemas.ATTRIBUTES.simpleString()


def _items(lines: DataFrame, levels: tuple[str, str, str], fields: str) -> DataFrame:
    """resource → scope → item explosion of every line that is not blank;
    attribute maps are built once per resource and once per item, and so are
    the item's ``fields`` (a struct's DDL) and its JSON text ``raw``.

    Explosions are outer ones: a line that cannot be parsed stays as one row
    with its text in ``line``, a resource without items as one without item,
    which still tells its developer. (An inner one would also have the
    optimizer test each list's size first, extracting it twice.)"""
    resources, scopes, items = levels
    docs = _with_seq(lines).filter(~_blank()).select("value", "seq", _once(F.try_parse_json("value")).alias("json"))
    docs = docs.select("seq", "value", _once(F.when(~_misshapen("json", *levels), F.col("json"))).alias("doc"))
    shape = f"array<struct<resource:struct<attributes:{_ATTRIBUTES}>,{scopes}:array<struct<{items}:array<variant>>>>>"
    res = docs.select(
        "seq", F.when(F.col("doc").isNull(), F.col("value")).alias("line"),
        F.posexplode_outer(F.try_variant_get("doc", f"$.{resources}", shape)).alias("ri", "res"),
    ).select(
        "seq", "line", F.when(F.col("res").isNotNull(), F.col("ri")).alias("ri"), F.col(f"res.{scopes}").alias("scopes"),
        _once(C.attr_map(F.col("res.resource.attributes"))).alias("rattrs"),
    )
    found = (
        res.select("seq", "line", "ri", "rattrs", F.posexplode_outer("scopes").alias("si", "scope"))
        .select("seq", "line", "ri", "rattrs", "si", F.posexplode_outer(f"scope.{items}").alias("pi", "item"))
        .select("*", _once(F.to_json("item")).alias("raw"))
    )
    # A cast builds each text by an expression of its own, so the item's fields
    # are read from its JSON: written from the VARIANT, it holds every number as
    # the cast would write it. Only an item with a part of another type is cast.
    kinds = f"struct<{fields},attributes:{_ATTRIBUTES},{CORRUPT}:string>"
    read = F.from_json("raw", kinds, {"columnNameOfCorruptRecord": CORRUPT})
    f = F.when(F.col(f"read.{CORRUPT}").isNull(), F.col("read")).otherwise(F.try_variant_get("item", "$", kinds))
    found = found.select("*", _once(read).alias("read")).select("*", _once(f).alias("f"))
    return found.select("seq", "line", "ri", "si", "pi", "rattrs", "item", "raw", "f",
                        _once(C.attr_map(F.col("f.attributes"))).alias("attrs"))


def _field(path: str) -> Column:
    return F.col(f"f.{path}")


def _resource_columns(cfg: EngineConfig) -> list[Column]:
    a = cfg.attributes
    raw_dev = C.or_unattributed(F.col("rattrs")[a.developer_id])
    return [
        C.first_present(F.col("rattrs")[a.wrapper_session_id], F.col("attrs")[a.session_id],
                        F.col("rattrs")[a.session_id]).alias("session_id"),
        C.blank_to_null(F.col("attrs")[a.prompt_id]).alias("prompt_id"),
        C.or_unattributed(F.col("rattrs")[a.issue_key]).alias("issue_key"),
        C.pseudonym(raw_dev, cfg.salt).alias("developer_id"),
    ]


def _reason(checks: list[tuple[str, Column]]) -> Column:
    reason = None
    for name, failed in checks:
        reason = F.when(failed, F.lit(name)) if reason is None else reason.when(failed, F.lit(name))
    return reason


def _line_reason(checks: list[tuple[str, Column]]) -> list[Column]:
    """``_reason``, ``_raw`` and the resource's identity."""
    reason = (F.when(F.col("line").isNotNull(), F.lit("malformed_line")).when(F.col("item").isNull(), F.lit(NOTHING))
              .otherwise(_reason(checks)))
    raw = F.when(reason.isNotNull(), F.coalesce(F.col("line"), F.col("raw")))
    return [reason.alias("_reason"), raw.alias("_raw")]


def _who(cfg: EngineConfig) -> list[Column]:
    a = cfg.attributes
    return [C.or_unattributed(F.col("rattrs")[a.developer_id]).alias("raw_developer_id"),
            C.blank_to_null(F.col("rattrs")[a.developer_email]).alias("developer_email")]


def parse_traces(lines: DataFrame, cfg: EngineConfig) -> Parsed:
    """Trace lines → ``raw_spans`` rows (+ ``_seq`` order key)."""
    a = cfg.attributes
    spans = _items(lines, TRACE_LEVELS, SPAN_FIELDS)
    sp = _field
    cost, tin, tout = (F.col("attrs")[k] for k in (a.cost_usd, a.input_tokens, a.output_tokens))
    start, end = C.nanos_to_timestamp(sp("startTimeUnixNano")), C.nanos_to_timestamp(sp("endTimeUnixNano"))
    checks = [
        ("bad_time", C.nanos_is_bad(sp("startTimeUnixNano")) | C.nanos_is_bad(sp("endTimeUnixNano"))),
        ("missing_time", start.isNull() | end.isNull()),
        ("missing_span_id", C.blank_to_null(sp("spanId")).isNull()),
        ("missing_trace_id", sp("traceId").isNull()),
        ("missing_name", sp("name").isNull()),
        ("bad_cost", C.number_is_bad(cost, "decimal(12,6)")),
        ("bad_tokens", C.number_is_bad(tin, "bigint") | C.number_is_bad(tout, "bigint")),
    ]
    rest = _resource_columns(cfg)
    rows = spans.select(
        sp("spanId").alias("span_id"),
        C.blank_to_null(sp("parentSpanId")).alias("parent_span_id"),
        sp("traceId").alias("trace_id"),
        rest[0], rest[1], rest[2], rest[3],
        sp("name").alias("span_name"),
        C.span_kind(sp("name")).alias("span_kind"),
        C.blank_to_null(F.col("attrs")[a.tool_name]).alias("tool_name"),
        start.alias("start_ts"),
        end.alias("end_ts"),
        (C.duration_micros(start, end).cast("decimal(20,0)") * F.lit(Decimal("0.001"))).cast("decimal(38,3)").alias("duration_ms"),
        C.number_or_zero(cost, "decimal(12,6)").alias("cost_usd"),
        C.number_or_zero(tin, "bigint").alias("input_tokens"),
        C.number_or_zero(tout, "bigint").alias("output_tokens"),
        F.col("raw").alias("raw_payload"),
        F.struct("seq", "ri", "si", "pi").alias("_seq"),
        *_line_reason(checks),
        *_who(cfg),
    )
    return split(rows, "traces")


def parse_logs(lines: DataFrame, cfg: EngineConfig) -> Parsed:
    """Log lines → ``raw_events`` rows (+ ``_seq`` order key)."""
    a = cfg.attributes
    recs = _items(lines, LOG_LEVELS, LOG_FIELDS)
    cost, tin, tout = (F.col("attrs")[k] for k in (a.cost_usd, a.input_tokens, a.output_tokens))
    ts = C.nanos_to_timestamp(_field("timeUnixNano"))
    checks = [
        ("bad_time", C.nanos_is_bad(_field("timeUnixNano"))),
        ("missing_time", ts.isNull()),
        ("bad_cost", C.number_is_bad(cost, "decimal(12,6)")),
        ("bad_tokens", C.number_is_bad(tin, "bigint") | C.number_is_bad(tout, "bigint")),
    ]
    order = F.struct("seq", "ri", "si", "pi")
    rows = recs.select(
        C.surrogate_id(order).alias("event_id"),
        *_resource_columns(cfg),
        C.first_present(F.col("attrs")[a.event_name], _field("body.stringValue"), F.lit("unknown")).alias("event_name"),
        ts.alias("ts"),
        C.blank_to_null(F.col("attrs")[a.tool_name]).alias("tool_name"),
        C.full_command(F.col("attrs")[a.tool_parameters]).alias("full_command"),
        C.blank_to_null(F.col("attrs")[a.decision]).alias("decision"),
        C.truthy_flag(F.col("attrs")[a.success]).alias("success"),
        C.number_or_zero(cost, "decimal(12,6)").alias("cost_usd"),
        C.number_or_zero(tin, "bigint").alias("input_tokens"),
        C.number_or_zero(tout, "bigint").alias("output_tokens"),
        F.col("raw").alias("raw_payload"),
        order.alias("_seq"),
        *_line_reason(checks),
        *_who(cfg),
    )
    return split(rows, "logs")
