"""Scalar building blocks as Column expressions (JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costlens.config import UNATTRIBUTED
from costlens.functions import rules

MICROS = 1_000_000


def blank_to_null(c: Column) -> Column:
    """``x || null``: an empty string counts as missing."""
    return F.nullif(c, F.lit(""))


def first_present(*cols: Column) -> Column:
    """First argument that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def attr_map(attrs: Column) -> Column:
    """OTLP ``[{key, value:{stringValue|intValue|doubleValue|boolValue|arrayValue}}]``
    to ``map<string,string>``. The first present slot is the value; a repeated
    key keeps the later entry (needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``)."""
    entries = F.transform(
        F.filter(attrs, lambda kv: kv["key"].isNotNull()),
        lambda kv: F.struct(
            kv["key"].alias("key"),
            F.coalesce(
                kv["value"]["stringValue"],
                kv["value"]["intValue"],
                kv["value"]["doubleValue"],
                kv["value"]["boolValue"],
                kv["value"]["arrayValue"],
            ).alias("value"),
        ),
    )
    return F.map_from_entries(entries)


def surrogate_id(place: Column) -> Column:
    """A row's id from a struct that says where it stands: 32 hex digits, the
    same on every read."""
    return F.substring(F.sha2(F.to_json(place), 256), 1, 32)


def nanos_to_timestamp(nanos: Column) -> Column:
    """Integer nanoseconds (as text) to a millisecond timestamp; missing,
    zero or non-integer input gives null."""
    n = nanos.try_cast("bigint")
    ms = int_div(n, 1_000_000)
    return F.when(n.isNull() | (n == 0), F.lit(None)).otherwise(F.timestamp_millis(ms))


def int_div(c: Column, d: int) -> Column:
    """Integral division truncating toward zero, exact for any bigint
    (``/`` would go through double)."""
    return F.call_function("div", c, F.lit(d).cast("bigint"))


def nanos_is_bad(nanos: Column) -> Column:
    """True when a nanosecond field is present but not an integer."""
    return blank_to_null(nanos).isNotNull() & nanos.try_cast("bigint").isNull()


def full_command(tool_parameters: Column) -> Column:
    """``full_command`` else ``bash_command`` from a JSON-encoded parameter
    string; unparsable or missing gives null."""
    return first_present(
        F.get_json_object(tool_parameters, "$.full_command"),
        F.get_json_object(tool_parameters, "$.bash_command"),
    )


def pseudonym(raw_id: Column, salt: str) -> Column:
    """Developer pseudonym: first 16 hex digits of sha256(``salt:raw``);
    missing or ``UNATTRIBUTED`` stays ``UNATTRIBUTED``."""
    missing = raw_id.isNull() | (raw_id == "") | (raw_id == UNATTRIBUTED)
    hashed = F.substring(F.sha2(F.concat(F.lit(salt + ":"), raw_id), 256), 1, 16)
    return F.when(missing, F.lit(UNATTRIBUTED)).otherwise(hashed)


def or_unattributed(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(UNATTRIBUTED))


def span_kind(name: Column) -> Column:
    """interaction / tool / llm_request / other by case-insensitive substring, in order."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(n.contains("interaction"), "interaction")
        .when(n.contains("tool"), "tool")
        .when(n.contains("llm_request") | n.contains("api_request"), "llm_request")
        .otherwise("other")
    )


def truthy_flag(c: Column) -> Column:
    """True only for boolean true / the text 'true'; anything else is false."""
    return F.coalesce(c == F.lit("true"), F.lit(False))


def number_or_zero(raw: Column, sql_type: str) -> Column:
    """Missing or empty gives 0; otherwise a checked cast (null when uncastable,
    which the caller routes to quarantine)."""
    return F.when(blank_to_null(raw).isNull(), F.lit(0).cast(sql_type)).otherwise(raw.try_cast(sql_type))


def number_is_bad(raw: Column, sql_type: str) -> Column:
    return blank_to_null(raw).isNotNull() & raw.try_cast(sql_type).isNull()


def duration_micros(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def micros_to_seconds(us: Column) -> Column:
    """Exact seconds with six decimals."""
    return (us.cast("decimal(38,0)") / F.lit(MICROS)).cast("decimal(38,6)")


def seconds_to_micros(sec: Column) -> Column:
    return (sec * F.lit(MICROS)).cast("decimal(38,0)")


def round_ratio(num: Column, den: int, scale: int) -> Column:
    """``round(num / den, scale)`` half away from zero, computed exactly in
    integer arithmetic (``num`` integral, ``den`` > 0); decimal(38, scale)."""
    return _round_frac(num.cast("decimal(38,0)"), F.lit(den).cast("decimal(38,0)"), scale)


def day(ts: Column) -> Column:
    """``date_trunc('day', ts)`` in UTC."""
    return F.date_trunc("day", ts)


def clamp_gap(gap_us: Column, ceiling_us: int) -> Column:
    return F.least(gap_us, F.lit(ceiling_us).cast("bigint"))


def pct(part: Column, whole: Column, scale: int = 1) -> Column:
    """``round(100.0 * part / nullif(whole, 0), scale)`` exactly."""
    return F.when(whole == 0, F.lit(None)).otherwise(
        _round_frac(part.cast("decimal(38,0)") * F.lit(100), whole.cast("decimal(38,0)"), scale)
    )


def _round_frac(num: Column, den: Column, scale: int) -> Column:
    """round(num/den, scale) half away from zero for integral num and positive
    integral den columns; exact, decimal(38, scale)."""
    factor = 10**scale
    top = (F.abs(num) * F.lit(2 * factor) + den).cast("decimal(38,0)")
    bottom = (den * F.lit(2)).cast("decimal(38,0)")
    q = ((top - (top % bottom)) / bottom).cast("decimal(38,0)")
    signed = F.when(num < 0, -q).otherwise(q)
    return (signed / F.lit(factor)).cast(f"decimal(38,{scale})")


def ratio_at_least_one(num: Column, den: Column, scale: int = 2) -> Column:
    """``round(num / greatest(den, 1), scale)`` exactly."""
    return _round_frac(num.cast("decimal(38,0)"), F.greatest(den, F.lit(1)).cast("decimal(38,0)"), scale)


# ---- text classifiers ---------------------------------------------------

def prompt_intent(prompt: Column) -> Column:
    expr = None
    for name, pattern in rules.INTENT_PATTERNS:
        cond = prompt.rlike(pattern)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(rules.INTENT_FALLBACK))


def mentions_tests(prompt: Column) -> Column:
    return prompt.rlike(rules.MENTIONS_TESTS_PATTERN)


def utf16_length(text: Column) -> Column:
    """String length in UTF-16 code units (astral characters count twice)."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)).cast("int")


def command_category(command: Column) -> Column:
    expr = None
    for name, pattern in rules.COMMAND_PATTERNS:
        cond = command.rlike(pattern)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(rules.COMMAND_FALLBACK))


def is_test_run(command: Column) -> Column:
    return F.coalesce(command.rlike(rules.TEST_RUN_PATTERN), F.lit(False))


def is_commit_command(command: Column) -> Column:
    return F.coalesce(command.rlike(rules.COMMIT_PATTERN), F.lit(False))


def issue_key_from_branch(branch: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.coalesce(branch, F.lit("")), rules.ISSUE_KEY_PATTERN, 1))


def trailer(body: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(F.coalesce(body, F.lit("")), pattern, 1))


def shortstat_part(stat: Column, pattern: str) -> Column:
    found = blank_to_null(F.regexp_extract(F.coalesce(stat, F.lit("")), pattern, 1))
    return F.coalesce(found.try_cast("int"), F.lit(0))


def ticket_label(issue_key: Column, summary: Column) -> Column:
    label = F.concat(issue_key, F.lit(": "), F.coalesce(summary, F.lit(rules.NO_SUMMARY)))
    return F.when(
        F.length(label) > rules.LABEL_MAX,
        F.concat(F.substring(label, 1, rules.LABEL_KEEP), F.lit(rules.LABEL_ELLIPSIS)),
    ).otherwise(label)
