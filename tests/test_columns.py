"""Column functions against literal edge cases."""

import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from costlens import schemas
from costlens.functions import columns as C


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_attr_map_slots_duplicates_and_nulls(spark):
    kv = lambda k, **v: {"key": k, "value": {s: v.get(s) for s in ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue")}}
    rows = [
        ([kv("a", stringValue="x"), kv("a", intValue="7")],),  # later duplicate wins
        ([kv("n", intValue="42"), kv("b", boolValue="true"), kv("e", stringValue="")],),
        ([kv("d", doubleValue="0.5"), {"key": None, "value": None}],),
        (None,),
    ]
    schema = f"attrs {schemas.ATTRIBUTES.simpleString()}"
    out = one(spark, C.attr_map(F.col("attrs")), rows, schema)
    assert out[0] == {"a": "7"}
    assert out[1] == {"n": "42", "b": "true", "e": ""}
    assert out[2] == {"d": "0.5"}
    assert out[3] is None


def test_nanos(spark):
    rows = [("1704067200123456789",), ("0",), (None,), ("",), ("12x",), ("999999",)]
    out = one(spark, C.nanos_to_timestamp(F.col("n")).cast("string"), rows, "n string")
    assert out[0] == "2024-01-01 00:00:00.123"
    assert out[1:4] == [None, None, None]
    assert out[4] is None
    assert out[5] == "1970-01-01 00:00:00"
    bad = one(spark, C.nanos_is_bad(F.col("n")), rows, "n string")
    assert bad == [False, False, False, False, True, False]


def test_full_command(spark):
    rows = [('{"full_command": "pytest -q"}',), ('{"full_command": "", "bash_command": "ls"}',), ("not json",), (None,),
            ('{"other": 1}',)]
    assert one(spark, C.full_command(F.col("p")), rows, "p string") == ["pytest -q", "ls", None, None, None]


def test_pseudonym_matches_sha256(spark):
    rows = [("dev@x.io",), ("",), (None,), ("UNATTRIBUTED",)]
    out = one(spark, C.pseudonym(F.col("r"), "s"), rows, "r string")
    assert out[0] == hashlib.sha256(b"s:dev@x.io").hexdigest()[:16]
    assert out[1:] == ["UNATTRIBUTED"] * 3


def test_span_kind_order(spark):
    rows = [("claude_code.interaction",), ("Tool_Execution",), ("llm_request",), ("API_REQUEST x",), ("other",),
            (None,), ("interaction tool",)]
    out = one(spark, C.span_kind(F.col("n")), rows, "n string")
    assert out == ["interaction", "tool", "llm_request", "llm_request", "other", "other", "interaction"]


def test_flags_and_numbers(spark):
    rows = [("true",), ("TRUE",), (None,), ("1",)]
    assert one(spark, C.truthy_flag(F.col("x")), rows, "x string") == [True, False, False, False]
    rows = [("1.5",), ("",), (None,), ("abc",), ("0.1234567",)]
    out = one(spark, C.number_or_zero(F.col("x"), "decimal(12,6)"), rows, "x string")
    assert out == [Decimal("1.5"), Decimal(0), Decimal(0), None, Decimal("0.123457")]
    assert one(spark, C.number_is_bad(F.col("x"), "bigint"), rows, "x string") == [True, False, False, True, True]


def test_exact_rounding_half_away_from_zero(spark):
    rows = [(5,), (15,), (-5,), (4,), (0,)]
    out = one(spark, C.round_ratio(F.col("n"), 10, 0), rows, "n long")
    assert out == [Decimal(1), Decimal(2), Decimal(-1), Decimal(0), Decimal(0)]
    out = one(spark, C.round_ratio(F.col("n"), 3_600_000_000, 3), [(1_800_000,), (1_799_999,)], "n long")
    assert out == [Decimal("0.001"), Decimal("0.000")]


def test_intent_rules_ascii_boundaries(spark):
    rows = [("please fix the failing test",), ("éfix this",), ("add tests",), ("clean up module",),
            ("implement it",), ("hello",), ("bugs everywhere",), ("crashing now",), ("prefix",)]
    out = one(spark, C.prompt_intent(F.col("p")), rows, "p string")
    # JS word boundaries are ASCII: "é" is not a word character, so "éfix" matches;
    # rules are ordered, so "add tests" is a test prompt.
    assert out == ["bug_fix", "bug_fix", "test", "refactor", "feature", "other", "other", "bug_fix", "other"]
    mt = one(spark, C.mentions_tests(F.col("p")), [("coverage please",), ("spec it",), ("testing_x",)], "p string")
    assert mt == [False, True, False]


def test_utf16_length_counts_astral_twice(spark):
    out = one(spark, C.utf16_length(F.col("p")), [("a😀b",), ("héllo",), ("",)], "p string")
    assert out == [4, 5, 0]


def test_command_category(spark):
    rows = [("pytest -q",), ("NPM TEST",), ("make",), ("makefile edit",), ("git status",), ("  git commit",),
            ("mvn package",), ("ls",), ("cd x && git push",)]
    out = one(spark, C.command_category(F.col("c")), rows, "c string")
    assert out == ["test", "test", "build", "other", "git", "git", "build", "other", "other"]


def test_test_run_and_commit_patterns(spark):
    rows = [("PYTEST tests/",), ("npm run test:unit",), ("echo jest",), ("ls",), (None,)]
    assert one(spark, C.is_test_run(F.col("c")), rows, "c string") == [True, True, True, False, False]
    rows = [("git commit -m x",), ("  GIT   COMMIT",), ("echo git commit",), ("x\ngit commit",)]
    assert one(spark, C.is_commit_command(F.col("c")), rows, "c string") == [True, True, False, False]


def test_trailers_and_shortstat(spark):
    from costlens.functions import rules

    body = "subject\n\nSession-Id: s12\nJira-Issue: PROJ-3"
    rows = [(body,), ("plain",), (None,)]
    assert one(spark, C.trailer(F.col("b"), rules.SESSION_TRAILER_PATTERN), rows, "b string") == ["s12", None, None]
    assert one(spark, C.trailer(F.col("b"), rules.ISSUE_TRAILER_PATTERN), rows, "b string") == ["PROJ-3", None, None]
    stat = [(" 3 files changed, 10 insertions(+), 2 deletions(-)",), (" 1 file changed, 1 deletion(-)",), (None,)]
    assert one(spark, C.shortstat_part(F.col("s"), rules.SHORTSTAT_FILES_PATTERN), stat, "s string") == [3, 1, 0]
    assert one(spark, C.shortstat_part(F.col("s"), rules.SHORTSTAT_INSERTIONS_PATTERN), stat, "s string") == [10, 0, 0]
    assert one(spark, C.shortstat_part(F.col("s"), rules.SHORTSTAT_DELETIONS_PATTERN), stat, "s string") == [2, 1, 0]


def test_issue_key_from_branch_and_label(spark):
    rows = [("feature/PROJ-101-login",), ("main",), ("fix/abc-1",), (None,)]
    assert one(spark, C.issue_key_from_branch(F.col("b")), rows, "b string") == ["PROJ-101", None, None, None]
    rows = [("PROJ-1", "short"), ("PROJ-2", None), ("PROJ-3", "x" * 60)]
    out = one(spark, C.ticket_label(F.col("k"), F.col("s")), rows, "k string, s string")
    assert out[0] == "PROJ-1: short" and out[1] == "PROJ-2: (no summary)"
    assert len(out[2]) == 50 and out[2].endswith("…")


def test_a_json_line_is_written_once(spark):
    """Filters on a line do not have it made again."""
    from costlens.operators import signals

    lines = signals.as_json_lines(spark.range(3).selectExpr("concat('c', id) as sha", "id as seq"), "seq")
    kept = lines.filter(F.col("value").isNotNull() & ~F.col("value").rlike("^ *$"))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator(") == 1
    assert [tuple(r) for r in kept.orderBy("seq").collect()] == [('{"sha":"c0"}', 0), ('{"sha":"c1"}', 1), ('{"sha":"c2"}', 2)]
