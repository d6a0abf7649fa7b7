"""Identity stays in the developer registry; signals carry no raw text."""

from pyspark.sql import functions as F

from costlens.operators import privacy, signals
from costlens.plans import registry
from costlens.sources import fixtures as fx
from tests.conftest import SF_SMALL


def has_email(df):
    cond = F.lit(False)
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            cond = cond | F.coalesce(F.col(f.name).contains("@"), F.lit(False))
    return df.filter(cond).count() > 0


def test_analytic_frames_hold_no_email(spark):
    q = registry.queries()
    for name in ["s3_commit_records", "k3_commit_upsert", "c11_pseudonymise", "s4_prompt_signals", "j9_commits_by_ticket"]:
        assert not has_email(q[name](spark, SF_SMALL)), name
    assert has_email(q["k4_register_developers"](spark, SF_SMALL))


def test_pseudonymise_splits_identity(spark):
    safe, ids = privacy.pseudonymise(fx.commit_log(spark, SF_SMALL), "author_email", "s")
    assert "author_email" not in safe.columns and not has_email(safe)
    assert ids.filter(F.col("git_email").isNull()).count() == 0


def test_signals_drop_text(spark):
    p = signals.prompt_signals(fx.prompt_payloads(spark, SF_SMALL))
    t = signals.tool_signals(fx.command_payloads(spark, SF_SMALL))
    assert "prompt" not in p.columns and "command" not in t.columns
    assert set(p.columns) == {"session_id", "issue_key", "developer_email", "intent", "mentions_tests", "prompt_length", "ts"}
