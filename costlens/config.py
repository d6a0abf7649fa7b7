"""Engine configuration and session settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

UNATTRIBUTED = "UNATTRIBUTED"


@dataclass(frozen=True)
class AttributeNames:
    """OTLP attribute keys. These drift between producer versions, so they
    are configuration rather than code."""

    issue_key: str = "jira.issue_key"
    session_id: str = "session.id"
    # Resource attribute stamped by a session wrapper; preferred over the
    # producer's own session.id because commit trailers carry the same id.
    wrapper_session_id: str = "wrapper.session_id"
    developer_id: str = "developer.id"
    developer_email: str = "developer.email"
    prompt_id: str = "prompt.id"
    tool_name: str = "tool_name"
    tool_parameters: str = "tool_parameters"
    event_name: str = "event.name"
    decision: str = "decision"
    success: str = "success"
    cost_usd: str = "cost_usd"
    input_tokens: str = "input_tokens"
    output_tokens: str = "output_tokens"


@dataclass(frozen=True)
class EngineConfig:
    """Parameters of one deployment.

    ``salt`` keys the developer pseudonym and has no default on purpose.
    ``ceiling_seconds`` caps a single developer think-time gap.
    ``gap_bucket_seconds`` is the time slice used to split a session's
    event sequence across tasks (see operators.rollup).
    """

    salt: str
    ceiling_seconds: int = 900
    gap_bucket_seconds: int = 60
    team: str = "default"
    story_points_field: str = "customfield_10016"
    attributes: AttributeNames = field(default_factory=AttributeNames)

    def __post_init__(self) -> None:
        if not self.salt:
            raise ValueError("salt is required")
        if 86400 % self.gap_bucket_seconds:
            raise ValueError("gap_bucket_seconds must divide a day (slices never span two days)")


# Runtime SQL settings the engine relies on. All are session-scoped.
SESSION_SETTINGS = {
    # Times are stored and bucketed by day in UTC.
    "spark.sql.session.timeZone": "UTC",
    # OTLP attribute lists may repeat a key; the later one wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # So does the later of two equal keys of a JSON object.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The JVM never compiles a method beyond this size: such a stage runs faster
    # operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# Settings of a deployment that has not set its own.
DEFAULT_SETTINGS = {
    # Staged lines are many times their size in a file: larger parts make a
    # parse wait for its last few tasks.
    "spark.sql.files.maxPartitionBytes": "16m",
}


def configure_session(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in DEFAULT_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``; ``fallback`` is used only where it is unset
    (tests on one machine)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set and no fallback was given")
    try:
        spark.conf.set("spark.checkpoint.dir", fallback)
    except Exception:  # some deployments reject setting core confs at run time
        pass
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback.rstrip("/")
