"""Identity separation: analytic frames carry pseudonyms only; the real
identity leaves in a separate frame that only the registry table stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import columns as C


def pseudonymise(df: DataFrame, identity_col: str, salt: str, email_col: str | None = None):
    """C11: replace ``identity_col`` by ``developer_id`` (salted hash).
    Returns (pseudonymised frame, identity frame (developer_id, git_email,
    display_name)) — the first contains no identity column at all."""
    raw = C.or_unattributed(F.col(identity_col))
    email = F.col(email_col) if email_col else F.when(F.col(identity_col).contains("@"), F.col(identity_col))
    drop = [identity_col] + ([email_col] if email_col else [])
    safe = df.withColumn("developer_id", C.pseudonym(raw, salt)).drop(*drop)
    ids = df.select(
        C.pseudonym(raw, salt).alias("developer_id"),
        C.blank_to_null(email).alias("git_email"),
        F.when(C.blank_to_null(email).isNull(), raw).alias("display_name"),
    ).filter(F.col("developer_id") != "UNATTRIBUTED")
    # One row per developer, the same one on every run: a known address first.
    first = F.min(F.struct(F.col("git_email").isNull().alias("unknown"), "git_email", "display_name"))
    ids = ids.groupBy("developer_id").agg(first.alias("i")).select("developer_id", "i.git_email", "i.display_name")
    return safe, ids
