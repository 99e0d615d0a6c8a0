"""Push events to the projects they concern; the same function serves tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.functions import text as tx

DEFAULT_BRANCH = "master"


def route_push_events(events: DataFrame, projects: DataFrame) -> DataFrame:
    """(event_id, project_id): active projects with the pushed remote and branch.

    Equal URLs in any case have equal keys, so the key alone decides. An event has at most two keys and a
    project one, hence an equi join without duplicates. Input: ``event_id, kind, ref, ssh_url, http_url``.
    """
    keys = F.array_distinct(F.array(tx.git_url_key(F.col("ssh_url")), tx.git_url_key(F.col("http_url"))))
    pushed = events.filter((F.col("kind") == "push") & F.col("ref").isNotNull() & F.col("ssh_url").isNotNull()).select(
        "event_id", F.explode(keys).alias("url_key"), F.replace("ref", F.lit("refs/heads/"), F.lit("")).alias("branch")
    )
    targets = projects.filter((F.col("status") == 1) & F.col("git_remote_url").isNotNull()).select(
        F.col("id").alias("project_id"),
        tx.git_url_key(F.col("git_remote_url")).alias("url_key"),
        F.coalesce("git_branch", F.lit(DEFAULT_BRANCH)).alias("branch"),
    )
    return pushed.filter("url_key <> ''").join(targets, ["url_key", "branch"]).select("event_id", "project_id")
