"""The versioned statement inventory: dedup, comparison of scans, upserts, clean-up.

An inventory row is ``id, project_id, sql_hash, sql_text, source_file, source_location, status,
first_scan_id, last_scan_id`` and any further columns (owner, normalised text, types, update time);
``status`` 1 is active, 0 retired. Nothing is changed in place: each operator returns the next snapshot. Further
columns are kept; those that a scan has, too, are refreshed where the scan knows a value.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querywarden.functions import text as tx
from querywarden.operators.lookups import salted_lookup
from querywarden.operators.ranking import number_by_hash, pick_first, pick_last, top_n

KEY = ["project_id", "sql_hash"]

# The order in which source kinds are scanned.
SCAN_ORDER = {"MAPPER_XML": 0, "ANNOTATION": 1, "QUERY_WRAPPER": 2, "LAMBDA_WRAPPER": 2}


def scan_order(source_type: Column) -> Column:
    """Position of a source kind in a scan."""
    order = F.lit(max(SCAN_ORDER.values()) + 1)
    for kind, pos in SCAN_ORDER.items():
        order = F.when(source_type == kind, pos).otherwise(order)
    return order


def statement_union(*kinds: DataFrame) -> DataFrame:
    """All statement tables as one."""
    first, *others = kinds
    for other in others:
        first = first.unionByName(other)
    return first


def count_by_source(statements: DataFrame) -> DataFrame:
    """Statements per kind; both wrapper kinds count together."""
    kind = F.when(F.col("source_type").isin("QUERY_WRAPPER", "LAMBDA_WRAPPER"), "WRAPPER").otherwise(
        F.col("source_type")
    )
    return statements.groupBy(kind.alias("source_kind")).agg(F.count("*").alias("statements"))


def with_fingerprint(statements: DataFrame) -> DataFrame:
    """Adds ``sql_normalized`` and ``sql_hash``."""
    return statements.withColumn("sql_normalized", tx.normalize_sql(F.col("sql_text"))).withColumn(
        "sql_hash", tx.fingerprint(F.col("sql_normalized"))
    )


def first_occurrence(statements: DataFrame) -> DataFrame:
    """First statement of each (project, hash) in scan order; blank statements are dropped.

    Blank is tested on the raw text: a test on the hash would be pushed below it and hash every row twice.
    """
    ranked = statements.filter(~tx.is_blank(F.col("sql_text"))).withColumn("scan_ord", scan_order(F.col("source_type")))
    order = ["scan_ord", "source_file", "source_location", "stmt_id"]
    return pick_first(ranked, KEY, order).drop("scan_ord")


def statement_delta(current: DataFrame, existing: DataFrame) -> DataFrame:
    """(project, hash) with ``delta`` new, unchanged or removed."""
    now = current.select(*KEY, F.lit(True).alias("_now")).distinct()
    before = existing.select(*KEY, F.lit(True).alias("_before")).distinct()
    delta = (
        F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "removed").otherwise("unchanged")
    )
    return now.join(before, KEY, "full_outer").select(*KEY, delta.alias("delta"))


def _max_id(inventory: DataFrame) -> Column:
    return F.coalesce(inventory.agg(F.max("id")).scalar(), F.lit(0))


BASIC = ["id", *KEY, "sql_text", "source_file", "source_location", "status", "first_scan_id", "last_scan_id", "change"]


def _further(inventory: DataFrame) -> list[str]:
    return [c for c in inventory.columns if c not in BASIC]


def _scanned(scan: DataFrame, inventory: DataFrame) -> list[Column]:
    """The scan's values for further columns, under names of their own."""
    return [F.col(c).alias(f"_new_{c}") for c in _further(inventory) if c in scan.columns]


def _refreshed(scan: DataFrame, inventory: DataFrame, when: Column) -> list[Column]:
    return [
        F.when(when, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c) if c in scan.columns else F.col(c) for c in _further(inventory)
    ]


def _as_new(rows: DataFrame, inventory: DataFrame, scan_id: int) -> DataFrame:
    kinds = dict(inventory.dtypes)
    numbered = number_by_hash(rows, "sql_hash", ["project_id"], _max_id(inventory), "id")
    return numbered.select(
        "id", *KEY, "sql_text", "source_file", "source_location",
        F.lit(1).alias("status"),
        F.lit(scan_id).cast("long").alias("first_scan_id"),
        F.lit(scan_id).cast("long").alias("last_scan_id"),
        F.lit("new").alias("change"),
        *[(F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c])).alias(c) for c in _further(inventory)],
    )


def full_scan_upsert(
    inventory: DataFrame, scan: DataFrame, scan_id: int, projects: DataFrame | None = None
) -> DataFrame:
    """Next inventory after a full scan, with ``change`` new, refreshed, retired or kept.

    ``scan`` holds one row per (project, hash). A known hash takes the scanned file and location; an
    active record that was not scanned is retired; a retired one that reappears becomes a new record.
    ``projects`` limits the scan to some projects; the default is all of them.
    """
    active = inventory.filter("status = 1")
    passive = inventory.filter("status = 0").withColumn("change", F.lit("kept"))
    if projects is not None:
        ids = projects.select("project_id").distinct()
        others = active.join(ids, "project_id", "left_anti").withColumn("change", F.lit("kept"))
        passive = passive.unionByName(others)
        active = active.join(ids, "project_id", "left_semi")
    seen = scan.select(
        *KEY, F.col("source_file").alias("_file"), F.col("source_location").alias("_loc"), F.lit(True).alias("_seen"), *_scanned(scan, inventory)
    )
    known = active.join(seen, KEY, "left").select(
        "id", *KEY, "sql_text",
        F.coalesce("_file", "source_file").alias("source_file"),
        F.coalesce("_loc", "source_location").alias("source_location"),
        F.when(F.col("_seen"), 1).otherwise(0).alias("status"),
        "first_scan_id",
        F.when(F.col("_seen"), F.lit(scan_id).cast("long")).otherwise(F.col("last_scan_id")).alias("last_scan_id"),
        F.when(F.col("_seen"), "refreshed").otherwise("retired").alias("change"),
        *_refreshed(scan, inventory, F.col("_seen")),
    )
    fresh = _as_new(scan.join(active, KEY, "left_anti"), inventory, scan_id)
    return known.unionByName(fresh).unionByName(passive.select(known.columns))


def incremental_scan_upsert(inventory: DataFrame, scan: DataFrame, changes: DataFrame, scan_id: int) -> DataFrame:
    """Next inventory after a scan of the changed files only.

    ``changes`` is (project_id, source_file, change_type). Records of deleted files are retired first,
    then records of changed files whose hash is gone. A scanned hash that is still active anywhere in
    the project is only refreshed, any other one is inserted. The outcome does not depend on file order.
    """
    active = inventory.filter("status = 1")
    passive = inventory.filter("status = 0").withColumn("change", F.lit("kept"))
    marks = changes.groupBy("project_id", "source_file").agg(
        F.max(F.col("change_type") == "DELETE").alias("_deleted")
    )
    seen = scan.select(*KEY, F.lit(True).alias("_seen"), *_scanned(scan, inventory))
    judged = (
        salted_lookup(active, marks, ["project_id", "source_file"], "id")
        .join(seen, KEY, "left")
        .withColumn(
            "change",
            F.when(F.col("_deleted"), "retired")
            .when(F.col("_deleted").isNotNull() & F.col("_seen").isNull(), "retired")
            .when(F.col("_seen"), "refreshed")
            .otherwise("kept"),
        )
    )
    known = judged.select(
        "id", *KEY, "sql_text", "source_file", "source_location",
        F.when(F.col("change") == "retired", 0).otherwise(1).alias("status"),
        "first_scan_id",
        F.when(F.col("change") == "refreshed", F.lit(scan_id).cast("long"))
        .otherwise(F.col("last_scan_id")).alias("last_scan_id"),
        "change",
        *_refreshed(scan, inventory, F.col("change") == "refreshed"),
    )
    survivors = known.filter("status = 1").select(*KEY)
    fresh = _as_new(scan.join(survivors, KEY, "left_anti"), inventory, scan_id)
    return known.unionByName(fresh).unionByName(passive.select(known.columns))


def retire_by_deleted_file(records: DataFrame, deleted: DataFrame) -> DataFrame:
    """Active records of deleted files (project_id, source_file) get status 0; ``retired_now`` says which."""
    gone = deleted.select("project_id", "source_file", F.lit(True).alias("_gone")).distinct()
    hit = F.coalesce(F.col("_gone") & (F.col("status") == 1), F.lit(False))
    return (
        salted_lookup(records, gone, ["project_id", "source_file"], "id")
        .withColumn("retired_now", hit)
        .withColumn("status", F.when(F.col("retired_now"), 0).otherwise(F.col("status")))
        .drop("_gone")
    )


def retire_unknown(records: DataFrame) -> DataFrame:
    """Active records whose text has an unresolved table get status 0."""
    hit = (F.col("status") == 1) & F.coalesce(F.contains("sql_text", F.lit("_unknown")), F.lit(False))
    return records.withColumn("retired_now", hit).withColumn(
        "status", F.when(F.col("retired_now"), 0).otherwise(F.col("status"))
    )


def retire_duplicates(records: DataFrame) -> DataFrame:
    """Of the active records of one (project, hash) only the highest id stays active.

    The winners are found by a combined aggregate and joined back on the id, which is unique, so a
    statement with very many copies does not gather in one task.
    """
    keep = records.filter("status = 1").groupBy(*KEY).agg(F.max("id").alias("id")).select("id", F.lit(True).alias("_keep"))
    hit = (F.col("status") == 1) & F.col("_keep").isNull()
    return (
        records.join(keep, "id", "left")
        .withColumn("retired_now", hit)
        .withColumn("status", F.when(F.col("retired_now"), 0).otherwise(F.col("status")))
        .drop("_keep")
    )


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """Newest analysis of each record; the higher id wins a tie."""
    return pick_last(analyses, ["sql_record_id"], ["create_time", "id"])


def reuse_prior_analysis(records: DataFrame, analyses: DataFrame) -> DataFrame:
    """For each active record without analysis, the latest one of another active record with that hash.

    Of several such records, in any project, the lowest id with an analysis is taken.
    """
    active = records.filter("status = 1")
    latest = latest_analysis(analyses)
    done = latest.select(F.col("sql_record_id").alias("id"))
    priors = (
        active.join(done, "id", "left_semi").groupBy("sql_hash").agg(F.min("id").alias("prior_record_id"))
    )
    todo = active.join(done, "id", "left_anti").select(F.col("id").alias("record_id"), "sql_hash")
    best = latest.withColumnRenamed("sql_record_id", "prior_record_id").select(
        "prior_record_id", "final_risk_level", "ai_model"
    )
    known = priors.join(best, "prior_record_id")
    return salted_lookup(todo, known, ["sql_hash"], "record_id", "inner").select(
        F.col("record_id").alias("sql_record_id"),
        "prior_record_id",
        "final_risk_level",
        "ai_model",
        F.lit(0).cast("long").alias("ai_tokens_used"),
        F.lit("ANALYZED").alias("handle_status"),
        F.format_string("Reused from prior analysis (record #%d)", F.col("prior_record_id")).alias("handle_note"),
    )


def seen_within_ttl(rows: DataFrame, key: str, ts: str, ttl: timedelta = timedelta(hours=24)) -> DataFrame:
    """Adds ``reused``: whether the key already occurred less than ``ttl`` earlier.

    This counts any earlier occurrence, so a refresh prolongs the time; see ``expiry.assess_with_ttl``
    for expiry after writing. Time is cut into parts of an hour, or of ``ttl`` if that is shorter; only the first
    instant of a key in a part can look back beyond the part, so the ordered pass runs over one row per key
    and part, not over all rows. A null key is a key; a null time is never reused.
    """
    if ttl <= timedelta(0):
        raise ValueError("ttl must be positive")
    micros = min(ttl, timedelta(hours=1)) // timedelta(microseconds=1)
    since = F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    parted = rows.withColumn("_part", F.floor(since / micros))
    parts = parted.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_at")).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    order = Window.partitionBy("_key").orderBy("_at")
    parts = parts.withColumn("_before", F.lag("_last").over(order)).drop("_last")
    limit = F.col(ts) - F.lit(ttl)
    reused = F.coalesce((F.col(ts) > F.col("_first")) | (F.coalesce(F.col("_before") > limit, F.lit(False))), F.lit(False))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_part").eqNullSafe(F.col("_at"))
    return parted.join(parts, same).withColumn("reused", reused).drop("_part", "_key", "_at", "_first", "_before")


def analysis_budget(statements: DataFrame, n: int, batch: str = "project_id") -> DataFrame:
    """The first ``n`` statements of each batch in scan order; a negative ``n`` means no limit."""
    if n < 0:
        return statements
    order = [F.col("scan_ord"), F.col("source_file"), F.col("source_location"), F.col("stmt_id")]
    ranked = statements.withColumn("scan_ord", scan_order(F.col("source_type")))
    return top_n(ranked, [batch], order, n, "stmt_id", rank="budget_rank").drop("scan_ord")


def scan_batch_summary(upserted: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Counts per project of an upsert result; ``changed`` is always 0, a changed text is a new statement.

    With ``latest`` (see ``latest_analysis``) the active statements at risk are counted too.
    """
    rows = upserted
    if latest is not None:
        levels = latest.select(F.col("sql_record_id").alias("id"), "final_risk_level")
        rows = rows.join(levels, "id", "left")
    else:
        rows = rows.withColumn("final_risk_level", F.lit(None).cast("string"))
    scanned = F.col("change").isin("new", "refreshed")
    return rows.groupBy("project_id").agg(
        F.count_if(scanned).alias("total_sql"),
        F.count_if(F.col("change") == "new").alias("new_sql"),
        F.lit(0).cast("long").alias("changed_sql"),
        F.count_if(F.col("change") == "retired").alias("removed_sql"),
        F.count_if(scanned & tx.high_risk(F.col("final_risk_level"))).alias("risk_sql"),
    )


def scan_mode(projects: DataFrame, forced: Column) -> DataFrame:
    """FULL when forced or without a previous or current commit, else INCREMENTAL."""
    full = forced | F.col("last_scan_commit").isNull() | F.col("head_commit").isNull()
    return projects.withColumn("scan_type", F.when(full, "FULL").otherwise("INCREMENTAL"))


def first_last_seen(history: DataFrame) -> DataFrame:
    """First and last scan of each (project, hash)."""
    return history.groupBy(*KEY).agg(
        F.min("scan_id").alias("first_scan_id"), F.max("scan_id").alias("last_scan_id")
    )


def upsert_by_key(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming values replace existing ones; ``outcome`` is created, updated or kept."""
    values = [c for c in existing.columns if c != key]
    left = existing.select(key, F.struct(*values).alias("_old"))
    right = incoming.select(key, F.struct(*values).alias("_new"))
    outcome = (
        F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").otherwise("updated")
    )
    picked = F.coalesce("_new", "_old")
    return left.join(right, key, "full_outer").select(
        key, *[picked.getField(v).alias(v) for v in values], outcome.alias("outcome")
    )
