"""Prompts, parsed assessments, rule-based risk, and call statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywarden.functions import text as tx
from querywarden.operators.lookups import keep_if, salted_lookup
from querywarden.operators.metadata import resolve_sets
from querywarden.session import cut_lineage

ASSESSMENT = T.StructType(
    [
        T.StructField("riskLevel", T.StringType()),
        T.StructField("canUseIndex", T.BooleanType()),
        T.StructField("indexUsed", T.StringType()),
        T.StructField("estimatedScanRows", T.LongType()),
        T.StructField("estimatedExecTimeMs", T.IntegerType()),
        T.StructField("issues", T.ArrayType(T.StringType())),
        T.StructField("indexSuggestions", T.ArrayType(T.StringType())),
        T.StructField("rewriteSuggestions", T.ArrayType(T.StringType())),
        T.StructField("explanation", T.StringType()),
    ]
)

# Issue classes and the text pattern that shows each. The patterns are ours.
ISSUE_PATTERNS = {
    "leading_wildcard": r"like\s+('%|concat\s*\(\s*'%)",
    "function_on_column": r"(where|and|or)\s+[a-z_]+\s*\(\s*[a-z_]+(\.[a-z_]+)?\s*[,)]",
    "many_joins": r"\sjoin\s.*\sjoin\s.*\sjoin\s",
    "deep_paging": r"(limit\s+\d{5,}\s*,|offset\s+\d{5,})",
    "select_star": r"select\s+([a-z_]+\.)?\*",
}

# Grading thresholds on table rows and index selectivity. They are ours: no published rule exists.
HUGE_ROWS, LARGE_ROWS, SMALL_ROWS = 1_000_000, 20_000, 1_000
POOR_SELECTIVITY = 0.01

def prompt_assemble(statements: DataFrame, templates: DataFrame, key: str, default: str, apart: bool = False) -> DataFrame:
    """Statements with ``prompt``: the active template of ``key``, else the default, its ``%s`` filled.

    The slots are type, location, normalised text, table context and knowledge context, in this order; a mark
    beyond the fifth stays as it is written. ``apart``: ``prompt`` ends with the knowledge context and ``prompt_rest`` is
    what follows, null if the template has no mark for it; see ``prompt_digests``.
    """
    found = templates.filter((F.col("template_key") == key) & (F.col("status") == 1)).agg(F.max("content"))
    pieces = F.split(F.coalesce(found.scalar(), F.lit(default)), "%s", -1)
    values = [F.coalesce(c, F.lit("")) for c in ("sql_type", "source_location", "sql_normalized", "ddl_context", "knowledge_context")]
    named = statements.withColumn("_slots", F.array(*values)).withColumn("_pieces", pieces)

    def filled(parts: Column, first: int) -> Column:
        """The pieces from number ``first`` on, each behind what fills its mark."""
        return F.transform(
            parts, lambda piece, i: F.when(i + first == 0, piece).otherwise(F.concat(F.coalesce(F.get("_slots", i + first - 1), F.lit("%s")), piece))
        )

    if not apart:
        return named.withColumn("prompt", F.array_join(filled(F.col("_pieces"), 0), "")).drop("_slots", "_pieces")
    n = len(values)
    knows = F.size("_pieces") > n
    start = F.array_join(filled(F.slice("_pieces", 1, n), 0), "")
    rest = F.concat(F.get("_pieces", F.lit(n)), F.array_join(filled(F.slice("_pieces", n + 2, F.greatest(F.size("_pieces") - n - 1, F.lit(0))), n + 1), ""))
    return (
        named.withColumn("prompt", F.when(knows, F.concat(start, F.get("_slots", F.lit(n - 1)))).otherwise(start))
        .withColumn("prompt_rest", F.when(knows, rest))
        .drop("_slots", "_pieces")
    )


def prompt_digests(prompts: DataFrame, columns: list[str], out: str = "prompt_md5") -> DataFrame:
    """``_own, columns, out``: the MD5 of the whole prompt for each of ``asks`` (``knowledge.gathered``) of the prompts made ``apart``.

    A prompt is ``prompt``, then, where the template has a mark for it, ``near_lead`` and the ask's ``near`` if it has one, and
    ``prompt_rest``. Prompts of a row begin alike, so that beginning, which grows with the entries of the tables, is digested once.
    """
    given = prompts.select(*columns, "prompt", "prompt_rest", "near_lead", "asks")
    own = given.schema["asks"].dataType.elementType["_own"].dataType
    schema = T.StructType([T.StructField("_own", own), *[given.schema[c] for c in columns], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                start, rest, lead = (row.column(c).cast(pa.binary())[0].as_buffer() for c in ("prompt", "prompt_rest", "near_lead"))
                asks = row.column("asks").flatten()
                begun = hashlib.md5(start or b"", usedforsecurity=False)
                digests = []
                for near in asks.field("near").cast(pa.binary()):
                    whole = begun.copy()
                    if rest is not None:
                        if near.is_valid:
                            whole.update(lead)
                            whole.update(near.as_buffer())
                        whole.update(rest)
                    digests.append(whole.hexdigest())
                same = pa.array([0] * len(asks), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [asks.field("_own"), *[row.column(c).take(same) for c in columns], pa.array(digests, pa.string())], ["_own", *columns, out]
                )

    return given.mapInArrow(run, schema)


def strip_fences(response: Column) -> Column:
    """Response without Markdown code fences."""
    bare = F.regexp_replace(F.regexp_replace(response, r"```json\s*", ""), r"```\s*", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def assessment_parse(responses: DataFrame) -> DataFrame:
    """Adds ``assessment``; unknown fields are ignored, a malformed body gives null."""
    body = strip_fences(F.col("response"))
    parsed = F.from_json(body, ASSESSMENT)
    usable = body.rlike(r"^\{[\s\S]*\}$") & F.get_json_object(body, "$").isNotNull()
    return responses.withColumn("assessment", F.when(usable, parsed))


def assessment_to_analysis(parsed: DataFrame) -> DataFrame:
    """Analysis rows; suggestion lists become JSON text and the final level is the assessed one."""
    a = F.col("assessment")
    return keep_if(parsed, "assessment", a.isNotNull()).select(
        *[c for c in parsed.columns if c not in ("assessment", "response")],
        a["riskLevel"].alias("ai_risk_level"),
        a["explanation"].alias("ai_analysis"),
        F.to_json(a["indexSuggestions"]).alias("ai_index_suggestion"),
        F.to_json(a["rewriteSuggestions"]).alias("ai_rewrite_suggestion"),
        a["estimatedScanRows"].alias("ai_estimated_scan_rows"),
        a["estimatedExecTimeMs"].alias("ai_estimated_exec_time_ms"),
        a["riskLevel"].alias("final_risk_level"),
        F.lit("ANALYZED").alias("handle_status"),
    )


def rule_issues(statements: DataFrame) -> DataFrame:
    """Adds ``issues``, the classes a statement's text shows; needs ``sql_normalized`` and ``has_dynamic``."""
    low = F.lower("sql_normalized")
    no_where = low.rlike(r"^(select|update|delete)\s") & ~low.rlike(r"\swhere\s")
    flags = [F.when(no_where, "no_where"), F.when(no_where & F.col("has_dynamic"), "all_conditions_optional")]
    flags += [F.when(low.rlike(pattern), name) for name, pattern in ISSUE_PATTERNS.items()]
    return statements.withColumn("issues", F.array_compact(F.array(*flags)))


def with_table_facts(statements: DataFrame, meta: DataFrame, stats: DataFrame, id_col: str = "stmt_id") -> DataFrame:
    """Adds ``table_rows`` and ``best_selectivity``, the largest over the tables a statement names."""
    best = stats.groupBy("table_name").agg(F.max("selectivity").alias("_sel"))
    known = meta.select("table_name", "estimated_rows").join(best, "table_name", "left")
    facts = resolve_sets(statements, known).groupBy("table_refs").agg(
        F.max("estimated_rows").alias("table_rows"), F.max("_sel").alias("best_selectivity")
    )
    known_facts = salted_lookup(statements, facts, ["table_refs"], id_col)
    return known_facts.withColumn("table_rows", F.coalesce("table_rows", F.lit(0)))


def risk_level(issues: Column, rows: Column, selectivity: Column) -> Column:
    """P0..P4 from issues, table size and index selectivity."""

    def has(*names: str) -> Column:
        return F.arrays_overlap(issues, F.array(*[F.lit(n) for n in names]))

    scan = has("no_where", "leading_wildcard", "function_on_column")
    poor = (rows >= LARGE_ROWS) & (selectivity < POOR_SELECTIVITY)
    return (
        F.when(scan & (rows >= HUGE_ROWS), "P0")
        .when(scan & (rows >= LARGE_ROWS), "P1")
        .when((scan & (rows >= SMALL_ROWS)) | has("many_joins") | (has("deep_paging") & (rows >= SMALL_ROWS)), "P2")
        .when((F.size(issues) > 0) | F.coalesce(poor, F.lit(False)), "P3")
        .otherwise("P4")
    )


def rule_risk_level(statements: DataFrame) -> DataFrame:
    """Adds ``rule_risk_level``; needs ``issues, table_rows, best_selectivity``."""
    level = risk_level(F.col("issues"), F.col("table_rows"), F.col("best_selectivity"))
    return statements.withColumn("rule_risk_level", level)


Scorer = Callable[[pd.DataFrame], pd.Series]


def rule_scorer(batch: pd.DataFrame) -> pd.Series:
    """The deterministic scorer: the same grades as ``risk_level`` on a batch."""
    found = batch["issues"].map(set)
    has = lambda *names: found.map(lambda s: not s.isdisjoint(names))
    rows, sel = batch["table_rows"].fillna(0), batch["best_selectivity"]
    scan = has("no_where", "leading_wildcard", "function_on_column")
    conds = [
        scan & (rows >= HUGE_ROWS),
        scan & (rows >= LARGE_ROWS),
        (scan & (rows >= SMALL_ROWS)) | has("many_joins") | (has("deep_paging") & (rows >= SMALL_ROWS)),
        (found.map(len) > 0) | ((rows >= LARGE_ROWS) & (sel < POOR_SELECTIVITY)),
    ]
    return pd.Series(np.select(conds, ["P0", "P1", "P2", "P3"], default="P4"), index=batch.index)


def batch_score(statements: DataFrame, scorer: Scorer = rule_scorer, id_col: str = "stmt_id") -> DataFrame:
    """(id, risk_level) by a scorer that sees Arrow batches of a partition; no shuffle."""
    columns = [id_col, "issues", "table_rows", "best_selectivity"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({id_col: b[id_col], "risk_level": scorer(b)})

    return statements.select(*columns).mapInPandas(run, f"{id_col} long, risk_level string")


def response_quality(parsed: DataFrame) -> DataFrame:
    """Per model: usable and failed responses, empty explanations, list sizes and a verdict."""
    a = F.col("assessment")
    empty = a.isNotNull() & tx.is_blank(a["explanation"])
    count = lambda name: F.coalesce(F.sum(F.when(a[name].isNotNull(), F.size(a[name]))), F.lit(0))
    stats = parsed.groupBy("model").agg(
        F.count_if(a.isNotNull()).alias("ok"),
        F.count_if(a.isNull()).alias("failed"),
        F.count_if(empty).alias("empty_explanations"),
        count("issues").alias("issues"),
        count("indexSuggestions").alias("index_suggestions"),
        count("rewriteSuggestions").alias("rewrite_suggestions"),
    )
    verdict = F.when(F.col("empty_explanations") > 0, "WARNING").otherwise("OK")
    return stats.withColumn("verdict", verdict)


def call_log_summary(calls: DataFrame) -> DataFrame:
    """Per provider: calls, successes, failures, elapsed time and tokens.

    Input: ``provider, ok, elapsed_ms, prompt_tokens, completion_tokens``.
    """
    return calls.groupBy("provider").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("ok") == 1).alias("successes"),
        F.count_if(F.col("ok") == 0).alias("failures"),
        F.sum(F.col("elapsed_ms").cast("decimal(18,2)")).cast("double").alias("elapsed_ms"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        (F.sum("prompt_tokens") + F.sum("completion_tokens")).alias("total_tokens"),
    )


FAILURE_THRESHOLD = 3
COOLDOWN = timedelta(seconds=60)


def failure_streaks(
    calls: DataFrame, threshold: int = FAILURE_THRESHOLD, cooldown: timedelta = COOLDOWN
) -> DataFrame:
    """Calls with ``streak``, failures in a row up to and including the call, and ``cooling``.

    ``cooling`` says that before the call the provider had ``threshold`` failures in a row, the last one
    less than ``cooldown`` ago. Input: ``event_id, ts, provider, ok``; a success resets the streak.

    Calls are sorted into ranges of about equal numbers of rows, however they lie in time, so a provider with
    all its calls in one minute is spread over all ranges. A range hands on the number of a provider's failures
    after its last success, or all of them if it has none; only these summaries, one per provider and range, are
    ordered as a whole. Ranges are stored, so that a lost executor cannot cut them anew.
    """
    ranged = calls.repartitionByRange("provider", "ts", "event_id")
    log = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()), "calls")
    fail = F.col("ok") == 0
    inside = Window.partitionBy("provider", "_part").orderBy("ts", "event_id")
    run = log.withColumn("_resets", F.sum(F.col("ok")).over(inside))
    group = Window.partitionBy("provider", "_part", "_resets").orderBy("ts", "event_id")
    run = run.withColumn("_run", F.count_if(fail).over(group)).withColumn(
        "_prev_fail", F.max(F.when(fail, F.col("ts"))).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    run = run.withColumn("_prev_run", F.coalesce(F.lag("_run").over(inside), F.lit(0))).withColumn(
        "_prev_resets", F.coalesce(F.lag("_resets").over(inside), F.lit(0))
    )
    ends = run.groupBy("provider", "_part").agg(
        F.max("_resets").alias("_total_resets"),
        F.max(F.when(fail, F.col("ts"))).alias("_last_fail"),
        F.max_by("_run", F.struct("ts", "event_id")).alias("_tail"),
    )
    across = Window.partitionBy("provider").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("provider").orderBy("_part")
    # parts since the last one with a success, that one included, form one stretch of failures
    ends = ends.withColumn("_stretch", F.sum(F.when(F.col("_total_resets") > 0, 1).otherwise(0)).over(upto))
    stretch = Window.partitionBy("provider", "_stretch").orderBy("_part")
    ends = ends.withColumn("_sum", F.sum("_tail").over(stretch))
    carry = ends.select(
        "provider",
        "_part",
        F.coalesce(F.lag("_sum").over(upto), F.lit(0)).alias("_carry"),
        F.max("_last_fail").over(across).alias("_carry_fail"),
    )
    same = run["provider"].eqNullSafe(carry["provider"]) & (run["_part"] == carry["_part"])
    joined = run.join(carry, same).drop(carry["provider"], carry["_part"])
    streak = F.when(F.col("_resets") == 0, F.col("_run") + F.col("_carry")).otherwise(F.col("_run"))
    before = F.when(F.col("_prev_resets") == 0, F.col("_prev_run") + F.col("_carry")).otherwise(F.col("_prev_run"))
    last_fail = F.coalesce("_prev_fail", "_carry_fail")
    cooling = (before >= threshold) & (F.col("ts") - last_fail < F.lit(cooldown))
    return joined.select(
        *calls.columns, streak.alias("streak"), F.coalesce(cooling, F.lit(False)).alias("cooling")
    )
