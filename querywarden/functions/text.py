"""Column functions on SQL text, source locations, URLs and timestamps.

All of them are built-in JVM expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "..."


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(text.rlike(r"\S"), F.lit(False))


def normalize_sql(text: Column) -> Column:
    """Bound and inlined parameters become ``?``, white space runs one space; blank gives ''."""
    unbound = F.regexp_replace(text, r"[#$]\{[^}]*\}", "?")
    return F.coalesce(F.trim(F.regexp_replace(unbound, r"\s+", " ")), F.lit(""))


def fingerprint(normalized: Column) -> Column:
    """SHA-256 of the trimmed lower-case text; blank gives ''."""
    return F.when(is_blank(normalized), "").otherwise(F.sha2(F.trim(F.lower(normalized)), 256))


# Literals and comments; a name in a table list, an alias or hint behind it (no word that goes on with the statement),
# and a join condition. HELD stands for a pair of brackets whose content is looked at by itself.
_HELD = "\u0001"
_SILENT = r"(?s)'(?:[^'\\]|\\.|'')*+'|--[^\n]*+|/\*.*?\*/"
_INNERMOST = r"\(([^()]*+)\)"
_JOINED = r"(?i)\b(from|join)\s*+((?:\(\s*+)*)\((?!\s*+(?:select|with|values|table)\b)([^()]*+)\)"
_NAME = rf"[^\s,;(){_HELD}]++"
_GOES_ON = (
    "where|on|using|set|values|value|select|join|left|right|inner|outer|cross|full|natural|straight_join|group|order|having|limit|offset|union|except"
    "|intersect|for|window|force|use|ignore|partition|returning|when"
)
_BEHIND = rf"(?:\s*+{_HELD})?+"
_ALIAS = rf"(?:\s++(?:as\s++)?(?!(?:{_GOES_ON})\b)[`\"A-Za-z_][\w`\"$]*+)?+"
_HINTS = rf"(?:\s++(?:(?:force|use|ignore)\s++(?:index|key)(?:\s++for\s++[a-z]++(?:\s++by)?+)?+|partition)\s*+{_HELD})*+"
_ITEM = rf"(?:lateral\s++)?+(?:{_HELD}|{_NAME}){_BEHIND}{_HINTS}{_ALIAS}{_BEHIND}{_HINTS}"
_ENDS = _GOES_ON.replace("on|", "", 1).replace("|when", r"|when\s+(?:not\s+)?matched")
_CONDITION = rf"\s*+(?:\busing\s*+{_HELD}|\bon\b(?:(?!\b(?:{_ENDS})\b(?!\s*+{_HELD}))[^,;()])*+)"
_LIST = rf"{_ITEM}(?:(?:{_CONDITION})?+\s*+,\s*+{_ITEM})*+"
_STATEMENT = rf"(?i)^[\s{_HELD}]*+(?:select|with|insert|update|delete|merge|replace|from)\b"


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _levels(text: Column) -> Column:
    """How deep brackets are nested in ``text``."""
    marks = F.filter(F.split(F.regexp_replace(text, "[^()]", ""), ""), lambda c: c != "")
    open_now = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(acc: Column, mark: Column) -> Column:
        now = F.greatest(acc["now"] + F.when(mark == "(", 1).otherwise(-1), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, open_now, count, lambda acc: acc["most"])


def _statements_in(text: Column) -> Column:
    """The statement without its brackets, and the sub-selects in them, each behind the one around it.

    Innermost brackets are taken out again and again, so any depth works. Brackets around joined tables are only
    opened; those that do not match stay as they are.
    """
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("inner"))

    def collapse(acc: Column, _: Column) -> Column:
        return _once(F.regexp_replace(acc["text"], _JOINED, "$1 $2$3 "), lambda opened: taken_out(opened, acc["inner"]))

    def taken_out(opened: Column, inner: Column) -> Column:
        inside = F.regexp_extract_all(opened, F.lit(_INNERMOST), F.lit(1))
        # joined tables in a comma list
        inside = F.transform(inside, lambda t: F.when(t.rlike(r"(?i)\bjoin\b") & ~t.rlike(_STATEMENT), F.concat(F.lit("from "), t)).otherwise(t))
        found = F.filter(inside, lambda t: t.rlike(_STATEMENT))
        return F.struct(F.regexp_replace(opened, _INNERMOST, f" {_HELD} ").alias("text"), F.concat(found, inner).alias("inner"))

    whole = F.aggregate(F.sequence(F.lit(1), _levels(text)), start, collapse, lambda acc: F.concat(F.array(acc["text"]), acc["inner"]))
    return F.when(F.contains(text, F.lit("(")), whole).otherwise(F.array(text))


def _listed(sql: Column) -> Column:
    """Names, in order, in the lists after FROM, JOIN, INTO and UPDATE of a statement without brackets."""
    lists = F.regexp_extract_all(sql, F.lit(rf"(?i)(?:^|[\s({_HELD}])(?:from|join|into|update)\s++({_LIST})"), F.lit(1))
    bare = F.transform(lists, lambda t: F.regexp_replace(t, rf"(?i){_CONDITION}(?=\s*,)", ""))
    items = F.flatten(F.transform(bare, lambda t: F.split(t, r"\s*,\s*")))
    first = F.transform(items, lambda t: F.regexp_extract(t, rf"(?i)^\s*(?:lateral\s+)?([^\s{_HELD}]+)", 1))
    return F.transform(first, lambda t: F.regexp_replace(F.lower(t), r"^.*\.|[`\"\[\]]+", ""))


def table_refs(sql: Column) -> Column:
    """Distinct lower-case names after FROM, JOIN, INTO and UPDATE: the statement's own in order of appearance, then
    those of its sub-selects, each behind the one around it.

    All names of a comma list count, also those behind a sub-select, an index hint or a join and its condition,
    however deep its brackets go. What stands in literals and comments does not. Aliases, a schema prefix and
    quotes are dropped, and so are names that start with an underscore.
    """
    clean = F.regexp_replace(sql, _SILENT, " ")
    names = _once(clean, lambda text: F.flatten(F.transform(_statements_in(text), _listed)))
    kept = F.filter(names, lambda n: (n != "") & ~n.startswith("_") & ~n.isin("select", "lateral", "unnest"))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def shard_base(table: Column) -> Column:
    """Name without one trailing shard suffix (1, 2 or at least 4 digits); null when there is none."""
    base = F.regexp_extract(F.lower(table), r"^(.+?)(_\d{4,}|_\d{1,2})$", 1)
    return F.when(base != "", base)


def truncate_ellipsis(text: Column, size: int, null_as: str | None = None) -> Column:
    """At most ``size`` characters, followed by ``...`` when something was cut."""
    cut = F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(ELLIPSIS))).otherwise(text)
    return cut if null_as is None else F.coalesce(cut, F.lit(null_as))


def repo_name(url: Column, fallback: Column) -> Column:
    """Last path segment of a remote URL as a safe directory name."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"\.git$", ""), r"/$", "")
    last = F.regexp_extract(bare, r"([^/]*)$", 1)
    chosen = F.when(is_blank(last), fallback).otherwise(last)
    return F.regexp_replace(chosen, r"[^A-Za-z0-9_-]", "_")


def short_id(commit: Column) -> Column:
    """First eight characters."""
    return F.substring(commit, 1, 8)


def first_line(text: Column) -> Column:
    """Text up to the first line break."""
    return F.split_part(text, F.lit("\n"), F.lit(1))


def format_timestamp(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` without fraction; null gives ''."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def query_param(url: Column, key: str) -> Column:
    """Decoded value of a URL query parameter, null when absent."""
    return F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(key)))


def source_class(location: Column) -> Column:
    """Part before the last dot; '' when there is none."""
    return F.regexp_extract(location, r"^(.+)\.[^.]*$", 1)


def source_method(location: Column) -> Column:
    """Part after the last dot, or all of it when there is none."""
    return F.regexp_extract(location, r"([^.]*)$", 1)


def git_url_key(url: Column) -> Column:
    """Host and path of a remote, the same for its ssh and http forms."""
    bare = F.regexp_replace(F.lower(url), r"^(https?://|git@)", "")
    key = F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit(":"), F.lit("/")), r"\.git$", ""), r"/$", "")
    return F.coalesce(key, F.lit(""))


def camel_to_snake(name: Column) -> Column:
    """``maxTaskNum`` to ``max_task_num``; a run of capitals is not split."""
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


def high_risk(level: Column) -> Column:
    """True for P0, P1 and P2; any other text and null give false."""
    return F.coalesce(level.isin("P0", "P1", "P2"), F.lit(False))


def duration_text(ms: Column) -> Column:
    """Milliseconds as ``340ms``, ``12s`` or ``3m 5s``; null stays null."""
    secs = F.floor(ms / 1000)
    return (
        F.when(ms.isNull(), F.lit(None).cast("string"))
        .when(ms < 1000, F.format_string("%dms", ms))
        .when(secs < 60, F.format_string("%ds", secs))
        .otherwise(F.format_string("%dm %ds", F.floor(secs / 60), secs % 60))
    )


def duration_decimal(ms: Column) -> Column:
    """Milliseconds as ``340ms`` or seconds with one decimal; null gives ``-``."""
    return (
        F.when(ms.isNull(), "-")
        .when(ms < 1000, F.format_string("%dms", ms))
        .otherwise(F.format_string("%.1fs", F.round(ms / 1000.0, 1)))
    )


def suggestion_text(json_list: Column) -> Column:
    """Items of a JSON list parted by a blank line; other text stays as it is."""
    items = F.from_json(json_list, "array<string>")
    is_list = json_list.rlike(r"^\s*\[[\s\S]*\]\s*$") & items.isNotNull()
    return (
        F.when(json_list.isNull() | (json_list == ""), "暂无")
        .when(is_list, F.array_join(items, "\n\n"))
        .otherwise(json_list)
    )
