"""Statements in mapper XML files, dynamic tags expanded to their two extreme forms.

XML nests without bound, which column expressions cannot follow; a small Arrow pass per partition parses
each file and renders its statements. Normalising, comparing and exploding stay with Spark.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.functions import text as tx

# Statement tags and dynamic tags.
STATEMENT_TAGS = ("select", "insert", "update", "delete")
DYNAMIC_TAGS = {"if", "choose", "when", "otherwise", "where", "set", "trim", "foreach"}


def _body(node: ET.Element, on: bool, parts: dict[str, ET.Element], open_ids: tuple = ()) -> str:
    """Text of a node's content; ``on`` says whether optional content is taken."""
    out = [node.text or ""]
    for child in node:
        out += [_tag(child, on, parts, open_ids), child.tail or ""]
    return "".join(out)


def _tag(node: ET.Element, on: bool, parts: dict[str, ET.Element], open_ids: tuple) -> str:
    tag = node.tag
    if tag == "bind" or (tag == "if" and not on):
        return ""
    if tag == "include":
        ref = node.get("refid")
        return _body(parts[ref], on, parts, (*open_ids, ref)) if ref in parts and ref not in open_ids else ""
    if tag == "choose":
        first, other = node.find("when"), node.findall("otherwise")[-1:]
        taken = first if (on and first is not None) or not other else other[0]
        return "" if taken is None else _body(taken, on, parts, open_ids)
    text = _body(node, on, parts, open_ids)
    if tag not in ("where", "set", "trim", "foreach"):
        return text
    text = text.strip()
    if tag == "foreach":
        sep = node.get("separator")
        items = f"{sep} ".join([text] * 3) if sep else text
        return (node.get("open") or "") + items + (node.get("close") or "")
    if not text:
        return ""
    if tag == "where":
        return " WHERE " + re.sub(r"^(and|or)\s+", "", text, flags=re.I)
    if tag == "set":
        return " SET " + re.sub(r",\s*$", "", text)
    for word in filter(None, map(str.strip, (node.get("prefixOverrides") or "").split("|"))):
        text = re.sub(rf"^\s*{re.escape(word)}{'(?!\\w)' if word[-1].isalnum() else ''}\s*", "", text, count=1, flags=re.I)
    for word in filter(None, map(str.strip, (node.get("suffixOverrides") or "").split("|"))):
        text = re.sub(rf"\s*{'(?<!\\w)' if word[0].isalnum() else ''}{re.escape(word)}\s*$", "", text, count=1, flags=re.I)
    return " ".join(["", node.get("prefix") or "", text, node.get("suffix") or ""])


def _dynamic(node: ET.Element, parts: dict[str, ET.Element], open_ids: tuple = ()) -> bool:
    for child in node.iter():
        ref = child.get("refid") if child.tag == "include" else None
        if child is not node and child.tag in DYNAMIC_TAGS:
            return True
        if ref in parts and ref not in open_ids and _dynamic(parts[ref], parts, (*open_ids, ref)):
            return True
    return False


def file_statements(path: str, content: str) -> list[dict]:
    """Rows of one file; a file that cannot be parsed gives one row with ``error``."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as exc:
        return [{"path": path, "error": str(exc)}]
    if root.tag != "mapper":
        return []
    parts = {n.get("id"): n for n in root.iter("sql") if n.get("id")}
    return [
        {
            "path": path,
            "sql_type": tag.upper(),
            "source_location": f"{root.get('namespace') or ''}.{node.get('id') or ''}",
            "has_dynamic": _dynamic(node, parts),
            "full": _body(node, True, parts),
            "bare": _body(node, False, parts),
        }
        for tag in STATEMENT_TAGS
        for node in root.iter(tag)
    ]


FORMS = "path string, sql_type string, source_location string, has_dynamic boolean, full string, bare string, error string"


def mapper_forms(files: DataFrame) -> DataFrame:
    """(path, content) to one row per statement with its ``full`` and ``bare`` form, or ``error``."""
    names = [f.split()[0] for f in FORMS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for path, text in zip(b["path"], b["content"]) for r in file_statements(path, text)]
            yield pd.DataFrame([{**dict.fromkeys(names), **r} for r in rows], columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, FORMS)


def mapper_statement_extract(files: DataFrame) -> DataFrame:
    """One row per distinct non-blank form of each statement."""
    forms = F.when(
        F.col("has_dynamic"), F.array(tx.normalize_sql(F.col("full")), tx.normalize_sql(F.col("bare")))
    ).otherwise(F.array(tx.normalize_sql(F.col("full"))))
    texts = F.filter(F.array_distinct(forms), lambda t: t != "")
    return mapper_forms(files).filter("error is null").select(
        F.explode(texts).alias("sql_text"), F.col("sql_text").alias("sql_normalized"), "sql_type",
        F.lit("MAPPER_XML").alias("source_type"), F.col("path").alias("source_file"), "source_location", "has_dynamic",
    )


def mapper_rejects(files: DataFrame) -> DataFrame:
    """(path, error) of files that could not be parsed."""
    return mapper_forms(files).filter("error is not null").select("path", "error")
