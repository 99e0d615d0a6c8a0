"""Statements in Java text: SQL annotations and query-builder chains.

A file is cut into tokens once (strings, text blocks, characters, names, brackets; comments are dropped), and
one pass over them matches brackets and knows the class and method at each place: a scope ends at its closing
brace. Calls count at any depth. Files whose brackets do not match give no rows but one in ``java_rejects``.

A builder belongs to the nearest method around it; one in a constructor, an initialiser or a field gives
nothing. A method of an anonymous class counts under the named class around it. A variable that is declared
without a value and set later keeps the type argument of its declaration.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.functions import text as tx

LITERAL = r'"(?:[^"\\\n]++|\\.)*+"'
TEXT_BLOCK = r'"""[\s\S]*?"""'
STRING = f"(?:{TEXT_BLOCK}|{LITERAL})"
TOKEN = re.compile(
    r'"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\''
    r"|/\*[\s\S]*?\*/|//[^\n]*|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|->|::|\S"
)

# The builder types and the calls that make one.
WRAPPERS = ["QueryWrapper", "LambdaQueryWrapper", "UpdateWrapper", "LambdaUpdateWrapper"]
FACTORIES = ["lambdaQuery", "lambdaUpdate", "query", "update"]
SQL_ANNOTATIONS = ["Select", "Insert", "Update", "Delete"]
# Java words that can stand before "(...) {" without naming a method, open a type, or stand before a constructor.
NOT_METHODS = {"if", "for", "while", "switch", "catch", "synchronized", "try"}
TYPES = {"class", "interface", "enum", "record"}
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "default", "synchronized", "native", "strictfp"}
CLOSES = {")": "(", "]": "[", "}": "{"}


class Unbalanced(ValueError):
    """Brackets of a file that do not match."""


class Source:
    """Tokens of a file with matched brackets and the scope of each brace."""

    def __init__(self, content: str):
        found = [m for m in TOKEN.finditer(content) if not m[0].startswith(("//", "/*"))]
        self.token = [m[0] for m in found]
        self.place = [m.span() for m in found]
        self.content = content
        self.match: dict[int, int] = {}
        self.brace: list[int] = []
        self.scope: dict[int, tuple[str, str]] = {}
        self.outer: dict[int, int] = {}
        stack, braces = [], [-1]
        for i, t in enumerate(self.token):
            self.brace.append(braces[-1])
            if t in "([{":
                stack.append(i)
                if t == "{":
                    self.scope[i], self.outer[i] = self._opened(i, braces[-1]), braces[-1]
                    braces.append(i)
            elif t in CLOSES:
                if not stack or self.token[stack[-1]] != CLOSES[t]:
                    raise Unbalanced(f"unmatched {t} at character {self.place[i][0]}")
                self.match[i], self.match[stack[-1]] = stack[-1], i
                stack.pop()
                if t == "}":
                    braces.pop()
        if stack:
            raise Unbalanced(f"{self.token[stack[-1]]} at character {self.place[stack[-1]][0]} is not closed")

    def at(self, i: int) -> str:
        return self.token[i] if 0 <= i < len(self.token) else ""

    def is_name(self, i: int) -> bool:
        t = self.at(i)
        return bool(t) and (t[0].isalpha() or t[0] in "_$")

    def text(self, low: int, high: int) -> str:
        """Source text of the tokens from ``low`` up to ``high``, without comments."""
        out, last = [], None
        for i in range(low, high):
            a, b = self.place[i]
            if last is not None:
                out.append(re.sub(r"/\*[\s\S]*?\*/|//[^\n]*", "", self.content[last:a]))
            out.append(self.content[a:b])
            last = b
        return "".join(out)

    def _opened(self, i: int, around: int) -> tuple[str, str]:
        """What the brace at ``i`` opens: a type, an anonymous type, a method, a constructor, or something else."""
        items, k = [], i - 1
        while k >= 0 and self.token[k] not in (";", "{", "}", "("):
            if self.token[k] in ")]":
                k = self.match[k]
            items.append(k)
            if self.token[k] == "," and around >= 0 and self.scope[around][0] == "enum":
                break
            k -= 1
        for k in reversed(items):
            if self.token[k] in TYPES and self.at(k - 1) != "." and self.is_name(k + 1):
                return ("enum" if self.token[k] == "enum" else "type", self.token[k + 1])
        closed = i - 1
        for k in items:
            if self.token[k] == "throws":
                closed = k - 1
        if self.at(closed) != ")":
            return ("other", "")
        name = self.match[closed] - 1
        k = name
        while self.is_name(k) and self.token[k] != "new" or self.at(k) in ("<", ">", ".", ",", "?", "[", "]"):
            k -= 1
        if self.at(k) == "new":
            return ("anonymous", "")
        kind = self.scope[around][0] if around >= 0 else ""
        if kind not in ("type", "anonymous", "enum") or not self.is_name(name) or self.token[name] in NOT_METHODS:
            return ("other", "")
        before = self.at(name - 1)
        if kind == "enum" and before in ("{", ","):
            return ("anonymous", "")
        typed = (self.is_name(name - 1) and before not in MODIFIERS and self.at(name - 2) != "@") or before in (">", "]")
        return ("method" if typed else "constructor", self.token[name])

    def class_of(self, i: int) -> str:
        b = self.brace[i]
        while b >= 0 and self.scope[b][0] not in ("type", "enum"):
            b = self.outer[b]
        return self.scope[b][1] if b >= 0 else "Unknown"

    def methods_of(self, i: int) -> list[int]:
        """Braces of the methods around a token, the nearest first; none beyond a constructor."""
        b, out = self.brace[i], []
        while b >= 0:
            if self.scope[b][0] == "constructor":
                break
            if self.scope[b][0] == "method":
                out.append(b)
            b = self.outer[b]
        return out

    def generic(self, k: int) -> tuple[str | None, int]:
        """First type argument of the ``<...>`` at ``k``, if there is one, and the token behind it."""
        if self.at(k) != "<":
            return None, k
        depth, j = 0, k
        while j < len(self.token):
            depth += (self.token[j] == "<") - (self.token[j] == ">")
            j += 1
            if not depth:
                break
        return (self.token[k + 1] if self.is_name(k + 1) else None), j

    def after_annotations(self, k: int) -> int:
        while self.at(k) == "@" and self.is_name(k + 1):
            k += 2
            while self.at(k) == "." and self.is_name(k + 1):
                k += 2
            if self.at(k) == "(":
                k = self.match[k] + 1
        return k

    def args(self, opened: int) -> list[str]:
        """Arguments of the call whose bracket is at ``opened``, white space as one space."""
        out, low, k = [], opened + 1, opened + 1
        end = self.match[opened]
        while k <= end:
            if k == end or self.token[k] == ",":
                out.append(re.sub(r"\s+", " ", self.text(low, k)).strip())
                low = k + 1
            elif self.token[k] in "([{":
                k = self.match[k]
            k += 1
        return [a for a in out if a]

    def chain(self, k: int) -> tuple[list[tuple[int, str, list[str]]], int]:
        """The calls ``.name(..)`` from ``k`` on, and the token behind them."""
        calls = []
        while self.at(k) == ".":
            name = self.generic(k + 1)[1]
            if not self.is_name(name) or self.at(name + 1) != "(":
                break
            calls.append((name, self.token[name], self.args(name + 1)))
            k = self.match[name + 1] + 1
        return calls, k

    def annotations(self) -> list[dict]:
        """SQL annotations on methods."""
        out = []
        for i, t in enumerate(self.token):
            if t == "@" and self.at(i + 1) in SQL_ANNOTATIONS and self.at(i + 2) == "(":
                end = self.match[i + 2]
                k = self.after_annotations(end + 1)
                while k < len(self.token) and self.token[k] not in (";", "{", "}", "="):
                    if self.is_name(k) and self.at(k + 1) == "(":
                        out.append({"kind": "sql", "pos": i, "cls": self.class_of(i), "name": self.token[k], "sql_type": self.token[i + 1].upper(), "text": self.text(i + 3, end)})
                        break
                    k = self.after_annotations(k) if self.token[k] == "@" else k + 1
        return out

    def entities(self) -> list[dict]:
        """Table names on classes."""
        out = []
        for i, t in enumerate(self.token):
            if t != "@" or self.at(i + 1) != "TableName" or self.at(i + 2) != "(":
                continue
            end, value = self.match[i + 2], i + 3
            if not self.at(value).startswith('"'):
                named = [k for k in range(i + 3, end) if self.token[k] == "value" and self.token[k + 1] == "="]
                value = named[0] + 2 if named else end
            k = self.after_annotations(end + 1)
            while k < len(self.token) and (self.token[k] in MODIFIERS or self.token[k] == "@"):
                k = self.after_annotations(k) if self.token[k] == "@" else k + 1
            if self.at(value).startswith('"') and self.at(k) == "class" and self.is_name(k + 1):
                out.append({"kind": "entity", "pos": i, "name": self.token[k + 1], "text": self.token[value]})
        return out

    def usages(self) -> list[dict]:
        """Calls on builders, in source order for each builder."""
        made: list[dict] = []
        held: dict[tuple[int, str], dict] = {}
        declared: dict[tuple[int, str], tuple[str, str | None]] = {}

        def born(i: int, wrapper: str, entity: str | None, calls: list, var: str | None) -> None:
            methods = self.methods_of(i)
            if not methods:
                return
            if var is not None and entity is None:
                entity = next((declared[m, var][1] for m in methods if (m, var) in declared), None)
            usage = {"at": i, "method": methods[0], "wrapper": wrapper, "entity": entity, "calls": list(calls)}
            made.append(usage)
            if var is not None:
                held[next((m for m in methods if (m, var) in declared), methods[0]), var] = usage

        for i, t in enumerate(self.token):
            if t in WRAPPERS and self.at(i - 1) not in ("new", ".") and self.methods_of(i):
                entity, k = self.generic(i + 1)
                if self.is_name(k) and self.at(k + 1) in ("=", ";", ","):
                    declared[self.methods_of(i)[0], self.token[k]] = (t, entity)
                    start = k + 2
                    if self.at(k + 1) == "=":
                        f = start + 2 if self.is_name(start) and self.at(start + 1) == "." else start
                        f = self.generic(f)[1]
                        if self.at(f) in FACTORIES and self.at(f + 1) == "(":
                            born(i, t, entity, self.chain(self.match[f + 1] + 1)[0], self.token[k])
            elif t == "new":
                k = i + 1
                while self.is_name(k) and self.at(k + 1) == ".":
                    k += 2
                if self.at(k) in WRAPPERS:
                    entity, opened = self.generic(k + 1)
                    if self.at(opened) == "(":
                        calls, end = self.chain(self.match[opened] + 1)
                        var = self.token[i - 2] if self.at(i - 1) == "=" and self.is_name(i - 2) and self.at(end) in (";", ",") else None
                        born(i, self.token[k], entity, calls, var)
            elif self.at(i + 1) == "." and self.is_name(i) and self.at(i - 1) != ".":
                usage = next((held[m, t] for m in self.methods_of(i) if (m, t) in held), None)
                if usage is not None:
                    usage["calls"] += self.chain(i + 1)[0]
        out = []
        for u in made:
            who = {"cls": self.class_of(u["at"]), "name": self.scope[u["method"]][1]}
            for seq, (_, call, args) in enumerate(sorted(u["calls"], key=lambda c: c[0]), 1):
                out.append({"kind": "call", "pos": u["at"], **who, "wrapper_type": u["wrapper"], "declared_entity": u["entity"], "seq": seq, "call_name": call, "args": args})
        return out


SCANNED = (
    "path string, kind string, pos long, cls string, name string, sql_type string, text string, wrapper_type string, "
    "declared_entity string, seq long, call_name string, args array<string>"
)


def scan_java(files: DataFrame, *kinds: str) -> DataFrame:
    """(path, content) to rows of the kinds ``sql``, ``entity``, ``call`` and ``reject``, of one pass over each file.

    Null content counts as empty.
    """
    wanted = kinds or ("sql", "entity", "call", "reject")

    def rows_of(content: str) -> list[dict]:
        try:
            source = Source(content)
        except Unbalanced as problem:
            return [{"kind": "reject", "text": str(problem)}]
        parts = {"sql": source.annotations, "entity": source.entities, "call": source.usages}
        return [r for k in wanted if k in parts for r in parts[k]()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("path", pa.string()), ("kind", pa.string()), ("pos", pa.int64()), *[(c, pa.string()) for c in ("cls", "name", "sql_type", "text", "wrapper_type", "declared_entity")],
             ("seq", pa.int64()), ("call_name", pa.string()), ("args", pa.list_(pa.string()))]
        )
        for batch in batches:
            found = [
                {"path": path, **row}
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)
                for row in rows_of(content or "")
                if row["kind"] in wanted
            ]
            yield pa.RecordBatch.from_pylist(found, schema)

    return files.select("path", "content").mapInArrow(run, SCANNED)


def java_rejects(files: DataFrame) -> DataFrame:
    """(path, reason) of files whose brackets do not match."""
    return scan_java(files, "reject").select("path", F.col("text").alias("reason"))


def _find(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _find_all(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))



def literal_value(token: Column) -> Column:
    """Text between the quotes of a literal or text block, escapes kept as written."""
    return F.when(token.startswith('"""'), F.substring(token, F.lit(4), F.length(token) - 6)).otherwise(
        F.substring(token, F.lit(2), F.length(token) - 2)
    )


def with_annotation_text(rows: DataFrame) -> DataFrame:
    """Adds ``sql_text`` from the annotation argument ``args``.

    Literals joined by ``+`` stand as they are, array parts are parted by one space; anything that is no
    literal adds nothing, and of named arguments only ``value`` counts. Each step is a column of its own,
    so that no regular expression is evaluated twice.
    """
    element = f'(\\{{(?:[^"}}]++|{STRING})*+\\}}|(?:[^",]++|{STRING})*+)'
    named = F.col("args").rlike(r"^\s*[A-Za-z_]\w*\s*=")
    value = F.when(named, _find("args", rf"\bvalue\s*=\s*{element}")).otherwise(F.col("args"))
    # a comma between array parts becomes a mark no source text holds
    marked = F.transform("tokens", lambda t: F.when(t == ",", "\x01").otherwise(literal_value(t)))
    kept = F.filter(marked, lambda m: F.col("is_array") | (m != "\x01"))
    parts = F.transform(F.split("joined", "\x01"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    text = F.when(F.col("is_array"), F.array_join(F.filter(parts, lambda p: p != ""), " ")).otherwise(F.col("joined"))
    return (
        rows.withColumn("value", value)
        .withColumns({"tokens": _find_all("value", f"{STRING}|,"), "is_array": F.col("value").rlike(r"^\s*\{")})
        .withColumn("joined", F.array_join(kept, ""))
        .withColumn("sql_text", text)
        .drop("args", "value", "tokens", "is_array", "joined")
    )


def annotation_sql_extract(files: DataFrame) -> DataFrame:
    """(path, content) to one row per SQL annotation on a method, under the class whose braces hold it."""
    found = scan_java(files, "sql").select("path", "cls", "name", "sql_type", F.col("text").alias("args"))
    texts = with_annotation_text(found).withColumn("sql_normalized", tx.normalize_sql(F.col("sql_text")))
    return texts.filter("sql_normalized <> ''").select(
        F.col("path").alias("source_file"), "sql_text", "sql_type",
        F.concat("cls", F.lit("."), "name").alias("source_location"),
        "sql_normalized", F.lit("ANNOTATION").alias("source_type"),
    )


def entity_table_map(files: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """(entity, table_name) from table-name annotations on classes; of several, the last path counts.

    ``scanned`` are the files' stored rows of ``scan_java`` if there are any, so that no file is cut into tokens twice.
    """
    found = scan_java(files, "entity") if scanned is None else scanned.filter("kind = 'entity'")
    rows = found.select("path", F.col("name").alias("entity"), literal_value(F.col("text")).alias("table_name"))
    return (
        rows.filter("table_name <> ''").groupBy("entity").agg(F.max(F.struct("path", "table_name")).alias("m"))
        .select("entity", F.col("m.table_name").alias("table_name"))
    )


def wrapper_call_extract(files: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Builder calls: ``path, cls, method, usage_id, wrapper_type, declared_entity, seq, call_name, args``.

    A usage is one builder. Its calls are those chained to its creation and, if it is held in a variable,
    the later ones on that variable in the same method, in source order. ``scanned``: see ``entity_table_map``.
    """
    found = scan_java(files, "call") if scanned is None else scanned.filter("kind = 'call'")
    return found.select(
        "path", "cls", F.col("name").alias("method"), F.concat_ws("#", "path", "cls", "name", F.col("pos").cast("string")).alias("usage_id"),
        "wrapper_type", "declared_entity", "seq", "call_name", "args",
    )
