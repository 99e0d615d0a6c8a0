"""Personal data by weak supervision, in DataFrame operations only.

Candidates come from regular expressions, those of the base kinds and wider ones. Labelers vote on each
candidate for, against or not at all: its format, a check of its characters, a gazetteer of known parts, words in
its context, and its borders. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data. These probabilities train the final classifier of
spans, additive log-odds of span features. Base spans are always kept; others if the classifier says so.

Spans are in code points, end exclusive. A null or empty text has none. Repeated rows are searched one by one; no
two spans of one kind overlap. Keys may be null or repeated. An empty table gives an empty result; with no
candidates there is nothing to learn. Other columns are not used. Patterns take time in proportion to the text:
a run is tried from its start only, possessively or up to a fixed length.
"""

from __future__ import annotations

from collections import defaultdict
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querywarden.llm.packs import ROW, numbered, stored

# A match starts where a run of local characters starts, or right behind the match before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# whole runs of digits with single separators, 13 to 19 of them
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[\x20.-]?)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![.-]?[0-9])"
MASK = r"(?i)[(\[{]\x20?at\x20?[)\]}]"
MASKED_EMAIL = (
    r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]++\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[A-Z0-9-]++"
    r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?[A-Z0-9-]++|\.[A-Z0-9-]++)++"
)
SECRET = r"(?i)(?<![A-Z0-9])(?:token|secret|password|passwd|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\"']?[A-Z0-9+/_=-]{16,}+[\"']?"

KINDS = ["email", "ip", "card", "phone", "local_phone", "masked_email", "secret"]
BASE = KINDS[:4]
LABELERS = ["format", "characters", "gazetteer", "context", "borders"]
STEPS = 25
LEFT, RIGHT = 32, 16

# gazetteers: common top-level domains, calling codes, first digits of card issuers
TLDS = "com|org|net|edu|gov|io|info|biz|co|de|fr|es|it|uk|eu|us|ca|au|jp|cn|in|br|nl|ch|at|se|pl|ru"
CALLING_CODES = "1|7|20|27|3[0-469]|4[0-1]|4[3-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|351|352|353|358|420|421|971|972"
ISSUERS = r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|3[068]|62"
CONTEXT = {
    "email": "e-?mail|mail|contact|write to|correo|courriel",
    "masked_email": "e-?mail|mail|contact|write to|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse|login|client",
    "card": "card|visa|master|credit|tarjeta|carte|karte|payment",
    "phone": r"phone|call|\btel|fax|mobile|telefon|llame|appel",
    "local_phone": r"phone|call|\btel|fax|mobile|telefon|llame|appel",
    "secret": "token|secret|passw|key|credential",
}
AGAINST = r"version|release|section|chapter|isbn|figure|\bno\.?\s*$|\bv\s*$"


def _pieces(t: Column, kind: str, pattern: str, when: Column) -> Column:
    """The text between matches and the matches, as rows to be; null without a match."""
    zipped = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hit"))
    rows = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("at"),
            F.length(z["gap"]).alias("gap"),
            F.left(z["gap"], F.lit(RIGHT)).alias("head"),
            F.right(z["gap"], F.lit(LEFT)).alias("tail"),
            z["hit"].alias("hit"),
        ),
    )
    return F.when(when, rows)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row, kind, start, end, hit, left, right`` of every match in a ``numbered`` table."""
    t = F.col("_text")
    digits, plus = F.col("_digits"), F.contains(t, F.lit("+"))
    equal = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    found = F.array(
        _pieces(t, "email", EMAIL, F.contains(t, F.lit("@"))),
        _pieces(t, "ip", IP, digits),
        _pieces(t, "card", CARD, digits),
        _pieces(t, "phone", PHONE, digits & plus),
        _pieces(t, "local_phone", LOCAL_PHONE, digits),
        _pieces(t, "masked_email", MASKED_EMAIL, t.rlike(MASK)),
        _pieces(t, "secret", SECRET, equal),
    )
    rows = docs.select(F.col(ROW).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_digits", t.rlike("[0-9]")).filter(digits | equal | F.contains(t, F.lit("@")) | t.rlike(MASK))
    some = F.flatten(F.filter(found, lambda f: f.isNotNull() & (F.size(f) > 1)))
    pieces = stored(rows.select("row", F.explode(some).alias("p")).select("row", "p.*"), "pii-pieces")
    order = Window.partitionBy("row", "kind").orderBy("at")
    step = F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))
    end = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.withColumn("end", end).withColumn("right", F.lead("head").over(order)).filter("hit is not null")
    return placed.select("row", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", F.col("tail").alias("left"), "right")


def _kind(name: str) -> Column:
    return F.col("kind") == KINDS.index(name)


def _digits(c: str = "hit") -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def one(i: Column) -> Column:
        x = F.ascii(F.substring(back, i, F.lit(1))) - ord("0")
        return F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda acc, i: acc + one(i)) % 10 == 0


def base_holds() -> Column:
    """Whether a match of a base kind is a base span."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    n = F.length(_digits())
    return (
        F.when(_kind("email"), True)
        .when(_kind("ip"), F.col("hit").rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(_kind("card"), luhn(_digits()))
        .when(_kind("phone"), n.between(9, 15))
        .otherwise(False)
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes() -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1, -1, or 0 for none."""
    hit, low = F.col("hit"), F.lower("hit")
    chars = F.size(F.array_distinct(F.split(F.regexp_replace(low, r"^.*?[=:]\s*", ""), "")))
    near = F.lower(F.col("left"))
    context = F.lit(False)
    for kind, words in CONTEXT.items():
        context |= _kind(kind) & (near.rlike(words) if kind != "secret" else hit.rlike("(?i)token|secret|passw|key"))
    mailed, called = _kind("email") | _kind("masked_email"), _kind("phone") | _kind("local_phone")
    formed = (
        (mailed & low.rlike(r"[a-z]{2,24}$") & ~low.rlike(r"^[.-]|\.\.|-@"))
        | (_kind("ip") & ~hit.rlike(r"(?:^|\.)0[0-9]"))
        | (_kind("card") & hit.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"))
        | (called & hit.rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{0,4}$"))
        | (_kind("secret") & hit.rlike(r"[\"'][^\"']+[\"']$|[=:]\s*[A-Za-z0-9+/_=-]+$"))
    )
    checked = (
        (mailed & low.rlike("^[^@(\\[{]*[a-z]"))
        | (_kind("ip") & ~hit.rlike(r"^(?:0|127|255)\.|\.(?:0|255)$"))
        | (_kind("card") & luhn(_digits()))
        | (called & F.length(_digits()).between(10, 13))
        | (_kind("secret") & (chars >= 8) & hit.rlike("[0-9]"))
    )
    listed = (
        (mailed & low.rlike(rf"(?:\.|dot[)\]}}]?\x20?)(?:{TLDS})$"))
        | (_kind("card") & _digits().rlike(f"^(?:{ISSUERS})"))
        | (_kind("phone") & _digits().rlike(f"^(?:{CALLING_CODES})"))
        | (_kind("local_phone") & hit.rlike(r"^\(?[2-9]"))
        | (_kind("secret") & low.rlike("^(?:token|secret|password|api)"))
    )
    unlisted = (mailed & ~listed) | (_kind("card") & ~listed) | (_kind("phone") & ~listed)
    open_left = F.coalesce(F.right("left", F.lit(1)), F.lit("")).rlike(r"[\p{L}0-9_@]")
    open_right = F.coalesce(F.left("right", F.lit(1)), F.lit("")).rlike(r"[\p{L}0-9_@]")
    return {
        "format": _vote(formed, ~formed),
        "characters": _vote(checked, ~checked),
        "gazetteer": _vote(listed, unlisted),
        "context": _vote(context, near.rlike(AGAINST)),
        "borders": _vote(~open_left & ~open_right, open_left | open_right),
    }


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """The probability that a candidate is personal data, by kind and votes, from counts of these.

    There are at most ``len(KINDS) * 3 ** len(LABELERS)`` of them. Labelers vote independently given the
    truth; how often a labeler votes each way for either truth, and each kind's share of true ones, are
    estimated in turn with the probabilities. All start from the majority of votes.
    """
    belief = {(k, v): 1 / (1 + 2.0 ** -(2 * sum(v))) for k, v, _ in counts}
    for _ in range(STEPS):
        share, seen = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: 0.5)
        for k, v, n in counts:
            p = belief[k, v]
            share[k][0] += n * (1 - p)
            share[k][1] += n * p
            for j, x in enumerate(v):
                seen[j, x, 0] += n * (1 - p)
                seen[j, x, 1] += n * p
        total = {(j, z): sum(seen[j, x, z] for x in (-1, 0, 1)) for j in range(len(LABELERS)) for z in (0, 1)}
        # a labeler is never trusted the wrong way round
        odds = {}
        for j in range(len(LABELERS)):
            for x in (-1, 0, 1):
                raw = log(seen[j, x, 1] / total[j, 1]) - log(seen[j, x, 0] / total[j, 0])
                odds[j, x] = max(0.0, raw) if x == 1 else min(0.0, raw) if x == -1 else 0.0
        for k, v, _ in counts:
            margin = log(share[k][1] / share[k][0]) + sum(odds[j, x] for j, x in enumerate(v))
            belief[k, v] = 1 / (1 + 2.718281828459045 ** -max(-40.0, min(40.0, margin)))
    return belief


def span_features() -> Column:
    """The features of a span, one text each; there are a few hundred values in all."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    length = F.least(F.floor(F.log2(F.length("hit"))), F.lit(9)).cast("string")
    share = F.floor(F.length(_digits()) * 4 / F.length("hit")).cast("string")
    edge = lambda c, side: F.when(F.coalesce(side(c, F.lit(1)), F.lit("")).rlike(r"[\p{L}0-9_@]"), "open").otherwise("closed")
    tail = F.when(F.lower("hit").rlike(rf"(?:{TLDS})$"), "known").otherwise("other")
    shape = F.left(F.regexp_replace(F.regexp_replace(F.left("hit", F.lit(6)), r"\p{L}", "a"), "[0-9]", "9"), F.lit(3))
    common = F.regexp_replace(shape, "[^a9+(.-]", "?")
    parts = {"kind": F.lit(""), "length": length, "digits": share, "left": edge("left", F.right), "right": edge("right", F.left), "tail": tail, "shape": common}
    return F.array(*[F.concat_ws(":", kind, F.lit(name), value) for name, value in parts.items()])


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Kept spans: ``row, kind, start, end, base, chance``; ``docs`` is a ``numbered`` table."""
    wanted = candidates(docs, text).withColumn("base", base_holds()).filter(F.col("base") | (F.col("kind") >= len(BASE)))
    judged = wanted.select("*", *[v.cast("int").alias(name) for name, v in votes().items()], span_features().alias("features"))
    judged = stored(judged.drop("hit", "left", "right"), "pii-candidates")
    counts = judged.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return judged.select("row", "kind", "start", "end", "base", F.lit(0.0).alias("chance"))
    belief = reliabilities([(r.kind, tuple(r[x] for x in LABELERS), r.n) for r in counts])
    pattern = F.concat_ws(",", "kind", *LABELERS)
    known = F.create_map(*[F.lit(x) for (k, v), p in sorted(belief.items()) for x in (",".join(map(str, (k, *v))), p)])
    soft = judged.withColumn("p", F.element_at(known, pattern))
    sums = soft.select("p", F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("one"), F.sum(1 - F.col("p")).alias("nil")).collect()
    whole = {k: [1.0, 1.0] for k in KINDS}
    for r in sums:
        if r.f.split(":")[1] == "kind":
            whole[r.f.split(":")[0]] = [r.nil + 1, r.one + 1]
    odds = {}
    for r in sums:
        kind, name = r.f.split(":")[:2]
        nil, one = whole[kind]
        odds[r.f] = log(one / nil) if name == "kind" else log((r.one + 0.5) / one) - log((r.nil + 0.5) / nil)
    table = F.create_map(*[F.lit(x) for f, o in sorted(odds.items()) for x in (f, float(o))])
    margin = F.aggregate("features", F.lit(0.0), lambda acc, f: acc + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    scored = judged.withColumn("chance", 1 / (1 + F.exp(-margin)))
    return scored.filter(F.col("base") | (F.col("chance") >= 0.5)).select("row", "kind", "start", "end", "base", "chance")


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``spans``, an array of (kind, start, end, base, chance) in order of kind and start."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    docs = numbered(docs, key, text)
    kept = find_spans(docs, text).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base", "chance"))).alias("s"))
    named = F.transform("s", lambda s: F.struct(name(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["chance"].alias("chance")))
    rows = docs.select(F.col(ROW).alias("row"), F.col(key).alias("doc_id"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean,chance:double>>")
    return rows.join(kept.select("row", named.alias("spans")), "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
