"""Secrets in texts: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is a column expression; a text is one row and nothing is shuffled.
The entropy of a window follows from the counts of its characters.  The window
moves by one character, so one count goes up, one goes down, and the sum of
c log2 c changes by two terms.  Sums are whole numbers (times 2**20), so equal
windows have equal scores wherever they are computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the three base kinds
_WORDS = "password passwd secret token api_?key"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, _WORDS.split())) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_VALUE = 8

CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
UNIT = 1 << 20
#: pattern of a class of candidates, and the entropy in bits that a window of it must reach
CLASSES = (("[0-9A-Fa-f]+", 3.0), ("[0-9A-Z]+|[0-9a-z]+", 3.5), (".*", 3.8))
PLACEHOLDER = ".*(EXAMPLE|XXXX|xxxx|1234567|abcdefg|ABCDEFG).*"
#: candidates that are no secrets: words and paths of letters, numbers, UUIDs, integrity digests, placeholders
ALLOWED = (
    "[A-Za-z/_+-]+",
    "[0-9/_+-]+",
    "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    "(sha256|sha384|sha512)-.*",
    PLACEHOLDER,
)
KINDS = ("assign", "access", "hex", "entropy")


def terms() -> list[int]:
    """c log2 c for every count of a window, in units."""
    return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1))]


def most(bits: float) -> int:
    """Largest sum of the terms at which a window still has so many bits."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def _located(text: Column, pattern: str, found: Column) -> Column:
    """Where each match starts: what lies between the matches, and the matches, in turn."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    walked = F.aggregate(
        lengths,
        start,
        lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.array_append(s["starts"], s["at"] + x["gap"]).alias("starts")),
    )
    return walked["starts"]


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


_NONE = "array<struct<start:int,kind:int,end:int>>"


def _spans(kind: int, text: Column, pattern: str, found: Column, value: Column | None = None) -> Column:
    at = _located(text, pattern, found)
    spans = F.zip_with(at, found, lambda s, m: _span(kind, s, s + F.length(m)))
    if value is not None:
        kept = F.zip_with(spans, value, lambda s, v: F.when(F.length(v) >= ASSIGN_VALUE, s))
        spans = F.filter(kept, lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_NONE))


_PARTS = "array<struct<start:int,end:int>>"


def _part(start: Column, end: Column) -> Column:
    return F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))


def limit_of(candidate: Column) -> Column:
    """Largest sum of the terms that a hot window of the candidate may have."""
    limit = F.lit(most(CLASSES[-1][1])).cast("long")
    for pattern, bits in reversed(CLASSES[:-1]):
        limit = F.when(candidate.rlike(f"^({pattern})$"), F.lit(most(bits)).cast("long")).otherwise(limit)
    return limit


def outside(start: Column, end: Column, base: Column) -> Column:
    """Parts of [start, end) of a window or more that lie between base spans (sorted by start)."""

    def upto(s: Column, stop: Column) -> Column:
        return F.when(stop - s["at"] >= WINDOW, F.concat(s["parts"], _part(s["at"], stop))).otherwise(s["parts"])

    cuts = F.filter(base, lambda b: (b["start"] < end) & (start < b["end"]))
    zero = F.struct(start.cast("int").alias("at"), F.array().cast(_PARTS).alias("parts"))
    return F.aggregate(
        cuts,
        zero,
        lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), upto(s, b["start"]).alias("parts")),
        lambda s: upto(s, end),
    )


def hot_parts(piece: Column, limit: Column) -> Column:
    """(start, end) of each stretch of a piece that hot windows cover without a gap."""
    table = F.array(*(F.lit(t).cast("long") for t in terms()))
    codes = F.transform(F.split(piece, ""), lambda c: F.ascii(c) - 42)  # + is 43, z is 122

    def state(counts, total, at, first, last, done) -> Column:
        return F.struct(counts.alias("counts"), total.alias("total"), at.alias("at"), first.alias("first"), last.alias("last"), done.alias("done"))

    def step(s: Column, x: Column) -> Column:
        come, go = x["come"], x["go"]
        more = table[s["counts"][come - 1] + 1] - table[s["counts"][come - 1]]
        less = F.when(go > 0, table[s["counts"][go - 1]] - table[s["counts"][go - 1] - 1]).otherwise(F.lit(0).cast("long"))
        total = F.when(come == go, s["total"]).otherwise(s["total"] + more - less)
        counts = F.transform(s["counts"], lambda v, k: v + (k == come - 1).cast("int") - (k == go - 1).cast("int"))
        at = s["at"] + 1
        hot = (at >= WINDOW) & (total <= x["limit"])
        apart = hot & (s["first"] >= 0) & (at - WINDOW > s["last"])
        first = F.when(hot & ((s["first"] < 0) | apart), at - WINDOW).otherwise(s["first"])
        done = F.when(apart, F.concat(s["done"], _part(s["first"], s["last"]))).otherwise(s["done"])
        return state(counts, total, at, first, F.when(hot, at).otherwise(s["last"]), done)

    gone = F.concat(F.array_repeat(F.lit(0), WINDOW), codes)
    pairs = F.zip_with(codes, F.slice(gone, F.lit(1), F.size(codes)), lambda c, g: F.struct(c.alias("come"), g.alias("go"), limit.alias("limit")))
    zero = state(F.array_repeat(F.lit(0), 80), F.lit(0).cast("long"), F.lit(0), F.lit(-1), F.lit(-1), F.array().cast(_PARTS))
    return F.aggregate(pairs, zero, step, lambda s: F.when(s["first"] >= 0, F.concat(s["done"], _part(s["first"], s["last"]))).otherwise(s["done"]))


def unreleased(piece: Column, parts: Column) -> Column:
    """Hot parts without a placeholder; those with nothing but cold characters between them become one."""

    def flush(s: Column) -> Column:
        return F.when(s["first"] >= 0, F.concat(s["done"], _part(s["first"], s["last"]))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        released = F.substring(piece, x["start"] + 1, x["end"] - x["start"]).rlike(PLACEHOLDER)
        first = F.when(released, F.lit(-1)).when(s["first"] < 0, x["start"]).otherwise(s["first"])
        return F.struct(first.alias("first"), x["end"].alias("last"), F.when(released, flush(s)).otherwise(s["done"]).alias("done"))

    zero = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.array().cast(_PARTS).alias("done"))
    return F.aggregate(parts, zero, step, flush)


def scan(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """Secrets of each text: the kept columns, ``base`` and ``spans``, arrays of (start, kind, end) by start.

    Positions are code points and ``end`` is exclusive; ``kind`` numbers KINDS.
    ``base`` has the matches of the fixed patterns.  ``spans`` adds high-entropy
    parts of candidate strings that no allow pattern covers: windows that touch a base
    span do not count, those before and after it do, and a placeholder releases
    the hot part it stands in.  A null text counts as empty and has no spans; null ids and
    repeated rows stay; an empty table gives an empty one; other columns are not read.
    """
    keep = keep or ("doc_id",)
    allowed = "^(" + "|".join(a for a in ALLOWED if a != PLACEHOLDER) + ")$"
    text = F.col("_text")
    matched = docs.select(*keep, F.coalesce(text_col, F.lit("")).alias("_text")).select(
        *keep,
        "_text",
        F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(0)).alias("_assign"),
        F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2)).alias("_value"),
        F.regexp_extract_all("_text", F.lit(ACCESS), F.lit(0)).alias("_access"),
        F.regexp_extract_all("_text", F.lit(HEX), F.lit(0)).alias("_hex"),
        F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("_candidate"),
    )
    base = F.array_sort(
        F.concat(
            _spans(0, text, ASSIGN, F.col("_assign"), F.col("_value")),
            _spans(1, text, ACCESS, F.col("_access")),
            _spans(2, text, HEX, F.col("_hex")),
        )
    )
    at = _located(text, CANDIDATE, F.col("_candidate"))
    placed = F.zip_with(at, F.col("_candidate"), lambda s, c: F.struct(s.alias("start"), c.alias("text")))
    suspects = F.filter(placed, lambda c: ~c["text"].rlike(allowed))
    matched = matched.select(*keep, "_text", base.alias("base"), F.when(F.size("_candidate") > 0, suspects).alias("_suspects"))
    pieces = F.flatten(
        F.transform(
            F.coalesce("_suspects", F.array().cast("array<struct<start:int,text:string>>")),
            lambda c: F.transform(
                outside(c["start"], c["start"] + F.length(c["text"]), F.col("base")),
                lambda p: F.struct(
                    p["start"].alias("start"),
                    F.substring(c["text"], p["start"] - c["start"] + 1, p["end"] - p["start"]).alias("text"),
                    limit_of(c["text"]).alias("limit"),
                ),
            ),
        )
    )
    found = matched.select(*keep, "base", pieces.alias("_pieces"))
    rated = F.transform("_pieces", lambda p: F.struct(p["start"].alias("start"), p["text"].alias("text"), hot_parts(p["text"], p["limit"]).alias("hot")))
    spans = F.transform(rated, lambda p: F.transform(unreleased(p["text"], p["hot"]), lambda h: _span(3, p["start"] + h["start"], p["start"] + h["end"])))
    return found.select(*keep, "base", F.array_sort(F.concat("base", F.flatten(spans))).alias("spans"))


def named(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return found.select(id_col, *counts, F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"))


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans share one."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap).alias("out"))

    done = F.aggregate(spans, zero, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
