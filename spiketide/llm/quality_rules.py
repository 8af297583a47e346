"""Quality rules: fixed limits, then robust multivariate outliers within each language and source.

Statistics of a text are column expressions on its own row.  Their transformed
vectors are whole numbers, so sums, means and covariances do not depend on how
the rows are spread.  The minimum covariance determinant of a group is found by
concentration steps: from a robust start, keep the half of the rows that lies
nearest, take its mean and covariance, measure again.  A step is one aggregation
to (group, distance bin); which bins make up the nearest half follows from their
counts, so no group is ever ordered or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spiketide.session import stage

# fixed values: limits and characters of the base rules
SYMBOLS = "[#*$%&|<>]"
WHITE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

DIMS = ("length", "symbols", "lines", "repeats", "capitals")
#: Per dimension (1024 = 1): spread of ordinary texts, squared and added to every variance, so that a
#: statistic that is 0 nearly everywhere in a group does not make the first other value an outlier.
FLOORS = (90, 60, 250, 120, 60)
TOP = 16_383  # a transformed value never exceeds this, so its squares sum up exactly in 64 bits
STEPS = 4
# constants of the chi-squared distribution with 5 degrees of freedom
HALF_FACTOR = 1.912  # covariance of the inner half to that of all
INNER, INNER_FACTOR = 12.833, 1.055  # 97.5 % point, and the factor of what lies within
CUT = 20.0  # squared distance from which a text is an outlier
BINS_PER_UNIT, LAST_BIN = 16, 4095

N = len(DIMS)
PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]


def statistics(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The kept columns and the counts of each text; a null text has no words and all counts are 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, WHITE, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = docs.select(
        *keep,
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("n_capitals"),
        words.alias("_words"),
        lines.alias("_lines"),
    )
    w = F.col("_words")
    starts = F.when(F.size(w) >= 5, F.sequence(F.lit(0), F.size(w) - 5)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*(w[i + k] for k in range(5))))
    held = held.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_capitals",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    v = F.col("_windows")
    repeated = F.size(F.array_distinct(v)) < F.size(v)
    return held.select(
        *(c for c in held.columns if c != "_windows"),
        F.when(repeated, _covered(v)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: sort (hash, place), pair equal neighbours, measure the union."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    less = F.size(windows) - 1
    equal = F.zip_with(
        F.slice(placed, F.lit(1), less), F.slice(placed, F.lit(2), less), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))
    steps = F.zip_with(at, F.slice(at, F.lit(2), F.size(windows)), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def vector_sql() -> list[str]:
    """Transformed statistics: smoothed shares, square roots, in whole 1/1024."""
    shares = (
        "(word_chars + 100) / CAST(n_words + 20 AS DOUBLE)",
        "n_symbols / CAST(word_chars + 50 AS DOUBLE)",
        "n_dup_lines / CAST(n_lines + 5 AS DOUBLE)",
        "n_repeat_words / CAST(n_words + 20 AS DOUBLE)",
        "n_capitals / CAST(word_chars + 50 AS DOUBLE)",
    )
    return [f"CAST(least({TOP}, floor(1024 * sqrt({s}))) AS BIGINT)" for s in shares]


def distance_sql() -> str:
    """Squared Mahalanobis distance from the centre m0.. through the Cholesky factor l00, l10, l11, ... (nested)."""
    z: list[str] = []
    for i in range(N):
        rest = "".join(f" - l{i}{j} * {z[j]}" for j in range(i))
        z.append(f"((v{i} - m{i}{rest}) / l{i}{i})")
    return " + ".join(f"{x} * {x}" for x in z)


def cholesky_sql() -> list[tuple[str, str]]:
    """Columns of the factor, in an order in which each needs earlier ones only, from c00, c10, c11, ..."""
    out = []
    for i in range(N):
        for j in range(i + 1):
            rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append((f"l{i}{j}", f"sqrt({rest})" if i == j else f"({rest}) / l{j}{j}"))
    return out


def moments_sql() -> list[tuple[str, str]]:
    return (
        [("n", "count(*)")]
        + [(f"s{i}", f"sum(v{i})") for i in range(N)]
        + [(f"q{i}{j}", f"sum(v{i} * v{j})") for i, j in PAIRS]
    )


def centre_sql(factor: float) -> list[tuple[str, str]]:
    """Mean and regularised covariance from the moments n, s.., q.. (doubles)."""
    mean = [(f"m{i}", f"s{i} / n") for i in range(N)]
    cov = [(f"c{i}{j}", f"{factor}e0 * ((q{i}{j} - s{i} * s{j} / n) / n)" + (f" + {FLOORS[i] ** 2}" if i == j else "")) for i, j in PAIRS]
    return mean + cov


GROUP = ["lang", "source"]


def _factored(sums: DataFrame, factor: float) -> DataFrame:
    """Centre and Cholesky factor of each group, from its moments."""
    doubles = sums.select(*GROUP, *(F.col(c).cast("double").alias(c) for c, _ in moments_sql()))
    out = doubles.select(*GROUP, *(F.expr(e).alias(c) for c, e in centre_sql(factor)))
    for c, e in cholesky_sql():
        out = out.withColumn(c, F.expr(e))
    return stage(out.select(*GROUP, *(f"m{i}" for i in range(N)), *(c for c, _ in cholesky_sql())))


def _measured(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    c = centres.withColumnsRenamed({g: f"_{g}" for g in GROUP})
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in GROUP]
    joined = vectors.join(c, same[0] & same[1])
    return joined.select(*vectors.columns, F.expr(distance_sql()).alias("d2"))


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*GROUP, *by).agg(*(F.expr(e).alias(c) for c, e in moments_sql()))


def _nearest_half(measured: DataFrame) -> DataFrame:
    """Moments of the nearest (n + p + 1) / 2 rows of each group, whole bins at a time."""
    bins = _moments(measured.withColumn("bin", F.expr(f"CAST(least({LAST_BIN}, floor(sqrt(d2) * {BINS_PER_UNIT})) AS INT)")), "bin")
    over = "(PARTITION BY lang, source ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    ranked = bins.withColumn("_before", F.expr(f"sum(n) OVER {over} - n")).withColumn("_all", F.expr("sum(n) OVER (PARTITION BY lang, source)"))
    inner = ranked.filter(F.expr(f"_before < floor((_all + {N + 1}) / 2)"))
    return inner.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c, _ in moments_sql()))


def _start(vectors: DataFrame) -> DataFrame:
    """Coordinate-wise lower medians as centre, and the floors, times four, as spread."""
    one = vectors.select(*GROUP, F.posexplode(F.array(*(f"v{i}" for i in range(N)))).alias("k", "v"))
    counts = one.groupBy(*GROUP, "k", "v").agg(F.count("*").alias("n"))
    below = F.expr("sum(n) OVER (PARTITION BY lang, source, k ORDER BY v ROWS UNBOUNDED PRECEDING)")
    total = F.expr("sum(n) OVER (PARTITION BY lang, source, k)")
    middle = counts.withColumn("_below", below).withColumn("_all", total).filter("2 * _below >= _all")
    medians = middle.groupBy(*GROUP, "k").agg(F.min("v").alias("v"))
    centre = medians.groupBy(*GROUP).agg(*(F.max(F.when(F.col("k") == i, F.col("v"))).cast("double").alias(f"m{i}") for i in range(N)))
    spread = {f"l{i}{j}": F.lit(2.0 * FLOORS[i] if i == j else 0.0) for i, j in PAIRS}
    return stage(centre.withColumns(spread))


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, base rules and outlier distance of each text.

    Rows: ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``d2`` (squared distance within the
    language and source) and ``kept``, one for each row of ``docs``.  Texts that fail
    the base rules neither shape a group nor get a distance.  Null languages and
    sources are groups of their own.  A null text has no words, so it fails.  A
    group of one row lies at its own centre and is kept.  An empty table gives an
    empty one; other columns are not read.
    """
    named = docs.select(id_col, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("_text"))
    counts = statistics(named, id_col, "lang", "source", text_col="_text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    table = stage(counts.withColumn("base_failed", failed))
    passed = table.filter("not base_failed").select(*GROUP, *(F.expr(e).alias(f"v{i}") for i, e in enumerate(vector_sql())))
    vectors = stage(passed)
    centres = _start(vectors)
    for _ in range(STEPS):
        centres = _factored(_nearest_half(_measured(vectors, centres)), HALF_FACTOR)
    inner = _moments(_measured(vectors, centres).filter(F.col("d2") <= INNER))
    # a group whose every row lies outside keeps the centre of its nearest half
    final = _factored(inner, INNER_FACTOR)
    bare = centres.join(final.select(F.col("lang").alias("_l"), F.col("source").alias("_s")), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left_anti")
    final = stage(final.union(bare.select(*final.columns)))
    good = table.filter("not base_failed").select("*", *(F.expr(e).alias(f"v{i}") for i, e in enumerate(vector_sql())))
    rated = _measured(good, final).select(*table.columns, "d2")
    every = rated.union(table.filter("base_failed").select("*", F.lit(None).cast("double").alias("d2")))
    return every.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUT, F.lit(False))).alias("kept"),
    )
