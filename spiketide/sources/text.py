"""Readers of the text files of a run directory, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: fields of one line of a parameter file, in order
PARAM_WEIGHTS = 4
PARAM_PROBS = 16
PARAM_RATES = 2


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(job_id, line) of every matching file; the job number comes from the file name."""
    job = F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"id(\d+)_", 1)
    return (
        spark.read.option("pathGlobFilter", pattern)
        .text(path)
        .select(F.when(job != "", job).cast("bigint").alias("job_id"), F.trim("value").alias("line"))
    )


def _numbers(c: Column) -> Column:
    """Numbers of a comma list with or without a comma at its end; nan becomes NULL."""
    parts = F.filter(F.split(c, ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.nullif(F.trim(x).try_cast("double"), F.lit(float("nan"))))


def read_network(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(job_id, pre, post, w) from lines ``post<-pre,w``; header lines do not match."""
    rx = r"^(\d+)<-(\d+),([-+.eE0-9]+)$"
    part = [F.regexp_extract("line", rx, i) for i in (1, 2, 3)]
    return _lines(spark, path, pattern).filter(F.col("line").rlike(rx)).select(
        "job_id", part[1].cast("int").alias("pre"), part[0].cast("int").alias("post"), part[2].cast("double").alias("w")
    )


def read_adjacency(spark: SparkSession, path: str, pattern: str = "*_adj.txt") -> DataFrame:
    """(job_id, pre, post) from in-lists ``post<-pre,pre,...,``; deleted ends (-1) are left out."""
    sides = F.split("line", "<-")
    e = _lines(spark, path, pattern).filter(F.col("line").contains("<-")).select(
        "job_id", F.explode(_numbers(sides[1])).alias("pre"), sides[0].cast("int").alias("post")
    )
    return e.select("job_id", F.col("pre").cast("int").alias("pre"), "post").filter("pre <> -1 AND post <> -1")


def read_pairs(spark: SparkSession, path: str, pattern: str = "*_trinfo.txt") -> DataFrame:
    """(job_id, t_id, r_id, delay); files of two columns have no delay."""
    v = F.split("line", ",")
    return _lines(spark, path, pattern).filter(F.col("line").rlike(r"^\d")).select(
        "job_id", v[0].cast("int").alias("t_id"), v[1].cast("int").alias("r_id"), F.get(v, F.lit(2)).try_cast("int").alias("delay")
    )


def read_summaries(spark: SparkSession, path: str, pattern: str = "id*_result.txt", pops: tuple[str, ...] = ("total", "F", "S")) -> DataFrame:
    """(job_id, pop, chi, cv, frs_m, frs_s) from ``key:v,v,...,`` lines.

    Undefined values (nan, and -1 for cv) become NULL.
    """
    kv = F.split("line", ":")
    names = F.array(*[F.lit(p) for p in pops])
    rows = (
        _lines(spark, path, pattern)
        .filter(F.col("line").rlike(r"^(chi|cv|frs_m|frs_s):"))
        .select("job_id", kv[0].alias("key"), F.posexplode(_numbers(kv[1])).alias("k", "v"))
    )
    v = F.when(~((F.col("key") == "cv") & (F.col("v") == -1)), F.col("v"))
    pick = [F.max(F.when(F.col("key") == c, v)).alias(c) for c in ("chi", "cv", "frs_m", "frs_s")]
    pop = F.coalesce(F.get(names, F.col("k")), F.col("k").cast("string"))
    return rows.groupBy("job_id", pop.alias("pop")).agg(*pick)


def read_axes(spark: SparkSession, path: str) -> DataFrame:
    """(name, idx, value) from a control file: first line sizes, then ``name:v,v,...,``."""
    kv = F.split("line", ":")
    return (
        _lines(spark, path, "control_params.txt")
        .filter(F.col("line").contains(":"))
        .select(kv[0].alias("name"), F.posexplode(_numbers(kv[1])).alias("idx", "value"))
    )


def read_params(spark: SparkSession, path: str, with_seed: bool = False) -> DataFrame:
    """Parameter lines as (job_id, seed, w, p, nu, wratio, tdelay).

    The job id is the number of the line after the first one, which counts the jobs.  The short form has 22
    numbers; ``with_seed`` expects a seed before and a weight ratio and a
    delay after them.  A line of another length stops the job with an error;
    blank lines are passed over.
    """
    v = _numbers(F.col("line"))
    first = 1 if with_seed else 0
    need = PARAM_WEIGHTS + PARAM_PROBS + PARAM_RATES + (3 if with_seed else 0)
    p0 = first + PARAM_WEIGHTS
    r0 = p0 + PARAM_PROBS
    p = F.array(*[F.slice("v", p0 + 4 * i + 1, 4) for i in range(4)])

    def only(c: Column, kind: str) -> Column:
        return (c if with_seed else F.lit(None)).cast(kind)

    whole = spark.read.option("pathGlobFilter", "params_to_run.txt").text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\\r?\\n")).alias("at", "line")).filter("at > 0 AND trim(line) <> ''")
    wrong = F.raise_error(F.concat(F.lit(f"a parameter line has {need} numbers: "), F.col("line")))
    checked = F.when(F.size("v") == need, F.col("v")).otherwise(wrong)
    return (
        lines.select((F.col("at") - 1).cast("bigint").alias("job_id"), "line", v.alias("v"))
        .select("job_id", checked.alias("v"))
        .select(
            "job_id",
            only(F.get("v", F.lit(0)), "bigint").alias("seed"),
            F.slice("v", first + 1, PARAM_WEIGHTS).alias("w"),
            p.alias("p"),
            F.slice("v", r0 + 1, PARAM_RATES).alias("nu"),
            only(F.get("v", F.lit(r0 + PARAM_RATES)), "double").alias("wratio"),
            only(F.get("v", F.lit(r0 + PARAM_RATES + 1)), "double").alias("tdelay"),
        )
    )
