"""Queries: clustering, consensus, grids, feature summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.functions.columns import rounded
from spiketide.operators import clusters, hist
from spiketide.plans.registry import query
from spiketide.plans.tables import table
from spiketide.session import stage

DIMS = 64


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v")
    )


SIL = """p AS (SELECT vec_id, CAST(label AS BIGINT) AS label, embedding::DOUBLE[] AS v FROM embeddings),
    sz AS (SELECT label, count(*) AS n FROM p GROUP BY label),
    d AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END) AS d
      FROM p a CROSS JOIN p b GROUP BY ALL),
    m AS (SELECT vec_id, d.label, other, d / (CASE WHEN d.label = other THEN n - 1 ELSE n END) AS m FROM d JOIN sz ON sz.label = other),
    ab AS (SELECT vec_id, label, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b FROM m GROUP BY 1, 2),
    sil AS (SELECT vec_id, label, a, b, (b - a) / greatest(a, b) AS s FROM ab)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.silhouette(points(spark, sf), "vec_id", "label", "v")


@query("silhouette", f"WITH {SIL} SELECT vec_id, label, round(a, 6) AS a, round(b, 6) AS b, round(s, 6) AS s FROM sil")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("vec_id", "label", *[rounded(c).alias(c) for c in ("a", "b", "s")])


@query(
    "silhouette_coefficient",
    f"WITH {SIL}, c AS (SELECT label, avg(s) AS s FROM sil GROUP BY label) SELECT round(max(s), 6) AS coefficient FROM c",
)
def silhouette_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    """Largest of the cluster means."""
    return scored(spark, sf).groupBy("label").agg(F.avg("s").alias("s")).agg(rounded(F.max("s")).alias("coefficient"))


@query(
    "gated_contingency",
    f"""WITH {SIL}, g AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM sil WHERE s > 0.0 GROUP BY 1, 2)
    SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 9) AS share FROM g""",
)
def gated_contingency(spark: SparkSession, sf: str) -> DataFrame:
    """Cross table of two labelings over well-placed points only."""
    s = scored(spark, sf).select(F.col("label").alias("a"), (F.col("vec_id") % 10).alias("b"), "s")
    return hist.contingency(s, "a", "b", gate=F.col("s") > 0.0).withColumn("share", rounded("share", 9))


RUNS = """l AS (SELECT vec_id, CAST(label AS BIGINT) AS r0, vec_id % 10 AS r1,
      list_position(embedding, list_max(embedding))::BIGINT - 1 AS r2 FROM embeddings)"""


def labelings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("r0"),
        (F.col("vec_id") % 10).alias("r1"),
        (F.array_position("embedding", F.array_max("embedding")) - 1).cast("bigint").alias("r2"),
    )


CONSENSUS = f"""WITH {RUNS}, sg AS (SELECT concat_ws('|', r0, r1, r2) AS s, r0, r1, r2, count(*) AS n FROM l GROUP BY ALL),
    cm AS (SELECT a.s AS i, b.s AS j, a.n AS n_i, b.n AS n_j, ((a.r0 = b.r0)::INT + (a.r1 = b.r1)::INT + (a.r2 = b.r2)::INT) / 3.0 AS c
      FROM sg a JOIN sg b ON a.s <= b.s AND (a.r0 = b.r0 OR a.r1 = b.r1 OR a.r2 = b.r2))"""


@query("consensus_matrix", f"{CONSENSUS} SELECT i, j, n_i, n_j, round(c::DOUBLE, 9) AS c FROM cm")
def consensus_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Co-membership over three labelings, one row per pair of label signatures that ever meet."""
    return clusters.consensus(labelings(spark, sf), ["r0", "r1", "r2"]).withColumn("c", rounded("c", 9))


@query(
    "pac",
    f"""WITH {RUNS}, pr AS (SELECT ((a.r0 = b.r0)::INT + (a.r1 = b.r1)::INT + (a.r2 = b.r2)::INT) / 3.0 AS c
      FROM l a JOIN l b ON a.vec_id < b.vec_id)
    SELECT round(count(*) FILTER (round(c / 0.05) > 3 AND round(c / 0.05) <= 17) / count(*), 9) AS pac,
    round(count(*) FILTER (c = 0) / count(*), 9) AS never FROM pr""",
)
def pac(spark: SparkSession, sf: str) -> DataFrame:
    l = labelings(spark, sf)
    m = clusters.consensus(l, ["r0", "r1", "r2"])
    out = clusters.ambiguous_share(m, l.agg(F.count("*")).scalar())
    return out.select(rounded("pac", 9).alias("pac"), rounded("never", 9).alias("never"))


@query(
    "representative_point",
    f"""WITH {SIL}, k AS (SELECT vec_id, label, greatest(s, 0) AS w, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS k,
      floor(count(*) OVER (PARTITION BY label) * 0.25) AS take FROM sil),
    e AS (SELECT vec_id, label, unnest(v) AS v, unnest(range(0, 64)) AS i FROM p),
    c AS (SELECT e.label, e.i, sum(w * v) / nullif(sum(w), 0) AS c FROM k JOIN e USING (vec_id) WHERE k <= take GROUP BY 1, 2),
    g AS (SELECT e.vec_id, e.label, sqrt(sum((v - c) * (v - c))) AS gap FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY 1, 2)
    SELECT label, arg_min(vec_id, gap) AS vec_id, round(min(gap), 6) AS gap FROM g WHERE gap IS NOT NULL GROUP BY label""",
)
def representative_point(spark: SparkSession, sf: str) -> DataFrame:
    s = stage(scored(spark, sf).select("vec_id", "s"))
    both = points(spark, sf).join(s, "vec_id")
    out = clusters.representatives(both, "label", "vec_id", "v", DIMS)
    return out.filter("gap IS NOT NULL").select("label", "vec_id", rounded("gap").alias("gap"))


@query(
    "cluster_means",
    """WITH e AS (SELECT CAST(label AS BIGINT) AS label, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS dim FROM embeddings)
    SELECT label, dim, round(avg(v), 7) AS m, round(stddev_pop(v), 7) AS s FROM e GROUP BY label, dim""",
)
def cluster_means(spark: SparkSession, sf: str) -> DataFrame:
    e = points(spark, sf).select("label", F.posexplode("v").alias("dim", "x"))
    return e.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(
        rounded(F.avg("x"), 7).alias("m"), rounded(F.stddev_pop("x"), 7).alias("s")
    )


@query(
    "largest_differences",
    """WITH e AS (SELECT CAST(label AS BIGINT) AS label, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS dim FROM embeddings),
    m AS (SELECT dim, avg(v) FILTER (label = 0) - avg(v) FILTER (label = 1) AS d FROM e GROUP BY dim)
    SELECT dim, round(d, 7) AS diff FROM m ORDER BY abs(d) DESC LIMIT 5""",
)
def largest_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Report: the five features that differ most between two clusters."""
    e = points(spark, sf).filter("label IN (0, 1)").select("label", F.posexplode("v").alias("dim", "x"))
    d = F.avg(F.when(F.col("label") == 0, F.col("x"))) - F.avg(F.when(F.col("label") == 1, F.col("x")))
    m = e.groupBy(F.col("dim").cast("bigint").alias("dim")).agg(d.alias("d"))
    return m.orderBy(F.abs("d").desc()).limit(5).select("dim", rounded("d", 7).alias("diff"))


@query(
    "regress_trend",
    """WITH e AS (SELECT CAST(label AS BIGINT) AS x, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS dim FROM embeddings),
    m AS (SELECT dim, x, avg(v) AS y FROM e GROUP BY 1, 2)
    SELECT dim, round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 8) AS intercept FROM m GROUP BY dim""",
)
def regress_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Linear trend of each feature over the cluster order."""
    e = points(spark, sf).select(F.col("label").alias("x"), F.posexplode("v").alias("dim", "v"))
    m = e.groupBy(F.col("dim").cast("bigint").alias("dim"), "x").agg(F.avg("v").alias("y"))
    return m.groupBy("dim").agg(
        rounded(F.regr_slope("y", "x"), 8).alias("slope"), rounded(F.regr_intercept("y", "x"), 8).alias("intercept")
    )


@query(
    "first_appearance_relabel",
    """WITH f AS (SELECT CAST(label AS BIGINT) AS label, min(vec_id) AS p FROM embeddings GROUP BY 1)
    SELECT label, row_number() OVER (ORDER BY p) AS "new" FROM f""",
)
def first_appearance_relabel(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.relabel_by_first(points(spark, sf).select("label", "vec_id"), "label", "vec_id")


GRID = """g AS (SELECT CAST(l_linenumber AS BIGINT) AS r, CAST(round(l_discount * 100) AS BIGINT) AS c,
      count(*) % 2 AS state, CAST(floor(avg(l_quantity) * 1000) AS BIGINT) % 3 AS hue FROM lineitem GROUP BY 1, 2)"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Line number x discount; the state of a cell is the parity of its row count."""
    return (
        table(spark, sf, "lineitem", "l_linenumber", "l_discount")
        .groupBy(F.col("l_linenumber").cast("bigint").alias("r"), F.round(F.col("l_discount") * 100).cast("bigint").alias("c"))
        .agg((F.count("*") % 2).alias("state"))
    )


NB = """nb AS (SELECT a.r, a.c, a.state, b.r AS nr, b.c AS nc, b.state AS ns FROM g a JOIN g b ON abs(a.r - b.r) + abs(a.c - b.c) = 1)"""


@query(
    "grid_boundary",
    f"""WITH {GRID}, {NB} SELECT CASE WHEN nr <> r THEN c - 0.5 ELSE (c + nc) / 2 END::DOUBLE AS x0, CASE WHEN nr <> r THEN c + 0.5 ELSE (c + nc) / 2 END::DOUBLE AS x1,
    CASE WHEN nr <> r THEN (r + nr) / 2 ELSE r - 0.5 END::DOUBLE AS y0, CASE WHEN nr <> r THEN (r + nr) / 2 ELSE r + 0.5 END::DOUBLE AS y1 FROM nb WHERE state <> ns""",
)
def grid_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.grid_boundary(grid(spark, sf))


COMP = f"""WITH RECURSIVE {GRID}, {NB}, reach(r, c, k) AS (SELECT r, c, r * 100 + c FROM g
      UNION SELECT nb.nr, nb.nc, reach.k FROM reach JOIN nb ON nb.r = reach.r AND nb.c = reach.c AND nb.state = nb.ns),
    comp AS (SELECT r, c, min(k) AS comp FROM reach GROUP BY r, c)"""


@query("grid_components", f"{COMP} SELECT g.r, g.c, g.state, comp.comp FROM g JOIN comp USING (r, c)")
def grid_components(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.grid_components(stage(grid(spark, sf)), 100).select("r", "c", "state", "comp")


@query(
    "grid_denoise",
    f"""WITH {GRID}, {NB}, v AS (SELECT r, c, state, ns, count(*) AS k FROM nb GROUP BY ALL),
    b AS (SELECT r, c, state, max(CASE WHEN ns = state THEN 1 ELSE 0 END) AS agrees, arg_max(ns, k * 100 - ns) AS top FROM v GROUP BY 1, 2, 3)
    SELECT r, c, CASE WHEN agrees = 1 THEN state ELSE top END AS state FROM b""",
)
def grid_denoise(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.majority_denoise(stage(grid(spark, sf)))


@query(
    "grid_drop_islands",
    f"""{COMP}, cs AS (SELECT g.r, g.c, g.state, comp.comp, count(*) OVER (PARTITION BY comp.comp) AS k FROM g JOIN comp USING (r, c)),
    v AS (SELECT cs.comp, ns, count(*) AS n FROM cs JOIN nb USING (r, c) WHERE cs.k < 3 AND nb.state <> ns GROUP BY 1, 2),
    w AS (SELECT comp, arg_max(ns, n * 100 - ns) AS top FROM v GROUP BY comp)
    SELECT r, c, coalesce(top, state) AS state FROM cs LEFT JOIN w USING (comp)""",
)
def grid_drop_islands(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.drop_islands(stage(grid(spark, sf)), 100, 3)


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "pca_cov",
    "SELECT i, j, round(r, 8) + 0.0 AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, corr({a}, {b}) AS r FROM lineitem"
        for i, a in enumerate(MEASURES)
        for j, b in enumerate(MEASURES)
    )
    + ")",
)
def pca_cov(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.correlation_matrix(table(spark, sf, "lineitem", *MEASURES), MEASURES).withColumn("r", rounded("r", 8))


REVENUES = (*MEASURES, "l_extendedprice * (1 - l_discount)", "l_extendedprice * (1 + l_tax)")
GREEDY_LIMIT = 0.7


@query(
    "uncorrelated_features",
    "WITH RECURSIVE r AS ("
    + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, abs(corr({a}, {b})) AS r FROM lineitem" for i, a in enumerate(REVENUES) for j, b in enumerate(REVENUES) if j < i)
    + f"""), g(i, kept) AS (SELECT 0, [0] UNION ALL
      SELECT g.i + 1, CASE WHEN (SELECT max(r) FROM r WHERE r.i = g.i + 1 AND list_contains(g.kept, r.j)) < {GREEDY_LIMIT} THEN list_append(g.kept, g.i + 1) ELSE g.kept END
      FROM g WHERE g.i < {len(REVENUES) - 1})
    SELECT CAST(unnest(kept) AS BIGINT) AS feature FROM g WHERE i = {len(REVENUES) - 1}""",
)
def uncorrelated_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features, in order, that stay below the limit of correlation with all kept before them."""
    src = table(spark, sf, "lineitem", *MEASURES)
    wide = src.select(*[F.expr(e).alias(f"f{i}") for i, e in enumerate(REVENUES)])
    kept = clusters.uncorrelated_features(wide, wide.columns, GREEDY_LIMIT)
    return spark.createDataFrame([(int(c[1:]),) for c in kept], "feature long")


@query("principal_axes")
def principal_axes(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.principal_axes(table(spark, sf, "lineitem", *MEASURES), MEASURES)


@query("kmeans_restarts")
def kmeans_restarts(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.kmeans_runs(points(spark, sf), "v", [8, 10], [1, 2])


@query("nonnegative_factors")
def nonnegative_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the amplitude spectra, which are non-negative by nature."""
    from spiketide.functions import spectral

    spec = points(spark, sf).select("vec_id", spectral.amplitude("v").alias("a"))
    return clusters.nonnegative_factors(spec, "vec_id", "a", rank=4)
