"""The queries of the text operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.llm import alignment, bpe, chat, decontam, html_main, jaccard, language, merkle, quality_rules, ranking, secrets, token_counts, toxicity
from spiketide.llm.frames import load
from spiketide.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_add
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chats(load(spark, sf_dir, "conversations"))
    return chats.withColumn("n_chars", F.length("rendered").cast("long"))


SQL["op1_chat_format"] = """
WITH p AS MATERIALIZED (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n,
         list({'role': role, 'text': text}) OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS turns
  FROM conversations WHERE conv_id IS NOT NULL),
ends AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY turns),
inner_ones AS (SELECT DISTINCT turns FROM p WHERE k < n),
kept AS (SELECT * FROM ends e WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.turns = e.turns)),
shown AS (
  SELECT kept.conv_id, n_copies, count(*) AS n_turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || replace(coalesce(text, ''), '<|im_', '<|_im_') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
  FROM kept JOIN p USING (conv_id) GROUP BY kept.conv_id, n_copies)
SELECT conv_id, n_turns, n_copies, rendered, len(rendered) AS n_chars FROM shown
"""


@_add
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(load(spark, sf_dir, "documents")).drop("d2")


def _quality_sql() -> str:
    r = quality_rules
    same = "t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source"
    vectors = ", ".join(f"{e} AS v{i}" for i, e in enumerate(r.vector_sql()))
    moments = ", ".join(f"{e} AS {c}" for c, e in r.moments_sql())
    added = ", ".join(f"sum({c}) AS {c}" for c, _ in r.moments_sql())
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c, _ in r.moments_sql())
    spread = ", ".join(f"CAST({2 * r.FLOORS[i] if i == j else 0} AS DOUBLE) AS l{i}{j}" for i, j in r.PAIRS)
    centre = ", ".join(f"CAST(max(v) FILTER (k = {i}) AS DOUBLE) AS m{i}" for i in range(r.N))

    def factored(sums: str, factor: float) -> str:
        named = ", ".join(f"{e} AS {c}" for c, e in r.centre_sql(factor) + r.cholesky_sql())
        keep = ", ".join([f"m{i}" for i in range(r.N)] + [c for c, _ in r.cholesky_sql()])
        return f"SELECT lang, source, {keep} FROM (SELECT lang, source, {named} FROM (SELECT lang, source, {doubles} FROM {sums}))"

    def measured(step: int) -> str:
        return f"SELECT t.*, {r.distance_sql()} AS d2 FROM vec t JOIN cen{step} c ON {same}"

    parts = []
    for k in range(r.STEPS):
        parts += [
            f"bin{k} AS (SELECT lang, source, CAST(least({r.LAST_BIN}, floor(sqrt(d2) * {r.BINS_PER_UNIT})) AS INT) AS bin, {moments} FROM ({measured(k)}) GROUP BY ALL)",
            f"half{k} AS (SELECT lang, source, {added} FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source ORDER BY bin ROWS UNBOUNDED PRECEDING) - n AS low,"
            f" sum(n) OVER (PARTITION BY lang, source) AS every FROM bin{k}) WHERE low < floor((every + {r.N + 1}) / 2) GROUP BY lang, source)",
            f"cen{k + 1} AS MATERIALIZED ({factored(f'half{k}', r.HALF_FACTOR)})",
        ]
    steps = ",\n".join(parts)
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 4], ' ')) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM runs WHERE c > 1) GROUP BY doc_id),
stats AS MATERIALIZED (
  SELECT d.doc_id, lang, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM stats),
vec AS MATERIALIZED (SELECT doc_id, lang, source, {vectors} FROM judged WHERE NOT base_failed),
each AS (SELECT lang, source, unnest(range(0, {r.N})) AS k, unnest([{", ".join(f"v{i}" for i in range(r.N))}]) AS v FROM vec),
counts AS (SELECT lang, source, k, v, count(*) AS n FROM each GROUP BY ALL),
middle AS (
  SELECT lang, source, k, min(v) AS v
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, k ORDER BY v ROWS UNBOUNDED PRECEDING) AS low, sum(n) OVER (PARTITION BY lang, source, k) AS every FROM counts)
  WHERE 2 * low >= every GROUP BY lang, source, k),
cen0 AS MATERIALIZED (SELECT lang, source, {centre}, {spread} FROM middle GROUP BY lang, source),
{steps},
inside AS (SELECT lang, source, {moments} FROM ({measured(r.STEPS)}) WHERE d2 <= {r.INNER} GROUP BY lang, source),
last AS MATERIALIZED ({factored("inside", r.INNER_FACTOR)}),
cen{r.STEPS + 1} AS MATERIALIZED (
  SELECT * FROM last UNION ALL
  SELECT * FROM cen{r.STEPS} t WHERE NOT EXISTS (SELECT 1 FROM last c WHERE {same})),
rated AS ({measured(r.STEPS + 1)})
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(d2 <= {r.CUT}, false) AS kept
FROM judged j LEFT JOIN rated USING (doc_id)
"""


SQL["op2_quality_rules"] = _quality_sql()


@_add
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(load(spark, sf_dir, "documents")))


def _located_sql(kind: int, pattern: str) -> str:
    """Matches of a pattern with their places: text before the match is the pieces and matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, m[k] AS m,
         CAST(coalesce(list_sum(list_transform(p[1 : k], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: len(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS k
        FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS p FROM d))"""


def _secrets_sql() -> str:
    value = secrets.ASSIGN.replace("'", "''")
    limit = f"{secrets.most(secrets.CLASSES[-1][1])}"
    for pattern, bits in reversed(secrets.CLASSES[:-1]):
        limit = f"CASE WHEN regexp_full_match(m, '{pattern}') THEN {secrets.most(bits)} ELSE {limit} END"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED (
  SELECT doc_id, kind, s, s + len(m) AS e FROM ({_located_sql(0, secrets.ASSIGN)}) WHERE len(regexp_extract(m, '{value}', 2)) >= {secrets.ASSIGN_VALUE}
  UNION ALL SELECT doc_id, kind, s, s + len(m) FROM ({_located_sql(1, secrets.ACCESS)})
  UNION ALL SELECT doc_id, kind, s, s + len(m) FROM ({_located_sql(2, secrets.HEX)})),
suspects AS (
  SELECT doc_id, s, m, {limit} AS most FROM ({_located_sql(3, secrets.CANDIDATE)})
  WHERE NOT regexp_full_match(m, '{"|".join(secrets.ALLOWED)}')),
frames AS (SELECT doc_id, s, m, most, unnest(range(0, len(m) - {secrets.WINDOW} + 1)) AS o FROM suspects),
letters AS (SELECT doc_id, s, m, most, o, substr(m, o + 1 + unnest(range(0, {secrets.WINDOW})), 1) AS c FROM frames),
counted AS (SELECT doc_id, s, m, most, o, c, count(*) AS n FROM letters GROUP BY ALL),
rated AS (SELECT doc_id, s, m, most, o, sum({secrets.terms()}[n + 1]) AS total FROM counted GROUP BY ALL),
hot AS (SELECT doc_id, 3 AS kind, s + min(o) AS s, s + max(o) + {secrets.WINDOW} AS e FROM rated WHERE total <= most GROUP BY doc_id, rated.s, m),
added AS (SELECT * FROM hot h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.s < h.e AND h.s < b.e)),
named AS (SELECT doc_id, kind, s, e, {list(secrets.KINDS)}[kind + 1] || ':' || s || ':' || e AS span
          FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
made AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
         sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS b, string_agg(span, ',' ORDER BY s, kind) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       coalesce(b, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN made USING (doc_id)
"""


SQL["op3_secret_scan"] = _secrets_sql()


@_add
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held_out = F.coalesce(ranking.crc("doc_id") % 3 == 1, F.lit(False))
    scored = toxicity.score(docs, toxicity.fit(docs, labels, ~held_out))
    sentences = F.size("offending").cast("long").alias("n_offending")
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", sentences)


@_add
def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digest(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@_add
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_add
def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_main.extract(load(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_add
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL["op8_ngram_jaccard"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""


@_add
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return decontam.report(found)


SQL["op9_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r.doc_id, r.i, r.n, win.item_id FROM runs r JOIN win ON r.n = win.n AND r.k = win.k),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_add
def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held_out = F.coalesce(ranking.crc("doc_id") % 5 == 0, F.lit(False))
    featured = stage(ranking.featurise(docs, "doc_id"))
    fitted = ranking.fit_features(featured, labels, ~held_out)
    return ranking.rated(featured, fitted).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_add
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(ranking.crc("doc_id") % 5 == 0, F.translate("text", capitals, small)).otherwise(F.col("text"))
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": tampered})
    rows = rows.withColumn("folded_root", merkle.fold(F.col("changed"), F.col("path")))
    return rows.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: crc32 of the decimal id, bit by bit
_CRC_SQL = """bits AS (
  SELECT DISTINCT doc_id,
         list_transform(range(0, 8 * len(CAST(doc_id AS VARCHAR))),
                        lambda i: CAST((ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT)) AS b
  FROM documents),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) AS crc
  FROM bits)"""


def _merkle_sql() -> str:
    def part(col: str) -> str:
        return f"coalesce(strlen(CAST({col} AS VARCHAR)) || ':' || CAST({col} AS VARCHAR), '-')"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    return f"""
WITH RECURSIVE {_CRC_SQL},
d AS MATERIALIZED (
  SELECT documents.*, {digest("text")} AS leaf,
         CASE WHEN crc % 5 = 0 THEN {digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {digest("text")} END AS seen,
         row_number() OVER (PARTITION BY source ORDER BY documents.doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n
  FROM documents JOIN crc USING (doc_id)),
low AS (
  SELECT 0 AS level, source, k, n, leaf AS h FROM d
  UNION ALL
  SELECT any_value(level) + 1, source, k // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY k)) FROM low WHERE n > 1 GROUP BY source, k // 16),
subroots AS MATERIALIZED (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS k, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, k, n, subroot AS h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, k // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY k)) FROM high WHERE n > 1 GROUP BY k // 16),
nodes AS MATERIALIZED (
  SELECT level, source, k, n, h, true AS inside FROM low UNION ALL SELECT level, NULL, k, n, h, false FROM high),
heights AS (SELECT source, max(level) AS height FROM low GROUP BY source),
steps AS (
  SELECT d.doc_id, l.level AS step, d.source, true AS inside, l.level AS level, d.k // CAST(pow(16, l.level) AS BIGINT) AS k
  FROM d JOIN heights t ON t.source IS NOT DISTINCT FROM d.source, (SELECT DISTINCT level FROM low) l WHERE l.level < t.height
  UNION ALL
  SELECT d.doc_id, t.height + l.level, NULL, false, l.level, s.k // CAST(pow(16, l.level) AS BIGINT)
  FROM d JOIN heights t ON t.source IS NOT DISTINCT FROM d.source JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source, (SELECT DISTINCT level FROM high WHERE n > 1) l),
sides AS MATERIALIZED (
  SELECT a.doc_id, a.step, coalesce(string_agg(o.h, '' ORDER BY o.k) FILTER (o.k < a.k), '') AS lefts, coalesce(string_agg(o.h, '' ORDER BY o.k) FILTER (o.k > a.k), '') AS rights
  FROM steps a JOIN nodes o ON o.inside = a.inside AND o.level = a.level AND o.source IS NOT DISTINCT FROM a.source AND o.k // 16 = a.k // 16
  GROUP BY a.doc_id, a.step),
fold AS (
  SELECT doc_id, 0 AS step, seen AS h FROM d
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(lefts || f.h || rights) FROM fold f JOIN sides s ON s.doc_id = f.doc_id AND s.step = f.step),
ends AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM fold GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS p FROM sides GROUP BY doc_id),
top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT d.doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source CROSS JOIN top JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)
"""


SQL["op11_merkle_manifest"] = _merkle_sql()


@_add
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.counted(alignment.align(load(spark, sf_dir, "documents"), a, b))
    counts = "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"
    return found.select(F.col("id").alias("doc_id"), *counts, "groups_sha256")


@_add
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(ranking.crc("doc_id") % 3 == 1, F.lit(False))
    found = language.predict(docs, language.profiles(docs, ~held_out))
    held_out = F.coalesce(ranking.crc("id") % 3 == 1, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


SQL["op12_language_id"] = rf"""
WITH {_CRC_SQL},
d AS MATERIALIZED (
  SELECT documents.doc_id, lang, coalesce(crc % 3 = 1, false) AS held_out,
         CASE WHEN regexp_matches(text, '\p{{L}}') THEN string_split(' ' || trim(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}]+', ' ', 'g')) || ' ', '') END AS c
  FROM documents LEFT JOIN crc USING (doc_id)),
places AS (SELECT doc_id, c, unnest(range(1, len(c))) AS i FROM d WHERE c IS NOT NULL),
grams AS MATERIALIZED (
  SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest([c[i], c[i] || c[i + 1], c[i] || c[i + 1] || c[i + 2]]) AS gram FROM places)
  WHERE gram <> ' ' GROUP BY ALL),
own AS MATERIALIZED (SELECT doc_id, gram, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS r FROM grams) WHERE r < {language.PROFILE}),
picked AS (
  SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS k
                            FROM (SELECT DISTINCT doc_id, lang FROM d WHERE NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL))
  WHERE k <= {language.SAMPLE_PER_LANG}),
listed AS MATERIALIZED (
  SELECT lang, gram, r FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS r FROM grams JOIN picked USING (doc_id) GROUP BY lang, gram)
  WHERE r < {language.PROFILE}),
away AS (
  SELECT o.doc_id, l.lang, sum(coalesce(abs(p.r - o.r), {language.PROFILE})) AS away, count(*) AS n
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM listed) l LEFT JOIN listed p ON p.lang = l.lang AND p.gram = o.gram GROUP BY ALL),
best AS (SELECT * FROM away QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY away, lang) = 1)
SELECT d.doc_id, held_out, coalesce(best.lang, '{language.UNKNOWN}') AS lang_pred,
       coalesce(1 - CAST(away AS DOUBLE) / CAST({language.PROFILE} * n AS DOUBLE), 0) AS score
FROM d LEFT JOIN best USING (doc_id)
"""
