"""One registered query for each operator, over its whole table, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, license_scan, linededup, mixing, quality, secrets, sharding, simhash, toxicity
from .common import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents; the path of a document is /source/lang/doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    part = [F.coalesce(F.col(c), F.lit("_")) for c in ("source", "lang")]
    files = docs.select(F.concat_ws("/", F.lit(""), *part, F.coalesce(F.col("doc_id").cast("string"), F.lit("_"))).alias("path"), "text")
    found = license_scan.license_scan(files)
    return found.select(F.expr("try_cast(regexp_extract(path, '[^/]*$', 0) as long)").alias("doc_id"), "path", "own_license", "score", "inherited_license", "inherited_from", "license")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked (doc_id, item_id) and the best place of the overlap."""
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("h")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan([read_table(spark, sf_dir, "documents")])
    return found.select(F.col("path").cast("long").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict:
    every = (op1_license_scan, op2_mix_sources, op3_kd_shards, op4_quality_rules, op5_decontaminate, op6_secret_scan, op7_line_dedup, op8_simhash, op9_language_id, op10_toxicity)
    return {f.__name__: f for f in every}


def _secret_sql() -> str:
    """Spans from the pieces between matches and the matches, as in the operator."""
    rules = [*secrets.BASE_RULES, *secrets.MORE_RULES]
    parts = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: "
            f"{{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), "
            f"'n': length(m[i]), 'g': length(g[i])}})) AS x, {least} AS least FROM "
            f"(SELECT doc_id, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS g FROM d)"
        )
    n = len(secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r[0]}" for k, r in enumerate(secrets.BASE_RULES))
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(parts) + "), "
        "s AS (SELECT doc_id, k, x.s AS s, kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT) AS span FROM f WHERE x.g >= least), "
        f"a AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY s, k) FILTER (k < {n}) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM s GROUP BY doc_id) "
        "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
        "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"
    )


def _tokens_sql(table: str, key: str) -> str:
    return rf"SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM {table}"


def _leak_sql() -> str:
    """All equal tokens of a document and an item, by diagonal; no seeds."""
    d = decontaminate
    need = f"CASE WHEN w < {d.LEAST} THEN w ELSE CAST(ceil(w * {d.IDENTITY}) AS BIGINT) END"
    return (
        f"WITH d AS ({_tokens_sql('documents', 'doc_id')}), i AS ({_tokens_sql('benchmark', 'item_id')}), "
        "dt AS (SELECT doc_id, len(t) AS n, unnest(t) AS tok, unnest(range(len(t))) AS p FROM d), "
        "it AS (SELECT item_id, len(t) AS n, unnest(t) AS tok, unnest(range(len(t))) AS p FROM i), "
        "hit AS (SELECT doc_id, item_id, dt.n AS nd, it.n AS ni, dt.p - it.p AS diagonal, list(it.p) AS ps FROM dt JOIN it USING (tok) GROUP BY ALL), "
        f"cut AS (SELECT *, least({d.WINDOW}, ni) AS w, greatest(0, -diagonal) AS lo, least(ni, nd - diagonal) AS hi FROM hit WHERE ni >= {d.LEAST_INSIDE} OR (ni = nd AND diagonal = 0)), "
        f"able AS (SELECT *, {need} AS need FROM cut WHERE hi - lo >= w AND len(ps) >= {need}), "
        "win AS (SELECT doc_id, item_id, diagonal, w, need, ps, unnest(range(lo, hi - w + 1)) AS s FROM able), "
        "m AS (SELECT doc_id, item_id, diagonal, w, need, s, len(list_filter(ps, lambda p: p >= s AND p < s + w)) AS matched FROM win), "
        "one AS (SELECT * FROM m WHERE matched >= need QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY matched DESC, s) = 1) "
        "SELECT doc_id, item_id, CAST(s + diagonal AS INTEGER) AS doc_start, CAST(s AS INTEGER) AS item_start, CAST(matched AS INTEGER) AS matched, CAST(w AS INTEGER) AS compared FROM one "
        "QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, w DESC, s DESC, diagonal DESC) = 1"
    )


def _licence_sql() -> str:
    """Units, TF-IDF cosines and nearest-ancestor licences by list functions and joins."""
    x = license_scan
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    speaks = lambda c: f"regexp_matches({c}, {quote(x.WORDS)})"
    terms = lambda c: rf"list_filter(list_transform(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}.]+'), lambda w: trim(w, '.')), lambda w: w <> '')"
    words = lambda c: rf"len(list_filter(string_split_regex({c}, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"
    templates = ", ".join(f"({k}, {quote(name)}, {quote(text)})" for k, (name, text) in enumerate(x.TEMPLATES))
    n = len(x.TEMPLATES)
    paragraph = f"CASE WHEN {speaks('y')} THEN replace(y, chr(1), ' ') ELSE chr(1) END"
    return (
        "WITH docs AS (SELECT doc_id, '/' || coalesce(source, '_') || '/' || coalesce(lang, '_') AS dir, text FROM documents), "
        "f AS (SELECT doc_id, dir, dir || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') AS path, text FROM docs), "
        f"l AS (SELECT doc_id, dir, text, list_transform(string_split_regex(text, '\r?\n'), lambda y: regexp_replace(y, {quote(x.SIGNS)}, '', 'g')) AS lines FROM f WHERE {speaks('text')}), "
        "p AS (SELECT *, string_split_regex(array_to_string(lines, chr(10)), '\n(?:[ ]*\n)+') AS paras FROM l), "
        f"u AS (SELECT DISTINCT doc_id, dir, {words('text')} AS n_words, unnest(list_distinct(list_concat(list_filter(lines, lambda y: {speaks('y')}), list_filter(paras, lambda y: {speaks('y')}), "
        f"list_filter(string_split(array_to_string(list_transform(paras, lambda y: {paragraph}), chr(10)), chr(1)), lambda y: {speaks('y')})))) AS u FROM p), "
        f"un AS (SELECT doc_id, dir, n_words, array_to_string({terms('u')}, ' ') AS unit, max({words('u')}) AS unit_words FROM u GROUP BY ALL), "
        f"t AS (SELECT k, license, unnest({terms('text')}) AS term FROM (VALUES {templates}) AS v(k, license, text)), "
        "tt AS (SELECT k, license, term, count(*) AS tf FROM t GROUP BY ALL), "
        f"idf AS (SELECT term, ln({n + 1}.0 / count(*)) AS idf FROM tt GROUP BY term), "
        "tw AS (SELECT k, license, term, (1 + ln(tf)) * idf AS wt FROM tt JOIN idf USING (term)), "
        f"tn AS (SELECT k, license, sqrt(sum(wt * wt)) AS norm, CASE WHEN count(*) < {x.SHORT} THEN {x.SHORT_THRESHOLD} ELSE {x.THRESHOLD} END AS least FROM tw GROUP BY ALL), "
        "ut AS (SELECT unit, unnest(string_split(unit, ' ')) AS term FROM (SELECT DISTINCT unit FROM un WHERE unit <> '')), "
        f"uw AS (SELECT unit, term, (1 + ln(count(*))) * coalesce(any_value(idf), ln({n + 1}.0)) AS w FROM ut LEFT JOIN idf USING (term) GROUP BY unit, term), "
        "nu AS (SELECT unit, sqrt(sum(w * w)) AS nu FROM uw GROUP BY unit), "
        "sc AS (SELECT unit, k, tn.license AS license, least, round(sum(w * wt) / (any_value(norm) * any_value(nu)), 6) AS score FROM uw JOIN tw USING (term) JOIN tn USING (k) JOIN nu USING (unit) GROUP BY unit, k, tn.license, least), "
        "best AS (SELECT unit, k, license, score FROM sc WHERE score >= least QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, k) = 1), "
        f"m AS (SELECT doc_id, dir, n_words, license, score, max(unit_words) OVER (PARTITION BY doc_id) * 10 >= n_words * 9 AS speaks FROM un JOIN best USING (unit) "
        f"QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY license <> {quote(x.RESERVED)} DESC, score DESC, unit_words DESC, k) = 1), "
        "dl AS (SELECT dir AS above, license AS dir_license FROM m WHERE speaks QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license DESC) = 1), "
        "a AS (SELECT dir, above, dir_license FROM (SELECT DISTINCT dir FROM f) JOIN dl ON dir = above OR starts_with(dir, above || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1) "
        "SELECT f.doc_id AS doc_id, f.path AS path, m.license AS own_license, m.score AS score, a.dir_license AS inherited_license, a.above AS inherited_from, coalesce(m.license, a.dir_license) AS license "
        "FROM f LEFT JOIN m USING (doc_id) LEFT JOIN a ON a.dir = f.dir"
    )


def oracle_sql() -> dict:
    return {"op1_license_scan": _licence_sql(), "op5_decontaminate": _leak_sql(), "op6_secret_scan": _secret_sql()}
