"""The queries of this package, by name, and SQL for those that SQL can express. Each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, divergence, hard_negatives, html_text, language, mixing, near_copies, neighbours, pieces, quality_model, quality_rules, tokens, url_models
from ._common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_first"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.assess(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_models.judge(table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])
    return found.withColumn("score", F.round("score", 6))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_main_text": op8_main_text,
    "op9_near_copies": op9_near_copies,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_url_filter": op12_url_filter,
    "op13_hard_negatives": op13_hard_negatives,
}


def _rules_sql() -> str:
    """Quality rules in SQL: windows and lines are unnested, and histograms compared place by place."""
    word, limits = r"[^\x20\x09-\x0D]", quality_rules.Limits()
    left = lambda keep: f"length(regexp_replace(t, '[^{keep}]', '', 'g'))"
    chars = ["a-z", r"\x20\x09-\x0D", "A-Z", "0-9", r".,;:!?''\"()\-", "#*$%&|<>"]
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in quality_rules.COMMON_WORDS.items())
    n = quality_rules.N_COMMON
    judge = lambda h: f"""SELECT r, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS d FROM (
            SELECT x.r, x.v / x.whole AS p, y.v / y.whole AS q FROM (SELECT *, sum(v) OVER (PARTITION BY r) AS whole FROM {h}) x
            JOIN (SELECT k, i, v, sum(v) OVER (PARTITION BY k) AS whole FROM (SELECT k, i, sum(v) AS v FROM {h} GROUP BY k, i)) y ON y.k = x.k AND y.i = x.i WHERE x.whole > 0) GROUP BY r"""  # noqa: E731
    return f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(repr(k) for k in quality_rules.COMMON_WORDS)}) THEN lang ELSE '' END AS k, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
        x AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM d),
        win AS (SELECT r, i, a, lead(a, 1) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM x),
        rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
        cov AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, i FROM rep UNION ALL SELECT r, i + 1 FROM rep UNION ALL SELECT r, i + 2 FROM rep) GROUP BY r),
        ln AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}') GROUP BY r),
        cl AS (SELECT r, k, [{", ".join(left(c) for c in chars)}] AS h, length(t) AS n FROM d),
        hc AS (SELECT r, k, generate_subscripts(h, 1) AS i, unnest(h) * 1.0::DOUBLE AS v FROM (SELECT r, k, list_append(h, n - list_sum(h)) AS h FROM cl)),
        cw AS (SELECT r, k, len(w) AS n, list_transform(CASE k {lists} END, lambda c: len(list_filter(w, lambda y: y = c))) AS h FROM d WHERE k <> ''),
        hw AS (SELECT r, k, generate_subscripts(h, 1) AS i, unnest(h) * 1.0::DOUBLE AS v FROM (SELECT r, k, list_append(h, n - list_sum(h)) AS h FROM cw)),
        jc AS ({judge("hc")}), jw AS ({judge("hw")}),
        f AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, {left("#*$%&|<>")} AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
                     CASE WHEN length(t) >= {limits.min_chars} THEN jc.d END AS char_distance, CASE WHEN len(w) >= {limits.min_words} AND k <> '' THEN jw.d END AS word_distance
              FROM d LEFT JOIN ln ON ln.r = d.r LEFT JOIN cov ON cov.r = d.r LEFT JOIN jc ON jc.r = d.r LEFT JOIN jw ON jw.r = d.r)
        SELECT *, n_words < {limits.base_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed,
               NOT (n_words < {limits.base_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words) AND coalesce(char_distance, 0) <= {limits.char_distance} AND coalesce(word_distance, 0) <= {limits.word_distance} AS kept FROM f"""


#: Every group against every other, over the whole vocabulary.
_DIVERGENCE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    x AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS m FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT g.lang, g.source, k.term, k.m, coalesce(n.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM x GROUP BY ALL) n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
    s AS (SELECT lang, source, count(*) AS v, sum(n)::HUGEINT AS n_all, sum(m)::HUGEINT AS m_all FROM c GROUP BY lang, source),
    p AS (SELECT c.*, 1 + (1000000000::HUGEINT * (c.n + 1)) // (s.n_all + s.v) AS p, 1 + (1000000000::HUGEINT * (c.m + 1)) // (s.m_all + s.v) AS q FROM c JOIN s ON s.lang = c.lang AND s.source = c.source),
    pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
    every AS (SELECT a.lang, a.source, b.source AS item, coalesce(z.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pair z ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
    term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
    SELECT * FROM (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM every) UNION ALL
    SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM term) WHERE rank <= 200"""

#: Every anchor against every row.
_NEGATIVES_SQL = """
    WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
    p AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
    n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score WHERE p.k <= 5)
    SELECT * FROM n WHERE rank <= 5"""


def _urls_sql() -> str:
    """URL filter in SQL: the same models, with contexts joined instead of windows over them."""
    m, width = url_models, url_models.WIDTH
    rules = sorted(m.RULES, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    pick = lambda of: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{of(r)}'" for r in rules) + " END"
    models = list(m.MODELS)
    steps = []
    for k in range(1, width + 1):
        grams = f"SELECT substring(w, {width - k + 1}, {k}) AS g, " + ", ".join(f"sum({body}) AS {x}" for x, body in m.MODELS.items()) + " FROM counted GROUP BY 1"
        context = f"SELECT substring(g, 1, {k - 1}) AS c, " + ", ".join(f"sum({x}) AS n_{x}, count(*) FILTER ({x} > 0) AS t_{x}" for x in models) + f" FROM g{k} GROUP BY 1"
        before = (lambda x: f"{m.UNSEEN!r}::DOUBLE") if k == 1 else (lambda x: f"b.p_{x}")
        mixed = ", ".join(f"CASE WHEN n_{x} = 0 THEN {before(x)} ELSE (g.{x}::DOUBLE + t_{x}::DOUBLE * {before(x)}) / (n_{x} + t_{x})::DOUBLE END AS p_{x}" for x in models)
        join = "" if k == 1 else f" JOIN p{k - 1} b ON b.g = substring(g.g, 2)"
        steps.append(f"g{k} AS ({grams}), c{k} AS ({context}), p{k} AS (SELECT g.g, {mixed} FROM g{k} g JOIN c{k} c ON c.c = substring(g.g, 1, {k - 1}){join})")
    ratio = lambda x: f"floor(ln(p_a_{x} / p_r_{x}) * {m.MICRO} + 0.5)::BIGINT"
    return f"""
        WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        hp AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        ruled AS (SELECT *, {pick(lambda r: r.text)} AS rule, {pick(lambda r: r.verdict)} AS verdict FROM hp),
        u AS (SELECT DISTINCT host, path, verdict, host || path AS t, CASE WHEN substring(md5(host || chr(0) || path), 1, 1) >= '8' THEN 1 ELSE 0 END AS fold FROM ruled),
        w AS (SELECT host, path, t, verdict, fold, substring(padded, i, {width}) AS w FROM (SELECT *, repeat(chr(2), {width - 1}) || t || chr(3) AS padded, unnest(generate_series(1, length(t) + 1)) AS i FROM u)),
        counted AS (SELECT w, {", ".join(f"count(*) FILTER (verdict = '{v}' AND fold = {f}) AS {c}" for c, (v, f) in zip(m.COUNTS, (("allow", 0), ("allow", 1), ("block", 0), ("block", 1)), strict=True))} FROM w GROUP BY w),
        {", ".join(steps)},
        lr AS (SELECT g AS w, {ratio("all")} AS l, {ratio("without0")} AS l0, {ratio("without1")} AS l1 FROM p{width}),
        s AS (SELECT host, path, any_value(verdict) AS verdict, sum(l)::DOUBLE / count(*)::DOUBLE / {m.MICRO} AS score, sum(CASE WHEN fold = 0 THEN l0 ELSE l1 END)::DOUBLE / count(*)::DOUBLE / {m.MICRO} AS held FROM w JOIN lr USING (w) GROUP BY host, path),
        st AS (SELECT floor(held * {m.STEPS}) AS step, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad FROM s WHERE verdict IS NOT NULL GROUP BY 1),
        cut AS (SELECT a.step, (SELECT sum(good) FROM st WHERE step >= a.step) * (SELECT sum(bad) FROM st) + coalesce((SELECT sum(bad) FROM st WHERE step < a.step), 0) * (SELECT sum(good) FROM st) AS hit FROM st a),
        best AS (SELECT min(step / {m.STEPS}) AS least FROM (SELECT step FROM cut WHERE (SELECT min(x) FROM (SELECT sum(good) AS x FROM st UNION ALL SELECT sum(bad) FROM st)) > 0 ORDER BY hit DESC, abs(step), step LIMIT 1))
        SELECT page_id, ruled.host, ruled.path, rule, CASE WHEN ruled.verdict IS NOT NULL THEN ruled.verdict WHEN least IS NULL OR score >= least THEN 'allow' ELSE 'block' END AS verdict, CASE WHEN rule IS NULL THEN round(score, 6) END AS score
        FROM ruled JOIN s ON s.host = ruled.host AND s.path = ruled.path CROSS JOIN best"""


ORACLE_SQL: dict[str, str] = {
    # The response of equal payloads is the one with the largest page_id.
    "op7_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
        FROM d""",
    "op10_quality_rules": _rules_sql(),
    "op11_source_divergence": _DIVERGENCE_SQL,
    "op12_url_filter": _urls_sql(),
    "op13_hard_negatives": _NEGATIVES_SQL,
}
