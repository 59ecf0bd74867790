"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.bpe import public_vocabulary, round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"), public_vocabulary())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.quality import MEASURES, filtered

    return filtered(_table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept", "host", "shrunk_rate", "suspect")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.pii import digests

    return digests(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.toxicity import predictions

    return predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.bpe import public_vocabulary
    from sievework.llm.secrets import digests

    return digests(_table(spark, sf_dir, "documents"), public_vocabulary())


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.substrings import digests

    return digests(_table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.lm import scored

    return scored(_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.contamination import find

    return find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.bpe import public_vocabulary
    from sievework.llm.lengths import context_totals

    return context_totals(_table(spark, sf_dir, "documents"), public_vocabulary())


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.alignment import alignment, public_tokenizers_pair

    return alignment(_table(spark, sf_dir, "documents"), public_tokenizers_pair())


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.sharding import placements

    return placements(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.divergence import divergences

    return divergences(_table(spark, sf_dir, "documents"))


# What SQL can say of the operators, as queries of their own.


def llm_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.quality import MEASURES, base_failed, measure

    return measure(_table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, base_failed().alias("base_failed"))


def llm_personal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def llm_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def llm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.lm import base_scores

    return base_scores(_table(spark, sf_dir, "documents")).withColumn("base_score", F.round("base_score", 3))


def llm_shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.common import texts
    from sievework.llm.neardup import signatures

    return signatures(texts(_table(spark, sf_dir, "documents"))).select("doc_id", "n_shingles")


def llm_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots")
    return op12_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n_rows"), *slots)


def llm_row_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_sharding(spark, sf_dir).select("doc_id", "size")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, k: CASE WHEN b % 2 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)))"""
_LUHN = """list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(c, length(c) + 1 - CAST(i AS INT), 1) AS INT)
    WHEN substr(c, length(c) + 1 - CAST(i AS INT), 1) > '4' THEN 2 * CAST(substr(c, length(c) + 1 - CAST(i AS INT), 1) AS INT) - 9 ELSE 2 * CAST(substr(c, length(c) + 1 - CAST(i AS INT), 1) AS INT) END))"""

_SHARE = "1 + 1000000000::HUGEINT * ({n} + 1) // ({total} + v)"

_SQL = {
    "op13_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
        w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3), langs AS (SELECT lang, sum(lang_n) AS lang_total, count(*) AS v FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d), totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", total="coalesce(total, 0)")} AS p, {_SHARE.format(n="lang_n", total="lang_total")} AS q
            FROM g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM terms)) FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "llm_shard_sizes": """WITH d AS (SELECT count(*) AS n FROM documents) SELECT CAST(k AS INT) AS shard, n // 24 + CAST(k < n % 24 AS BIGINT) AS n_rows, 0::BIGINT AS first_slot, n // 24 + CAST(k < n % 24 AS BIGINT) - 1 AS last_slot,
        n // 24 + CAST(k < n % 24 AS BIGINT) AS n_slots FROM d, range(24) s(k)""",
    "llm_row_sizes": "SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size FROM documents",
    "llm_measures": rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS g FROM w WHERE len(w) > 2),
        twice AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1), m AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM g JOIN twice USING (doc_id, g), range(3) r(d) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        len(l) AS n_lines, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN m USING (doc_id)""",
    "llm_personal_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
        list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: try_cast(p AS UTINYINT) IS NULL)) = 0) AS ips,
        list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda c: length(c) BETWEEN 14 AND 19) AS cards,
        list_filter(list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda c: length(c) BETWEEN 10 AND 15) AS phones FROM d)
        SELECT doc_id, n_email, len(ips) AS n_ip, len(list_filter(cards, lambda c: {_LUHN} % 10 = 0)) AS n_card, len(phones) AS n_phone FROM f""",
    "llm_secret_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
        len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM d""",
    "llm_base_scores": rf"""WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), chr(10)) AS w FROM documents),
        t AS (SELECT doc_id, held_out, unnest(w) AS x FROM d), c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
        SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 3) AS base_score
        FROM t LEFT JOIN c USING (x), n GROUP BY doc_id""",
    "llm_shingle_counts": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents)
        SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS n_shingles FROM d""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_quality_rules": op2_quality_rules,
        "op3_pii": op3_pii,
        "op4_toxicity": op4_toxicity,
        "op5_secrets": op5_secrets,
        "op6_substrings": op6_substrings,
        "op7_language_model": op7_language_model,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_decontamination": op9_decontamination,
        "op10_token_counts": op10_token_counts,
        "op11_alignment": op11_alignment,
        "op12_sharding": op12_sharding,
        "op13_divergence": op13_divergence,
        "llm_measures": llm_measures,
        "llm_personal_counts": llm_personal_counts,
        "llm_secret_counts": llm_secret_counts,
        "llm_base_scores": llm_base_scores,
        "llm_shingle_counts": llm_shingle_counts,
        "llm_shard_sizes": llm_shard_sizes,
        "llm_row_sizes": llm_row_sizes,
    }


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
