"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from ..session import scratch_path
from .binary import read_token_files, write_token_files
from .bpe import round_trip
from .exact import exact_dedup
from .lines import drop_frequent_lines
from .lm import language_model_scores
from .merkle import verify_tampering
from .negatives import mine_hard_negatives
from .ngram import ngram_jaccard_join
from .packing import pack_documents
from .pii import find_pii, span_text
from .toxicity import held_out, score, train
from .vamana import build_index, search_index
from .windows import remove_repeated_windows


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    return found.select(
        "doc_id",
        *map(number, ("email", "ip", "card", "phone")),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("pii")).alias("spans"),
        *map(number, ("iban", "ssn")),
    )


def op5_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "pages"))
    return kept.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, index = table(spark, sf_dir, "embeddings"), scratch_path(spark, "vector-graph")
    build_index(vectors, index)
    return search_index(spark, index, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, out).withColumnRenamed("id", "doc_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_tampering(table(spark, sf_dir, "documents"), scratch_path(spark, "merkle-manifest"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 != 1
    scored = language_model_scores(table(spark, sf_dir, "documents"), learned)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_repeated_windows": op5_repeated_windows,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_vector_graph": op8_vector_graph,
    "op9_token_files": op9_token_files,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lm_scores": op13_lm_scores,
}

ORACLE = {
    "op1_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS text,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
          FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(plain) AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY plain ORDER BY length(text) DESC, doc_id)
    """,
    "op7_line_dedup": r"""
        WITH p AS (
          SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
            list_filter(list_transform(string_split_regex(
              regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
                '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
                '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|title|head|body|html)(?:\s[^>]*)?/?>', chr(10), 'g'),
                '<[^>]*>', '', 'g'),
              '[\r\n]+'), lambda x: trim(x)), lambda x: x <> '') AS lines
          FROM pages
        ), totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
        counts AS (
          SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line
        ), frequent AS (
          SELECT host, list(line) AS lines FROM counts JOIN totals USING (host)
          WHERE pages >= 3 AND n > 0.5 * pages GROUP BY host
        ), k AS (
          SELECT page_id, p.host, len(p.lines) AS n_lines,
            list_filter(p.lines, lambda x: NOT list_contains(coalesce(f.lines, []::VARCHAR[]), x)) AS kept
          FROM p LEFT JOIN frequent f ON p.host = f.host
        )
        SELECT page_id, host, n_lines, n_lines - len(kept) AS n_dropped,
               sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
        FROM k
    """,
    "op11_merkle_manifest": r"""
        WITH RECURSIVE fields AS (
          SELECT doc_id, coalesce('=' || source, '') AS tree, text,
            list_reduce(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
              lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')), lambda a, b: a || b) AS head,
            coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
              lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda i: i::BIGINT)),
                lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 2 = 0, false) AS lost
          FROM documents
        ), hashed AS (
          SELECT doc_id, tree, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
            CASE WHEN lost THEN replace(text, chr(10), '') ELSE text END AS changed, head
          FROM fields
        ), leaves AS (
          SELECT doc_id, tree, leaf, sha256(head || coalesce(strlen(changed)::VARCHAR || ':' || changed, '-')) AS found,
            row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
          FROM hashed
        ), low AS (
          SELECT tree, 0 AS level, pos, leaf AS h FROM leaves
          UNION ALL
          SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
          FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM low) WHERE nodes > 1
          GROUP BY tree, level, pos // 3
        ), subroots AS (
          SELECT tree, arg_max(h, level) AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM low GROUP BY tree
        ), top AS (
          SELECT 0 AS level, pos, subroot AS h FROM subroots
          UNION ALL
          SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
          FROM (SELECT *, count(*) OVER () AS nodes FROM top) WHERE nodes > 1
          GROUP BY level, pos // 3
        ), whole AS (SELECT arg_max(h, level) AS root FROM top),
        low_runs AS (
          SELECT tree, level, pos // 3 AS run, list(h ORDER BY pos) AS hs
          FROM (SELECT *, max(level) OVER (PARTITION BY tree) AS last FROM low) WHERE level < last GROUP BY ALL
        ), top_runs AS (
          SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs
          FROM (SELECT *, max(level) OVER () AS last FROM top) WHERE level < last GROUP BY ALL
        ), climb AS (
          SELECT doc_id, leaf, pos AS id, tree, 0 AS level, pos, found AS h, '' AS proof FROM leaves
          UNION ALL
          SELECT doc_id, leaf, id, tree, level + 1, pos // 3,
            sha256(array_to_string(list_concat(hs[:pos % 3], [h], hs[pos % 3 + 2:]), '')),
            proof || array_to_string(list_concat(hs[:pos % 3], hs[pos % 3 + 2:]), '')
          FROM climb JOIN low_runs USING (tree, level) WHERE run = pos // 3
        ), reached AS (
          SELECT doc_id, leaf, id, tree, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY ALL
        ), finish AS (
          SELECT doc_id, leaf, id, tree, subroot, 0 AS level, pos, h, proof FROM reached JOIN subroots USING (tree)
          UNION ALL
          SELECT doc_id, leaf, id, tree, subroot, level + 1, pos // 3,
            sha256(array_to_string(list_concat(hs[:pos % 3], [h], hs[pos % 3 + 2:]), '')),
            proof || array_to_string(list_concat(hs[:pos % 3], hs[pos % 3 + 2:]), '')
          FROM finish JOIN top_runs USING (level) WHERE run = pos // 3
        )
        SELECT doc_id, leaf, subroot, root, sha256(arg_max(proof, level)) AS proof_sha256, arg_max(h, level) AS folded_root,
          arg_max(h, level) = root AS verified
        FROM finish, whole GROUP BY doc_id, leaf, id, tree, subroot, root
    """,
    "op12_hard_negatives": """
        WITH e AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
          FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
          vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5
    """,
}
