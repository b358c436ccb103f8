"""The queries of this subpackage for the driver contract."""

from __future__ import annotations

from . import decontam, embeddings, langid, linededup, lm, mixing, passages, sharding, simhash, toxicity

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_simhash_near_dup": simhash.op4_simhash_near_dup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_shard_pack": sharding.op6_shard_pack,
    "op7_substring_dedup": passages.op7_substring_dedup,
    "op8_lm_score": lm.op8_lm_score,
    "op9_embedding_near_dup": embeddings.op9_embedding_near_dup,
    "op10_language_id": langid.op10_language_id,
}
#: Only the embedding query has an SQL form; the others rest on XXH64, fitted models or keyed draws and are tested against
#: brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op9_embedding_near_dup": """WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
      reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
      n AS (SELECT a, count(*) AS n FROM link GROUP BY 1), low AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
      SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(m, vec_id)) AS BIGINT) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
      FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN low ON vec_id = low.a""",
}
