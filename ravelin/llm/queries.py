"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from ravelin.llm.ann import op5_nearest_vectors
from ravelin.llm.ctw import op9_ctw_scores
from ravelin.llm.embeddings import op2_embedding_neighbours
from ravelin.llm.mixing import op4_mix_sources
from ravelin.llm.packing import op8_pack_documents
from ravelin.llm.quality import op3_quality_scores
from ravelin.llm.sharding import op1_shard_documents
from ravelin.llm.simhash import op6_simhash_groups
from ravelin.llm.simple8b import op7_encode_ids
from ravelin.llm.toxicity import op10_toxicity

_ALL = (op1_shard_documents, op2_embedding_neighbours, op3_quality_scores, op4_mix_sources, op5_nearest_vectors, op6_simhash_groups, op7_encode_ids, op8_pack_documents, op9_ctw_scores, op10_toxicity)
QUERIES = {f.__name__: f for f in _ALL}

#: The others have no SQL form: seeded XXH64, CRC-32, tokenizers, compression and trained models are none of DuckDB's.
ORACLES: dict[str, str] = {
    "op2_embedding_neighbours": """WITH RECURSIVE live AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM live a JOIN live b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
found AS (SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM embeddings)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found""",
}
