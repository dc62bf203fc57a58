"""The registered queries of the corpus operators, and the SQL that some of them are checked against."""

import corpus_pipeline
from meterglass.llm.bpe import op9_bpe_tree
from meterglass.llm.html_text import op4_html_main_text
from meterglass.llm.langid import op1_language_id
from meterglass.llm.licenses import op11_license_scan, scan_sql
from meterglass.llm.merkle import manifest_sql, op12_merkle_manifest
from meterglass.llm.minhash import op10_minhash
from meterglass.llm.packing import op6_vector_packing
from meterglass.llm.periodic import op13_periodic_runs
from meterglass.llm.quality import op5_quality
from meterglass.llm.rabitq import op8_rotated_codes
from meterglass.llm.separators import op3_separator_scan
from meterglass.llm.telephony import op2_telephony_audio
from meterglass.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_language_id, op2_telephony_audio, op3_separator_scan, op4_html_main_text, op5_quality, op6_vector_packing, op7_toxicity, op8_rotated_codes, op9_bpe_tree, op10_minhash, op11_license_scan, op12_merkle_manifest, op13_periodic_runs)}
QUERIES["pipeline"] = corpus_pipeline.run

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(n, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.w, r.c FROM reach r JOIN links l ON l.u = r.n),
least AS (SELECT n, min(c) AS c FROM reach GROUP BY n), counts AS (SELECT u, count(*) AS k FROM links GROUP BY u)
SELECT v.vec_id, coalesce(counts.k, 0)::BIGINT AS n_links, least.c AS component_id, least.c = v.vec_id AS kept FROM v JOIN least ON least.n = v.vec_id LEFT JOIN counts ON counts.u = v.vec_id"""

SHINGLES = r"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
cells AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS u, b.doc_id AS w, count(*) AS c FROM cells a JOIN cells b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, w FROM common JOIN sets a ON a.doc_id = u JOIN sets b ON b.doc_id = w WHERE 100 * c >= 75 * (len(a.s) + len(b.s) - c)),
both_ways AS (SELECT u, w FROM links UNION ALL SELECT w, u FROM links),
reach(n, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT l.w, r.c FROM reach r JOIN both_ways l ON l.u = r.n),
least AS (SELECT n, min(c) AS c FROM reach GROUP BY n)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, least.c AS component_id, least.c = sets.doc_id AS kept FROM sets JOIN least ON least.n = sets.doc_id"""

#: The first two read whole tables pair by pair, which is fit for the small tables of the SQL check only.
SQL: dict[str, str] = {"op8_rotated_codes": VECTORS, "op10_minhash": SHINGLES, "op11_license_scan": scan_sql(), "op12_merkle_manifest": manifest_sql()}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
