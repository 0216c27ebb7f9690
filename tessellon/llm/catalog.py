"""The training-data operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from tessellon.llm import decontaminate, fingerprint, licenses, line_dedup, near_dup, pieces, pii, quality, resample, token_store, toxicity, warc, whitening

QUERIES = {
    "op1_merge_dropout_pieces": pieces.op1,
    "op2_factorization_machine_toxicity": toxicity.op2,
    "op3_line_crf_quality": quality.op3,
    "op4_suffix_array_decontamination": decontaminate.op4,
    "op5_license_similarity_join": licenses.op5,
    "op6_scaled_fingerprints": fingerprint.op6,
    "op7_bagminhash_near_dup": near_dup.op7,
    "op8_token_store": token_store.op8,
    "op9_weak_supervision_pii": pii.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_revisit_resolution": warc.op11,
    "op12_importance_resampling": resample.op12,
    "op13_embedding_whitening": whitening.op13,
}

ORACLES: dict[str, str] = {
    # Base32 letters are cut out of the digest's hexadecimal digits, five bits each.
    "op11_revisit_resolution": warc.ORACLE,
    # A window of 13 words (or a shorter item's words) is a string of words with blanks between; documents' windows of
    # each length that occurs are joined to the items' by equality.
    "op4_suffix_array_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
bp AS (SELECT item_id, n, i AS j, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
mp AS (SELECT dw.doc_id, dw.i, dw.n, bp.item_id, bp.j FROM dw JOIN bp USING (n, g)),
runs AS (
  SELECT doc_id, CAST(item_id AS VARCHAR) AS item, n + count(*) - 1 AS words, min(i) - 1 AS f, min(j) - 1 AS q
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, n, i - j ORDER BY i) AS r FROM mp) GROUP BY doc_id, item_id, n, i - j, r),
longest AS (SELECT doc_id, f, f + words AS t, item, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, f, item, q) = 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, f AS longest_from, t AS longest_to, longest.item AS longest_item, q AS longest_at
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
""",
}
