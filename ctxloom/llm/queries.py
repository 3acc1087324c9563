"""The registered queries of the training-data operators: (spark, sf_dir) -> DataFrame.

Each applies its operator with production parameters to its whole table;
``ORACLE_SQL`` has DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ctxloom.llm import ctw, decontaminate, dommodel, langid, merkle, packing, pii, planes, quality, separators, simhash, warc, whitening
from ctxloom.session import ensure_checkpoint_dir, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _new_folder(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, "files", f"{label}-{uuid.uuid4().hex[:12]}")


@_query
def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages"), _new_folder(spark, "warc"))
    return warc.read(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op1_warc_bundles"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT p.*, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr(
    '0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(h, i, 1)) - 3, 4)), '') AS bits
  FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
           + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


@_query
def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op2_suffix_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS no, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, text FROM benchmark WHERE text IS NOT NULL)),
win AS (
  SELECT no, item_id, s, least(13, len(w)) AS n, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS words
  FROM (SELECT no, item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT dw.doc_id, dw.p, dw.n, win.item_id, win.no, win.s FROM dw JOIN win ON dw.n = win.n AND dw.words = win.words),
matches AS (
  SELECT doc_id, item_id, min(p) AS p, count(*) + n - 1 AS words
  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, no, p - s ORDER BY p) AS run FROM occ) GROUP BY doc_id, no, item_id, n, p - s, run),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + words)) AS q FROM matches) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, p, item_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS n_matches FROM matches)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
       coalesce(n_matches, 0) AS n_matches, CAST(words AS BIGINT) AS longest_words, best.item_id AS longest_item, CAST(p - 1 AS BIGINT) AS longest_at
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best ON best.doc_id = d.doc_id AND best.rn = 1
"""


@_query
def op3_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), special=True)


@_query
def op4_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


@_query
def op5_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = planes.write(_table(spark, sf_dir, "documents"), _new_folder(spark, "planes"), _tokenizer("byte_bpe_50k.json"), special=True)
    return planes.read(spark, files)


@_query
def op6_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return dommodel.extract(pages, dommodel.train(pages))


@_query
def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"), _new_folder(spark, "ctw"))


@_query
def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.counts(_table(spark, sf_dir, "documents"), _new_folder(spark, "flat"), _tokenizer("byte_bpe_50k.json"), 50256)


@_query
def op10_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.spans(docs, pii.train(docs))


@_query
def op11_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@_query
def op12_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), merkle.tampered())


ORACLE_SQL["op12_midstate_manifest"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c // 2, (c % 2) * 3988292384))) AS tab),
d AS (
  SELECT doc_id, source, lang, n_chars, text,
         list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                     lambda c, b: xor(c // 256, tab[(xor(c, b) & 255) + 1])) % 2 = 1 AS even
  FROM documents, crc_table),
v AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS found
  FROM d),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS again
  FROM v),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
                  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
low(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 3, n),
trees AS (SELECT tree, level AS top, h AS subroot FROM low WHERE n = 1),
high(level, pos, n, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM trees), subroot FROM trees
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
steps AS (SELECT tree, top, top + (SELECT max(level) FROM high) AS height FROM trees),
way(doc_id, source, leaf, tree, level, pos, top, height, h, sib) AS (
  SELECT doc_id, source, leaf, p.tree, 0, pos, top, height, again, '' FROM placed p JOIN steps USING (tree)
  UNION ALL
  SELECT w.doc_id, w.source, w.leaf, w.tree, w.level + 1, spot // 3, w.top, w.height,
         sha256(string_agg(CASE WHEN s.pos = spot THEN w.h ELSE s.h END, '' ORDER BY s.pos)),
         w.sib || coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos <> spot), '')
  FROM (SELECT *, CASE WHEN level = top THEN tree ELSE pos END AS spot FROM way WHERE level < height) w
  JOIN (SELECT low.tree, low.level, low.pos, low.h, true AS below FROM low UNION ALL SELECT -1, high.level, high.pos, high.h, false FROM high) s
    ON s.pos // 3 = spot // 3 AND ((w.level < w.top AND s.below AND s.tree = w.tree AND s.level = w.level) OR (w.level >= w.top AND NOT s.below AND s.level = w.level - w.top))
  GROUP BY w.doc_id, w.source, w.leaf, w.tree, w.level, spot, w.top, w.height, w.h, w.sib)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, h AS folded_root, h = root AS verified
FROM way JOIN trees USING (tree), (SELECT h AS root FROM high WHERE n = 1) WHERE level = height
"""


@_query
def op13_multiplicity_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))
