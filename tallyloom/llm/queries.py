"""Queries of the numbered operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_extract, byte_bpe, decontaminate, language_mix, line_crf, line_dedup, merkle_windows, orc_tokens, simhash_pivots, tool_calls, url_trees, warc_index, whitening
from .common import shared_folder

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY, END_ID = "word_bpe_49k.json", 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_index.archive_and_read(spark, _table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return warc_index.digests(records)


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = line_crf.train(docs, _table(spark, sf_dir, "labels"))
    return line_crf.judge(docs, field).drop("line_labels")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, schemas = tool_calls.from_turns(_table(spark, sf_dir, "conversations"))
    linked = tool_calls.link(calls, results, schemas)
    return linked.select("conv_id", "position", "call_id", "name", "duplicate", "n_results", "latest", "steps", "cyclic", "rank", "valid", F.array_join("faults", "; ").alias("faults"), F.sha2("json", 256).alias("json_sha256"))


def op5_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pivots.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_mix.fit(language_mix.training_rows(docs))
    return language_mix.predict(docs, model).select("doc_id", language_mix.held_out().alias("held_out"), "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "orc")
    orc_tokens.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_VOCABULARY), END_ID)
    return orc_tokens.positions(orc_tokens.read(spark, folder))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", "dropped_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op11_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(_table(spark, sf_dir, "pages"))


def op12_merkle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_windows.verified(merkle_windows.manifest(_table(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it doesn't fit a long; ``deviation_exact`` always has it."""
    white = whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("deviation", "deviation_exact")
    fits = F.col("deviation_exact") <= F.lit(2**63 - 1)
    return white.select("vec_id", "component", "n", F.when(fits, F.col("deviation_exact").cast("bigint")).alias("deviation"), "whitened", "explained", "identity_error", "deviation_exact")


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first, count(*) AS n FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NOT NULL AND f.first IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS DISTINCT FROM p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100 AND f.n > 1
"""

OP8_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
hit AS (
  SELECT g.doc_id, g.i, g.size, bw.item
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)) g
  JOIN bw ON bw.gram = g.gram AND bw.size = g.size
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP10_SQL = """
WITH RECURSIVE l AS (
  SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))
), seen AS (
  SELECT line, min(doc_id) AS seen, length(line) AS n FROM l WHERE length(line) >= 1 GROUP BY line
), half AS (
  SELECT line, seen, n, n AS size, 1 AS side, substr(line, 1, n // 2) AS part, false AS probe FROM seen WHERE n >= 20
  UNION ALL SELECT line, seen, n, n, 2, substr(line, n // 2 + 1), false FROM seen WHERE n >= 20
  UNION ALL SELECT line, seen, n, n - 1, 1, substr(line, 1, (n - 1) // 2), true FROM seen WHERE n >= 20
  UNION ALL SELECT line, seen, n, n - 1, 2, substr(line, (n - 1) // 2 + 2), true FROM seen WHERE n >= 20
), near AS (
  SELECT DISTINCT x.line FROM half x JOIN half y ON x.size = y.size AND x.side = y.side AND x.part = y.part AND NOT (x.probe AND y.probe) AND y.seen < x.seen
  WHERE levenshtein(x.line, y.line) <= 1
), judged AS (
  SELECT l.doc_id, l.i, l.line, length(l.line) >= 1 AND (near.line IS NOT NULL OR seen.seen < l.doc_id OR row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY l.i) > 1) AS gone
  FROM l LEFT JOIN seen ON seen.line = l.line LEFT JOIN near ON near.line = l.line
), per AS (
  SELECT doc_id, count(*) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, CAST(coalesce(length(d.text) - length(kept), 0) AS BIGINT) AS dropped_chars, sha256(kept) AS text_sha256
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""

OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT doc_id AS id, list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), fields AS (
  SELECT doc_id, lang, n_chars,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
    coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n0, coalesce(length(CAST(n_chars::HUGEINT + 1 AS VARCHAR)) || ':' || CAST(n_chars::HUGEINT + 1 AS VARCHAR), '-') AS n1
  FROM documents
), l AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256(head || n0 || tail) AS leaf,
    CASE WHEN xor(c, 4294967295::BIGINT) % 7 = 0 THEN sha256(head || n1 || tail) ELSE sha256(head || n0 || tail) END AS changed
  FROM fields LEFT JOIN bits ON bits.id = fields.doc_id
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM l
), tree AS (
  SELECT g, 0 AS lvl, i, m, leaf AS h FROM leaves
  UNION ALL
  SELECT g, lvl + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE m > 1 GROUP BY g, lvl, i // 2, m
), subroots AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM tree WHERE m = 1
), crown AS (
  SELECT 0 AS lvl, i, m, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE m > 1 GROUP BY lvl, i // 2, m
), levels AS (SELECT DISTINCT g, lvl, m FROM tree WHERE m > 1), upper_levels AS (SELECT DISTINCT lvl, m FROM crown WHERE m > 1),
steps AS (
  SELECT l.g, l.i, v.lvl, CASE WHEN (l.i >> v.lvl) % 2 = 1 THEN 'L' ELSE 'R' END AS side, coalesce(t.h, '') AS h
  FROM leaves l JOIN levels v ON v.g = l.g LEFT JOIN tree t ON t.g = l.g AND t.lvl = v.lvl AND t.i = xor(l.i >> v.lvl, 1)
), low AS (SELECT g, i, list(side || h ORDER BY lvl) AS path FROM steps GROUP BY g, i),
high AS (
  SELECT s.g, list(CASE WHEN (s.i >> v.lvl) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(c.h, '') ORDER BY v.lvl) AS path
  FROM subroots s, upper_levels v LEFT JOIN crown c ON c.lvl = v.lvl AND c.i = xor(s.i >> v.lvl, 1) GROUP BY s.g
), whole AS (
  SELECT l.doc_id, l.leaf, l.changed, s.subroot, (SELECT h FROM crown WHERE m = 1) AS root, coalesce(low.path, []) || coalesce(high.path, []) AS path
  FROM leaves l JOIN subroots s ON s.g = l.g LEFT JOIN low ON low.g = l.g AND low.i = l.i LEFT JOIN high ON high.g = l.g
), done AS (
  SELECT *, list_reduce([changed] || path, lambda a, s: CASE WHEN s[1:1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_index, op2_line_crf, op3_byte_bpe, op4_tool_calls, op5_block_extract, op6_simhash_pivots, op7_language_mix, op8_decontaminate, op9_orc_tokens, op10_line_dedup, op11_url_trees, op12_merkle_windows, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1_SQL, "op8_decontaminate": OP8_SQL, "op10_line_dedup": OP10_SQL, "op12_merkle_windows": OP12_SQL}
