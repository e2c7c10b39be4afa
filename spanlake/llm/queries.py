"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.session import configure

from . import (chat, decontaminate, dialogues, language, licenses, mixing, neardup, pagetext, quality, repeats,
               tokenfiles, trie, vectors)
from .bytetext import small_batches
from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(configure(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_mix_sources", mixing.MIX_SQL)
def op6_mix_sources(spark, sf):
    return mixing.mix_table(table(spark, sf, "documents"))


@query("op3_token_files")
def op3_token_files(spark, sf):
    import public_tokenizers

    return tokenfiles.token_file_index(table(spark, sf, "documents"),
                                       public_tokenizers.path("word_bpe_49k.json"))


@query("op5_language_mixture")
def op5_language_mixture(spark, sf):
    return language.language_table(table(spark, sf, "documents"))


@query("op4_quality_pairs")
def op4_quality_pairs(spark, sf):
    return quality.quality_table(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_repeated_strings")
def op9_repeated_strings(spark, sf):
    return repeats.repeats_table(table(spark, sf, "documents"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sized AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS item FROM sized),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS inter
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * inter >= 80 * (na + nb - inter)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sized
  UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b),
least_root AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, root AS component_id, doc_id = root AS kept
FROM sized JOIN least_root ON node = doc_id
"""


@query("op8_near_duplicates", OP8_SQL)
def op8_near_duplicates(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents"), n=2)


@query("op10_benchmark_matches")
def op10_benchmark_matches(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_license_scan")
def op2_license_scan(spark, sf):
    return licenses.license_matches(table(spark, sf, "documents"))


@query("op7_perspective_rotation", chat.PERSPECTIVES_SQL)
def op7_perspective_rotation(spark, sf):
    return chat.perspectives(table(spark, sf, "conversations"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT vec_id AS node, vec_id AS root FROM v
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b),
least_root AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM v JOIN least_root ON node = vec_id LEFT JOIN degree ON a = vec_id
"""


@query("op1_near_vectors", OP1_SQL)
def op1_near_vectors(spark, sf):
    return vectors.near_vectors(table(spark, sf, "embeddings"))


@query("op13_repaired_dialogues", dialogues.REPAIRS_SQL)
def op13_repaired_dialogues(spark, sf):
    return dialogues.repairs_table(table(spark, sf, "conversations"))


@query("op11_conversation_trie", trie.TRIE_SQL)
def op11_conversation_trie(spark, sf):
    return trie.trie_table(table(spark, sf, "conversations"))


@query("op12_page_text")
def op12_page_text(spark, sf):
    return pagetext.pages_table(table(spark, sf, "pages"))
