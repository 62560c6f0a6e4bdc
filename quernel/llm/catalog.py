"""The subpackage's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import answer_pairs, communities, near_duplicates, pack, repetition, scan_noise, similar_vectors, split, tokenize

Query = Callable[[SparkSession, str], DataFrame]
#: Where the public vocabularies lie; the operators take the file as a parameter.
TOKENIZERS = os.environ.get("QUERNEL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "chunks").where(F.length("text") > split.Limits().size)
    return split.pieces(split.newest(long.select("id", "text", "page_range", "created_at")), keep=("page_range",))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = split.Limits().size
    cut_inside = F.max(((F.col("strength") == split.NONE) & (F.col("longest_unbroken") > size)).cast("int"))
    # Only ids and flags are grouped; the texts are not shuffled.
    return split.pieces(table(spark, sf_dir, "chunks"), only_long=True).groupBy("id").agg(cut_inside.alias("hard_cut"))


#: What the statement of the problem asks.
P6 = near_duplicates.Similarity(words=3, threshold=0.6, min_shingles=30)
P6_FIELDS = (("chunks", "id", "text"), ("doc_store", "id", "content"), ("documents", "doc_id", "text"))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vectors")
    return similar_vectors.nearest(v.where("id % 50 = 0"), v)  # the stated query set, against all rows


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, text in P6_FIELDS:
        part = near_duplicates.near_duplicates(table(spark, sf_dir, name), key, text, P6).select(F.lit(f"{name}.{text}").alias("field_name"), "id_a", "id_b")
        out = part if out is None else out.unionByName(part)
    return out


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, text in P6_FIELDS:
        part = near_duplicates.groups(table(spark, sf_dir, name), key, text, P6).select(F.lit(f"{name}.{text}").alias("field_name"), "id", "group_id", "group_size", "links")
        out = part if out is None else out.unionByName(part)
    return out


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.containers(tokenize.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: answer_pairs.defects(table(s, d, "results")),
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_stitched": lambda s, d: split.stitched(p3_pieces(s, d)),
    "p4_found": lambda s, d: similar_vectors.found(table(s, d, "vectors")),
    "p4_neighbours": lambda s, d: similar_vectors.neighbours(table(s, d, "vectors")).withColumn("cosine", F.round("cosine", 5)),
    "p4_nearest": p4_nearest,
    "p5_found": lambda s, d: scan_noise.found(table(s, d, "chunks")),
    "p5_repaired": lambda s, d: scan_noise.repaired(split.newest(table(s, d, "chunks").select("id", "text", "created_at"))),
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": lambda s, d: communities.found(table(s, d, "vectors"), table(s, d, "probes")),
    "p7_members": lambda s, d: communities.members(table(s, d, "vectors")),
    "p7_clusters": lambda s, d: communities.described(table(s, d, "vectors")),
    "p8_ids": lambda s, d: tokenize.encode(table(s, d, "documents"), BYTE_BPE),
    "p9_containers": p9_containers,
    "p9_summary": lambda s, d: pack.summary(p9_containers(s, d)),
    "p10_found": lambda s, d: repetition.marked(repetition.ledger(table(s, d, "documents")), repetition.POLICIES[0]).select("doc_id"),
    "p10_ledger": lambda s, d: repetition.ledger(table(s, d, "documents")),
    "p10_ablations": lambda s, d: repetition.ablations(repetition.ledger(table(s, d, "documents"))),
}

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_SHINGLES = """
{0} AS (SELECT '{1}' AS field_name, id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
  FROM (SELECT DISTINCT {2} AS id, {3} AS w FROM {4} WHERE {5} IS NOT NULL))
"""
_PAIRS = (
    ", ".join(_SHINGLES.format(f"s{i}", f"{t}.{c}", k, _WORDS.format(c), t, c) for i, (t, k, c) in enumerate(P6_FIELDS))
    + """, s AS (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2), e AS (SELECT field_name, id, len(s) AS n, unnest(s) AS g FROM s WHERE len(s) >= 30),
c AS (SELECT a.field_name, a.id AS id_a, b.id AS id_b, any_value(a.n) + any_value(b.n) AS n, count(*) AS k FROM e a JOIN e b ON a.field_name = b.field_name AND a.g = b.g AND a.id < b.id GROUP BY ALL),
q AS (SELECT field_name, id_a, id_b FROM c WHERE k >= 0.6 * (n - k))"""
)
_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _repeated(parts: str) -> str:
    """Share of the characters that lies in stripped parts met before; 0 where the text is one part."""
    p = f"list_filter(list_transform({parts}, lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '')"
    total, once = (f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)" for x in (p, f"list_distinct({p})"))
    return f"CASE WHEN len({parts}) > 1 AND {total} > 0 THEN ({total} - {once}) / {total} ELSE 0 END::DOUBLE"


_R = repetition.Rules()
_LEDGER = f"""
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT r, doc_id, text, {_WORDS.format("text")} AS w FROM t),
g AS (SELECT *, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g5, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g3 FROM w),
m AS (SELECT r, doc_id, len(w) AS n_words, len(g5) AS n_runs, len(g5) - len(list_distinct(g5)) AS n_repeated_runs, coalesce(list_max(map_values(list_aggregate(g3, 'histogram'))), 0) AS top,
  {_repeated("string_split(text, chr(10))")} AS repeated_line_share, {_repeated("string_split_regex(text, '" + chr(92) + "n" + _SPACE + "*" + chr(92) + "n')")} AS repeated_paragraph_share,
  {_repeated("string_split_regex(text, '[.!?" + chr(92) + "n]" + _SPACE + "+')")} AS repeated_sentence_share FROM g),
s AS (SELECT *, n_repeated_runs / greatest(n_runs, 1) AS repeated_run_share, CASE WHEN top > 1 THEN least(1.0::DOUBLE, top * {_R.phrase} / greatest(n_words, 1)) ELSE 0 END::DOUBLE AS top_phrase_share FROM m),
ledger AS (SELECT doc_id, n_words, n_runs, n_repeated_runs, repeated_run_share, repeated_line_share, repeated_paragraph_share, repeated_sentence_share, top_phrase_share,
  ((n_words < {_R.min_words})::INT + 2 * (n_runs > 0 AND repeated_run_share >= {_R.run_share}::DOUBLE)::INT + 4 * (repeated_line_share >= {_R.line_share}::DOUBLE)::INT + 8 * (repeated_paragraph_share >= {_R.paragraph_share}::DOUBLE)::INT
  + 16 * (repeated_sentence_share >= {_R.sentence_share}::DOUBLE)::INT + 32 * (top_phrase_share >= {_R.top_phrase_share}::DOUBLE)::INT)::INT AS failed FROM s)"""


def _ablation_cases() -> str:
    out = []
    for p in repetition.POLICIES:
        any_of, unless = p.masks()
        out += [f"('{p.name}', {p.version}, '{x}', {any_of & ~repetition.BITS.get(x, 0)}, {unless})" for x in ("", *p.any_of)]
    return ", ".join(out)


SQL: dict[str, str] = {
    "p10_ledger": f"WITH {_LEDGER} SELECT * FROM ledger",
    "p10_ablations": f"WITH {_LEDGER} SELECT c.policy, c.version::INT AS version, c.without, count(*) FILTER ((failed & c.any_of) <> 0 AND (failed & c.unless) = 0)::BIGINT AS n_marked FROM ledger, (VALUES {_ablation_cases()}) c(policy, version, without, any_of, unless) GROUP BY ALL",
    "p3_found": """
SELECT id, max(list_max(list_transform(string_split_regex(text, '[ \\t\\n\\r\\f]'), lambda x: length(x))) > 2000)::INT AS hard_cut
FROM chunks WHERE length(text) > 2000 GROUP BY id""",
    "p3_stitched": "SELECT DISTINCT id, md5(text) AS md5, true AS within FROM chunks WHERE length(text) > 2000",
    "p4_found": """
WITH v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS v FROM vectors WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.id < b.id),
e AS (SELECT a, b, c FROM p WHERE c >= 0.9 UNION ALL SELECT b, a, c FROM p WHERE c >= 0.9),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS n FROM e)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 5""",
    "p4_neighbours": """
WITH v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS v FROM vectors WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS n FROM p WHERE c >= 0.9)
SELECT a AS id, b AS other_id, round(round(c, 6), 5) AS cosine, n::INT AS rank FROM r WHERE n <= 5""",
    "p6_groups": "WITH RECURSIVE "
    + _PAIRS
    + """, x AS (SELECT field_name, id_a AS a, id_b AS b FROM q UNION ALL SELECT field_name, id_b, id_a FROM q), t AS (SELECT field_name, a AS id, a AS other FROM x UNION SELECT t.field_name, t.id, x.b FROM t JOIN x ON x.field_name = t.field_name AND x.a = t.other),
g AS (SELECT field_name, id, min(other) AS group_id, count(DISTINCT other) AS group_size FROM t GROUP BY ALL),
k AS (SELECT s.field_name, s.id, max(md5(list_sort(s.s)::VARCHAR)) AS class FROM s WHERE len(s.s) >= 30 GROUP BY ALL),
l AS (SELECT x.field_name, x.a AS id, count(DISTINCT kb.class) FILTER (kb.class <> ka.class) AS links FROM x JOIN k ka ON ka.field_name = x.field_name AND ka.id = x.a JOIN k kb ON kb.field_name = x.field_name AND kb.id = x.b GROUP BY ALL)
SELECT field_name, id, group_id, group_size::BIGINT AS group_size, links::BIGINT AS links FROM g JOIN l USING (field_name, id)""",
    "p6_found": "WITH "
    + _PAIRS
    + " SELECT field_name, id_a, id_b FROM q",
    "p10_found": f"""
SELECT doc_id FROM (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL)) WHERE n >= 50 AND len(g) - len(list_distinct(g)) >= 0.3 * len(g)""",
}
