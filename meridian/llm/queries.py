"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import vocabulary
from .fill_middle import fill_in_middle
from .language_id import identify
from .near_vectors import near_vectors
from .ngram_join import jaccard_classes
from .page_text import extract_main
from .secrets import scan_secrets
from .sharding import place
from .source_audit import audit_sources
from .source_mix import mix_sources
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .topk_search import top_k
from .word_bpe import encode_texts


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_read(spark, sf_dir, "documents"), k=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"), k=10, scale=1024, every=100)


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_read(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), length=400).drop("kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(_read(spark, sf_dir, "documents").select("doc_id"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"), least=0.93)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_read(spark, sf_dir, "documents"), seed=7, rate=100, spm=50, with_text=False)


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(_read(spark, sf_dir, "pages"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(_read(spark, sf_dir, "documents"), least=3, top=200)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_topk_search, op3_word_bpe, op4_token_counts, op5_language_id, op6_source_mix, op7_secret_scan, op8_suffix_dedup, op9_sharding, op10_near_vectors, op11_fill_middle, op12_page_text, op13_source_audit, pipeline)}

_VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2),
link AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, comp.c AS component_id FROM s JOIN comp ON comp.a = s.doc_id""",
    "op2_topk_search": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_VALID}),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_near_vectors": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_VALID} AND label IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
edge AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, comp.c AS component_id, e.vec_id = comp.c AS kept FROM embeddings e JOIN comp ON comp.a = e.vec_id LEFT JOIN deg ON deg.a = e.vec_id""",
    "op11_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:z], '') AS mid, array_to_string(u[z + 1:], '') AS suf FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM p),
x AS (SELECT *, instr(out, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS two, instr(out, '<M>') AS three FROM o),
r AS (SELECT *, CASE form WHEN 'plain' THEN out WHEN 'psm' THEN substr(out, 4, two - 4) || substr(out, three + 3) || substr(out, two + 3, three - two - 3)
  ELSE substr(out, two + 3, three - two - 3) || substr(out, three + 3) || substr(out, 4, two - 4) END AS back FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars, sha256(out) AS output_sha256, sha256(back) AS restored_sha256 FROM r""",
    "op13_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
q AS (SELECT lang, term, CAST(count(*) AS BIGINT) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
lv AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM q GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS m FROM w JOIN q ON w.lang = q.lang AND w.term = q.term GROUP BY 1, 2, 3),
gn AS (SELECT g.lang, g.source, coalesce(sum(m), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2),
cell AS (SELECT gn.lang, gn.source, q.term, coalesce(m, 0) AS m, CAST(1 + (1000000000 * (CAST(coalesce(m, 0) AS HUGEINT) + 1)) // (gn.n + v) AS HUGEINT) AS p, CAST(1 + (1000000000 * (CAST(total AS HUGEINT) + 1)) // (lv.n + v) AS HUGEINT) AS ql
  FROM gn JOIN lv ON gn.lang = lv.lang JOIN q ON gn.lang = q.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = q.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - ql) * (p - ql) // ql AS BIGINT) AS value FROM cell WHERE m > 0 AND p > ql),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
