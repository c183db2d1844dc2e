"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .clusters import centroid_clusters, clusters_sql
from .decontaminate import contamination
from .licenses import license_scan
from .mixing import taken_words
from .near_dups import near_duplicates
from .ngram_lm import lm_scores
from .privacy import personal_data
from .quality import quality_scores
from .ranked import RANKED_SQL, ranked_search
from .substrings import SUBSTRINGS_SQL, repeated_substrings
from .token_counts import token_counts
from .token_files import token_files
from .topk import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": lambda s, d: top_k(_table(s, d, "embeddings"), k=10, every=100),
        "op2_source_mixing": lambda s, d: taken_words(_table(s, d, "documents")),
        "op3_license_scan": lambda s, d: license_scan(_table(s, d, "documents")),
        "op4_near_duplicates": lambda s, d: near_duplicates(_table(s, d, "documents"), k=4, percent=80),
        "op5_personal_data": lambda s, d: personal_data(_table(s, d, "documents")),
        "op6_quality": lambda s, d: quality_scores(_table(s, d, "documents"), _table(s, d, "labels")),
        "op7_decontamination": lambda s, d: contamination(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op8_ngram_lm": lambda s, d: lm_scores(_table(s, d, "documents")),
        "op9_token_counts": lambda s, d: token_counts(_table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
        "op10_token_files": lambda s, d: token_files(_table(s, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
        "op11_centroid_clusters": lambda s, d: centroid_clusters(_table(s, d, "embeddings"), k=40, rounds=5),
        "op12_ranked_search": lambda s, d: ranked_search(_table(s, d, "documents"), _table(s, d, "benchmark"), k=20),
        "op13_repeated_substrings": lambda s, d: repeated_substrings(_table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_topk": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
              FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
              SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
              FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
        "op4_near_duplicates": r"""
            WITH RECURSIVE w AS (
              SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
              FROM documents),
            sh AS (
              SELECT DISTINCT doc_id, s FROM (
                SELECT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w)),
            n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
            f AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
            c AS (
              SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
              FROM sh a JOIN f USING (s) JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
            l AS (
              SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r AS (SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_id),
            m AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
            FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id""",
        "op7_decontamination": r"""
            WITH t AS (
              SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
            w AS (
              SELECT k, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM t),
            b AS (
              SELECT DISTINCT id, n, s FROM (
                SELECT id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s
                FROM w WHERE k = 'b' AND len(w) > 0)),
            l AS (SELECT DISTINCT n FROM b),
            g AS (
              SELECT id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'i': i, 's': array_to_string(w[i:i + n - 1], ' ')})) AS x
              FROM w, l WHERE k = 'd' AND len(w) >= n),
            h AS (SELECT DISTINCT g.id, g.n, x.i AS i, x.s AS s FROM g JOIN (SELECT DISTINCT n, s FROM b) q ON q.n = g.n AND q.s = g.x.s),
            p AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS j FROM h) GROUP BY id),
            m AS (SELECT DISTINCT h.id, CAST(b.id AS VARCHAR) AS item FROM h JOIN b ON b.n = h.n AND b.s = h.s),
            i AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM m GROUP BY id)
            SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
              sha256(coalesce(i.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
            FROM w LEFT JOIN p ON p.id = w.id LEFT JOIN i ON i.id = w.id WHERE w.k = 'd'""",
        "op11_centroid_clusters": clusters_sql(k=40, rounds=5),
        "op12_ranked_search": RANKED_SQL,
        "op13_repeated_substrings": SUBSTRINGS_SQL,
    }
