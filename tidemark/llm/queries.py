"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, gam, langid, maxscore, merkle, mixing, ngram_join, ngram_trie, token_store, toxicity, whitening, wumanber
from tidemark.llm.common import held_out, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(4, 2)
    return gam.score(docs, gam.fit(docs, table(spark, sf_dir, "labels").where(~held)), held)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


def op6_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.learn_and_score(table(spark, sf_dir, "documents"), held_out(10, 0))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(3, 1)
    return langid.identify(docs, langid.learn(docs.where(~held)), held)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = token_store.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.document_checksums(spark, place)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(4, 2)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held)), held)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.measured(table(spark, sf_dir, "documents"), "lang")
    domains = mixing.learn_domains(rows)
    soft = mixing.soft_members(rows, domains)
    return mixing.rates(soft, mixing.fit(soft, domains))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), merkle.every_seventh())


def op12_wumanber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wumanber.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_maxscore": op2_maxscore,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_gam": op4_quality_gam,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ngram_trie": op6_ngram_trie,
    "op7_language_mixture": op7_language_mixture,
    "op8_token_store": op8_token_store,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_merkle": op11_merkle,
    "op12_wumanber": op12_wumanber,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op2_maxscore": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id,
                          CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
             t AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
    """,
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op11_merkle": """
        WITH RECURSIVE
          crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
          d AS (SELECT row_number() OVER () AS r, doc_id, n_chars, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree,
                       [CAST(doc_id AS VARCHAR), source, lang, text] AS f, CAST(n_chars AS VARCHAR) AS chars, CAST(n_chars + 1 AS VARCHAR) AS more,
                       xor(list_reduce(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
                                       lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 7 = 0 AS tampered FROM documents, crc_table),
          e AS (SELECT *, list_transform([f[1], f[2], f[3], chars, more, f[4]], lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END) AS g FROM d),
          leaves AS (SELECT r, doc_id, tree, sha256(g[1] || g[2] || g[3] || g[4] || g[6]) AS leaf, CASE WHEN tampered AND n_chars IS NOT NULL THEN sha256(g[1] || g[2] || g[3] || g[5] || g[6]) END AS claimed FROM e),
          placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
          nodes(tree, level, pos, n, node) AS (
            SELECT tree, 0, pos, n, leaf FROM placed
            UNION ALL SELECT tree, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2),
          subroots AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, level AS height FROM nodes WHERE n = 1),
          tops(level, pos, n, node) AS (
            SELECT 0, pos, n, node FROM subroots
            UNION ALL SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2),
          -- every node's sibling on the way up, null for a lone one, by level
          steps AS (SELECT p.r, s.level, s.pos % 2 AS side, o.node AS sibling FROM placed p JOIN nodes s ON s.tree = p.tree AND s.n > 1 AND s.pos = p.pos >> s.level
                    LEFT JOIN nodes o ON o.tree = s.tree AND o.level = s.level AND o.pos = xor(s.pos, 1)
                    UNION ALL SELECT p.r, q.height + s.level, s.pos % 2, o.node FROM placed p JOIN subroots q ON q.tree = p.tree JOIN tops s ON s.n > 1 AND s.pos = q.pos >> s.level
                    LEFT JOIN tops o ON o.level = s.level AND o.pos = xor(s.pos, 1)),
          proof AS (SELECT r, list({'side': side, 'sibling': sibling} ORDER BY level) AS path, coalesce(string_agg(sibling, '' ORDER BY level), '') AS joined FROM steps GROUP BY r),
          fold(r, k, node) AS (
            SELECT p.r, 0, coalesce(claimed, leaf) FROM placed p
            UNION ALL SELECT f.r, k + 1, sha256(CASE WHEN path[k + 1].sibling IS NULL THEN node WHEN path[k + 1].side = 0 THEN node || path[k + 1].sibling ELSE path[k + 1].sibling || node END)
                      FROM fold f JOIN proof USING (r) WHERE k < len(path))
        SELECT p.doc_id, p.leaf, q.node AS subroot, t.node AS root, sha256(coalesce(joined, '')) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
        FROM placed p JOIN subroots q ON q.tree = p.tree JOIN tops t ON t.n = 1 LEFT JOIN proof USING (r) JOIN fold f ON f.r = p.r AND f.k = coalesce(len(path), 0)
    """,
    "op12_wumanber": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             sized AS (SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
             wanted AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
             seen AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d, (SELECT DISTINCT m FROM sized))),
             found AS (SELECT r, i, m, item FROM seen JOIN wanted USING (m, s)),
             hit AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM found)) GROUP BY r),
             held AS (SELECT r, list(DISTINCT item ORDER BY item) AS items FROM found GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
    """,
}
