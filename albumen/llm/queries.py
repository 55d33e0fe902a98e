"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, conversations, decontaminate, fingerprint, html_extract, langid, licenses, mixing, ngram_join, sharding, substring_dedup, tokenbin
from .storage import read_table


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CUT = "1000000 * a::HUGEINT * a // ({}::HUGEINT * {})"
OP13_SQL = f"""WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
f1 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM pieces) GROUP BY 1, 2),
f2 AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM pieces WHERE len(w) > 1) GROUP BY 1, 2, 3),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM pieces WHERE len(w) > 2) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY 1, 2, 3),
two AS (SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, p.f AS l, q.f AS r FROM f2 c JOIN f1 p ON p.lang = c.lang AND p.p = c.x JOIN f1 q ON q.lang = c.lang AND q.p = c.y LEFT JOIN longer g ON g.lang = c.lang AND g.x = c.x AND g.y = c.y WHERE c.f >= 10 AND NOT coalesce(100 * g.f >= 50 * c.f, FALSE)),
three AS (SELECT *, {_CUT.format("p1", "p23")} AS s1, {_CUT.format("p12", "p3")} AS s2 FROM (SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.f AS a, o.f AS p1, t.f AS p23, h.f AS p12, e.f AS p3 FROM f3 c JOIN f1 o ON o.lang = c.lang AND o.p = c.x JOIN f2 t ON t.lang = c.lang AND t.x = c.y AND t.y = c.z JOIN f2 h ON h.lang = c.lang AND h.x = c.x AND h.y = c.y JOIN f1 e ON e.lang = c.lang AND e.p = c.z)),
scored AS (SELECT lang, phrase, a, l, r, {_CUT.format("l", "r")} AS score FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN p12 ELSE p1 END, CASE WHEN s2 < s1 THEN p3 ELSE p23 END, least(s1, s2) FROM three)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored) JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY 1) USING (lang) WHERE rank <= 2000"""


_U = "(('0x' || substr(md5('0:' || j || ':' || coalesce('=' || source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
OP11_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY 1),
c AS (SELECT *, 3 * size / w AS bound, coalesce(sum(3 * size) OVER (ORDER BY 3 * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(w) OVER (ORDER BY 3 * size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s),
v AS (SELECT level FROM (SELECT bound, CAST((SELECT sum(size) FROM s) - held AS DOUBLE) / CAST(open AS DOUBLE) AS level FROM c) WHERE bound >= level ORDER BY bound LIMIT 1),
t AS (SELECT source, size AS source_size, least(w * level, CAST(3 * size AS DOUBLE)) AS target FROM s, v),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), md5(coalesce(CAST(doc_id AS VARCHAR), '')), d.size) - 1 AS nth FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT source, j, {_U} AS u FROM s, range(32) g(j)),
p AS (SELECT u.source, j, u.u, abs(CAST(sum(r.size * (floor(rate * (nth + 1) + u.u) - floor(rate * nth + u.u))) AS BIGINT) - any_value(target)) AS miss FROM r JOIN u ON u.source IS NOT DISTINCT FROM r.source GROUP BY 1, 2, 3),
best AS (SELECT source, u FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, j) = 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate * (nth + 1) + best.u) - floor(rate * nth + best.u)) AS BIGINT) AS taken FROM r JOIN best ON best.source IS NOT DISTINCT FROM r.source"""


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenbin.written_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.roundtrip_digest(read_table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(read_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op5_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, sf_dir, "documents"))


def op6_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_digest(read_table(spark, sf_dir, "documents"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("copies")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(conversations.damaged(read_table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_binary": op1_token_binary,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_label_propagation_shards": op5_label_propagation_shards,
    "op6_multiset_fingerprint": op6_multiset_fingerprint,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_html_extract": op10_html_extract,
    "op11_source_mixing": op11_source_mixing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op11_source_mixing": OP11_SQL, "op13_collocations": OP13_SQL}
