"""The queries of the operators, op1_ to op13_, and their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustloom.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT *, 3 * source_size / w::DOUBLE AS cap_level,
        (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(3.0::DOUBLE * source_size, w * (SELECT level FROM l WHERE cap_level > level ORDER BY cap_level, level LIMIT 1)), 3.0::DOUBLE * source_size) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM t),
g AS (SELECT source, h, sum(size) AS z, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
c AS (SELECT g.source, g.h, (upto <= rest OR upto - rest < rest - (upto - z)) AND rest > 0 AS more FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target, ((p.whole + CASE WHEN c.more THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from dustloom.llm.piece_sampling import segmentation_digest

    return segmentation_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.line_dedup import line_dedup_digest

    return line_dedup_digest(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i + 1] AS a, l[i + 2] AS b, l[i + 3] AS c FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM d)),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth FROM w
      WHERE regexp_matches(a, '\\S') OR regexp_matches(b, '\\S') OR regexp_matches(c, '\\S')),
r AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE nth > 1) GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(ps, i - 1)) END, chr(10))) AS text_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from dustloom.llm.token_files import token_file_digest

    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.personal_data import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.near_dedup import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.vector_search import build_index, top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(build_index(vectors), vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 bit by bit; prefixes as text in JSON; a leaf counts for each depth of its smallest member up to its own.
OP11_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS v FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(v ORDER BY p) AS l FROM t GROUP BY c),
h AS (SELECT c, l, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 AS h FROM o),
b AS (SELECT a.c, list_concat(coalesce(f.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM h a LEFT JOIN o f ON f.c = a.c - a.c % 5),
m AS MATERIALIZED (SELECT c, d, to_json(l[1:d])::VARCHAR AS k, CASE WHEN d > 0 THEN to_json(l[1:d - 1])::VARCHAR END AS pk, CASE WHEN d > 0 THEN strlen(l[d].t) ELSE 0 END AS z, d = len(l) AS ends FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM b)),
n AS MATERIALIZED (SELECT k, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(pk) AS pk, any_value(z) AS z, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS e FROM m GROUP BY k),
u AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.pk = n.k) AS children FROM n),
s AS (SELECT m.k, sum(CASE WHEN u.children = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves, sum((u.n - 1) * u.z)::BIGINT AS saved FROM u JOIN m ON m.c = u.c AND m.d <= u.d GROUP BY m.k)
SELECT u.c AS conv_id, u.d AS depth, q.c AS parent_conv_id, u.n AS n_convs, u.children AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, u.e AS ends_sha256
FROM u JOIN s USING (k) LEFT JOIN n q ON q.k = u.pk
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.lexical_search import ranked_documents

    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS length FROM d WHERE len(t) > 0),
f AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
p AS (SELECT i, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // length)))))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dustloom.llm.warc import warc_digest

    return warc_digest(spark, table(spark, sf_dir, "pages"))


OP13_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS largest FROM p WHERE payload_bytes >= 1000 GROUP BY 1),
r AS (SELECT *, largest IS NOT NULL AND page_id IS DISTINCT FROM largest AS again FROM p LEFT JOIN g USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN largest END AS refers_to FROM r
"""


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_piece_sampling, op4_line_dedup, op5_token_files, op6_toxicity, op7_personal_data, op8_near_dedup, op9_vector_search, op10_sharding, op11_prefix_trie, op12_lexical_search, op13_warc)}
ORACLE = {"op1_exact_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op4_line_dedup": OP4_SQL, "op9_vector_search": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_warc": OP13_SQL}
