"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex16, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


#: Runs of 50 words or more as strings; a run is the shortest from its first or to its last line.
OP4_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM raw),
s AS (
  SELECT doc_id, pos, bare, nw, row_number() OVER w AS seq, sum(nw) OVER w AS cum,
         sum(nw) OVER w - nw AS prev FROM l WHERE nw > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (
  SELECT a.doc_id, a.seq AS i, b.seq AS j FROM s a JOIN s b
    ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + 49 AND b.cum - a.prev >= 50
   AND (b.prev - a.prev < 50 OR b.cum - a.cum < 50)),
named AS (
  SELECT r.doc_id, r.i, r.j, string_agg(s.bare, chr(10) ORDER BY s.seq) AS content
  FROM runs r JOIN s ON s.doc_id = r.doc_id AND s.seq BETWEEN r.i AND r.j GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS nth FROM named),
dead AS (
  SELECT DISTINCT s.doc_id, s.pos FROM ranked r JOIN s ON s.doc_id = r.doc_id AND s.seq BETWEEN r.i AND r.j
  WHERE nth > 1),
owner AS (
  SELECT l.doc_id, l.pos, max(CASE WHEN l.nw > 0 THEN l.pos END) OVER (PARTITION BY l.doc_id ORDER BY l.pos) AS own
  FROM l),
marked AS (
  SELECT raw.doc_id, raw.pos, raw.line, d.pos IS NOT NULL AS gone
  FROM raw JOIN owner o USING (doc_id, pos) LEFT JOIN dead d ON d.doc_id = o.doc_id AND d.pos = o.own)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.kept, '') END AS text,
       CAST(coalesce(m.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(m.g, 0) AS INTEGER) AS n_deleted
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept, count(*) AS n,
         count(*) FILTER (gone) AS g FROM marked GROUP BY doc_id) m USING (doc_id)
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_net import learnable, score_quality

    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode, read_ranks
    from .common import small_batches

    small_batches(spark)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    ids = encode(docs, ranks, public_tokenizers.PATTERN, id_bytes="raw", decoded="back", keep=["doc_id"])
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("raw", 256).alias("ids_sha256"), F.sha2("back", 256).alias("decoded_sha256")
    )


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_shards import read_shards, shard_folder, write_shards

    folder = shard_folder(spark)
    write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(spark, folder)


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_mincut import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_forest import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_lang_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_crf import identify, learnable

    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")


def op11_piece_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_prefix import encode, read_model

    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    found = encode(table(spark, sf_dir, "documents"), model, decoded="decoded", keep=["doc_id"])
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_sphere_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sphere_kmeans import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op12_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .zfast_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


#: Prefixes as strings of turn digests. The CRC goes bit by bit: 8 steps give the table of bytes, the digits of an id fold over it.
OP12_SQL = f"""WITH bytes AS (SELECT {"list_transform(" * 8}range(256){", lambda x: xor(x >> 1, 3988292384 * (x & 1)))" * 8} AS crc),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
  md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, len(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1),
crcs AS (SELECT conv_id, n, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])) AS reg FROM sizes, bytes),
plan AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(reg, 4294967295) % 6 AS h FROM crcs),
full_plan AS (SELECT p.*, least(h, coalesce(s.n, 0)) AS taken FROM plan p LEFT JOIN sizes s ON s.conv_id = p.base),
built AS (SELECT p.conv_id, t.pos AS d, mark, chars FROM full_plan p JOIN turns t ON t.conv_id = p.base AND t.pos <= h
  UNION ALL SELECT p.conv_id, t.pos - h + taken, mark, chars FROM full_plan p JOIN turns t ON t.conv_id = p.conv_id AND t.pos > h
  UNION ALL SELECT conv_id, 0, '', 0 FROM plan),
path AS (SELECT conv_id, d, chars, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY d) AS key, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM built),
node AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM path GROUP BY key, d),
kids AS (SELECT substr(key, 1, 32 * (d - 1)) AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
below AS (SELECT p.key, sum(n.own) AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM node n JOIN path p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN kids k ON k.key = n.key GROUP BY p.key)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below b ON b.key = n.key LEFT JOIN kids k ON k.key = n.key LEFT JOIN node up ON n.d > 0 AND up.d = n.d - 1 AND up.key = substr(n.key, 1, 32 * (n.d - 1))"""


def _op13_sql(rounds: int = 10) -> str:
    """Every assignment and every mean written out, on lists of whole numbers."""
    near = """near{r} AS MATERIALIZED (SELECT rid, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
  SELECT rid, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS d FROM kept, cent{r}) GROUP BY rid)"""
    mean = """cent{s} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM cent{r} o LEFT JOIN (
  SELECT cluster, list(m ORDER BY dim) AS c FROM (SELECT cluster, dim, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM near{r}) GROUP BY cluster, dim) GROUP BY cluster) n ON n.cluster = o.cluster)"""
    steps = [x for r in range(rounds) for x in (near.format(r=r), mean.format(r=r, s=r + 1))] + [near.format(r=rounds)]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
cent0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster, v AS c FROM kept WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT 8),
{", ".join(steps)}
SELECT vec_id, CAST(n.cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} n JOIN kept USING (rid) JOIN cent{rounds} c ON c.cluster = n.cluster"""


QUERIES = {"op3_lang_crf": op3_lang_crf, "op6_license_scan": op6_license_scan, "op2_rule_forest": op2_rule_forest, "op1_html_mincut": op1_html_mincut, "op7_token_shards": op7_token_shards, "op5_bpe": op5_bpe, "op9_decontaminate": op9_decontaminate, "op10_quality": op10_quality, "op4_line_dedup": op4_line_dedup, "op8_simhash": op8_simhash}
QUERIES |= {"op11_piece_prefix": op11_piece_prefix, "op12_zfast_trie": op12_zfast_trie, "op13_sphere_kmeans": op13_sphere_kmeans}
ORACLE: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op12_zfast_trie": OP12_SQL, "op13_sphere_kmeans": _op13_sql()}
