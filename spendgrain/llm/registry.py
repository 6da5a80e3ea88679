"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrain.llm import (
    chat,
    grammar,
    importance,
    language,
    mixing,
    near_vectors,
    ordinal,
    pieces,
    prefix_trie,
    secret_scan,
    setsketch,
    token_counts,
    topk,
)
from spendgrain.llm.common import stored, table
from spendgrain.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file. The operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_link_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = chat.tool_events(table(spark, folder, "conversations"))
    return chat.link_tool_calls(calls, results, chat.TOOLS)


def op2_recurrent_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_re_pair_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    shards = stored(grammar.encode_shards(docs, tokenizer_path("byte_bpe_50k.json")), "shards")
    return grammar.decode_shards(shards)


def op4_hypergeometric_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_offset_preserving_pieces(spark: SparkSession, folder: str) -> DataFrame:
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    return pieces.encode(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"), outputs)


def op6_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, folder, "documents"))


def op7_pca_tiled_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, folder, "embeddings"), threshold=0.95)


def op8_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = ordinal.fit(docs, ordinal.rated(table(spark, folder, "labels")))
    return ordinal.grade(docs, model).withColumn("held_out", ordinal.held_out())


def op9_ball_tree_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), k=20, every=20)


def op10_setsketch_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, folder, "documents"), percent=85).drop("text_hash", "root")


def op11_splitter_skeleton_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_bit_sliced_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=5, least_words=20)


def op13_digest_cached_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    cache = f"{shared_folder(spark, 'llm')}/token-counts"
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), cache, limit=2048)


def queries() -> dict[str, Query]:
    found = {name: query for name, query in globals().items() if name.startswith("op") and callable(query)}
    return dict(sorted(found.items(), key=lambda item: int(item[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op4_hypergeometric_mix": MIX_SQL,
        "op7_pca_tiled_near_vectors": NEAR_VECTORS_SQL,
        "op9_ball_tree_top_k": TOP_K_SQL,
        "op10_setsketch_near_duplicates": NEAR_DUPLICATES_SQL,
        "op11_splitter_skeleton_trie": PREFIX_TRIE_SQL,
        "op12_bit_sliced_resampling": RESAMPLING_SQL,
    }


# The order of a source's stream is that of the first 60 bits of an MD5, which both engines have.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, substr(md5('0|' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS place,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (s - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0::DOUBLE * source_size AS room FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(room) OVER (ORDER BY room / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY room / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(room, weight * max(level) OVER ()) AS target FROM levels),
plan AS (
  SELECT *, least(round(target)::BIGINT, 2 * source_size) AS amount, least(round(target)::BIGINT, 2 * source_size) // greatest(source_size, 1) AS whole
  FROM targets),
placed AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.amount - p.whole * p.source_size AS part,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, size, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, part - start)))::BIGINT AS taken FROM placed
"""

# What a vector needs to take part.
USABLE = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"

NEAR_VECTORS_SQL = f"""
WITH RECURSIVE part AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {USABLE} AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM part a JOIN part b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = x
"""

TOP_K_SQL = f"""
WITH whole AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE {USABLE}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM cut)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON d.doc_id = x LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""

# CRC-32 is linear: a byte's part depends on its value and on how many bytes follow, and the parts add up by exclusive or.
CRC_TABLES = """
one AS (
  SELECT 0 AS k, b::BIGINT AS b, b::BIGINT AS v FROM range(256) t(b)
  UNION ALL SELECT k + 1, b, xor(v >> 1, 3988292384 * (v & 1)) FROM one WHERE k < 8),
step AS (SELECT b, v FROM one WHERE k = 8),
parts AS (
  SELECT 0 AS after, b, v FROM step
  UNION ALL SELECT after + 1, p.b, xor(p.v >> 8, s.v) FROM parts p JOIN step s ON s.b = (p.v & 255) WHERE after < (SELECT max(size) FROM hashed)),
start AS (
  SELECT 0 AS size, 4294967295::BIGINT AS v
  UNION ALL SELECT size + 1, xor(t.v >> 8, s.v) FROM start t JOIN step s ON s.b = (t.v & 255) WHERE size < (SELECT max(size) FROM hashed)),
placed AS (SELECT f, bytes, size, unnest(range(size)) AS i FROM hashed),
summed AS (
  SELECT f, any_value(size) AS size, bit_xor(v) AS v
  FROM placed JOIN parts ON after = size - 1 - i AND b = ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT GROUP BY f),
crcs AS (SELECT f, xor(xor(m.v, t.v), 4294967295) AS crc FROM summed m JOIN start t USING (size))
"""

RESAMPLING_SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark),
cut AS (
  SELECT kind, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
found AS (
  SELECT kind, id, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS f
  FROM cut, (VALUES (1), (2), (3)) t(k)),
counted AS (SELECT kind, id, f, count(*) AS n FROM found GROUP BY ALL),
hashed AS (SELECT f, hex(encode(f)) AS bytes, octet_length(encode(f)) AS size FROM (SELECT DISTINCT f FROM counted)),
{CRC_TABLES.strip()},
held AS (SELECT kind, id, crc % 10000 AS bucket, sum(n)::BIGINT AS n FROM counted JOIN crcs USING (f) GROUP BY ALL),
totals AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t
  FROM range(10000) r(b) LEFT JOIN held ON bucket = b GROUP BY b),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM totals),
weighed AS (SELECT id, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n FROM held JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (
  SELECT c.id AS doc_id, len(w) >= 20 AS eligible, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || c.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM cut c LEFT JOIN weighed d ON d.id = c.id WHERE kind = 0),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, (SELECT 5 * count(*) // 100 FROM scored WHERE eligible) AS most
  FROM scored WHERE eligible)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id
"""

PREFIX_TRIE_SQL = rf"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    substr(sha256(concat(len(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32)) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT f, hex(encode(f)) AS bytes, octet_length(encode(f)) AS size FROM (SELECT DISTINCT conv_id::VARCHAR AS f FROM turns)),
{CRC_TABLES.strip()},
heads AS (SELECT f::BIGINT AS conv_id, crc % 4 AS h FROM crcs),
rebuilt AS (
  SELECT h.conv_id, i, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 20 AND i <= h
  UNION ALL SELECT conv_id, i + 1000000, role, text FROM heads JOIN turns USING (conv_id) WHERE i > h),
stepped AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, sha256(concat(len(role), ':', role, text)) AS step, text FROM rebuilt),
whole AS (SELECT conv_id, coalesce(list(step ORDER BY depth) FILTER (step IS NOT NULL), []) AS steps FROM heads LEFT JOIN stepped USING (conv_id) GROUP BY conv_id),
prefixes AS (SELECT conv_id, d, array_to_string(steps[:d], '') AS path, d = len(steps) AS is_end FROM (SELECT *, unnest(range(len(steps) + 1)) AS d FROM whole)),
words AS (SELECT DISTINCT step, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM stepped),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, left(path, 64 * (d - 1)) AS up,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d),
counted AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.up = n.path) AS n_children,
    (n_convs - 1) * coalesce(w.n, 0) AS saved
  FROM nodes n LEFT JOIN words w ON w.step = right(n.path, 64))
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, a.ends_sha256,
  count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens
FROM counted a JOIN counted b ON b.depth >= a.depth AND starts_with(b.path, a.path)
LEFT JOIN nodes p ON a.depth > 0 AND p.depth = a.depth - 1 AND p.path = a.up
GROUP BY a.path, a.conv_id, a.depth, p.conv_id, a.n_convs, a.n_children, a.ends_sha256
"""
