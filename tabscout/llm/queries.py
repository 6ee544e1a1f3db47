"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscout.llm import chat, clusters, decontam, html, licenses, lines, mixing, neardup, negatives, quality, sharding, spans, tokens
from tabscout.llm.common import back, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = lines.apply_keep(docs, lines.line_keep(docs))
    return out.select(F.col("d").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op1_line_dedup"] = r"""
WITH l AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id < k.top AS dropped FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


@query
def op2_hyperminhash(spark, sf_dir):
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Params(words=3, percent=85))
    return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.coalesce(F.col("d") == F.col("component"), F.col("component").isNull()).alias("kept"))


@query
def op3_sentence_spans(spark, sf_dir):
    out = spans.repeated_spans(table(spark, sf_dir, "documents"), close=True)
    return out.select(back("d").alias("doc_id"), F.size("spans").cast("bigint").alias("n_spans"),
                      F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["size"]).alias("n_bytes"),
                      F.transform("spans", lambda s: F.array(s["first"], s["first"] + s["size"])).alias("spans"))


@query
def op4_repetition_coverage(spark, sf_dir):
    out = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in (*quality.COUNTS, "base_failed", "kept")])


@query
def op5_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # The conversation whose texts hold control strings.
    marked = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], turns.schema)
    back = chat.read_back(chat.format_chats(turns.unionByName(marked)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


ORACLE["op5_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, coalesce(lag(role) OVER w <> role, true) AS starts,
  replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') AS safe
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + 13 + CASE WHEN starts THEN 7 + length(role) ELSE 0 END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


@query
def op6_transducer_tokens(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "tokens.*")


@query
def op7_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = mixing.with_times(docs, mixing.mix(docs), [F.col("doc_id")])
    return out.select("doc_id", "__said.size", "__said.source_size", "__said.target", (F.col("__said.size") * F.col("__said.times")).alias("taken"))


@query
def op8_uniform_shards(spark, sf_dir):
    body = text_of("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    out = sharding.shard(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_recurrent_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.main_text(pages, html.fit(pages)).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op10_qgram_bands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.item_id", "f.edits", F.col("f.start").alias("start"), F.col("f.end").alias("end"))


@query
def op11_license_index(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"licence.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


_PARTS = ", ".join(f"({n}, '{t.label}', {t.base}, {i}, '{w}', {k})"
                   for n, t in enumerate(licenses.TEMPLATES) for i, (w, k) in enumerate(zip(t.words, t.key)))
ORACLE["op11_license_index"] = rf"""
WITH part(t, label, base, i, word, key) AS (VALUES {_PARTS}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM d),
held AS (SELECT word, count(DISTINCT r) AS n FROM w WHERE word IN (SELECT word FROM part) GROUP BY word),
weight AS (SELECT word, CAST(floor(1000 * ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0)))) + 1 AS BIGINT) AS weight
  FROM (SELECT DISTINCT word FROM part) LEFT JOIN held USING (word)),
rare AS (SELECT t, word FROM (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY weight DESC, word) AS place
  FROM (SELECT DISTINCT t, word FROM part) JOIN weight USING (word)) WHERE place <= {licenses.RARE}),
agreed AS (SELECT r, t, p - i AS start FROM w JOIN part USING (word) SEMI JOIN rare USING (t, word) GROUP BY ALL HAVING count(*) >= {licenses.AGREE}),
tried AS (SELECT a.r, a.t, a.start, any_value(label) AS label, any_value(base) AS base, coalesce(sum(weight) FILTER (w.word IS NOT NULL), 0) AS got, sum(weight) AS total,
    count(*) FILTER (key AND w.word IS NULL) AS lost
  FROM agreed a JOIN part USING (t) JOIN weight USING (word) LEFT JOIN w ON w.r = a.r AND w.p = a.start + part.i AND w.word = part.word GROUP BY a.r, a.t, a.start),
found AS (SELECT * FROM tried WHERE lost = 0 AND 2 * got >= total),
said AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(CAST(got AS DOUBLE) / CAST(total AS DOUBLE)) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN said USING (r)"""


@query
def op12_tree_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    points = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(points, F.col("vec_id") % 100 == 0, negatives.Params(positives=5, negatives=10, low=30, high=90, scale=256))


ORACLE["op12_tree_negatives"] = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, o.r AS other, o.vec_id, o.label = a.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM e a JOIN e o ON a.r <> o.r AND len(a.v) = len(o.v) WHERE a.vec_id % 100 = 0),
pos AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY r, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN (SELECT r, vec_id, score FROM s WHERE NOT same) USING (r) WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""


@query
def op13_shallot_clusters(spark, sf_dir):
    out = clusters.kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10, scale=1024, dimension=64, seed=3)
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _rounds(n: int) -> str:
    """Assignments a0 to an and the centroids c1 to cn between them."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT r, c, sum((x - y) * (x - y)) AS d FROM p JOIN c{i} USING (j) GROUP BY r, c) GROUP BY r)""")
        if i < n:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, j, coalesce(m, y) AS y FROM c{i} LEFT JOIN (
    SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM a{i} JOIN p USING (r) GROUP BY c, j) USING (c, j))""")
    return ",\n".join(parts)


ORACLE["op13_shallot_clusters"] = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM k),
f AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM k QUALIFY c < 8),
c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM f),
{_rounds(10)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM a10 JOIN k USING (r) JOIN (SELECT c, sha256(string_agg(y, ',' ORDER BY j)) AS digest FROM c10 GROUP BY c) USING (c)"""
