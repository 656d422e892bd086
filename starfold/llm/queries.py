"""One query for each operator, over the whole of its table, with the parameters that the operators default to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies. The driver reads it; tasks get its content."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_and_decoded(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each document."""
    import public_tokenizers

    from starfold.llm import bpe

    definition = bpe.model_json(bpe.read_ranks(tokenizer_path(vocabulary)))
    found = bpe.round_trip(docs, definition, public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: count of ids, digest of the ids, digest of the decoded bytes."""
    return encoded_and_decoded(table(spark, sf_dir, "documents"))


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 1,024 tokens."""
    from starfold.llm.counts import count_tokens

    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as definition:
        return count_tokens(table(spark, sf_dir, "documents"), definition.read())


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic each document is. Labels are learned from the rows that are not held out."""
    from starfold.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out("doc_id")))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "worst_score",
                         "worst_start", "worst_end")


@query()
def op4_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near-duplicates that each document belongs to."""
    from starfold.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum([coalesce(q.v[i], 0) * coalesce(c.v[i], 0)
      FOR i IN range(1, greatest(len(q.v), len(c.v)) + 1)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors by integer inner product, for every vector whose id is divisible by 50."""
    from starfold.llm.search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op6_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, as it is or paraphrased, with the item."""
    from starfold.llm.decontam import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "share", "answer_share")


@query("""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(CASE WHEN payload_bytes >= 1000 THEN page_id END) OVER (PARTITION BY payload_digest) AS first_page
      FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_page THEN first_page END AS refers_to
FROM m
""")
def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to ZIP packages of WARC records and read back by range."""
    from starfold.llm.scratch import Scratch
    from starfold.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), Scratch(spark, "warc").path("packages"))


@query()
def op8_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each document by its text and by its page, and by both."""
    from starfold.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


@query()
def op9_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that a document shares with another, changed words allowed."""
    from starfold.llm.substring import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed into rows of 2,048, written, and read back: each segment's place and checksum."""
    import public_tokenizers

    from starfold.llm import bpe, packing
    from starfold.llm.scratch import Scratch

    definition = bpe.model_json(bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken")))
    path = Scratch(spark, "packing").path("rows")
    packing.write(packing.pack(table(spark, sf_dir, "documents"), definition, public_tokenizers.PATTERN), path)
    found = packing.segments(packing.read(spark, path))
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query(r"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS n_bytes,
          sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT DISTINCT conv_id, n, conv_id - conv_id % 5 AS base,
    xor(4294967295, list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, bit: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h
  FROM t),
r AS (
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.place - c.h + 1 AS depth, t.digest, t.n_bytes
  FROM c LEFT JOIN c b ON b.conv_id = c.base JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h
  UNION ALL
  SELECT c.conv_id, t.place + 1, t.digest, t.n_bytes FROM c JOIN t ON t.conv_id = c.base AND t.place < c.h),
s AS (
  SELECT conv_id, coalesce(list(digest ORDER BY depth) FILTER (WHERE depth IS NOT NULL), []) AS d,
    coalesce(list(n_bytes ORDER BY depth) FILTER (WHERE depth IS NOT NULL), []) AS b
  FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
p AS (
  SELECT conv_id, depth, sha256(array_to_string(d[1:depth], ' ')) AS node, sha256(array_to_string(d[1:depth - 1], ' ')) AS parent,
    d[depth] AS turn_digest, CASE WHEN depth = 0 THEN 0 ELSE b[depth] END AS n_bytes, len(d) AS n
  FROM (SELECT *, unnest(range(0, len(d) + 1)) AS depth FROM s)),
m AS (
  SELECT depth, node, min(CASE WHEN depth > 0 THEN parent END) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    min(n_bytes) AS n_bytes, min(CASE WHEN depth > 0 THEN turn_digest END) AS turn_digest,
    sha256(coalesce(string_agg(CASE WHEN depth = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY depth, parent),
u AS (
  SELECT depth, node, count(*) FILTER (WHERE childless) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved_tokens
  FROM (SELECT DISTINCT a.depth, a.node, x.depth AS x_depth, x.node AS x_node, x.n_convs, x.n_bytes, k.node IS NULL AS childless
        FROM p a JOIN p e ON e.conv_id = a.conv_id AND e.depth >= a.depth
        JOIN m x ON x.depth = e.depth AND x.node = e.node LEFT JOIN k ON k.depth = x.depth AND k.node = x.node)
  GROUP BY depth, node)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, m.n_convs, coalesce(k.n_children, 0) AS n_children,
  u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256, m.turn_digest
FROM m JOIN u USING (depth, node) LEFT JOIN k USING (depth, node) LEFT JOIN m o ON o.depth = m.depth - 1 AND o.node = m.parent
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with what sharing it saves."""
    from starfold.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


@query()
def op12_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product that the index finds, for every vector whose id is divisible by 20."""
    from starfold.llm.permutation import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT w.doc_id, part,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS failed
  FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
p AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT c1.x || c2.x || c3.x || c4.x || c5.x AS filter_order, [c1.b, c2.b, c3.b, c4.b, c5.b] AS bits
  FROM c c1, c c2, c c3, c c4, c c5
  WHERE list_sum([c1.b, c2.b, c3.b, c4.b, c5.b]) = 31 AND len(list_distinct([c1.b, c2.b, c3.b, c4.b, c5.b])) = 5),
s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit,
    CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN failed & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & bit <> 0 AND failed & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & bit <> 0 AND failed & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & bit <> 0 AND failed & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & bit <> 0 AND failed & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM p, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does at each step of all their orders, for each language."""
    from starfold.llm.filters import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
