"""Registered queries of the subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import (
    coding, exact_dedup, forest, jaccard, linededup, mixing, packing, phrases, quality, secrets, toxicity, trie, vector_dedup,
)
from tidegrid.llm.common import held_out, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary lies; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar(table(spark, sf_dir, "documents"), words=3, numerator=9, denominator=10)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def _classified(spark: SparkSession, sf_dir: str, kind) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kind.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), kind.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= kind.THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, offsets = coding.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    digests = documents.select("file", "doc_id", "inside", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return coding.with_starts(digests, offsets).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.digested(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
    return packing.packed(cut).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.without_repeats(table(spark, sf_dir, "documents"))
    lines = lambda text: F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long")
    before, after = F.col("row.text"), F.col("text")
    return cut.select(
        F.col("row.doc_id").alias("doc_id"),
        lines(before).alias("n_lines"),
        # a text that has lost all its lines is the empty text, which still splits into one
        (lines(before) - F.when(F.col("changed") & (after == ""), F.lit(0)).otherwise(lines(after))).alias("n_deleted"),
        F.crc32(F.coalesce(after, F.lit(""))).alias("text_crc32"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity)


def _joined(spans, test):
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.filter(spans, test), one), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(spans, lambda s: s["base"]), 256).alias("base_sha256"),
        _joined(spans, lambda s: s["kind"].isNotNull()).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = exact_dedup.classes(docs, [exact_dedup.digest().alias("text_sha256")])
    return found.select("doc_id", "keep_id", "group_size", "kept", "carried.text_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(*trie.branched(table(spark, sf_dir, "conversations")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_nearest": op2_nearest,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_token_files": op5_token_files,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}

_OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS coin
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM per_source),
level AS (
  -- the least level at which the capped targets share all tokens: one candidate for each set of capped sources
  SELECT coalesce(min(candidate) FILTER (candidate >= reach AND candidate <= next_reach), 0) AS level
  FROM (
    SELECT cap::DOUBLE / weight AS next_reach, coalesce(lag(cap::DOUBLE / weight) OVER w, 0) AS reach,
           (1.5 * (SELECT sum(source_size) FROM weighed)::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS candidate
    FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST))),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target,
         CASE WHEN source_size > 0 THEN least(cap::DOUBLE, level * weight) / source_size ELSE 0.0 END AS rate
  FROM weighed, level)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
"""

_OP11 = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM hashed WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)
"""

_OP12 = r"""
WITH RECURSIVE placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  -- CRC-32 of the decimal id: one division step for each bit of each digit
  SELECT conv_id, conv_id - conv_id % 20 AS head,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))),
             4294967295::BIGINT) % 4 AS cut
  FROM (SELECT DISTINCT conv_id FROM placed)),
rebuilt AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS place
  FROM (SELECT ids.conv_id, role, text, place FROM ids JOIN placed ON placed.conv_id = head AND place <= cut
        UNION ALL SELECT ids.conv_id, role, text, place FROM ids JOIN placed ON placed.conv_id = ids.conv_id AND place > cut)),
path AS (
  SELECT conv_id, 0 AS depth, '' AS node, '' AS parent, 0 AS words FROM ids
  UNION ALL
  SELECT path.conv_id, depth + 1, md5(node || ':' || md5(role) || md5(text)), node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
  FROM path JOIN rebuilt ON rebuilt.conv_id = path.conv_id AND place = depth + 1),
counted AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words
  FROM path GROUP BY node),
inner_nodes AS (SELECT parent, count(*) AS n_children FROM counted WHERE depth > 0 GROUP BY parent),
below AS (
  SELECT path.node, sum(CASE WHEN inner_nodes.parent IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * counted.words) AS saved_tokens
  FROM counted LEFT JOIN inner_nodes ON inner_nodes.parent = counted.node
  JOIN path ON path.conv_id = counted.conv_id AND path.depth <= counted.depth GROUP BY path.node),
ends AS (
  SELECT node, string_agg(path.conv_id::VARCHAR, ',' ORDER BY path.conv_id) AS ids
  FROM path JOIN (SELECT conv_id, max(depth) AS deepest FROM path GROUP BY conv_id) USING (conv_id) WHERE depth = deepest GROUP BY node)
SELECT counted.conv_id, CAST(counted.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(counted.n AS BIGINT) AS n_convs,
       CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted LEFT JOIN counted AS up ON up.node = counted.parent AND counted.depth > 0
LEFT JOIN inner_nodes ON inner_nodes.parent = counted.node
JOIN below ON below.node = counted.node LEFT JOIN ends ON ends.node = counted.node
"""

_OP13 = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
counts AS (
  SELECT lang, size, array_to_string(words[start : start + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS start
        FROM pieces, range(1, 6) AS sizes(size) WHERE len(words) >= size)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, f, cut, array_to_string(words[: cut], ' ') AS head, array_to_string(words[cut + 1 :], ' ') AS tail
  FROM (SELECT lang, phrase, f, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS cut FROM counts WHERE size > 1)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, cut, l.f AS l, r.f AS r, n,
         CAST((1000::HUGEINT * cuts.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts JOIN counts AS l ON l.lang = cuts.lang AND l.phrase = head JOIN counts AS r ON r.lang = cuts.lang AND r.phrase = tail
  JOIN totals ON totals.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest
  WHERE NOT EXISTS (
    SELECT 1 FROM counts AS longer WHERE longer.lang = lowest.lang AND longer.size > len(string_split(lowest.phrase, ' '))
      AND 100 * longer.f >= 100 * a AND contains(' ' || longer.phrase || ' ', ' ' || lowest.phrase || ' ')))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op4_mixing": _OP4, "op11_exact_dedup": _OP11, "op12_prefix_trie": _OP12, "op13_phrases": _OP13}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
