"""Queries over the driver's tables, one for each operator of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hmm, jaccard, line_dedup, pieces, token_counts, toxicity, transport, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.corpus_scores(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its class of near copies and the number of documents that it is linked with."""
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_dedup.rewritten(docs.select("doc_id", "text"), counter="removed_lines")


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as media: their markup is the video of a stream, their address the audio."""
    return transport.parsed(transport.muxed(_table(spark, sf_dir, "pages"), "html", "url", "page_id"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_index(_table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_table(spark, sf_dir, "conversations"))


def transport_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams of op4 with their lists as text and the digest of their payload, to be held against what the pages' lengths tell."""
    streams = op4_transport_streams(spark, sf_dir)
    lists = {c: F.array_join(c, ",", "-") for c in ("pts", "dts", "random_access", "sizes", "damaged")}
    return streams.withColumns(lists | {"data_md5": F.md5("data")}).drop("data")


def warc_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page read again through the index of op6."""
    return warc.page_records(_table(spark, sf_dir, "pages"))


def pieces_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viterbi segmentation by the vocabulary of op8 read as a unigram one."""
    return pieces.encoded(_table(spark, sf_dir, "documents"), pieces.Encoder(by_rank=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hmm_scores, op2_jaccard_join, op3_line_dedup, op4_transport_streams, op5_decontaminate, op6_warc_normaliser, op7_toxicity, op8_pieces, op9_token_counts, op10_chat_format, transport_tables, warc_random_access, pieces_by_rank)}


#: The first copy of a line, by doc_id, then by place, stays; lines of fewer than 20 bytes always stay.
LINE_DEDUP_SQL = """
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)
), ranked AS (
  SELECT doc_id, i, line, strlen(line) >= 20 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS gone FROM lines
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
       CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS removed_lines
FROM ranked GROUP BY doc_id
"""


#: Exact: word trigrams, all pairs at a similarity of 0.5 or more, and the least id that can be reached over them.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x09-\x0d\x1c-\x20]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(least(len(w), 1), len(w) - 2) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 2 * c >= x.n + y.n - c),
ends AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached AS (SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT r.id, e.b FROM reached r JOIN ends e ON e.a = r.to_id)
SELECT d.doc_id, (SELECT min(to_id) FROM reached r WHERE r.id = d.doc_id) AS class_id, (SELECT count(*) FROM ends e WHERE e.a = d.doc_id) AS links
FROM documents d
"""


#: Access units of 1,024 bytes, groups of 12; a PES header has 19 bytes with two times and 14 with one, a packet takes 184 bytes, or 182
#: if it is flagged as a random-access point.
TRANSPORT_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS v, coalesce(url, '') AS a, CAST(ceil(strlen(coalesce(html, '')) / 1024.0) AS BIGINT) AS units FROM pages
), g AS (SELECT *, greatest(1, CAST(ceil(units / 12.0) AS BIGINT)) AS groups FROM p),
s AS (SELECT *, CAST(ceil(strlen(a) / CAST(groups AS DOUBLE)) AS BIGINT) AS share FROM g),
streams AS (
  SELECT page_id, 257 AS pid, 27 AS stream_type, v AS data, list_transform(range(units), lambda k: least(1024, strlen(v) - 1024 * k)) AS sizes,
         list_transform(range(units), lambda k: 97200 + 3600 * k) AS pts, list_transform(range(units), lambda k: CAST(90000 + 3600 * k AS VARCHAR)) AS dts,
         list_filter(range(units), lambda k: k % 12 = 0) AS random_access, 19 AS head, 12 AS flagged FROM s
  UNION ALL
  SELECT page_id, 258, 15, a, list_filter(list_transform(range(groups), lambda k: least(share, strlen(a) - share * k)), lambda x: x > 0),
         list_transform(range(CAST(ceil(strlen(a) / greatest(share, 1)) AS BIGINT)), lambda k: 90000 + 43200 * k), list_transform(range(CAST(ceil(strlen(a) / greatest(share, 1)) AS BIGINT)), lambda k: '-'),
         [], 14, 0 FROM s
)
SELECT page_id AS media_id, 1 AS program, pid, stream_type,
       CAST(coalesce(list_sum(list_transform(sizes, lambda x, i: CASE WHEN flagged > 0 AND (i - 1) % 12 = 0 THEN 1 + ceil(greatest(0, x + head - 182) / 184.0) ELSE ceil((x + head) / 184.0) END)), 0) AS INTEGER) AS packets,
       0 AS continuity_errors, 0 AS duplicates, 0 AS dropped, 0 AS sync_errors,
       coalesce(array_to_string(list_transform(pts, lambda x: CAST(x AS VARCHAR)), ','), '') AS pts, coalesce(array_to_string(dts, ','), '') AS dts,
       coalesce(array_to_string(list_transform(random_access, lambda x: CAST(x AS VARCHAR)), ','), '') AS random_access,
       coalesce(array_to_string(list_transform(sizes, lambda x: CAST(x AS VARCHAR)), ','), '') AS sizes, '' AS damaged, md5(data) AS data_md5
FROM streams
"""

WARC_SQL = """
SELECT page_id, url AS uri, CAST(strlen(content) AS BIGINT) AS content_length, md5(content) AS body_md5
FROM (SELECT page_id, url, replace('HTTP/1.1 200 OK|Content-Type: text/html; charset=utf-8||', '|', chr(13) || chr(10)) || coalesce(html, '') AS content FROM pages)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": JACCARD_SQL, "op3_line_dedup": LINE_DEDUP_SQL, "op10_chat_format": chat.SQL, "transport_tables": TRANSPORT_SQL, "warc_random_access": WARC_SQL}
