"""The queries that apply this subpackage's operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import Scratch, table
from batchloom.llm.minhash import edited_fingerprints
from batchloom.llm.mixing import ORACLE as MIXING_ORACLE
from batchloom.llm.mixing import replicate
from batchloom.llm.pieces import Model, encode
from batchloom.llm.quality import classify
from batchloom.llm.secrets import digest, find_secrets
from batchloom.llm.simhash import near_duplicates
from batchloom.llm.surrogates import KINDS, pseudonymise
from batchloom.llm.token_files import read_tokens, summary, write_tokens
from batchloom.llm.url_lists import filter_captures, host_of
from batchloom.llm.vector_graph import near_vectors

# Dated entries of a blocking list (host, date, 1: put on, 0: taken off).
LIST_ENTRIES = (
    ("spam-farm.example.org", "2020-03-01", 1),
    ("spam-farm.example.org", "2023-06-15", 0),
    ("ads-track.example.com", "2021-01-10", 1),
    ("ads-track.example.com", "2021-11-05", 0),
    ("ads-track.example.com", "2022-09-20", 1),
    ("casino-win.example.com", "2019-12-01", 1),
    ("free-bets.example.com", "2022-02-28", 1),
    ("free-bets.example.com", "2022-02-28", 0),
    ("free-bets.example.com", "2024-01-01", 0),
)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = pseudonymise(table(spark, sf_dir, "documents"), Scratch(spark))
    count = lambda kind: F.size(F.filter("_found", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    return new.select("doc_id", "text", "n_chars", *map(count, KINDS))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = Model.read(str(public_tokenizers.path("piece_bpe_32k.model")))
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark), model)
    return found.select("doc_id", F.col("_ids").alias("ids"), F.size("_ids").cast("bigint").alias("n_tokens"), F.col("_round_trip").alias("round_trip"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no list and no fetch times: the time follows from the page id, and besides
    the fixed entries a quarter of the hosts is listed for a time, by the hash of the host."""
    day = lambda base, n: F.date_add(F.lit(base).cast("date"), n.cast("int"))
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", day("2020-01-01", F.pmod(F.col("page_id") * 7919, F.lit(1826))).alias("fetched"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    digit = lambda i: F.conv(F.substr(F.md5("host"), F.lit(i), F.lit(2)), 16, 10).cast("int")
    spans = hosts.where(digit(1) < 64).select("host", F.explode(F.array(F.struct(day("2020-02-01", digit(3) * 4).alias("ts"), F.lit(True).alias("listed")), F.struct(day("2020-02-01", digit(3) * 4 + 30 + digit(5) * 3).alias("ts"), F.lit(False).alias("listed")))).alias("e"))
    fixed = spark.createDataFrame(LIST_ENTRIES, "host string, ts string, listed int")
    entries = spans.select("host", "e.ts", "e.listed").unionByName(fixed.select("host", F.col("ts").cast("date").alias("ts"), (F.col("listed") == 1).alias("listed")))
    found = filter_captures(captures, entries)
    return found.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "listed_host", F.col("listed_from").cast("string").alias("listed_from"), "blocked")


_URL_ORACLE = f"""
WITH captures AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '[.]+$', ''), '') AS host,
    DATE '2020-01-01' + ((page_id * 7919) % 1826)::INTEGER AS fetched FROM pages
),
hosts AS (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL),
digits AS (SELECT host, ('0x' || substr(md5(host), 1, 2))::INTEGER AS a, ('0x' || substr(md5(host), 3, 2))::INTEGER AS b, ('0x' || substr(md5(host), 5, 2))::INTEGER AS c FROM hosts),
entries AS (
  SELECT host, DATE '2020-02-01' + b * 4 AS ts, 1 AS listed FROM digits WHERE a < 64
  UNION ALL SELECT host, DATE '2020-02-01' + (b * 4 + 30 + c * 3), 0 FROM digits WHERE a < 64
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{h}', DATE '{d}', {x})" for h, d, x in LIST_ENTRIES)}) v
),
single AS (SELECT host, ts, max(listed) AS listed FROM entries GROUP BY ALL),
changed AS (SELECT * FROM (SELECT *, lag(listed, 1, 0) OVER (PARTITION BY host ORDER BY ts) AS was FROM single) x WHERE listed <> was),
spans AS (SELECT host AS listed_host, listed, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY host ORDER BY ts), DATE '9999-12-31') AS valid_to FROM changed),
hits AS (
  SELECT DISTINCT c.host, c.fetched, s.listed_host, s.valid_from FROM (SELECT DISTINCT host, fetched FROM captures) c
  JOIN spans s ON s.listed = 1 AND (c.host = s.listed_host OR ends_with(c.host, '.' || s.listed_host)) AND s.valid_from <= c.fetched AND c.fetched < s.valid_to
),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY host, fetched ORDER BY length(listed_host) DESC) = 1)
SELECT c.page_id, c.host, c.fetched::VARCHAR AS fetched, b.listed_host, b.valid_from::VARCHAR AS listed_from, b.listed_host IS NOT NULL AS blocked
FROM captures c LEFT JOIN best b ON c.host = b.host AND c.fetched = b.fetched
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))
    return found.select("doc_id", "lang", F.col("_perplexity").alias("perplexity"), F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_keep").alias("keep"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark).path("tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, str(public_tokenizers.path("word_bpe_49k.json")))
    return summary(read_tokens(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_secret_scan": op1_secret_scan, "op2_pii_surrogates": op2_pii_surrogates, "op3_minhash": op3_minhash, "op4_vector_graph": op4_vector_graph, "op5_pieces": op5_pieces, "op6_mixing": op6_mixing, "op7_url_lists": op7_url_lists, "op8_simhash": op8_simhash, "op9_quality": op9_quality, "op10_token_files": op10_token_files}

#: Only what SQL can express; the rest is held against brute force in tests/llm.
ORACLES: dict[str, str] = {"op6_mixing": MIXING_ORACLE, "op7_url_lists": _URL_ORACLE}
