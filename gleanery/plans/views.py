"""Tables of the engine derived from the driver's test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-04 00:00:00"

# Words that profiles ask for, picked by customer columns.
TEAM_WORDS = ("the", "des", "und", "thnd", "erre", "von", "retion", "nicht", "ontion", "los", "elle")
PLAYER_WORDS = ("of the", "in", "que", "zu", "to the", "anha", "de la")
INTEREST_WORDS = ("that", "attion", "by", "geheit", "et")

ITEMS_SQL = """items as (
  select case doc_id % 3 when 0 then 'rss' when 1 then 'page' else 'video' end as source_type,
    'd' || doc_id as id, split_part(text, chr(10), 1) as title, text as description,
    'https://www.' || source || '.example.com/news/' || doc_id as url,
    timestamp '2024-01-01 00:00:00' + to_minutes((doc_id * 97) % 4320) as published_date,
    text as content, doc_id
  from documents)"""

SCRIPTS_SQL = """scripts as (
  select 'd' || conv_id as id, string_agg(text, '' order by turn) as transcript
  from conversations group by conv_id)"""


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


PROFILES_SQL = f"""profiles as (
  select 'c' || c_custkey as profile_id, c_name as name,
    [{_sql_list(TEAM_WORDS)}[1 + c_nationkey % {len(TEAM_WORDS)}],
     {_sql_list(TEAM_WORDS)}[1 + (c_nationkey + 3) % {len(TEAM_WORDS)}]] as teams,
    [{_sql_list(PLAYER_WORDS)}[1 + c_custkey % {len(PLAYER_WORDS)}]] as players,
    [{_sql_list(INTEREST_WORDS)}[1 + len(c_mktsegment) % {len(INTEREST_WORDS)}]] as interests
  from customer)"""


# Tables whose texts are costly to work on.
_TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Text tables in fewer pieces than there are cores (the test files have one
    row group each) are spread over all cores; larger ones stay as they are read."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _TEXT_TABLES and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows


def source_type(number) -> F.Column:
    return F.when(number % 3 == 0, "rss").when(number % 3 == 1, "page").otherwise("video")


def published(number) -> F.Column:
    minutes = ((number * 97) % 4320).cast("int")
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), minutes
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        source_type(number).alias("source_type"),
        F.concat(F.lit("d"), number).alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/news/"), number).alias("url"),
        published(number).alias("published_date"),
        F.col("text").alias("content"),
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("d"), "conv_id").alias("id"), F.col("turn").alias("pos"), "text"
    )


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as first stored, without transcripts."""
    return items(spark, sf_dir).select(
        "*",
        F.lit(None).cast("string").alias("transcript"),
        F.expr("timestamp_ntz'2024-01-03 12:00:00'").alias("created_at"),
    )


def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a stored and of a new item for each benchmark row."""
    number = F.col("item_id")
    versions = table(spark, sf_dir, "benchmark").select(
        "item_id",
        "text",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("version"),
    )
    kinds = versions.select("*", F.explode(F.array(F.lit("d"), F.lit("b"))).alias("kind"))
    return kinds.select(
        source_type(number).alias("source_type"),
        F.concat("kind", number).alias("id"),
        F.concat(F.lit("version "), "version").alias("title"),
        F.lit("").alias("description"),
        F.concat(F.lit("https://www.example.com/news/"), "kind", number).alias("url"),
        (published(number) + F.make_dt_interval(F.lit(0), F.col("version"))).alias("published_date"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("transcript"),
        (number * 2 + F.col("version")).alias("batch_pos"),
    )


BATCH_SQL = """batch as (
  select case item_id % 3 when 0 then 'rss' when 1 then 'page' else 'video' end as source_type,
    k.kind || item_id as id, 'version ' || v.version as title, '' as description,
    'https://www.example.com/news/' || k.kind || item_id as url,
    timestamp '2024-01-01 00:00:00' + to_minutes((item_id * 97) % 4320) + to_hours(v.version) as published_date,
    text as content, item_id * 2 + v.version as batch_pos
  from benchmark, (values (0), (1)) v(version), (values ('d'), ('b')) k(kind))"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    def word(words, at):
        return F.get(F.array(*[F.lit(w) for w in words]), (at % len(words)).cast("int"))

    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("profile_id"),
        F.col("c_name").alias("name"),
        F.array(word(TEAM_WORDS, nation), word(TEAM_WORDS, nation + 3)).alias("teams"),
        F.array(word(PLAYER_WORDS, F.col("c_custkey"))).alias("players"),
        F.array(word(INTEREST_WORDS, F.length("c_mktsegment"))).alias("interests"),
    )
