"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

1. A text, white space runs as one blank, is cut where its content says so: a chunk ends
   behind the first sentence mark and blank that follows its first `LEAST` characters, or
   after `MOST` characters. Equal texts are cut alike.
2. Chunks are deduplicated by digest. The contents under one digest are compared: a digest
   with more than one content is no identifier, and its chunks are named by their content.
   This is the one time that text is shuffled, each distinct chunk of a task once.
3. A document is from then on the ordered list of its chunks' identifiers. Documents with
   equal lists are equal; the lists are grouped with partial aggregation, so a group with a
   third of all rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.words import single_spaced, whole
from gleanery.session import freeze_table

LEAST, MOST = 512, 4096
SALTS = 32  # most tasks that a group of equal texts is looked up from
CUT = rf"(?s).{{{LEAST},{MOST - 2}}}?[.!?;:] |.{{1,{MOST}}}"


def chunks(text: Column, cut: str = CUT) -> Column:
    """The text's chunks in order; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def digest(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def clashing_digests(cut: DataFrame, digest=digest) -> DataFrame:
    """Digests under which the chunks of ``cut`` (column ``chunks``) have several contents."""
    occurrences = cut.select(F.explode("chunks").alias("chunk"))
    distinct = occurrences.groupBy(digest(F.col("chunk")).alias("digest")).agg(
        F.min("chunk").alias("lowest"), F.max("chunk").alias("highest")
    )
    return distinct.filter("lowest <> highest").select("digest")


def with_recipes(cut: DataFrame, clashing: DataFrame, digest=digest) -> DataFrame:
    """``cut`` with ``recipe``, the verified identifiers of its chunks in order."""
    plain = F.transform("chunks", digest)
    if clashing.isEmpty():
        return cut.withColumn("recipe", plain).drop("chunks")
    # Content as the identifier where the digest is none; one byte tells the two kinds apart.
    rows = cut.withColumn("_row", F.monotonically_increasing_id())
    rows = freeze_table(rows, "cut")
    parts = rows.select("_row", F.posexplode("chunks").alias("_pos", "chunk"))
    parts = parts.withColumn("digest", digest(F.col("chunk")))
    named = parts.join(clashing.withColumn("_clash", F.lit(True)), "digest", "left").select(
        "_row",
        "_pos",
        F.when(F.col("_clash"), F.concat(F.lit(b"\x01"), F.col("chunk").cast("binary")))
        .otherwise(F.concat(F.lit(b"\x00"), "digest"))
        .alias("name"),
    )
    lists = named.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", "name"))).alias("_list"))
    lists = lists.select("_row", F.col("_list.name").alias("recipe"))
    joined = rows.drop("chunks").join(lists, "_row", "left")
    return joined.withColumn("recipe", F.coalesce("recipe", F.expr("cast(array() as array<binary>)"))).drop("_row")


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest=digest, cut: str = CUT
) -> DataFrame:
    """``id_column, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when they are after each run of white space became one blank; a missing
    text counts as an empty one. Of equal texts the row with the smallest id stays. Rows with
    a missing id never win against one that has an id; where a group has no id at all its
    keep_id is null and none of its rows is kept. Rows that repeat the smallest id are all
    marked as kept. Other columns are not read.
    """
    spaced = docs.select(F.col(id_column).alias("_id"), single_spaced(whole(text_column)).alias("_text"))
    rows = spaced.select("_id", chunks(F.col("_text"), cut).alias("chunks"), F.sha2("_text", 256).alias("text_sha256"))
    recipes = with_recipes(rows, freeze_table(clashing_digests(rows, digest), "clashing"), digest)
    recipes = freeze_table(recipes, "recipes")
    salted = recipes.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    groups = salted.groupBy("recipe").agg(
        F.min("_id").alias("keep_id"),
        F.count("*").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_salts"),
    )
    # Only groups of two or more are looked up, each from the tasks that its rows are dealt to:
    # a group with a third of all rows is not one task, a pair is there twice at most, and rows
    # alone in their group meet nothing.
    asked = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("_salts", s) == 1)
    several = groups.filter("group_size > 1").select("recipe", "keep_id", "group_size", F.explode(asked).alias("_salt"))
    joined = salted.join(several, ["recipe", "_salt"], "left").withColumns(
        {"keep_id": F.coalesce("keep_id", "_id"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))}
    )
    return joined.select(
        F.col("_id").alias(id_column),
        "keep_id",
        "group_size",
        F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns. A row goes when none of the rows with its
    id is kept; rows with a missing id stay."""
    by_id = exact_groups(docs, id_column, text_column).groupBy(id_column).agg(F.max("kept").alias("kept"))
    dropped = by_id.filter(~F.col("kept") & F.col(id_column).isNotNull()).select(id_column)
    return docs.join(dropped, id_column, "left_anti").select(*docs.columns)
