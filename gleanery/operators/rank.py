"""Ranking for interest profiles: top-n per profile, full ranking for one, supplied scores.

Default score of an item for a profile, with t, p, i the numbers of distinct team,
player and interest phrases found in its title and summary, and age in hours:

    least(10, 3*least(t,2) + 2.5*least(p,2) + least(i,3) + 2*greatest(0, 1 - age/24))

Order: score descending, newer first, id ascending.

Top-n per profile is exact without pairing every item with every profile:

* profiles that ask for the same phrases are ranked once;
* an item counts by the set of phrases found in it. Among items with equal sets the
  newer one never scores less, so the n newest of each set stand for all of it, and
  wishes meet sets, not items;
* of the sets that give a wish the same points, only the n with the newest items matter;
* an item without any hit can only be in a top-n if it is among the n newest of all.

A phrase in very many sets is dealt over `PHRASE_PARTS` tasks by a digest of the set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.once import bound
from gleanery.functions.text import match_form
from gleanery.operators.latest import first_per_key
from gleanery.session import freeze_table, ntz

TOP_N = 10
# kind: (profile column, points for each phrase found, phrases that count)
KINDS = {
    "t": ("teams", 3.0, 2),
    "p": ("players", 2.5, 2),
    "i": ("interests", 1.0, 3),
}
RECENCY_POINTS = 2.0
RECENCY_HOURS = 24.0
MAX_SCORE = 10.0
# Lower bounds of the score bands.
BANDS = ((9.0, "high"), (7.0, "very relevant"), (5.0, "moderate"), (3.0, "some"), (0.0, "low"))

# Parts of each phrase's sets; every wish for it meets each part once.
PHRASE_PARTS = 8


def _best_first(score: str = "relevance_score") -> list[Column]:
    return [F.desc(score), F.desc("published"), F.asc("id")]


def recency(published: Column, as_of) -> Column:
    """Points for freshness, zero from the end of the look-back window on."""
    age = ntz(as_of) - published
    hours = (
        F.extract(F.lit("DAY"), age) * 24
        + F.extract(F.lit("HOUR"), age)
        + F.extract(F.lit("MINUTE"), age) / 60
        + F.extract(F.lit("SECOND"), age).cast("double") / 3600
    )
    return F.round(F.lit(RECENCY_POINTS) * F.greatest(F.lit(0.0), 1 - hours / RECENCY_HOURS), 4)


def total_score(points: Column, fresh: Column) -> Column:
    return F.round(F.least(F.lit(MAX_SCORE), points + fresh), 4)


def band(score: Column) -> Column:
    """Name of the score band."""
    named = F.when(score >= BANDS[0][0], BANDS[0][1])
    for low, name in BANDS[1:]:
        named = named.when(score >= low, name)
    return named


def _points(counts: dict[str, Column]) -> Column:
    points = F.lit(0.0)
    for kind, (_, each, most) in KINDS.items():
        points = points + F.lit(each) * F.least(counts[kind], F.lit(most))
    return points


def _phrases(kind: str) -> Column:
    """Distinct match forms of a profile's phrases of one kind, marked like ``t:some words``."""
    forms = F.transform(F.coalesce(F.col(KINDS[kind][0]), F.array()), match_form)
    given = F.array_distinct(F.filter(forms, lambda f: f != ""))
    return F.transform(given, lambda f: F.concat(F.lit(f"{kind}:"), f))


def all_phrases() -> Column:
    return F.array_sort(F.concat(*[_phrases(k) for k in KINDS]))


def _form(phrase: Column) -> Column:
    return F.substring(phrase, 3, 2**31 - 1)


def padded_form(*texts: Column) -> Column:
    """Match form of the texts between blanks, so that whole phrases are substrings."""
    return F.concat(F.lit(" "), match_form(F.concat_ws(" ", *texts)), F.lit(" "))


def found_phrases(phrases: Column, padded: Column) -> Column:
    """Phrases (marked) that occur in ``padded``, a plain column holding a padded form."""
    return F.filter(phrases, lambda p: F.contains(padded, F.concat(F.lit(" "), _form(p), F.lit(" "))))


def _item_phrases(items: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, published, fresh, phrase) of every phrase found in an item.

    Items are cut into word runs of the lengths that occur, so that the search is an
    equi-join on the run instead of a test of every phrase on every item.
    """
    listed = phrases.select(_form(F.col("phrase")).alias("form"), "phrase")
    # As many values as there are phrase lengths, in words.
    sizes = listed.select(F.size(F.split("form", " ")).alias("n")).distinct().orderBy("n").collect()
    words = F.split(match_form(F.concat_ws(" ", "title", "summary")), " ")
    worded = items.select("id", "published", "fresh", words.alias("words"))

    def runs(n: int) -> Column:
        if n == 1:
            return F.col("words")
        starts = F.when(
            F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice("words", s, n), " "))

    every = [runs(r["n"]) for r in sizes] or [F.array().cast("array<string>")]
    # The outer form, as for the plain one Spark would build the runs once more to filter on them.
    found = worded.select(
        "id", "published", "fresh", F.explode_outer(F.array_distinct(F.concat(*every))).alias("form")
    )
    return found.join(listed, "form").select("id", "published", "fresh", "phrase")


def _set_hits(wishes: DataFrame, item_phrases: DataFrame, top_n: int) -> DataFrame:
    """(wish, id, published, fresh, points) of items that can be among a wish's best."""
    held = item_phrases.groupBy("id", "published", "fresh").agg(F.array_sort(F.collect_set("phrase")).alias("held"))
    newest = first_per_key(held, ["held"], [F.desc("published"), F.asc("id")], top_n, number="nth")
    newest = freeze_table(newest.withColumn("key", F.md5(F.array_join("held", "\u0001"))), "phrase-sets")

    # A set goes by its newest item; of equally new ones the smaller id comes first.
    sets = newest.filter("nth = 1")
    part = F.pmod(F.xxhash64("key"), F.lit(PHRASE_PARTS)).cast("int")
    of_sets = sets.select("key", "published", "id", part.alias("part"), F.explode("held").alias("phrase"))
    of_wishes = wishes.select("wish", F.explode("phrases").alias("phrase"))
    of_wishes = of_wishes.select("wish", "phrase", F.explode(F.sequence(F.lit(0), F.lit(PHRASE_PARTS - 1))).alias("part"))
    kind = F.substring("phrase", 1, 1)
    pairs = (
        of_wishes.join(of_sets, ["phrase", "part"])
        .groupBy("wish", "key", "published", "id")
        .agg(*[F.count(F.when(kind == k, 1)).alias(k) for k in KINDS])
        .select("wish", "key", "published", "id", _points({k: F.col(k) for k in KINDS}).alias("points"))
    )
    kept = first_per_key(pairs, ["wish", "points"], [F.desc("published"), F.asc("id")], top_n)
    return kept.select("wish", "key", "points").join(
        newest.select("key", "id", "published", "fresh"), "key"
    ).select("wish", "id", "published", "fresh", "points")


def rank_for_wishes(
    summaries: DataFrame,
    profiles: DataFrame,
    as_of=None,
    top_n: int = TOP_N,
) -> tuple[DataFrame, DataFrame]:
    """(profile_id, wish) and (wish, id, rank, relevance_score): what each profile asks for, and
    the ``top_n`` best summaries of each wish, once for all profiles that share it."""
    items = summaries.select(
        "id",
        "title",
        F.col("summary_text").alias("summary"),
        F.col("article_created_at").alias("published"),
        recency(F.col("article_created_at"), as_of).alias("fresh"),
    )
    asked = profiles.select("profile_id", all_phrases().alias("phrases"))
    # Equal phrase lists get one number; it is frozen, as a lost task could renumber.
    numbered = freeze_table(
        asked.select("phrases").distinct().withColumn("wish", F.monotonically_increasing_id()), "wishes"
    )
    phrases = numbered.select(F.explode("phrases").alias("phrase")).distinct()
    item_phrases = freeze_table(_item_phrases(items, phrases), "item-phrases")
    wishes = numbered.select("wish", "phrases")
    found = _set_hits(wishes, item_phrases, top_n)
    newest = items.select("id", "published", "fresh").orderBy(F.desc("published"), F.asc("id")).limit(top_n)
    newest = newest.collect()  # top_n rows
    if newest:
        slots = F.array(
            *[
                F.struct(
                    F.lit(r["id"]).alias("id"), ntz(r["published"]).alias("published"), F.lit(r["fresh"]).alias("fresh")
                )
                for r in newest
            ]
        )
        filler = wishes.select("wish", F.inline(slots)).withColumn("points", F.lit(0.0))
        found = found.unionByName(filler)

    best = (
        found
        .groupBy("wish", "id", "published", "fresh")
        .agg(F.max("points").alias("points"))
        .withColumn("relevance_score", total_score(F.col("points"), F.col("fresh")))
    )
    ranked = first_per_key(best, ["wish"], _best_first(), top_n, number="rank")
    of_profile = asked.join(numbered, "phrases").select("profile_id", "wish")
    return of_profile, ranked.select("wish", "id", "rank", "relevance_score")


def rank_for_profiles(
    summaries: DataFrame,
    profiles: DataFrame,
    as_of=None,
    top_n: int = TOP_N,
) -> DataFrame:
    """(profile_id, id, rank, relevance_score): the ``top_n`` best summaries of each profile."""
    of_profile, ranked = rank_for_wishes(summaries, profiles, as_of, top_n)
    return of_profile.join(ranked, "wish").select("profile_id", "id", "rank", "relevance_score")


def with_global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with a gapless ``rank`` 1..n in ``order``, without moving all rows to one task."""
    numbered = freeze_table(
        rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted"
    )
    # The id holds the task's number above bit 33 and the row's number in the task below.
    task, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(task.alias("_task")).count().orderBy("_task").collect()  # one row per task
    offsets, total = [], 0
    for size in sizes:
        offsets.append((size["_task"], total))
        total += size["count"]
    offset = rows.sparkSession.createDataFrame(offsets, "_task long, _offset long")
    placed = numbered.withColumn("_task", task).join(F.broadcast(offset), "_task")
    return placed.withColumn("rank", (F.col("_offset") + row + 1).cast("int")).drop("_at", "_task", "_offset")


def rank_all(summaries: DataFrame, profile: dict, as_of=None) -> DataFrame:
    """(id, rank, relevance_score, reasoning): every summary ranked for one profile."""
    given = {column: F.array(*[F.lit(v) for v in profile.get(column) or []]).cast("array<string>")
             for column, _, _ in KINDS.values()}
    padded = padded_form(F.col("title"), F.col("summary_text"))
    rows = summaries.select("id", F.col("article_created_at").alias("published"), padded.alias("padded"))
    asked = rows.sparkSession.range(1).select(F.lit(1).alias("one")).withColumns(given)
    phrases = asked.select(all_phrases()).first()[0]
    listed = F.array(*[F.lit(p) for p in phrases]).cast("array<string>")
    rows = rows.select("id", "published", bound(F.col("padded"), lambda t: found_phrases(listed, t)).alias("found"))

    def hits(kind: str) -> Column:
        return F.size(F.filter("found", lambda p: p.startswith(f"{kind}:")))

    counts = {kind: hits(kind) for kind in KINDS}
    score = total_score(_points(counts), recency(F.col("published"), as_of))
    scored = rows.select("id", "published", score.alias("relevance_score"), reasoning(F.col("found")).alias("reasoning"))
    return with_global_rank(scored, _best_first()).select("id", "rank", "relevance_score", "reasoning")


def reasoning(found: Column) -> Column:
    """The matched phrases in words."""
    listed = F.array_join(F.transform(found, _form), ", ")
    return F.when(F.size(found) > 0, F.concat(F.lit("Mentions: "), listed)).otherwise(F.lit("No stated interest"))


def check_scores(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows a model supplied, split into valid ones and rejects."""
    valid = F.coalesce(
        F.col("profile_id").isNotNull()
        & F.col("summary_id").isNotNull()
        & F.col("relevance_score").between(0.0, MAX_SCORE)
        & ~F.isnan("relevance_score")
        & (F.col("rank") >= 1)
        & F.col("reasoning").isNotNull(),
        F.lit(False),
    )
    return scores.filter(valid), scores.filter(~valid)


def top_supplied(scores: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """The ``top_n`` lowest ranks of each profile, before ids are looked up."""
    return first_per_key(scores, ["profile_id"], [F.asc("rank"), F.asc("summary_id")], top_n)
