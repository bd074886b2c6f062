"""Mixing sources to target weights as a min-cost flow.

1. Documents are aggregated by membership pattern, the sorted set of sources that hold them:
   one row per pattern with its words. Nothing of single documents reaches the driver.
2. Targets: the budget is shared by weight; no source is asked for more than ``repeats``
   times what it holds, and what that leaves over is shared again by weight.
3. Words flow from patterns to the quotas of their sources. The k-th repetition of a
   pattern is an arc of its own with cost k * k, so costs are convex and a flow repeats as
   few words as it can. Successive shortest paths give the exact minimum.
4. Documents of a pattern stand in the order of a seeded digest. The pattern's flow claims a
   stretch of that order, once around for each repetition; whole documents inside the
   stretch of a source are taken for it, and what is then missing is filled by the one
   further document whose size comes nearest.
5. Where very long documents straddle the ends of stretches, one document does not mend that.
   A source that is then off by more than `NEAR` of its median documents goes on in the
   seeded order with as many whole documents as it takes, first copies before second ones.

The running sums over a pattern are made per bucket of digests, so that a source with a
third of all rows is spread over as many tasks as there are buckets.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.words import unused, whole, word_count
from gleanery.session import freeze_table

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
REPEATS = 2
SEED = "mix-1"
MADE = ["members", "size", "source_size", "target", "copies", "taken", "served"]
BUCKET_DIGITS = 3  # hexadecimal digits of the digest that make a bucket: 4,096 a pattern
# Patterns are combinations of sources; the flow is solved on the driver up to this many.
MAX_PATTERNS = 100_000
# Median documents by which a source may miss its words after one fill for each claim; one
# that is further off is filled by more documents.
NEAR = 5


def cyclic_weights(sources: Sequence[str | None], weights: Sequence[int] = WEIGHTS) -> list[int]:
    return [weights[i % len(weights)] for i in range(len(sources))]


def capped_targets(
    held: Sequence[int], weights: Sequence[int], budget: Fraction, repeats: int = REPEATS
) -> list[Fraction]:
    """Shares of ``budget`` by weight, none above ``repeats`` times what its source holds."""
    caps = [repeats * h for h in held]
    open_ = list(range(len(held)))
    out = [Fraction(0)] * len(held)
    rest = Fraction(budget)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * rest >= caps[i] * weight]
        if not full:
            for i in open_:
                out[i] = Fraction(weights[i]) * rest / weight
            break
        for i in full:
            out[i] = Fraction(caps[i])
        rest -= sum(caps[i] for i in full)
        capped = set(full)
        open_ = [i for i in open_ if i not in capped]
    return out


def rounded_quotas(targets: Sequence[Fraction]) -> list[int]:
    """Whole words near the targets, with the same sum up to half a word."""
    return [int(t + Fraction(1, 2)) for t in targets]


def cheapest_flow(
    patterns: Sequence[tuple[tuple[int, ...], int]], quotas: Sequence[int], repeats: int = REPEATS
) -> list[dict[int, int]]:
    """Words that each pattern sends to each source: {source: words} per pattern.

    ``patterns`` are (sources, words). Successive shortest augmenting paths over a bipartite
    network; the k-th repetition of a pattern's words costs k * k a word. Words handed from one
    source to another cost nothing, so a path costs what its first word does, and a search ends
    at the first source whose cheapest word costs no more than the cheapest of all.
    """
    n, m = len(patterns), len(quotas)
    used = [0] * n
    sent: list[dict[int, int]] = [{} for _ in range(n)]
    missing = list(quotas)

    def price(p: int) -> int | None:
        k = used[p] // patterns[p][1]
        return None if k >= repeats else (k + 1) ** 2

    # The patterns of each source by the price of their next word. Prices only rise, so an entry
    # that is out of date is put back at its new price when it comes up.
    offers: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for p, (members, words) in enumerate(patterns):
        if words > 0 and repeats > 0:
            for s in members:
                offers[s].append((1, p))
    for heap in offers:
        heapq.heapify(heap)
    # hands[a][b]: patterns of source a that send words to b, which could go to a instead.
    hands: list[dict[int, dict[int, None]]] = [{} for _ in range(m)]

    def send(p: int, s: int, words: int) -> None:
        before = sent[p].get(s, 0)
        sent[p][s] = before + words
        if before == 0 and words > 0:
            for other in patterns[p][0]:
                if other != s:
                    hands[other].setdefault(s, {})[p] = None
        elif before + words == 0 and before > 0:
            for other in patterns[p][0]:
                if other != s:
                    del hands[other][s][p]
                    if not hands[other][s]:
                        del hands[other][s]

    def cheapest(s: int) -> tuple[int, int] | None:
        heap = offers[s]
        while heap:
            now = price(heap[0][1])
            if now is None:
                heapq.heappop(heap)
            elif now != heap[0][0]:
                heapq.heapreplace(heap, (now, heap[0][1]))
            else:
                return heap[0]
        return None

    for target in range(m):
        while missing[target] > 0:
            tops = [cheapest(s) for s in range(m)]
            floor = min((t[0] for t in tops if t), default=None)
            if floor is None:
                break  # all words are used up
            # Cheapest way to one more word at `target`: from a pattern of its own, or from a
            # pattern of another source that hands one of its words on.
            came: dict[int, int | None] = {target: None}
            queue, best = deque([target]), None
            while queue:
                at = queue.popleft()
                if tops[at] and (best is None or tops[at][0] < best[0][0]):
                    best = (tops[at], at)
                    if tops[at][0] <= floor:
                        break
                for other in hands[at]:
                    if other not in came:
                        came[other] = at
                        queue.append(other)
            if best is None:
                break  # nothing holds more words for this source
            (_, p), at = best
            words = patterns[p][1]
            path, node = [], at
            amount = min((used[p] // words + 1) * words - used[p], missing[target])
            while came[node] is not None:
                towards = came[node]
                through = next(iter(hands[towards][node]))
                path.append((node, towards, through))
                amount = min(amount, sent[through][node])
                node = towards
            used[p] += amount
            send(p, at, amount)
            for source, towards, through in path:
                send(through, source, -amount)
                send(through, towards, amount)
            missing[target] -= amount
    return [{s: w for s, w in row.items() if w > 0} for row in sent]


def _order(id_column: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))


def _further(rows: DataFrame, taken: DataFrame, gaps: Mapping[int, int], repeats: int) -> tuple[DataFrame, dict[int, int]]:
    """Whole documents for the gaps of sources, (_row, _to, size), and what is then missing.

    ``rows`` has a row for each document and source ``_to`` that may take it, ``taken`` a row for
    each copy that is gone. In each round a source takes documents in the seeded order, those
    with fewer copies gone first, up to the first that does not fit any more, which leaves the
    later rounds; one that fills the gap alone stands before all. When none fits, the smallest
    is taken if that is nearer. Of sources that meet at one document one gets it in a round.
    """
    spark, missing, found = rows.sparkSession, dict(gaps), []
    gone = taken.groupBy("_row").agg(F.count("*").cast("int").alias("_gone"))
    left = rows.join(gone, "_row", "left").withColumn("_gone", F.coalesce("_gone", F.lit(0)))
    while True:
        asked = spark.createDataFrame([(s, g) for s, g in missing.items() if g > 0], "_to int, _gap long")
        helping = left.join(F.broadcast(asked), "_to").filter((F.col("_gone") < repeats) & (F.col("size") < 2 * F.col("_gap")))
        left = freeze_table(helping.drop("_gap"), "left")
        least = left.groupBy("_to").agg(F.min("size").alias("least")).collect()  # one row per source
        if not least:
            break
        room = [(r["_to"], max(missing[r["_to"]], r["least"])) for r in least]
        fitting = left.join(F.broadcast(spark.createDataFrame(room, "_to int, _room long")), "_to").filter("size <= _room")
        fitting = fitting.withColumn("_rank", F.when(F.col("size") == F.col("_room"), -1).otherwise(F.col("_gone")))
        # Running sums by bucket; only the buckets that begin inside the gap are sorted.
        place = ["_to", "_rank", "_bucket"]
        sums = fitting.groupBy(*place, "_room").agg(F.sum("size").alias("_words"))
        ahead = Window.partitionBy("_to").orderBy("_rank", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.withColumn("_start", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).filter("_start < _room")
        inside = Window.partitionBy(*place).orderBy("_digest", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
        placed = fitting.join(starts.select(*place, "_start"), place).withColumn("_run", F.sum("size").over(inside))
        offers = placed.filter("_start + _run <= _room")
        one = F.min(F.struct(F.xxhash64("_digest", "_to").alias("draw"), "_to", "size")).alias("one")
        got = freeze_table(offers.groupBy("_row").agg(one).select("_row", "one._to", "one.size"), "fill")
        found.append(got)
        for r in got.groupBy("_to").agg(F.sum("size").alias("words")).collect():
            missing[r["_to"]] -= r["words"]
        more = got.select("_row", F.lit(1).alias("_more"))
        left = left.join(more, "_row", "left").withColumn("_gone", F.col("_gone") + F.coalesce("_more", F.lit(0))).drop("_more")
    whole = rows.select("_row", "_to", "size").limit(0)
    for got in found:
        whole = whole.unionByName(got)
    return whole, missing


def mix(
    docs: DataFrame,
    memberships: Column | None = None,
    weights: Sequence[int] | Mapping[str | None, int] = WEIGHTS,
    share: Fraction = SHARE,
    repeats: int = REPEATS,
    seed: str = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """How often each document is taken: ``id_column, members, size, source_size, target,
    copies, taken, served``, and the columns ``keep``.

    ``memberships`` is an array column of the sources that hold a document; by default it has
    the one in ``source``. A missing source is a source of its own, after all others; a
    missing or empty array counts as it. ``source_size`` and ``target`` are those of the first
    member. ``size`` is the number of words, 0 for a missing text; such documents are never
    taken. ``served`` names the source that each copy is counted to. Rows that repeat an id are
    documents of their own. The id and kept columns that are called like a column made here
    come with underscores behind their names.
    """
    if memberships is None:
        memberships = F.array("source")
    clean = F.when(F.size(memberships) > 0, memberships)
    named = F.coalesce(clean, F.array(F.lit(None).cast("string")))
    members = F.array_sort(F.array_distinct(named))  # missing last
    kept = {f"_keep{i}": name for i, name in enumerate(keep)}
    rows = docs.select(
        F.col(id_column).alias("_id"),
        members.alias("members"),
        word_count(whole(text_column)).alias("size"),
        *[F.col(name).alias(held_as) for held_as, name in kept.items()],
    ).withColumn("_digest", _order("_id", seed))
    rows = rows.withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
    # Row keys differ when a task runs again, so they are written before they are used.
    rows = freeze_table(rows.withColumn("_row", F.monotonically_increasing_id()), "mix")
    spark = rows.sparkSession

    patterns = rows.groupBy("members").agg(F.sum("size").alias("words"))
    found = patterns.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} combinations of sources; join rare sources first")
    found = sorted(((tuple(r["members"]), int(r["words"])) for r in found), key=lambda r: [(s is None, s or "") for s in r[0]])
    sources = sorted({s for p, _ in found for s in p}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(sources)}
    held = [0] * len(sources)
    for pattern, words in found:
        for s in pattern:
            held[place[s]] += words
    weigh = (
        [weights.get(s, 0) for s in sources] if isinstance(weights, Mapping) else cyclic_weights(sources, weights)
    )
    total = sum(words for _, words in found)
    targets = capped_targets(held, weigh, share * total, repeats)
    flow = cheapest_flow([(tuple(place[s] for s in p), w) for p, w in found], rounded_quotas(targets), repeats)

    # Claims: stretches [low, high) of a pattern's order, by pattern and repetition.
    claims: dict[tuple, list[tuple]] = {}
    for number, ((pattern, words), sent) in enumerate(zip(found, flow)):
        at = 0
        for s, amount in sorted(sent.items()):
            low, at = at, at + amount
            for k in range(low // words, (at - 1) // words + 1):
                cut = (max(low, k * words) - k * words, min(at, (k + 1) * words) - k * words)
                claims.setdefault((number, k), []).append((f"{number}-{k}-{s}", sources[s], *cut))
    offered = spark.createDataFrame(
        [(list(found[number][0]), stretches) for (number, _), stretches in claims.items()],
        "members array<string>, claims array<struct<claim: string, serves: string, low: long, high: long>>",
    )
    given = [sum(sent.get(i, 0) for sent in flow) for i in range(len(sources))]
    asked = spark.createDataFrame(
        [(i, s, h, float(t), g) for i, (s, h, t, g) in enumerate(zip(sources, held, targets, given))],
        "_to int, first string, source_size long, target double, _given long",
    )

    # Where each document stands in its pattern's order: bucket starts plus a running sum.
    sums = rows.groupBy("members", "_bucket").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("members").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("members", "_bucket", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("members", "_bucket").orderBy("_digest", "size", "_row")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_run", F.sum("size").over(inside)).join(starts, ["members", "_bucket"])
    placed = placed.withColumn("_end", F.col("_start") + F.col("_run")).filter("size > 0")

    # Each repetition of a document has one claim at home: the one its middle lies in, else
    # one by its digest, for which it may serve as a fill. The broadcast side has a row for
    # each pattern and repetition.
    begin, end, size = F.col("_end") - F.col("size"), F.col("_end"), F.col("size")
    holding = F.filter("claims", lambda c: (2 * c["low"] <= begin + end) & (begin + end < 2 * c["high"]))
    spare = F.get("claims", F.pmod(F.xxhash64("_digest"), F.size("claims")).cast("int"))
    offers = placed.join(F.broadcast(offered), "members")
    offers = offers.withColumn("home", F.coalesce(F.get(holding, F.lit(0)), spare))
    within = (begin >= F.col("home.low")) & (end <= F.col("home.high"))
    offers = offers.select("_row", "_digest", "size", "home.*", within.alias("inside"))
    offers = freeze_table(offers, "offers")
    full = offers.groupBy("claim").agg(
        F.coalesce(F.sum(F.when(F.col("inside"), F.col("size"))), F.lit(0)).alias("_got"),
        F.first(F.col("high") - F.col("low")).alias("_asked"),
    )
    gaps = full.select("claim", (F.col("_asked") - F.col("_got")).alias("_gap")).filter("_gap > 0")
    off = F.abs(F.col("_gap") - size)
    fills = offers.filter("not inside").join(F.broadcast(gaps), "claim").filter(off < F.col("_gap"))
    best = F.min(F.struct(off.alias("off"), "_digest", "size", "_row", "serves", "_gap")).alias("best")
    fills = fills.groupBy("claim").agg(best).select("best._row", "best.serves", "best.size", "best._gap")
    fills = freeze_table(fills, "fills")
    stretches = offers.filter("inside").select("_row", "serves")
    taken = stretches.unionByName(fills.select("_row", "serves"))

    # Sources that one fill for each claim leaves far off; only those reach the driver.
    fits = F.col("size") <= F.col("_gap")
    words = offers.filter("inside").select("serves", "size", F.lit(True).alias("stays"))
    words = words.unionByName(fills.select("serves", "size", fits.alias("stays")))
    words = words.groupBy("serves").agg(
        F.sum("size").alias("_all"), F.coalesce(F.sum(F.when(F.col("stays"), F.col("size"))), F.lit(0)).alias("_stays")
    )
    state = asked.join(words, F.col("first").eqNullSafe(F.col("serves")), "left").select(
        "_to",
        "first",
        (F.col("_given") - F.coalesce("_all", F.lit(0))).alias("_off"),
        (F.col("_given") - F.coalesce("_stays", F.lit(0))).alias("_gap"),
    )
    # The median holds still when a few texts are very long.
    sizes = rows.filter("size > 0").select("size", F.explode("members").alias("_source"))
    sizes = sizes.groupBy("_source").agg(F.median("size").alias("_median"))
    state = state.join(sizes, F.col("first").eqNullSafe(F.col("_source"))).filter(F.abs("_off") > NEAR * F.col("_median"))
    far = {r["_to"]: r for r in state.collect()}
    if far:
        # Fills that fit stay; one that is too long goes if more documents come nearer.
        names = spark.createDataFrame([(i, sources[i]) for i in far], "_to int, serves string")
        ways = rows.filter("size > 0").select("_row", "_digest", "_bucket", "size", F.explode("members").alias("_member"))
        ways = ways.join(F.broadcast(names), F.col("_member").eqNullSafe(F.col("serves"))).drop("_member", "serves")
        further, missing = _further(ways, taken, {i: r["_gap"] for i, r in far.items()}, repeats)
        nearer = names.filter(F.col("_to").isin([i for i, r in far.items() if abs(missing[i]) < abs(r["_off"])]))
        replaced = F.broadcast(nearer.select("_to", F.col("serves").alias("_serves")))
        stay = fills.filter(fits).unionByName(
            fills.filter(~fits).join(replaced, F.col("serves").eqNullSafe(F.col("_serves")), "left_anti")
        )
        further = further.join(replaced, "_to").select("_row", F.col("_serves").alias("serves"))
        taken = stretches.unionByName(stay.select("_row", "serves")).unionByName(further)
    copies = taken.groupBy("_row").agg(
        F.count("*").cast("int").alias("_copies"), F.sort_array(F.collect_list(F.struct("serves"))).alias("_served")
    )
    out = rows.join(copies, "_row", "left").withColumn("_first", F.get("members", F.lit(0)))
    out = out.join(F.broadcast(asked.drop("_to", "_given")), F.col("_first").eqNullSafe(F.col("first")))
    count = F.coalesce("_copies", F.lit(0))
    return out.select(
        F.col("_id").alias(unused(MADE, id_column)),
        "members",
        "size",
        "source_size",
        "target",
        count.alias("copies"),
        (F.col("size") * count).alias("taken"),
        F.coalesce(F.col("_served.serves"), F.expr("cast(array() as array<string>)")).alias("served"),
        *[F.col(held_as).alias(unused(MADE, name)) for held_as, name in kept.items()],
    )


def mixed_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, all columns. Rows are
    told apart by a key of their own, so a missing or repeated id does not matter."""
    key, copies, copy = (unused(docs.columns, name) for name in ("_key", "_copies", "_copy"))
    keyed = freeze_table(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    chosen = mix(keyed, id_column=id_column, text_column=text_column, keep=[key], **options)
    chosen = chosen.filter(F.col("copies") > 0).select(key, F.col("copies").alias(copies))
    joined = keyed.join(chosen, key)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)
