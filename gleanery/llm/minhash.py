"""Near duplicates by MinHash with sequential Bayesian verification.

1. A text's set: distinct runs of ``width`` words, as 64-bit hashes. Documents with equal sets
   are one class; the smallest id stands for it. Sets are not stored: the signature, `HASHES`
   minima, and a key of the whole set are.
2. Banding: signatures that agree in all `ROWS` minima of a band share a bucket. Buckets that
   hold the same classes are one. At a similarity of 0.8 a pair misses every band with a
   probability of about 5e-8.
3. First members: of each bucket up to `CENTRES` members are centres (`FEW` of a large one), and
   every member meets each of them. Signatures are compared batch by batch: with a uniform prior, the similarity
   after m matches of n has a Beta(m + 1, n - m + 1) distribution, and a pair is given up once
   it reaches the threshold with less than `MISS` probability. Of the survivors each member is
   first verified on full sets, recomputed from the texts, against one centre of many matches;
   then the pairs that this has not linked through others.
4. Contraction: members that are linked by now need no comparison among each other. Buckets with
   one part, or with at most one member beside the centres, are done. In the others only pairs
   of different parts are compared, by the same test and the same verification, so a bucket of
   n near copies costs n times the members that their centres have not reached, not n * n.
5. Components of the links, by alternating large and small stars.

No bucket is capped. What is left of a bucket is cut into blocks of bounded size: those of the
largest part, which do not meet each other, and those of all other members. A task holds two
blocks, and every pair of blocks that has to meet does so once. Each pair is judged in the first
band it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from gleanery.llm import uneven
from gleanery.llm.words import whole
from gleanery.session import freeze_table

WIDTH = 5
THRESHOLD = (80, 100)  # similarity of 80 / 100 or more
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16  # minima compared at once
MISS = 1e-5
CENTRES = 8  # members of a bucket that all others meet first
FEW, LARGE = 2, 16  # so many centres serve buckets of more members than that
STRONG = 110  # matches that make a link all but sure
AT_ONCE = 256  # members compared with a centre at once
MEMBERS = 4096  # members that meet a centre in one task, about
SALTS = 16  # tasks over which those of a centre are dealt that are verified on full sets
BLOCK = 512  # classes of one bucket in a block
BLOCK_HASHES = 1 << 21  # hashes of full sets in a block, about
PAIRS = 1 << 17  # pairs of a task judged at once
IDS_SENT = 4_000_000  # ids that are broadcast to the texts, 32 MB
SEED = 20240104
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)


# Sets and signatures ------------------------------------------------------------------


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct word runs of a text, as sorted hashes. Fewer words than ``width`` are one run."""
    # Splits at the six ASCII white spaces, and lowers A-Z only.
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    runs = max(1, len(words) - width + 1)
    out = np.full(runs, len(words) if len(words) < width else width, dtype=np.uint64)
    for at in range(min(width, len(words))):
        out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[at : at + runs]
    return np.unique(out ^ (out >> np.uint64(32)))


@lru_cache(maxsize=4)
def _coefficients(hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    scale = draw.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
    return scale, draw.integers(0, 1 << 32, hashes, dtype=np.uint32)


def signature(hashes: np.ndarray, size: int = HASHES, seed: int = SEED) -> np.ndarray:
    """Minima of ``size`` hash functions over a set that is not empty."""
    scale, shift = _coefficients(size, seed)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(out, (low[at : at + 256, None] * scale + shift).min(axis=0), out=out)
    return out


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, keys, signatures = [], [], []
        for text in batch.column(1):
            hashes = shingle_hashes(text.as_py(), width)
            counts.append(len(hashes))
            keys.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            signatures.append(signature(hashes).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(signatures, pa.binary()),
            ],
            names=["id", "n_shingles", "set_key", "signature"],
        )


# Sequential verification --------------------------------------------------------------


@lru_cache(maxsize=8)
def least_matches(
    hashes: int = HASHES, batch: int = BATCH, threshold: float = THRESHOLD[0] / THRESHOLD[1], miss: float = MISS
) -> list[tuple[int, int]]:
    """(minima compared, matches needed to go on) after each batch.

    After m matches of n the chance that the similarity reaches the threshold t is that of a
    Beta(m + 1, n - m + 1) variable above t, which is the chance of at most m successes in
    n + 1 trials of probability t.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, needed = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                needed = m
                break
        out.append((n, needed))
    return out


def surviving(signatures: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) of rows that are not given up, with all their matches."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int32)
    done = 0
    for n, needed in least_matches():
        a = signatures[left[alive], done:n]
        b = signatures[right[alive], done:n]
        matches[alive] += (a == b).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= needed]
        done = n
        if not len(alive):
            break
    return alive, matches[alive]


def first_shared_band(signatures: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a = signatures[left].reshape(-1, BANDS, ROWS)
    b = signatures[right].reshape(-1, BANDS, ROWS)
    return (a == b).all(axis=2).argmax(axis=1)


class Group:
    """Rows of one (bucket, pair of blocks): both blocks, or one block with itself."""

    def __init__(self, band: int, within: bool, sides: np.ndarray, signatures: np.ndarray, parts: np.ndarray):
        self.band, self.within, self.signatures, self.parts = band, within, signatures, parts
        self.first = np.flatnonzero(sides == 0)
        self.second = self.first if within else np.flatnonzero(sides == 1)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Surviving pairs of different parts that meet in this band first, in bounded runs."""
        rows = max(1, PAIRS // max(1, len(self.second)))
        for at in range(0, len(self.first), rows):
            some = self.first[at : at + rows]
            left, right = np.repeat(some, len(self.second)), np.tile(self.second, len(some))
            apart = self.parts[left] != self.parts[right]
            if self.within:
                apart &= left < right
            left, right = left[apart], right[apart]
            alive, _ = surviving(self.signatures, left, right)
            left, right = left[alive], right[alive]
            here = first_shared_band(self.signatures, left, right) == self.band if len(left) else slice(0, 0)
            yield left[here], right[here]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one group after another; batches come sorted by group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack(
            [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1
        )
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(keys[start])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _arrays(group: pa.Table) -> tuple[np.ndarray, Group]:
    raw = b"".join(group.column("signature").to_pylist())
    signatures = np.frombuffer(raw, dtype=np.uint32).reshape(-1, HASHES)
    key = {c: group.column(c)[0].as_py() for c in ("block_a", "block_b", "band")}
    sides, parts = group.column("side").to_numpy(), group.column("part").to_numpy()
    members = group.column("id").to_numpy()
    return members, Group(key["band"], key["block_a"] == key["block_b"], sides, signatures, parts)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of classes that have a surviving partner in their group, without signatures."""
    for table in _groups(batches):
        members, group = _arrays(table)
        stay = np.zeros(len(members), dtype=bool)
        for left, right in group.pairs():
            stay[left] = True
            stay[right] = True
        if stay.any():
            yield from table.drop_columns("signature").filter(pa.array(stay)).combine_chunks().to_batches()


def intersection_sizes(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with each of several."""
    lengths = np.fromiter(map(len, others), dtype=np.int64, count=len(others))
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    hits = np.concatenate([[0], np.cumsum(one[at] == flat)])
    ends = np.cumsum(lengths)
    return hits[ends] - hits[ends - lengths]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b), verified on full sets, that join two parts of their group."""
    over, under = THRESHOLD
    for table in _groups(batches):
        members, group = _arrays(table)
        sets = [np.frombuffer(b, dtype=np.uint64) for b in table.column("hashes").to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        part = np.unique(group.parts, return_inverse=True)[1]
        links = []
        for left, right in group.pairs():
            order = np.argsort(left, kind="stable")
            left, right = left[order], right[order]
            starts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else np.array([], dtype=int)
            for start, end in zip(starts, [*starts[1:], len(left)]):
                a, others = left[start], right[start:end]
                others = others[part[others] != part[a]]
                if not len(others):
                    continue
                both = intersection_sizes(sets[a], [sets[b] for b in others])
                linked = others[under * both >= over * (sizes[a] + sizes[others] - both)]
                for b in linked:
                    if part[b] != part[a]:
                        part[part == part[b]] = part[a]
                        links.append((members[a], members[b]))
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_pydict({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            sets = [shingle_hashes(t.as_py(), width).tobytes() for t in piece.column(1)]
            keys = [xxhash.xxh3_128_digest(s) for s in sets]
            columns = [piece.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "set_key", "hashes"])


# Members against centres --------------------------------------------------------------


def matches_with(centre: bytes, members: list[bytes]) -> np.ndarray:
    """Matching minima with a centre, 0 for members that are given up."""
    rows = np.frombuffer(b"".join([centre, *members]), dtype=np.uint32).reshape(-1, HASHES)
    right = np.arange(1, len(rows))
    alive, matches = surviving(rows, np.zeros_like(right), right)
    out = np.zeros(len(members), dtype=np.int32)
    out[alive] = matches
    return out


def linked_with(centre: bytes, members: list[bytes]) -> np.ndarray:
    """1 for members whose full sets are similar to the centre's, else 0."""
    over, under = THRESHOLD
    one, others = np.frombuffer(centre, dtype=np.uint64), [np.frombuffer(m, dtype=np.uint64) for m in members]
    both = intersection_sizes(one, others)
    sizes = np.fromiter(map(len, others), dtype=np.int64, count=len(others))
    return (under * both >= over * (len(one) + sizes - both)).astype(np.int32)


def _meet(judge):
    """Streams rows (centre, salt, member, is_member, value), sorted so that a centre comes before
    its members; a task holds the value of one centre and those of a slice of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, value = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(2)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            members, flags = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for start, end in zip(cuts, cuts[1:]):
                if held != tuple(keys[start]):
                    held, value = tuple(keys[start]), None
                if not flags[start]:
                    value = batch.column(4)[start].as_py()
                    start += 1
                if start == end or value is None:
                    continue
                for at in range(start, end, AT_ONCE):
                    score = judge(value, batch.column(4).slice(at, min(AT_ONCE, end - at)).to_pylist())
                    found = np.flatnonzero(score)
                    if len(found):
                        columns = {"a": np.full(len(found), held[0]), "b": members[at + found], "score": score[found]}
                        yield pa.RecordBatch.from_pydict(columns)

    return run


def _meetings(pairs: DataFrame, values: DataFrame, judge) -> DataFrame:
    """(a, b, score) of the ``pairs`` (centre, salt, member) for which ``judge`` finds a score.

    A member's value moves once per pair, a centre's once per salt.
    """
    asked = pairs.select("centre", "salt").distinct()
    named = values.toDF("id", "value")
    centres = asked.join(named.withColumnRenamed("id", "centre"), "centre")
    centres = centres.select("centre", "salt", F.col("centre").alias("member"), F.lit(0).alias("is_member"), "value")
    members = pairs.join(named.withColumnRenamed("id", "member"), "member")
    members = members.select("centre", "salt", "member", F.lit(1).alias("is_member"), "value")
    rows = centres.unionByName(members).repartition("centre", "salt").sortWithinPartitions("centre", "salt", "is_member")
    return rows.mapInArrow(_meet(judge), "a long, b long, score int")


def _first_links(held: DataFrame, classes: DataFrame, full_sets) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members with the centres of their buckets, and the parts that they form.

    ``full_sets`` gives (id, hashes) of the classes in a table of ids.
    """
    # Two centres of a bucket meet once, the larger one as the member.
    is_centre = F.array_contains("centres", F.col("id"))
    others = F.filter("centres", lambda c: (c < F.col("id")) | ((c > F.col("id")) & ~is_centre))
    met = held.select(F.explode(others).alias("centre"), F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), F.col("id").alias("member"))
    met = met.distinct()
    alive = freeze_table(_meetings(met, classes.select("id", "signature"), matches_with), "alive")
    # Of the centres that are all but sure the one that all members prefer, so that parts are few.
    choice = F.struct((-F.least("score", F.lit(STRONG))).alias("score"), "a")
    best = alive.groupBy("b").agg(F.min(choice).alias("top")).select(F.col("top.a").alias("a"), "b")
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS))

    sets = full_sets(alive.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = freeze_table(pairs.select(F.col("a").alias("centre"), salt.alias("salt"), F.col("b").alias("member")), "pairs")
        return freeze_table(_meetings(pairs, sets, linked_with).select("a", "b"), "links")

    links = verified(best)
    # Every member has one link by now, so two steps along them tell most that need no other.
    ends = alive.join(best.withColumn("met", F.lit(True)), ["a", "b"], "left").filter("met is null").select("a", "b")
    for end in ("a", "b"):
        ends = ends.withColumn(f"to_{end}", F.col(end))
        for _ in range(2):
            step = links.select(F.col("b").alias(f"to_{end}"), F.col("a").alias("next"))
            ends = ends.join(step, f"to_{end}", "left").withColumn(f"to_{end}", F.coalesce("next", f"to_{end}")).drop("next")
    links = links.unionByName(verified(ends.filter("to_a <> to_b").select("a", "b")))
    return links, components(links).withColumnRenamed("component_id", "part")


# Components ---------------------------------------------------------------------------


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Edges in the shared folder, with their number and a print of them taken as they are written."""
    seen = Observation()
    table = freeze_table(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "links")
    return table, seen.get


def _with_least(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` (u, v) with ``m``, the smallest v of each u; ``count`` bounds their number.

    A few rows meet in a window. Of many the minima are aggregated before they are shuffled, and
    the rows of a hot u stay where they are.
    """
    if count <= uneven.EVEN_ROWS:
        return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return uneven.join_each(rows, least, "u", count).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """``id, component_id`` of every id in ``links`` (a, b): the smallest id it can reach.

    Large stars tie every larger neighbour of a node to the smallest one around it, small
    stars every smaller one; both keep the components, and alternating them ends in stars.
    A node with very many links is no task's burden, see `_with_least`.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = _written(edges)
    while True:
        rows = before["n"]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * rows).filter("v > u")
        large = large.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v")
        # (v, m) for each v but the smallest, whose row stands for u itself.
        small = _with_least(large, 2 * rows).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, now = _written(small.filter("u <> v").distinct())
        # Edges are stars with the smallest id in the middle once a round changes none.
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return ends.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


# The operator -------------------------------------------------------------------------


def _shared_buckets(banded: DataFrame) -> DataFrame:
    """Rows (bucket, band, id, ...) of buckets of several classes, of those with the same classes the
    one of the lowest band, with n, centres and salts of their bucket.

    Centres are the members with the smallest id in each of `CENTRES` classes of hashes; the
    buckets of a group of near copies mostly share them. ``salts`` tells over how many tasks the
    members of a centre are dealt.
    """
    rows = banded.withColumn("_print", F.xxhash64("id"))
    slot = F.pmod("_print", F.lit(CENTRES))
    sums = [
        F.count("*").alias("n"),
        F.bit_xor("_print").alias("x"),
        F.sum(F.shiftrightunsigned("_print", 24)).alias("y"),
        *[F.min(F.when(slot == c, F.col("id"))).alias(f"c{c}") for c in range(CENTRES)],
    ]
    buckets = rows.groupBy("bucket", "band").agg(*sums).filter("n > 1")
    centres = F.array_compact(F.array(*[F.col(f"c{c}") for c in range(CENTRES)]))
    centres = F.slice(centres, 1, F.when(F.col("n") > LARGE, F.lit(FEW)).otherwise(F.lit(CENTRES)))
    least = F.min(F.struct("band", "bucket", centres.alias("centres"))).alias("one")
    kept = buckets.groupBy("n", "x", "y").agg(least).select("one.bucket", "one.band", "n", "one.centres")
    kept = kept.withColumn("salts", F.ceil(F.col("n") / MEMBERS))
    return banded.join(kept, ["bucket", "band"])


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, band, id, part, n_shingles) without buckets of one part, each class with the
    pairs of blocks it meets in: adds ``block_a, block_b, side``.

    Blocks of the largest part of a bucket are numbered behind those of all others.
    """
    by_part = rows.groupBy("bucket", "band", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load"))
    top = by_part.groupBy("bucket", "band").agg(
        F.max(F.struct("n", "load", "part")).alias("top"), F.sum("n").alias("n"), F.sum("load").alias("load"), F.count("*").alias("parts")
    )
    blocks = lambda n, load: F.greatest(F.ceil(n / BLOCK), F.ceil(load / BLOCK_HASHES)).cast("int")
    kept = top.filter("parts > 1").select(
        "bucket",
        "band",
        F.col("top.part").alias("main"),
        blocks(F.col("n") - F.col("top.n"), F.col("load") - F.col("top.load")).alias("others"),
        blocks(F.col("top.n"), F.col("top.load")).alias("mains"),
    )
    held = rows.join(kept, ["bucket", "band"]).withColumn("_print", F.xxhash64("id"))
    in_main = F.col("part") == F.col("main")
    others, mains = F.col("others"), F.col("mains")
    block = F.pmod("_print", F.when(in_main, mains).otherwise(others)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    meet = lambda a, b, side: F.struct(a.alias("block_a"), b.alias("block_b"), side.cast("int").alias("side"))
    of_main = F.transform(upto(others), lambda o: meet(o, others + block, F.lit(1)))
    of_other = F.concat(
        F.transform(upto(others), lambda o: meet(F.least(block, o), F.greatest(block, o), block > o)),
        F.transform(upto(mains), lambda m: meet(block, others + m, F.lit(0))),
    )
    spread = held.select("bucket", "band", "id", "part", F.explode(F.when(in_main, of_main).otherwise(of_other)).alias("m"))
    return spread.select("bucket", "m.block_a", "m.block_b", "band", "m.side", "id", "part")


def _by_group(rows: DataFrame) -> DataFrame:
    keys = ["bucket", "block_a", "block_b"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "band")


def near_parts(signed: DataFrame, docs: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """(id, part) of every linked class representative: the smallest id that its links reach."""
    classes = signed.filter("set_key is not null and id is not null").groupBy("set_key").agg(
        F.min(F.struct("id", "signature", "n_shingles")).alias("one")
    )
    classes = freeze_table(classes.select("set_key", "one.*"), "classes")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), whole(text_column).alias("text"))

    def full_sets(wanted: DataFrame) -> DataFrame:
        seen = Observation()
        wanted = freeze_table(wanted.observe(seen, F.count(F.lit(1)).alias("n")), "wanted")
        # Up to a bound the ids go to the texts, beyond it they meet by a shuffle.
        asked = F.broadcast(wanted) if seen.get["n"] <= IDS_SENT else wanted
        # A repeated id has several texts; the one of its class is told by the key.
        found = texts.join(asked, "id", "left_semi").mapInArrow(lambda b: _full_sets(b, width), "id long, set_key binary, hashes binary")
        same = classes.select("id", "set_key").join(found, ["id", "set_key"]).dropDuplicates(["id", "set_key"])
        return freeze_table(same.select("id", "hashes"), "sets")

    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.struct(
            F.xxhash64(F.substring("signature", b * ROWS * 4 + 1, F.lit(ROWS * 4)), b).alias("bucket"), b.alias("band")
        ),
    )
    banded = classes.select("id", "n_shingles", F.explode(bands).alias("b")).select("b.bucket", "b.band", "id", "n_shingles")
    held = freeze_table(_shared_buckets(banded), "buckets")
    links, parts = _first_links(held, classes, full_sets)

    # Buckets whose members have not all met: those of different parts meet now.
    left = held.filter(F.col("n") - F.size("centres") > 1).select("bucket", "band", "id", "n_shingles")
    left = left.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    known = classes.select("id", "signature")
    grouped = _blocked(left).join(known, "id")
    keys = ["bucket", "block_a", "block_b", "band", "side", "id", "part"]
    schema = "bucket long, block_a int, block_b int, band int, side int, id long, part long"
    pruned = freeze_table(_by_group(grouped.select(*keys, "signature")).mapInArrow(_prune, schema), "survivors")
    if pruned.isEmpty():
        return parts
    full = full_sets(pruned.select("id").distinct()).join(known, "id")
    last = _by_group(pruned.join(full, "id").select(*keys, "signature", "hashes")).mapInArrow(_verify, "a long, b long")
    return components(links.unionByName(last)).withColumnRenamed("component_id", "part")


def near_groups(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked when their sets of lower-cased word runs have a similarity of 0.8
    or more. A text without words, or none, has an empty set and no links; neither has a row
    without an id, whose component is null and which is kept. Of each component the rows with
    the smallest id are kept. Ids must be whole numbers; a repeated id is one document with
    several texts, linked by each of them.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = rows.mapInArrow(lambda b: _sign(b, width), "id long, n_shingles long, set_key binary, signature binary")
    signed = freeze_table(signed, "signatures")
    reached = near_parts(signed, docs, width, id_column, text_column)
    # Equal sets are linked through the smallest id of their class.
    keyed = signed.select("id", "n_shingles", "set_key")
    filled = keyed.filter("set_key is not null")
    reps = filled.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    labelled = reps.join(reached.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_key", F.coalesce("part", "rep").alias("component_id"), "n"
    )
    named = uneven.join_each(filled, labelled, "set_key", signed.count()).select(*keyed.columns, "component_id")
    none = F.lit(None).cast("long").alias("component_id")
    out = named.unionByName(keyed.filter("set_key is null").select("*", none))
    out = out.withColumn(
        "component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    )
    return out.select(
        F.col("id").alias(id_column), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group, all columns. A row goes when none of the rows with its id is kept."""
    groups = near_groups(docs, width, id_column, text_column).groupBy(id_column).agg(F.max("kept").alias("kept"))
    dropped = groups.filter(~F.col("kept") & F.col(id_column).isNotNull()).select(id_column)
    return docs.join(dropped, id_column, "left_anti").select(*docs.columns)
