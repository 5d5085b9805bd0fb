"""Jaccard join of word shingles by vertical partitioning.

1. A text becomes its set of word shingles, hashed to 64 bits. Texts with equal sets form a class.
2. A shingle that only one class has matches nothing. A class whose share of such shingles is too
   large to leave a link goes; a slice of the shingles tells this of nearly all texts that have no
   link, so only the texts of the others are read again, whole.
3. The shingles of the others get a global order: rare ones first. Two sets that link have a common
   shingle among the first n - ceil(similarity * n) + 1 of each. These prefixes give the candidates.
4. The order is cut into FRAGMENTS of about equal weight, and every set into its segments. The
   overlap of a candidate pair is counted segment by segment, each fragment on its own, and summed
   per pair; the sum decides exactly.
5. Only components are asked for, so a bucket of a prefix shingle needs no pairs between members that
   are connected already: members outside its first component are pivots, all of them if they are
   few, else some; pivots meet members of other components. Rounds go on, with more pivots, until no
   bucket has an untested pair of different components. So no link is lost, and a bucket of near
   copies costs a few pairs per member.
6. A bucket may hold many texts that don't link, as those with a common passage. So a set carries the
   parities of how many of its shingles fall into each of a few hundred cells: where two sets differ
   in d parities, they differ in d shingles or more. This bound leaves out most pairs before they are made.

Keys that hold a large share of all rows are dealt over several tasks in every join (see
``operators.skew``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics.llm.common import Words, lower_ascii, pieces, text_of
from adlytics.llm.near_dedup import components, shingle_sets
from adlytics.operators.skew import spread_join
from adlytics.workspace import Workspace

#: One in SLICE shingles, chosen by hash, is looked at for all texts.
SLICE = 5
#: Parts of the global order.
FRAGMENTS = 8
#: Pivots of a bucket in the first round; each round has PIVOT_GROWTH times as many.
PIVOTS = 2
PIVOT_GROWTH = 8
#: Cells of the parities of a set, as 64-bit integers. Sets of more than about 20 shingles a cell have no use of them.
PARITY_WORDS = 4
#: Bits of a shingle's hash in its place in the global order.
_HASH_BITS = 57


def _profiles(k: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets = shingle_sets(Words(piece.column("text")), k)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sliced = [s[s % np.uint64(SLICE) == 0].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(sliced, pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "digest", "slice"],
            )

    return profile


def _parity(shingles: np.ndarray) -> np.ndarray:
    """A bit for each cell: whether the number of shingles in it is odd."""
    cells = 64 * PARITY_WORDS
    odd = np.bincount((shingles % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _whole_sets(k: int):
    """Of the texts found by a class's id, the sets of those of the class; an id may have other texts too."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets = shingle_sets(Words(piece.column("text")), k)
            own = [k for k, (s, d) in enumerate(zip(sets, piece.column("digest").to_pylist())) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == d]
            classes = piece.column("class").take(pa.array(own, pa.int64()))
            lists = [[sets[k].view(np.int64) for k in own], [_parity(sets[k]) for k in own]]
            yield pa.RecordBatch.from_arrays([classes, *[pa.array(x, pa.list_(pa.int64())) for x in lists]], names=["class", "shingles", "parity"])

    return whole


def _needed(n: Column, similarity: int) -> Column:
    """Shingles a set of n must share with any set that it links to."""
    return F.ceil(F.lit(similarity) * n / F.lit(100)).cast("long")


def _may_link(profile: DataFrame, similarity: int) -> DataFrame:
    """Digests of classes that keep enough shared shingles, as far as the slice tells."""
    cut = profile.select("digest", "n_shingles", F.explode("slice").alias("shingle"))
    name = F.xxhash64("digest")
    # Two classes are told apart by 64 bits here; were two linked ones alike, both would have the same set.
    alone = cut.groupBy("shingle").agg(F.min(name).alias("least"), F.max(name).alias("most")).filter("least = most")
    alone = alone.groupBy(F.col("least").alias("name")).agg(F.count(F.lit(1)).alias("alone"))
    classes = profile.groupBy("digest").agg(F.min("id").alias("least_id"), F.first("n_shingles").alias("n"))
    classes = classes.withColumn("name", name).join(alone, "name", "left")
    left = F.col("n") - F.coalesce("alone", F.lit(0))
    return classes.filter(left >= _needed(F.col("n"), similarity)).select("digest", "least_id", "n")


def _ordered_sets(space: Workspace, sets: DataFrame, similarity: int) -> DataFrame:
    """Rows (class, n, parity, shared): the shared shingles of every class that may link, in global order.

    The order is by the power of two of the number of classes that have a shingle, then by its hash.
    """
    postings = space.save(sets.select("class", F.explode("shingles").alias("shingle")), "postings")
    found_in = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    rank = F.shiftleft(F.floor(F.log2("classes")).cast("long"), _HASH_BITS)
    place = (rank + F.shiftrightunsigned("shingle", 64 - _HASH_BITS)).alias("place")
    placed = spread_join(postings, found_in, ["shingle"]).select("class", place)
    ordered = placed.groupBy("class").agg(F.array_sort(F.collect_list("place")).alias("shared"))
    ordered = ordered.join(sets.select("class", "n", "parity"), "class")
    return space.save(ordered.filter(F.size("shared") >= _needed(F.col("n"), similarity)).select("class", "n", "parity", "shared"), "ordered")


def _between(low: int | None, high: int | None) -> Callable[[Column], Column]:
    """From low on and below high; None is no bound."""
    return lambda place: (F.lit(True) if low is None else place >= low) & (F.lit(True) if high is None else place < high)


def _segments(space: Workspace, ordered: DataFrame, fragments: int) -> DataFrame:
    """Rows (fragment, class, segment) of every set, cut at quantiles of the global order."""
    places = ordered.select(F.explode("shared").alias("place"))
    shares = [k / fragments for k in range(1, fragments)]
    cuts = sorted(set(places.agg(F.percentile_approx("place", shares, 1_000)).first()[0] or ()))
    bounds = [None, *cuts, None]
    each = [
        F.struct(F.lit(k).alias("fragment"), F.filter("shared", _between(low, high)).alias("segment"))
        for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:]))
    ]
    rows = ordered.select("class", F.inline(F.array(*each))).filter(F.size("segment") > 0)
    return space.save(rows, "segments")


def _overlap_at_most(n: Column, m: Column, i: Column, j: Column) -> Column:
    """Of sets of n and m that share the shingle at places i and j: what they can share at most."""
    return F.least(i, j) + 1 + F.least(n - i, m - j) - 1


def _overlap_by_parity(n: Column, m: Column, own: str, other: str) -> Column:
    """What sets of n and m with these parities can share at most."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(own)[k].bitwiseXOR(F.col(other)[k])) for k in range(PARITY_WORDS)])
    return F.floor((n + m - differ) / 2)


def _links_if(overlap: Column, n: Column, m: Column, similarity: int) -> Column:
    return 100 * overlap >= similarity * (n + m - overlap)


def _candidates(space: Workspace, buckets: DataFrame, pivots: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (pivot, member, n, m) to count, and the buckets that are not settled by them.

    buckets: rows (place, class, n, parity, at, component), `at` counting from 0 over the whole set. All
    members outside the first component of a bucket are pivots if they are few, else about `pivots`,
    chosen by a hash of the class, so buckets of the same members choose the same ones.
    """
    ends = buckets.groupBy("place").agg(F.min("component").alias("main"), F.max("component").alias("other")).filter("main <> other")
    marked = space.save(spread_join(buckets, ends.select("place", "main"), ["place"]), "open-buckets")
    outside = marked.filter("component <> main").groupBy("place").agg(F.count(F.lit(1)).alias("outside"))
    marked = space.save(spread_join(marked, outside, ["place"]), "marked-buckets")
    chance = F.pmod(F.xxhash64(F.col("class"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    serves = (F.col("component") != F.col("main")) & ((F.col("outside") <= pivots) | (chance * F.col("outside") < pivots))
    own = marked.filter(serves).select(
        "place", *[F.col(c).alias(f"p_{c}") for c in ("class", "n", "parity", "at", "component")]
    )
    met = spread_join(marked.withColumn("serves", serves), own, ["place"])
    at_most = F.least(
        _overlap_at_most(F.col("p_n"), F.col("n"), F.col("p_at"), F.col("at")),
        _overlap_by_parity(F.col("p_n"), F.col("n"), "p_parity", "parity"),
    )
    met = met.filter(
        (F.col("component") != F.col("p_component"))
        & ~(F.col("serves") & (F.col("class") > F.col("p_class")))  # of two pivots one is the other's member
        & _links_if(at_most, F.col("p_n"), F.col("n"), similarity)
    )
    pairs = met.select(F.col("p_class").alias("pivot"), F.col("class").alias("member"), F.col("p_n").alias("n"), F.col("n").alias("m"))
    rest = marked.filter(F.col("outside") > pivots).select("place", "class", "n", "parity", "at", "component")
    return space.save(pairs.distinct(), "pairs"), rest


def _links(pairs: DataFrame, segments: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that link, by their overlaps in each fragment summed."""
    of_pivot = segments.select(F.col("class").alias("pivot"), "fragment", F.col("segment").alias("own"))
    of_member = segments.select(F.col("class").alias("member"), "fragment", "segment")
    met = spread_join(pairs, of_pivot, ["pivot"]).join(of_member, ["member", "fragment"])
    partial = met.select("pivot", "member", "n", "m", F.size(F.array_intersect("own", "segment")).alias("partial"))
    summed = partial.groupBy("pivot", "member", "n", "m").agg(F.sum("partial").alias("overlap"))
    linked = summed.filter(_links_if(F.col("overlap"), F.col("n"), F.col("m"), similarity))
    return linked.select(F.col("pivot").alias("a"), F.col("member").alias("b"))


def similar_documents(
    space: Workspace,
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 5,
    similarity: int = 80,
    fragments: int = FRAGMENTS,
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    Words are split at ASCII white space, A-Z in lower case. A text with fewer words than a shingle is
    one shingle. Texts link when 100 * intersection >= similarity * union of their sets, similarity
    being 1 to 100; the component is the smallest id that links lead to. Texts that are null or have no
    word link with nothing. Rows with a null id link with nothing either and have a null component.
    Rows repeating an id and text give equal rows; different texts under one id are nodes of their own.
    Ids are integers. An empty table gives no rows; other columns play no part.
    """
    ids = docs.select(F.col(id_column).cast("long").alias("id"), lower_ascii(text_of(text_column)).alias("text"))
    profile = ids.mapInArrow(_profiles(shingle), "id long, n_shingles long, digest binary, slice array<long>")
    profile = space.save(profile, "profiles")
    known = profile.filter("id is not null and digest is not null")
    wanted = _may_link(known, similarity).withColumn("class", F.monotonically_increasing_id())
    wanted = space.save(wanted, "classes")

    texts = ids.join(wanted.select(F.col("least_id").alias("id"), "class", "digest"), "id")
    sets = texts.mapInArrow(_whole_sets(shingle), "class long, shingles array<long>, parity array<long>").dropDuplicates(["class"])
    sets = space.save(sets.withColumn("n", F.size("shingles").cast("long")), "sets")
    ordered = _ordered_sets(space, sets, similarity)
    segments = _segments(space, ordered, fragments)

    alone = F.col("n") - F.size("shared")  # shingles of one class come first in the order
    prefix = F.slice("shared", F.lit(1), (F.col("n") - _needed(F.col("n"), similarity) + 1 - alone).cast("int"))
    buckets = ordered.select("class", "n", "parity", alone.alias("alone"), F.posexplode(prefix).alias("at", "place"))
    buckets = space.save(
        buckets.select("place", "class", "n", "parity", (F.col("alone") + F.col("at")).alias("at"), F.col("class").alias("component")), "buckets"
    )

    pivots, found = PIVOTS, None
    while True:
        pairs, buckets = _candidates(space, buckets, pivots, similarity)
        links = _links(pairs, segments, similarity)
        if found is not None:  # stars of the rounds before stand for their links
            links = links.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
        found = space.save(components(space, links), "components")
        if buckets.isEmpty():
            break
        now = found.select(F.col("id").alias("class"), F.col("component").alias("now"))
        buckets = buckets.join(now, "class", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
        buckets = space.save(buckets, "buckets")
        pivots *= PIVOT_GROWTH

    of = wanted.select("class", "digest", "least_id").join(found.withColumnRenamed("id", "class"), "class")
    least = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = spread_join(space.save(of, "members"), least, ["component"]).select("digest", "component_id")
    every = known.groupBy("digest").agg(F.min("id").alias("least_id"))
    named = space.save(every.join(of, "digest", "left").select("digest", F.coalesce("component_id", "least_id").alias("component_id")), "named")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    rows = profile.select("id", "n_shingles", "digest")
    return spread_join(rows, named, ["digest"], "left").select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"))
