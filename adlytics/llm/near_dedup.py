"""Near duplicates: MinHash signatures, banding, verified links, connected components.

1. A text becomes its set of word shingles, hashed to 64 bits. Texts with equal sets form a class
   and one of them stands for it.
2. Each class gets the minima of many universal hashes; equal bands of minima share a bucket.
3. In a bucket, pivots are compared with the members of other components. Signatures that agree
   too little are left out, then the whole sets decide. In a large bucket few pivots serve first:
   what links to a pivot joins its component, and members of one component need no comparison.
   Rounds go on, with more pivots each time, until no bucket has untested members of different
   components. So no link between candidates is lost, and a bucket of near copies costs a few
   comparisons per member instead of all pairs.
4. After every round, large-star and small-star steps join components until nothing changes.

With BANDS bands of ROWS minima a pair of similarity 0.8 is missed by banding with probability
(1 - 0.8 ** 4) ** 32 = 5e-8. A pair at 0.8 agrees in less than 60 % of the 128 minima with
probability 8e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.llm.common import Words, lower_ascii, pieces, released, text_of
from adlytics.workspace import Workspace

ROWS = 4
BANDS = 32
SEED = 20_240_229
#: Pivots of a large bucket in the first round; each round has PIVOT_GROWTH times as many.
PIVOTS = 8
PIVOT_GROWTH = 8
#: Pivots that are held at a time, and members that meet them in one go: by minima, by sets.
BLOCK = 64
PART = 2_000
MEMBERS = 200
#: Bytes of texts that are hashed together: their words and sets are held beside them, several times as large.
PIECE = 1 << 20
#: Share of minima below which a pair can't reach the similarity asked for.
SIGNATURE_FLOOR = 0.6
#: Bytes of a bucket's name.
_NAME = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text of a batch."""
    if not len(words.codes):
        return [np.zeros(0, np.uint64)] * len(words.counts)
    each = _mixed(words.hashes())[words.codes]
    rolled = np.zeros(len(each), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            left = max(0, len(each) - i)
            rolled[:left] = rolled[:left] * _ODD + each[i:]
        rolled = _mixed(rolled)
        sets = []
        for start, stop in zip(words.starts[:-1].tolist(), words.starts[1:].tolist()):
            n = stop - start
            if n >= k:
                sets.append(np.unique(rolled[start : stop - k + 1]))
            elif n:
                whole = np.uint64(n)
                for h in each[start:stop]:
                    whole = whole * _ODD + h
                sets.append(_mixed(np.array([whole ^ _ODD], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n multiply-shift hashes."""
    random = np.random.default_rng(SEED)
    return random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """(texts, hashes) minima, 32 bits each; texts without shingles get zeros."""
    found = np.zeros((len(sets), hashes), np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if not filled:
        return found
    multiply, add = _universal(hashes)
    sizes = np.array([len(sets[i]) for i in filled])
    group = np.cumsum(sizes) // 20_000  # texts that are hashed together
    with np.errstate(over="ignore"):
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            all_ = np.concatenate([sets[filled[i]] for i in mine])
            starts = np.concatenate(([0], np.cumsum(sizes[mine])[:-1]))
            to = np.array(filled)[mine]
            for h in range(hashes):
                hashed = ((all_ * multiply[h] + add[h]) >> np.uint64(32)).astype(np.uint32)
                found[to, h] = np.minimum.reduceat(hashed, starts)
    return found


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _profiles(k: int, rows: int, bands: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            sets = shingle_sets(Words(piece.column("text")), k)
            signature = minima(sets, rows * bands)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([m.tobytes() if len(s) else None for m, s in zip(signature, sets)], pa.binary()),
                ],
                names=["id", "n_shingles", "digest", "signature"],
            )

    return profile


def _signatures(batch: pa.RecordBatch, rows: int, bands: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, bands, rows)


def _bucket_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, bands) names of the buckets: a hash of a band's minima, and the band in the low bits."""
    bands, rows = signature.shape[1:]
    band = np.arange(bands, dtype=np.uint64)
    key = np.broadcast_to(band + np.uint64(1), signature.shape[:2])
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = _mixed(key * _ODD + signature[:, :, i])
    return key << np.uint64(bands.bit_length()) | band


def _bands(rows: int, bands: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _bucket_keys(_signatures(batch, rows, bands))
            ids = np.repeat(np.asarray(batch.column("id")), bands)
            band = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
            columns = [pa.array(key.reshape(-1).view(np.int64)), pa.array(band), pa.array(ids)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "band", "id"])

    return cut


def _sketches(rows: int, bands: int):
    """The low byte of every minimum, then the name of the bucket in every band."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signature = _signatures(batch, rows, bands)
            low = signature.reshape(-1, rows * bands).astype(np.uint8)
            both = np.concatenate([low, _bucket_keys(signature).view(np.uint8)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in both], pa.binary())], names=["id", "sketch"])

    return sketch


_FOUND = "bucket long, block long, member long, pivots array<long>"


def _agree(rows: int, bands: int):
    """Of open buckets, the members whose minima agree enough with those of pivots, and these pivots.

    Rows come sorted by (bucket, block, part), a block's pivots first. A sketch ends with the names
    of the buckets in the bands before that of the row. A pair counts in the first bucket that it
    shares, so it is found once. The last row of a block lists its pivots in use.
    """
    fields = ("bucket", "block", "part", "own", "id", "component", "serves", "sketch")
    low = rows * bands

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots, matrix, used = None, [], None, set()
        found: list[tuple] = []

        def drain() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "member", "pivots"])

        for batch in batches:
            for bucket, block, part, own, id_, component, serves, sketch in zip(*(batch.column(f).to_pylist() for f in fields)):
                if (bucket, block, part) != at:
                    if used:
                        found.append((*at[:2], None, sorted(used)))
                    at, pivots, matrix, used = (bucket, block, part), [], None, set()
                if own:
                    pivots.append((id_, component, sketch))
                    continue
                if not pivots:
                    continue
                if matrix is None:
                    ids, components_, sketches = zip(*pivots)
                    ids, components_ = np.array(ids), np.array(components_)
                    matrix = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(pivots), -1)
                same = matrix == np.frombuffer(sketch, np.uint8)
                fit = (components_ != component) & (same[:, :low].sum(axis=1) >= SIGNATURE_FLOOR * low)
                if serves:  # of two pivots one is the other's member
                    fit &= ids < id_
                if fit.any():
                    before = same[:, low:].reshape(len(pivots), (len(sketch) - low) // _NAME, _NAME).all(axis=2).any(axis=1)
                    hits = ids[fit & ~before].tolist()
                    if hits:
                        used.update(hits)
                        found.append((bucket, block, id_, hits))
            if len(found) > 10_000:
                yield drain()
        if used:
            found.append((*at[:2], None, sorted(used)))
        if found:
            yield drain()

    return agree


def _compare(k: int, similarity: int):
    """Of rows sorted by (bucket, block, part, member or null), the pairs that are similar enough.

    The rows without a member hold the texts of the block's pivots and come first; the sets of one
    block are held at a time. A member names the pivots it is to be compared with.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for piece in pieces(batches, "text", PIECE):
            keys = zip(*(piece.column(c).to_pylist() for c in ("bucket", "block", "part")))
            members, pivots = piece.column("member").to_pylist(), piece.column("pivots").to_pylist()
            sets = shingle_sets(Words(piece.column("text")), k)
            pairs = []
            for key, member, others, shingles in zip(keys, members, pivots, sets):
                if key != at:
                    at, held = key, {}
                if member is None:
                    held[others[0]] = shingles
                    continue
                for pivot in others:
                    both = len(np.intersect1d(held[pivot], shingles, assume_unique=True))
                    if 100 * both >= similarity * (len(held[pivot]) + len(shingles) - both):
                        pairs.append((pivot, member))
            a, b = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


def components(space: Workspace, links: DataFrame) -> DataFrame:
    """Rows (id, component) of links (a, b) between integers: the smallest id that each reaches.

    Large-star and small-star steps alternate until only stars are left. Each pair of steps is
    written, which cuts the lineage.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = space.save(edges, "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = space.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def _candidates(buckets: DataFrame, sketches: DataFrame, pivots: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, block, member, pivots) to compare, and the buckets that are not settled by them.

    buckets: rows (bucket, band, id, component). Members outside the smallest component of a bucket
    are pivots: all of them if they are few, else about `pivots`, chosen by a hash of the id so that
    buckets of the same members choose the same ones. The pivots of a bucket are dealt over blocks
    and its members over parts, both of bounded size; pairs are formed inside a block only.
    """
    ends = buckets.groupBy("bucket").agg(F.min("component").alias("main"), F.max("component").alias("other"))
    marked = buckets.join(ends.filter("main <> other").select("bucket", "main"), "bucket")
    outside = marked.filter("component <> main").groupBy("bucket").agg(F.count(F.lit(1)).alias("outside"))
    chance = F.pmod(F.xxhash64(F.lit(SEED), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    serves = (F.col("component") != F.col("main")) & ((F.col("outside") <= pivots) | (chance * F.col("outside") < pivots))
    marked = marked.join(outside, "bucket").withColumn("serves", serves)
    sizes = marked.groupBy("bucket").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("serves") / BLOCK)).alias("blocks"), F.ceil(F.count(F.lit(1)) / PART).alias("parts")
    )
    spread = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_member = F.transform(upto("blocks"), lambda b: F.struct(b.alias("block"), spread(1, "parts").alias("part"), F.lit(False).alias("own")))
    as_pivot = F.transform(upto("parts"), lambda p: F.struct(spread(2, "blocks").alias("block"), p.alias("part"), F.lit(True).alias("own")))
    places = F.when(F.col("serves"), F.concat(as_member, as_pivot)).otherwise(as_member)
    placed = marked.join(sizes, "bucket").join(sketches, "id")
    sketch = F.substring("sketch", F.lit(1), F.lit(rows * bands) + F.col("band") * _NAME).alias("sketch")
    placed = placed.select("bucket", "id", "component", "serves", sketch, F.explode(places).alias("place"))
    placed = placed.select("place.*", "bucket", "id", "component", "serves", "sketch")
    key = ["bucket", "block", "part"]
    placed = placed.repartition(*key).sortWithinPartitions(*key, F.desc("own"))
    return placed.mapInArrow(released(_agree(rows, bands)), _FOUND), marked.filter(F.col("outside") > pivots).select("bucket", "band", "id", "component")


def _links(space: Workspace, found: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs that are similar enough.

    The members of a block are dealt over parts of bounded size. A member's text travels once per
    block of pivots, not once per pair.
    """
    found = space.save(found, "agreeing")
    wanted = found.filter("member is not null")
    parts = wanted.groupBy("bucket", "block").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    key = ["bucket", "block", "part"]
    members = wanted.join(parts, ["bucket", "block"]).withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")))
    members = members.select(*key, "member", "pivots").join(texts.withColumnRenamed("id", "member"), "member")
    own = found.filter("member is null").select("bucket", "block", F.explode("pivots").alias("pivot")).distinct()
    own = own.join(parts, ["bucket", "block"])
    own = own.select("bucket", "block", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    own = own.join(texts.withColumnRenamed("id", "pivot"), "pivot")
    own = own.select(*key, F.lit(None).cast("long").alias("member"), F.array("pivot").alias("pivots"), "text")
    rows = members.unionByName(own).repartition(*key).sortWithinPartitions(*key, F.col("member").asc_nulls_first())
    return rows.select(*key, "member", "pivots", "text").mapInArrow(released(_compare(k, similarity)), "a long, b long")


def near_duplicates(
    space: Workspace,
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 5,
    similarity: int = 80,
    rows: int = ROWS,
    bands: int = BANDS,
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Words are split at ASCII white space, A-Z in lower case. A text with fewer words than a shingle
    is one shingle. Texts link when 100 * intersection >= similarity * union of their sets; the
    component is the smallest id that links lead to. Texts that are null or have no word link with
    nothing. Rows with a null id link with nothing either and are kept, with a null component.
    Rows repeating an id and text give equal rows; different texts under one id are nodes of their
    own. Ids are integers. An empty table gives no rows.
    """
    ids = docs.select(F.col(id_column).cast("long").alias("id"), lower_ascii(text_of(text_column)).alias("text"))
    profile = ids.mapInArrow(released(_profiles(shingle, rows, bands)), "id long, n_shingles long, digest binary, signature binary")
    profile = space.save(profile, "profiles")
    named = profile.filter("id is not null and digest is not null")
    classes = named.groupBy("digest").agg(F.min("id").alias("least_id"), F.min("signature").alias("signature"))
    classes = space.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    banded = classes.select("id", "signature").mapInArrow(released(_bands(rows, bands)), "bucket long, band int, id long")
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = space.save(banded.join(full.select("bucket"), "bucket").withColumn("component", F.col("id")), "buckets")
    wanted = classes.join(buckets.select("id").distinct(), "id")
    sketches = space.save(wanted.select("id", "signature").mapInArrow(released(_sketches(rows, bands)), "id long, sketch binary"), "sketches")
    wanted = wanted.select(F.col("id").alias("class"), F.col("least_id").alias("id"), "digest")
    texts = space.save(ids.join(wanted, "id").mapInArrow(released(_own_text(shingle)), "id long, text string"), "texts")

    pivots, found = PIVOTS, None
    while True:
        agreeing, buckets = _candidates(buckets, sketches, pivots, rows, bands)
        links = _links(space, agreeing, texts, shingle, similarity)
        if found is not None:  # stars of the rounds before stand for their links
            links = links.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
        found = components(space, links)
        now = found.select("id", F.col("component").alias("now"))
        buckets = buckets.join(now, "id", "left").select("bucket", "band", "id", F.coalesce("now", "component").alias("component"))
        buckets = space.save(buckets, "open-buckets")
        if buckets.isEmpty():
            break
        pivots *= PIVOT_GROWTH
    of = classes.select("id", "digest", "least_id").join(found, "id", "left")
    of = of.withColumn("component", F.coalesce("component", "id"))
    least = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = of.join(least, "component").select("digest", "component_id")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return (
        profile.select("id", "n_shingles", "digest")
        .join(of, "digest", "left")
        .select(
            F.col("id").alias(id_column),
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def _own_text(k: int):
    """Of the texts found by a class's id, those of the class; an id may have other texts too."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            sets = shingle_sets(Words(piece.column("text")), k)
            same = [_digest(s) == d for s, d in zip(sets, piece.column("digest").to_pylist())]
            kept = piece.filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("class", "text")], names=["id", "text"])

    return own
