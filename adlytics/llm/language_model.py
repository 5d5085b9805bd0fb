"""LM scoring by deleted interpolation of word bigrams, unigrams and a uniform share.

P(w | v) = a c(v, w) / c(v) + b c(w) / N + (1 - a - b) / (V + 1), with weights a, b that depend on
the frequency c(v) of the context, in buckets of powers of two. The weights are learned by
expectation-maximisation on held-out text: a part of the training documents is left out of the
counts ("deleted") and the weights are those that make it likeliest. Final counts have all of it.

The corpus decides the size of the model, so no task holds it. Documents are taken in batches. A
batch asks for the counts of its own n-grams: sorted 64-bit hashes with the batch's counts go to
shards of the hash range, shards add them up, and the totals go back to the batches that asked, in
the order asked. A batch then scores its documents with the part of the model that they need. Every
batch and shard has bounded size whatever the corpus; frequent n-grams travel once per batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics.llm.common import Words, pieces, text_of
from adlytics.workspace import Workspace

#: Text of one batch, and text whose n-grams one shard adds up, in bytes.
BATCH_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
LEAST_SHARDS = 16
BUCKETS = 32
#: Held-out probabilities are tabulated in steps of a half octave.
STEPS = 2
NEVER = -10_000
EM_ROUNDS = 100
_END = np.uint64(xxhash.xxh3_64_intdigest("\x00end"))
_START = np.uint64(xxhash.xxh3_64_intdigest("\x00start"))
#: Pairs are told apart by 52 bits; fewer travel faster.
_PAIR_BITS = np.uint64((1 << 64) - (1 << 12))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Batch:
    """Tokens of a batch: sorted hashes of its words and pairs, and per token its places there."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        n = len(words.counts)
        self.lengths = words.counts + 1
        hashes = words.hashes()
        self.words, place = np.unique(np.append(hashes, _END), return_inverse=True)
        ends = words.starts[1:] + np.arange(n)
        token = np.full(len(words.codes) + n, place[-1], np.int64)
        inner = np.ones(len(token), bool)
        inner[ends] = False
        token[inner] = place[:-1][words.codes]
        self.token = token
        self.starts = ends + 1 - self.lengths
        self.context = np.concatenate(([-1], token[:-1])) if len(token) else token
        self.context[self.starts] = -1
        before = np.where(self.context < 0, _START, self.words[self.context])
        with np.errstate(over="ignore"):
            pair = before * _ODD + self.words[token]
            pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            pair ^= pair >> np.uint64(32)
        self.pairs, self.pair = np.unique(pair & _PAIR_BITS, return_inverse=True)

    def counts(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the texts marked, how often each word and pair occurs."""
        weight = np.repeat(counted, self.lengths)
        return (
            np.bincount(self.token[weight], minlength=len(self.words)),
            np.bincount(self.pair[weight], minlength=len(self.pairs)),
        )


def _packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as differences, their bytes in planes, then counts."""
    steps = np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(steps).tobytes() + counts.astype(np.int32).tobytes(), 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(packed)
    n = len(raw) // 12
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).reshape(-1)
    with np.errstate(over="ignore"):
        return np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, np.int32, n, 8 * n)


def _slices(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each of the equal parts of the hash range begins, and the end; shards is a power of two."""
    width = (1 << 64) // shards
    return np.searchsorted(hashes, np.array([i * width for i in range(shards)], np.uint64)).tolist() + [len(hashes)]


_BUNDLE = "batch string, tune boolean, docs binary"
_ASKED = "batch string, tune boolean, shard int, words binary, pairs binary"


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of documents, compressed, one per row; those that tune apart from the others."""

    def row(parts: list[pa.RecordBatch], tune: bool) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        whole = pa.Table.from_batches(parts).combine_chunks()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(whole)
        columns = [pa.array([uuid.uuid4().hex]), pa.array([tune]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["batch", "tune", "docs"])

    held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
    size = {False: 0, True: 0}
    for piece in pieces(batches, "text", BATCH_BYTES // 4):
        for tune in (False, True):
            part = piece.filter(pc.equal(piece.column("tune"), tune)).select(["doc_id", "text", "held_out"])
            if part.num_rows:
                held[tune].append(part)
                size[tune] += part.nbytes
                if size[tune] >= BATCH_BYTES:
                    yield row(held[tune], tune)
                    held[tune], size[tune] = [], 0
    for tune in (False, True):
        if held[tune]:
            yield row(held[tune], tune)


def _documents(docs: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(docs).read_all().combine_chunks().to_batches()[0]


def _ask(shards: int):
    """The counts that batches bring and ask for, by shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for name, tune, docs in zip(*(given.column(c) for c in ("batch", "tune", "docs"))):
                piece = _documents(docs.as_buffer())
                batch = Batch(piece.column("text"))
                held_out = piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                word_counts, pair_counts = batch.counts(~held_out)
                word_at, pair_at = _slices(batch.words, shards), _slices(batch.pairs, shards)
                rows = []
                for s in range(shards):
                    a, b, c, d = word_at[s], word_at[s + 1], pair_at[s], pair_at[s + 1]
                    if b > a or d > c:
                        asked = _packed(batch.words[a:b], word_counts[a:b]), _packed(batch.pairs[c:d], pair_counts[c:d])
                        rows.append((name.as_py(), tune.as_py(), s, *asked))
                kinds = pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["batch", "tune", "shard", "words", "pairs"])

    return ask


_ANSWERED = "batch string, tune boolean, shard int, words binary, pairs binary, less_words binary, less_pairs binary, known long, tokens long, less_tokens long"


def _add_up(group: pa.Table) -> pa.Table:
    """Totals of one shard, for every batch in the order it asked: with all training text and, for
    batches that tune, without the held-out part."""
    tunes = group.column("tune").to_pylist()
    out = {"known": 0, "tokens": 0, "less_tokens": 0}
    answers: dict[str, list] = {}
    for kind in ("words", "pairs"):
        asked = [_unpacked(x) for x in group.column(kind).to_pylist()]
        ends = np.cumsum([len(h) for h, _ in asked])
        hashes, place = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
        counts = np.concatenate([c for _, c in asked])
        tune = np.repeat(np.array(tunes, bool), [len(h) for h, _ in asked])
        total = np.bincount(place, counts, minlength=len(hashes)).astype(np.int64)
        less = np.bincount(place[~tune], counts[~tune], minlength=len(hashes)).astype(np.int64)
        if kind == "words":
            out = {"known": int((total > 0).sum()), "tokens": int(total.sum()), "less_tokens": int(less.sum())}
        wanted = [(place[e - len(h) : e], t) for (h, _), e, t in zip(asked, ends.tolist(), tunes)]
        answers[kind] = [zstandard.compress(total[at].tobytes(), 1) for at, _ in wanted]
        answers[f"less_{kind}"] = [zstandard.compress(less[at].tobytes(), 1) if t else None for at, t in wanted]
    first = [True] + [False] * (len(tunes) - 1)
    return pa.table(
        {
            "batch": group.column("batch"),
            "tune": group.column("tune"),
            "shard": group.column("shard"),
            **{k: pa.array(answers[k], pa.binary()) for k in ("words", "pairs", "less_words", "less_pairs")},
            **{k: pa.array([v if f else 0 for f in first], pa.int64()) for k, v in out.items()},
        }
    )


def _answers(group: pa.Table, prefix: str = "") -> tuple[pa.RecordBatch, Batch, np.ndarray, np.ndarray]:
    """Of the rows of one batch: its documents, its index, and the totals of its words and pairs."""
    order = np.argsort(np.asarray(group.column("shard")))
    docs = group.column("docs")[int(order[0])]
    piece = _documents(docs.as_buffer())
    told = [
        np.concatenate([np.frombuffer(zstandard.decompress(group.column(prefix + kind)[i].as_py()), np.int64) for i in order[1:].tolist()])
        for kind in ("words", "pairs")
    ]
    return piece, Batch(piece.column("text")), *told


def _parts(batch: Batch, words: np.ndarray, pairs: np.ndarray, tokens: int, texts: int):
    """Per token: context bucket, bigram share, unigram share."""
    context = np.where(batch.context < 0, texts, words[batch.context])
    bucket = np.where(context > 0, np.minimum(BUCKETS - 1, np.log2(np.maximum(context, 1)).astype(np.int64) + 1), 0)
    bigram = pairs[batch.pair] / np.maximum(context, 1)
    return bucket, bigram, words[batch.token] / max(1, tokens)


def _step(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.floor(STEPS * np.log2(np.maximum(p, 1e-300))), NEVER).astype(np.int64)


def _tabulate(tokens: int):
    def tabulate(group: pa.Table) -> pa.Table:
        _, batch, words, pairs = _answers(group, "less_")
        texts = int(words[np.searchsorted(batch.words, _END)])
        bucket, bigram, unigram = _parts(batch, words, pairs, tokens, texts)
        cell = np.stack([bucket, _step(bigram), _step(unigram)], axis=1)
        cell, place = np.unique(cell, axis=0, return_inverse=True)
        place = place.reshape(-1)
        return pa.table(
            {
                **{k: pa.array(cell[:, i]) for i, k in enumerate(("bucket", "bigram_step", "unigram_step"))},
                "n": pa.array(np.bincount(place, minlength=len(cell)).astype(np.int64)),
                "bigram": pa.array(np.bincount(place, bigram, minlength=len(cell))),
                "unigram": pa.array(np.bincount(place, unigram, minlength=len(cell))),
            }
        )

    return tabulate


@dataclass
class Interpolation:
    """Weights (bigram, unigram, uniform) per context bucket, and the sizes they go with."""

    weights: np.ndarray
    tokens: int
    known: int


def learn_weights(cells: pa.Table, known: int) -> np.ndarray:
    """Expectation-maximisation on held-out counts, tabulated by bucket and both probabilities.

    Buckets without held-out text get the weights of all buckets together; without any, thirds.
    """
    column = lambda k: np.asarray(cells.column(k), float)
    n = np.maximum(column("n"), 1.0)
    shares = np.stack([column("bigram") / n, column("unigram") / n, np.full(len(n), 1 / (known + 1))], axis=1)
    bucket = np.asarray(cells.column("bucket"), np.int64)

    def weights(mine: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        p, times = shares[mine], n[mine]
        for _ in range(EM_ROUNDS if len(p) else 0):
            joint = p * w
            w = (times[:, None] * joint / joint.sum(axis=1, keepdims=True)).sum(axis=0) / times.sum()
        # A part that held-out text never used keeps a trace, so that no text gets probability 0.
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    together = weights(np.ones(len(n), bool))
    return np.array([weights(bucket == b) if (bucket == b).any() else together for b in range(BUCKETS)])


_SCORED = "doc_id {0}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Interpolation):
    def score(group: pa.Table) -> pa.Table:
        piece, batch, words, pairs = _answers(group)
        texts = int(words[np.searchsorted(batch.words, _END)])
        bucket, bigram, unigram = _parts(batch, words, pairs, model.tokens, texts)
        w = model.weights[bucket]
        likely = w[:, 0] * bigram + w[:, 1] * unigram + w[:, 2] / (model.known + 1)
        count = words[batch.token]
        base = np.log10((count + 1) / (model.tokens + model.known + 1))
        add = lambda v: np.add.reduceat(v, batch.starts)
        n = len(batch.lengths)
        return pa.table(
            {
                "doc_id": piece.column("doc_id"),
                "held_out": piece.column("held_out"),
                "n_tokens": pa.array(batch.lengths),
                "n_known": pa.array(add((count > 0).astype(np.int64))),
                "train_tokens": pa.array([model.tokens] * n, pa.int64()),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(np.log10(likely))),
            }
        )

    return score


def score_documents(
    space: Workspace, docs: DataFrame, held_out: Column, tune: Column, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts come from the rows that are not held out; of these the ones marked `tune` teach the
    weights. Tokens are words split at ASCII white space, A-Z in lower case, and one end per text.
    Null and empty texts are one end. base_score adds one to every count. Repeated rows count and
    are scored each; other columns play no part; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), held_out.alias("held_out"))
    rows = rows.withColumn("tune", tune & ~F.col("held_out"))
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    shards = LEAST_SHARDS
    while shards * SHARD_BYTES < size:
        shards *= 2
    bundles = space.save(rows.mapInArrow(_bundle, _BUNDLE), "bundles")
    asked = bundles.select("batch", "tune", "docs").mapInArrow(_ask(shards), _ASKED)
    totals = space.save(asked.groupBy("shard").applyInArrow(_add_up, _ANSWERED), "totals")
    sizes = totals.agg(F.sum("known"), F.sum("tokens"), F.sum("less_tokens")).first()
    known, tokens, less_tokens = (x or 0 for x in sizes)

    wanted = ["batch", "shard", "words", "pairs", "docs"]
    nothing = F.lit(None).cast("binary")
    own = bundles.select("batch", "tune", F.lit(-1).alias("shard"), nothing.alias("words"), nothing.alias("pairs"), "docs")
    tuned = totals.filter("tune").select("batch", "shard", "less_words", "less_pairs", nothing.alias("docs"))
    tuned = own.filter("tune").select("batch", "shard", nothing.alias("less_words"), nothing.alias("less_pairs"), "docs").unionByName(tuned)
    cells = tuned.groupBy("batch").applyInArrow(
        _tabulate(less_tokens), "bucket long, bigram_step long, unigram_step long, n long, bigram double, unigram double"
    )
    cells = cells.groupBy("bucket", "bigram_step", "unigram_step").agg(*[F.sum(c).alias(c) for c in ("n", "bigram", "unigram")])
    model = Interpolation(learn_weights(cells.toArrow(), known), tokens, known)

    told = own.select(*wanted).unionByName(totals.select("batch", "shard", "words", "pairs", nothing.alias("docs")))
    scored = _SCORED.format(rows.schema["doc_id"].dataType.simpleString())
    return told.groupBy("batch").applyInArrow(_score(model), scored)
