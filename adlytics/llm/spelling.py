"""Spelling variants: exact neighbours of words by a dictionary of trie-node pairs.

Every word is a path in a trie and, read backwards, in a reversed trie. Nodes are numbered, so a
word cut at a place is a pair of integers: the node of what stands before, the node of what follows.

* A word's pair around a skipped character, (node of w[:i], node of w[i+1:]), is shared by all
  words that have another character there: these are one replacement apart.
* It equals the plain cut (node of v[:i], node of v[i:]) of the one word that lacks the
  character: that is one deletion apart.

So two words are neighbours if and only if they share a pair in one of these ways; nothing is
compared and nothing is verified later. Deleting any character of a run of equal ones gives the
same word, so only the first of a run counts. A pair is shared by at most as many words as there
are letters, plus one.

Nodes down to a depth of SHALLOW are numbered by arithmetic, as their characters in one integer.
Deeper nodes are numbered through a dictionary, which holds only nodes of two words or more: a node
of one word is shared with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics.llm.common import lower_ascii, text_of
from adlytics.operators.skew import spread_join
from adlytics.workspace import Workspace

#: The letters of a word, each of them one byte in Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
#: Depth down to which a node is its characters in one integer.
SHALLOW = 7
#: Numbers of the dictionary begin here, above all shallow ones.
_DEEP = 1 << 60
#: Characters of the words that are cut together.
_BATCH = 1 << 18


def runs(text: Column, min_length: int) -> Column:
    """Maximal runs of letters of at least that length, A-Z in lower case."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))


def with_slips(doc_id: Column, run: Column, every: int) -> Column:
    """The run, with one character deleted where crc32 of `<doc_id>:<run>` is divisible by `every`.

    The crc names the character, too. A null id counts as the empty text.
    """
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(crc, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(crc, F.lit(every)) == 0, cut).otherwise(run)


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = 6, min_count: int = 5, slip_every: int = 0
) -> DataFrame:
    """Rows (word, n): words of at least `min_length` letters that occur at least `min_count` times.

    `slip_every` plants misspellings (see `with_slips`); 0 plants none. Null texts hold no word.
    """
    each = docs.select(F.col(id_column).alias("id"), F.explode(runs(text_of(text_column), min_length)).alias("run"))
    word = with_slips(F.col("id"), F.col("run"), slip_every) if slip_every else F.col("run")
    words = each.select(word.alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _nodes(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names (two integers) of the nodes on the path of each word, from the root on.

    The path of word k begins at starts[k] + k and has lengths[k] + 1 nodes. A shallow node is
    named by its characters alone; a deeper one by two hashes that follow the path.
    """
    names = np.zeros((2, len(letters) + len(starts)), np.uint64)
    first = starts + np.arange(len(starts))
    live = np.arange(len(starts))
    a = np.zeros(len(starts), np.uint64)
    b = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            keep = lengths[live] >= depth
            live, a, b = live[keep], a[keep], b[keep]
            c = letters[starts[live] + depth - 1].astype(np.uint64)
            if depth <= SHALLOW:
                a = a << np.uint64(8) | c
            else:
                b = _mixed(b * np.uint64(0x9E3779B97F4A7C15) + (a if depth == SHALLOW + 1 else np.uint64(0)) + c)
                a = _mixed(a * np.uint64(0xD6E8FEB86659FD93) + c)
            names[0, first[live] + depth] = a
            names[1, first[live] + depth] = b
    return names.view(np.int64)


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts of words: plain ones (at place i) and ones that skip the character at place i."""
    for batch in batches:
        sizes = [len(w) for w in batch.column("word").to_pylist()]
        ends = np.cumsum(sizes)
        for group in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // _BATCH)) + 1):
            if len(group):
                yield from _cut_words(batch.slice(int(group[0]), len(group)))


def _cut_words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    words = batch.column("word").to_pylist()
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    head = _nodes(letters, starts, lengths)
    back = np.concatenate([np.frombuffer(w.encode("latin-1")[::-1], np.uint8) for w in words])
    tail = _nodes(back, starts, lengths)
    n_nodes = lengths + 1
    word = np.repeat(np.arange(len(words)), n_nodes)
    at = np.arange(len(word)) - np.repeat(np.cumsum(n_nodes) - n_nodes, n_nodes)
    base, whole = (starts + np.arange(len(words)))[word], lengths[word]
    following = base + whole - at  # the node of w[at:]
    inner = at < whole
    place = np.minimum(starts[word] + at, len(letters) - 1)
    first_of_run = (at == 0) | (letters[place] != letters[np.maximum(place - 1, 0)])
    for skips, chosen, after in ((False, np.ones(len(word), bool), following), (True, inner, following - 1)):
        here, there = (base + at)[chosen], after[chosen]
        depth = at[chosen]
        columns = [
            pa.array(np.asarray(batch.column("id"))[word[chosen]]),
            pa.array(np.asarray(batch.column("n"))[word[chosen]]),
            pa.array(np.full(int(chosen.sum()), skips)),
            pa.array(first_of_run[chosen]),
            pa.array(head[0][here]),
            pa.array(head[1][here], mask=depth <= SHALLOW),
            pa.array(tail[0][there]),
            pa.array(tail[1][there], mask=whole[chosen] - depth - skips <= SHALLOW),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "skips", "first", "head", "head2", "tail", "tail2"])


_CUTS = "id long, n long, skips boolean, first boolean, head long, head2 long, tail long, tail2 long"


def _numbered(space: Workspace, cuts: DataFrame, side: str) -> DataFrame:
    """Cuts with deep nodes of one side as numbers of a dictionary; nodes of one word go."""
    names = [side, f"{side}2"]
    deep = cuts.filter(F.col(names[1]).isNotNull())
    node = deep.groupBy(*names).agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most")
    node = node.select(*names).sortWithinPartitions(*names).withColumn("node", F.monotonically_increasing_id() + F.lit(_DEEP))
    node = space.save(node, f"{side}-nodes")
    found = spread_join(deep, node, names)
    shallow = cuts.filter(F.col(names[1]).isNull()).withColumn("node", F.col(side))
    return shallow.unionByName(found).drop(*names).withColumnRenamed("node", side)


def _better(member: Column) -> Column:
    """Sorts near words: the more frequent first, then the first in code-point order."""
    return F.struct((-member["n"]).alias("minus_n"), member["id"].alias("id"))


def near_words(space: Workspace, words: DataFrame) -> DataFrame:
    """Rows (id, n_near, best_n, best) of words (id, word, n) that have a near word.

    Two words are near if they differ by exactly one inserted, deleted or replaced character.
    `best` is the id of the near word of largest n, the smallest id among equals. Words are distinct.
    """
    cuts = space.save(words.select("id", "word", "n").mapInArrow(_cuts, _CUTS), "cuts")
    # Numbering reads its cuts three times, so the first side is saved before the second.
    headed = space.save(_numbered(space, cuts, "head"), "headed-cuts")
    pairs = _numbered(space, headed, "tail").select("head", "tail", "id", "n", "skips", "first")
    # Hardly any pair comes twice within a task of the join, so lists are made behind the shuffle only:
    # there a task holds the share of a shuffle partition, whatever the size of the stored files.
    dealt = pairs.repartition("head", "tail")
    shared = dealt.groupBy("head", "tail").agg(F.collect_list(F.struct("id", "n", "skips", "first")).alias("members"))
    # Members of a pair differ in the character they skip, so there are few of them whatever the data.
    shared = shared.filter(F.size("members") > 1)
    each = shared.select("members", F.explode("members").alias("own"))
    own = F.col("own")
    near = F.filter(
        "members",
        lambda m: F.when(m["skips"] & own["skips"], m["id"] != own["id"])
        .when(m["skips"] != own["skips"], F.when(m["skips"], m["first"]).otherwise(own["first"]))
        .otherwise(False),
    )
    found = each.select("own.id", near.alias("near")).filter(F.size("near") > 0)
    found = found.select("id", F.size("near").alias("n_near"), F.array_min(F.transform("near", _better)).alias("best"))
    best = found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return best.select("id", "n_near", (-F.col("best.minus_n")).alias("best_n"), F.col("best.id").alias("best"))


def roots(space: Workspace, forms: DataFrame) -> DataFrame:
    """Rows (id, root) of rows (id, form): the last form that following the forms leads to.

    Every round doubles the steps that are followed. Forms lead to ever more frequent words, so
    the way has an end.
    """
    found = space.save(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        step = found.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = spread_join(found, step, ["root"], "left")
        if further.filter("next is not null").isEmpty():
            return found
        found = space.save(further.select("id", F.coalesce("next", "root").alias("root")), "roots")


def variants(space: Workspace, counts: DataFrame, ratio: int = 5) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of distinct words (word, n), one per word.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that n
    is at least `ratio` times the word's own; else null. Its root is what following forms leads to,
    the word itself where it has no form. Words of any length; they consist of LETTERS. No words,
    no rows. Further columns are ignored.
    """
    ordered = counts.filter(F.col("word") != "").select("word", "n").orderBy("word")
    words = space.save(ordered.withColumn("id", F.monotonically_increasing_id()), "words")
    near = space.save(near_words(space, words), "near")
    formed = words.select("id", "n").join(near, "id").filter(F.col("best_n") >= ratio * F.col("n"))
    formed = space.save(formed.select("id", F.col("best").alias("form")), "forms")
    root = roots(space, formed)
    links = formed.join(root, "id")
    names = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    links = spread_join(links, names, ["form"])
    names = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    links = spread_join(space.save(links, "links"), names, ["root"]).select("id", "form_word", "root_word", "form_n")
    return (
        words.join(near.select("id", "n_near"), "id", "left")
        .join(links, "id", "left")
        .select(
            "word",
            F.col("form_word").alias("form"),
            F.coalesce("root_word", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )
