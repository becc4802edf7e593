"""Spelling variants: near words by a relational trie frontier.

The words of the corpus form a trie over letters. A node with more than ``LEAF`` words below is
open, and the edges from it, at most one for each letter, are rows of a table; a node with fewer
is a leaf that holds its words. States (word, position, node, edits) say that the word up to
``position`` leads to ``node``. Level by level, the states without an edit are joined with all
edges of their node, which replace, add or skip a letter, and the states with one edit with the
edge of their next letter; an edge also lists the letters that follow it, so that most states
die before they are made. A state with one edit that comes to a leaf is a neighbour of the word
there whose rest equals its own; the words of one leaf are compared with each other.

Either the first or the second half of a word is free of the edit. So there are two tries, of
the words and of the reversed words, and a word enters each at the depth of the half taken as
it stands: states near the root, where a trie is dense, are never opened with an edit.

Nodes are prefixes, so the result is exact. A node has at most as many edges as there are
letters and a leaf at most ``LEAF`` words, so no group is ever paired with itself. Levels go as
deep as more than ``LEAF`` words share a prefix, however long single words are.

Defined cases: a null text has no words, a null id counts as an empty one; only A-Z are
lower-cased; rows of one id are documents of their own; words of any length are handled whole;
ties for the form go to the smallest word in code-point order; an empty table gives no words;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from threadloom.llm.rows import text_of
from threadloom.session import BROADCAST_BYTES, broadcast_if_small, write_measured, write_scratch

RUN = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
FORWARD, BACKWARD, END = ">", "<", "$"
LONG_TEXT = 1 << 22
HELD_WORDS = 200_000
LEAF = 64
HEAVY = 10_000
FILE_ROWS = 25_000


def word_counts(docs: DataFrame, slip: int | None = 97, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: the words of all whole texts with at least ``least_length`` code points.

    With ``slip``, a word whose crc32 beside its document's id is divisible by it loses one
    letter, the same in all places of that document.
    """
    kept = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_of().alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, totals = re.compile(RUN), Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = text.as_py().encode().lower().decode()
                runs = Counter(found.findall(body) if len(body) < LONG_TEXT else (m.group() for m in found.finditer(body)))
                for word, n in runs.items():
                    if len(word) < least_length:
                        continue
                    if slip:
                        code = zlib.crc32(f"{doc_id}:{word}".encode())
                        if code % slip == 0:
                            at = code % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_length:
                                continue
                    totals[word] += n
                if len(totals) >= HELD_WORDS:
                    yield counted(totals)
                    totals = Counter()
        yield counted(totals)

    def counted(totals: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(totals.values(), pa.int64())],
                                          names=["word", "n"])

    return kept.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Nodes:
    """A table keyed by trie nodes with the number of words below each, to be joined whatever that number is."""

    def __init__(self, rows: DataFrame, name: str, parts: int) -> None:
        self.rows, self.n, size = write_measured(rows.coalesce(parts), name)
        self.small = size <= BROADCAST_BYTES
        # Nodes over many words are few and go out to the rows; the others have small groups.
        self.heavy = None if self.small else broadcast_if_small(self.rows.where(F.col("below") > HEAVY))

    def join(self, rows: DataFrame, how: str = "inner", key: tuple[str, ...] = ("node",)) -> DataFrame:
        """Inner or left join by the node and, if given, further columns."""
        if self.small:
            return rows.join(F.broadcast(self.rows), list(key), how)
        heavy = self.heavy.select("node").distinct()
        light = rows.join(heavy, "node", "left_anti").join(self.rows.where(F.col("below") <= HEAVY), list(key), how)
        return rows.join(heavy, "node", "left_semi").join(self.heavy, list(key), how).unionByName(light)


def paths(words: DataFrame) -> DataFrame:
    """path, free: each word in both directions between a mark of the direction and an end mark, and how much stands as it is."""
    half = F.floor(F.length("word") / 2).cast("int")
    return words.select(F.explode(F.array(
        F.struct(F.concat(F.lit(FORWARD), "word", F.lit(END)).alias("path"), (half + 1).alias("free")),
        F.struct(F.concat(F.lit(BACKWARD), F.reverse("word"), F.lit(END)).alias("path"), (F.length("word") - half + 1).alias("free")),
    )).alias("p")).select("p.*")


def letter(n: Column | int) -> Column:
    """The letter of the path after the first ``n``, empty at the end."""
    return F.col("path").substr(F.lit(n) + 1 if isinstance(n, int) else n + 1, F.lit(1))


def trie(words: DataFrame, least_length: int, leaf: int, parts: int) -> tuple[DataFrame, list[tuple[int, Nodes]]]:
    """path, free, leaf (the depth of its leaf) of every word, and the edges from the open nodes of each depth."""
    depth = 1 + least_length // 2
    waiting, placed, edges = paths(words), None, []
    while True:
        cut = waiting.withColumn("node", F.col("path").substr(1, depth))
        large = Nodes(cut.groupBy("node").agg(F.count("*").alias("below")).where(F.col("below") > leaf), "open_nodes", parts)
        level = write_scratch(large.join(cut, "left").coalesce(parts), "level")
        if edges:
            # What the nodes of this depth are to those above them.
            below = level.groupBy("node").agg(F.max(F.col("below").isNotNull()).alias("open"), F.concat_ws("", F.collect_set(letter(depth))).alias("next"))
            parent = F.col("node").substr(F.lit(1), F.length("node") - 1)
            above = below.select(parent.alias("node"), F.col("node").alias("child"), F.right("node", F.lit(1)).alias("letter"), "open", "next")
            edges[-1] = (depth - 1, Nodes(edges[-1][1].join(above), "edges", parts))
        here = level.where("below IS NULL").select("path", "free", F.lit(depth).alias("leaf"))
        placed = here if placed is None else placed.union(here)
        if not large.n:
            return placed, edges
        edges.append((depth, large))
        waiting = level.where("below IS NOT NULL").select("path", "free")
        depth += 1


def opened(placed: DataFrame, edges: Nodes, depth: int) -> DataFrame:
    """path, position, node, open: states with one edit, from the words that pass an open node of this depth without one."""
    passing = placed.where((F.col("free") <= depth) & (F.col("leaf") > depth)).select("path", F.col("path").substr(1, depth).alias("node"))
    met = edges.join(passing).where(F.col("letter") != letter(depth))
    # Replaced, added, and left out; after it the rest of the word has to follow.
    after = F.array_compact(F.array(
        *[F.when(follows(F.lit(depth + skipped)), F.lit(depth + skipped)) for skipped in (1, 0)],
        F.when((F.col("letter") == letter(depth + 1)) & follows(F.lit(depth + 2)), F.lit(depth + 2))))
    return met.select("path", F.explode(after).alias("position"), F.col("child").alias("node"), "open")


def follows(position: Column) -> Column:
    """Whether the path can go on behind the edge just taken: its next letter, or its end behind an end mark."""
    return F.when(F.col("letter") == END, position == F.length("path")).otherwise(
        (position < F.length("path")) & (F.instr(F.col("next"), letter(position)) > 0))


def advanced(states: DataFrame, edges: Nodes) -> DataFrame:
    """States with one edit after the edge of their next letter."""
    asked = states.select("path", "position", "node", letter(F.col("position")).alias("letter"))
    moved = edges.join(asked, key=("node", "letter")).withColumn("position", F.col("position") + 1)
    return moved.where(follows(F.col("position"))).select("path", "position", F.col("child").alias("node"), "open")


def near_words(words: DataFrame, n: int, least_length: int = LEAST_LENGTH, leaf: int = LEAF) -> DataFrame:
    """word, near: all pairs, both ways, that differ by one inserted, deleted or replaced code point. ``n``: number of words."""
    parts = files_for(n)
    placed, levels = trie(words, least_length, leaf, parts)
    states, ended = None, None
    for depth, edges in levels:
        step = opened(placed, edges, depth)
        if states is not None:
            step = step.union(advanced(states.where("open"), edges))
        states = write_scratch(step.coalesce(parts), "states")
        ended = states if ended is None else ended.union(states)
    # A leaf is the same prefix for all its words: the rests behind it are compared.
    members = write_scratch(placed.select(F.col("path").substr(F.lit(1), F.col("leaf")).alias("node"), "path").coalesce(parts), "members")
    rest = lambda at: F.col("path").substr(at + 1, F.length("path"))
    others = members.select("node", F.col("path").alias("other"), rest(F.length("node")).alias("rest"))
    pairs = members.withColumnRenamed("path", "one").join(others.select("node", "other"), "node").where(
        (F.col("one") != F.col("other")) & (F.abs(F.length("one") - F.length("other")) <= 1)
        & (F.levenshtein("one", "other", 1) == 1)).select("one", "other")
    if ended is not None:
        arrived = ended.where("NOT open").select("node", F.col("path").alias("one"), rest(F.col("position")).alias("rest"))
        pairs = pairs.union(arrived.join(others, ["node", "rest"]).select("one", "other"))
    bare = lambda c: F.col(c).substr(F.lit(2), F.length(c) - 2)
    turned = lambda c: F.when(F.col(c).startswith(FORWARD), bare(c)).otherwise(F.reverse(bare(c)))
    return pairs.select(turned("one").alias("word"), turned("other").alias("near")).distinct()


def files_for(rows: int) -> int:
    """How many files a table of about so many words is written to."""
    return max(8, math.ceil(rows / FILE_ROWS))


def followed(forms: DataFrame, parts: int) -> DataFrame:
    """word, root: the last word on the way along forms (word, form); by pointer doubling."""
    roots = write_scratch(forms.select("word", F.col("form").alias("root")).coalesce(parts), "roots")
    while True:
        ahead = broadcast_if_small(roots.select(F.col("word").alias("root"), F.col("root").alias("next")).coalesce(parts))
        seen = Observation()
        step = roots.join(ahead, "root", "left").observe(seen, F.count("next").alias("moved"))
        roots = write_scratch(step.select("word", F.coalesce("next", "root").alias("root")).coalesce(parts), "roots")
        if not seen.get["moved"]:
            return roots


def spelling_variants(docs: DataFrame, slip: int | None = 97, least_length: int = LEAST_LENGTH,
                      least_count: int = LEAST_COUNT, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word with ``least_count`` occurrences.

    A word's form is its most frequent near word, if that occurs ``factor`` times as often.
    """
    words, n, _ = write_measured(word_counts(docs, slip, least_length).where(F.col("n") >= least_count), "words")
    pairs, parts = near_words(words, n, least_length), files_for(n)
    sized = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = sized.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.less") >= factor * F.col("n")
    table = write_scratch(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.less")).alias("form_n")).coalesce(parts), "variants")
    roots = followed(table.where("form IS NOT NULL"), parts)
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
