"""Near-duplicate documents by Order MinHash, verified by banded alignment.

1. Every text gets an Order MinHash signature (``sketches``): tuples of the ``order`` least
   occurrence-numbered five-word k-mers in text order, ``functions`` of them for each of
   ``bins`` classes of k-mers.
2. Equal texts are one node from here on, so copies are never expanded.
3. Nodes that agree in a tuple share a bucket. A bucket has leaders: the member of most and
   largest buckets, which in a family of versions is their source, and some drawn at random. In
   each of a few rounds every node meets one leader of its buckets: the heaviest, the heaviest
   in another group, then drawn ones in other groups. A pair is a link if the edit similarity of
   its word sequences is at least ``least`` (``alignment``). Families shrink to one group
   instead of all pairs.
4. What is still apart is settled (``settled_links``). Buckets with the same heaviest member are
   one class. Every two members of a class in different groups are compared by length and by
   their counts of words in ``BINS`` kinds, by whole arrays inside a task; neither test can
   exclude a link. Pairs that pass are aligned in the task, each in the first class that both
   belong to, and only links that join two groups leave it. So rows grow with the members of
   classes, not with their pairs, also where many texts share a passage but are not alike.
5. Groups are the connected components of the links, found by star contraction with
   written tables between rounds.

A pair of texts whose k-mers overlap by J agrees in a tuple with chance near J^order. Words
replaced at scattered places leave the share s^5 of the k-mers at similarity s, and
J = s^5 / (2 - s^5). Of 1,500 planted pairs of 200 words each, the 160 tuples missed 0.9 % at
s = 0.8, where J = 0.2, 0.1 % at 0.82 and none at 0.85. That holds for texts of many k-mers: of
texts of a few words, edits may leave none in common. No bucket is capped. A class of more than ``BLOCK`` members is
compared in cells of blocks: the members outside its largest group, in blocks, with each other
and with that group.

Defined cases: a null text counts as empty; texts without words are grouped only with
equal texts; of each group the row with the least id (null first, then by text digest)
is kept; rows equal in id and text count as one document; a very long text is one row like any
other; an empty table gives an empty result; other columns are ignored, and come back from
``one_of_each`` under their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm import sketches
from threadloom.llm.alignment import similarity
from threadloom.llm.rows import boxed, slices, text_of, unboxed
from threadloom.session import broadcast_if_small, write_result, write_scratch

BINS = 128
DRAWS = 1
BLOCK = 1024
CHUNK_ROWS = 32


def sketch(docs: DataFrame, functions: int, order: int, bins: int) -> DataFrame:
    """doc_id, node (digest of the text), row_no, and for the first row of a text in its task n_words, bag, signature.

    bag: words in each of BINS classes, at most 255.
    """
    kept = docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), text_of().alias("body"))
    schema = (f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, row_no long, node binary, fresh boolean, n_words long, "
              "bag binary, signature array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        randoms, seen = sketches.Randoms(), set()
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            nodes = [hashlib.md5(t.encode()).digest() for t in texts]
            fresh = np.array([not (n in seen or seen.add(n)) for n in nodes], dtype=bool)
            new = [t for t, f in zip(texts, fresh) if f]
            signed, counts = sketches.signatures(new, functions, order, randoms, bins=bins)
            lists = pa.ListArray.from_arrays(np.arange(len(new) + 1, dtype=np.int32) * signed.shape[1], pa.array(signed.ravel()))
            place = pa.array(np.cumsum(fresh) - 1, mask=~fresh)
            columns = [pa.array(counts), pa.array([bag(t, randoms) for t in new], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.binary()), pa.array(fresh),
                                              *[c.take(place) for c in columns]],
                                             names=["doc_id", "row_no", "node", "fresh", "n_words", "bag", "signature"])

    return kept.mapInArrow(run, schema)


def bag(text: str, randoms: sketches.Randoms) -> bytes:
    hashes = sketches.word_hashes(sketches.spaced(text)[0], randoms)
    counts = np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=BINS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def word_bodies(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, words: 32-bit word hashes of the texts in ``nodes`` (id, node, doc_id), one row each."""
    wanted = nodes.select("id", F.col("node").alias("_node"), F.col("doc_id").alias("_id"))
    texts = docs.select(F.unhex(F.md5(text_of())).alias("node"), "doc_id", text_of().alias("body")).join(
        broadcast_if_small(wanted), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        randoms = sketches.Randoms()
        for batch in slices(batches):
            out = [sketches.word_hashes(sketches.spaced(t)[0], randoms).astype("<u4").tobytes()
                   for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "words"])

    return texts.mapInArrow(run, "id long, words binary").groupBy("id").agg(F.any_value("words").alias("words"))


def verified(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """u, v of the pairs (u, v) whose texts reach the similarity ``least``."""
    joined = pairs.join(bodies.select(F.col("id").alias("u"), F.col("words").alias("a")), "u") \
        .join(bodies.select(F.col("id").alias("v"), F.col("words").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = np.array([similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) >= least
                              for x, y in zip(a, b)], dtype=bool)
            yield batch.select(["u", "v"]).filter(pa.array(found))

    return joined.mapInArrow(run, "u long, v long")


def room(a: np.ndarray, a_words: np.ndarray, b: np.ndarray, b_words: np.ndarray, least: float) -> np.ndarray:
    """Whether the bags and lengths of texts leave room for the similarity: truth values [a, b].

    An edit changes the counts of two classes by one each at most.
    """
    longer = np.maximum(a_words[:, None], b_words[None, :])
    most = ((1 - least) * longer + 1e-9).astype(np.int64)
    fits = np.abs(a_words[:, None] - b_words[None, :]) <= most
    near = np.abs(a[:, None, :].astype(np.int16) - b[None, :, :]).sum(axis=2, dtype=np.int64) <= 2 * most
    return fits & near


def linked(rows: pa.Table, key: int, within: bool, least: float) -> list[tuple[int, int]]:
    """Links between the groups of one cell: of rows on the left with the others, or of all; no more than join the groups.

    A pair is aligned if it is in different groups by now, ``room`` lets it pass, and this is the
    first class that both texts belong to.
    """
    rows = rows.sort_by("n_words")
    left = np.ones(rows.num_rows, dtype=bool) if within else rows["left"].to_numpy(zero_copy_only=False)
    ids, roots, words = (rows[c].to_numpy() for c in ("id", "root", "n_words"))
    bags = np.frombuffer(b"".join(rows["bag"].to_pylist()), dtype=np.uint8).reshape(-1, BINS)
    classes, bodies = [set(c) for c in rows["classes"].to_pylist()], rows["words"].to_pylist()
    right = np.arange(len(ids)) if within else np.flatnonzero(~left)
    lefts = np.flatnonzero(left)
    above = {int(r): int(r) for r in np.unique(roots)}
    found = []

    def group(r: int) -> int:
        while above[r] != r:
            above[r] = r = above[above[r]]
        return r

    for first in range(0, len(lefts), CHUNK_ROWS):
        a = lefts[first:first + CHUNK_ROWS]
        # Only texts of a fitting length, which stand together.
        low, high = words[a[0]] * least - 1, (words[a[-1]] + 1) / least + 1
        b = right[np.searchsorted(words[right], low):np.searchsorted(words[right], high, side="right")]
        differ = roots[a][:, None] != roots[b][None, :]
        if within:
            differ &= a[:, None] < b[None, :]
        if not differ.any():
            continue
        x, y = np.nonzero(differ & room(bags[a], words[a], bags[b], words[b], least))
        for i, j in zip(a[x].tolist(), b[y].tolist()):
            one, two = group(int(roots[i])), group(int(roots[j]))
            if one != two and min(classes[i] & classes[j]) == key and similarity(
                    np.frombuffer(bodies[i], "<u4"), np.frombuffer(bodies[j], "<u4"), least) >= least:
                above[max(one, two)] = min(one, two)
                found.append((int(ids[i]), int(ids[j])))
    return found


def cells(members: DataFrame) -> DataFrame:
    """``members`` (key, id, root, ...) of the unsettled buckets in the cells in which they are to be compared.

    In a cell stand one block of members outside the largest group of a bucket (``left``) and
    one of that group (kind 0), or two blocks of such members (kind 1).
    """
    groups = members.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(
        F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("mains"), F.sum("size").alias("n"))
    split = groups.where(F.col("n") > F.col("mains")).select(
        "key", "main", F.ceil(F.col("mains") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil((F.col("n") - F.col("mains")) / BLOCK).cast("int").alias("other_blocks"))
    rows = members.join(split, "key")
    block = lambda n: F.pmod(F.xxhash64("id", "key"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    main = rows.where(F.col("root") == F.col("main")).withColumn("y", block("main_blocks")) \
        .select("*", F.explode(every("other_blocks")).alias("x"), F.lit(0).alias("kind"), F.lit(False).alias("left"))
    other = rows.where(F.col("root") != F.col("main")).withColumn("mine", block("other_blocks"))
    with_main = other.select("*", F.explode(every("main_blocks")).alias("y"), F.col("mine").alias("x"), F.lit(0).alias("kind"),
                             F.lit(True).alias("left"))
    with_others = other.select("*", F.explode(every("other_blocks")).alias("z")).select(
        "*", F.least("mine", "z").alias("x"), F.greatest("mine", "z").alias("y"), F.lit(1).alias("kind"), (F.col("mine") <= F.col("z")).alias("left"))
    columns = ["key", "kind", "x", "y", "left", "id", "root"]
    return main.select(columns).union(with_main.select(columns)).union(with_others.select(columns))


def settled_links(classes: DataFrame, texts: DataFrame, bodies: DataFrame, rounds: DataFrame, least: float) -> DataFrame:
    """u, v of links between different groups, such that no two members of one class (key, id) that are alike stay apart."""
    grouped = classes.join(broadcast_if_small(rounds), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = write_scratch(cells(write_scratch(grouped, "grouped")), "cells")
    at = ["key", "kind", "x", "y"]
    own = classes.groupBy("id").agg(F.collect_list("key").alias("classes"))
    details = texts.select("id", "n_words", "bag").join(open_.select("id").distinct(), "id", "left_semi").join(own, "id").join(bodies, "id")
    sized = open_.join(details, "id").select(*at, "left", "id", "root", "n_words", "bag", "classes", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for first, last in zip([0, *change], [*change, batch.num_rows]):
                here = tuple(keys[:, first])
                if here != now and held:
                    yield links(held, now)
                    held = []
                now = here
                held.append(batch.slice(first, last - first))
        if held:
            yield links(held, now)

    def links(rows: list[pa.RecordBatch], cell: tuple) -> pa.RecordBatch:
        found = linked(pa.Table.from_batches(rows), int(cell[0]), cell[1] == 1 and cell[2] == cell[3], least)
        return pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())],
                                          names=["u", "v"])

    return sized.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, root of the connected components of links (u, v): root is the least node. By star contraction.

    Every link is kept as u > v, so a node's lower neighbours are the v of its rows. A round is one
    plan without a union, and is run only while the links are not yet stars: each job, shuffle and
    broadcast of these narrow tables costs the driver buffers and threads, whatever its rows.
    """
    edges = write_scratch(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                          .where(F.col("u") != F.col("v")).distinct(), "edges")
    while not stars(edges):
        lower = edges.groupBy(F.col("u").alias("lower")).agg(F.min("v").alias("m"))
        large = edges.join(lower, F.col("v") == F.col("lower"), "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("u", "v"))
        edges = write_scratch(small.where(F.col("u") != F.col("v")).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def stars(edges: DataFrame) -> bool:
    """Whether every u of distinct links (u > v) has one link and is nowhere a v."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                         F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return node.where("up > 0 and n > 1").isEmpty()


def near_duplicates(docs: DataFrame, least: float = 0.8, functions: int = 20, order: int = 2,
                    bins: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, node, n_words, class_id (least id of its group), kept."""
    return write_result(docs.sparkSession, "classes", lambda: _grouped(docs, least, functions, order, bins))


def _grouped(docs: DataFrame, least: float, functions: int, order: int, bins: int) -> DataFrame:
    signed = write_scratch(sketch(docs, functions, order, bins), "sketches")
    rows = signed.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), (F.count("*") > F.count("doc_id")).alias("no_id"),
        F.min(F.when(F.col("fresh"), F.col("row_no"))).alias("id")).select(
            "id", "node", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"))
    nodes = write_scratch(rows, "nodes")
    # One signed row of each text.
    texts = signed.where("fresh").withColumnRenamed("row_no", "id").join(broadcast_if_small(nodes.select("id")), "id", "left_semi")
    bands = texts.select("id", F.posexplode("signature").alias("f", "value")).where("value != -1") \
        .select("id", F.xxhash64("f", "value").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = write_scratch(bands.join(shared, "key").select("key", "n", "id"), "members")
    weights = members.groupBy("id").agg(F.sum("n").alias("weight"))
    leaders = members.join(weights, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("heaviest"), *[
        F.max(F.struct(F.xxhash64("id", "key", F.lit(draw)).alias("draw"), "id")).alias(f"drawn_{draw}") for draw in range(DRAWS)])
    drawn = [f"drawn_{draw}" for draw in range(DRAWS)]
    led = write_scratch(members.join(leaders, "key").select("id", "heaviest", *drawn), "led")

    bodies = write_scratch(word_bodies(docs, members.select("id").distinct().join(nodes, "id")), "bodies")

    def met(leader: str, groups: DataFrame | None) -> DataFrame:
        """Links of members with one leader each: the first of those of their buckets that are in another group."""
        pairs = led.select("id", F.col(f"{leader}.id").alias("lead"), F.col(leader).alias("turn")).where("id != lead")
        if groups is not None:
            known = broadcast_if_small(groups)
            pairs = pairs.join(known, "id", "left").withColumnRenamed("root", "root_a") \
                .join(known.select(F.col("id").alias("lead"), F.col("root").alias("root_b")), "lead", "left") \
                .where(F.coalesce("root_a", "id") != F.coalesce("root_b", "lead"))
        chosen = pairs.groupBy("id").agg(F.max("turn").alias("turn")).select("id", F.col("turn.id").alias("lead"))
        pairs = chosen.select(F.greatest("id", "lead").alias("u"), F.least("id", "lead").alias("v")).distinct()
        return write_scratch(verified(pairs, bodies, least), "links")

    groups = _groups(met("heaviest", None))
    for leader in ("heaviest", *drawn):
        groups = _groups(met(leader, groups), groups)
    # Buckets with the same heaviest member make one class: two nodes of a bucket are in one class at least.
    classes = write_scratch(led.select(F.col("heaviest.id").alias("key"), "id").distinct(), "bucket_classes")
    links = write_scratch(settled_links(classes, texts, bodies, groups, least), "links")
    return _classes(signed, texts, nodes, _groups(links, groups))


def _groups(links: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """id, root of the nodes that links join with others, and of those in the ``groups`` found before."""
    if groups is not None:
        links = links.union(groups.select("id", "root"))
    return components(links).withColumnRenamed("node", "id")


def _classes(signed: DataFrame, texts: DataFrame, nodes: DataFrame, rounds: DataFrame) -> DataFrame:
    """Name every row's group. Only texts that have links are grouped by root, and their names measured to be sent out."""
    roots = rounds.union(rounds.select(F.col("root").alias("id"), "root").distinct())
    linked = write_scratch(nodes.join(broadcast_if_small(roots), "id"), "linked")
    best = linked.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("best"))
    best = broadcast_if_small(best.select("root", F.col("best.doc_id").alias("best_id"), F.col("best.node").alias("best_node")))
    other = linked.join(best, "root").select("id", "best_id", "best_node")
    words = texts.select("id", "n_words")
    named = nodes.join(words, "id").join(broadcast_if_small(other), "id", "left").select(
        "node", "n_words", F.when(F.col("best_node").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("class_id"),
        F.coalesce("best_node", "node").alias("best_node"))
    return signed.select("doc_id", "node").join(named, "node").select(
        "doc_id", "node", "n_words", "class_id",
        ((F.col("node") == F.col("best_node")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def one_of_each(docs: DataFrame, **settings: float) -> DataFrame:
    """One document of each group, with the columns of ``docs``.

    Only ids and digests of rows to drop, and of rows that stand more than once, are joined.
    """
    rows = near_duplicates(docs, **settings).groupBy("doc_id", "node").agg(
        F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    marked = broadcast_if_small(rows.where(~F.col("kept") | (F.col("n") > 1)).select(
        F.col("doc_id").alias("marked_id"), F.col("node").alias("marked"), "kept"))
    found = boxed(docs, doc_id=F.col("doc_id"), node=F.unhex(F.md5(text_of()))).join(
        marked, (F.col("node") == F.col("marked")) & F.col("doc_id").eqNullSafe(F.col("marked_id")), "left")
    single = found.where(F.col("marked").isNull()).select("row")
    repeated = found.where("kept").dropDuplicates(["doc_id", "node"]).select("row")
    return unboxed(single.union(repeated), docs.columns, [])
