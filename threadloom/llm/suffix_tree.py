"""Language-model scores by a probabilistic suffix tree over the bytes of words.

A text is lower-cased (A-Z) and read as its words, each followed by a blank, and an end
mark. Contexts are the last 0 to ``DEPTH`` bytes, also across words. Training counts, for
every position of every training text, the byte that follows its context:

* contexts occur with at least ``least_share`` of all positions, which bounds the tree by
  DEPTH / least_share contexts however large the corpus is;
* a context is retained if its next-byte counts diverge from the distribution of its
  shorter context by more than a description-length penalty; its suffixes stay with it;
* distributions are smoothed from the shorter context (weight: number of distinct
  followers), down to an additive one over all 256 bytes, so nothing has probability 0;
* a position is scored by the longest retained suffix of what stands before it. With all
  prefixes of contexts added as states this is an automaton, run over many stretches of
  text at once;
* ``tree_score`` is the tree's log10 probability of the whole stream, the sum over all its
  bytes: every word, known or not, is spelled where it stands. It is the score of the query;
* with e, the share of training tokens seen once, as the estimate of unseen ones,
  ``spelled_score`` gives a token (1 - e) times its share of the training tokens plus e
  times its spelling by the tree: a distribution over all words, unseen ones spelled;
* ``score`` has the events of the base score, the training words and one unknown token:
  the unknown token has e, a known one (1 - e) times the probability above. The tree hardly
  enters it, so the query returns it as ``event_score`` beside the tree's own.

The base score is a unigram model of whole words. Its counts stay in Spark: words with at
least ``COMMON_SHARE`` of the tokens (at most 1 / COMMON_SHARE words) are broadcast, the
others meet their counts in a join. Words are compared by 64-bit hashes.

Defined cases: a null text counts as empty and consists of the end mark; rows repeated or
with equal or null ids are scored each on their own; a null id counts as training; an
empty training set leaves the uniform distribution and N = V = 0, base terms then being
log10(0.5 / 0.5); a very long text is one row like any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm import sketches
from threadloom.llm.rows import slices, text_of
from threadloom.session import write_scratch

DEPTH = 5
LEAST_SHARE = 2e-5
COMMON_SHARE = 1e-6
GROUP_BYTES = 4 << 20
COLUMNS = 4096
MOST_KEYS = 4_000_000
END = 10  # the end mark and, before a text, the padding of its first contexts
END_TOKEN = 0x656E64  # stands among the word hashes for the end mark
GRAM, WORD = 0, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _stream(words: bytes) -> bytes:
    return bytes([END]) * DEPTH + words + bytes([END])


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(keys, return_counts=True)
    found, of = np.unique(keys, return_inverse=True)
    return found, np.bincount(of, weights, len(found)).astype(np.int64)


def count_symbols(training: DataFrame) -> DataFrame:
    """kind, key, n: the (context, next byte) grams and the word hashes of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        randoms = sketches.Randoms()
        parts: dict[int, list] = {GRAM: [], WORD: []}
        ends = 0

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            return _counted(np.concatenate([k for k, _ in parts[kind]]), np.concatenate([n for _, n in parts[kind]]))

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)],
                names=["kind", "key", "n"])

        for batch in slices(batches):
            for group in _groups(batch.column(0).to_pylist()):
                streams = [_stream(w) for w, _ in group]
                codes = np.frombuffer(b"".join(streams), dtype=np.uint8)
                keys = np.zeros(len(codes) - DEPTH, dtype=np.uint64)
                for i in range(DEPTH + 1):
                    keys = keys << np.uint64(8) | codes[i:len(codes) - DEPTH + i]
                parts[GRAM].append(_counted(keys[_scored(streams)[DEPTH:]]))
                parts[WORD].append(_counted(sketches.word_hashes(b"".join(w for w, _ in group), randoms)))
                ends += len(group)
                for kind in parts:
                    if len(parts[kind]) > 8 or sum(len(k) for k, _ in parts[kind]) > MOST_KEYS:
                        parts[kind] = [merged(kind)]
                        if len(parts[kind][0][0]) > MOST_KEYS:
                            yield rows(kind, *parts[kind].pop())
        if ends:
            parts[WORD].append((np.array([END_TOKEN], dtype=np.uint64), np.array([ends])))
        for kind in parts:
            if parts[kind]:
                yield rows(kind, *merged(kind))

    return training.select(text_of().alias("body")).mapInArrow(run, "kind int, key long, n long") \
        .groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _groups(texts: list[str]) -> Iterator[list[tuple[bytes, int]]]:
    """Lower-cased words of texts with their number, in groups of about GROUP_BYTES."""
    group, size = [], 0
    for text in texts:
        group.append(sketches.spaced(text, lower=True))
        size += len(group[-1][0]) + DEPTH + 1
        if size > GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _scored(streams: list[bytes]) -> np.ndarray:
    """Which positions of joined streams are symbols rather than padding."""
    sizes = np.array([len(s) for s in streams])
    starts = np.cumsum(sizes) - sizes
    marks = np.ones(int(sizes.sum()), dtype=bool)
    for i in range(DEPTH):
        marks[starts + i] = False
    return marks


@dataclass
class Tree:
    """The automaton: next state and log10 probability for every state and class of bytes."""

    classes: np.ndarray
    step: np.ndarray
    score: np.ndarray
    n_retained: int


def fit_tree(counts: DataFrame, least_share: float = LEAST_SHARE) -> Tree:
    """Retain contexts and smooth their distributions. Only frequent contexts reach the driver."""
    grams = counts.where(F.col("kind") == GRAM)
    total = grams.agg(F.sum("n")).first()[0] or 0
    depths = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit((1 << 8 * (d + 1)) - 1).alias("mask"))
                                 for d in range(DEPTH + 1)]))
    cut = grams.select(depths.alias("at"), "key", "n").groupBy(
        F.col("at.d").alias("d"), F.col("key").bitwiseAND(F.col("at.mask")).alias("gram")).agg(F.sum("n").alias("n"))
    cut = write_scratch(cut.withColumn("context", F.shiftrightunsigned("gram", 8)), "grams")
    frequent = cut.groupBy("d", "context").agg(F.sum("n").alias("total")).where(F.col("total") >= least_share * total)
    rows = cut.join(frequent.select("d", "context"), ["d", "context"], "left_semi").select("d", "gram", "n").toArrow()
    depth, gram, n = (rows.column(c).to_numpy() for c in ("d", "gram", "n"))
    return _tree(depth, gram.astype(np.int64), n.astype(np.float64), total)


def _tree(depth: np.ndarray, gram: np.ndarray, n: np.ndarray, total: int) -> Tree:
    used = np.unique(gram & 255)
    classes = np.full(256, len(used), dtype=np.int32)
    classes[used] = np.arange(len(used))
    width = len(used) + 1
    # Contexts in order of depth; a context is known by (depth, bytes).
    names: list[tuple[int, int]] = []
    rows: list[np.ndarray] = []
    index: dict[tuple[int, int], int] = {}
    order = np.lexsort((gram, depth))
    depth, gram, n = depth[order], gram[order], n[order]
    context = gram >> 8
    cuts = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (context[1:] != context[:-1])])) \
        if len(gram) else np.empty(0, dtype=np.int64)
    keep: list[bool] = []
    parents: list[int] = []
    root = np.full(width, 0.5)
    for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(gram)]):
        d, bytes_ = int(depth[at]), int(context[at])
        followers, times = classes[gram[at:end] & 255], n[at:end]
        if d == 0:
            root[followers] += times
            row, parent, retained = root / (total + 128), -1, True
        else:
            parent = index[d - 1, bytes_ & (1 << 8 * (d - 1)) - 1]
            shorter, whole, kinds = rows[parent], times.sum(), len(times)
            gain = float((times * np.log(times / whole / shorter[followers])).sum())
            retained = gain > 0.5 * kinds * np.log(total)
            row = shorter * (kinds / (whole + kinds))
            row[followers] += times / (whole + kinds)
        index[d, bytes_] = len(names)
        names.append((d, bytes_))
        rows.append(row)
        keep.append(retained)
        parents.append(parent)
    if not names:
        names, rows, keep, parents, index = [(0, 0)], [np.full(width, 1 / 256)], [True], [-1], {(0, 0): 0}
    rows[0][width - 1] = 0.5 / (total + 128) if total else 1 / 256
    for i in range(len(names) - 1, 0, -1):
        if keep[i]:
            keep[parents[i]] = True
    # States: retained contexts and all their substrings; the latter score by their retained suffix.
    states = {i for i, k in enumerate(keep) if k}
    todo = list(states)
    while todo:
        d, bytes_ = names[i := todo.pop()]
        for other in ([parents[i], index[d - 1, bytes_ >> 8]] if d else []):
            if other not in states:
                states.add(other)
                todo.append(other)
    state_of = {c: s for s, c in enumerate(sorted(states))}
    step = np.zeros((len(state_of), width), dtype=np.int32)
    score = np.empty((len(state_of), width), dtype=np.float32)
    for c, s in state_of.items():
        d, bytes_ = names[c]
        if d:
            step[s] = step[state_of[parents[c]]]
        from_ = c
        while not keep[from_]:
            from_ = parents[from_]
        score[s] = np.log10(rows[from_])
    for c, s in state_of.items():  # the context that ends with byte x is reached by x from its prefix
        d, bytes_ = names[c]
        if d:
            step[state_of[index[d - 1, bytes_ >> 8]], classes[bytes_ & 255]] = s
    _inherit(step, names, state_of, parents)
    return Tree(classes, step, score, sum(keep))


def _inherit(step: np.ndarray, names: list[tuple[int, int]], state_of: dict[int, int], parents: list[int]) -> None:
    """Where a state has no longer context of its own, it goes where its suffix goes (depth by depth)."""
    for c, s in state_of.items():
        if names[c][0]:
            above = step[state_of[parents[c]]]
            step[s] = np.where(_deeper(step[s], above, names, state_of), step[s], above)


def _deeper(own: np.ndarray, above: np.ndarray, names: list[tuple[int, int]], state_of: dict[int, int]) -> np.ndarray:
    return own > above  # states are numbered by depth: the greater is the longer context


def run_tree(tree: Tree, streams: list[bytes]) -> np.ndarray:
    """log10 probability of every byte of joined streams (padding: 0), by stretches of all at once."""
    codes = tree.classes[np.frombuffer(b"".join(streams), dtype=np.uint8)]
    width = tree.step.shape[1]
    step, score = (tree.step * width).ravel(), tree.score.ravel()
    columns = min(COLUMNS, max(1, len(codes) // 64))
    length = -(-len(codes) // columns)
    padded = np.zeros(DEPTH + columns * length, dtype=np.int32)
    padded[DEPTH:DEPTH + len(codes)] = codes
    at = np.arange(columns) * length
    state = np.zeros(columns, dtype=np.int32)
    logs = np.empty((length, columns), dtype=np.float32)
    for i in range(length + DEPTH):
        cell = state + padded[at + i]
        if i >= DEPTH:
            np.take(score, cell, out=logs[i - DEPTH])
        state = step[cell]
    logs = logs.T.ravel()[:len(codes)].astype(np.float64)
    logs[~_scored(streams)] = 0
    return logs


def token_scores(tree: Tree, group: list[tuple[bytes, int]]) -> np.ndarray:
    """log10 probability of every token by the tree: all words in order, then the ends of the texts."""
    streams = [_stream(w) for w, _ in group]
    logs = run_tree(tree, streams)
    codes = np.frombuffer(b"".join(streams), dtype=np.uint8)
    sizes = np.array([len(s) for s in streams])
    ends = np.cumsum(sizes) - 1
    stops = np.union1d(np.flatnonzero(codes == 32), ends)
    sums = np.add.reduceat(logs, np.concatenate([[0], stops[:-1] + 1]))
    last = np.isin(stops, ends)
    return np.concatenate([sums[~last], sums[last]])


def score(docs: DataFrame, counts: DataFrame, tree: Tree, common_share: float = COMMON_SHARE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, tree_score, score, spelled_score of every row of ``docs``."""
    spark = docs.sparkSession
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    size = words.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1)).first()
    tokens, kinds, once = size[0] or 0, size[1], size[2]
    scale = tokens + 0.5 * (kinds + 1)
    escape = (once + 1) / (tokens + 2)  # the share of tokens seen once estimates that of unseen ones
    common = words.where(F.col("n") >= common_share * tokens).toArrow()  # at most 1 / common_share rows
    keys = common.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((tree.classes, tree.step, tree.score, keys[order],
                                           common.column("n").to_numpy()[order]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc = f"struct<doc_id:{kind},n_tokens:bigint,n_known:bigint,base:double,spelled:double,tree:double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        randoms = sketches.Randoms()
        classes, step, logs, keys, times = shared.value
        tree = Tree(classes, step, logs, 0)
        end_token = np.array([END_TOKEN], dtype=np.uint64)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            first = 0
            for group in _groups(batch.column(1).to_pylist()):
                ids = batch.column(0).slice(first, len(group))
                first += len(group)
                counts = np.array([n for _, n in group])
                hashes = sketches.word_hashes(b"".join(w for w, _ in group), randoms)
                owner = np.concatenate([np.repeat(np.arange(len(group)), counts), np.arange(len(group))])
                hashes = np.concatenate([hashes, np.repeat(end_token, len(group))])
                spelled = token_scores(tree, group)
                place = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                hit = keys[place] == hashes if len(keys) else np.zeros(len(hashes), dtype=bool)
                seen = times[place[hit]]
                base = np.bincount(owner[hit], np.log10((seen + 0.5) / scale), len(group))
                known = np.bincount(owner[hit], minlength=len(group))
                mixed = np.log10((1 - escape) * seen / max(tokens, 1) + escape * 10 ** spelled[hit])
                details = pa.StructArray.from_arrays(
                    [ids, pa.array(counts + 1), pa.array(known), pa.array(base),
                     pa.array(np.bincount(owner[hit], mixed, len(group))), pa.array(np.bincount(owner, spelled, len(group)))],
                    names=["doc_id", "n_tokens", "n_known", "base", "spelled", "tree"])
                rows = row + np.arange(len(group))
                row += len(group)
                names = ["row", "key", "is_word", "spelled", "doc"]
                # Rows of documents go anywhere; rows of rarer words go to their counts.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(sketches.mix(rows.astype(np.uint64)).view(np.int64)),
                     pa.array(np.zeros(len(rows), dtype=bool)), pa.nulls(len(rows), pa.float32()), details], names=names)
                rare = ~hit
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[owner[rare]]), pa.array(hashes[rare].view(np.int64)),
                     pa.array(np.ones(int(rare.sum()), dtype=bool)), pa.array(spelled[rare].astype(np.float32)),
                     pa.nulls(int(rare.sum()), details.type)], names=names)

    parts = docs.select("doc_id", text_of().alias("body")).mapInArrow(
        run, f"row long, key long, is_word boolean, spelled float, doc {doc}")
    rarer = words.where(F.col("n") < common_share * tokens).withColumn("is_word", F.lit(True))
    met = parts.join(rarer, ["key", "is_word"], "left")
    base = F.log10((F.col("n") + 0.5) / F.lit(float(scale)))
    # log10 of (1 - escape) n / tokens + escape 10^spelled; the spelling alone for a word never seen.
    spelled = F.col("spelled").cast("double") + F.lit(float(np.log10(escape)))
    mixed = F.log10(F.col("n") * F.lit((1 - escape) / max(tokens, 1)) + F.pow(F.lit(10.0), spelled))
    unseen = F.sum(F.when(F.col("n").isNull(), spelled))
    nothing = F.lit(0.0)
    summed = met.groupBy("row").agg(
        F.max("doc.doc_id").alias("doc_id"), F.max("doc.n_tokens").alias("n_tokens"),
        (F.max("doc.n_known") + F.count("n")).alias("n_known"),
        F.max("doc.tree").alias("tree_score"),
        (F.max("doc.base") + F.coalesce(F.sum(base), nothing)).alias("base"),
        (F.max("doc.spelled") + F.coalesce(F.sum(mixed), nothing)).alias("known"), F.coalesce(unseen, nothing).alias("unseen"))
    n_unknown = F.col("n_tokens") - F.col("n_known")
    log = lambda p: F.lit(float(np.log10(p)))
    return summed.select(
        "doc_id", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + log(0.5 / scale) * n_unknown).alias("base_score"), "tree_score",
        (F.col("known") + log(1 - escape) * F.col("n_known") + log(escape) * n_unknown).alias("score"),
        (F.col("known") + F.col("unseen")).alias("spelled_score"))


def scores(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """Train on the documents that are not held out and score all."""
    counts = write_scratch(count_symbols(docs.where(~held_out(F.col("doc_id")))), "symbols")
    scored = score(docs, counts, fit_tree(counts, least_share))
    return scored.withColumn("held_out", held_out(F.col("doc_id")))
