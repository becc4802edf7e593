"""Mixing domains to target weights by soft membership.

A softmax classifier, fitted on labelled documents, gives every document a posterior over
the domains (one for each pair of quality and toxic label). Nonnegative rates, one per
document, are then fitted so that the expected token total of every domain,
sum of rate x tokens x posterior, meets its target in least squares.

The fit is projected gradient descent from rate 1 in the metric of the domains'
second moments M = sum n p p' over the rates that are not clipped: each step is
y = M^-1 (totals - targets), then rate <- max(0, rate - p.y), and half of it if that came no
nearer. The step is the exact one as long as no other rate is clipped. A rate
depends on the document's posterior and on the few vectors y alone, so an iteration is one
aggregation of narrow rows, nothing is kept per document between iterations, and rates
are applied to the texts without a join.

``SAMPLE`` bounds the labelled rows that the classifier is fitted on, drawn by a hash of
the id, one text for each id (the least); posteriors, totals and rates cover all documents.
``misfit`` is the largest share of the tokens by which a domain misses its target after the
last step: targets that no nonnegative rates can meet leave it above ``tolerance``.

Defined cases: null and empty texts have the prior of their few features and no tokens;
rows with null labels are not used; labels of unknown ids do nothing; documents repeated
or with equal ids are rated each on their own; without labels there is one domain and all
rates are the same; a target for a domain that no label has counts as absent, and the
remaining targets are scaled to sum to 1; an empty table gives an empty result; a very long
text is one row like any other; other columns are ignored, and ``mixed`` returns them under
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from threadloom.llm import sketches
from threadloom.llm.rows import quoted, slices, text_of
from threadloom.session import write_scratch

SAMPLE = 8000
BUCKETS = 1 << 18
#: Share of the tokens that each domain, named by its labels, should have.
TARGETS = {"quality=1,toxic=0": 0.985, "quality=0,toxic=0": 0.005, "quality=1,toxic=1": 0.005, "quality=0,toxic=1": 0.005}
GROUP_BYTES = 2 << 20
FIT_CELLS = 1 << 18


@dataclass
class Mixture:
    """Classifier weights [buckets + 1, domains] and the steps that give the rates."""

    domains: list[str]
    weights: np.ndarray
    steps: list[list[float]] = field(default_factory=list)
    misfit: float = 0.0


def features(texts: list[str | None], randoms: sketches.Randoms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word buckets of each text: bucket numbers, their number per text, words per text.

    A word counts by its lower-cased letters and digits; its shape (upper case, marks
    around it) counts as a feature of its own.
    """
    spaced = [sketches.spaced(t) for t in texts]
    counts = np.array([n for _, n in spaced])
    joined = b"".join(w for w, _ in spaced)
    plain = sketches.word_hashes(joined.translate(_LETTERS), randoms)
    shape = sketches.word_hashes(joined.translate(_SHAPES), randoms)
    owner = np.repeat(np.arange(len(texts)), counts).astype(np.uint64)
    bucket = np.concatenate([plain, shape]) & np.uint64(BUCKETS - 1)
    found = np.unique(np.concatenate([owner, owner]) << np.uint64(32) | bucket)
    return (found & np.uint64(0xFFFFFFFF)).astype(np.int64), \
        np.bincount((found >> np.uint64(32)).astype(np.int64), minlength=len(texts)), counts


def _table(kept: str, mark) -> bytes:
    return bytes(32 if c == 32 else ord(mark(chr(c))) if c < 128 else c if kept == "letters" else ord("x") for c in range(256))


_LETTERS = _table("letters", lambda c: c.lower() if c.isalnum() else ".")
_SHAPES = _table("shape", lambda c: "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > GROUP_BYTES or i + 1 == len(texts):
            yield first, texts[first:i + 1]
            first, size = i + 1, 0


def posteriors(texts: list[str | None], weights: np.ndarray, randoms: sketches.Randoms) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every text and its number of words."""
    out, words = [], []
    for _, group in _groups(texts):
        buckets, sizes, counts = features(group, randoms)
        logits = np.zeros((len(group), weights.shape[1])) + weights[-1]
        if len(buckets):
            starts = np.cumsum(sizes) - sizes
            logits[sizes > 0] += np.add.reduceat(weights[buckets], starts[sizes > 0], axis=0, dtype=np.float64)
        out.append(_softmax(logits))
        words.append(counts)
    if not out:
        return np.empty((0, weights.shape[1])), np.empty(0, dtype=np.int64)
    return np.concatenate(out), np.concatenate(words)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(rows: np.ndarray, buckets: np.ndarray, target: np.ndarray, domains: int, rounds: int = 120,
                rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights by full-batch Adam. ``rows``/``buckets`` are the set cells of a 0/1 matrix, by row.

    Runs in the driver, so the rows are taken some at a time: no array of cells times domains.
    """
    found = np.zeros(BUCKETS, dtype=bool)
    found[buckets] = True
    used = np.flatnonzero(found)
    cell = (np.cumsum(found, dtype=np.int32) - 1)[buckets]
    n = len(target)
    truth = np.eye(domains)[target]
    w = np.zeros((len(used) + 1, domains))
    m, v = np.zeros_like(w), np.zeros_like(w)
    starts = np.searchsorted(rows, np.arange(n + 1))
    filled = np.diff(starts) > 0
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(rows), FIT_CELLS)), n)).tolist()
    error = np.empty((n, domains))
    for t in range(1, rounds + 1):
        grad = np.zeros_like(w)
        for first, last in zip([0, *cuts], cuts):
            mine, here = filled[first:last], cell[starts[first]:starts[last]]
            logits = np.zeros((last - first, domains)) + w[-1]
            if len(here):
                logits[mine] += np.add.reduceat(w[here], starts[first:last][mine] - starts[first], axis=0)
            error[first:last] = (_softmax(logits) - truth[first:last]) / n
            each = np.repeat(np.arange(first, last), np.diff(starts[first:last + 1]))
            for k in range(domains):
                np.add.at(grad[:, k], here, error[each, k])
        grad[-1] = error.sum(axis=0)
        grad[:-1] += decay * w[:-1] / n * len(used) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros((BUCKETS + 1, domains), dtype=np.float32)
    weights[used], weights[-1] = w[:-1], w[-1]
    return weights


def classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Mixture:
    """Fit on at most about ``sample`` labelled documents."""
    domain = F.concat(F.lit("quality="), F.col("quality").cast("string"), F.lit(",toxic="), F.col("toxic").cast("string"))
    named = labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null").distinct()
    total = named.count()
    share = min(1.0, sample / max(total, 1))
    chosen = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # One text for each chosen id, however often the id stands in ``docs``: at most about ``sample`` short rows.
    bodies = docs.select("doc_id", text_of().alias("body")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id") \
        .groupBy("doc_id").agg(F.min("body").alias("body"))
    read = bodies.join(F.broadcast(chosen), "doc_id").select("domain", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        randoms = sketches.Randoms()
        for batch in slices(batches):
            for first, group in _groups(batch.column(1).to_pylist()):
                buckets, sizes, _ = features(group, randoms)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(group)), pa.ListArray.from_arrays(ends, pa.array(buckets.astype(np.int32)))],
                    names=["domain", "buckets"])

    rows = read.mapInArrow(run, "domain string, buckets array<int>").orderBy(F.xxhash64("domain", "buckets")).toArrow()
    names = rows.column("domain").to_pylist()
    domains = sorted(set(names)) or ["all"]
    lists = rows.column("buckets").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False) if len(names) else np.empty(0, dtype=int)
    cells = lists.flatten().to_numpy() if len(names) else np.empty(0, dtype=int)
    # Buckets of a single document say nothing about another one.
    often = (np.bincount(cells, minlength=BUCKETS) >= 3)[cells] if len(cells) else np.empty(0, dtype=bool)
    of = np.repeat(np.arange(len(names), dtype=np.int32), sizes)[often]
    cells = cells[often]
    del rows, lists, often
    target = np.array([domains.index(d) for d in names], dtype=int)
    return Mixture(domains, fit_softmax(of, cells, target, len(domains)))


def memberships(docs: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, n_tokens (words), p (posterior over the domains) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        randoms = sketches.Randoms()
        for batch in slices(batches):
            p, words = posteriors(batch.column(1).to_pylist(), shared.value, randoms)
            cuts = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.ListArray.from_arrays(cuts, pa.array(p.ravel()))],
                names=["doc_id", "n_tokens", "p"])

    return docs.select("doc_id", text_of().alias("body")).mapInArrow(run, f"doc_id {kind}, n_tokens long, p array<double>")


def rate_of(p: Column, model: Mixture) -> Column:
    """The rate of a posterior after all steps so far."""
    if not model.steps:
        return F.lit(1.0)
    domains = range(len(model.domains))
    dot = lambda y: sum((F.get(p, F.lit(k)) * F.get(y, F.lit(k)) for k in domains), F.lit(0.0))
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in y]) for y in model.steps])
    return F.aggregate(steps, F.lit(1.0), lambda r, y: F.greatest(F.lit(0.0), r - dot(y)))


def fit_rates(members: DataFrame, model: Mixture, targets: dict[str, float], most_steps: int = 40,
              tolerance: float = 1e-6) -> list[float]:
    """Add the steps to ``model``; the error that remains in each domain, as a share of all tokens."""
    domains = range(len(model.domains))
    wanted = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    wanted = wanted / wanted.sum() if wanted.sum() else np.full(len(wanted), 1 / len(wanted))
    pairs = [(a, b) for a in domains for b in domains if a <= b]
    p = lambda k: F.get("p", F.lit(k))
    moments = members.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * p(a) * p(b)) for a, b in pairs]).first()
    total = float(moments[0] or 0)
    if not total:
        return [0.0 for _ in domains]
    metric = np.zeros((len(wanted), len(wanted)))
    for (a, b), value in zip(pairs, moments[1:]):
        metric[a, b] = metric[b, a] = value / total
    inverse = np.linalg.pinv(metric, rcond=1e-9)
    held, direction, scale, norm = np.zeros(len(wanted)), None, 1.0, np.inf
    for step in range(most_steps + 1):
        rated = members.select(rate_of(F.col("p"), model).alias("r"), "n_tokens", "p")
        free = F.when(F.col("r") > 0, F.col("n_tokens"))
        sums = rated.agg(*[F.sum(F.col("r") * F.col("n_tokens") * p(k)) for k in domains],
                         *[F.sum(free * p(a) * p(b)) for a, b in pairs]).first()
        error = np.array(sums[:len(wanted)], dtype=float) / total - wanted
        model.misfit = float(np.abs(error).max())
        if model.misfit < tolerance or step == most_steps:
            return error.tolist()
        if direction is not None and np.linalg.norm(error) >= norm and scale > 1 / 32:
            # Too far: half of the last step.
            scale /= 2
            model.steps[-1] = (scale * direction).tolist()
            continue
        held, norm, scale = error, np.linalg.norm(error), 1.0
        if model.steps:  # the metric of the rates that are not clipped
            for (a, b), value in zip(pairs, sums[len(wanted):]):
                metric[a, b] = metric[b, a] = (value or 0.0) / total
            inverse = np.linalg.pinv(metric, rcond=1e-9)
        direction = inverse @ held
        model.steps.append(direction.tolist())


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS,
           sample: int = SAMPLE) -> tuple[Mixture, DataFrame]:
    """The fitted mixture and the memberships it was fitted on."""
    model = classifier(docs, labels, sample)
    members = write_scratch(memberships(docs, model), "memberships")
    fit_rates(members, model, targets)
    return model, members


def copies_of(rate: Column, doc_id: Column) -> Column:
    """Whole copies whose expected number is the rate: rounded up by a hash of the id."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + draw).cast("long")


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS,
                   sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posterior (of that), rate, copies, misfit (of all rates) of every row."""
    model, members = fitted(docs, labels, targets, sample)
    best = F.array_max("p")
    return members.withColumn("rate", rate_of(F.col("p"), model)).select(
        "doc_id", "n_tokens", F.get(F.array(*map(F.lit, model.domains)), F.array_position("p", best).cast("int") - 1).alias("domain"),
        best.alias("posterior"), "rate", copies_of(F.col("rate"), F.col("doc_id")).alias("copies"), F.lit(model.misfit).alias("misfit"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE) -> DataFrame:
    """The documents, each as often as its copies, with the columns of ``docs``.

    The posterior is computed again beside the text: rates need no join.
    """
    model, _ = fitted(docs, labels, targets, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    text_at = docs.columns.index("text")
    p_name = "p" + "_" * max(len(c) for c in docs.columns)  # longer than, so unlike, every name
    schema = StructType([*docs.schema.fields, StructField(p_name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        randoms = sketches.Randoms()
        for batch in slices(batches):
            p, _ = posteriors(batch.column(text_at).to_pylist(), shared.value, randoms)
            cuts = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(p.ravel()))],
                                             names=[*batch.schema.names, p_name])

    rated = docs.mapInArrow(run, schema)
    copies = copies_of(rate_of(F.col(p_name), model), F.col("doc_id"))
    return rated.withColumn(p_name, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(
        *map(quoted, docs.columns))
