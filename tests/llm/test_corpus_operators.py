"""Suffix tree, near duplicates, chats, mixing and the pipeline against plain Python or SQL."""

import collections
import math
import random
import re
import uuid
import zlib

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import alignment, chats, mixing, near_dup, queries, suffix_tree

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER)) + [None]


class PlainTree:
    """The suffix tree by its definition: dictionaries and a walk per byte."""

    def __init__(self, texts, least_share):
        depth = suffix_tree.DEPTH
        self.follow = collections.defaultdict(collections.Counter)
        for text in texts:
            stream = suffix_tree._stream(b"".join(t.encode() + b" " for t in tokens_of(text)[:-1]))
            for i in range(depth, len(stream)):
                for d in range(depth + 1):
                    self.follow[stream[i - d:i]][stream[i]] += 1
        total = sum(self.follow[b""].values())
        self.kept = {}
        self.p = {}
        frequent = sorted((c for c, n in self.follow.items() if sum(n.values()) >= least_share * total), key=len)
        for c in frequent:
            n = self.follow[c]
            whole = sum(n.values())
            if not c:
                self.p[c] = {a: (n[a] + 0.5) / (total + 128) for a in range(256)}
                self.kept[c] = True
                continue
            up = self.p[c[1:]]
            gain = sum(k * math.log(k / whole / up[a]) for a, k in n.items())
            self.kept[c] = gain > 0.5 * len(n) * math.log(total)
            self.p[c] = {a: (n[a] + len(n) * up[a]) / (whole + len(n)) for a in range(256)}
        for c in reversed(frequent):
            if self.kept[c] and c:
                self.kept[c[1:]] = True

    def words(self, text):
        """log10 of the spelling of each token."""
        stream = suffix_tree._stream(b"".join(t.encode() + b" " for t in tokens_of(text)[:-1]))
        out, now = [], 0.0
        for i in range(suffix_tree.DEPTH, len(stream)):
            d = max(d for d in range(suffix_tree.DEPTH + 1) if self.kept.get(stream[i - d:i]))
            now += math.log10(self.p[stream[i - d:i]][stream[i]])
            if stream[i] == 32 or i + 1 == len(stream):
                out.append(now)
                now = 0.0
        return out


@pytest.mark.parametrize("share", [2e-5, 2e-3])
def test_scores_by_definition(documents, texts, share):
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    training = [t for i, t in texts.items() if i not in held]
    counts = collections.Counter(w for t in training for w in tokens_of(t))
    total, kinds = sum(counts.values()), len(counts)
    escape = (sum(n == 1 for n in counts.values()) + 1) / (total + 2)
    tree = PlainTree(training, share)
    rows = suffix_tree.scores(documents, least_share=share).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        words = tokens_of(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in held, len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    for r in rows[:60]:
        words = tokens_of(texts[r.doc_id])
        spelled = tree.words(texts[r.doc_id])
        each = [(1 - escape) * counts[w] / total + escape * 10 ** s for w, s in zip(words, spelled)]
        assert r.spelled_score == pytest.approx(sum(map(math.log10, each)), rel=1e-5)
        want = sum(math.log10((1 - escape) * p if counts[w] else escape) for w, p in zip(words, each))
        assert r.score == pytest.approx(want, rel=1e-5)
    if share == suffix_tree.LEAST_SHARE:  # better than the base on texts that were not seen
        unseen = [r for r in rows if r.held_out]
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_the_score_of_the_query_is_the_trees(spark, tmp_path):
    """Every byte is scored by the tree, so gibberish ranks below text and the order of the words counts."""
    rng = random.Random(3)
    lines = ["the old river runs past a quiet mill", "we walk down to the river at dawn", "a mill turns while the river runs"]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(8))) for i in range(60)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    clean = " ".join(lines)
    backwards = " ".join(reversed(clean.split()))
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(4)) for _ in clean.split())
    rows += list(zip(held, [clean, backwards, junk, None]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_lm_scores(spark, str(tmp_path)).collect()}
    tree = PlainTree([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], suffix_tree.LEAST_SHARE)
    for i, text in rows[:5] + rows[60:]:
        assert got[i].score == pytest.approx(sum(tree.words(text or "")), rel=1e-5)
    assert got[held[0]].held_out and got[held[2]].score < got[held[1]].score < got[held[0]].score


def test_tree_rows_are_distributions(documents):
    counts = suffix_tree.count_symbols(documents)
    tree = suffix_tree.fit_tree(counts)
    p = 10 ** tree.score.astype(float)
    unseen = 256 - len(np.unique(tree.classes[tree.classes < p.shape[1] - 1]))
    assert np.allclose(p[:, :-1].sum(axis=1) + unseen * p[:, -1], 1, atol=1e-4)
    assert 1 < tree.n_retained <= len(tree.score) <= suffix_tree.DEPTH / suffix_tree.LEAST_SHARE


def test_the_fit_holds_few_cells_at_a_time():
    """The driver fits the classifier: its memory stays below an array of cells times domains, the weights as they were."""
    import tracemalloc
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 900, 2000)
    rows, domains = np.repeat(np.arange(len(sizes)), sizes), 4
    cells, target = rng.integers(0, 5000, len(rows)), rng.integers(0, domains, len(sizes))
    tracemalloc.start()
    got = mixing.fit_softmax(rows, cells, target, domains, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(rows) * domains
    # After one round every weight has moved by the rate against the sign of its gradient.
    error = (np.full((len(sizes), domains), 1 / domains) - np.eye(domains)[target]) / len(sizes)
    for k in range(domains):
        grad = np.bincount(cells, error[rows, k], 5000)
        clear = np.abs(grad) > 1e-6
        assert np.allclose(got[:5000, k][clear], -0.05 * np.sign(grad[clear]), rtol=1e-2)


def plain_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_banded_alignment():
    rng = random.Random(8)
    for _ in range(1500):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 22))]
        b = [x for x in a if rng.random() > 0.2]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 4))
        most = rng.randint(0, 12)
        got = alignment.edit_distance(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), most)
        assert got == min(most + 1, plain_distance(a, b))


def test_near_duplicates_by_all_pairs(documents, texts):
    group = {r.doc_id: r.class_id for r in near_dup.near_duplicates(documents).collect()}
    ids, codes = list(texts), {}
    words = [np.array([codes.setdefault(w, len(codes)) for w in texts[i].split()], dtype=np.int64) for i in ids]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if texts[ids[a]] == texts[ids[b]] or len(words[a]) and len(words[b]) and alignment.similarity(words[a], words[b], 0.8):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: min(ids[k] for k in range(len(ids)) if find(k) == find(n)) for n, i in enumerate(ids)}
    assert group == want


def test_copies_in_large_groups(spark):
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(60))
    source = [f"s{i}" for i in range(200)]
    rows = ["exact copy of one text, word for word."] * 300
    for k in range(200):
        near = list(source)
        for _ in range(6):
            near[rng.randrange(200)] = f"e{k}x{rng.random()}"
        rows.append(" ".join(near))
    rows += [" ".join(f"u{k}x{i}" for i in range(100)) + " " + common for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    group = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert {group[i] for i in range(300)} == {0} and {group[i] for i in range(300, 500)} == {300}
    assert all(group[i] == i for i in range(500, 700))


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def jobs_of(spark, work):
    """What ``work`` gives, and the number of jobs that the driver ran for it."""
    group = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


def test_components_take_few_jobs(spark):
    """Links that are stars need no round; others a plan without repeated scans: the driver pays for every job."""
    apart = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(50)] + [(200, 200 + i) for i in range(1, 30)], "u long, v long")
    got, jobs = jobs_of(spark, lambda: near_dup.components(apart).collect())
    assert {r.node: r.root for r in got} == {2 * i + 1: 2 * i for i in range(50)} | {200 + i: 200 for i in range(1, 30)}
    assert jobs <= 8
    path = spark.createDataFrame([(i, i + 1) for i in range(8)], "u long, v long")
    got, jobs = jobs_of(spark, lambda: near_dup.components(path).collect())
    assert {r.node: r.root for r in got} == {i: 0 for i in range(1, 9)}
    assert jobs <= 34


def test_chats_against_sql(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for conv in range(60):
        turns = [(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(rng.randint(1, 5))]
        rows += [(conv, i, *t) for i, t in enumerate(turns)]
    long = [(100, i, "user", str(i)) for i in range(400)] + [(101, i, "user", str(i)) for i in range(399)]
    spark.createDataFrame(rows + long, "conv_id long, turn long, role string, text string").coalesce(1) \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    turns = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    out = chats.chat_turns(turns)
    assert compare.differences(out, con, queries.oracle_sql()["op7_chat_formatting"]) is None
    assert out.where("conv_id = 101").count() == 0 and out.where("conv_id = 100").count() == 400


def test_rates_meet_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    targets = {"quality=1,toxic=0": 0.7, "quality=0,toxic=0": 0.2, "quality=1,toxic=1": 0.1, "quality=0,toxic=1": 0.0}
    model, members = mixing.fitted(docs, labels.where(F.pmod("doc_id", F.lit(3)) > 0), targets)
    rows = members.collect()
    p, n = np.array([r.p for r in rows]), np.array([r.n_tokens for r in rows])
    rate = np.ones(len(rows))
    for y in model.steps:
        rate = np.maximum(0, rate - p @ np.array(y))
    share = (rate * n) @ p / n.sum()
    assert np.abs(share - [targets[d] for d in model.domains]).max() < 0.005 and rate.min() >= 0
    # Held-out accuracy of the classifier.
    truth = {r.doc_id: f"quality={r.quality},toxic={r.toxic}" for r in labels.where(F.pmod("doc_id", F.lit(3)) == 0).collect()}
    likeliest = {r.doc_id: model.domains[int(np.argmax(r.p))] for r in rows}
    assert np.mean([likeliest[i] == d for i, d in truth.items()]) > 0.85


def plain_rates(p, n, wanted, steps=20_000):
    """Nonnegative rates nearest to 1 in no particular metric: plain projected gradient descent, many small steps."""
    rate, total = np.ones(len(p)), n.sum()
    size = 0.5 / np.linalg.norm((p * (n / total)[:, None]).T @ p, 2)
    for _ in range(steps):
        rate = np.maximum(0, rate - size * p @ ((rate * n) @ p / total - wanted))
    return rate


@pytest.mark.parametrize("wanted", [[0.6, 0.3, 0.1], [0.05, 0.05, 0.9], [1.0, 0.0, 0.0]])
def test_rates_against_an_independent_solver(spark, wanted):
    """Posteriors that overlap, so that rates are clipped and some targets cannot be met."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.2], 80)
    n = rng.integers(1, 50, 80)
    members = spark.createDataFrame([(i, int(k), [float(x) for x in row]) for i, (k, row) in enumerate(zip(n, p))],
                                    "doc_id long, n_tokens long, p array<double>")
    model = mixing.Mixture(["a", "b", "c"], np.zeros((1, 3)))
    error = mixing.fit_rates(members, model, dict(zip("abc", wanted)), most_steps=400)
    rates = members.withColumn("rate", mixing.rate_of(F.col("p"), model)).orderBy("doc_id").toPandas()["rate"].to_numpy()
    best = plain_rates(p, n, np.array(wanted))
    miss = lambda r: np.linalg.norm((r * n) @ p / n.sum() - wanted)
    met = miss(best) < 1e-3  # the last targets cannot be met: the steps then only come near the least error
    assert rates.min() >= 0 and miss(rates) <= miss(best) + (2e-3 if met else 2e-2) and (model.misfit > 1e-3) == (not met)
    assert model.misfit == pytest.approx(max(map(abs, error))) and np.allclose((rates * n) @ p / n.sum() - wanted, error, atol=1e-9)
    assert rates.min() == 0 or wanted == [0.6, 0.3, 0.1]


def test_repeated_ids_do_not_swell_the_sample(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    once = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.when(F.col("id") % 2 == 0, "bad text").otherwise("fine text")).alias("text"))
    often = once.union(once.where("doc_id = 3").crossJoin(spark.range(500).select(F.lit(1).alias("one"))).drop("one"))
    assert (mixing.classifier(once, labels).weights == mixing.classifier(often, labels).weights).all()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near dedup", "secret scans", "source mixing", "best-fit packing"]
    before = {r.doc_id for r in docs.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= before
    total = collections.Counter()
    for r in rows:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 1024
