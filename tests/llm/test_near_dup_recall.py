"""Near duplicates whose edits are scattered over the text, close to the limit of similarity."""

import random

import numpy as np

from threadloom.llm import near_dup, sketches


def scattered(rng, source, share, name):
    """``source`` with a share of its words replaced by new ones, at places drawn anew."""
    out = list(source)
    for i in rng.sample(range(len(out)), round(share * len(out))):
        out[i] = f"{name}x{i}"
    return out


def test_scattered_edits_are_found(spark):
    rng = random.Random(12)
    rows = []
    for k in range(300):
        source = [f"s{k}x{i}" for i in range(200)]
        rows += [source, scattered(rng, source, 0.2 - 0.1 * (k % 3) / 2, f"e{k}")]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    group = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    found = [group[2 * k + 1] == 2 * k for k in range(300)]
    assert all(group[2 * k] == 2 * k for k in range(300))
    for kind in range(3):  # similarity 0.80, 0.85 and 0.90
        assert sum(found[kind::3]) >= 97


def test_star_of_versions(spark):
    """Versions link to their source only; the source is an arbitrary member of its buckets."""
    rng = random.Random(13)
    source = [f"s{i}" for i in range(200)]
    rows = [scattered(rng, source, 0.12, f"e{k}") for k in range(500)]
    rows.insert(250, source)
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    group = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert sum(group[i] == group[250] for i in range(501)) >= 499


def test_bags_exclude_no_link():
    """A pair at the very limit stays, one far from it goes."""
    rng = random.Random(14)
    randoms = sketches.Randoms()
    source = [f"s{i}" for i in range(200)]
    near = [scattered(rng, source, 0.2, f"e{k}") for k in range(50)]
    far = [[f"f{k}x{i}" for i in range(200)] for k in range(50)]
    bags = [np.frombuffer(b"".join(near_dup.bag(" ".join(t), randoms) for t in group), np.uint8).reshape(-1, near_dup.BINS)
            for group in ([source], near, far)]
    n = np.full(50, 200)
    assert near_dup.room(bags[0], n[:1], bags[1], n, 0.8).sum() == 50 and near_dup.room(bags[0], n[:1], bags[2], n, 0.8).sum() < 25


def passage_rows(spark, n):
    """Rows that the buckets of n unlike texts with a common passage of 60 words make, and the links."""
    passage = [f"p{i}" for i in range(60)]
    rng = random.Random(15)
    texts = []
    for k in range(n):
        own = [f"u{k}x{i}" for i in range(140)]
        at = rng.randrange(141)
        texts.append(" ".join(own[:at] + passage + own[at:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    before = near_dup.write_scratch

    def counted(df, name):
        out = before(df, name)
        seen.append(out.count())
        return out

    near_dup.write_scratch = counted
    try:
        classes = near_dup.near_duplicates(docs).select("class_id").distinct().count()
    finally:
        near_dup.write_scratch = before
    assert classes == n
    return sum(seen)


def test_texts_sharing_a_passage_make_rows_in_proportion(spark):
    few, many = passage_rows(spark, 150), passage_rows(spark, 300)
    assert many < 2.3 * few


def test_cells_compare_every_pair_once(spark, monkeypatch):
    """Blocks far smaller than the buckets: each pair of different groups meets in one cell."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = [(1, i, 0 if i < 10 else i) for i in range(25)] + [(2, i, i % 2) for i in range(9)] + [(3, i, 7) for i in range(5)]
    members = spark.createDataFrame(rows, "key long, id long, root long")
    got = []
    groups = {}
    for r in near_dup.cells(members).collect():
        groups.setdefault((r.key, r.kind, r.x, r.y), []).append(r)
    for (key, kind, x, y), cell in groups.items():
        for a in cell:
            for b in cell:
                apart = a.id < b.id if kind == 1 and x == y else a.left and not b.left
                if apart and a.root != b.root:
                    got.append((key, *sorted((a.id, b.id))))
    want = [(k, i, j) for k, i, a in rows for m, j, b in rows if k == m and i < j and a != b]
    assert sorted(got) == sorted(want)
