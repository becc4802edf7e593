"""Quality rules, secrets, tokens, fingerprints and page text against plain Python."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from threadloom.llm import fingerprints, html_text, lengths, packing, quality, secrets, sketches, tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(tokens.JSON_PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def as_docs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def counts_of(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeated = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated), failed


def test_quality_counts(spark, documents, texts):
    rng = random.Random(4)
    odd = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + "\n" * rng.randint(0, 2) for _ in range(60)]
    odd += ["a b c d e f g h i j\n\x0b \n a b c d e f g h i j", "x\ty\r\nz\x85 w \U0001f600"]
    rows = [*texts.values(), *odd]
    for r in quality.quality_rules(as_docs(spark, rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts_of(rows[r.doc_id])


def test_lines_and_verdicts(spark):
    good = "The council met on Tuesday and agreed on a plan for the river bank, as expected by all of its members."
    cases = {
        good: None,
        "Home | About us | Contact | Shop | Help": "navigation", "Next": "navigation", "Done.": None,
        "buy### now$$$ great*** deal&&& today%%% only###": "punctuation",
        "WOW!! SO!! MUCH!! FUN!! HERE!! TODAY!!": "punctuation",
        "this line of many words goes on and on without any mark that would end it": "punctuation",
        "We use cookies. See our privacy policy.": "boilerplate",
        "go go go go go go go go go.": "boilerplate", "": None, " \t": None,
    }
    docs = as_docs(spark, ["\n".join([good] * 9 + [line]) for line in cases])
    got = [r.lines[-1].reason for r in quality.quality_rules(docs).orderBy("doc_id").collect()]
    assert got == list(cases.values())
    lost = as_docs(spark, [good, good + "\nHome | About | Contact | Shop", good + ("\nHome | About | Contact | Shop" * 4)])
    rows = quality.quality_rules(lost).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, True, False] and rows[1].clean_text == good
    kept = {r.doc_id: r.text for r in quality.kept_documents(lost).collect()}
    assert kept == {0: good, 1: good}


PATTERNS = [("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
             lambda m: len(m.group(2)) >= 6),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24)]


def strong_spans(text):
    found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, rx, ok) in enumerate(PATTERNS)
             for m in re.finditer(rx, text, re.A) if ok(m)]
    return ",".join(x[2] for x in sorted(found))


def test_strong_spans(spark, texts):
    rng = random.Random(5)
    bits = ["token", "secret=", "api_key", ": ", "=", "'", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\U0001f600",
            " ", "\n", "xyz", "PassWord", "deadbeef", "ſecret=", "abcdefg"]
    rows = [*texts.values(), *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400))]
    got = secrets.scan(as_docs(spark, rows)).select("doc_id", secrets.joined("base_spans").alias("s")).collect()
    assert all(r.s == strong_spans(rows[r.doc_id]) for r in got)


def test_linked_parts(spark):
    far = " word" * 60
    rows = ["user=alice pwd=hunter2", "user=alice", "pwd=hunter2", f"user=alice{far} pwd=hunter2",
            "see https://db.example.org/x", 'https://db.example.org/x token = "abcdef123"', "pwd=hunter2 " + "é" * 190 + " host=db.local",
            "user=bob" + " user=bob" * 300 + " pwd=hunter2"]
    got = {r.doc_id: r.s for r in secrets.scan(as_docs(spark, rows)).select(
        "doc_id", secrets.joined("spans").alias("s")).collect()}
    assert got[0] == "link_id:0:10,link_secret:11:22" and got[1] == got[2] == got[3] == got[4] == ""
    assert got[5] == "link_endpoint:0:24,assign:25:43" and got[6] == "link_secret:0:11,link_endpoint:203:216"
    near = [s for s in got[7].split(",") if s.startswith("link_id")]
    assert len(near) == sum(len(rows[7]) - 11 - (9 * i + 8) <= 200 for i in range(301))
    masked = {r.doc_id: r.text for r in secrets.redacted(as_docs(spark, rows)).collect()}
    assert masked[0] == "[SECRET] [SECRET]" and masked[5] == '[SECRET] [SECRET]"' and masked[1] == rows[1]


def test_token_ids(ids):
    encode = tokens.encoder()
    rng = random.Random(6)
    cases = ["", "a <|endoftext|> b", " " * 3000 + "x", "\n\n\r\n\t", "don't we're", "ſ K Å   \U0001f600 1²½"]
    cases += ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0xD7FF), rng.randint(0x10000, 0x1FFFF)]))
                      for _ in range(50)) for _ in range(300)]
    for text in cases:
        assert encode(text).tolist() == ids(text)
    assert len(encode(" " * 1_500_000)) == len(ids(" " * 1_500_000))


def test_length_totals(spark, documents, texts, ids):
    sizes = [len(ids(t)) for t in texts.values()]
    totals = lengths.totals_by_limit(lengths.length_histogram(documents))
    rows = totals.collect()
    assert sorted(r.length for r in rows) == sorted(set(sizes))
    for r in rows:
        assert (r.n_docs, r.docs_within, r.docs_cut) == (sizes.count(r.length), sum(s <= r.length for s in sizes),
                                                         sum(s > r.length for s in sizes))
        assert r.tokens_truncated == sum(min(s, r.length) for s in sizes)
        assert r.tokens_lost == sum(sizes) - r.tokens_truncated and r.tokens_within == sum(s for s in sizes if s <= r.length)
    got = {r.quantile: r.length for r in lengths.quantile_lengths(totals, [0.5, 0.9]).collect()}
    assert got == {q: sorted(sizes)[int(np.ceil(q * len(sizes))) - 1] for q in (0.5, 0.9)}


def test_packed_pieces(documents, texts, ids):
    rows = packing.pack(documents).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, parts in pieces.items():
        whole = np.array(ids(texts[doc_id]) + [2], dtype="<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 1024 for r in parts[1:])
        assert [r.start for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
        assert sum(r.length for r in parts) == len(whole)
        assert all(zlib.crc32(whole[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 1024


def fewest(items, capacity):
    """Least bins by exhaustive search."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                place(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1:])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_plans_are_valid_and_least():
    rng = random.Random(7)
    for _ in range(150):
        items = [rng.randint(1, 20) for _ in range(rng.randint(0, 9))]
        counts = collections.Counter(items)
        plan = packing.plan_sequences(dict(counts), 20)
        placed = collections.Counter()
        for pattern, times in plan:
            assert sum(n * k for n, k in pattern) <= 20
            for n, k in pattern:
                placed[n] += k * times
        assert placed == counts
        assert sum(t for _, t in plan) == fewest(items, 20) >= packing.lower_bound(dict(counts), 20)
    assert packing.cut_points(25, 10) == [0, 5, 15] and packing.cut_points(20, 10) == [0, 10] and packing.cut_points(3, 10) == [0]


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_beats_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(5.6, 0.8, 3000), 1, 1024) if seed < 4 else rng.integers(100, 700, 1500)
    counts = dict(collections.Counter(int(n) for n in sizes))
    number = lambda plan: sum(times for _, times in plan)
    assert packing.lower_bound(counts, 1024) <= number(packing.plan_sequences(counts, 1024)) < number(packing.best_fit(counts, 1024))


def test_fingerprints_of_edits(documents, texts):
    rows = {r.doc_id: r for r in fingerprints.with_edits(documents.repartition(3)).collect()}
    order = sorted(texts, reverse=True)
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(documents).collect()}
    assert set(rows) == set(texts)
    by_text = {}
    for here, after in zip(order, order[1:] + order[:1]):
        text, third = texts[here], len(texts[here]) // 3
        changed = text[:len(text) - third] + texts[after][:third]
        r = rows[here]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == plain[here] == by_text.setdefault(text, r.fingerprint)
        same = lambda a, b: sum(a[i:i + 4] == b[i:i + 4] for i in range(0, 256, 4)) / 64
        assert r.near_edited == same(r.fingerprint, r.edited_fingerprint) and r.near_next == same(r.fingerprint, plain[after])
    long = [r for r in rows.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.15 > 0.02 > np.mean([r.near_next for r in long])


def test_fingerprints_of_repeated_ids(spark):
    """One id, or none, for a third of the rows: every row has its next, and no range holds them all."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i // 6 % 7} with some words") for i in range(300)]
    got = fingerprints.with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((i, len(t)) for i, t in rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    changed = collections.Counter()
    for (_, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        third = len(text) // 3
        changed[hashlib.sha256((text[:len(text) - third] + after[:third]).encode()).hexdigest()] += 1
    assert collections.Counter(r.edited_sha256 for r in got) == changed


def naive_signature(text, function, order, randoms):
    """Order MinHash of one text by its definition, over the same random numbers."""
    words = text.encode().split()
    hashes = [int(sketches.word_hashes(w + b" ", randoms)[0]) for w in words]
    grams, seen = [], collections.Counter()
    for i in range(max(1, len(words) - 4) if words else 0):
        gram = 0
        for k in range(5):
            gram += (hashes[i + k] if i + k < len(words) else k + 1) * int(randoms.place[k])
        mix = lambda x: int(sketches.mix(np.array([x % 2 ** 64], dtype=np.uint64))[0])
        gram = mix(gram)
        seen[gram] += 1
        grams.append(gram if seen[gram] == 1 else mix(gram + (seen[gram] - 1) * int(randoms.place[0])))
    if not grams:
        return -1
    ranked = sorted(range(len(grams)), key=lambda i: (grams[i] ^ int(randoms.seeds[function])) * int(randoms.factors[function]) % 2 ** 64)
    chosen = sorted(ranked[:order]) if len(grams) >= order else sorted(ranked * order)[:order]
    signature = 0
    for i in chosen:
        signature = mix(signature * int(randoms.place[1]) + grams[i])
    return int(np.uint64(signature).view(np.int64))


def test_order_min_hash():
    randoms = sketches.Randoms()
    texts = ["", "one", "a b c d e", "a b c d e f", "x y x y x y x y x y x y", "the cat sat on the mat and the cat sat on the hat",
             " ".join(str(i * i % 97) for i in range(300))]
    got, words = sketches.signatures(texts, 6, 2, randoms, most=40)
    assert words.tolist() == [len(t.split()) for t in texts]
    for i, text in enumerate(texts):
        for f in range(6):
            assert got[i, f] == naive_signature(text, f, 2, randoms)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", sources[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_page_furniture():
    body = "".join(f"<p>This is sentence {i}, with some <b>bold</b> words, and it ends here.</p>" for i in range(6))
    page = f"""<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id="menu"><a href="/">Home</a></div>
    <div class="content"><h2>Title &mdash; here</h2>{body}<p>Short.</p><ul><li>One point.</li><li>Two points.</li></ul>
    <script>if (a < b) {{ x = "</p>"; }}</script><form><p>Your name please, thank you.</p></form></div>
    <div class="sidebar"><p>Another story, which is long enough, to look like text, indeed.</p></div>
    <div class="comments"><p>A comment by a reader, who writes a lot, and says much.</p></div>
    <div class="cookie-notice">We use cookies, as everybody does, on this page.</div><footer>&copy; us</footer></body></html>"""
    text = html_text.main_text(page)
    assert text.startswith("Title — here This is sentence 0, with some bold words,")
    assert text.endswith("and it ends here. Short. One point. Two points.")
    for hostile in ("<" * 50_000, "<a" * 50_000, "<!--" * 50_000, "<div>" * 50_000 + "deep.", "<p class='" * 20_000):
        html_text.main_text(hostile)
