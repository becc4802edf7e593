import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from threadloom.operators import ingest, vectors
from threadloom.session import scratch_path
from threadloom.operators import vocabulary
from threadloom.session import dropped_scratch, scratch_root, write_scratch
from threadloom.sources import archives, chat_export, tables
from threadloom.streaming import ingest as streams
from threadloom.streaming.ingest import load_exports, stream_embed, stream_ingest

EXPORT = [
    {"id": "c1", "title": "A \"quoted\" {title", "create_time": 1700000001.25, "mapping": {
        "n0": {"id": "n0", "message": None},
        "n1": {"parent": "n0", "message": {"id": "m1", "author": {"role": "assistant"}, "create_time": 1700000002.5,
                                           "content": {"parts": ["Mail bob@x.com", {"image": 1}, "two"]}, "model": "gpt-4"}},
        "n2": {"parent": "n1", "message": {"role": "user", "timestamp": "2024-01-01T00:00:00Z", "content": " Plain ",
                                           "source": "other", "parent": "own"}},
        "n3": {"message": {"text": "from text", "create_time": "bad"}},
        "n4": {"message": {}},
        "n5": {"message": {"role": "alien", "content": {"x": [1, 2]}}},
        "n6": {"message": {"role": "user", "content": None, "create_time": 0, "source": None}}}},
    {"id": "c2", "title": None, "update_time": 1600000000, "mapping": {"k": {"message": {"role": "user"}}}},
    {"id": "c3", "mapping": {}},
]


def zipped(name="conversations.json", payload=EXPORT):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("readme.txt", "x")
        archive.writestr(name, json.dumps(payload, ensure_ascii=False, indent=1))
    return out.getvalue()


@pytest.fixture
def drop(tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "one export.zip").write_bytes(zipped())
    return folder


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_objects_survive_any_chunking(size):
    text = json.dumps(EXPORT, indent=1) + "\n" + json.dumps({"a": "}{\\\"", "b": [{}]}) + " {}"
    chunks = (text[i:i + size] for i in range(0, len(text), size))
    assert [json.loads(x) for x in archives.json_objects(chunks)] == [*EXPORT, {"a": "}{\\\"", "b": [{}]}, {}]
    with pytest.raises(ValueError):
        list(archives.json_objects(iter(['[{"a": 1}, {"b": '])))


def test_broken_archives_are_reported(spark, drop):
    (drop / "bad.zip").write_bytes(b"garbage")
    (drop / "cut.zip").write_bytes(zipped()[:40])
    (drop / "other.zip").write_bytes(zipped("x.json"))
    (drop / "short.json").write_text(json.dumps(EXPORT)[:-80])
    parsed, rejects = ingest.parse_exports(archives.read_exports(spark, str(drop)))
    reasons = {r.archive.rsplit("/", 1)[1]: r.reason for r in rejects.collect()}
    assert set(reasons) == {"bad.zip", "cut.zip", "other.zip", "short.json"}
    assert "missing" in reasons["other.zip"] and "ZIP" in reasons["bad.zip"]
    assert parsed.where(F.col("archive").endswith("one export.zip")).count() == 3
    listed = {(r.archive.rsplit("/", 1)[1], r.member, r.status) for r in archives.list_archives(spark, str(drop)).collect()}
    assert ("one export.zip", "conversations.json", "ok") in listed
    assert ("bad.zip", None, "not a ZIP archive") in listed


def test_normalisation_rules(spark, drop):
    parsed, _ = ingest.parse_exports(archives.read_exports(spark, str(drop)))
    rows = {r.msg_id: r for r in ingest.normalise_messages(ingest.explode_messages(parsed)).collect()}
    assert set(rows) == {"m1", "n2", "n3", "n5", "n6", "k"}
    m1, n2, n3, n6 = rows["m1"], rows["n2"], rows["n3"], rows["n6"]
    assert (m1.role, m1.text, m1.parent_id) == ("assistant", "Mail «EMAIL»\ntwo", "n0")
    assert m1.meta.asDict() == {"model": "gpt-4", "source": "chatgpt_export"}
    assert str(m1.ts) == "2023-11-14 22:13:22.500000" and len(m1.hash) == 64
    assert (n2.parent_id, n2.text, str(n2.ts), n2.meta.source) == ("own", " Plain ", "2024-01-01 00:00:00", "other")
    assert (n3.text, n3.role, str(n3.ts)) == ("from text", "user", "2023-11-14 22:13:21.250000")
    assert rows["n5"].text == '{"x":[1,2]}' and n6.text == "" and n6.meta.source is None
    assert str(rows["k"].ts) == "2020-09-13 12:26:40"
    import hashlib
    assert n2.hash == hashlib.sha256(b"plain").hexdigest()
    raw = ingest.normalise_messages(ingest.explode_messages(parsed), enable_pii=False).where("msg_id = 'm1'").first()
    assert "bob@x.com" in raw.text and raw.hash == m1.hash
    late = ingest.normalise_messages(ingest.explode_messages(parsed), hash_on="redacted").where("msg_id = 'm1'").first()
    assert late.hash != m1.hash
    titles = {r.conv_id: r.title for r in ingest.project_conversations(parsed).collect()}
    assert titles == {"c1": "A \"quoted\" {title", "c2": "Untitled", "c3": "Untitled"}


def test_import_is_idempotent(spark, drop, tmp_path):
    root = str(tmp_path / "tables")
    tables.ensure_schema(spark, root)
    tables.ensure_schema(spark, root)
    raw = archives.read_exports(spark, str(drop))

    def run():
        return ingest.ingest_export(raw, tables.read_conversations(spark, root), tables.read_table(spark, root, "messages"))

    first = run()
    assert first.summary.first().asDict() == {"imported": 6, "inserted": 5, "conversations": 3}
    assert [r.msg_id for r in first.quarantine.collect()] == ["n5"]
    tables.append_table(first.new_messages, root, "messages")
    again = run()
    assert again.new_messages.collect() == [] and again.summary.first().inserted == 0
    assert {r.conv_id for r in again.conversations.collect()} == {"c1", "c2", "c3"}


def test_streaming_ingest_and_embedding(spark, drop, tmp_path):
    root, offsets = str(tmp_path / "tables"), str(tmp_path / "offsets")

    def run(owner="me"):
        stream_ingest(spark, str(drop), root, offsets, owner).awaitTermination()
        return {(r.conv_id, r.msg_id) for r in tables.read_table(spark, root, "messages").collect()}

    assert len(run()) == 5
    renamed = [{"id": "c1", "title": "Renamed", "mapping": {
        "n9": {"message": {"role": "tool", "content": "new", "create_time": 1}}, "x": EXPORT[0]["mapping"]["n1"]}}]
    (drop / "two.zip").write_bytes(zipped(payload=renamed))
    assert len(run("someone else")) == 6
    stored = tables.read_table(spark, root, "messages")
    assert stored.count() == 6
    c1 = tables.read_conversations(spark, root).where("conv_id = 'c1'").first()
    assert (c1.title, c1.owner_id) == ("Renamed", "me")
    assert tables.read_table(spark, root, "load_rejects").where("msg_id = 'n5'").count() == 1
    for _ in range(2):
        stream_embed(spark, root, scratch_path(spark, "embed"), vectors.hashing_embedder(8), 8, "hash-8", delay=0).awaitTermination()
    made = tables.read_table(spark, root, "message_embeddings").collect()
    assert len(made) == 6 and all(len(r.embedding) == 8 and r.model == "hash-8" for r in made)


def test_many_conversations_in_one_archive(spark, tmp_path):
    pick = random.Random(1)
    export = [{"id": f"c{i}", "mapping": {str(j): {"message": {"content": "é{}\"\\" * pick.randrange(50), "create_time": 5}}
                                          for j in range(4)}} for i in range(700)]
    (tmp_path / "big.zip").write_bytes(zipped(payload=export))
    raw = archives.read_exports(spark, str(tmp_path))
    assert "REPARTITION_BY_COL" in raw._jdf.queryExecution().toString()
    parsed, rejects = ingest.parse_exports(raw)
    assert ingest.explode_messages(parsed).count() == 2800 and rejects.count() == 0


def test_a_replayed_load_keeps_rejects_once(spark, tmp_path):
    raw = spark.createDataFrame(
        [("z", 0, None, "not a ZIP archive"), ("z", 1, '{"title": "no id"}', None)],
        "archive string, ordinal long, conversation string, error string") \
        .withColumn("modified", F.lit("2024-06-01").cast("timestamp"))
    root = str(tmp_path / "tables")
    tables.ensure_schema(spark, root)
    for _ in range(2):
        load_exports(raw, root)
    assert tables.read_table(spark, root, "load_rejects").count() == 2


# ---------------------------------------------------------------- the data source

def by_name(rows):
    return sorted((r.archive.rsplit("/", 1)[1], r.ordinal, r.conversation, r.error) for r in rows.collect())


@pytest.fixture
def damaged(drop):
    (drop / "bad.zip").write_bytes(b"garbage")
    (drop / "short.json").write_text(json.dumps(EXPORT)[:-80])
    (drop / "inner").mkdir()
    (drop / "inner" / "more.zip").write_bytes(zipped(payload=EXPORT[1:]))
    (drop / "_hidden").mkdir()
    (drop / "_hidden" / "no.zip").write_bytes(b"x")
    (drop / ".no.zip").write_bytes(b"x")
    return drop


def test_source_reads_what_read_exports_reads(spark, damaged):
    chat_export.register(spark)
    source = spark.read.format("chat_export").load(str(damaged))
    assert source.columns == archives.read_exports(spark, str(damaged)).columns
    assert by_name(source) == by_name(archives.read_exports(spark, str(damaged)))
    assert source.rdd.getNumPartitions() == 4
    one = spark.read.format("chat_export").load(f"file://{damaged}/one export.zip")
    assert one.count() == 3 and one.where("modified IS NULL").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("chat_export").load(f"{damaged}/nowhere").count()


def test_source_opens_only_archives_asked_for(spark, damaged, monkeypatch):
    reader = chat_export.ArchiveReader(str(damaged), spark.read.format("chat_export").load(str(damaged)).schema)
    left = list(reader.pushFilters([chat_export.EqualTo(("ordinal",), 1), chat_export.StringEndsWith(("archive",), ".zip"),
                                    chat_export.StringContains(("archive",), "/inner/")]))
    assert [f.attribute for f in left] == [("ordinal",)]
    assert [a.path.rsplit("/", 1)[1] for a in reader.partitions()] == ["more.zip"]
    narrow = spark.read.format("chat_export").schema("ordinal long, archive string").load(str(damaged))
    found = narrow.where(F.col("archive").isin(f"file:{damaged}/inner/more.zip")).collect()
    assert sorted(r.ordinal for r in found) == [0, 1] and set(found[0].asDict()) == {"ordinal", "archive"}


def test_stream_reads_each_archive_once(spark, damaged, tmp_path):
    chat_export.register(spark)

    def run():
        arrivals = spark.readStream.format("chat_export").option("log", str(tmp_path / "log")).option("max_files", 3).load(str(damaged))
        arrivals.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True) \
            .start(str(tmp_path / "out")).awaitTermination()
        return by_name(spark.read.parquet(str(tmp_path / "out")))

    assert run() == by_name(archives.read_exports(spark, str(damaged)))
    late = damaged / "late.zip"
    late.write_bytes(zipped(payload=EXPORT[2:]))
    import os
    os.utime(late, (1, 1))  # an old file moved in is still new
    run()
    assert run() == by_name(archives.read_exports(spark, str(damaged)))
    with pytest.raises(Exception, match="log"):
        spark.readStream.format("chat_export").load(str(damaged)).writeStream.format("noop") \
            .option("checkpointLocation", str(tmp_path / "none")).start().awaitTermination()


def test_a_batch_of_the_stream_is_the_same_when_repeated(spark, damaged, tmp_path):
    options = {"path": str(damaged), "log": str(tmp_path / "log"), "max_files": "2"}
    schema = spark.read.format("chat_export").load(str(damaged)).schema
    first = chat_export.ArchiveStream(options, schema)
    end = first.latestOffset()
    before = first.partitions(first.initialOffset(), end)
    (damaged / "a.zip").write_bytes(zipped())
    again = chat_export.ArchiveStream(options, schema)
    assert again.partitions({"entry": 0}, end) == before and len(before) == 4 and end == {"entry": 2}
    assert [a.path.rsplit("/", 1)[1] for a in again.partitions(end, again.latestOffset())] == ["a.zip"]


# ---------------------------------------------------------------- loads

def contents(spark, root):
    names = ["conversations", "messages", "load_rejects", "vocabulary"]
    rows = {n: sorted(map(str, tables.read_table(spark, root, n).drop("loaded_at").collect())) for n in names}
    keys = spark.read.schema(tables._key_schema()).parquet(tables.location(root, "messages_keys"))
    return rows | {"keys": sorted((r.conv_id, r.msg_id) for r in keys.collect())}


def raw_exports(spark, drop):
    (drop / "bad.zip").write_bytes(b"garbage")
    return archives.read_exports(spark, str(drop))


@pytest.mark.parametrize("failing", range(6))
def test_a_repeated_load_replaces_what_a_failed_one_left(spark, drop, tmp_path, monkeypatch, failing):
    """A failure before any of the writes of a load, then the same load again."""
    raw = raw_exports(spark, drop)
    clean, broken = str(tmp_path / "clean"), str(tmp_path / "broken")
    for root in (clean, broken):
        tables.ensure_schema(spark, root)
    load_exports(raw, clean, load_id="x-1", words=True)
    write, calls = tables._replace, []

    def breaking(*args):
        calls.append(args)
        if len(calls) == failing + 1:
            raise OSError("storage is away")
        write(*args)

    monkeypatch.setattr(tables, "_replace", breaking)
    if failing < 5:
        with pytest.raises(OSError):
            load_exports(raw, broken, load_id="x-1", words=True)
    else:
        load_exports(raw, broken, load_id="x-1", words=True)
        assert len(calls) == 5
    monkeypatch.setattr(tables, "_replace", write)
    load_exports(raw, broken, load_id="x-1", words=True)
    assert contents(spark, broken) == contents(spark, clean)
    load_exports(raw, broken, load_id="x-2", words=True)  # the same archives in another load add nothing but a title change
    again = contents(spark, broken)
    assert {k: again[k] for k in again if k != "conversations"} == {k: v for k, v in contents(spark, clean).items() if k != "conversations"}
    tables.drop_load(spark, broken, "x-1")
    assert contents(spark, broken)["messages"] == []


def test_an_import_writes_texts_once_before_they_are_stored(spark, drop, tmp_path, monkeypatch):
    from threadloom import session
    from threadloom.operators import loads
    root, written = str(tmp_path / "tables"), []
    tables.ensure_schema(spark, root)

    def noted(df, name):
        written.append((name, set(df.columns)))
        return write_scratch(df, name)

    for module in (streams, loads, session):
        monkeypatch.setattr(module, "write_scratch", noted)
    raw = raw_exports(spark, drop)
    for load in ("a", "b"):
        written.clear()
        load_exports(raw, root, load_id=load)
        assert [name for name, columns in written if columns & {"text", "conversation"}] == ["normalised"]
    assert len(tables.read_table(spark, root, "messages").collect()) == 5


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 150, 0])
def test_rows_of_keys(spark, monkeypatch, broadcast_bytes):
    """The keys kept go out, or those that are not, or the rows are joined; a null is a key."""
    from threadloom import session
    monkeypatch.setattr(session, "BROADCAST_BYTES", broadcast_bytes)
    rows = spark.createDataFrame([(i if i else None, "x") for i in range(20)] + [(3, "y")], "k long, text string")
    keys = rows.select("k")
    for kept in (lambda r: r.k is None or r.k > 2, lambda r: r.k == 3, lambda r: False):
        chosen = [(r.k,) for r in keys.collect() if kept(r)]
        got = session.rows_of_keys(rows, spark.createDataFrame(chosen, "k long"), keys, ["k"]).collect()
        assert sorted(map(str, got)) == sorted(str(r) for r in rows.collect() if kept(r))
    once, again = session.split_repeated(rows, ["k"])
    assert sorted(r.text for r in again.collect()) == ["x", "y"] and once.count() == 19


def test_small_imports_open_few_key_files(spark, tmp_path):
    root = str(tmp_path / "tables")
    tables.ensure_schema(spark, root)
    stored = spark.range(20_000).select(F.concat(F.lit("c"), (F.col("id") / 4).cast("long").cast("string")).alias("conv_id"),
                                        F.col("id").cast("string").alias("msg_id"), F.lit("user").alias("role"),
                                        F.current_timestamp().alias("ts"), F.lit("t").alias("text"))
    for part in range(3):
        tables.append_table(stored.where(F.col("msg_id").cast("long") % 3 == part), root, "messages")
    arriving = spark.createDataFrame([("c7",), ("c8",), ("new",)], "conv_id string")
    opened = tables.key_partitions(spark, root, "messages", arriving)
    files = opened.select(F.input_file_name()).distinct().count()
    every = spark.read.schema(tables._key_schema()).parquet(tables.location(root, "messages_keys")).select(F.input_file_name()).distinct().count()
    assert files <= 3 * 3 * 2 and every > 500
    assert opened.where("conv_id = 'c7'").count() == 4 and opened.count() < 20_000 / 50


def test_streams_in_threads_keep_their_scratch_apart(spark):
    import threading
    kept, gone = [], []
    started, leave = threading.Event(), threading.Event()

    def other():
        with dropped_scratch(spark):
            gone.append(write_scratch(spark.range(3), "inner"))
            started.set()
            leave.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    started.wait(60)
    with dropped_scratch(spark):
        kept.append(write_scratch(spark.range(4), "mine"))
    assert gone[0].count() == 3  # ours is deleted, the other's is not
    with pytest.raises(Exception):
        kept[0].count()
    leave.set()
    thread.join()
    with pytest.raises(Exception):
        gone[0].count()


def test_streams_leave_no_scratch(spark, drop, tmp_path):
    import os
    root = str(tmp_path / "tables")
    before = set(os.listdir(scratch_root(spark).removeprefix("file:"))) if os.path.isdir(scratch_root(spark).removeprefix("file:")) else set()
    stream_ingest(spark, str(drop), root, str(tmp_path / "offsets"), words=True).awaitTermination()
    stream_embed(spark, root, str(tmp_path / "embed"), vectors.hashing_embedder(8), 8, "hash-8", delay=0).awaitTermination()
    after = set(os.listdir(scratch_root(spark).removeprefix("file:")))
    assert after - before == set()
    assert streams._load_of("/a/b/", 3) == streams._load_of("/a/b", 3) != streams._load_of("/a/c", 3)


def test_scratch_of_a_local_session_without_a_folder(spark, monkeypatch):
    from threadloom import session

    class Bare:
        class conf:
            get = staticmethod(lambda *_: None)
        sparkContext = spark.sparkContext

    first = session.scratch_root(Bare)
    assert first == session.scratch_root(Bare) and "threadloom-" in first

    class Cluster(Bare):
        class sparkContext:
            applicationId, master = "another", "yarn"

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.scratch_root(Cluster)


# ---------------------------------------------------------------- vocabulary

@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_vocabulary_gives_the_lexemes_of_every_place(spark, monkeypatch, broadcast_bytes):
    from threadloom.functions import stem
    monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", broadcast_bytes)
    monkeypatch.setattr(vocabulary, "FREQUENT", 5)
    texts = ["consigned consisting the Knaves", "knave knives knave", "consistency " * 9, "", None, "The the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "msg_id int, text string")
    words = vocabulary.vocabulary(rows)
    got = sorted((r.msg_id, r.lexeme) for r in vocabulary.with_lexemes(vocabulary.word_places(rows, "msg_id"), words).collect())
    plain = [(i, stem.stem(w)) for i, t in enumerate(texts) for w in (t or "").lower().split() if w != "the"]
    assert got == sorted(plain)
    stored = words.where("word < 'k'").select("word", "lexeme")
    assert {r.word for r in vocabulary.new_words(stored, rows).collect()} == {"knaves", "knave", "knives"}
