"""The pipeline against a brute-force version of every stage, and the registered queries on a folder of tables."""

import contextlib
import random
import threading

import numpy as np
import psutil
import pytest

import corpus_pipeline
from runledger.llm import registry
from tests.llm.test_operators import WORD, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice(["the", "an", "ti", "on", "ré", "st", "ou", "wer", "min"]) for _ in range(draw.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(30) for _ in range(4)]
    passage = text(70)
    docs = [text(draw.randint(40, 150)) for _ in range(60)]
    toxic = set()
    for i in range(0, 60, 6):
        words = docs[i].split(" ")
        for _ in range(3):
            words[draw.randrange(len(words))] = draw.choice(["wretch", "scoundrel"])
        docs[i] = " ".join(words)
        toxic.add(i)
    docs += [docs[1], docs[2] + " " + word(), text(30) + " " + passage + " " + text(30), text(20) + " " + passage, text(40) + " " + items[2] + " " + text(20), None, "", "x"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, {i: t for i, t, *_ in rows}, toxic, items


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    at, texts, toxic, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), dict(texts)
    columns = docs.columns

    def after(name):
        nonlocal docs
        docs = corpus_pipeline.materialised(stages[name](spark, docs, at))
        assert docs.columns == columns
        return {r["doc_id"]: r for r in docs.collect()}

    kept = {i: t for i, t in kept.items() if i not in toxic}
    assert after("toxicity").keys() == kept.keys()

    sets = {i: shingles(t) for i, t in kept.items()}
    similar = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    kept = {i: t for i, t in kept.items() if not any(j < i and similar(i, j) for j in kept)}  # no chains here
    assert after("near_copies").keys() == kept.keys()

    first, left = {}, {}
    for i in sorted(kept):
        data = (kept[i] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], i) < i:
                gone[p : p + 50] = True
        rest = bytes(np.frombuffer(data, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.any() or WORD.search(rest):
            left[i] = rest
    got = after("repeats")
    assert {i: r["text"] for i, r in got.items()} == left
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    bare = lambda t: [w.strip(".,;:!?()[]{}\"'").lower() for w in WORD.findall(t)]
    windows = lambda t: {tuple(bare(t)[k : k + 8]) for k in range(len(bare(t)) - 7)}
    kept = {i: t for i, t in left.items() if not any(len(windows(t) & windows(x)) >= 6 for x in items)}
    assert len(kept) == len(left) - 1
    assert after("decontamination").keys() == kept.keys()

    pieces = stages["packing"](spark, docs, at).collect()
    tokenizer = Tokenizer.from_file(registry.tokenizer_file())
    for i, t in kept.items():
        assert sum(r["length"] for r in pieces if r["doc_id"] == i) == len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert {r["doc_id"] for r in pieces} == kept.keys()
    whole = corpus_pipeline.run(spark, at).collect()
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(whole) == key(pieces)


def test_near_copies_with_scattered_changes(spark):
    words = [f"w{i}" for i in range(200)]
    changed = [w + "x" if i in (30, 80, 120, 170) else w for i, w in enumerate(words)]  # 5-word Jaccard 176 / 216, 3-word 186 / 210
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:172])), (4, " ".join(words[:140]) + " end" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 4}


def test_stages_take_empty_tables_and_nulls(spark, folder):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a b c", None, None, 5), (1, "a b c", "en", "s", None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, at).count() == 3, name


CLASHES = ["score", "features", "kept", "spans", "sequence_id", "shard", "slot", "read", "toxicity", "row", "copy", "root", "_key", "_text", "_group", "hash", "n_bytes", "offset"]


def test_stages_carry_columns_of_any_name(spark, folder):
    at, texts, *_ = folder
    docs = spark.createDataFrame([(i, t, *[f"{i} {c}" for c in CLASHES]) for i, t in texts.items()], ", ".join(["doc_id long", "text string", *[f"{c} string" for c in CLASHES]]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{r['doc_id']} {c}" for r in got for c in CLASHES), name
    assert corpus_pipeline.pack(spark, docs, at).count() >= len(texts)


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n not in registry.ORACLE_SQL))
def test_queries_without_sql_run(spark, folder, name):
    if name == "op4_chat":
        at = folder[0]
        spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{at}/conversations.parquet")
        got = {r["conv_id"]: r["n_turns"] for r in registry.QUERIES[name](spark, at).collect()}
        assert got == {1: 2, 2: 1, -7: 2}
    else:
        got = [r["doc_id"] for r in registry.QUERIES[name](spark, folder[0]).collect()]
        assert set(got) == set(folder[1]) and (name == "op1_packing" or len(got) == len(folder[1]))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_duckdb(spark, folder, name):
    import duckdb

    at, con = folder[0], duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, at)
    theirs = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(theirs.columns) == columns
    places = [theirs.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in places) for r in theirs.fetchall())))


def test_memory_of_the_repeats_of_one_phrase(spark):
    draw = np.random.default_rng(8)
    letters, phrase = draw.integers(97, 123, 120_000 * 70, np.uint8).tobytes().decode(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+-*/=()[]{}<>"
    rows = [(i, letters[i * 70 : i * 70 + 40] + phrase + letters[i * 70 + 40 : i * 70 + 70], "en") for i in range(120_000)]  # all meet in one part
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    peak, ended = [0], threading.Event()

    def watch():
        while not ended.wait(0.02):
            for p in psutil.Process().children(recursive=True):
                with contextlib.suppress(psutil.Error):
                    if "python" in p.name():
                        peak[0] = max(peak[0], p.memory_info().rss)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeats(spark, docs, None).collect()}
    finally:
        ended.set()
        watcher.join()
    assert len(got) == len(rows) and got[0] == rows[0][1]
    firsts = {c: next(i for i, t, _ in rows if t[89] == c) for c in "abc"}  # the phrase and one more letter are 50 bytes
    assert all((phrase in got[i]) == (i == 0) for i in (0, *range(3000, 3050))) and all(got[i].endswith(rows[i][1][-20:]) for i in firsts.values())
    assert 0 < peak[0] < 600_000_000, peak
