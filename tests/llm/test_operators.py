"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names, and brute force."""

import hashlib
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runledger.llm import chat, common, components, decontam, langid, lm, ngram_join, packing, quality, registry, sharding, suffix_dedup, textblocks, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, shard string, n long"


def corpus():
    """Random texts with copies, near copies, shared passages, and the odd cases."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice(["the", "an", "ti", "on", "ré", "st", "ou"]) for _ in range(draw.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \t\n ", "one", "One two", "one two three", "x" * 49, "y" * 50, "y" * 51, "a\x0bb\x0cc\x1cd", "é" * 40, "ab " * 400, "!! " * 30]
    for _ in range(25):
        texts.append(" ".join(word() for _ in range(draw.randint(3, 120))))
    for i in range(15, 25):
        words = texts[i].split(" ")
        words[draw.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[i] + " " + passage + " " + word())
    texts += texts[13:20] + [texts[14].upper()]
    rows = [(i, t, None if i % 7 == 0 else "en", "s", i) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_ledger(docs, nothing, rows):
    got = {r["doc_id"]: r for r in quality.ledger(docs).collect()}
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {p + k for p, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected, text
    assert quality.ledger(nothing).count() == 0
    assert "n_words" in quality.ledger(docs.withColumn("n_words", F.lit(1))).columns
    ablation = {(r["policy"], r["rule"]): r for r in quality.ablations(quality.ledger(docs)).collect()}
    bits = [r["failure_bits"] for r in got.values()]
    for (policy, rule), r in ablation.items():
        mask, bit = quality.mask_of(quality.POLICIES[policy]), quality.mask_of((rule,))
        assert (r["n_rows"], r["n_kept"], r["n_kept_without"], r["n_only_this"]) == (len(bits), sum(not b & mask for b in bits), sum(not b & mask & ~bit for b in bits), sum(b & mask == bit for b in bits))


def test_sharding(spark, docs, nothing):
    one, more = dict.fromkeys(range(4), 1.0), dict.fromkeys(range(5), 1.0)
    keys = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"))
    got = sharding.shard_records(keys, "doc_id", one, more, []).collect()
    for r in got:
        assert r["grown_shard"] in (r["shard"], 4)
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)}
    assert all(x == list(range(len(x))) and 600 < len(x) < 900 for x in slots.values())
    heavy = Counter(r["shard"] for r in sharding.shard_records(keys, "doc_id", {0: 3.0, 1: 1.0}, {0: 3.0, 1: 1.0}, []).collect())
    assert 2100 < heavy[0] < 2400
    repeated = spark.createDataFrame([(None,), (None,), (5,), (5,), (5,)], "doc_id long")
    again = sharding.shard_records(repeated, "doc_id", one, more, []).collect()
    assert sorted((r["shard"], r["slot"]) for r in again) == sorted({(r["shard"], r["slot"]) for r in again})
    assert sharding.shard_records(nothing, "doc_id", one, more, []).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_exactly(seed):
    draw = random.Random(seed)
    histogram = Counter(draw.randint(1, 32) for _ in range(draw.choice([1, 10, 3000])))
    used = Counter()
    for option, n in packing.plan(histogram, 32):
        assert sum(option) <= 32 and n > 0
        used.update({c: k * n for c, k in Counter(option).items()})
    assert used == histogram
    if sum(histogram.values()) > 1000:
        weight = sum(c * n for c, n in histogram.items())
        assert sum(n for _, n in packing.plan(histogram, 32)) <= 1.03 * weight / 32 + 1


def test_nnls_against_a_grid():
    a, b = np.array([[1.0, 0, 2], [0, 1, 1]]), np.array([3.0, -1])
    x = packing.nnls(a, b)
    best = min(((a @ np.array([i, j, k]) - b) ** 2).sum() for i in np.linspace(0, 3, 31) for j in np.linspace(0, 3, 31) for k in np.linspace(0, 3, 31))
    assert (x >= 0).all() and ((a @ x - b) ** 2).sum() <= best + 1e-9


def test_packing_round_trip(spark, docs, nothing, rows):
    from tokenizers import Tokenizer

    path = registry.tokenizer_file()
    tokenizer = Tokenizer.from_file(path)
    odd = [(1002, "hello <|startoftext|> world<|endoftext|>x <|ENDOFTEXT|>", "en", "s", 1), (1003, "é<|endoftext|> <|EndOfText|>", "en", "s", 1), (1000, "Don't <|endoftext|> it's 12,5 ΣΑΣ İ x́y ﬁ 中文　 a\x85b", "en", "s", 1), (1001, "word " * 9000, "en", "s", 1)]
    got = packing.pack(docs.unionByName(spark.createDataFrame(odd, SCHEMA)), path).collect()
    for i, text, *_ in [*rows, *odd]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, "<u4").tobytes()
        assert {r["doc_tokens"] for r in own} == {len(ids)}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(nothing, path).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string"), path).collect()
    assert len(twice) == 3 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3


@pytest.mark.parametrize("most", [1, 3, 300])
def test_packing_of_short_pieces_leaves_little_padding(spark, most):
    lengths = [1 + i * 7919 % most for i in range(20000)]
    pieces = spark.createDataFrame([(i, 0, n, "x", 5) for i, n in enumerate(lengths)], "doc_id long, start long, length long, text string, sequence_id int")
    out = packing.place(pieces)
    assert out.columns == ["doc_id", "start", "length", "text", "sequence_id", "offset"]
    sequences = {}
    for r in out.collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    assert sorted(d for x in sequences.values() for *_, d in x) == list(range(20000))
    for x in sequences.values():
        ends = [0, *(a + n for a, n, _ in sorted(x))]
        assert [a for a, *_ in sorted(x)] == ends[:-1] and ends[-1] <= 4096
    assert len(sequences) <= 1 + 1.05 * sum(lengths) / 4096


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(words, words[1:], words[2:], strict=False)) or (frozenset([tuple(words)]) if words else frozenset())


@pytest.mark.parametrize("leaders", [False, True])
def test_similar_components(docs, nothing, rows, leaders):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs, leaders=leaders).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_join.similar_components(nothing).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_filters_never_lose_a_link(seed):
    draw = np.random.default_rng(seed)
    for n, changed in ((30, 2), (300, 10), (1500, 70), (1500, 85), (6000, 300), (70000, 3000)):
        a = np.unique(draw.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate((a[changed:], draw.integers(0, 2**64, changed, np.uint64))))
        apart = sum(int(x).bit_count() for x in np.bitwise_xor(*ngram_join.parities([a, b])).view(np.uint64))
        least = -(-90 * (len(a) + len(b)) // 190)
        plausible = ngram_join.may_be_similar(ngram_join.range_counts(a), ngram_join.range_counts(b), len(a), len(b))
        assert apart <= 2 * changed and (plausible and apart <= len(a) + len(b) - 2 * least or not ngram_join.compare(a, b))
    assert not ngram_join.may_be_similar(ngram_join.range_counts(a[:20000]), ngram_join.range_counts(a[20000:40000]), 20000, 20000)


def test_null_keys_take_part(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(None, text), (3, text), (2, text + " w"), (2, text + " w"), (9, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.similar_components(rows).collect()) == [(-1, 2), (2, 2), (2, 2), (3, 2), (9, 9)]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (60, 60)]
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {41: 40, 50: 40}


def test_prefix_length_covers_every_partner():
    for n in range(1, 200):
        least = -(-90 * n // 100)  # shingles that a smaller partner shares at least
        assert packing and ngram_join.prefix_length(n) == n - least + 1


@pytest.mark.parametrize("group_bytes", [700, 10**6])
def test_remove_repeats(spark, docs, nothing, rows, group_bytes):
    first, expected = {}, {}
    for i, text, *_ in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first.get(data[p : p + 50], i) < i:
                gone[p : p + 50] = True
        for p in range(len(data) - 49):
            first.setdefault(data[p : p + 50], i)
        expected[i] = (len(data), bytes(np.frombuffer(data, np.uint8)[~gone]))
    got = suffix_dedup.remove_repeats(docs, group_bytes=group_bytes)
    assert got.columns == ["doc_id", "lang", "shard", "n", "n_bytes", "kept", "spans"]
    for r in got.collect():
        assert (r["n_bytes"], bytes(r["kept"])) == expected[r["doc_id"]]
        assert r["n_bytes"] - len(r["kept"]) == sum(s["end"] - s["start"] for s in r["spans"])
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeats_in_more_groups_than_buckets(spark):
    draw = random.Random(4)
    shared = "".join(draw.choice("abcdef ") for _ in range(60))
    rows = [(i, "".join(draw.choice("abcdef ") for _ in range(3000)) + chr(65 + i) + shared * (i % 2)) for i in range(40)]
    rows.append((99, "q" * 120_000 + shared))
    docs = spark.createDataFrame([(*r, "c", 1, "g") for r in rows], "doc_id long, text string, kept string, copy int, _name string")
    out = suffix_dedup.remove_repeats(docs, group_bytes=1, most_buckets=4)  # some 240,000 groups
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in out.collect()}
    expected = {i: [(3001, 3061)] if i % 2 and i > 1 else [] for i in range(40)} | {99: [(120_000, 120_060)]}
    assert got == expected and out.columns == ["doc_id", "copy", "_name", "n_bytes", "kept", "spans"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("repeats_")]


def test_repeats_of_one_key_and_of_none(spark):
    text = "é" * 30 + " end"
    rows = spark.createDataFrame([(4, text), (4, text), (None, text), (5, text + "!")], "doc_id long, text string")
    rows = rows.withColumn("never", F.lit(1)).withColumn("row", F.struct("doc_id", "never"))  # columns without nulls
    got = sorted((r["doc_id"] or -1, r["kept"]) for r in suffix_dedup.remove_repeats(rows, decoded=True).collect())
    assert got == [(-1, text), (4, text), (4, text), (5, "!")]


def part_of(runs):
    """The blocks of a part; runs: (group, minimizer, key, text)."""
    rows = []
    for g in sorted({r[0] for r in runs}):
        own = sorted({(mu, text): key for grp, mu, key, text in runs if grp == g}.items(), key=lambda x: x[0][0])
        mu, key, size = (np.array(x, np.uint64) for x in zip(*((m, k, len(t)) for (m, t), k in own), strict=True))
        rows.append({"part": 0, "grp": g, "mu": textblocks.pack_sorted(mu), "n": textblocks.pack_counts(key), "size": textblocks.pack_counts(size), "data": b"".join(t for (_, t), _ in own)})
    return rows, pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), ("grp", pa.int32()), *((c, pa.binary()) for c in ("mu", "n", "size", "data"))]))


@pytest.mark.parametrize(("searched", "most"), [(10**6, 10**6), (3000, 10**6), (600, 100), (60, 1)])
def test_parts_are_searched_by_ranges(searched, most):
    draw = random.Random(6)
    passages = {mu: bytes(draw.choice(b"abc ") for _ in range(90)) for mu in (7, *(i << 40 for i in range(1, 20)))}
    runs = []
    for i in range(400):
        mu, a = 7 if i % 2 else draw.randrange(1, 20) << 40, draw.randint(0, 30)  # one frequent minimizer
        text = bytes(draw.choice(b"de") for _ in range(draw.randint(0, 3))) + passages[mu][a : a + draw.randint(50, 60)] + bytes(draw.choice(b"fg") for _ in range(draw.randint(0, 2)))
        runs.append((i // 50, mu, i * 37 % 101, text))
    rows, table = part_of(runs)
    least, found = {}, []
    for row in rows:
        ends = np.cumsum(textblocks.unpack_counts(row["size"])).tolist()
        mu, key = textblocks.unpack_sorted(row["mu"]).tolist(), textblocks.unpack_counts(row["n"]).tolist()
        found.append([(m, k, row["data"][a:b]) for m, k, a, b in zip(mu, key, [0, *ends], ends, strict=False)])
    for m, k, text in sum(found, []):
        for p in range(len(text) - 49):
            least[m, text[p : p + 50]] = min(k, least.get((m, text[p : p + 50]), k))
    for own, answer in zip(found, suffix_dedup._decide_blocks(table, searched, most).to_pylist(), strict=True):
        at = 0
        for (m, k, text), state in zip(own, answer["state"], strict=True):
            n = len(text) - 49
            got = answer["mask"][at : at + n] if state == 2 else bytes([state]) * n
            at += n * (state == 2)
            assert list(got) == [least[m, text[p : p + 50]] < k for p in range(n)]
        assert at == len(answer["mask"])


@pytest.mark.parametrize("minimizers", [1, 3000])
def test_memory_of_a_part(minimizers):
    draw = np.random.default_rng(3)
    letters = draw.integers(97, 123, 12_000_000, np.uint8).tobytes()
    anchors = [letters[i * 24 : i * 24 + 24] for i in range(minimizers)]
    runs = [(i % 20, i % minimizers << 30, i, letters[i * 70 : i * 70 + 40] + anchors[i % minimizers] + letters[i * 70 + 40 : i * 70 + 70]) for i in range(120_000)]
    _, table = part_of(runs)
    del runs
    tracemalloc.start()
    suffix_dedup._decide_blocks(table)  # 11 MB of runs
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250_000_000


def test_memory_of_flags():
    draw = np.random.default_rng(3)
    keys = [np.unique(draw.integers(0, 1 << 48, 20_000, np.uint64)) for _ in range(100)]
    keys[1::2] = keys[::2]
    none = pa.nulls(100, pa.binary())
    table = pa.table({"part": pa.array([0] * 100, pa.int32()), "grp": pa.array(range(100), pa.int32()), "mu": pa.array([textblocks.pack_sorted(k) for k in keys], pa.binary()), "n": pa.array([textblocks.pack_counts(np.ones(len(k))) for k in keys], pa.binary()), "size": none, "data": none})
    tracemalloc.start()
    out = suffix_dedup._flag_minimizers(table)  # 2 million minimizers
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.unpackbits(np.frombuffer(x, np.uint8))[: len(k)].all() for x, k in zip(out["state"].to_pylist(), keys, strict=True))
    assert peak < 100_000_000


def test_groups_share_files(spark):
    draw = random.Random(9)
    shared = "".join(draw.choice("abcdefgh ") for _ in range(80))
    rows = [(i, "".join(draw.choice("xyz ") for _ in range(60)) + shared[i % 7 : 70 + i % 5]) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = Path(common.shared_folder(spark).removeprefix("file:"))
    before = set(at.iterdir())
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs, group_bytes=200).collect()}  # about 1,000 groups
    tables = [p for p in set(at.iterdir()) - before if p.name.startswith("repeats_")]
    assert len(tables) == 1 and 1 < len(list(tables[0].glob("*.parquet"))) <= 200
    least = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            least.setdefault(t[p : p + 50], i)
    for i, t in rows:
        gone = {p + k for p in range(len(t) - 49) if least[t[p : p + 50]] < i for k in range(50)}
        assert got[i].decode() == "".join(c for p, c in enumerate(t) if p not in gone)


def test_memory_of_equal_windows():
    letters = np.random.default_rng(3).integers(97, 123, 1_500_000, np.uint8).tobytes()
    texts = [letters[i * 70 : i * 70 + 40] + letters[i % 500 * 24 : i % 500 * 24 + 24] + letters[i * 70 + 40 : i * 70 + 70] for i in range(21_000)]
    tracemalloc.start()
    suffix_dedup.equal_windows(texts)  # 2 MB
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000


def test_workers_give_memory_back():
    code = """
import io, re
from pathlib import Path
import pyarrow as pa
from runledger.llm import common
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1])
before = held()
batch = pa.RecordBatch.from_arrays([pa.array([bytes([i + 1]) * 1_000_000 for i in range(9)], pa.binary())], ["data"])
stream = pa.BufferOutputStream()
with pa.ipc.new_stream(stream, batch.schema) as writer:
    writer.write_batch(batch)
raw = stream.getvalue().to_pybytes()
del batch, stream, writer
for _ in range(3):
    common.of_group(lambda table: pa.array(table["data"].to_pylist(), pa.binary()).nbytes)(pa.ipc.open_stream(io.BytesIO(raw)).read_all())
del raw
common.release_memory()
print(before, held(), pa.total_allocated_bytes())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout
    before, after, allocated = map(int, out.split())
    assert allocated == 0 and after < before + 45_000, out  # kB: some 28,000 of it is not the pool's


@pytest.mark.parametrize("seed", range(3))
def test_equal_windows(seed):
    draw = random.Random(seed)
    texts = [bytes(draw.choice(b"ab\x00\xff") for _ in range(draw.randint(8, 60))) for _ in range(30)]
    texts += [texts[0] + texts[1], b"aaaaaaaaaaaaaaaaaaaa"]
    classes, start = suffix_dedup.equal_windows(texts, 8)
    named = {}
    for s, t in zip(start, texts, strict=True):
        for k in range(len(t) - 7):
            assert named.setdefault(int(classes[s + k]), t[k : k + 8]) == t[k : k + 8]
    assert len(named) == len({t[k : k + 8] for t in texts for k in range(len(t) - 7)})


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, docs, nothing, rows, order):
    train = {i for i, *_ in rows if i % 3}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t, *_ in rows}
    counts = [Counter(), Counter(), Counter()]
    for i in train:
        padded = ["<s>", "<s>", *tokens[i]]
        counts[0].update(tokens[i])
        counts[1].update(zip(padded[1:], padded[2:], strict=False))
        counts[2].update(zip(padded, padded[1:], padded[2:], strict=False))
    n, v = sum(counts[0].values()), len(counts[0])

    def probability(context, w):
        p = (counts[0][w] + 1) / (n + v + 1)
        for k in range(1, order):
            own = context[2 - k :]
            state = len(train) if own[-1] == "<s>" else counts[0][own[0]] if k == 1 else counts[1][own]
            if state:
                mass = state**lm.SPREAD
                p = (counts[k][(*own, w)] + mass * p) / (state + mass)
        return p

    got = {r["doc_id"]: r for r in lm.score_documents(docs, F.col("doc_id") % 3 != 0, order=order, group_bytes=900).collect()}
    for i, own in tokens.items():
        padded = ["<s>", "<s>", *own]
        total = sum(np.log10(probability(tuple(padded[k : k + 2]), w)) for k, w in enumerate(own))
        assert got[i]["score"] == pytest.approx(total), i
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((counts[0][w] + 1) / (n + v + 1)) for w in own))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(own), sum(counts[0][w] > 0 for w in own), n, i not in train)
    assert lm.score_documents(nothing, F.lit(True)).count() == 0


def test_chat_round_trip(spark):
    odd = r"\### Assistant: </turn> ok"
    part = lambda **k: {f.name: k.get(f.name) for f in chat.PART_TYPE}
    parts = [part(type="text", text="see <turn>"), part(type="image", ref="i.png", width=56, height=29), part(type="audio", ref="a.wav", seconds=2.0), part(type="document", ref="d.pdf", pages=3), part(type="odd", ref="o"), part(type="image", ref="j.png")]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part(type="text", text=odd)]), (1, 1, "assistant", [part(type="text", text="b\\\\")]), (None, None, None, None), (2, 0, "us\ner", [part(type="text", text=None)])]
    messages = spark.createDataFrame(rows, chat.T.StructType([*spark.createDataFrame([], "conv_id long, turn long, role string").schema, chat.T.StructField("parts", chat.T.ArrayType(chat.PART_TYPE))]))
    formatted = chat.format_messages(messages).collect()
    first = next(r for r in formatted if r["conv_id"] == 1 and r["at"] == 0)
    assert first["formatted"] == "<turn>user\nsee \\<turn><part:image:1><part:audio:1><part:document:1><part:other:1><part:image:2></turn>\n"
    assert [(a["kind"], a["ordinal"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", 1, "i.png", 4), ("audio", 1, "a.wav", 50), ("document", 1, "d.pdf", 1800), ("other", 1, "o", 0), ("image", 2, "j.png", 0)]
    assert first["expanded_tokens"] == 1854
    plain = messages.where("conv_id = 2 OR turn = 1")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_messages(plain)).collect()}
    learned = "".join(sorted([odd, "b\\\\"]))
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[2]["turns_sha256"] == hashlib.sha256(b"us\ner\n\n").hexdigest() and got[2]["loss_chars"] == 0
    assert chat.digests(chat.format_messages(messages.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\<", "</turn>", "<turn>x</turn>\n", "<part:image:1>", "a\\<b", "\\</turn>"])
def test_escapes_reverse(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.read_turn(f"<turn>r\n{chat.escape(text)}</turn>\n") == ("r", text)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    words, stems = ["idiot", "moron", "scum", "dumbfoundling"], ["achl", "wretch"]
    automaton = toxicity.compile_lexicon(words, stems)
    draw = random.Random(1)
    given = ["idiot", "idot", "idiott", "idiat", "xidiot", "diot", "scum", "scam", "achl", "achlich", "ach", "moronn", "", "dunbfoundling", "dumbfoundlin", "dumbfound", "wretched", "wertch", "wrethed", "wreched", "wretsh"]
    given += ["".join(draw.choice("idiotmrn") for _ in range(draw.randint(1, 7))) for _ in range(3000)]
    code = np.frombuffer("".join(given).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in given])
    got = automaton.classes(code, np.cumsum(size) - size, size)
    for w, kind in zip(given, got, strict=True):
        near = min(distance(w, x) for x in words if len(x) >= toxicity.FUZZY_LENGTH)
        near = min([near, *(distance(w[:k], x) for x in stems if len(x) >= toxicity.FUZZY_STEM for k in range(len(w) + 1))])
        exact = w in words or any(w.startswith(s) for s in stems)
        assert kind == (toxicity.EXACT if exact else toxicity.FUZZY if near <= 1 else toxicity.MISS), w


def test_quotation_is_told_from_abuse():
    automaton = toxicity.compile_lexicon(["idiot"], [])
    x = toxicity.features(automaton, ['you idiot, go', 'the word idiot is rude', 'he is "an idiot" they say', "«un idiot» dit", "you idoit idiots", None, ""])
    hits = np.expm1(x[:, 1:]).round().astype(int).tolist()
    assert hits == [[1, 0, 0], [0, 0, 1], [0, 0, 1], [0, 0, 1], [0, 1, 0], [0, 0, 0], [0, 0, 0]]


def test_toxicity_learns_words_and_stems(spark, nothing):
    draw = random.Random(2)
    plain = ["the", "house", "river", "green", "walks", "often", "under"]
    texts, labels = [], []
    for i in range(400):
        words = [draw.choice(plain) for _ in range(30)]
        if i % 5 == 0:
            words[draw.randrange(30)] = draw.choice(["wretch", "vilum" + draw.choice(["a", "os", "ix", "er"])])
        texts.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    given = spark.createDataFrame([(1, "a wretch indeed"), (2, "wretsh"), (3, "vilumnew"), (4, "the green river"), (5, None), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(given, model).collect()}
    assert got[1] > 0.5 and got[3] > 0.5 and got[1] > got[2] > got[4] == got[5] == got[6] and got[4] < 0.1
    assert toxicity.scored(nothing, model).count() == 0
    assert (toxicity.fit(nothing, known.limit(0)).weights == toxicity.PRIOR).all()


def test_long_toxic_words_may_be_misspelled(spark):
    plain = ["the", "house", "river", "green", "walks", "often", "under", "said"]
    draw = random.Random(3)
    rows = [(i, " ".join([*draw.choices(plain, k=20), "dumbfoundling" if i % 4 == 0 else "dumb founder"]), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit(docs, docs, label="y")
    given = ["dumbfoundling", "dunbfoundling", "dumbfoundlin you", "the green house", None, "", "dunbfoundling", 'he said "dumbfoundling" twice', "green " * 40000 + "dumbfoundling"]
    extra = spark.createDataFrame([(i, t, "s", 7.5, "k") for i, t in enumerate(given)], "doc_id long, text string, source string, features double, kept string")
    out = toxicity.scored(extra, model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "source", "features", "kept", "score"] and got[0]["features"] == 7.5
    for i, t in enumerate(given):  # the score again, from hits counted by edit distance
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        exact = sum(w.startswith("dumbfoundl") for w in words)  # the stem that the longest prefix gives
        near = sum(not w.startswith("dumbfoundl") and min(distance(w[:k], "dumbfoundl") for k in range(9, 12)) <= 1 for w in words)
        x = np.log1p([np.e - 1, 0, near, exact] if i == 7 else [np.e - 1, exact, near, 0])
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-x @ model.weights))), t
    assert got[0]["score"] > 0.5 and got[1]["score"] == got[6]["score"] > got[3]["score"] == got[4]["score"] == got[5]["score"]


def test_language_identification(spark, nothing):
    say = {"en": "the of and with this house that where", "fr": "le la une avec cette maison que où", "xx": "zu zi zo zazu"}
    rows = [(i, " ".join(random.Random(i).choices(w.split(), k=12)), lang) for i, (lang, w) in enumerate(list(say.items()) * 30)]
    rows += [(900, "the", None), (901, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    given = [(1, "this house and that"), (2, "AVEC LA MAISON"), (3, None), (4, "12 !! \n"), (5, "zuzo"), (6, ""), (7, "thise housing " * 2000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(given, "doc_id long, text string"), model).collect()}
    assert {i: p for i, (p, _) in got.items()} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "xx", 6: "und", 7: "en"}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    assert langid.predict(nothing.select("doc_id", "text"), langid.fit(nothing, F.lit(True))).count() == 0


def test_decontamination(spark, nothing):
    item = "Each of the 12 boxes on the wide shelf holds 12 red apples that were picked by Maria before noon on the farm road"
    changed = item.replace("12", "15").replace("Maria", "Peter")
    mixed = item.replace("12", "15", 1)
    texts = ["Intro words here. " + item + " tail", changed, mixed, "A train travels far and wide", None, "", item.upper(), "once twice", "x " * 30000 + item, "11 12 13 14 15 16 17 18 19"]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, hash string, at int")
    items = spark.createDataFrame([(10, item, 1), (11, None, 1), (12, "", 1), (13, "once twice", 1), (14, "7 8 9 10 11 12 13 14 15", 1)], "item_id long, text string, size int")
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontam.matches(docs, items).collect()}
    assert got == {(0, 10): True, (1, 10): False, (2, 10): True, (6, 10): True, (7, 13): True, (8, 10): True}
    assert decontam.matches(nothing, items).count() == 0 and decontam.matches(docs, items.limit(0)).count() == 0
    assert decontam.matches(docs.unionByName(docs), items).count() == 6


def test_every_item_is_found_in_the_items(spark):
    texts = [
        "If 3 + 4 = 7 and 5 + 6 = 11 what is 9", "What is 17 * 23 ?", "Maria has 12 apples and gives 5 of them to her old friend from school", "7 8 9 10 11 12 13 14 15", "One",
        "What colour is the old bridge near the mill today?", "Barack Obama met Angela Merkel in Berlin Germany", "... !!", "What of 5 6 7 8 boxes on the wide shelf",
    ]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    given = [t for x in texts for t in (x, f"Question 7 {x} end of it", x.lower(), x.upper())] + ["Peter has 31 apples and gives 9 of them to her old friend from school"]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontam.matches(docs, items).collect()}
    assert {(4 * i + k, i) for i in range(len(texts)) for k in range(4)} <= got.keys()
    assert got[4 * len(texts), 2] is False


def test_short_items_word_for_word(spark):
    items = ["What colour is the old bridge near the mill today?", "Which river?", "Barack Obama met Angela Merkel in Berlin Germany", "What of 5 6 7 8 boxes on the wide shelf"]
    texts = ["Question 7 " + items[0] + " end", "Heading Which river? end", "so barack obama met angela merkel in berlin germany then", "What of 1 2 3 4 boxes on the wide shelf", "Nothing of it here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontam.matches(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["same_values"] for r in got} == {(0, 0): True, (1, 1): True, (2, 2): True, (3, 3): False}


def test_conflicting_values_drop_their_windows_only(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50)]
    words[5], words[20], words[45] = "12", "30", "12"
    at = lambda **new: " ".join(new.get(f"p{i}", w) for i, w in enumerate(words))
    texts = [at(p45="15"), at(p5="7", p20="7", p45="7"), " ".join(words), "nothing of it", "12 30 " * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_windows"], r["n_literal_windows"], r["same_values"]) for r in decontam.matches(docs, items).collect()}
    # a place is in eight windows, the last five places in fewer; of 12 -> 7 (twice) and 30 -> 7 (once) the first stays
    assert got == {0: (43, 38, False), 1: (35, 24, False), 2: (43, 43, True)}


def test_queries_are_registered():
    assert {n.partition("_")[0] for n in registry.QUERIES if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}


def test_crc_folds(spark):
    from runledger.llm.common import fold_of

    got = {r["id"]: r["f"] for r in spark.range(50).select("id", fold_of(F.col("id"), 7).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 for i in range(50)}
