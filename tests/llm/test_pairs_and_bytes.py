"""Near-copy join, top-k search and byte deduplication against plain versions."""
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import ngram_join, suffix_dedup
from tabloom.llm.components import components
from tabloom.llm.ngram_join import jaccard_components
from tabloom.llm.topk import best, segments, top_k

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return sorted((i, len(x), root(i)) for i, x in sets)


def family(seed, base, copies, edits):
    """Copies of ``base`` with some words replaced: many pairs lie close to the threshold."""
    r = random.Random(seed)
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    passage = [r.choice(WORDS) for _ in range(60)]
    rows = family(1, [r.choice(WORDS) for _ in range(150)], 70, 6)
    rows += family(2, [r.choice(WORDS) for _ in range(40)], 40, 2)
    rows += family(3, [r.choice(WORDS) for _ in range(900)], 12, 30)
    # A passage that many otherwise different documents hold.
    rows += [" ".join([r.choice(WORDS) for _ in range(20)] + passage + [r.choice(WORDS) for _ in range(8)]) for _ in range(60)]
    rows += [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 30))) for _ in range(60)]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "one two", "Ä ä", "ä ä", "a a a a a a a a a", "a a a a a", "x\x00y z", "w1\xa0w2 w3"]
    rows += [rows[0]] * 5
    r.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard_components(spark, texts):
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in jaccard_components(docs).collect())
    assert got == plain_components(texts)


def test_jaccard_rarest_blocks_lose_no_link(spark, texts):
    """Every bound of sizes and bands is tried by the sets of the fixture at other thresholds too."""
    docs = spark.createDataFrame(texts[:120], "doc_id long, text string")
    for percent in (50, 95):
        got = sorted((r.doc_id, r.component_id) for r in jaccard_components(docs, percent=percent).collect())
        sets = {i: shingles(t) for i, t in texts[:120]}
        links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        name = dict(got)
        assert all(name[i] == name[j] for i, j in links)
        apart = {i: i for i in sets}
        for i, j in sorted(links):
            lo, hi = sorted((apart[i], apart[j]))
            apart = {k: lo if v == hi else v for k, v in apart.items()}
        assert name == apart


def test_jaccard_repeated_and_null_ids(spark):
    rows = [(7, "a b c d e f"), (7, "u v w x y z"), (9, "a b c d e f"), (3, "u v w x y z"), (None, "a b c d e f"), (5, None)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None)
    assert named == [(3, 2, 3), (5, 0, 5), (7, 2, 3), (7, 2, 3), (9, 2, 3)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_jaccard_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {90: 90, 95: 90, 100: 90}


def test_top_k(spark):
    random_ = np.random.RandomState(3)
    vectors = [(i, [float(np.float32(x)) for x in random_.standard_normal(12) / 3]) for i in range(400)]
    vectors += [(400 + i, vectors[50][1]) for i in range(30)]
    odd = [(600, None), (650, [float("nan")] * 12), (None, [1.0] * 12), (700, [None] * 12), (750, []), (800, [1e3]), (850, [float("inf")] * 12)]
    rows = [(i, v, "x") for i, v in vectors + odd]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string"), F.col("vec_id") % 50 == 0).collect()
    whole = {i: [int(np.floor(256 * x)) for x in v] + [0] * (12 - len(v)) for i, v in vectors + [odd[4], odd[5]]}
    want = []
    for q in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few(spark):
    shape = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], shape), F.col("vec_id") % 50 == 0).collect() == []
    assert top_k(spark.createDataFrame([(0, [1.0])], shape), F.col("vec_id") % 50 == 0).collect() == []
    got = top_k(spark.createDataFrame([(0, [1.0]), (1, [0.5]), (0, [2.0])], shape), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 128)]


def clustered(random_, rows):
    centres = random_.standard_normal((40, 64))
    return np.floor(centres[random_.randint(0, 40, rows)] * 30 + random_.standard_normal((rows, 64)) * 6).astype(np.int64)


def tied(random_, rows):
    return np.repeat(random_.randint(-9, 9, (3, 8)), rows // 3, 0)


def beyond_doubles(random_, rows):
    return random_.randint(-(2**28), 2**28, (rows, 8))


@pytest.mark.parametrize("made, share", [(clustered, 0.5), (tied, 1.0), (beyond_doubles, 1.0)])
def test_segments_stop_on_proof(made, share):
    random_ = np.random.RandomState(1)
    rows = made(random_, 1500)
    ids, asked = random_.permutation(1500) * 3, 60
    parts = [part for _, part in segments(rows)]
    assert sum(len(size) for _, _, size in parts) == np.count_nonzero(rows)
    score = rows[:asked].astype(object) @ rows.T.astype(object)
    want = []
    for i in range(asked):
        others = sorted((j for j in range(1500) if j != i), key=lambda j: (-score[i, j], ids[j]))
        want += [(i, j, score[i, j]) for j in others[:5]]
    got, products = best(rows[:asked], ids[:asked], parts, ids, 5)
    assert got == want
    # A score met elsewhere spares more; the rows that reach it stay.
    least = np.array([float(want[5 * i + 4][2]) for i in range(asked)])
    again, fewer = best(rows[:asked], ids[:asked], parts, ids, 5, least)
    assert again == want
    assert fewer <= products <= asked * rows.size
    assert fewer <= share * asked * rows.size


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("tabloom.llm.topk.INDEX_BLOCK", 64)
    monkeypatch.setattr("tabloom.llm.topk.QUERY_BLOCK", 8)
    whole = clustered(np.random.RandomState(5), 600)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(whole)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, scale=1).collect()
    want = []
    for q in range(0, 600, 20):
        scores = sorted((-int(whole[q] @ v), i) for i, v in enumerate(whole) if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def plain_removal(rows, least=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - least + 1 if i is not None else 0):
            w = b[s : s + least]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1 if i is not None else 0):
            if first[b[s : s + least]] < i:
                gone[s : s + least] = b"\1" * least
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def byte_texts():
    r = random.Random(8)

    def prose(n):
        return " ".join(r.choice(WORDS) for _ in range(n))

    passage, line, chorus = prose(30), "All rights are reserved, and this line stands in many documents.", "é" * 40 + "ñ" * 30
    rows = [prose(r.randint(5, 120)) for _ in range(40)]
    rows += [prose(20) + passage[r.randint(0, 30) : r.randint(90, 140)] + prose(20) for _ in range(25)]
    rows += [prose(3) + line + prose(3) for _ in range(40)]
    rows += [rows[3]] * 6 + [rows[4][:77] + "#" + rows[4][77:]] * 2
    rows += [None, "", "short", "z" * 49, "z" * 50, "z" * 300, "ab" * 200, chorus, chorus + "x", "x" + chorus, passage + passage, line * 4]
    r.shuffle(rows)
    return list(enumerate(rows))


def removed(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted(map(tuple, rows), key=repr)


def test_suffix_dedup(spark, byte_texts):
    docs = spark.createDataFrame([(i, t, "k") for i, t in byte_texts], "doc_id long, text string, kept string")
    assert removed(suffix_dedup.suffix_dedup(docs)) == plain_removal(byte_texts)


def test_suffix_dedup_of_crowded_minimizers(spark, byte_texts, monkeypatch):
    """Segments of crowded minimizers are dealt anew by longer pieces and then go the same way."""
    monkeypatch.setattr(suffix_dedup, "GROUP_SEGMENTS", 1)
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 300)
    docs = spark.createDataFrame(byte_texts, "doc_id long, text string")
    assert removed(suffix_dedup.suffix_dedup(docs)) == plain_removal(byte_texts)


def test_suffix_dedup_of_one_minimizer_in_many_segments(spark):
    """One short piece in 30,000 documents, in different surroundings; a few strings are repeated around it."""
    r = random.Random(2)
    piece = "=THE SAME PIECE="
    rows = [(i, "".join(r.choices("abcdefgh", k=60)) + piece + "".join(r.choices("ijklmnop", k=60))) for i in range(30_000)]
    rows += [(40_000 + i, "#" + rows[7 * i][1][20:120] + "#") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(suffix_dedup.suffix_dedup(docs)) == plain_removal(rows)


def test_suffix_dedup_of_a_very_long_text(spark):
    import time

    r = random.Random(6)
    long = " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(900_000))
    rows = [(1, long), (2, "SO#" + long[4_000_000:4_000_400] + "#IT ENDS"), (3, "nothing of it is here, however long one looks for it in the text")]
    start = time.perf_counter()
    found = {row[0]: tuple(row)[1:] for row in removed(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert found[1][1] == 0 and found[2][1] == 400 and found[3][1] == 0
    assert time.perf_counter() - start < 120


def test_suffix_dedup_repeated_and_null_ids(spark):
    text, other = "0123456789" * 7, "abcdefghij" * 9
    rows = [(4, text), (4, text), (4, other), (None, text), (2, other + "!"), (9, text + other)]
    assert removed(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_removal(rows)
    assert removed(suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_common_prefixes_by_interval_expansion():
    r = random.Random(4)
    segments = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(30)]
    symbols = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int64) + 1, 0) for s in segments])
    order = suffix_dedup.suffix_array(symbols, 12)
    found = suffix_dedup.common_prefixes(symbols[order - 1], 12)
    for k in range(1, len(order)):
        a, b, n = order[k - 1], order[k], 0
        while n < 12 and symbols[a + n] and symbols[a + n] == symbols[b + n]:
            n += 1
        assert found[k] == (n if n < 12 else -1)


def test_shingles_of_long_words():
    import pyarrow as pa

    from tabloom.llm.common import blocks

    text = "x" * 3000 + " " + "x" * 3001 + " a b c " + "x" * 3000
    for block in blocks(pa.array([text, None, text.upper()])):
        owner, value = ngram_join.shingle_sets(block, 5)
        assert owner.tolist() == [0, 0, 2, 2] and value[:2].tolist() == value[2:].tolist()
