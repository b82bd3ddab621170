"""Classifiers, scans, sharding, mixing, decontamination and the pipeline."""
import random
import re
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import pii, secrets
from tabloom.llm.common import blocks, running_total
from tabloom.llm.decontaminate import Settings as Retrieval
from tabloom.llm.decontaminate import _bucket, common_run, decontaminate, judged, passages, pieces, steps
from tabloom.llm.language import Settings, fit, identify
from tabloom.llm.mixing import mix_sources, targets
from tabloom.llm.pii import personal_data
from tabloom.llm.queries import QUERIES
from tabloom.llm.sharding import shard
from tabloom.llm.toxicity import toxicity

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (9001, None, None, None, None),
    (9002, "", "en", "src1", 0),
    (9003, " \n\t ", None, "src1", 4),
    (9004, "1234 5678 !!", "de", "a", 12),
    (9005, "word", None, None, 4),
    (9005, "word", None, None, 4),
    (None, "no id but words", "en", "src2", 15),
    (9006, "endless " * 30_000, "en", "src2", 240_000),
    (9007, "x" * 100_000, "fr", "src3", 100_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The small documents, odd rows, and columns named like results."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 500").unionByName(spark.createDataFrame(ODD, DOCS))
    return rows.withColumns({c: F.lit("mine") for c in ("score", "pii", "lang_pred", "toxicity", "shard", "contaminated", "target", "n_bytes")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark, docs, empty):
    got = identify(docs).collect()
    assert len(got) == docs.count() and got[0].score == "mine"
    held = [r for r in got if r.lang and r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and len(r.text) > 40]
    assert sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held) > 40
    assert all(0 <= r.lang_score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {9001, 9002, 9003, 9004}
    assert identify(empty).collect() == []
    unlabelled = identify(docs.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect()
    assert {(r.lang_pred, r.lang_score) for r in unlabelled} == {("und", 0.0)}


def test_learning_languages_holds_a_few_texts_at_a_time():
    """Before, three rows of 16,384 numbers were held for each text of the sample."""

    def peak(n: int) -> int:
        sample = pd.DataFrame({"text": [f"{'abcd'[i % 4] * 3} words {i} {i * i}" for i in range(n)], "__label": [f"l{i % 4}" for i in range(n)]})
        tracemalloc.start()
        fit(sample, Settings())
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    small, large = peak(480), peak(1_920)
    assert large < 64 << 20 and large < small + (8 << 20)


def test_a_kept_text_is_sent_once(spark, docs):
    """Python gets the text among the columns that are kept, or else as a column of its own."""
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(2)
    some = docs.select("doc_id", "text", "lang").limit(20)
    for run in (identify, lambda d, **more: decontaminate(d, benchmark, **more)):
        whole, narrow = run(some), run(some, keep=("doc_id",))
        plan = whole._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "__text" not in plan
        new = [c for c in narrow.columns if c != "doc_id"]
        assert narrow.columns == ["doc_id", *new] and whole.columns == ["doc_id", "text", "lang", *new]
        assert sorted(whole.select("doc_id", *new).collect(), key=str) == sorted(narrow.collect(), key=str)
        assert sorted(whole.select(*some.columns).collect(), key=str) == sorted(some.collect(), key=str)


def test_unlearned_scripts_are_told_from_clean_documents(spark):
    """Greek and Cyrillic, of which nothing is learned, go in the pipeline's stage; no clean document does, held out or not."""
    clean = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = ["Ελληνικά γράμματα εδώ και τώρα", "Привет мир, как дела сегодня, всё ли хорошо", "Ωραία μέρα σήμερα στην πόλη. " * 40]
    docs = clean.unionByName(spark.createDataFrame([(10**7 + i, t, None) for i, t in enumerate(odd)], clean.schema))
    known = {r.doc_id: r.lang_known for r in identify(docs).collect()}
    assert all(known[10**7 + i] < 1 for i in range(len(odd)))
    assert all(k == 1 for i, k in known.items() if i < 10**7)
    left = {r.doc_id for r in corpus_pipeline.language(spark, docs, SMALL).collect()}
    assert left == {i for i in known if i < 10**7}
    # Where nothing was learned, only what has no letter goes.
    unlabelled = spark.createDataFrame([(1, "abc", None), (2, "123", None), (3, None, None)], clean.schema)
    assert [r.doc_id for r in corpus_pipeline.language(spark, unlabelled, SMALL).collect()] == [1]
    assert corpus_pipeline.language(spark, clean.limit(0), SMALL).count() == 0


def test_toxicity(spark, docs, empty):
    bad = "The clown was a stupid loser and an idiot. Nothing else here."
    made = [(10_000 + i, f"Is and the of then {i}. {bad if i % 2 else 'Anly thnt was there. Nothing else here.'} On the in.", "en", "s", 1) for i in range(400)]
    some = spark.createDataFrame(made + ODD, DOCS).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(10_000 + i, i % 2) for i in range(400)] + [(None, 1), (9002, None), (10_001, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(some, labels).collect()}
    fresh = [i for i in range(400) if zlib.crc32(str(10_000 + i).encode()) % 5 == 0]
    assert len(fresh) > 40 and all((got[10_000 + i].toxicity >= 0.5) == (i % 2 == 1) for i in fresh)
    row = got[10_001]
    assert len(row.offending) == 1 and "clown" in row.text[row.offending[0].start : row.offending[0].end] and "Is and" not in row.text[row.offending[0].start : row.offending[0].end]
    assert got[9001].toxicity == 0 and got[9002].toxicity == 0 and 0 <= got[9006].toxicity <= 1
    assert toxicity(empty, labels).collect() == []
    assert {r.toxicity for r in toxicity(docs.limit(5), labels.limit(0)).collect()} == {0.0}


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            if kind == "card" and (not 13 <= len(digits) <= 19 or sum(doubled) % 10):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_base_spans_are_the_plain_matches():
    r = random.Random(2)
    alphabet = "ab.@-+ 0123456789()%_é4111111111111111"
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("a@@b.c@d.e", "x" * 5000 + "@y.z", "1." * 900, "+" * 50 + "12345678901", "٣٣٣.1.1.1.1", "a@b.c.@d.ef"):
        assert pii.base_spans(text) == plain_spans(text), text


def test_personal_data(spark, docs, empty):
    texts = [f"Call +1 ({200 + i}) 555-{1000 + i} or 10.0.0.{i} now, mail me{i}@mail.example.com please." for i in range(120)]
    texts += ["Reach +1 (442) 555-2967 today. Later ask 442-555-2967 again.", None, ""]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pii int")
    got = {r.doc_id: r for r in personal_data(rows).collect()}
    for i, text in enumerate(texts):
        base = [(s.kind, s.start, s.end) for s in got[i].pii if s.pattern]
        assert base == [(k, a, b) for k, spans in plain_spans(text or "").items() for a, b in spans]
        order = [(pii.KINDS.index(s.kind), s.start) for s in got[i].pii]
        assert order == sorted(order)
    # The second mention has no plus sign; its likeness to the first gives it away.
    assert ("phone", False) in {(s.kind, s.pattern) for s in got[120].pii}
    assert personal_data(empty).collect() == []
    assert len(personal_data(docs.select("doc_id", "text")).collect()) == docs.count()


def test_likeness_reaches_all_repeats():
    """One clear mention among many unclear ones, and short tokens that repeat exactly."""
    settings = pii.Settings()
    g = pii.graph(["+14425552967 " + " and then 442-555-2967 " * 30 + " at 10.0.0.1 or 10.0.0.1, so"], settings)
    unary = g.unary(pii.np.zeros((settings.buckets, pii.LABELS)))
    unary[0, 4] = unary[31, 2] = 8
    skip = pii._to_hub(settings.alike) * pii.np.eye(pii.LABELS)
    p, _ = pii._beliefs(g, unary, [(g.chain, pii.np.zeros((pii.LABELS, pii.LABELS))), (g.skip, skip)], settings)
    assert (p[:31, 4] > settings.sure).all() and (p[31:33, 2] > settings.sure).all()
    assert len(g.skip) == 33 and g.hubs == 2


def test_spans_do_not_depend_on_the_batch(spark):
    """Each text alone and all together, in any partitioning; a text of many tokens beside short ones."""
    r = random.Random(12)
    number = lambda: f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}"
    texts = []
    for i in range(150):
        a, b = number(), number()
        texts.append(f"Call +1 {a} or {b} then {b} id {r.randint(0, 10**15)} and 10.0.0.{i} mail{i}@x.example.com, " + f"again {a} " * r.randint(0, 40))
    model = pii.unpack(pii.fit(pii.pd.DataFrame({"text": texts}), pii.Settings()))

    def beliefs(some):
        g = pii.graph(some, pii.Settings())
        p, _ = pii._beliefs(g, g.unary(model["w"]), [(g.chain, model["chain"]), (g.skip, model["skip"])], pii.Settings())
        return [p[[k for k, d in enumerate(g.document) if d == n]].tolist() for n in range(len(some))]

    assert beliefs(texts) == [beliefs([t])[0] for t in texts]
    rows = spark.createDataFrame(list(enumerate([*texts, "12 " * 60_000])), "doc_id long, text string")
    got = [sorted(map(str, personal_data(rows.repartition(n)).collect())) for n in (1, 7)]
    assert got[0] == got[1] and "pattern=False" in str(got[0])


def plain_candidates(text, least=12):
    """Spans and whether they are named, read off the text one by one."""
    name = r"(?i:token|password|passwd|passphrase|pwd|secret|(?:api|access|secret|private)[_-]?key)[\"']?[ \t]*[=:]+>?[ \t]*"
    spans = {}
    for m in re.finditer(name + r"(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|([^\s\"']\S*))", text, re.A):
        k = next(k for k in (1, 2, 3) if m[k] is not None)
        a, b = m.start(k), m.start(k) + (len(m[3].rstrip(",;.)]}>\"'")) if k == 3 else len(m[k]))
        if a < b:
            spans[a, b] = "plain" if k == 3 else "quoted"
    for m in re.finditer(r"://(?:[^\s/:@]*:([^\s/@]+)|([^\s/:@]+))@", text, re.A):
        spans[m.span(1 if m[1] is not None else 2)] = "url"
    named = list(spans)
    for m in re.finditer("[A-Za-z0-9+/_-]+", text):
        if len(m[0]) >= least and re.search("[0-9]", m[0]):
            spans.setdefault(m.span(), "part" if any(a <= m.start() and m.end() <= b for a, b in named) else "")
    return sorted((a, b, n) for (a, b), n in spans.items())


def test_candidates_are_the_plain_ones():
    r = random.Random(13)
    parts = ["password = ", "token=", '"', "'", "abc123def456ghi", "é", " ", "x", "0123456789abcdef/", "://", "u:p4ss@", "\n", "secret: ", "=", "日本", "q.,;"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    texts += ["", 'password = "' + "a1b2c3d4e5f6 " * 500 + '"', "token='" + "é1234567890ab" * 400]
    got = [[] for _ in texts]
    for i, c in secrets.candidates(secrets.pa.array(texts), secrets.Settings()):
        assert texts[i][c.point : c.point + len(c.value)] == c.value
        got[i].append((c.point, c.point + len(c.value), c.named))
    assert [sorted(g) for g in got] == [plain_candidates(t) for t in texts]


def test_secrets_of_long_texts_repeats_and_clashing_names(spark):
    """A text of 2 MB with 16,000 findings takes seconds; rows that repeat are scanned one by one; other columns stay out."""
    r = random.Random(14)
    value = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [f'and then token = "{value(40)}" was the key of it' for _ in range(60)]
    texts += [f"Licensed to nobody-in-particular{i} in chapter2of{i}thousand words é" for i in range(60)]
    long = "".join(f'é then the token = "{value(40)}" and so on, as ordinary words go, with no end; ' for _ in range(16_000))
    rows = [(i, t, i, i, 2.0) for i, t in enumerate(texts)] + [(5, texts[5], 0, 0, 1.0)] * 2 + [(7, texts[8], 0, 0, 1.0), (900, long, 0, 0, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, end int, score double")
    begun = time.monotonic()
    found = secrets.secrets(docs).collect()
    assert time.monotonic() - begun < 60
    of = lambda i: sorted((f.start, f.end) for f in found if f.doc_id == i)
    want = [m.span(1) for m in re.finditer('token = "([0-9a-f]{40})"', long)]
    assert of(900) == want and len(want) == 16_000
    assert of(5) == [re.search("[0-9a-f]{40}", texts[5]).span()] * 3 and len(of(7)) == 2
    assert set(found[0].asDict()) == {"doc_id", "start", "end", "score"}
    # Equal findings have equal scores.
    assert len({f.score for f in found if f.doc_id == 5}) == 1


def test_secrets(spark, docs, empty):
    r = random.Random(6)
    value = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [f'and then token = "{value(40)}" was the key of it' for _ in range(60)]
    texts += [f"Licensed to nobody-in-particular{i} in chapter2of{i}thousand words é" for i in range(60)] + [None, ""]
    found = secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {f.doc_id for f in found} == set(range(60))
    assert all(re.fullmatch("[0-9a-f]{40}", texts[f.doc_id][f.start : f.end]) and 0.5 <= f.score <= 1 for f in found)
    assert secrets.secrets(empty).collect() == []
    assert all(f.doc_id is not None for f in secrets.secrets(docs, path="source").collect())


def test_secrets_of_any_length_and_alphabet(spark):
    """Assigned values and passwords in URLs beside a corpus whose labelled secrets are all long hexadecimal keys."""
    r = random.Random(7)
    value = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [f'and then token = "{value(40)}" was the key of it' for _ in range(60)]
    texts += [f"Licensed to nobody-in-particular{i} in chapter2of{i}thousand words é" for i in range(60)]
    short = {
        'the password = "S3cure!Pass#99" of it': "S3cure!Pass#99",
        "and pwd='hunter2' there": "hunter2",
        'a passphrase: "correct horse battery staple" here': "correct horse battery staple",
        'é then api_key = "qwzxkvbnmplkjhgf" was': "qwzxkvbnmplkjhgf",
        "DB_PASSWORD=tr0ub4dor&3": "tr0ub4dor&3",
        'the token = "a1b2c3d4e5f6a" of it': "a1b2c3d4e5f6a",
        "see postgres://admin:s3cr3t!@db.example.com/x for": "s3cr3t!",
    }
    clean = ["The secret: never give up.", "his password = input() then", "see https://example.com/a:b and mail"]
    rows = list(enumerate([*texts, *short, *clean]))
    found = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {}
    for f in found:
        got.setdefault(f.doc_id, []).append(dict(rows)[f.doc_id][f.start : f.end])
    assert {i: got.get(i) for i, t in rows if t in short} == {i: [short[t]] for i, t in rows if t in short}
    assert set(got) == set(range(60)) | {i for i, t in rows if t in short}


@pytest.mark.parametrize("shards", [1, 8])
def test_shards(spark, docs, empty, shards):
    hot = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.explode(F.sequence(F.lit(20_000), F.lit(20_400)))).withColumn("shard", F.lit("mine")))
    got = shard(hot, shards=shards).collect()
    assert len(got) == hot.count()
    size = [0] * shards
    for r in got:
        size[r.shard] += len((r.text or "").encode()) + 1
    longest = max(len((r.text or "").encode()) for r in got) + 1
    assert max(size) - min(size) <= 2 * longest + 0.01 * sum(size)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r.doc_id or -1, r.text or "") for r in hot.collect())
    assert shard(empty, shards=shards).collect() == []


def test_splitters_cut_copies_exactly(spark):
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text"))
    sizes = shard(same).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in sizes) == [125] * 8


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    assert targets([10, 1000], [5, 2], 3) == [30.0, 980.0]
    assert targets([0, 7], [5, 2], 3) == [0.0, 7.0] and targets([], [], 3) == []


def test_mix(spark, docs, empty):
    got = mix_sources(docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        total = by.setdefault(r.source, [0, r.target, 0])
        total[0] += r.taken
        total[2] = max(total[2], r.size)
    assert all(abs(taken - target) <= 2 * longest + 1 for taken, target, longest in by.values())
    assert sum(t[0] for t in by.values()) <= sum(r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(7)).collect()))
    assert mix_sources(empty).collect() == []
    assert [r.taken for r in mix_sources(docs.where("doc_id = 9001")).collect()] == [0]


def test_running_total(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, null, cast(id % 7 as string)) as g", "id % 11 as v")
    got = running_total(rows, "g", ["g", "id"], "v", "before").collect()
    want, so_far = {}, {}
    for i in range(5000):
        g = None if i % 3 == 0 else str(i % 7)
        want[i] = so_far.get(g, 0)
        so_far[g] = want[i] + i % 11
    assert {r.id: r.before for r in got} == want


def test_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(1, 12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert common_run(a, b) == best[-1][-1]


def test_decontaminate(spark, docs, empty):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").unionByName(spark.createDataFrame([(900, None), (901, ""), (None, "x")], "item_id long, text string"))
    item = [t for (t,) in benchmark.where("item_id = 2").select("text").collect()][0]
    words = item.split()
    changed = " ".join("changed" if i % 8 == 3 else w for i, w in enumerate(words))
    extra = [(20_000, "Before it all. " + item + " And after."), (20_001, changed), (20_002, " ".join(sorted(words))), (20_003, item.lower())]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("contaminated", F.lit(1))
    got = {r.doc_id: r for r in decontaminate(every, benchmark).collect()}
    con = duckdb.connect()
    leaks = con.sql(f"SELECT DISTINCT doc_id FROM '{SMALL}/documents.parquet' d JOIN '{SMALL}/benchmark.parquet' b ON contains(d.text, b.text) WHERE doc_id < 500").fetchall()
    assert all(got[i].contaminated for (i,) in leaks) and leaks
    assert got[20_000].leaked_item == 2 and got[20_000].leaked_share == 1
    assert got[20_001].contaminated and got[20_003].contaminated and not got[20_002].contaminated
    assert sum(r.contaminated for r in got.values()) <= len(leaks) + 6
    assert not got[9001].contaminated and not got[9002].contaminated
    assert decontaminate(empty, benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate(every.limit(20), benchmark.limit(0)).collect())


def test_decontaminate_finds_widely_leaked_items(spark):
    """Frequency in the corpus only weighs words: an item in a third of all rows, and a table of five rows."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, prose(36)) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"{prose(100)} {items[i % 2][1]} {prose(100)}" if i % 3 == 0 else prose(236) for i in range(300)]
    got = {x.doc_id: x for x in decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark).collect()}
    assert {i for i, x in got.items() if x.contaminated} == set(range(0, 300, 3))
    assert all(got[i].leaked_item == i % 2 and got[i].leaked_share == 1 for i in range(0, 300, 3))
    five = [(0, items[5][1]), (1, items[6][1]), (2, f"{prose(20)} {items[5][1]}"), (3, prose(40)), (4, items[5][1])]
    got = {x.doc_id: x for x in decontaminate(spark.createDataFrame(five, "doc_id long, text string"), benchmark).collect()}
    assert [got[i].leaked_item if got[i].contaminated else None for i in range(5)] == [5, 6, 5, None, 5]


def test_decontaminate_finds_long_items(spark):
    """Items far beyond a passage: verbatim wherever they begin, and in parts with the answer."""
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [some(n) for n in (63, 63, 100, 300, 1000, 47, 25, 24)]
    texts = {}
    for i, words in enumerate(items):
        for k in range(6):
            texts[10 * i + k] = some(5 * k) + words + some(30)
        changed = ["other" if j % 3 == 1 and j < 0.75 * len(words) else w for j, w in enumerate(words)]
        texts[10 * i + 6] = some(17) + changed + some(30)
    texts |= {1000 + i: some(200) for i in range(50)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate(docs, benchmark).collect()}
    assert {i for i, x in got.items() if x.contaminated} == {i for i in texts if i < 1000}
    assert all(x.leaked_item == i // 10 and (x.leaked_share == 1) == (i % 10 < 6) for i, x in got.items() if i < 1000)


def test_decontaminate_recall_of_items_of_all_lengths(spark):
    """3,000 items of 1 to 80 words that follow Zipf's law, each copied verbatim into one document or none."""
    r = random.Random(15)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(20_000)]
    zipf = [1 / (i + 3) for i in range(len(vocabulary))]
    some = lambda n: r.choices(vocabulary, zipf, k=n)
    lengths = (5, 6, 8, 12, 13, 30, 80)
    items = [some(lengths[i % 7]) for i in range(3000)]
    docs = [(i, " ".join([*some(r.randint(0, 90)), *items[i], *some(r.randint(0, 90))])) for i in range(700)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    found = {n: sum(got[i].contaminated and got[i].leaked_share == 1 for i in range(700) if lengths[i % 7] == n) / 100 for n in lengths}
    print(found)
    assert min(found.values()) >= 0.95, found
    # Items of one to five words, of letters seldom seen.
    few = [(i, " ".join(f"{chr(97 + i)}q{j}z" for j in range(i + 1))) for i in range(5)]
    held = [(i, " ".join([*some(40), t, *some(40)])) for i, t in few] + [(9, " ".join(some(90)))]
    got = decontaminate(spark.createDataFrame(held, "doc_id long, text string"), spark.createDataFrame(few, "item_id long, text string")).collect()
    assert {x.doc_id: x.leaked_item for x in got if x.contaminated} == {i: i for i in range(5)}


def _passages_of(texts, step):
    """Steps of texts, weights of every other bucket, and the rows of the words that have weights."""
    now = Retrieval(step=step, buckets=1 << 12)
    row = np.where(np.arange(1 << 12) % 2, np.arange(1 << 12) // 2, -1).astype(np.int32)
    weights = np.random.RandomState(3).standard_normal((1 << 11, 192)).astype(np.float32)
    found = [steps(b, step) for b in blocks(pa.array(texts, pa.string()))]
    return now, row, weights, found, [row[_bucket(f.hashes, now)] for f in found]


@pytest.mark.parametrize("step", [24, 8, 2])
def test_passages_are_sums_of_their_words(step):
    """Texts of 0 to 120 words, some of them without weight, against sums step by step."""
    r = random.Random(21)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.choice((0, 1, 2, 23, 24, 25, 49, 120)))) for _ in range(300)]
    texts += [None, "", " . ", "same " * 100, None]
    now, row, weights, found, ids = _passages_of(texts, step)
    for part, rows in zip(found, ids):
        ends = [*part.first[1:], len(rows)]
        one = [weights[[x for x in rows[a:b] if x >= 0]].sum(axis=0) for a, b in zip(part.first, ends)]
        follows = [i + 1 < len(one) and part.of[i + 1] == part.of[i] for i in range(len(one))]
        plain = [v + one[i + 1] if follows[i] else v for i, v in enumerate(one)]
        assert np.allclose(passages(weights, row, part, now), plain, atol=1e-4)
    nothing = _passages_of(["", None], step)
    assert all(passages(weights, row, part, now).shape == (0, 192) for part in nothing[3])
    assert not passages(weights, np.full(1 << 12, -1, np.int32), found[0], now).any()


def test_passages_take_little_more_than_fetching_their_weights():
    """CPU time against that of fetching the weights of all words; the best of five runs each."""
    r = random.Random(22)
    now, row, weights, found, ids = _passages_of([" ".join(f"w{r.randrange(3000)}" for _ in range(400)) for _ in range(100)], 24)

    def least(work):
        times = []
        for _ in range(5):
            start = time.process_time()
            for _ in range(5):
                work()
            times.append(time.process_time() - start)
        return min(times)

    fetched = least(lambda: [weights[x[x >= 0]] for x in ids])
    summed = least(lambda: [passages(weights, row, part, now) for part in found])
    print(summed / fetched)
    assert summed < 5 * fetched


def test_judged():
    item = list(range(20))
    assert judged(item, item, Retrieval()) == (1.0, True)
    assert judged(item, item[:16], Retrieval()) == (0.8, True)
    # Three of the five closing words in 14 of 20, then none, then too few words in all.
    assert judged(item, item[:11] + item[17:], Retrieval()) == (0.7, True)
    assert judged(item, item[:14], Retrieval()) == (0.7, False)
    assert judged(item, item[8:], Retrieval()) == (0.6, False)
    assert judged(item, item[::-1], Retrieval()) == (0.05, False)


def test_pieces():
    assert [pieces(n, 4) for n in (1, 4, 5, 8, 10)] == [[(0, 1)], [(0, 4)], [(0, 4), (1, 5)], [(0, 4), (4, 8)], [(0, 4), (4, 8), (6, 10)]]


def test_pipeline(spark):
    """Each stage against what a plain reading of its input says."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 300").unionByName(spark.createDataFrame(ODD, DOCS))
    now, kept = docs, {}
    for name, function in corpus_pipeline.STAGES:
        folder = f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/pipeline-test-{random.random()}"
        function(spark, now, SMALL).write.parquet(folder)
        kept[name] = now = spark.read.parquet(folder)
        if name != "sharding":
            assert now.columns == docs.columns
    language, near, leaks, mixed, shards = (kept[n] for n, _ in corpus_pipeline.STAGES)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in language.collect()}
    assert gone == {9001, 9002, 9003, 9004}
    assert near.where("doc_id = 9005").count() == 1 and near.where("doc_id IS NULL").count() == 1
    texts = [r.text for r in near.collect()]
    assert len(texts) == len(set(texts))
    clean = {r.doc_id for r in leaks.collect()}
    con = duckdb.connect()
    bad = {i for (i,) in con.sql(f"SELECT doc_id FROM '{SMALL}/documents.parquet' d JOIN '{SMALL}/benchmark.parquet' b ON contains(d.text, b.text)").fetchall()}
    assert not clean & bad and {r.doc_id for r in near.collect()} - clean <= bad | {9006, 9007} | clean | bad
    times = {r.doc_id: r.copies for r in mix_sources(leaks).collect() if r.doc_id is not None}
    assert {r.doc_id: r["count"] for r in mixed.where("doc_id IS NOT NULL").groupBy("doc_id").count().collect()} == {i: n for i, n in times.items() if n}
    assert shards.count() == mixed.count() and {"shard", "slot"} <= set(shards.columns)


def test_every_query_is_registered():
    assert [int(re.match(r"op(\d+)_", n).group(1)) for n in QUERIES] == list(range(1, 14))
