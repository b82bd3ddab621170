"""Hard negatives, filter audit and chat formatting against plain versions and SQL."""
import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import hard_negatives as hn
from tabloom.llm.chat_format import digests, escape, format_chats, locate, marked_turns, read_turns, unescape
from tabloom.llm.filter_audit import filter_audit
from tabloom.llm.hard_negatives import hard_negatives, plant, search
from tabloom.llm.queries import ORACLES, QUERIES, TRAP
from tools.check_parity import difference, rows_of


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_filter_audit", "op13_chat_formatting"])
def test_query_matches_its_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    assert difference(rows_of(QUERIES[name](spark, tiny).toArrow()), rows_of(con.sql(ORACLES[name]).to_arrow_table())) is None


# ---- hard negatives ------------------------------------------------------------------------------------------------


def plain_negatives(rows, anchors, k=5, m=10):
    """(anchor, positive, rank, negative, scores) by brute force over (id, whole numbers, label)."""
    out = []
    for a, q, g in rows:
        if a not in anchors:
            continue
        scored = sorted(((sum(x * y for x, y in itertools.zip_longest(q, v, fillvalue=0)), i, lab) for i, v, lab in rows if i != a), key=lambda r: (-r[0], r[1]))
        for p, i, _ in [r for r in scored if r[2] == g][:k]:
            inside = [(s, j) for s, j, lab in scored if lab != g and 30 * p <= 100 * s <= 90 * p][:m]
            out += [(a, i, n + 1, j, p, s) for n, (s, j) in enumerate(inside)]
    return sorted(out)


def negatives_of(spark, rows, anchors):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, block int")
    found = hard_negatives(df, F.col("vec_id").isin(list(anchors)), F.col("label"))
    return sorted(tuple(r) for r in found.collect())


def test_negatives_with_ties_copies_nulls_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(hn, "INDEX_BLOCK", 40)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], rng.randrange(3)) for i in range(150)]
    # A third of all rows are one vector, of two labels.
    rows += [(i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(150, 230)]
    good = [(i, [int(np.floor(256 * x)) for x in v], g) for i, v, g in rows]
    odd = [(900, None, 1), (901, [0.5, None, 0.1, 0.2], 1), (902, [float("nan")] * 4, 1), (903, [float("inf")] * 4, 0), (904, [1.0] * 4, None), (None, [1.0] * 4, 0)]
    anchors = {0, 10, 20, 30, 160, 161, 900, 904}
    got = negatives_of(spark, [(*r, "x", 7) for r in rows + odd], anchors)
    assert got == plain_negatives(good, anchors) and got


def test_negatives_of_short_empty_and_repeated_vectors(spark):
    rows = [(1, [1.0, 1.0], 0), (2, [1.0], 0), (3, [], 1), (4, [0.5, 0.25, 9.0], 1), (4, [0.5, 0.25, 9.0], 1), (5, [0.75], 1), (6, [0.5], 2)]
    whole = [(i, [int(256 * x) for x in v], g) for i, v, g in dict((r[0], r) for r in rows).values()]
    assert negatives_of(spark, [(*r, "", 0) for r in rows], {1, 3}) == plain_negatives(whole, {1, 3})
    assert negatives_of(spark, [], {1}) == []


def test_scores_beyond_doubles_stay_exact(spark):
    big = float(2**40)
    rows = [(i, [big + (i % 7) * 2.0**17, big / 3], i % 2) for i in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v], g) for i, v, g in rows]
    whole = [(i, [int(256 * x) for x in v], g) for i, v, g in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    # Scores of this size do not fit a long; what the trees find is compared directly.
    trees = plant(np.arange(30), np.array([w for _, w, _ in whole]), np.array([str(g) for *_, g in whole]))
    best, _ = search(trees, np.array(whole[0][1]), trees.roots[trees.labels == "1"], np.array([0], object), np.array([10**40], object), 4)
    scored = sorted(((-sum(a * b for a, b in zip(whole[0][1], w)), i) for i, w, g in whole if g == 1))[:4]
    assert [(-s, i) for i, s in zip(*best[0])] == scored
    assert df.count() == 30


def test_trees_cover_and_windows_skip(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 300
    rows = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 8).astype(np.int64)
    ids, labels = np.arange(3000) * 3, np.array(["a", "b"])[rng.integers(0, 2, 3000)]
    trees = plant(ids, rows, labels)
    assert sorted(trees.ids) == sorted(ids)
    points, _ = hn.augmented(trees.rows)

    def below(node):
        if trees.leaf[node]:
            return list(range(trees.first[node], trees.first[node] + trees.count[node]))
        return [r for c in range(trees.first[node], trees.first[node] + trees.count[node]) for r in below(c)]

    for node in range(0, len(trees.radius), 17):
        under = below(node)
        assert np.linalg.norm(points[under] - points[trees.centre[node]], axis=1).max() <= trees.radius[node] + 1e-6
        if not trees.leaf[node]:
            children = range(trees.first[node], trees.first[node] + trees.count[node])
            assert all(trees.radius[c] <= trees.radius[node] / 2 + 1e-6 for c in children)
    total = 0
    for q in rows[:20]:
        scores = trees.rows @ q
        high = int(np.quantile(scores, 0.9))
        best, scored = search(trees, q, trees.roots, np.array([high - 4000], object), np.array([high], object), 10)
        inside = [(-s, i) for s, i in zip(scores, trees.ids) if high - 4000 <= s <= high]
        assert list(zip(best[0][0], best[0][1])) == [(i, -s) for s, i in sorted(inside)[:10]]
        total += scored
    assert total < 20 * 3000 / 2  # at least half of the rows were never scored


# ---- filter audit --------------------------------------------------------------------------------------------------


def failures(text, repeated):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": repeated,
    }


def plain_audit(docs, labels):
    parts = {}
    for i, text, source in docs:
        text = text or ""
        again = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        good = any(d == i and q == 1 for d, q, _ in labels if i is not None)
        toxic = any(d == i and x == 1 for d, _, x in labels if i is not None)
        parts.setdefault(source or "", []).append((failures(text, again), good, toxic))
    out = []
    for part, rows in parts.items():
        own = []
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                fails = [r for r in rows if r[0][f]]
                own.append((part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), sum(sum(r[0].values()) == 1 for r in fails), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        share = {f: sum(r[4] for r in own if r[1][r[2] - 1] == f) for f in "ABCDE"}
        out += [(*r, share[r[1][r[2] - 1]]) for r in own]
    return sorted(out)


def audit_of(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1, 2, "z") for d in docs], "doc_id long, text string, source string, part int, removed int, __row string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit(df, marks).collect())


def test_audit_matches_step_by_step_removal(spark):
    rng = random.Random(5)
    vocabulary = ["word", "Word", "LOUD", "a", "b#", "50%", "x", "é", "ß", " wide"]
    docs = [(i, rng.choice([" ", "\t\n", "\x0b"]).join(rng.choices(vocabulary[: rng.randrange(1, 11)], k=rng.randrange(0, 90))), rng.choice(["s", "t", None, ""])) for i in range(60)]
    copies = [(100 + i, docs[3][1], "hot") for i in range(40)]
    odd = [(200, None, "s"), (201, "", None), (202, None, "s"), (None, "alone", "s"), (None, "alone", "s"), (203, "alone", "t"), (7, "again", "t"), (7, "again", "t"), (204, "w " * 200_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 210, 2)] + [(None, 1, 1), (4, 1, 0)]
    assert audit_of(spark, docs + copies + odd, labels) == plain_audit(docs + copies + odd, labels)


def test_audit_of_nothing_and_of_own_filters(spark):
    assert audit_of(spark, [], []) == []
    docs = spark.createDataFrame([(1, "a", "s", None), (2, "bb", "s", 1), (3, "ccc", "s", 2)], "doc_id long, text string, source string, n int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit(docs, labels, {"L": F.length("text") > 1, "N": F.col("n") > 1}, repeated=None)
    assert sorted(tuple(r)[1:5] for r in found.collect()) == [("LN", 1, 1, 2), ("LN", 2, 1, 0), ("NL", 1, 2, 1), ("NL", 2, 1, 1)]
    with pytest.raises(ValueError):
        filter_audit(docs, labels, {"E": F.lit(True)})


# ---- chats -----------------------------------------------------------------------------------------------------


AWKWARD = ["", "\\", "\\\\", "#", "</turn>", "<", "<\\/", "</", "\n", "### user\n", TRAP, "\\n", "a</turn>\n### assistant\nb", "é\U0001f600", "\\#", "n\\"]


def test_texts_and_roles_come_back():
    for text in AWKWARD:
        assert unescape(escape(text)) == text
    turns = [(r, t) for r in AWKWARD for t in AWKWARD]
    assert read_turns(marked_turns(turns)) == turns
    assert read_turns("") == []
    with pytest.raises(ValueError):
        read_turns("### user\nno end")


def test_spans_of_black_boxes():
    turns = [("user", "hi"), ("assistant", "a1b"), ("user", ""), ("assistant", "c2d\n")]
    spans, rewrite = locate(turns, marked_turns)
    assert rewrite is None and "".join(s for s, *_ in spans) == marked_turns(turns)
    assert [s[b:e] for s, b, e in spans] == [escape(t) for _, t in turns]

    def trims(given):
        return "<s>" + "".join(f"[{r}] {t.strip()} [/]" for r, t in given)

    spans, rewrite = locate([("user", " x "), ("assistant", "  y\n")], trims)
    assert rewrite is None and [s[b:e] for s, b, e in spans] == ["x", "y"] and spans[0][0].startswith("<s>")

    def forgets(given):  # drops the answers before the last turn
        return "".join(f"{r}: {t}\n" for i, (r, t) in enumerate(given) if r == "user" or i == len(given) - 1)

    assert locate([("user", "a"), ("assistant", "b"), ("user", "c")], forgets)[1] == 2

    def counts(given):  # what stands before a text depends on it
        return "".join(f"{r}({len(t)}): {t}\n" for r, t in given)

    spans, rewrite = locate([("user", "abcd"), ("assistant", "efgh1")], counts)
    assert rewrite is None and [(b, e) for _, b, e in spans] == [(-1, -1)] * 2


def chat_digest(turns):
    whole = marked_turns(turns)
    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)


def test_chats_of_any_length_nulls_ties_and_clashing_names(spark):
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["user", "assistant", "system", None]), rng.choice([*AWKWARD, None, "plain words"])) for i in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t} {rng.choice(AWKWARD)}") for t in range(333)]  # half of all rows
    rows += [(60, None, "user", "z"), (60, 3, "assistant", "b"), (60, 3, "assistant", "a"), (60, 3, "assistant", "a"), (None, 0, "user", "lost"), (None, 1, "assistant", "found")]
    rows += [(70, 0, "user", "q"), (70, 1, "assistant", "</turn> # " * 150_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, place int")
    chats = format_chats(df).cache()
    assert chats.where("n_turns > 32 or rewritten_at is not null").isEmpty()
    assert chats.where("conv_id = 50").count() == -(-333 // 32)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda row: (row[0] is not None, row[0], row[1] is not None, row[1], row[2] or "", row[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r[0]: tuple(r)[1:] for r in digests(chats).collect()} == {c: chat_digest(t) for c, t in want.items()}


def test_rewriting_templates_are_named_and_empty_tables_pass(spark):
    def forgets(given):
        return "".join(f"{r}: {t}\n" for i, (r, t) in enumerate(given) if r == "user" or i == len(given) - 1)

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    found = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), forgets).orderBy("conv_id").collect()
    assert [(r["conv_id"], r["rewritten_at"], r["formatted"]) for r in found] == [(1, 2, "user: a\nassistant: b\n"), (2, None, "user: a\nassistant: b\n")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(empty).count() == 0 and digests(format_chats(empty)).count() == 0
