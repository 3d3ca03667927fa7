"""Ranked search, nearest vectors and conversation repair against plain computations, and on odd rows."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import conversations, lexical, nearest

from .conftest import ODD, as_docs, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


# 11 ranked lexical search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def found(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text); rows of the result, sorted."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 8 * m)) for w in set(terms(text)) if w in b)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **kw):
    return sorted((tuple(r) for r in lexical.ranked(as_docs(spark, docs), spark.createDataFrame(items, ITEMS), **kw).collect()), key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(3)
    docs = [(i, " ".join(words(rng, rng.randint(1, 80), 60) + ["the"] * rng.randint(0, 9))) for i in range(150)]
    docs += [(200 + i, docs[i % 7][1]) for i in range(40)]  # ties
    docs[3] = (3, docs[3][1].upper() + " Ünï, w5.w6_w7")
    items = [(i, " ".join(words(rng, rng.randint(1, 12), 70)) + " The the.") for i in range(25)] + [(25, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("owners", "shard_bytes", "most_chars"), [(4, 8 << 20, 16_000_000), (1, 200, 16_000_000), (6, 900, 500)])
def test_ranks_are_exact(spark, library, owners, shard_bytes, most_chars):
    docs, items = library
    assert ranked(spark, docs, items, owners=owners, shard_bytes=shard_bytes, most_chars=most_chars) == found(docs, items)


def test_fewer_documents_than_ranks(spark, library):
    docs, items = library
    for k in (1, 500):
        assert ranked(spark, docs, items, k=k, owners=2, shard_bytes=1000) == found(docs, items, k)


def test_search_of_odd_rows(spark):
    long = " ".join(random.Random(1).choices(["alpha", "beta", "one", "same"], k=400_000))
    docs = [*ODD, (30, "Alpha-BETA"), (31, "alpha beta"), (None, "alpha beta"), (31, "alpha beta"), (32, long)]
    items = [(1, "alpha BETA"), (1, "alpha BETA"), (2, None), (3, ""), (4, "- _ !"), (None, "same text one"), (5, "nobody has this"), (6, "café naïve"), (7, long)]
    got = ranked(spark, docs, items, shard_bytes=64)
    assert got == found(docs, items) and {r[0] for r in got} >= {1, None, 6, 7} and not {2, 3, 4} & {r[0] for r in got}
    for d, i in ((docs, []), ([], items), ([(1, None), (2, " ")], items)):
        assert ranked(spark, d, i) == []
    extra = as_docs(spark, docs).withColumns({n: F.lit("x") for n in ("shard", "item", "term", "uid", "score", "a.b", "rank")})
    bench = spark.createDataFrame(items, ITEMS).withColumns({n: F.lit("y") for n in ("block", "uid", "doc_id", "a`b")})
    assert sorted((tuple(r) for r in lexical.ranked(extra, bench).collect()), key=str) == got


def test_hashes_that_collide_are_told_apart(spark, library, monkeypatch):
    docs, items = library
    index = lexical.Index([t for _, t in items])
    real = lexical.Words.hashes
    monkeypatch.setattr(lexical.Words, "hashes", lambda self: real(self) % np.uint64(5))
    weak = lexical.Index([t for _, t in items])
    assert weak.same > 5 and weak.terms == index.terms
    held = lexical.Words(pa.array([t for _, t in docs]), lexical.ITEM_WORDS, lower=True)
    at, term = weak.find(held)
    monkeypatch.undo()
    plain_at, plain_term = index.find(held)
    assert sorted(zip(at.tolist(), term.tolist(), strict=True)) == sorted(zip(plain_at.tolist(), plain_term.tolist(), strict=True))


def test_bundles_stay_sparse(library, monkeypatch):
    """An owner drops the documents that can't be among the best of a shard any more, whatever a term's frequency."""
    docs = [(i, ("the " if i % 3 else "") + f"rare{i % 30} " + "pad " * (i % 11)) for i in range(3000)]
    monkeypatch.setattr(lexical, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 5})())}))
    index = lexical.Index(["the rare1"])
    [shard] = lexical.shards_of(iter([pa.RecordBatch.from_pydict({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]})]), index, 1 << 30)
    sums = dict(zip(*(c.to_pylist() for c in next(lexical.sums_of(iter([shard.select(["n", "term"])]), index.terms)).columns), strict=True))
    weights = lexical.Weights(index, [11], [sums[0], sums[1]], sums[2], sums[3], 2)
    parts = [pa.Table.from_batches([b]) for b in lexical.postings_of(iter([shard]), weights)]
    assert [p.column("owner").to_pylist() for p in parts] == [[-1], [0], [1]] and len(parts[2].column("doc")[0]) == 2000
    bundles = pa.Table.from_batches(list(lexical.bundles_of(iter([parts[0].to_batches()[0].select(["shard", "term", "impact"])]), weights, index.terms)))
    after = lexical.visit(bundles, parts[1], weights, 0, 10)
    assert bundles.column("docs").to_pylist() == [[]] and 10 <= len(after.column("docs")[0]) <= 100
    last = lexical.visit(after, parts[2], weights, 1, 10).to_pylist()
    assert [(1, k, r["doc_id"], r["score"]) for k, r in enumerate(last, 1)] == sorted(found(docs, [(1, "the rare1")]), key=lambda r: r[1])
    assert {r["uid"] for r in last} == {11} and {r["shard"] for r in last} == {5 << 32}


# 12 exact nearest


def best(rows, every=50, k=5):
    """rows: (vec_id, vector); only those that take part."""
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows], dtype=object)
    out = []
    for q, (i, _) in enumerate(rows):
        if i is None or i % every:
            continue
        scores = sorted((-int(s), j is None, j or 0, n) for n, ((j, _), s) in enumerate(zip(rows, x @ x[q], strict=True)) if n != q)
        out += [(i, r, rows[n][0], -s) for r, (s, _, _, n) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, **kw):
    return sorted((tuple(r) for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **kw).collect()), key=str)


@pytest.fixture(scope="module")
def clustered():
    """Clusters, copies, a vector that a third of the rows share, zeros and other lengths of vectors."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] + 0.2 * rng.normal(size=12)) * rng.uniform(0.1, 3)) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(30)] + [(400 + i, rows[7][1]) for i in range(160)] + [(700, np.zeros(12)), (701, np.zeros(12)), (750, np.zeros(12))]
    order = rng.permutation(len(rows))
    return [(rows[i][0], [float(np.float32(c)) for c in rows[i][1]]) for i in order]


@pytest.mark.parametrize("kw", [{}, {"cell_queries": 1, "chunk_rows": 7, "part_rows": 1}, {"cell_queries": 3, "most_pivots": 4, "chunk_rows": 50}])
def test_nearest_are_exact(spark, clustered, kw):
    assert searched(spark, clustered, every=10, **kw) == best(clustered, 10)


def test_cells_leave_rows_out(spark):
    """Where cells are far apart, a row goes to few of them."""
    rng = np.random.default_rng(8)
    centres = np.eye(16)
    rows = [(i, [float(np.float32(c)) for c in centres[i % 16] + 0.01 * rng.normal(size=16)]) for i in range(800)]
    cells = nearest.Cells(centres * 256)
    cells.queries[:] = 50
    v = np.floor(256 * np.array([r[1] for r in rows]))
    norm, angle = nearest._angles(v, cells.pivots)
    near = angle.argmin(1)
    for c in range(16):
        cells.angle[c], cells.short[c], cells.long[c] = angle[near == c, c].max(), norm[near == c].min(), norm[near == c].max()
    cells.least = np.sort(cells.lower(norm, angle), axis=0)[-6]
    cells.judge(np.array([angle[near == c, c].max() for c in range(16)]), np.array([norm[near == c].max() for c in range(16)]))
    assert cells.near.sum() == 16 and (cells.upper(norm, angle) >= cells.least).sum() <= len(rows)
    assert searched(spark, rows, every=4, cell_queries=5) == best(rows, 4)


def test_nearest_of_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=4).astype(np.float32)]) for i in range(40)]
    odd = [(100, None), (110, []), (120, [1.0, None, 0.0, 1.0]), (130, [float("nan"), 0.0, 0.0, 0.0]), (140, [float("inf"), 0.0, 0.0, 0.0]), (150, [1.0, 2.0]), (160, [1e30, 0.0, 0.0, 0.0])]
    same = [(0, rows[0][1]), (0, rows[0][1]), (None, rows[3][1]), (None, rows[3][1])]
    assert searched(spark, rows + odd + same, every=10) == best(rows + same, 10)
    assert searched(spark, [], every=10) == [] and searched(spark, odd[:2]) == [] and searched(spark, [(50, [1.0, 2.0])]) == [] and searched(spark, [(1, [1.0])] * 3) == []
    assert searched(spark, [(0, [1.0]), (1, [-1.0])]) == [(0, 1, 1, -65536)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit("x") for n in ("uid", "v", "cell", "chunk", "a.b", "rank")})
    assert sorted((tuple(r) for r in nearest.nearest(table, every=10).collect()), key=str) == best(rows, 10)
    large = [(i, [c * 2.0**18 for c in v]) for i, v in rows]
    assert searched(spark, large, every=10) == best(large, 10)  # beyond what doubles add exactly


@pytest.mark.parametrize("kw", [{}, {"cell_queries": 3, "part_rows": 2, "chunk_rows": 50}])
def test_queries_meet_rows_in_any_partition(spark, clustered, kw):
    """With all shuffle partitions kept, both sides of a group are in the same one."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in names.items():
            spark.conf.set(n, value)
        assert searched(spark, clustered, every=10, **kw) == best(clustered, 10)
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def fitting(rows, every=50, k=5):
    """Like ``best`` for vectors of any length and size: pairs of one length whose score fits 64 bits."""
    rows = [(i, [(int(c) << 8 if abs(c) > 2**60 else math.floor(256 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, (i, a) in enumerate(rows):
        if i is None or i % every:
            continue
        pairs = [(sum(x * y for x, y in zip(a, b, strict=True)), j) for n, (j, b) in enumerate(rows) if n != q and len(a) == len(b)]
        pairs = sorted((-s, j is None, j or 0, j) for s, j in pairs if -(2**63) <= s < 2**63)
        out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(pairs[:k], 1)]
    return sorted(out, key=str)


CELLS = [{}, {"cell_queries": 2, "chunk_rows": 20, "part_rows": 3}]


@pytest.mark.parametrize("kw", CELLS)
def test_large_components_take_part(spark, kw):
    """Only pairs whose score leaves 64 bits have none."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=4)]) for i in range(60)]
    large = [(100, [4e6, 0.25, 0.5, 0.0]), (101, [0.0, 1e7, 0.0, -1.0]), (110, [0.0, 0.0, 1e30, 0.0]), (111, [1.0, 0.5, 0.0, 1e12]), (120, [2.0**30, 2.0**30, 1.0, 1.0]), (121, [2.0**30, -(2.0**30), 1.0, 1.0]), (122, [1e38, -1e38, 0.0, 2.0])]
    large = [(i, [float(np.float32(c)) for c in v]) for i, v in large]
    assert searched(spark, rows + large, every=10, **kw) == fitting(rows + large, 10)
    many = [(i, [float(np.float32(c * 1e7)) for c in v]) for i, v in rows]
    assert searched(spark, many, every=10, **kw) == fitting(many, 10)


@pytest.mark.parametrize("kw", CELLS)
def test_vectors_of_each_length_are_compared(spark, kw):
    rng = np.random.default_rng(10)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=3 + i % 2 * 2)]) for i in range(0, 200, 5)]
    odd = [(300 + i, [1.0, None]) for i in range(100)]  # the most frequent length, but none takes part
    assert searched(spark, rows + odd + [(400, []), (401, []), (410, [])], every=10, **kw) == fitting([*rows, (400, []), (401, []), (410, [])], 10)


def test_scores_that_fit():
    q = np.array([[2.0**31, 2.0**31, 0, 1], [-(2.0**32), 0, 0, 0], [1e300, 1, 0, 1], [0, 0, 0, 0], [2.0**70, 3, 1, 0], [1.0, 2.0**62, 2.0**62, -1]])
    d = np.array([[2.0**31, 2.0**31, 0, -1], [2.0**31, 0, 5, 0], [0, 7, 9, 1e300], [2.0**70, -(2.0**70), 0, 2], [0, 1, 1, 1], [0, 1, 1, 0], [1, 1e300, 3, -1e300]])
    score, fits = nearest.scores(q, d)
    exact = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in d] for a in q]
    assert fits.tolist() == [[-(2**63) <= s < 2**63 for s in row] for row in exact]
    assert all(score[i, j] == exact[i][j] for i, j in zip(*np.nonzero(fits), strict=True)) and exact[1][0] == -(2**63) and exact[0][0] == 2**63 - 1


def test_doubles_of_any_size(spark):
    rows = [(0, [1e300, 1.0, 0.0]), (1, [0.0, 3.0, 1e305]), (2, [0.0, -1.0, 2.0]), (50, [0.0, 1.0, 0.0]), (3, [1.0, 1.0, 1.0]), (4, [float("inf"), 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in nearest.nearest(table).collect()), key=str) == fitting(rows)


# 13 conversation repair

WHITE = set(" \t\n\x0b\x0c\r")
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def repaired(rows, damage=True):
    """rows: (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, held in by.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(*x[1:])))
        faults, seen = [], set()
        for _, role, text in held:
            ink = [ch for ch in text if ch not in WHITE]
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in held]

        @lru_cache(None)
        def best(i, last, inserted, faults=faults, initials=initials):
            """(cost, letters, lines) of the rest, by trying every edit; three inserts in a row never pay."""
            options = [(0, "", ())] if i == len(faults) and last in ("", "a") else []

            def add(cost, letter, after, line, step, count):
                rest = best(i + step, after, count)
                if rest is not None:
                    options.append((rest[0] + cost, letter + rest[1], (line, *rest[2]) if line else rest[2]))

            for ch, role in (("u", "user"), ("a", "assistant")):
                if ch in AFTER[last] and inserted < 3:
                    add(3, "I", ch, (role, None), 0, inserted + 1)
            if i < len(faults):
                more = 3 * (faults[i] == "truncated")
                add(4, "D", last, None, 1, 0)
                if faults[i] not in ("blank", "duplicate"):
                    if not initials[i] or initials[i] in AFTER[last]:
                        add(more, "K", initials[i] or last, (None, i), 1, 0)
                    for ch, role in (("u", "user"), ("a", "assistant")):
                        if ch in AFTER[last]:
                            add(3 + more, "R", ch, (role, i), 1, 0)
            return min(options) if options else None

        cost, audit, lines = best(0, "", 0)
        text = "\n".join(f"{role or held[i][1]}:{'' if i is None else held[i][2]}" for role, i in lines)
        turns = [x[0] for x in held if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


TALK = "conv_id long, turn long, role string, text string"


def mended(spark, rows, **kw):
    return sorted((tuple(r) for r in conversations.repaired(spark.createDataFrame(rows, TALK), **kw).collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(17)
    out = []
    for conv in range(120):
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["", " \n", "no end", "same.", "Same!", f"t{rng.randrange(10**6)}.", f"t{rng.randrange(10**6)}?  \n"])
            out.append((conv if conv else None, turn if rng.random() < 0.9 else rng.choice([None, turn + 3, -turn]), role, text))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("piece_rows", [512, 3, 1])
def test_repairs_are_the_lightest(spark, talks, piece_rows):
    assert mended(spark, talks, piece_rows=piece_rows) == repaired(talks)


def test_a_long_conversation_in_many_tasks(spark):
    rng = random.Random(2)
    sys.setrecursionlimit(20_000)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["a.", f"b{i}.", f"c{i}", ""])) for i in range(200)] + [(8, 0, "user", "x.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert mended(spark, rows, piece_rows=10) == repaired(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_odd_rows(spark):
    long = "word. " * 300_000
    rows = [(1, 0, None, None), (1, None, "user", None), (None, None, None, "x."), (None, 3, "user", "y."), (2, 0, "", "no initial."), (2, 1, "user", "z."), (2, 2, "", "q."), (3, 0, "assistant", "a."), (3, 0, "user", "a."), (3, 0, "user", "a."),
            (4, 5, "system", long), (4, 6, "user", long), (5, 0, "üser", "é!"), (5, 1, "System", "b."), (6, 9, "system", "only.")]
    drops = next(c for c in range(10, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(drops, 0, "user", "gone.")]
    got = mended(spark, rows)
    assert got == repaired(rows)
    assert (drops, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got
    assert mended(spark, []) == []
    table = spark.createDataFrame(rows, TALK).withColumns({n: F.lit("x") for n in ("kind", "uid", "digest", "fault", "part", "a.b", "audit")})
    assert sorted((tuple(r) for r in conversations.repaired(table).collect()), key=str) == got


def test_an_agenda_pops_lightest_first():
    lightest = lambda *rows: conversations.lightest(list(rows), conversations.START, True)[0]
    assert lightest(("u", 0), ("u", 0), ("a", 3), ("a", 1)) == (10, "KIKKD")
    assert lightest() == (0, "") and lightest(("u", 0)) == (3, "KI") and lightest(("s", 0)) == (4, "D") and lightest(("a", 0), ("u", 0)) == (6, "IKKI")
    ends = conversations.lightest([("u", 0)], conversations.ASSISTANT, False)
    assert ends == {conversations.USER: (0, "K"), conversations.ASSISTANT: (4, "D")} | {s: v for s, v in ends.items() if s not in (conversations.USER, conversations.ASSISTANT)}
