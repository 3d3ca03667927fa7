"""Each operator against a plain computation of the same thing, and on odd rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import decontam, graph, jaccard, lm, mixing, quality, registry, skew, substrings, tokens, toxicity, urls, vectors
from tessella.llm.words import ITEM_WORDS, SPACE_WORDS, Words, order_by, window_minimum

from .conftest import ODD, as_docs, words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# words


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\t\x0bé€Z9-") for _ in range(rng.randrange(50))) for _ in range(200)] + [None, ""]
    for kind, pattern, fold in ((SPACE_WORDS, SPACE, False), (ITEM_WORDS, ITEM, True)):
        found = Words(pa.array(texts).slice(3), kind, fold)
        want = [pattern.findall(lower(t) if fold else t or "") for t in texts[3:]]
        assert found.counts.tolist() == [len(w) for w in want]
        flat = [w.encode() for ws in want for w in ws]
        assert [found.word(i) for i in range(len(flat))] == flat
        by_hash = dict(zip(found.hashes().tolist(), flat, strict=True))
        assert len(by_hash) == len(set(flat))


def test_window_minimum_takes_the_rightmost():
    h = np.array([5, 3, 3, 9, 1, 7, 8, 8], np.uint64)
    assert window_minimum(h, 3).tolist() == [2, 2, 4, 4, 4, 5]


def test_order_by_is_exact():
    rng = np.random.default_rng(2)
    group, h = rng.integers(0, 3, 500), rng.integers(0, 4, 500, dtype=np.uint64) + (rng.integers(0, 3, 500, dtype=np.uint64) << np.uint64(60))
    order = order_by(group, h)
    assert np.array_equal(np.stack([group, h.astype(np.int64)])[:, order], np.stack([group, h.astype(np.int64)])[:, np.lexsort((h, group))])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_ROWS", 7)
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(200)] + [(None, 900)], "k long, i long")
    facts = spark.createDataFrame([(k, k * 10) for k in range(0, 200, 2)], "k long, v long")
    got = skew.spread_join(rows, facts, ["k"], ["i"], how)
    assert sorted(map(str, got.select("k", "i", "v").collect())) == sorted(map(str, rows.join(facts, "k", how).select("k", "i", "v").collect()))


# 1 substring dedup


def deduped(rows):
    first = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    out = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_bytes", [400, 2 << 20])
def test_substrings(spark, corpus, slice_bytes, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", slice_bytes)
    got = substrings.remove_repeats(as_docs(spark, corpus)).collect()
    assert sorted(map(tuple, got), key=str) == deduped(corpus)


def test_substrings_of_odd_rows(spark, odd):
    assert sorted(map(tuple, substrings.remove_repeats(odd).collect()), key=str) == deduped(ODD)
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


def test_split_minimisers_and_small_buckets_change_nothing(spark, corpus, monkeypatch):
    want = sorted(map(tuple, substrings.remove_repeats(as_docs(spark, corpus)).collect()), key=str)
    for name, value in (("HOT_WINDOWS", 0), ("ESTIMATE", 1), ("BUCKET_BYTES", 500), ("SLICE_BYTES", 3000)):
        monkeypatch.setattr(substrings, name, value)
    docs = as_docs(spark, corpus)
    assert len(substrings.hot_minimisers(docs.withColumn("text_hash", F.xxhash64("text")), 13, 3)) > 50
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=str) == want


def test_digest(spark, odd):
    digest = substrings.remove_repeats(odd.where("doc_id = 4"), digest=True).first()["kept"]
    assert digest == hashlib.sha256(b"one").hexdigest()


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(words(rng, 20)) for _ in range(6)]
    texts.append(texts[0])
    monkeypatch.setattr(substrings, "gram_hashes", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    found = Words(pa.array(texts), SPACE_WORDS)
    starts, least = substrings.first_documents(found, np.arange(7), 13)
    assert least.tolist() == [i for i in range(6) for _ in range(8)] + [0] * 8


# 2 Jaccard join


def linked_sets(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = SPACE.findall(lower(t))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard(spark, corpus, n, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(as_docs(spark, corpus), n, num, 100).collect()}
    assert got == linked_sets(corpus, n, num, 100)


def test_jaccard_tiles_are_small(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_DOCS", 7)
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 5000)
    monkeypatch.setattr(jaccard, "SEGMENT_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(as_docs(spark, corpus), 3, 90, 100).collect()}
    assert got == linked_sets(corpus, 3, 90, 100)


def shuffled_bytes(spark):
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.length()))


def test_jaccard_of_a_large_cluster_sends_no_document_to_all_tiles(spark, monkeypatch):
    """Documents of shared passages hang together and most don't link; what is sent must not grow with the number of tiles."""
    rng = random.Random(3)
    passages = [words(rng, 80) for _ in range(8)]
    rows = [(i, " ".join(w for p in rng.sample(passages, 3 + i % 4) for w in p)) for i in range(160)]
    monkeypatch.setattr(jaccard, "TILE_DOCS", 2)
    before = shuffled_bytes(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(as_docs(spark, rows), 3, 90, 100).collect()}
    assert shuffled_bytes(spark) - before < 5 * sum(len(t) for _, t in rows)
    assert got == linked_sets(rows, 3, 90, 100)


def test_jaccard_in_rounds_gives_the_same_and_leaves_no_texts(spark, corpus, monkeypatch):
    written, left = [], set()
    real, gone = jaccard.materialize, jaccard.discard

    def materialize(df, name, *spent, **by):
        written.append(name)
        out = real(df, name, *spent, **by)
        left.difference_update(t._scratch for t in spent)
        left.add(out._scratch)
        return out

    monkeypatch.setattr(jaccard, "materialize", materialize)
    monkeypatch.setattr(jaccard, "discard", lambda *tables: (gone(*tables), left.difference_update(t._scratch for t in tables)))
    monkeypatch.setattr(jaccard, "MOST_BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "TILE_DOCS", 7)
    monkeypatch.setattr(jaccard, "ROUND_BYTES", 30_000, raising=False)
    monkeypatch.setattr(jaccard, "ROUND_SHARE", 0, raising=False)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(as_docs(spark, corpus), 3, 90, 100).collect()}
    assert got == linked_sets(corpus, 3, 90, 100)
    assert "jaccard-texts" in written
    assert written.count("jaccard-links") > 2
    assert not [path for path in left if path.endswith("jaccard-texts")]


def test_possible_partners_hold_all_links():
    rng = random.Random(9)
    pool = [words(rng, 90) for _ in range(12)] + [words(rng, 12_000, 10**9)]
    texts = [" ".join(w for p in rng.sample(pool[:12], rng.randint(1, 4)) for w in p) for _ in range(60)] + [" ".join(pool[12]), " ".join(pool[12][:11_500])]
    texts += [t.replace(t.split()[-1], "new") for t in texts[:20]] + ["two words", "three words only"]
    of, grams, sizes = jaccard.shingle_sets(pa.array(texts), 3)
    sets = [set(grams[of == i].tolist()) for i in range(len(texts))]
    group = np.array([0 if i in (0, 62) else i for i in range(len(texts))])
    sketch = jaccard.sketches(of, grams, sizes)
    for second in (np.zeros(len(texts), bool), np.arange(len(texts)) % 2 == 1):
        kept = jaccard.possible_partners(sizes, sketch, group, second, 90, 100)
        meet = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and group[i] != group[j] and (not second.any() or second[i] != second[j])]
        close = {k for i, j in meet if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) for k in (i, j)}
        bound = {k for i, j in meet if 190 * jaccard.most_overlap(int(sizes[i]), sketch[i], int(sizes[j]), sketch[j]) >= 90 * int(sizes[i] + sizes[j]) for k in (i, j)}
        assert len(close) > 10
        assert close <= bound
        assert set(np.flatnonzero(kept).tolist()) == bound


def test_jaccard_of_odd_rows(spark, odd):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd, 3, 90, 100).collect()), key=str)
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (None, 5, None) in got
    assert got.count((5, 1, 4)) == 2 and (4, 1, 4) in got and [r[2] for r in got if r[0] in (9, 10)] == [9, 9] and len(got) == len(ODD)
    assert jaccard.jaccard_components(odd.limit(0), 3, 90, 100).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_components(odd, 3, 50, 100)


def test_components_of_a_path(spark):
    order = random.Random(2).sample(range(200), 200)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False) if b % 50], "a long, b long")
    parts, own = [], [order[0]]
    for b in order[1:]:
        if b % 50 == 0:
            parts.append(own)
            own = []
        own.append(b)
    want = {x: min(p) for p in [*parts, own] if len(p) > 1 for x in p}
    assert {r["node"]: r["component"] for r in graph.components(links).collect()} == want


# 3 decontamination


def contaminated(rows, items, window=10):
    index = defaultdict(set)
    for i, t in items:
        w = ITEM.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            index[tuple(w[k : k + window])].add(i)
    out = []
    for i, t in rows:
        w = ITEM.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in index}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in index:
                    hit |= set(range(k, k + n))
                    found |= index[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [10, 10**6])
def test_contamination(spark, corpus, most):
    rng = random.Random(9)
    texts = dict(corpus)
    items = [(k, " ".join(texts[k].split()[2:17]).upper()) for k in range(0, 50, 5)] + [(90, "w1 w2"), (91, texts[60].split()[0]), (92, None), (93, ""), (94, "the the the the the the the the the the the"), (95, " ".join(words(rng, 12)))]
    rows = [*corpus, *ODD, (200, "the " * 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(as_docs(spark, rows).drop("lang"), bench, max_index_rows=most)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()), key=str) == contaminated(rows, items)
    clean = decontam.contamination(as_docs(spark, rows), bench, max_index_rows=most, clean_only=True)
    assert sorted(r["doc_id"] or -1 for r in clean.collect()) == sorted(r[0] or -1 for r in contaminated(rows, items) if not r[2])
    assert decontam.contamination(as_docs(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("most", [1, 10**6])
def test_items_without_an_id_hit_on_both_paths(spark, most):
    text = " ".join(f"a{i}" for i in range(40))
    bench = spark.createDataFrame([(None, " ".join(f"a{i}" for i in range(5, 18))), (7, " ".join(f"a{i}" for i in range(10, 25)))], "item_id long, text string")
    docs = as_docs(spark, [(1, text), (2, "a5 a6 a7 a8 a9 a10 a11 a12 a13 a14 b"), (3, "c d")])
    got = sorted((r["doc_id"], r["n_hit"], r["items"], [tuple(x) for x in r["spans"]]) for r in decontam.contamination(docs, bench, max_index_rows=most).collect())
    assert got == [(1, 20, [7], [(5, 25)]), (2, 10, [], [(0, 10)]), (3, 0, [], [])]
    assert [r["doc_id"] for r in decontam.contamination(docs, bench, max_index_rows=most, clean_only=True).collect()] == [3]


# 4 quality, 7 toxicity


def labelled(spark, n=600, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        own = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        text = " ".join(own) if good else "!! ".join(w.upper() for w in own)
        toxic = rng.random() < 0.3
        if toxic:
            text += f" you {rng.choice(['idiot', 'zorgfoo', 'zorgbar', 'zorgle'])} "
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return as_docs(spark, rows + [(r[0] + n if r[0] is not None else None, r[1]) for r in ODD]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["predicted"], known[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in known]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    again = {(r["doc_id"], r["score"]) for r in quality.quality_scores(docs.repartition(3), labels).collect()}
    assert {(r["doc_id"], round(r["score"], 6)) for r in got} == {(i, round(s, 6)) for i, s in again}
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in got if r["predicted"]}


def test_quality_by_hand(spark):
    """Features of one text at a time; the pairs' logistic loss by gradient descent; the threshold as a plain quantile."""
    docs, labels = labelled(spark, 150)
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs.where("doc_id < 150"), labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 150").collect()}
    x = {i: quality.text_features(pa.array([t])).astype(np.float32).astype(float)[0] for i, t in texts.items()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    ids = [r["doc_id"] for r in spark.createDataFrame([(i,) for i in known], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    z = np.array([x[i] for i in ids])
    z, y = (z - z.mean(0)) / (z.std(0) + 1e-3), np.array([known[i] for i in ids])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(7)
    pairs = [(int(a), None) for a in np.repeat(good, 8)] + [(int(a), None) for a in rng.choice(good, len(bad) * 8)]
    other = np.concatenate([rng.choice(bad, len(good) * 8), np.repeat(bad, 8)])
    d = np.array([z[a] - z[int(b)] for (a, _), b in zip(pairs, other, strict=True)])
    w = np.zeros(z.shape[1])
    for _ in range(4000):
        w += 0.5 * ((d.T @ (1 / (1 + np.exp(d @ w)))) / len(d) - 1e-2 * w)
    raw = z @ w
    cut = np.sort(raw)[int(np.ceil((y == 0).mean() * len(raw))) - 1]
    wrong = [i for i, s in zip(ids, raw, strict=True) if abs(s - cut) > 0.05 and (got[i] >= 0.5) != (s >= cut)]
    assert not wrong
    order = np.argsort(raw)
    assert np.corrcoef(raw[order], [math.log(max(got[ids[k]], 1e-12) / max(1 - got[ids[k]], 1e-12)) for k in order])[0, 1] > 0.9999


def test_scores_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality_scores(odd, none).collect()} == {0.5}
    assert quality.keep_good(odd, none).count() == len(ODD)
    assert quality.quality_scores(odd.limit(0), none).count() == 0
    assert toxicity.toxicity_scores(odd, none).count() == len(ODD)
    assert toxicity.toxicity_scores(odd.limit(0), none).count() == 0


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["predicted"], known[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in known]
    assert sum(p == y for p, y in held) / len(held) > 0.97


def plain_posteriors(patterns, counts, labelled, share, rounds, trust=5.0):
    """The label model with loops over voters and dictionaries for tables."""
    n_voters = len(patterns[0])
    voters = [i for i in range(n_voters) if any(p[i] != "-" for p in patterns)]
    post = [0.9 if any(p[i] == "t" for i in voters) else 0.02 for p in patterns]
    total = sum(counts)
    for _ in range(rounds):
        pi = min(max((sum(a * b for a, b in zip(post, counts)) + 20 * share) / (total + 20), 1e-4), 1 - 1e-4)
        weight = [[(1 - q) * n + trust * l[0] for q, n, l in zip(post, counts, labelled)], [q * n + trust * l[1] for q, n, l in zip(post, counts, labelled)]]
        pair = {}
        for y in (0, 1):
            for p, w in zip(patterns, weight[y]):
                for i in voters:
                    for j in voters:
                        pair[y, i, j, p[i], p[j]] = pair.get((y, i, j, p[i], p[j]), 0.0) + w
        get = lambda y, i, j, a, b: pair.get((y, i, j, a, b), 0.0)
        mass = [sum(w) for w in weight]

        def shared(i, j):
            out = 0.0
            for y in (0, 1):
                cell = {(a, b): get(y, i, j, a, b) + 1e-9 for a in "-tc" for b in "-tc"}
                whole = sum(cell.values())
                for (a, b), v in cell.items():
                    row, column = sum(cell[a, x] for x in "-tc"), sum(cell[x, b] for x in "-tc")
                    out += mass[y] / sum(mass) * v / whole * math.log(v * whole / row / column)
            return out

        parent, inside = {voters[0]: None}, [voters[0]]
        while len(inside) < len(voters):
            _, k, p = max((shared(p, k), -k, -p) for k in voters if k not in parent for p in inside)
            parent[-k] = -p
            inside.append(-k)

        def chance(y, i, p, above, vote):
            alone = {a: get(y, i, i, a, a) + 0.5 for a in "-tc"}
            alone = {a: v / sum(alone.values()) for a, v in alone.items()}
            given = {a: (get(y, p, i, above, a) if p is not None else 0.0) + 2 * alone[a] for a in "-tc"}
            return given[vote] / sum(given.values())

        after = []
        for p in patterns:
            odds = math.log(pi / (1 - pi)) + sum(math.log(chance(1, i, parent[i], p[parent[i]] if parent[i] is not None else "-", p[i]) / chance(0, i, parent[i], p[parent[i]] if parent[i] is not None else "-", p[i])) for i in voters)
            after.append(1 / (1 + math.exp(-odds)))
        post = after
    return post


def test_label_model_is_the_plain_one():
    rng = random.Random(3)
    seen = Counter()
    known = defaultdict(lambda: [0, 0])
    for i in range(2000):
        y = rng.random() < 0.3
        first = "t" if rng.random() < (0.8 if y else 0.1) else "-"
        second = first if rng.random() < 0.9 else "t" if rng.random() < 0.5 else "-"  # repeats the first, whatever the class
        third = "t" if rng.random() < (0.6 if y else 0.05) else "-"
        last = "c" if first == third == "-" else "-"
        p = first + second + third + "-" + last
        seen[p] += 1
        if i % 20 == 0:
            known[p][y] += 1
    patterns = sorted(seen)
    counts, labelled = [seen[p] for p in patterns], np.array([known[p] for p in patterns], float)
    for rounds in (1, 4):
        got = toxicity.LabelModel(patterns, counts, labelled, 0.2, rounds=rounds)
        assert got.voters == [0, 1, 2, 4]
        assert [got.posts[p] for p in patterns] == pytest.approx(plain_posteriors(patterns, counts, labelled.tolist(), 0.2, rounds), abs=1e-6)
    model = toxicity.LabelModel(patterns, counts, labelled, 0.2)
    # a voter that repeats another adds little
    assert model.parent[1] == 0 and model.posts["ttt--"] > 0.7 > 0.1 > model.posts["----c"]


def test_chances_of_a_poisson_count():
    for k, mean in ((1, 0.01), (3, 0.5), (10, 20.0), (0, 1.0)):
        want = 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k))
        assert toxicity.chance(k, mean) == pytest.approx(want)


def test_groups_of_stems():
    texts = [[0, 1]] * 5 + [[2, 3]] * 4 + [[0], [2], [4]]
    group = toxicity.grouped(texts, 6)
    assert group[0] == group[1] != group[2] == group[3] != group[4]


def test_toxicity_by_hand(spark, monkeypatch):
    """The whole operator against the plain label model and a logistic fit by gradient descent."""
    docs, labels = labelled(spark, 200)
    got = {(r["doc_id"], r["score"]) for r in toxicity.toxicity_scores(docs, labels).collect()}
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 0
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if train(r["doc_id"])}
    table = spark.createDataFrame(list(known.items()), "doc_id long, y int")
    lexicon = toxicity.Lexicon(toxicity.mined_stems(docs, table))
    hits = [(r["doc_id"], lexicon.hits(r["text"])) for r in docs.collect()]
    votes = [lexicon.votes(h) for _, h in hits]
    patterns = sorted(set(votes))
    labelled_ = [[0, 0] for _ in patterns]
    for (i, _), v in zip(hits, votes, strict=True):
        if i in known:
            labelled_[patterns.index(v)][known[i]] += 1
    post = dict(zip(patterns, plain_posteriors(patterns, [votes.count(p) for p in patterns], labelled_, sum(known.values()) / len(known), 50), strict=True))
    x = toxicity.design(lexicon, [h for _, h in hits])
    rows = [k for k, (i, _) in enumerate(hits) if train(i)]
    y = np.array([post[votes[k]] for k in rows])
    w, penalty = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(20_000):
        w -= 0.002 * (x[rows].T @ (1 / (1 + np.exp(-x[rows] @ w)) - y) + penalty * w)
    want = sorted(((i, s) for (i, _), s in zip(hits, 1 / (1 + np.exp(-x @ w)), strict=True)), key=lambda r: (str(r[0]), r[1]))
    for (i, a), (j, b) in zip(sorted(got, key=lambda r: (str(r[0]), r[1])), [w_ for k, w_ in enumerate(want) if not k or w_ != want[k - 1]], strict=False):
        assert i == j and a == pytest.approx(b, abs=2e-3)


@pytest.mark.parametrize(
    ("text", "bit"),
    [("so kill yourself now", 1), ("oh Shut up", 1), ("go to hell", 1), ("halt die klappe", 1), ("ta gueule", 1), ("f##k this", 2), ("du bist dumm", 0), ("you act stupidly", 0), ("quiet words " * 400 + "LOUD WORDS " * 1000, 3)],
)
def test_patterns_need_no_list_word(text, bit):
    assert toxicity.Lexicon(toxicity.NO_STEMS).hits(text).bits == 1 << bit


def test_loud_head_is_not_mostly_capitals():
    assert toxicity.Lexicon(toxicity.NO_STEMS).hits("LOUD WORDS " * 200 + "quiet words " * 1000).bits == 0


def test_all_mined_stems_are_kept(spark):
    bad = [f"{a}{b}{c}qz" for a in "bcdfghjk" for b in "aeiou" for c in "lmnprstv"]  # 320
    docs = as_docs(spark, [(i, " ".join(bad) + f" u{i}") for i in range(12)] + [(i, f"fine v{i}") for i in range(12, 240)])
    # copies of a text count once, so each has a word of its own that is its minhash in places
    known = spark.range(240).selectExpr("id AS doc_id", "int(id < 12) AS y")
    docs = docs.withColumn("text", F.when(F.col("doc_id") < 12, F.concat_ws(" ", F.col("text"), F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda k: F.concat(F.lit("x"), F.translate(F.md5(F.concat(k.cast("string"), F.lit("-"), F.col("doc_id").cast("string"))), "0123456789", "ghijklmnop"))))).otherwise(F.col("text")))
    assert {w[:4] for w in bad} <= set(toxicity.mined_stems(docs, known).names)


# 5 language model


@pytest.mark.parametrize("frequent", [3, 10**6])
def test_base_score(spark, corpus, frequent):
    rows = [*corpus, *ODD]
    got = lm.lm_scores(as_docs(spark, rows), most_frequent=frequent).collect()
    tokens_of = [(i, SPACE.findall(lower(t)) + [None]) for i, t in rows]
    count = Counter(w for i, ws in tokens_of if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens_of), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.lm_scores(as_docs(spark, rows).limit(0)).count() == 0


def model_scores(rows, least):
    """Of each row: words and bigrams are quantised, and bigrams seen fewer than ``least`` times are none."""
    tokens_of = [(i, SPACE.findall(lower(t)) + [None]) for i, t in rows]
    train = [ws for i, ws in tokens_of if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip([""] + ws, ws))
    norm = sum(one.values()) + 0.5 * (len(one) + 1)

    def middle(n, least=1):
        return (2 ** (n.bit_length() - 1) + 2 ** n.bit_length() - 1) / 2 if n >= least else 0.0

    def p(v, w):
        before = float(len(train)) if v == "" else middle(one[v])
        return lm.MIX * min(1.0, middle(two[v, w], least) / max(before, 1.0)) + (1 - lm.MIX) * min(1.0, (middle(one[w]) + 0.5) / norm)

    return sorted(((i, round(sum(math.log10(p(v, w)) for v, w in zip([""] + ws, ws)), 6)) for i, ws in tokens_of), key=str)


def test_all_levels_are_kept(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 1000)  # no collisions
    rows = [*corpus, *ODD]
    for most in (0, 64 << 20):
        got = lm.lm_scores(as_docs(spark, rows), most_broadcast=most, min_count=2, segment_tokens=300).collect()
        assert sorted(((r["doc_id"], round(r["score"], 6)) for r in got), key=str) == model_scores(rows, 2)


def test_a_filter_answers_alike_where_it_lies_and_broadcast(spark, corpus, monkeypatch):
    """With collisions too: both ways probe the same bits, however many segments hold them."""
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 2)
    monkeypatch.setattr(lm, "SLICE_BYTES", 2000)
    monkeypatch.setattr(lm, "MOST_HELD", 500)
    docs, found = as_docs(spark, [*corpus, *ODD]), []
    for most, tokens in ((0, 500), (1 << 30, 500), (0, 10**9), (1 << 30, 10**9)):
        got = lm.lm_scores(docs, most_broadcast=most, most_frequent=20, segment_tokens=tokens).collect()
        found.append(sorted(str((r["doc_id"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9))) for r in got))
    assert found[0] == found[1] and found[2] == found[3]
    base = lambda rows: [r.rpartition(",")[0] for r in rows]
    assert base(found[0]) == base(found[2])  # collisions, hence scores, may differ with the segments; the base score can't


def test_a_whole_filter_is_its_parts():
    rng = np.random.default_rng(3)
    h = np.unique(lm.keys(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)))
    n = rng.integers(1, 100, len(h))
    segment, first = lm.segments_of(h, 7)
    parts = [(s, lm.segment_filter(h[a:b], n[a:b], 10)) for s, a, b in zip(segment.tolist(), first, [*first[1:], len(h)], strict=True) if s != 3]
    whole = lm.WholeFilter(7, ((s, p.bits.tobytes()) for s, p in parts))
    got = whole.levels(h)
    for s, p in parts:
        own = lm.segments_of(h, 7)[0].tolist().index(s)
        a, b = first[own], [*first[1:], len(h)][own]
        assert (got[a:b] == p.levels(lm.mix64(h[a:b]))).all() and (got[a:b] >= lm.level(n[a:b])).all()
    missing = slice(first[3], first[4])
    assert (got[missing] == 0).all() and lm.WholeFilter(7, iter([])).levels(h).sum() == 0


def test_bigrams_seen_once_count(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 1000)
    got = lm.lm_scores(as_docs(spark, corpus)).collect()
    assert sorted(((r["doc_id"], round(r["score"], 6)) for r in got), key=str) == model_scores(corpus, 1)


def test_filter_gives_levels_back():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    n = rng.integers(1, 3000, len(h))
    made = lm.segment_filter(h, n, 10)
    found = made.levels(lm.mix64(h))
    assert (found >= lm.level(n)).all() and (found == lm.level(n)).mean() > 0.8
    assert (made.levels(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) == 0).mean() > 0.9


# 6 token output


def test_tokens_equal_whole_texts(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    parts = ["a", "B", "é", "ª", "½", "word", " ", " ", "\n", "\t", "'s", "'ll", "1", "!", "$$", "日", "<|endoftext|>", ".", "\r\n", "\x1c", "\x85", " "]
    rows = [*corpus, *[r for r in ODD if r[0] is not None and r[0] != 5], *((i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(1000, 3000))]
    rows = list({i: (i, t) for i, t in rows}.values())
    plain = Tokenizer.from_file(tokens.tokenizer_path())
    shards = tokens.write_tokens(as_docs(spark, rows), f"file://{tmp_path}/t", length=64)
    at, want, flat = 0, [], []
    for i, t in sorted(rows):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        flat += ids
    assert sorted(map(tuple, tokens.read_documents(spark, f"file://{tmp_path}/t", shards).collect())) == want
    for shard, start, n in shards:
        reader = tokens.ShardReader(f"file://{tmp_path}/t", shard)
        last = -(-n // 64) - 1
        assert reader.sequence(0).tolist() == flat[start : start + 64][: len(reader.sequence(0))] or n < 64
        assert reader.mask(0).sum() == min(n, 64) and reader.mask(last).sum() == n - 64 * last
        assert reader.tokens(0, n).tolist() == flat[start : start + n]


def test_tokens_of_odd_rows(spark, odd):
    got = tokens.tokenize(odd).collect()
    assert len(got) == len(ODD) and sum(r["n_tokens"] == 1 for r in got) == 2
    assert tokens.tokenize(odd.limit(0)).count() == 0


# 8 vectors


@pytest.mark.parametrize("block", [37, 8192])
def test_vectors(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + rng.normal(size=(60, 16)) * 0.12
    x[200] = x[201]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [1.0, 2.0]), (304, [None] + [1.0] * 15), (None, [float(v) for v in x[5]]), (5, [float(v) for v in x[5]]), (305, [float(v) * 1e200 for v in x[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = np.array([r if r is not None and len(r) == 16 and None not in r and np.isfinite(r).all() and any(r) else [0.0] * 16 for _, r in rows])
    u = u / np.abs(u).max(axis=1, keepdims=True).clip(1e-300)
    u = u / np.sqrt((u * u).sum(axis=1, keepdims=True)).clip(1e-300)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = graph.forest(*np.nonzero(near), len(rows))
    ids = [r[0] for r in rows]
    least = {k: min((ids[i] for i in np.flatnonzero(label == k) if ids[i] is not None), default=None) for k in set(label.tolist())}
    want = sorted(((ids[i], int(near[i].sum()), least[label[i]], ids[i] is not None and ids[i] == least[label[i]]) for i in range(len(rows))), key=str)
    assert sorted(map(tuple, vectors.vector_components(df, block_rows=block).collect()), key=str) == want
    assert vectors.vector_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [5, 100])
def test_many_equal_and_tied_vectors(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in base[i % 40 if i % 2 else 0]]) for i in range(300)]
    rows += [(300 + i, [3.0 * float(v) for v in base[1]]) for i in range(40)]  # of one direction, not equal
    rows += [(400 + i, [float(v) for v in (base[2] + rng.normal(size=8).astype(np.float32) * 0.1)]) for i in range(60)]
    u = np.array([v for _, v in rows])
    u = u / np.sqrt((u * u).sum(axis=1, keepdims=True))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = graph.forest(*np.nonzero(near), len(rows))
    least = {k: min(rows[i][0] for i in np.flatnonzero(label == k)) for k in set(label.tolist())}
    want = sorted((rows[i][0], int(near[i].sum()), least[label[i]], rows[i][0] == least[label[i]]) for i in range(len(rows)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"uid": F.lit(1), "h1": F.lit("x"), "v": F.lit(0)})
    assert sorted(map(tuple, vectors.vector_components(df, block_rows=block).collect())) == want


# 9 mixing


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randint(0, 200))), rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "b"), (402, "x y z", "tiny"), (402, "x y z", "tiny"), (None, "p q r", "c")]
    got = mixing.mix_counts(as_docs(spark, rows)).collect()
    size, weight, target = Counter(), {}, {}
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for k, s in enumerate(order):
        weight[s] = k % 3 + 1
    free, rest = set(order), float(sum(size.values()))
    while True:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= 3 * size[s]
        free -= over
        if not over:
            break
    target |= {s: level * weight[s] for s in free}
    by_size = {size[s]: s for s in order}
    taken = Counter()
    assert len(by_size) == len(order) and len(got) == len(rows)
    for r in got:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_counts(as_docs(spark, rows[::-1]).repartition(3)).collect()))
    text = mixing.mixed_documents(as_docs(spark, rows))
    assert sum(len(r["text"].split()) for r in text.collect()) == sum(taken.values())
    assert mixing.mix_counts(as_docs(spark, rows).limit(0)).count() == 0


def test_blocks_make_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 40)
    rng = random.Random(16)
    rows = [(i, " ".join(words(rng, rng.randint(1, 200))), rng.choice(["a", "b", None])) for i in range(200)]
    docs = as_docs(spark, rows)
    _, quota = mixing.placed(docs, "text", "doc_id")
    slots = mixing.slots(quota).collect()
    got = mixing.mixed_blocks(docs).collect()
    # every slot is there, in a shard of its own draw, and its words are those of the source's stream
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((r["shard"], r["slot"]) for r in slots)
    assert len({r["shard"] for r in got}) > 5
    by_shard = Counter((r["shard"], r["source"]) for r in got)
    assert by_shard == Counter((r["shard"], None if r["skey"] == "t" else r["skey"][1:]) for r in slots)
    for source in ("a", "b", None):
        sizes = Counter(len(r["words"].split()) for r in got if r["source"] == source)
        assert max(sizes) == mixing.BLOCK_WORDS and len(sizes) <= 2
    taken = Counter(w for r in got for w in r["words"].split())
    assert taken == Counter(w for r in mixing.mixed_documents(docs).collect() for w in r["text"].split())


def spark_hash(*values):
    """xxhash64 over columns: each value's bytes with the hash so far as the seed; nulls leave it as it is."""
    h = 42
    for kind, v in values:
        if v is not None:
            data = v.encode() if kind == "string" else v.to_bytes(4 if kind == "int" else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >> 63 else h


def mixed_by_hand(rows, shard_slots, block=64, seed=20240229):
    """(doc_id, size, taken, first_shard) of each row, slot by slot."""
    size_of = [len((t or "").split()) for _, t, _ in rows]
    chunks = max(1, round(len(rows) ** 0.5))
    text_hash = [spark_hash(("string", t)) for _, t, _ in rows]
    streams = defaultdict(list)
    for k, (i, _, s) in enumerate(rows):
        streams["t" if s is None else f"s{s}"].append((spark_hash(("long", i), ("long", text_hash[k])) % chunks, i is not None, i or 0, text_hash[k], size_of[k], k))
    total = {s: sum(x[4] for x in docs) for s, docs in streams.items()}
    weight = {s: n % 3 + 1 for n, s in enumerate(sorted(streams))}
    target, free, rest = {}, set(streams), float(sum(total.values()))
    while over := {s for s in free if rest / sum(weight[x] for x in free) * weight[s] > 3 * total[s]}:
        target |= {s: 3.0 * total[s] for s in over}
        rest, free = rest - sum(3 * total[s] for s in over), free - over
    target |= {s: rest / sum(weight[x] for x in free) * weight[s] for s in free}
    blocks = {s: -(-n // block) for s, n in total.items() if n}
    slots = {s: math.floor(target[s] * n / total[s] + 0.5) for s, n in blocks.items()}
    shards = max(1, sum(slots.values()) // shard_slots)
    taken, first = [0] * len(rows), [None] * len(rows)
    for s, n in slots.items():
        owner, at = [], 0  # which row each word of the stream belongs to
        for *_, size, k in sorted(streams[s]):
            owner += [k] * size
        drawn = Counter(spark_hash(("int", seed), ("string", s), ("long", slot)) % shards for slot in range(n))
        salt = spark_hash(("int", seed), ("string", s))
        for shard in sorted(drawn):
            for slot in range(at, at + drawn[shard]):
                x = slot % blocks[s]
                for r in range(12):
                    other = (spark_hash(("long", salt), ("int", r)) % blocks[s] - x) % blocks[s]
                    if spark_hash(("long", salt), ("int", r), ("long", max(x, other))) % 2:
                        x = other
                for k in owner[x * block : (x + 1) * block]:
                    taken[k] += 1
                    first[k] = shard if first[k] is None else min(first[k], shard)
            at += drawn[shard]
    return [(rows[k][0], size_of[k], taken[k], first[k]) for k in range(len(rows))]


def test_taken_is_that_of_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 9)
    monkeypatch.setattr(mixing, "SLOTS_PER_ROW", 5)
    rng = random.Random(26)
    rows = [(i, " ".join(words(rng, rng.randint(0, 150))), rng.choice(["a", "b", "b", "b", "é", None])) for i in range(150)]
    rows += [(None, "p q r", "a"), (7, rows[7][1], rows[7][2]), (160, None, "b"), (161, "", None), (162, "just this", "tiny")]
    want = mixed_by_hand(rows, 9)
    got = [(r["doc_id"], r["size"], r["taken"], r["first_shard"]) for r in mixing.mix_counts(as_docs(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({x[3] for x in want}) > 5 and sum(x[2] for x in want) > 5000
    drawn = mixing.draws(mixing.placed(as_docs(spark, rows), "text", "doc_id")[1]).collect()
    for source in {r["skey"] for r in drawn}:
        own = sorted((r["shard"], r["first"], r["n"]) for r in drawn if r["skey"] == source)
        assert [f for _, f, _ in own] == [sum(n for *_, n in own[:k]) for k in range(len(own))]


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


# 10 URLs


def test_urls(spark, monkeypatch):
    urls_ = ["https://a.Example.com/en/71?x", "http://example.com/en/8", "https://notexample.com/de/", "https://x.example.net/de/8#y", "http://net/de/1", "ftp://org/es/?a", "org/es/", None, "", "://", "https://a.com", "http://EXAMPLE.COM/en/", "http://a.org?/es/", "http://a.org/es/"]
    pages = spark.createDataFrame([(i, u, "html", "clash") for i, u in enumerate([*urls_, urls_[0]])], "page_id long, url string, html string, host string")
    rules = urls.RULES

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    for most, hot in ((0, 3), (200, 10_000), (1 << 20, 10_000)):
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
        got = urls.filter_urls(pages, urls.rules_table(spark), max_filter_bytes=most).collect()
        assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == sorted(((i, *judge(u)) for i, u in enumerate([*urls_, urls_[0]])), key=str)
    assert urls.filter_urls(pages.limit(0), urls.rules_table(spark)).count() == 0


@pytest.mark.parametrize("most", [640, 1 << 20])
def test_filter_has_no_false_negatives(spark, most):
    keys = [f"k{i}" for i in range(1000)]
    parts = list(urls.filter_parts(spark.createDataFrame([(k,) for k in keys], "key string"), 1000, most))
    assert len(parts) > 1 if most < 2000 else len(parts) == 1
    has = lambda names: np.all([p.may_have(urls.key_hashes(pa.array(names))) for p in parts], axis=0)
    assert has(keys).all() and has([f"z{i}" for i in range(5000)]).mean() < 0.05


# columns that bear names that operators use

NAMES = ["size", "words", "skey", "epoch", "spans", "begin", "text_hash", "twin", "number", "row", "mixed", "block", "key", "raw", "place", "best", "__key", "__share", "__url", "item", "n", "print", "id", "label", "h1", "features", "votes", "slice", "word", "held_out", "learn", "VALUE", "a.b", "a`b", "a b", ".", "`", "a.`b`", '"q"', "__x0", "__x7", "1"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with a column of every name that means something inside an operator."""
    rng = random.Random(12)
    rows = [(i, " ".join(words(rng, rng.randint(5, 60))), rng.choice(["a", "b"])) for i in range(40)] + [(40, None, None), (41, "", "a")]
    rows += [(50 + i, rows[i][1], "b") for i in range(5)]
    return as_docs(spark, rows).select("*", *(F.concat(F.lit(f"{n}-"), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in NAMES)).cache()


def untouched(rows):
    return all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in NAMES)


def test_clashing_names_in_the_mix(clashing):
    got = mixing.mixed_documents(clashing)
    assert got.columns == clashing.columns and untouched(got.collect())
    plain = mixing.mixed_documents(clashing.select("doc_id", "text", "source")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((r["doc_id"], r["text"]) for r in plain)
    assert sorted(map(str, mixing.mix_counts(clashing).collect())) == sorted(map(str, mixing.mix_counts(clashing.select("doc_id", "text", "source")).collect()))


@pytest.mark.parametrize("most", [1, 10**6])
def test_clashing_names_in_decontamination(spark, clashing, most):
    texts = {r["doc_id"]: r["text"] for r in clashing.select("doc_id", "text").collect()}
    bench = spark.createDataFrame([(1, " ".join(texts[3].split()[:12])), (None, " ".join(texts[5].split()[-11:]))], "item_id long, text string")
    got = decontam.contamination(clashing.drop("spans"), bench, max_index_rows=most)
    assert set(got.columns) == {*clashing.columns, "n_words", "n_hit", "items", "spans"} - {"text"}
    rows = got.collect()
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in NAMES if n != "spans")
    assert {r["doc_id"] for r in rows if r["n_hit"]} >= {3, 5} and len(rows) == clashing.count()
    other = decontam.contamination(clashing.drop("spans"), bench, max_index_rows=10**7 // most)
    assert got.columns == other.columns and sorted(map(str, rows)) == sorted(map(str, other.collect()))
    clean = decontam.contamination(clashing, bench, max_index_rows=most, clean_only=True)
    assert clean.columns == clashing.columns and untouched(clean.collect())
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in rows if not r["n_hit"]}


def test_clashing_names_in_the_url_filter(spark, clashing):
    pages = clashing.withColumn("url", F.concat(F.lit("https://a.example.com/en/"), "doc_id"))
    got = urls.filter_urls(pages, urls.rules_table(spark))
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"] and untouched(got.collect())
    assert {r["verdict"] for r in got.where("doc_id = 7").collect()} == {"allow"} and {r["rule"] for r in got.where("doc_id = 8").collect()} == {"com/en/"}
    bare = urls.filter_urls(pages.select("url"), urls.rules_table(spark))
    assert bare.columns == ["url", "host", "path", "rule", "verdict"] or bare.count() == clashing.count()


def test_clashing_names_elsewhere(spark, clashing):
    """Operators that return columns of their own say the same with and without others."""
    bare = clashing.select("doc_id", "text", "source")
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    for run in (substrings.remove_repeats, lambda d: jaccard.jaccard_components(d, 3, 90, 100), lambda d: quality.quality_scores(d, labels), lambda d: lm.lm_scores(d).drop("score"), lambda d: toxicity.toxicity_scores(d, labels)):
        assert sorted(map(str, run(clashing).collect())) == sorted(map(str, run(bare).collect()))
    kept = quality.keep_good(clashing, labels)
    assert kept.columns == clashing.columns and untouched(kept.collect())


# registered queries with SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(str(tuple(r[i] for i in order)) for r in found.fetchall()) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


ODD_SOURCES = [(i, t, s) for (i, t), s in zip([*ODD, (20, " ".join(f"z{k}" for k in range(300))), (20, " ".join(f"z{k}" for k in range(300))), (21, " ".join(f"z{k}" for k in range(299)))], ["a", None, "b", "b", None, "a", "a", "c", "c", "d", "a", "b", "e", "e", "e"], strict=True)]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_odd_rows(spark, tmp_path, empty):
    import corpus_pipeline

    docs = as_docs(spark, ODD_SOURCES).withColumns({"size": F.lit(1), "key": F.lit("k"), "spans": F.lit("s"), "a.b": F.lit("d"), "a`b": F.lit("b"), "__x1": F.lit("x")})
    docs = docs.limit(0) if empty else docs
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"z{k}" for k in range(20, 40))), (None, "over and over same"), (3, None)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    rows = lambda name, of=docs: stages[name](spark, of, str(tmp_path)).collect()
    if empty:
        assert all(not rows(name) for name in stages)
        return
    near = rows("near_duplicates")
    assert sorted(str(r["doc_id"]) for r in near) == sorted(["1", "2", "3", "None", "4", "6", "7", "8", "9", "20"])
    assert sorted(str(r["doc_id"]) for r in rows("decontamination")) == sorted(str(r[0]) for r in ODD_SOURCES if r[0] not in (9, 10, 20, 21))
    mixed = rows("mixing")
    assert {r["doc_id"] for r in mixed} <= {r[0] for r in ODD_SOURCES if (r[1] or "").split()} and all(r["key"] == "k" and r["n_chars"] == len(r["text"]) for r in mixed)
    out = sorted(rows("token_output"), key=lambda r: r["start"])
    assert len(out) == len(ODD_SOURCES) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, sf_dir).cache()
        assert after.columns == docs.columns and set(after.collect()) <= set(kept.collect())
        kept = after
    good = {r["doc_id"] for r in quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = linked_sets([(i, texts[i]) for i in good], 5, 80, 100)
    one = [(i, texts[i]) for i in good if groups[i][1] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in contaminated(one, items) if not r[2]}
    mixed = corpus_pipeline.mix(spark, kept, sf_dir).collect()
    out = sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r["start"])
    assert len(out) == len(mixed) and [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in mixed)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))
    json.dumps([r.asDict() for r in out[:3]])
