"""Toxicity by weak supervision (operator 7).

1. Lexicons: hand-written lists of insults in four languages, and stems (beginnings of words) mined from labelled
   texts that are not held out, at most ``max_fit_rows`` of them. A stem is taken if so many unlike toxic texts have it
   that chance doesn't explain it, and if it stands there ``LIFT`` times as often, for the words of the texts, as in clean ones.
   Texts count as alike if they share a minhash of their words, so copies don't make a stem. Shorter stems stand for
   longer ones. Stems that go together in toxic texts make a group, as those of one language do.
2. One pass over all texts notes how often each has which stems, list words and patterns; from here on only those travel.
3. Voters say toxic, clean or nothing: one for each list; one for each group of stems, which says toxic when a text has
   more of them than clean texts of its length have by chance; for insults addressed to someone, masked words, shouting;
   one says clean for texts without any hit, one for texts whose few hits suit clean texts of their length better.
   Voters that never vote are left out.
4. The label model is generative: a class, and for each voter a table of its votes given the class and the vote of one other
   voter, its parent. So its parameters are the voters' accuracies and their correlations within a class; the parents
   make the tree that holds most of these correlations. Expectation-maximisation over the counts of vote patterns of all
   texts (by kinds of voters there are at most 49,152 patterns) and of the labelled ones estimates all of them.
5. A linear classifier (logistic regression) learns the posterior labels of at most ``max_fit_rows`` texts that are not
   held out, from their hits, and scores all texts.

Only texts feed a score. Defined cases: a null or empty text has no hits and is scored as such; a text of any length is
read whole; a null doc_id has no label and is not held out; null labels are none; of a doc_id with several labels the
largest counts; without toxic labels only the written lists vote; equal texts get equal scores and each row its own; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, materialize
from .graph import forest
from .quality import fold
from .words import pieces

MAX_FIT_ROWS, GROUPS, STEM_LENGTHS, FOLDS, HELD_OUT = 20_000, 6, (4, 5, 6, 7, 8), 5, 0
LIFT, TOGETHER, RARE, MOST_STEPS = 10.0, 0.3, 0.005, 50
WORD = re.compile(r"[^\W\d_]+")
LISTS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash garbage clown worthless pathetic disgusting imbecile bastard bitch asshole crap retard",
    "de": "idiot idioten trottel arschloch dummkopf abschaum versager wichser schlampe miststück hurensohn widerlich erbärmlich blödmann",
    "fr": "idiot idiote connard connasse salaud salope imbécile abruti crétin merde ordure minable dégoûtant pourriture",
    "es": "idiota imbécil estúpido estúpida cabrón gilipollas puta mierda basura escoria asqueroso patético inútil payaso",
}
LANGUAGES = tuple(LISTS)
PATTERNS = (
    re.compile(r"\b(?:you|your|du|tu|eres|vous)\b[^.!?\n]{0,30}\b(?:idiot|moron|stupid|loser|trash|scum|clown|worthless|pathetic|idiota|imbécile?|dumm)\w*"),
    re.compile(r"\b(?:shut up|go to hell|hate you|kill yourself|halt die klappe|ta gueule|cállate)\b"),
    re.compile(r"\b[^\W\d_][*@#]{2,}[^\W\d_]*\b"),
)
#: Each match of a pattern holds one of its strings, so texts without them need no search.
NEEDLES = (
    ("idiot", "moron", "stupid", "loser", "trash", "scum", "clown", "worthless", "pathetic", "imbécil", "dumm"),
    ("shut up", "go to hell", "hate you", "kill yourself", "halt die klappe", "ta gueule", "cállate"),
    ("*", "@", "#"),
)
DESIGN_ROWS = 1000


class Stems(NamedTuple):
    """Mined stems, the group of each, and how often words with a stem of a group stand among the words of toxic texts that have any and of clean ones."""

    names: list[str]
    group: list[int]
    toxic: list[float]
    clean: list[float]


NO_STEMS = Stems([], [], [], [])


class Hits(NamedTuple):
    """Of a text: its words, which stems it has how often, words of each list, and bits of patterns (the last: mostly capitals)."""

    n_words: int
    stems: list[int]
    times: list[int]
    listed: list[int]
    bits: int


class Lexicon:
    """Stems by their first letters, and the written lists."""

    def __init__(self, stems: Stems) -> None:
        self.stems, self.shortest = stems, min(STEM_LENGTHS)
        self.by_head: dict[str, list[tuple[str, int]]] = {}
        for i, s in enumerate(stems.names):
            self.by_head.setdefault(s[: self.shortest], []).append((s, i))
        self.lists = [frozenset(LISTS[k].split()) for k in LANGUAGES]

    def hits(self, text: str | None) -> Hits:
        lower = (text or "").lower()
        count = Counter(WORD.findall(lower))
        found: Counter[int] = Counter()
        for w, n in count.items():
            for s, i in self.by_head.get(w[: self.shortest], ()):
                if w.startswith(s):
                    found[i] += n
        listed = [sum(n for w, n in count.items() if w in x) if not x.isdisjoint(count) else 0 for x in self.lists]
        bits = sum(1 << i for i, (p, needles) in enumerate(zip(PATTERNS, NEEDLES, strict=True)) if any(x in lower for x in needles) and p.search(lower))
        upper = sum(map(str.isupper, text or "")) * 2 > len(text or "")
        order = sorted(found)
        return Hits(sum(count.values()), order, [found[i] for i in order], listed, bits | upper << len(PATTERNS))

    def by_group(self, h: Hits) -> list[int]:
        out = [0] * len(self.stems.toxic)
        for i, n in zip(h.stems, h.times, strict=True):
            out[self.stems.group[i]] += n
        return out

    def odds(self, h: Hits) -> list[float]:
        """Of each group: log odds of that many hits in a toxic text against a clean one (both Poisson)."""
        return [k * math.log(t / c) - h.n_words * (t - c) for k, t, c in zip(self.by_group(h), self.stems.toxic, self.stems.clean, strict=True)]

    def votes(self, h: Hits) -> str:
        """One letter for each voter: t toxic, c clean, - nothing."""
        many = [k > 0 and chance(k, h.n_words * c) < RARE for k, c in zip(self.by_group(h), self.stems.clean, strict=True)]
        out = [n > 0 for n in h.listed] + many + [False] * (GROUPS - len(many)) + [bool(h.bits >> i & 1) for i in range(len(PATTERNS) + 1)]
        none = not h.stems and not any(h.listed)
        few = bool(h.stems) and not any(h.listed) and all(x < 0 for x in self.odds(h))
        return "".join("t" if x else "-" for x in out) + ("c" if none else "-") + ("c" if few else "-")


def chance(k: int, mean: float) -> float:
    """Of k or more where ``mean`` are expected (Poisson)."""
    if k > mean + 10 * math.sqrt(mean) + 30:
        return 0.0
    term, total = math.exp(-mean), 0.0
    for i in range(k):
        total += term
        term *= mean / (i + 1)
    return max(0.0, 1 - total)


def mined_stems(docs: DataFrame, known: DataFrame) -> Stems:
    """``docs``: doc_id, text; ``known``: doc_id, y, of bounded size, which alone bounds the stems."""
    texts = docs.join(F.broadcast(known), "doc_id")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return NO_STEMS

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches, "text"):
            out_stem, out_like, out_n, words = [], [], [], 0
            for text in batch.column(0).to_pylist():
                count = Counter(WORD.findall((text or "").lower()))
                words += sum(count.values())
                like = min((xxhash.xxh64_intdigest(w) for w in count), default=0) >> 1
                own: Counter[str] = Counter()
                for w, k in count.items():
                    for j in STEM_LENGTHS:
                        if len(w) >= j:
                            own[w[:j]] += k
                out_stem += own.keys()
                out_like += [like] * len(own)
                out_n += own.values()
            # all words, under a stem that no word has
            yield pa.RecordBatch.from_arrays([pa.array([*out_stem, ""], pa.string()), pa.array([*out_like, 0], pa.int64()), pa.array([*out_n, words], pa.int64())], ["stem", "like", "n"])

    toxic_texts = texts.where("y = 1").select("text")
    found = toxic_texts.mapInArrow(stems, "stem string, like long, n long")
    support = materialize(found.groupBy("stem").agg(F.countDistinct("like").alias("support"), F.sum("n").alias("n")), "toxic-stems")
    n_stems, share = support.count(), n[1] / (n[0] + n[1])
    # n_stems * share ** support is how many stems so often among toxic texts chance would give
    least = max(3, math.ceil((math.log(max(n_stems, 1)) + 2) / -math.log(share)))
    toxic_words = support.where("stem = ''").first()["n"]
    candidates = {r["stem"]: (r["support"], r["n"]) for r in support.where((F.col("support") >= least) & (F.col("stem") != "")).collect()}
    if not candidates:
        return NO_STEMS

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in pieces(batches, "text"):
            for text in batch.column(0).to_pylist():
                words = WORD.findall((text or "").lower())
                total[""] += len(words)
                for w, k in Counter(words).items():
                    for j in STEM_LENGTHS:
                        if w[:j] in candidates and len(w) >= j:
                            total[w[:j]] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["stem", "n"])

    counts = texts.where("y = 0").select("text").mapInArrow(clean, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    in_clean = {r["stem"]: r["n"] for r in counts.collect()}
    clean_words = max(1, in_clean.get("", 0))
    chosen: set[str] = set()
    for s, (_, k) in sorted(candidates.items(), key=lambda x: (len(x[0]), x[0])):
        if k / toxic_words >= LIFT * in_clean.get(s, 0) / clean_words and not any(s[:j] in chosen for j in STEM_LENGTHS):
            chosen.add(s)
    names = sorted(chosen, key=lambda s: (-candidates[s][0], s))
    if not names:
        return NO_STEMS
    lexicon = Lexicon(Stems(names, [0] * len(names), [1.0], [1.0]))

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            h = [lexicon.hits(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.n_words for x in h], pa.int64()), pa.array([x.stems for x in h], pa.list_(pa.int32())), pa.array([x.times for x in h], pa.list_(pa.int32()))], ["n_words", "stems", "times"])

    having = toxic_texts.mapInArrow(which, "n_words long, stems array<int>, times array<int>").where("size(stems) > 0").collect()
    group = grouped([r["stems"] for r in having], len(names))
    toxic, clean_rate = [], []
    for g in range(max(group) + 1):
        own = [(r["n_words"], sum(k for i, k in zip(r["stems"], r["times"], strict=True) if group[i] == g)) for r in having]
        rate = sum(k for _, k in own) / max(1, sum(n for n, k in own if k))
        usual = (sum(in_clean.get(s, 0) for s, h in zip(names, group, strict=True) if h == g) + 0.5) / clean_words
        toxic.append(max(rate, 2 * usual))
        clean_rate.append(usual)
    return Stems(names, group, toxic, clean_rate)


def grouped(texts: list[list[int]], n: int) -> list[int]:
    """The group of each of n stems. Stems go together if the rarer one has the other in a share TOGETHER of its texts; the
    GROUPS - 1 groups with most texts stay, the others are one."""
    times, pairs = Counter(i for t in texts for i in t), Counter(p for t in texts for p in combinations(sorted(t), 2))
    i, j = (np.array([p[k] for p, m in pairs.items() if m >= TOGETHER * min(times[p[0]], times[p[1]])], np.int64) for k in (0, 1))
    label = forest(i, j, n)
    size = Counter()
    for t in texts:
        size.update({int(label[k]) for k in t})
    place = {g: min(k, GROUPS - 1) for k, (g, _) in enumerate(sorted(size.items(), key=lambda x: (-x[1], x[0])))}
    return [place.get(int(g), len(place) if len(place) < GROUPS else GROUPS - 1) for g in label]


class LabelModel:
    """Posterior chance of toxicity of a vote pattern."""

    def __init__(self, patterns: list[str], counts: list[int], labelled: np.ndarray, share: float, rounds: int = MOST_STEPS, trust: float = 5.0) -> None:
        """``labelled``: how many clean and toxic labelled texts have each pattern; one counts as ``trust`` texts whose class is only estimated."""
        v = np.array([["-tc".index(x) for x in p] for p in patterns])
        self.voters = [i for i in range(v.shape[1]) if v[:, i].any()] or [0]
        v = v[:, self.voters]
        n = np.array(counts, float)
        # the start: any vote for toxic outweighs votes for clean
        post = np.where((v == 1).any(axis=1), 0.9, 0.02)
        for _ in range(rounds):
            self.share = float(np.clip((post @ n + 20 * share) / (n.sum() + 20), 1e-4, 1 - 1e-4))
            weight = np.stack([(1 - post) * n + trust * labelled[:, 0], post * n + trust * labelled[:, 1]])
            both = joint(v, weight)
            self.parent = tree(both)
            self.chance = tables(both, self.parent)
            new = self.posterior(v)
            settled = np.abs(new - post).max() < 1e-6
            post = new
            if settled:
                break
        self.posts = dict(zip(patterns, post.tolist(), strict=True))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.full(len(v), math.log(self.share / (1 - self.share)))
        for i, p in enumerate(self.parent):
            above = v[:, p] if p >= 0 else np.zeros(len(v), np.int64)
            odds += self.chance[1, i, above, v[:, i]] - self.chance[0, i, above, v[:, i]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def joint(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight of each pair of votes by class, voter and voter: class, i, j, vote of i, vote of j."""
    one_hot = np.eye(3)[v]
    return np.einsum("yp,pia,pjb->yijab", weight, one_hot, one_hot, optimize=True)


def tree(both: np.ndarray) -> list[int]:
    """The parent of each voter (-1 for the first): the tree with the largest sum of mutual information given the class."""
    p = both + 1e-9
    total = p.sum(axis=(3, 4))
    p = p / total[..., None, None]
    independent = p.sum(axis=4, keepdims=True) * p.sum(axis=3, keepdims=True)
    share = total[:, 0, 0] / total[:, 0, 0].sum()
    shared = np.einsum("y,yij->ij", share, (p * np.log(p / independent)).sum(axis=(3, 4)))
    n = len(shared)
    parent, best, source = [-1] * n, shared[0].copy(), np.zeros(n, np.int64)
    out = set(range(1, n))
    while out:
        k = max(out, key=lambda i: (best[i], -i))
        parent[k] = int(source[k])
        out.remove(k)
        closer = shared[k] > best
        best[closer], source[closer] = shared[k][closer], k
    return parent


def tables(both: np.ndarray, parent: list[int]) -> np.ndarray:
    """Log chance of each vote given the class and the parent's vote: class, voter, vote of the parent, vote."""
    out = np.zeros((2, len(parent), 3, 3))
    for i, p in enumerate(parent):
        alone = np.stack([np.diag(both[y, i, i]) for y in (0, 1)]) + 0.5
        alone = alone / alone.sum(axis=1, keepdims=True)
        for a in range(3):
            # votes of the parent that are seen seldom say little beyond the voter's own habits
            given = (both[:, p, i, a] if p >= 0 else np.zeros((2, 3))) + 2 * alone
            out[:, i, a] = np.log(given / given.sum(axis=1, keepdims=True))
    return out


def design(lexicon: Lexicon, rows: list[Hits]) -> np.ndarray:
    """Numbers of each text, the constant last: stems, lists and patterns that it has; of groups whether it has hits, how
    they speak for toxicity, and whether they are too many for chance; how many hits there are, and by the words."""
    n_stems, groups = len(lexicon.stems.names), len(lexicon.stems.toxic)
    x = np.zeros((len(rows), n_stems + len(LANGUAGES) + len(PATTERNS) + 1 + 3 * groups + 4))
    for r, h in enumerate(rows):
        x[r, h.stems] = 1
        at = n_stems + len(LANGUAGES)
        x[r, n_stems:at] = [k > 0 for k in h.listed]
        x[r, at : at + len(PATTERNS) + 1] = [h.bits >> i & 1 for i in range(len(PATTERNS) + 1)]
        at += len(PATTERNS) + 1
        if h.stems:
            own = lexicon.by_group(h)
            x[r, at : at + groups] = [k > 0 for k in own]
            x[r, at + groups : at + 2 * groups] = np.clip(lexicon.odds(h), -10, 10) / 5 * (np.array(own) > 0)
            x[r, at + 2 * groups : at + 3 * groups] = [k > 0 and chance(k, h.n_words * c) < RARE for k, c in zip(own, lexicon.stems.clean, strict=True)]
        number = sum(h.times) + sum(h.listed)
        x[r, -4:] = number > 0, math.log1p(number), min(1.0, 20 * number / max(1, h.n_words)), 1
    return x


def logistic(lexicon: Lexicon, rows: list[Hits], y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights for soft labels y, by Newton's method; the design is made some rows at a time, as stems may be many."""
    n = design(lexicon, []).shape[1]
    w, penalty = np.zeros(n), ridge * np.append(np.ones(n - 1), 1e-3)
    for _ in range(rounds):
        curve, slope = np.diag(penalty), penalty * w
        for k in range(0, len(rows), DESIGN_ROWS):
            x = design(lexicon, rows[k : k + DESIGN_ROWS])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve += (x * (p * (1 - p))[:, None]).T @ x
            slope += x.T @ (p - y[k : k + DESIGN_ROWS])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))

    def train() -> Column:
        return (fold(F.col("doc_id"), folds) != held_out) & F.col("doc_id").isNotNull()

    known = labels.where(F.col(label).isin(0, 1) & train()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows), "toxic-labels")
    share = known.agg(F.coalesce(F.avg("y"), F.lit(0.05))).first()[0]
    lexicon = Lexicon(mined_stems(docs, known))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [lexicon.hits(t) for t in batch.column(1).to_pylist()]
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32())
            columns = [pa.array([h[i] for h in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([lexicon.votes(h) for h in found], pa.string())], ["doc_id", *Hits._fields, "votes"])

    seen = materialize(docs.mapInArrow(look, "doc_id long, n_words long, stems array<int>, times array<int>, listed array<int>, bits int, votes string"), "toxic-hits")
    patterns = seen.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    if not patterns:
        return seen.select("doc_id", F.lit(False).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    at = {r["votes"]: i for i, r in enumerate(patterns)}
    labelled = np.zeros((len(at), 2))
    for r in seen.join(F.broadcast(known), "doc_id").groupBy("votes", "y").agg(F.count("*").alias("n")).collect():
        labelled[at[r["votes"]], r["y"]] = r["n"]
    model = LabelModel([r["votes"] for r in patterns], [r["n"] for r in patterns], labelled, max(share, 0.01))
    sample = seen.where(train()).orderBy(F.xxhash64("doc_id"), "doc_id", "votes").limit(max_fit_rows).collect()
    weights = logistic(lexicon, [Hits(*(r[k] for k in Hits._fields)) for r in sample], np.array([model.posts[r["votes"]] for r in sample]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Hits(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            odds = [design(lexicon, rows[k : k + DESIGN_ROWS]) @ weights for k in range(0, len(rows), DESIGN_ROWS)]
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(odds or [np.zeros(0)]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    scored = seen.select("doc_id", *Hits._fields).mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
