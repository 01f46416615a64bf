"""Toxicity by weak supervision (op1): voters, a label model of their accuracies and correlations, a linear classifier.

Voters are an insult lexicon and patterns (words and word starts that occur once, twice or three
times) that part labelled rows significantly. A generative model of the unknown class, of each
voter's accuracy and of the dependence between voters is fitted by EM on labelled and unlabelled
rows; given labels are one more, noisy voter. A linear classifier on counts of word starts in the
text is then trained on the posteriors, and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Rows that the models are fitted on, at most: labelled ones of each class, and unlabelled ones; the least hashes of doc_id are taken.
FIT_ROWS = 4000
#: Word starts of these lengths, and whole words, are tried as patterns; each votes if it occurs so often in a text.
STARTS = (3, 4, 5, 6)
TIMES = (1, 2, 3)
BEGIN = min(STARTS)
#: A pattern votes if its log-likelihood ratio against chance and its lift among toxic fit rows are this high.
MIN_G2, MIN_LIFT = 40.0, 3.0
#: Patterns of this ratio are features of the classifier, whether they vote or not; the model's size is that of the best PATTERNS.
FEATURE_G2, PATTERNS = 25.0, 150
#: Chance that a given label is right, and what an unlabelled row counts beside a labelled one.
LABEL_RIGHT, UNLABELLED = 0.99, 0.2
#: Patterns that a task counts before it hands them on.
HELD = 50_000
#: Insults that vote from the outset, whatever the labelled rows hold.
LEXICON = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
_WORD = re.compile(r"\w+")


def word_patterns(word: str) -> list[str]:
    """The word itself and its starts; a start ends in *."""
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def fit_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic): at most `most` rows of each class and as many without label (toxic null), none held out.

    Of a doc_id's labels the greatest counts, of its texts the first by bytes. Of texts of a class
    that share their least 5-word shingle by hash, as copies mostly do, one is left, so that the
    words of one text that was copied often don't look significant.
    """
    ids = docs.where("doc_id is not null and text is not null").where(~held_out()).select("doc_id").distinct()
    own = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = own.join(ids, "doc_id", "left_semi")
    other = ids.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("toxic", F.lit(None).cast("int"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [x.orderBy(*order).limit(most) for x in (known.where("toxic = 1"), known.where("toxic = 0"), other)]
    picked = base.cut(some[0].unionByName(some[1]).unionByName(some[2]))
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")  # at most 3 * most rows of two numbers
    one = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    w = one.withColumn("w", F.split(F.lower("text"), r"\s+"))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, 5), " ")))
    return w.groupBy("toxic", F.array_min(each).alias("__least")).agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.doc_id", "d.text", "toxic")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class LabelModel:
    """Latent toxic or clean, voters given the class and one other voter each, by EM.

    votes[i, j] tells whether voter j fires on row i; it abstains else, which counts as missing and
    not as evidence, as each voter knows few forms of what is toxic. One more voter, for clean,
    fires where all others abstain. Given the class the voters form a forest: each depends on at
    most one other, the pairs of most conditional mutual information under the posteriors (at least
    `tie` nats a row), found anew in each of the first rounds. Accuracies are P(vote | class),
    correlations P(vote | class, other vote); both are estimated together with the posteriors. gold
    is 1, 0 or -1 for no label; it is one more voter, of accuracy LABEL_RIGHT, and rows without it
    count UNLABELLED.
    """

    def __init__(self, votes: np.ndarray, gold: np.ndarray, rounds: int = 30, tie: float = 2e-4):
        v = np.hstack([votes, ~votes.any(1, keepdims=True)]).astype(np.float64)
        known = gold >= 0
        p = np.where(known, np.where(gold == 1, LABEL_RIGHT, 1 - LABEL_RIGHT), 0.5)
        label = np.where(known, np.where(gold == 1, 1, -1), 0) * np.log(LABEL_RIGHT / (1 - LABEL_RIGHT))
        self.weight = np.where(known, 1.0, UNLABELLED)
        self.parent = np.full(v.shape[1], -1)
        for i in range(rounds):
            use = self.weight if i else known.astype(np.float64)  # first from labelled rows alone
            w = np.stack(((1 - p) * use, p * use))
            if i < 5:
                self.parent[:-1] = self._forest(v[:, :-1], w, tie)
            self._tables(v, w)
            odds = np.log(w[1].sum() + 1) - np.log(w[0].sum() + 1)
            new = _sigmoid(odds + self._evidence(v) + label)
            moved = np.abs(new - p).max()
            p = new
            if i >= 5 and moved < 1e-4:
                break
        self.posterior = p

    @staticmethod
    def _forest(v: np.ndarray, weights: np.ndarray, tie: float) -> np.ndarray:
        """Of each voter the one that it depends on, or -1: a greatest spanning forest over conditional mutual information."""
        k, n = v.shape[1], weights.sum() + 1e-9
        mi = np.zeros((k, k))
        for w in weights:
            total = w.sum() + 1e-9
            one = (w @ v) / total
            both = (v * w[:, None]).T @ v / total
            for a in (0, 1):
                for b in (0, 1):
                    joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                    apart = np.outer(one if a else 1 - one, one if b else 1 - one)
                    joint = np.clip(joint, 1e-12, None)
                    mi += total / n * joint * np.log(joint / np.clip(apart, 1e-12, None))
        np.fill_diagonal(mi, 0)
        parent = np.full(k, -1)
        best, by, out = np.full(k, -1.0), np.full(k, -1), np.zeros(k, bool)
        for _ in range(k):
            j = int(np.argmax(np.where(out, -2.0, best)))
            out[j] = True
            parent[j] = by[j] if best[j] >= tie else -1
            better = ~out & (mi[j] > best)
            best[better], by[better] = mi[j][better], j
        return parent

    def _tables(self, v: np.ndarray, w: np.ndarray) -> None:
        """P(fires | class, the other voter's vote) of each voter, smoothed towards its own accuracy."""
        self.accuracy = (w @ v + 0.05) / (w.sum(1, keepdims=True) + 1)
        up = np.where(self.parent[None, :] >= 0, v[:, self.parent], 0.0)
        self.table = np.empty((2, 2, v.shape[1]))  # class, the other's vote, voter
        for c in (0, 1):
            for o, x in enumerate((1 - up, up)):
                n = w[c] @ x
                self.table[c, o] = np.clip((w[c] @ (x * v) + self.accuracy[c]) / (n + 1), 1e-6, 1 - 1e-6)

    def _evidence(self, v: np.ndarray) -> np.ndarray:
        up = np.where(self.parent[None, :] >= 0, v[:, self.parent], 0.0)
        fired = np.log(self.table[1] / self.table[0])
        return (v * np.where(up > 0, fired[1], fired[0])).sum(1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights of a ridge logistic regression on soft labels of weighted rows, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + pull * w)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


class Model:
    """Weights of patterns, for occurring and for the logarithm of how often, and an offset: a text's logit is their sum."""

    def __init__(self, weights: dict[str, tuple[float, float]], offset: float):
        self.weights, self.offset = weights, offset
        self.begin = {p[:BEGIN] for p in weights}

    def counts(self, text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        begin, weights = self.begin, self.weights
        for w, n in Counter(_WORD.findall(text.lower())).items():
            if w[:BEGIN] in begin:
                for p in word_patterns(w):
                    if p in weights:
                        out[p] = out.get(p, 0) + n
        return out

    def score(self, text: str) -> float:
        z = self.offset
        for p, n in sorted(self.counts(text).items()):
            some, often = self.weights[p]
            z += some + often * np.log(n)
        return float(_sigmoid(np.float64(z)))


def _significance(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-likelihood ratio of the two rates against one common rate."""

    def part(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = (pos + neg) / (n_pos + n_neg)
    return 2 * (part(pos, n_pos, pos / n_pos) + part(neg, n_neg, neg / n_neg) - part(pos, n_pos, both) - part(neg, n_neg, both))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """Voters are the lexicon and patterns that part the fit rows; label model; classifier on its posteriors."""
    rows = base.cut(fit_rows(docs, labels, most))
    lexicon = Model({**dict.fromkeys(LEXICON, (6.0, 0.0))}, -4.0)
    n = dict(rows.groupBy("toxic").count().collect())
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:  # nothing to learn from: the lexicon alone
        return lexicon

    def count(batches):
        pos, neg = Counter(), Counter()

        def counted():
            keys = list(pos | neg)
            out = pd.DataFrame({"pattern": pd.Series([k[0] for k in keys], dtype=object), "times": [k[1] for k in keys], "pos": [pos[k] for k in keys], "neg": [neg[k] for k in keys]})
            pos.clear()
            neg.clear()
            return out

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                each: Counter = Counter()
                for w, k in Counter(_WORD.findall(text.lower())).items():
                    for p in word_patterns(w):
                        each[p] += k
                (pos if toxic else neg).update((p, t) for p, k in each.items() for t in TIMES if k >= t)
                if len(pos) + len(neg) > HELD:
                    yield counted()
        yield counted()

    counted = rows.where("toxic is not null").mapInPandas(base.tidy(count), "pattern string, times int, pos long, neg long").groupBy("pattern", "times").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # what can reach the ratio at all: no lower bound is lost, as n hits with none against have at most 2 n log(rows / toxic rows)
    least = int(FEATURE_G2 / (2 * np.log((n_pos + n_neg) / n_pos)))
    found = counted.where((F.col("pos") >= max(1, least)) & (F.col("pos") * n_neg >= MIN_LIFT * F.col("neg") * n_pos)).toPandas()  # of 2 * most texts, most of them once only
    found["g2"] = _significance(found["pos"].to_numpy(float), found["neg"].to_numpy(float), n_pos, n_neg)
    found = found[found["g2"] >= FEATURE_G2].sort_values(["g2", "pattern", "times"], ascending=[False, True, True])
    found["root"] = found["pattern"].str.slice(0, BEGIN)
    found = found.drop_duplicates(["root", "times", "pos", "neg"])  # starts of one word that stand in the same rows
    found = found.head(PATTERNS)
    voters = sorted(set(zip(found["pattern"], found["times"])) & set(zip(*[found[found["g2"] >= MIN_G2][c] for c in ("pattern", "times")])) | {(x, 1) for x in LEXICON})
    features = sorted(set(found["pattern"]) | set(LEXICON))
    index = {p: i for i, p in enumerate(features)}
    probe = Model(dict.fromkeys(features, (0.0, 0.0)), 0.0)

    def occur(batches):
        for pdf in batches:
            got = [{index[p]: k for p, k in probe.counts(t).items()} for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"].fillna(-1).astype(int), "at": [sorted(x) for x in got], "n": [[x[i] for i in sorted(x)] for x in got]})

    got = rows.mapInPandas(base.tidy(occur), "doc_id long, toxic int, at array<int>, n array<int>").orderBy("doc_id").collect()  # at most 3 * most rows
    c = np.zeros((len(got), len(features)), np.float32)
    for i, r in enumerate(got):
        c[i, r["at"]] = r["n"]
    votes = np.stack([c[:, index[p]] >= t for p, t in voters], 1)
    label = LabelModel(votes, np.array([r["toxic"] for r in got]))
    some = c > 0
    w, b = _logistic(np.hstack([some, np.where(some, np.log(np.maximum(c, 1)), 0)]).astype(np.float64), label.posterior, label.weight)
    k = len(features)
    return Model({p: (float(w[i]), float(w[k + i])) for p, i in index.items()}, b)


def score(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Labels are read for rows that are not held out alone; lang, source and doc_id are no inputs.
    Null and empty texts score as texts without any pattern; repeated rows come out each; without
    labelled rows of both classes the lexicon alone scores; a null doc_id counts as not held out.
    Other columns are left out.
    """
    model = fit(docs, labels, most)

    def run(batches):
        for pdf in batches:
            s = [model.score(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": [int(x >= 0.5) for x in s]})

    d = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return base.by_batch(d, run, "held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Rows of docs, with all columns, whose text scores under 0.5."""
    model = fit(docs, labels, most)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        out = pd.Series([model.score(t) for t in text], dtype=float)
        base.give_back()
        return out

    return docs.where(of(F.coalesce("text", F.lit(""))) < 0.5)
