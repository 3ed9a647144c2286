"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is the gap-weighted count of the letter subsequences they share,
normalised, so that letters put between those of an insult lower it only a little. A
sentence is its best kernel value with each landmark, mapped by the Nyström square root of
the landmarks' own kernel matrix; a linear machine with squared hinge loss is fitted on
labelled sentences, of each labelled document those that respond most, and a document is
as toxic as its worst sentence.

A kernel value counts as 0 where a word lacks too many of a landmark's letters (SHARE) or
where it is below FLOOR; so most words of a text need no kernel at all. Both are part of the
kernel, in training and scoring alike, for texts of any length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import training_rows

#: Labelled rows that the machine is fitted on at most: those with the smallest hash of their id.
TRAIN_ROWS = 6_000
ORDER, DECAY, SHARE, FLOOR = 4, 0.65, 0.75, 0.35
#: Stands before every word, so that where letters stand in a word counts.
START = "^"
#: Prefixes of so many letters and more may be landmarks, besides whole words.
STEM = 4
TOXIC_LANDMARKS, PLAIN_LANDMARKS = 76, 4
#: Words of the labelled rows whose stems are looked at, best first, and how many of the ranked stems and of the plain words.
LOOKED_AT, RANKED, PLAIN = 1_500, 600, 400
#: Longer words are cut into overlapping windows of this length, so that no letter is left out.
WINDOW = 24
#: Of a labelled document so many sentences, those that respond most, are learnt from.
SENTENCES = 6


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of s (n x a letters) with the same row of t (n x b)."""
    n, a, b = len(s), s.shape[1], t.shape[1]
    same = s[:, :, None] == t[:, None, :]
    inner, out = np.ones((n, a + 1, b + 1), np.float32), np.zeros(n, np.float32)
    for step in range(order):
        ended = decay * decay * inner[:, :a, :b] * same
        out = ended.sum((1, 2))
        if step == order - 1:
            break
        inner = np.zeros((n, a + 1, b + 1), np.float32)
        for i in range(1, a + 1):
            row = np.zeros((n, b + 1), np.float32)
            for j in range(1, b + 1):
                row[:, j] = decay * row[:, j - 1] + ended[:, i - 1, j - 1]
            inner[:, i] = decay * inner[:, i - 1] + row
    return out


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, each after a mark of its start, and each word's offset."""
    words = [START + w for w in words]
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])


def bag(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each of 40 letter classes occurs in each word."""
    cls = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % 14).astype(np.int64)
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(word * 40 + cls, minlength=40 * (len(offsets) - 1)).reshape(-1, 40).astype(np.uint8)


class Landmarks:
    """Words against which every other word's kernel is taken."""

    def __init__(self, words: list[str]):
        self.words = words
        self.points, self.offsets = letters_of(words)
        self.bags = bag(self.points, self.offsets)
        self.size = np.diff(self.offsets)
        self.own = np.array([max(1e-9, float(kernel(*(self.letters(i)[None],) * 2)[0])) for i in range(len(words))])

    def letters(self, i: int) -> np.ndarray:
        return self.points[self.offsets[i] : self.offsets[i + 1]]

    def respond(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse kernel values: (word, landmark, value) wherever the value is at least FLOOR."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        if not self.words or not words:
            return none
        source = np.arange(len(words))
        if max(map(len, words)) > WINDOW:
            cut = [(i, w[j : j + WINDOW]) for i, w in enumerate(words) for j in (range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2) if len(w) > WINDOW else (0,))]
            source, words = np.array([i for i, _ in cut]), [w for _, w in cut]
        points, offsets = letters_of(words)
        bags, size = bag(points, offsets), np.diff(offsets)
        columns = np.ascontiguousarray(bags.T)
        hits = []
        for own, n in zip(self.bags, self.size, strict=True):
            letters = np.flatnonzero(own)
            shared = np.zeros(len(words), np.uint8)
            for x in letters.tolist():
                shared += np.minimum(columns[x], own[x])
            hits.append(np.flatnonzero(shared >= max(ORDER, SHARE * n)))
        w = np.concatenate(hits)
        m = np.repeat(np.arange(len(self.words)), [len(h) for h in hits])
        if len(w) == 0:
            return none
        value = np.zeros(len(w), np.float32)
        self_value = np.ones(len(words))
        for n in common.distinct(size[w]).tolist():
            each = common.distinct(w[size[w] == n])
            for k in range(0, len(each), 4096):
                own = points[offsets[each[k : k + 4096], None] + np.arange(n)]
                self_value[each[k : k + 4096]] = kernel(own, own)
            for b in common.distinct(self.size).tolist():
                at = np.flatnonzero((size[w] == n) & (self.size[m] == b))
                for k in range(0, len(at), 4096):
                    x = at[k : k + 4096]
                    value[x] = kernel(points[offsets[w[x], None] + np.arange(n)], self.points[self.offsets[m[x], None] + np.arange(b)])
        value /= np.sqrt(np.maximum(self_value[w], 1e-9) * self.own[m]).astype(np.float32)
        ok = value >= FLOOR
        return source[w[ok]], m[ok], value[ok]

    def root(self) -> np.ndarray:
        """Inverse square root of the landmarks' kernel matrix."""
        w, m, v = self.respond(self.words)
        k = np.eye(len(self.words))
        k[w, m] = v
        k = (k + k.T) / 2
        values, vectors = np.linalg.eigh(k)
        good = values > 1e-4 * max(values.max(initial=1e-9), 1e-9)
        return vectors[:, good] / np.sqrt(values[good])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Stems of the words of texts: (code, text, sentence) per word and the stems by code.

    Words lose their signs; a run of three or more single letters is one word.
    Sentences are numbered through all texts; they end with a word that ends in a stop.
    """
    codes, offsets, words = common.words_of(pc.utf8_lower(pc.fill_null(texts, "")))
    stems = pc.replace_substring_regex(words, "[[:punct:]]+", "")
    coded = stems.dictionary_encode()
    of_word = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = pc.match_substring_regex(words, "[.!?]$").to_numpy(zero_copy_only=False)[codes]
    new = np.ones(len(codes), bool)
    new[1:] = ends[:-1] | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    code = of_word[codes].astype(np.int64)
    single = np.fromiter((len(x) == 1 for x in names), bool, len(names))[code]
    if single.any():
        # a run ends where its text does, whatever text comes next
        edge = np.flatnonzero(np.concatenate([[True], (single[1:] != single[:-1]) | (text[1:] != text[:-1]), [True]]))
        extra: dict[str, int] = {}
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a >= 3 and single[a]:
                code[a] = extra.setdefault("".join(names[c] for c in code[a:b].tolist()), len(names) + len(extra))
        names += list(extra)
    return code, text, sentence, names


def responses(texts: pa.Array, marks: Landmarks) -> tuple[np.ndarray, np.ndarray]:
    """Sentences with a kernel value: (text of each, its best value with every landmark)."""
    code, text, sentence, names = tokens(texts)
    w, m, v = marks.respond(names)
    if len(w) == 0:
        return np.empty(0, np.int64), np.empty((0, len(marks.words)), np.float32)
    table, used = np.zeros((len(common.distinct(w)), len(marks.words)), np.float32), common.distinct(w)
    np.maximum.at(table, (np.searchsorted(used, w), m), v)
    place = np.full(len(names), -1)
    place[used] = np.arange(len(used))
    at = np.flatnonzero(place[code] >= 0)
    if len(at) == 0:
        return np.empty(0, np.int64), np.empty((0, len(marks.words)), np.float32)
    starts = np.flatnonzero(np.diff(sentence[at], prepend=-1))
    return text[at[starts]], np.maximum.reduceat(table[place[code[at]]], starts, axis=0)


class StringMachine:
    """The fitted machine: landmarks, weights on their responses, and the logistic link of its margin."""

    def __init__(self, marks: Landmarks, weights: np.ndarray, intercept: float, link: tuple[float, float]):
        self.marks, self.weights, self.intercept, self.link = marks, weights, intercept, link

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Of each text the largest margin of its sentences; one without a response has the intercept."""
        out = np.full(len(texts), self.intercept)
        text, x = responses(texts, self.marks)
        np.maximum.at(out, text, x @ self.weights + self.intercept)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        a, b = self.link
        return 1 / (1 + np.exp(-np.clip(a * self.margins(texts) + b, -30, 30)))


def hinge(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighted equally; Newton steps on the active rows."""
    z = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y) * cost / max(1, len(y)) * 100
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = sign * (z @ w) < 1
        za = z[active] * weight[active, None]
        new = np.linalg.solve(ridge + z[active].T @ za, za.T @ sign[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic_link(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's link with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, v = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + 1e-6 * np.eye(2), z.T @ (target - p) - 1e-6 * v)
        v = v + np.clip(step, -2, 2)
    return max(float(v[0]), 0.1), float(v[1])


def landmarks(texts: list[str], y: np.ndarray) -> Landmarks:
    """Words and stems that mark toxic documents (by likelihood ratio) and differ from each other, and some plain words."""
    code, text, _, names = tokens(pa.array(texts, pa.string()))
    order = np.argsort(np.array(names, object), kind="stable")
    names = [names[i] for i in order.tolist()]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pair = common.distinct(place[code] * len(texts) + text)  # by word, then by document
    word, doc = pair // len(texts), pair % len(texts)
    bad = y > 0
    n1, n0 = max(1, int(bad.sum())), max(1, int((~bad).sum()))
    c1, c0 = (np.bincount(word, x[doc], len(names)) for x in (bad, ~bad))

    def ratio(a: float, b: float) -> float:
        """Log-likelihood ratio of a toxic and b other documents against independence; 0 unless much commoner in toxic ones."""
        if a < 2 or a / n1 <= 3 * b / n0:
            return 0.0
        e = (a + b) * n1 / (n1 + n0)
        return 2 * (a * np.log(a / e) + (b * np.log(b / (a + b - e)) if b else 0))

    seen: dict[str, float] = {}
    first = np.lexsort((np.arange(len(names)), -(c1 / n1 - 3 * c0 / n0)))[:LOOKED_AT]
    for i in first.tolist():
        for k in {*range(STEM, min(len(names[i]), WINDOW)), len(names[i])}:
            stem = names[i][:k]
            if ORDER - 1 <= k <= WINDOW and stem not in seen:
                lo = bisect.bisect_left(names, stem)
                hi = bisect.bisect_left(names, stem[:-1] + chr(ord(stem[-1]) + 1), lo)
                at = common.distinct(doc[np.searchsorted(word, lo) : np.searchsorted(word, hi)])
                seen[stem] = ratio(float(bad[at].sum()), float((~bad[at]).sum()))
    ranked = sorted((s for s in seen if seen[s] > 0), key=lambda s: (-seen[s], -len(s), s))
    plain = [names[i] for i in np.lexsort((np.arange(len(names)), -c0))[:PLAIN].tolist() if ORDER <= len(names[i]) <= WINDOW and c0[i] / n0 > c1[i] / n1]
    chosen: list[str] = []
    for group, most, near in ((ranked[:RANKED], TOXIC_LANDMARKS, 0.75), (plain, TOXIC_LANDMARKS + PLAIN_LANDMARKS, 0.6)):
        for s in group:
            if len(chosen) >= most:
                break
            if not chosen or Landmarks(chosen).respond([s])[2].max(initial=0) < near:
                chosen.append(s)
    return Landmarks(chosen)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS) -> StringMachine:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    Without labelled rows, or with one class only, the score is a constant: 0.5, or near the class.
    """
    got = sorted((r["doc_id"], r["y"], r["text"] or "") for r in training_rows(docs, labels, label, most).select("doc_id", "y", "text").collect())
    y, texts = np.array([r[1] for r in got]), [r[2] for r in got]
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return StringMachine(Landmarks([]), np.empty(0), 0.0, (1.0, float(np.log(p / (1 - p)))))
    marks = landmarks(texts, y)
    if not marks.words:
        return StringMachine(marks, np.empty(0), 0.0, (1.0, float(np.log(y.mean() / (1 - y.mean())))))
    root = marks.root()
    of, x = [], []
    for k in range(0, len(texts), 500):
        text, best = responses(pa.array(texts[k : k + 500], pa.string()), marks)
        order = np.lexsort((-best.max(1, initial=0), text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        keep = order[rank < SENTENCES]
        of.append(text[keep] + k)
        x.append(best[keep])
    of, x = np.concatenate([*of, np.arange(len(texts))]), np.concatenate([*x, np.zeros((len(texts), len(marks.words)), np.float32)])
    z = x @ root
    strength = x.max(1)
    for _ in range(4):  # of a toxic document the sentence that shows it, of the others all
        first = np.lexsort((-strength, of))
        first = first[np.flatnonzero(np.diff(of[first], prepend=-1))]
        rows = np.concatenate([first[y[of[first]] > 0], np.flatnonzero(y[of] <= 0)])
        w, b = hinge(z[rows], y[of[rows]])
        strength = z @ w
    machine = StringMachine(marks, root @ w, b, (1.0, 0.0))
    margin = np.full(len(y), -np.inf)
    np.maximum.at(margin, of, z @ w + b)
    machine.link = logistic_link(margin, y)
    return machine


def score(docs: DataFrame, machine: StringMachine) -> DataFrame:
    """(doc_id, score) of every row, by its whole text.

    A null or empty text has no sentence and gets the machine's score of nothing. A null doc_id
    stays null, repeated rows are scored each, other columns are ignored, and an empty table
    gives an empty result.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(it, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(machine.scores(batch.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
