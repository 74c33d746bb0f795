"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

Two words are alike by the letter triples they share as subsequences, each weighted by decay
to the power of the gaps it spans; inserted or swapped letters cost weight, not the match. A
sentence is the sum of its words that come near a landmark. Landmarks are mined from the
labelled documents (words and word beginnings that mark toxic ones), sentence features are
the kernel with the landmarks through the inverse root of the landmark kernel, and a linear
SVM is trained on labelled sentences. A document's score is logistic in the summed margins
of its sentences, the largest one, and its length.

Training holds at most ``max_train`` labelled rows on the driver; scoring is one map over the
documents with a model of fixed size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import common

#: Bounds of a fit: labelled documents, words looked at as landmarks, landmarks, and letters of a word that may become one.
MAX_TRAIN = 4000
CANDIDATES, LANDMARKS = 1500, 96
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGN = 64
_LONGEST = 24


def _codes(word: str) -> list[int]:
    return [ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 for c in word]


def letters(token: str) -> str:
    return "".join(_LETTERS.findall(token.lower()))


class Kernel:
    """Triples of letters as subsequences spanning at most ``span`` letters.

    a to z have codes of their own; all other letters share 37, by code point, so that two of
    them may count as one letter.
    """

    def __init__(self, decay: float = 0.6, span: int = 6):
        self.decay, self.span = decay, span
        self._shapes: dict[int, tuple] = {}

    def shape(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self._shapes:
            rows = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + self.span))]
            at = np.array(rows, dtype=np.int64).reshape(-1, 3)
            self._shapes[n] = at, (self.decay ** (at[:, 2] - at[:, 0] - 2)).astype(np.float32)
        return self._shapes[n]

    def triples(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (words x triples) and weights (triples) of words of one length (words x letters)."""
        at, weight = self.shape(chars.shape[1])
        return (chars[:, at[:, 0]] * _SIGN + chars[:, at[:, 1]]) * _SIGN + chars[:, at[:, 2]], weight

    def explicit(self, word: str) -> dict[int, float]:
        out: Counter = Counter()
        if len(word) >= 3:
            codes, weight = self.triples(np.array([_codes(word)]))
            for c, w in zip(codes[0].tolist(), weight.tolist(), strict=True):
                out[c] += w
        return out


def pieces(word: str) -> list[str]:
    """Overlapping parts of a very long word; a word of usual length is its only part."""
    return [word] if len(word) <= _LONGEST else [word[i : i + _LONGEST] for i in range(0, len(word) - _LONGEST // 2, _LONGEST // 2)]


class Landmarks:
    def __init__(self, words: list[str], kernel: Kernel, gate: float):
        self.words, self.kernel, self.gate = words, kernel, gate
        maps = [kernel.explicit(w) for w in words]
        norms = [np.sqrt(sum(v * v for v in m.values())) or 1.0 for m in maps]
        known = sorted({c for m in maps for c in m})
        self.index = np.zeros(_SIGN**3, np.int32)
        self.index[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(words)), np.float32)
        for j, (m, n) in enumerate(zip(maps, norms, strict=True)):
            for c, v in m.items():
                self.table[self.index[c], j] = v / n
        self.most = self.table.max(axis=1, initial=0)
        values, vectors = np.linalg.eigh(self.similar(words).astype(np.float64)) if words else (np.zeros(0), np.zeros((0, 0)))
        keep = values > 1e-6
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])

    def project(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """similar(words) @ weights, some words at a time."""
        parts = [self.similar(words[i : i + 10_000]) @ weights for i in range(0, len(words), 10_000)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def similar(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of words (letters only) with the landmarks; rows below the gate are zero."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, w in enumerate(words):
            for p in pieces(w):
                if len(p) >= 3:
                    by_length.setdefault(len(p), []).append((i, p))
        for group in by_length.values():
            for lo in range(0, len(group), 20_000):
                part = group[lo : lo + 20_000]
                text = "".join(p for _, p in part)
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(part), -1)
                chars = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 37)
                codes, weight = self.kernel.triples(chars)
                rows = self.index[codes]
                at_least = np.sqrt((weight**2).sum())
                near = np.flatnonzero((self.most[rows] @ weight) >= self.gate * at_least)
                for lo2 in range(0, len(near), 256):
                    sel = near[lo2 : lo2 + 256]
                    same = codes[sel][:, :, None] == codes[sel][:, None, :]
                    norm = np.sqrt(np.einsum("nab,a,b->n", same, weight, weight, optimize=True))
                    k = np.einsum("ncm,c->nm", self.table[rows[sel]], weight, optimize=True) / norm[:, None]
                    k[k.max(axis=1) < self.gate] = 0
                    ids = [part[s][0] for s in sel]
                    np.maximum.at(out, ids, k)
        return out


def sentences(token_list: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in token_list:
        out[-1].append(t)
        if t[-1] in ".!?":
            out.append([])
    return [s for s in out if s]


def merged(tokens: list[str]) -> list[str]:
    """Runs of three or more one-letter tokens are one word, as in spelled-out insults."""
    out, run = [], []
    for t in [*tokens, None]:
        if t is not None and len(letters(t)) == 1 and len(t) <= 3:
            run.append(t)
            continue
        out += ["".join(run)] if len(run) >= 3 else run
        run = []
        if t is not None:
            out.append(t)
    return out


def mine(texts: list[str], toxic: list[int], kernel: Kernel, most: int = LANDMARKS, least_z: float = 3.5, candidates: int = CANDIDATES) -> list[str]:
    """Words and word beginnings that mark toxic documents, strongest first, near copies left out.

    Words of 3 to 24 letters in three toxic documents or more, and four times as often there
    as in others; of these the ``candidates`` of the highest z are looked at, and at most
    ``most`` become landmarks. Scoring reads words of any length, long ones in parts.
    """

    def parts(text: str) -> set[str]:
        own = {w for w in map(letters, set(merged(text.lower().split()))) if 3 <= len(w) <= _LONGEST}
        return own | {w[:n] for w in own for n in (5, 6, 7) if len(w) > n}

    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    total = Counter(toxic)
    for t, y in zip(texts, toxic, strict=True):
        if y:
            seen[1].update(parts(t))
    often = {w for w, a in seen[1].items() if a >= 3}
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            seen[0].update(parts(t) & often)
    n1, n0 = max(total[1], 1), max(total[0], 1)
    z = {}
    for w in often:
        a, b = seen[1][w], seen[0][w]
        if a / n1 > 4 * b / n0:
            z[w] = (a / n1 - b / n0) / np.sqrt((a + b) / (n1 + n0) * (1 / n1 + 1 / n0))
    chosen: list[str] = []
    maps: list[dict[int, float]] = []
    for w in sorted((w for w in z if z[w] >= least_z), key=lambda w: (-z[w], w))[:candidates]:
        m = kernel.explicit(w)
        size = np.sqrt(sum(v * v for v in m.values()))
        if size and all(sum(v * o.get(c, 0) for c, v in m.items()) < 0.9 * size * np.sqrt(sum(v * v for v in o.values())) for o in maps):
            chosen.append(w)
            maps.append(m)
        if len(chosen) == most:
            break
    return chosen


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40, seed: int = 5) -> np.ndarray:
    """Hinge loss by dual coordinate descent; the last column of x is the constant."""
    rng = np.random.default_rng(seed)
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x**2).sum(axis=1)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            if norm[i] > 0:
                a = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0), cost[i])
                w += (a - alpha[i]) * y[i] * x[i]
                alpha[i] = a
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What scoring needs; without both classes to learn from, every score is the share of toxic labels."""

    def __init__(self, landmarks: Landmarks | None, weights: np.ndarray, bias: float, head: np.ndarray, share: float):
        self.landmarks, self.weights, self.bias, self.head, self.share = landmarks, weights, bias, head, share

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: log of its summed positive margins, log of its words, their difference, the largest margin."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        counts = np.diff(np.asarray(lists.offsets))
        code = lists.values.dictionary_encode()
        raw = code.dictionary.to_pylist()
        idx = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        clean = [letters(t) for t in raw]
        value = self.landmarks.project(clean, self.weights)
        word = value[idx]
        single = np.array([len(c) == 1 and len(t) <= 3 for c, t in zip(clean, raw, strict=True)], bool)[idx]
        # spelled-out words: runs of single letters in one document
        run = np.flatnonzero(single[:-2] & single[1:-1] & single[2:] & (doc[:-2] == doc[2:])) if len(single) > 2 else np.zeros(0, np.int64)
        done = -1
        for i in run.tolist():
            if i > done:
                end = i
                while end < len(single) and single[end] and doc[end] == doc[i]:
                    end += 1
                word[i] += float((self.landmarks.similar(["".join(clean[j] for j in idx[i:end])]) @ self.weights)[0])
                done = end
        ends = np.array([t.endswith((".", "!", "?")) for t in raw], bool)[idx]
        first = np.ones(len(idx), bool)
        first[1:] = ends[:-1] | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(first)
        margin = (np.add.reduceat(word, begin) if len(begin) else np.zeros(0)) + self.bias
        of = doc[begin]
        mass = np.bincount(of, np.maximum(margin - self.bias, 0), len(texts))
        top = np.full(len(texts), self.bias)
        np.maximum.at(top, of, margin)
        return np.column_stack([np.log1p(mass), np.log1p(counts), np.log1p(100 * mass / (counts + 20)), top])

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(texts), self.share)
        x = np.column_stack([self.features(texts), np.ones(len(texts))])
        return 1 / (1 + np.exp(-np.clip(x @ self.head, -30, 30)))


def fit(texts: list[str], toxic: list[int], gate: float = 0.55, cost: float = 1.0, landmarks: int = LANDMARKS, candidates: int = CANDIDATES) -> Model:
    """Landmarks, their SVM and the head, of labelled texts; ``landmarks`` and ``candidates`` bound what ``mine`` looks at."""
    kernel, most = Kernel(), landmarks
    share = float(np.mean(toxic)) if toxic else 0.0
    marks = mine(texts, toxic, kernel, most, candidates=candidates) if 0 < share < 1 else []
    if not marks:
        return Model(None, np.zeros(0), 0.0, np.zeros(0), share)
    landmarks = Landmarks(marks, kernel, gate)
    rows, labels = [], []
    blank = 0
    for text, y in zip(texts, toxic, strict=True):
        tokens = merged(text.lower().split())
        words = sorted({w for w in map(letters, tokens) if w})
        near = {w: k for lo in range(0, len(words), 10_000) for w, k in zip(words[lo:], landmarks.similar(words[lo : lo + 10_000]), strict=False) if k.any()}
        for s in sentences(tokens):
            own = [near[w] for w in map(letters, s) if w in near]
            if own:
                rows.append(np.sum(own, axis=0))
                labels.append(1 if y else -1)
            else:
                blank += not y
    rows += [np.zeros(len(marks))] * min(blank, len(rows))
    y = np.array(labels + [-1] * (len(rows) - len(labels)))
    x = np.column_stack([np.array(rows) @ landmarks.whiten, np.ones(len(rows))])
    weight = np.where(y > 0, cost * max(1.0, (y < 0).sum() / max((y > 0).sum(), 1)), cost)
    w = linear_svm(x, y, weight)
    model = Model(landmarks, landmarks.whiten @ w[:-1], float(w[-1]), np.zeros(5), share)
    x = np.concatenate([model.features(pa.array(texts[i : i + 200], pa.string())) for i in range(0, len(texts), 200)])
    model.head = logistic(x, np.array(toxic, float))
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most max_train labelled documents, drawn by a hash of the id. Several labels of an id: the highest counts; several texts: the least."""
    label = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).alias("y"))
    label = label.orderBy(F.xxhash64("id"), "id").limit(max_train)
    text = docs.select(F.col(id_column).alias("id"), common.text_of(F.col(text_column).cast("string")).alias("t"))
    rows = text.join(F.broadcast(label), "id").groupBy("id", "y").agg(F.min("t").alias("t")).collect()  # max_train rows
    rows.sort(key=lambda r: r["id"])
    return fit([r["t"] for r in rows], [int(r["y"] > 0) for r in rows])


def score_documents(docs: DataFrame, model: Model, *, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All rows and columns plus a score, 0 to 1 (an underscore is added to a name in use).

    A null or empty text has the score of a text without words. Repeated rows get equal
    scores. Texts are read whole; very long words are read in overlapping parts.
    """
    out = common.free_name(docs, score_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            parts, lo, size = [], 0, 0
            sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).tolist()
            for hi, n in enumerate(sizes, 1):
                size += n
                if size > 4_000_000 or hi - lo == 4000 or hi == len(sizes):
                    parts.append(shared.value.scores(texts.slice(lo, hi - lo).cast(pa.string())))
                    lo, size = hi, 0
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))
            common.give_back()

    return docs.withColumn(out, score(common.text_of(F.col(text_column).cast("string"))))


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that never saw the held-out quarter's labels."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    out = score_documents(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
