"""Quality by a generalised additive model with pairwise interactions.

A text's measures (shares of characters, words and lines) are cut into quantile bins. Shallow
trees on one measure at a time, in cyclic boosting rounds of small steps, add up to a lookup
table per measure; then trees on two measures do so for the pairs with most left to explain.
A score is logistic in the sum of the table entries of a text's bins.

What reaches the driver is at most ``max_train`` rows of measures; the fit is over them alone.
Scoring is one map over the documents with tables of fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import common

#: Labelled documents that a fit takes at most.
MAX_TRAIN = 20_000
MEASURES = (
    "log_chars", "log_words", "word_length", "letters", "capitals", "digits", "stops", "symbols", "spaces", "entropy", "distinct_words", "top_word", "repeats",
    "bare_words", "capital_words", "capital_starts", "marked_words", "short_words", "longest_word", "line_length", "distinct_lines", "stopped_lines",
)
_SLICE = 4_000_000
_UPPER, _LOWER, _DIGIT = (np.arange(a, b) for a, b in ((65, 91), (97, 123), (48, 58)))
_STOPS = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_SPACE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_LETTERS_ONLY = bytes(b if b >= 0x80 or 65 <= b <= 90 or 97 <= b <= 122 else 0x20 for b in range(256))
_ENDS = b".,;:!?'\")"


def _slices(b: bytes) -> Iterator[bytes]:
    """b in parts of some megabytes, cut at white space where there is any in the megabyte before."""
    lo = 0
    while len(b) - lo > _SLICE:
        hi = lo + _SLICE
        cut = max(b.rfind(s, hi - 1_000_000, hi) for s in (b" ", b"\n", b"\t"))
        hi = cut + 1 if cut > lo else hi
        yield b[lo:hi]
        lo = hi
    yield b[lo:]


def measures(b: bytes) -> list[float]:
    """MEASURES of a text in UTF-8; all shares of an empty text are 0."""
    hist = np.bincount(np.frombuffer(b, np.uint8), minlength=256) if b else np.zeros(256, np.int64)
    chars = int(hist.sum() - hist[0x80:0xC0].sum())  # code points
    upper, lower, wide = int(hist[_UPPER].sum()), int(hist[_LOWER].sum()), int(hist[0xC0:].sum())
    letters, digits, stops, spaces = upper + lower + wide, int(hist[_DIGIT].sum()), int(hist[_STOPS].sum()), int(hist[_SPACE].sum())
    count: Counter = Counter()
    words = repeats = 0
    last = None
    for part in _slices(b):
        own = part.split()
        if own:
            count.update(own)
            words += len(own)
            repeats += sum(map(eq, own, islice(own, 1, None))) + (own[0] == last)
            last = own[-1]
    bare = capital = starts = marked = short = longest = 0
    for w, c in count.items():
        core = w.translate(_LETTERS_ONLY).strip()
        longest = max(longest, len(w))
        if not core:
            bare += c
            continue
        if len(core) > 1 and core.isupper():
            capital += c
        if core[:1].isupper():
            starts += c
        if len(w.rstrip(_ENDS).translate(_LETTERS_ONLY).strip()) < len(w.rstrip(_ENDS)):
            marked += c
        if len(w) <= 3:
            short += c
    lines = [x for x in b.split(b"\n") if x.strip()]
    p = hist[hist > 0] / max(len(b), 1)
    at = lambda x, n: x / n if n else 0.0
    return [
        float(np.log1p(chars)), float(np.log1p(words)), at(chars - spaces, words), at(letters, chars), at(upper, upper + lower), at(digits, chars), at(stops, chars), at(chars - letters - digits - stops - spaces, chars), at(spaces, chars),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, at(len(count), words), at(max(count.values(), default=0), words), at(repeats, words - 1), at(bare, words), at(capital, words), at(starts, words), at(marked, words), at(short, words),
        float(np.log1p(longest)), float(np.log1p(at(len(b), len(lines)))), at(len(set(lines)), len(lines)), at(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines), len(lines)),
    ]


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int, ridge: float) -> tuple[np.ndarray, float]:
    """A tree over ordered bins: the step of each bin, and the gain. Best splits first, up to some leaves of at least so many rows."""
    cg, ch, cn = (np.concatenate([[0], np.cumsum(x)]) for x in (g, h, n))
    score = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)

    def best(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + 1, b)
        k = k[(cn[k] - cn[a] >= least) & (cn[b] - cn[k] >= least)]
        if not len(k):
            return 0.0, -1
        gain = score(a, k) + score(k, b) - score(a, b)
        i = int(gain.argmax())
        return float(gain[i]), int(k[i])

    parts, total = [(0, len(g), *best(0, len(g)))], 0.0
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda j: parts[j][2])
        a, b, gain, k = parts[i]
        if k < 0 or gain <= 1e-9:
            break
        total += gain
        parts[i : i + 1] = [(a, k, *best(a, k)), (k, b, *best(k, b))]
    step = np.zeros(len(g))
    for a, b, *_ in parts:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return step, total


def _split2(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, ridge: float) -> tuple[np.ndarray, float]:
    """A tree over a grid of bins: a cut on the first measure, then one on the second on either side."""
    out, most = np.zeros(g.shape), 0.0
    for k in range(1, g.shape[0]):
        step, total = np.zeros(g.shape), 0.0
        for rows in (slice(0, k), slice(k, None)):
            one, gain = _split(g[rows].sum(0), h[rows].sum(0), n[rows].sum(0), 2, least, ridge)
            step[rows], total = one, total + gain
        if total > most:
            out, most = step, total
    return out, most


@dataclass
class Model:
    """edges: inner bin edges of each measure; mains: a table each; pairs: (i, j, coarse edges of i and j, table); base: log odds of the constant."""

    edges: list[np.ndarray]
    mains: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (e, table) in enumerate(zip(self.edges, self.mains, strict=True)):
            total += table[np.searchsorted(e, x[:, j], side="right")]
        for i, j, ei, ej, table in self.pairs:
            total += table[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    cut = np.unique(np.quantile(x, np.arange(1, bins) / bins))
    return cut[cut > x.min()] if len(cut) else cut


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, coarse: int = 8, pairs: int = 10, rounds: int = 300, rate: float = 0.1, leaves: int = 3, least: int = 5, ridge: float = 1.0, bags: int = 4, patience: int = 10, seed: int = 3) -> Model:
    """Tables from rows of measures x and classes y (0, 1), the mean of some bags.

    Each bag holds out a sixth of the rows and stops when these have not gained for some
    rounds. Pairs are chosen by the gain of one tree each on what the mains leave, over a
    coarse grid. One class alone gives a constant; no rows give one half.
    """
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model([], [], [], float(np.log(share / (1 - share))))
    k = x.shape[1]
    edges, rough = [_edges(x[:, j], bins) for j in range(k)], [_edges(x[:, j], coarse) for j in range(k)]
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(k)]
    near = [np.searchsorted(rough[j], x[:, j], side="right") for j in range(k)]
    base = float(np.log(y.mean() / (1 - y.mean())))
    mains = [np.zeros(len(e) + 1) for e in edges]
    rng = np.random.default_rng(seed)
    least = max(1, min(least, len(y) // 20))

    def boost(own: np.ndarray, places: list[np.ndarray], sizes: list, start: np.ndarray, tree) -> list[np.ndarray]:
        """Cyclic rounds over some measures (or pairs of them, as flat places) from given log odds."""
        tables, f = [np.zeros(s) for s in sizes], start.copy()
        test = ~own
        best, kept, since = np.inf, [t.copy() for t in tables], 0
        for _ in range(rounds):
            for j, (p, s) in enumerate(zip(places, sizes, strict=True)):
                q = 1 / (1 + np.exp(-f[own]))
                cells = int(np.prod(s))
                g, h = np.bincount(p[own], y[own] - q, cells), np.bincount(p[own], q * (1 - q), cells)
                step = rate * tree(g.reshape(s), h.reshape(s), np.bincount(p[own], minlength=cells).reshape(s))
                tables[j] += step
                f += step.ravel()[p]
            loss = float(np.logaddexp(0, np.where(y[test] > 0, -f[test], f[test])).mean()) if test.any() else -np.inf
            if loss < best - 1e-4 or not test.any():
                best, kept, since = loss, [t.copy() for t in tables], 0
            else:
                since += 1
                if since >= patience:
                    break
        return kept

    for _ in range(bags):
        own = rng.random(len(y)) >= 1 / 6
        if y[own].min() == y[own].max():
            own[:] = True
        tables = boost(own, at, [len(m) for m in mains], np.full(len(y), base), lambda g, h, n: _split(g, h, n, leaves, least, ridge)[0])
        for m, t in zip(mains, tables, strict=True):
            m += t / bags
    f = base + sum(m[p] for m, p in zip(mains, at, strict=True))
    q = 1 / (1 + np.exp(-f))
    flat, gains = {}, []
    for i in range(k):
        for j in range(i + 1, k):
            s = (len(rough[i]) + 1, len(rough[j]) + 1)
            p = near[i] * s[1] + near[j]
            cells = s[0] * s[1]
            gain = _split2(np.bincount(p, y - q, cells).reshape(s), np.bincount(p, q * (1 - q), cells).reshape(s), np.bincount(p, minlength=cells).reshape(s), least, ridge)[1]
            flat[i, j] = p, s
            gains.append((-gain, i, j))
    chosen = [(i, j) for gain, i, j in sorted(gains)[:pairs] if gain < 0]
    twos = [np.zeros(flat[c][1]) for c in chosen]
    for _ in range(bags if chosen else 0):
        own = rng.random(len(y)) >= 1 / 6
        tables = boost(own, [flat[c][0] for c in chosen], [flat[c][1] for c in chosen], f, lambda g, h, n: _split2(g, h, n, least, ridge)[0])
        for m, t in zip(twos, tables, strict=True):
            m += t / bags
    return Model(edges, mains, [(i, j, rough[i], rough[j], t) for (i, j), t in zip(chosen, twos, strict=True)], base)


def measured(text: Column) -> Column:
    """The measures of a text column as an array of doubles."""

    @F.pandas_udf("array<double>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([measures(b) for b in s], dtype=object)

    return of(common.text_of(text.cast("string")).cast("binary"))


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most max_train labelled documents, drawn by a hash of the id.

    Several labels of an id: the highest counts. Several texts of an id: the one of smallest
    measures. Null ids and labels are left out.
    """
    label = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).alias("y"))
    label = label.orderBy(F.xxhash64("id"), "id").limit(max_train)
    text = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    rows = text.join(F.broadcast(label), "id").select("id", "y", measured(F.col("t")).alias("x"))  # max_train ids and classes
    rows = rows.groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).orderBy("id").select("r.x", "r.y").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(MEASURES))
    return fit(x, (rows["y"].to_numpy() > 0).astype(float))


def score_documents(docs: DataFrame, model: Model, *, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All rows and columns plus a score, 0 to 1 (an underscore is added to a name in use).

    A null text is scored as the empty one, which has measures like any other text. Repeated
    rows score alike. Texts are read whole, very long ones in slices.
    """
    out = common.free_name(docs, score_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            x = np.array([measures(b) for b in s], float).reshape(-1, len(MEASURES))
            yield pd.Series(shared.value.scores(x))

    return docs.withColumn(out, score(common.text_of(F.col(text_column).cast("string")).cast("binary")))


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that never saw the held-out third's labels."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    out = score_documents(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
