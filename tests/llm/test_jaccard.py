import random
from itertools import combinations

import numpy as np
import pytest

from caseloom.llm import jaccard, partners, trie
from tests.llm.helpers import AZ, MIXED, frame, words


def brute(rows, n, percent):
    sets = []
    for _, t, _ in rows:
        w = words((t or "").translate(AZ))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return {(d, len(s), d if not s else least.get(top(i))) for i, ((d, _, _), s) in enumerate(zip(rows, sets, strict=True))}


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = list(MIXED)
    for family in range(12):  # chains of edits; family 0 is a large one
        text = [rng.choice(vocabulary) for _ in range(rng.randint(6, 60))]
        for _ in range(45 if family == 0 else rng.randint(1, 6)):
            rows.append((1000 + len(rows), " ".join(text), "a"))
            text[rng.randrange(len(text))] = rng.choice(vocabulary).upper()
    for n, percent in ((4, 85), (5, 80)):
        got = jaccard.near_duplicates(frame(spark, rows), n=n, percent=percent)
        assert {tuple(r) for r in got.collect()} == brute(rows, n, percent)
    assert got.count() == len(rows)


def test_empty_table(spark):
    assert jaccard.near_duplicates(frame(spark, MIXED).limit(0)).count() == 0


@pytest.mark.parametrize(("crowd", "hot"), [(128, 4096), (0, 4096), (0, 8)])
def test_small_blocks_and_slices_give_the_same(spark, monkeypatch, crowd, hot):
    """Large partitions, cut into blocks, and many slices: as at scale; with all partitions thinned, and with all signatures hot."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(partners, "HOT", hot)
    monkeypatch.setattr(partners, "ROWS", 50)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard, "MERGED", 500)
    monkeypatch.setattr(jaccard, "RUN", 300)
    monkeypatch.setattr(jaccard, "CHUNK", 200)
    monkeypatch.setattr(jaccard, "FEW", 0)
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(90):  # a star of edits, some of which only link with other edits
        text = list(base)
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary[:3])
        rows.append((i, " ".join(text), "a"))
    got = jaccard.near_duplicates(frame(spark, rows), n=4, percent=85)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 85)


def test_trie_connects_what_pairs_connect():
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = rng.choice(200, 40, replace=False)
        sets = []
        for _ in range(25):
            drop = rng.random(40) < 0.08
            sets.append(np.unique(np.concatenate([base[~drop], rng.choice(400, rng.integers(0, 6))])).astype(np.uint64)[::-1].copy())
        up = list(range(25))
        down = list(range(25))
        for a, b in combinations(range(25), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                up = [up[a] if x == up[b] else x for x in up]
        for a, b in trie.connected(sets, 85):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)
            down = [down[a] if x == down[b] else x for x in down]
        same = lambda x: [[i for i in range(25) if x[i] == x[j]] for j in range(25)]
        assert same(up) == same(down)


def test_sets_that_link_are_equal_in_a_part_and_within_the_bound():
    rng = np.random.default_rng(7)
    linked = 0
    for _ in range(3000):
        n = int(rng.integers(1, 90))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        keep = base[rng.random(n) > rng.random() * 0.2]
        a, b = base, np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        for percent in (80, 85):
            if not len(b) or set(a) == set(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            linked += 1
            common = np.intersect1d(partners.signatures(a, percent), partners.signatures(b, percent))
            assert len(common)
            keys = np.repeat(common[:1].view(np.int64), 2)
            sketches = np.stack([np.frombuffer(partners.sketch(x), np.uint64) for x in (a, b)])
            assert partners.close(keys, np.array([len(a), len(b)]), sketches, percent).all()
    assert linked > 500


def test_texts_of_the_same_passages_that_do_not_link_have_no_partners(spark, monkeypatch):
    """Nearly all pairs share shingles of their prefixes; only those that link are left to compare, whatever the number of texts."""
    rng = random.Random(1)
    passages = [" ".join(f"s{i}w{j}" for j in range(rng.randint(8, 14))) for i in range(20)]
    drawn = [[rng.choice(passages) for _ in range(30)] for _ in range(1500)]
    drawn.append([*drawn[0][:-1], "another end of it"])
    rows = [(i, " ".join(x), "a") for i, x in enumerate(drawn)]
    kept, thinned = jaccard.common.kept, {}

    def count(df, name):
        out = kept(df, name)
        if name in ("members", "partners"):
            thinned[name] = out.select("node").distinct().count()
        return out

    monkeypatch.setattr(jaccard.common, "kept", count)
    got = jaccard.near_duplicates(frame(spark, rows), n=4, percent=85)
    assert [tuple(r) for r in got.where("doc_id <> component_id").select("doc_id", "component_id").collect()] == [(1500, 0)]
    assert thinned["members"] == 1501 and thinned["partners"] <= 20
