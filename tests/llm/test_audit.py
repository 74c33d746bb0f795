import random
import re
from collections import Counter

import numpy as np
import pytest

from caseloom.llm import audit
from tests.llm.helpers import AZ, LONG, MIXED

COLUMNS = "doc_id long, text string, lang string, source string, term string, g int, count long, Part string"


def brute(rows, min_docs, top=50):
    groups, langs = {}, {}
    df = Counter()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(AZ) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.setdefault((lang, source), Counter()).update(words)
        langs.setdefault(lang, Counter()).update(words)
        df.update((lang, w) for w in set(words))
    out = []
    for lang in langs:
        kept = sorted(w for w in langs[lang] if df[lang, w] >= min_docs)
        v = len(kept)

        def share(count, kept=kept, v=v):
            n = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 5) // (n + 5 * v) for w in kept}

        own = {s: share(c) for (lg, s), c in groups.items() if lg == lang}
        q = share(langs[lang])
        for s, p in own.items():
            parts = {"pair": [(sum(abs(p[w] - o[w]) for w in kept), x) for x, o in own.items() if x != s], "term": [(p[w] - q[w], w) for w in kept if groups[lang, s][w] > 0 and p[w] > q[w]]}
            for part, values in parts.items():
                for rank, (f, item) in enumerate(sorted(values, key=lambda z: (-z[0], z[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, f, rank))
    return sorted(out)


def rows_of():
    rng = random.Random(9)
    words = ["The", "the", "Élan", "élan", "größe", "a1b", "naïve", "𝒳y", "word", "Word", "zz", "it's", "\x7fq", "rare"]
    made = [(i, " ".join(rng.choices(words, weights=range(1, 15), k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None, "s5"])) for i in range(150)]
    return made + [(900, LONG, "en", "s1")] * 2 + [(901, None, "en", "empty"), (902, "", "lone", "only"), (903, "!!", "none", "x"), (904, None, "none", "y")] + [(i, t, "en", s) for i, t, s in MIXED]


@pytest.mark.parametrize(("tile", "block"), [(2, 3), (256, 4096)])
def test_pairs_and_terms_are_those_of_brute_force(spark, tile, block):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "t", 1, 2, "p") for r in rows], COLUMNS)
    out = audit.audit_sources(docs, min_docs=3, tile=tile, block_terms=block)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 3)
    if tile == 2:
        few = audit.audit_sources(docs, min_docs=3, top=2, tile=tile, block_terms=block)
        assert sorted(tuple(r) for r in few.collect()) == brute(rows, 3, 2)
        assert audit.audit_sources(docs.limit(0)).count() == 0


def test_shares_are_exact_where_products_leave_64_bits():
    counts = np.array([0, 7, 10**12, 3 * 10**14], dtype=np.int64)
    total, terms = int(counts.sum()), 4
    assert audit.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x250))) + " MiXed ÀÉ 𝒳 end"
    want = [w.translate(AZ) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
    assert [w.decode() for w in audit.terms_of(text.encode())] == want


def test_counts_passed_on_early_add_up(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD", 2)
    docs = spark.createDataFrame([("en", "s", "a b c d"), ("en", "s", "a b"), ("en", "t", "a")], "lang string, source string, t string")
    got = {(r["source"], r["term"]): (r["count"], r["whole"]) for r in audit.kept_counts(docs, 2).collect()}
    assert got == {("s", "a"): (2, 3), ("t", "a"): (1, 3), ("s", "b"): (2, 2)}
