import hashlib
import random
import re

import pytest

from caseloom.llm import fim
from tests.llm.helpers import LONG, MIXED, frame


def brute(doc_id, text):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def rows_of():
    rng = random.Random(4)
    made = [(100 + i, "".join(rng.choices(["a", "Zq", "é", " ", "\n", "𝒳", "<", "S>", "7", "word"], k=rng.randint(0, 300))), "a") for i in range(120)]
    marked = [(300, "has <S> inside", "a"), (301, "ends with <", "a"), (302, "<S", "a"), (303, "P><S M>", "a"), (304, "x" * 70_000, "a"), (305, "\n" * 40_000, "a"), (306, "ab " * 64, "a"), (307, "é" * 64, "a")]
    return made + marked + [(400, LONG, "a")] * 3 + [(None, LONG, "a"), (None, "other", "b")] + MIXED


@pytest.mark.parametrize("a_row", [1, 3, 64])
def test_cuts_are_those_of_brute_force_whatever_the_rows(spark, a_row):
    rows = rows_of() if a_row > 1 else [r for r in rows_of() if len(r[1] or "") < 1000]
    docs = frame(spark, rows).withColumnsRenamed({"digest_": "fim", "t": "K1", "Mix_size": "n"})
    out = fim.fill_in_middle(docs, units_a_row=a_row)
    assert out.columns == [*docs.columns, "fim_"]
    made = out.withColumn("back", fim.restored(out["fim_.output"], out["fim_.form"])).collect()
    got = sorted(((r["doc_id"], r["text"], tuple(r["fim_"]), r["back"]) for r in made), key=repr)
    assert got == sorted(((i, t, brute(i, t), t or "") for i, t, _ in rows), key=repr)
    forms = {r["fim_"]["form"] for r in made}
    assert forms == {"plain", "psm", "spm"}


def test_no_rows(spark):
    assert fim.fill_in_middle(frame(spark, MIXED).limit(0)).count() == 0


def test_texts_are_matched_once_and_counts_travel_once(spark):
    docs = spark.createDataFrame([(1, 2, 3, 4, "some text")], "k1 long, k2 long, h1 long, h2 long, t string")
    plan = fim.cut_places(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
