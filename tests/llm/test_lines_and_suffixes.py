from caseloom.llm import lines, suffixes
from tests.llm.helpers import LONG, MIXED, frame, words


def test_spread_lines_go_but_for_the_first(spark):
    rows = [(i, f"own text number {i}, which is long enough to stay whole\ncookie notice\n\nmore of {i}", f"s{i % 9}") for i in range(18)]
    out = {r["doc_id"]: r for r in lines.drop_spread_lines(frame(spark, rows + MIXED[:3])).collect()}
    assert out[0]["removed_lines_"] == 0 and "cookie" in out[0]["text"]
    assert all(out[i]["removed_lines_"] == 1 and out[i]["text"] == rows[i][1].replace("cookie notice\n", "") for i in range(4, 18))
    few = {r["doc_id"]: r["removed_lines_"] for r in lines.drop_spread_lines(frame(spark, [(i, t, f"s{i % 7}") for i, t, _ in rows])).collect()}
    assert set(few.values()) == {0}
    copies = lines.drop_spread_lines(frame(spark, [(i, "the same\ncopy", f"s{i}") for i in range(20)])).collect()
    assert all(r["removed_lines_"] == 0 for r in copies)
    mixed = lines.drop_spread_lines(frame(spark, MIXED)).collect()
    assert len(mixed) == len(MIXED) and lines.drop_spread_lines(frame(spark, MIXED).limit(0)).count() == 0


def test_mostly_boilerplate_is_cleaned_unless_a_copy(spark):
    notice = "a notice that is on every site there is"
    rows = [(i, f"{notice}\nown {i}", f"s{i}") for i in range(12)] + [(20 + i, f"{notice}\nown 0", f"s{i}") for i in range(3)]
    out = {r["doc_id"]: r["text"] for r in lines.drop_spread_lines(frame(spark, rows)).collect()}
    assert all(out[i] == f"own {i}" for i in range(1, 12))
    assert {out[i] for i in (0, 20, 21, 22)} == {f"{notice}\nown 0"}


def test_passages_equal_brute_force(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(10, f"a1 a2 {shared} a3", "a"), (11, " ".join(f"q{i}" for i in range(70)) + " " + shared.upper(), "b"), (12, " ".join(f"p{i}" for i in range(49)), "a"), (13, f"{shared} {shared}", "c"), (14, " ".join(["r"] * 300), "c"), (15, LONG, "b"), *MIXED]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffixes.repeated_passages(frame(spark, rows)).collect()}
    n = len(words(LONG))
    assert got == {(10, 2, 62), (11, 70, 130), (13, 0, 120), (15, 0, n), (7, 0, n)}
    assert suffixes.repeated_passages(frame(spark, rows).limit(0)).count() == 0
