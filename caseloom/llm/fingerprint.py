"""Document fingerprints as invertible Bloom lookup sketches. DataFrame functions only.

A text is cut into paragraphs after words that its own content selects: 16 words on average
(level 4), whatever its length. The digest of each distinct paragraph goes to one cell in
each of three parts of the sketch; a cell keeps a count, the xor of its digests and the xor
of their checks. Subtracting two sketches cancels what the texts share; cells left with one
digest give it up, and taking it from its other cells frees further ones, until the
differing digests are known. If cells remain, the two texts are sketched again with more
cells, at last three times as many as both have digests.

A text under 1344 characters would have few paragraphs; its fingerprint also has a sketch of
shorter ones. Two fingerprints are compared at the level of their finest paragraphs if that
is the same, else at level 4, which every fingerprint has: so any two can be subtracted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm import common

#: Cells in each of the three parts of a fingerprint.
WIDTH = 16
#: Of the first retry.
RETRY = 64
#: Smallest digests that a fingerprint holds.
LEAST = 32
ROUNDS = 8
#: A paragraph of a long text has about 2^MAX_LEVEL words.
MAX_LEVEL = 4
#: A paragraph ends after as many words where none is selected, as in one word said a thousand times.
MAX_WORDS = 64
_SPACE = r"[\x20\x09-\x0D]+"
_CELL = "struct<n: int, key: bigint, check: bigint>"


def level_of(n_chars: Column) -> Column:
    rising = F.floor(F.log2(F.greatest(n_chars, F.lit(1)) / F.lit(42.0))).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), rising))


def paragraph_digests(text: Column, level: Column) -> Column:
    """The distinct 60-bit digests of a text's content-defined paragraphs, in order."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1
    cut = lambda w: F.when(F.xxhash64(w).bitwiseAND(mask) == 0, F.concat(w, F.lit("\x01"))).otherwise(w)
    marked = F.array_join(F.transform(F.split(text, _SPACE), cut), " ")
    ended = lambda s: F.split(F.regexp_replace(F.trim(s), f"((?:[^ ]++ ){{{MAX_WORDS}}})", "$1\x01"), "\x01")
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    parts = F.flatten(F.transform(F.split(marked, "\x01"), lambda s: F.when(spaces(s) > MAX_WORDS, ended(s)).otherwise(F.array(s))))
    parts = F.filter(parts, lambda s: F.trim(s) != "")
    return F.sort_array(F.array_distinct(F.transform(parts, lambda s: F.shiftrightunsigned(F.xxhash64(F.trim(s)), 4))))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.cast("bigint").alias("key"), check.cast("bigint").alias("check"))


def _check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))


#: Cells of a part: a power of two, or (low bits, the highest number that they make, the highest that the high bits make).
Width = int | tuple[Column, Column, Column]


def _places(width: Width) -> tuple[Column, Column, Column]:
    if not isinstance(width, int):
        return width
    bits = width.bit_length() - 1
    low = bits // 2
    return F.lit(low), F.lit((1 << low) - 1), F.lit((1 << (bits - low)) - 1)


def _sums(entries: Column, width: Width) -> Column:
    """The cells of three parts for entries (n, key); part j takes its place from the bits 16 * j on, dealt high bits first."""
    low, lows, highs = _places(width)
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))
    add = lambda c, p: _cell(c["n"] + p["n"], c["key"].bitwiseXOR(p["key"]), c["check"].bitwiseXOR(_check(p["key"])))
    of = lambda p, at, top: F.call_function("shiftright", p["key"], at).bitwiseAND(top)
    each = lambda top: F.sequence(F.lit(0).cast("bigint"), top.cast("bigint"))
    cells = lambda own, j: F.transform(each(lows), lambda i: F.aggregate(F.filter(own, lambda p: of(p, F.lit(16 * j), lows) == i), zero, add))
    part = lambda j: F.flatten(F.transform(F.transform(each(highs), lambda i: F.filter(entries, lambda p: of(p, F.lit(16 * j) + low, highs) == i)), lambda own: cells(own, j)))
    return F.concat(part(0), part(1), part(2))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])))


def sketch(digests: Column, width: Width = WIDTH) -> Column:
    """The cells of three parts."""
    return _sums(F.transform(digests, lambda k: F.struct(F.lit(1).alias("n"), k.alias("key"))), width)


def difference(a: Column, b: Column, width: Width = WIDTH) -> Column:
    """What peeling the difference of two sketches recovers: (only_a, only_b), or null if it stops early."""
    cells = _minus(a, b)
    none = F.array().cast("array<struct<n: int, key: bigint>>")

    def peel(s: Column, _: Column) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"])))
        pure = F.array_distinct(F.transform(pure, lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"))))
        return F.struct(s["cells"].alias("cells"), s["found"].alias("found"), pure.alias("pure"))

    def take(s: Column) -> Column:
        return F.struct(
            F.when(F.size(s["pure"]) == 0, s["cells"]).otherwise(_minus(s["cells"], _sums(s["pure"], width))).alias("cells"),
            F.concat(s["found"], s["pure"]).alias("found"), none.alias("pure"),
        )

    start = F.struct(cells.alias("cells"), none.alias("found"), none.alias("pure"))
    turn = lambda s, i: F.when(F.pmod(i, F.lit(2)) == 0, peel(s, i)).otherwise(take(s))
    side = lambda found, n: F.transform(F.filter(found, lambda p: p["n"] == n), lambda p: p["key"])
    done = lambda s: F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0)), F.struct(side(s["found"], 1).alias("only_a"), side(s["found"], -1).alias("only_b")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, turn, done)


def _likeness(n_a: Column, n_b: Column, n_only_a: Column) -> Column:
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise(2.0 * (n_a - n_only_a) / (n_a + n_b))


def common_least(a: Column, b: Column) -> Column:
    """Of the LEAST smallest digests of either or both of two texts, as far as both texts' own smallest tell: struct(common, of)."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, LEAST)
    return F.struct(F.size(F.array_intersect(F.array_intersect(a, b), both)).alias("common"), F.size(both).alias("of"))


def likeness(n_a: Column, n_b: Column, cells_a: Column, cells_b: Column, least_a: Column, least_b: Column, again: list[Column]) -> Column:
    """Share of common paragraphs, 2 * common / (n_a + n_b), found by peeling the difference of two sketches; 1 for two empty texts.

    again: what peeling larger sketches of the same texts recovers, smaller ones first; one is
    looked at only where those before it have not ended. Fingerprints without a common smallest
    digest are 0 alike. Where the largest sketch fails too, the smallest digests estimate.
    """
    none = F.array().cast("array<bigint>")
    least = common_least(least_a, least_b)
    same = F.when((n_a == n_b) & (cells_a == cells_b), F.struct(none.alias("only_a"), none.alias("only_b")))
    share = least["common"] / least["of"]
    peeled = _likeness(n_a, n_b, F.size(F.coalesce(same, difference(cells_a, cells_b), *again)["only_a"]))
    apart = (n_a + n_b > 0) & ~F.arrays_overlap(least_a, least_b)
    return F.when(apart, F.lit(0.0)).otherwise(F.coalesce(peeled, 2 * share / (1 + share)))


def _sketch_text(level: Column, digests: Column, cells: Column) -> Column:
    one = lambda c, i: F.when(c["n"] != 0, F.concat(i.cast("string"), F.lit(":"), c["n"].cast("string"), F.lit(":"), F.lower(F.hex(c["key"])), F.lit(":"), F.lower(F.hex(c["check"]))))
    least = F.transform(F.slice(digests, 1, LEAST), lambda k: F.lower(F.hex(k)))
    return F.concat_ws("|", level.cast("string"), F.size(digests).cast("string"), F.array_join(F.transform(cells, one), ","), F.array_join(least, ","))


def parsed(fingerprint: Column) -> Column:
    """The parts of a fingerprint's string, by level: map of struct(n, cells, least)."""
    number = lambda x: F.conv(x, 16, 10).cast("bigint")
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))

    def cells(text: Column) -> Column:
        parts = F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: F.split(x, ":"))
        table = F.map_from_entries(F.transform(parts, lambda x: F.struct(x[0].cast("int").alias("k"), _cell(x[1].cast("int"), number(x[2]), number(x[3])).alias("v"))))
        return F.transform(F.sequence(F.lit(0), F.lit(3 * WIDTH - 1)), lambda i: F.coalesce(F.try_element_at(table, i), zero))

    fields = F.transform(F.split(fingerprint, ";"), lambda x: F.split(x, r"\|"))
    least = lambda text: F.transform(F.filter(F.split(text, ","), lambda x: x != ""), number)
    own = lambda x: F.struct(x[1].cast("int").alias("n"), cells(x[2]).alias("cells"), least(x[3]).alias("least"))
    return F.map_from_entries(F.transform(fields, lambda x: F.struct(x[0].cast("int").alias("level"), own(x).alias("own"))))


def likeness_of(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints' strings alone: by peeling, or estimated from their smallest digests where it stops."""
    fine = lambda x: F.array_min(F.map_keys(x))
    level = F.when(fine(a) == fine(b), fine(a)).otherwise(MAX_LEVEL)
    x, y = F.try_element_at(a, level), F.try_element_at(b, level)
    return likeness(x["n"], y["n"], x["cells"], y["cells"], x["least"], y["least"], [])


def digests_of(df: DataFrame, **texts: str) -> DataFrame:
    """df with, for each name=text column: name_level, name_digests, and name_digests4, those at level 4 where that isn't the text's own level, else null.

    All names go in a few steps, as every step analyses the whole plan again.
    """
    df = df.withColumns({f"{n}_level": level_of(F.length(t)) for n, t in texts.items()})
    own = {f"{n}_digests": paragraph_digests(F.col(t), F.col(f"{n}_level")) for n, t in texts.items()}
    return df.withColumns({**own, **{f"{n}_digests4": F.when(F.col(f"{n}_level") < MAX_LEVEL, paragraph_digests(F.col(t), F.lit(MAX_LEVEL))) for n, t in texts.items()}})


def cells_of(df: DataFrame, *names: str, others: tuple[str, ...] = ()) -> DataFrame:
    """df with name_cells and name_cells4, the sketches of the digests; level 4 is the own level of long texts. Others get no sketches."""
    parts = [f"{n}_{part}" for n in names for part in ("digests", "digests4")]
    df = df.withColumn("sketches", F.transform(F.array(*parts), lambda d: F.when(d.isNotNull(), sketch(d))))
    at = lambda n, i: F.get("sketches", F.lit(2 * names.index(n) + i))
    df = df.withColumns({**{f"{n}_cells": at(n, 0) for n in names}, **{f"{n}_cells4": F.coalesce(at(n, 1), at(n, 0)) for n in names}, **{f"{n}_digests4": F.coalesce(f"{n}_digests4", f"{n}_digests") for n in (*names, *others)}})
    return df.drop("sketches")


def as_text(name: str) -> Column:
    """A fingerprint as a string: for each level the level, the number of digests and the cells that are not empty, as place:count:key:check."""
    fine = _sketch_text(F.col(f"{name}_level"), F.col(f"{name}_digests"), F.col(f"{name}_cells"))
    return F.concat_ws(";", F.when(F.col(f"{name}_level") < MAX_LEVEL, fine), _sketch_text(F.lit(MAX_LEVEL), F.col(f"{name}_digests4"), F.col(f"{name}_cells4")))


def nearness(df: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """df with, for each out=(a, b), the likeness of two texts' fingerprints at the level that they are compared at.

    Retries have RETRY cells a part where the digests are few enough for it, then as many as
    both texts have digests, rounded up, then four times as many. A text without columns of
    cells is sketched where it has a smallest digest in common with the other one.
    """
    ones = lambda bits: F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1

    def sides(a: str, b: str) -> Column:
        fine = F.col(f"{a}_level") == F.col(f"{b}_level")
        pick = lambda x, part: F.when(fine, F.col(f"{x}_{part}")).otherwise(F.col(f"{x}_{part}4"))
        known = lambda x: pick(x, "cells") if f"{x}_cells" in df.columns else F.lit(None).cast(f"array<{_CELL}>")
        return F.struct(*[c.alias(f"{part}_{side}") for side, x in (("a", a), ("b", b)) for part, c in (("digests", pick(x, "digests")), ("cells", known(x)))])

    def wider(p: Column) -> Column:
        low = F.ceil(F.log2(F.greatest(F.size(p["digests_a"]) + F.size(p["digests_b"]), F.lit(2))) / 2).cast("int")
        return F.struct(p.alias("p"), low.alias("low"), ones(low).alias("ones"), ones(low + 1).alias("more"))

    def near(x: Column) -> Column:
        p = x["p"]
        a, b = p["digests_a"], p["digests_b"]
        peeled = lambda width: difference(sketch(a, width), sketch(b, width), width)
        retries = [F.when(F.size(a) + F.size(b) <= 2 * RETRY, peeled(RETRY)), peeled((x["low"], x["ones"], x["ones"])), peeled((x["low"] + 1, x["more"], x["more"]))]
        cells = [F.coalesce(p[f"cells_{side}"], sketch(x)) for side, x in (("a", a), ("b", b))]
        return likeness(F.size(a), F.size(b), *cells, F.slice(a, 1, LEAST), F.slice(b, 1, LEAST), retries)

    df = df.withColumn("pairs", F.transform(F.array(*[sides(a, b) for a, b in pairs.values()]), wider)).withColumn("nears", F.transform("pairs", near))
    return df.withColumns({out: F.get("nears", F.lit(i)) for i, out in enumerate(pairs)}).drop("pairs", "nears")


def fingerprint(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint, a string, of each row; equal texts have equal ones.

    A null text is empty, and its fingerprint has no paragraphs. Repeated rows, null ids and
    texts of any length each get their row; other columns are not read; no rows give none.
    """
    out = docs.select(F.col(id_column), common.text_of(F.col(text_column).cast("string")).alias("own_text"))
    out = cells_of(digests_of(out, own="own_text"), "own")
    return out.select(id_column, as_text("own").alias("fingerprint"))


def previous_of(keys: DataFrame, by: list[str], carried: list[str]) -> DataFrame:
    """Each row of keys (unique by its order columns) with the one before it as prev_*; the first gets the last.

    Range partitions are numbered and kept; only each partition's last row goes to a window
    over all of them.
    """
    names = [*by, *carried]
    r = common.durable(keys.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(*by)
    inside = r.withColumn("prev", F.lag(F.struct(*names)).over(own))
    lasts = r.groupBy("part").agg(F.max(F.struct(*names)).alias("last"))
    order = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("before"))
    out = inside.join(lasts, "part").withColumn("prev", F.coalesce("prev", "before"))
    return out.select(*names, *[F.col(f"prev.{n}").alias(f"prev_{n}") for n in names])


def compare_with_edit(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document beside its edited text and the next document.

    The edited text has the last half of the code points replaced by as many of the next
    document's first (or all it has). Documents are ordered by id, null first, then by a
    hash of the text; equal rows are one document and each get its row; the last one's next
    is the first. Columns: doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is empty. A sole document is its own next.
    """
    text = common.text_of(F.col(text_column).cast("string"))
    none = F.lit(-(1 << 63))  # stands for a null id; both uses of the texts then share one exchange
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), none).alias("k"), text.alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    order = previous_of(rows.select("k", "h", F.length("t").cast("long").alias("n")).distinct(), ["k", "h"], ["n"])
    placed = rows.join(order, ["k", "h"])
    first = Window.partitionBy("k", "h").orderBy(F.lit(0))
    heads = placed.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    half = F.floor(F.col("prev_n") / 2).cast("int")
    heads = digests_of(heads.select(F.col("prev_k").alias("k"), F.col("prev_h").alias("h"), F.substring(F.col("t"), F.lit(1), half).alias("next_head"), "t"), next="t")
    both = placed.select("k", "h", "t", "n").join(heads.drop("t"), ["k", "h"])
    keep = (F.col("n") - F.floor(F.col("n") / 2)).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), keep), F.col("next_head")))
    both = cells_of(digests_of(both, own="t", edited="edited"), "own", "edited", others=("next",))
    both = nearness(both, near_edited=("own", "edited"), near_next=("own", "next"))
    return both.select(F.when(F.col("k") != none, F.col("k")).alias(id_column), F.col("n").alias("n_chars"), "edited", as_text("own").alias("fingerprint"), as_text("edited").alias("edited_fingerprint"), "near_edited", "near_next")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's."""
    out = compare_with_edit(common.table(spark, sf_dir, "documents"))
    return out.withColumn("edited_sha256", F.sha2("edited", 256)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
