"""N-gram Jaccard join by a prefix tree over globally ordered shingle sets.

1. Equal sets are one node. A set can link only if at most n - ceil(t n) of its shingles
   are in no other set; so of any fixed share of the shingles (here those with an even
   hash) that many at most may be alone. An exchange of sorted runs finds which are alone;
   what has more of them links with nothing and goes no further.
2. The sets left get the global order by how many of them hold a shingle, exactly counted
   in a second exchange of runs, ties by hash. Two sets that link share a shingle within
   their prefixes (the rarest n - ceil(t n) + 1), so postings of prefixes route sets to
   partitions, one for the smallest member of each shingle's posting list.
3. The sets of a partition form a trie (module ``trie``); one traversal finds links
   enough to connect all that are connected. A large partition is cut into blocks that
   all hold the smallest member; what is not connected with the partition's main
   component after that meets every block once more.

Nothing emits pairs other than links, no list of candidates is capped, and nothing is
broadcast but the ids of at most ``FEW`` texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import common, partners, trie
from caseloom.llm import shingles as S

#: Shingles in a run that a map task sends, and in a slice that one task merges.
RUN, MERGED = 1_000_000, 4_000_000
#: Shingles in a stored chunk of sets.
CHUNK = 200_000
#: Sets, and shingles, of a block of a partition.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
#: From partitions of more sets than this go those without a possible partner.
CROWD = 128
#: So many ids of texts at most are broadcast; beyond it they are joined by a shuffle.
FEW = 100_000
_SEEN_BITS = 36
_SHARED = np.uint64(0xFFFFFFFFFFFFFFFF)


def _signatures(docs: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """Per row: id, h (hash of the text), n (size), d1, d2 (digest), even (shingles with an even hash)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), *S.digest(s), int(np.count_nonzero(s & np.uint64(1) == 0))) for s in S.shingle_sets(b.column(2), n)]
            cols = list(zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in cols]], names=["id", "h", "n", "d1", "d2", "even"])

    return _texts(docs, id_column, text_column).mapInArrow(run, f"id {kind}, h long, n long, d1 long, d2 long, even long")


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = common.text_of(F.col(text_column).cast("string"))
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))


def _planes(values: np.ndarray, width: int) -> bytes:
    """Ascending values as differences, byte by byte, which compresses well."""
    step = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(data: bytes, width: int) -> np.ndarray:
    step = np.zeros((len(data) // width, 8), np.uint8)
    step[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return np.cumsum(step.reshape(-1).view("<u8"), dtype=np.uint64)


def _bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal neighbours."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True))


def _bits(total: int) -> int:
    return max(0, (max(total, 1) // MERGED).bit_length())


def _shared_counts(texts: DataFrame, total: int, n: int) -> DataFrame:
    """d1, shared: how many shingles with an even hash each set has in common with any other set; at least.

    A map task sends, by slice of the hash range, each distinct shingle of a run of texts
    once, with the set that holds it unless several do; so a shingle that a third of all
    texts hold is sent once per run. Counts go back by slice of the digest. Hashes are kept
    to as many bits as make a false meeting rare; one only lets a set pass that could go.
    """
    bits = _bits(total)
    width = 5

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names: dict[int, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            values = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            new = np.append(True, values[1:] != values[:-1])
            first = np.flatnonzero(new)
            alone = np.diff(np.append(first, len(values))) == 1
            here = np.bincount(owner[~alone[np.cumsum(new) - 1]], minlength=len(held))
            digests = np.fromiter(names, np.uint64, len(names))
            keys, rows = [], []
            by = np.argsort(digests)
            for a, b in _bounds(digests[by] >> np.uint64(64 - bits) if bits else np.zeros(len(by))):
                keys.append(-1 - (int(digests[by[a]]) >> (64 - bits)))
                rows.append(digests[by[a:b]].tobytes() + here[by[a:b]].astype("<u4").tobytes())
            values, owner = values[first], np.where(alone, owner[first], len(held))
            which = values >> np.uint64(_SEEN_BITS)
            for a, b in _bounds(which):
                used, place = np.unique(owner[a:b], return_inverse=True)
                names_used = np.where(used < len(held), digests[np.minimum(used, len(held) - 1)], _SHARED)
                keys.append(int(which[a]))
                rows.append(np.array([b - a, len(used)], "<u4").tobytes() + _planes(values[a:b] & np.uint64((1 << _SEEN_BITS) - 1), width) + names_used.astype("<u8").tobytes() + place.astype("<u2").tobytes())
            held.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], names=["slice", "run"])

        for b in batches:
            for s in S.shingle_sets(b.column(0), n):
                name = S.digest(s)[0] & ((1 << 64) - 1) if len(s) else None
                if name is None or name in names:
                    continue
                names[name] = len(held)
                held.append(s[s & np.uint64(1) == 0] >> np.uint64(64 - _SEEN_BITS - bits))
                size += len(held[-1])
                if size > RUN or len(held) > 60_000:
                    yield out()
                    size = 0
        if size:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            values, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            new = np.append(True, values[1:] != values[:-1])
            first = np.flatnonzero(new)
            several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
            mine = several[np.cumsum(new) - 1] & (owner != _SHARED)
            digests, counts = np.unique(owner[mine], return_counts=True)
            bounds = _bounds(digests >> np.uint64(64 - bits) if bits else np.zeros(len(digests)))
            keys = [int(digests[a]) >> (64 - bits) for a, _ in bounds]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([digests[a:b].tobytes() + counts[a:b].astype("<u4").tobytes() for a, b in bounds], pa.binary())], names=["bucket", "counts"])

        for b in batches:
            for s, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != at and held:
                    yield out()
                at = s
                if s < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - s], pa.int64()), pa.array([r], pa.binary())], names=["bucket", "counts"])
                    continue
                k, m = (int(x) for x in np.frombuffer(r, "<u4", 2))
                owners = np.frombuffer(r, "<u8", m, 8 + width * k)
                held.append((_values(r[8 : 8 + width * k], width), owners[np.frombuffer(r, "<u2", k, 8 + width * k + 8 * m)]))
        if held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            digests, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            digests, place = np.unique(digests, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), pa.array(np.bincount(place, counts, len(digests)).astype(np.int64))], names=["d1", "shared"])

        for b in batches:
            for s, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != at and held:
                    yield out()
                at = s
                k = len(r) // 12
                held.append((np.frombuffer(r, "<u8", k), np.frombuffer(r, "<u4", k, 8 * k)))
        if held:
            yield out()

    sent = texts.select("t").mapInArrow(send, "slice long, run binary")
    merged = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "bucket long, counts binary")
    return merged.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "d1 long, shared long")


def _chunks(texts: DataFrame, n: int) -> DataFrame:
    """The sets of texts (node, t), many to a row: chunk, total, nodes, sizes, sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, size = [], [], 0

        def out() -> pa.RecordBatch:
            data = np.concatenate(sets).tobytes()
            names = np.array(nodes, "<i8").tobytes()
            row = [S.xxhash.xxh3_64_intdigest(names + data) >> 1, size, names, np.array([len(s) for s in sets], "<u4").tobytes(), data]
            nodes.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int64(), pa.int64()] + [pa.binary()] * 3, strict=True)], names=["chunk", "total", "nodes", "sizes", "sets"])

        for b in batches:
            for node, s in zip(b.column(0).to_pylist(), S.shingle_sets(b.column(1), n), strict=True):
                nodes.append(node)
                sets.append(s)
                size += len(s)
                if size > CHUNK:
                    yield out()
                    size = 0
        if nodes:
            yield out()

    return texts.select("node", "t").mapInArrow(run, "chunk long, total long, nodes binary, sizes binary, sets binary")


def _ordered(chunks: DataFrame, total: int, percent: int) -> DataFrame:
    """node, n, items (the set in the global order, common shingles first), tokens (its prefix's shingles that other sets hold)."""
    bits = _bits(total)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, sets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                values, counts = np.unique(np.frombuffer(sets, np.uint64), return_counts=True)
                which = values >> np.uint64(64 - bits) if bits else np.zeros(len(values), np.uint64)
                bounds = _bounds(which)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(which[a]) for a, _ in bounds], pa.int64()), pa.array([chunk] * len(bounds), pa.int64()), pa.array([_planes(values[a:b], 8) + counts[a:b].astype("<u4").tobytes() for a, b in bounds], pa.binary())],
                    names=["slice", "chunk", "run"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, held = None, [], []

        def out() -> pa.RecordBatch:
            values, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.cumsum([len(x) for x, _ in held])
            distinct, place = np.unique(values, return_inverse=True)
            level = np.floor(4 * np.log2(np.bincount(place, counts, len(distinct)))).astype(np.uint8)[place]
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([at] * len(names), pa.int64()), pa.array([x.tobytes() for x in np.split(level, ends[:-1])], pa.binary())], names=["chunk", "slice", "levels"])
            names.clear()
            held.clear()
            return batch

        for b in batches:
            for s, c, r in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if s != at and held:
                    yield out()
                at = s
                names.append(c)
                held.append((_values(r[: len(r) // 12 * 8], 8), np.frombuffer(r, "<u4", len(r) // 12, len(r) // 12 * 8)))
        if held:
            yield out()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[bytes] = []
        chunk = None

        def out() -> pa.RecordBatch:
            nodes, sizes, data = np.frombuffer(chunk[0], "<i8"), np.frombuffer(chunk[1], "<u4"), np.frombuffer(chunk[2], np.uint64)
            level = np.frombuffer(b"".join(levels), np.uint8)[np.unique(data, return_inverse=True)[1]]
            rows = []
            for node, end, size in zip(nodes.tolist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                s, lv = data[end - size : end], level[end - size : end]
                at = np.lexsort((s, lv))
                first = at[: size - -(-percent * size // 100) + 1]
                first = first[lv[first] > 0]
                if len(first):
                    rows.append((node, size, s[at[::-1]].tobytes(), s[first].view(np.int64)))
            cols = list(zip(*rows, strict=True)) if rows else ([], [], [], [])
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            levels.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["node", "n", "items", "tokens"])

        for b in batches:
            for s, lv, nodes, sizes, sets in zip(*[b.column(i).to_pylist() for i in range(1, 6)], strict=True):
                if s < 0:
                    if chunk:
                        yield out()
                    chunk = (nodes, sizes, sets)
                else:
                    levels.append(lv)
        if chunk:
            yield out()

    sent = chunks.select("chunk", "sets").mapInArrow(send, "slice long, chunk long, run binary")
    levels = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "chunk long, slice long, levels binary")
    none = F.lit(None).cast("binary")
    both = chunks.select("chunk", F.lit(-1).cast("long").alias("slice"), none.alias("levels"), "nodes", "sizes", "sets").unionByName(levels.select("chunk", "slice", "levels", none.alias("nodes"), none.alias("sizes"), none.alias("sets")))
    return both.repartition("chunk").sortWithinPartitions("chunk", "slice").mapInArrow(order, "node long, n long, items binary, tokens array<bigint>")


def _members(ordered: DataFrame, percent: int) -> DataFrame:
    """hub, node, n, blocks: the partitions' members; a hub is the smallest node of a prefix shingle's postings.

    In crowded partitions only sets with a possible partner stay, and the smallest of these is the hub.
    """
    postings = ordered.select("node", "n", F.explode("tokens").alias("token"))
    hubs = postings.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("many")).where("many > 1").select("token", "hub")
    members = common.kept(postings.join(hubs, "token").select("hub", "node", "n").distinct(), "members")
    sizes = members.groupBy("hub").agg(F.count("*").alias("sets")).where("sets > 1")
    sized = common.kept(members.join(sizes, "hub"), "sized")
    crowded = sized.where(F.col("sets") > CROWD).drop("sets")
    if not crowded.isEmpty():
        sets = crowded.select("node").distinct().join(ordered.select("node", "items"), "node")
        stay = crowded.join(partners.with_partners(sets, percent), "node")
        first = stay.groupBy("hub").agg(F.min("node").alias("first"))
        stay = stay.join(first, "hub").select(F.col("first").alias("hub"), "node", "n")
        sized = common.kept(sized.where(F.col("sets") <= CROWD).select("hub", "node", "n").unionByName(stay).distinct(), "members-with-partners")
    counts = sized.groupBy("hub").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    return sized.select("hub", "node", "n").join(counts.select("hub", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")), "hub")


def _block(name: str, blocks: str | Column = "blocks") -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks) if isinstance(blocks, str) else blocks).alias(name)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of equal leading columns, one group at a time."""
    at, held = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


def _links_within(members: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Links a, b that connect whatever any links within a block connect; a hub is in each block of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in _grouped(batches, 2):
            found = dict(rows)
            nodes = list(found)
            for x, y in trie.connected([np.frombuffer(found[k], np.uint64) for k in nodes], percent) if len(nodes) > 1 else ():
                a.append(nodes[x])
                b.append(nodes[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    block = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(_block("block")))
    dealt = members.select("hub", "node", F.explode(block).alias("block"))
    rows = dealt.join(ordered.select("node", "items"), "node").select("hub", "block", "node", "items")
    return rows.repartition("hub", "block").sortWithinPartitions("hub", "block").mapInArrow(run, "a long, b long")


def _links_across(members: DataFrame, ordered: DataFrame, label: DataFrame, percent: int) -> DataFrame | None:
    """Links between labels that are still missing in partitions of several blocks; None if there can't be any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in _grouped(batches, 3):
            sides = [[(mark, np.frombuffer(items, np.uint64)) for probe, mark, items in rows if probe == side] for side in (False, True)]
            if all(sides):
                (m_labels, m), (p_labels, p) = (list(zip(*x, strict=True)) for x in sides)
                for x, y in trie.connected_across(list(m), list(m_labels), list(p), list(p_labels), percent):
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    large = members.where("blocks > 1").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    large = common.kept(large, "large")
    counts = large.groupBy("hub", "label").agg(F.count("*").alias("many"), F.sum("n").alias("shingles"))
    main = counts.groupBy("hub").agg(F.max(F.struct("many", "label")).alias("main")).select("hub", F.col("main.label").alias("main"))
    left = counts.join(main, "hub").where("label <> main").groupBy("hub").agg(F.sum("many").alias("sets"), F.sum("shingles").alias("shingles"))
    left = left.select("hub", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("probe_blocks"))
    todo = common.kept(large.join(main.join(left, "hub"), "hub"), "todo")
    if todo.isEmpty():
        return None
    zero = F.lit(0).cast("long")
    as_member = todo.select("hub", F.explode(F.sequence(zero, F.col("probe_blocks") - 1)).alias("p"), _block("m"), F.lit(False).alias("probe"), "label", "node")
    as_probe = todo.where("label <> main").select("hub", _block("p", "probe_blocks"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("m"), F.lit(True).alias("probe"), "label", "node")
    rows = as_member.unionByName(as_probe).join(ordered.select("node", "items"), "node").select("hub", "p", "m", "probe", "label", "items")
    return rows.repartition("hub", "p", "m").sortWithinPartitions("hub", "p", "m").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable), for the nodes of links (a, b).

    Each round every node takes the smallest label among its neighbours' and hands it to the
    label it had, then takes its label's label; rounds grow with the logarithm of the
    longest chain.
    """
    both = common.durable(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("label"))
    while True:
        label = common.durable(label)
        seen = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("l"))
        step = label.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("new"))
        step = common.durable(step)
        pushed = step.select(F.col("node").alias("x"), "new").unionByName(step.where("new < old").select(F.col("old").alias("x"), "new")).groupBy("x").agg(F.min("new").alias("far"))
        if step.where("new < old").isEmpty():
            return label
        label = step.join(pushed.withColumnRenamed("x", "new"), "new").select("node", F.least("new", "far").alias("label"))


def _component_labels(docs: DataFrame, id_column: str, text_column: str, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame | None:
    """node, label of the nodes that link with any other; None where none can."""
    texts = _texts(docs, id_column, text_column)
    total = rows.agg(F.coalesce(F.sum("even"), F.lit(0))).first()[0]
    shared = _shared_counts(texts, total, n)
    alone = F.col("even") - F.coalesce("shared", F.lit(0))
    may_link = classes.join(shared.groupBy("d1").agg(F.sum("shared").alias("shared")), "d1", "left").where(alone <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100))
    may_link = common.kept(may_link.select("node", "n", "pick"), "may-link")
    count, total = may_link.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count < 2:
        return None
    picked = may_link.select("node", F.col("pick.id").alias("id"), F.col("pick.h").alias("h"))
    picked = F.broadcast(picked) if count <= FEW else picked
    found = texts.alias("x").join(picked.alias("y"), F.expr("x.h = y.h AND x.id <=> y.id")).select("y.node", "x.t")
    ordered = common.kept(_ordered(common.kept(_chunks(found, n), "chunks"), total, percent), "ordered")
    members = common.kept(_members(ordered, percent), "partitions")
    links = common.kept(_links_within(members, ordered, percent), "links")
    if links.isEmpty():
        label = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    else:
        label = components(links)
    more = _links_across(members, ordered, label, percent)
    if more is not None:
        known = label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        label = components(known.unionByName(common.kept(more, "more-links")))
    return label


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", n: int = 5, percent: int = 80, text_hash: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; with a name for it also the text's hash (xxhash64) and that of the component's first text, component_<name>.

    Two texts link when 100 * |A & B| >= percent * |A | B| for their sets of distinct n-word
    shingles (A-Z lower-cased; the whole sequence as one where there are fewer words). The
    component is the smallest id reachable over links. A null or empty text, or one of white
    space, has no shingles, links with nothing and is its own component. Null ids come out
    as they are, and are never a component's id unless all its ids are null. Equal rows are
    in one component. An empty table gives no rows; other columns are not read.
    """
    rows = common.kept(_signatures(docs, id_column, text_column, n), "signatures")
    key = ["n", "d1", "d2"]
    pick = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("pick")
    classes = rows.where("n > 0").groupBy(*key).agg(pick, F.first("even").alias("even"))
    classes = common.kept(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    label = _component_labels(docs, id_column, text_column, rows, classes, n, percent)
    if label is None:
        named = classes.select(*key, F.col("pick").alias("least"))
    else:
        named = classes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = named.groupBy("label").agg(F.min("pick").alias("least"))
        named = named.join(least, "label").select(*key, "least")
    out = rows.join(named, key, "left")
    of = lambda own, name: F.when(F.col("n") == 0, F.col(own)).otherwise(F.col(f"least.{name}"))
    hashes = [F.col("h").alias(text_hash), of("h", "h").alias(f"component_{text_hash}")] if text_hash else []
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), of("id", "id").alias("component_id"), *hashes)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are 85 % alike."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), n=4, percent=85)
