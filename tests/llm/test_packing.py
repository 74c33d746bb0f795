import numpy as np

from caseloom.llm import packing
from tests.llm.helpers import MIXED, frame


def test_karmarkar_karp_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 500, 400)
    w = packing.karmarkar_karp(sizes, 20)
    loads = np.bincount(w, weights=sizes, minlength=20)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() <= 10
    assert len(packing.karmarkar_karp(np.zeros(0, int), 3)) == 0


def test_ids_are_those_of_the_vocabulary_file():
    e = packing.Encoder(packing.tokenizer_path())
    for text in ("", "Hello  world\n\n it's 12 – ok", "<|endoftext|> x", "ß é 漢字 \t\r\n", " " * 50, "a" * 3000):
        assert e.ids(text).tolist() == e.slow(text)
    long = "word other\n  thing " * 90_000
    assert e.ids(long).tolist() == e.slow(long)


def test_every_id_is_in_one_piece(spark):
    docs = frame(spark, MIXED)
    out = packing.pack_documents(docs, block_windows=4).toPandas()
    e = packing.Encoder(packing.tokenizer_path())
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.append(0, g.length.cumsum().to_numpy()[:-1]).tolist()
        n = g.length.sum()
        assert g.padded_length.iloc[0] == 2048 or (n & (n - 1) == 0 and g.padded_length.iloc[0] == n)
    for i, text, _ in MIXED:
        if i not in (6, None):
            g = out[out.doc_id == i].sort_values("start")
            ids = np.concatenate([np.frombuffer(b, "<u4") for b in g.ids])
            assert ids.tolist() == [*e.ids(text or "").tolist(), 1] and (g.doc_tokens == len(ids)).all()
    assert (out[out.doc_id == 6].start == 0).sum() == 2 and out.doc_id.isna().sum() == 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_ids_are_those_of_an_untouched_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    for text in ("", "<|endoftext|> x", "a <|endoftext|><|endoftext|>\n\n b", "plain  words\t and more", "naïve 𝒳 \r\n  end ", " ".join(f"w{i}" for i in range(3000)) + "<|endoftext|>"):
        assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_tiny_texts_are_packed_in_bounded_memory():
    import time
    import tracemalloc

    packer, start = packing._Packer(2048, 512, 256, 8, 0), time.perf_counter()
    loads, seen = {}, 0
    tracemalloc.start()
    for source in ((packer.add((i, np.ones(1, "<u4")), 1) for i in range(600_000)), [packer.flush(last=True)]):
        for pieces in source:
            for _, at, size, seq, offset in pieces:
                assert at == 0 and size == 1 and offset == loads.get(seq, 0)
                loads[seq] = offset + size
                seen += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == sum(loads.values()) == 600_000 and max(loads.values()) <= 2048 and peak < 300e6 and time.perf_counter() - start < 120
    assert sum(2048 - n for n in loads.values() if n & (n - 1)) < 0.01 * 600_000


def test_bundles_keep_order_and_bound():
    place, sizes = packing.bundles([5, 60, 70, 128, 1, 1, 500, 2], 128)
    assert place.tolist() == [0, 0, 1, 2, 3, 3, 4, 5] and sizes.tolist() == [65, 70, 128, 2, 500, 2]


def test_a_worker_has_one_encoder_whatever_its_tasks():
    path = packing.tokenizer_path()
    assert packing.encoder_of(path) is packing.encoder_of(path)
