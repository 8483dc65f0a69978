import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from reportmill.llm import _common as c
from reportmill.llm import _files as files
from reportmill.llm import packing, sstable
from reportmill.llm._ids import ChunkEncoder
from reportmill.llm.queries import tokenizer_path
from tests.llm.odd import ROWS, documents

NAMES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
TEXTS = [
    "", " a", "a  b", "  a b", "a \n b", "a  b", "x ́y", "it 's 't", "can't, we'll. y'all., z", "<|endoftext|> a<|endoftext|>. <|endoftext|>,",
    "İstanbul İ ΑΣ Σ ΑΣ. x", "é́ e ́", "5. a5., x².", "tab\tand\rreturn \x0b x", "日本語 テキスト。 a", "end ", ". , .. a",
]


def whole(name, text):
    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("name,lead", NAMES)
def test_chunks_encode_as_whole_texts(name, lead, spark, sf):
    encoder = ChunkEncoder(tokenizer_path(name), lead, most=2000)  # so few that chunks are forgotten and learnt again
    plain = Tokenizer.from_file(tokenizer_path(name))
    texts = TEXTS + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:80])


@pytest.mark.parametrize("name,lead", NAMES)
def test_odd_characters_encode_as_whole_texts(name, lead):
    """Random short texts of characters that normal forms, cases, marks, stops and special tokens make odd."""
    encoder, plain = ChunkEncoder(tokenizer_path(name), lead, most=500), Tokenizer.from_file(tokenizer_path(name))
    pool = [*"aAzZ09 .,  '’-\n\té", "İ", "ı", "ß", "ẞ", "Σ", "ς", "ŉ", "ǰ", "ΐ", "ﬁ", "\u0301", "\u0307", "\u0345", "\u200d", "\u00a0", "\u2028", "\u1680", "\x1c", "\x85", "\u212b", "\u1100", "\u1161", "\u11a8",
            "각", "日", "١", "²", "Ⅷ", "①", "𝔸", "🙂", "क", "्", "א", "ְ", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "ALİ.", "x.", "\ufb1d", "\ua7cb", "\U00010d50"]
    draw = np.random.default_rng(11)
    texts = ["".join(pool[i] for i in draw.integers(0, len(pool), n)) for n in draw.integers(1, 12, 30_000)]
    for text, e in zip(texts, plain.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), np.uint32).tolist() == e.ids, repr(text)


def test_best_fit_decreasing_is_brute_force():
    draw = np.random.default_rng(3)
    for window in (7, 64, 100):
        lengths = sorted(draw.integers(1, window + 1, 200).tolist(), reverse=True)
        rooms, expected = [], []
        for x in lengths:
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                rooms.append(window - x)
        placed = packing.best_fit_decreasing(lengths, window)
        used = Counter()
        for (at, offset), x in zip(placed, lengths):
            assert offset == used[at]
            used[at] += x
        assert sorted(window - u for u in used.values()) == sorted(rooms)


@pytest.mark.parametrize("clashes", [False, True])
def test_packing_keeps_every_id(spark, clashes):
    name, window = "word_bpe_49k.json", 256
    rows = packing.pack_documents(documents(spark, clashes=clashes), tokenizer_path(name), window, shard_tokens=20_000).collect()
    expected = Counter()
    for doc_id, text, *_ in ROWS:
        ids = whole(name, text)
        for at in range(0, len(ids), window):
            piece = np.array(ids[at : at + window], "<u4").tobytes()
            expected[(doc_id, at, len(piece) // 4, zlib.crc32(piece), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(by) == list(range(len(by)))


def test_packing_of_nothing(spark):
    assert packing.pack_documents(documents(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("clashes", [False, True])
def test_shards_round_trip(spark, clashes):
    name = "byte_bpe_50k.json"
    shards = sstable.write_shards(documents(spark, clashes=clashes), tokenizer_path(name), c.scratch(spark, "t"), shards=3)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.read_shards(shards).collect()))
    assert Counter((d, n, crc) for _, d, n, crc in got) == Counter((r[0], len(whole(name, r[1])), zlib.crc32(np.array(whole(name, r[1]), "<u4").tobytes())) for r in ROWS)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [-1 if g[1] is None else g[1] for g in got]
    assert ids == sorted(ids)
    looked_up = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.lookup_digests(shards, documents(spark, clashes=clashes)).collect())
    assert looked_up == got


def test_shard_lookup_finds_what_is_there(spark):
    name = "byte_bpe_50k.json"
    shards = sstable.write_shards(documents(spark), tokenizer_path(name), c.scratch(spark, "t"), shards=3)
    wanted = spark.createDataFrame([(1,), (3,), (9,), (77,), (2**53 + 1,), (None,)], "doc_id long")
    got = Counter((r.doc_id, tuple(r.ids)) for r in sstable.lookup(shards, wanted).collect())
    assert got == Counter((r[0], tuple(whole(name, r[1]))) for r in ROWS if r[0] in (1, 3, 9, 2**53 + 1, None))


def test_bloom_filter_and_blocks(tmp_path):
    path = str(tmp_path / "x.sst")
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f, block_bytes=64)
        for i in range(-50, 500, 2):
            w.add(sstable.key_of(i), np.array([abs(i), 70_000 if i % 10 == 0 else 1], "<u4").tobytes())
        w.close()
    r = sstable.ShardReader(path, files.RangeReader())
    assert len(r.blocks) > 10 and r.documents == 275 and r.tokens == 550
    for i in range(-50, 500, 2):
        assert [x.tolist() for x in r.get(i)] == [[abs(i), 70_000 if i % 10 == 0 else 1]]
    assert not any(r.get(i) for i in range(-51, 501, 2))
    assert sum(r.may_hold(i) for i in range(1001, 3001)) < 60


def test_empty_table_makes_no_shard(spark):
    shards = sstable.write_shards(documents(spark, []), tokenizer_path("byte_bpe_50k.json"), c.scratch(spark, "t"))
    assert shards.count() == 0 and sstable.read_shards(shards).count() == 0
