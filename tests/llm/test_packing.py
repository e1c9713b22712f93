import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import WordEncoder, best_two_fit, pack_documents, pack_pieces, tightest_pair
from tessera.llm.queries import tokenizer_path
from tessera.llm.shared import Table
from tests.llm.data import documents, frame

ODD = ["", "  ", "It's  the DON'T\u00a0stop\u2003x", "a\u0301 e\u0301\n\u0301", "<|endoftext|> <|startoftext|>x", "\x1c\x1d\x85 日本語 ΣΑΣ İ ǅ", "1234 5.6e7 ½ ²", "a\tb\x0bc\x0cd\re", "x" * 3000, "'s 't're !!!??", "\x00 \ufffd 😀👩‍👩‍👧"]


def test_encoder_gives_the_ids_of_whole_texts():
    whole, own = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path(), max_words=50)
    texts = ODD + [r[1] for r in documents() if r[1]]
    for _ in range(2):
        ids, ends = own.encode(pa.array([*texts, None]))
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids
        assert ends[-1] == ends[-2]


def test_letters_next_to_punctuation():
    whole, own = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path())
    signs = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    texts = [t for c in map(chr, range(0xC0, 0x280)) for p in signs for t in (f"gel{c}{p}", f"{p}{c}x", f"a{p}{c}{p}b {c}")]
    ids, ends = own.encode(pa.array(texts))
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [t for i, t in enumerate(texts) if ids[ends[i] : ends[i + 1]].tolist() != want[i]] == []


def test_tightest_pair():
    left = np.zeros(101, int)
    left[[3, 10, 40]] = [1, 1, 2]
    assert sum(tightest_pair(left, 80)) == 80 and sum(tightest_pair(left, 79)) == 50 and tightest_pair(left, 12) is None
    assert sum(tightest_pair(left, 13)) == 13


def test_smallest_gives_way_to_a_tighter_pair():
    # greedy: 60 + 30, gap 10; 30 gives way to 21 + 19
    bins, offsets = best_two_fit(np.array([60, 30, 21, 19]), 100)
    assert bins.tolist() == [0, 1, 0, 0]


@pytest.mark.parametrize("capacity", [50, 1000])
def test_bins_are_gapless_and_few(capacity):
    lengths = np.random.default_rng(2).integers(1, capacity // 2, 3000)
    bins, offsets = best_two_fit(lengths, capacity)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= capacity and len(fill) <= -(-lengths.sum() // capacity) + 1
    for b in range(0, len(fill), 50):
        own = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][own] == np.concatenate([[0], np.cumsum(lengths[bins == b][own])[:-1]])).all()


def test_documents(spark):
    rows = documents()
    got = pack_documents(frame(spark, rows), tokenizer_path(), capacity=512).collect()
    whole = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in rows:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r[0], k, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted(map(str, want)) == sorted(str((g.doc_id, g.piece, g.start, g.length, g.ids_crc32)) for g in got)
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 512
    assert len(bins) <= -(-sum(w[3] for w in want) // 512) + 2


def test_groups_are_repacked(spark):
    rows = Table(spark.range(2000).selectExpr("id", "1 + (id * 7919) % 900 as length"), "t").df
    got = pack_pieces(rows, 1000, group_rows=300).collect()
    assert len(got) == 2000
    fill = defaultdict(int)
    for g in got:
        fill[g.sequence_id] += g.length
    assert max(fill.values()) <= 1000 and len(fill) <= 1.02 * sum(fill.values()) / 1000 + 1


def test_empty(spark):
    assert pack_documents(frame(spark, documents()).limit(0), tokenizer_path()).collect() == []
