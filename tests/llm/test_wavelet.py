import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomwork.llm import wavelet as wv


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(wv.default_vocabulary())


def brute(rows, tokenizer):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def run(df, tmp_path):
    shards = wv.encode_corpus(df, f"file://{tmp_path}/shards")
    return sorted(map(tuple, wv.decode_corpus(shards).collect()), key=lambda r: r[1])


def test_round_trip_of_the_table(spark, tmp_path, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs, tmp_path) == brute(rows, tokenizer)


def test_edge_cases(spark, tmp_path, tokenizer):
    rows = [(5, None), (2, ""), (None, "no id"), (2, "b"), (2, "b"), (-7, "don't We'LL <|endoftext|> x"), (9, 'say "hi" ' * 20_000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, bucket string")
    assert run(df, tmp_path) == brute(rows, tokenizer)
    assert run(df.limit(0), tmp_path / "none") == []


TEXT = st.text(
    st.sampled_from(list("aAzZ'sSté ÉèßİıſK\t\n\r\x0b\x0c\x1c\x85\xa0 　​é́́ 0١Ⅷ½中文日本語한글🙂👩‍👩‍👧%$#|.,!\"_-<>")), max_size=60
)


@cache
def _probe():
    coder = wv.Pieces(wv.default_vocabulary())
    assert coder.by_pieces
    return Tokenizer.from_file(wv.default_vocabulary()), coder


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    tok, coder = _probe()
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(map(int, x)) for x in coder.texts([t.encode() for t in texts])] == want


def test_the_table_grows_and_starts_anew(monkeypatch, tokenizer):
    words = [f"word{chr(97 + i % 26)}{'q' * (i % 300)}{i} Pläne{chr(97 + i // 7 % 26)}x{chr(97 + i % 26)}!" for i in range(3000)]
    monkeypatch.setattr(wv, "CACHE_PIECES", 2000)
    coder = wv.Pieces(wv.default_vocabulary())
    for at in range(0, 3000, 1000):
        part = words[at : at + 1000]
        assert [x.tolist() for x in coder.texts([t.encode() for t in part])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
    coder.clear()
    h = np.arange(100_000, dtype=np.uint64) * np.uint64(1 << 16)  # all begin at one slot
    coder.add(h[:300], h[:300], [b"ab"] * 300)
    assert coder.find(h[:301], h[:301]).tolist() == [*range(300), -1]


def test_rank_select_access_locate(monkeypatch):
    monkeypatch.setattr(wv, "BLOCK_BITS", 64)
    monkeypatch.setattr(wv, "STEP", 16)
    rng = np.random.default_rng(4)
    tokens = (rng.zipf(1.3, 900) % 49_408).astype(np.uint16)
    s = wv.Shard(wv.pack_shard(tokens, [1, None], [400, 500]))
    assert s.doc_ids == [1, None] and (s.tokens() == tokens).all()
    assert [s.access(i) for i in range(900)] == tokens.tolist()
    for t in [*set(tokens[:40].tolist()), 49_000]:
        places = np.flatnonzero(tokens == t).tolist()
        assert s.count(t) == len(places) and s.locate(t) == places
        assert s.rank(t, 450) == sum(p < 450 for p in places)
    with pytest.raises(IndexError):
        s.select(49_407, 0)


def test_shards_close_and_long_documents_stay_whole(spark, tmp_path, monkeypatch, tokenizer):
    rows = [(i, f"word{i} " * (1 + i * 7 % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(wv, "SHARD_TOKENS", 500)
    assert run(df, tmp_path) == brute(rows, tokenizer)
