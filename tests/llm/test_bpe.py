import codecs
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from polyweave.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.load_ranks(PATH)
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, PATTERN)


def ids(text):
    packed = ENCODER(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    assert ids(text) == PUBLIC.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(40))
def test_pieces_without_breaks(seed):
    rnd = random.Random(seed)
    letters = rnd.choice(["ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "éèçñßö", "中文字", "-=#*"])
    text = "".join(rnd.choices(letters, k=rnd.choice([5, 60, 800])))
    assert ids(text) == PUBLIC.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=2, max_size=5).map(str.encode), st.integers(0, 10 ** 6), max_size=12), st.text("abc", max_size=30))
def test_any_ranks(extra, text):
    """Ranks in any order, also tokens that the merges never reach."""
    ranks = {bytes([b]): 10 ** 7 + b for b in range(256)}
    for token, rank in extra.items():
        ranks[token] = 2 * rank if 2 * rank not in ranks.values() else 10 ** 8 + len(ranks)
    assert list(struct.unpack(f"={len(p := bpe.Transducer(ranks).encode(text.encode())) // 4}I", p)) == bpe.merged(ranks, text.encode())


def test_full_tables_change_nothing(monkeypatch):
    for name in ("PIECES", "PAIRS", "FLUSH"):
        monkeypatch.setattr(bpe, name, 30)
    small = bpe.Encoder(RANKS, PATTERN)
    small.pieces.machine.limit = 5
    text = "The thonth aneable enblea, reation of the thing; unmöglich façade 12345 " * 3 + "Xyzzyabcdéfthing" * 40
    assert small(text) == ENCODER(text)
    assert ids(text) == PUBLIC.encode_ordinary(text)


def test_streams_may_cut_characters():
    text = "naïve 😀 中文 é" * 5
    names, found = bpe.names_of(RANKS), ids(text)
    stream = bpe.StreamDecoder(names)
    assert "".join(stream.feed([i]) for i in found) + stream.end() == text
    broken = bpe.StreamDecoder(names)
    assert broken.feed([RANKS[b"\xe4"]]) + broken.end() == "�"


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=40) | st.lists(st.sampled_from([b"\xe0", b"\xed", b"\xf0", b"\xf4", b"\xf5", b"\xc1", b"\xc2", b"\x80", b"\x9f", b"\xa0", b"\x8f",
                                                       b"\x90", b"\xbf", b"a"]), max_size=12).map(b"".join), st.integers(0, 40), st.booleans())
def test_stream_machine_reads_any_bytes(data, cut, few):
    """As the standard library does, in two runs and with or without kept steps."""
    stream = bpe.StreamDecoder([bytes([b]) for b in range(256)])
    stream.kept = bpe.PAIRS if few else 0
    for _ in range(2):  # a decoder can be used again
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.end() == data.decode("utf-8", "replace")
    plain, half = codecs.getincrementaldecoder("utf-8")("replace"), bpe.StreamDecoder([bytes([b]) for b in range(256)])
    assert half.feed(data[:cut]) == plain.decode(data[:cut])


def test_query_against_the_public_library(spark, small, texts):
    got = queries.op9_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        want = PUBLIC.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark):
    long = "Xyzzy" * 100000
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, " \n é", None), (3, long, "d"), (3, long, "d")], "doc_id long, text string, ids string")
    out = bpe.encoded(docs, PATH, PATTERN)
    rows = out.withColumn("back", bpe.decode_text("ids", PATH)).collect()
    assert out.columns == ["doc_id", "text", "ids", "n_tokens"]
    assert [r["back"] for r in rows] == ["", "", " \n é", long, long]
    assert [r["n_tokens"] for r in rows][:2] == [0, 0]
    assert bpe.digests(docs.limit(0), PATH, PATTERN).collect() == []
