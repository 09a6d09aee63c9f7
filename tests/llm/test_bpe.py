import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracewell.llm import bpe, token_files
from tracewell.llm.queries import tokenizer_path
from tracewell.llm.wordbpe import Codes, LibraryEncoder, SpeculativeEncoder, merged, merged_together, vocabulary

SCHEMA = "doc_id long, text string, ids string"
TEXTS = [
    None, "", "  \n\t ", "Hello WORLD's end", "a<|endoftext|>b <|startoftext|>", "é İΣ 日本語 \U0001f600", "the the the",
    "x" * 5000, "\xa0", "\x1c\x1d z\x85y", "½² 3٣ don't I'll", "thandeingofreor " * 300,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("encoder", [SpeculativeEncoder, LibraryEncoder])
def test_equals_the_library(library, encoder):
    rng = random.Random(7)
    signs = "abcdething'ASR -.,!?<|>/0129éßΣİ²٣ \t\n\x0b\x1c\x85​　日́\U0001f600\x00"
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    codes = Codes(encoder(tokenizer_path()), most_units=50, decode=True)
    for k in range(0, len(texts), 40):
        part = texts[k : k + 40]
        ids, decoded = codes.ids([x.encode() for x in part])
        for text, got, back in zip(part, ids, decoded):
            want = library.encode(text, add_special_tokens=False).ids
            assert got.tolist() == want, text
            assert back.decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("encoder", [SpeculativeEncoder, LibraryEncoder])
def test_every_code_point_in_three_contexts(library, encoder):
    """Planes 0 and 1 and the tags whole, every 53rd point of the rest."""
    points = [c for c in [*range(0x20000), *range(0x20000, 0x110000, 53), *range(0xE0000, 0xE1000)] if not 0xD800 <= c < 0xE000]
    codes = Codes(encoder(tokenizer_path()))
    for k in range(0, len(points), 4000):
        some = [chr(c) for c in points[k : k + 4000]]
        texts = ["\n".join(f.format(c) for c in some) for f in ("a{0}b", "{0}{0}", "1{0}! {0}'s")]
        ids, _ = codes.ids([x.encode() for x in texts])
        for text, got in zip(texts, ids):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids, f"from {points[k]:x}"


def test_both_exact_merges_agree():
    vocab = vocabulary(tokenizer_path())
    rng = random.Random(3)
    words = [[vocab.ids[rng.choice("thaneingo")] for _ in range(rng.randint(1, 12))] + [vocab.ids["e</w>"]] for _ in range(500)]
    assert merged_together([list(w) for w in words], vocab) == [merged(list(w), vocab) for w in words]


def test_digests_over_odd_rows(spark, library):
    rows = [(k if k != 3 else None, x, "clash") for k, x in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoding_digests(docs, tokenizer_path()).collect()}
    want = set()
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.add((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert got == want
    assert bpe.encoded(docs, tokenizer_path()).count() == len(rows)
    assert bpe.encoding_digests(docs.limit(0), tokenizer_path()).count() == 0


def test_token_files_over_odd_rows(spark, library):
    rows = [(k if k != 3 else None, x, "clash") for k, x in enumerate(TEXTS)] + [(5, "twin", ""), (5, "twin", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(token_files.token_positions(docs, tokenizer_path()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    plain = {r[0]: r[1] for r in rows if r[0] != 5}
    for r in got:
        if r.doc_id != 5:
            ids = [*library.encode(plain[r.doc_id] or "", add_special_tokens=False).ids, 2]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert token_files.token_positions(docs.limit(0), tokenizer_path()).count() == 0


def test_frames_are_independent_and_checked():
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = token_files.FrameWriter(sink)
    for k in (3, 5, 9):
        writer.add(k, np.arange(k, dtype="<u4").tobytes())
    writer.close()
    data = sink.getvalue()
    reader = token_files.FrameReader(pa.BufferReader(data))
    assert {k: x.tolist() for k, x in reader.documents([5])} == {5: [0, 1, 2, 3, 4]}
    assert [k for k, _ in reader.documents()] == [3, 5, 9]
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(whole) == 4 * 17
    broken = bytearray(data)
    broken[8] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FrameReader(pa.BufferReader(bytes(broken))).documents([3]))
