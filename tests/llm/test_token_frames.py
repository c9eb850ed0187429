"""op13: the files against the library's own ids, and readers that read what they need."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from quarry.llm import token_frames
from tests.llm.test_operators import docs

VOCABULARY = public_tokenizers.path(token_frames.VOCABULARY)
SAMPLES = ["", "a", " \u2003 x\u00a0 y", "Hello, world! it's 42nd", "tabs\t\tand\n\nlines  ", "<|endoftext|> x", "naïve café ²³ ½x", "我们，去。北京 3次", "ก็ได้ครับ 12", "áb c", "x" * 700, "\x00\x01", "'s 'll I'd"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_pieces_give_the_ids_of_the_whole_text(library):
    encoder = token_frames.Encoder(VOCABULARY)

    @given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(SAMPLES + [" ", "\n", "é", "1", "-", "'"]), max_size=12).map("".join)))
    @settings(max_examples=400, deadline=None)
    def same(text):
        ids = np.frombuffer(b"".join(b for _, b in encoder.ids(pa.array([text]))), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids

    same()


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_chunks_cut_no_piece(library, monkeypatch, chunk):
    monkeypatch.setattr(token_frames, "CHUNK_BYTES", chunk)
    encoder, rng = token_frames.Encoder(VOCABULARY), random.Random(chunk)
    texts = ["".join(rng.choice(SAMPLES + [" ", "\u00a0", "\u3000", "\x1c", "\u0301", "×", "ß"]) for _ in range(rng.randrange(9))) for _ in range(200)]
    found = {i: b"" for i in range(len(texts) + 1)}
    for i, block in encoder.ids(pa.array(["skipped"] + texts + [None])[1:]):
        found[i] += block
    for i, text in enumerate(texts):
        assert np.frombuffer(found[i], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def expected(library, texts):
    out, start = [], 0
    for i, t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    return out


def rows(df):
    return [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in df.orderBy("start").collect()]


@pytest.mark.parametrize("frame_ids, file_ids", [(1 << 20, 1 << 28), (3, 200)])
def test_files_give_back_every_id(spark, library, monkeypatch, frame_ids, file_ids):
    monkeypatch.setattr(token_frames, "FRAME_IDS", frame_ids)
    monkeypatch.setattr(token_frames, "FILE_IDS", file_ids)
    rng = random.Random(frame_ids)
    texts = [rng.choice(SAMPLES) * rng.randrange(1, 4) for _ in range(120)] + [None, ""]
    df = docs(spark, texts).withColumnRenamed("n", "start").orderBy(F.rand(3))
    path = token_frames.write(df, VOCABULARY)
    want = expected(library, list(enumerate(texts)))
    assert rows(token_frames.read(spark, path)) == want
    asked = [5, 17, 121, 9999, -4]
    assert rows(token_frames.read(spark, path, asked)) == [w for w in want if w[0] in asked]
    assert token_frames.read(spark, path, []).count() == 0 and token_frames.read(spark, path, [7000]).count() == 0


def test_null_and_repeated_ids_come_whole(spark):
    table = [(None, "a b"), (None, "c"), (3, "x"), (3, "x"), (3, "y"), (1, None), (None, "a b")]
    path = token_frames.write(spark.createDataFrame(table, "doc_id long, text string"), VOCABULARY)
    got = rows(token_frames.read(spark, path))
    assert [r[0] for r in got] == [None, None, None, 1, 3, 3, 3]
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(7)]
    assert [r[0] for r in rows(token_frames.read(spark, path, [0, 3]))] == [3, 3, 3]


def test_an_empty_table_has_no_files(spark):
    path = token_frames.write(docs(spark, ["a"]).limit(0), VOCABULARY)
    assert token_frames.read(spark, path).count() == 0


def test_one_document_is_read_beside_a_broken_one(spark, library, tmp_path):
    """Only requested frames are decompressed: a broken frame is an error for its own
    document alone."""
    path = token_frames.write(docs(spark, ["first text", "second text", "third text"]).repartition(1).coalesce(1), VOCABULARY, str(tmp_path / "ids"))
    place = token_frames.files(spark, path).collect()
    assert sum(p["n_docs"] for p in place) == 3
    system, folder = fs.FileSystem.from_uri(f"{path}/frames")
    hurt = None
    for p in place:
        reader = token_frames.Reader(f"{path}/frames", p["file"])
        if 1 in reader.ids:
            i = int(np.flatnonzero(reader.ids == 1)[0])
            at = int(reader.offsets[reader.first_frame[i]]) + int(reader.sizes[reader.first_frame[i]]) - 1
            name = f"{folder}/{p['file']}"
            content = bytearray(system.open_input_file(name).read())
            content[at] ^= 0xFF
            with system.open_output_stream(name, compression=None) as out:
                out.write(bytes(content))
            hurt = p
    assert hurt is not None
    want = expected(library, [(0, "first text"), (1, "second text"), (2, "third text")])
    assert rows(token_frames.read(spark, path, [0, 2])) == [want[0], want[2]]
    with pytest.raises(Exception, match="checksum|[Dd]ecompress|frame"):
        token_frames.read(spark, path, [1]).collect()


def test_plain_zstandard_reads_the_file(spark, library, tmp_path):
    token_frames.write(docs(spark, ["first text", None, "third"]).coalesce(1), VOCABULARY, str(tmp_path / "ids"))
    content = b""
    for p in token_frames.files(spark, str(tmp_path / "ids")).orderBy("place").collect():
        raw = (tmp_path / "ids" / "frames" / p["file"]).read_bytes()
        content += zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert content == b"".join(w[-1] for w in expected(library, [(0, "first text"), (1, None), (2, "third")]))


def test_a_long_text_without_spaces_is_cut_at_signs(monkeypatch):
    monkeypatch.setattr(token_frames, "CHUNK_BYTES", 1 << 20)
    encoder = token_frames.Encoder(VOCABULARY)
    blocks = list(encoder.ids(pa.array(["x", "ab12," * 1_000_000, "", None, "y"])))
    assert {i for i, _ in blocks} == {0, 1, 4} and sum(i == 1 for i, _ in blocks) > 1
    assert sum(len(b) for _, b in blocks) // 4 > 2_000_000


def test_forgotten_pieces_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr(token_frames, "KNOWN_PIECES", 3)
    encoder = token_frames.Encoder(VOCABULARY)
    for text in SAMPLES * 3:
        ids = np.frombuffer(b"".join(b for _, b in encoder.ids(pa.array([text]))), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
