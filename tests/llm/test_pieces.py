"""SentencePiece and byte-level pieces against their libraries."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tessera.llm import bpe, sentencepieces, token_files
from tessera.llm.common import text_blocks

from . import brute

SF = "/root/testdata/sf0.001"
LETTERS = [*"  ab▁tehin▁\n", "é", "é", "🙂", "ﬁ", "日", "　", "½", "\x00", "­", "'s", "<s>"]


def hard_texts(n=1500):
    rnd = random.Random(1)
    fixed = ["", "  ", "a", " a", "   a  b   ", "▁▁a ▁", "▁", "x" * 5000, " " * 3000 + "z", "日本語テキスト🙂", "é é ﬁ ｆｕｌｌ ℃ ½", "\t\n a　b", "<s> </s> <unk> <0x41>", "a\x00b", "﻿", "ﷺ", "한국어 각"]
    return fixed + ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def differences(ours, library, texts):
    out = []
    for at, data, offsets in text_blocks(pa.array(texts), 1 << 16):
        ids, bounds, starts, ends = ours.encode_texts(data, offsets)
        shown = sentencepieces._shown(*ours.decode_texts(ids, bounds)).to_pylist()
        for i, text in enumerate(texts[at : at + len(offsets) - 1]):
            a, b = bounds[i], bounds[i + 1]
            want = library.encode(text, return_type="proto").pieces
            got = list(zip(ids[a:b].tolist(), starts[a:b].tolist(), ends[a:b].tolist()))
            if got != [(p.id, p.begin, p.end) for p in want] or shown[i] != library.decode([p.id for p in want]):
                out.append(text)
    return out


@pytest.fixture(scope="module")
def pieces():
    path = sentencepieces.default_model()
    return sentencepieces.PieceBPE(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_ids_spans_and_texts(pieces):
    assert differences(*pieces, hard_texts(3000)) == []


def test_all_code_points(pieces):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(points[i : i + 64]) for i in range(0, len(points), 64)] + [f"a{c}b {c}" for c in points[:0x3000]]
    assert differences(*pieces, texts) == []


@pytest.mark.parametrize("collapse,prefix", [(False, False), (False, True), (True, False), (True, True)])
def test_character_maps(tmp_path, collapse, prefix):
    """Models whose normaliser has a compiled map: those that come with the library."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    folder = os.path.join(os.path.dirname(sentencepiece.__file__), "package_data")
    for name in sorted(os.listdir(folder)):
        model = pb.ModelProto()
        with open(sentencepieces.default_model(), "rb") as f:
            model.ParseFromString(f.read())
        with open(os.path.join(folder, name), "rb") as f:
            model.normalizer_spec.precompiled_charsmap = f.read()
        model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = collapse, prefix
        path = str(tmp_path / name)
        with open(path, "wb") as f:
            f.write(model.SerializeToString())
        assert differences(sentencepieces.PieceBPE(path), sentencepiece.SentencePieceProcessor(model_file=path), hard_texts(600)) == []


def test_other_models_are_refused(tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(sentencepieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        sentencepieces.PieceBPE(str(tmp_path / "m"))


def test_query(spark, tmp_path):
    d = spark.createDataFrame(brute.documents(), brute.DOCUMENTS).selectExpr("*", "1 AS ids", "2 AS starts", "'x' AS decoded")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    for path in (SF, str(tmp_path)):
        want = []
        for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect():
            ids = library.encode(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        got = [tuple(r)[:4] for r in sentencepieces.op11_sentencepiece(spark, path).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], brute.DOCUMENTS)
    assert sentencepieces.encode(empty).count() == 0


def test_operator_keeps_columns_and_decodes_anything(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "id int, text string, ends string")
    rows = sentencepieces.encode(df).orderBy("id").collect()
    assert rows[0].ids == [264, 287] and rows[0].starts == [0, 1] and rows[0].ends == [1, 3] and rows[1].ids == [] and rows[0].asDict().keys() == {"id", "text", "ids", "starts", "ends"}
    odd = spark.createDataFrame([(1, [3 + 0xE9, 264, 99999, -1]), (2, None), (3, [3 + 0xC3, 3 + 0xA9])], "id int, ids array<int>")
    assert [r.decoded for r in sentencepieces.decode(odd).orderBy("id").collect()] == ["� a", "", "é"]


@pytest.mark.parametrize("kind", [bpe.ByteBPE, token_files.LibraryBPE])
def test_byte_level_pieces_of_all_code_points(kind):
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(bpe.default_tokenizer()), kind(bpe.default_tokenizer())
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (kind is bpe.ByteBPE or i < 0x3000 or i % 97 == 0)]
    for a in range(0, len(points), 20000):
        texts = [f"a{c}'s {c} 1{c}2!{c}\n{c} {c}" for c in points[a : a + 20000]]
        raw = [t.encode() for t in texts]
        ids, counts = ours.encode_block(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
        bounds = np.r_[0, np.cumsum(counts)]
        assert [t for i, (t, e) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))) if e.ids != ids[bounds[i] : bounds[i + 1]].tolist()] == []
