"""SentencePiece encoding and decoding against the library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tests.llm import plain

from vertexloom.llm import pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.public_model())


def same(model, library, texts):
    ids, n = model.encode(pa.array(texts, pa.string()))
    at, back = np.concatenate([[0], np.cumsum(n)]), model.decode(ids, n)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert ids[at[i] : at[i + 1]].tolist() == want, repr(t)[:100]
        assert back[i] == library.decode(want)


def test_odd_texts(model, library):
    same(model, library, ["", None, " ", "  a", "Hello  world\n", "▁x", "▁ ▁▁a", "a\0b", "<s>", "<0x41></s><unk>", "é漢😀", "\t x", "a ", "﻿x", "\r\n", " ", "=" * 300, " " * 70 + "x" + " " * 9])


@pytest.mark.parametrize("letters", ["thean ", "aeinthodrs T▁ \n.,12<>üßé漢😀", "ab", "▁ ", "the"])
def test_random_texts(model, library, letters):
    r = random.Random(3)
    same(model, library, ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(400)])


def test_long_words(model, library):
    """Words beyond LONG go through the queue; one of two million characters ends soon."""
    r = random.Random(4)
    same(model, library, ["a" * 5000, "th" * 3000, "the" * 2000, " " * 6000, "".join(r.choice("aeinthodrs") for _ in range(9000)), "x" + " " * 3000 + "the" * 900])
    assert len(model.encode(pa.array(["lo" * 1_000_000]))[0]) > 100_000


def test_decoding(model, library):
    r = random.Random(5)
    runs = [[], [1, 2], [259], [28705, 28705], [1, 0, 300], [131, 300], [3 + 0xE6, 3 + 0xBC], [3 + 0xE6, 3 + 0xBC, 3 + 0xA2, 3 + 0xFF, 264]]
    runs += [[r.choice([r.randrange(32000), 3 + r.randrange(256)]) for _ in range(r.randint(0, 12))] for _ in range(3000)]
    flat = np.array([i for x in runs for i in x], np.int64)
    assert model.decode(flat, np.array([len(x) for x in runs])) == [library.decode(x) for x in runs]
    with pytest.raises(ValueError):
        model.decode(np.array([32000]), np.array([1]))


def test_other_models(tmp_path):
    """A model of another kind is refused: here the normaliser's mark before the text is switched off."""
    raw = open(pieces.public_model(), "rb").read()
    assert raw.endswith(b"\x18\x01\x20\x00\x32\x00")
    (tmp_path / "m").write_bytes(raw[:-6] + b"\x18\x00\x20\x00\x32\x00")
    with pytest.raises(ValueError, match="normalise"):
        pieces.Model(str(tmp_path / "m"))


@pytest.mark.parametrize("kind", ["awkward", "real", "empty"])
def test_report(spark, library, kind):
    docs = plain.awkward(spark).withColumnRenamed("kept", "ids") if kind == "awkward" else spark.read.parquet(f"{SF}/documents.parquet").where("true" if kind == "real" else "false")
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, pieces.report(docs).collect())) == want
    both = pieces.decoded(pieces.encoded(docs))
    assert both.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    assert both.where("decoded is null").count() == 0
