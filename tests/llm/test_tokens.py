"""Batch encoding against the tokenizers library, text by text."""

import random

import pyarrow as pa
import pytest

from costwise.llm import tokens
from costwise.llm.tokens import Encoder, Known, vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def texts(seed, n):
    r = random.Random(seed)
    odd = ["", " ", "  ", None, " a", "a ", "a  b", "\n", " \n x", "a \tb", "é ü", "  lead", "trail  \n", "<|endoftext|> a", "don't stop", "a\n\n b", "日本 語", "a " * 50, ".", "x.\ny,\nz", "x\r\ny", "a b", "a  b", "   c", "\x85 d", "e \x1c f", "word. Word! w;x"]
    odd += ["".join(r.choice(" \n\tab.,é1' Zz") for _ in range(r.randrange(40))) for _ in range(n)]
    odd += [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 12))) + r.choice(["", "", ",", ".", "!", "\n", ".\nNext"]) for _ in range(r.randrange(60))) for _ in range(n)]
    r.shuffle(odd)
    return odd


def check(encoder, library, rows):
    ids, counts = encoder.encode_batch(pa.array(rows, pa.string()), end_id=2)
    at = 0
    for row, n in zip(rows, counts.tolist()):
        assert ids[at : at + n].tolist() == library.encode(row or "", add_special_tokens=False).ids + [2], row
        at += n
    assert at == len(ids)


def test_batches_equal_the_library(library):
    encoder = Encoder(vocabulary_path())
    for seed in range(3):
        check(encoder, library, texts(seed, 300))
    assert [len(x) for x in encoder.encode_batch(pa.array([], pa.string()))] == [0, 0]


def test_full_tables_start_over(library, monkeypatch):
    """Words are forgotten when the tables are full, and encoded again."""
    monkeypatch.setattr(tokens, "KNOWN", 200)
    monkeypatch.setattr(tokens, "CACHED", 20)
    encoder = Encoder(vocabulary_path())
    for seed in range(4):
        check(encoder, library, texts(seed, 100))
        encoder.known.trim(200)
        assert len(encoder.known.words) <= 200 == len(encoder.known.words) or len(encoder.known.words) >= 100
        assert len(encoder.new) <= 20


def test_known_words_keep_their_ids():
    known = Known(Encoder(vocabulary_path()).dtype)
    known.add(pa.array([f"w{i}" for i in range(100)]), [bytes([i, 0] * (1 + i % 3)) for i in range(100)])
    known.trim(60)
    assert len(known.words) == 30
    at = known.find(pa.array(["w99", "w70", "w69", "x"]))
    assert (at >= 0).tolist() == [True, True, False, False]
    for word, place in zip((99, 70), at.tolist()):
        assert known.table[known.begin[place] : known.begin[place] + known.size[place]].tolist() == [word] * (1 + word % 3)


def test_sliced_batches(library):
    """Arrow slices, as tasks cut them, encode as the whole does."""
    rows = texts(9, 50)
    encoder, array = Encoder(vocabulary_path()), pa.array(rows, pa.string())
    ids, counts = encoder.encode_batch(array)
    parts = [encoder.encode_batch(array.slice(i, 13)) for i in range(0, len(rows), 13)]
    assert [x for p, _ in parts for x in p.tolist()] == ids.tolist() and [x for _, p in parts for x in p.tolist()] == counts.tolist()


def test_words_of_the_table_are_not_kept_twice():
    """New words are encoded once and kept in the table alone; the ids are the library's."""
    enc = Encoder(vocabulary_path())
    texts = ["a plain wörd, x1y and plain ends.", "again x1y wörd, ends. it’s"]
    for _ in range(2):
        ids, counts = enc.encode_batch(pa.array(texts))
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert " x1y" not in enc.new and " it’s" not in enc.new
