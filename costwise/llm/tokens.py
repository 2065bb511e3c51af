"""Whole texts to token ids with a public byte-level BPE vocabulary.

The tokenizers library does the encoding. A batch of texts is split into words
by Arrow; the different words are looked up, all at once, in a bounded table of
words seen before, and only new ones are encoded; numpy gathers the ids of all
words. So Python touches a word when it is new, not when it occurs. A text may be cut before any blank that stands before a
character that is not white space: the vocabulary's splitting rule
(``pre_tokenizer``) never joins across such a place, so the ids of the pieces
are the ids of the text.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED = 50_000  # pieces in each of the two halves of the cache of odd pieces: 20 MB a worker at most
KNOWN = 1_000_000  # words in the table of words seen before: about 25 bytes each, 25 MB a worker
_CUT = re.compile(r"(?= \S)")
_LINES = re.compile(r"\S+(?:\n\S+)+")
_LONE_BLANK = re.compile(r" (?=\s|\Z)")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def byte_letters() -> str:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable
    Latin-1 stands for itself, the other bytes for U+0100 onwards in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return "".join(out)


class Known:
    """Words (after a blank) and their ids: an Arrow array to find them in and one flat array of ids."""

    def __init__(self, dtype: np.dtype):
        self.words = pa.array([], pa.string())
        self.begin, self.size, self.table = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, dtype)

    def find(self, words: pa.Array) -> np.ndarray:
        """Each word's place, -1 if it is not there."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def add(self, words: pa.Array, entries: list[bytes]) -> np.ndarray:
        """Puts new words at the end and returns their places."""
        size = np.fromiter(map(len, entries), np.int32, len(entries)) // self.table.dtype.itemsize
        return self.append(words, np.frombuffer(b"".join(entries), self.table.dtype), size)

    def append(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``add`` for words whose ids lie one after the other."""
        self.begin = np.concatenate([self.begin, len(self.table) + np.cumsum(size, dtype=np.int32) - size])
        self.size = np.concatenate([self.size, size])
        self.table = np.concatenate([self.table, ids])
        self.words = pa.concat_arrays([self.words, words])
        return np.arange(len(self.words) - len(words), len(self.words))

    def trim(self, most: int) -> None:
        """Forgets the older half when full."""
        if len(self.words) > most:
            k = len(self.words) - most // 2
            cut = int(self.begin[k])
            self.words = pa.concat_arrays([self.words.slice(k)])
            self.begin, self.size, self.table = self.begin[k:] - np.int32(cut), self.size[k:].copy(), self.table[cut:].copy()


class Encoder:
    """Text -> ids as little-endian unsigned 16- or 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 0x10000 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # of array(); Spark runs on little-endian machines
        self.letters = dict(enumerate(byte_letters()))
        self.blank = self.letters[32]
        self.known = Known(self.dtype)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _encoded(self, piece: str) -> bytes:
        """Ids of a piece, not kept."""
        word = piece[1:] if piece[:1] == " " else piece
        if word.isascii() and word.isalpha():  # one word of letters that stand for themselves: no splitting needed
            return self._pack([t.id for t in self.model.tokenize(piece if word is piece else self.blank + word)])
        if word.isalpha() and max(word) < "ɐ":  # other Latin letters
            mapped = piece.encode().decode("latin-1").translate(self.letters)
            return self._pack([t.id for t in self.model.tokenize(mapped)])
        if "\n" in word and _LINES.fullmatch(word):  # single line breaks between other characters are pieces of their own
            one, *more = piece.split("\n")
            line = self["\n"]
            return self[one] + b"".join([line + self[x] for x in more])
        if len(word) > 1 and word[-1] in ".,;:!?" and word[-2].isalpha():  # the mark is a piece of its own
            return self[piece[:-1]] + self[piece[-1]]
        return self._pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece that is not in the newer half of the cache."""
        got = self.old.get(piece)
        if got is None:
            got = self._encoded(piece)
        if len(piece) <= 64:
            if len(self.new) >= CACHED:
                self.old, self.new = self.new, {}
            self.new[piece] = got
        return got

    def __getitem__(self, piece: str) -> bytes:
        got = self.new.get(piece)
        return self._ids(piece) if got is None else got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _LONE_BLANK.search(text):
            pieces = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
            pieces = [" " + x for x in rest]
            if first:
                pieces.insert(0, first)
        new, ids = self.new, self._ids
        out = []
        for p in pieces:
            got = new.get(p)
            if got is None:
                got = ids(p)
                new = self.new
            out.append(got)
        return b"".join(out)


    def places(self, words: pa.Array) -> np.ndarray:
        """Places of different words in the table of known ones, new ones added to it."""
        # a word and a mark of punctuation: the mark is a piece of its own, and the word may be known
        marked = pc.match_substring_regex(words, r"^[A-Za-z]+[.,;:!?]$")
        bases = pc.utf8_slice_codeunits(words.filter(marked), 0, -1)
        whole = pa.concat_arrays([words, bases]).dictionary_encode()
        different, code = whole.dictionary, whole.indices.to_numpy()
        at = self.known.find(different).astype(np.int64)  # the one look-up: it costs a pass over the table
        base_of = np.full(len(different), -1)
        base_of[code[: len(words)][marked.to_numpy(zero_copy_only=False)]] = code[len(words) :]
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            plain = pc.match_substring_regex(different, r"^[A-Za-z]+$").to_numpy(zero_copy_only=False)
            first, then = fresh[base_of[fresh] < 0], fresh[base_of[fresh] >= 0]  # marked words need their bases
            letters, others = first[plain[first]], first[~plain[first]]
            tokenize, blank, ids, size = self.model.tokenize, self.blank, array(self.code), []
            chosen = different.take(pa.array(letters))
            for word in chosen.to_pylist():
                tokens = tokenize(blank + word)
                size.append(len(tokens))
                ids.extend([t.id for t in tokens])
            at[letters] = self.known.append(chosen, np.frombuffer(ids, self.dtype), np.array(size, np.int32))
            chosen, get, encoded = different.take(pa.array(others)), self.new.get, self._encoded  # the table keeps them: no second copy in the cache
            at[others] = self.known.add(chosen, [get(" " + word) or encoded(" " + word) for word in chosen.to_pylist()])
            if len(then):
                raw, width, stem = self.known.table.tobytes(), self.dtype.itemsize, at[base_of[then]]
                begin = self.known.begin[stem].astype(np.int64) * width
                stop = begin + self.known.size[stem] * width
                last = different.take(pa.array(then))
                marks = pc.utf8_slice_codeunits(last, -1).to_pylist()
                at[then] = self.known.add(last, [raw[i:j] + self[m] for i, j, m in zip(begin.tolist(), stop.tolist(), marks)])
        return at[code[: len(words)]]

    def encode_batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text); a null text is empty, ``end_id`` follows each text."""
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        self.known.trim(KNOWN)
        texts = pc.fill_null(pc.cast(texts, pa.string()), "")
        words = pc.split_pattern(texts, " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        first, n_words = offsets[:-1] - offsets[0], np.diff(offsets)
        coded = words.flatten().dictionary_encode()
        codes, kinds = coded.indices.to_numpy().copy(), coded.dictionary
        n_kinds = len(kinds)
        # after a blank, nothing or white space: the blank is not the start of a word
        odd = pc.match_substring_regex(kinds, r"^(\s|[\x0B\x1C-\x1F\x{85}\p{Z}]|$)").to_numpy(zero_copy_only=False)[codes]
        odd[first] = False
        beginnings = kinds.take(pa.array(codes[first])).to_pylist()
        codes[first] = n_kinds + np.arange(len(texts))  # the first word has no blank before it
        if odd.any():
            at = np.repeat(np.arange(len(texts)), n_words)
            for i in np.unique(at[odd]).tolist():  # the text as a whole takes the place of its first word
                codes[first[i] : first[i] + n_words[i]] = n_kinds + len(texts)
                codes[first[i]] = n_kinds + i
                beginnings[i] = None
        own = [self.encode(texts[i].as_py()) if w is None else self[w] if w else b"" for i, w in enumerate(beginnings)] + [b""]
        used = np.zeros(n_kinds + len(own), bool)
        used[codes] = True
        at = self.places(kinds.filter(pa.array(used[:n_kinds])))
        begin, size = np.zeros(len(used), np.int32), np.zeros(len(used), np.int32)
        begin[:n_kinds][used[:n_kinds]], size[:n_kinds][used[:n_kinds]] = self.known.begin[at], self.known.size[at]
        size[n_kinds:] = np.fromiter(map(len, own), np.int32, len(own)) // self.dtype.itemsize
        begin[n_kinds:] = len(self.known.table) + np.cumsum(size[n_kinds:]) - size[n_kinds:]
        table = np.concatenate([self.known.table, np.frombuffer(b"".join(own), self.dtype)])
        length = size[codes]
        counts = np.add.reduceat(length, first).astype(np.int64)
        ends = np.cumsum(length, dtype=np.int32)  # a batch is far below 2^31 ids
        ids = table[np.repeat(begin[codes] - ends + length, length) + np.arange(ends[-1], dtype=np.int32)]
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
        return ids, counts


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
