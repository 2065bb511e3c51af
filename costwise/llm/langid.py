"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower-case letters with single blanks between words;
every run of 1 to 3 characters is hashed into ``2 ** bits`` buckets. Fitting
counts buckets per language in numpy inside the tasks and adds the counts up
in streams; the model is a (languages x buckets) matrix, whose size depends
on the parameters only. Scoring broadcasts its logarithms and sums them per
text over the buckets that occur in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.llm.common import id_text, python_ready, slices

UNKNOWN = "und"
BITS = 15
#: More languages than this are refused (the matrix is broadcast): 1000 x 2^15 doubles are 262 MB.
MAX_LANGUAGES = 1000
_BLOCK = 4096  # buckets in one row of partial counts
_SLICE = 1 << 18  # characters of a long text at a time
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@lru_cache(1)
def _folds() -> np.ndarray:
    """For each code point of the first plane its lower-case letter, or a blank."""
    out = np.full(0x10000, 32, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else i
    return out


def letters(text: str) -> np.ndarray:
    """Code points of the folded text, one blank at each end; empty if it has no letter."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = x >= 0x10000
    y = _folds()[np.where(high, 32, x)]
    if high.any():
        far = [i for i in np.flatnonzero(high) if chr(x[i]).isalpha()]
        y[far] = x[far]
    blank = y == 32
    if blank.all():
        return np.empty(0, np.uint32)
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run
    y = y[keep]
    y = y[1 if y[0] == 32 else 0 : -1 if y[-1] == 32 else None]
    return np.concatenate(([32], y, [32])).astype(np.uint32)


def buckets(y: np.ndarray, bits: int = BITS, starts: int | None = None) -> np.ndarray:
    """Bucket of every 1-, 2- and 3-gram of folded text (blanks alone are left out).

    ``starts``: only of those that start in the first so many places.
    """
    n = len(y) if starts is None else starts
    z = y.astype(np.uint64)
    shift = np.uint64(64 - bits)
    one = (z + np.uint64(1)) * _MIX[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * _MIX[1] + z[1:] * _MIX[2]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * _MIX[0] + z[2:] * _MIX[1]
    grams = (one[:n][y[:n] != 32], two[:n] + np.uint64(2), three[:n] + np.uint64(3))
    return np.concatenate([((h ^ (h >> np.uint64(32))) * _MIX[2]) >> shift for h in grams]).astype(np.int64)


def bucket_counts(y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """How often each bucket occurs; long texts go through in slices."""
    out = np.zeros(1 << bits, np.int64)
    for i in range(0, len(y), _SLICE):
        out += np.bincount(buckets(y[i : i + _SLICE + 2], bits, _SLICE), minlength=1 << bits)
    return out


@dataclass
class Model:
    languages: list[str]  # in code point order
    log_prob: np.ndarray  # (languages, buckets)
    log_prior: np.ndarray
    bits: int = BITS

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, posterior); ties go to the language first in code point order."""
        y = letters(text) if text else np.empty(0, np.uint32)
        if not len(y) or not self.languages:
            return UNKNOWN, 0.0
        if len(y) > 10_000:
            got = self.log_prob @ bucket_counts(y, self.bits)
        else:
            got = self.log_prob[:, buckets(y, self.bits)].sum(axis=1)
        total = self.log_prior + got
        best = int(np.argmax(total))
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in slices(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            docs[lang] = docs.get(lang, 0) + 1
            y = letters(text) if text else ()
            if len(y):
                own = counts.get(lang)
                if own is None:
                    own = counts[lang] = np.zeros(1 << bits, np.int64)
                own += bucket_counts(y, bits)
    yield from _packed(counts, docs)


def _packed(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    for lang, n in docs.items():
        blocks = counts[lang].reshape(-1, min(_BLOCK, counts[lang].size)) if lang in counts else []
        rows = [(lang, -1, np.array([n], np.int64).tobytes())] + [(lang, i, x.tobytes()) for i, x in enumerate(blocks) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], ["lang", "block", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the partial counts of each (language, block), as a stream."""
    sums: dict[tuple, np.ndarray] = {}
    for b in batches:
        for lang, block, raw in zip(*(c.to_pylist() for c in b.columns[:3])):
            x = np.frombuffer(raw, np.int64)
            key = (lang, block)
            sums[key] = sums[key] + x if key in sums else x
    if sums:
        rows = [(k, i, x.tobytes()) for (k, i), x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], ["lang", "block", "counts"])


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, alpha: float = 0.5) -> Model:
    """Learns from all rows whose language is not null.

    Null texts count for the prior only. Raises if there are more than
    ``MAX_LANGUAGES`` languages. Without any labelled row the model knows no
    language and answers ``und``.
    """
    python_ready(rows.sparkSession)
    labelled = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL")
    schema = "lang string, block int, counts binary"
    partial = labelled.mapInArrow(lambda it: _count(it, bits), schema)
    n_langs = labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n_langs > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is {lang_col} a language column?")
    summed = partial.repartition("lang", "block").mapInArrow(_add_up, schema).collect()  # languages x buckets at most
    langs = sorted({r["lang"] for r in summed}, key=lambda s: s.encode("utf-8", "surrogatepass"))
    at = {x: i for i, x in enumerate(langs)}
    counts, docs = np.zeros((len(langs), 1 << bits)), np.zeros(len(langs))
    for r in summed:
        x = np.frombuffer(r["counts"], np.int64)
        if r["block"] < 0:
            docs[at[r["lang"]]] = x[0]
        else:
            counts[at[r["lang"]], r["block"] * _BLOCK : r["block"] * _BLOCK + x.size] = x
    smooth = counts + alpha
    return Model(langs, np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True)), np.log(docs) - np.log(docs.sum()) if langs else docs, bits)


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for b in slices(batches):
        got = [model.score(t) for t in b.column("_text").to_pylist()]
        cols = [c for n, c in zip(b.schema.names, b.columns) if n != "_text"]
        names = [n for n in b.schema.names if n != "_text"]
        pred = [pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())]
        yield pa.RecordBatch.from_arrays(cols + pred, names + ["lang_pred", "score"])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list | None = None) -> DataFrame:
    """``keep`` columns plus lang_pred and score, row by row.

    ``und`` with score 0 where the text is null or has no letter (Unicode
    category L); otherwise the most probable language and its posterior. Any
    length of text is scored whole.
    """
    python_ready(docs.sparkSession)
    sent = docs.select(*(keep if keep is not None else ["doc_id"]), F.col(text_col).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name != "_text")
    return sent.mapInArrow(lambda it: _predict(it, shared), f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """The quarter kept out of fitting: crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.crc32(id_text(F.col(id_col)).cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of (doc_id, text, lang).

    The model learns from rows that are not held out and have a language;
    empty tables give no rows, repeated rows are scored one by one.
    """
    model = fit(docs.filter(~held_out()))
    return predict(docs, model, keep=[F.col("doc_id"), held_out().alias("held_out")])
