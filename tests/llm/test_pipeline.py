"""The pipeline, stage by stage, against plain Python on a small table, and the entry's guard."""

import re
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from costwise.llm import langid, mixing

from .test_operators import plain_lines, plain_near, words

LINE = "This very line is found in many documents"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, taken long, _n string"


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 120)
    rows = [(i, " ".join(words(10 + i, 40)) + f"\n{LINE}\n" * (i % 2), ("en", "de")[i % 2], "abc"[i % 3]) for i in range(40)]
    rows += [
        (50, " ".join(base), "en", "a"),
        (51, " ".join(base[:60] + ["changed"] + base[61:]), "en", None),
        (52, None, "en", "b"),
        (53, "... 123 !!", "en", "b"),
        (54, LINE, "en", "b"),
        (55, "", None, None),
        (56, " ".join(words(99, 20_000)), None, "c"),
        (50, " ".join(base), "en", "a"),
    ]
    return spark.createDataFrame([(d, t, la, s, len(t or ""), 7, "clash") for d, t, la, s in rows], COLUMNS)


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages_against_plain_python(spark, docs):
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "near_dedup", "mix_sources", "pack"]

    kept = corpus_pipeline.stage(steps["language_id"](spark, docs, ""), "test-lang")
    model = langid.fit(docs.filter(~langid.held_out()))
    want = Counter()
    for d, t, la, s in rows_of(docs):
        pred, score = model.score(t)
        if pred != "und" and score >= corpus_pipeline.MIN_SCORE:
            want[(d, t, la or pred, s)] += 1
    assert kept.columns == docs.columns and Counter(rows_of(kept)) == want
    assert {d for d, *_ in want} == set(range(40)) | {50, 51, 54, 56}

    cut = corpus_pipeline.stage(steps["line_dedup"](spark, kept, ""), "test-lines")
    plain = Counter({(d, t): n for (d, lines, gone, t), n in plain_lines(rows_of(kept)).items() if not gone or gone < lines})
    assert cut.columns == docs.columns and Counter((d, t) for d, t, *_ in rows_of(cut)) == plain
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = corpus_pipeline.stage(steps["near_dedup"](spark, cut, ""), "test-near")
    ids = {d for d, _, _, stays in plain_near(rows_of(cut), 5, 0.8) if stays}
    assert single.columns == docs.columns and sorted(d for d, *_ in rows_of(single)) == sorted(ids)
    assert 50 in ids and 51 not in ids

    mixed = corpus_pipeline.stage(steps["mix_sources"](spark, single, ""), "test-mix")
    assert mixed.columns == docs.columns
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    texts = {d: t for d, t, *_ in rows_of(single)}
    got = defaultdict(list)
    for d, t, *_ in rows_of(mixed):
        got[d].append(t)
    for r in mixing.mix_sources(single).collect():
        copies = got.pop(r.doc_id, [])
        assert sum(len(split(t)) for t in copies) == r.taken and copies.count(texts[r.doc_id]) >= r.whole
        for t in copies:  # a whole text or a stretch of its words, going round the end
            w = split(texts[r.doc_id])
            assert t == texts[r.doc_id] or " ".join(split(t)) in " ".join(w + w)
    assert not got

    packed = steps["pack"](spark, mixed, "").collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r[0] for r in rows_of(mixed))


def test_stages_on_an_empty_table(spark, docs):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), "").count() == 0


def test_near_dedup_judges_nulls_and_repeated_ids_by_their_texts(spark):
    def text(seed, edit=None):
        w = words(seed, 120)
        return " ".join(w if edit is None else w[:60] + [edit] + w[61:])

    rows = [
        (None, text(1, "p")), (None, text(1, "q")), (None, text(1)),  # a group of null ids alone
        (7, text(2)), (None, text(2)), (None, text(2, "r")),  # null-id copies of a kept document
        (8, text(3)), (8, text(4)), (9, text(4, "s")),  # one id, two texts; a near copy of the second
        (10, text(5, "t")), (10, text(5, "u")), (11, text(5)),  # one id twice in a group
        (12, text(6)), (12, text(6)), (13, ""), (14, ""), (14, ""), (15, None),
    ]
    docs = spark.createDataFrame([(d, t, "en", "a", 0, 7, "clash") for d, t in rows], COLUMNS)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    want = [(None, min(t for _, t in rows[:3])), (7, text(2)), (8, text(3)), (8, text(4)), (10, min(text(5, "t"), text(5, "u"))), (12, text(6)), (13, ""), (14, ""), (15, None)]
    assert got.columns == docs.columns and Counter((d, t) for d, t, *_ in rows_of(got)) == Counter(want)


def test_mix_matches_rows_that_repeat_an_id(spark, docs):
    twice = docs.filter("doc_id < 6").withColumn("doc_id", F.lit(1).cast("long"))
    mixed = dict(corpus_pipeline.STAGES)["mix_sources"](spark, twice, "").collect()
    total = sum(r.taken for r in mixing.mix_sources(twice).collect())
    assert sum(len(r.text.split()) for r in mixed) == total


def test_entry_imports_without_the_optional_parts(tmp_path):
    """The guard hides only the missing package, and the library's own queries stay."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('costwise.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'analyze' in names and 'pipeline' not in names and not any(n.startswith('op') for n in names), names\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
