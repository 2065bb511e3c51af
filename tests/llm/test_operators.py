"""Each operator on small tables: nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from costwise.llm import chat, exact_dedup, langid, license_scan, line_dedup, mixing, near_dedup, packing, token_files, topk
from costwise.llm.components import components
from costwise.llm.tokens import Encoder, vocabulary_path

WHITE = r"[\x20\x09-\x0D]"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, shard int, kept string"


def docs_df(spark, rows):
    """(doc_id, text, lang, source); the other columns clash with names used inside."""
    return spark.createDataFrame([(d, t, la, s, 0, -1, "x", 3, "no") for d, t, la, s in rows], DOCS)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def mixed_rows():
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    line = "This very line is found in many documents"
    rows = [
        (1, " ".join(base), "en", "a"),
        (2, " ".join(near), "en", "a"),
        (3, "  ".join(base) + "\n", "de", "b"),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, " \t\n", "en", None),
        (7, "one", "fr", "c"),
        (8, "one", "fr", "c"),
        (8, "one", "fr", "c"),  # a repeated row
        (9, f"{line}\nfirst own line of nine\n{line}", "en", "a"),
        (10, f"  {line.upper()} \nten", "en", "a"),
        (11, f"{line}\t\neleven", "en", "a"),
        (None, f"{line}\nno id", "en", "a"),
        (12, " ".join(words(2, 30_000)), "en", "long"),  # very long
        (13, "Released under the MIT License.", "en", "b"),
        (14, "<|endoftext|> a <|im_end|>", "en", "b"),
        (15, "123 ... !!", "en", "b"),
    ]
    return rows


def test_exact_dedup(spark, mixed_rows):
    got = exact_dedup.exact_dedup(docs_df(spark, mixed_rows)).collect()
    groups = defaultdict(list)
    for d, t, *_ in mixed_rows:
        groups[re.sub(WHITE, "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    want = Counter()
    for norm, members in groups.items():
        best = min(members)
        for i, m in enumerate(sorted(members)):
            want[(m[3], best[3], len(members), i == 0, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("hot", [True, False])
def test_exact_dedup_keeps_one_of_rows_that_repeat_the_kept_id(spark, monkeypatch, hot):
    """A third of the rows are one row, others repeat an id or have none; one row of each group stays."""
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5 if hot else 10**6)
    monkeypatch.setattr(exact_dedup, "_CUT", 7)
    rows = [(1, "hot text", "en", "a")] * 100
    rows += [(5, "x y", "en", "a"), (5, "xy ", "en", "a"), (5, " xy", "en", "a"), (None, "abc  d", "en", "a"), (None, "abcd  ", "en", "a"), (None, "only", "en", "a")]
    rows += [(None, "zz", "en", "a"), (2, "z z", "en", "a"), (3, "z  z", "en", "a"), (3, "zz  ", "en", "a"), (-(1 << 63), "low", "en", "a"), ((1 << 63) - 1, "low", "en", "a")]
    rows += [(i, f"text {i}", "en", "a") for i in range(10, 150)]
    random.Random(4).shuffle(rows)
    got = exact_dedup.exact_dedup(docs_df(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({re.sub(WHITE, "", t) for _, t, *_ in rows})
    by = {r.text_sha256: (r.keep_id, r.group_size) for r in got}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert by[sha("hottext")] == (1, 100) and by[sha("xy")] == (5, 3) and by[sha("abcd")] == (None, 2) and by[sha("zz")] == (3, 4) and by[sha("low")] == (-(1 << 63), 2)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_compares_contents_under_one_digest(spark, mixed_rows):
    full = exact_dedup.exact_dedup(docs_df(spark, mixed_rows)).collect()
    weak = exact_dedup.exact_dedup(docs_df(spark, mixed_rows), digest_hex=1).collect()
    assert Counter(map(tuple, full)) == Counter(map(tuple, weak))


def test_foreign_line_that_shares_slot_and_fingerprint_is_no_hot_line():
    """A line outside the hot index with a member's slot and fingerprint: only the whole hash tells them apart."""
    r = np.random.default_rng(3)
    keys = r.integers(-(1 << 62), 1 << 62, size=(200, 2))
    index = line_dedup.build_exact(keys[:, 0], keys[:, 1], np.arange(200) + 5, np.arange(200) * 10)
    exact = line_dedup.ExactIndex(index)
    n, last = exact.probe(keys[:, 0], keys[:, 1])
    assert n.tolist() == list(range(5, 205)) and last.tolist() == [10 * i for i in range(200)]
    # foreign keys with the fingerprint of a member: some fall on a member's slot and pass a fingerprint index
    weak = line_dedup.build_index(keys[:, 0], keys[:, 1], np.arange(200) + 5, np.arange(200) * 10)
    lo = np.repeat(keys[:, 1], 2000)
    hi = r.integers(-(1 << 62), 1 << 62, size=len(lo))
    assert (line_dedup.probe(weak, hi, lo)[0] > 0).any()
    n, last = exact.probe(hi, lo)
    assert not n.any() and not last.any()
    assert line_dedup.ExactIndex(line_dedup.build_exact([], [], [], [])).probe([1], [2])[0].tolist() == [0]


def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: re.sub(rf"^{WHITE}+|{WHITE}+$", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    none = -(1 << 63)
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(none if d is None else d)
    out = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == (none if d is None else d)]
        out[(d, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("hot_floor", [1000, 2])
def test_line_dedup(spark, mixed_rows, hot_floor):
    df = docs_df(spark, mixed_rows)
    out = line_dedup.dedup_lines(df, lines_per_shard=3, hot_lines=1 if hot_floor == 2 else 100, hot_floor=hot_floor)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == plain_lines(mixed_rows)


def test_line_index_answers_members_and_rejects_foreign_lines():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    index = line_dedup.build_index(hi, lo, np.arange(5000) + 1, np.arange(5000) * 7)
    n, last = line_dedup.probe(index, hi, lo)
    assert (n == np.arange(5000) + 1).all() and (last == np.arange(5000) * 7).all()
    foreign = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    assert (line_dedup.probe(index, *foreign)[0] > 0).sum() == 0


def plain_near(rows, width, threshold):
    sets = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((d, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if a and b and (100 * len(a & b) >= 100 * threshold * len(a | b) or (d is not None and d == e)):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, mixed_rows, width):
    got = near_dedup.near_duplicates(docs_df(spark, mixed_rows), words=width).collect()
    assert Counter(map(tuple, got)) == plain_near(mixed_rows, width, 0.8)


def test_near_dedup_of_a_chain_and_a_large_group(spark, monkeypatch):
    """A group of edited copies around one text, with borderline links, in long lists and large components."""
    monkeypatch.setattr(near_dedup, "LARGE", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4096)
    r, rows = random.Random(3), []
    for centre in range(3):
        base = words(100, 150, 1000) if centre < 2 else words(200, 150, 1000)
        base = base[: 150 - 14 * centre] + words(300 + centre, 14 * centre, 1000)
        for i in range(40):
            t = list(base)
            for _ in range(r.randrange(12)):
                t[r.randrange(len(t))] = f"x{r.random()}"
            rows.append((len(rows), " ".join(t), "en", "a"))
    for n in (4, 5, 6, 9, 10, 13, 14, 16, 20):  # short ones, one word apart
        t = words(n, n)
        rows += [(len(rows), " ".join(t), "en", "a"), (len(rows) + 1, " ".join([*t, "tail"]), "en", "a")]
    got = near_dedup.near_duplicates(docs_df(spark, rows), words=2).collect()
    assert Counter(map(tuple, got)) == plain_near(rows, 2, 0.8)


def test_lists_miss_no_similar_sets():
    rng = np.random.default_rng(5)
    for n in (4, 5, 9, 10, 12, 13, 14, 16, 20, 40, 59, 62, 74, 215, 260, 300):
        for _ in range(60):
            u = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            m = int(rng.integers(int(np.ceil(n * 0.8)), int(n / 0.8) + 1))
            c = int(np.ceil(0.8 * (n + m) / 1.8 - 1e-9))
            if c > min(n, m) or n == m == c:
                continue
            a, b = np.sort(u[:n]), np.sort(np.concatenate([u[:c], u[n : n + m - c]]))
            assert np.intersect1d(near_dedup.keys(a), near_dedup.keys(b)).size


def test_estimate_is_exact_for_small_sets():
    a, b = np.arange(0, 30, dtype="<u4"), np.arange(10, 40, dtype="<u4")
    assert near_dedup.estimate(a.tobytes(), b.tobytes()) == 0.5


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, r.randrange(1001, 1200)) for _ in range(200)] + [(5000, 5000), (7000, 7001), (7001, 7000)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[0] != got[1000] and got[7000] == got[7001] and 5000 not in got
    assert len({got[b] for _, b in edges[300:500]}) == 1


def test_mixing_meets_targets_and_limits(spark, mixed_rows):
    rows = mixed_rows + [(100 + i, " ".join(words(i, 50)), "en", "abc"[i % 3]) for i in range(90)]
    df = docs_df(spark, rows)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for x in got:
        by[x.source].append(x)
        assert 0 <= x.taken <= 2 * x.size
    sizes = {s: sum(x.size for x in v) for s, v in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while True:  # share by weight, hold back what is above, share the excess again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    for s, v in by.items():
        assert v[0].source_size == sizes[s] and v[0].target == pytest.approx(target[s])
        assert abs(sum(x.taken for x in v) - target[s]) <= 4
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert Counter(map(tuple, got)) != Counter(map(tuple, mixing.mix_sources(df, seed=1).collect()))


def test_shard_quotas_are_sainte_lague(spark):
    r = random.Random(4)
    rows, want = [], {}
    for src in range(6):
        sizes = [r.choice([1, 3, 50, 400, 5000]) for _ in range(r.randrange(1, 40))]
        quota = r.randrange(0, 300)
        rows += [(src, i, s, sum(sizes), quota) for i, s in enumerate(sizes)]
        seats = sorted(((-(s / (2 * n + 1)), i, n) for i, s in enumerate(sizes) for n in range(quota)))[:quota]
        for i in range(len(sizes)):
            want[src, i] = sum(x[1] == i for x in seats)
    df = spark.createDataFrame(rows, "src long, shard long, shard_size long, source_size long, quota long")
    got = {(x.src, x.shard): x.blocks for x in mixing.shard_quotas(df).collect()}
    assert got == want


def test_chat_escapes_and_reads_back(spark):
    nasty = ["<|im_end|>", "<\\|x", "<\\\\|", "a<|im_start|>user\n", "<", "|", "<<|||>", "", None, "né\n\n", "<|image:0|>"]
    for t in nasty:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and "<|" not in chat.escape(t or "")
    rows = [(c, i, role, t) for c in (1, 2) for i, (role, t) in enumerate(zip(["user", "assistant", None, "assistant\nx", "system<|"] * 3, nasty))]
    rows += [(None, 0, "assistant", "no id"), (3, 0, "b", "tie"), (3, 0, "a", "tie"), (3, None, "assistant", "first"), (4, 0, "user", "z" * 3_000_00)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    for limit in (1_000_000, 10):  # in one part and in many
        out = chat.format_conversations(df, max_chars=limit)
        got = {r.conv_id: r for r in chat.read_back(out).collect()}
        for conv in {r[0] for r in rows}:
            turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
            said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
            loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
            g = got[conv]
            assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
            assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [
        {"kind": "text", "text": "look <|here|>"},
        {"kind": "image", "ref": "s3://a.png", "width": 56, "height": 29},
        {"kind": "audio", "ref": "b.wav", "seconds": 2.0},
        {"kind": "document", "ref": "c.pdf", "pages": 3},
        {"kind": "text", "text": "end"},
    ]
    row = [(1, 0, "assistant", "ignored", [tuple(p.get(k) for k in ("kind", "text", "ref", "width", "height", "seconds", "pages")) for p in parts]), (1, 1, "user", "plain", None)]
    df = spark.createDataFrame(row, f"conv_id long, turn long, role string, text string, parts {chat.PARTS_TYPE}")
    r = chat.format_conversations(df).first()
    (role, content), (_, plain) = chat.parse(r.formatted)
    assert role == "assistant" and plain == "plain"
    assert content == "look <\\|here|><|image:0|><|audio:1|><|document:2|>end"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "s3://a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 2400)]
    assert r.expanded_tokens == 2454
    for a in r.attachments:
        assert r.formatted[a.position :].startswith(f"<|{a.kind}:{a.ordinal}|>")
    assert "".join(chat.unescape(r.formatted[s.start : s.stop]) for s in r.loss_spans) == "look <|here|>end"
    back = chat.parse_parts(content, {a.ordinal: a.asDict() for a in r.attachments})
    assert [(p["kind"], p.get("text"), p.get("ref")) for p in back] == [(p["kind"], p.get("text"), p.get("ref")) for p in parts]


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_the_library(ids_of):
    r = random.Random(2)
    letters = [*" \n\t.,'sabéñ日 \x1c\x851<|>", "<|endoftext|>", "'ll"]
    enc = Encoder(vocabulary_path())
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == ids_of(t)[:-1], repr(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, mixed_rows, ids_of):
    df = docs_df(spark, mixed_rows)
    for tokens in (1 << 17, 50):  # documents longer than a block, and many blocks
        path = token_files.new_path(spark)
        token_files.write_tokens(df, path, block_tokens=tokens)
        want, at = Counter(), 0
        for d, t, *_ in sorted(mixed_rows, key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = ids_of(t)
            want[(d, at, len(ids), crc(ids))] += 1
            at += len(ids)
        assert Counter(map(tuple, token_files.read_digests(spark, path).collect())) == want
        full = {r.start: r.ids for r in token_files.read_tokens(spark, path).collect()}
        assert all(crc(full[s]) == c for _, s, _, c in want)
    path = token_files.new_path(spark)
    token_files.write_tokens(df.limit(0), path)
    assert token_files.read_digests(spark, path).count() == 0


def test_packing(spark, mixed_rows, ids_of):
    got = packing.pack_documents(docs_df(spark, mixed_rows)).collect()
    texts = defaultdict(list)
    for d, t, *_ in mixed_rows:
        texts[d].append(ids_of(t))
    seqs, n = defaultdict(list), 0
    for r in got:
        assert any(crc(x[r.start : r.start + r.length]) == r.ids_crc32 for x in texts[r.doc_id])
        assert r.length == 1024 or r.piece == 0
        seqs[r.sequence_id].append((r.offset, r.length))
        n += r.length
    assert n == sum(len(x) for v in texts.values() for x in v)
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(docs_df(spark, mixed_rows).limit(0)).count() == 0


def test_plan_is_best_fit_decreasing():
    r = random.Random(6)
    for _ in range(30):
        lengths = [r.randint(1, 50) for _ in range(r.randint(0, 300))]
        rooms, seqs = [], 0
        for x in sorted(lengths, reverse=True):
            fit = [i for i, room in enumerate(rooms) if room >= x]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(50 - x)
        slots = packing.plan(dict(Counter(lengths)), 50)
        used = defaultdict(list)
        for length, lo, hi, first, offset in slots:
            for k in range(hi - lo):
                used[first + k].append((offset, length))
        assert len(used) == len(rooms) and sum(map(len, used.values())) == len(lengths)
        for v in used.values():
            assert [o for o, _ in sorted(v)] == list(np.cumsum([0] + [x for _, x in sorted(v)])[:-1])
        ranks = defaultdict(list)
        for length, lo, hi, *_ in slots:
            ranks[length] += range(lo, hi)
        assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_topk(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(60)]  # one vector many times: ties
    rows += [(500, None), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (540, [float("nan")] * 6), (560, [float("inf")] * 6), (None, [1.0] * 6), (580, [1e6] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    ok = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:7]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    for lead in (None, 1):
        got = topk.top_k(df, k=7, rows_per_block=40, queries_per_block=5, lead=lead)
        assert {tuple(r) for r in got.collect()} == want
    few = topk.top_k(df.filter("vec_id < 3"), k=7).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1), (0, 2)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_of_huge_components(spark):
    rows = [(i, [float(2**40 + i), 3.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, k=3, scale=1.0).collect()
    want = sorted(((2**40) * (2**40 + i) + 9 for i in range(1, 30)), reverse=True)[:3]
    top = 2**63 - 1
    assert [r.score for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [min(x, top) for x in want]


@pytest.mark.parametrize("tail", [3, -3, 1 << 20])
def test_topk_between_double_precision_and_64_bits(spark, tail):
    """Scores from 2^53 to 2^63: one apart, decided by whole numbers."""
    vectors = {i: ((1 << 30) + i, tail) for i in range(60)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    want = set()
    for q in (0, 20, 40):
        scores = sorted((-(vectors[q][0] * a + vectors[q][1] * b), i) for i, (a, b) in vectors.items() if i != q)[:20]
        assert all(1 << 53 < -s < 1 << 63 for s, _ in scores)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    got = topk.top_k(df, scale=1.0, queries_per_block=2, lead=1).collect()
    assert {tuple(r) for r in got} == want


def test_topk_keeps_scores_below_the_64_bit_range():
    """Held at the smallest long, such scores are entries like others, after all larger ones."""
    q, x = np.array([[1 << 40, 1]]), np.array([[-(1 << 40), 0], [-(1 << 20), 5], [-(1 << 41), 0]])
    cut = np.array([np.iinfo(np.int64).min])
    found = list(topk.local_lists(q, np.array([9]), cut, x, np.array([1, 2, 3]), 3, 1))
    assert [ids.tolist() for _, ids, _ in found] == [[2, 1, 3]]


def test_language_id_edges(spark, mixed_rows):
    out = {(r.doc_id, r.lang_pred, r.held_out): r.score for r in langid.identify(docs_df(spark, mixed_rows)).collect()}
    preds = {d: p for d, p, _ in out}
    assert preds[4] == preds[5] == preds[6] == preds[15] == "und" and all(0 <= s <= 1 for s in out.values())
    for d, _, held in out:
        assert held == (zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2)
    assert langid.identify(docs_df(spark, mixed_rows).limit(0)).count() == 0
    none = langid.identify(docs_df(spark, [(1, "text", None, "a")])).first()
    assert none.lang_pred == "und"


def test_language_model_against_plain_counts(spark):
    rows = [(1, "the cat", "en", "a"), (5, "der Hund", "de", "a"), (6, "the dog", "en", "a"), (9, "das Haus", "de", "b")]
    model = langid.fit(docs_df(spark, rows))
    counts = {la: sum(langid.bucket_counts(langid.letters(t)) for _, t, x, _ in rows if x == la) + 0.5 for la in ("de", "en")}
    want = np.array([np.log(counts[la] / counts[la].sum()) for la in ("de", "en")])
    assert model.languages == ["de", "en"] and np.allclose(model.log_prob, want)
    y = langid.letters("The Mouse, 42!")
    assert "".join(map(chr, y)) == " the mouse "
    score = want @ langid.bucket_counts(y) + np.log(0.5)
    p = np.exp(score - score.max())
    assert model.score("The Mouse, 42!") == (model.languages[int(score.argmax())], pytest.approx(p.max() / p.sum()))


def test_language_accuracy_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert r.filter("lang = lang_pred").count() >= 0.98 * r.count()


def test_slices_of_long_texts_count_the_same(monkeypatch):
    y = langid.letters(" ".join(words(3, 5000)))
    whole = langid.bucket_counts(y)
    monkeypatch.setattr(langid, "_SLICE", 100)
    assert (langid.bucket_counts(y) == whole).all()


def test_license_scan(spark, mixed_rows):
    mit = license_scan.TEMPLATES["MIT"].split()
    edited = mit[:40] + ["changed"] + mit[41:]  # one word of 90: five shingles
    rows = mixed_rows + [
        (50, " ".join(words(9, 300)) + " " + " ".join(edited) + " " + " ".join(words(10, 300)), "en", "a"),
        (51, " ".join(mit[:30]), "en", "a"),  # a third is no match
        (52, "x Licensed under CC BY-NC 4.0. y", "en", "a"),
        (53, license_scan.TEMPLATES["Apache-2.0"].upper(), "en", "a"),
    ]
    got = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(docs_df(spark, rows)).collect()}
    assert set(got) == {(13, "MIT-notice"), (50, "MIT"), (52, "CC-BY-NC-4.0-notice"), (53, "Apache-2.0"), (53, "Apache-2.0-notice")}
    assert got[50, "MIT"].first_word == 300 and 0.8 <= got[50, "MIT"].containment < 1
    assert got[52, "CC-BY-NC-4.0-notice"].containment == 1
    split = license_scan.scan_licenses(docs_df(spark, rows), keys_per_pass=5).collect()  # several passes
    assert {(r.doc_id, r.license) for r in split} == set(got)
    assert license_scan.scan_licenses(docs_df(spark, rows).limit(0)).count() == 0
    assert license_scan.scan_licenses(docs_df(spark, rows), templates={}).count() == 0


def test_operators_leave_the_session_as_it_was(spark):
    """No operator changes a setting of the session, whatever its result is used for later."""
    from costwise.llm import queries

    def settings():
        return {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"}

    before = settings()
    for name, query in queries.QUERIES.items():
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        assert settings() == before, name


def test_topk_cutoffs_come_from_all_blocks(spark, monkeypatch):
    """Lists of all row blocks tighten the cutoffs: few entries more than the result are sent. Repeated ids included."""
    r = random.Random(11)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    rows += [(20, rows[3][1]), (20, list(rows[20][1])), (41, rows[41][1]), (41, rows[60][1]), (7, [1.0] * 5), (8, [2.0] * 30), (None, [1.0] * 16)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sent = {}
    real = topk.stage
    monkeypatch.setattr(topk, "stage", lambda d, name: sent.setdefault(name, real(d, name)))
    got = Counter(tuple(x) for x in topk.top_k(df, k=5, rows_per_block=64, queries_per_block=7).collect())
    ints = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v in rows if i is not None]
    want = Counter()
    for q in {i for i, _ in ints if i % 20 == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for i, v in ints if i == q for j, w in ints if j != q))[:5]
        for rank, (s, j) in enumerate(scored, 1):
            want[(q, rank, j, -s)] += 1
    assert got == want
    n_queries = len([1 for i, _ in ints if i % 20 == 0])
    assert sent["topk-hits"].count() < 4 * 5 * n_queries


def test_topk_moves_blocks_by_shuffles_only(spark, monkeypatch):
    """A query block meets all rows: its copies are far larger than its file, so no join may send them through the driver."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(400)], "vec_id long, embedding array<float>")
    plans, real = [], topk.stage

    def seen(d, name):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return real(d, name)

    monkeypatch.setattr(topk, "stage", seen)
    out = topk.top_k(df, rows_per_block=32, queries_per_block=4)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("FlatMapCoGroupsInArrow" in p for p in plans) == 2
    assert not any("Broadcast" in p for p in plans)


def test_topk_units_are_bounded():
    """A unit's bytes are bounded, and what moves is far less than a copy of all queries for every row block."""
    row, query = 4096 * 72, 2048 * 72
    for n in (500, 51_282, 615_384, 15_000_000):
        row_blocks, query_blocks = -(-n // 4096), -(-n // 20 // 2048)
        r, q = topk._groups(row_blocks, query_blocks, row, query, 24)
        assert r * q >= min(24, row_blocks * query_blocks)
        assert -(-row_blocks // r) * row <= topk.ROW_BYTES and -(-query_blocks // q) * query <= topk.QUERY_BYTES
        assert n < 10**6 or r * query_blocks * query + q * row_blocks * row < row_blocks * query_blocks * query / 15
    assert topk._groups(9, 7, 1 << 40, 1 << 40, 1) == (9, 7)  # one block at least


def test_topk_of_common_vectors_over_many_units(spark):
    """A third of the rows share one vector, 80 rows are one and the same row, some ids repeat, some vectors are
    empty, longer or at the ends of the narrow integers: over several units of each kind the lists are those of all pairs."""
    r = random.Random(23)
    rows = [(i, [r.randint(-128, 127) for _ in range(9)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(260)] + [(1500, rows[1][1])] * 80
    rows += [(40, []), (2001, []), (60, [127] * 9), (80, [-128] * 9), (2003, [128, -129] * 6), (2020, [40000, 1]), (2021, [-(1 << 20)] * 3)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = Counter(tuple(x) for x in topk.top_k(df, k=6, scale=1.0, rows_per_block=50, queries_per_block=9).collect())
    want = Counter()
    for q in {i for i, _ in rows if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for i, v in rows if i == q for j, w in rows if j != q)[:6]
        want.update((q, n + 1, j, -s) for n, (s, j) in enumerate(scored))
    assert got == want


def test_topk_of_other_number_types(spark):
    """Vectors of whole numbers, nulls among them; of doubles that reach past 64 bits when scaled; and all empty."""
    whole = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [5, None]), (3, [-7, 1])], "vec_id long, embedding array<int>")
    assert {tuple(r) for r in topk.top_k(whole, k=5, scale=1.0).collect()} == {(0, 1, 1, 11), (0, 2, 3, -5)}
    wide = spark.createDataFrame([(0, [1.0]), (1, [1e300]), (2, [-1e300]), (3, [1.7e308]), (4, [0.5])], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(wide, k=5, scale=2.0).collect()}
    top = 2**63
    assert got == {(0, 1, 1, top - 1), (0, 2, 3, top - 1), (0, 3, 4, 2), (0, 4, 2, -top)}
    empty = spark.createDataFrame([(i, []) for i in range(3)], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(empty).collect()} == {(0, 1, 1, 0), (0, 2, 2, 0)}


def plain_licenses(texts, templates, required, words=5, threshold=0.8):
    """Brute force: (text place, license) by exact containment and phrases."""
    split = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    shingles = lambda w: [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    out = set()
    for name, t in templates.items():
        wanted = set(shingles(split(t)))
        for i, text in enumerate(texts):
            w = split(text)
            at = [j for j, s in enumerate(shingles(w)) if s in wanted]
            if wanted and len({shingles(w)[j] for j in at}) >= threshold * len(wanted):
                span = f" {' '.join(w[min(at) : max(at) + words])} "
                if all(f" {p} " in span for p in required.get(name, ())):
                    out.add((i, name))
    return out


def test_license_recall_of_edited_templates(spark):
    """Templates of 9 to 90 words with one to three words changed, left out or put in, within other text: all are found."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    templates = {f"t{i}": " ".join(word() for _ in range(n)) for i, n in enumerate([*range(9, 40), 50, 64, 90])}
    texts = []
    for t in templates.values():
        for k in range(8):
            w = t.split()
            if k == 0 and len(w) < 12:  # one shingle in the middle broken by its middle word only
                w[len(w) // 2] = word()
            for _ in range(k % 4):
                i = r.randrange(len(w))
                w[i : i + 1] = r.choice([[word()], [], [w[i], word()]])
            texts.append(" ".join([word() for _ in range(r.randrange(30))] + w + [word() for _ in range(r.randrange(30))]))
    want = plain_licenses(texts, templates, {})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.license) for x in license_scan.scan_licenses(df, templates).collect()}
    assert len(want) > 100 and got == want


def test_licenses_of_nearly_the_same_wording(spark):
    """Versions and families are told apart; each default template finds itself."""
    t = license_scan.TEMPLATES
    names = list(t)
    texts = [f"Some words before. {t[n]} And some after, in version 7 of the file." for n in names]
    texts += [t["GPL-3.0-or-later"].replace("version 3", "version 2"), t["GPL-3.0-or-later"].replace("General", "Lesser General"), "Licensed under the MIT License, see LICENSE"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.license) for x in license_scan.scan_licenses(df).collect()}
    assert got == plain_licenses(texts, t, license_scan.REQUIRED)
    assert {(i, n) for i, n in enumerate(names)} <= got
    by = {}
    for i, n in got:
        by.setdefault(i, set()).add(n)
    assert by[names.index("GPL-2.0-notice")] == {"GPL-2.0-notice"} and by[names.index("GPL-3.0-notice")] == {"GPL-3.0-notice"}
    assert by[names.index("LGPL-2.1-or-later")] == {"LGPL-2.1-or-later"} and by[names.index("AGPL-3.0-or-later")] == {"AGPL-3.0-or-later"}
    assert "GPL-3.0-or-later" not in by.get(len(names), set()) | by.get(len(names) + 1, set()) and by[len(names) + 2] == {"MIT-notice-licensed"}


def plain_buckets(text, bits=15):
    """Folding, n-grams and their buckets in plain Python integers, by the module's stated rule."""
    folded = []
    for c in text:
        low = c.lower()
        ch = (low if len(low) == 1 and ord(low) < 0x10000 else c) if c.isalpha() and ord(c) < 0x10000 else c if c.isalpha() else " "
        if ch != " " or (folded and folded[-1] != " "):
            folded.append(ch)
    whole = "".join(folded).strip(" ")
    if not whole:
        return Counter()
    z, all_ones = [ord(c) for c in f" {whole} "], (1 << 64) - 1
    a, b, c = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    out = Counter()
    for i in range(len(z)):
        one = (z[i] + 1) * a & all_ones
        hashes = [one] if z[i] != 32 else []
        if i + 1 < len(z):
            two = ((one ^ (one >> 29)) * b + z[i + 1] * c) & all_ones
            hashes.append(two + 2 & all_ones)
            if i + 2 < len(z):
                hashes.append(((two ^ (two >> 31)) * a + z[i + 2] * b) + 3 & all_ones)
        for h in hashes:
            out[((h ^ (h >> 32)) * c & all_ones) >> (64 - bits)] += 1
    return out


def test_language_model_against_plain_python(spark):
    """Counts, probabilities and predictions without any of the module's own functions."""
    r = random.Random(12)
    words_of = {"en": ["the", "cat", "sat", "on", "mat"], "de": ["der", "Hund", "läuft", "über", "Straße"], "xx": ["𝒜b", "ÇA", "İx", "日本"]}
    rows = [(i, " ".join(r.choice(words_of[la]) for _ in range(r.randrange(1, 12))) + r.choice(["", "! 42", "\n\n "]), la, "a") for i, la in enumerate(["en", "de", "xx"] * 12)]
    model = langid.fit(docs_df(spark, rows))
    langs = sorted(words_of)
    counts = {la: sum((plain_buckets(t) for _, t, x, _ in rows if x == la), Counter()) for la in langs}
    log_prob = {la: {b: np.log((counts[la][b] + 0.5) / (sum(counts[la].values()) + 0.5 * 2**15)) for b in range(2**15)} for la in langs}
    assert model.languages == langs
    for text in ["der Kater", "the Hund", "日本 b", "ÇÇ the", "42", ""]:
        grams = plain_buckets(text)
        if not grams:
            assert model.score(text) == ("und", 0.0)
            continue
        total = np.array([np.log(1 / 3) + sum(n * log_prob[la][b] for b, n in grams.items()) for la in langs])
        p = np.exp(total - total.max())
        assert model.score(text) == (langs[int(total.argmax())], pytest.approx(p.max() / p.sum()))
