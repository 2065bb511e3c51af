"""Near-duplicate detection on word shingles: sketches from one hash function,
inverted lists of retained values, union-sketch estimates, exact Jaccard.

1. A document is its set of distinct shingles, each hashed once (64 bits). Its
   sketch retains the smallest values. Documents with the same set fall into
   one class; everything below is done per class.
2. Inverted lists. Single retained values are too common to be lists (two-word
   shingles have a finite universe), so values are retained in tuples: the
   hash values are divided into residue classes, and the list key is the tuple
   of the smallest ``TUPLE`` values of a residue class. Two sets of similarity
   t agree on a residue class with probability t^TUPLE or more, independently;
   with ``CLASSES`` = 45 of them, a pair of similarity 0.8 shares no list with
   probability 1e-6. Smaller sets have fewer residue classes (see ``keys``).
3. Star pairs: every member of some list is paired with the centres of its
   largest lists (centres are chosen in one of ``ORDERS`` orders, so that a group
   of copies has several), at most ``STARS`` of them. The pair's
   similarity is estimated from both sketches (bottom-k of the union); likely
   pairs are confirmed on the full sets and links give components. In lists
   that still span several components, members outside the largest are paired
   with a member of it, once for each such component, and so on while that helps.
4. What is left is done in full: in each list that spans several components,
   members outside the largest component are paired with all members of other
   components. Long lists, and large components with all that share a list
   with them, are instead compared block by block of full sets. Pairs are dropped only where the estimate lies five standard
   errors below the threshold; the others are confirmed on the full sets.
   Together with step 3 this covers every pair of a list that could still
   join two components.

Components are complete for all pairs that share a list. Copies are never
expanded into pairs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import ceil, comb, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.llm.common import python_ready, slices, stage
from costwise.llm.components import components

WORDS, THRESHOLD = 5, 0.8
SKETCH, TUPLE, CLASSES = 64, 6, 45
ORDERS, ROUNDS, STARS = 4, 4, 4
#: Components and lists of so many members are compared in blocks of so many bytes of sets.
LARGE, LONG, BLOCK_BYTES = 64, 32, 1 << 20
#: Rows of small tables up to this many are broadcast (checked).
BROADCAST_ROWS = 100_000
#: Sets up to this size (at 0.8) differ in at most two shingles when similar; their lists are all subsets without up to two shingles.
SMALL = 13
#: Fewer values than this are too common a key.
THIN = 3
#: Sizes with 20 residue classes; below, size steps; above, ``CLASSES``.
_MID = (60, 270)
_CACHED = 200_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word -> 64-bit hash; starts anew when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


_WORDS = _Words()


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than that are one shingle."""
    parts = text.lower().split() if text else []  # of bytes: A-Z, and white space as in the contracts
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        acc = _mix((acc + h[j : len(h) - width + 1 + j]) * _A + np.uint64(j + 1))
    return np.unique(acc)


def _sum_key(bucket: int, label: np.ndarray, values: np.ndarray) -> np.ndarray:
    return _mix(values + _mix((label.astype(np.uint64) + np.uint64(1)) * _A + np.uint64(bucket)))


@lru_cache(8)
def _steps(threshold: float) -> tuple[list[float], list[tuple[int, int]]]:
    """Size steps of small sets by 1 / threshold, and per step (residue classes, partitions).

    Sets of a step differ from similar ones in at most ``d`` values. If these
    miss one residue class of a partition, the pair shares its key; partitions
    are added until all failing is less likely than 1e-6 (and one more, for
    the residue classes that are too thin to be keys).
    """
    lows, plan, k = [], [], 0
    while (low := (1 / threshold) ** k) < _MID[0] / threshold:
        classes = max(3, round(low / 5))
        d = max(1, int(2 * low / threshold * (1 - threshold) / (1 + threshold)))
        all_hit = sum((-1) ** j * comb(classes, j) * (1 - j / classes) ** d for j in range(classes + 1))
        lows.append(low)
        plan.append((classes, 1 + ceil(log(1e-6) / log(min(max(all_hit, 1e-6), 0.999)))))
        k += 1
    return lows, plan


def _tuples(values: np.ndarray, label_base: int, classes: int) -> np.ndarray:
    """One key per residue class: its smallest ``TUPLE`` values; classes of fewer than ``THIN`` values have none."""
    head = values[: classes * TUPLE * 8]  # surely enough of each class, or else all
    while True:
        label = (_mix(head + np.uint64(label_base)) % np.uint64(classes)).astype(np.int64)
        n = np.bincount(label, minlength=classes)
        if len(head) == len(values) or n.min() >= TUPLE:
            break
        head = values
    order = np.argsort(label, kind="stable")
    label, head = label[order], head[order]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    keep = (np.arange(len(head)) - first[label] < TUPLE) & (n[label] >= THIN)
    label, head = label[keep], head[keep]
    if not len(head):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(np.diff(label, prepend=-1))
    with np.errstate(over="ignore"):
        return _mix(np.add.reduceat(_sum_key(label_base, label, head), starts))


def keys(values: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Inverted-list keys of a set (sorted hashes), as int64.

    A pair of similarity ``threshold`` differs in at most (1 - t) / (1 + t) of
    both sizes together; sets that can only match their equals have no keys.
    At 0.8, sets of 4 to 13 shingles have a key per subset without up to two
    shingles, which misses nothing. Sets below 75 are keyed in their size step
    and the next, with residue classes of about five values in several
    partitions; sets of 60 to 270 in three partitions into 20 residue classes;
    sets from 216 on in one partition into ``CLASSES``. The ranges overlap by
    1 / threshold, so that similar sets share one.
    """
    n = len(values)
    if n == 0 or n * (1 - threshold) / threshold < 1 - 1e-9:
        return np.empty(0, np.int64)
    out = []
    if n <= SMALL and threshold >= 0.8:
        drop = 0 if n < 5 else 1 if n < 10 else 2
        mixed = _mix(values + _A)
        with np.errstate(over="ignore"):
            total = mixed.sum(dtype=np.uint64)
            left = [total] + ([total - x for x in mixed] if drop else []) + ([total - x - y for x, y in combinations(mixed, 2)] if drop > 1 else [])
            out.append(_mix(np.array(left, np.uint64)))
    if (n >= (SMALL + 1) * threshold or threshold < 0.8) and n < _MID[0] / threshold:
        lows, plan = _steps(threshold)
        own = bisect_right(lows, n + 1e-9) - 1
        for k in range(own, min(own + 2, len(lows))):
            classes, partitions = plan[k]
            out += [_tuples(values, 1000 * (k + 1) + i, classes) for i in range(partitions)]
    if _MID[0] <= n < _MID[1]:
        out += [_tuples(values, 100 + i, 20) for i in range(3)]
    if n >= _MID[1] * threshold:
        out.append(_tuples(values, 1, CLASSES))
    return np.unique(np.concatenate(out)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n, digests, sketches, lists = [], [], [], []
        for text in pc.cast(b.column(1), pa.binary()).to_pylist():
            s = shingle_set(text, words)
            n.append(len(s))
            digests.append(blake2b(s.tobytes(), digest_size=16).digest())
            sketches.append((s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes())
            lists.append(keys(s, threshold))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "digest", "sketch", "keys"])


def _full_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [shingle_set(t, words).tobytes() for t in pc.cast(b.column(0), pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["digest", "full"])


def estimate(a: bytes, b: bytes) -> float:
    """Jaccard similarity from two sketches: the share of the union's smallest values that both retain."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    union = np.union1d(x, y)
    if len(x) >= SKETCH or len(y) >= SKETCH:  # else both are whole sets
        union = union[:SKETCH]
    both = np.intersect1d(x, y, assume_unique=False)
    return float((both <= union[-1]).sum() / len(union)) if len(union) else 0.0


def _sets_of(cids: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(cid, full): full sets of the named classes, from the text of one document of each.

    The documents' ids are broadcast while they are few (checked), so that no
    other text moves; else texts and ids meet by a shuffle.
    """
    named = stage(cids.distinct().join(classes.select("cid", "digest", "rep"), "cid"), "near-named")
    reps = named.select(F.col("rep").alias("_rep")).distinct()
    if named.count() <= BROADCAST_ROWS:
        reps = F.broadcast(reps)
    text = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    full = text.mapInArrow(lambda it: _full_sets(it, words), "digest binary, full binary").dropDuplicates(["digest"])
    return stage(named.select("cid", "digest").join(full, "digest").select("cid", "full"), "near-sets")


def linked_roots(xs: list[tuple[int, bytes]], ys: list[tuple[int, bytes]], threshold: float) -> set[tuple[int, int]]:
    """Pairs of different roots (of ``xs``, of ``ys``) that hold sets similar enough; members are (root, set)."""
    x_sets, y_sets = ([np.frombuffer(s, np.uint64) for _, s in side] for side in (xs, ys))
    y_roots = np.array([r for r, _ in ys])
    ny = np.array([len(y) for y in y_sets])
    starts = np.concatenate(([0], np.cumsum(ny)[:-1]))
    vocabulary, flat = np.unique(np.concatenate(y_sets), return_inverse=True)
    out, flags = set(), np.zeros(len(vocabulary), np.int32)
    for (root, _), x in zip(xs, x_sets):
        at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
        at = at[vocabulary[at] == x]
        flags[at] = 1
        common = np.add.reduceat(flags[flat], starts)
        flags[at] = 0
        hit = (100 * common >= round(100 * threshold) * (len(x) + ny - common)) & (y_roots != root)
        out.update((root, int(r)) for r in np.unique(y_roots[hit]))
    return out


def _in_blocks(grouped: DataFrame, classes: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """(kind, group, side, root, cid) -> (a, b), roots that hold similar sets on the two sides of a group.

    Each side of a group is packed into blocks of about ``BLOCK_BYTES`` of full
    sets; each block of side 0 meets each block of side 1, and only the roots
    that link come out, never the pairs.
    """
    spark = grouped.sparkSession
    filled = stage(grouped.join(_sets_of(grouped.select("cid"), classes, docs, words), "cid"), "near-filled")
    room = filled.groupBy("kind", "group", "side").agg(F.ceil(F.sum(F.length("full")) / BLOCK_BYTES).alias("blocks")).filter("blocks > 1")
    room = stage(room, "near-room")  # at most a row for each ``BLOCK_BYTES`` of sets
    if room.count() <= BROADCAST_ROWS:
        room = F.broadcast(room)
    block = F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).alias("block")
    packed = stage(filled.join(room, ["kind", "group", "side"], "left").groupBy("kind", "group", "side", block).agg(F.collect_list(F.struct("root", "full")).alias("held")), "near-blocks")

    def compare(batches):
        for b in slices(batches, 1):
            for xs, ys in zip(*(c.to_pylist() for c in b.columns)):
                got = sorted(linked_roots([(x["root"], x["full"]) for x in xs], [(y["root"], y["full"]) for y in ys], threshold))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], pa.int64()) for i in (0, 1)], ["a", "b"])

    sides = [packed.filter(F.col("side") == i).select("kind", "group", F.col("block").alias(f"block{i}"), F.col("held").alias(f"held{i}")) for i in (0, 1)]
    # pairs of block numbers first; the blocks join them one side after the other
    numbers = [s.drop(f"held{i}") for i, s in enumerate(sides)]
    meet = stage(numbers[0].join(numbers[1], ["kind", "group"]).filter("kind = 0 OR block0 <= block1"), "near-meet")  # a list meets itself
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: spread without merging partitions
    held = meet.join(sides[0], ["kind", "group", "block0"]).join(sides[1], ["kind", "group", "block1"])
    return stage(held.repartition(n, "kind", "group", "block0", "block1").select("held0", "held1").mapInArrow(compare, "a long, b long"), "near-between").distinct()


def _pairs_confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, threshold: float, errors: float = 5.0) -> DataFrame:
    """Of (a, b) pairs of classes those whose full sets are similar enough.

    Pairs estimated more than ``errors`` standard errors below the threshold are left out.
    """
    least = threshold - errors * sqrt(threshold * (1 - threshold) / SKETCH) - 0.5 / SKETCH  # half a value for the rounding

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([estimate(x, y) >= least for x, y in zip(a, b)], dtype=bool)

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= round(100 * threshold) * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    sk = [classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b")]
    fits = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-6
    seen = stage(pairs.join(sk[0], "a").join(sk[1], "b").filter(fits).filter(likely("sa", "sb")).select("a", "b"), "near-likely")
    sets = _sets_of(seen.select(F.col("a").alias("cid")).union(seen.select("b")), classes, docs, words)
    side = [sets.select(F.col("cid").alias(c), F.col("full").alias(f"f{c}")) for c in ("a", "b")]
    return stage(seen.join(side[0], "a").join(side[1], "b").filter(similar("fa", "fb")).select("a", "b"), "near-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, id_type: str = "long") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs without U+0020, U+0009-U+000D, A-Z folded. Sets without
    words (null or empty text) are linked with nothing. ``component_id`` is
    the smallest doc_id of the component, ``kept`` says that the row carries
    it. Rows of one id are one document: their sets are linked. Null ids link
    by text like others, count for no component_id, and are null with kept
    true where no member has an id. An empty table gives no rows; other
    columns are ignored. Ids are cast to ``id_type``, any type with an order.
    """
    spark = docs.sparkSession
    python_ready(spark)
    texts = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = stage(texts.mapInArrow(lambda it: _sets(it, words, threshold), f"doc_id {id_type}, n long, digest binary, sketch binary, keys array<long>"), "near-sketches")
    classes = stage(
        sketched.filter("n > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "near-classes",
    )
    posted = classes.select(F.explode("keys").alias("key"), "cid")

    def centre(order):  # one member of a list, the first in an order of the classes
        return F.min(F.struct(F.xxhash64(order, "cid").alias("h"), F.col("cid").alias("cid"))).getField("cid")

    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members"), centre(F.pmod("key", F.lit(ORDERS))).alias("pivot")).filter("members > 1")
    linked = stage(posted.join(lists, "key").select("key", "cid", "pivot", "members"), "near-lists")
    rows = stage(sketched.filter("n > 0").select("doc_id", "digest").join(classes.select("digest", "cid"), "digest").select("doc_id", "cid"), "near-rows")
    per_id = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a <> z")
    same_id = rows.join(per_id, "doc_id").filter("cid <> a").select("a", F.col("cid").alias("b"))

    def pairs_of(df, x, y):
        return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    centres = F.slice(F.sort_array(F.collect_set(F.struct("members", "pivot")), False), 1, STARS)  # of a class's few lists
    largest = linked.filter("cid <> pivot").groupBy("cid").agg(centres.alias("c")).select("cid", F.explode("c.pivot").alias("pivot"))
    tried = stage(pairs_of(largest, "pivot", "cid"), "near-tried")
    links = same_id.unionByName(_pairs_confirmed(tried, classes, texts, words, threshold, errors=2.0))
    lists_open, before = linked.select("key", "cid"), None
    for turn in range(1, ROUNDS + 1):
        roots = components(links)
        placed = lists_open.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")).select("key", "cid", "root")
        # lists that still span several components, and the largest of these
        per_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), centre(F.pmod("key", F.lit(ORDERS * 4)) + turn).alias("rep"))
        main = per_root.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "root", "rep")).alias("m")).filter("parts > 1")
        open_ = stage(placed.join(main.select("key", F.col("m.root").alias("main"), F.col("m.rep").alias("rep"), F.col("m.size").alias("in_main")), "key"), "near-open")
        outside = open_.filter("root <> main")
        n_outside = outside.count()
        if not n_outside or turn == ROUNDS or (before is not None and n_outside > 0.7 * before):
            break
        before, lists_open = n_outside, open_.select("key", "cid")
        per_main = outside.groupBy("cid", "main").agg(F.max(F.struct("in_main", "key", "rep")).getField("rep").alias("rep"))
        star = pairs_of(per_main, "rep", "cid").join(tried, ["a", "b"], "left_anti")
        found = _pairs_confirmed(star, classes, texts, words, threshold, errors=2.0)
        links = stage(links.unionByName(found), "near-links")

    # the rest in full: large components and long lists in blocks, the others as pairs
    if n_outside:
        counts = open_.select("root", "cid").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        big = stage(counts.filter(F.col("n") >= LARGE).select("root"), "near-big")
        small = open_.join(big, "root", "left_anti").select("key", "cid", "root")
        # lists of the same members are one list
        whole_list = small.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("s"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        once = whole_list.filter("lo <> hi").groupBy("n", "s", "lo", "hi").agg(F.min("key").alias("key")).select("key", "n")
        small = stage(small.join(once, "key"), "near-small")

        short = small.filter(F.col("n") < LONG).join(classes.select("cid", F.col("n").alias("size")), "cid")
        one = short.select("key", F.col("cid").alias("x"), F.col("root").alias("rx"), F.col("size").alias("nx"))
        two = short.select(F.col("key").alias("key2"), F.col("cid").alias("y"), F.col("root").alias("ry"), F.col("size").alias("ny"))
        fits = F.least("nx", "ny") >= F.lit(threshold) * F.greatest("nx", "ny") - 1e-6
        cross = pairs_of(one.join(two, (F.col("key") == F.col("key2")) & (F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry")) & fits), "x", "y")
        more = _pairs_confirmed(cross, classes, texts, words, threshold)

        parts = open_.select("key", "root").distinct()
        members = stage(open_.select("root", "cid").distinct(), "near-members")
        touching = parts.join(big, "root").withColumnRenamed("root", "group").join(parts, "key").filter("group <> root").select("group", "root").distinct()
        side = lambda df, i: df.select(*[F.col(c) for c in ("kind", "group")], F.lit(i).alias("side"), "root", "cid")
        of_big = members.join(big, "root").select(F.lit(0).alias("kind"), F.col("root").alias("group"), "root", "cid")
        near_big = touching.join(members, "root").select(F.lit(0).alias("kind"), "group", "root", "cid")
        listed = small.filter(F.col("n") >= LONG).select(F.lit(1).alias("kind"), F.col("key").alias("group"), "root", "cid")
        grouped = stage(side(of_big, 0).unionByName(side(near_big, 1)).unionByName(side(listed, 0)).unionByName(side(listed, 1)), "near-grouped")
        if grouped.limit(1).count():
            more = more.unionByName(_in_blocks(grouped, classes, texts, words, threshold))
        if more.limit(1).count():
            roots = components(links.unionByName(more))

    whole = rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("doc_id", F.coalesce("root", "cid").alias("root"), "cid")
    least_id = whole.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    per_class = stage(whole.select("cid", "root").distinct().join(least_id, "root").select("cid", "component_id").join(classes.select("cid", "digest"), "cid").select("digest", "component_id", F.lit(True).alias("linked")), "near-components")
    out = sketched.select("doc_id", "n", "digest").join(per_class, "digest", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: Two-word shingles, links by brute force over all pairs that share a shingle, components by recursion.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w), 2))) AS i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
