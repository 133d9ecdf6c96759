"""SimHash near-duplicates, joined exactly with vantage-point trees.

1. Every text gets a 64-bit fingerprint: the bitwise majority of the XXH64
   values of its three-word shingles.
2. Exact copies collapse: one class per distinct fingerprint.
3. A vantage-point tree is grown on a bounded sample of the fingerprints. Its
   leaves are the shards. Each class lives in one leaf (its home); where a ball
   boundary lies within ``max_bits`` of it, it also visits the leaves beyond
   (triangle inequality), so both members of every close pair meet in the home
   leaf of one of them.
4. Each leaf is searched exactly. A leaf emits the edges of a spanning forest
   instead of all pairs, so a dense group costs as many edges as members.
5. Components come from minimum-label propagation with pointer jumping over the
   edge table, in the shared folder, never on the driver.

Nulls and ties: a NULL or blank text has fingerprint zero and is linked like any
other; a NULL ``doc_id`` is kept and never becomes a component id unless its
whole component has none (then NULL). Repeated rows keep one result row each. Texts are
read whole, however long. An empty table gives an empty result. :func:`near_duplicates`
ignores extra columns, :func:`keep_one` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledger_spark.llm.common import free_name, may_contain, slices, smallest_by_hash, written

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints that the tree is grown on (the tree only decides the sharding).
TREE_SAMPLE = 16384
#: Classes that a leaf should hold: this many times the root of their number,
#: within bounds. Small leaves prune more but are visited more often, and visits
#: are shuffled; inside a leaf a second tree prunes in memory.
LEAF_FACTOR, LEAF_CLASSES, LEAF_MOST = 20, 4096, 1 << 18
INNER_LEAF = 2048
MAX_LEAVES = 1 << 14
#: Vantage candidates tried at a node.
CANDIDATES = 8
_XXH = partial(xxhash.xxh64_intdigest, seed=SEED)
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) < shingle_words:
        return _XXH(b" ".join(words))
    n = len(words) - shingle_words + 1
    grams = map(_XXH, map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    hashes = np.fromiter(grams, np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        block = hashes[at:at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t, shingle_words) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, fp long")


def _distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Vantage-point tree over 64-bit fingerprints, as flat arrays.

    ``inside[i]``/``outside[i]`` are node numbers, or ``-1 - leaf``.
    """

    def __init__(self, sample: np.ndarray, total: int, max_bits: int, leaf_classes: int = LEAF_CLASSES):
        self.max_bits, self.leaves = max_bits, 0
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self._scale = total / max(1, len(sample))
        self._leaf_classes = max(leaf_classes, total // MAX_LEAVES)
        self._rng = np.random.default_rng(SEED)
        self.root = self._grow(sample)

    def _grow(self, points: np.ndarray) -> int:
        split = None
        if len(points) * self._scale > self._leaf_classes and len(points) > 8:
            split = self._split(points)
        if split is None:
            self.leaves += 1
            return -self.leaves
        vantage, radius, near = split
        node = len(self.vantage)
        self.vantage.append(int(vantage))
        self.radius.append(radius)
        self.inside.append(0)
        self.outside.append(0)
        self.inside[node] = self._grow(points[near])
        self.outside[node] = self._grow(points[~near])
        return node

    def _split(self, points: np.ndarray):
        """The vantage point and radius that send the fewest points both ways;
        None where nearly all would go both ways (a dense group: salting splits it)."""
        best = None
        for vantage in self._rng.choice(points, min(CANDIDATES, len(points)), replace=False):
            d = _distance(points, vantage)
            radius = int(np.median(d))
            near = d <= radius
            if near.all():
                radius -= 1
                near = d <= radius
            if not near.any() or near.all():
                continue
            both = ((d > radius - self.max_bits) & (d <= radius + self.max_bits)).mean()
            lopsided = abs(near.mean() - 0.5)
            if best is None or both + lopsided < best[0]:
                best = (both + lopsided, both, vantage, radius, near)
        if best is None or best[1] > 0.9:
            return None
        return best[2:]

    def route(self, fps: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, index into fps, is home) of every visit. ``home`` tells which
        fingerprints live here (default: all); the others are guests from the start."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        every = np.arange(len(fps))
        stack = [(self.root, every, every[:0]) if home is None else (self.root, every[home], every[~home])]
        while stack:
            node, home, guest = stack.pop()
            if not len(home) and not len(guest):
                continue
            if node < 0:
                n = len(home) + len(guest)
                out.append((np.full(n, -1 - node), np.concatenate([home, guest]), np.arange(n) < len(home)))
                continue
            v, r, m = np.uint64(self.vantage[node]), self.radius[node], self.max_bits
            dh, dg = _distance(fps[home], v).astype(int), _distance(fps[guest], v).astype(int)
            # an outside home within max_bits of the ball visits the inside;
            # a pair across the boundary thus meets where the inner member lives
            visits = home[(dh > r) & (dh <= r + m)]
            stack.append((self.inside[node], home[dh <= r], np.concatenate([visits, guest[dg <= r + m]])))
            stack.append((self.outside[node], home[dh > r], guest[dg > r - m]))
        if not out:
            return every[:0], every[:0], every[:0].astype(bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def _forest(fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever is linked in a leaf: a breadth-first search in
    which each home is compared with the homes not yet reached and with all
    guests. A guest gets one edge per component that it touches."""
    homes, guests = fps[home], fps[~home]
    left = np.arange(len(homes))
    touched = np.full(len(guests), -1)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    component = 0
    while len(left):
        queue = [left[0]]
        left = left[1:]
        while queue:
            p = homes[queue.pop()]
            if len(left):
                close = _distance(homes[left], p) <= max_bits
                if close.any():
                    found = left[close]
                    left = left[~close]
                    queue.extend(found.tolist())
                    a.append(np.full(len(found), p))
                    b.append(homes[found])
            if len(guests):
                met = np.flatnonzero(_distance(guests, p) <= max_bits)
                met = met[touched[met] != component]
                if len(met):
                    touched[met] = component
                    a.append(np.full(len(met), p))
                    b.append(guests[met])
        component += 1
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _edges_within(fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_forest` of a leaf, pruned by a tree over its homes."""
    homes = fps[home]
    if len(homes) <= 2 * INNER_LEAF:
        return _forest(fps, home, max_bits)
    sample = np.random.default_rng(SEED).choice(homes, min(len(homes), TREE_SAMPLE), replace=False)
    leaf, at, lives = Tree(sample, len(homes), max_bits, INNER_LEAF).route(fps, home)
    order = np.argsort(leaf, kind="stable")
    found = []
    for group in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        if lives[group].any():
            found.append(_forest(fps[at[group]], lives[group], max_bits))
    return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def close_edges(classes: DataFrame, max_bits: int = MAX_BITS, leaf_classes: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``classes.fp``: their
    components are those of all pairs within ``max_bits``."""
    spark = classes.sparkSession
    total = classes.count()
    if leaf_classes is None:
        leaf_classes = min(max(LEAF_CLASSES, int(LEAF_FACTOR * total ** 0.5)), LEAF_MOST)
    sample = np.array([r.fp for r in smallest_by_hash(classes.select("fp"), "fp", TREE_SAMPLE, total).collect()], np.int64)
    tree = spark.sparkContext.broadcast(Tree(sample.view(np.uint64), total, max_bits, leaf_classes))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8192):
            fps = part.column(0).to_numpy(zero_copy_only=False)
            leaf, at, home = tree.value.route(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf.astype(np.int32)), pa.array(fps[at]), pa.array(home)], ["leaf", "fp", "home"])

    routed = written(classes.select("fp").mapInArrow(visits, "leaf int, fp long, home boolean"), "simhash-visits")
    # leaves above the target are searched by several tasks, each for its own homes
    salts = (routed.filter("home").groupBy("leaf").count()
             .select("leaf", F.ceil(F.col("count") / (4 * leaf_classes)).cast("int").alias("salts"))
             .filter("salts > 1"))
    shares = {r.leaf: r.salts for r in salts.collect()}  # at most MAX_LEAVES rows
    share = F.lit(1)
    if shares:
        pairs = [F.lit(x) for kv in shares.items() for x in kv]
        share = F.coalesce(F.element_at(F.create_map(*pairs), F.col("leaf")), F.lit(1))
    dealt = (routed.withColumn("salts", share)
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
             .withColumn("home", F.col("home") & (F.col("salt") == F.col("own")))
             .select("leaf", "salt", "fp", "home"))

    def search(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        u, v = _edges_within(fps, group.column("home").to_numpy().astype(bool), max_bits)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return written(dealt.groupBy("leaf", "salt").applyInArrow(search, "u long, v long"), "simhash-edges")


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges(u, v)``.

    Each round takes the minimum over the neighbours and then over the root's
    own label, so path lengths halve; labels only fall, so an unchanged sum
    means that nothing changed.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = written(both, "component-edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                     .select("node", F.least("node", "m").alias("root")), "component-labels")
    last = None
    while True:
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == last:
            return labels
        last = total
        near = (both.join(labels, both.u == labels.node).select(F.col("v").alias("node"), "root")
                .union(labels).groupBy("node").agg(F.min("root").alias("root")))
        near = written(near, "component-near")
        up = near.select(F.col("node").alias("root"), F.col("root").alias("above"))
        labels = written(near.join(up, "root").select("node", F.least("root", "above").alias("root")),
                         "component-labels")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (needs doc_id, text)."""
    rows = written(fingerprints(docs, shingle_words), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    labels = component_labels(close_edges(classes, max_bits))
    rooted = written(classes.join(labels, classes.fp == labels.node, "left")
                     .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    roots = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-roots")
    of = written(rooted.join(roots, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without its near-duplicates: of each component the row with the
    smallest doc_id stays; of rows that repeat this id with one fingerprint, one.

    The columns are those of ``docs``. Rows without a doc_id stay where nothing
    of their component has one: one row per fingerprint.
    """
    names = docs.columns
    own, fp, n, found_fp = (free_name(c, names) for c in ("kept_id", "kept_fp", "kept_rows", "found_fp"))
    found = written(near_duplicates(docs, shingle_words, max_bits), "simhash-found")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # ids of which some row goes; the rows of all others pass without a shuffle
    concerned = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.every(stays).alias("stays"))
    may = may_contain(concerned.filter("rows > 1 OR NOT stays OR doc_id IS NULL"), "doc_id", F.col("doc_id"))
    rest = docs.filter(may)
    kept = written(found.filter(stays).groupBy(F.col("doc_id").alias(own), F.col("fp").alias(fp))
                   .agg(F.count(F.lit(1)).alias(n)), "simhash-kept")
    ids = kept.groupBy(own).agg(F.sum(n).alias(n))
    once = docs.filter(~may).union(
        rest.join(ids.filter(F.col(n) == 1), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi"))
    again = ids.filter(F.col(n) > 1)
    if again.isEmpty():
        return once
    more = rest.join(again, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    at, schema = names.index("text"), docs.schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t, shingle_words) for t in part.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps.view(np.int64))], [*names, found_fp])

    more = more.mapInArrow(add, StructType([*schema.fields, StructField(found_fp, LongType())]))
    more = more.join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(found_fp) == F.col(fp)), "left_semi")
    return once.union(more.dropDuplicates(["doc_id", found_fp]).select(*names))
