"""SimHash: fingerprints against a plain version, components against brute force."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledger_spark.llm import simhash

SCHEMA = "doc_id long, text string, source string"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").split(" ")
    words = [w for x in words for w in x.replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """doc_id -> component over (doc_id, fingerprint) with union-find over all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if bin(a ^ rows[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [(key, least[find(i)]) for i, (key, _) in enumerate(rows)]


def test_fingerprint_matches_the_plain_version():
    for text in [None, "", " \n\t", "One", "one two", "A b C", "x y z w " * 50, "Éa Ü ß q r s", "a\x1cb c d e"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 100)
    assert simhash.fingerprint(text) == whole


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    fps[1500:] = fps[:1500] ^ (np.uint64(1) << rng.integers(0, 63, 1500).astype(np.uint64))
    fps[1400:1600] = fps[0] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))  # a dense group
    fps = np.unique(fps)
    tree = simhash.Tree(fps[:500], len(fps), 3, 64)
    assert tree.leaves > 4
    leaf, at, home = tree.route(fps)
    assert np.array_equal(np.sort(at[home]), np.arange(len(fps)))  # one home each
    met = set()
    for x in range(tree.leaves):
        mine = leaf == x
        homes, everyone = set(at[mine & home].tolist()), at[mine].tolist()
        met |= {(min(i, j), max(i, j)) for i in homes for j in everyone if i != j}
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            assert j == i or (min(i, j), max(i, j)) in met


def test_inner_tree_gives_the_same_components(monkeypatch):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(5), fps[:50] ^ np.uint64(0x4005)]))
    home = rng.random(len(fps)) < 0.7
    monkeypatch.setattr(simhash, "INNER_LEAF", 32)

    def groups(edges):
        parent = {int(f): int(f) for f in fps}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for u, v in zip(*edges):
            parent[find(int(u))] = find(int(v))
        return {f: find(f) for f in parent}

    one, two = groups(simhash._edges_within(fps, home, 3)), groups(simhash._forest(fps, home, 3))
    for a in one:
        for b in list(one)[:40]:
            assert (one[a] == one[b]) == (two[a] == two[b])


def test_components_nulls_ties_and_repeats(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 4
    rows = [(5, base, "a"), (3, base, "a"), (9, base + "now", "b"), (7, "something else entirely here now", "b"),
            (7, "something else entirely here now", "b"), (4, None, None), (2, "", None), (None, base, None),
            (None, "lonely words without id", None), (8, "two words", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    expected = sorted(brute([(k, plain_fingerprint(t)) for k, t, _ in rows]), key=str)
    assert got == expected


def test_keep_one_per_component(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 3
    rows = [(5, base, "a"), (3, base, "x"), (3, base, "x"), (6, "other text of its own", "a"), (None, "no id here at all", "n"),
            (1, None, "q"), (2, " ", "q")]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS fp", "2 AS __rows"))
    assert kept.columns == ["doc_id", "text", "source", "fp", "__rows"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 6, None, 1], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_labels_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.component_labels(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_kept_rows_keep_any_column(spark):
    rows = [(1, "some words here"), (2, "some words here"), (2, "some words here"), (3, "another text"), (3, "another one text"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs
    for name in ("__id", "__fp", "__found", "__rows", "kept_id", "kept_fp", "kept_rows", "found_fp", "fp", "u"):
        clash = clash.withColumn(name, F.lit("kept"))
    got = simhash.keep_one(clash)
    assert got.columns == clash.columns and {r.fp for r in got.collect()} == {"kept"}
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, simhash.keep_one(docs).collect()))
