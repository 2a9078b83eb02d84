"""Exact dedup and the Jaccard join against plain Python."""

import math
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from trailgraph.llm import bits, common, exact_dedup, jaccard_join, minhash_dedup
from trailgraph.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "null id text"), (1000, None), (1001, ""), (1002, "   \t\n"), (1003, "Two Words"), (1004, "two words"), (1005, "two  words"), (1006, "X" * 50_000)]
    base = [[rng.choice(words) for _ in range(rng.choice([5, 6, 30, 80, 200]))] for _ in range(12)]
    for k in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, len(text) // 12])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text = text[: max(5, len(text) * 9 // 10)]
        rows.append((k, " ".join(text)))
    rows += [(2000, "Same Text Here"), (2001, "same text here"), (2001, "same text here"), (2002, "SAME TEXT HERE")]
    return rows


def sets_of(rows):
    out = []
    for _, text in rows:
        w = WORD.findall((text or "").encode().lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def expected_components(rows, percent=75):
    sets, label = sets_of(rows), {}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            label[find(i)] = min(label.get(find(i), key), key)
    return sorted((-1 if key is None else key, len(sets[i]), -1 if key is None else label[find(i)]) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("tile_shingles", [1 << 20, 150])
@pytest.mark.parametrize("hot", [1 << 16, 1])
def test_near_copies_equal_brute_force(spark, monkeypatch, tile_shingles, hot):
    monkeypatch.setattr(jaccard_join, "TILE_MEMBERS", 3 if hot == 1 else 512)
    monkeypatch.setattr(jaccard_join, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(common, "HOT_ROWS", 2 if hot == 1 else 500)
    rows = corpus(tile_shingles + hot)
    docs = spark.createDataFrame([(k, t, "x", 7) for k, t in rows], "doc_id long, text string, component_id string, n long")
    got = jaccard_join.near_copies(docs, tile_shingles=tile_shingles).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == expected_components(rows)


def test_near_copies_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_copies(empty).collect() == []


def test_drop_near_copies_keeps_columns_and_smallest(spark):
    rows = [(5, "a b c d e f g h", "k"), (2, "a b c d e f g h", None), (9, "other words entirely in this one", "z"), (7, None, "n")]
    kept = jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 9]


def other_texts(n=6):
    return [" ".join(f"{c}{i}" for i in range(20)) for c in "abcdefghij"[:n]]


@pytest.mark.parametrize("tile_shingles", [1 << 20, 30])
def test_repeated_ids_of_different_texts(spark, tile_shingles):
    a, b, c, d, e, f = other_texts()
    rows = [(5, a), (5, b), (2, a + " z"), (7, b + " z"), (5, c), (9, c), (9, d), (9, d), (8, e), (8, None), (None, a), (None, f), (3, e + " z"), (3, f), (4, f)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_copies(docs, tile_shingles=tile_shingles).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == expected_components(rows)
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.drop_near_copies(docs).collect()]
    expected = [(5, b), (2, a + " z"), (5, c), (9, d), (9, d), (8, None), (None, a), (None, f), (3, e + " z"), (3, f)]
    assert sorted(map(str, kept)) == sorted(map(str, expected))


def test_exact_dedup_of_null_and_repeated_ids(spark):
    a, b, c, d, _, _ = other_texts()
    rows = [(None, a), (6, a), (None, b), (None, c), (None, None), (1, d), (1, "unique one"), (2, d.upper()), (1, b + " z")]
    kept = [(r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    expected = [(6, a), (None, b), (None, c), (None, None), (1, "unique one"), (2, d.upper()), (1, b + " z")]
    assert sorted(map(str, kept)) == sorted(map(str, expected))


def test_bitmaps_never_exclude_a_link():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(1, 1 << 63, n // 12, dtype=np.uint64))))
        if not len(b):
            continue
        overlap = len(np.intersect1d(a, b))
        assert jaccard_join._overlap(a, b) == overlap
        if 100 * overlap >= 75 * (len(a) + len(b) - overlap):
            pair = sorted((a, b), key=len)
            maps = [jaccard_join._bitmap(s, jaccard_join.bitmap_bits(len(s))) for s in pair]
            assert jaccard_join.with_partner(np.array([len(s) for s in pair]), maps).all()


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(300, 299), (299, 300)]
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 130)}, 300: 299}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups_equal_brute_force(spark, monkeypatch):
    rows = corpus(11) + [(3000, "ÄPFEL"), (3001, "äpfel"), (3002, "Äpfel")]
    docs = spark.createDataFrame([(k, t, 1, "y") for k, t in rows], "doc_id long, text string, group_size int, kept string")
    for slice_rows, hot_rows in ((exact_dedup.SLICE_ROWS, 500), (20, 1)):
        monkeypatch.setattr(exact_dedup, "SLICE_ROWS", slice_rows)
        monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect())
        groups = {}
        for key, text in rows:
            groups.setdefault(lowered(text), []).append(-1 if key is None else key)
        assert got == sorted((-1 if k is None else k, max(groups[lowered(t)]), len(groups[lowered(t)]), (-1 if k is None else k) == max(groups[lowered(t)])) for k, t in rows)


def test_bloom_passes_single_rows_through(spark):
    rows = [(i, f"text {i}") for i in range(500)] + [(1000 + i, "copy") for i in range(20)]
    digests = common.written(exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"))
    maybe = {r["doc_id"]: r["maybe"] for r in exact_dedup.possibly_repeated(digests).collect()}
    assert all(maybe[1000 + i] for i in range(20))
    assert sum(maybe[i] for i in range(500)) < 50


def shuffles(df):
    """The columns that each shuffle of the plan carries."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bExchange (hash|range|round|Single)", line)]


def test_only_possible_repeats_are_shuffled(spark):
    rows = common.written(exact_dedup.digests(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string"), "doc_id", "text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        key = [F.col("text_sha256")]
        marks = bits.with_held(rows, key, common.written(bits.bit_filter(rows, key, 1, 2)), 1, "maybe")
        assert shuffles(marks) == [] and "bitmap" not in "".join(marks.columns) and "BroadcastHashJoin" in marks._jdf.queryExecution().executedPlan().toString()
        for line in shuffles(bits.bit_filter(rows, key, 1, 2)):
            assert "chunk" in line and "sha256" not in line and "bitmap" not in line
        docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
        kept = bits.without(docs, [docs["doc_id"]], common.written(docs.select("doc_id").filter("doc_id = 1")))
        assert [r["doc_id"] for r in kept.collect()] == [2]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    rows = common.written(spark.createDataFrame([(i, i % 7 if i % 7 else None) for i in range(3000)], "k long, v long"))
    key = [F.col("k"), F.col("v")]
    chunks = bits.chunks_for(10**9, most=1)
    made = bits.with_held(rows, key, bits.bit_filter(rows.filter("k % 2 = 0"), key, chunks), chunks, "held")
    assert made.filter("k % 2 = 0 and not held").count() == 0
    assert sorted(r["k"] for r in bits.without(rows, key, rows.filter("k < 2990")).collect()) == list(range(2990, 3000))


def test_counted_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(90)], "k long, i long")
    side = common.written(rows.groupBy("k").agg(F.count("*").alias("n")).filter("k != 6"))
    got = sorted(tuple(r) for r in common.join_counted(rows, side, "k", "n").collect())
    assert got == sorted(tuple(r) for r in rows.join(side, "k").collect()) and len(got) == 89


def test_columns_of_any_name_are_kept(spark):
    names = ["doc_id", "text", "__dropped_id", "__dropped_hash", "maybe", "chunk", "bitmap", "key", "component_id", "text_sha256"]
    a = " ".join(f"w{i}" for i in range(30))
    rows = [(k, t, *range(8)) for k, t in ((1, a), (2, a), (3, a + " z"), (4, "other words here"))]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    exact, near = exact_dedup.exact_dedup(docs), jaccard_join.drop_near_copies(docs)
    assert exact.columns == near.columns == names
    assert sorted(r["doc_id"] for r in exact.collect()) == [2, 3, 4] and sorted(r["doc_id"] for r in near.collect()) == [1, 4]


def test_exact_dedup_of_nothing_and_columns(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "A b", "s"), (2, "a B", None), (None, None, "n")]
    kept = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, keep_id string"))
    assert kept.columns == ["doc_id", "text", "keep_id"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None"]


# -- MinHash ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile_shingles, seed", [(1 << 20, 3), (150, 4), (600, 5)])
def test_minhash_components_equal_brute_force(spark, tile_shingles, seed):
    rows = corpus(seed, 90)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, key string, n int").repartition(3)
    got = minhash_dedup.near_copies(df, tile_shingles=tile_shingles).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == expected_components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_group_of_many_near_copies_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_MEMBERS", 12)
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for k in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 9])):
            text[rng.randrange(len(text))] = f"x{k}"
        rows.append((k, " ".join(text)))
    got = minhash_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected_components(rows, 85)


def test_minhash_threshold_misses_less_than_it_says():
    short = sum(math.comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(minhash_dedup.MATCHES))
    assert short <= minhash_dedup.MISS < short + math.comb(64, minhash_dedup.MATCHES) * 0.85**minhash_dedup.MATCHES * 0.15 ** (64 - minhash_dedup.MATCHES)


def test_minhash_agreement_estimates_jaccard():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.85):
        agreed = []
        for _ in range(60):
            n = 300
            common_n = round(2 * n * share / (1 + share))
            pool = rng.integers(1, 1 << 63, 2 * n - common_n, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common_n], pool[n:])))
            agreed.append((minhash_dedup.signature(a) == minhash_dedup.signature(b)).mean())
        assert abs(np.mean(agreed) - share) < 0.03 and np.std(agreed) < 1.4 * (share * (1 - share) / 64) ** 0.5


def test_minhash_matching_by_merging_and_skipping_equals_counting():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 5, (6, 64), dtype=np.uint32)
    rows = base[rng.integers(0, 6, 80)].copy()
    changed = rng.random(rows.shape) < rng.random((80, 1)) * 0.7
    rows[changed] = rng.integers(0, 9, int(changed.sum()), dtype=np.uint32)
    postings = minhash_dedup.Postings(rows)
    for i in range(80):
        wanted = rng.random(80) < 0.8
        counts = (rows == rows[i]).sum(axis=1)
        assert postings.matching(i, wanted).tolist() == np.flatnonzero((counts >= minhash_dedup.MATCHES) & wanted).tolist()


def test_minhash_digests_tell_sets_apart():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64)) for n in range(0, 40)]
    sets += [s[:-1] for s in sets[5:]] + [s[1:] for s in sets[5:]]
    assert len({minhash_dedup.digest(s) for s in sets}) == len({s.tobytes() for s in sets})


def test_minhash_keeps_other_columns_and_rows_without_partner(spark):
    rows = corpus(8)
    docs = spark.createDataFrame([(k, t, f"s{i}", i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, node string, component_id int")
    kept = minhash_dedup.deduplicated(docs)
    assert kept.schema == docs.schema
    component = {}
    for (k, t), (_, _, c) in zip(sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])), expected_components(rows, 85)):
        component[k] = c
    assert {r.doc_id for r in kept.collect()} == {k for k, c in component.items() if k is None or k == c}


def test_minhash_empty_table(spark):
    assert minhash_dedup.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
