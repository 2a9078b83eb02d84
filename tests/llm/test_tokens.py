"""Token encoding, token files, packing, sampled pieces: against the libraries and brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailgraph.llm import packing, piece_sampling, token_files
from trailgraph.llm.common import ordered_parts, range_bounds, range_part
from trailgraph.llm.token_files import EliasFano
from trailgraph.llm.wordbpe import WordBpe

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "Hello, world!! don't STOP...", "<|endoftext|> a <|startoftext|>b", "Éclair ÉON, İstanbul ΣΑΣ", "hi\x85there 12½ ²\xa0x", "日本語 🎉 text é", "a" * 5000, "x. " * 3000, "tab\there\nnew  line ", "▁ sym ▁x", "a\U0010fffdb ▁\U0010ffff"]
LIBRARY = Tokenizer.from_file(WORD_BPE)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    got = WordBpe(WORD_BPE).encode_batch(TEXTS)
    assert [x.tolist() for x in got] == [library(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcXYZ éÉß.,'!?-_ \n\t ́½1日<|>"), max_size=40), min_size=1, max_size=5))
def test_encoder_equals_library_on_odd_texts(texts):
    assert [x.tolist() for x in WordBpe.load(WORD_BPE).encode_batch(texts)] == [library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    sequence = EliasFano.from_bytes(memoryview(EliasFano.encode(np.array(values, dtype=np.uint64)).to_bytes()))
    assert [sequence.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1500, 20_000))
    assert len(EliasFano.encode(ends).to_bytes()) < 20_000 * (2 + math.log2(750) + 1.5) / 8


def rows_of_texts():
    rng = random.Random(2)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (-5, "negative"), (2**40, "far"), (3, "tie B"), (3, "tie a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [1, 50, 1 << 18])
def test_token_files_round_trip(spark, tmp_path, monkeypatch, segment):
    rows = rows_of_texts()
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, start string")
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, WORD_BPE, end_id=1)
    got = token_files.read_token_files(spark, path, with_ids=True).collect()
    place, expected = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library(text), 1]
        expected.append((key, place, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        place += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    keys = [3, 2**40, -5, 999]
    found = token_files.read_token_files(spark, path, with_ids=True, keys=keys).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == [r for r in expected if r[0] in keys]
    assert token_files.read_token_files(spark, path, keys=[]).collect() == []


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", WORD_BPE, end_id=1)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").collect() == []


def test_segment_selects_one_document():
    ids = [np.array([5, 6, 1]), np.array([1]), np.array([7, 1])]
    segment = token_files.Segment(token_files.segment_bytes([None, 4, 900], ids, 2))
    assert [segment.document(i).tolist() for i in range(3)] == [x.tolist() for x in ids] and [segment.key(i) for i in range(3)] == [None, 4, 900]


def test_range_parts_are_in_order(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "key")
    bounds = range_bounds(df, "key", 13)
    rows = df.select("key", range_part(df["key"], bounds).alias("part")).orderBy("key").collect()
    assert [r["part"] for r in rows] == [sum(b <= r["key"] for b in bounds) for r in rows] and len(bounds) == 12


@pytest.mark.parametrize("key", [None, 17])
def test_rows_of_one_key_are_dealt_on_in_order(spark, tmp_path, key):
    rng = random.Random(3)
    rows = [(key, f"{rng.random()} text é {k}") for k in range(19_000)] + [(key, None), (key, ""), (key, "same")] + [(key, "same")] * 3 + [(k, f"other {k}") for k in range(-500, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    part, hot = ordered_parts(docs, "doc_id", "text", 16)
    found = docs.select("*", part.alias("part")).collect()
    in_order = sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    assert [r["part"] for r in in_order] == sorted(r["part"] for r in found) and hot == [key]
    assert max(Counter(r["part"] for r in found).values()) < 20_000 / 16 * 2.5
    path = f"file://{tmp_path}/hot"
    token_files.write_token_files(docs, path, WORD_BPE, end_id=1)
    got = sorted(token_files.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in in_order]
    assert [r["ids"] for r in got[::97]] == [[*library(r["text"]), 1] for r in in_order[::97]]


def test_packing_is_whole_and_gapless(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_PARTITION", 20)
    rng = random.Random(4)
    rows = rows_of_texts() + [(100 + k, " ".join(rng.choice(["cat", "dog", "tree"]) for _ in range(rng.randrange(1, 60)))) for k in range(150)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD_BPE, end_id=0, capacity=64).collect()
    expected, total = Counter(), 0
    for key, text in rows:
        ids = np.array([*library(text), 0], dtype="<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 64)):
            expected[key, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    lengths = np.array([r["length"] for r in got])
    bound = packing.lower_bound(np.bincount(lengths, minlength=65), 64)
    assert bound <= len(by_sequence) <= bound + 2


def packed_lengths(spark, lengths, capacity):
    rows = [(k, 0, 0, n, k) for k, n in enumerate(lengths)]
    return packing.pack(spark.createDataFrame(rows, packing.PIECE_SCHEMA), capacity)


@pytest.mark.parametrize("seed", range(3))
def test_partitions_with_gaps_exchange_until_certified(spark, monkeypatch, seed):
    monkeypatch.setattr(packing, "PIECES_A_PARTITION", 8)
    rng = random.Random(seed)
    lengths = [rng.choice([13, 17, 24, 26, 31, 34, 41, 50]) for _ in range(300)]
    rounds = []
    packed = packing._packed
    monkeypatch.setattr(packing, "_packed", lambda pieces, n, capacity, number, *larger: rounds.append((number, n)) or packed(pieces, n, capacity, number, *larger))
    out = packed_lengths(spark, lengths, 100)
    sequences, bound = packing.certificate(out, 100)
    (_, first), *later = rounds
    alone = packing._bins(packed(spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], packing.PIECE_SCHEMA), first, 100, 0))
    assert later and bound <= sequences < alone and sorted(r["length"] for r in out.collect()) == sorted(lengths)
    fills = Counter()
    for r in out.collect():
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 100 and all(r["fill"] == fills[r["sequence_id"]] for r in out.collect())


def test_certified_partitions_are_closed(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_PARTITION", 10)
    out = packed_lengths(spark, [50] * 40, 100)
    assert packing.certificate(out, 100) == (20, 20)
    assert all(r["partition_bins"] == r["partition_bound"] for r in out.collect())


def test_ids_of_many_rounds_differ(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_PARTITION", 4)
    ids = []
    for number in (0, 1, 63, 64, 65, 127, 128, packing.MOST_ROUNDS):
        rows = packing._packed(spark.createDataFrame([(k, 0, 0, 40 + k % 9, k) for k in range(40)], packing.PIECE_SCHEMA), 40, 100, number)
        ids.append({r["sequence_id"] for r in rows.collect()})
    assert all(min(i) >= 0 for i in ids) and len(set.union(*ids)) == sum(map(len, ids))


def test_more_than_64_rounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_PARTITION", 6)
    monkeypatch.setattr(packing, "PATIENCE", 100)
    packed, numbers = packing._packed, []
    monkeypatch.setattr(packing, "_packed", lambda pieces, n, capacity, number, larger=1: numbers.append(number) or packed(pieces, n, capacity, number, 1))
    monkeypatch.setattr(packing, "lower_bound", lambda counts, capacity, bound=packing.lower_bound: bound(counts, capacity) - 1)  # never met
    rng = random.Random(6)
    lengths = [rng.choice([34, 35, 51, 67]) for _ in range(40)]
    out = packing.pack(spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], packing.PIECE_SCHEMA), 100, rounds=70)
    rows = out.collect()
    fills = Counter()
    for r in rows:
        fills[r["sequence_id"]] += r["length"]
    sequences, bound = packing.certificate(out, 100)
    assert max(numbers) == 70 and sorted(r["length"] for r in rows) == sorted(lengths) and max(fills.values()) <= 100
    assert {r["gap"] for r in rows} == {sequences - bound}
    with pytest.raises(ValueError):
        packing.pack(out, 100, rounds=packing.MOST_ROUNDS + 1)


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORD_BPE).collect() == []


def test_lower_bound_never_exceeds_the_optimum():
    rng = random.Random(9)

    def optimum(sizes, capacity):
        best = len(sizes)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= capacity:
                    place(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        return best

    for _ in range(60):
        sizes = sorted((rng.randrange(1, 31) for _ in range(8)), reverse=True)
        assert packing.lower_bound(np.bincount(sizes, minlength=31), 30) <= optimum(sizes, 30) <= packing.best_fit_decreasing(np.array(sizes), 30)[0].max() + 1
    assert packing.lower_bound(np.bincount([11] * 10, minlength=21), 20) == 10


def test_pieces_decode_to_every_text():
    sampler = piece_sampling.PieceSampler.load(PIECES, 1.0)
    for seed in range(3):
        got = sampler.encode_batch(list(range(len(TEXTS))), TEXTS, seed)
        assert [sampler.decode(x.tolist()) for x in got] == [t or "" for t in TEXTS]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab the▁ \n\té日🎉\x00"), max_size=60), min_size=1, max_size=6))
def test_pieces_decode_to_odd_texts(texts):
    sampler = piece_sampling.PieceSampler.load(PIECES, 1.0)
    assert [sampler.decode(x.tolist()) for x in sampler.encode_batch(list(range(len(texts))), texts, 5)] == texts


def segmentations(sampler, unit):
    paths = [{(): 0.0}] + [{} for _ in unit]
    for j in range(1, len(unit) + 1):
        for i in range(j):
            if unit[i:j] in sampler.pieces:
                number, weight = sampler.pieces[unit[i:j]]
                for path, log in paths[i].items():
                    paths[j][(*path, number)] = log + weight
    total = sum(map(math.exp, paths[-1].values()))
    return {path: math.exp(log) / total for path, log in paths[-1].items()}


@pytest.mark.parametrize("theta", [1.0, 0.3])
def test_pieces_have_the_lattice_distribution(theta):
    sampler = piece_sampling.PieceSampler.load(PIECES, theta)
    expected = segmentations(sampler, "▁thane")
    n = 40_000
    got = Counter(tuple(x.tolist()) for x in sampler.encode_batch(list(range(n)), ["thane"] * n, 3))
    assert set(got) <= set(expected)
    assert all(abs(got[p] / n - q) < 0.01 for p, q in expected.items())


def test_pieces_depend_on_key_and_seed_alone(spark, monkeypatch):
    sampler = piece_sampling.PieceSampler.load(PIECES, 1.0)
    texts = ["some words in a row, again and again", "other words"] * 20
    keys = list(range(40))
    first = [x.tolist() for x in sampler.encode_batch(keys, texts, 1)]
    monkeypatch.setattr(piece_sampling, "KEPT_UNITS", 3)
    fresh = piece_sampling.PieceSampler(PIECES, 1.0)
    again = [fresh.encode_batch([k], [t], 1)[0].tolist() for k, t in zip(keys, texts)]
    assert first == again
    assert first != [x.tolist() for x in sampler.encode_batch(keys, texts, 2)]
    # Nor on what a worker has filtered before: shares are equal to the last bit.
    alone, after = piece_sampling.Lattices(), piece_sampling.Lattices()
    sampler.filter(alone, [" words", " in"])
    sampler.filter(after, [f" other{i}" for i in range(500)] + [" words", " in"])
    own, low = alone.cumulative, (1 << piece_sampling.SHARE_BITS) - 1
    tail = after.cumulative[-len(own):]
    assert ((own & np.uint64(low)) == (tail & np.uint64(low))).all() and (alone.flat == after.flat[-len(alone.flat):]).all()
    rows = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").repartition(3)
    spread = {r["doc_id"]: r["ids"] for r in piece_sampling.sampled_pieces(rows, PIECES, 1, 1.0).collect()}
    assert [spread[k] for k in keys] == first


def test_round_trips_and_decoder(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(None, "null id", 2)], "doc_id long, text string, lossless int")
    assert all(r["lossless"] for r in piece_sampling.round_trips(docs, PIECES, 1, 1.0).collect())
    back = {r["doc_id"]: r["text"] for r in piece_sampling.decoded_texts(piece_sampling.sampled_pieces(docs, PIECES, 1, 1.0), PIECES).collect()}
    assert back == {**{k: t or "" for k, t in enumerate(TEXTS)}, None: "null id"}
