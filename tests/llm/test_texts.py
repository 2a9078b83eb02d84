"""Personal data, fingerprints, languages, toxicity, quotation: against brute force, or held-out accuracy."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailgraph.llm import common, langid, order_minhash, pii, quotation, toxicity
from trailgraph.llm.words import chunk_groups

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def brute_spans(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@.-+%1234567890 ()é\n"), max_size=80))
def test_plain_spans_equal_the_patterns(text):
    assert pii.plain_spans(text) == brute_spans(text)


DISGUISED = [
    ("mail me: john (at) example [dot] com or jane at corp dot example dot org!", [("email", "john (at) example [dot] com"), ("email", "jane at corp dot example dot org")]),
    ("call plus one five five five one two three four five six seven ok", [("phone", "plus one five five five one two three four five six seven")]),
    ("jоhn@exаmple.com and ４１１１ 1111 1111 1111", [("email", "jоhn@exаmple.com"), ("card", "４１１１ 1111 1111 1111")]),
    ("at one two seven dot zero dot zero dot one now", [("ip", "one two seven dot zero dot zero dot one")]),
    ("vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", [("card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins")]),
    ("a​nn@ex​ample.org", [("email", "a​nn@ex​ample.org")]),
    ("meet at noon, dot the i", []), ("one two three, at least", []), ("él vio dos o tres", []), ("", []), (None, []),
]


@pytest.mark.parametrize("text,expected", DISGUISED)
def test_disguised_spans_in_source_places(text, expected):
    ((plain, added),) = pii.find_all([text])
    assert [(k, text[a:b]) for k, a, b in pii.ordered(added)] == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("a1@. ()-dotａо​+"), max_size=60))
def test_added_spans_keep_the_plain_ones(text):
    ((plain, added),) = pii.find_all([text])
    assert plain == brute_spans(text)
    for kind, a, b in added:
        assert 0 <= a < b <= len(text) and all(e <= a or b <= s for _, s, e in plain)


@pytest.mark.parametrize("text,expected", [
    ("write to jane at corp.example.org today", [("email", "jane at corp.example.org")]),
    ("call +1 four one five 555 2671 now", [("phone", "+1 four one five 555 2671")]),
    ("call +1 four,one,five,five,five,five 2671", [("phone", "+1 four,one,five,five,five,five 2671")]),
    ("call +1 (four one five) 555 2671", [("phone", "+1 (four one five) 555 2671")]),
    ("host seven.0.0.1 is up", [("ip", "seven.0.0.1")]),
])
def test_single_disguises_are_found(text, expected):
    ((plain, added),) = pii.find_all([text])
    assert plain == [] and [(k, text[a:b]) for k, a, b in added] == expected


@pytest.mark.parametrize("text", [
    "look at this.example and go", "we meet at noon.we go then", "version seven.1.2.3 is out", "see section four.2.1.3 please", "he was at home.it was late", "a polka dot dress, dot the i",
    "sat at table nine.5 and left", "good at chess.no doubt", "stare at a dot on the wall", "at nine.30 at night", "one dot here, two dot there", "Release: one.2.3.4", "arrive at one dot five, at best",
    "they laugh at un.deux and go", "point at it.is it", "he aimed at the dot. com was late", "at six, seven, eight and nine",
])
def test_prose_is_no_disguise(text):
    plain, added, wider = pii.find_each([text])[0]
    assert (added, wider) == ([], [])


@pytest.mark.parametrize("text,expected", [
    ("mail bob at example dot it or so", "bob at example dot it"), ("bob at mail dot example dot com.", "bob at mail dot example dot com"), ("x at y.z.org", "x at y.z.org"),
    ("ann at host.co dot uk", "ann at host.co dot uk"), ("kim (at) noon.we", "kim (at) noon.we"), ("kim at noon (dot) we", None), ("10 dot 0 dot 0 dot 1", "10 dot 0 dot 0 dot 1"),
])
def test_words_before_a_host_are_signs(text, expected):
    plain, added, wider = pii.find_each([text])[0]
    assert [text[a:b] for _, a, b in added + wider] == ([expected] if expected else [])


def test_long_chains_of_dots_cost_one_pass():
    began = time.perf_counter()
    pii.find_each(["a at " + "a dot " * 200_000 + "b", "a dot " * 200_000 + "com", "at a." * 200_000])
    assert time.perf_counter() - began < 30


def test_wider_disguised_spans_stand_beside_plain_ones(spark):
    text = "to jоhn@example.com or ann@example.org dot uk, +1 415 555 2671 and"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = pii.personal_spans(docs).collect()
    spans = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in row["spans"].split(","))]
    assert sorted(spans) == sorted([("email", "jоhn@example.com"), ("email", "hn@example.com"), ("email", "ann@example.org dot uk"), ("email", "ann@example.org"), ("phone", "+1 415 555 2671")])
    assert row["base_sha256"] == hashlib.sha256(pii.joined(pii.plain_spans(text)).encode()).hexdigest()
    assert pii.redact(docs).first()["text"] == "to [EMAIL] or [EMAIL], [PHONE] and"


def test_personal_spans_and_redaction(spark):
    rows = [(1, "x a@b.co +1 (555) 123-4567 é 10.0.0.1", "s", 9), (None, None, None, None), (2, "", "t", 0), (3, "4111 1111 1111 1111 " + "w " * 30_000, "u", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    got = {r["doc_id"]: r for r in pii.personal_spans(docs).collect()}
    for key, text, *_ in rows:
        expected = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(text or ""))
        assert got[key]["spans"] == expected and got[key]["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest()
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 0, 1)
    clean = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert clean[1]["text"] == "x [EMAIL] [PHONE] é [IP]" and clean[1]["n_chars"] == len(clean[1]["text"]) and clean[1]["spans"] == "s"
    assert clean[None]["text"] is None and clean[3]["text"].startswith("[CARD] w")
    assert pii.personal_spans(docs.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("12. a"), max_size=60))
def test_ip_spans_equal_the_pattern(text):
    assert [s for s in pii.plain_spans(text) if s[0] == "ip"] == [s for s in brute_spans(text) if s[0] == "ip"]


@pytest.mark.parametrize("text", ["7" * 1_000_000, "1." * 500_000, "1 " * 500_000, "+" * 500_000 + "1" * 500_000, "a@" * 500_000, "a." * 500_000, "one " * 100_000, "x at " * 100_000, " " * 1_000_000, "(at" * 300_000])
def test_long_runs_cost_one_pass(text):
    began = time.perf_counter()
    pii.find_each([text])
    assert time.perf_counter() - began < 10


# -- fingerprints


def test_edited_texts_and_neighbours(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "délta", "epsilon", "日本", "zeta", "eta"]
    rows = [(k * 3 - 20, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 300)))) for k in range(40)] + [(None, "the null key"), (500, None), (501, ""), (502, "ab"), (503, "tie B"), (503, "tie A"), (504, "long " * 40_000)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_chars int")
    got = sorted((tuple("" if x is None else x for x in r) for r in order_minhash.fingerprints(docs).collect()), key=str)
    expected = []
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        marks = [order_minhash.fingerprint(t) for t in (text, edited, after)]
        hexes = [m.astype(">u2").tobytes().hex() for m in marks]
        expected.append(("" if key is None else key, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexes[0], hexes[1], order_minhash.likeness(marks[0], marks[1]), order_minhash.likeness(marks[0], marks[2])))
    assert got == sorted(expected, key=str)


@pytest.mark.parametrize("key", [None, 17])
def test_neighbours_among_rows_of_one_key(spark, key):
    rng = random.Random(8)
    rows = [(key, f"{rng.random()} é") for _ in range(3000)] + [(key, None), (key, ""), (key, "same"), (key, "same")] + [(k, f"other {k}") for k in range(-150, 150)]
    order = [(k, t or "") for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))]
    got = order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    expected = []
    for (k, text), (_, after) in zip(order, order[1:] + order[:1]):
        q = len(text) // 4
        expected.append((str(k), len(text), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected)


def test_lone_document_and_none(spark):
    (row,) = order_minhash.fingerprints(spark.createDataFrame([(1, "just one text here")], "doc_id long, text string")).collect()
    assert row["near_next"] == 1.0
    assert order_minhash.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


M = (1 << 64) - 1


def plain_mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M
    return h ^ h >> 31


def plain_order_minhash(text):
    """Order MinHash in plain Python: 8-mers numbered by occurrence, the two least of each of 64 slots, in text order."""
    if not text:
        return [0] * 64
    codes = [ord(c) * 0x9E3779B97F4A7C15 & M for c in text]
    if len(codes) < 8:
        kmers = [plain_mix(sum(c * (0xC2B2AE3D27D4EB4F * (i + 1) & M) for i, c in enumerate(codes)) + len(codes) & M)]
    else:
        h = codes
        for step in (1, 2, 4):
            h = [h[i] * 0x2545F4914F6CDD1D + (h[i + step] ^ h[i + step] >> 29) & M for i in range(len(h) - step)]
        kmers = [plain_mix(x) for x in h]
    seen, slots = {}, {}
    for place, k in enumerate(kmers):
        seen[k] = seen.get(k, -1) + 1
        element = plain_mix(k + seen[k] * 0xD1342543DE82EF95 & M)
        slots.setdefault(element >> 58, []).append((element, place))
    out = []
    for slot in range(64):
        away = next(a for a in range(64) if (slot + a) % 64 in slots)
        least = sorted(slots[(slot + away) % 64])[:2]
        value = 0
        for j, (element, _) in enumerate([*sorted(least, key=lambda x: x[1]), (0, None)][:2] if len(least) < 2 else sorted(least, key=lambda x: x[1])):
            value = plain_mix(value * 0x9E3779B97F4A7C15 + element + j + 1 & M)
        out.append(plain_mix(value + away * 0xA0761D6478BD642F & M) >> 48)
    return out


def test_fingerprints_equal_plain_python():
    rng = random.Random(7)
    texts = ["", "a", "ab", "é日🎉", "sevenxx", "exactly8", "abcabcabcabcabcabcabc", "a" * 500, "the cat and the cat and the cat sat"]
    texts += ["".join(rng.choice("abcdé 日\n") for _ in range(rng.randrange(1, n))) for n in (20, 60, 200, 900, 5000) for _ in range(6)]
    for text in texts:
        assert order_minhash.fingerprint(text).tolist() == plain_order_minhash(text), text[:40]


def test_long_texts_pass_over_large_hashes_without_a_difference(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    short = order_minhash.fingerprint(text)
    monkeypatch.setattr(order_minhash, "AIMED", 10**9)
    assert (short == order_minhash.fingerprint(text)).all()


def test_likeness_sees_edits_and_order():
    rng = random.Random(1)
    parts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150)) for _ in range(4)]
    text = " ".join(parts)
    mark = order_minhash.fingerprint(text)
    edited = order_minhash.likeness(mark, order_minhash.fingerprint(text.replace("a", "q", 20)))
    swapped = order_minhash.likeness(mark, order_minhash.fingerprint(" ".join(parts[::-1])))
    other = order_minhash.likeness(mark, order_minhash.fingerprint("".join(rng.choice("klmnop ") for _ in range(4000))))
    assert edited > 0.8 and other < 0.2 and swapped < 0.9 and order_minhash.likeness(mark, mark) == 1.0


# -- languages


def language_rows(n=240):
    rng = random.Random(5)
    alphabets = {"aa": ["the", "and", "thing", "with"], "bb": ["der", "und", "schön", "nicht"], "cc": ["que", "los", "niño", "para"]}
    return [(k, " ".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(3, 40))), lang) for k, lang in enumerate(rng.choice(list(alphabets)) for _ in range(n))]


def test_languages_held_out_accuracy(spark):
    rows = language_rows() + [(1000, None, "aa"), (1001, "123 ²½ ...", "bb"), (1002, "", "cc"), (1003, "niño para", None), (None, "und nicht", "bb"), (1004, "the thing " * 150_000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(docs, 200)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert model.languages == ["aa", "bb", "cc"] and len(got) == len(rows)
    for key, text, lang in rows:
        held = key is None or zlib.crc32(str(key).encode()) % 5 == 0
        assert got[key]["held_out"] == held and 0 <= got[key]["score"] <= 1
    scored = [got[k]["lang_pred"] == lang for k, _, lang in rows[:240] if got[k]["held_out"]]
    assert sum(scored) >= 0.97 * len(scored) > 0
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1004]["lang_pred"] == "aa"


def test_languages_are_not_learnt_from_held_out_rows(spark):
    docs = spark.createDataFrame([(k, t, lang if zlib.crc32(str(k).encode()) % 5 else "zz") for k, t, lang in language_rows()], "doc_id long, text string, lang string")
    assert "zz" not in langid.fit(docs, 200).languages


def test_languages_with_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    (row,) = langid.identify(docs, langid.fit(docs, 10)).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)


def test_document_frequencies_and_slices(spark, monkeypatch):
    texts = ["abcabc", "bcd", None, ""]
    got = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    expected = np.zeros(langid.BUCKETS, dtype=int)
    for t in texts:
        expected[list({b for g in langid.grams(t or "") for b in g.tolist()})] += 1
    assert (got == expected).all()
    whole = np.sort(np.concatenate(list(langid.grams("hello wörld again"))))
    monkeypatch.setattr(langid, "SLICE", 4)
    assert (np.sort(np.concatenate(list(langid.grams("hello wörld again")))) == whole).all()


def brute_ftrl(rows, classes, epochs, seed):
    """Per coordinate and in plain Python, from the update rule as published."""
    a, beta, l1, l2 = langid.ALPHA, langid.BETA, langid.L1, langid.L2
    z, n = {}, {}

    def weight(i, c):
        zi, ni, penalty = z.get((i, c), 0.0), n.get((i, c), 0.0), 0.0 if i == "bias" else l1
        return 0.0 if abs(zi) <= penalty else -(zi - math.copysign(penalty, zi)) / ((beta + math.sqrt(ni)) / a + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, buckets, values = rows[k]
            features = [*zip(buckets.tolist(), values.tolist()), ("bias", 1.0)]
            now = {(i, c): weight(i, c) for i, _ in features for c in range(classes)}
            logits = [sum(now[i, c] * x for i, x in features) for c in range(classes)]
            total = sum(math.exp(v - max(logits)) for v in logits)
            for c in range(classes):
                error = math.exp(logits[c] - max(logits)) / total - (c == y)
                for i, x in features:
                    g, before = error * x, n.get((i, c), 0.0)
                    sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / a
                    z[i, c] = z.get((i, c), 0.0) + g - sigma * now[i, c]
                    n[i, c] = before + g * g
    return weight


def test_ftrl_equals_the_plain_rule():
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(3)), np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(25)]
    known, w, bias = langid.fit_ftrl(rows, 3, epochs=2, seed=5)
    weight = brute_ftrl(rows, 3, 2, 5)
    assert known.tolist() == sorted({b for _, x, _ in rows for b in x.tolist()})
    assert np.allclose(w, [[weight(b, c) for c in range(3)] for b in known.tolist()]) and np.allclose(bias, [weight("bias", c) for c in range(3)])
    assert (w == 0).any() and (w != 0).any()


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(4)
    logits = rng.normal(size=(300, 4)) * 5
    labels = np.array([rng.choice(4, p=np.exp(x / 2.5) / np.exp(x / 2.5).sum()) for x in logits])

    def loss(t):
        return -np.mean([x[y] / t - math.log(sum(math.exp(v / t) for v in x)) for x, y in zip(logits, labels)])

    got = langid.fit_temperature(logits, labels)
    assert loss(got) <= min(loss(t) for t in np.linspace(0.5, 6, 400)) + 1e-6


def test_every_language_is_learnt(spark):
    rng = random.Random(8)
    letters = [chr(0x4E00 + 40 * k) for k in range(90)]
    rows = [(i, " ".join("".join(chr(ord(letters[i % 90]) + rng.randrange(30)) for _ in range(4)) for _ in range(12)), f"l{i % 90:02d}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, 20)
    got = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in langid.identify(docs, model).collect()}
    right = [got[k][0] == lang for k, _, lang in rows if got[k][1]]
    assert len(model.languages) == 90 and sum(right) >= 0.95 * len(right)
    # The sums don't depend on how they are taken.
    g = np.concatenate([x for _, t, _ in rows[:300] for x in langid.grams(t)])
    assert len(g) > langid.BLOCK and np.allclose(model.sums(g), model.weights[model.rows[g]].sum(axis=0, dtype=np.float64))


# -- toxicity


def brute_segments(scores):
    """All maximal segments by definition: the best one, then those of the rests."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = best[3], best[4]
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-9, 9).map(lambda x: x + 0.0), max_size=14))
def test_maximal_segments(scores):
    got = toxicity.maximal_segments(np.array(scores, dtype=float))
    for a, b, s in got:
        assert s == pytest.approx(sum(scores[a:b])) and s > 0
    assert [s for *_, s in got] == pytest.approx([sum(scores[a:b]) for a, b in brute_segments(scores)])
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 14))
def test_maximal_segments_one_by_one(seed, n):
    scores = np.random.default_rng(seed).normal(-0.3, 1, n).tolist()  # without ties, the segments are the same ones
    assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(scores))] == brute_segments(scores)


def test_log_odds_equal_the_plain_formula():
    n1, n0 = [0, 3, 9, 40, 1, 200], [5, 0, 9, 2, 1, 1000]
    all1, all0 = 900, 4000
    got = toxicity.log_odds(np.array(n1), np.array(n0), all1, all0, 1.5)
    for x, y, w in zip(n1, n0, got):
        prior = toxicity.PRIOR_TOTAL * (x + y) / (all1 + all0) + toxicity.PRIOR_EACH
        odds = math.log((x + prior) / (all1 + toxicity.PRIOR_TOTAL - x - prior)) - math.log((y + prior) / (all0 + toxicity.PRIOR_TOTAL - y - prior))
        error = 1.5 * math.sqrt(1 / (x + prior) + 1 / (y + prior))
        assert w == pytest.approx(0 if x + y < toxicity.MIN_TEXTS or abs(odds) <= error else odds - math.copysign(error, odds))
    assert (got > 0).any() and (got == 0).any() and toxicity.log_odds(np.array([1]), np.array([1]), 0, 5, 1.0).tolist() == [0.0]


def test_lambda_solves_its_equation():
    scores, shares = np.array([-0.1, 1.4, -2.0]), np.array([0.9, 0.02, 0.08])
    rate = toxicity._root(scores, shares)
    assert rate > 0.01 and sum(p * math.exp(rate * s) for p, s in zip(shares, scores)) == pytest.approx(1)


def test_the_curve_has_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.exponential(1.5, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(3 - 2 * x))).astype(float)
    weight = np.where(y == 1, 1.0, 2.0)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a + b * x)))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.005 * (a * a + b * b)

    a, b = toxicity._logistic(x, y, weight)
    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-9 for d in (-0.05, 0, 0.05) for e in (-0.05, 0, 0.05))


def test_copies_of_a_toxic_text_do_not_make_its_words_telling(spark):
    docs, labels = toxic_rows()
    rng = random.Random(2)
    odd = [f"strange{i}" for i in range(80)]
    copies = [(5000 + k, " ".join([*odd[:40], "idiot", "scum", *odd[40:], f"end{k}"])) for k in range(60)]
    clean = [(6000 + k, " ".join(rng.sample(odd, 12) + ["word1"] * 30)) for k in range(20)]
    model = toxicity.fit(spark.createDataFrame(docs + copies, "doc_id long, text string"), spark.createDataFrame(labels + [(k, 1) for k, _ in copies], "doc_id long, toxic int"), 2000)
    got = toxicity.score(spark.createDataFrame(copies + clean, "doc_id long, text string"), model).collect()
    assert all(r["predicted"] == (r["doc_id"] < 6000) for r in got)


def test_stems_are_first_bytes():
    (group,) = chunk_groups(["Worthless wort é"], marks_apart=True, prefixes=(4, 5))
    (four,), (five,) = (next(chunk_groups([t], marks_apart=True, prefixes=(4, 5))).prefixes[k] for t, k in (("worth", 0), ("worthy", 1)))
    assert group.prefixes[0].tolist() == [four, 0, 0] and group.prefixes[1].tolist() == [five, 0, 0]
    assert four != group.hashes[1]


def toxic_rows(n=600):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(120)]
    bad = ["idiot", "scum", "trash"]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = int(rng.random() < 0.25)
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(bad)
        docs.append((k, " ".join(text)))
        labels.append((k, toxic))
    return docs, labels


def test_toxicity_held_out_accuracy(spark):
    docs, labels = toxic_rows()
    extra = [(9000, None), (9001, ""), (9002, "idiot! scum, word1"), (None, "word1 word2"), (9003, "word5 " * 60_000)]
    table = spark.createDataFrame([(*r, 1.0) for r in docs + extra], "doc_id long, text string, score double")
    model = toxicity.fit(table, spark.createDataFrame([*labels, (3, None), (7777, 1)], "doc_id long, toxic int"), 400)
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    truth = dict(labels)
    held = [k for k in truth if got[k]["held_out"]]
    assert all((zlib.crc32(str(k).encode()) % 3 == 1) == got[k]["held_out"] for k in truth)
    assert sum(got[k]["predicted"] == truth[k] for k in held) >= 0.97 * len(held)
    assert got[9002]["predicted"] == 1 and [got[k]["predicted"] for k in (9000, 9001, 9003)] == [0, 0, 0]
    (first, *_) = got[9002]["segments"]
    assert "idiot! scum, word1"[first["start"] : first["end"]].startswith("idiot")
    kept = toxicity.drop_toxic(table, model)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["predicted"] == 0}


def test_passages_of_words_seen_before_are_segments(spark):
    bad = ["idiot", "scum", "trash"]
    rest = [f"word{i}" for i in range(300)]
    hashes = np.sort(next(toxicity.token_groups([" ".join(bad)])).hashes)
    model = toxicity.ToxicityModel(hashes, np.full(3, 3.0), scale=0.05)
    twice = " ".join([*rest, *bad, *rest, *bad, *rest])
    apart = " ".join([*rest, bad[0], *rest, bad[1], *rest, bad[2], *rest, *bad, *rest])
    got = {r["doc_id"]: r["segments"] for r in toxicity.score(spark.createDataFrame([(1, twice), (2, apart)], "doc_id long, text string"), model).collect()}
    assert [twice[s["start"] : s["end"]] for s in got[1]] == [" ".join(bad)] * 2
    assert got[1][0]["score"] == pytest.approx(got[1][1]["score"])
    assert [apart[s["start"] : s["end"]] for s in got[2]] == [" ".join(bad)]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "any text")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), 10)
    (row,) = toxicity.score(docs, model).collect()
    assert (row["score"], row["predicted"]) == (0.0, 0)


# -- quotation


def test_quotes_are_linked_and_ordered(spark):
    rows = [
        (1, 0, "u", "Hello there\n\nSecond para."), (1, 1, "a", "reply one"), (1, 2, "u", "On x, Bob wrote:\n> hello   THERE\n>> deep\nmy answer"), (1, 3, "a", None),
        (2, 0, "u", "> Second para.\nok"), (2, 1, "u", "> nowhere\n\n> ok\nfine"), (None, 1, "u", "zz"), (1, 1, "a", "reply one"), (3, 5, None, "> quotes itself\nquotes itself"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotation.reply_order(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, reply_to int")).collect()}
    assert [got[1, k]["reply_to"] for k in range(4)] == [None, 0, 0, 2]
    assert [got[1, k]["branch"] for k in range(4)] == [0, 0, 1, 1]
    assert got[1, 2]["own_text"] == ">> deep\nmy answer" and (got[1, 2]["n_quotes"], got[1, 2]["n_linked"]) == (2, 1)
    assert (got[2, 0]["source_conv"], got[2, 0]["source_turn"]) == (1, 0)
    assert (got[2, 1]["n_quotes"], got[2, 1]["n_linked"], got[2, 1]["reply_to"]) == (2, 1, 0)
    assert got[None, 1]["n_quotes"] == 0 and got[3, 5]["n_linked"] == 0
    assert quotation.reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("block", [2, 1024])
@pytest.mark.parametrize("apart", [1, 10**12])
def test_branches_equal_a_loop(spark, monkeypatch, block, apart):
    monkeypatch.setattr(quotation, "BLOCK_TURNS", block)
    monkeypatch.setattr(quotation, "MOST_BLOCKS", 5)
    rng = random.Random(block)
    rows = []
    for conv in range(6):
        for t in sorted(rng.sample(range(-3, 40), 14 if conv else 2)):
            quote = f"> message {apart * rng.randrange(-3, t + 2)}\n" if rng.random() < 0.4 else ""
            rows.append((conv, apart * t, "u", f"{quote}message {apart * t}"))
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["branch"], r["place"]) for r in quotation.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    expected = {}
    for conv in range(6):
        before, branch, place, seen = None, 0, 0, set()
        for _, turn, _, said in sorted(r for r in rows if r[0] == conv):
            quoted = re.match(r"> message (-?\d+)\n", said)
            quoted = int(quoted[1]) if quoted and int(quoted[1]) in seen else None
            if quoted is not None and quoted != before:
                branch, place = branch + 1, 0
            place += 1
            expected[conv, turn] = (before if quoted is None else quoted, branch, place)
            before = turn
            seen.add(turn)
    assert got == expected


def test_quotes_of_a_passage_that_the_own_conversation_has_only_later(spark):
    rows = [(1, 0, "> shared words"), (1, 1, "shared words"), (2, 3, "shared words"), (2, 4, "shared words"), (3, 0, "shared words"), (4, 0, "> shared words"), (5, 0, "> mine alone\n\nmine alone")]
    docs = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], r["source_conv"], r["source_turn"]) for r in quotation.reply_order(docs).collect()}
    assert (got[1, 0], got[4, 0], got[5, 0]) == ((1, 1, 2, 3), (1, 1, 1, 1), (1, 0, None, None))


QUOTING = "run this:\n>>> print(1)\n1\n\n\nthanks"


def test_quotes_of_nothing_known_stay_as_written(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    rows = [(1, 0, "the words"), (1, 1, QUOTING), (1, 2, "A B wrote:\n\n> the words\n>\n> never said\n\nmine\r\n"), (1, 3, "Z wrote:\n> gone\n"), (1, 4, " \n\t\n"), (2, 0, "hm\n>\n> THE  words"), (2, 1, None), (2, 2, "> the words"), (2, 2, "> the words\nagain")]
    docs = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["turn"], r["own_text"]) for r in quotation.reply_order(docs).collect())
    assert got == [(1, 0, "the words"), (1, 1, QUOTING), (1, 2, "> never said\n\nmine"), (1, 3, "Z wrote:\n> gone\n"), (1, 4, " \n\t\n"), (2, 0, "hm"), (2, 1, ""), (2, 2, ""), (2, 2, "again")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab>: \n\r\tw"), max_size=60))
def test_parts_are_the_whole_message(text):
    assert "".join(raw for p in quotation.parts(text) for raw in p.raw) == text


def test_quote_levels():
    assert quotation.line_level("> > a >b") == (2, "a >b") and quotation.line_level("plain") == (0, "plain")
    assert quotation.passages("a\nb\n\n> q\n>> r\nZ wrote:\n> s") == [(0, "a\nb"), (1, "q"), (2, "r"), (1, "s")]
    assert quotation.passages(None) == [] and quotation.passages("") == []
