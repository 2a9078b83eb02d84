"""The fill-in-middle transformation against a plain regular expression."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from trailgraph.llm import fill_middle as fim

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def plain_cut(text, key, fim_percent=100, spm_percent=50):
    text = text or ""
    units = LINE.findall(text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(seed=1, n=300):
    rng = random.Random(seed)
    parts = ["a", "\n", "\n\n", "é", "日本", "🙂", "\r\n", "<", "<P", ">", "S>", " ", "word ", " ", "\x85"]
    made = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 5, 40]))) for _ in range(n)]
    return [None, "", "\n", "\n\n\n", "one", "one\n", "\none", "x<P>y", "<S>", "a<M>\nb", "<<P\n<S\n<M", "<P", *made, "line of text\n" * 20_000, "é" * 50_000, "\n" * 9_999]


@pytest.mark.parametrize("seed", range(3))
def test_a_cut_is_what_the_expression_says(seed):
    for key, text in enumerate(texts(seed)):
        cut = fim.transform(text, str(key))
        assert (cut.n, cut.form, cut.prefix_chars, cut.middle_chars, cut.output.decode()) == plain_cut(text, key)


def test_ranked_bits_are_found_by_halving():
    rng = random.Random(5)
    for width in (1, 2, 3, 64, 65, 1000):
        places = sorted(rng.sample(range(width), rng.randint(1, width)))
        mask = sum(1 << p for p in places)
        assert [fim.select(mask, width, k) for k in range(len(places))] == places


def test_shares_of_forms():
    forms = [fim.transform("a\nb\n", str(k), fim_percent=60, spm_percent=25).form for k in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.4) < 0.03 and abs(forms.count("spm") / 4000 - 0.15) < 0.03


def test_rows_and_round_trip(spark):
    rows = [(k if k != 3 else None, t) for k, t in enumerate(texts())] + [(7, "again\nand again"), (7, "again\nand again")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, output string, n int")
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out))) == sorted(map(repr, ((k, *plain_cut(t, k), t or "") for k, t in rows)))


def test_an_empty_table_gives_no_row(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
