"""Collocations against a brute-force version, on small and awkward inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxspark.llm import collocations

DOCS = "doc_id bigint, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, covered, most):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    counts[lang][tuple(words[at : at + size])] += 1
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = "a b c New york city of THE É é \x7f \x7fé é\xa0x 𝛼 中 中文".split(" ")
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und"])))
    rows += [(1, None, "en"), (1, None, None), (None, "", "de"), (None, ".,;", "de"), (7, "one", "nl"), (8, "new york city " * 4000, "en"), (9, "hot pair " * 9, "xx"), (10, "a b " * 20, "two\nlines")]
    return rows + [rows[3]] * 15


@pytest.mark.parametrize("longest, least, covered, most", [(3, 10, 50, 2000), (3, 2, 50, 7), (2, 3, 50, 2000), (4, 3, 80, 2000), (3, 1, 0, 2000)])
def test_collocations(spark, rows, longest, least, covered, most):
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("n", "words", "phrase", "_salt", "_fact", "w1", "short", "rank"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = collocations.collocations(docs, longest, least, covered, most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, longest, least, covered, most)


def test_words_outside_the_book(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "BOOK_WORDS", 4)
    got = collocations.collocations(spark.createDataFrame(rows, DOCS), 3, 2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 2, 50, 2000)


def test_codes_read_back():
    words = [w.encode() for w in ["the", "é", "中", "\x7f", "x"] + [f"w{i}" for i in range(57_000)]]
    book = collocations.Book(words)
    other = [w.encode() for w in ["\x7fa", "ü", "û", "𝛼", "word", "Ā", collocations.character(56_000), "文字"]]
    sent = [book[w] for w in words + other]
    assert len(set(sent)) == len(sent) and [book.read(s) for s in sent] == words + other and all(s.decode() for s in sent)


def test_nothing_to_find(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "en")], DOCS)).collect() == []


def test_products_beyond_64_bits(spark, monkeypatch, tmp_path):
    """A score from counts whose product has 20 digits."""
    big = 4_000_000_000
    rows = [("en", ["x", "y"], big - 1), ("en", ["x"], big), ("en", ["y"], big + 1), ("en", [], 3 * big)]
    counts = spark.createDataFrame(rows, "lang string, words array<string>, n bigint")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counts)
    assert [tuple(r) for r in collocations.collocations(spark.createDataFrame([], DOCS)).collect()] == [
        ("en", 1, "x y", big - 1, big, big + 1, 3 * big, 1_000_000 * (big - 1) ** 2 // (big * (big + 1)))
    ]


def test_windows_that_begin_alike_go_out_together():
    keys = [b"", b"a", b"b a", b"abcdefgh x", b"abcdefgz", "é a b".encode(), b"a b", b"abc", b"abcdefgh y"]
    order = np.argsort(collocations.beginnings(pa.array(keys, pa.binary())), kind="stable")
    assert [keys[k][:8] for k in order] == sorted(k[:8] for k in keys)
    assert len(collocations.beginnings(pa.array([], pa.binary()))) == 0
    part = pa.array([b"zz", *keys], pa.binary()).slice(1)
    assert (collocations.beginnings(part) == collocations.beginnings(pa.array(keys, pa.binary()))).all()
