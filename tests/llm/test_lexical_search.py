"""Ranked search against a brute-force version, on small and awkward inputs."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxspark.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, most=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c, _ in held if c), sum(k for *_, k in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, k in held:
            if c:
                m = 10 + 90 * k * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
                if score > 0:
                    found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["The", "THE", "é", "É", "naïve", "x_y", "a-b", "中文", " ", "𝛼"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(500 + i, docs[5][1] or "w1") for i in range(30)] + [(None, docs[5][1]), (None, None), (None, "w3 w4"), (7, "w3 w4"), (7, "w3 w4"), (900, ""), (901, "!?"), (902, "w5 w6\x00w7 " * 3000), (903, None)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(25)] + [(99, None), (98, ""), (97, "nowhere"), (None, "w3 w4"), (3, "w3 w4"), (96, "w3 " * 2000)]
    return docs, items


@pytest.mark.parametrize("most, width, batch_terms", [(10, 2048, 20_000), (10, 1, 20_000), (3, 16, 60), (1000, 64, 20_000)])
def test_search(spark, tables, most, width, batch_terms):
    docs, items = tables
    d = spark.createDataFrame(docs, DOCS).repartition(5).withColumn("_id", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("_text", F.lit("w1")).withColumn("rank", F.lit(1))
    q = spark.createDataFrame(items, ITEMS).withColumn("cost", F.lit(0)).withColumn("_item", F.lit("clash")).withColumn("_batch", F.lit(7)).withColumn("before", F.lit(2))
    got = lexical_search.search(d, q, most, width, batch_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, most)


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(t, s) for t, s in zip(tables, (DOCS, ITEMS)))
    assert lexical_search.search(docs.limit(0), items).collect() == [] and lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(docs.where("text IS NULL"), items).collect() == []


def test_bounds_and_stopping(tables):
    """No bound is below a score, and documents whose bound is below the tenth best score are never scored."""
    docs, items = tables
    counts = [c for _, t in docs if (c := lexical_search.term_counts((t or "").encode()))]
    n, total = len(counts), sum(c.total() for c in counts)
    known = lexical_search.Statistics(n, total, Counter(t for c in counts for t in c))
    queries = [(k, list(lexical_search.term_counts((t or "").encode()))) for k, (_, t) in enumerate(items)]
    for width in (4, 512):
        task = lexical_search.Search(queries, known, 3, width)
        factors = [known.length_factor(c.total()) for c in counts]
        bounds = lexical_search.sketches(counts, factors, task.coordinates)[:, task.used] @ task.lookup
        for q, (_, ts) in enumerate(queries):
            for d, (c, m) in enumerate(zip(counts, factors)):
                assert bounds[d, q] >= sum(known.weights[t] * lexical_search.impact(c[t], m) for t in ts if t in c)
    task.feed(list(range(len(docs))), [(t or "").encode() for _, t in docs])
    assert task.scored < len(counts) * len(queries) / 2


def test_long_texts_are_split_at_spaces():
    text = ("ab1 " * 50 + "é" * 30 + ",").encode() * 20
    whole = lexical_search.term_counts(text)
    assert sum((Counter(t) for t in lexical_search.terms(text, 17)), Counter()) == whole == Counter({b"ab1": 1000, "é".encode() * 30: 20})
