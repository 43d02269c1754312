"""N-best segmentation: against the library, on long texts without spaces, and on empty tables."""

import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxspark.llm import sentencepiece_nbest

tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(tokenizers.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_share_of_words_that_the_library_cuts_alike(spark):
    """The library merges greedily and the lattice is searched for its best path, so words of several pieces can
    differ: of the test documents, whose words are invented, five words in six are the same (0.833)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    words = Counter(w for t in texts for w in t.split())
    same = sum(k for w, k in words.items() if next(sentencepiece_nbest.model(PATH).encode([w], 1))[0].tolist() == sp.encode(w))
    assert same >= 0.82 * words.total()
    for text in ("Hello world this", "The weather is nice today.", "one\ntwo  three"):
        assert next(sentencepiece_nbest.model(PATH).encode([text], 1))[0].tolist() == sp.encode(text)


def test_walking_one_segment_equals_walking_many():
    rng, m = random.Random(1), sentencepiece_nbest.model(PATH)
    segments = ["▁" + "".join(rng.choice("abcdeéth一\U0001F600ions") for _ in range(rng.randint(1, 100))) for _ in range(300)] + ["▁" + "a" * 60, "▁▁▁▁", "\n"]
    together, alone = m._together(segments), m._one_by_one(segments)
    assert all(np.array_equal(a, b) for a, b in zip(together, alone))
    starts = np.cumsum(together[1]) - together[1]
    for k, segment in enumerate(segments):
        paths = m.segment_paths(segment, 4)
        assert paths[0] == (together[2][k], tuple(together[0][starts[k] : starts[k] + together[1][k]]))
        assert len(paths) < 2 or paths[0][0] - paths[1][0] == together[3][k]
        assert len({p for _, p in paths}) == len(paths) and [s for s, _ in paths] == sorted((s for s, _ in paths), reverse=True)


def test_a_long_lattice_has_the_paths_of_a_kept_one(monkeypatch):
    rng, m = random.Random(3), sentencepiece_nbest.Model(PATH)
    segments = ["".join(rng.choice("thenatio") for _ in range(90)) for _ in range(20)]
    kept = [m.segment_paths(s, 5) for s in segments]
    monkeypatch.setattr(sentencepiece_nbest, "LONG", 10)
    assert [m.segment_paths(s, 5) for s in segments] == kept


@pytest.mark.parametrize("text", ["".join(random.Random(2).choice("ABCDEFGHabcdefgh0123+/") for _ in range(100_000)), "a" * 100_000, "漢字" * 20_000])
def test_long_texts_without_spaces(text):
    m, began = sentencepiece_nbest.Model(PATH), time.process_time()
    (ids, paths), = m.encode([text], 4)
    assert time.process_time() - began < 60  # in proportion to the length: a second or two
    assert m.decode(ids.tolist()) == text and len(paths) <= 4
    for _, changes in paths:
        assert m.decode(sentencepiece_nbest.changed(ids, changes).tolist()) == text


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text"), (1, "some text"), (None, None)], "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("_text", F.lit(3))
    assert sorted((r.n_pieces, r.n_paths, r.round_trip) for r in sentencepiece_nbest.digests(df, PATH).collect()) == [(0, 1, True), (2, 4, True), (2, 4, True)]
    for empty in (sentencepiece_nbest.encode(df.limit(0), PATH), sentencepiece_nbest.digests(df.limit(0), PATH)):
        assert empty.count() == 0
