"""The token store: its word mapping against the library, and what damage its readers notice."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from boxspark.llm import token_store

tokenizers = pytest.importorskip("public_tokenizers")
PARTS = list("abcXYZ019'’,.;:!?-_()<>|=&#*@\"\\/~^`éÉßÿñ×÷ÀÖØçà µªº²½—…中文字 \t\n ̸́̀İıſK‍ẛ😀٣")
PARTS += ["'s", "'re", "'LL", "<|endoftext|>", "<|STARTOFTEXT|>", "don't", " ", " ", " ", " the "]


def test_random_texts_have_the_ids_of_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    by = token_store.WordTokenizer(str(tokenizers.path("word_bpe_49k.json")), remember=5_000)
    assert by.plain
    for at in range(0, len(texts), 500):
        ids, ends = by.encode(texts[at : at + 500], 2)
        start = 0
        for t, end in zip(texts[at : at + 500], ends.tolist()):
            assert ids[start:end].tolist() == by.whole(t) + [2], t
            start = end


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    rng = random.Random(1)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 900)))) for i in range(40)] + [(None, None), (3, "twice"), (3, "twice"), (77, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit(1)).withColumn("start", F.lit("x")).withColumn("block", F.lit(0))
    token_store.write_store(docs, str(tokenizers.path("word_bpe_49k.json")), path)
    return path, rows, docs


def _copy(path, tmp_path):
    import shutil

    return shutil.copytree(path, tmp_path / "copy")


def test_clashing_columns_nulls_and_repeats(spark, store):
    path, rows, _ = store
    got = sorted((tuple(r)[:3] for r in token_store.read_summaries(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0] == (None, 0, 1)


def test_empty_table(spark, store, tmp_path):
    token_store.write_store(store[2].limit(0), str(tokenizers.path("word_bpe_49k.json")), str(tmp_path / "s"))
    assert token_store.read_summaries(spark, str(tmp_path / "s")).count() == token_store.read_documents(spark, str(tmp_path / "s")).count() == 0


def test_a_lost_recipe_file_is_noticed(spark, store, tmp_path):
    copy = _copy(store[0], tmp_path)
    max((copy / "recipes").glob("*.parquet"), key=lambda p: pq.read_metadata(p).num_rows).unlink()
    for read in (token_store.read_summaries, token_store.read_documents):
        with pytest.raises(ValueError, match="manifest"):
            read(spark, str(copy))


def test_an_altered_chunk_is_noticed(spark, store, tmp_path):
    copy = _copy(store[0], tmp_path)
    file = max((copy / "chunks").glob("*.parquet"), key=lambda p: pq.read_metadata(p).num_rows)
    table = pq.read_table(file)
    ids = table.column("ids").to_pylist()
    ids[0] = bytes([ids[0][0] ^ 1]) + ids[0][1:]
    pq.write_table(table.set_column(1, "ids", pa.array(ids, pa.binary())), file)
    for crc in copy.rglob(".*.crc"):
        crc.unlink()
    for read in (token_store.read_summaries, token_store.read_documents):
        with pytest.raises(Exception, match="damaged|rebuilt"):
            read(spark, str(copy)).collect()
