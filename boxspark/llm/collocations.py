"""Phrase collocation mining by top-order marginalisation.

A word is read once. Every place of a piece starts one window of the longest length: its words stand in *lead columns*, the
piece's words shifted by 0, 1, 2 and padded with empty words, so no word is shuffled to find its successors and shorter phrases
are not exploded on their own. Only the padded windows are counted; ``GROUP BY lang, ROLLUP`` sums their prefixes, which are
all shorter phrases, down to the words and each language's total.

Windows are shuffled once, by all words but the last, so a prefix's windows meet and only prefixes that are rare or dealt to
several parts are summed by a second, small shuffle. Words of a code book, frequent ones, travel as one character each, and
prefixes of very frequent words alone are dealt to several parts by their last word. Book and very frequent words come from a
bounded sample of all rows; they decide how many bytes travel, and where to, and nothing else.

Parts of a frequent phrase are frequent themselves, so only rows of ``least`` occurrences or more leave the counting,
and a phrase's parts are looked up among them.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxspark.llm.common import slices, stage, with_facts

#: What ends a piece, and what stands between words, as the contract names them.
ENDS = ".,;:!?\x0a\x0b\x0c\x0d"
#: One pass over a text's bytes: A-Z in lower case, every end a newline, tabs as spaces.
PLAIN = bytes.maketrans((string.ascii_uppercase + ENDS + "\t").encode(), (string.ascii_lowercase + "\n" * len(ENDS) + " ").encode())
WIDE = "decimal(38,0)"
#: The sample that the code book is made of, and what stands before a word that looks like a code or begins with the mark.
BOOK_TEXTS, BOOK_CHARACTERS, BOOK_WORDS, MARK = 2_000, 5_000, 60_000, b"\x7f"
#: A word of this share of the sample is very frequent; parts that a prefix of such words is dealt to.
HOT_SHARE, HOT_PARTS = 0.001, 64
#: Different windows that a task holds before it puts out their counts.
HELD = 1_000_000


def tokens(text: bytes, pads: int) -> list[bytes]:
    """The words of a text, with ``pads`` newlines behind every piece."""
    return [*filter(None, (text.translate(PLAIN) + b"\n").replace(b"\n", b" \n" * pads + b" ").split(b" "))]


def character(i: int) -> str:
    """The i-th code: one character from U+0080 on, of two bytes for the first 1,920, without the surrogates."""
    return chr(i + 0x80 if i < 0xD800 - 0x80 else i + 0x880)


class Book(dict):
    """Words to the bytes that travel for them: a code for words of the book, else the word, marked where it could be mistaken."""

    def __init__(self, words: list[bytes], hot: int = 0, remember: int = 500_000):
        super().__init__()
        self.coded = {w: character(i).encode() for i, w in enumerate(words)}
        self.words, self.remember = {code: w for w, code in self.coded.items()}, remember
        self.hot = character(min(hot, 1_920))  # the first code that is not of a very frequent word
        self[b"\n"] = b""  # a place behind a piece

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.remember:
            self.clear()
            self[b"\n"] = b""
        found = self.coded.get(word)
        if found is None:
            alone = word[0] >= 0x80 and len(word.decode(errors="replace")) == 1
            found = MARK + word if alone or word.startswith(MARK) else word
        self[word] = found
        return found

    def read(self, travelled: bytes) -> bytes:
        return self.words.get(travelled) or travelled.removeprefix(MARK)


def code_book(texts: DataFrame) -> Book:
    """Made of the first BOOK_CHARACTERS characters of about BOOK_TEXTS texts from all over the table."""
    share = min(1.0, BOOK_TEXTS / max(1, texts.count()))
    sample = texts.select(F.substring("_text", 1, BOOK_CHARACTERS).alias("text")).sample(share, 7).limit(2 * BOOK_TEXTS).collect()
    counts = Counter(w for r in sample for w in tokens(r["text"].encode(), 0))
    words, least = counts.most_common(BOOK_WORDS), HOT_SHARE * counts.total()
    return Book([w for w, _ in words], sum(n >= least for _, n in words))


def beginnings(keys: pa.Array) -> np.ndarray:
    """The first eight bytes of each key as one number, in the order of bytes: sorted by it, windows that begin alike go out one
    after the other, and the shuffle's compression spares what they share."""
    _, offsets, data = keys.buffers()
    starts = np.frombuffer(offsets, np.int32)[keys.offset : keys.offset + len(keys) + 1]
    bytes_ = np.concatenate([np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    first = np.lib.stride_tricks.sliding_window_view(bytes_, 8)[starts[:-1]]
    first = np.where(np.arange(8) < np.diff(starts)[:, None], first, 0).astype(np.uint8)
    return first.view(">u8").ravel().astype(np.uint64)


def windows(texts: DataFrame, longest: int, book: Book) -> DataFrame:
    """_prefix, _last, n: different windows of ``texts`` (_text, _lang) and how often a part of a task's texts has each.
    _prefix holds the words but the last, the part that the window is dealt to, and the language, a newline between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                keys, n = pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())
                order = pa.array(np.argsort(beginnings(keys)))
                for at in range(0, len(order), 50_000):
                    some = order[at : at + 50_000]
                    columns = keys.take(some).view(pa.string()), pa.repeat(pa.scalar(lang, pa.string()), len(some)), n.take(some)
                    yield pa.RecordBatch.from_arrays(list(columns), ["_window", "_lang", "n"])
            found.clear()

        for part, sent in slices(batches, "_bytes", 1_000_000):
            for lang, text in zip(part.column("_lang").to_pylist(), sent):
                leads = [*map(book.__getitem__, tokens(text, longest - 1))]
                at = compress(zip(*(islice(leads, k, None) for k in range(longest))), leads)  # none starts behind a piece
                found[lang].update(map(b" ".join, at))
            if sum(map(len, found.values())) > HELD:
                yield from out()
        yield from out()

    found = texts.select("_lang", F.col("_text").cast("binary").alias("_bytes")).mapInArrow(run, "_window string, _lang string, n bigint")
    prefix, last = F.substring_index("_window", " ", longest - 1), F.substring_index("_window", " ", -1)
    # Codes are one character each, the most frequent words' first: a prefix of such words alone is short and low.
    low = [F.ascii(F.substring("_prefix", 2 * k + 1, 1)).between(0x80, ord(book.hot) - 1) for k in range(longest - 1)]
    hot = reduce(Column.__and__, low, F.length("_prefix") == 2 * longest - 3)
    dealt = F.when(hot, F.pmod(F.xxhash64("_last"), F.lit(HOT_PARTS)).cast("string")).otherwise(F.lit(""))
    found = found.select(prefix.alias("_prefix"), last.alias("_last"), "_lang", "n")
    return found.select(F.concat("_prefix", F.lit("\n"), dealt, F.lit("\n"), "_lang").alias("_prefix"), "_last", "n")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, words (array), n: all phrases of 1 to ``longest`` words with ``least`` occurrences or more, and each language's
    number of words as the row with no words."""
    names = [f"w{k}" for k in range(1, longest)]
    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), F.col(text_col).alias("_text"))
    book = code_book(texts)
    dealt = windows(texts, longest, book).repartition("_prefix")
    # Both parts read this one shuffle: neither filters nor drops a column before it, so its two uses are the same plan.
    held = F.split("_prefix", "\n", 3)
    top = dealt.groupBy("_prefix", "_last").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = top.select(held[2].alias("lang"), F.concat(F.split(held[0], " "), F.array("_last")).alias("words"), "n")
    # A prefix that is whole here and rare is of no use itself, only its words are; its last column becomes null.
    sums = dealt.groupBy("_prefix").agg(F.sum("n").alias("n"), F.count("_last").alias("_windows")).where("_windows > 0").select(held[2].alias("lang"), F.split(held[0], " ").alias("_w"), (held[1] != "").alias("_part"), "n")
    kept = F.col("_part") | (F.col("n") >= least)
    counted = sums.select("lang", *(F.when(kept if k == longest - 2 else F.lit(True), F.get("_w", F.lit(k))).alias(names[k]) for k in range(longest - 1)), "n")
    prefixes = docs.sparkSession.sql(
        f"SELECT lang, array({', '.join(names)}) AS words, sum(n) AS n, grouping_id() AS short FROM {{counted}} GROUP BY lang, ROLLUP ({', '.join(names)}) HAVING sum(n) >= {int(least)}",
        counted=counted,
    )
    # grouping_id() has a bit for each summed column, the last ones first.
    prefixes = prefixes.select("lang", F.expr(f"slice(words, 1, {longest - 1} - bit_count(short))").alias("words"), "n")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[w if w is None else book.read(w.encode()).decode(errors="replace") for w in ws] for ws in batch.column("words").to_pylist()]
            whole = pa.array([None not in ws and "" not in ws for ws in words], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(words, pa.list_(pa.string())), batch.column("n")], ["lang", "words", "n"]).filter(whole)

    return top.unionByName(prefixes).mapInArrow(read, "lang string, words array<string>, n bigint")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, covered_percent: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases of 2 to ``longest`` words.

    A phrase of a occurrences is cut where floor(1,000,000 a^2 / (l r)) is least, l and r being the occurrences of the
    two parts; equal cuts: the first. Products are decimals of 38 digits, which raise rather than wrap. Phrases that
    stand in a longer candidate with at least ``covered_percent`` percent of their occurrences are left out. Order:
    score, then a, both falling, then the phrase's bytes.

    Null texts and texts without words add nothing; a null language is ``und`` and joins rows that name it so; repeated
    rows count as often as they come; ids are not read; an empty table gives no row. Texts are read whole. A language
    that holds a third of all rows is counted by phrase and ranked in two steps; lookups of frequent parts, which many
    phrases share, are answered by a broadcast of at most 1,000 rows (``with_facts``).
    """
    counts = stage(phrase_counts(docs, longest, least, text_col, lang_col), "collocation-counts").withColumn("phrase", F.array_join("words", " "))
    candidates = counts.where(F.size("words") >= 2).select("lang", "words", "phrase", F.col("n").alias("a"))

    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right")
    )
    # A part of n occurrences is asked for by at most n / least candidates at each cut.
    facts = counts.where(F.size("words") >= 1).select("lang", "phrase", "n")
    total = counts.where(F.size("words") == 0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    for side in ("left", "right"):
        known = facts.select("lang", F.col("phrase").alias(side), "n")
        cuts = with_facts(cuts, known, ["lang", side], "n", longest * total, F.xxhash64("phrase")).withColumn(f"n_{side}", F.col("_fact.n")).drop("_fact")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    squared = (F.lit(1_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)")).cast(WIDE)
    cuts = cuts.withColumn("product", (wide("n_left") * wide("n_right")).cast(WIDE)).withColumn("top", squared)
    best = F.min(F.struct(F.expr("top div product").alias("score"), "k", F.col("n_left").alias("l"), F.col("n_right").alias("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    inner = [part(F.lit(at), F.lit(size)) for size in range(2, longest) for at in range(1, longest - size + 2)]
    sizes = [size for size in range(2, longest) for _ in range(1, longest - size + 2)]
    starts = [at for size in range(2, longest) for at in range(1, longest - size + 2)]
    if inner:
        inside = F.array(*(F.when(F.lit(at + size - 1) <= F.size("words"), p) for p, at, size in zip(inner, starts, sizes)))
        longer = candidates.where(F.size("words") > 2).select("lang", "words", "a", F.explode(inside).alias("phrase"))
        longer = longer.where("phrase IS NOT NULL AND phrase <> array_join(words, ' ')").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
        scored = scored.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < covered_percent * F.col("a"))).drop("_longer")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))))
    near = scored.withColumn("_salt", salt).withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_nth") <= most)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    totals = counts.where(F.size("words") == 0).select("lang", "n")
    return ranked.drop("_salt", "_nth").join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
