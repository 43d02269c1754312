"""Toxicity by a linear-chain conditional random field over tokens.

States are clean (0) and toxic (1). A token's features are its letters and its first letters; their weights and the
transitions are learned by gradient ascent on the labelled tokens' likelihood. Forward-backward gives each token the
probability of being toxic; a document's score is a logistic function of these marginals, and runs of tokens above
one half are its offending spans.

Labels are of documents, so tokens are labelled by what the training documents say: in a toxic document a token is
toxic when one of its features stands in toxic documents far more often than in clean ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxspark.llm.common import in_held_out_fold, slices, stage

TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings that are features beside the whole token.
STEMS = (4, 5, 6)
_U = np.uint64


@dataclass
class Crf:
    """features: hashes, sorted; weights: how much each adds to the toxic state; transitions[from, to]; start;
    link: intercept and slopes of the score over (log expected toxic tokens, their share, largest marginal)."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    link: np.ndarray


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def feature_hashes(words: list[str]) -> np.ndarray:
    """(words, 1 + len(STEMS)) hashes of the lower-case word and its beginnings; 0 where the word is no longer."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros((n, 1 + len(STEMS)), np.uint64)
    h, at = np.zeros(n, np.uint64), np.arange(n)
    with np.errstate(over="ignore"):
        for k in range(1, int(lengths.max(initial=0)) + 1):
            at = at[lengths[at] >= k]
            h[at] = (h[at] + codes[starts[at] + k - 1] + _U(1)) * _U(0x9E3779B97F4A7C15)
            h[at] ^= h[at] >> _U(29)
            if k in STEMS:
                out[at, 1 + STEMS.index(k)] = h[at] * _U(0xBF58476D1CE4E5B9) + _U(k)
        out[:, 0] = h * _U(0x94D049BB133111EB) | _U(1)
    return out


def document_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows of all tokens, end of each text's tokens), each different word hashed once."""
    found = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    index: dict[str, int] = {}
    which = np.fromiter((index.setdefault(w, len(index)) for ws in found for w in ws), np.int64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    return (feature_hashes(list(index))[which] if len(which) else np.zeros((0, 1 + len(STEMS)), np.uint64)), ends


def emissions(crf: Crf, rows: np.ndarray) -> np.ndarray:
    """Log odds of the toxic state that each token's own features give."""
    if not len(crf.features):
        return np.full(len(rows), crf.bias)
    at = np.minimum(np.searchsorted(crf.features, rows), len(crf.features) - 1)
    return crf.bias + np.where(crf.features[at] == rows, crf.weights[at], 0.0).sum(axis=1)


def _scan(odds: np.ndarray, first: np.ndarray, transitions: np.ndarray, width: int = 64) -> np.ndarray:
    """Forward messages as log odds of state 1: over chains put end to end, ``first`` marking where one begins.

    A step maps odds r to e * (t01 + t11 r) / (t00 + t10 r). Such maps are 2 x 2 matrices, so blocks of ``width``
    steps are multiplied for all blocks at once, block results are carried on, and the blocks are run again."""
    t = np.exp(transitions)
    n = len(odds)
    blocks = -(-n // width)
    e = np.ones(blocks * width)
    e[:n] = np.exp(np.clip(odds, -30, 30))
    start = np.zeros(blocks * width, bool)
    start[:n] = first
    e, start = e.reshape(blocks, width), start.reshape(blocks, width)
    # Matrix of a step acting on (weight of 0, weight of 1); a first token forgets what came before.
    m = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for k in range(width):
        a, b = m[:, 0, :], m[:, 1, :]
        zero = np.where(start[:, k, None], 1.0, t[0, 0]) * a + np.where(start[:, k, None], 1.0, t[1, 0]) * b
        one = e[:, k, None] * (np.where(start[:, k, None], 1.0, t[0, 1]) * a + np.where(start[:, k, None], 1.0, t[1, 1]) * b)
        scale = np.maximum(np.maximum(zero, one).max(axis=1), 1e-300)[:, None]
        m[:, 0, :], m[:, 1, :] = zero / scale, one / scale
    carried = np.empty((blocks, 2))
    v = np.array([1.0, 0.0])
    for k in range(blocks):
        carried[k] = v
        v = m[k] @ v
        v /= max(v.sum(), 1e-300)
    out = np.empty((blocks, width))
    a, b = carried[:, 0].copy(), carried[:, 1].copy()
    for k in range(width):
        s = start[:, k]
        total = a + b
        zero = np.where(s, total, t[0, 0] * a + t[1, 0] * b)
        one = e[:, k] * np.where(s, total, t[0, 1] * a + t[1, 1] * b)
        scale = np.maximum(zero + one, 1e-300)
        a, b = zero / scale, one / scale
        out[:, k] = np.log(np.maximum(b, 1e-300)) - np.log(np.maximum(a, 1e-300))
    return out.reshape(-1)[:n]


def marginals(crf: Crf, odds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of every token, by forward-backward over all documents of a slice."""
    n = len(odds)
    if not n:
        return np.zeros(0)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    sizes = np.diff(ends, prepend=0)
    first[(ends - sizes)[sizes > 0]] = True
    last[ends[sizes > 0] - 1] = True
    forward = _scan(odds, first, crf.transitions)
    backward = _scan(odds[::-1], last[::-1], crf.transitions.T)[::-1]  # holds the token's own odds too
    both = forward + backward - np.clip(odds, -30, 30)
    return 1 / (1 + np.exp(-np.clip(both, -60, 60)))


def summaries(p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(documents, 3): log of 1 + expected toxic tokens, their share, the largest marginal; zeros without tokens."""
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(ends), 3))
    some = np.flatnonzero(sizes > 0)
    if len(some):
        starts = (ends - sizes)[some]
        total = np.add.reduceat(p, starts)
        out[some] = np.column_stack([np.log1p(total), total / sizes[some], np.maximum.reduceat(p, starts)])
    return out


def _document_counts(rows: DataFrame, only: np.ndarray | None) -> DataFrame:
    """(feature, documents): in how many rows of ``_text`` a feature stands, of those in ``only`` where it is given."""
    wanted = rows.sparkSession.sparkContext.broadcast(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value
        for _, texts in slices(batches, "_text"):
            hashes, ends = document_features(texts)
            doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0) * hashes.shape[1])
            flat = hashes.reshape(-1)
            keep = flat != 0
            if only is not None:
                at = np.minimum(np.searchsorted(only, flat), max(len(only) - 1, 0))
                keep &= only[at] == flat if len(only) else False
            flat, doc = flat[keep], doc[keep]
            order = np.lexsort((doc, flat))
            flat, doc = flat[order], doc[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
            seen, n = np.unique(flat[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n, pa.int64())], ["feature", "documents"])

    return rows.select("_text").mapInArrow(count, "feature bigint, documents bigint").groupBy("feature").agg(F.sum("documents").alias("documents"))


def _lexicon(sample: DataFrame, least_documents: int, least_share: float) -> np.ndarray:
    """Hashes of the features that mark toxic documents of the sample: in enough of them, in few clean ones, and far
    from chance. Clean documents are counted only for features that stand in enough toxic ones."""
    n = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return np.zeros(0, np.uint64)
    # Of the features of toxic documents only those travel that would be far from chance without any clean document.
    share, both = F.col("documents") / n[1], F.col("documents") / (n[1] + n[0])
    far = share / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * (1 / n[1] + 1 / n[0])) >= 4.0
    found = _document_counts(sample.where("_label = 1"), None).where((F.col("documents") >= least_documents) & far).toArrow()
    features, toxic = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(features)
    features, toxic, clean = features[order], toxic[order], np.zeros(len(features))
    found = _document_counts(sample.where("_label = 0"), features).toArrow()
    clean[np.searchsorted(features, found.column(0).to_numpy().view(np.uint64))] = found.column(1).to_numpy()
    # The sample's labels are not as frequent as the corpus's; rates within each label are.
    share, rate = toxic / n[1], clean / n[0]
    both = (toxic + clean) / (n[1] + n[0])
    z = (share - rate) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[1] + 1 / n[0]))
    return features[(share >= least_share * (share + 10 * rate)) & (z >= 4.0)]


def _fit(sample: list[tuple[str, int]], lexicon: np.ndarray, rounds: int = 30, l2: float = 1e-4) -> Crf:
    """Maximise the likelihood of the labelled tokens of the sample by Adam steps, then fit the score's logistic link."""
    crf = Crf(lexicon, np.zeros(len(lexicon)), -4.0, np.log(np.array([[0.95, 0.05], [0.6, 0.4]])), np.zeros(4))
    labels = np.array([y for _, y in sample], float)
    if not len(sample) or not len(lexicon) or labels.min() == labels.max():
        base = labels.mean() if len(sample) else 0.0
        crf.link[0] = float(np.log((base + 1e-3) / (1 - base + 1e-3)))
        return crf
    rows, ends = document_features([t for t, _ in sample])
    at = np.minimum(np.searchsorted(lexicon, rows), len(lexicon) - 1)
    hit = lexicon[at] == rows
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), sizes)
    y = hit.any(axis=1) & (labels[doc] > 0)
    first = np.zeros(len(y), bool)
    first[(ends - sizes)[sizes > 0]] = True
    follows = np.flatnonzero(~first)
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[follows - 1].astype(int), y[follows].astype(int)), 1.0)
    state = np.concatenate([crf.weights, [crf.bias], crf.transitions.ravel()])
    m, v, k = np.zeros_like(state), np.zeros_like(state), len(lexicon)
    for step in range(1, rounds + 1):
        crf.weights, crf.bias, crf.transitions = state[:k], float(state[k]), state[k + 1 :].reshape(2, 2)
        odds = emissions(crf, rows)
        first_odds = odds.copy()
        last = np.zeros(len(y), bool)
        last[ends[sizes > 0] - 1] = True
        forward = _scan(first_odds, first, crf.transitions)
        backward = _scan(odds[::-1], last[::-1], crf.transitions.T)[::-1]
        p = 1 / (1 + np.exp(-np.clip(forward + backward - np.clip(odds, -30, 30), -60, 60)))
        # Pair marginals of neighbours, from forward odds, transition and backward odds.
        f = 1 / (1 + np.exp(-forward[follows - 1]))
        b = np.exp(np.clip(backward[follows], -60, 60))
        joint = np.stack([(1 - f) * np.exp(crf.transitions[0, 0]), (1 - f) * np.exp(crf.transitions[0, 1]) * b, f * np.exp(crf.transitions[1, 0]), f * np.exp(crf.transitions[1, 1]) * b])
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        residual = y - p
        gradient = np.concatenate([
            np.bincount(at[hit], np.repeat(residual, hit.sum(axis=1)), minlength=k), [residual.sum()], (gold - expected).ravel(),
        ]) / len(sample) - l2 * state
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        state = state + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    crf.weights, crf.bias, crf.transitions = state[:k], float(state[k]), state[k + 1 :].reshape(2, 2)
    x = np.column_stack([np.ones(len(ends)), summaries(marginals(crf, emissions(crf, rows), ends), ends)])
    link = np.zeros(4)
    for _ in range(30):  # Newton steps of a penalised logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ link, -30, 30)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(4)
        link = link + np.linalg.solve(hessian, x.T @ (labels - q) - 1e-2 * link)
    crf.link = link
    return crf


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None,
    toxic_rows: int = 8_000, clean_rows: int = 24_000, fit_rows: int = 2_000, fit_chars: int = 4_000_000, least_documents: int = 4, least_share: float = 0.5,
) -> Crf:
    """Learn from a bounded sample of the labelled rows that ``learn`` admits (by default those outside the held-out
    fold): the first ``toxic_rows`` and ``clean_rows`` ids by a hash, whole texts. Feature counts are over all of the
    sample; the CRF's weights are fitted on its first ``fit_rows`` of either label, at most ``fit_chars`` characters in
    all. Null labels and ids teach nothing; several labels of an id count as toxic if one is; ids whose hashes tie come
    in their own order.
    """
    known = labels.select(F.col(id_col).alias("_labelled"), F.col(label_col).cast("int").alias("_label")).where("_label IS NOT NULL AND _labelled IS NOT NULL")
    known = known.groupBy("_labelled").agg(F.max("_label").alias("_label"))
    known = known.where(~in_held_out_fold("_labelled") if learn is None else learn).withColumn("_o", F.xxhash64("_labelled"))
    ids = [known.where(F.col("_label") == k).orderBy("_o", "_labelled").limit(n) for k, n in ((1, toxic_rows), (0, clean_rows))]
    ids = stage(ids[0].unionByName(ids[1]), "toxicity-sample")  # at most toxic_rows + clean_rows rows, so it may be sent
    sample = stage(
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(ids), F.col("_id") == F.col("_labelled")).select("_text", "_label", "_o"), "toxicity-labelled"
    )
    lexicon = _lexicon(sample, least_documents, least_share)
    chosen, used = [], 0
    for label in (1, 0):
        some = sample.where(F.col("_label") == label).select("_o", F.length("_text").alias("_n")).orderBy("_o", "_n").limit(fit_rows)
        for r in some.collect():  # at most fit_rows rows, without their texts
            if used + r["_n"] <= fit_chars * (2 - label) // 2:
                used += r["_n"]
                chosen.append((r["_o"], label, r["_n"]))
    wanted = sample.sparkSession.createDataFrame(chosen, "_o bigint, _label int, _n int").distinct()
    texts = sample.withColumn("_n", F.length("_text")).join(F.broadcast(wanted), ["_o", "_label", "_n"], "left_semi").select("_o", "_label", "_text")
    rows = sorted((-r["_label"], r["_o"], r["_text"]) for r in texts.limit(2 * fit_rows).collect())  # at most fit_chars characters, but for ids that repeat
    return _fit([(text, -label) for label, _, text in rows], lexicon)


def score(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id, score (0 to 1), spans (array of start, end in code points of runs of tokens whose
    toxic marginal is above one half). A null or empty text, or one without letters, has the score of no toxic token
    and no span. Whole texts count; repeated rows each get a row; other columns are not read."""
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for part, texts in slices(batches, "_text"):
            hashes, ends = document_features(texts)
            p = marginals(crf, emissions(crf, hashes), ends)
            x = np.column_stack([np.ones(len(ends)), summaries(p, ends)])
            scores = 1 / (1 + np.exp(-np.clip(x @ crf.link, -30, 30)))
            toxic, spans = np.flatnonzero(p > 0.5), [[] for _ in texts]
            owners = np.searchsorted(ends, toxic, side="right")
            for d in np.unique(owners).tolist():
                # Lower-casing can change lengths: offsets are taken from the text itself where counts agree.
                places = tokens(texts[d]) if len(tokens(texts[d])) == ends[d] - (ends[d - 1] if d else 0) else tokens(texts[d].lower())
                own = toxic[owners == d] - (ends[d - 1] if d else 0)
                runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
                spans[d] = [{"start": places[r[0]][0], "end": places[r[-1]][1]} for r in runs]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["_id", "score", "spans"])

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(rows, schema).withColumnRenamed("_id", id_col)


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, n_spans, spans (start:end of the offending runs in code points, comma-joined),
    with a model learned outside the held-out fold.

    Null and empty texts have no span and the score of no toxic token; null ids are held out; repeated rows each get a
    row; without labels of both kinds all scores are the share of toxic ones; an empty table gives an empty one."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select(
        id_col, in_held_out_fold(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), joined.alias("spans")
    )
