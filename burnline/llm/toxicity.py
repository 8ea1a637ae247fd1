"""Operator 7: toxicity by subword-bag embeddings and a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (hashed, with
a space on either side as word boundary); a passage's is the mean of its words'.
A linear softmax on it is trained jointly with the n-gram vectors, in numpy, on a
bounded sample of labelled documents. As insults are few words of a long text, a
document is as toxic as its worst passage: training starts from whole documents
and goes on with the worst passage of each. Misspellings share n-grams with what
they misspell, so they score alike.

As the softmax is linear, a word's score is the mean of scores of its n-grams, so
scoring looks numbers up and adds them, over whole texts.

Nulls: a null or empty text has no words and takes the score of the bias alone.
Labels with a null doc_id or label are ignored. Repeated rows are scored each; a
document labelled twice trains twice. Without labels of both kinds every score is
the share of toxic labels (0.0 without any). An empty table gives no rows. Other
columns are ignored. Very long texts are scored in blocks that never cut a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnline.llm.common import pieces, utf8
from burnline.llm.words import BASE, BLOCK, INVERSE, LOWER, SPACE, U, powers, prefix, spans

#: Lengths of n-grams, buckets they hash into, size of a vector, words of a passage.
GRAMS, BUCKET_BITS, SIZE, PASSAGE = (3, 4, 5, 6), 18, 8, 4
#: The sample: labelled documents of either kind, and their bytes together; a document of any length may be among them.
PER_LABEL, BUDGET = 1_200, 3 << 20
#: The sample has as many toxic as clean documents; this share of the log-odds to the labels' own ratio is put back.
PRIOR = 0.5
#: Rounds of training, of which the first use whole documents.
ROUNDS, WHOLE = 90, 30


@dataclass
class Model:
    gram: np.ndarray  # score of each bucket
    scale: float
    bias: float


def _grams(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Starts and ends of words, and for each n the (start, bucket) of every n-gram of a word with its boundaries.

    White space counts as one boundary character, and so does a byte put between texts by the caller."""
    s, e = spans(raw, starts)
    gap = SPACE[raw]
    total, back = prefix(np.where(gap, np.uint8(32), LOWER[raw])), powers(INVERSE, len(raw) + 1)
    inner = np.concatenate([[0], np.cumsum(gap)])
    out = []
    for n in GRAMS:
        m = len(raw) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.int32)))
            continue
        at = np.flatnonzero(inner[n - 1 : n - 1 + m] == inner[1 : 1 + m])  # no gap but at either end
        h = (total[at + n] - total[at]) * back[at]
        out.append((at.astype(np.int32), ((h ^ (h >> U(29))) * U(BASE) >> U(64 - BUCKET_BITS)).astype(np.int32)))
    return s, e, out


def _joined(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each and after the last, and where each begins."""
    n = len(offsets) - 1
    out = np.full(len(raw) + n + 1, 32, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(raw)) + doc + 1] = raw
    return out, offsets[:-1] + np.arange(n)


def word_scores(raw: np.ndarray, starts: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and score of each word."""
    s, e, grams = _grams(raw, starts)
    score, count = np.zeros(len(raw) + 1), np.zeros(len(raw) + 1)
    for at, bucket in grams:
        score[at] += gram[bucket]
        count[at] += 1
    score, count = np.concatenate([[0], np.cumsum(score)]), np.concatenate([[0], np.cumsum(count)])
    lo = s - 1  # n-grams that begin at the boundary before the word, up to its last byte
    n = count[e] - count[lo]
    return s, (score[e] - score[lo]) / np.maximum(n, 1)


def worst_passage(words: np.ndarray) -> float:
    """The largest mean of PASSAGE words in a row (of all words, where there are fewer)."""
    n = len(words)
    if n <= PASSAGE:
        return float(words.sum() / PASSAGE) if n else 0.0
    total = np.concatenate([[0], np.cumsum(words)])
    return float((total[PASSAGE:] - total[:-PASSAGE]).max() / PASSAGE)


def _blocks(text: np.ndarray, gram: np.ndarray) -> Iterator[np.ndarray]:
    """Scores of the words of one long text, block by block; a word is never cut."""
    at, size = 0, BLOCK // 2
    while at < len(text):
        to = min(at + size, len(text))
        if to < len(text):
            gaps = np.flatnonzero(SPACE[text[at:to]])
            if not len(gaps):  # a word as long as a block
                while to < len(text) and not SPACE[text[to : to + size]].any():
                    to = min(to + size, len(text))
                to += int(SPACE[text[to : to + size]].argmax()) if to < len(text) else 0
                yield np.array([_long_word(text[at:to], gram)])
                at = to
                continue
            to = at + int(gaps[-1]) + 1
        joined, starts = _joined(text[at:to], np.array([0, to - at]))
        yield word_scores(joined, starts, gram)[1]
        at = to


def _long_word(word: np.ndarray, gram: np.ndarray) -> float:
    """The mean score of the n-grams of one very long word, a bounded part of it at a time."""
    score, count, size = 0.0, 0, BLOCK // 2
    back = powers(INVERSE, size)
    for a in range(-1, len(word), size):
        part = LOWER[word[max(a, 0) : a + size + max(GRAMS) - 1]]
        part = np.concatenate([[np.uint8(32)] * (a < 0), part, [np.uint8(32)] * (a + size + max(GRAMS) - 1 > len(word))]).astype(np.uint8)
        total = prefix(part)
        for n in GRAMS:
            k = min(len(part) - n + 1, size)
            if k > 0:
                h = (total[n : n + k] - total[:k]) * back[:k]
                score += float(gram[((h ^ (h >> U(29))) * U(BASE) >> U(64 - BUCKET_BITS)).astype(np.int64)].sum(dtype=np.float64))
                count += k
    return score / max(count, 1)


def _texts(raw: np.ndarray, offsets: np.ndarray, gram: np.ndarray) -> Iterator[np.ndarray]:
    """Scores of the words of each text, a bounded run of texts at a time."""
    for a, b in pieces(offsets, BLOCK // 2):
        block = raw[offsets[a] : offsets[b]]
        if len(block) > BLOCK // 2:  # one long text, in blocks cut at white space
            yield np.concatenate([np.zeros(0), *_blocks(block, gram)])
            continue
        joined, starts = _joined(block, offsets[a : b + 1] - offsets[a])
        s, score = word_scores(joined, starts, gram)
        before = np.append(np.searchsorted(s, starts), len(s))
        for i in range(b - a):
            yield score[before[i] : before[i + 1]]


def fit(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """Train n-gram vectors and the softmax together on labelled texts."""
    y = np.array(labels, np.float64)
    rate = float(y.mean()) if len(y) else 0.0
    if not 0 < rate < 1:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0, 30.0 if rate else -30.0)
    # The words of the sample, each once, with its n-grams.
    vocab: dict[bytes, int] = {}
    docs = []
    for t in texts:
        docs.append(np.array([vocab.setdefault(w, len(vocab)) for w in (t or "").encode().lower().split()], np.int64))
    raw, starts = _joined(*utf8(pa.array([b" ".join(vocab)], pa.binary()))[::-1])
    s, e, grams = _grams(raw, starts)
    word = np.concatenate([np.searchsorted(s, g[0] + 1, side="right") - 1 for g in grams]).astype(np.int32)
    bucket = np.concatenate([g[1].astype(np.int32) for g in grams])
    del raw, grams
    seen = np.zeros(1 << BUCKET_BITS, bool)
    seen[bucket] = True
    used = np.flatnonzero(seen)
    slot = (np.cumsum(seen) - 1).astype(np.int32)[bucket]
    del bucket
    # The n-grams of each word, and the words of each n-gram: every word has some, as its boundaries count.
    order = np.argsort(word, kind="stable")
    slots_of_word, word_at = slot[order], np.searchsorted(word[order], np.arange(len(vocab)))
    order = np.argsort(slot, kind="stable")
    words_of_slot, slot_at = word[order], np.searchsorted(slot[order], np.arange(len(used)))
    per_word = np.bincount(word, minlength=len(vocab)).astype(np.float64)
    del word, slot, order
    rng = np.random.default_rng(seed)
    vec = rng.normal(0, 0.1, (len(used), SIZE))
    w, scale, bias = rng.normal(0, 0.5, SIZE), 4.0, float(np.log(rate / (1 - rate)))
    balance = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))
    moments = [np.zeros_like(vec), np.zeros_like(vec), np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, 0.0, 0.0]
    # Passages of all documents in one list: those of document i are first[i] to first[i + 1].
    keep = np.array([len(d) > 0 for d in docs])
    docs, y, balance = [d for d in docs if len(d)], y[keep], balance[keep]
    flat, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    opens = [np.arange(b - len(d), b - PASSAGE + 1) if len(d) > PASSAGE else np.array([b - len(d)]) for b, d in zip(ends, docs, strict=True)]
    first = np.concatenate([[0], np.cumsum([len(o) for o in opens])])[:-1]
    begin, sizes = np.concatenate(opens), np.array([len(d) for d in docs])
    passes = np.minimum(begin + PASSAGE, np.repeat(ends, np.diff(first, append=len(begin))))
    for step in range(1, ROUNDS + 1):
        gram_score = vec @ w
        word_score = np.add.reduceat(gram_score[slots_of_word], word_at) / per_word
        total = np.concatenate([[0], np.cumsum(word_score[flat])])
        if step <= WHOLE:
            lo, hi, length = ends - sizes, ends, sizes
        else:
            each = total[passes] - total[begin]
            top = np.flatnonzero(each == np.repeat(np.maximum.reduceat(each, first), np.diff(first, append=len(each))))
            top = top[np.searchsorted(top, first)]
            lo, hi, length = begin[top], passes[top], np.full(len(docs), PASSAGE)
        mean = (total[hi] - total[lo]) / length
        p = 1 / (1 + np.exp(-np.clip(scale * mean + bias, -30, 30)))
        g = (p - y) * balance / len(y)
        reach = np.zeros(len(flat) + 1)
        np.add.at(reach, lo, g * scale / length)
        np.add.at(reach, hi, -g * scale / length)
        word_grad = np.bincount(flat, np.cumsum(reach)[:-1], len(vocab)) / per_word
        gram_grad = np.add.reduceat(word_grad[words_of_slot], slot_at)
        grads = [np.outer(gram_grad, w), gram_grad @ vec, float((g * mean).sum()), float(g.sum())]
        values = [vec, w, scale, bias]
        for k, (grad, at_rate) in enumerate(zip(grads, (0.02, 0.02, 0.1, 0.05), strict=True)):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * grad
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * grad**2
            fixed = moments[2 * k] / (1 - 0.9**step), moments[2 * k + 1] / (1 - 0.99**step)
            values[k] = values[k] - at_rate * fixed[0] / (np.sqrt(fixed[1]) + 1e-10)
        vec, w, scale, bias = values
    gram = np.zeros(1 << BUCKET_BITS, np.float32)
    gram[used] = vec @ w
    return Model(gram, float(scale), float(bias))


def held_out(doc_id="doc_id"):
    """Rows that no label may be learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _within(rows: list, budget: int) -> list:
    """Rows in their order, each that still fits into what is left of the budget; the smallest one where none fits."""
    out, left = [], budget
    for r in rows:
        if r.size <= left:
            out.append(r)
            left -= r.size
    return out or sorted(rows, key=lambda r: r.size)[:1]


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, budget: int = BUDGET) -> Model:
    """A model from at most `per_label` labelled documents, `budget` bytes, of either kind outside the held-out rows."""
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    fitting = docs.select("doc_id", F.octet_length("text").alias("size")).where("size is not null").join(marks, "doc_id")
    order = F.xxhash64("doc_id", F.lit(11))
    count = {r.toxic: r.n for r in marks.where("toxic IN (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Ids are picked first, so that texts of the sample alone leave the executors.
    picked = [r for kind in (0, 1) for r in _within(fitting.where(F.col("toxic") == kind).orderBy(order, "size").limit(per_label).collect(), budget)]
    sample = F.broadcast(docs.sparkSession.createDataFrame(picked, fitting.schema).distinct())  # 2 * per_label rows
    same = F.col("size") == F.octet_length("text")  # an id may repeat with other texts
    rows = docs.select("doc_id", "text").join(sample, "doc_id").where(same).orderBy("doc_id").limit(2 * per_label).collect()  # bounded by per_label and budget
    model = fit([r.text for r in rows], [r.toxic for r in rows])
    if min(count.get(0, 0), count.get(1, 0)) and model.scale:
        model.bias += PRIOR * float(np.log(count[1] / count[0]))  # the sample's own odds are weighed out by fit()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `toxicity`, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for part in parts:
            offsets, raw = utf8(pa.array(part, pa.string()))
            worst = np.fromiter(map(worst_passage, _texts(raw, offsets, m.gram)), np.float64, len(part))
            yield pd.Series(1 / (1 + np.exp(-np.clip(m.scale * worst + m.bias, -30, 30))))

    return docs.withColumn("toxicity", score("text"))
