"""Operator 2: toxicity of deobfuscated text by a noisy-channel decoder.

1. A character trigram model is counted over all documents.
2. A token that may be disguised (leetspeak, symbols inside, repeated letters, letters with spaces between) becomes a
   lattice of what each character can stand for; Viterbi finds its likeliest readings under the character model, with
   back pointers, so a token costs time in proportion to its length. A mask (``*``, ``#``, ``%``, ``_``) inside a word
   stands for any one letter.
3. Terms of restored words (whole words and their beginnings) carry the odds that labelled rows give them: a toxic term
   occurs under label 1 alone, another one at the rate of all rows.
4. A logistic classifier joins a document's evidence: the noisy-or of its distinct toxic words, the strongest one, their
   number, and the mean log odds of all its words. It is fitted on terms learnt from the other half of the labelled rows
   (cross fitting), so that its score is a calibrated probability; with few labels it stays at the noisy-or alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, joined, mix, steps, table, texts, word_hashes

# Letters that a character can stand for in disguised words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
# Characters that hide one letter of a word.
MASKS = frozenset("*#%_")
#: Character classes: boundary, a to z, any other letter.
CLASSES = 28


@dataclass(frozen=True)
class ToxicConfig:
    max_labelled: int = 8000  #: labelled rows that the classifier is fitted on, by hash of doc_id
    threshold: float = 0.7
    prior: float = 1e-4  #: share of terms that are toxic
    purity: float = 0.98  #: share of a toxic term's rows that have label 1
    beginnings: tuple[int, ...] = (4, 5, 6)  #: lengths of word beginnings that are terms
    keep: float = 0.05  #: weaker terms are left out
    min_spaced: int = 3  #: so many single characters in a row are one spaced word
    double: float = 3.0  #: channel cost of reading two equal letters as one
    min_rows: int = 8  #: a word in fewer labelled rows has no log odds
    ridge: float = 1.0  #: weight of the classifier's prior, which is the noisy-or
    cache_words: int = 1 << 19  #: words whose score a worker remembers


_BYTE_CLASS = np.zeros(256, np.int64)
_BYTE_CLASS[97:123] = np.arange(1, 27)
_BYTE_CLASS[65:91] = np.arange(1, 27)
_BYTE_CLASS[0xC3:0xF5] = 27


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        column = texts(batch.column(0))
        for lo, hi in steps(column):
            buf, _, _ = joined(column, lo, hi, width=2)
            x = _BYTE_CLASS[buf[(buf < 0x80) | (buf >= 0xC0)]]  # without continuation bytes
            if len(x) > 2:
                total += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative log probabilities) of a character class after two others, over all texts of docs."""
    rows = docs.select("text").mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES**3)
    for r in rows:  # at most CLASSES ** 3 rows
        n[r["gram"]] = r["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    two = n.sum(0) + 0.5  # backs off to the last character alone
    low = two / two.sum(1, keepdims=True)
    return -np.log((n + 2 * low[None]) / (n.sum(2, keepdims=True) + 2))


def _class(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def _lattice(token: str, double: float) -> list[list[tuple[str, float]]] | None:
    """For each run of one character its readings with channel costs; None if there is one reading only."""
    out, several = [], False
    at, n = 0, len(token)
    while at < n:
        to = at
        while to < n and token[to] == token[at]:
            to += 1
        ch, run = token[at], to - at
        edge = at == 0 or to == n
        if ch.isalpha():
            if run == 1:
                out.append([(ch, 0.0)])
            else:
                several = True
                out.append([(ch * 2, 0.0), (ch, double)] if run == 2 else [(ch, 0.5), (ch * 2, 0.9)])
        elif ch in LEET:
            several = True
            out.append([("", 0.7 if edge and not ch.isdigit() else 3.0)] + [(x, 1.0 if run == 1 else 1.5) for x in LEET[ch]])
        else:
            several |= not edge
            out.append([("", 0.0 if edge else 0.7)])
        at = to
    return out if several else None


def readings(token: str, costs: list, double: float = 3.0) -> list[str]:
    """Likeliest readings of a lower-case token, one for each pair of last characters, best first; plain tokens have one."""
    letters = sum(ch.isalpha() for ch in token)
    if not letters:
        return []
    lattice = _lattice(token, double)
    if lattice is None:
        return ["".join(ch for ch in token if ch.isalpha())]
    # a path is (path before, what it adds): all paths share their beginnings
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in lattice:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for add, price in choices:
                total, p, q = cost + price, a, b
                for ch in add:
                    c = _class(ch)
                    total += costs[p][q][c]
                    p, q = q, c
                if (p, q) not in after or total < after[p, q][0]:
                    after[p, q] = (total, (path, add) if add else path)
        states = after
    ends = sorted(((cost + costs[a][b][0], k, path) for k, ((a, b), (cost, path)) in enumerate(states.items()) if path), key=lambda x: x[:2])
    out = []
    for _, _, path in ends[:3]:
        parts = []
        while path:
            path, add = path
            parts.append(add)
        out.append("".join(reversed(parts)))
    return out


def terms(word: str, c: ToxicConfig) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in c.beginnings if len(word) >= k)]


def _tokens(column: pa.Array, lo: int, hi: int, c: ToxicConfig):
    """Bytes, word starts, ends, hashes, each document's first and last word, and its spaced words as (document, text)."""
    buf, begin, end = joined(column, lo, hi)
    starts, ends, words = word_hashes(buf)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    heads = np.append(0, np.cumsum((buf & 0xC0) != 0x80))  # characters, not bytes
    single = np.append(heads[ends] - heads[starts] == 1, False)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8)])))
    spaced = []
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=False):
        if b - a >= c.min_spaced:
            k = int(np.searchsorted(first, a, "right")) - 1
            for x, y in _within(first, last, a, b, k):
                if y[1] - y[0] >= c.min_spaced:
                    spaced.append((x, bytes(buf[starts[y[0] : y[1]]]).decode("utf-8", "replace").lower()))
    return buf, starts, ends, words, first, last, spaced


def _within(first, last, a: int, b: int, k: int):
    """A run of words a to b cut at the ends of documents, from document k on."""
    while a < b and k < len(first):
        to = min(b, int(last[k]))
        if to > a:
            yield k, (a, to)
            a = to
        k += 1


def _evidence(c: ToxicConfig, costs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text, toxic, half) as (term, context, toxic, half), once for each document: its least context.

        A word's context is the hash of both neighbours, a beginning's is the whole word: copies of a document have equal
        rows, which count once, and a beginning needs several words behind it.
        """
        model = costs.tolist()
        cache: dict[int, list[tuple[str, int | None]]] = {}
        for batch in batches:
            column, label, half = texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in steps(column):
                buf, starts, ends, words, first, last, spaced = _tokens(column, lo, hi, c)
                around = np.concatenate([np.zeros(1, np.uint64), words, np.zeros(1, np.uint64)])
                context = mix(around[:-2] * np.uint64(3) + around[2:]).view(np.int64).tolist()
                names = words.tolist()
                raw = buf.tobytes()
                out: list[tuple] = []
                for k in range(hi - lo):
                    least: dict[str, int] = {}
                    for w in range(int(first[k]), int(last[k])):
                        if (found := cache.get(names[w])) is None:
                            token = raw[starts[w] : ends[w]].decode("utf-8", "replace").lower()
                            found = cache[names[w]] = [(t, None if t[0] == "=" else xxhash.xxh64_intdigest(x) - (1 << 63)) for x in readings(token, model, c.double)[:1] for t in terms(x, c)]
                        for t, whole in found:
                            at = context[w] if whole is None else whole
                            if at < least.get(t, 1 << 63):
                                least[t] = at
                    out += [(t, x, label[lo + k], half[lo + k]) for t, x in least.items()]
                if len(cache) > c.cache_words:
                    cache.clear()
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["term", "context", "toxic", "half"])

    return run


@dataclass(frozen=True)
class Lexicon:
    """What labelled rows tell of words: the probability that a term is toxic, and the log odds of whole words."""

    toxic: dict[str, float]
    odds: dict[str, float]


def _lexicon(counts: list, rate: float, c: ToxicConfig) -> Lexicon:
    """counts: (term, rows with label 1, rows)."""
    up, down = math.log(c.purity / rate), math.log((1 - c.purity) / (1 - rate))
    start = math.log(c.prior / (1 - c.prior))
    toxic, odds = {}, {}
    for term, pos, n in counts:
        if pos > 1 and (p := 1 / (1 + math.exp(-max(-700.0, start + pos * up + (n - pos) * down)))) >= c.keep:
            toxic[term] = p
        if term[0] == "=" and n >= c.min_rows:
            odds[term[1:]] = math.log((pos + rate) / (n - pos + 1 - rate) * (1 - rate) / rate)
    return Lexicon(toxic, odds)


#: Numbers that the classifier sees of a document, and its weights before any label: the noisy-or alone.
FEATURES = 5
PRIOR = np.array([0.0, 1.0, 0.0, 0.0, 0.0])


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, c: ToxicConfig) -> tuple[Lexicon, np.ndarray] | None:
    """Lexicon and classifier of a bounded sample of labelled rows; None without any."""
    key = F.xxhash64("doc_id")
    sample = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct().orderBy(key, "doc_id").limit(c.max_labelled)
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")
    scratch = Scratch(docs.sparkSession, "toxicity")
    # at most max_labelled rows are broadcast, and as many texts written
    rows = scratch.keep(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", half), "sample")
    seen = rows.mapInArrow(_evidence(c, costs), "term string, context long, toxic int, half int").distinct()
    counts = seen.groupBy("term").agg(*[F.sum(F.when(F.col("half") == h, x).otherwise(0)).cast("long").alias(f"{name}{h}") for h in (0, 1) for name, x in (("pos", F.col("toxic")), ("n", F.lit(1)))])
    counts = counts.where(f"pos0 + pos1 > 1 or (n0 + n1 >= {int(c.min_rows)} and term like '=%')").select("term", "pos0", "n0", "pos1", "n1").collect()  # terms of the sample
    totals = rows.agg(F.avg("toxic").alias("rate")).first()
    if totals["rate"] is None:
        return None
    rate = min(max(totals["rate"], 0.01), 0.9)
    whole = _lexicon([(t, a + b, m + n) for t, a, m, b, n in counts], rate, c)
    others = [_lexicon([(r[0], r[3 - 2 * h], r[4 - 2 * h]) for r in counts], rate, c) for h in (0, 1)]
    x, y = [np.zeros((0, FEATURES))], []
    for h in (0, 1):  # terms of one half, rows of the other one
        found = rows.where(F.col("half") == h).select("toxic", "text").mapInArrow(_score(c, costs, others[h], None), "toxic int, text string, features array<double>").select("toxic", "features").collect()
        x.append(np.array([r["features"] for r in found], float).reshape(-1, FEATURES))
        y += [r["toxic"] for r in found]
    return whole, _logistic(np.concatenate(x), np.array(y, float), c.ridge)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic classifier around PRIOR, by Newton's steps. All evidence counts for label 1: a weight below zero is left out."""
    free = np.ones(FEATURES, bool)
    while True:
        w = np.where(free, PRIOR, 0.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            z = x[:, free]
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1]), z.T @ (p - y) + ridge * (w - PRIOR)[free])
            w[free] -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        if (w[1:] >= 0).all():
            return w
        free[1 + int(w[1:].argmin())] = False


def _score(c: ToxicConfig, costs: np.ndarray, known: Lexicon, weights: np.ndarray | None):
    """Rows (any, text, ...) with a last column: the score, or without weights the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = costs.tolist()
        cache: dict[int, tuple[float, float]] = {}
        longest = max(map(len, known.toxic), default=1) - 1
        of_size: dict[int, list[str]] = {}
        for t in known.toxic:
            of_size.setdefault(len(t) - 1, []).append(t)

        def masked(token: str) -> float:
            """The strongest term that a word with masked letters can be."""
            word = token.strip("".join(ch for ch in set(token) if not ch.isalnum()))
            if not MASKS & set(word) or len(word) - sum(ch in MASKS for ch in word) < 2:
                return 0.0
            fits = lambda t, n: all(a == b or b in MASKS for a, b in zip(t[1:], word[:n], strict=True))
            whole = max((known.toxic[t] for t in of_size.get(len(word), ()) if t[0] == "=" and fits(t, len(word))), default=0.0)
            return max([whole, *(known.toxic[t] for n in c.beginnings if n <= len(word) and sum(ch.isalpha() for ch in word[:n]) >= 3 for t in of_size.get(n, ()) if t[0] == "^" and fits(t, n))])

        def best(token: str) -> tuple[float, float]:
            found = readings(token, model, c.double)
            p = max((known.toxic.get(t, 0.0) for x in found for t in terms(x, c)), default=0.0)
            return max(p, masked(token)) if MASKS & set(token) else p, known.odds.get(found[0], 0.0) if found else 0.0

        def inside(token: str) -> float:
            """Spaced letters may hold several words: every part is looked up, and the beginning of all."""
            whole = [*readings(token, model, c.double), "".join(ch for ch in token if ch.isalpha())]
            parts = {x[i:j] for x in whole for i in range(len(x)) for j in range(i + 3, min(len(x), i + longest) + 1)}
            return max([0.0, *(known.toxic.get(f"={x}", 0.0) for x in parts), *(known.toxic.get(t, 0.0) for x in whole for t in terms(x, c))])

        for batch in batches:
            column = texts(batch.column(1))
            features = np.zeros((len(column), FEATURES))
            some = np.zeros(len(column), bool)
            for lo, hi in steps(column):
                buf, starts, ends, words, first, last, spaced = _tokens(column, lo, hi, c)
                distinct, at, back = np.unique(words, return_index=True, return_inverse=True)
                raw = buf.tobytes()
                value = np.zeros((len(distinct), 2))
                for k, (h, w) in enumerate(zip(distinct.tolist(), at.tolist(), strict=True)):
                    if (p := cache.get(h)) is None:
                        p = cache[h] = best(raw[starts[w] : ends[w]].decode("utf-8", "replace").lower())
                    value[k] = p
                if len(cache) > c.cache_words:
                    cache.clear()
                hits = np.flatnonzero(value[back, 0] > 0)
                doc = np.searchsorted(last, hits, "right")
                seen = {(d, h): p for d, h, p in zip(doc.tolist(), back[hits].tolist(), value[back[hits], 0].tolist(), strict=True)}
                for n, (k, token) in enumerate(spaced):
                    if (p := inside(token)) > 0:
                        seen[k, -1 - n] = p
                none, most, number = np.zeros(hi - lo), np.zeros(hi - lo), np.zeros(hi - lo)
                for (d, _), p in seen.items():
                    none[d] += math.log1p(-min(p, 1 - 1e-12))
                    most[d] = max(most[d], p)
                    number[d] += 1
                count = last - first
                full = np.flatnonzero(count)
                mean = np.zeros(hi - lo)
                if len(full):
                    mean[full] = np.add.reduceat(value[back, 1], first[full]) / count[full]
                some[lo:hi] = count > 0
                # log odds of the noisy-or and of the strongest term, from those of no hit on
                any_ = np.log(np.maximum(-np.expm1(none), 1e-3)) - np.maximum(none, -40.0)
                one = np.log(np.maximum(most, 1e-3)) - np.log(np.maximum(1 - most, 1e-12)) - math.log(1e-3)
                features[lo:hi] = np.stack([np.ones(hi - lo), any_, one, np.log1p(number), mean], 1)
            if weights is None:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, features.size + 1, FEATURES, dtype=np.int32)), pa.array(features.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "features"])
            else:
                score = np.where(some, 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(score, 6))], [*batch.schema.names, "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null doc_id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, config: ToxicConfig | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, extra columns, score) for each row of docs (doc_id long, text string); labels has doc_id and toxic (0 or 1).

    Texts without a word, null and empty ones among them, score 0; labels with nulls or other values are not used;
    without labelled rows every score is 0; repeated rows are scored each; a very long text is one step, so memory
    follows the longest; an empty table gives no rows; only text reaches the score.
    """
    c = config or ToxicConfig()
    costs = character_model(docs)
    learnt = labels.where(~held_out(F.col("doc_id")))
    fitted = fit(docs, learnt, costs, c)
    rows = docs.select("doc_id", "text", *extra)
    if fitted is None:
        return rows.withColumn("score", F.lit(0.0))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(c, costs, *fitted), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ToxicConfig()
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), c)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= c.threshold).cast("int").alias("predicted"))
