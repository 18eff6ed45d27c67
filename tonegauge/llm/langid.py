"""Language identification by error-correcting output codes over byte n-grams.

Every learned language has a codeword of bits. One linear classifier for each bit says from a text's n-gram profile
whether the bit is set; the language whose codeword has the smallest loss, weighted by how sure and how good each bit
is, is the answer. Training reads a bounded sample of each language's labelled documents, fixed by a hash of the text.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Sequence

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import map_columns, ship

BUCKETS = 1 << 13
LETTER = regex.compile(r"\p{L}")
#: Most languages for which all distinct two-way splits are used as bits.
EXHAUSTIVE = 6
#: Most characters of a text to learn from, where a language has such texts.
LONGEST = 20_000


@dataclasses.dataclass
class CodeModel:
    """languages, codewords (languages x bits, 1 or -1), weights (n-gram buckets x bits), bias, and each bit's say."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    say: np.ndarray


def codewords(count: int, seed: int = 7) -> np.ndarray:
    """Rows of 1 and -1. Few languages: every way to split them in two. Many: the widest of several random codes."""
    if count <= 1:
        return np.ones((count, 1))
    if count <= EXHAUSTIVE:
        return np.array([[1, *bits] for bits in itertools.product((1, -1), repeat=count - 1) if -1 in bits], float).T
    random = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(count)))
    tries = [random.choice((1.0, -1.0), (count, bits)) for _ in range(50)]

    def worst(code):
        apart = (code.shape[1] - code @ code.T) / 2
        return apart[~np.eye(count, dtype=bool)].min()

    return max(tries, key=worst)


def _slots(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram and of each bigram."""
    wide = data.astype(np.uint32)
    if len(wide) < 3:
        wide = np.r_[wide, np.full(3 - len(wide), 32, np.uint32)]
    two = wide[:-1] << np.uint32(8) | wide[1:]
    three = two[:-1] << np.uint32(8) | wide[2:]
    return np.r_[(two * np.uint32(2654435761)) >> np.uint32(19), ((three ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> np.uint32(19)]


def profile(text: str) -> np.ndarray:
    """Square roots of the n-gram shares of a whole text: a vector of length one. Every character counts."""
    counts = np.zeros(BUCKETS)
    low = text.lower()
    for i in range(0, len(low), 1 << 20):  # in pieces that overlap by two characters, to bound memory
        data = np.frombuffer(f" {low[max(0, i - 2) : i + (1 << 20)]} ".encode("utf-8"), np.uint8)
        counts += np.bincount(_slots(data), minlength=BUCKETS)
    return np.sqrt(counts / counts.sum())


def sample_documents(docs: DataFrame, usable: Column, per_language: int = 150, most: int = 2400, text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(lang, text) of at most ``per_language`` documents of each language, ``most`` in all: those of the smallest text hash.

    Equal texts of a language count once. The first cut by hash happens in the JVM with counts of distinct texts per
    language, so only about the sample itself is ranked and sent. Texts beyond 20,000 characters are passed over to bound
    what reaches the driver, but for languages that have no shorter one: of those the shortest are taken, whole, while
    they hold ``per_language`` times 20,000 characters together, and one at least.
    """
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("_l"), F.col(text).alias("_t"), F.xxhash64(F.lit(1), F.col(text)).alias("_h"), F.length(text).alias("_n"))
    short = F.col("_n") <= LONGEST
    hashes = rows.groupBy("_l", "_h").agg(F.min("_n").alias("_n"))
    counts = hashes.groupBy("_l").agg(F.count(F.when(short, 1)).alias("short")).collect()
    per_language = max(1, min(per_language, most // max(1, len(counts))))
    share = F.lit(False)
    for row in counts:
        bar = min(1.0, 1.5 * (per_language + 20) / max(1, row["short"]))
        share = share | ((F.col("_l") == row["_l"]) & (F.pmod("_h", F.lit(1_000_003)) < int(bar * 1_000_003) + 1))
    found: dict[str, list[tuple[int, str]]] = {}

    def take(picked: DataFrame) -> None:
        for row in picked.groupBy("_l", "_h").agg(F.min("_t").alias("_t")).collect():
            found.setdefault(row["_l"], []).append((row["_h"], row["_t"]))

    if counts:
        take(rows.where(short & share))
    for row in counts:
        name = row["_l"]
        own = F.col("_l") == name
        if len(found.get(name, [])) < min(per_language, row["short"]):  # the share gave too few
            smallest = [r["_h"] for r in hashes.where(own & short).orderBy("_h").limit(per_language).collect()]
            found.pop(name, None)
            take(rows.where(own & short & F.col("_h").isin(smallest)))
        elif not row["short"]:
            chosen, held = [], 0
            for r in hashes.where(own).orderBy("_n", "_h").limit(per_language).collect():
                held += r["_n"]
                if not chosen or held <= per_language * LONGEST:
                    chosen.append(r["_h"])
            take(rows.where(own & F.col("_h").isin(chosen)))
    return [(name, value) for name in sorted(found) for _, value in sorted(found[name])[:per_language]]


def fit(sample: Sequence[tuple[str, str]], rounds: int = 200, seed: int = 7) -> CodeModel:
    """Logistic regression for every bit by full gradient steps; a bit's say is its log odds of being right."""
    languages = sorted({name for name, _ in sample})
    code = codewords(len(languages), seed)
    if not languages:
        return CodeModel([], np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1))
    # short cuts of the texts as well, so that short texts are judged as well as long ones
    texts = [(name, cut) for name, value in sample for cut in (value, value[:200], value[len(value) // 2 :][:60]) if LETTER.search(cut)]
    x = np.array([profile(value) for _, value in texts], np.float32)
    label = np.array([languages.index(name) for name, _ in texts])
    y = code[label].astype(np.float32)
    share = np.bincount(label, minlength=len(languages))
    weight = ((1 / share[label])[:, None] / len(languages)).astype(np.float32)
    weights, bias, speed = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.zeros((BUCKETS, code.shape[1]), np.float32)
    for _ in range(rounds):
        margin = x @ weights + bias
        pull = weight * y / (1 + np.exp(np.clip(y * margin, -30, 30)))
        speed = 0.9 * speed + (x.T @ pull - 1e-5 * weights)
        weights += 20.0 * speed
        bias += 2.0 * pull.sum(axis=0)
    right = (weight * (y * (x @ weights + bias) > 0)).sum(axis=0)
    say = np.log((right + 0.01) / (1 - right + 0.01))
    return CodeModel(languages, code, weights, bias, np.maximum(say, 0.01))


def decode(model: CodeModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by weighted logistic loss, its share of the likelihood, whether the choice is ambiguous, and whether it is a tie."""
    loss = np.logaddexp(0, -margins[:, None, :] * model.code[None, :, :]) @ model.say / model.say.sum()
    best = loss.argmin(axis=1)
    even = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * model.code.shape[1])
    score = 1 / even.sum(axis=1)
    near = np.sort(loss, axis=1)
    ahead = near[:, 1] - near[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, score, ahead < 0.02, ahead < 1e-9


def predict(docs: DataFrame, model: CodeModel, keys: dict[str, str], text: str = "text") -> DataFrame:
    """lang_pred, score, ambiguous and tied for every whole text, beside the key columns.

    NULL texts and texts without a letter: `und`, score 0, not ambiguous. So are all texts where nothing was learned.
    """
    shipped = ship(docs.sparkSession, model)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in keys.items()) + ", lang_pred string, score double, ambiguous boolean, tied boolean"

    def make():
        own = shipped()

        def step(*columns):
            texts = columns[-1]
            names, scores, flags, ties = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts), [False] * len(texts)
            able = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if own.languages else []
            if able:
                margins = np.array([profile(texts[i]) @ own.weights for i in able]) + own.bias
                for i, best, score, flag, tie in zip(able, *decode(own, margins)):
                    names[i], scores[i], flags[i], ties[i] = own.languages[best], min(1.0, float(score)), bool(flag), bool(tie)
            return [*columns[:-1], names, scores, flags, ties]

        return step

    return map_columns(docs, [*[F.col(f"`{name}`").cast(kind) for name, kind in keys.items()], F.col(text)], schema, make)


def identify(docs: DataFrame, usable: Column, keys: dict[str, str], per_language: int = 150, text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the labelled rows that ``usable`` allows, then predict every document."""
    return predict(docs, fit(sample_documents(docs, usable, per_language, text=text, lang=lang)), keys, text)
