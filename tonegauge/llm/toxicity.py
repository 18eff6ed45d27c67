"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

Everything is learned from a bounded number of labelled texts, found by joining labels with document ids, so no text is
shuffled. The lexicon: each of these texts counts once for each of its words and word beginnings, Spark sums the
counts by label, and the entries whose presence speaks most for the label are kept (``entries`` of them, a fixed bound).
Other features are rates: lexicon hits near a second person, capitals, punctuation, spelled-out and substituted letters.
The calibration sees scores of texts that neither the lexicon nor the trees behind them have seen.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.llm import boosting
from tonegauge.llm.common import labelled_sample, map_columns, ship

#: Fixed word list: second persons in the four languages of the tables.
SECOND_PERSONS = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "toi", "te", "ton", "ta", "vous", "votre", "usted", "ustedes", "ti", "tus"]
#: Fixed table: signs that stand in for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
PREFIXES = (4, 5, 6)
TOKEN = regex.compile(r"[\p{L}\p{N}@$!|*]*\p{L}[\p{L}\p{N}@$!|*]*")
#: Three or more single letters of one token, parted by signs.
SPELLED = regex.compile(r"(?<![\p{L}\p{N}])\p{L}(?:[.\-_*]\p{L}){2,}(?![\p{L}\p{N}])")
TRIM = "!*|@$"
NEAR = 5


def plain(token: str) -> str:
    """A token in lower case with substituted letters put back and letters repeated over twice reduced."""
    low = token.lower().strip(TRIM)
    if not low.isalpha():
        low = "".join(SUBSTITUTES.get(c, c) for c in low if c != "*")
    return regex.sub(r"(.)\1{2,}", r"\1", low)


def learn_lexicons(texts: DataFrame, folds: int, entries: int, least: int = 3, prefixes=PREFIXES) -> list[dict[str, float]]:
    """A lexicon without each fold's texts, and as the last one a lexicon of all texts.

    Every text (``_t``, ``_y``, ``_h``; its fold is its hash modulo ``folds``) counts once for each of its words and word
    beginnings (with `*`). Kept are the entries with the largest gain in log likelihood whose smoothed log odds exceed one.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("_t"), F.lit(r"\p{L}{2,}"), F.lit(0)))
    starts = [F.transform(F.filter("t", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in prefixes]
    rows = texts.select((F.col("_y") == 1).alias("y"), F.pmod("_h", F.lit(folds)).alias("fold"), tokens.alias("t"))
    sizes = {(r["y"], r["fold"]): r["n"] for r in rows.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    entry = rows.select("y", "fold", F.explode(F.array_distinct(F.concat("t", *starts))).alias("entry"))
    counts = entry.groupBy("entry").agg(*[F.count(F.when((F.col("fold") == k) & (F.col("y") == y), 1)).alias(f"n{k}_{int(y)}") for k in range(folds) for y in (True, False)])

    def without(k: int) -> Column:
        found = [sum(F.col(f"n{j}_{y}") for j in range(folds) if j != k) for y in (1, 0)]
        whole = [sum(n for (y, j), n in sizes.items() if y == kind and j != k) for kind in (True, False)]
        usable = F.lit(bool(whole[0] and whole[1]))
        odds = F.log(((found[0] + 0.5) / (whole[0] + 1)) / ((found[1] + 0.5) / (whole[1] + 1)))
        return F.struct(F.lit(k).alias("k"), found[0].alias("toxic"), odds.alias("odds"), usable.alias("usable"))

    each = counts.select("entry", F.inline(F.array(*[without(k) for k in range(folds + 1)]))).where((F.col("toxic") >= least) & F.col("usable") & (F.col("odds") > 1))
    best = Window.partitionBy("k").orderBy(F.desc(F.col("toxic") * F.col("odds")), "entry")
    kept: list[dict[str, float]] = [{} for _ in range(folds + 1)]
    for r in each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= entries).collect():
        kept[r["k"]][r["entry"]] = r["odds"]
    return kept


class Reader:
    """Dense features of texts. What a token adds is worked out once and kept in a bounded table."""

    #: Columns of the token table: sum of hit weights, hits after letters were put back, person, capitals, shouted, marks, double marks, one letter,
    #: hits, spelled-out words, words, the three largest weights.
    WIDTH = 14

    def __init__(self, lexicon: dict[str, float], persons: frozenset[str], most: int = 200_000, chars: int = 8_000_000, step: int = 100_000):
        self.lexicon, self.persons, self.most, self.chars, self.step = lexicon, persons, most, chars, step
        self.known: dict[str, int] = {}
        self.held = 0
        self.table = np.zeros((1024, self.WIDTH), np.float32)

    def rows(self, tokens: list[str]) -> np.ndarray:
        """The table's rows of some tokens; the table is emptied when it holds too many entries or characters."""
        if len(self.known) > self.most or self.held > self.chars:
            self.known.clear()
            self.held = 0
        get, add = self.known.get, self.add
        numbers = [n if (n := get(t)) is not None else add(t) for t in tokens]  # may put a longer table in place
        return self.table[numbers]

    def weight(self, word: str) -> float:
        best = self.lexicon.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                best = max(best, self.lexicon.get(word[:n] + "*", 0.0))
        return best

    def add(self, token: str) -> int:
        """Number of a token not seen before."""
        number = len(self.known)
        if number == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        row = self.table[number]
        row[:] = 0
        body = token.rstrip(".,;:")
        if body.isalpha() and body.islower():
            row[0], row[2], row[7], row[10] = self.weight(body), body in self.persons, len(body) == 1, 1
            row[8], row[11] = row[0] > 0, row[0]
        else:
            apart = SPELLED.findall(body)
            raw = TOKEN.findall(SPELLED.sub(" ", body) if apart else body)
            joined = ["".join(filter(str.isalpha, run)) for run in apart]
            parts = [(plain(part), part.lower()) for part in raw] + [(plain(part), "") for part in joined]
            hits = sorted(((found, word != low) for word, low in parts if (found := self.weight(word))), reverse=True)
            row[0], row[1], row[8] = sum(found for found, _ in hits), sum(changed for _, changed in hits), len(hits)
            row[2], row[9], row[10] = any(word in self.persons for word, _ in parts), len(apart), max(1, len(parts))
            row[11 : 11 + min(3, len(hits))] = [found for found, _ in hits[:3]]
            letters = [c for c in body if c.isalpha()]
            row[3], row[4] = sum(map(str.isupper, body)), sum(len(part) > 2 and part.isupper() for part in raw + joined)
            row[5], row[6], row[7] = token.count("!") + token.count("?"), token.count("!!"), len(letters) == 1
        self.known[token] = number
        self.held += len(token)
        return number

    def spelled(self, tokens: list[str], single: np.ndarray) -> list[str]:
        """Words written as three or more single letters."""
        places = np.flatnonzero(single)
        runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
        return [plain("".join(c for i in run for c in tokens[i] if c.isalpha())) for run in runs if len(run) >= 3]

    def features(self, text: str | None) -> list[float]:
        """All zero for a text without words. Whole texts, ``step`` tokens at a time."""
        tokens = (text or "").split()
        if not tokens:
            return [0.0] * 16
        sums, persons, hits, single = np.zeros(self.WIDTH), [], [], []
        for first in range(0, len(tokens), self.step):
            rows = self.rows(tokens[first : first + self.step])
            sums += rows.sum(axis=0, dtype=np.float64)
            found = np.flatnonzero(rows[:, 8])
            hits.append((first + found, rows[found, 8], rows[found, 11:]))
            persons.append(first + np.flatnonzero(rows[:, 2]))
            single.append(rows[:, 7] > 0)
        place, many, best = (np.concatenate(part) for part in zip(*hits))
        near, person = 0, np.concatenate(persons)
        if len(place) and len(person):
            close = np.searchsorted(person, place + NEAR, "right") > np.searchsorted(person, place - NEAR)
            near = int(many[close].sum())
        spelled = self.spelled(tokens, np.concatenate(single)) if sums[7] >= 3 else []
        more = [w for word in spelled if (w := self.weight(word))]
        top = sorted([*best.ravel().tolist(), *more, 0.0, 0.0, 0.0], reverse=True)[:3]
        found, total, changed = sums[8] + len(more), sums[0] + sum(more), sums[1] + len(more)
        count, size, apart = int(sums[10]), len(text), sums[9] + len(spelled)
        return [
            found / count, math.log1p(found), total / count, total, *top,
            near / count, float(near), changed / count, apart / count, sums[3] / size, sums[4] / count, sums[5] / size, sums[6] / size, math.log1p(count),
        ]


@dataclasses.dataclass
class ToxicModel:
    trees: boosting.Boosted
    knots: tuple[np.ndarray, np.ndarray]
    reader: Reader


def fit_sample(rows: list[tuple[str, int, int]], lexicons: list[dict[str, float]], persons: frozenset[str]) -> ToxicModel:
    """Trees on all rows, and isotonic calibration of scores each fold gets from a lexicon and trees made without it."""
    y = np.array([label for _, label, _ in rows], float)
    folds = len(lexicons) - 1
    fold = np.array([key % folds for _, _, key in rows], int)

    def fitted(lexicon: dict[str, float], held: np.ndarray) -> tuple[boosting.Boosted, np.ndarray]:
        read = Reader(lexicon, persons).features
        x = np.array([read(text) for text, _, _ in rows]) if rows else np.zeros((0, 16))
        trees = boosting.fit(x[~held], y[~held], trees=60, depth=4, rate=0.15)
        return trees, trees.score(x[held])

    apart = np.zeros(len(rows))
    for k in range(folds):
        held = fold == k
        if held.any():
            apart[held] = fitted(lexicons[k], held)[1]
    trees, _ = fitted(lexicons[-1], np.zeros(len(rows), bool))
    knots = boosting.isotonic(apart, y) if rows else (np.zeros(0), np.zeros(0))
    return ToxicModel(trees, knots, Reader(lexicons[-1], persons))


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = 12_000, sample: int = 3000, most_chars: int = 8_000, entries: int = 1000, folds: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicModel:
    """Learn from the labelled documents that ``usable`` (a condition on the document id) allows.

    At most ``rows`` labelled documents of up to ``most_chars`` characters are looked at (``labelled_sample``): the lexicon
    counts their distinct texts, the trees and the calibration see ``sample`` of them. No labelled document: every score
    is one half.
    """
    once, chosen = labelled_sample(docs, labels, usable, label, rows, sample, most_chars, doc_id, text)
    lexicons = learn_lexicons(once, folds, entries) if chosen else [{}] * (folds + 1)
    return fit_sample(chosen, lexicons, frozenset(SECOND_PERSONS))


def score_texts(docs: DataFrame, model: ToxicModel, keys: dict[str, str], text: str = "text") -> DataFrame:
    """score (0 to 1) and predicted (score at least one half) of every whole text, beside the key columns.

    NULL and empty texts get the score of a text without any hit.
    """
    shipped = ship(docs.sparkSession, model)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in keys.items()) + ", score double, predicted int"

    def make():
        own = shipped()

        def step(*columns):
            x = np.array([own.reader.features(value) for value in columns[-1]])
            p = boosting.calibrated(own.knots, own.trees.score(x))
            return [*columns[:-1], p.tolist(), (p >= 0.5).astype(int).tolist()]

        return step

    return map_columns(docs, [*[F.col(f"`{name}`").cast(kind) for name, kind in keys.items()], F.col(text)], schema, make)
