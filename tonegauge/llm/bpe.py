"""Byte-pair encoding by tree concatenation.

A long unsplit run of letters is cut into leaves that are encoded independently, level by level: two neighbours are
joined by encoding a window of tokens around the seam again, and the window grows until its outermost tokens are the
ones both sides already had there. A token sequence is the encoding of its text exactly if each adjacent pair of
tokens is the encoding of its own text; agreement at both ends of the window therefore makes the joined sequence
exact. Whole texts are encoded, with a per-task table of words already seen. Texts with an unsplit run of ``PART`` letters
or more are taken apart: the parts of a run are encoded in tasks of their own, and neighbours are joined in the same way,
``FAN`` at a time; other texts are encoded where they lie.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Sequence

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import map_columns, ship

#: Letters in a leaf: short ones recur, so most are looked up, and so are most windows.
LEAF = 6
#: Letters of a part of a long run; parts joined at a time; levels, enough for the longest string Spark holds (2**31 bytes).
PART, FAN, LEVELS = 1 << 15, 16, 4
#: White space as the tokenizer files' patterns mean it (Unicode White_Space).
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SEPARATORS = regex.compile("[\x1c-\x1f]")
NEVER = 1 << 30
#: Entries of the tables of words, and of leaves and of windows: a worker holds them beside its rows.
WORD_TABLE, PART_TABLE = 200_000, 150_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else 256 and up in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in printable)
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Recent(dict):
    """What was seen of late: emptied when ``size`` entries are full, so its size is bounded."""

    def __init__(self, size: int):
        self.most = size

    def note(self, key, value) -> None:
        if len(self) >= self.most:
            self.clear()
        self[key] = value


class BpeModel:
    """Merges and vocabulary of a tokenizer file with word ends; encodes and decodes."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [step["type"] for step in spec["normalizer"]["normalizers"]]
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["dropout"] or not (splitter["behavior"] == "Removed" and splitter["invert"]):
            raise ValueError("a tokenizer file of another kind")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.letters = dict(enumerate(byte_letters()))
        self.leaves = Recent(PART_TABLE), Recent(PART_TABLE)
        self.windows = Recent(PART_TABLE)
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.pieces = regex.compile(splitter["pattern"]["Regex"].replace(r"\s", SPACE))
        self.added = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.numbers = {**self.vocab, **self.added}
        self.names = {number: name for name, number in self.numbers.items()}
        self.written = {name: str(number) for name, number in self.numbers.items()}
        self.words = Words(WORD_TABLE)
        self.words.model = self

    # merging

    def merge(self, symbols: list[str]) -> list[str]:
        """Lowest rank first, leftmost among equals."""
        if len(symbols) > 48:
            return self._merge_long(symbols)
        parts, rank_of = list(symbols), self.ranks.get
        while len(parts) > 1:
            ranks = [rank_of(pair, NEVER) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, symbols: list[str]) -> list[str]:
        parts: list[str | None] = list(symbols)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [part for part in parts if part is not None]

    def symbols(self, token: str) -> list[str]:
        """A token's letters; the word end belongs to the last."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def concatenate(self, left: tuple[str, ...], right: tuple[str, ...]) -> tuple[str, ...]:
        """The encoding of two neighbours' joint text from their encodings."""
        width = 1
        while True:
            inner, outer = left[-width:], right[:width]
            window = self.window(inner, outer)
            agrees_left = width >= len(left) or window[0] == inner[0]
            agrees_right = width >= len(right) or window[-1] == outer[-1]
            if agrees_left and agrees_right:
                return left[:-width] + window + right[width:]
            width *= 2

    def window(self, inner: tuple[str, ...], outer: tuple[str, ...]) -> tuple[str, ...]:
        """The encoding of a few tokens' text; what was seen before is looked up."""
        known = self.windows.get((inner, outer))
        if known is None:
            known = self.named(self.merge([s for token in (*inner, *outer) for s in self.symbols(token)]))
            if len(inner) + len(outer) <= 8:
                self.windows.note((inner, outer), known)
        return known

    def named(self, tokens: list[str]) -> tuple[str, ...]:
        """The tokens as the vocabulary's own strings, so that tables hold no copies of them."""
        return tuple([self.names[self.numbers[token]] if token in self.numbers else token for token in tokens])

    def leaf(self, letters: str, last: bool) -> tuple[str, ...]:
        known = self.leaves[last].get(letters)
        if known is None:
            known = self.named(self.merge([*letters[:-1], letters[-1] + self.end] if last else list(letters)))
            self.leaves[last].note(letters, known)
        return known

    def encode_piece(self, piece: str) -> tuple[str, ...]:
        """Tokens of one unsplit piece: leaves first, then their joins level by level."""
        return self.encode_letters(self.byte_form(piece), True)

    def byte_form(self, piece: str) -> str:
        return piece.encode("utf-8").decode("latin-1").translate(self.letters)

    def encode_letters(self, letters: str, last: bool) -> tuple[str, ...]:
        """Tokens of a piece, or of a part of one; ``last``: the word ends with it."""
        size = len(letters)
        if size <= LEAF:
            return self.leaf(letters, last)
        return self.join([self.leaf(letters[i : i + LEAF], last and i + LEAF >= size) for i in range(0, size, LEAF)])

    def join(self, level: list[tuple[str, ...]]) -> tuple[str, ...]:
        """The encoding of neighbours' joint text, two by two and level by level."""
        while len(level) > 1:
            pairs = [self.concatenate(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0]

    def segments(self, text: str, part: int) -> list[tuple[str | None, list[str]]]:
        """A text in order: letters of a piece of ``part`` letters or more, not encoded yet, or the tokens between two such."""
        result: list[tuple[str | None, list[str]]] = [(None, [])]
        for chunk in self.chunks(text):
            if chunk in self.added or len(chunk) * 4 < part:
                result[-1][1].extend(self.chunk_tokens(chunk))
                continue
            for piece in [chunk] if chunk.isalpha() else self.pieces.findall(chunk):
                letters = self.byte_form(piece)
                if len(letters) < part:
                    result[-1][1].extend(self.encode_letters(letters, True))
                else:
                    result += [(letters, []), (None, [])]
        return result

    # texts

    def chunks(self, text: str) -> list[str]:
        """Normalised text between white space, special tokens apart."""
        result: list[str] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                result.append(part)
            elif part:
                flat = part if part.isascii() else unicodedata.normalize("NFC", part)
                # one letter at a time, as the file's rule lowers them: a final capital sigma is no exception
                low = flat.replace("Σ", "σ").lower() if "Σ" in flat else flat.lower()
                # str.split knows the same white space, and four separators more
                result.extend(low.split() if not SEPARATORS.search(low) else (c for c in self.spaces.split(low) if c))
        return result

    def chunk_tokens(self, chunk: str) -> Sequence[str]:
        if chunk in self.added:
            return (chunk,)
        if chunk.isalpha():  # one piece for the pattern too
            return self.encode_piece(chunk)
        return [token for piece in self.pieces.findall(chunk) for token in self.encode_piece(piece)]

    def encode(self, text: str | None) -> list[int]:
        return [self.numbers[token] for chunk in self.chunks(text or "") for token in self.chunk_tokens(chunk)]

    def decode(self, ids: list[int]) -> str:
        """Token names joined by a space: the file has no decoder."""
        return " ".join(self.names[number] for number in ids)


class Words(Recent):
    """Ids and names by chunk, made when first asked for."""

    model: BpeModel

    def __missing__(self, chunk: str) -> tuple[str, str]:
        tokens = self.model.chunk_tokens(chunk)
        value = " ".join(map(self.model.written.__getitem__, tokens)), " ".join(tokens)
        if len(chunk) <= 64:
            self.note(chunk, value)
        return value


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def has_long_run(text: Column, part: int) -> Column:
    """Whether white space leaves a run of ``part`` or more; only texts of that length are split to see."""
    runs = F.exists(F.split(text, r"\s+"), lambda run: F.octet_length(run) >= part)
    return F.coalesce(F.when(F.octet_length(text) >= part, runs), F.lit(False))


def encode_parts(texts: DataFrame, shipped, part: int) -> DataFrame:
    """(s, seq, part, tokens) of texts (s, t): every part of a long run is a row, encoded in whatever task it is dealt to."""

    def cut():
        model = shipped()

        def step(names, values):
            rows = []
            for name, value in zip(names, values):
                for seq, (letters, tokens) in enumerate(model.segments(value or "", part)):
                    if letters is None:
                        rows.append((name, seq, 0, None, True, tokens))
                    else:
                        rows += [(name, seq, i // part, letters[i : i + part], i + part >= len(letters), None) for i in range(0, len(letters), part)]
            return list(map(list, zip(*rows))) if rows else [[]] * 6

        return step

    def encode():
        model = shipped()

        def step(names, seqs, parts, letters, last, tokens):
            return [names, seqs, parts, [t if l is None else list(model.encode_letters(l, e)) for l, e, t in zip(letters, last, tokens)]]

        return step

    kind = "s string, seq int, part int, "
    rows = map_columns(texts, [F.col("s"), F.col("t")], kind + "letters string, last boolean, tokens array<string>", cut)
    tasks = texts.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartition(tasks, "s", "seq", "part")  # a fixed number: the rows are few, but each takes time
    return map_columns(dealt, [F.col(c) for c in dealt.columns], kind + "tokens array<string>", encode)


def join_parts(parts: DataFrame, shipped) -> DataFrame:
    """(s, tokens): neighbouring parts joined ``FAN`` at a time, then the text's segments in order."""

    def make():
        model = shipped()

        def step(names, seqs, at, groups):
            return [names, seqs, at, [list(model.join([tuple(tokens) for tokens in group])) if len(group) > 1 else group[0] for group in groups]]

        return step

    for _ in range(LEVELS):
        near = parts.groupBy("s", "seq", F.floor(F.col("part") / FAN).cast("int").alias("up")).agg(F.array_sort(F.collect_list(F.struct("part", "tokens")))["tokens"].alias("group"))
        parts = map_columns(near, [F.col(c) for c in ("s", "seq", "up", "group")], "s string, seq int, part int, tokens array<string>", make)
    return parts.groupBy("s").agg(F.flatten(F.array_sort(F.collect_list(F.struct("seq", "tokens")))["tokens"]).alias("tokens"))


def encode_texts(df: DataFrame, text: Column, tokenizer: str, keys: dict[str, str], with_ids: bool = False, part: int = PART, with_decoded: bool = True) -> DataFrame:
    """Token count and digests of every whole text, beside the key columns (name to type).

    ``tokenizer`` is the path of the tokenizer file, read where the plan is made and sent to the tasks once. NULL and
    empty texts have no tokens: count 0 and the digests of the empty text. Repeated rows give a row each.
    ``with_ids`` adds the ids and, unless ``with_decoded`` is false, the decoded text. Texts with an unsplit run of ``part`` bytes or more are encoded in
    several tasks, equal ones once; no other text is shuffled.
    """
    # what a task has seen stays with the broadcast model in its worker, for the tasks that follow there
    shipped = ship(df.sparkSession, BpeModel(load_spec(tokenizer)))
    results = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        results += ", ids array<int>" + (", decoded string" if with_decoded else "")

    def digests(pairs: list[tuple[str, str]]) -> tuple:
        """The result's values of one text, from (ids, names) of its pieces in order."""
        ids, decoded = " ".join([a for a, _ in pairs]), " ".join([b for _, b in pairs])
        row = ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()
        if not with_ids:
            return row
        numbers = np.fromstring(ids, np.int32, sep=" ") if ids else np.empty(0, np.int32)  # no object for each id
        return (*row, numbers, decoded) if with_decoded else (*row, numbers)

    def whole():
        model = shipped()
        table = model.words

        def step(*columns):
            rows = [digests(list(map(table.__getitem__, model.chunks(value or "")))) for value in columns[-1]]
            return [*columns[:-1], *map(list, zip(*rows))]

        return step

    def joined():
        written = shipped().written

        def step(names, tokens):
            rows = [digests([(written[token], token) for token in own]) for own in tokens]
            return [names, *map(list, zip(*rows))]

        return step

    named = [F.col(f"`{name}`").cast(kind).alias(f"k{i}") for i, (name, kind) in enumerate(keys.items())]
    frame, value = df.select(*named, text.alias("t")), F.col("t")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in keys.items()) + ", " + results
    plain = map_columns(frame.where(~has_long_run(value, part)), [F.col(c) for c in frame.columns], schema, whole)

    long = frame.where(has_long_run(value, part)).withColumn("s", F.sha2(value, 256))
    parts = encode_parts(long.select("s", "t").dropDuplicates(["s"]), shipped, part)
    found = map_columns(join_parts(parts, shipped), [F.col("s"), F.col("tokens")], "s string, " + results, joined)
    own = long.drop("t").join(found, "s").drop("s")
    return plain.unionByName(own.toDF(*plain.columns))
