"""Keywords in texts: many patterns at once, drawn-out letters, small differences, weights by configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_RUN = re.compile(r"(.)\1+", re.DOTALL)
#: Letters that a pattern needs, without repeats, for each difference it bears.
LETTERS_A_DIFFERENCE = 5


@dataclass(frozen=True)
class Keyword:
    """What a name stands for: its weight, patterns of one or more words, and the differences they bear (by their length if null)."""

    name: str
    weight: float
    patterns: tuple[str, ...]
    differences: int | None = None


def keywords_of(config: dict) -> list[Keyword]:
    """Out of a configuration's mapping: name -> weight, patterns and, if given, differences. ValueError for what makes no sense."""
    out = []
    for name, x in config.items():
        if not isinstance(x, dict) or not x.get("patterns") or isinstance(x.get("weight"), (bool, str, type(None))):
            raise ValueError(f"keywords.{name}: a weight and patterns are needed")
        out.append(Keyword(str(name), float(x["weight"]), tuple(map(str, x["patterns"])), x.get("differences")))
    return out


def collapsed(word: str) -> str:
    """Runs of a letter as one."""
    return _RUN.sub(r"\1", word)


def words_of(text: str) -> list[str]:
    return [collapsed(w) for w in _WORD.findall(text.lower())]


#: Distinct words that a worker remembers.
_HELD = 1 << 18


class Automaton:
    """All patterns at once: each distinct word is compared with the patterns' words, and is remembered with the states it leads to.

    A difference is a letter more, less or other; spaces bear none, so words of a pattern meet words of a text one by one and their differences
    add up. All words of patterns are one non-deterministic automaton, whose states are bits of an integer, once for each number of differences: a step over a
    character is some shifts and masks, however many patterns there are. It runs only over distinct words that share a piece with a pattern's word of
    about their length: of d + 1 pieces of a word, d differences leave one whole.
    """

    def __init__(self, keywords: list[Keyword]):
        self.starts = self.spaces = 0
        self.letters: dict[str, int] = {}
        self.ends: list[tuple[int, int]] = []  # bit of the last space, which word
        self.patterns: list[tuple[int, int, str, list[int]]] = []  # differences, which keyword, pattern, its words
        self.known: dict[str, dict[int, int] | None] = {}
        self.near: set[str] = set()  # those of the known words that are some pattern's word
        number: dict[str, int] = {}
        bears: dict[str, int] = {}
        for k, keyword in enumerate(keywords):
            for pattern in dict.fromkeys(" ".join(words_of(p)) for p in keyword.patterns):
                if not pattern:
                    raise ValueError(f"keywords.{keyword.name}: a pattern without a word")
                most = keyword.differences if keyword.differences is not None else len(pattern.replace(" ", "")) // LETTERS_A_DIFFERENCE
                own = pattern.split(" ")
                for w in own:
                    bears[w] = max(bears.get(w, 0), most)
                self.patterns.append((most, k, pattern, [number.setdefault(w, len(number)) for w in own]))
        at = 0
        for w, n in number.items():
            self.starts |= 1 << at
            for c in f" {w} ":
                self.letters[c] = self.letters.get(c, 0) | 1 << at
                self.spaces |= (c == " ") << at
                at += 1
            self.ends.append((1 << (at - 1), n))
        self.most = max(bears.values(), default=0)
        self.keywords = keywords
        #: what words of a length hold if they may be near; a pattern's word of no more letters than differences has an empty piece
        pieces: dict[int, set[str]] = {}
        for w, d in bears.items():
            for length in range(max(1, len(w) - d), len(w) + d + 1):
                pieces.setdefault(length, set()).update(self._pieces(w, d + 1))
        self.pieces = {length: re.compile("|".join(sorted(ps))).search for length, ps in pieces.items()}
        self.firsts: dict[int, list[tuple[int, int, str, list[int]]]] = {}
        for p in self.patterns:
            self.firsts.setdefault(p[3][0], []).append(p)

    @staticmethod
    def _pieces(word: str, n: int) -> list[str]:
        cuts = [len(word) * i // n for i in range(n + 1)]
        return [re.escape(word[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _differences(self, word: str) -> dict[int, int] | None:
        """Which of the patterns' words a collapsed word is, and at how many differences; null if none."""
        if len(word) not in self.pieces or not self.pieces[len(word)](word):
            return None
        states = [0] * (self.most + 1)
        letters_only = ~self.spaces
        for c in f" {word} ":
            mask, letter = self.letters.get(c, 0), c != " "
            before, below_before, below = states, 0, 0
            states = []
            for d, state in enumerate(before):
                now = (state << 1 | self.starts) & mask
                if d:
                    if letter:
                        now |= below_before | (below_before << 1) & letters_only
                    now |= (below << 1) & letters_only
                states.append(now)
                below_before, below = state, now
        found = {n: d for bit, n in self.ends if (d := next((d for d, s in enumerate(states) if s & bit), None)) is not None}
        return found or None

    def hits(self, text: str) -> list[tuple[str, str, float, int, int]]:
        """Keyword, pattern, weight, differences and number (from 0) of the first word of each hit, in order; of one keyword at one word the closest pattern."""
        return self.counted_hits(text)[0]

    def counted_hits(self, text: str) -> tuple[list[tuple[str, str, float, int, int]], int]:
        """hits() of a text, and how many words it has."""
        words = _WORD.findall(text.lower())
        distinct = set(words)
        if len(self.known) > _HELD:
            self.known.clear()
            self.near.clear()
        for w in distinct.difference(self.known):
            self.known[w] = self._differences(collapsed(w))
            if self.known[w]:
                self.near.add(w)
        if self.near.isdisjoint(distinct):
            return [], len(words)
        met = [self.known[w] for w in words]
        found: dict[tuple[int, int], tuple[int, int, str]] = {}
        for at, first in enumerate(met):
            if not first:
                continue
            for n in first:
                for most, k, pattern, own in self.firsts.get(n, ()):
                    if at + len(own) > len(met):
                        continue
                    d = 0
                    for i, w in enumerate(own):
                        here = met[at + i]
                        if here is None or w not in here:
                            break
                        d += here[w]
                    else:
                        if d <= most:
                            found[at, k] = min(found.get((at, k), (d, -len(own), pattern)), (d, -len(own), pattern))
        return [(self.keywords[k].name, pattern, self.keywords[k].weight, d, first) for (first, k), (d, _, pattern) in sorted(found.items())], len(words)


def keyword_hits(rows: DataFrame, keywords: list[Keyword], *, text: str = "text", start: str | None = None, end: str | None = None) -> DataFrame:
    """rows without their text, with keyword, pattern, weight, differences, word (from 0) and, given a start, t: a row for each hit.

    t is the start of the text, or, given its end as well, the share of its words before the hit on the way. Null texts have no hits.
    """
    # a text's hits, made in one pass: its words are found once
    kind = "array<struct<keyword: string, pattern: string, weight: double, differences: int, word: int, words: int>>"
    held: list[Automaton] = []

    @F.pandas_udf(kind)
    def find(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Automaton(keywords))
        names = ("keyword", "pattern", "weight", "differences", "word")
        made = [held[0].counted_hits(x) if x else ([], 0) for x in texts]
        return pd.Series([[dict(zip(names, h, strict=True)) | {"words": n} for h in hits] for hits, n in made], dtype=object)

    kept = [c for c in rows.columns if c != text]
    out = rows.withColumn("_h", F.explode(find(F.coalesce(F.col(text), F.lit(""))))).select(*kept, "_h.*")
    if start is None:
        return out.drop("words")
    at: Column = F.col(start).cast("double")
    if end is not None:
        at = at + (F.col(end).cast("double") - at) * F.col("word") / F.col("words")
    return out.withColumn("t", at).drop("words")
