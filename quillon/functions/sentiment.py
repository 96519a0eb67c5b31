"""Sentiment of sentences and documents from word lists.

Lists are data: callers give a DataFrame or mapping of their own; a small
English and Finnish list is included so that the functions work as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .analyzer import small_batches

#: Hand-written examples; class 1 positive, -1 negative, 0 neutral.
ENGLISH = {1: "good great excellent happy wonderful love nice best beautiful :) :-)".split() + ["well done"], -1: "bad awful terrible sad hate worst ugly worthless stupid idiot trash scum :( :-(".split() + ["waste of time"], 0: "okay average ordinary".split()}
FINNISH = {1: "hyvä loistava iloinen ihana kaunis paras :)".split(), -1: "huono kamala surullinen ruma typerä :(".split(), 0: "tavallinen keskiverto".split()}
#: Dots in these end no sentence.
ABBREVIATIONS = tuple(f" {w}" for w in "approx. dr. e.g. etc. fig. i.e. jr. mr. mrs. ms. no. prof. sr. st. vs. esim. jne. mm. ns. yms.".split())
MIN_SENTENCE = 8
#: Entries up to which a text is searched for them before it is taken apart.
FEW_ENTRIES = 64
_MARKS = re.compile(r'[:"/()_\[\];&^@<>\\´”]| -|- ')


@dataclass(frozen=True)
class Lexicon:
    """Words, phrases and smileys with their class; the first class that names an entry keeps it (negative, neutral, positive)."""

    words: dict[str, int] = field(default_factory=dict)
    phrases: dict[str, int] = field(default_factory=dict)
    smileys: dict[str, int] = field(default_factory=dict)

    @cached_property
    def signs(self) -> list[str] | None:
        """Strings of which a lower-case text has one if it has an entry; None if they tell too little or are too many."""
        out = {*self.words, *self.smileys, *(e.split()[0] for e in self.phrases)}
        return None if len(out) > FEW_ENTRIES or any(re.search(r"[?!.,;\s]", e) for e in out) else sorted(out)

    @staticmethod
    def of(lists: dict[int, list[str]]) -> Lexicon:
        """From entries by class; one-byte words are dropped."""
        out = Lexicon()
        for c in (-1, 0, 1):
            for e in lists.get(c, ()):
                e = e.strip().lower()
                if len(e.encode()) < 2:
                    continue
                kind = out.phrases if " " in e else out.smileys if re.search(r"[^\w\s'\-]", e) or not re.search(r"\w", e) else out.words
                kind.setdefault(e, c)
        return out


def score_sentence(sentence: str, lexicon: Lexicon) -> tuple[dict[int, int], Counter, bool]:
    """Counts by class (from 1 on), tokens, and whether anything was found."""
    s = " " + re.sub(r"\r\n|[?!.,]", " ", sentence).lower() + " "
    counts = {-1: 1, 0: 1, 1: 1}
    hit = False
    for e, c in lexicon.smileys.items():
        n = s.count(e)
        if n:
            s, hit = s.replace(e, " "), True
            counts[c] += n
    s = _MARKS.sub(" ", s)
    found: list[str] = []
    for e, c in lexicon.phrases.items():
        n = s.count(f" {e} ")
        if n:
            s, hit = s.replace(f" {e} ", " "), True
            counts[c] += n
            found += e.split()
    tokens = Counter({t: 1 for t in found})
    for t, n in Counter(s.split(" ")).items():
        tokens.setdefault(t, n)
    for t, n in tokens.items():
        if t in lexicon.words:
            counts[lexicon.words[t]] += n
            hit = True
    return counts, tokens, hit


def class_shares(sentence: str, lexicon: Lexicon) -> dict[int, float]:
    """Share of each class in a sentence, with equal priors."""
    counts, _, _ = score_sentence(sentence, lexicon)
    total = sum(counts.values())
    return {c: n / total for c, n in counts.items()}


def score_document(text: str, lexicon: Lexicon) -> tuple[int, dict[str, int]]:
    """Sum of the sentences' scores, and for each token the sum of those of its sentences.

    A sentence scores positive less negative hits, each less half of the
    neutral ones but not below 0, truncated; it counts only if it had a hit.
    """
    signs = lexicon.signs
    t = re.sub(r"[?!\n\t;]", ".", text).lower()
    if signs is not None and not any(e in t for e in signs):
        return 0, {}
    for e in lexicon.smileys:  # a dot in a smiley ends no sentence
        if "." in e:
            t = t.replace(e, f" {e.replace('.', '')} ")
    for a in ABBREVIATIONS:
        t = t.replace(a, " ")
    total, words, before = 0, {}, ""
    for s in t.split("."):
        s = s.strip()
        if not s:
            continue
        if len(s.encode()) < MIN_SENTENCE:
            before += " " + s
            continue
        s, before = (before + " " + s).strip(), ""
        if signs is not None and not any(e in s for e in signs):
            continue
        counts, tokens, hit = score_sentence(s, lexicon)
        if hit:
            half = max(0, counts[0] - 1) / 2
            average = int(max(0, counts[1] - 1 - half) - max(0, counts[-1] - 1 - half))
            total += average
            for w in tokens:
                if w:
                    words[w] = words.get(w, 0) + average
    return total, words


def clamp(score: int) -> int:
    """To the range of a signed byte."""
    return max(-128, min(127, score))


def lexicons(english: Lexicon | None = None, finnish: Lexicon | None = None) -> dict[str, Lexicon]:
    """The lexicon of each language and mode."""
    en, fi = english or Lexicon.of(ENGLISH), finnish or Lexicon.of(FINNISH)
    return {"1": en, "en": en, "2": fi, "fi": fi}


def document_sentiment(text: Column, lang: Column | None = None, mode: int | str = 1, english: Lexicon | None = None, finnish: Lexicon | None = None) -> Column:
    """Struct of total (clamped) and words (map token to score).

    mode 1 English, 2 Finnish, 1001 by ``lang`` ('en'/1, 'fi'/2; others score 0).
    """
    lists = lexicons(english, finnish)
    small_batches(SparkSession.active())

    @F.pandas_udf("total int, words map<string,int>")
    def run(s: pd.Series, lang: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x in zip(s, lang):
            use = lists.get(str(x) if mode == 1001 else str(mode))
            total, words = score_document(t, use) if use and t else (0, {})
            rows.append((clamp(total), {w: clamp(n) for w, n in words.items()}))
        return pd.DataFrame(rows, columns=["total", "words"])

    return run(text, (lang if lang is not None else F.lit(None)).cast("string"))
