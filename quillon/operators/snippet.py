"""Search snippets: the window of a text around the words of a query, marked up."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.html import text_of
from ..functions.linguistics import stem_english, stem_finnish

_ELLIPSIS = " <b>...</b> "


def _hits(text: str, words: list[str], lang: str) -> tuple[dict[str, list[int]], list[str]]:
    places: dict[str, list[int]] = {}
    forms = list(words)
    taken: set[int] = set()
    for w in words:
        exact = w.startswith("=")
        w = w.removeprefix("=")
        if not w:
            continue
        stem = (stem_finnish if lang == "fi" else stem_english)(w)
        stem = stem if stem and w.startswith(stem) else w
        more = len(stem) - 1 if len(stem) - 1 > 4 else len(w) - 1
        pattern = rf"\b{re.escape(w)}\b" if exact and len(w) >= 4 else rf"\b{re.escape(stem)}\w{{0,{max(more, 0)}}}\b"
        for m in re.finditer(pattern, text, re.IGNORECASE):
            if m.start() not in taken:
                taken.add(m.start())
                places.setdefault(w, []).append(m.start())
                forms.append(m.group().lower())
    return places, list(dict.fromkeys(f.removeprefix("=") for f in forms if f.strip("=")))


def _window(text: str, at: float, half: int, size: int, first: bool, last: bool) -> str:
    start = max(0, int(at + half - size / 2))
    before = after = ""
    if start:
        sentence = max(text.rfind(m, max(0, start - 20), int(at)) + 2 for m in (". ", "? ", "! "))
        if sentence > 1:
            start = sentence
        else:
            blank = text.find(" ", start)
            if 0 <= blank < at and blank < start + 10:
                start = blank + 1
            before = "..." if first else ""
    end = start + size
    if end < len(text):
        sentence = max(text.rfind(m, end - 20, end + 20) + 1 for m in (". ", "? ", "! "))
        if sentence > 0:
            end = sentence
        else:
            blank = text.rfind(" ", end - 10, end + 10)
            end = blank if blank > 0 else end
            after = "..." if last else ""
    return before + text[start:end].strip() + after


def focus(text: str, query: str, lang: str = "en", wrap: int = 90, longest: int = 150) -> str:
    """The part of a text that shows the query's words, which are put in <b>.

    The query as a whole is looked for first, then its words and longer forms
    of their stems.  A text over ``longest`` characters is cut to one window
    about the hits, or to two joined by an ellipsis where they lie apart; cuts
    go to the end of a sentence within 20 characters, or a blank within 10.
    """
    query = re.sub(r"[,;!?]", " ", query)
    half = len(query.strip()) // 2
    text = re.sub(r"\s+", " ", text_of(text)).strip()
    words = list(dict.fromkeys(w for w in query.lower().split(" ") if w))
    whole = re.search(rf"\b{re.escape(query.strip())}\b", text, re.IGNORECASE) if len(words) > 1 else None
    if whole and whole.start():
        places, forms = {}, words
        centres: list[float] = [whole.start()]
    else:
        places, forms = _hits(text, words, lang)
        centres = [0.0]
    if len(text) > longest:
        if places:
            first, last = [p[0] for p in places.values()], [p[-1] for p in places.values()]
            target = max(first) if max(first) - min(first) <= max(last) - min(last) or len(places) == 1 else max(last)
            near = [min(p, key=lambda x: abs(x - target)) for p in places.values()]
            low, high = min(near), max(near)
            centres = [sum(near) / len(near)] if high - low + 2 * half + 20 < longest else [low, high]
        size = longest // len(centres)
        text = _ELLIPSIS.join(_window(text, c, half, size, k == 0, k == len(centres) - 1) for k, c in enumerate(centres))
    else:
        text = "<br/>\n".join(textwrap.wrap(text, wrap, break_long_words=False, break_on_hyphens=False)) or text
    if forms:
        pattern = "|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True))
        text = re.sub(rf"\b({pattern})\b(?![^<]*>)", r"<b>\1</b>", text, flags=re.IGNORECASE)
    return text


def snippet(text: Column, query: str, lang: str = "en", wrap: int = 90, longest: int = 150) -> Column:
    """focus as a Column; meant for a page of results."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: focus(t, query, lang, wrap, longest), na_action="ignore")

    return run(text)
