"""Stemmers, syllables, Double Metaphone: plain functions, and pandas UDFs for distinct tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analyzer import FOLDS

# --- English -----------------------------------------------------------------

_V = "(?:[aeiou]|(?<![aeiou])y)"
_C = "(?:[bcdfghjklmnpqrstvwxz]|(?<=[aeiou])y|^y)"
_KEEP = dict(p.split(":") for p in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl".split())
_KEEP |= {w: w for w in "andes atlas bias cosmos howe news sky".split()}
_DONE = frozenset("canning earring exceed herring inning outing proceed succeed".split())


def _rules(text: str) -> list[tuple[str, str]]:
    return [(a, b) for a, _, b in (r.partition(">") for r in text.split())]


#: Endings by the last letter but one, each replaced where enough of the word is left.
_STEP2 = {
    "a": _rules("ational>ate tional>tion"),
    "c": _rules("enci>ence anci>ance"),
    "e": _rules("izer>ize"),
    "g": _rules("logi>log"),
    "l": _rules("lessli>less entli>ent fulli>ful ousli>ous alli>al bli>ble") + [(c + "li", c) for c in "cdeghkmnrt"],
    "o": _rules("ization>ize ation>ate ator>ate"),
    "s": _rules("iveness>ive fulness>ful ousness>ous alism>al"),
    "t": _rules("biliti>ble aliti>al iviti>ive"),
}
_STEP3 = {"a": _rules("ical>ic"), "s": _rules("ness>"), "t": _rules("icate>ic iciti>ic"), "u": _rules("ful>"), "v": _rules("ative>"), "z": _rules("alize>al")}
_STEP4 = {k: _rules(v) for k, v in {"a": "al>", "c": "ance> ence>", "e": "er>", "i": "ic>", "l": "able> ible>", "n": "ant> ement> ment> ent>", "s": "ism>", "t": "ate> iti>", "u": "ous>", "v": "ive>", "z": "ize>"}.items()}


def measure(word: str) -> int:
    """Number of vowel-consonant sequences."""
    body = re.sub(f"^{_C}+", "", word)
    body = re.sub(f"{_V}+$", "", body)
    return len(re.findall(f"{_V}+{_C}+", body))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and bool(re.search(f"{_C}{{2}}$", word))


def _short(word: str) -> bool:
    return bool(re.search(f"{_C}{_V}{_C}$", word)) and word[-1] not in "wxy"


def _apply(word: str, rules: dict, least: int) -> str:
    for ending, new in rules.get(word[-2:-1], ()):
        if word.endswith(ending):
            stem = word[: len(word) - len(ending)]
            return stem + new if measure(stem) > least else word
    return word


def stem_english(word: str) -> str:
    """Porter's stemmer with the exceptions of its second version, no possessives, more -li endings."""
    if len(word.encode()) <= 2:
        return word
    for p in ("'s'", "'s", "'"):
        word = word.replace(p, "")
    if word in _KEEP:
        return _KEEP[word]
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word in _DONE:
        return word
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for ending, cut in (("ingly", 5), ("ing", 3), ("edly", 4), ("ed", 2)):
            if word.endswith(ending) and re.search(_V, word[:-cut]):
                word = word[:-cut]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and not word.endswith(("ll", "ss", "zz")):
                    word = word[:-1]
                elif measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and re.search(_V, word[:-1]):
        word = word[:-1] + "i"
    word = _apply(_apply(word, _STEP2, 0), _STEP3, 0)
    if word[-2:-1] == "o":
        word = _apply(word, {"o": [("ion", "")] if word.endswith(("tion", "sion")) else [("ou", "")]}, 1)
    else:
        word = _apply(word, _STEP4, 1)
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


# --- Finnish -----------------------------------------------------------------

_FI_VOWELS = set("aeiouyøäåö")
_FI_CONSONANTS = set("bcdfghjklmnŋprsštvʃzžʒ")
_GLIDES = set("iy ey äy öy iu eu au ou ui yi öi äi oi ei ai".split())
_OPENING = {"uo", "yö", "ie"}


def syllables(word: str) -> list[str]:
    """Finnish syllables: a break between vowels that form no diphthong, and before a consonant with its vowel."""
    out: list[str] = []
    back = 0
    for i in range(len(word) - 1):
        pair = word[i : i + 2]
        if pair[0] in _FI_VOWELS and pair[1] in _FI_VOWELS and pair not in _GLIDES and (pair not in _OPENING or out):
            out.append(word[back : i + 1])
            back = i + 1
        elif i > 0 and pair[0] in _FI_CONSONANTS and pair[1] in _FI_VOWELS:
            out.append(word[back:i])
            back = i
    return [*out, word[back:]]


def stem_finnish(word: str) -> str:
    """The word without its last syllable, if two stay; lengthened to a second consonant where it has one only."""
    word = word.strip()
    parts = syllables(word)
    if len(parts) < 3:
        return word
    stem = "".join(parts[:-1])
    cons = [c in _FI_CONSONANTS for c in word]
    if sum(cons[: len(stem)]) == 1 and sum(cons) > 1:
        for i in range(len(stem), len(word)):
            if i + 1 == len(word) and cons[i]:
                break
            stem += word[i]
            if cons[i]:
                break
    return stem


def stem_keyword(token: str, prefix_length: int = 3, minimum_quality: int = 0) -> tuple[str, int]:
    """The shorter of both stems that is a prefix of the token, and its length; ('', length) without one."""
    n = least = len(token)
    stem = ""
    en, fi = stem_english(token), stem_finnish(token)
    if token.startswith(en) and prefix_length <= len(en) <= least:
        stem, least = en, len(en)
    if token.startswith(fi) and prefix_length <= len(fi) <= least and len(fi) > n / 2:
        stem, least = fi, len(fi)
    if minimum_quality:
        need = -(-n * minimum_quality // 100)
        if least < need:
            stem = token[:need]
            least = need
    return stem, least


# --- Double Metaphone --------------------------------------------------------


def double_metaphone(word: str, size: int = 4) -> tuple[str, str]:
    """Primary and secondary code of Lawrence Philips' Double Metaphone, cut to ``size``."""
    w = word.upper()
    n, last = len(w), len(w) - 1
    slavic = any(x in w for x in ("W", "K", "CZ", "WITZ"))
    one: list[str] = []
    two: list[str] = []

    def at(i: int, *options: str) -> bool:
        return i >= 0 and any(w.startswith(o, i) for o in options)

    def ch(i: int) -> str:
        return w[i] if 0 <= i < n else ""

    def vowel(i: int) -> bool:
        return ch(i) != "" and ch(i) in "AEIOUY"

    def add(a: str, b: str | None = None) -> None:
        one.append(a)
        two.append(a if b is None else b)

    i = 1 if at(0, "GN", "KN", "PN", "WR", "PS") else 0
    if ch(0) == "X":
        add("S")
        i = 1
    while i < n and (sum(map(len, one)) < size or sum(map(len, two)) < size):
        c = w[i]
        step = 1
        if c in "AEIOUY":
            if i == 0:
                add("A")
        elif c == "B":
            add("P")
            step = 2 if ch(i + 1) == "B" else 1
        elif c == "Ç":
            add("S")
        elif c == "C":
            if i > 1 and not vowel(i - 2) and at(i - 1, "ACH") and ch(i + 2) != "I" and (ch(i + 2) != "E" or at(i - 2, "BACHER", "MACHER")):
                add("K")
                step = 2
            elif i == 0 and at(i, "CAESAR"):
                add("S")
                step = 2
            elif at(i, "CHIA"):
                add("K")
                step = 2
            elif at(i, "CH"):
                step = 2
                if i > 0 and at(i, "CHAE"):
                    add("K", "X")
                elif i == 0 and at(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not at(0, "CHORE"):
                    add("K")
                elif at(0, "VAN ", "VON ", "SCH") or at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or ch(i + 2) in ("T", "S") or ((ch(i - 1) in ("A", "O", "U", "E") or i == 0) and (ch(i + 2) in tuple("LRNMBHFVW ") or i + 2 > last)):
                    add("K")
                elif i > 0:
                    add("K") if at(0, "MC") else add("X", "K")
                else:
                    add("X")
            elif at(i, "CZ") and not at(i - 2, "WICZ"):
                add("S", "X")
                step = 2
            elif at(i + 1, "CIA"):
                add("X")
                step = 3
            elif at(i, "CC") and not (i == 1 and ch(0) == "M"):
                if ch(i + 2) in ("I", "E", "H") and not at(i + 2, "HU"):
                    add("KS") if (i == 1 and ch(0) == "A") or at(i - 1, "UCCEE", "UCCES") else add("X")
                    step = 3
                else:
                    add("K")
                    step = 2
            elif at(i, "CK", "CG", "CQ"):
                add("K")
                step = 2
            elif at(i, "CI", "CE", "CY"):
                add("S", "X") if at(i, "CIO", "CIE", "CIA") else add("S")
                step = 2
            else:
                add("K")
                if at(i + 1, " C", " Q", " G"):
                    step = 3
                elif ch(i + 1) in ("C", "K", "Q") and not at(i + 1, "CE", "CI"):
                    step = 2
        elif c == "D":
            if at(i, "DG"):
                if ch(i + 2) in ("I", "E", "Y"):
                    add("J")
                    step = 3
                else:
                    add("TK")
                    step = 2
            else:
                add("T")
                step = 2 if at(i, "DT", "DD") else 1
        elif c in "FKNQVM":
            add({"Q": "K", "V": "F"}.get(c, c))
            step = 2 if ch(i + 1) == c or (c == "M" and at(i - 1, "UMB") and (i + 1 == last or at(i + 2, "ER"))) else 1
        elif c == "Ñ":
            add("N")
        elif c == "G":
            if ch(i + 1) == "H":
                step = 2
                if i > 0 and not vowel(i - 1):
                    add("K")
                elif i == 0:
                    add("J") if ch(i + 2) == "I" else add("K")
                elif (i > 1 and ch(i - 2) in ("B", "H", "D")) or (i > 2 and ch(i - 3) in ("B", "H", "D")) or (i > 3 and ch(i - 4) in ("B", "H")):
                    pass
                elif i > 2 and ch(i - 1) == "U" and ch(i - 3) in ("C", "G", "L", "R", "T"):
                    add("F")
                elif i > 0 and ch(i - 1) != "I":
                    add("K")
            elif ch(i + 1) == "N":
                step = 2
                if i == 1 and vowel(0) and not slavic:
                    add("KN", "N")
                elif not at(i + 2, "EY") and ch(i + 1) != "Y" and not slavic:
                    add("N", "KN")
                else:
                    add("KN")
            elif at(i + 1, "LI") and not slavic:
                add("KL", "L")
                step = 2
            elif i == 0 and (ch(1) == "Y" or at(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
                add("K", "J")
                step = 2
            elif (at(i + 1, "ER") or ch(i + 1) == "Y") and not at(0, "DANGER", "RANGER", "MANGER") and ch(i - 1) not in ("E", "I") and not at(i - 1, "RGY", "OGY"):
                add("K", "J")
                step = 2
            elif ch(i + 1) in ("E", "I", "Y") or at(i - 1, "AGGI", "OGGI"):
                step = 2
                if at(0, "VAN ", "VON ", "SCH") or at(i + 1, "ET"):
                    add("K")
                else:
                    add("J") if w[i + 1 :].startswith("IER") and i + 4 > last else add("J", "K")
            else:
                add("K")
                step = 2 if ch(i + 1) == "G" else 1
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                add("H")
                step = 2
        elif c == "J":
            if at(i, "JOSE") or at(0, "SAN "):
                add("H") if (i == 0 and ch(i + 4) in (" ", "")) or at(0, "SAN ") else add("J", "H")
            else:
                if i == 0:
                    add("J", "A")
                elif vowel(i - 1) and not slavic and ch(i + 1) in ("A", "O"):
                    add("J", "H")
                elif i == last:
                    add("J", "")
                elif ch(i + 1) not in ("L", "T", "K", "S", "N", "M", "B", "Z") and ch(i - 1) not in ("S", "K", "L"):
                    add("J")
                step = 2 if ch(i + 1) == "J" else 1
        elif c == "L":
            if ch(i + 1) == "L":
                step = 2
                spanish = (i == n - 3 and at(i - 1, "ILLO", "ILLA", "ALLE")) or ((at(last - 1, "AS", "OS") or ch(last) in ("A", "O")) and at(i - 1, "ALLE"))
                add("L", "") if spanish else add("L")
            else:
                add("L")
        elif c == "P":
            if ch(i + 1) == "H":
                add("F")
                step = 2
            else:
                add("P")
                step = 2 if ch(i + 1) in ("P", "B") else 1
        elif c == "R":
            if i == last and not slavic and at(i - 2, "IE") and not at(i - 4, "ME", "MA"):
                add("", "R")
            else:
                add("R")
            step = 2 if ch(i + 1) == "R" else 1
        elif c == "S":
            if at(i - 1, "ISL", "YSL"):
                pass
            elif i == 0 and at(i, "SUGAR"):
                add("X", "S")
            elif at(i, "SH"):
                add("S") if at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else add("X")
                step = 2
            elif at(i, "SIO", "SIA", "SIAN"):
                add("S") if slavic else add("S", "X")
                step = 3
            elif (i == 0 and ch(1) in ("M", "N", "L", "W")) or ch(i + 1) == "Z":
                add("S", "X")
                step = 2 if ch(i + 1) == "Z" else 1
            elif at(i, "SC"):
                step = 3
                if ch(i + 2) == "H":
                    if at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                        add("X", "SK") if at(i + 3, "ER", "EN") else add("SK")
                    else:
                        add("X", "S") if i == 0 and not vowel(3) and ch(3) != "W" else add("X")
                elif ch(i + 2) in ("I", "E", "Y"):
                    add("S")
                else:
                    add("SK")
            else:
                add("", "S") if i == last and at(i - 2, "AI", "OI") else add("S")
                step = 2 if ch(i + 1) in ("S", "Z") else 1
        elif c == "T":
            if at(i, "TION", "TIA", "TCH"):
                add("X")
                step = 3
            elif at(i, "TH", "TTH"):
                step = 2
                add("T") if at(i + 2, "OM", "AM") or at(0, "VAN ", "VON ", "SCH") else add("0", "T")
            else:
                add("T")
                step = 2 if ch(i + 1) in ("T", "D") else 1
        elif c == "W":
            if at(i, "WR"):
                add("R")
                step = 2
            elif i == 0 and (vowel(1) or at(0, "WH")):
                add("A", "F") if vowel(1) else add("A")
            elif (i == last and vowel(i - 1)) or at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, "SCH"):
                add("", "F")
            elif at(i, "WICZ", "WITZ"):
                add("TS", "FX")
                step = 4
        elif c == "X":
            if not (i == last and (at(i - 3, "IAU", "EAU") or at(i - 2, "AU", "OU"))):
                add("KS")
            step = 2 if ch(i + 1) in ("C", "X") else 1
        elif c == "Z":
            if ch(i + 1) == "H":
                add("J")
                step = 2
            else:
                add("S", "TS") if at(i + 1, "ZO", "ZI", "ZA") or (slavic and i > 0 and ch(i - 1) != "T") else add("S")
                step = 2 if ch(i + 1) == "Z" else 1
        i += step
    return "".join(one)[:size], "".join(two)[:size]


_CODES = {c: i for i, c in enumerate(" NKAPTSFLMXRHJ0")}


def metaphone_int(token: str) -> int:
    """The primary code in 16 bits, four a character from the left-padded front; 0 if the folded token is not of ASCII letters."""
    plain = "".join(FOLDS.get(c, c) for c in token)
    if not (plain.isascii() and plain.isalpha()):
        return 0
    code = double_metaphone(plain)[0].rjust(4)
    return sum(_CODES[c] << (4 * i) for i, c in enumerate(code))


def metaphone_text(number: int) -> str | None:
    """The code of a 16-bit number."""
    out = ""
    while number:
        out += " NKAPTSFLMXRHJ0"[number & 15]
        number >>= 4
    return out or None


# --- UDFs: meant for distinct tokens ------------------------------------------


@F.pandas_udf(T.StringType())
def stem_english_udf(s: pd.Series) -> pd.Series:
    """stem_english of each token."""
    return s.map(stem_english, na_action="ignore")


@F.pandas_udf(T.StringType())
def stem_finnish_udf(s: pd.Series) -> pd.Series:
    """stem_finnish of each token."""
    return s.map(stem_finnish, na_action="ignore")


@F.pandas_udf(T.StringType())
def stem_keyword_udf(s: pd.Series) -> pd.Series:
    """The stem that a query would use for each token."""
    return s.map(lambda t: stem_keyword(t)[0], na_action="ignore")


@F.pandas_udf(T.IntegerType())
def metaphone_udf(s: pd.Series) -> pd.Series:
    """metaphone_int of each token."""
    return s.map(metaphone_int, na_action="ignore").astype("Int32")
