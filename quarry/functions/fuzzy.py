"""Fuzzy matching on Columns: similarity modes, phonetic codes, normalisation profiles."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str) -> float:
    """The Jaro-Winkler measure: a Jaro measure over 0.7 gains by a common prefix of up to four characters."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used = [False] * m
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    k = len(left)
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _grams(s: Column) -> Column:
    p = F.concat(F.lit(" "), s, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda i: F.substring(p, i, F.lit(3))))


def _jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def _tokens(s: Column) -> Column:
    return F.filter(F.split(s, "\\s+"), lambda t: t != "")


def similarity(a: Column, b: Column, mode: str = "JAROWINKLER") -> Column:
    """A score from 0 to 1, letter case aside; null if either text is null."""
    x, y = F.lower(a), F.lower(b)
    mode = mode.upper()
    if mode == "JAROWINKLER":
        return _jaro_winkler(x, y)
    if mode == "LEVENSHTEIN":
        return _edit(x, y)
    if mode == "TRIGRAM":
        return F.when(x.isNotNull() & y.isNotNull(), _jaccard(_grams(x), _grams(y)))
    if mode == "JACCARD":
        return F.when(x.isNotNull() & y.isNotNull(), _jaccard(F.array_distinct(_tokens(x)), F.array_distinct(_tokens(y))))
    if mode == "TOKENSORT":
        return _edit(F.array_join(F.array_sort(_tokens(x)), " "), F.array_join(F.array_sort(_tokens(y)), " "))
    raise ValueError(f"similarity mode {mode!r}")


def _edit(x: Column, y: Column) -> Column:
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x.isNotNull() & y.isNotNull(), F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest))


def difference(a: Column, b: Column) -> Column:
    """Equal places, 0 to 4, of the two soundex codes."""
    same = F.zip_with(F.split(F.soundex(a), ""), F.split(F.soundex(b), ""), lambda x, y: (x == y).cast("int"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(same, F.lit(0), lambda t, v: t + F.coalesce(v, F.lit(0))))


# Words that the profiles drop or expand.
COMPANY_SUFFIXES = "inc incorporated corp corporation co company llc llp ltd limited plc gmbh ag sa srl bv nv pty"
PERSON_WORDS = "mr mrs ms miss dr prof sir jr sr ii iii iv phd md esq"
ADDRESS_WORDS = {"n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "rd": "road", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "sq": "square", "hwy": "highway", "pkwy": "parkway", "ter": "terrace", "cir": "circle"}
UNIT_WORDS = "apt apartment unit suite ste floor fl room rm"


def normalize(s: Column, mode: str | None = None) -> Column:
    """A text without surface variation, by profile: None, COMPANY, PERSON, ADDRESS, PHONE or EMAIL."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), "[\\p{Cntrl}&&[^\\s]]", ""), "\\s+", " "))
    if mode is None:
        return clean
    mode = mode.upper()
    if mode == "EMAIL":
        return F.trim(F.lower(s))
    if mode == "PHONE":
        d = F.regexp_replace(s, "\\D", "")
        return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    bare = F.regexp_replace(clean, "[.,;:'\"#]", "" if mode != "ADDRESS" else " ")
    if mode == "COMPANY":
        out = F.regexp_replace(bare, "\\s*&\\s*", " and ")
        out = F.regexp_replace(out, "\\b(?:the|a|an)\\b", " ")
        for _ in range(2):
            out = F.regexp_replace(F.trim(out), f"\\s+(?:{COMPANY_SUFFIXES.replace(' ', '|')})$", "")
    elif mode == "PERSON":
        out = F.regexp_replace(bare, f"\\b(?:{PERSON_WORDS.replace(' ', '|')})\\b", " ")
    elif mode == "ADDRESS":
        out = F.regexp_replace(bare, f"\\b(?:{UNIT_WORDS.replace(' ', '|')})\\s+\\w+", " ")
        for short, long in ADDRESS_WORDS.items():
            out = F.regexp_replace(out, f"\\b{short}\\b", long)
    else:
        raise ValueError(f"normalize mode {mode!r}")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def metaphone_key(word: str) -> str:
    """The Metaphone key of a word: '0' stands for TH, 'X' for SH and CH."""
    w = re.sub(r"[^A-Z]", "", word.upper())
    w = re.sub(r"(.)\1+", lambda m: m[0] if m[1] == "C" else m[1], w)
    for start, to in (("AE", "E"), ("GN", "N"), ("KN", "N"), ("PN", "N"), ("WR", "R"), ("X", "S"), ("WH", "W")):
        if w.startswith(start):
            w = to + w[len(start) :]
            break
    out, i, n = [], 0, len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    while i < n:
        c, nxt, prev = w[i], at(i + 1), at(i - 1)
        if c in "AEIOU":
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (i == n - 1 and prev == "M"):
                out.append("B")
        elif c == "C":
            if nxt == "I" and at(i + 2) == "A" or nxt == "H":
                out.append("X")
                i += nxt == "H"
            elif nxt and nxt in "IEY":
                if prev != "S":
                    out.append("S")
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if nxt == "G" and at(i + 2) in ("E", "Y", "I") else "T")
        elif c == "G":
            if nxt == "H" and at(i + 2) not in tuple("AEIOU") or nxt == "N" and i + 2 >= n or prev == "D" and nxt and nxt in "EIY":
                pass
            else:
                out.append("J" if nxt and nxt in "EIY" else "K")
        elif c == "H":
            if nxt and nxt in "AEIOU" and (not prev or prev not in "CSPTG"):
                out.append("H")
        elif c == "K":
            if prev != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if nxt == "H" else "P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if nxt == "H" or nxt == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            else:
                out.append("S")
        elif c == "T":
            if nxt == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            elif nxt == "H":
                out.append("0")
            elif not (nxt == "C" and at(i + 2) == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if nxt and nxt in "AEIOU":
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
        i += 1
    return "".join(out)


@F.pandas_udf(T.StringType())
def metaphone(s: pd.Series) -> pd.Series:
    """METAPHONE: the key of each text's letters; null for null."""
    return s.map(lambda x: None if x is None else metaphone_key(x))


def _double(word: str) -> tuple[str, str]:
    """Primary and alternate keys of up to four letters, where the alternate takes other readings of CH, G, J, SCH, TH, W, X and Z."""
    w = re.sub(r"[^A-Z]", "", word.upper())
    for start in ("GN", "KN", "PN", "WR", "PS"):
        if w.startswith(start):
            w = w[1:]
            break
    one, two, i, n = [], [], 0, len(w)

    def add(a: str, b: str | None = None) -> None:
        one.append(a)
        two.append(a if b is None else b)

    def step(i: int) -> int:
        c, rest = w[i], w[i:]
        prev, nxt = w[i - 1 : i], w[i + 1 : i + 2]
        if c in "AEIOUY":
            if i == 0:
                add("A")
            return 1
        if c == "C":
            if rest.startswith("CH"):
                add("K") if i == 0 and rest[:5] in ("CHARA", "CHORU", "CHEMI", "CHIAN") or rest[2:3] in ("R", "L") else add("X", "K")
                return 2
            if rest.startswith(("CIA", "CIO")):
                add("X", "S")
                return 3
            if rest[1:2] in ("I", "E", "Y") and rest[1:2]:
                add("S")
                return 2
            add("K")
            return 2 if nxt and nxt in "CKQ" else 1
        if c == "D":
            if rest.startswith(("DGE", "DGI", "DGY")):
                add("J")
                return 3
            add("T")
            return 2 if nxt and nxt in "DT" else 1
        if c == "G":
            if nxt == "H":
                if i and prev not in "AEIOU":
                    add("K")
                elif i == 0:
                    add("J" if rest[2:3] == "I" else "K")
                elif rest[2:3] == "" or rest[2:3] == "T":
                    pass
                else:
                    add("F" if prev == "U" else "K")
                return 2
            if nxt == "N":
                add("KN", "N") if i == 1 and prev in "AEIOUY" else add("N", "KN")
                return 2
            if nxt and nxt in "EIY":
                add("J", "K") if i else add("K", "J")
                return 2
            add("K")
            return 2 if nxt == "G" else 1
        if c == "H":
            if (i == 0 or prev in "AEIOU") and nxt and nxt in "AEIOU":
                add("H")
                return 2
            return 1
        if c == "J":
            add("J", "H") if rest.startswith("JOSE") else add("J", "A" if i == 0 else "H" if prev in "AEIOU" and nxt in ("A", "O") else "J")
            return 2 if nxt == "J" else 1
        if c == "L":
            add("L")
            return 2 if nxt == "L" else 1
        if c == "M":
            add("M")
            return 2 if nxt == "M" or rest.startswith("MB") and i + 2 >= n else 1
        if c == "P":
            add("F" if nxt == "H" else "P")
            return 2 if nxt and nxt in "HPB" else 1
        if c == "S":
            if rest.startswith("SCH"):
                add("X", "SK") if rest[3:5] in ("ER", "EN") else add("X" if i == 0 else "SK", "S" if i == 0 and rest[3:4] not in tuple("AEIOU") and rest[3:4] != "W" else None)
                return 3
            if nxt == "H":
                add("X")
                return 2
            if rest.startswith(("SIO", "SIA")):
                add("S", "X")
                return 3
            if i == 0 and nxt and nxt in "MNLW" or nxt == "Z":
                add("S", "X")
                return 2 if nxt == "Z" else 1
            add("S")
            return 2 if nxt and nxt in "SZ" else 1
        if c == "T":
            if rest.startswith(("TION", "TIA", "TCH")):
                add("X")
                return 3
            if rest.startswith(("TH", "TTH")):
                add("T") if rest[2:4] in ("OM", "AM") else add("0", "T")
                return 2
            add("T")
            return 2 if nxt and nxt in "TD" else 1
        if c == "W":
            if nxt == "R":
                add("R")
                return 2
            if i == 0 and nxt and (nxt in "AEIOUY" or nxt == "H"):
                add("A", "F" if nxt in "AEIOUY" else "A")
            return 1
        if c == "X":
            add("S") if i == 0 else add("KS")
            return 2 if nxt and nxt in "CX" else 1
        if c == "Z":
            add("S", "TS") if nxt in ("O", "I", "A") and i else add("S")
            return 2 if nxt == "Z" else 1
        add({"Q": "K", "V": "F"}.get(c, c))
        return 2 if nxt == c else 1

    while i < n and (len("".join(one)) < 4 or len("".join(two)) < 4):
        i += step(i)
    return "".join(one)[:4], "".join(two)[:4]


@F.pandas_udf(T.StringType())
def dmetaphone(s: pd.Series) -> pd.Series:
    """DMETAPHONE: the primary key."""
    return s.map(lambda x: None if x is None else _double(x)[0])


@F.pandas_udf(T.StringType())
def dmetaphone_alt(s: pd.Series) -> pd.Series:
    """DMETAPHONE_ALT: the alternate key."""
    return s.map(lambda x: None if x is None else _double(x)[1])
