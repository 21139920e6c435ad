"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980, with his later rules for -bli and -logi) and folding of accents.

Stems are taken once for each distinct term of a table; the same rules as SQL stand beside it for comparison.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Suffixes and what they become, the longest that fits first.
STEP_2 = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "tional": "tion", "biliti": "ble", "entli": "ent", "ousli": "ous",
    "ation": "ate", "alism": "al", "aliti": "al", "iviti": "ive", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "alli": "al", "ator": "ate", "bli": "ble", "eli": "e",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]
SHORTEST, LONGEST = 3, 64


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _kinds(word).count("vc")


def _short_end(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    for suffix, other in rules.items():
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + other if _measure(stem) >= least else word
    return word


def fold(term: str) -> str:
    """The term without accents and other marks."""
    if term.isascii():
        return term
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", term) if unicodedata.category(c)[0] != "M"))


def stem(term: str) -> str:
    """The stem of a lower-case term after folding. Terms of fewer than three bytes or more than 64 stay."""
    w = fold(term)
    if not SHORTEST <= len(w.encode()) <= LONGEST:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                if "v" in _kinds(cut := w[: -len(suffix)]):
                    w = cut
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":  # of two y one is a vowel
                        w = w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP_2, 1), STEP_3, 1)
    for suffix in STEP_4:
        if w.endswith(suffix):
            cut = w[: -len(suffix)]
            if _measure(cut) > 1 and (suffix != "ion" or cut.endswith(("s", "t"))):
                w = cut
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of each distinct term of ``terms``; a null term has none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stem(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["term", "stem"])

    return terms.select("term").filter(F.col("term").isNotNull()).distinct().mapInArrow(each, "term string, stem string")


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME, _MORE, _ONE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
_VOWEL, _SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def sql_steps(source: str) -> dict[str, str]:
    """Common table expressions that end in ``stems`` (term, stem) of the distinct terms of the table ``source``; a y at the beginning is held as Y."""
    has, cut = (lambda suffix: f"ends_with(w, '{suffix}')"), (lambda n: f"left(w, length(w) - {n})")
    fits = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"
    swap = lambda rules, cond: "CASE " + " ".join(f"WHEN {has(s)} THEN CASE WHEN {fits(cut(len(s)), cond)} THEN {cut(len(s))} || '{r}' ELSE w END" for s, r in rules.items()) + " ELSE w END"
    lost = " ".join(
        f"WHEN {has(s)} THEN CASE WHEN {fits(cut(len(s)), _MORE)}{' AND ' + fits(cut(3), '[st]$') if s == 'ion' else ''} THEN {cut(len(s))} ELSE w END" for s in STEP_4
    )
    x = "w[2:]"
    tail = f"""CASE WHEN {fits(x, "(at|bl|iz)$")} THEN {x} || 'e' WHEN length({x}) > 1 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND {fits(x, "[^aeiouylsz]$")}
        THEN left({x}, length({x}) - 1) WHEN {fits(x, _SHORT)} THEN {x} || 'e' ELSE {x} END"""
    steps = [
        f"CASE WHEN {has('sses')} OR {has('ies')} THEN {cut(2)} WHEN {has('s')} AND NOT {has('ss')} THEN {cut(1)} ELSE w END",
        f"""CASE WHEN {has("eed")} THEN CASE WHEN {fits(cut(3), _SOME)} THEN {cut(1)} ELSE w END WHEN {has("ed")} THEN CASE WHEN {fits(cut(2), _VOWEL)} THEN '+' || {cut(2)} ELSE w END
        WHEN {has("ing")} THEN CASE WHEN {fits(cut(3), _VOWEL)} THEN '+' || {cut(3)} ELSE w END ELSE w END""",
        f"CASE WHEN w[1] = '+' THEN {tail} ELSE w END",
        f"CASE WHEN {has('y')} AND {fits(cut(1), _VOWEL)} THEN {cut(1)} || 'i' ELSE w END",
        swap(STEP_2, _SOME), swap(STEP_3, _SOME), f"CASE {lost} ELSE w END",
        f"CASE WHEN {has('e')} AND ({fits(cut(1), _MORE)} OR ({fits(cut(1), _ONE)} AND NOT {fits(cut(1), _SHORT)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN {has('ll')} AND {fits('w', _MORE)} THEN {cut(1)} ELSE w END",
    ]
    parts = {"stem0": f"SELECT term, f, regexp_replace(f, '^y', 'Y') AS w FROM (SELECT term, strip_accents(term) AS f FROM (SELECT DISTINCT term FROM {source}))"}
    for i, step in enumerate(steps):
        parts[f"stem{i + 1}"] = f"SELECT term, f, {step} AS w FROM stem{i}"
    size = "octet_length(encode(f))"
    parts["stems"] = f"SELECT term, CASE WHEN {size} < {SHORTEST} OR {size} > {LONGEST} THEN f ELSE lower(w) END AS stem FROM stem{len(steps)}"
    return parts
