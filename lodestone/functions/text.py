"""Query cleaning, the folded and stemmed index tokenizer, and canonical text forms."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = set("aeiou")
#: Suffix tables of the published stemmer (M. F. Porter, 1980), steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """The word as c and v."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in _VOWELS or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy" if len(stem) >= 3 else False


def _swap(w: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else w
    return w


def stem(w: str) -> str:
    """The published Porter stem of a lower-case word."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _shape(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base)):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(text: str) -> str:
    """Case folded, diacritics removed."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def index_tokens(text: str | None) -> list[str]:
    """What the index holds of a text: folded, split at all but letters and digits, stemmed."""
    return [stem(w) for w in re.findall(r"[^\W_]+", fold(text or ""))]


def query_phrases(query: str | None) -> list[list[str]]:
    """A query's terms; one with an underscore is a phrase of adjacent tokens. Repeats stay."""
    terms = re.findall(r"\w+", query or "")
    return [p for p in (index_tokens(t) for t in terms) if p]


#: Bytes of texts of a batch that a worker holds as Python's strings at a time, and words whose stems it keeps.
PIECE, KNOWN = 1 << 20, 100_000


def pieces_of(texts: pa.Array) -> Iterator[list[str | None]]:
    """A batch's texts, about ``PIECE`` bytes at a time or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
        yield texts.slice(lo, hi - lo).to_pylist()
        lo = hi


@F.arrow_udf(T.ArrayType(T.StringType()))
def index_tokens_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each distinct word is stemmed once a task, while they are few; tokens are held by Arrow."""
    known: dict[str, str] = {}
    for texts in batches:
        made = []
        for piece in pieces_of(texts):
            split = [re.findall(r"[^\W_]+", fold(t or "")) for t in piece]
            if len(known) > KNOWN:
                known.clear()
            for w in {w for words in split for w in words} - known.keys():
                known[w] = stem(w)
            ends = np.cumsum([0, *map(len, split)]).astype(np.int32)
            made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array([known[w] for words in split for w in words], pa.string())))
        yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))


def _number(x: float | int) -> str:
    """A number as ECMAScript prints it."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    short = repr(abs(x))
    mantissa, _, e = short.partition("e")
    whole, _, fraction = mantissa.partition(".")
    point = len(whole) + int(e or 0)
    figures = (whole + fraction).lstrip("0")
    point -= len(whole + fraction) - len((whole + fraction).lstrip("0"))
    figures = figures.rstrip("0") or "0"
    n = len(figures)
    if n <= point <= 21:
        out = figures + "0" * (point - n)
    elif 0 < point <= 21:
        out = figures[:point] + "." + figures[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + figures
    else:
        power = point - 1
        out = figures[0] + ("." + figures[1:] if n > 1 else "") + "e" + ("+" if power >= 0 else "-") + str(abs(power))
    return ("-" if x < 0 else "") + out


def canonical_json(value) -> str:
    """RFC 8785: sorted by UTF-16 code units, shortest numbers, no blanks."""
    if value is None:
        return "null"
    if isinstance(value, (bool, int, float)):
        return _number(value)
    if isinstance(value, str):
        if any(0xD800 <= ord(c) <= 0xDFFF for c in value):
            raise ValueError("lone surrogate")
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
    return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in keys) + "}"


def strict_object(text: str) -> dict:
    """Parsed JSON object; duplicate keys, keys not in NFC and keys that collide under NFC are refused at any depth."""

    def pairs(items):
        out = {}
        for k, v in items:
            if unicodedata.normalize("NFC", k) != k:
                raise ValueError("key is not in normal form")
            if k in out:
                raise ValueError("duplicate key")
            out[k] = v
        return out

    def no_constant(name):
        raise ValueError(f"{name} is not JSON")

    value = json.loads(text, object_pairs_hook=pairs, parse_constant=no_constant)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value


@F.pandas_udf(T.BooleanType())
def strict_object_column(text: pd.Series) -> pd.Series:
    """Whether a text is an object that ``strict_object`` takes; null for null."""

    def sound(t: str) -> bool:
        try:
            strict_object(t)
        except ValueError:
            return False
        return True

    return pd.Series([None if t is None else sound(t) for t in text], dtype=object)


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def fixed_text(value: float, decimals: int) -> str:
    """A value at a declared precision; negative zero is zero."""
    out = f"{value:.{decimals}f}"
    return out[1:] if out.startswith("-") and not out.strip("-0.") else out


@F.pandas_udf(T.StringType())
def fixed_text_udf(value: pd.Series, decimals: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(d) else fixed_text(v, int(d)) for v, d in zip(value, decimals, strict=True)], dtype=object)


def nfc_column(text: Column) -> Column:
    """Unicode normal form C; texts without a character from U+0300 on are in it and stay on the JVM side.

    A worker gets nulls in their place: Spark evaluates a Python function for every row, whatever stands around it.
    """
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\u02FF]"), text)), text)


@F.arrow_udf(T.StringType())
def _nfc(text: pa.Array) -> pa.Array:
    made = [pa.array([None if t is None else nfc(t) for t in piece], pa.string()) for piece in pieces_of(text)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())
