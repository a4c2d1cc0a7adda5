"""Problem 1: one consistent form for texts that read the same.

Arrow text is copied into numpy code-point arrays; a lookup table gives every code point its
expansion (width, ligature, radical, compatibility-ideograph and canonical decompositions), a second
one maps letters drawn alike, invisible code points are dropped, and marks are put in canonical
order and composed with vector operations only.

Kept apart on purpose: letter case, accents, punctuation marks, super- and subscripts, circled
figures, fractions, and characters that merely resemble each other.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import checkpointed
from .arrowtext import codepoints, row_ids, slices, to_arrow

_TOP = 0x30000  #: above it only the tag and variation planes change, and they vanish

#: Letters of other scripts (Greek, Cyrillic, Armenian, Cherokee, Lisu, Coptic) and phonetic letters whose
#: usual glyph is that of a Latin letter.  A letter that only resembles one (κ/k, ρ/p, п/n, ı/i, and I/l, 0/O inside one
#: script) is left out: a reader can tell them apart.
_ALIKE = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐⲂ", "C": "СᏟꓚϹⲤ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "ꓝϜ", "G": "ԌꓖᏀ", "H": "ΗНᎻꓧⲎ",
    "I": "ΙІӀⲒ", "J": "ЈᎫꓙ", "K": "ΚКᏦꓗⲔ", "L": "Ꮮꓡ", "M": "ΜМᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ΟОՕꓳⲞ", "P": "ΡРᏢꓑⲢ",
    "Q": "Ԛ", "R": "ꓣᎡ", "S": "ЅՏꓢᏚ", "T": "ΤТᎢꓔⲦ", "U": "Սꓴ", "V": "ᏙꓦѴ", "W": "ᎳꓪԜ", "X": "ΧХꓫⲬ",
    "Y": "ΥҮꓬУⲨ", "Z": "ΖᏃꓜ", "a": "а", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "οоօⲟ", "p": "рⲣ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у", "-": "‐", "’": "ʼ",
}
#: Kana drawn like a Han character (or hiragana); the neighbours decide which form is kept.
_KANA = {"エ": "工", "ニ": "二", "ロ": "口", "カ": "力", "タ": "夕", "ハ": "八", "ト": "卜", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ"}
#: Compatibility characters whose look differs from their expansion.
_LOOKS_OTHER = {0x17F, 0x2135, 0x2136, 0x2137, 0x2138, *range(0x3D0, 0x3D7), *range(0x3F0, 0x3F7)} - {0x3F2, 0x3F3}
_SAME = {"<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<small>"}


def _expand(cp: int) -> list[int]:
    """The full decomposition of a code point over the mappings that leave its look unchanged."""
    parts = unicodedata.decomposition(chr(cp)).split()
    if not parts:
        return [cp]
    if parts[0][0] == "<":
        tag, parts = parts[0], parts[1:]
        if tag == "<compat>":
            letters = all(unicodedata.category(chr(int(p, 16)))[0] == "L" for p in parts)
            joined = unicodedata.category(chr(cp))[0] in "L" or 0x2E80 <= cp <= 0x2FDF or 0x2160 <= cp <= 0x217F
            if cp in _LOOKS_OTHER or not (letters and joined):
                return [cp]
        elif tag not in _SAME:
            return [cp]
    return [x for p in parts for x in _expand(int(p, 16))]


def _invisible(cp: int) -> bool:
    c = chr(cp)
    if unicodedata.category(c) == "Cf":
        return not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD))
    if unicodedata.category(c) == "Cc":
        return c not in "\t\n\v\f\r\x1c\x1d\x1e\x85"
    return cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F


@lru_cache(1)
def _tables() -> dict[str, np.ndarray]:
    length, start, flat = np.ones(_TOP, np.uint8), np.arange(_TOP, dtype=np.int64), [np.arange(_TOP, dtype=np.uint32)]
    more, pairs = [], {}
    ccc, gone = np.zeros(_TOP, np.uint8), np.zeros(_TOP, bool)
    alike = {ord(o): ord(k) for k, others in _ALIKE.items() for o in others}
    alike |= {0x309B: 0x3099, 0x309C: 0x309A}
    for cp in range(_TOP):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x4E00 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x2F7FF:
            continue  # Hangul is composed by rule; the others never change
        c = chr(cp)
        ccc[cp], gone[cp] = unicodedata.combining(c), _invisible(cp)
        own = unicodedata.decomposition(c)
        if own and own[0] != "<" and " " in own and unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)) == c:
            a, b = (int(p, 16) for p in own.split())
            pairs[a << 21 | b] = cp
        if unicodedata.category(c) == "Zs" or c == "\t":
            new = [0x20]
        elif c in "\v\f\r\x1c\x1d\x1e\x85  ":
            new = [0x0A]
        else:
            new = [alike.get(x, x) for x in _expand(cp)]
        if new != [cp]:
            length[cp], start[cp] = len(new), _TOP + len(more)
            more += new
    keys = np.array(sorted(pairs), np.int64)
    kana, han = np.array([ord(k) for k in _KANA], np.uint32), np.array([ord(v) for v in _KANA.values()], np.uint32)
    return {
        "length": length, "start": start, "flat": np.concatenate([*flat, np.array(more, np.uint32)]), "ccc": ccc, "gone": gone,
        "keys": keys, "made": np.array([pairs[k] for k in keys.tolist()], np.uint32), "kana": kana, "han": han,
    }


def _compose(cps: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition over the whole batch, never across rows."""
    low = np.minimum(cps, _TOP - 1)
    ccc = t["ccc"][low]
    marks = np.flatnonzero(ccc)
    made, keys = t["made"], t["keys"]

    def lookup(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 21 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, made[at], 0).astype(np.uint32)

    keep = np.ones(len(cps), bool)
    if len(marks):
        cps = cps.copy()
        begins = np.ones(len(marks), bool)
        begins[1:] = (np.diff(marks) != 1) | (rows[marks[1:]] != rows[marks[:-1]])
        run = np.cumsum(begins) - 1
        order = np.argsort(run.astype(np.int64) * 256 + ccc[marks], kind="stable")
        cps[marks] = cps[marks[order]]
        ccc[marks] = ccc[marks[order]]
        first = marks[begins]
        base = first - 1
        based = (base >= 0) & (rows[np.maximum(base, 0)] == rows[first])
        nth = np.arange(len(marks)) - np.flatnonzero(begins)[run]
        blocked = np.zeros(len(first), np.int64)
        for n in range(int(nth.max()) + 1):
            at = np.flatnonzero((nth == n) & based[run])
            of, mark = run[at], marks[at]
            new = lookup(cps[base[of]], cps[mark])
            ok = (new > 0) & (blocked[of] < ccc[mark])
            cps[base[of[ok]]] = new[ok]
            keep[mark[ok]] = False
            blocked[of[~ok]] = ccc[mark[~ok]]
        cps, rows = cps[keep], rows[keep]
    for again in range(2):  # starters: Hangul syllables by rule, a few Indic vowels by table
        if len(cps) < 2:
            break
        a, b, near = cps[:-1].astype(np.int64), cps[1:].astype(np.int64), rows[:-1] == rows[1:]
        odd = near & ((b >= 0x1161) & (b <= 0x11C2) | (b >= 0x9BE) & (b <= 0x1B35) & (t["ccc"][np.minimum(b, _TOP - 1)] == 0))
        if not odd.any():
            break
        lv = near & (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        s = a - 0xAC00
        lvt = near & (s >= 0) & (s < 11172) & (s % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        new = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, np.where(lvt, a + b - 0x11A7, np.where(odd, lookup(a, b), 0)))
        hit = new > 0
        hit[1:] &= ~hit[:-1]
        cps = cps.copy()
        cps[:-1][hit] = new[hit]
        stay = np.concatenate([[True], ~hit])
        cps, rows = cps[stay], rows[stay]
    return cps, rows


def _settle_kana(cps: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Kana drawn like Han: kana form next to sure katakana, else the Han (hiragana) form."""
    kana, han = t["kana"], t["han"]
    either = np.isin(cps, np.concatenate([kana, han]))
    if not either.any():
        return cps
    at = np.flatnonzero(either)
    sure = (cps >= 0x30A1) & (cps <= 0x30FE) & (cps != 0x30FB) & ~either
    where = np.arange(len(cps))
    left = np.maximum.accumulate(np.where(either, -1, where))[at]
    right = np.minimum.accumulate(np.where(either, len(cps), where)[::-1])[::-1][at]
    def is_sure(i: np.ndarray) -> np.ndarray:
        ok = (i >= 0) & (i < len(cps))
        j = np.where(ok, i, 0)
        return ok & sure[j] & (rows[j] == rows[at])
    to_kana = is_sure(left) | is_sure(right)
    cps = cps.copy()
    old = cps[at]
    new = old.copy()
    for k, h in zip(kana, han):
        new[(old == k) | (old == h)] = h
        new[((old == k) | (old == h)) & to_kana] = k
    cps[at] = new
    return cps


def normalize_codepoints(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of a batch: code points and offsets."""
    t = _tables()
    n, rows = len(offsets) - 1, row_ids(offsets)
    high = cps >= 0xE0000
    keep = ~high & ~t["gone"][np.minimum(cps, _TOP - 1)]
    keep |= high & (cps >= 0xE1000)
    if len(cps) > 1:  # CR LF is one line break
        keep[:-1] &= ~((cps[:-1] == 13) & (cps[1:] == 10) & (rows[:-1] == rows[1:]))
    cps, rows = cps[keep], rows[keep]
    low = cps < _TOP
    idx = np.where(low, cps, 0)
    length = np.where(low, t["length"][idx], 1).astype(np.int64)
    if (length != 1).any():
        ends = np.cumsum(length)
        inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
        src = np.repeat(np.where(low, t["start"][idx], 0), length) + inner
        out = np.where(np.repeat(low, length), t["flat"][np.minimum(src, len(t["flat"]) - 1)], np.repeat(cps, length))
        cps, rows = out.astype(np.uint32), np.repeat(rows, length)
    else:
        cps = np.where(low, t["flat"][t["start"][idx]], cps).astype(np.uint32)
    cps, rows = _compose(cps, rows, t)
    cps = _settle_kana(cps, rows, t)
    return cps, np.searchsorted(rows, np.arange(n + 1)).astype(np.int64)


def normalize_arrow(column) -> pa.Array:
    """The consistent form of an Arrow string column; null stays null, empty stays empty."""
    cps, offsets, valid = codepoints(column)
    return to_arrow(*normalize_codepoints(cps, offsets), valid)


def with_normal_form(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with column ``to`` = the consistent form of ``column``.  ``to`` must be a new name (ValueError otherwise).

    Null stays null; empty and blank texts keep their blanks; rows, order of columns and all other
    columns are unchanged.
    """
    if to in df.columns:
        raise ValueError(f"column {to} exists")
    schema = StructType([*df.schema.fields, StructField(to, StringType())])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, [at]):
                yield pa.RecordBatch.from_arrays([*part.columns, normalize_arrow(part.column(at))], names=[*part.schema.names, to])

    return df.mapInArrow(run, schema)


def real_text(c: Column) -> Column:
    """True for a comment that holds text: not null, not empty, not the literal ``nan``."""
    return c.isNotNull() & (F.length(F.trim(c)) > 0) & (c != "nan")


def keyed_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, s1, s2) of every record once: 128-bit keys of its consistent form and of its spelling.

    Repeated rows of an id count once (the texts of an id are equal; were they not, the smallest is
    taken).  Null, empty and ``nan`` texts take no part.  No text travels beyond this.
    """
    one = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw")).where(real_text(F.col("raw")) & F.col("doc_id").isNotNull())
    one = with_normal_form(one.groupBy("doc_id").agg(F.min("raw").alias("raw")), "raw", "form")
    key = lambda c, n: F.xxhash64(c, F.lit(n))
    return one.select("doc_id", key("form", 1).alias("k1"), key("form", 2).alias("k2"), key("raw", 1).alias("s1"), key("raw", 2).alias("s2"))


def same_look_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "comment") -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) of records with unequal strings and the same consistent form.

    Forms with one spelling, however many records share it, are dropped by a pre-aggregated minimum and
    maximum; the spellings of each other form are paired, and only then are the records of either
    spelling attached, so no two records of one spelling ever meet.
    """
    rows = checkpointed(keyed_forms(df, id_col, text_col))
    span = rows.groupBy("k1", "k2").agg(*[f(c).alias(f"{n}_{c}") for c in ("s1", "s2") for n, f in (("lo", F.min), ("hi", F.max))])
    mixed = span.where("lo_s1 <> hi_s1 or lo_s2 <> hi_s2").select("k1", "k2")
    members = checkpointed(rows.join(mixed, ["k1", "k2"], "left_semi"))
    spellings = members.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("s1", "s2"))).alias("g"))
    pairs = spellings.select("k1", "k2", F.posexplode("g").alias("i", "x"), "g").select("k1", "k2", "x", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("y"))
    pairs = pairs.select("k1", "k2", F.col("x.s1").alias("s1"), F.col("x.s2").alias("s2"), "y")
    left = pairs.join(members.withColumnRenamed("doc_id", "a"), ["k1", "k2", "s1", "s2"]).select("a", "k1", "k2", F.col("y.s1").alias("s1"), F.col("y.s2").alias("s2"))
    found = left.join(members.withColumnRenamed("doc_id", "b"), ["k1", "k2", "s1", "s2"])
    return found.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
