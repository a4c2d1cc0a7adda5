"""Problem 3: per-document text statistics, and an induced rule list that tells prose from the rest.

The statistics are counted once over the flat code points of an Arrow batch (``arrowtext.py``), in the
pass that also makes the consistent form: a table gather gives each code point its class, and counts by
text, line, segment and word are bin counts; no string is made for a row.  An ordered rule list is
induced from labelled documents by incremental reduced-error pruning (``rules.py``), exported as a CASE
expression and applied natively.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import labelled
from .arrowtext import codepoints, row_ids, slices
from .neardup import _mix
from .normalize import normalize_codepoints, real_text
from .rules import Rule, induce, to_case

#: Function words of Chinese and Japanese that are single characters, and words of several languages that join, point or ask.
_FUNCTION_CHARS = "的了是在我也都很就不和有没还这那说去到要会能吗呢吧啊把被给对从跟比又再才只但更最太挺真得过着让他她它们你您与或而且及其之以于为向因所如若虽则并可应该必须已经正将曾刚仍总常极颇稍略较每各某几些谁什么怎哪觉想看问来等做走送换请像当"
_FUNCTION_WORDS = (
    "the a an and or but of to in on at for with from by is are was were be been it its we our you your they their i my me he she his her this that these those not no so as if when while had have has do did very just than then there what which who why how can could will would should all some any out up into about after before again only "
    "der die das und oder aber ein eine einen einer ist sind war waren im in am an auf mit von zu zum zur für nicht wir ich sie er es auch sehr nur nach den dem des wie was wenn dass noch schon bei aus hat haben hatte wird werden man so "
    "el la los las un una y o pero de del al en con por para es era son fue nos lo se su sus muy que no más como cuando donde si ya me mi "
    "le les des du et ou mais dans avec pour est était sont pas nous vous je il elle ils on très qui que ce cette ces ne se sa son ses au aux par sur plus si comme quand où"
)
_TERMINATORS = ".!?…。！？｡।॥～~"
_CLOSERS = "\"'”’」』）)]】»"
_BULLETS = "-*•·●○■□◆◇▪▸►✓✗✔✘☑☐√×+–—"
_BREAKS = "、，,；;。！？!?／/|\t・…"
_ODD = "<>{}[]|=+*/\\^%$#&_@~"
#: The classes a code point may belong to, as bits.
_BITS = ("letter", "cjk", "kana", "digit", "space", "symbol", "odd", "emoji", "terminator", "closer", "bullet", "segment", "function", "upper", "lower", "vowel", "rare", "broken", "sentence")
_BIT = {name: np.uint32(1 << i) for i, name in enumerate(_BITS)}
_TOP = 0x30000
#: What a text's statistics are called, in order.
STATISTICS = (
    "n_chars", "n_words", "n_lines", "n_segments", "n_rows", "mean_word_len", "symbol_ratio", "odd_symbol_ratio", "digit_ratio", "emoji_ratio", "end_punct_share", "item_line_share", "common_ratio",
    "bare_segment_share", "mean_segment_len", "longest_segment", "pair_row_share", "valued_row_share", "mean_line_len", "broken_ratio", "markup_ratio", "repeat_ratio", "distinct_word_ratio", "longest_token", "case_switch_ratio", "vowel_ratio", "rare_ratio", "sentence_marks",
)
_LONGEST_PERIOD = 12  #: repetitions of up to this many characters are seen


def _common_han(codec: str, first: int, last: int) -> set[int]:
    """The first level of a national character set, in which characters stand by how common they are."""
    out = set()
    for lead in range(first, last + 1):
        for trail in range(0x40, 0xFF):
            try:
                c = bytes((lead, trail)).decode(codec)
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out.add(ord(c))
    return out


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class bits, lower-case form) of every code point, and the sorted hashes of the function words."""
    bits, lower = np.zeros(_TOP, np.uint32), np.arange(_TOP, dtype=np.uint32)
    usual = _common_han("gb2312", 0xB0, 0xD7) | _common_han("euc_jp", 0xB0, 0xCF) | _common_han("big5", 0xA4, 0xC6)
    for cp in range(_TOP):
        if 0xAC00 <= cp <= 0xD7A3:
            bits[cp] = _BIT["letter"]
            continue
        if 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp:
            bits[cp] = _BIT["letter"] | _BIT["cjk"] | (0 if cp in usual else _BIT["rare"])
            continue
        if 0xD800 <= cp <= 0xF8FF:
            bits[cp] = _BIT["symbol"] | _BIT["broken"]
            continue
        c, b = chr(cp), np.uint32(0)
        kind = unicodedata.category(c)
        if kind[0] in "LM":
            b |= _BIT["letter"]
            if 0x3040 <= cp <= 0x30FF or cp == 0x3005:
                b |= _BIT["cjk"] | _BIT["kana"]
            b |= _BIT["upper"] if kind == "Lu" else _BIT["lower"] if kind == "Ll" else np.uint32(0)
            plain = unicodedata.normalize("NFD", c)[0].lower()
            b |= _BIT["vowel"] if plain in "aeiouy" else np.uint32(0)
            low = c.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
        elif kind[0] == "N":
            b |= _BIT["letter"] | (_BIT["digit"] if kind == "Nd" else np.uint32(0))
        elif kind[0] == "Z" or c in "\t\n\v\f\r":
            b |= _BIT["space"]
        else:
            b |= _BIT["symbol"]
        if kind == "So" and cp >= 0x2190 or 0x1F000 <= cp <= 0x1FAFF or 0x2190 <= cp <= 0x21FF or 0x25A0 <= cp <= 0x27BF:
            b |= _BIT["emoji"]
        if cp == 0xFFFD or 0x80 <= cp <= 0x9F:
            b |= _BIT["broken"]
        for name, chars in (("odd", _ODD), ("terminator", _TERMINATORS), ("closer", _CLOSERS), ("bullet", _BULLETS), ("segment", _BREAKS), ("sentence", "。！？!?；;")):
            if c in chars:
                b |= _BIT[name]
        bits[cp] = b
    for c in _FUNCTION_CHARS:
        bits[ord(c)] |= _BIT["function"]
    bits[0x3041:0x3097] |= _BIT["function"]  # hiragana: the grammar of a Japanese sentence is written in them
    words = sorted(set(_FUNCTION_WORDS.split()))
    flat = np.array([ord(c) for w in words for c in w], np.uint32)
    starts = np.cumsum([0, *(len(w) for w in words)])[:-1]
    return bits, lower, np.sort(_word_hashes(flat, starts))


def _word_hashes(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points; the runs follow each other without gaps."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(cps)))
    place = np.arange(len(cps)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        return np.add.reduceat(_mix((cps.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1)), starts)


def _runs(mask: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of a mask, which end with their row."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) != 1) | (rows[at[1:]] != rows[at[:-1]])
    begin = np.flatnonzero(first)
    return at[begin], np.diff(np.append(begin, len(at)))


def _pieces(breaks: np.ndarray, rows: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece of each code point or -1, row of each piece, length of each piece): the parts between breaks that hold more than blanks.

    The length is counted from the first to the last code point that is no blank.
    """
    cut = np.zeros(len(rows) + 1, bool)
    cut[1:] = breaks
    cut[1:-1] |= rows[1:] != rows[:-1]
    piece = np.cumsum(cut[:-1])
    keep = solid & ~breaks
    if not keep.any():
        return np.full(len(rows), -1), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(keep)
    first = np.ones(len(at), bool)
    first[1:] = np.diff(piece[at]) != 0
    begin = np.flatnonzero(first)
    number = np.full(int(piece[-1]) + 1, -1)
    number[piece[at[begin]]] = np.arange(len(begin))
    last = np.append(at[begin[1:] - 1], at[-1])
    return np.where(breaks, -1, number[piece]), rows[at[begin]], last - at[begin] + 1


def _between(cps: np.ndarray, rows: np.ndarray, opens: int, closes: int, most: int, inner: np.ndarray | None = None) -> np.ndarray:
    """How many code points lie in spans from an opening to the next closing sign, at most ``most`` apart, as (start, length) sums by row."""
    a, b = np.flatnonzero(cps == opens), np.flatnonzero(cps == closes)
    out = np.zeros((0, 2), np.int64)
    if len(a) and len(b):
        k = np.searchsorted(b, a)
        ok = k < len(b)
        a, end = a[ok], b[k[ok]]
        following = np.append(a[1:], len(cps))
        good = (rows[a] == rows[end]) & (end - a <= most) & (end - a > 1) & (following > end)
        if inner is not None:  # only signs of one class may stand between
            bad = np.concatenate([[0], np.cumsum(~inner)])
            good &= bad[end] == bad[a + 1]
        out = np.stack([rows[a[good]], end[good] - a[good] + 1], 1)
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """(n, len(STATISTICS)) of a string column; null and empty texts have zeros.  Whole texts are counted."""
    raw, raw_offsets, _ = codepoints(column)
    n = len(raw_offsets) - 1
    out = dict.fromkeys(STATISTICS, np.zeros(n))
    # a tab is a boundary of fields, which the consistent form does not keep
    cps, offsets = normalize_codepoints(np.where(raw == 9, np.uint32(0x7C), raw), raw_offsets)
    size = np.diff(offsets).astype(float)
    safe = np.maximum(size, 1)
    if not len(cps):
        return np.zeros((n, len(STATISTICS)))
    bits, lower, function_words = _tables()
    rows = row_ids(offsets)
    cls = bits[np.minimum(cps, _TOP - 1)]
    has = lambda name: (cls & _BIT[name]) != 0
    per_row = lambda mask: np.bincount(rows[mask], minlength=n).astype(float)
    newline, space, letter, cjk = cps == 10, has("space"), has("letter"), has("cjk")
    # words: each Han or kana character, and each run of other letters and digits
    start, length = _runs(letter & ~cjk, rows)
    token_row = rows[start]
    flat = lower[np.minimum(cps[letter & ~cjk], _TOP - 1)]
    begin = np.cumsum(np.concatenate([[0], length]))[:-1]
    hashes = _word_hashes(flat, begin)
    at = np.minimum(np.searchsorted(function_words, hashes), len(function_words) - 1)
    common_word = function_words[at] == hashes if len(hashes) else np.zeros(0, bool)
    n_tokens = np.bincount(token_row, minlength=n).astype(float)
    n_words = per_row(cjk) + n_tokens
    words = np.maximum(n_words, 1)
    out["n_chars"], out["n_words"] = size, n_words
    out["mean_word_len"] = per_row(letter) / words
    for name, bit in (("symbol_ratio", "symbol"), ("odd_symbol_ratio", "odd"), ("emoji_ratio", "emoji"), ("rare_ratio", "rare")):
        out[name] = per_row(has(bit)) / safe
    function = has("function")
    out["common_ratio"] = (per_row(function) + np.bincount(token_row[common_word], minlength=n)) / words
    longest = np.zeros(n)
    np.maximum.at(longest, token_row, length)
    out["longest_token"] = longest
    out["sentence_marks"] = per_row(has("sentence")) / safe
    # lines
    line, line_row, _ = _pieces(newline, rows, ~space)
    n_lines = np.bincount(line_row, minlength=n).astype(float)
    out["n_lines"] = n_lines
    lines = np.maximum(n_lines, 1)
    inside = np.flatnonzero((line >= 0) & ~space)
    of = line[inside]
    first = inside[np.append(True, np.diff(of) != 0)] if len(of) else inside
    text_end = np.flatnonzero((line >= 0) & ~space & ~has("closer"))
    ends = np.zeros(len(line_row), bool)
    if len(text_end):
        ends[line[text_end]] = has("terminator")[text_end]  # the last one of a line wins
    out["end_punct_share"] = np.bincount(line_row[ends], minlength=n) / lines
    item = _is_item(cps, cls, rows, first)
    out["item_line_share"] = np.bincount(line_row[item], minlength=n) / lines
    out["mean_line_len"] = size / lines
    digits = has("digit")
    number = np.zeros(len(cps), bool)  # the number of an item is none of its figures
    for k in range(3):
        at = first[item] + k
        number[at[(at < len(cps)) & digits[np.minimum(at, len(cps) - 1)]]] = True
    out["digit_ratio"] = per_row(digits & ~number) / safe
    # segments, between the marks that separate parts of a sentence or of a list
    wide = np.zeros(len(cps), bool)
    if len(cps) > 2:
        pair = space[1:] & space[:-1] & (rows[1:] == rows[:-1])
        wide[1:] |= pair
        wide[:-1] |= pair
        dash = np.isin(cps[1:-1], [0x2D, 0x2013, 0x2014]) & space[:-2] & space[2:]
        wide[1:-1] |= dash
    comma_in_number = np.zeros(len(cps), bool)
    if len(cps) > 2:
        digit = has("digit")
        comma_in_number[1:-1] = ((cps[1:-1] == 0x2C) | (cps[1:-1] == 0x2F)) & digit[:-2] & digit[2:]
    cut = (has("segment") & ~comma_in_number) | newline | wide
    segment, seg_row, seg_len = _pieces(cut, rows, ~space)
    n_seg = np.bincount(seg_row, minlength=n).astype(float)
    segs = np.maximum(n_seg, 1)
    spoken = np.zeros(len(seg_row), bool)
    spoken[segment[function & (segment >= 0)]] = True
    word_seg = segment[start[common_word]] if len(start) else np.zeros(0, int)
    spoken[word_seg[word_seg >= 0]] = True
    out["n_segments"] = n_seg
    out["bare_segment_share"] = np.bincount(seg_row[~spoken & (seg_len <= 32)], minlength=n) / segs
    out["mean_segment_len"] = size / segs
    far = np.zeros(n)
    np.maximum.at(far, seg_row, seg_len)
    out["longest_segment"] = far
    # rows of values: a label and its value, or several fields, without a sentence mark
    row_cut = newline | (cps == 0x3B) | (cps == 0xFF1B)
    value_row, vr_row, vr_len = _pieces(row_cut, rows, ~space)
    count = lambda mask: np.bincount(value_row[mask & (value_row >= 0)], minlength=len(vr_row))
    time_like = np.zeros(len(cps), bool)
    if len(cps) > 2:
        time_like[1:-1] = (cps[1:-1] == 0x3A) & has("digit")[:-2] & has("digit")[2:]
    arrow = np.isin(cps, [0x2192, 0x21D2])
    if len(cps) > 2:  # "->", and a dash between blanks
        arrow[1:] |= (cps[1:] == 0x3E) & (cps[:-1] == 0x2D)
        arrow[1:-1] |= np.isin(cps[1:-1], [0x2D, 0x2013]) & space[:-2] & space[2:]
    wide_start = space & wide
    wide_start[1:] &= ~(space & wide)[:-1]
    joints = count((np.isin(cps, [0x3A, 0xFF1A, 0x3D, 0xFF1D, 0x7C]) & ~time_like) | arrow | wide_start & ~newline)
    spoken_marks = count(has("sentence") | (cps == 0xFF0C))
    commas = count(cps == 0x2C)
    fields = np.maximum(commas, joints) + 1
    # a heading row has no values of its own
    valued = np.bincount(vr_row[(count(has("digit")) > 0) & (commas >= 2)], minlength=n)[vr_row] > 0
    is_pair = (spoken_marks == 0) & (vr_len <= 24 * fields) & ((joints > 0) & (joints >= commas) | (commas >= 2) & valued & (vr_len <= 14 * fields))
    has_value = is_pair & (count(digits & ~number) > 0)
    n_rows = np.bincount(vr_row, minlength=n).astype(float)
    out["n_rows"] = n_rows
    out["pair_row_share"] = np.bincount(vr_row[is_pair], minlength=n) / np.maximum(n_rows, 1)
    out["valued_row_share"] = np.bincount(vr_row[has_value], minlength=n) / np.maximum(n_rows, 1)
    # junk
    out["case_switch_ratio"] = _switches(cls, rows, n) / safe
    latin = per_row(has("upper") | has("lower"))
    out["vowel_ratio"] = np.where(latin < 6, 0.4 * (size > 0), per_row(has("vowel")) / np.maximum(latin, 1))
    out["repeat_ratio"] = np.bincount(rows[_repeated(cps, rows)], minlength=n) / safe
    out["distinct_word_ratio"] = _distinct_words(cps, rows, cjk, hashes, token_row, n) / words
    out["broken_ratio"] = _broken(raw, row_ids(raw_offsets), n) / np.maximum(np.diff(raw_offsets), 1)
    signs = np.concatenate([
        _between(cps, rows, 0x3C, 0x3E, 80), _between(cps, rows, 0x26, 0x3B, 9, letter | (cps == 0x23)), _between(cps, rows, 0x7B, 0x7D, 60), _between(cps, rows, 0x5B, 0x5D, 40, has("lower") | has("upper") | (cps == 0x2F) | (cps == 0x3D)),
    ])
    out["markup_ratio"] = np.bincount(signs[:, 0], weights=signs[:, 1], minlength=n) / safe
    return np.stack([out[name] for name in STATISTICS], 1)


def _is_item(cps: np.ndarray, cls: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether lines that begin at these places begin as an item: a bullet, or a short number or letter and a mark."""
    n = len(cps)
    look = lambda k: np.minimum(first + k, n - 1)
    same = lambda k: (first + k < n) & (rows[look(k)] == rows[first])
    bit = lambda k, name: same(k) & ((cls[look(k)] & _BIT[name]) != 0)
    is_in = lambda k, chars: same(k) & np.isin(cps[look(k)], [ord(c) for c in chars])
    item = bit(0, "bullet") | same(0) & (cps[first] >= 0x2460) & (cps[first] <= 0x24FF)
    digits = bit(0, "digit")
    opened = is_in(0, "(（") & bit(1, "digit")
    for k in (1, 2, 3):
        item |= digits & is_in(k, ".、)）") & ~bit(k + 1, "digit")
        item |= opened & is_in(k + 1, ")）")
        digits &= bit(k, "digit")
    return item


def _switches(cls: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How often a word goes from small to large letters, or between letters and digits."""
    if len(cls) < 2:
        return np.zeros(n)
    a, b = cls[:-1], cls[1:]
    cased, digit = _BIT["upper"] | _BIT["lower"], _BIT["digit"]
    hit = ((a & _BIT["lower"]) != 0) & ((b & _BIT["upper"]) != 0) | ((a & digit) != 0) & ((b & cased) != 0) | ((a & cased) != 0) & ((b & digit) != 0)
    return np.bincount(rows[1:][hit & (rows[1:] == rows[:-1])], minlength=n).astype(float)


def _repeated(cps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Code points inside a stretch that repeats one to ``_LONGEST_PERIOD`` characters at least three times, its first occurrence left out."""
    change = np.zeros(len(cps) + 1, np.int64)
    for p in range(1, _LONGEST_PERIOD + 1):
        if len(cps) <= 2 * p:
            break
        same = (cps[p:] == cps[:-p]) & (rows[p:] == rows[:-p])
        start, length = _runs(same, rows[p:])
        keep = length >= 2 * p
        change += np.bincount(start[keep] + p, minlength=len(change)) - np.bincount(start[keep] + p + length[keep], minlength=len(change))
    return np.cumsum(change[:-1]) > 0


def _distinct_words(cps: np.ndarray, rows: np.ndarray, cjk: np.ndarray, hashes: np.ndarray, token_row: np.ndarray, n: int) -> np.ndarray:
    """How many different words each row has."""
    key = np.concatenate([_mix(cps[cjk].astype(np.uint64) + np.uint64(7)), hashes])
    row = np.concatenate([rows[cjk], token_row]).astype(np.uint64)
    mixed = np.unique(_mix(key + _mix(row + np.uint64(1))) >> np.uint64(24) | row << np.uint64(40))
    return np.bincount((mixed >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)


def _broken(cps: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Code points of text as stored that come from bytes read in a wrong encoding: a lead byte's letter and what continuation bytes turn into."""
    if not len(cps):
        return np.zeros(n)
    tail = np.zeros(0x2200, bool)
    for byte in range(0x80, 0xC0):
        tail[byte] = True
        c = bytes([byte]).decode("cp1252", "ignore")
        if c and ord(c) < len(tail):
            tail[ord(c)] = True
    lead = (cps >= 0xC2) & (cps <= 0xF4)
    is_tail = tail[np.minimum(cps, len(tail) - 1)] & (cps < len(tail)) & (cps != 0xA0)
    hit = (cps == 0xFFFD) | (cps >= 0x80) & (cps <= 0x9F)
    if len(cps) > 1:
        near = rows[1:] == rows[:-1]
        pair = near & lead[:-1] & is_tail[1:]
        # two lead letters in a row, or two signs of continuation bytes, as a run of them shows
        runs = near & (lead[:-1] & lead[1:] & (cps[:-1] != cps[1:]) | (is_tail[:-1] & is_tail[1:] & (cps[:-1] < 0xC0) & (cps[1:] < 0xC0)))
        for k in (0, 1):
            hit[k : len(cps) - 1 + k] |= pair | runs
    return np.bincount(rows[hit], minlength=n).astype(float)


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the columns of ``STATISTICS`` over ``text_col``; its own columns of those names are replaced.

    All statistics of a null text are null; of an empty text, zeros.  Whole texts are read.
    """
    kept = [f for f in df.schema.fields if f.name not in STATISTICS]
    schema = StructType([*kept, *(StructField(s, DoubleType()) for s in STATISTICS)])
    text = F.col(f"`{text_col}`").cast("string").alias("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, [b.num_columns - 1]):
                column = part.column(part.num_columns - 1)
                gone = np.asarray(column.is_null())
                made = [pa.array(x, mask=gone) for x in statistics(column).T]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)

    return df.select(*[F.col(f"`{f.name}`") for f in kept], text).mapInArrow(run, schema)


_LEARNED: dict[tuple[int, int], tuple[Rule, ...]] = {}


def kinds(rules: tuple[Rule, ...], x: np.ndarray) -> np.ndarray:
    """What the CASE expression says of rows of ``statistics``."""
    out, open_rows = np.full(len(x), "prose", object), np.ones(len(x), bool)
    for rule in rules:
        hit = open_rows.copy()
        for name, le, cut in rule.tests:
            v = x[:, STATISTICS.index(name)]
            hit &= (v <= cut) if le else (v > cut)
        out[hit] = rule.label
        open_rows &= ~hit
    return out


def learned_rules(sample: int = 14_000, seed: int = 11) -> tuple[Rule, ...]:
    """The ordered rule list, induced from ``sample`` labelled documents (the bound of what it is fitted on); kept for each process."""
    key = (sample, seed)
    if key not in _LEARNED:
        rows = labelled.documents(sample, seed)
        x = np.concatenate([statistics(pa.array([t for _, t in rows[i : i + 2000]], pa.string())) for i in range(0, len(rows), 2000)])
        _LEARNED[key] = tuple(induce(x, np.array([k for k, _ in rows]), list(STATISTICS), default="prose", seed=seed))
    return _LEARNED[key]


def text_kind(sample: int = 14_000, seed: int = 11) -> Column:
    """``list``, ``table``, ``junk`` or ``prose`` as a SQL CASE over the statistics, exported from the rule list."""
    return F.expr(to_case(learned_rules(sample, seed), "prose"))


def classified(df: DataFrame, id_col: str = "doc_id", text_col: str = "comment") -> DataFrame:
    """(doc_id, statistics…, kind), every id once.  Null, empty and ``nan`` texts have kind null."""
    one = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(text_col).alias("text"))
    one = one.withColumn("_real", real_text(F.col("text")))
    return with_statistics(one, "text").drop("text").withColumn("kind", F.when(F.col("_real"), text_kind())).drop("_real")
