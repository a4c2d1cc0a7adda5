"""Problem 9: sentence boundaries across languages and scripts.

The terminators, full stops, closers, continuation marks, blanks and letters are the Unicode
sentence-break classes, all taken from the character database, so every script's marks count, and
the standard rules apply to them: no end inside figures and between joined letters, none before a
continuation mark or another terminator, none after a full stop if a lower-case letter comes first,
closers and blanks after the marks belong to the sentence.  On top come suppression of abbreviations,
initials and ordinals by the language of the document, nesting of quotations and brackets with their
introductions and attributions, line breaks (hard ones end a sentence, wrapped ones do not), and
blanks as boundaries in texts of unspaced scripts that use no end marks.

The language is the one given if the text's own function words do not speak against it; else, as where
it is null or unknown, the one they speak for; the lists of all languages where there are none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, by language: abbreviations in front of names or inside sentences, which never end one …
INSIDE = {
    "en": "mr mrs ms messrs dr prof rev hon gen col capt lt sgt gov sen rep vs i.e e.g approx incl excl est dept viz cf al",
    "de": "hr fr frl dr prof dipl ing bzw ca inkl exkl evtl ggf sog zzgl bspw vgl geb z.b d.h u.a z.t u a z d b h",
    "fr": "m mm mme mmes mlle mlles dr prof ex env cf éd av boul p.ex p",
    "es": "sra sres srta dr dra prof gral aprox ej p.ej p avda dña d",
    "hi": "डॉ सं कि.मी कि श्री रु प्रो पं सुश्री",
}
#: … abbreviations in front of figures, which do not end one if a figure follows …
BEFORE_FIGURE = {
    "en": "no nos vol pp fig figs ch sec art ext apt rm max min tel jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "nr str max min tel abs art bd kap abb zi jan feb mär apr jun jul aug sep sept okt nov dez",
    "fr": "no nos art chap vol tél max min janv févr avr juil sept oct nov déc",
    "es": "núm núms no nº pág págs art cap vol tel máx mín ud uds ene feb mar abr jun jul ago sept oct nov dic",
}
#: … and abbreviations that stand before a name or at an end; a function word after them starts a sentence.
BEFORE_NAME = {"en": "st mt ft", "de": "st", "fr": "st ste", "es": "sr sto sta"}
#: Abbreviations that end a sentence if a new one plainly follows.
_MAY_END = frozenset("a.m p.m etc usw u.s u.k jr inc ltd co corp".split())
#: Frequent function words that tell the language; most of them also start sentences.
_WORDS = {
    "en": "the and was were is are of to in with for it he she we they you this that there then our my i at but if when who what",
    "de": "der die das und ist war nicht mit für wir ich es sie ein eine von zu auf dem den im am auch wer was wenn dann unser",
    "fr": "le la les des et est était une un pour dans nous vous il elle on je ce cette du au avec pas qui que notre si",
    "es": "el la los las una un y es era para con por nos se lo ella ellos yo este esta no muy del al que quien nuestro si",
}
_LANGUAGE = {w: tuple(k for k, ws in _WORDS.items() if w in ws.split()) for w in {w for ws in _WORDS.values() for w in ws.split()}}
_INSIDE, _FIGURED, _NAMED = ({k: frozenset(ws.split()) for k, ws in t.items()} for t in (INSIDE, BEFORE_FIGURE, BEFORE_NAME))
_STARTERS = {k: frozenset(ws.split()) for k, ws in _WORDS.items()}
for _t in (_INSIDE, _FIGURED, _NAMED, _STARTERS):  # no language known: all of them
    _t[""] = frozenset().union(*_t.values())
_UNSPACED = re.compile(r"[ぁ-ヿ㐀-䶿一-鿿ก-๛຀-໿က-႟ក-៿]")
_HAN_KANA = re.compile(r"[ぁ-ヿ㐀-䶿一-鿿]")
_ITEM = re.compile(r"[ \t　]*(?:[-*•·・●○■□◆◇▪▸►✓✗–]|[(（]?\d{1,3}[.、)）．]|[①-⑳]|#{1,6}\s)[ \t　]*")
_FIGURE = re.compile(r"[0-9A-Za-zÀ-ɏ０-９Ａ-Ｚａ-ｚ.,:+%\-_'’@/&]+$")
_EVERY = "".join(map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x20000)]))


def _of(cls: str) -> list[str]:
    return regex.findall(rf"\p{{{cls}}}", _EVERY)


def _mates() -> dict[str, str]:
    """Opening mark -> closing mark: in the character database a pair stands close together, the opening one first."""
    closers = {ord(c) for c in _of("Sentence_Break=Close") if unicodedata.category(c) in ("Pe", "Pf")}
    out = {}
    for c in _of("Sentence_Break=Close"):
        if unicodedata.category(c) in ("Ps", "Pi"):
            mate = next((x for x in range(ord(c) + 1, ord(c) + 17) if x in closers), None)
            if mate:
                out[c] = chr(mate)
    return out | {"„": "“", "‚": "‘"}  # low quotation marks close with what opens elsewhere


#: What the standard leaves open is settled here: a single mark is an apostrophe more often than a quotation.
_PAIRS = {a: b for a, b in _mates().items() if a not in "‘‚‛‹"} | {"‘": "’", "‹": "›"}
_OPEN, _CLOSE = frozenset(_PAIRS) - {"‘"}, frozenset(_PAIRS.values()) - {"’", "“"}
_BRACKETS = frozenset(c for c in _PAIRS if unicodedata.category(c) == "Ps" and c not in _of("Quotation_Mark=Yes") and c not in "《〈")
_CONT = frozenset(_of("Sentence_Break=SContinue"))
_DASHES = frozenset(c for c in _CONT if unicodedata.category(c) == "Pd")
_BLANK = "".join(["\t", *_of("Sentence_Break=Sp")])
_SPACE = _BLANK + "\n"
_STOPS = frozenset(_of("Sentence_Break=ATerm")) - {"．"}  # the full-width stop ends sentences as an ideographic one does
_ENDING = "~～"


@lru_cache(1)
def _marks() -> tuple[frozenset[str], re.Pattern, re.Pattern]:
    """All terminators except the full stop, and the token patterns: for all texts, and for those within the basic plane."""
    sterm = frozenset(_of("Sentence_Break=STerm")) | {"｡", "．", "…", "⋯"}
    quotes = "".join(sorted(_OPEN | _CLOSE))
    stops = "".join(sorted(_STOPS))
    basic = "".join(sorted(c for c in sterm if c <= "\uffff"))
    return sterm, re.compile(rf"[{re.escape(''.join(sorted(sterm)) + quotes + stops)}\"]"), re.compile(rf"[{re.escape(basic + quotes + stops)}\"]")


def language_of(text: str, given: str | None) -> str:
    """One of the languages of the lists, or ``""`` for all of them."""
    found = dict.fromkeys(_WORDS, 0)
    for w in text.lower().split():
        for k in _LANGUAGE.get(w, ()):
            found[k] += 1
    best = max(found, key=found.get)
    if found[best] == 0 or given not in found and list(found.values()).count(found[best]) > 1:
        return given if given in _INSIDE else ""
    return given if given in found and 2 * found[given] >= found[best] else best


def _soft_breaks(text: str, lang: str) -> set[int]:
    """Positions of line breaks at which the sentence plainly runs on."""
    if "\n" not in text:
        return set()
    lines = text.split("\n")
    lengths = [len(x.rstrip()) for x in lines]
    widths, i = lengths.copy(), 0
    while i < len(lines):  # the width of a block of lines is that of its longest
        j = i
        while j + 1 < len(lines) and lengths[i] and lengths[j + 1]:
            j += 1
        widths[i : j + 1] = [max(lengths[i : j + 1])] * (j + 1 - i)
        i = j + 1
    sterm = _marks()[0]
    soft, at = set(), 0
    for i in range(len(lines) - 1):
        at += len(lines[i])
        a, b = lines[i].rstrip(), lines[i + 1].strip()
        if a and b and not (_ITEM.match(lines[i + 1]) and not (b[0].isdigit() and 50 <= lengths[i] <= 120)):
            tail = a.rstrip("\"”’」』）)]»›“")
            first, width = b[0], widths[i]
            if first in sterm or first in _CLOSE:
                soft.add(at)
            elif a[-1] in ",，、،" or a[-1] in ";；" and first.islower():
                soft.add(at)
            elif tail and tail[-1] not in sterm and tail[-1] not in ".:：" or tail and tail[-1] == "." and _suppressed(a, len(tail) - 1, b, lang):
                if first.islower() and not _UNSPACED.match(a[-1]):
                    soft.add(at)
                elif not _UNSPACED.match(a[-1]) and not _ITEM.match(lines[i]) and (50 <= lengths[i] <= 120 or 40 <= width <= 120 and lengths[i] + 1 + len(b.split(None, 1)[0]) > width):
                    soft.add(at)
            elif tail and tail[-1] in sterm and len(tail) < len(a) and first.islower() or tail and tail[-1] in ":：" and first in "\"“„«「『":
                soft.add(at)
        at += 1
    return soft


def _suppressed(text: str, dot: int, after: str, lang: str) -> bool:
    """Whether the full stop at ``dot`` belongs to an abbreviation, an initial, an ordinal or a figure of the language."""
    i = dot
    while i > 0 and (text[i - 1].isalnum() or text[i - 1] == "." or "ऀ" <= text[i - 1] <= "ॣ" or text[i - 1] in "’'"):
        i -= 1
    word = text[i:dot]
    if not word or _UNSPACED.match(word[-1]):
        return False
    low = word.lower()
    first = after[:1]
    if low in _MAY_END:
        return first.isdigit() or first.islower()
    last = low.replace("’", "'").rsplit("'", 1)[-1]  # l'art.
    if last in _INSIDE[lang]:
        return True
    if last in _FIGURED.get(lang, ()):
        return first.isdigit() or first in "#№" and first != ""
    follows = _leading(after).lower()
    if last in _NAMED.get(lang, ()):
        return first.isupper() and follows not in _STARTERS[lang]
    if len(word) == 1 and word.isalpha() and word.isupper():
        # an initial, unless a word in lower case stands before it ("vitamin C.") and a function word after it
        before = text[:i].rstrip(_SPACE).rsplit(None, 1)
        named = not before or not before[-1][:1].islower()
        return named or follows not in _STARTERS.get(lang, ())
    if "ऀ" <= word[-1] <= "ॣ":
        return len(word) <= 4  # the danda ends sentences there
    if word.isdigit():
        if len(word) <= 3 and text[:i].strip(" \t　(（") == "":
            return True  # the number of an item
        if len(word) <= 2 and first.isupper() and lang == "de" and follows not in _STARTERS["de"]:
            return True  # a German ordinal
    return False


def _leading(text: str) -> str:
    """The word a text begins with."""
    k = 0
    while k < len(text) and text[k].isalpha():
        k += 1
    return text[:k]


def _lower_first(text: str, i: int, e: int, sterm: frozenset[str]) -> bool:
    """Whether a lower-case letter is the first letter from ``i`` on, before a figure, another terminator or the end of the line."""
    while i < e:
        c = text[i]
        if c.isalpha():
            return c.islower()
        if c.isdigit() or c in sterm or c in _STOPS or c == "\n" or unicodedata.category(c) == "So":
            return False
        i += 1
    return False


def _breaks_in(text: str, s: int, e: int, out: list[int], lang: str) -> int:
    """Appends the ends (exclusive) of sentences inside one unit of text; returns the number of end marks outside quotations."""
    sterm, full, basic = _marks()
    token = basic if text.isascii() or max(text[s:e], default="") <= "\uffff" else full
    stack: list[tuple[str, int, bool, bool]] = []
    waiting: dict[str, int] = {}  # how often each closing mark is on the stack
    begin, marks = s, 0
    german = "„" in text

    def start_of(i: int) -> int:
        while i < e and text[i] in " \t\n 　 ":
            i += 1
        return i

    pos = s
    while True:
        m = token.search(text, pos, e)
        if not m:
            break
        a, b = m.span()
        ch = text[a]
        if ch in _OPEN or ch in _CLOSE or ch == '"':
            pos = b
            closes = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == ch), None) if waiting.get(ch) else None
            if closes is None or ch == '"' and closes is None:
                if ch == '"' or ch in _OPEN and not (german and ch == "“"):
                    at_start, back = start_of(begin) >= a, a
                    while back > begin and text[back - 1] in _SPACE:
                        back -= 1
                    before = text[back - 1] if back > begin else ""
                    mate = '"' if ch == '"' else _PAIRS[ch]
                    waiting[mate] = waiting.get(mate, 0) + 1
                    stack.append(('"' if ch == '"' else _PAIRS[ch], a, at_start, before in (":", "：", ",", "，")))
                continue
            _, opened, at_start, introduced = stack[closes]
            for closed in stack[closes:]:
                waiting[closed[0]] -= 1
            del stack[closes:]
            if stack:
                continue
            inner = text[opened + 1 : a].rstrip(_SPACE)
            if not inner or not (inner[-1] in sterm or inner[-1] in _STOPS):
                continue
            nxt = start_of(b)
            if nxt >= e:
                continue
            c = text[nxt]
            if c in sterm or c in _STOPS or c in _CONT or c in _CLOSE:
                continue
            if text[opened] in _BRACKETS:
                go = at_start
            elif c.islower() and not (introduced and _UNSPACED.search(inner)):
                go = False
            elif at_start:
                if "ぁ" <= c <= "ゟ":
                    go = False
                elif c.isupper() or c in _OPEN or c == '"' or c.isdigit():
                    go = True
                else:
                    go = False  # scripts without case: the words after it attribute the quotation
            elif "ぁ" <= c <= "ゟ":
                go = False
            else:
                go = introduced or c.isupper() and b < nxt
            if go:
                out.append(b)
                begin = pos = nxt
            continue
        # a run of terminators
        while b < e and (text[b] in _STOPS or text[b] in sterm):
            b += 1
        bare = b
        while b < e and (text[b] in _ENDING or text[b] in sterm):
            b += 1
        pos = b
        if stack:
            if b - stack[-1][1] > 400:
                stack.clear()  # a quotation that never closes
                waiting.clear()
            else:
                continue
        run = text[a:bare]
        # closing marks without an opening one belong to the sentence
        k = b
        while k < e and (text[k] in _CLOSE and not (text[k] in _OPEN) or text[k] in "’”"):
            k += 1
        nxt = start_of(k)
        c = text[nxt] if nxt < e else ""
        # after a script without case and blanks a foreign word in lower case may well start a sentence
        uncased = a > s and _UNSPACED.match(text[a - 1]) is not None
        if set(run) <= _STOPS:
            if len(run) == 1:
                if c and nxt == k and (c.isdigit() or c.isascii() and c.isalpha() and a > s and text[a - 1].isascii() and text[a - 1].isalnum() and not (c.isupper() and (text[a - 1].islower() or text[a - 1].isdigit()))):
                    continue
                if _suppressed(text[max(begin, a - 40) : a], min(a - begin, 40), text[nxt : nxt + 40], lang):
                    continue
                if c and a > s and text[a - 1] in " \n" and nxt == k:
                    continue
            if c and (not uncased and _lower_first(text, nxt, e, sterm) or c in _CONT and nxt == k):
                continue
        elif set(run) <= {"…", "⋯"}:
            if c and (c.islower() and not (uncased and len(run) > 1) or len(run) == 1 and not c.isupper() or c in _CONT):
                continue
        elif c and c in _CONT and c not in _DASHES:
            continue
        marks += 1
        if out and start_of(begin) >= a:
            out[-1] = k  # marks alone belong to the sentence before
        else:
            out.append(k)
        begin = pos = nxt
    return marks


def _blank_breaks(text: str, s: int, e: int) -> list[int]:
    """Ends of statements in a unit of an unspaced script without end marks: blanks between complete statements."""
    depth, out, pieces, i, at = 0, [], [], s, s
    while i < e:
        ch = text[i]
        if ch in _OPEN:
            depth += 1
        elif ch in _CLOSE:
            depth = max(0, depth - 1)
        elif depth == 0 and ch in _SPACE:
            if i > at:
                pieces.append((at, i))
            while i < e and text[i] in _SPACE:
                i += 1
            at = i
            continue
        i += 1
    if e > at:
        pieces.append((at, e))
    for k in range(len(pieces) - 1):
        p, q = text[pieces[k][0] : pieces[k][1]], text[pieces[k + 1][0] : pieces[k + 1][1]]
        before = text[pieces[k - 1][0] : pieces[k - 1][1]] if k else ""
        if _FIGURE.fullmatch(p) or _FIGURE.fullmatch(q):
            continue
        if (q[0] in _OPEN or p[-1] in _CLOSE) and not (_HAN_KANA.match(p[-1]) or _HAN_KANA.match(q[0])):
            continue  # scripts that put blanks around quotations
        if p[-1] in "，、,：:" or q[0] in "，、,：:":
            continue
        if len(q) == 1 or len(p) == 1 and before and _FIGURE.fullmatch(before):
            continue
        if len(p) <= 2 and k == 0:
            continue
        out.append(pieces[k][1])
    return out


def sentence_ends(text: str | None, lang: str | None = None) -> list[int]:
    """1-based positions of the last character of each sentence; [] for null, empty and blank texts."""
    if not text or not text.strip():
        return []
    lang = language_of(text, lang) if "." in text else ""
    soft = _soft_breaks(text, lang)
    units, at = [], 0
    i = text.find("\n")
    while i >= 0:
        if i not in soft:
            if i > at:
                units.append((at, i))
            at = i + 1
        i = text.find("\n", i + 1)
    units.append((at, len(text)))
    found: list[list[int]] = []
    marks = 0
    for s, e in units:
        out: list[int] = []
        marks += _breaks_in(text, s, e, out, lang)
        found.append(out)
    by_blank = marks == 0 and _UNSPACED.search(text) is not None
    ends: list[int] = []
    for (s, e), out in zip(units, found):
        if by_blank:
            out = sorted({*out, *_blank_breaks(text, s, e)})
        last = e
        while last > s and text[last - 1].isspace():
            last -= 1
        if last == s:
            continue
        if not out or out[-1] < last:
            tail = text[(out[-1] if out else s) : last]
            if out and not any(c.isalnum() for c in tail) and not _UNSPACED.search(tail):
                out[-1] = last  # emojis and stray marks stay with the sentence before
            else:
                out.append(last)
        ends += out
    return ends


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, sentence_no, start_pos, end_pos): the sentences of every document in order.

    Positions are 1-based code points of the text as stored, blanks around a sentence left out.  Null,
    empty and blank texts have no sentence.  Repeated ids give the sentences of each row.  ``lang_col``
    may be absent, null or wrong: the text's own words decide then.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, number, starts, stops = [], [], [], []
            for row, (text, lang) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                last = 0
                for n, end in enumerate(sentence_ends(text, lang), 1):
                    begin = last
                    while begin < end and text[begin].isspace():
                        begin += 1
                    take.append(row)
                    number.append(n)
                    starts.append(begin + 1)
                    stops.append(end)
                    last = end
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())],
                names=["doc_id", "sentence_no", "start_pos", "end_pos"],
            )

    lang = F.col(lang_col).cast("string") if lang_col in df.columns else F.lit(None).cast("string")
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang")).mapInArrow(run, f"doc_id {kind}, sentence_no int, start_pos int, end_pos int")
