"""Problem 2: personal data in free text.

Regular expressions propose spans, checksums confirm or refute them (mod 11-2, mod 97, mod 23, Luhn),
and words nearby move the score; spans at or above the threshold are replaced by typed placeholders.
An identity number without a label needs a checksum that holds, a weak one (Luhn) a label too; digits that make up a payment card are
no telephone or identity number.  Names are found by their structure (a family name and a given name in
Han or Hangul, two to four capitalised words else) next to words that only persons go with.  Matching
runs on a folded copy (width, look-alike letters, blanks, invisible characters) whose positions map back
to the text as stored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normalize import _ALIKE, _TOP, _invisible, real_text

THRESHOLD = 0.6
WINDOW = 16  #: code points on either side in which context words count
KINDS = ("email", "phone", "id_number", "address", "person_name")

#: Frequent Chinese family names.
_SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏窦章云苏潘葛奚范彭郎鲁韦昌马苗凤方俞任袁柳"
    "史唐费廉岑薛雷贺倪汤滕殷罗毕郝安傅卞齐康伍余顾孟黄穆萧尹姚邵汪狄米戴宋庞熊纪舒屈项祝董梁杜阮蓝席季贾江童颜郭梅"
    "林钟徐邱骆高夏蔡田樊胡凌霍虞万柯卢莫裘丁邓洪左石崔吉龚程邢裴陆荣翁曲封储靳松富巴牧谷侯班仰仲伊宫宁"
    "仇甘武符刘景詹束龙叶司黎薄怀索赖卓乔阎聂曾文关辛简饶曾丰温单"
)
_DOUBLE = "欧阳|司徒|上官|诸葛|司马|慕容|尉迟|皇甫|东方|夏侯|令狐|长孙|宇文|端木|南宫|公孙"
_NAME = rf"(?:(?:{_DOUBLE})[一-鿿]{{1,2}}|[{_SURNAMES}][一-鿿]{{1,2}})"
_TITLE = r"经理|先生|女士|小姐|师傅|阿姨|老师|主管|太太|大叔|大姐|同学|医生|总"
_WORD = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}\p{Ll}+)?"
_LATIN = rf"{_WORD}(?: \p{{Lu}}\.)?(?: (?:(?:de|del|de la|von|van|van der|la|le|di|da|dos|bin|al|O['’]) )?{_WORD}){{1,3}}"
#: Frequent Korean family names.
_HANGUL = r"[김이박최정강조윤장임한오서신권황안송류홍전고문양손배백허유남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국][가-힣]{2}"
#: What only a person does or is, after a name, by language.
_DOES = r"帮|替|陪|亲自|主动|特地|告诉我|给我|给了我|送我们|接我们|接待"
_DID = r"helped|greeted|welcomed|told|showed|checked us|brought|gave|carried|apologi[sz]ed|answered|smiled|explained|upgraded|(?:was|is) (?:so |very |really |extremely )?(?:lovely|kind|friendly|helpful|rude|polite|attentive|nice)|hat (?:uns|mir)|half uns|nous a|m['’]a|nos (?:ayudó|atendió|recibió)|помог|встретил"


@dataclass(frozen=True)
class Proposal:
    """A pattern with its kind, base score and, for group ``m``, optional check."""

    kind: str
    pattern: re.Pattern
    base: float
    check: str = ""
    need: str = ""  #: a text without any of these characters cannot match; one of ``_FORMS`` stands for its pattern


_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?at\s?[)\]}>]\s?|艾特|\s+at\s+|#at#)"
_DOT = r"(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\s+dot\s+|点)"
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*"
_NUM = "一二三四五六七八九零〇幺"
_CNUM = r"(?:\d{1,5}|[一二三四五六七八九十百零〇]{1,6})"
_STREET = r"Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Crescent|Cres|Drive|Dr|Way|Close|Court|Ct|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Row|Mews|Parade|Highway"


@lru_cache(1)
def proposals() -> list[Proposal]:
    """The span patterns; compiled once per process."""
    c = lambda p: re.compile(p)
    han = r"[一-鿿]"
    return [
        Proposal("email", c(rf"(?i)(?<![A-Za-z0-9._%+\-])(?P<m>{_LOCAL}{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}})(?![A-Za-z0-9])"), 0.7, "email", "@艾aA"),
        Proposal("email", c(r"(?<![\p{L}\p{N}._%+\-])(?P<m>[\p{L}\p{N}][\p{L}\p{N}._%+\-]*@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}?)(?![\p{Latin}\p{N}]|\p{L}(?!\p{L}{4}))"), 0.7, "idn", "@"),
        # telephone numbers
        Proposal("phone", c(r"(?<![A-Za-z0-9_.+\-])(?P<m>(?:(?:[(]?(?:\+|00)\s?86[)]?)[\- ]?)?1[3-9]\d(?:[\-. ]?\d){8})(?![\-.]?[\dA-Za-z])"), 0.65, "phone", "6"),
        Proposal("phone", c(r"(?<![A-Za-z0-9_+])(?P<m>[(]?(?:\+|(?<!\d)00)[1-9]\d{0,2}[)]?(?:[ \-.]?[(]?\d{1,9}[)]?){1,6})(?![\-.]?[\dA-Za-z])"), 0.65, "phone", "6"),
        Proposal("phone", c(r"(?<![A-Za-z0-9_.+\-])(?P<m>[(]0\d{2,4}[)][ \-]?\d{3,8}(?:[ \-]\d{2,4}){0,3}|0\d{1,5}(?: ?/ ?|[ \-.])\d{2,8}(?:[ \-.]\d{2,8}){0,4})(?![\-.]?[\dA-Za-z])"), 0.65, "phone", "6"),
        Proposal("phone", c(r"(?<![A-Za-z0-9_.+\-])(?P<m>0\d{9,11})(?![\-.]?[\dA-Za-z])"), 0.4, "phone", "6"),
        Proposal("phone", c(r"(?<![A-Za-z0-9_.+\-])(?P<m>(?:1[\-. ])?[(]?[2-9]\d{2}[)]?[\-. ]\d{3}[\-. ]\d{4})(?![\-.]?[\dA-Za-z])"), 0.65, "phone", "6"),
        Proposal("phone", c(rf"(?<![{_NUM}十百千万])(?P<m>[一幺][{_NUM}](?:[ \-]?[{_NUM}]){{9}})(?![{_NUM}十百千万])"), 0.7, need="一幺"),
        # identity card and passport numbers
        Proposal("id_number", c(r"(?<![A-Za-z0-9_])(?<!\d[.\-])(?P<m>\d{6}[ \-]?\d{8}[ \-]?\d{3}[\dXx])(?![\-.]?\d|[A-Za-z])"), 0.2, "cn18", "6"),
        Proposal("id_number", c(r"(?<![A-Za-z0-9_])(?P<m>[A-Z]{1,2}\d{6}\s?[(][\dA][)])"), 0.65, need="6"),
        Proposal("id_number", c(r"(?<![\dA-Za-z.\-])(?P<m>(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4})(?![\dA-Za-z]|[.\-]\d)"), 0.7, need="6"),
        Proposal("id_number", c(r"(?<![\dA-Za-z.\-])(?P<m>[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2})(?![\dA-Za-z]|[.\-]\d)"), 0.1, "fr15", "6"),
        Proposal("id_number", c(r"(?<![\dA-Za-z.\-])(?P<m>\d{2}\.(?:0\d|1[0-2])\.[0-3]\d-\d{3}\.\d{2})(?!\d)"), 0.1, "be11", "6"),
        Proposal("id_number", c(r"(?<![\dA-Za-z.\-])(?P<m>\d{2}(?:0\d|1[0-2])[0-3]\d[\-+]\d{4}|\d{3}[ \-]\d{3}[ \-]\d{3})(?![\dA-Za-z]|[.\-]\d)"), 0.1, "luhn", "6"),
        Proposal("id_number", c(r"(?<![A-Za-z0-9_\-])(?P<m>\d{8}[\- ]?[A-Z])(?![A-Za-z0-9_])"), 0.3, "dni", "6"),
        Proposal("id_number", c(r"(?<![A-Za-z0-9_\-])(?P<m>[XYZ]\d{7}[\- ]?[A-Z])(?![A-Za-z0-9_])"), 0.3, "dni", "6"),
        Proposal("id_number", c(r"(?<![A-Za-z0-9_\-])(?P<m>[A-Z]{1,2}\d{7,9}|[A-Z]\d[A-Z0-9]{7}|[A-Z]{1,2} \d{7,8})(?![A-Za-z0-9_\-])"), 0.35, need="6"),
        Proposal("id_number", c(r"(?<![A-Za-z0-9_\-.])(?P<m>\d{9})(?![\w\-.]\d|[A-Za-z0-9_])"), 0.2, need="6"),
        # addresses
        Proposal("address", c(rf"(?P<m>(?:{han}{{1,6}}?[省州])?(?:{han}{{1,6}}?市)?(?:{han}{{1,6}}?[区县镇乡])?{han}{{1,8}}?(?:大道|大街|胡同|路|街|巷|弄|里|道)(?:{_CNUM}弄)?{_CNUM}号(?!线|楼层|涨价|房)(?:之{_CNUM})?(?:{han}{{2,6}}(?:花园|小区|公寓|大厦|苑|广场|里))?(?:[A-Za-z]座)?(?:{_CNUM}(?:栋|幢|座|号楼))?(?:{_CNUM}单元)?(?:\d+室?)?)"), 0.7, "cnaddr", "号"),
        Proposal("address", c(r"(?P<m>(?:〒?\d{3}-\d{4}\s?)?(?:[一-鿿]{1,4}[都道府県])?(?:[一-鿿ぁ-んァ-ヶー]{1,6}[市区町村郡])*[一-鿿ぁ-んァ-ヶー]{1,8}?\d{1,3}(?:丁目\d{1,3}(?:番地?|-)\d{0,3}号?|番地))"), 0.65, "cnaddr", "番目"),
        Proposal("address", c(rf"(?<![A-Za-z0-9_#.]|\d )(?P<m>\d{{1,5}}[a-zA-Z]?,? (?:\p{{Lu}}[\p{{L}}'’\-]+ ){{1,3}}(?:{_STREET})\b(?:\.?,? ?(?:Apt\.?|Flat|Unit|Suite|#) ?\w+)?)"), 0.7, need="0"),
        Proposal("address", c(r"(?<![A-Za-z0-9_\-])(?P<m>(?:\p{Lu}[\p{L}\-]*(?:stra(?:ß|ss)e|str\.|weg|allee|gasse|platz|ring|damm|ufer|chaussee|steig)|(?:\p{Lu}[\p{L}\-]+ )(?:Stra(?:ß|ss)e|Weg|Allee|Gasse|Platz|Ring|Damm)) \d{1,4} ?[a-z]?(?![A-Za-z0-9_]))"), 0.7, need="A"),
        Proposal("address", c(r"(?i)(?<![A-Za-z0-9_])(?P<m>\d{1,4}(?: ?bis| ?ter)?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|cours)\b(?: (?:de|du|des|la|le|les|d['’]|l['’]))* ?[\p{Lu}][\p{L}'’\-]+)"), 0.7, need="0"),
        Proposal("address", c(r"(?<![A-Za-z0-9_])(?P<m>(?:[Cc]alle|C/|[Cc]\.|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Tt]ravesía)(?: (?:de|del|la|las|los|el))* ?(?:\p{Lu}[\p{L}\-]+(?: (?:de|del|la|las|los))? ?){1,4},? ?(?:n\.?[ºo°]|núm\.)? ?\d{1,4})(?!\d)"), 0.7, need="A"),
        # names
        Proposal("person_name", c(rf"(?:联系人[:：]?\s?|我叫|我是|预订人[:：]?\s?|预定人[:：]?\s?|收件人[:：]?\s?|收货人[:：]?\s?|入住人[:：]?\s?|抬头(?:写|是|为|[:：])\s?|写着|打给|姓名[:：]?\s?|—+\s?|名字(?:是|叫)|叫做|感谢|谢谢|(?:值班经理|经理|管家|前台|服务员|领班|保安|大堂|客房部|礼宾部?|行李员|餐厅)的?)(?P<m>{_NAME})(?=$|[,，。.!！;；、（()）\s\d「『“]|给了|不怎么|不太|确实|真的|特别|实在|格外|相当|始终|一直|依旧|整体|明显|出乎意料|比想象中|略显|稍微|还算|多少有点|十分|帮|很|非常|收|的|在|说|和|先生|女士|小姐|态度|耐心|热情|一直|为|主动|把|送|请)"), 0.62, "cnname"),
        Proposal("person_name", c(rf"(?:^|[，。！；,.!;\s~…?？）])(?P<m>{_NAME})(?=(?:不怎么|不太|真的|确实|实在|特别|格外|相当|始终|一直|依旧|整体|明显|略显|稍微|还算|非常|很)(?:耐心|热情|周到|专业|贴心|细致)|，?手机|[（(](?:\+|\d|0|幺|一)|\s[\d+(一幺]|[,，]?\s?电话|{_DOES})"), 0.62, "cnname"),
        Proposal("person_name", c(rf"(?:写着|抬头写|联系人[:：]|收件人[:：]?|预订人[:：]?|我叫|打给|经理|[Mm]y name is |[Nn]ame is |[Ii] am |[Ii]['’]m |attention |[Aa]ttn:? |c/o |[Rr]each me [(]|[Aa]sk for |[Tt]hanks to |[Tt]hank you,? |merci à |[Jj]e m['’]appelle |[Mm]e llamo |[Mm]i nombre es |[Gg]racias a |[Aa] nombre de |[Ii]ch hei(?:ß|ss)e |[Mm]ein Name ist |[Dd]ank an |au nom de |[Ss]igned,? |—+\s?|– |(?:^|[.!?\n]) ?- |- )(?P<m>{_LATIN})"), 0.65, "latin", "A"),
        Proposal("person_name", c(rf"(?P<m>{_LATIN})(?= (?:at the desk|from the|at reception|at the front|du bar|de la réception|de recepción|del bar|von der Rezeption|an der Rezeption|vom Empfang|am Empfang|was (?:lovely|kind)|さん|様|氏)|さん|様|氏|先生|女士|确实|给了我|（[+\d(]|\s1\d{{10}})"), 0.65, "latin", "A"),
        Proposal("person_name", c(rf"(?<![\p{{L}}\p{{N}}])(?P<m>{_LATIN})(?= (?:{_DID})\b)"), 0.65, "latin", "A"),
        Proposal("person_name", c(rf"(?:[Cc]ontact|[Mm]et|[Aa]sked|[Cc]alled|[Nn]amed|[Mm]anager|[Rr]eceptionist|[Gg]uide|[Hh]ost|[Dd]river|[Cc]oncierge|[Ww]aiter|[Ww]aitress|[Ss]peak to|[Ss]poke (?:to|with)|[Ff]rau|[Hh]errn?|[Mm]onsieur|[Mm]adame|[Ss]eñora?) (?P<m>{_LATIN})"), 0.65, "latin", "A"),
        Proposal("person_name", c(r"(?<![\p{L}\p{N}])(?P<m>(?=[^ ]*\p{Cyrillic})\p{Lu}[\p{Ll}]+(?: \p{Lu}[\p{Ll}]+){1,2})(?!\p{L})"), 0.62, "cyrillic", "я"),
        Proposal("person_name", c(rf"(?:이름은|저는|담당자는?|직원|매니저|가이드|감사합니다,?|연락처:?) ?(?P<m>{_HANGUL})|(?<![가-힣])(?P<m>{_HANGUL})(?= ?(?:씨|님|매니저|직원|입니다|이라고|에게))"), 0.65, need="가"),
    ]


#: Words nearby that speak for or against a kind.
_FOR = {
    "email": r"邮|mail|correo|信箱|メール|adresse|почт|메일",
    "phone": r"电话|手机|联系|微信|\b(?:call|text|tel|fax|mobile|phone|reach|ring)\b|telef|téléph|rappel|llam|Anruf|Rückruf|Handy|電話|連絡|전화|звон|телеф",
    "id_number": r"身份证|证件|护照|passport|passeport|pasaporte|\bID\b|Ausweis|documento|パスポート|証|identity|identité|\bcard\b|\bcarte\b|\bDNI\b|\bNIE\b|\bSSN\b|social security|sécurité sociale|여권|паспорт",
    "address": r"寄|地址|住|送到|address|\b(?:home|send|ship|live|lives)\b|wohn|Adresse|adresse|habite|vivo|vive|direcci|に送|住所|주소|адрес",
    "person_name": r"",
}
_AGAINST = {
    "email": r"",
    "phone": r"单号|订单|流水|航班|验证码|取件码|快递|order|booking|tracking|票号|会员号|房号|ref\b|Buchung|commande|pedido|予約番号",
    "id_number": r"单号|订单|流水|航班|验证码|取件码|快递|order|booking|flight|tracking|票号|会员|房号|Buchung|commande|pedido|予約|确认号|确认码|voucher",
    "address": r"",
    "person_name": r"",
}


@lru_cache(1)
def _context() -> dict[str, tuple[re.Pattern | None, re.Pattern | None]]:
    return {k: tuple(re.compile(p, re.I) if p else None for p in (_FOR[k], _AGAINST[k])) for k in KINDS}


def luhn(digits: str) -> bool:
    """Luhn check, as payment cards and several identity numbers carry it."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(number: str, check: str) -> bool:
    """Whether the check digits are what 97 lacks of the number's remainder, as French and Belgian identity numbers have it."""
    return 97 - int(number) % 97 == int(check)


_CARD = re.compile(r"(?<![\d.\-])(?:[3-6]\d{3}|2[2-7]\d{2})(?:[ \-]?\d{4}){2}(?:[ \-]?\d{1,7})(?![\d])")


def _cards(text: str) -> list[tuple[int, int]]:
    """Spans of payment card numbers: their issuer's digit and length, confirmed by the Luhn check."""
    found = [(m.span(), re.sub(r"\D", "", m.group())) for m in _CARD.finditer(text)]
    return [span for span, digits in found if 13 <= len(digits) <= 19 and luhn(digits)]


def mod11_2(number: str) -> bool:
    """ISO 7064 mod 11-2 over 18 characters, the last may be X."""
    r = 0
    for ch in number[:-1]:
        r = (r + int(ch)) * 2 % 11
    return (12 - r) % 11 == (10 if number[-1] in "Xx" else int(number[-1]))


def _born(s: str) -> bool:
    try:
        return 1900 <= date(int(s[:4]), int(s[4:6]), int(s[6:])).year <= 2035
    except ValueError:
        return False


#: Verbs and labels that stand before a Chinese address without a blank.
_LEAD = re.compile(r"^.*?(?:寄到|寄往|寄至|邮寄|寄|送到|送至|送往|地址是|地址为|地址|住在|家住|家在|位于|搬到|就在|公司在|开到|我住|住|到|在|写着|是|的|去|从)(?=[一-鿿]{2})")


def _checked(check: str, text: str, m: re.Match) -> tuple[float, int, int]:
    """Score change by the validator, and the span it leaves; a change of -1 refutes."""
    a, b = m.span("m")
    s = text[a:b]
    if check == "cn18":
        n = re.sub(r"[ \-]", "", s)
        if not _born(n[6:14]):
            return -1, a, b
        return (0.6 if mod11_2(n) else 0.2), a, b
    if check == "dni":
        n = re.sub(r"[ \-]", "", s)
        value = int("".join(ch for ch in n[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")))
        return (0.4 if "TRWAGMYFPDXBNJZSQVHLCKE"[value % 23] == n[-1] else 0.1), a, b
    if check == "phone":
        digits = re.sub(r"\D", "", s)
        if not 8 <= len(digits) <= 15 or re.fullmatch(r"\d{4}[\-.]\d{2}[\-.]\d{2}", s):
            return -1, a, b
        if s[0] == "(" and ")" not in s:  # the bracket stands around more than the number
            a += 1
        elif s.count("(") != s.count(")"):
            return -1, a, b
        return 0, a, b
    if check == "luhn":
        return (0.3 if luhn(re.sub(r"\D", "", s)) else -1), a, b
    if check == "fr15":
        n = s.replace(" ", "").replace("2A", "19").replace("2B", "18")
        return (0.6 if mod97(n[:13], n[13:]) else -1), a, b
    if check == "be11":
        n = re.sub(r"\D", "", s)
        return (0.6 if mod97(n[:9], n[9:]) or mod97("2" + n[:9], n[9:]) else -1), a, b
    if check == "email":
        at = re.search(r"\s+at\s+", s, re.I)
        if at and not re.search(r"(?i)dot|点", s) and not re.search(r"[\d._+\-]", s[: at.start()]):
            return -1, a, b
        return 0.1, a, b
    if check == "idn":  # with letters beyond ASCII; the others have a pattern of their own
        return (-1 if s.isascii() else 0), a, b
    if check == "cnaddr":
        lead = _LEAD.match(s)
        if lead and lead.end() < len(s):
            a += lead.end()
        return (0 if len(text[a:b]) >= 4 else -1), a, b
    if check == "cnname":
        if re.match(rf"(?:{_TITLE})", s[1:]) or re.match(rf"(?:{_TITLE})", text[b : b + 2]) and len(s) < 3:
            return -1, a, b
        if re.search(r"经理|先生|女士|小姐|师傅|阿姨|老师|[的了是在和都也很不太真还]", s):
            return -1, a, b
        return 0, a, b
    if check == "latin":
        first = s.split()[0]
        if first in _NO_NAME or s.split()[-1] in _PLACES:
            return -1, a, b
        return 0, a, b
    if check == "cyrillic":  # two capitalised words; what is folded to Latin letters counts with the rest
        return (-1 if s.split()[-1].lower() in _CYRILLIC_PLACES else 0), a, b
    return 0, a, b


#: Words that begin a sentence or a place and no name, and words that end a place.
_NO_NAME = frozenset("The A An Our My Your We They He She It This That From Close First At In On And But When Then Hotel Le La Les Los Las El Das Der Die Wir Mr Mrs Ms Dr Prof Frau Herr Madame Monsieur Señor Señora Unter Ober Alt Room Breakfast".split())
_PLACES = frozenset("Street Road Lane Avenue Drive Square Park Garden Gardens Market Bridge Theatre Museum Library Hotel Arcade Chapel Church Harbour Pier Gallery Bistro Cafe Café Restaurant Station Airport Hall House Tower Castle Beach Bay Hill Lake River Island Suites Inn Resort Tearoom Brewery Bar".split())
_CYRILLIC_PLACES = frozenset("ул улица проспект площадь отель гостиница вокзал парк мост музей театр".split())


@lru_cache(1)
def _fold_table() -> dict[int, int | None]:
    import unicodedata

    t: dict[int, int | None] = {cp: (None if _invisible(cp) else cp) for cp in range(_TOP) if not 0x3000 <= cp <= 0xF8FF and _invisible(cp)}
    t |= {0xFF01 + i: 0x21 + i for i in range(94)}
    t |= {cp: 0x20 for cp in range(_TOP) if not 0x3400 <= cp <= 0xFFFF and unicodedata.category(chr(cp)) == "Zs"} | {0x3000: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0xFE0F: None}
    t |= {ord(o): ord(k) for k, others in _ALIKE.items() for o in others}
    t |= {cp: int(unicodedata.decomposition(chr(cp)).split()[-1], 16) for cp in [*range(0x2F00, 0x2FD6), *range(0xF900, 0xFA6E)] if unicodedata.decomposition(chr(cp))}
    return t


def fold(text: str) -> tuple[str, list[int] | None]:
    """The folded text, and where each of its characters stood (None: the same places)."""
    t = _fold_table()
    folded = text.translate(t)
    if len(folded) == len(text):
        return folded, None
    return folded, [i for i, ch in enumerate(text) if t.get(ord(ch), 0) is not None]


#: What some proposals need of a text, looked for once: a digit, six of them close together, a capitalised word, Hangul, Cyrillic letters.
_FORMS = {"0": re.compile(r"\d"), "6": re.compile(r"\d(?:[ \-.()/]{0,3}\d){5}"), "A": re.compile(r"\p{Lu}[\p{Ll}'’]"), "가": re.compile(r"[가-힣]"), "я": re.compile(r"\p{Cyrillic}")}


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the personal data in a text, not overlapping, in order; [] for null or empty."""
    if not text:
        return []
    folded, where = fold(text)
    found = []
    has = {k: p.search(folded) is not None for k, p in _FORMS.items()}
    cards = _cards(folded) if has["6"] else []
    for p in proposals():
        if p.need and not (has[p.need] if p.need in has else any(ch in folded for ch in p.need)):
            continue
        for m in p.pattern.finditer(folded, overlapped=p.kind == "person_name"):
            change, a, b = _checked(p.check, folded, m)
            if change <= -1 or cards and p.kind in ("phone", "id_number") and any(x < b and a < y for x, y in cards):
                continue
            near = folded[max(0, a - WINDOW) : a] + "\0" + folded[b : b + WINDOW]
            pro, con = _context()[p.kind]
            score = p.base + change + (0.3 if pro and pro.search(near) else 0) - (0.4 if con and con.search(folded[max(0, a - 8) : a]) else 0)
            if score >= threshold:
                found.append((-score, a - b, a, b, p.kind))
    chosen: list[tuple[int, int, str, float]] = []  # in order, so only the neighbours can overlap
    for score, _, a, b, kind in sorted(found):
        at = bisect_left(chosen, (a,))
        if (at == 0 or chosen[at - 1][1] <= a) and (at == len(chosen) or b <= chosen[at][0]):
            chosen.insert(at, (a, b, kind, -score))
    at = (lambda i: i) if where is None else (lambda i: where[i])
    return [(at(a), at(b - 1) + 1, kind, round(s, 3)) for a, b, kind, s in chosen]


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each mention replaced by its placeholder; null stays null."""
    return None if text is None else _replaced(text, find_spans(text, threshold))


def _replaced(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, last = [], 0
    for a, b, kind, _ in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def mentions(df: DataFrame, id_col: str = "doc_id", text_col: str = "comment", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos, score): one row a mention, positions 1-based code points.

    Every id counts once however many rows it has (equal texts; else the smallest).  Null, empty and
    ``nan`` texts have no mention.
    """
    one = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where(real_text(F.col("t")) & F.col("doc_id").isNotNull())
    one = one.groupBy("doc_id").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, kind, a + 1, e, s) for d, t in zip(b["doc_id"], b["t"]) for a, e, kind, s in find_spans(t, threshold)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos", "end_pos", "score"])

    return one.mapInPandas(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, kind string, start_pos int, end_pos int, score double")


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "comment", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, n_mentions): every id once with its redacted text; null texts stay null, others keep all other text."""
    one = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(text_col).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [None if not isinstance(t, str) else t for t in b["t"]]
            spans = [find_spans(t, threshold) for t in texts]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [None if t is None else _replaced(t, x) for t, x in zip(texts, spans)], "n_mentions": [len(x) for x in spans]})

    return one.mapInPandas(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, text string, n_mentions int")
