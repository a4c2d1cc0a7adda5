"""Labelled documents for the text-kind rules, made from a seed: prose, lists, tables and junk in many notations.

Topics and wording are everyday ones (garden, workshop, school, kitchen, weather) and owe nothing to the
collections the rules are applied to; what the rules learn is the form.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

_ZH_THINGS = "锤子 电钻 铅笔 橡皮 书包 台历 番茄 萝卜 南瓜 蜂蜜 面粉 酱油 蝴蝶 企鹅 地图 望远镜 显微镜 吉他 小提琴 羽毛球 自行车 水泵 纸箱 旧报纸 胶水 花盆 铁锹 种子 雨鞋 手电筒 充电器 键盘".split()
_ZH_PLACES = "实验室 操场 菜园 图书馆 仓库 车间 教室 山坡 河边 邮局 果园 邻村 县城 研究所".split()
_ZH = [
    "昨天把{n}搬到{p}去了，结果发现{n}已经坏掉", "其实{n}并不难学，只是需要每天练习", "孩子们在{p}里种下{n}和{n}，每周浇三次水", "这份报告我读过{d}遍，每次都有新的想法", "早知道要下雪，就不会在{p}待到{k}点",
    "他买{n}花掉{d}块，比网上贵一点", "我不同意这个说法，因为数据只来自{d}个样本", "{n}、{n}、{n}以及{n}都得提前准备，缺一样也不行", "雨停以后{p}的石头很滑，走路要小心", "奶奶做的{n}比店里卖的好吃多了",
    "会议从{k}点开到天黑，谁也没有说服谁", "谁能告诉我{n}到底该怎么用", "听{N}的人讲，当地冬天要烧{d}斤柴", "修理工检查过{n}，说是里面进了灰", "她先去{p}，再去{N}，最后才回家吃饭", "这次实验重复{k}次，误差不超过{k}.{k}",
    "老师要求我们写一篇关于{n}的短文", "新买的{n}用起来顺手，声音也小", "{N}发来的{n}少了两个，已经写信去问", "把{n}洗净切碎，放进锅里煮{d}分钟", "风太大，{p}的门关不上", "从{k}月起{p}改在晚上开放", "到{N}要换两次车，一共{k}.{k}小时",
    "{N}{d}路车改线，{p}站停用", "本周气温{k}到{d}度，{N}有雨", "{n}售价{d}元，另收运费{k}元", "周末{p}人多，停车难", "{n}偏贵，{n}一般", "{N}和{N}之间新修铁路，工期{d}天", "{N}出产{n}，{N}出产{n}", "阿{N}家养{d}只羊，日子红火", "{n}颜色鲜艳，{N}那款更便宜", "编号{D}，请核对", "{N}寄来包裹，编号{D}",
    "{n}{v}{a}", "{n}{v}{a}", "{N}{n}，{n}{v}{a}", "{N}{N}一带{n}{v}{a}", "{t}{N}开工，{n}{v}{a}", "{N}{n}、{N}{n}{v}{a}", "{t}收工，{n}{v}{a}，{n}{v}{a}", "{n}{v}{a}，{n}倒{v}{a}", "{n}质地{a}，{n}不够{a}", "{N}{n}{v}{a}", "{t}{n}{v}{a}", "{t}才买到{n}，只得绕道{p}", "{t}修好{n}，{n}{v}{a}", "{N}停电，{t}{v}黑",
    "合同{D}已经盖章，日期{Y}", "有事打{D}，找{N}", "证书号{D}写错一位，{Y}重新办理", "水表读数{d}，上月{d}，差额{k}.{k}吨", "{Y}那天{n}卖出{d}份，{N}卖出{d}份",
]
_ZH_ADVERBS = "很 太 更 最 挺 十分 非常 特别 尤其 相当 比较 极其 过于 略微 不够 并不 从来不 越来越 照样 向来 居然 果然 尤为 稍显 愈发 依然 未免 着实 大体 基本 完全 逐渐 简直 近乎".split()
_ZH_QUALITIES = "粗糙 结实 锋利 甜 酸 沉 轻巧 厚 薄 滑 脏 亮 灵活 笨重 松脆 苦涩 鲜嫩 牢固 简单 深奥 有趣 乏味 准确 模糊".split()
_ZH_TIMES = "早上 上午 下午 夜里 去年 上周 春天 星期三 开学前 放学后 停电时 收工前".split()
_ZH_SHORT = "太好了|没意见|凑合|赞同|收到|谢谢分享|一点也不值|还行吧|有用|看不懂|一般般|好喝|辛苦了|期待下一期|质量好，发货快|屏幕清楚，声音大|天气好|字迹清楚|物美价廉|没毛病|价格便宜，味道好，分量足|做工精细|颜色漂亮，手感好|东西收到了，很满意|挺好|好书|真香|省心省力".split("|")
_JA_THINGS = "金槌 鉛筆 絵の具 かぼちゃ 玉ねぎ 味噌 地図 望遠鏡 ギター 自転車 植木鉢 種 長靴 懐中電灯 電池 消しゴム ノート はさみ".split()
_JA = [
    "昨日は{n}を買いに行きましたが、もう売り切れていました", "{n}の使い方がよく分かりません", "先生に{n}を貸してもらって助かった", "{N}まで電車で{d}分かかる", "子どもたちは庭に{n}を植えました", "{n}と{n}を混ぜて、弱火で{d}分煮ます", "雨が降ったので、試合は{k}月に延期された",
    "{n}、{n}、{n}などを持って来てください", "この本はもう{k}回も読んだ", "誰か{n}を見ませんでしたか", "{N}で作られた{n}は軽くて丈夫だ", "実験の結果は予想とは少し違っていた", "{N}行きは{d}番線、{k}時{d}分発です", "番号は{D}です", "去年{N}で開かれた{n}の展示会には{d}人も集まったそうです", "{N}から{N}へ向かうバスの中に{n}を忘れてしまいました", "{n}が壊れたので{N}の店まで直しに行かなければならない", "{N}の{n}と{N}の{n}とではどちらが丈夫なのか誰も知らない",
    "{N}と{N}と{N}の代表が{N}に集まり{n}について話し合った", "{n}は{d}円、{n}は{d}円だった", "{N}と{N}の間に橋ができた",
]
_JA_SHORT = "なるほど|助かります|よく分かった|いまいち|まあまあ|楽しかった|了解です|おいしい|ありがとう".split("|")
_EN_THINGS = "hammer pencil pumpkin honey atlas telescope guitar bicycle flowerpot battery notebook ladder kettle tomato seed lantern microscope shovel violin envelope".split()
_EN = [
    "Yesterday I carried the {w} up to the attic, and now my back hurts", "Nobody told us that the {w} had to be ordered in {N}", "The teacher asked for {d} words on the {w} and its history", "If it snows again, the match in {N} will be put off",
    "You need a {w}, a {w}, some {w}s and a good deal of patience", "They sold {d} of them within {k} weeks, which nobody had expected", "Why does the {w} make that noise when it is cold", "Her report compares {k} methods and finds that none of them is perfect", "We grew {w}s, {w}s and {w}s behind the shed last year",
    "After the storm it took {d} hours to clear the road to {N}", "My neighbour still thinks that the {w} was stolen", "Boil the {w} for {d} minutes and let it cool", "There was no answer, so he wrote to {N} once more",
    "{N} sells {N} {w}s, {k}.{d}", "{N} Lane, {N} corner: old {w}s sold here", "Tried {N} {w}s, loved {N} {w}s", "{N} mends {w}s, {N} paints {w}s",
    "Invoice {D} was sent on {Y}", "Call {D} and ask for {N} {N}", "{N} beat {N} {k}-{k}, {N} lost to {N}", "Bus {d} stops at {N}, {N} and {N}", "Between {N} and {N} prices fell from {d}.{d} to {k}.{k} pounds", "{N} {N} plays {N}, {N} {N} sings",
]
_DE_THINGS = "Hammer Bleistift Kürbis Honig Atlas Fernrohr Fahrrad Blumentopf Heft Leiter Kessel Samen Laterne Schaufel Geige Umschlag Schraube Pinsel".split()
_DE = [
    "Gestern haben wir den {w} auf den Dachboden getragen", "Niemand wusste, dass der {w} aus {N} kommt", "Wenn es wieder schneit, fällt das Spiel in {N} aus", "Man braucht {w}, {w}, {w} und etwas Geduld", "Nach dem Sturm war die Straße nach {N} {d} Stunden lang gesperrt",
    "Warum macht der {w} so ein Geräusch", "In diesem Heft stehen {d} Aufgaben, von denen die meisten leicht sind", "Mein Nachbar hat mir den {w} geliehen, aber er ist kaputt", "Rechnung {D} kam am {Y} an", "Zug {d} hält in {N}, {N} und {N}",
]
_FR_THINGS = "marteau crayon potiron miel atlas vélo cahier échelle bouilloire graine lanterne pelle violon enveloppe pinceau tournevis".split()
_FR = [
    "Hier nous avons monté le {w} au grenier", "Personne ne savait que le {w} venait de {N}", "S’il neige encore, le match de {N} sera reporté", "Il faut un {w}, un {w}, un {w} et de la patience", "Après la tempête, la route de {N} est restée fermée {d} heures", "Pourquoi le {w} fait-il ce bruit", "Son rapport compare {k} méthodes et n’en retient aucune", "La facture {D} date du {Y}", "Le train {d} dessert {N}, {N}, {N} et {N}", "De {N} à {N}, de {N} à {N}, rien à signaler",
]
_ES_THINGS = "martillo lápiz calabaza miel atlas bicicleta cuaderno escalera tetera semilla linterna pala violín sobre pincel tornillo".split()
_ES = [
    "Ayer subimos el {w} al desván y ahora me duele la espalda", "Nadie sabía que el {w} venía de {N}", "Si vuelve a nevar, el partido de {N} se aplazará", "Hace falta un {w}, un {w}, un {w} y mucha paciencia", "Después de la tormenta la carretera de {N} estuvo cerrada {d} horas", "¿Por qué hace tanto ruido el {w}", "Su informe compara {k} métodos y ninguno es perfecto", "La factura {D} lleva fecha de {Y}", "El tren {d} para en {N}, {N}, {N} y {N}",
]
_LATIN_SHORT = "agreed|well done|no idea|so so|thanks a lot|not worth it|too slow|works fine|danke|geht so|keine Ahnung|schon gut|merci|pas mal|trop lent|gracias|no vale la pena|regular|5/5|+1|top|ok".split("|")
_HEADS = {"zh": ["准备物品：", "清单", "购物单：", "【材料】", "今日作业"], "ja": ["持ち物：", "材料", "【予定】"], "la": ["To buy:", "Materials", "Liste:", "Matériel :", "Lista:"]}
_LABELS = {"zh": "长度 宽度 重量 颜色 价格 数量 温度 湿度 编号 得分".split(), "ja": "長さ 幅 重さ 色 値段 数量 温度 番号".split(), "la": "length width weight colour price amount Länge Preis poids prix peso precio".split()}
_UNITS = ["", "", "kg", "cm", "元", "分", "%", "℃", " €", "h"]
_SMILE = [chr(c) for c in (0x1F600, 0x1F44D, 0x1F389, 0x2764, 0x1F33B, 0x1F4DA, 0x1F622)]


def _level(lead_from: int, lead_to: int) -> list[str]:
    """The characters of some rows of the national set, the common ones in its first rows."""
    return [bytes((a, b)).decode("gb2312") for a in range(lead_from, lead_to) for b in range(0xA1, 0xF0)]


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.common, self.seldom = _level(0xB0, 0xD0), _level(0xD8, 0xF7)

    def pick(self, xs):  # noqa: ANN001, ANN201
        return self.r.choice(xs)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def han(self, n: int, rare: float = 0.4) -> str:
        return "".join(self.pick(self.seldom if self.chance(rare) else self.common) for _ in range(n))

    def name(self) -> str:
        return "".join(self.pick("b d f g h j k l m n p r s t v w z br st kl".split()) + self.pick("a e i o u ei ou".split()) for _ in range(self.r.randint(2, 4))).capitalize() + self.pick(["", "", "n", "rt", "x"])

    def proper(self, kind: str) -> str:
        if kind == "la":
            return self.name() + self.pick(["", "", " Hill", "-Süd", " Viejo", " " + self.name()])
        return self.han(self.r.randint(2, 3)) + self.pick(["村", "镇", "山", "厂", "桥", "店"] if kind == "zh" else ["町", "山", "駅", "店"])

    def code(self) -> str:
        """A number of some kind, as invoices, parcels and telephones have them."""
        digits = "".join(self.pick(string.digits) for _ in range(self.r.randint(6, 18)))
        return self.pick(["", "", "", self.pick(string.ascii_uppercase), "+"]) + (digits if self.chance(0.6) else f"{digits[:3]}{self.pick('- ')}{digits[3:7]}{self.pick('- ')}{digits[7:]}")

    def thing(self, kind: str, lang: str = "") -> str:
        if kind != "la" and self.chance(0.08):  # foreign words stand in any text
            return self.pick(["wifi", "App", "USB", "CD", "LED", "e-mail", "T-shirt", "4K", "café", "Python", "PDF", "mp3", "K3", self.name(), self.name().lower()])
        if kind == "zh":
            return self.pick(_ZH_THINGS) if self.chance(0.5) else self.han(self.r.randint(1, 3)) + self.pick(["花", "茶", "米", "布", "纸", "草", "鱼", "灯", "果", "楼", "园"])
        if kind == "ja":
            return self.pick(_JA_THINGS) if self.chance(0.6) else self.han(2, 0.1) + self.pick(["茶", "紙", "花", "の湯", "園"])
        return self.pick({"en": _EN_THINGS, "de": _DE_THINGS, "fr": _FR_THINGS, "es": _ES_THINGS}[lang or self.pick(["en", "de", "fr", "es"])])

    def entry(self, kind: str) -> str:
        """A list item: a word or a short phrase."""
        x = self.thing(kind)
        how = self.r.random()
        if kind == "la":
            return x if how < 0.3 else f"{self.name()} {x}" if how < 0.6 else f"{self.pick(['small', 'red', 'old', 'neue', 'vieux', 'nuevo'])} {x}" if how < 0.8 else f"{self.r.randint(2, 20)} {x}s"
        if how < 0.55:
            return x
        if how < 0.75:
            return self.pick(["小号", "红色", "备用", "两个", "免费", "手工"] if kind == "zh" else ["小さな", "赤い", "予備の", "無料"]) + x
        return self.proper(kind)

    def sentence(self, kind: str) -> str:
        lang = kind if kind != "la" else self.pick(["en", "en", "de", "fr", "es"])
        s = self.pick({"zh": _ZH, "ja": _JA, "en": _EN, "de": _DE, "fr": _FR, "es": _ES}[lang])
        made: dict[str, Callable[[], str]] = {
            "n": lambda: self.thing(kind), "w": lambda: self.thing("la", lang), "N": lambda: self.proper(kind), "p": lambda: self.pick(_ZH_PLACES) if self.chance(0.6) else self.proper("zh"), "d": lambda: str(self.r.randint(2, 900)), "k": lambda: str(self.r.randint(1, 9)), "D": self.code, "v": lambda: self.pick(_ZH_ADVERBS), "a": lambda: self.pick(_ZH_QUALITIES), "t": lambda: self.pick(_ZH_TIMES), "Y": lambda: self.pick(["{}-{:02}-{:02}", "{}/{}/{}", "{}.{}.{}"]).format(self.r.randint(1990, 2030), self.r.randint(1, 12), self.r.randint(1, 28)),
        }
        parts = s.split("{")
        return parts[0] + "".join(made[p[0]]() + p[2:] for p in parts[1:])

    def kind(self) -> str:
        return self.r.choices(["zh", "ja", "la"], [6, 2, 4])[0]

    def prose(self) -> str:
        kind, how = self.kind(), self.r.random()
        if how < 0.12:
            return self.pick({"zh": _ZH_SHORT, "ja": _JA_SHORT, "la": _LATIN_SHORT}[kind]) + self.pick(["", "", "。", "！", "!", "~"])
        xs = [self.sentence(kind) for _ in range(self.r.randint(1, 9))]
        ends = [". ", ". ", "! ", "? ", "... "] if kind == "la" else ["。", "。", "，", "！", "？", "……", "；"]
        ends = [self.pick(ends)] if self.chance(0.3) else ends
        if how < 0.24:  # points, and one sentence a line
            form = self.pick(["{}. ", "{}、", "({}) ", "{}) ", "- ", "", ""])
            mark = self.pick(["", ".", ";"] if kind == "la" else ["", "。", "；"])
            return self.pick(["", "", self.pick(_HEADS[kind]) + "\n"]) + "\n".join(form.format(i + 1) + x + mark for i, x in enumerate(xs))
        if how < 0.32 and kind != "la":  # no marks at all
            return self.pick([" ", "  ", "　", "\n"]).join(xs)
        if how < 0.38:  # an enumeration inside a sentence
            row = (", " if kind == "la" else "、").join(self.entry(kind) for _ in range(self.r.randint(3, 8)))
            xs.append({"zh": f"这里能看到{row}，都是本地的", "ja": f"棚には{row}が並んでいます", "la": f"On the table we found {row} and nothing else"}[kind])
            self.r.shuffle(xs)
        text = "".join(x + self.pick(ends) for x in xs).strip()
        if self.chance(0.2):
            text = text[:-1] if text[-1] in "，；。" else text
        tail = self.r.random()
        if tail < 0.1:
            return text + "".join(self.pick(_SMILE) for _ in range(self.r.randint(1, 6)))
        if tail < 0.16:
            return text + self.pick(["哈哈哈哈", "！！！", "~~~", "(^_^)", " :-)", "......", "？？？"])
        if tail < 0.22:
            return text + self.pick([" ", "，", "\n"]) + self.pick([f"mail: {self.name().lower()}@{self.name().lower()}.org", f"{self.r.randint(10**9, 10**11)}", f"No. {self.han(1)}{self.r.randint(100, 99999)}-{self.r.randint(1, 99)}", f"http://{self.name().lower()}.net/{self.r.randint(1, 999)}"])
        return text

    def list(self) -> str:
        kind = self.kind()
        xs = [self.entry(kind) for _ in range(self.r.randint(3, 16))]
        head = self.pick(["", "", "", self.pick(_HEADS[kind])])
        how = self.r.random()
        if how < 0.4:
            mark = self.pick(["- ", "* ", "• ", "✓ ", "· ", "+ ", "☐ ", "●", "■ ", "– "])
            second = self.pick([mark, mark, "✗ " if mark in "✓ ☐ " else mark])
            return head + ("\n" if head else "") + "\n".join(self.pick([mark, second]) + x for x in xs)
        if how < 0.55:
            form = self.pick(["{}. ", "{}、", "({}) ", "{}) ", "{}.", "{}: "])
            return head + ("\n" if head else "") + "\n".join(form.format(i + 1) + x for i, x in enumerate(xs))
        if how < 0.65:
            return head + ("\n" if head else "") + "\n".join(xs)
        mark = self.pick([", ", " / ", "; ", " | ", " · "] if kind == "la" else ["、", "、", "，", " / ", "/", "；", " | ", " ", "　"])
        return head + ("" if not head or head[-1] in "：:】" else "：") + mark.join(xs) + self.pick(["", "", "", "。" if kind != "la" else "."])

    def table(self) -> str:
        kind, n = self.kind(), self.r.randint(2, 12)
        unit = self.pick(_UNITS)
        names = [self.entry(kind) for _ in range(n)] if self.chance(0.6) else [self.pick(_LABELS[kind]) for _ in range(n)]
        rows = [[a, str(self.r.randint(1, 9999)), f"{self.r.randint(0, 99)}.{self.r.randint(0, 99)}{unit}", self.pick(["A", "B", "ok", "-", self.han(2, 0.1), "2021-03-05"])][: self.r.choice([2, 3, 3, 4])] for a in names]
        head = [self.pick(_LABELS[kind]) for _ in rows[0]]
        with_head = [head, *rows] if self.chance(0.5) else rows
        how = self.r.randrange(10)
        if how == 0:
            return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])
        if how == 1:
            return "\n".join(self.pick([",", ","]).join(r) for r in with_head)
        if how == 2:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in with_head) + "</table>"
        if how == 3:
            return "\n".join("".join(f"{c:<{w}}" for c, w in zip(r, (16, 8, 10, 8))) for r in with_head)
        if how == 4:
            return self.pick(["; ", ";", " ", ", ", "\n"]).join(f"{r[0]}={'/'.join(r[1:])}" for r in rows)
        if how == 5:
            return "\n".join("\t".join(r) for r in with_head)
        if how == 6:
            return "\n".join(f"{r[0]}：{r[-1]}" for r in rows)
        if how == 7:
            return "{" + ", ".join(f'"{r[0]}": {r[1]}' for r in rows) + "}"
        if how == 8:
            return "\n".join(self.pick([" | ", "|"]).join(r) for r in with_head)
        return "\n".join(f"{r[0]}{self.pick([': ', ' - ', ' -> '])}{r[-1]}" for r in rows)

    def junk(self) -> str:
        n, how = self.r.randint(8, 120), self.r.randrange(13)
        if how == 0:
            return "".join(self.pick(string.ascii_letters + string.digits + "+/") for _ in range(n)) + self.pick(["", "=", "=="])
        if how == 1:
            return "".join(self.pick("!?&%$#@^*()_+=|<>~/--;:,.") for _ in range(n))
        if how == 2:
            return "".join(chr(self.r.choice([0x1F300, 0x1F600, 0x1F680, 0x2600]) + self.r.randrange(70)) for _ in range(n))
        if how == 3:
            return self.sentence(self.pick(["zh", "ja"])).encode().decode(self.pick(["latin-1", "latin-1", "cp1252"]), "replace")
        if how == 4:
            return self.sentence(self.pick(["zh", "ja"])).encode(self.pick(["gb18030", "utf-8"]), "ignore")[self.r.randrange(2) :].decode(self.pick(["latin-1", "utf-8", "cp1252"]), "replace") + "�" * self.r.randrange(2, 6)
        if how == 5:
            tags = [f"<div id={self.name().lower()}>", "</div>", "<br>", "&nbsp;", "&#39;", "{{" + self.name().lower() + "}}", f'<a href="/{self.name().lower()}">', "</a>", "[/b]", "[img]", "<td>", "</li>", "&quot;"]
            return "".join(self.pick(tags) + self.pick(["", "", " ", self.name().lower()]) for _ in range(max(3, n // 8)))
        if how == 6:
            return "".join(self.pick("qwertyuiopasdfghjklzxcvbnm;'" if self.chance(0.5) else "sdfghjkl") for _ in range(n))
        if how == 7:
            return self.pick(["好", "啊", "x", "7", "。", "!", ".", "ー", "?", "草", "~", "=", "#"]) * n
        if how == 8:
            word = self.pick(["yes", "haha", "真的", "加油", "nein", "test", "never", "すごい", "顶", self.name().lower(), self.han(2, 0.1)])
            return self.pick([" ", "", "，", ", ", "\n", "！"]).join([word] * max(5, n // 4))
        if how == 9:
            return self.han(n // 3 + 6, 0.7)
        if how == 10:
            return "".join(chr(self.r.randrange(0x4E00, 0x9FA5)) for _ in range(n // 3 + 6))
        if how == 11:
            return " ".join("".join(self.pick(string.ascii_letters + string.digits) for _ in range(self.r.randint(3, 14))) for _ in range(n // 8 + 2))
        return "".join(self.pick("★☆●■◆→←↑↓※§▲▼♥♪✿▒░┃━") for _ in range(n))


def documents(n: int, seed: int) -> list[tuple[str, str]]:
    """``n`` (label, text) rows: four in seven prose, the rest lists, tables and junk in equal parts."""
    m = _Maker(seed)
    makers = [("prose", m.prose)] * 4 + [("list", m.list), ("table", m.table), ("junk", m.junk)]
    return [(label, make()) for label, make in (makers[i % len(makers)] for i in range(n))]
