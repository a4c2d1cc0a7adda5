import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm.sentences import language_of, sentence_ends, sentences

CASES = [
    ["早餐很好。", "房间干净！", "还能看到茶楼吗？！"],
    ["前台说：“请稍等。马上就好。”", "床垫很软。"],
    ["“烧鸡已经没了！”服务员笑着说。", "第2次来。"],
    ["（早餐不含在房费里。）", "泳池很大……", "电梯太慢！！！"],
    ["价格3.5元，离这里1.7公里。", "不错~~。"],
    ["展厅.", "房间安静."],
    ["价格349元，接驳车老旧", "　第56次来，咖啡机实在稳定", " King一直偏咸，书桌也一样"],
    ["住的是 SPA 房，送了 21 张 菱杉糖水 券", "　停车场非常拥挤"],
    ["『夜景が最高！』という看板がありました。", "料金は36.5ドル（朝食は別です。）でした。", "「まで行けますか？」と聞くと、遠いと言われた。"],
    ["ロビーは静かでした", " 『夜景が最高！』という看板がありました", "\n枕は古めでした"],
    ["小女儿问：“还有多远？”", " 第5次来，花园安静", " “没了！”服务员笑着说", "\n午后睡着"],
    ["ห้องพักสบายครับ", " ราคา 3549 บาทต่อคืนถือว่าคุ้มครับ", " พนักงานบอกว่า “รอสักครู่ กำลังทำ” แล้วก็หายไปค่ะ"],
    ["डॉ. मालवंशी ने 4.3 अंक दिए।", " “कमरा तैयार है? हम थक गए हैं!” एक मेहमान ने पूछा।", " दूरी 2.1 कि.मी. है।"],
    ["Mr. Bell and Dr. J. R. Fox vs. the bar: 3.50 dollars!", " It opens at 6 p.m.", " We left at 7 a.m. on Oct. 5.", " No. 39 is approx. 2.1 km off, i.e. far."],
    ['The porter wrote: "Never again. Not for free."', " We stayed."],
    ['"Lovely view!" she said.', " The pool ... well, it was cold.", " Who pays for that?!"],
    ["„Ist noch frei? Wir suchen etwas“, fragte die Frau.", " Am 16. März kamen wir z. B. um 23.30 Uhr an.", " Das Bett im 3. Stock ist gut."],
    ["« C’est prêt ? On attend ! » a crié une dame.", " Elle a répondu : « Bien sûr. Suivez-moi. »", " Serviettes, etc. sont fournis."],
    ["Ella contestó: «Claro. Pasen».", " «¿Está lista? ¡Ya!», gritó alguien.", " La núm. 8 cuesta 4,5 euros, p. ej. hoy."],
    ["Fazit\n", "Von Bach nach Berg braucht man 14 Minuten zu Fuß und\nsteht dann lange.", "\n\n- gutes Bett\n", "Ende."],
    ["1. Das Zimmer war gut.", "\n2. Der Bus kam."],
    ["It was a long walk from the old harbour to the very last one\nof the Museum halls.", " Then we slept."],
    ["Good😀👍", "\nBad! 😀"],
    ["The answer is no.", " We left."], ["We met Max.", " He was kind."], ["It is modern art.", " We liked it."], ["Use vitamin C.", " It helps."],
    ["It got 9 out of 5.", "Our bath was cold."], ["Written by A. B. Karr et al. in vol. 3, art. 5 and no. 7.", " Fine."], ["Es kostete 20.", " Das war viel."],
    ["茶很香.", "wifi也快。", "灯光太暗……", "wifi也慢。"], ["店员说：“好的。马上。”", "wifi也快。"],
]


@pytest.mark.parametrize("parts", CASES)
def test_cases(parts):
    text = "".join(parts)
    ends, at = [], 0
    for p in parts:
        at += len(p)
        ends.append(len(text[:at].rstrip()))
    assert sentence_ends(text) == ends


def test_language():
    assert sentence_ends("Siehe Nr. Das gilt.", "de") == [9, 19]
    assert language_of("the cat and the dog", "de") == "en" and language_of("der Hund und die Katze", None) == "de"
    assert language_of("xyz", "fr") == "fr" and language_of("xyz", "qq") == "" == language_of("", None)
    # a lone letter before a stop is an abbreviation in some languages only
    assert sentence_ends("We saw plan d. Then we left the house.", "en") == [14, 38]
    assert sentence_ends("Wir und z. B. Otto, der kam.", "de") == [28]


def test_a_wrapped_line_end_is_a_blank():
    assert sentence_ends("11\n bก") == [7 - 1]


@pytest.mark.parametrize("text", [None, "", "  \n　\n"])
def test_none(text):
    assert sentence_ends(text) == []


@settings(max_examples=300, deadline=None)
@given(st.text("ab A.。!？“”（）\n\"' 1，好　ก।…~", max_size=60))
def test_ends_are_ordered_and_cover_the_text(text):
    ends = sentence_ends(text)
    assert ends == sorted(set(ends))
    if text.strip():
        assert ends and ends[-1] == len(text.rstrip())
    assert all(not text[e - 1].isspace() for e in ends)


def test_long():
    assert len(sentence_ends("早餐很好。" * 60_000)) == 60_000
    assert len(sentence_ends("“" + "a。" * 1000)) > 500


def test_table(spark):
    rows = [(1, "a. B b! 好。", "x"), (2, None, "x"), (3, "", "x"), (1, "a. B b! 好。", "x")]
    out = sentences(spark.createDataFrame(rows, "doc_id long, text string, end_pos string"))
    assert sorted((r["doc_id"], r["sentence_no"], r["start_pos"], r["end_pos"]) for r in out.collect())[::2] == [(1, 1, 1, 7), (1, 2, 9, 10)]
    assert sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("part", ["“", "“a", "\"", "(“a ", "« a « ", "a. ", "a\n", "あ い "])
def test_very_long_texts_take_no_more_than_their_length(part):
    begun = time.perf_counter()
    assert sentence_ends(part * 60_000)
    assert time.perf_counter() - begun < 5
