import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm.arrowtext import codepoints, to_arrow
from staylens.llm.normalize import normalize_arrow, same_look_pairs, with_normal_form

SAME = [
    ("ＷｉＦｉ　１２", "WiFi 12"), ("café", "café"), ("が", "が"), ("ガ", "ｶﾞ"), ("SPА", "SPA"), ("oﬃce", "office"), ("a​b﻿c", "abc"), ("a b", "a b"), ("a b", "a b"),
    ("⼯作", "工作"), ("施エ中", "施工中"), ("门ロ", "门口"), ("ニ楼", "二楼"), ("了了"[1:], "了"), ("check‑in", "check-in"), ("a\r\nb", "a\nb"), ("한국", "한국"), ("ﾛﾋﾞｰ", "ロビー"),
    ("q̣̇", "q̣̇"), ("ế", "ế"), ("·", "·"), ("｡", "。"), ("（a）", "(a)"), ("Ⅳ", "IV"), ("カ月", "力月"),
    ("ɡood", "good"), ("ᏚPA", "SPA"), ("νilla", "villa"), ("heӏlo", "hello"), ("Ⲟslo", "Oslo"), ("bսs", "bus"),
]
OTHER = [("a", "A"), ("cafe", "café"), ("，", "、"), ("。", "."), ("m²", "m2"), ("①", "1"), ("l", "1"), ("O", "0"), ("未", "末"), ("'", "’"), ("½", "1/2"), ("…", "..."), ("a b", "ab"), ("–", "-"), ("ſ", "s"), ("κ", "k"), ("ı", "i"), ("selIs", "sells")]


def form(t):
    return normalize_arrow(pa.array([t])).to_pylist()[0]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert form(a) != form(b)


def test_readable():
    assert form("ロビーが広い") == "ロビーが広い" and form("工事のエレベーター") == "工事のエレベーター" and form("入ロ") == "入口"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"]), max_size=12)), max_size=6))
def test_batch_is_rowwise_idempotent_and_composed(texts):
    out = normalize_arrow(pa.array(texts, pa.string())).to_pylist()
    assert out == [None if t is None else form(t) for t in texts]
    assert normalize_arrow(pa.array(out, pa.string())).to_pylist() == out
    for t, o in zip(texts, out):
        if t is not None:
            assert form(unicodedata.normalize("NFD", t)) == o == form(unicodedata.normalize("NFC", t))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"]), max_size=9)), max_size=6), st.integers(0, 3))
def test_round_trip(texts, cut):
    arr = pa.array(texts, pa.string()).slice(min(cut, len(texts)))
    assert to_arrow(*codepoints(arr)).to_pylist() == arr.to_pylist()


def test_long_text():
    t = "ｅ́" * 200_000
    assert form(t) == "é" * 200_000
    assert len(np.unique(codepoints(pa.array([form("か" + "゙" * 1000)]))[0])) == 2


def test_pairs(spark):
    rows = [("1", "abc"), ("2", "ａbc"), ("2", "ａbc"), ("3", "abc"), ("4", None), ("5", ""), ("6", "nan"), ("7", "ｎａｎ"), (None, "abc"), ("8", "ab​c"), ("9", "Abc")]
    df = spark.createDataFrame(rows, "doc_id string, comment string").withColumns({})
    got = sorted(map(tuple, same_look_pairs(df).collect()))
    assert got == [("1", "2"), ("1", "8"), ("2", "3"), ("2", "8"), ("3", "8")]
    assert same_look_pairs(df.where("false")).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([("1", "ａ", "x", "y")], "doc_id string, comment string, form string, raw string")
    assert with_normal_form(df, "comment", "f").columns == [*df.columns, "f"]
    assert same_look_pairs(df).count() == 0
    with pytest.raises(ValueError):
        with_normal_form(df, "comment", "raw")
