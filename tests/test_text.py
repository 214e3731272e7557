"""Hand-derived cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from loam.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,n", [("", 0), ("   ", 1), ("hello world", 4), ("Привет мир", 5), ("ё" * 10, 3), ("е" * 10, 6), ("a\tb", 1), ("Hi. Привет 42", 5), (None, 0)])
def test_token_estimate(spark, text, n):
    assert value(spark, tx.token_estimate(F.lit(text).cast("string"))) == n


def test_blank_counts_nothing(spark):
    assert value(spark, tx.token_count(F.lit("   "))) == 0


@pytest.mark.parametrize(
    "pieces,chunks",
    [(["aaaa.", "bbbb.", "cccc."], ["aaaa. bbbb.", "bb. cccc."]), (["aaaa.", "bbbbb.", "cccc."], ["aaaa. bbbbb.", "bb. cccc."]), (["aaaa.", "bbbbbb."], ["aaaa.", "aa. bbbbbb."]), (["x" * 20 + ".", "yy."], ["x" * 20 + ".", "xx. yy."])],
)
def test_packing(spark, pieces, chunks):
    assert value(spark, tx.packed(F.array(*map(F.lit, pieces)), 12, 4)) == chunks


def test_packing_without_overlap_repeats_nothing(spark):
    assert value(spark, tx.packed(F.array(*map(F.lit, ["aaaa.", "bbbbbb.", "c."])), 12, 0)) == ["aaaa.", "bbbbbb. c."]


@pytest.mark.parametrize("s,ok", [("a" * 9, False), ("a" * 10, True), ("a" * 500, True), ("a" * 501, False), ("1234567890", False), ("ABCDEFghij", False), ("ABCDEfghij", True)])
def test_eligible(spark, s, ok):
    assert value(spark, tx.eligible_sentence(F.lit(s))) is ok


@pytest.mark.parametrize("reply,places", [("3, 1, 5", [2, 0, 4]), ("", []), ("none", [0, 1, 2, 3, 4]), ("0, 9", [0, 1, 2, 3, 4]), ("1., 2", [1]), ("3 1", [0, 1, 2, 3, 4]), ("2,2", [1]), ("²", [0, 1, 2, 3, 4])])
def test_reranked(spark, reply, places):
    assert value(spark, tx.reranked(F.lit(reply), F.lit(5))) == places


@pytest.mark.parametrize("answer,ok", [("Я не нашел информации в документах", False), ("Париж", True), ("", True)])
def test_answered(spark, answer, ok):
    assert value(spark, tx.answered(F.lit(answer))) is ok


def test_split_by_tokens_loses_nothing(spark):
    text = "Aa bb. " + "w" * 95 + " cc dd! " + " ".join(["word"] * 40)
    got = value(spark, tx.split_by_tokens(F.lit(text), 10))
    assert "".join("".join(got).split()) == "".join(text.split())
    assert max(map(len, got)) <= 20


def test_cleaned_reply(spark):
    assert value(spark, tx.cleaned_reply(F.lit("```\n[('A','r','B')]\n```"))) == "[('A','r','B')]"


@pytest.mark.parametrize("name,words", [("Report-2024.pdf", ["report", "2024", "pdf"]), (None, [])])
def test_name_terms(spark, name, words):
    assert value(spark, tx.name_terms(F.lit(name).cast("string"))) == words
