"""Quotation marks of several bytes, and letters that share bytes with them."""

from __future__ import annotations

import pytest

from newsdesk.llm import toxicity


@pytest.mark.parametrize("text", ["il a lu « blockhead » à voix haute", "«blockhead»", "leyó “blockhead” así", "er las „blockhead“ À Ý ‚", 'À "blockhead" «à» Ü', "â\n“é blockhead ü” ó"])
def test_quoted_in_any_marks(text):
    got = toxicity.Scorer({"blockhead": 5.0}).features(text.encode())
    assert got[2] > 0 == got[0]


@pytest.mark.parametrize("text", ["À blockhead Ý", "« oui » blockhead «non»", "“a” blockhead “b”", "“ blockhead", "él â‚ blockhead €"])
def test_not_quoted_by_bytes_of_other_letters(text):
    got = toxicity.Scorer({"blockhead": 5.0}).features(text.encode())
    assert got[0] > 0 == got[2]


def test_marks_are_no_part_of_a_word():
    assert {"blockhead", "blockh*"} <= toxicity._terms("«blockhead»".encode())
