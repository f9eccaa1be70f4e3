"""The word lists are whole, and the long ones reach the segmentation."""

import pytest

import tessella as t
from tessella.functions.languages import profile


@pytest.mark.parametrize("code, n", [("da", 473), ("es", 251), ("it", 2225), ("kk", 289), ("nl", 1570)])
def test_lists_are_whole(code, n):
    assert len(set(profile(code).abbreviations)) == n


def test_an_abbreviation_of_the_long_lists(spark):
    text = "El excmo. señor vive aquí. Se fue."
    assert t.Segmenter(language="es").segment(text) == ("El excmo. señor vive aquí.", "Se fue.")
    for code in ("da", "it", "kk", "nl"):
        word = max((w for w in profile(code).abbreviations if w.isalpha() and w.islower()), key=len)
        assert t.Segmenter(language=code).segment(f"Xx {word}. 5 yy.") == (f"Xx {word}. 5 yy.",)
