"""The string-level interface."""

import pytest

import tessella as t


def test_segmenter(spark):
    assert t.Segmenter().segment("Good day world! See Mr. Lowe.") == ("Good day world!", "See Mr. Lowe.")
    spans = t.Segmenter(char_span=True).segment("Good day world! See it.")
    assert spans == (t.TextSpan("Good day world! ", 0, 16), t.TextSpan("See it.", 16, 23))
    assert (spans[0].raw_slice, spans[0].clean_end) == ("Good day world! ", 16)
    assert t.Segmenter().segment("") == t.Segmenter().segment(" \n") == t.Segmenter(language="").segment(None) == ()
    with pytest.raises(ValueError):
        t.Segmenter(doc_type="pdf")


def test_stream_equals_batch(spark):
    text = "One. Two.\n\nThree! Four.\n\n\nFive."
    for n in (1, 2, 10):
        assert tuple(t.Segmenter().stream(text, chunk_paragraphs=n)) == t.Segmenter().segment(text)
    spans = list(t.Segmenter(char_span=True).stream(text, chunk_paragraphs=1))
    assert [s.trailing_delim for s in spans] == ["", "\n\n", "", "\n\n\n", ""]
    assert all(text[s.start : s.end] == s.raw_slice for s in spans)
    with pytest.raises(ValueError):
        list(t.Segmenter().stream(text, chunk_paragraphs=0))


def test_normalize(spark):
    assert t.normalize(None) is None and t.normalize("") == ""
    got = t.normalize_with_map("<b>Hi</b> ``you''")
    assert got.text == 'Hi "you\'' or got.text == 'Hi "you"'
    assert got.offset_map.clean_to_raw(0) == 3 and got.offset_map.clean_span_to_raw_span(0, 2)[0] == 3
    assert t.normalize_with_map("").offset_map == t.OffsetMap.identity(0)


def test_disambiguate(spark):
    assert t.disambiguate(" Ab cd.  Ef gh. ", config="en") == ("Ab cd.", "Ef gh.")
    assert t.disambiguate(" Ab cd.  Ef gh. ", char_span=True) == ((1, 7), (9, 15))
    assert t.disambiguate("") == ()
