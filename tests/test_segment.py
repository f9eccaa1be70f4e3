"""Sentences and spans of texts written for the rules they exercise."""

import pytest
from pyspark.sql import functions as F

from tessella.functions.languages import CODES, Profile, profile
from tessella.operators.segment import by_language, check_options, segment, sentences

CASES = {
    "en": [
        ("We left early. Nobody saw us.", ["We left early.", "Nobody saw us."]),
        ("Is it you? Yes! Come in.", ["Is it you?", "Yes!", "Come in."]),
        ("My tutor was Dr. Lowe of Leeds.", ["My tutor was Dr. Lowe of Leeds."]),
        ("She moved to the U.S. How odd.", ["She moved to the U.S.", "How odd."]),
        ("He reports to the U.S. Senate today.", ["He reports to the U.S. Senate today."]),
        ("Read p. 12 and no. 5 first.", ["Read p. 12 and no. 5 first."]),
        ("It rose by 3.5 points. Then it fell.", ["It rose by 3.5 points.", "Then it fell."]),
        ("“Stop. Now.” That was all.", ["“Stop. Now.”", "That was all."]),
        ("The list (see it. now. then.) is short. Good.", ["The list (see it. now. then.) is short.", "Good."]),
        ("1) Wash it. 2) Dry it.", ["1) Wash it.", "2) Dry it."]),
        ("I waited.... She came.", ["I waited....", "She came."]),
        ("One.\nTwo without a mark\n***\nThree.", ["One.", "Two without a mark", "***", "Three."]),
        ("We use Yahoo! every day. Really.", ["We use Yahoo! every day.", "Really."]),
    ],
    "de": [("Das war am 3. Mai 1999. Danach kam er.", ["Das war am 3. Mai 1999.", "Danach kam er."]), ("„Komm her. Schnell.“ Er ging.", ["„Komm her. Schnell.“", "Er ging."])],
    "es": [("La Sra. Paz vive aquí. ¿Quién es?", ["La Sra. Paz vive aquí.", "¿Quién es?"])],
    "fr": [("Il dort. Elle lit !", ["Il dort.", "Elle lit !"])],
    "hi": [("यह घर है। वह बाग है।", ["यह घर है।", "वह बाग है।"])],
    "zh": [("我来了。你呢？", ["我来了。", "你呢？"])],
    "ja": [("これは本です。「行く。来る。」と言った。", ["これは本です。", "「行く。来る。」と言った。"])],
    "ur": [("یہ گھر ہے۔ وہ کون ہے؟", ["یہ گھر ہے۔", "وہ کون ہے؟"])],
    "hy": [("Սա տուն է։ Դա այգի է։", ["Սա տուն է։", "Դա այգի է։"])],
    "am": [("ቤት ነው። ማን ነው?", ["ቤት ነው።", "ማን ነው?"])],
    "el": [("Τι είναι αυτό; Είναι σπίτι.", ["Τι είναι αυτό;", "Είναι σπίτι."])],
    "ru": [("Это А. С. Пушкин. Он поэт.", ["Это А. С. Пушкин.", "Он поэт."])],
    "ar": [("هل أنت هنا؟ نعم!", ["هل أنت هنا؟", "نعم!"])],
}


@pytest.mark.parametrize("code", sorted(CASES))
def test_sentences(spark, code):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES[code])], "id int, text string")
    got = segment(df, language=code).orderBy("id").collect()
    assert [[s.strip() for s in r.sentences] for r in got] == [e for _, e in CASES[code]]


def test_blank_texts_have_no_sentences(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (4, "x")], "id int, text string")
    for options in ({}, {"char_span": True}, {"clean": True}, {"clean": True, "char_span": True}):
        got = {r.id: len(r.sentences) for r in segment(df, **options).collect()}
        assert got == {1: 0, 2: 0, 3: 0, 4: 1}
        assert sentences(segment(df, **options), "id").count() == 1


def test_spans_cover_text_and_repeat(spark):
    texts = ["Same. Same.  Same.\n\nLast one", "  Lead. Tail.  ", "A . . . b. C!! D"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in segment(df, char_span=True).collect():
        t = texts[r.id]
        for s in r.sentences:
            assert (s.raw_slice, s.clean_start, s.clean_end) == (t[s.start : s.end], s.start, s.end)
        assert "".join(s.raw_slice for s in r.sentences) == t.lstrip()
        assert all(a.end == b.start for a, b in zip(r.sentences, r.sentences[1:]))
        assert not any(0xE000 <= ord(c) <= 0xF8FF for s in r.sentences for c in s.sent)


def test_clean_spans_point_into_the_raw_text(spark):
    raw = "<p>One is here. Two is there.</p>\n\nThree has ``marks'' and <b>bold</b>."
    got = segment(spark.createDataFrame([(raw,)], "text string"), clean=True, char_span=True).first().sentences
    assert [s.sent.strip() for s in got] == ["One is here.", "Two is there.", 'Three has "marks" and bold.']
    assert got[0].start == 3 and raw[got[1].start : got[1].end].startswith("Two is there.")
    assert raw[got[2].start : got[2].end].endswith("<b>bold</b>.")


def test_pdf_lines(spark):
    df = spark.createDataFrame([("This is a sen- \ntence\ncut in two. Next.",)], "text string")
    assert [s.strip() for s in segment(df, clean=True, doc_type="pdf").first().sentences] == ["This is a sen- tence cut in two.", "Next."]


def test_options(tmp_path):
    with pytest.raises(ValueError, match="requires `clean=True`"):
        check_options("en", False, "pdf")
    with pytest.raises(ValueError, match="Provide valid language ID"):
        check_options("xx", False, "")
    assert check_options("", False, "") is None
    assert len(CODES) == 23 and all(profile(c).code == c for c in CODES)
    file = tmp_path / "nl.toml"
    file.write_text('abbreviations = ["b.v", "bijv"]\n')
    assert Profile.load(str(file)).abbreviations == ("b.v", "bijv")


def test_own_profile(spark):
    own = Profile("x", abbreviations=("qqq", "z.b"), starters=("Then",))
    df = spark.createDataFrame([("See qqq. it and z.b. that. End.",)], "text string")
    assert len(segment(df, language=own).first().sentences) == 2


def test_each_row_its_language(spark):
    rows = [(1, "de", "Am 3. Mai. Gut."), (2, "en", "On 3. Mai. Good."), (3, None, "x. Y"), (4, "??", "x. Y")]
    df = spark.createDataFrame(rows, "id int, lang string, text string")
    got = {r.id: len(r.sentences) for r in by_language(df, "lang", ["de", "en"]).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == 2


def test_long_and_hostile_texts(spark):
    texts = ["word " * 50_000, "<a " + 'x="1" ' * 2_000, "'" + "don't stop " * 5_000, "(" * 3_000, '"' * 3_001, "a." * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.n for r in segment(df).select("id", F.size("sentences").alias("n")).collect()}
    assert got[0] == 1 and len(got) == 6
    assert segment(df.where("id < 3"), clean=True).count() == 3


def test_plan_stays_narrow(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "A b. C d.")], "id long, text string").write.parquet(path)
    plan = sentences(segment(spark.read.parquet(path)), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and len(plan) < 300_000
