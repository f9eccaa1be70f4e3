"""Cleaning, list markers, offset maps, chunks, joins, files and the stream."""

import bisect
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions.languages import profile
from tessella.functions.sentinels import unmask
from tessella.operators import cleaning, lists, offsets
from tessella.operators.chunks import chunks, segment_chunks
from tessella.operators.joins import asof, islands
from tessella.sources.files import read_texts, write_lines
from tessella.streaming.sentences import read_documents, stream_sentences, write_available

CLEANED = [
    ("<b>Hi</b> you", "Hi you"),
    ("a &lt;p&gt; b", "a  b"),
    ("&lt;strong&gt; stays", "&lt;strong&gt; stays"),
    ("x{b^>12<b^}y", "xy"),
    ("``so'' and `it'", "\"so\" and 'it'"),
    ("Part ..... 12-13 next", "Part \r next"),
    ("what ......then", "what  then"),
    ("a///b", "ab"),
    ("It ended.Then www.Site.com.Now", "It ended. Then www.Site.com.Now"),
    ("in the\nof\nword", "in theof\rword"),
    ("line \nmore", "line more"),
    ("one\n\nTwo\n.\nThree", "one\rTwo.\rThree"),
    (r"a\nb\rc", "a\nb\rc"),
    (None, None),
    ("", ""),
]


def test_cleaning(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANED)], "id int, text string")
    got = [r.text for r in cleaning.clean(df, profile=profile("en")).orderBy("id").collect()]
    assert got == [e for _, e in CLEANED]


def test_custom_rules_come_first(spark):
    df = spark.createDataFrame([("foo <x> $1",)], "text string")
    assert cleaning.clean(df, custom=[("foo", "<i>$")]).first().text == "<i>$  $1"


MARKERS = [
    ("1. red 2. blue", "1. red\r2. blue"),
    ("7. red 9. blue", "7. red 9. blue"),
    ("1. alone", "1. alone"),
    ("see room 4) there", "see room 4) there"),
    ("(a) x (b) y", "(a) x\r(b) y"),
    ("i. x ii. y iii. z", "i. x\rii. y\riii. z"),
    ("(iv) a (v) b", "(iv) a\r(v) b"),
    ("one • two ⁃ three", "one\r• two\r⁃ three"),
    ("wait for 1. then 2. go", "wait for 1. then\r2. go"),
    ("a) x c) y", "a) x c) y"),
]


def test_list_markers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MARKERS)], "id int, text string")
    for r in lists.mask_lists(df, "text").withColumn("plain", unmask(F.col("text"))).collect():
        before, after = MARKERS[r.id]
        assert (r.plain, len(r.text)) == (after, len(before))


def test_roman_table():
    assert len(lists.ROMAN) == 100 and lists.ROMAN[80] == "lxxxxi" and lists.ROMAN[98] == "xcix" and len(set(lists.ROMAN)) == 100


def _plain_map(text, rules):
    """Each kept character's raw place, by brute force: every rule maps the places of what it leaves."""
    keys, deltas, raw = [], [], len(text)

    def look(k):
        i = bisect.bisect_right(keys, k) - 1
        return min(raw, k + (deltas[i] if i >= 0 else 0))

    for pattern, to in rules:
        found = list(re.finditer(pattern, text))
        if not found:
            continue
        new, out, last = [], "", 0
        for m in found:
            new += [(len(out) + k - last, look(k)) for k in keys if last < k <= m.start() or (k == last == 0)]
            out += text[last : m.start()] + to
            new = [x for x in new if x[0] != len(out)] + [(len(out), look(m.end()))]
            last = m.end()
        new += [(len(out) + k - last, look(k)) for k in keys if k > last]
        text = out + text[last:]
        pairs = sorted(new)
        keys, deltas = [k for k, _ in pairs], [r - k for k, r in pairs]
    return text, [look(k) for k in range(len(text) + 1)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab<>/ \n`'.", max_size=24), min_size=1, max_size=6))
def test_offset_maps(spark, texts):
    rules = [(r"<[ab]>", ""), ("''", '"'), (r"\n\n", "\r"), (r"\n", "\r"), ("a", "xyz")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    df = df.withColumns({"t": F.col("text"), "__keys": F.array().cast(offsets._KEYS), "__raw_length": F.length("text")})
    for p, to in rules:
        df = offsets._follow(df, "t", cleaning.Edit(p, to))
    df = df.withColumn("m", F.struct(F.col("__keys").alias("keys"), F.col("__raw_length").alias("raw_length")))
    got = df.withColumn("at", offsets.places(F.col("m"), F.sequence(F.lit(0), F.length("t")))).collect()
    for r in got:
        text, places = _plain_map(texts[r.id], rules)
        assert (r.t, r.at) == (text, places)


def test_identity_and_spans(spark):
    df = spark.range(1).select(offsets.identity(F.lit(5)).alias("m"))
    r = df.select(offsets.to_raw(F.col("m"), F.lit(3)).alias("a"), offsets.span_to_raw(F.col("m"), F.lit(2), F.lit(9)).alias("s")).first()
    assert (r.a, r.s.start, r.s.end) == (3, 2, 5)


TEXT = "A b. C d.\n\nE f.\r\n\r\nG h.\n\n\nI j."


@pytest.mark.parametrize("n", [1, 2, 9])
def test_chunks(spark, n):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, " "), (4, "\n\nx\n\n")], "id int, text string")
    rows = chunks(df, paragraphs=n).orderBy("id", "chunk").collect()
    assert "".join(r.chunk_text for r in rows if r.id == 1) == TEXT and {r.id for r in rows} == {1, 4}
    for r in segment_chunks(df, char_span=True, paragraphs=n).where("id = 1").collect():
        assert all(TEXT[s.start : s.end] == s.raw_slice for s in r.sentences)
    with pytest.raises(ValueError, match="at least 1"):
        chunks(df, paragraphs=0)


def test_asof_and_islands(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "g string, t int, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 0, "z")], "g string, t int, v string")
    got = {r.id: r.v for r in asof(left, right, "t", ["g"], ["v"]).collect()}
    assert got == {1: "y", 2: None, 3: None}
    rows = spark.createDataFrame([(0, "..", 0, 2), (1, "a", 3, 4), (2, "!", 5, 6), (3, "b", 7, 8)], "at int, s string, a int, b int").withColumn("g", F.lit(1))
    out = islands(rows, ["g"], "at", F.rlike("s", F.lit(r"\w")), "a", "b").orderBy("a").collect()
    assert [(r.a, r.b) for r in out] == [(0, 2), (3, 6), (7, 8)]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"One. Two \xff.")
    assert read_texts(spark, str(tmp_path / "in")).first().text == "One. Two �."
    docs = spark.createDataFrame([(1, "One. Two."), (2, "Three!"), (3, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    rows = stream_sentences(read_documents(spark, str(tmp_path / "docs"), docs.schema), "doc_id")
    write_available(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.sent_id, r.sent) for r in back.collect()) == [(1, 0, "One."), (1, 1, "Two."), (2, 0, "Three!")]
    write_lines(back, str(tmp_path / "lines"), "doc_id", "sent_id")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["[0] One.", "[0] Three!", "[1] Two."]


def test_asof_by_slices_gives_the_same(spark):
    """A hot key, ties, nulls, empty slices and groups without right rows."""
    import random

    rng = random.Random(2)
    place = lambda: rng.choice([None, *range(100)])
    left = spark.createDataFrame([(rng.choice(["hot", "hot", "a", "b", None]), place(), i) for i in range(300)], "g string, t int, id int")
    right = spark.createDataFrame([(rng.choice(["hot", "hot", "a", None]), place(), rng.randrange(50)) for _ in range(60)], "g string, t int, v int")
    want = sorted(map(str, asof(left, right, "t", ["g"], ["v"]).collect()))
    for width in (1, 7, 40):
        assert sorted(map(str, asof(left, right, "t", ["g"], ["v"], F.floor(F.col("t") / width)).collect())) == want
    assert asof(left.where("false"), right, "t", ["g"], ["v"], F.col("t")).count() == 0
    assert asof(left, right.where("false"), "t", ["g"], ["v"], F.col("t")).where("v IS NOT NULL").count() == 0
