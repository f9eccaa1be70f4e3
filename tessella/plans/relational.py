"""Corpus queries: lines, tokens, lexicons, islands, as-of lookups, statistics, streaming; and segmentation of the corpus."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.languages import CODES, profile
from tessella.operators import offsets
from tessella.operators.chunks import chunks, segment_chunks
from tessella.operators.cleaning import HTML
from tessella.operators.joins import asof, in_lexicon, islands
from tessella.operators.segment import by_language, segment, sentences
from tessella.operators.splitting import _trim, lines
from tessella.sources.files import numbered_lines
from tessella.streaming.sentences import read_documents, stream_sentences, write_available


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table's texts, dealt over all cores if its files give fewer tasks than that; large tables are read as they are."""
    df, n = _table(spark, sf_dir, name).select(*cols), spark.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, line_id, start_at, line: the lines of all documents that are not blank."""
    df = lines(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "text")
    df = df.select("doc_id", "lang", "source", F.posexplode_outer("__lines").alias("line_id", "x"))
    return df.select("doc_id", "lang", "source", "line_id", F.col("x.at").alias("start_at"), F.col("x.line").alias("line")).where("length(trim(line)) > 0")


_LINES = "(SELECT doc_id, lang, source, CAST(i - 1 AS INTEGER) AS line_id, CAST(coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS start_at, l[i] AS line FROM (SELECT doc_id, lang, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)) WHERE length(trim(l[i])) > 0)"


def blank_filter(spark, sf_dir):
    """Conversations' lines that are not blank, with what they hold: a digit, a word, an end mark."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_id", "line"))
    has = lambda p: F.rlike("line", F.lit(p))
    return turns.where(~has(r"^\s*$")).select("conv_id", "turn", "line_id", has(r"\d").alias("digit"), has("[A-Za-z]").alias("word"), F.right("line", F.lit(1)).isin(".", "!", "?").alias("ended"))


def word_sets(spark, sf_dir):
    """Distinct words of each benchmark item, and whether any or all of them are among a few."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " +")).alias("words"))
    few = F.array(F.lit("the"), F.lit("of"))
    return items.select("item_id", F.size("words").cast("long").alias("n"), F.arrays_overlap("words", few).alias("some"), F.forall(few, lambda w: F.array_contains(F.col("words"), w)).alias("every"), F.array_join(F.array_sort(F.array_union("words", few)), " ").alias("with_few"))


def split_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_id", "start_at", F.length("line").alias("n"))


def trim_spans(spark, sf_dir):
    cut = _lines(spark, sf_dir).withColumn("core", _trim(F.col("line")))
    return cut.select("doc_id", "line_id", "core", (F.col("start_at") + F.length(F.regexp_extract("line", r"(?U)^\s*", 0))).alias("from_at"))


def symbol_lines(spark, sf_dir):
    return _lines(spark, sf_dir).where(~F.rlike("line", F.lit("[\\p{L}\\p{N}_]"))).select("doc_id", "line_id", "line")


def _matches(spark, sf_dir) -> DataFrame:
    """Runs of words and marks of the parts' names, with their places."""
    text = F.expr("p_name || ' .. ' || p_brand || '! ? ' || lower(p_type) || '.'")
    df = _table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    df = df.withColumn("m", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    df = df.select("p_partkey", F.posexplode_outer("m").alias("place", "piece"))
    before = Window.partitionBy("p_partkey").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece") + 1).over(before), F.lit(0)).cast("int")
    return df.withColumn("start_at", start).withColumn("end_at", (F.col("start_at") + F.length("piece")).cast("int"))


_MATCHES = "(SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, m[i] AS piece, CAST(coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS start_at, CAST(list_sum(list_transform(m[1:i], lambda x: length(x) + 1)) - 1 AS INTEGER) AS end_at FROM (SELECT p_partkey, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT p_partkey, regexp_extract_all(p_name || ' .. ' || p_brand || '! ? ' || lower(p_type) || '.', '\\S+') AS m FROM part)))"


def boundary_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


def noise_merge_islands(spark, sf_dir):
    return islands(_matches(spark, sf_dir), ["p_partkey"], "place", F.rlike("piece", F.lit(r"\w")), "start_at", "end_at")


def _tokens(spark, sf_dir) -> DataFrame:
    text = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z]+)\."), F.lit(1))).alias("word"))


def _lexicon(spark: SparkSession, code: str = "en") -> DataFrame:
    return spark.createDataFrame([(w,) for w in profile(code).abbreviations], "abbr string")


def lexicon_semi_join(spark, sf_dir):
    return in_lexicon(_tokens(spark, sf_dir), "word", _lexicon(spark), "abbr").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def lexicon_set_lookup(spark, sf_dir):
    known = F.lower("word").isin(list(profile("en").abbreviations))
    return _tokens(spark, sf_dir).where(known).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def lexicon_anti_join(spark, sf_dir):
    return in_lexicon(_tokens(spark, sf_dir), "word", _lexicon(spark), "abbr", keep=False).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _values(code: str, field: str) -> str:
    return "(SELECT unnest([" + ", ".join("'" + w.replace("'", "''") + "'" for w in getattr(profile(code), field)) + "]) AS abbr)"


def _words(spark, code, field):
    return spark.createDataFrame([(w,) for w in getattr(profile(code), field)], "abbr string")


def lexicon_union(spark, sf_dir):
    return reduce(DataFrame.union, [_words(spark, "en", f) for f in ("abbreviations", "prepositive", "number")]).distinct()


def lexicon_except(spark, sf_dir):
    return _words(spark, "en", "prepositive").subtract(_words(spark, "de", "abbreviations"))


def lexicon_intersect(spark, sf_dir):
    return _words(spark, "en", "abbreviations").intersect(_words(spark, "de", "abbreviations"))


def lexicon_longest_first(spark, sf_dir):
    w = Window.orderBy(F.desc(F.length("abbr")), "abbr")
    return _words(spark, "en", "abbreviations").distinct().select("abbr", F.row_number().over(w).alias("place"))


def language_config_join(spark, sf_dir):
    configs = spark.createDataFrame([(c, len(profile(c).abbreviations), profile(c).all_periods) for c in CODES], "lang string, n_abbr int, all_periods boolean")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(F.broadcast(configs), "lang", "left").select("doc_id", "lang", "n_abbr", "all_periods")


def line_stats_by_lang(spark, sf_dir):
    n = F.length("line")
    return _lines(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("deviation"), F.percentile(n, 0.5).alias("middle"))


def char_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.size(F.split(F.trim("text"), " +")).cast("long").alias("pieces"))


def lines_cube_lang_source(spark, sf_dir):
    return _lines(spark, sf_dir).cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def lines_rollup_lang_source(spark, sf_dir):
    return _lines(spark, sf_dir).rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def longest_lines_topk(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_id", F.length("line").alias("n")).orderBy(F.desc("n"), "doc_id", "line_id").limit(25)


def duplicate_lines(spark, sf_dir):
    """Pre-aggregated by line, so a line that millions share is one row per task before it is shuffled."""
    one = _lines(spark, sf_dir).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return one.where("n > 1")


def benchmark_overlap_semi(spark, sf_dir):
    wanted = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0").distinct()
    return _lines(spark, sf_dir).join(wanted, "line", "left_semi").select("doc_id", "line_id")


def benchmark_overlap_anti(spark, sf_dir):
    wanted = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0").distinct()
    return _lines(spark, sf_dir).join(wanted, "line", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def conversations_lines_by_role(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("role", F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0")
    return turns.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def pass_counts(spark, sf_dir):
    ends = F.rlike("line", F.lit(r"[.!?]\s*$"))
    return _lines(spark, sf_dir).groupBy("source").agg(F.sum(F.when(ends, 1).otherwise(0)).alias("passed"), F.sum(F.when(ends, 0).otherwise(1)).alias("failed"))


def neighbour_lines(spark, sf_dir):
    """Neighbours are beside each other in their document's array, so nothing is shuffled."""
    df = lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    numbered = F.transform("__lines", lambda x, i: F.struct(i.alias("line_id"), x["at"].alias("at"), F.length(x["line"]).alias("n"), (F.length(F.trim(x["line"])) > 0).alias("full")))
    df = df.select("doc_id", F.filter(numbered, lambda x: x["full"]).alias("l"))
    beside = F.transform("l", lambda x, i: F.struct(x["line_id"].alias("line_id"), F.get("l", i - 1)["n"].alias("before"), F.get("l", i + 1)["n"].alias("after"), F.get("l", i + 1)["at"].alias("next_start")))
    return df.select("doc_id", F.explode_outer(beside).alias("x")).select("doc_id", "x.*").where(F.col("line_id").isNotNull())


def paragraph_chunks(spark, sf_dir):
    """Documents as paragraphs: lines joined by blank lines, cut into chunks of five."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n+", "\n\n").alias("text"))
    return chunks(docs, paragraphs=5).select("doc_id", "chunk", "chunk_start", F.length("chunk_text").alias("n"))


def asof_offset_projection(spark, sf_dir):
    """Each error with the last click of the same user not later than it."""
    return _last_clicks(spark, sf_dir, "error").select("event_id", "click_id", "click_value")


def asof_purchases_and_errors(spark, sf_dir):
    """Each purchase or error with the last click of the same user not later than it."""
    return _last_clicks(spark, sf_dir, "purchase", "error")


def _last_clicks(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Sliced by day, so that a user with very many events is not one task."""
    events = _table(spark, sf_dir, "events")
    left = events.where(F.col("event_type").isin(*kinds)).select("user_id", "ts", "event_id", "event_type")
    right = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    found = asof(left, right, "ts", ["user_id"], ["click_id", "click_value"], F.to_date("ts"))
    return found.select("event_id", "event_type", "click_id", "click_value")


def offset_maps_pages(spark, sf_dir):
    """Where the visible text of a page starts and ends in its HTML, by the offset map of the tags' removal."""
    df = _table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("raw"), F.col("html").alias("t"))
    df = df.withColumns({"__keys": F.array().cast(offsets._KEYS), "__raw_length": F.length("raw")})
    df = offsets._follow(df, "t", HTML[0])
    m = F.struct(F.col("__keys").alias("keys"), F.col("__raw_length").alias("raw_length"), F.length("t").alias("clean_length"))
    df = df.withColumn("m", m)
    return df.select("page_id", F.length("t").alias("clean_length"), F.col("m.raw_length").alias("raw_length"), offsets.to_raw(F.col("m"), F.lit(0)).alias("first_at"), offsets.to_raw(F.col("m"), F.length("t")).alias("end_at"), F.size("m.keys").alias("n_keys"))


def offset_spans_pages(spark, sf_dir):
    """A page's URL between two tags: its span in the cleaned text, led back to the raw one, and by the identity map."""
    raw = F.concat(F.lit("<p class='x'>"), F.translate("url", "<>", "  "), F.lit("</p>"), F.col("page_id").cast("string"))
    df = _table(spark, sf_dir, "pages").select("page_id", raw.alias("raw")).withColumns({"t": F.col("raw"), "__keys": F.array().cast(offsets._KEYS), "__raw_length": F.length("raw")})
    df = offsets._follow(df, "t", HTML[0])
    made = F.struct(F.col("__keys").alias("keys"), F.col("__raw_length").alias("raw_length"), F.length("t").alias("clean_length"))
    n = F.length("t") - F.length(F.col("page_id").cast("string"))
    df = df.select("page_id", F.col("raw"), offsets.span_to_raw(made, F.lit(1), n - 1).alias("s"), offsets.span_to_raw(offsets.identity(F.length("raw")), F.lit(1), F.length("raw") + 5).alias("same"))
    inner = F.substring(F.col("raw"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return df.select("page_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), inner.alias("inside"), F.col("same.start").alias("same_start"), F.col("same.end").alias("same_end"))


def numbered_line_sink(spark, sf_dir):
    return numbered_lines(_lines(spark, sf_dir), "line", "line_id").select(F.col("value"))


def segment_docs(spark, sf_dir):
    return sentences(segment(_texts(spark, sf_dir, "documents", "doc_id", "text")), "doc_id")


def _languages(spark: SparkSession, sf_dir: str) -> list[str]:
    """The codes with a profile that the documents hold."""
    held = _table(spark, sf_dir, "documents").select("lang").where(F.col("lang").isin(list(CODES))).distinct()
    return sorted(r.lang for r in held.collect())


def segment_docs_multilang(spark, sf_dir):
    docs = _texts(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return sentences(by_language(docs, "lang", _languages(spark, sf_dir)), "doc_id", "lang")


def segment_spans_docs(spark, sf_dir):
    return sentences(segment(_texts(spark, sf_dir, "documents", "doc_id", "text"), char_span=True), "doc_id")


def clean_spans_projected(spark, sf_dir):
    pages = _texts(spark, sf_dir, "pages", "page_id", "html")
    return sentences(segment(pages, "html", clean=True, char_span=True), "page_id")


def segment_pdf(spark, sf_dir):
    return sentences(segment(_texts(spark, sf_dir, "documents", "doc_id", "text"), clean=True, doc_type="pdf"), "doc_id")


def segment_chunked(spark, sf_dir):
    docs = _texts(spark, sf_dir, "documents", "doc_id", "text")
    return sentences(segment_chunks(docs, char_span=True, paragraphs=5), "doc_id", "chunk")


def sentence_stats_by_lang(spark, sf_dir):
    n = F.length("sent")
    return segment_docs_multilang(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n_sentences"), F.avg(n).alias("mean"), F.max(n).alias("longest"))


def conversations_sentences_by_role(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("role", "text")
    return sentences(segment(turns), "role").groupBy("role").agg(F.count(F.lit(1)).alias("n_sentences"))


def stream_sentences_available(spark, sf_dir):
    """The stream form: documents arrive as files, sentences are appended as Parquet, and what was there is read back."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tessella-stream-")
    import uuid

    place = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    docs = read_documents(spark, f"{sf_dir}/documents.parquet*", schema)
    query = write_available(stream_sentences(docs.select("doc_id", "text"), "doc_id"), f"{place}/out", f"{place}/state")
    query.awaitTermination()
    return spark.read.schema("doc_id long, sent_id int, sent string").parquet(f"{place}/out")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        segment_docs, segment_docs_multilang, segment_spans_docs, clean_spans_projected, segment_pdf, segment_chunked, sentence_stats_by_lang,
        conversations_sentences_by_role, stream_sentences_available, blank_filter, word_sets, split_lines, trim_spans, symbol_lines, boundary_matches, noise_merge_islands,
        lexicon_semi_join, lexicon_set_lookup, lexicon_anti_join, lexicon_union, lexicon_except, lexicon_intersect, lexicon_longest_first,
        language_config_join, line_stats_by_lang, char_counts, lines_cube_lang_source, lines_rollup_lang_source, longest_lines_topk, duplicate_lines,
        benchmark_overlap_semi, benchmark_overlap_anti, conversations_lines_by_role, pass_counts, neighbour_lines, paragraph_chunks,
        asof_offset_projection, asof_purchases_and_errors, offset_maps_pages, offset_spans_pages, numbered_line_sink,
    )
}

_TOKENS = r"(SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z]+)\.', 1)) AS word FROM documents)"
_EN_WORDS = _values("en", "abbreviations")
_WANTED = "(SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(trim(line)) > 0)"
_TAG = r"</?[a-zA-Z0-9_:-]+(?:\s+[a-zA-Z0-9_:-]+(?:\s*=\s*(?:\"[^\"]*\"|''[^'']*''|[^''\">\s]+))?)*\s*/?>"

ORACLES: dict[str, str] = {
    "blank_filter": r"SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS line_id, regexp_matches(l[i], '\d') AS digit, regexp_matches(l[i], '[A-Za-z]') AS word, right(l[i], 1) IN ('.', '!', '?') AS ended FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)) WHERE NOT regexp_matches(l[i], '^\s*$')",
    "word_sets": "SELECT item_id, len(w) AS n, list_has_any(w, ['the', 'of']) AS some, list_has_all(w, ['the', 'of']) AS every, array_to_string(list_sort(list_distinct(list_concat(w, ['the', 'of']))), ' ') AS with_few FROM (SELECT item_id, list_distinct(string_split_regex(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' +')) AS w FROM benchmark)",
    "split_lines": f"SELECT doc_id, line_id, start_at, length(line) AS n FROM {_LINES}",
    "trim_spans": rf"SELECT doc_id, line_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS core, CAST(start_at + length(line) - length(regexp_replace(line, '^\s+', '')) AS INTEGER) AS from_at FROM {_LINES}",
    "symbol_lines": rf"SELECT doc_id, line_id, line FROM {_LINES} WHERE NOT regexp_matches(line, '[\p{{L}}\p{{N}}_]')",
    "boundary_matches": f"SELECT p_partkey, place, piece, start_at, end_at FROM {_MATCHES}",
    "noise_merge_islands": rf"SELECT p_partkey, CAST(island AS INTEGER) AS island, min(start_at) AS start_at, max(end_at) AS end_at FROM (SELECT *, sum(CASE WHEN regexp_matches(piece, '\w') OR place = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY place) AS island FROM {_MATCHES}) GROUP BY p_partkey, island",
    "lexicon_semi_join": f"SELECT doc_id, count(*) AS n FROM {_TOKENS} WHERE lower(word) IN (SELECT abbr FROM {_EN_WORDS}) GROUP BY doc_id",
    "lexicon_set_lookup": f"SELECT doc_id, count(*) AS n FROM {_TOKENS} WHERE lower(word) IN (SELECT abbr FROM {_EN_WORDS}) GROUP BY doc_id",
    "lexicon_anti_join": f"SELECT doc_id, count(*) AS n FROM {_TOKENS} WHERE lower(word) NOT IN (SELECT abbr FROM {_EN_WORDS}) GROUP BY doc_id",
    "lexicon_union": f"SELECT abbr FROM {_EN_WORDS} UNION SELECT abbr FROM {_values('en', 'prepositive')} UNION SELECT abbr FROM {_values('en', 'number')}",
    "lexicon_except": f"SELECT abbr FROM {_values('en', 'prepositive')} EXCEPT SELECT abbr FROM {_values('de', 'abbreviations')}",
    "lexicon_intersect": f"SELECT abbr FROM {_EN_WORDS} INTERSECT SELECT abbr FROM {_values('de', 'abbreviations')}",
    "lexicon_longest_first": f"SELECT abbr, CAST(row_number() OVER (ORDER BY length(abbr) DESC, abbr) AS INTEGER) AS place FROM (SELECT DISTINCT abbr FROM {_EN_WORDS})",
    "language_config_join": "SELECT doc_id, d.lang, n_abbr, all_periods FROM documents d LEFT JOIN (VALUES " + ", ".join(f"('{c}', {len(profile(c).abbreviations)}, {str(profile(c).all_periods).lower()})" for c in CODES) + ") v(lang, n_abbr, all_periods) ON d.lang = v.lang",
    "line_stats_by_lang": f"SELECT lang, count(*) AS n_lines, min(length(line)) AS shortest, max(length(line)) AS longest, round(avg(length(line)), 6) AS mean, round(stddev_samp(length(line)), 6) AS deviation, quantile_cont(length(line), 0.5) AS middle FROM {_LINES} GROUP BY lang",
    "char_counts": "SELECT doc_id, length(text) AS chars, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, len(string_split_regex(trim(text), ' +')) AS pieces FROM documents",
    "lines_cube_lang_source": f"SELECT lang, source, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM {_LINES} GROUP BY CUBE (lang, source)",
    "lines_rollup_lang_source": f"SELECT lang, source, count(*) AS n FROM {_LINES} GROUP BY ROLLUP (lang, source)",
    "longest_lines_topk": f"SELECT doc_id, line_id, length(line) AS n FROM {_LINES} ORDER BY n DESC, doc_id, line_id LIMIT 25",
    "duplicate_lines": f"SELECT line, count(*) AS n, min(doc_id) AS first_doc FROM {_LINES} GROUP BY line HAVING count(*) > 1",
    "benchmark_overlap_semi": f"SELECT doc_id, line_id FROM {_LINES} WHERE line IN (SELECT line FROM {_WANTED})",
    "benchmark_overlap_anti": f"SELECT lang, count(*) AS n FROM {_LINES} WHERE line NOT IN (SELECT line FROM {_WANTED}) GROUP BY lang",
    "conversations_lines_by_role": "SELECT role, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT role, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE length(trim(line)) > 0 GROUP BY role",
    "pass_counts": rf"SELECT source, CAST(sum(CASE WHEN regexp_matches(line, '[.!?]\s*$') THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN regexp_matches(line, '[.!?]\s*$') THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM {_LINES} GROUP BY source",
    "neighbour_lines": f"SELECT doc_id, line_id, CAST(lag(length(line)) OVER w AS INTEGER) AS before, CAST(lead(length(line)) OVER w AS INTEGER) AS after, lead(start_at) OVER w AS next_start FROM {_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY line_id)",
    "paragraph_chunks": r"SELECT doc_id, CAST(c AS INTEGER) AS chunk, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS chunk_start, CAST(n AS INTEGER) AS n FROM (SELECT doc_id, (i - 1) // 5 AS c, sum(length(l[i]) + CASE WHEN i < len(l) THEN 2 ELSE 0 END) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\n+') AS l FROM documents WHERE length(trim(text)) > 0)) GROUP BY doc_id, c) WHERE n > 0",
    "asof_offset_projection": "SELECT e.event_id, c.event_id AS click_id, c.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts",
    "asof_purchases_and_errors": "SELECT e.event_id, e.event_type, c.event_id AS click_id, c.value AS click_value FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'error')) e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts",
    "offset_spans_pages": "SELECT page_id, 14 AS start_at, CAST(12 + length(url) AS INTEGER) AS end_at, translate(url[2:length(url) - 1], '<>', '  ') AS inside, 1 AS same_start, CAST(17 + length(url) + length(CAST(page_id AS VARCHAR)) AS INTEGER) AS same_end FROM pages",
    "offset_maps_pages": f"SELECT page_id, CAST(length(t) AS INTEGER) AS clean_length, CAST(length(html) AS INTEGER) AS raw_length, CAST(length(regexp_extract(html, '^(?:{_TAG})+')) * 0 + CASE WHEN starts_with(html, '<!') THEN 0 ELSE length(regexp_extract(html, '^{_TAG}')) END AS INTEGER) AS first_at, CAST(length(html) AS INTEGER) AS end_at, CAST(len(list_filter(string_split_regex(html, '{_TAG}'), lambda x, i: i > 1 AND x <> '')) + CASE WHEN regexp_matches(html, '{_TAG}$') THEN 1 ELSE 0 END AS INTEGER) AS n_keys FROM (SELECT page_id, html, regexp_replace(html, '{_TAG}', '', 'g') AS t FROM pages)",
    "numbered_line_sink": f"SELECT '[' || line_id || '] ' || line AS value FROM {_LINES}",
}
