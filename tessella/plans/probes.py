"""One query per text stage. Texts that hold what the stage acts on are built from columns, by the same SQL expression here
and in the oracle; the oracle spells the stage out with captured context, as its regex dialect has no lookaround.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import Stage, any_of, each, run, sub
from tessella.functions.languages import profile
from tessella.functions.sentinels import ARABIC_COMMA, COLON, unmask
from tessella.operators import cleaning, lists, masking
from tessella.operators.segment import segment, sentences

NL, CR, Q, BS, P = "chr(10)", "chr(13)", "chr(39)", "chr(92)", "'\ue000'"
K = "CAST(p_partkey AS STRING)"
SIZE = "CAST(p_size AS STRING)"


class Probe(NamedTuple):
    name: str
    text: str
    stages: Callable[[], list[Stage]] | Callable[[DataFrame, str], DataFrame]
    oracle: str  # over {t}
    table: str = "part"
    key: str = "p_partkey"


def rr(t: str, pattern: str, to: str) -> str:
    return f"regexp_replace({t}, '{pattern}', {to}, 'g')"


def _chain(t: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        t = rr(t, pattern, to)
    return t


def _tokens(t: str, body: str) -> str:
    """Maps the tokens between single spaces."""
    return f"array_to_string(list_transform(string_split({t}, ' '), lambda x: {body}), ' ')"


def _edits(edits: tuple[cleaning.Edit, ...]) -> Callable[[], list[Stage]]:
    return lambda: [e.stage for e in edits]


def _words(words: tuple[str, ...]) -> str:
    return "|".join(sorted((w for w in words if "." not in w and " " not in w), key=len, reverse=True))


_EN = profile("en")
_HTML = (r"</?[a-zA-Z0-9_:-]+(?:\s+[a-zA-Z0-9_:-]+(?:\s*=\s*(?:\"[^\"]*\"|''[^'']*''|[^''\">\s]+))?)*\s*/?>", "''")
_HTML_ESC = (r"&lt;/?[^gt;]*gt;", "''")
_NL = (
    (r"\n([a-zA-Z]{1,2}\n)", r"'\1'"), (r"(\s)\n([a-z(])", r"'\1\2'"), (r"\n \n", CR), (r"\n\n", CR), (r"\n(\.\s)", r"'\1'"), (r"\n", CR),
)
_LEFT = r"(^|[\s(\[{—–\"''“‘-])"
_GOES = r"([.:?,!\"''“”«»-]|\s+(?:[a-zа-яё]|I\s|\d|\())"
_LISTED = f"'1. ' || p_name || ' 2. ' || p_brand || ' ' || CAST(p_size % 4 AS STRING) || '. ' || lower(p_type) || ' 7. end'"
_ALPHA = "'see a) ' || p_name || ' b) ' || p_brand || ' ' || chr(97 + p_size % 5) || ') ' || lower(p_type) || ' x) end'"
_ROMAN = "'i. ' || p_name || ' ii. ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' iii. ' ELSE ' v. ' END || lower(p_type) || ' ix. end'"


def _list_oracle(marker: str, value: str, first: str, mark: str) -> str:
    """Candidates, their values, and a rebuild that edits the valid ones."""
    sep = rf"(?:^|\s){marker}"
    m, g = f"regexp_extract_all({{t}}, '{sep}')", f"string_split_regex({{t}}, '{sep}')"
    return (
        f"(SELECT array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(CASE WHEN v[i] IS NOT NULL AND (coalesce(v[i + 1] = v[i] + 1, false) OR coalesce(v[i - 1] = v[i] - 1, false) OR {first}) "
        f"THEN CASE WHEN m[i][1] = ' ' THEN chr(13) || {mark.format(x='substr(m[i], 2)')} ELSE {mark.format(x='m[i]')} END ELSE m[i] END, '')), '') "
        f"FROM (SELECT m, g, list_transform(m, lambda x: {value}) AS v FROM (SELECT {m} AS m, {g} AS g)))"
    )


def _each(pattern: str, body: str) -> str:
    """Rebuilds {t} with every match of a pattern changed by ``body``, over {m}."""
    sides = f"SELECT string_split_regex({{t}}, '{pattern}') AS g, regexp_extract_all({{t}}, '{pattern}') AS m"
    return f"(SELECT array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce({body.replace('{m}', 'm[i]')}, '')), '') FROM ({sides}))"


_MASKED = "translate({m}, '.!?', '\ue000\ue004\ue005')"
_DE = profile("de")
_DE_WORDS = {w.strip() for ws in (_DE.abbreviations, _DE.prepositive, _DE.number) for w in ws}
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_ROMANS = "['" + "','".join(lists.ROMAN[:20]) + "']"

PROBES: list[Probe] = [
    Probe("strip_html_pages", "html", _edits(cleaning.HTML), _chain("{t}", _HTML, _HTML_ESC), "pages", "page_id"),
    Probe("clean_inline", f"'a{{b^>' || {K} || '<b^}}' || p_name || '{{b^&gt;7&lt;b^}} {{b^}}'", _edits(cleaning.INLINE), rr("{t}", r"\{{b\^&gt;\d*&lt;b\^\}}|\{{b\^>\d*<b\^\}}", "''")),
    Probe("clean_quotes", f"'He said ``' || p_name || {Q} || {Q} || ' and `' || p_brand || {Q} || '.'", _edits(cleaning.QUOTES), f"replace(replace({{t}}, '`', {Q}), {Q} || {Q}, '\"')"),
    Probe("toc_leaders", f"p_name || ' ....' || CASE WHEN p_size % 2 = 0 THEN '.. ' ELSE '' END || {SIZE} || '-' || {K} || ' next ... ' || {SIZE}", _edits(cleaning.CONTENTS), rr("{t}", r"\.{{4,}}\s*\d+-*\d*", CR)),
    Probe("consecutive_chars", f"p_name || '.....' || p_brand || '///' || {K} || '////' || '....' || lower(p_type)", _edits(cleaning.RUNS), _chain("{t}", (r"\.{{5,}}", "' '"), ("/{{3}}", "''"))),
    Probe("nospace_sentences", f"p_name || '.The end' || {K} || '.Next one at www.' || p_brand || '.Site a.Bc me@x.Yz ' || {SIZE} || '.5'", _edits(cleaning.JOINED),
          _tokens("{t}", "CASE WHEN " + " OR ".join(f"contains(lower(x), '{w}')" for w in cleaning.ADDRESS) + r" THEN x ELSE regexp_replace(x, '([a-z\d])\.([A-Z])', '\1. \2', 'g') END")),
    Probe("newline_norm", f"p_name || {NL} || 'of' || {NL} || p_brand || ' ' || {NL} || 'and (' || {NL} || {NL} || 'Then' || {NL} || ' ' || {NL} || 'x' || {NL} || '. ' || lower(p_type)", _edits(cleaning.LINES), _chain("{t}", *[(a.replace("{", "{{").replace("}", "}}"), b) for a, b in _NL])),
    Probe("pdf_newlines", f"p_name || {NL} || '• one ' || {NL} || 'Two' || {NL} || lower(p_type) || {NL} || p_brand || {NL} || {NL} || 'Q'", _edits(cleaning.PDF_LINES), _chain("{t}", (r"\n(•)", CR + r" || '\1'"), (r"([^\n]\s)\n(\S)", r"'\1\2'"), (r"\n([a-z])", r"' \1'"))),
    Probe("escaped_newlines", f"p_name || {BS} || 'n' || p_brand || {BS} || 'r' || {K} || {BS} || ' n' || {BS} || ' r' || {BS} || 't'", _edits(cleaning.ESCAPED), f"replace(replace(replace(replace({{t}}, {BS} || 'n', {NL}), {BS} || 'r', {CR}), {BS} || ' n', {NL}), {BS} || ' r', {CR})"),
    Probe("normalize_docs", "text", lambda: [e.stage for e in cleaning.edits(_EN)], _chain("{t}", _HTML, _HTML_ESC, ("`", "chr(39)"), ("''''", "'\"'"), (r"\.{{4,}}\s*\d+-*\d*", CR), (r"\.{{5,}}", "' '"), ("/{{3}}", "''"), *[(a.replace("{", "{{").replace("}", "}}"), b) for a, b in _NL]), "documents", "doc_id"),
    Probe("mask_possessive", f"p_name || ' Inc.' || {Q} || 's plan, the Co.’s ' || p_brand || '.' || {Q} || 'so'", lambda: [masking.POSSESSIVE], rr("{t}", r"\.((?:''s|’s|''S|’S)\b)", P + r" || '\1'")),
    Probe("mask_company", f"p_name || ' & Co. KG and Co.GmbH, co. ag or Co. ' || p_brand", lambda: [masking.COMPANY], rr("{t}", r"(?i)(Co)\.(\s*(?:KG|GmbH|OHG|AG)\b)", r"'\1' || chr(57344) || '\2'")),
    Probe("mask_initials", "chr(65 + p_size % 26) || '. ' || p_name || ' J.R. Smith in U.S. with ' || p_brand || ' aB. x'", lambda: [masking.INITIALS], _tokens("{t}", r"CASE WHEN regexp_full_match(x, '([A-Z]\.)+') THEN replace(x, '.', chr(57344)) ELSE x END")),
    Probe("mask_multi_period", f"'e.g. ' || p_name || ' i.e. a.B.c. at 5 p.m. ' || p_brand || ' x. yz.w ' || {SIZE} || '.5'", lambda: [masking.initialisms(None)], _tokens("{t}", r"CASE WHEN regexp_full_match(x, '[a-zA-Z](\.[a-zA-Z])+\.') THEN replace(x, '.', chr(57344)) ELSE x END")),
    Probe("mask_prepositive", "'Dr. ' || p_name || ' saw Mr. Smith, (prof. ' || p_brand || ') and st.:5 or Mrs.x ' || lower(p_type)", lambda: masking.lexicon(_EN)[1:2], rr("{t}", rf"{_LEFT}((?i:{_words(_EN.prepositive)}))\.(\s|:\d+)", r"'\1\2' || chr(57344) || '\3'")),
    Probe("mask_number_abbr", f"'see no. ' || {SIZE} || ' and p.' || {K} || ' or sec. (a) not art. x ' || p_name", lambda: masking.lexicon(_EN)[2:3], rr("{t}", rf"{_LEFT}((?i:{_words(_EN.number)}))\.(\s*\d|\s+\()", r"'\1\2' || chr(57344) || '\3'")),
    Probe("mask_standard_abbr", f"'the corp. ' || p_name || ' in Jan. ' || {SIZE} || ' with ' || p_brand || '. then etc., Inc. Next ave. x foo. bar'", lambda: masking.lexicon(_EN)[3:4], rr("{t}", rf"{_LEFT}((?i:{_words(_EN.abbreviations)}))\.{_GOES}", r"'\1\2' || chr(57344) || '\3'")),
    Probe("mask_single_lower", "'item ' || chr(97 + p_size % 26) || '. ' || p_name || ' and b. ' || CAST(p_size AS STRING) || ' x.'", lambda: [masking.SINGLE_LOWER], rr("{t}", rf"{_LEFT}([a-z])\.(\s+[a-zA-Z]|\s*$)", r"'\1\2' || chr(57344) || '\3'")),
    Probe("ampm_unmask", f"'at 5 p' || {P} || 'm' || {P} || CASE WHEN p_size % 2 = 0 THEN ' The ' ELSE ' the ' END || p_name || ' P' || {P} || 'M' || {P} || ' X'", lambda: [masking.HOURS], rr("{t}", r"(\b[AaPp]" + "" + r"[Mm])" + "" + r"(\s[A-Z])", r"'\1.\2'")),
    Probe("starters_unmask", f"'in the U' || {P} || 'S' || {P} || CASE WHEN p_size % 2 = 0 THEN ' How ' ELSE ' Government ' END || p_name || ' i' || {P} || 'v' || {P} || ' The'", lambda: masking.starters(_EN), rr("{t}", "(US|iv)" + rf"(\s+(?:{_words(_EN.starters)})\b)", r"'\1.\2'")),
    Probe("mask_numbers", f"'1. ' || p_name || ' v' || {SIZE} || '.' || {K} || '.0 is ' || {SIZE} || '.x .5 and 3. end'", lambda: masking.DECIMALS, _chain("{t}", (r"\.(\d)", P + r" || '\1'"), (r"(\d)\.(\S)", r"'\1' || chr(57344) || '\2'"), (r"^(\d{{1,3}})\.(\s\S|\))", r"'\1' || chr(57344) || '\2'"))),
    Probe("mask_footnotes", f"p_name || '.' || {SIZE} || ' Next ' || p_brand || '.[1, 2] The end.[3]'", lambda: [masking.REFERENCES], rr("{t}", r"([^\d\s])\.((?:\[(?:\d{{1,3}},?\s?-?\s?)*\b\d{{1,3}}\])+|(?:\d{{1,3}}\s?)?\d{{1,3}})(?: ([A-Z])|$)", r"'\1' || chr(57344) || '\2' || chr(13) || '\3'").join(("rtrim(", f", {CR})"))),
    Probe("mask_exclamation", "'Yahoo! ' || p_name || ' !Kung-Ekoka, Yum! Y!J ' || p_brand || '! !Xun'", lambda: masking.EXCLAIMED, "replace(replace(replace(replace(replace({t}, '!Kung', chr(57348) || 'Kung'), '!Xun', chr(57348) || 'Xun'), 'Yahoo!', 'Yahoo' || chr(57348)), 'Yum!', 'Yum' || chr(57348)), 'Y!J', 'Y' || chr(57348) || 'J')"),
    Probe("mask_quotes_double", "'She said \"' || p_name || '. Go! Now?\" to ' || p_brand || '. \"x.\"'", lambda: [masking.DOUBLE_QUOTES], "array_to_string(list_transform(string_split({t}, '\"'), lambda x, i: CASE WHEN i % 2 = 0 THEN translate(x, '.!?', chr(57344) || chr(57348) || chr(57349)) ELSE x END), '\"')"),
    Probe("mask_ellipsis", "p_name || '... The ' || p_brand || ' . . . x and that.... She... it ' || lower(p_type)", lambda: masking.ELLIPSES, _chain("{t}", (r"(?:\s\.){{3}}\s", "repeat(chr(57377) || chr(57376), 3) || chr(57377)"), (r"(\S)\.{{4}}(\s+[A-Z])", r"'\1' || repeat(chr(57376), 3) || '.\2'"), (r"\.\.\.(\s+[A-Z])", r"repeat(chr(57376), 2) || '.\1'"), (r"\.\.\.", "repeat(chr(57376), 3)"))),
    Probe("mask_common", "p_name || ' .pdf file? ' || 'go! he' || '!, x 5°C. 7 ' || p_brand || ' what?\" no!\" a.b.c d_e.f'", lambda: masking.COMMON, _chain("{t}", (r"([a-zA-Z]°)\.(\s*\d+)", r"'\1' || chr(57344) || '\2'"), (r"(\s)\.((?:pdf|txt|doc)\s)", r"'\1' || chr(57344) || '\2'"), (r"\?([\"''])", r"chr(57349) || '\1'"), (r"!([\"''])", r"chr(57348) || '\1'"), (r"!(,\s[a-z])", r"chr(57348) || '\1'"), (r"!(\s[a-z])", r"chr(57348) || '\1'"), (r"(\w)\.(\w)", r"'\1' || chr(57344) || '\2'"), (r"(\w)\.(\w)", r"'\1' || chr(57344) || '\2'"))),
    Probe("mask_cited", "'He said \"' || p_name || '.\" (see p. 5. x) \"' || p_brand || '!\" (no. 7) end'", lambda: [masking.CITED], _each(r'["”]\s\([^)]*\)\s["“]', "replace(replace({m}, ' (', chr(13) || '('), ') ', ')' || chr(13))")),
    Probe("mask_quotes_single", f"'he said ' || {Q} || p_name || '. Go!' || {Q} || ' to ' || p_brand || '. Then ' || {Q} || 'no.' || {Q}", lambda: [masking._single_quotes], _each(r"(?:^|\s)''[^\s''][^'']*''", _MASKED)),
    Probe("mask_parens", "p_name || ' (p. 5. now!) x. (' || p_brand || '?) () (a. (b.) c.'", lambda: [masking._PAIRS[4]], _each(r"\([^()\r\n]+\)", _MASKED)),
    Probe("mask_brackets", "p_name || ' [p. 5. now!] x. [' || p_brand || '?] [] end.'", lambda: [masking._PAIRS[3]], _each(r"\[[^\]\r\n]+\]", _MASKED)),
    Probe("mask_dashes", "p_name || ' --so. what?-- x. --' || p_brand || '! y. z'", lambda: [masking._PAIRS[6]], _each(r"--[^-\r\n]*--", _MASKED)),
    Probe("mask_arrows", "p_name || ' «so. what?» x. “' || p_brand || '!” y.'", lambda: masking._PAIRS[1:3], _each("«[^»]+»|“[^”]+”", _MASKED)),
    Probe("mask_pairs_de", "p_name || ' „so. what?“ x. ,,' || p_brand || '!“ y.'", lambda: [each(x, masking.mask) for x in _DE.pairs], _each("„[^“]+“|,,[^“]+“", _MASKED)),
    Probe("mask_all_periods_de", f"'Das ist z.B. ein Bsp. und Nr. ' || {SIZE} || ' von Dr. ' || p_name || ' usw. am Ende.'", lambda: masking.lexicon(_DE), _each(rf"(?i)\b(?:{any_of(w for w in _DE_WORDS if not w.endswith('.'))})\.", f"replace({{m}}, '.', {P})")),
    Probe("mask_rules_de", f"'am ' || {SIZE} || '. Mai und ' || {SIZE} || '. im x. Jahr ' || p_name || '.'", lambda: [sub(a, b) for a, b in _DE.rules], _chain("{t}", (rf"(\d)\.(\s*(?:{_MONTHS}))", r"'\1' || chr(57344) || '\2'"), (r"((?:^|\s)-?\d{{1,2}})\.(\s)", r"'\1' || chr(57344) || '\2'"), (r"((?:^|\s)[a-z])\.(\s)", r"'\1' || chr(57344) || '\2'"))),
    Probe("mask_rules_da", f"'den ' || {SIZE} || '. maj og -' || {SIZE} || '. ' || p_name || ' 1' || {K} || '00. x'", lambda: [sub(a, b) for a, b in profile("da").rules], rr("{t}", r"(\s-?\d{{1,2}})\.(\s)", r"'\1' || chr(57344) || '\2'")),
    Probe("mask_rules_sk", f"'dňa ' || {SIZE} || '. Mája, ' || {SIZE} || '. ročník, XV. Storočie, ' || {SIZE} || '. Praha ' || p_name", lambda: [sub(a, b) for a, b in profile("sk").rules], _chain("{t}", (r"(\d)\.(\s*(?:Mája|[a-z]))", r"'\1' || chr(57344) || '\2'"), (r"((?:^|\s)[VXI]+)\.(\s)", r"'\1' || chr(57344) || '\2'"))),
    Probe("mask_rules_kk", "'Не? - деді ' || p_name || '! — деп ' || p_brand || '? Иә! ' || lower(p_type)", lambda: [sub(a, b) for a, b in profile("kk").rules[1:]], _chain("{t}", (r"\?(\s*[-—])", r"chr(57349) || '\1'"), (r"!(\s*[-—])", r"chr(57348) || '\1'"))),
    Probe("mask_rules_fa", f"'ساعت ' || {SIZE} || ':30 و: سیب، ' || p_brand || '، ' || p_name", lambda: [sub(a, b) for a, b in profile("fa").rules], _chain("{t}", (r"(\d):(\d)", rf"'\1{COLON}\2'"), (r"،(\s\S+،)", rf"'{ARABIC_COMMA}\1'"))),
    Probe("mask_initialism_ru", f"'в т.д. и ' || p_name || ' Т.С.Ш. ' || {SIZE} || ' и т. п. ' || p_brand || ' а.б'", lambda: [masking.initialisms(profile("ru"))], _each(r"[Ѐ-ӿ]+(?:\.[Ѐ-ӿ]+)+\.?", f"replace({{m}}, '.', {P})")),
    Probe("clean_rules_ja",f"p_name || 'の' || {NL} || p_brand || 'の' || {NL} || ' x'", lambda: [cleaning.Edit(a, b).stage for a, b in profile("ja").clean_rules], rr("{t}", r"(の)\n(\S)", r"'\1\2'")),
    Probe("custom_rules", "p_name || ' <x> ' || p_brand || ' ###'", lambda df, col: cleaning.clean(df, col, custom=[("#+", "$"), ("small", "tiny")]), _chain("replace({t}, ' <x>', ' ')", ("#+", "'$'"), ("small", "'tiny'"))),
    Probe("unmask_all", f"p_name || {P} || '\ue004\ue005' || p_brand || '\ue010\ue013\ue00b\ue021'", lambda: [unmask], "replace(replace(replace(translate({t}, chr(57344) || chr(57348) || chr(57349) || chr(57377), '.!? '), chr(57360), '?!'), chr(57363), '!!'), chr(57355), '')"),
    Probe("numbered_list_validity", _LISTED, lists.mask_numbered, _list_oracle(r"\d{{1,3}}\.", "CAST(regexp_extract(x, '\\d+') AS INTEGER)", "(v[i] = 1 AND i = 1)", "replace({x}, '.', chr(57344))")),
    Probe("alpha_list_validity", _ALPHA, lists.mask_lettered, _list_oracle(r"[a-z]\)", "ascii(regexp_extract(x, '[a-z]'))", "false", "{x}")),
    Probe("roman_list_validity", _ROMAN, lists.mask_roman, _list_oracle(r"[ivxldcm]+\.", f"nullif(list_position({_ROMANS}, regexp_extract(x, '[a-z]+')), 0) - 1", "(v[i] = 0 AND i = 1)", "replace({x}, '.', chr(57344))")),
]


def _query(p: Probe) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{p.table}.parquet").select(p.key, F.expr(p.text).alias("result"))
        return p.stages(df, "result") if p.stages.__code__.co_argcount else run(df, "result", p.stages())

    return query


_PLAIN = f"'The ' || p_name || ' is ' || lower(p_type) || '. Is it ' || p_brand || '? Yes! It costs ' || {SIZE} || ' coins.'"
_TITLED = f"'Dr. ' || p_name || ' met Mr. Smith of ' || p_brand || '. They paid ' || {SIZE} || '.5 coins on Jan. 3! Why?'"
_SPACED = f"'  One ' || p_name || '.  Two ' || p_brand || '! ' || {NL} || {NL} || ' Three ' || {K} || '.'"


def _segmented(text: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(text).alias("text"))
        out = sentences(segment(df, **options), "p_partkey")
        return out.select("p_partkey", "sent_id", "sent", *(["start", "end"] if options.get("char_span") else [])).withColumnsRenamed({"start": "start_at", "end": "end_at"})

    return query


_SENT = r"\S.*?[.!?]+"
_UNNEST = "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS sent_id, {sent} AS sent{more} FROM (SELECT p_partkey, t, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT p_partkey, t, {list} AS s FROM (SELECT p_partkey, {text} AS t FROM part)))"
_TITLED_MASK = _chain("t", (r"\b(Dr|Mr|Jan)\.(\s)", r"'\1' || chr(57344) || '\2'"), (r"\.(\d)", r"chr(57344) || '\1'"))

def _plain(template: str) -> str:
    return template.replace("{{", "{").replace("}}", "}").replace("{t}", "t")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {p.name: _query(p) for p in PROBES} | {
    "segment_plain": _segmented(_PLAIN),
    "segment_titles": _segmented(_TITLED),
    "segment_spans": _segmented(_PLAIN, char_span=True),
    "segment_spans_blanks": _segmented(_SPACED, char_span=True),
}
ORACLES: dict[str, str] = {p.name: f"SELECT {p.key}, {_plain(p.oracle)} AS result FROM (SELECT {p.key}, {p.text} AS t FROM {p.table})" for p in PROBES} | {
    "segment_plain": _UNNEST.format(text=_PLAIN, list=f"regexp_extract_all(t, '{_SENT}')", sent="s[i]", more=""),
    "segment_titles": _UNNEST.format(text=_TITLED, list=f"regexp_extract_all({_TITLED_MASK}, '{_SENT}')", sent=f"replace(s[i], {P}, '.')", more=""),
    "segment_spans": _UNNEST.format(text=_PLAIN, list=f"regexp_extract_all(t, '{_SENT}')", sent="s[i] || CASE WHEN i < len(s) THEN ' ' ELSE '' END", more=", CAST(coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS start_at, CAST(coalesce(list_sum(list_transform(s[1:i], lambda x: length(x) + 1)), 0) - CASE WHEN i = len(s) THEN 1 ELSE 0 END AS INTEGER) AS end_at"),
    "segment_spans_blanks": _UNNEST.format(text=_SPACED, list=r"regexp_extract_all(t, '(?s)\S[^.!]*[.!]\s*')", sent="s[i]", more=", CAST(2 + coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start_at, CAST(2 + list_sum(list_transform(s[1:i], lambda x: length(x))) AS INTEGER) AS end_at"),
}
