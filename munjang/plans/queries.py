"""Every operator as a query over the tables of a folder, with the SQL that gives the same rows."""

from __future__ import annotations

import difflib
import io
import re
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from munjang.functions import metrics as M
from munjang.functions import registry as R
from munjang.functions import text as T
from munjang.operators import calibrate, corpus, detect, evaluate, history, prompt, report, rewrite
from munjang.plans import fixtures as X
from munjang.plans.cases import ROWS
from munjang.sources import documents as S
from munjang.sources.tables import over_all_cores, read_table

GENRE_SQL = "CASE lang WHEN 'en' THEN 'essay' WHEN 'fr' THEN 'column' WHEN 'de' THEN 'report' WHEN 'es' THEN 'abstract' ELSE 'essay' END"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return over_all_cores(table(spark, folder, "documents").select("doc_id", "text", "lang", "source", F.expr(GENRE_SQL).alias("genre")))


def all_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the inline texts, whose ids are put below those of documents."""
    return documents(spark, folder).select("doc_id", "text", "genre").unionByName(X.texts(spark).withColumn("doc_id", F.col("doc_id") - 100))


def known_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, the inline texts and the cases of every pattern."""
    return all_texts(spark, folder).unionByName(X.cases(spark))


def korean(spark: SparkSession) -> DataFrame:
    return X.texts(spark).withColumn("doc_id", F.col("doc_id") - 100).unionByName(X.cases(spark))


# SQL fragments. No query text has white space beyond ASCII, so RE2's \s agrees.
def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sents(x: str) -> str:
    cut = rf"string_split(regexp_replace({strip(x)}, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform(flatten(list_transform({cut}, lambda c: string_split(c, chr(10)))), lambda s: {strip('s')}), lambda s: s <> '')"


def tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"


def commas(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ',', '')))"


def n_matches(x: str, rx: str) -> str:
    return f"len(regexp_extract_all({x}, {X.quoted(rx)}))"


ENDING = r"([가-힣]{1,3})\s*[.!?。]?\s*$"
SEGMENTS = f"flatten(list_transform(s, lambda x: CASE WHEN contains(x, ',') THEN list_filter(string_split(x, ','), lambda y: {strip('y')} <> '') ELSE [x] END))"
ENDINGS = f"list_filter(list_transform(s, lambda x: nullif(regexp_extract(x, '{ENDING}', 1), '')), lambda k: k IS NOT NULL)"
LAST = f"regexp_replace({tokens('x')}[-1], {X.quoted(T.PUNCTUATION)}, '', 'g')"
METRIC_SQL = {
    "comma_inclusion_rate": ratio("len(list_filter(s, lambda x: contains(x, ',')))", "len(s)"),
    "comma_usage_rate": ratio(f"coalesce(list_sum(list_transform(s, lambda x: {commas('x')})), 0)", "len(s)"),
    "ending_comma_rate": ratio(n_matches("text", rf"(?:{M.CONNECTIVES})\s*,"), n_matches("text", rf"(?:{M.CONNECTIVES})(?:[\s,.!?、。]|$)")),
    "comma_segment_length": ratio(f"coalesce(list_sum(list_transform({SEGMENTS}, lambda x: len({tokens('x')}))), 0)", f"len({SEGMENTS})"),
    "ending_diversity": ratio(f"len(list_distinct({ENDINGS}))", f"len({ENDINGS})"),
    "declarative_ratio": ratio(f"len(list_filter(s, lambda x: coalesce(regexp_matches({LAST}, '{M.DECLARATIVE}'), false)))", "len(s)"),
}
DOCS_SQL = f"SELECT doc_id, coalesce(text, '') AS text, {GENRE_SQL} AS genre FROM documents"
TEXTS_SQL = f"SELECT doc_id::BIGINT AS doc_id, text, genre FROM {X.values(X.TEXTS, 't', 'doc_id, text, genre')}"


INLINE_SQL = f"SELECT doc_id - 100 AS doc_id, text, genre FROM ({TEXTS_SQL})"
KOREAN_SQL = f"{INLINE_SQL} UNION ALL SELECT doc_id::BIGINT, text, 'essay' FROM {X.values([(k - 1000, t) for k, _, t, _ in ROWS], 't', 'doc_id, text')}"
ALL_SQL = f"{DOCS_SQL} UNION ALL {INLINE_SQL}"
KNOWN_SQL = f"{DOCS_SQL} UNION ALL {KOREAN_SQL}"


def split_sql(source: str) -> str:
    return f"SELECT *, {sents('text')} AS s FROM ({source})"


def metrics_sql(source: str) -> str:
    return f"SELECT doc_id, text, genre, s, {', '.join(f'{v} AS {k}' for k, v in METRIC_SQL.items())} FROM ({split_sql(source)})"


def z_sql(metric: str) -> str:
    cell = "CASE WHEN genre IN ('essay', 'abstract', 'poetry', 'column', 'report') THEN genre WHEN genre = 'blog' THEN 'essay' WHEN genre = 'news' THEN 'column' ELSE 'essay' END"
    value = f"{metric} * 100" if metric in R.PERCENT else metric
    whens = " ".join(f"WHEN '{g}' THEN greatest(-3.0, least(3.0, ({value} - {h}) / ({abs(a - h)} / 2)))" for g, cells in R.BASELINES.items() if cells[metric] for h, a in [cells[metric]])
    return f"(CASE {cell} {whens} END)"


def re2(expression: str) -> str:
    """An expression for RE2: lookaround becomes consuming guards."""
    out = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: rf"\x{{{(m[1] or m[2]).lstrip('0')}}}", expression)
    for look, guard in ((r"(?<![가-힣])", "(?:^|[^가-힣])"), (r"(?![가-힣])", "(?:$|[^가-힣])"), (r"(?<=[가-힣])", "[가-힣]"), (r"(?=[가-힣])", "[가-힣]"), (r"(?<![0-9])", "(?:^|[^0-9])"), (r"(?:^|(?<=[.!?]\s))", r"(?:^|[.!?]\s)")):
        out = out.replace(look, guard)
    return out


def guarded(p: R.Pattern) -> tuple[str, str, str, str]:
    """(flags, what stands before a match, the match, what stands after it) for RE2; what lookaround sees is consumed and put back."""
    rx, before, after, flags = p.expression.replace(r"(?![가-힣])[,\s]*", r"(?:[,\s]+|$)"), "", "", ""
    if rx.startswith("(?m)"):
        flags, rx = rx[:4], rx[4:]
    for look, guard in ((r"(?<![가-힣])", "^|[^가-힣]"), (r"(?<=[가-힣])", "[가-힣]"), (r"(?<![0-9])", "^|[^0-9]"), (r"(?:^|(?<=[.!?]\s))", r"^|[.!?]\s")):
        if rx.startswith(look):
            rx, before = rx.removeprefix(look), guard
    for look, guard in ((r"(?![가-힣])", "$|[^가-힣]"), (r"(?=[가-힣])", "[가-힣]")):
        if rx.endswith(look):
            rx, after = rx.removesuffix(look), guard
    if p.context.startswith("start"):
        before = r"(?:^|[.!?\n])[ \t]*"
    return flags, before, re2(rx), after


def pieces_sql(p: R.Pattern) -> str:
    """The text cut before each match; a match ends at chr(2)."""
    flags, before, rx, after = guarded(p)
    groups = re.compile(p.expression).groups
    return rf"string_split(regexp_replace(text, {X.quoted(f'{flags}({before})({rx})({after})')}, '\1' || chr(1) || '\2' || chr(2) || '\{3 + groups}', 'g'), chr(1))"


def starts_sql(pieces: str, k: str = "k") -> str:
    return f"list_sum(list_transform({pieces}[1:{k}], lambda x: length(replace(x, chr(2), ''))))"


def count_sql(p: R.Pattern) -> str:
    rx = re2(p.expression)
    if p.context.startswith("start"):
        rx = rx.removeprefix("(?:^|[^가-힣])")
        rx = rf"(?:^|[.!?\n])[ \t]*(?:{rx})"
    n = n_matches("text", rx)
    if p.context.endswith("final"):
        ps = pieces_sql(p)
        n = f"len(list_filter(range(1, len({ps})), lambda k: {starts_sql(ps)} / length(text) >= 0.7))"
    return f"CASE WHEN {n} >= {p.min_count} THEN {n} ELSE 0 END"


def hits_sql(source: str) -> str:
    """CTEs ``src`` and ``hits`` (doc_id, pattern_id, ord, w, start, end, text): every match that counts."""
    each = []
    for i, p in enumerate(R.PATTERNS):
        cut = f"SELECT doc_id, length(text) AS size, {pieces_sql(p)} AS ps FROM src"
        # A particle is the last letter of A-17's match, where a guard takes one more.
        end = "regexp_replace(t, '[^가-힣]$', '')" if p.id == "A-17" else "t"
        each.append(f"SELECT doc_id, {X.quoted(p.id)} AS pattern_id, {i} AS ord, {p.weight * (0.6 + 0.2 * p.severity)!r}::DOUBLE AS w, {p.min_count} AS least, {p.context.endswith('final')} AS last_part, size, start, {end} AS t FROM (SELECT doc_id, size, {starts_sql('ps')} AS start, string_split(ps[k + 1], chr(2))[1] AS t FROM (SELECT *, unnest(range(1, len(ps))) AS k FROM ({cut})))")
    return f"""src AS MATERIALIZED (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text, genre FROM ({source})), matches AS MATERIALIZED ({' UNION ALL '.join(each)}), counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, pattern_id) AS n FROM matches WHERE NOT last_part OR start / size >= 0.7
), hits AS MATERIALIZED (SELECT doc_id, pattern_id, ord, w, start::INT AS start, (start + length(t))::INT AS "end", trim(t) AS text FROM counted WHERE n >= least)"""


SENTENCE_SCORES_SQL = rf"""
WITH {hits_sql(KNOWN_SQL)}, split AS (SELECT doc_id, {sents('text')} AS s FROM src), sentence AS (
  SELECT doc_id, i::INT AS idx, s[i + 1] AS text, list_sum(list_transform(s[1:i], lambda x: length(regexp_replace(x, '\s', '', 'g')))) AS before FROM (SELECT doc_id, s, unnest(range(len(s))) AS i FROM split)
), edges AS (SELECT *, coalesce(before, 0) AS first, coalesce(before, 0) + length(regexp_replace(text, '\s', '', 'g')) AS past FROM sentence),
placed AS (
  SELECT h.*, length(regexp_replace(src.text[1:h.start], '\s', '', 'g')) AS at, regexp_matches(src.text[h.start + 1:h.start + 1], '\s') AS blank FROM hits h JOIN src USING (doc_id)
)
SELECT e.doc_id, e.idx, any_value(e.text) AS text, round(greatest(0.0, least(100.0, 100 * (1 - exp(-coalesce(sum(p.w), 0.0) / greatest(length(any_value(e.text)), 1) * 100 / 5)))), 1) AS score,
  coalesce(string_agg(p.pattern_id, ' ' ORDER BY p.start, p."end", p.ord), '') AS hit_ids, coalesce(list(p.pattern_id ORDER BY p.start, p."end", p.ord) FILTER (p.pattern_id IS NOT NULL), []) AS every
FROM edges e LEFT JOIN placed p ON p.doc_id = e.doc_id AND p.at >= e.first AND p.at < e.past AND NOT (p.blank AND p.at = e.first) GROUP BY e.doc_id, e.idx"""
SENTENCE_SCORES_SQL = f"SELECT * EXCLUDE (every), array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), ' ') AS unique_ids FROM ({SENTENCE_SCORES_SQL})"


def layers_sql(source: str, places: int = 6) -> str:
    size = f"greatest(length({strip('text')}), {R.LEAST_DENSITY_CHARS})"
    l2 = " + ".join(f"least({count_sql(p)} * 1000.0::DOUBLE / {size}, {max(p.cap, R.LEAST_CAP)}) * {p.weight}::DOUBLE" for p in R.PATTERNS)
    l4 = " + ".join(f"least({n_matches('text', re2(h.expression))} * 1000.0::DOUBLE / {size}, 6.0) * {h.weight}::DOUBLE" for h in R.HUMAN)
    zs = ", ".join(z_sql(k) for k in detect.METRICS)
    n = "len(s)"
    ramp = lambda cond, v: f"CASE WHEN {cond} THEN greatest(0.0, least(1.0, {v})) ELSE 0.0 END"
    return f"""
WITH m AS MATERIALIZED ({metrics_sql(source)}), r AS MATERIALIZED (
  SELECT *, list_transform(s, lambda x: length(x)::DOUBLE) AS lens, list_filter([{zs}], lambda z: z IS NOT NULL) AS zs FROM m
), q AS MATERIALIZED (
  SELECT *, {ratio("list_stddev_pop(lens)", "list_avg(lens)")} AS cv, {ratio("len(list_filter(lens, lambda x: x >= 100))", n)} AS long_share FROM r
), l AS MATERIALIZED (
  SELECT doc_id, genre, length({strip('text')})::BIGINT AS n_chars, len(s)::BIGINT AS n_sentences, {ratio("list_sum(zs)", "len(zs)")} AS l1, least(({l2}) / 20.0, 6.0) AS l2,
    greatest(0.0, least(4.0, {ramp(f"{n} >= 4 AND cv < 0.35", "(0.35 - cv) / 0.25")} + {ramp(f"{n} >= 4 AND ending_diversity < 0.45", "(0.45 - ending_diversity) / 0.30")}
      + {ramp(f"{n} >= 15 AND long_share < 0.04", "(0.04 - long_share) / 0.04")} + {ramp(f"{n} >= 4 AND declarative_ratio > 0.75", "(declarative_ratio - 0.75) / 0.25")})) AS l3,
    least(({l4}) / 12.0, 3.0) AS l4
  FROM q
), f AS (
  SELECT *, {R.FUSION['l1_calibrated_z']} * greatest(l1, {R.L1_FLOOR}) + {R.FUSION['l2_pattern_density']} * l2 + {R.FUSION['l3_rhythm']} * l3 + {R.FUSION['l4_human_evidence']} * l4 + {R.FUSION['bias']} AS logit FROM l
)
SELECT doc_id, n_chars, n_sentences, round(l1, {places}) AS l1, round(l2, {places}) AS l2, round(l3, {places}) AS l3, round(l4, {places}) AS l4, round(logit, {places}) AS logit, round(100 / (1 + exp(-logit)), 1) AS score,
  CASE WHEN round(100 / (1 + exp(-logit)), 1) >= 60 THEN 'high' WHEN round(100 / (1 + exp(-logit)), 1) >= 25 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN n_chars < 150 THEN 'insufficient' WHEN n_chars < 400 THEN 'low' ELSE 'normal' END AS confidence
FROM f"""


def report_sql(source: str) -> str:
    """Score, number of signals and notes, and the keys of the signals, strongest first."""
    size = f"greatest(length({strip('text')}), {R.LEAST_DENSITY_CHARS})"
    signal = lambda cond, strength, order, key: f"CASE WHEN {cond} THEN {{'s': -greatest(0.0, least(1.0, {strength})), 'o': {order}, 'k': {X.quoted(key)}}} END"
    each = [signal(f"abs({z_sql(k)}) >= 0.8", f"abs({z_sql(k)}) / 3", i, k) for i, k in enumerate(detect.METRICS)]
    for i, p in enumerate(R.PATTERNS):
        contribution = f"least(counts[{i + 1}] * 1000.0::DOUBLE / {size}, {max(p.cap, R.LEAST_CAP)}) * {p.weight}::DOUBLE"
        each.append(signal(f"{contribution} >= 0.5", f"({contribution}) / 6", 100 + i, p.id))
    rhythm = (("sentence_len_cv", "len(s) >= 4 AND cv < 0.35", "(0.35 - cv) / 0.25"), ("ending_diversity", "len(s) >= 4 AND ending_diversity < 0.45", "(0.45 - ending_diversity) / 0.30"), ("long_sentence_absence", "len(s) >= 15 AND long_share < 0.04", "(0.04 - long_share) / 0.04"), ("normalisation_score", "len(s) >= 4 AND declarative_ratio > 0.75", "(declarative_ratio - 0.75) / 0.25"))
    each += [signal(cond, v, 200 + i, k) for i, (k, cond, v) in enumerate(rhythm)]
    for i, h in enumerate(R.HUMAN):
        n = f"human[{i + 1}]"
        each.append(signal(f"{n} > 0", f"least({n} * 1000.0::DOUBLE / {size}, 6.0) * {h.weight}::DOUBLE / 4", 300 + i, h.id))
    skipped = " + ".join(f"({z_sql(k)} IS NULL)::INT" for k in detect.METRICS)
    return f"""
WITH m AS MATERIALIZED (
  SELECT *, list_transform(s, lambda x: length(x)::DOUBLE) AS lens, [{', '.join(count_sql(p) for p in R.PATTERNS)}] AS counts, [{', '.join(n_matches("text", re2(h.expression)) for h in R.HUMAN)}] AS human FROM ({metrics_sql(source)})
), q AS MATERIALIZED (
  SELECT *, {ratio("list_stddev_pop(lens)", "list_avg(lens)")} AS cv, {ratio("len(list_filter(lens, lambda x: x >= 100))", "len(s)")} AS long_share FROM m
), f AS (
  SELECT doc_id, list_sort(list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)) AS found, 1 + (length({strip('text')}) < 400)::INT + (({skipped}) > 0)::INT AS n_notes FROM q
)
SELECT f.doc_id, l.score, len(found)::INT AS n_signals, n_notes::INT AS n_notes, array_to_string(list_transform(found, lambda x: x.k), ' ') AS signals FROM f JOIN ({layers_sql(source)}) l USING (doc_id)"""


def _layer_columns(df: DataFrame) -> DataFrame:
    return detect.fused(detect.layers(df)).select("doc_id", "n_chars", F.size("sents").cast("long").alias("n_sentences"), *[F.round(k, 6).alias(k) for k in ("l1", "l2", "l3", "l4", "logit")], "score", "band", "confidence")


# Sources and projections


@query("src_10_normalize", rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(8203), ''), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def src_10(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.normalize("text").cast("binary")).alias("digest"))


def _sample_files() -> list[tuple[str, bytes]]:
    def zipped(name: str, xml: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, xml)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = f"<w:document {w}><w:body><w:p><w:r><w:t>첫 문단</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>둘째</w:t><w:tab/><w:t>문단</w:t></w:r></w:p></w:body></w:document>"
    hwpx = '<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:run><hp:t>한글 문단</hp:t></hp:run></hp:p></hs:sec>'
    return [("a.docx", zipped("word/document.xml", docx)), ("b.hwpx", zipped("Contents/section0.xml", hwpx)), ("c.txt", "한글 인코딩".encode("cp949")), ("d.md", "# 제목\r\n\r\n\r\n\r\n본문  \n".encode()), ("e.xyz", b"?"), ("f.docx", b"broken")]


PARSED = [("a.docx", "첫 문단\n\n둘째\t문단", False), ("b.hwpx", "한글 문단", False), ("c.txt", "한글 인코딩", False), ("d.md", "# 제목\n\n본문", False), ("e.xyz", None, True), ("f.docx", None, True)]


@query("src_6_parse_bytes", f"SELECT path, replace(text, '\\t', chr(9)) AS text, failed FROM {X.values([(p, t.replace(chr(9), '\\t') if t else t, e) for p, t, e in PARSED], 't', 'path, text, failed')}")
def src_6(spark, d):
    files = spark.createDataFrame(_sample_files(), "path string, content binary")
    return S.parse_files(files).select("path", "text", F.col("error").isNotNull().alias("failed"))


def _bomb() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<p>" + " " * 4_000_000 + "</p>")
    return out.getvalue()


_ENCODED = [("utf8.txt", "한글 문장이다.".encode(), "한글 문장이다."), ("cp949.txt", "똠방각하 펲시콜라".encode("cp949"), "똠방각하 펲시콜라"), ("euckr.md", "한국어 글".encode("euc-kr"), "한국어 글"), ("utf16.txt", "한글 문장".encode("utf-16"), "한글 문장"), ("odd.TXT", "가\u200b나\u00a0다".encode(), "가나 다"), ("bomb.docx", _bomb(), None), ("empty.hwp", b"", None), ("blank.txt", b" \n ", "")]


@query("src_1_encodings_and_limits", f"SELECT path, text, failed FROM {X.values([(p, t, t is None) for p, _, t in _ENCODED], 't', 'path, text, failed')}")
def src_1(spark, d):
    """Encodings in the order tried, and files that unpack to too much or hold nothing."""
    files = spark.createDataFrame([(p, b) for p, b, _ in _ENCODED], "path string, content binary")
    return S.parse_files(files).select("path", "text", F.col("error").isNotNull().alias("failed"))


_LONG = "세종대왕이 훈민정음을 창제하면서 표기 체계가 갖추어졌다고 널리 알려져 있으며 오늘날까지 이어진다. "
_PAGES = [("kept", 0, _LONG * 8), ("other name space", 1, _LONG * 8), ("redirect", 0, " #redirect [[kept]] " + _LONG * 8), ("moved", 0, "#넘겨주기 [[kept]]\n" + _LONG * 8), ("short", 0, _LONG), ("markup", 0, "== 제목 ==\n* 목록\n'''굵은''' [[링크|말]] " + _LONG * 8), ("empty", 0, None)]


@query("src_13_wiki_pages", f"SELECT title, n::INT AS n FROM {X.values([('kept', 8 * len(_LONG) - 1), ('markup', 8 * len(_LONG) + 4)], 't', 'title, n')}")
def src_13(spark, d):
    return corpus.wiki_pages(spark.createDataFrame(_PAGES, "title string, ns long, text string")).select("title", F.length("text").alias("n"))


@query("src_16_genre_of_path", f"SELECT path, coalesce(nullif(regexp_extract(path, '([^/]*?)__[^/]*$', 1), ''), 'essay') AS genre FROM {X.values([('human/column__ab12.txt',), ('x/plain.txt',), ('__no.txt',), ('a__b__c.txt',)], 't', 'path')}")
def src_16(spark, d):
    return spark.createDataFrame([("human/column__ab12.txt",), ("x/plain.txt",), ("__no.txt",), ("a__b__c.txt",)], "path string").select("path", corpus.genre_of_path("path").alias("genre"))


@query("src_17_topics", rf"SELECT doc_id, topic FROM (SELECT doc_id, string_split(regexp_replace({strip('text[1:300]')}, '([.!?])\s', '\1' || chr(1), 'g'), chr(1))[1] AS topic FROM documents) WHERE length(topic) BETWEEN 10 AND 120")
def src_17(spark, d):
    return corpus.topics(documents(spark, d))


@query("flt_15_dump_guard", f"SELECT name, coalesce(nullif(regexp_extract(name, '(20\\d{{2}})(\\d{{2}})\\d{{2}}', 1), '')::INT * 100 + nullif(regexp_extract(name, '(20\\d{{2}})(\\d{{2}})\\d{{2}}', 2), '')::INT <= 202211, true) AS allowed FROM {X.values([('kowiki-20221101-pages.xml.bz2',), ('kowiki-20230101-pages.xml.bz2',), ('kowiki-latest.xml.bz2',)], 't', 'name')}")
def flt_15(spark, d):
    return spark.createDataFrame([("kowiki-20221101-pages.xml.bz2",), ("kowiki-20230101-pages.xml.bz2",), ("kowiki-latest.xml.bz2",)], "name string").select("name", corpus.dump_allowed("name").alias("allowed"))


@query("prj_1_preview", rf"SELECT doc_id, CASE WHEN length(t) > 90 THEN t[1:90] || '…' ELSE t END AS preview FROM (SELECT doc_id, {strip("regexp_replace(text, '\\s+', ' ', 'g')")} AS t FROM documents)")
def prj_1(spark, d):
    return documents(spark, d).select("doc_id", T.preview("text").alias("preview"))


@query("prj_3_truncate", f"SELECT k::INT AS k, n::INT AS n FROM {X.values([(1, 10), (2, 5002), (3, 7000), (4, 5998)], 't', 'k, n')}")
def prj_3(spark, d):
    rows = [(1, "짧은 글이다.\n\n끝"), (2, "a" * 5000 + "\n\n" + "\n\n" + "b" * 3000), (3, "c" * 7000 + "\n\n" + "d"), (4, "\n\n".join(["e" * 1998] * 5))]
    return spark.createDataFrame(rows, "k int, t string").select("k", F.length(T.truncate("t")).alias("n"))


# Scalar functions


@query("str_1_sentences", f"SELECT doc_id, (unnest(range(len(s))))::INT AS idx, unnest(s) AS sentence FROM ({split_sql(DOCS_SQL)})")
def str_1(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(T.sentences("text")).alias("idx", "sentence"))


@query("str_2_eojeols", f"SELECT doc_id, len({tokens('text')})::BIGINT AS n FROM documents")
def str_2(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.eojeols("text")).cast("long").alias("n"))


@query("str_3_strip_punctuation", f"SELECT doc_id, md5(regexp_replace(text, {X.quoted(T.PUNCTUATION)}, '', 'g')) AS digest FROM documents")
def str_3(spark, d):
    return documents(spark, d).select("doc_id", F.md5(F.regexp_replace("text", T.PUNCTUATION, "").cast("binary")).alias("digest"))


@query("str_4_last_eojeol", f"SELECT doc_id, i::INT AS idx, {LAST} AS word FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM ({split_sql(DOCS_SQL)}))")
def str_4(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(T.sentences("text")).alias("idx", "s")).select("doc_id", "idx", T.last_eojeol("s").alias("word"))


@query("str_5_endings", f"SELECT doc_id, i::INT AS idx, nullif(regexp_extract(x, '{ENDING}', 1), '') AS ending FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM ({split_sql(TEXTS_SQL)}))")
def str_5(spark, d):
    return X.texts(spark).select("doc_id", F.posexplode(T.sentences("text")).alias("idx", "s")).select("doc_id", "idx", T.ending("s").alias("ending"))


_FINAL = "CASE WHEN unicode(right(word, 1)) BETWEEN 44032 AND 55203 THEN (unicode(right(word, 1)) - 44032) % 28 <> 0 ELSE word <> '' AND contains('013678', right(word, 1)) END"
_WORDS = X.values([(w,) for w in X.WORDS], "t", "word")


@query("str_6_has_final", f"SELECT word, {_FINAL} AS closed FROM {_WORDS}")
def str_6(spark, d):
    return X.words(spark).select("word", T.has_final("word").alias("closed"))


@query("str_7_particles", f"SELECT word, CASE WHEN {_FINAL} THEN '이' ELSE '가' END AS subject, CASE WHEN {_FINAL} THEN '을' ELSE '를' END AS object, CASE WHEN {_FINAL} THEN '은' ELSE '는' END AS topic FROM {_WORDS}")
def str_7(spark, d):
    return X.words(spark).select("word", T.subject_particle("word").alias("subject"), T.object_particle("word").alias("object"), T.topic_particle("word").alias("topic"))


@query("str_8_instrumental", f"SELECT word, CASE WHEN unicode(right(word, 1)) BETWEEN 44032 AND 55203 AND (unicode(right(word, 1)) - 44032) % 28 NOT IN (0, 8) THEN '으로' ELSE '로' END AS particle FROM {_WORDS}")
def str_8(spark, d):
    return X.words(spark).select("word", T.instrumental_particle("word").alias("particle"))


@query("str_9_wikitext", f"SELECT * FROM {X.values([(c, e) for c, _, e in X.WIKI], 't', 'case_id, text')}")
def str_9(spark, d):
    return X.wiki(spark).select("case_id", corpus.clean_wikitext("raw").alias("text"))


@query("str_10_document_id", "SELECT doc_id, substring(sha1(text), 1, 12) AS sha FROM documents")
def str_10(spark, d):
    return documents(spark, d).select("doc_id", T.document_id("text").alias("sha"))


@query("str_13_tidy", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '\s+([,.!?])', '\1', 'g'), '(?m)^[ \t]+$', '', 'g')) AS digest FROM documents")
def str_13(spark, d):
    return documents(spark, d).select("doc_id", F.md5(rewrite.tidy(F.col("text")).cast("binary")).alias("digest"))


@query("str_14_change_rate")
def str_14(spark, d):
    return documents(spark, d).select("doc_id", rewrite.change_rate("text", F.upper("text")).alias("rate"))


@query("str_15_n_chars", f"SELECT doc_id, length({strip('text')})::BIGINT AS n FROM documents")
def str_15(spark, d):
    return documents(spark, d).select("doc_id", T.n_chars("text").cast("long").alias("n"))


@query("mth_1_sigmoid", "SELECT l_orderkey, l_linenumber, round(CASE WHEN x > 60 THEN 1.0 WHEN x < -60 THEN 0.0 ELSE 1 / (1 + exp(-x)) END, 9) AS p FROM (SELECT *, (l_quantity - 25) * 3 AS x FROM lineitem)")
def mth_1(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(detect.sigmoid((F.col("l_quantity") - 25) * 3), 9).alias("p"))


# Metrics


def _metric_query(i: int, metric: str) -> None:
    sql = f"SELECT doc_id, round({metric}, 9) AS value FROM ({metrics_sql(DOCS_SQL)}) UNION ALL SELECT doc_id - 100, round({metric}, 9) FROM ({metrics_sql(TEXTS_SQL)})"

    def run(spark: SparkSession, d: str) -> DataFrame:
        both = documents(spark, d).select("doc_id", "text").unionByName(X.texts(spark).select((F.col("doc_id") - 100).alias("doc_id"), "text"))
        split = both.withColumn("s", T.sentences("text"))
        return split.select("doc_id", F.round(M.all_metrics("text", F.col("s"))[metric], 9).alias("value"))

    query(f"agg_{i}_{metric}", sql)(run)


for _i, _m in enumerate(METRIC_SQL, 7):
    _metric_query(_i, _m)


@query("agg_13_sentence_lengths", f"SELECT doc_id, len(s)::BIGINT AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS total FROM ({split_sql(DOCS_SQL)})")
def agg_13(spark, d):
    n = documents(spark, d).select("doc_id", T.sentences("text").alias("s")).withColumn("n", M.sentence_lengths("s"))
    return n.select("doc_id", F.size("n").cast("long").alias("n"), F.coalesce(F.array_max("n"), F.lit(0)).cast("long").alias("longest"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("mth_3_z_scores", f"SELECT doc_id, {', '.join(f'round({z_sql(k)}, 9) AS {k}' for k in detect.METRICS)} FROM ({metrics_sql(DOCS_SQL)})")
def mth_3(spark, d):
    return detect.layers(documents(spark, d)).select("doc_id", *[F.round(f"z.{k}", 9).alias(k) for k in detect.METRICS])


# Patterns, layers, scores

def _counts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    counts = docs.select("doc_id", F.posexplode(detect.pattern_counts(F.col("text"))).alias("ord", "n")).where("n > 0")
    return counts.join(F.broadcast(detect.registry_table(spark).select("ord", "pattern_id")), "ord").select("doc_id", "pattern_id", F.col("n").cast("long").alias("n"))


@query("agg_1_pattern_counts", f"SELECT doc_id, pattern_id, n FROM ({' UNION ALL '.join(f'SELECT doc_id, {X.quoted(p.id)} AS pattern_id, ({count_sql(p)})::BIGINT AS n FROM ({TEXTS_SQL})' for p in R.PATTERNS)}) WHERE n > 0")
def agg_1(spark, d):
    return _counts(spark, X.texts(spark))


@query("agg_1_pattern_counts_on_documents", f"WITH {hits_sql(KNOWN_SQL)} SELECT doc_id, pattern_id, count(*)::BIGINT AS n FROM hits GROUP BY ALL")
def agg_1_documents(spark, d):
    return _counts(spark, known_texts(spark, d))


@query("agg_1_known_counts", f"SELECT case_id::INT AS case_id, id, n::BIGINT AS n FROM {X.values([(k, i, n) for k, i, _, n in ROWS], 't', 'case_id, id, n')}")
def agg_1_known(spark, d):
    """For each pattern and human signal its count in its own cases, against the known numbers."""
    asked = spark.createDataFrame([(k, i, t) for k, i, t, _ in ROWS], "case_id int, id string, text string")
    counts = F.map_from_arrays(F.array(*[F.lit(x.id) for x in (*R.PATTERNS, *R.HUMAN)]), F.concat(detect.pattern_counts(F.col("text")), detect.human_counts(F.col("text"))))
    return asked.select("case_id", "id", F.element_at(counts, F.col("id")).cast("long").alias("n"))


_PLAIN = [R.BY_ID[k] for k in ("C-2", "C-5", "C-9", "C-10", "C-50", "J-2", "J-3", "J-4")]


@query("flt_2_counts_on_documents", f"SELECT doc_id, {', '.join(f'({count_sql(p)})::BIGINT AS {p.id.replace("-", "_").lower()}' for p in _PLAIN)} FROM ({DOCS_SQL})")
def flt_2(spark, d):
    return documents(spark, d).select("doc_id", *[detect.pattern_count(F.col("text"), p).cast("long").alias(p.id.replace("-", "_").lower()) for p in _PLAIN])


@query("agg_4_human_counts", f"SELECT doc_id, {', '.join(f'{n_matches("text", re2(h.expression))}::BIGINT AS {h.id.replace("-", "_").lower()}' for h in R.HUMAN)} FROM ({TEXTS_SQL})")
def agg_4(spark, d):
    return _human_counts(X.texts(spark))


@query("agg_4_human_counts_on_documents", f"SELECT doc_id, {', '.join(f'{n_matches("text", re2(h.expression))}::BIGINT AS {h.id.replace("-", "_").lower()}' for h in R.HUMAN)} FROM ({ALL_SQL})")
def agg_4_documents(spark, d):
    return _human_counts(all_texts(spark, d))


def _human_counts(docs: DataFrame) -> DataFrame:
    c = docs.select("doc_id", detect.human_counts(F.col("text")).alias("c"))
    return c.select("doc_id", *[F.col("c")[i].cast("long").alias(h.id.replace("-", "_").lower()) for i, h in enumerate(R.HUMAN)])


@query("scr_1_score", layers_sql(DOCS_SQL))
def scr_1(spark, d):
    return _layer_columns(documents(spark, d))


@query("scr_2_score_korean", layers_sql(KOREAN_SQL))
def scr_2(spark, d):
    return _layer_columns(korean(spark))


@query("flt_8_confidence", f"SELECT conv_id, turn, CASE WHEN n < 150 THEN 'insufficient' WHEN n < 400 THEN 'low' ELSE 'normal' END AS confidence FROM (SELECT conv_id, turn, length({strip('text')}) AS n FROM conversations)")
def flt_8(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", detect.confidence(T.n_chars("text")).alias("confidence"))


@query("flt_9_band", "SELECT event_id, CASE WHEN value >= 60 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS band FROM events")
def flt_9(spark, d):
    return table(spark, d, "events").select("event_id", detect.band("value").alias("band"))


@query("scr_4_report", report_sql(ALL_SQL))
def scr_4(spark, d):
    full = detect.analyze(all_texts(spark, d))
    return full.select("doc_id", "score", F.size("signals").alias("n_signals"), F.size("notes").alias("n_notes"), F.array_join("signals.key", " ").alias("signals"))


@query("rw_3_hits", f'WITH {hits_sql(KNOWN_SQL)} SELECT doc_id, pattern_id, start, "end", text FROM hits')
def rw_3(spark, d):
    return detect.hits(known_texts(spark, d)).select("doc_id", "pattern_id", "start", "end", "text")


@query("scr_3_sentence_scores", SENTENCE_SCORES_SQL)
def scr_3(spark, d):
    return detect.sentence_scores(known_texts(spark, d)).select("doc_id", "idx", "text", "score", F.array_join("hit_ids", " ").alias("hit_ids"), F.array_join(F.array_distinct("hit_ids"), " ").alias("unique_ids"))


@query("win_1_sentence_offsets", f"SELECT doc_id, i::INT AS idx, x AS text FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM ({split_sql(DOCS_SQL)}))")
def win_1(spark, d):
    placed = documents(spark, d).select("doc_id", "text", F.posexplode(detect.sentence_spans("text", T.sentences("text"))).alias("idx", "s"))
    # The text is cut out again at the offsets: they are right if it is the sentence.
    return placed.select("doc_id", "idx", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))


@query("srt_3_top_sentences", f"SELECT doc_id, idx, score FROM (SELECT doc_id, idx, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r FROM ({SENTENCE_SCORES_SQL}) WHERE score > 25) WHERE r <= 12")
def srt_3(spark, d):
    """The sentences that a report shows: the highest scores, above the floor."""
    rows = detect.with_sentence_scores(known_texts(spark, d)).select("doc_id", F.explode(report.worst_sentences(report.HOT, report.SHOWN_SENTENCES)).alias("t"))
    return rows.select("doc_id", "t.idx", (-F.col("t.down")).alias("score"))


@query("snk_7_registry", f"SELECT * FROM {X.values([(p.id, p.name, p.severity, p.weight, p.risk, p.min_count) for p in R.PATTERNS], 't', 'pattern_id, name, severity, weight, risk, min_count')}".replace("SELECT *", "SELECT pattern_id, name, severity::INT AS severity, weight::DOUBLE AS weight, risk, min_count::INT AS min_count"))
def snk_7(spark, d):
    return detect.registry_table(spark).select("pattern_id", "name", "severity", "weight", "risk", "min_count")


# Rewriting


@query("rw_1_rewrites", f"SELECT case_id, text FROM {X.values([(c, e) for c, _, _, e in X.REWRITES], 't', 'case_id, text')}")
def rw_1(spark, d):
    parts = [rewrite.polish(X.rewrites(spark, level), level, scores=False).select(F.col("doc_id").alias("case_id"), "text") for level in R.RISKS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("rw_2_polish")
def rw_2(spark, d):
    return rewrite.polish(all_texts(spark, d), "aggressive").select("doc_id", "text", "change_rate", "aborted", "before_score", "after_score", "improved", F.to_json("changes").alias("changes"))


_PAIRS = [(c, lv, a, b) for c, lv, a, b in X.REWRITES]
_RATES = [(c, round(1 - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 4)) for c, _, a, b in _PAIRS]


@query("str_14_change_rate_of_rewrites", f"SELECT case_id, rate::DOUBLE AS rate FROM {X.values(_RATES, 't', 'case_id, rate')}")
def str_14_pairs(spark, d):
    rows = spark.createDataFrame([(c, a, b) for c, _, a, b in _PAIRS], "case_id string, a string, b string")
    return rows.select("case_id", F.bround(rewrite.change_rate("a", "b"), 4).alias("rate"))


@query("rw_2_polish_known", f"SELECT case_id, text, change_rate::DOUBLE AS change_rate, changed, aborted FROM {X.values([(c, b, rate, a != b, c.startswith('gate')) for (c, _, a, b), (_, rate) in zip(_PAIRS, _RATES, strict=True)], 't', 'case_id, text, change_rate, changed, aborted')}")
def rw_2_known(spark, d):
    """Rewrites of the cases by level with their rate of change, whether a rule changed them, and whether they were given up."""
    parts = [rewrite.polish(X.rewrites(spark, level), level, scores=False) for level in R.RISKS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select(F.col("doc_id").alias("case_id"), "text", "change_rate", (F.size("changes") > 0).alias("changed"), "aborted")


@query("str_16_prompts")
def str_16(spark, d):
    return prompt.prompts(all_texts(spark, d))


# Evaluation: score and class are made from the tables, so SQL can follow.

_SCORED_SQL = f"SELECT d.doc_id, 1 - l.quality AS positive, round((d.n_chars % 997) / 9.97 + l.toxic, 1) AS score, d.n_chars, {GENRE_SQL} AS genre FROM documents d JOIN labels l USING (doc_id)"
_SLICES_SQL = f"""
sc AS MATERIALIZED ({_SCORED_SQL}), rows AS MATERIALIZED (
  SELECT unnest(['overall', 'length ' || CASE WHEN n_chars < 150 THEN '0-150' WHEN n_chars < 400 THEN '150-400' WHEN n_chars < 1000 THEN '400-1000' ELSE '1000+' END, 'genre ' || genre]) AS slice, positive, score FROM sc
)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", (1 - F.col("quality")).alias("positive"), F.round((F.col("n_chars") % 997) / 9.97 + F.col("toxic"), 1).alias("score"), "n_chars", F.expr(GENRE_SQL).alias("genre"))


@query("evl_3_auroc", f"WITH {_SLICES_SQL}, u AS (SELECT slice, sum(CASE WHEN a.score > h.score THEN 1.0 WHEN a.score = h.score THEN 0.5 ELSE 0 END) AS wins FROM rows a JOIN rows h USING (slice) WHERE a.positive = 1 AND h.positive = 0 GROUP BY slice) SELECT slice, sum(1 - positive)::BIGINT AS n_human, sum(positive)::BIGINT AS n_ai, round(coalesce(any_value(wins)::DOUBLE / nullif(sum(positive) * sum(1 - positive), 0)::DOUBLE, 0.5), 9) AS auroc FROM rows LEFT JOIN u USING (slice) GROUP BY slice")
def evl_3(spark, d):
    return evaluate.auroc(evaluate.slices(scored(spark, d))).withColumn("auroc", F.round("auroc", 9))


@query("evl_2_operating_points", f"WITH {_SLICES_SQL}, g AS (SELECT slice, coalesce(list(score ORDER BY score DESC) FILTER (positive = 0), []) AS h, coalesce(list(score) FILTER (positive = 1), []) AS a FROM rows GROUP BY slice), t AS (SELECT *, unnest([0.01, 0.05, 0.10])::DOUBLE AS target_fpr FROM g), q AS (SELECT *, CASE WHEN len(h) = 0 THEN 50.0 WHEN floor(len(h) * target_fpr) >= len(h) THEN 0.0 ELSE h[floor(len(h) * target_fpr)::BIGINT + 1] + 1e-9 END AS threshold FROM t) SELECT slice, target_fpr, round(threshold, 6) AS threshold, round(coalesce(len(list_filter(a, lambda x: x >= threshold))::DOUBLE / nullif(len(a), 0), 0.0), 9) AS tpr FROM q")
def evl_2(spark, d):
    points = evaluate.operating_points(evaluate.slices(scored(spark, d)))
    return points.select("slice", F.col("target_fpr").cast("double").alias("target_fpr"), F.round("threshold", 6).alias("threshold"), F.round("tpr", 9).alias("tpr"))


_AUROC_SQL = "u AS (SELECT slice, sum(CASE WHEN a.score > h.score THEN 1.0 WHEN a.score = h.score THEN 0.5 ELSE 0 END) AS wins FROM rows a JOIN rows h USING (slice) WHERE a.positive = 1 AND h.positive = 0 GROUP BY slice), au AS (SELECT slice, sum(1 - positive)::BIGINT AS n_human, sum(positive)::BIGINT AS n_ai, coalesce(any_value(wins)::DOUBLE / nullif(sum(positive) * sum(1 - positive), 0)::DOUBLE, 0.5) AS auroc, sum(round(score * 10)::BIGINT) FILTER (positive = 0)::DOUBLE / (10 * count(*) FILTER (positive = 0))::DOUBLE AS mean_human, sum(round(score * 10)::BIGINT) FILTER (positive = 1)::DOUBLE / (10 * count(*) FILTER (positive = 1))::DOUBLE AS mean_ai FROM rows LEFT JOIN u USING (slice) GROUP BY slice)"


@query("agg_19_summary", f"WITH {_SLICES_SQL}, {_AUROC_SQL} SELECT slice, n_human, n_ai, round(auroc, 9) AS auroc, round(mean_human, 6) AS mean_human, round(mean_ai, 6) AS mean_ai FROM au")
def agg_19(spark, d):
    return evaluate.summary(scored(spark, d)).select("slice", "n_human", "n_ai", F.round("auroc", 9).alias("auroc"), F.round("mean_human", 6).alias("mean_human"), F.round("mean_ai", 6).alias("mean_ai"))


@query("evl_4_adversarial_drop", f"WITH sc AS MATERIALIZED ({_SCORED_SQL}), h AS (SELECT list(score ORDER BY score DESC) AS l FROM sc WHERE positive = 0), t AS (SELECT l[floor(len(l) * 0.01)::BIGINT + 1] + 1e-9 AS threshold FROM h), p AS (SELECT avg((score >= threshold)::INT::DOUBLE) AS a, avg((score * 0.9 >= threshold)::INT::DOUBLE) AS b FROM sc, t WHERE positive = 1) SELECT round(a, 9) AS tpr_overall, round(b, 9) AS tpr_adversarial, round(a - b, 9) AS drop FROM p")
def evl_4(spark, d):
    rows = scored(spark, d)
    return _rounded(evaluate.adversarial_drop(rows, rows.withColumn("score", F.col("score") * 0.9)), 9)


def _rounded(df: DataFrame, places: int) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# A labelled corpus from end to end: texts are scored, then reported. Class 1 are the documents of low quality and the inline texts of the pattern cases.

_LABELLED_SQL = f"SELECT t.doc_id, t.text, t.genre, CASE WHEN t.doc_id < -300 THEN 1 WHEN t.doc_id < 0 THEN 0 ELSE 1 - l.quality END AS label FROM ({KNOWN_SQL}) t LEFT JOIN labels l USING (doc_id) WHERE t.doc_id < 0 OR l.quality IS NOT NULL"


def labelled_corpus(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("doc_id") < -300, 1).when(F.col("doc_id") < 0, 0).otherwise(1 - F.col("quality"))
    joined = known_texts(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.where("doc_id < 0 OR quality IS NOT NULL").select("doc_id", "text", "genre", label.alias("label"))


def _real_scores_sql() -> str:
    return f"sc AS MATERIALIZED (SELECT x.doc_id, x.score, x.n_chars, g.genre, g.label AS positive FROM ({layers_sql(_LABELLED_SQL)}) x JOIN ({_LABELLED_SQL}) g USING (doc_id))"


_REAL_SLICES_SQL = "rows AS MATERIALIZED (SELECT unnest(['overall', 'length ' || CASE WHEN n_chars < 150 THEN '0-150' WHEN n_chars < 400 THEN '150-400' WHEN n_chars < 1000 THEN '400-1000' ELSE '1000+' END, 'genre ' || genre]) AS slice, positive, score FROM sc)"


@query("evl_1_score_rows", f"WITH {_real_scores_sql()} SELECT doc_id, positive::INT AS positive, score, n_chars, genre FROM sc")
def evl_1(spark, d):
    return evaluate.score_rows(labelled_corpus(spark, d))


@query("evl_6_evaluation", f"WITH {_real_scores_sql()}, {_REAL_SLICES_SQL}, {_AUROC_SQL} SELECT slice, n_human, n_ai, round(auroc, 4) AS auroc, round(mean_human, 1) AS mean_human, round(mean_ai, 1) AS mean_ai, CASE WHEN n_human = 0 OR n_ai = 0 THEN 1 ELSE 4 END AS n_lines FROM au")
def evl_6(spark, d):
    rows = evaluate.evaluation(evaluate.score_rows(labelled_corpus(spark, d)))
    lines = evaluate.blocks(rows).select("slice", (F.size(F.split("block", "\n")) - 1).alias("n_lines"))
    return rows.drop("operating_points").join(lines, "slice")


# Corpus and calibration

_NORMAL_SQL = r"regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("lang").alias("label"), F.col("source").alias("genre"), "text")


@query("snk_1_admit", f"SELECT label, substring(sha1(t), 1, 12) AS doc_id, min(genre) AS genre, length(t)::BIGINT AS n FROM (SELECT lang AS label, source AS genre, {_NORMAL_SQL} AS t FROM documents) WHERE length(t) >= 400 GROUP BY label, t")
def snk_1(spark, d):
    return corpus.admit(_corpus(spark, d)).select("label", "doc_id", "genre", F.length("text").cast("long").alias("n"))


@query("jn_7_admit_new", f"SELECT DISTINCT label, substring(sha1(t), 1, 12) AS doc_id FROM (SELECT lang AS label, {_NORMAL_SQL} AS t FROM documents) WHERE length(t) >= 400 AND label <> 'fr'")
def jn_7(spark, d):
    docs = _corpus(spark, d)
    return corpus.admit(docs, corpus.admit(docs.where("label = 'fr'"))).select("label", "doc_id")


@query("agg_15_statistics", "SELECT lang AS label, source AS genre, count(*)::BIGINT AS n, round(avg(strlen(text)) / 3, 6) AS mean_chars FROM documents GROUP BY ROLLUP (lang, source)")
def agg_15(spark, d):
    return corpus.statistics(_corpus(spark, d)).withColumn("mean_chars", F.round("mean_chars", 6))


@query("jn_9_generation_prompts")
def jn_9(spark, d):
    return corpus.generation_prompts(corpus.topics(documents(spark, d)), 500)


@query("agg_17_class_means", f"""WITH sc AS MATERIALIZED (SELECT x.*, g.label FROM ({layers_sql(_LABELLED_SQL, 15)}) x JOIN ({_LABELLED_SQL}) g USING (doc_id) WHERE length(g.text) >= 150),
 m AS (SELECT layer, avg(v) FILTER (label = 0) AS human, avg(v) FILTER (label = 1) AS machine FROM (SELECT label, unnest(['l1', 'l2', 'l3', 'l4']) AS layer, unnest([l1, l2, l3, l4]) AS v FROM sc) GROUP BY layer)
 SELECT layer, round(human, 6) AS human, round(machine, 6) AS machine, round(machine - human, 6) AS gap FROM m""")
def agg_17(spark, d):
    return _rounded(calibrate.class_means(calibrate.features(labelled_corpus(spark, d))), 6)


@query("cal_2_fit")
def cal_2(spark, d):
    weights = calibrate.fit(calibrate.features(labelled_corpus(spark, d)), min_docs=1)
    return spark.createDataFrame(sorted(weights.items()), "name string, weight double")


@query("agg_16_metric_baselines", f"SELECT genre, metric, round(round(avg(v), 5), 4) AS mean, round(round(stddev_pop(v), 5), 4) AS sd, count(*)::BIGINT AS n FROM (SELECT genre, unnest([{', '.join(X.quoted(k) for k in METRIC_SQL)}]) AS metric, unnest([{', '.join(METRIC_SQL)}]) AS v FROM ({metrics_sql(DOCS_SQL)}) WHERE length(text) >= 150) GROUP BY ALL HAVING count(*) >= 20")
def agg_16(spark, d):
    return calibrate.metric_baselines(documents(spark, d)).select("genre", "metric", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n")


# History: events as a log


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", "user_id", F.col("event_type").alias("kind"), F.round("value", 1).alias("score"), F.col("event_type").alias("text"), F.col("props").alias("result"))


@query("win_3_without_repeats", "SELECT event_id AS id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def win_3(spark, d):
    return history.without_repeats(_log(spark, d), key="user_id").select("id")


@query("his_1_newest", "SELECT event_id AS id FROM events ORDER BY event_id DESC LIMIT 500")
def his_1(spark, d):
    return history.newest(_log(spark, d)).select("id")


@query("his_2_recent", "SELECT event_id AS id, event_type AS kind FROM events ORDER BY event_id DESC LIMIT 60")
def his_2(spark, d):
    return history.recent(_log(spark, d)).select("id", "kind")


@query("his_4_delete", "SELECT event_id AS id FROM events WHERE event_id % 7 <> 0")
def his_4(spark, d):
    log = _log(spark, d)
    return history.delete(log, log.where("id % 7 = 0")).select("id")


@query("his_5_stats", "SELECT count(*)::BIGINT AS total, round(avg(round(value, 1)) FILTER (event_type = 'click'), 1) AS avg_score FROM events")
def his_5(spark, d):
    return history.stats(_log(spark, d).withColumn("kind", F.when(F.col("kind") == "click", "detect").otherwise(F.col("kind"))))


@query("jn_4_hits_in_sentences", f"SELECT doc_id, i::INT AS idx, len(regexp_extract_all(x, '\\([^)\\n]{{6,60}}\\)'))::BIGINT AS n FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM ({split_sql(KNOWN_SQL)})) WHERE len(regexp_extract_all(x, '\\([^)\\n]{{6,60}}\\)')) > 0")
def jn_4(spark, d):
    return detect.sentence_hits(known_texts(spark, d), ("J-4",), apply_min_count=False).groupBy("doc_id", "idx").agg(F.count("*").alias("n"))


# Single layers, gates and joins with the fixed tables

for _name, _layer in (("agg_5_l1", "l1"), ("agg_2_l2_density", "l2"), ("agg_6_l3_rhythm", "l3"), ("agg_3_l4_human_evidence", "l4")):

    def _one(spark: SparkSession, d: str, layer: str = _layer) -> DataFrame:
        both = documents(spark, d).select("doc_id", "text", "genre").unionByName(X.texts(spark).withColumn("doc_id", F.col("doc_id") - 100))
        return detect.layers(both).select("doc_id", F.round(layer, 6).alias("value"))

    query(_name, f"SELECT doc_id, {_layer} AS value FROM ({layers_sql(f"{DOCS_SQL} UNION ALL SELECT doc_id - 100, text, genre FROM ({TEXTS_SQL})")})")(_one)


@query("flt_1_pattern_subset", f"SELECT doc_id, ({count_sql(R.BY_ID['C-1'])} + {count_sql(R.BY_ID['H-1'])})::BIGINT AS n FROM ({TEXTS_SQL})")
def flt_1(spark, d):
    return _subset_counts(X.texts(spark))


@query("flt_1_pattern_subset_on_documents", f"SELECT doc_id, ({count_sql(R.BY_ID['C-1'])} + {count_sql(R.BY_ID['H-1'])})::BIGINT AS n FROM ({ALL_SQL})")
def flt_1_documents(spark, d):
    return _subset_counts(all_texts(spark, d))


def _subset_counts(docs: DataFrame) -> DataFrame:
    counts = detect.pattern_counts(F.col("text"), ("C-1", "H-1", "no such id"))
    return docs.select("doc_id", F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


_LEVELS = [(level, p.id) for level in (*R.RISKS, "unknown") for p in rewrite.rules(level)]


#: Patterns with a rewrite, by the level from which it is applied.
_SAFE, _MODERATE, _AGGRESSIVE = "A-8 C-5 C-11a", "A-7 A-20 A-50 A-51 D-1a D-1b D-1c G-2 G-2b", "A-2 A-17 C-50 D-50 F-1"
_GATED = [(level, k) for level, ids in (("safe", _SAFE), ("moderate", f"{_SAFE} {_MODERATE}"), ("aggressive", f"{_SAFE} {_MODERATE} {_AGGRESSIVE}"), ("unknown", f"{_SAFE} {_MODERATE}")) for k in ids.split()]
_REWRITABLE = ", ".join(X.quoted(k) for k in f"{_SAFE} {_MODERATE} {_AGGRESSIVE}".split())


@query("flt_3_risk_gate", f"SELECT * FROM {X.values(_GATED, 't', 'level, pattern_id')}")
def flt_3(spark, d):
    return spark.createDataFrame(_LEVELS, "level string, pattern_id string")


@query("flt_11_detect_only", f"SELECT * FROM {X.values([(p.id,) for p in R.PATTERNS], 't', 'pattern_id')} WHERE pattern_id NOT IN ({_REWRITABLE})")
def flt_11(spark, d):
    return detect.registry_table(spark).where(~F.col("pattern_id").isin(*rewrite.REWRITES)).select("pattern_id")


@query("flt_12_long_paragraphs", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda p: length(p) >= 40))::BIGINT AS n, coalesce(len(regexp_extract_all(text, '[가-힣]'))::DOUBLE / nullif(length(text), 0), 0.0) AS hangul FROM documents")
def flt_12(spark, d):
    return documents(spark, d).select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda p: F.length(p) >= corpus.PARAGRAPH_CHARS)).cast("long").alias("n"), corpus.hangul_share(F.col("text")).alias("hangul"))


@query("prj_2_registry_columns", f"SELECT pattern_id, CASE left(pattern_id, 1) WHEN 'A' THEN '번역투' WHEN 'B' THEN '영어 인용·용어 과다' WHEN 'C' THEN '구조적 AI 패턴' WHEN 'D' THEN 'AI 특유 관용구' WHEN 'E' THEN '리듬 균일성' WHEN 'F' THEN '수식·중복' WHEN 'G' THEN 'hedging 남용' WHEN 'H' THEN '접속사 남발' WHEN 'I' THEN '형식명사·의존명사 과다' ELSE '시각 장식 남용' END AS category_name, pattern_id IN ({_REWRITABLE}) AS rewritable FROM {X.values([(p.id,) for p in R.PATTERNS], 't', 'pattern_id')}")
def prj_2(spark, d):
    return detect.registry_table(spark).select("pattern_id", "category_name", F.col("pattern_id").isin(*rewrite.REWRITES).alias("rewritable"))


_CELLS = [(g, m, c[0], c[1]) for g, cells in R.BASELINES.items() for m, c in cells.items() if c]


@query("jn_3_baselines", f"SELECT doc_id, metric, human::DOUBLE AS human, ai::DOUBLE AS ai FROM ({DOCS_SQL}) JOIN {X.values(_CELLS, 'b', 'genre, metric, human, ai')} USING (genre)")
def jn_3(spark, d):
    cells = spark.createDataFrame(_CELLS, "genre string, metric string, human double, ai double")  # 14 rows
    return documents(spark, d).select("doc_id", M.genre_cell("genre").alias("genre")).join(F.broadcast(cells), "genre").select("doc_id", "metric", "human", "ai")


@query("agg_20_length_slices", "SELECT CASE WHEN n_chars < 150 THEN '0-150' WHEN n_chars < 400 THEN '150-400' WHEN n_chars < 1000 THEN '400-1000' ELSE '1000+' END AS slice, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def agg_20(spark, d):
    return table(spark, d, "documents").groupBy(evaluate.length_slice("n_chars").alias("slice")).agg(F.count("*").alias("n"))


@query("win_4_kth_highest", "SELECT lang, score FROM (SELECT lang, n_chars AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC) AS r, floor(count(*) OVER (PARTITION BY lang) * 0.05)::BIGINT + 1 AS k FROM documents) WHERE r = k")
def win_4(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("slice"), F.lit(0).alias("positive"), F.col("n_chars").cast("double").alias("score"))
    return evaluate.operating_points(rows, (0.05,)).select(F.col("slice").alias("lang"), F.round("threshold", 0).cast("long").alias("score"))


@query("his_3_get", "SELECT event_id AS id, event_type AS kind FROM events WHERE event_id = 7")
def his_3(spark, d):
    return history.get(_log(spark, d), 7).select("id", "kind")


@query("set_6_classes", "SELECT doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS label FROM documents WHERE lang IN ('en', 'de')")
def set_6(spark, d):
    docs = documents(spark, d).select("doc_id", "lang")
    return corpus.classes(docs.where("lang = 'en'"), docs.where("lang = 'de'")).select("doc_id", "label")


@query("evl_5_adversarial", f"SELECT doc_id, {X.quoted('essay')} AS genre, text FROM {X.values([(c, e) for c, lv, _, e in X.REWRITES if lv == 'moderate'], 't', 'doc_id, text')}")
def evl_5(spark, d):
    return corpus.adversarial(X.rewrites(spark, "moderate"), "moderate")


@query("evl_5_adversarial_on_documents")
def evl_5_documents(spark, d):
    return corpus.adversarial(all_texts(spark, d), "moderate")


@query("snk_6_report_json")
def snk_6(spark, d):
    return report.report_json(all_texts(spark, d))


@query("snk_5_report_text")
def snk_5(spark, d):
    return report.report_text(all_texts(spark, d))


@query("snk_6_unified_diff", "SELECT case_id, CASE WHEN a = b THEN '' ELSE '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || a || chr(10) || '+' || b END AS diff FROM " + X.values([(c, t, e) for c, _, t, e in X.REWRITES if "\n" not in t], "t", "case_id, a, b"))
def snk_6_diff(spark, d):
    rows = spark.createDataFrame([(c, t, e) for c, _, t, e in X.REWRITES if "\n" not in t], "case_id string, a string, b string")
    return rows.select("case_id", report.unified_diff("a", "b").alias("diff"))
