"""Chunking, rules, reports and corpus checks over the tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import fixed_values as V
from tarn.functions import rules as R
from tarn.functions import text as T
from tarn.operators import chunking as C
from tarn.operators import corpus_qa as Q
from tarn.operators import evaluation as E
from tarn.operators import cases, judging, reports, runs
from tarn.plans.retrieval import _t
from tarn.sources import markdown


def _docs(spark: SparkSession, sf_dir: str, paragraphs: bool = False) -> DataFrame:
    """Documents with the title that chunks take; with ``paragraphs`` each line end is a blank line."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n")) if paragraphs else F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.concat_ws("-", "source", "lang").alias("title"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: the source as chapter, the language as section, lines as paragraphs, the rest below a level-3 heading."""
    head = F.concat(F.lit("lost\n# "), "source", F.lit("\n"), F.lit("lead of "), "source", F.lit("\n## "), "lang", F.lit("\n"))
    tail = F.concat(F.lit("\n### part\n[12](#a)\nend of "), "source", F.lit("\n"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n\n")), tail).alias("text"), F.col("source").alias("title"))


_PARAS = "list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p)), lambda p: p <> '')"
_SENT = "[^.!?。！？；;]+[.!?。！？；;]?"


def chunk_fixed(spark, sf_dir):
    return C.fixed_size(_docs(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_count", "content", "source", "source_id")


FIXED_SQL = """
WITH n AS (SELECT doc_id, text, CAST(ceil(length(text) / 900) AS INTEGER) AS chunk_count FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, chunk_count, CAST(unnest(range(1, chunk_count + 1)) AS INTEGER) AS chunk_index FROM n)
SELECT doc_id, chunk_index, chunk_count, substr(text, (chunk_index - 1) * 900 + 1, 900) AS content, format('chunk_{:04d}.md', chunk_index) AS source, format('fixed_size_900_chunk_{:04d}', chunk_index) AS source_id FROM c
"""


def chunk_recursive(spark, sf_dir):
    return C.recursive(_docs(spark, sf_dir, True)).select("doc_id", "chunk_index", "chunk_count", "content", "source_id")


#: The packing fold runs over one string: chr(1) begins a chunk, chr(2) closes one that was cut.
RECURSIVE_SQL = f"""
WITH u AS (SELECT doc_id, flatten(list_transform({_PARAS}, lambda p: CASE WHEN length(p) <= 900 THEN [p] ELSE list_filter(list_transform(regexp_extract_all(p, '{_SENT}'), lambda s: trim(s)), lambda s: s <> '') END)) AS units FROM documents),
p AS (SELECT doc_id, list_reduce(units, lambda acc, x: CASE
    WHEN length(x) > 900 THEN acc || chr(1) || list_aggregate(list_transform(range(0, CAST(ceil(length(x) / 900) AS BIGINT)), lambda i: substr(x, i * 900 + 1, 900)), 'string_agg', chr(1)) || chr(2)
    WHEN acc = '' OR acc[-1:] = chr(2) OR length(string_split(acc, chr(1))[-1]) + 2 + length(x) > 900 THEN acc || chr(1) || x
    ELSE acc || chr(10) || chr(10) || x END, '') AS packed FROM u WHERE len(units) > 0),
c AS (SELECT doc_id, list_transform(string_split(packed, chr(1))[2:], lambda c: replace(c, chr(2), '')) AS chunks FROM p),
e AS (SELECT doc_id, CAST(len(chunks) AS INTEGER) AS chunk_count, unnest(chunks) AS content, CAST(unnest(range(1, len(chunks) + 1)) AS INTEGER) AS chunk_index FROM c)
SELECT doc_id, chunk_index, chunk_count, content, format('recursive_chunk_{{:04d}}', chunk_index) AS source_id FROM e
"""


def section_raw(spark, sf_dir):
    return C.section_raw(_markdown(spark, sf_dir)).select("doc_id", "chapter_id", "section_id", "chapter_title", "section_title", "title", "content", "source", "source_id")


SECTION_RAW_SQL = r"""
WITH b AS (SELECT doc_id, source AS s, lang AS l, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)) AS lines FROM documents),
t AS (SELECT doc_id, s, l, list_filter(list_transform(lines, lambda x: rtrim(x)), lambda x: NOT regexp_matches(trim(x), '\[\d+\]\([^)]*\)\s*$|^.*\.{2,}\s*\d+\s*$')) AS lines FROM b),
o AS (SELECT doc_id, s, l, ltrim(array_to_string(lines, chr(10)), chr(10)) || chr(10) || chr(10) || '### part' || chr(10) || chr(10) || 'end of ' || s AS body FROM t)
SELECT doc_id, 'ch00' AS chapter_id, 's00' AS section_id, s AS chapter_title, '' AS section_title, s AS title, 'lead of ' || s AS content, 'ch00/s00.md' AS source, 'ch00_s00_chunk_01' AS source_id FROM o
UNION ALL SELECT doc_id, 'ch00', 's01', s, l, l, body, 'ch00/s01.md', 'ch00_s01_chunk_01' FROM o
"""


def section_parse(spark, sf_dir):
    return C.parse_sections(_markdown(spark, sf_dir)).select("doc_id", "section_order", "chapter_id", "section_id", "chapter_title", "section_title", F.size("body_lines").alias("n_lines"))


SECTION_PARSE_SQL = SECTION_RAW_SQL.split("SELECT doc_id, 'ch00' AS chapter_id")[0] + """
SELECT doc_id, 1 AS section_order, 'ch00' AS chapter_id, 's00' AS section_id, s AS chapter_title, '' AS section_title, 1 AS n_lines FROM o
UNION ALL SELECT doc_id, 2, 'ch00', 's01', s, l, CAST(len(string_split(body, chr(10))) AS INTEGER) FROM o
"""


_NN = "chr(10) || chr(10)"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _kept(items: str) -> str:
    """Stripped texts that aren't empty."""
    return f"list_filter(list_transform({items}, lambda z: {_stripped('z')}), lambda z: z <> '')"


def _folded(items: str, step: str) -> str:
    """The chunks of a fold over one string, in which chr(1) begins a chunk and chr(2) closes one that was cut; ``step`` is of acc and u."""
    return f"(CASE WHEN len({items}) = 0 THEN [] ELSE list_transform(string_split(list_reduce({items}, lambda acc, u: {step}, ''), chr(1))[2:], lambda c: replace(c, chr(2), '')) END)"


def _filled(items: str, size: int, joint: str) -> str:
    pieces = f"list_aggregate(list_transform(range(0, CAST(ceil(length(u) / {size}) AS BIGINT)), lambda i: substr(u, i * {size} + 1, {size})), 'string_agg', chr(1))"
    fits = f"acc <> '' AND acc[-1:] <> chr(2) AND length(string_split(acc, chr(1))[-1]) + length({joint}) + length(u) <= {size}"
    return _folded(items, f"CASE WHEN length(u) > {size} THEN acc || chr(1) || {pieces} || chr(2) WHEN {fits} THEN acc || {joint} || u ELSE acc || chr(1) || u END")


def _sectioned_sql(units: str, chunks: str) -> str:
    """Chunks of the two sections that each document of ``_strategy`` has, from SQL for units of the body's paragraphs and for chunks of units."""
    return SECTION_RAW_SQL.split("SELECT doc_id, 'ch00' AS chapter_id")[0].rstrip() + f""",
ps AS (SELECT doc_id, {_kept("string_split_regex(body, chr(10) || '\\s*' || chr(10))")} AS paras FROM o),
us AS (SELECT doc_id, flatten(list_transform(paras, lambda p: {units})) AS units FROM ps),
cs AS (SELECT doc_id, {chunks} AS chunks FROM us),
es AS (SELECT doc_id, CAST(len(chunks) AS INTEGER) AS chunk_count, unnest(chunks) AS content, CAST(unnest(range(1, len(chunks) + 1)) AS INTEGER) AS chunk_index FROM cs)
SELECT doc_id, 'ch01' AS chapter_id, 's00' AS section_id, 1 AS chunk_index, 1 AS chunk_count, 'lead of ' || source AS content, 'ch01_s00_chunk_01' AS source_id FROM documents
UNION ALL SELECT doc_id, 'ch01', 's01', chunk_index, chunk_count, content, format('ch01_s01_chunk_{{:02d}}', chunk_index) FROM es"""


def _sentences(pattern: str) -> str:
    return _kept(f"regexp_extract_all(p, '{pattern}')")


def _packed(overlap: int) -> str:
    """Units packed to the target, each chunk led in by the end of the last paragraph before it."""
    open_ = "string_split(acc, chr(1))[-1]"
    lead = f"string_split({_stripped(open_)}, {_NN})[-1][-{overlap}:]"
    led = f"CASE WHEN {lead} <> '' AND length({_stripped(f'{lead} || {_NN} || u')}) <= {V.MAX_CHARS} THEN {lead} || {_NN} || u ELSE u END" if overlap else "u"
    return _kept(_folded("units", f"CASE WHEN acc = '' THEN chr(1) || u WHEN length({open_}) + 2 + length(u) <= {V.TARGET_CHARS} THEN acc || {_NN} || u ELSE acc || chr(1) || {led} END"))


_SHORT = "CASE WHEN length(p) <= 900 THEN [p] ELSE " + _sentences(V.SENTENCE) + " END"
_WITH_TAIL = _folded(f"({_filled('units', 900, _NN)})", f"CASE WHEN acc = '' THEN chr(1) || u ELSE acc || chr(1) || string_split(acc, chr(1))[-1][-{V.OVERLAP_CHARS}:] || {_NN} || u END")


def _long(pattern: str) -> str:
    return f"CASE WHEN length(p) <= {V.MAX_CHARS} THEN [p] ELSE " + _filled(_sentences(pattern), V.MAX_CHARS, "''") + " END"


#: The semantic strategies compare embeddings, which SQL has none of.
SECTIONED_SQL = {
    "section_recursive": _sectioned_sql(_SHORT, _filled("units", 900, _NN)),
    "section_recursive_overlap": _sectioned_sql(_SHORT, _WITH_TAIL),
    "section_based": _sectioned_sql(_long(V.SENTENCE), _packed(V.OVERLAP_CHARS)),
    "section_based_no_overlap": _sectioned_sql(_long(V.SENTENCE_COMMA), _packed(0)),
}


def _strategy(name):
    return lambda spark, sf_dir: C.experiment_corpus(_markdown(spark, sf_dir).withColumn("text", F.concat(F.lit("# before\nx\n"), "text")), name).select("doc_id", "chapter_id", "section_id", "chunk_index", "chunk_count", "content", "source_id")


def diagnostics(spark, sf_dir):
    return E.chunk_diagnostics(C.fixed_size(_docs(spark, sf_dir)))


DIAGNOSTICS_SQL = """
WITH n AS (SELECT doc_id, text, CAST(ceil(length(text) / 900) AS INTEGER) AS k FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, i, substr(text, (i - 1) * 900 + 1, 900) AS content FROM (SELECT doc_id, text, unnest(range(1, k + 1)) AS i FROM n)),
l AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c),
o AS (SELECT length(content) AS n, coalesce(list_max(list_filter(range(0, least(length(before), length(content)) + 1), lambda k: k = 0 OR before[-k:] = content[:k])), 0) AS overlap FROM l)
SELECT count(*) AS chunk_count, round(avg(n), 6) AS mean_length, round(median(n), 6) AS median_length, CAST(quantile_disc(n, 0.95) AS BIGINT) AS p95_length, CAST(min(n) AS BIGINT) AS min_length,
       CAST(max(n) AS BIGINT) AS max_length, CAST(sum(n) AS BIGINT) AS total_chars, CAST(sum(overlap) AS BIGINT) AS overlap_chars, round(sum(overlap) / sum(n), 6) AS overlap_ratio FROM o
"""

def overlap_diagnostics(spark, sf_dir):
    chunks = C.section_recursive(_markdown(spark, sf_dir).withColumn("text", F.concat(F.lit("# before\nx\n"), "text")), overlap=V.OVERLAP_CHARS)
    return E.chunk_diagnostics(chunks.filter("chapter_id <> 'ch00'"), order=("doc_id", "section_id", "chunk_index"))


OVERLAP_SQL = f"""WITH x AS ({SECTIONED_SQL["section_recursive_overlap"]}),
l AS (SELECT content, coalesce(lag(content) OVER (PARTITION BY doc_id ORDER BY section_id, chunk_index), '') AS before FROM x),
""" + DIAGNOSTICS_SQL[DIAGNOSTICS_SQL.index("o AS (SELECT"):]

# --- rules ------------------------------------------------------------------------------------------------------

_FIXTURE = [
    "Our company growth is slowing down. Please answer in English.",
    "A management diagnosis is needed.",
    "help",
    "客户减少，员工离职，KPI 考核混乱，怎么办",
    "帮我看看，状态不好",
    "战略不清楚，部门各做各的，流程审批太慢，员工主动性下降。请用中文回答",
]
_FIXTURE_SQL = " UNION ALL ".join(f"SELECT {-1 - i} AS id, '{t}' AS t" for i, t in enumerate(_FIXTURE))
_TURNS_SQL = f"turns AS (SELECT conv_id * 1000 + turn AS id, text AS t FROM conversations UNION ALL {_FIXTURE_SQL})"


def _turns(spark, sf_dir):
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(_FIXTURE)], "id long, t string")
    return _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("t")).unionByName(rows)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(text: str, words) -> str:
    return f"(len(list_filter({_list(words)}, lambda w: contains({text}, w))) > 0)"


def detect_language(spark, sf_dir):
    return _turns(spark, sf_dir).select("id", R.detect_language(F.col("t")).alias("language"))


LANGUAGE_SQL = f"""WITH {_TURNS_SQL}
SELECT id, CASE WHEN {_any("lower(t)", V.ENGLISH_MARKERS)} THEN 'en' WHEN {_any("lower(t)", V.CHINESE_MARKERS)} THEN 'zh'
  WHEN len(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]')) >= len(regexp_extract_all(t, '[a-zA-Z]{{2,}}')) THEN 'zh' ELSE 'en' END AS language FROM turns"""


def clarity(spark, sf_dir):
    check = R.check_clarity(F.col("t"))
    return _turns(spark, sf_dir).select("id", check["is_clear"].alias("is_clear"), F.array_join(check["issues"], "|").alias("issues"), F.array_join(check["signal_terms"], "|").alias("signals"), F.array_join(check["concrete_terms"], "|").alias("concrete"))


_HITS = "list_filter({}, lambda w: contains(lower(t), lower(w)))"
CLARITY_SQL = f"""WITH {_TURNS_SQL}, hits AS (SELECT id, trim(t) AS t, {_HITS.format(_list(V.SIGNAL_TERMS))} AS s, {_HITS.format(_list(V.CONCRETE_TERMS))} AS c, {_HITS.format(_list(V.VAGUE_TERMS))} AS v FROM turns),
i AS (SELECT id, s, c, list_filter([CASE WHEN length(t) < 20 THEN '{V.CLARITY_ISSUES["short"]}' END, CASE WHEN len(s) < 2 THEN '{V.CLARITY_ISSUES["signals"]}' END,
  CASE WHEN len(c) = 0 THEN '{V.CLARITY_ISSUES["concrete"]}' END, CASE WHEN len(v) > 0 AND len(c) = 0 THEN '{V.CLARITY_ISSUES["vague"]}' END], lambda x: x IS NOT NULL) AS issues FROM hits)
SELECT id, len(issues) = 0 AS is_clear, array_to_string(issues, '|') AS issues, array_to_string(s, '|') AS signals, array_to_string(c, '|') AS concrete FROM i"""


def routes(spark, sf_dir):
    types = R.route_problem(F.col("t"))
    return _turns(spark, sf_dir).select("id", F.array_join(types, "|").alias("types"), F.array_join(R.hints(types), "|").alias("hints"))


_ROUTES = "list_filter([" + ", ".join(f"CASE WHEN {_any('lower(t)', [w.lower() for w in words])} THEN '{k}' END" for k, words in V.PROBLEM_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"
_HINT_MAP = "MAP {" + ", ".join(f"'{k}': '{h}'" for k, h in V.PROBLEM_HINTS.items()) + "}"
ROUTE_SQL = f"""WITH {_TURNS_SQL}, r AS (SELECT id, {_ROUTES} AS types FROM turns), g AS (SELECT id, CASE WHEN len(types) = 0 THEN ['{V.GENERAL_PROBLEM}'] ELSE types END AS types FROM r)
SELECT id, array_to_string(types, '|') AS types, array_to_string(list_transform(types, lambda x: ({_HINT_MAP})[x]), '|') AS hints FROM g"""


def intake(spark, sf_dir):
    """Each turn as an intake: its role as a type, a description, and another type for turns that are multiples of three."""
    c = _t(spark, sf_dir, "conversations")
    types = F.array(F.when(F.col("turn") % 3 == 0, "other").otherwise("metrics_misalignment"), F.concat(F.lit(" "), "role", F.lit(" ")), F.lit(" "))
    n = R.normalize_intake(types, F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text")), F.when(F.col("turn") % 2 == 0, F.col("role")))
    return c.select("conv_id", "turn", n["valid"].alias("valid"), F.array_join(n["errors"], "|").alias("errors"), n["retrieval_query"].alias("retrieval_query"))


INTAKE_SQL = """WITH i AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'other' ELSE 'metrics_misalignment' END AS kind, CASE WHEN turn % 5 = 4 THEN '' ELSE trim(text) END AS d, CASE WHEN turn % 2 = 0 THEN role END AS o FROM conversations),
e AS (SELECT *, list_filter([CASE WHEN d = '' THEN 'description is required' END, CASE WHEN kind = 'other' AND o IS NULL THEN 'other_problem_type is required when problem_types contains 其他' END], lambda x: x IS NOT NULL) AS errors FROM i)
SELECT conv_id, turn, len(errors) = 0 AS valid, array_to_string(errors, '|') AS errors,
  'problem_types: ' || CASE kind WHEN 'other' THEN '其他' ELSE '指标错配' END || ', ' || role || chr(10) || 'description: ' || d || chr(10) || 'other_problem_type: ' || coalesce(o, '') AS retrieval_query FROM e"""


def tag_merge(spark, sf_dir):
    """Label rows as metadata records: labels and tags by quality and toxicity, merged while pending."""
    labels = F.when(F.col("quality") == 1, F.array(F.lit("指标体系错位"), F.lit(" 战略执行脱节 "), F.lit("unknown"))).otherwise(F.array(F.lit("客户价值错位"), F.lit("")))
    tags = F.when(F.col("toxic") == 1, F.array(F.lit("not_allowed"), F.lit("metrics_misalignment"))).otherwise(F.array(F.lit("opportunity_neglect")))
    rows = _t(spark, sf_dir, "labels").select("doc_id", labels.alias("labels"), tags.alias("tags"), F.when(F.col("doc_id") % 2 == 0, "pending").otherwise("done").alias("status"))
    m = R.merge_tags(F.col("labels"), F.col("tags"))
    join = lambda c: F.array_join(c, "|")
    return rows.select("doc_id", join(m["tags"]).alias("merged"), join(m["unmapped"]).alias("unmapped"), join(R.merge_tags_if(F.col("labels"), F.col("tags"), F.col("status"), True)).alias("pending_only"))


TAG_SQL = """WITH r AS (SELECT doc_id, quality, toxic, CASE WHEN toxic = 1 THEN ['metrics_misalignment'] ELSE ['opportunity_neglect'] END AS kept, CASE WHEN toxic = 1 THEN 'not_allowed|metrics_misalignment' ELSE 'opportunity_neglect' END AS raw FROM labels),
m AS (SELECT doc_id, quality, raw, CASE WHEN quality = 1 THEN kept || list_filter(['metrics_misalignment', 'strategy_execution_gap'], lambda t: NOT list_contains(kept, t)) ELSE kept || ['customer_value_misalignment'] END AS merged FROM r)
SELECT doc_id, array_to_string(merged, '|') AS merged, CASE WHEN quality = 1 THEN 'unknown' ELSE '' END AS unmapped, CASE WHEN doc_id % 2 = 0 THEN array_to_string(merged, '|') ELSE raw END AS pending_only FROM m"""


def report_quality(spark, sf_dir):
    """Documents as reports: a citation, a recommendation and a closing stop are added by id."""
    add = F.concat(
        F.when(F.col("doc_id") % 2 == 0, " Knowledge item 1. ").otherwise(" 知识项[ 9 ] "), F.when(F.col("doc_id") % 3 == 0, "We recommend action; assumption: none").otherwise(F.concat(F.lit("see "), "source")),
        F.when(F.col("doc_id") % 5 == 0, " (open").otherwise(""), F.when(F.col("doc_id") % 7 == 0, "").otherwise("."),
    )
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.concat("text", add).alias("r"), F.array(F.col("source"), F.lit("zz/none.md")).alias("s"))
    issues = R.report_issues(F.col("r"), F.col("s"))
    return rows.select("doc_id", (F.size(issues) == 0).alias("passed"), F.array_join(issues, "|").alias("issues"), F.array_join(R.citations(F.col("r")).cast("array<string>"), ",").alias("citations"))


_M = V.REPORT_ISSUES
_COUNT = "(length(r) - length(replace(r, '{}', '')))"
QUALITY_SQL = f"""WITH d AS (SELECT doc_id, source, text || CASE WHEN doc_id % 2 = 0 THEN ' Knowledge item 1. ' ELSE ' 知识项[ 9 ] ' END || CASE WHEN doc_id % 3 = 0 THEN 'We recommend action; assumption: none' ELSE 'see ' || source END
  || CASE WHEN doc_id % 5 = 0 THEN ' (open' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '.' END AS r FROM documents),
x AS (SELECT *, trim(r) AS t, lower(trim(r)) AS low, list_transform(regexp_extract_all(r, '(?i)(?:知识项\\s*|knowledge\\s+item\\s*)\\[?\\s*(\\d+)\\s*\\]?', 1), lambda n: CAST(n AS INTEGER)) AS c FROM d),
i AS (SELECT doc_id, c, list_filter([CASE WHEN t = '' THEN '{_M["empty"]}' END, CASE WHEN length(t) < 300 THEN '{_M["short"]}' END, CASE WHEN len(list_filter(c, lambda n: n BETWEEN 1 AND 2)) = 0 THEN '{_M["citation"]}' END,
  CASE WHEN contains(r, source) OR contains(r, 'zz/none.md') THEN '{_M["source"]}' END, CASE WHEN NOT ({_any("r", V.RECOMMENDATION_WORDS[0])} OR {_any("low", V.RECOMMENDATION_WORDS[1])}) THEN '{_M["recommendation"]}' END,
  CASE WHEN NOT ({_any("r", V.ASSUMPTION_WORDS[0])} OR {_any("low", V.ASSUMPTION_WORDS[1])}) THEN '{_M["assumption"]}' END, CASE WHEN len(list_filter({_list(V.GENERIC_PHRASES)}, lambda p: contains(r, p))) >= 2 THEN '{_M["generic"]}' END,
  CASE WHEN {_any("low", V.LENGTH_NOTES)} THEN '{_M["length_notes"]}' END, CASE WHEN t <> '' AND NOT list_contains({_list(V.SENTENCE_ENDS)}, t[-1:]) THEN '{_M["ending"]}' END,
  CASE WHEN {" OR ".join(f"{_COUNT.format(a)} <> {_COUNT.format(b)}" for a, b in V.BRACKETS)} THEN '{_M["brackets"]}' END], lambda m: m IS NOT NULL) AS issues FROM x)
SELECT doc_id, len(issues) = 0 AS passed, array_to_string(issues, '|') AS issues, array_to_string(c, ',') AS citations FROM i"""


# --- reports and runs ----------------------------------------------------------------------------------------------


def _sections(spark, sf_dir):
    """Conversations as runs: each four turns are the sections of a report."""
    c = _t(spark, sf_dir, "conversations")
    name = F.element_at(F.array(*map(F.lit, V.SECTIONS)), (F.col("turn") % 4 + 1).cast("int"))
    return c.select(
        (F.col("conv_id") * 1000 + F.floor(F.col("turn") / 4)).alias("run_id"), name.alias("section"), F.when(F.length("text") % 7 == 0, F.lit(" ")).otherwise(F.col("text")).alias("content"),
        F.when(F.length("text") % 11 == 0, F.lit(None)).otherwise(F.array((F.length("text") % 7).cast("int"), F.lit(1))).cast("array<int>").alias("source_items"),
        F.when(F.length("text") % 5 == 0, "length").when(F.length("text") % 13 == 0, F.lit(None)).otherwise("stop").alias("done_reason"), (F.length("text") % 3 != 0).alias("final_parse_success"),
    )


def validation(spark, sf_dir):
    sections = _sections(spark, sf_dir)
    runs_ = sections.select("run_id").distinct().withColumn("n_retrieved", F.lit(5))
    done = reports.validate_report(runs_, sections)
    return done.select("run_id", "passed", F.array_join("issues", "|").alias("issues"), F.array_join("failed_sections", "|").alias("failed"))


VALIDATION_SQL = f"""WITH names AS (SELECT unnest({_list(V.SECTIONS)}) AS section, unnest(range(0, 4)) AS pos),
s AS (SELECT conv_id * 1000 + turn // 4 AS run_id, turn % 4 AS turn, length(text) AS n FROM conversations), r AS (SELECT DISTINCT run_id FROM s),
g AS (SELECT r.run_id, pos, section, n FROM r CROSS JOIN names LEFT JOIN s ON s.run_id = r.run_id AND s.turn = pos),
i AS (SELECT run_id, pos, section, CASE WHEN n IS NULL THEN ['Missing section: ' || section || '.'] ELSE list_filter([
  CASE WHEN n % 7 = 0 THEN 'Section content is empty: ' || section || '.' END, CASE WHEN n % 11 = 0 THEN 'source_items is invalid: ' || section || '.' END,
  CASE WHEN n % 11 <> 0 AND (n % 7 < 1 OR n % 7 > 5) THEN 'source_items contains an invalid knowledge-item number: ' || section || '.' END,
  CASE WHEN n % 5 = 0 THEN 'Section was truncated by token length: ' || section || '.' END, CASE WHEN n % 5 <> 0 AND n % 13 = 0 THEN 'Section did not finish normally (missing): ' || section || '.' END,
  CASE WHEN n % 3 = 0 THEN 'Structured output parse failure: ' || section || '.' END], lambda x: x IS NOT NULL) END AS issues FROM g)
SELECT run_id, CAST(sum(len(issues)) AS BIGINT) = 0 AS passed, array_to_string(flatten(list(issues ORDER BY pos)), '|') AS issues, coalesce(string_agg(section, '|' ORDER BY pos) FILTER (len(issues) > 0), '') AS failed FROM i GROUP BY run_id"""


def assembly(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("turn", F.col("text").alias("text"), F.array((F.col("turn") % 3).cast("int"), F.lit(1)).alias("source_items")).alias("s"))
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    made = R.assemble_section(F.col("s"))
    return whole.select("conv_id", F.md5(made["content"].cast("binary")).alias("content_md5"), F.array_join(made["source_items"].cast("array<string>"), ",").alias("source_items"))


ASSEMBLY_SQL = """WITH e AS (SELECT conv_id, turn, text, unnest([turn % 3, 1]) AS item, unnest([0, 1]) AS pos FROM conversations),
f AS (SELECT conv_id, item, min(turn * 2 + pos) AS first FROM e GROUP BY ALL)
SELECT c.conv_id, md5(string_agg(text, '' ORDER BY turn)) AS content_md5, (SELECT string_agg(CAST(item AS VARCHAR), ',' ORDER BY first) FROM f WHERE f.conv_id = c.conv_id) AS source_items FROM conversations c GROUP BY c.conv_id"""


def source_resolution(spark, sf_dir):
    """Each conversation cites its turns in reverse, then an item out of range; role and turn parity are chapter and section titles."""
    c = _t(spark, sf_dir, "conversations")
    retrieved = c.select(
        F.col("conv_id").alias("run_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.col("role").alias("chapter_title"), (F.col("turn") % 2).cast("string").alias("section_title"),
        F.format_string("%02d", F.col("turn")).alias("chapter_number"), F.lit(None).cast("string").alias("section_number"), F.when(F.col("turn") % 3 == 1, F.col("role")).otherwise(F.lit(" ")).alias("summary"),
    )
    cited = c.groupBy("conv_id").agg(F.max("turn").alias("n")).select(F.col("conv_id").alias("run_id"), F.lit("root_causes").alias("section"), F.concat(F.reverse(F.sequence(F.lit(1), (F.col("n") + 1).cast("int"))), F.array(F.lit(9999))).alias("source_items"))
    return reports.resolve_sources(cited, retrieved)


RESOLUTION_SQL = """WITH n AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id),
j AS (SELECT c.conv_id AS run_id, n - turn AS pos, role, turn % 2 AS s, turn, CASE WHEN turn % 3 = 1 THEN role END AS summary FROM conversations c JOIN n USING (conv_id)),
g AS (SELECT run_id, role, s, min(pos) AS first, arg_min(turn, pos) AS turn, arg_min(summary, pos) FILTER (summary IS NOT NULL) AS summary FROM j GROUP BY run_id, role, s)
SELECT run_id, 'root_causes' AS section, CAST(row_number() OVER (PARTITION BY run_id ORDER BY first) AS INTEGER) AS position, format('{:02d}', turn) AS chapter_number, '-' AS section_number, coalesce(summary, '') AS summary FROM g"""


def latest_wins(spark, sf_dir):
    return Q.latest(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")


LATEST_SQL = "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n = 1"


def observation(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.length("text").cast("double").alias("score"), F.when(F.col("role") == "user", F.col("turn").cast("double")).alias("bm25_score"), F.when(F.col("role") == "none", 1.0).alias("embedding_score"))
    return runs.observation(c)


OBSERVATION_SQL = """SELECT conv_id AS run_id, count(*) AS chunk_count, CAST(max(length(text)) AS DOUBLE) AS top_score, coalesce(max(CAST(turn AS DOUBLE)) FILTER (role = 'user'), 0) AS top_bm25, 0.0::DOUBLE AS top_embedding FROM conversations GROUP BY conv_id"""


def context(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.col("role").alias("chapter_title"), F.lit(None).cast("string").alias("section_title"), F.col("turn").cast("string").alias("title"), F.col("text").alias("content")).alias("s"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("conv_id", F.md5(R.retrieved_context(F.col("s")).cast("binary")).alias("context_md5"))


CONTEXT_SQL = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, md5(string_agg('知识项' || i || '（Knowledge item ' || i || '）' || chr(10) || '章节：' || role || chr(10) || '小节：' || chr(10) || '标题：' || turn || chr(10) || '正文：' || chr(10) || text, chr(10) || chr(10) ORDER BY i)) AS context_md5 FROM n GROUP BY conv_id"""


def json_recovery(spark, sf_dir):
    """Turns as raw model output in several states of disrepair."""
    c = _t(spark, sf_dir, "conversations")
    good = F.to_json(F.struct(F.array(F.struct(F.col("text"), F.array(F.lit(1), F.lit(2)).alias("source_items"))).alias("sentences")))
    one = F.to_json(F.struct(F.col("text"), F.array(F.lit(1), F.lit(2)).alias("source_items")))
    stray = F.concat(F.lit('{"sentences":['), one, F.lit(', "'), one, F.lit("]}"))
    kind = F.col("turn") % 6
    raw = F.when(kind == 0, good).when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), good, F.lit(" done"))).when(kind == 3, F.replace(good, F.lit("[1,2]"), F.lit('"3"'))).when(kind == 5, stray).otherwise(F.substring(good, 1, 20))
    done = reports.parse_sections(c.select("conv_id", "turn", F.col("text"), raw.alias("raw")))
    return done.select("conv_id", "turn", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.array_join(F.col("source_items").cast("array<string>"), ",").alias("source_items"), "initial_parse_success", "final_parse_success", F.array_join("recovery_actions", "|").alias("actions"))


JSON_SQL = """WITH k AS (SELECT conv_id, turn, turn % 6 AS kind, text FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN kind = 4 THEN '' WHEN kind = 0 THEN trim(text) WHEN kind = 5 THEN text || text ELSE text END) AS content_md5, CASE kind WHEN 4 THEN '' WHEN 3 THEN '3' ELSE '1,2' END AS source_items, kind = 0 AS initial_parse_success, kind <> 4 AS final_parse_success,
  CASE kind WHEN 1 THEN 'strip_code_fence' WHEN 2 THEN 'extract_json_object' WHEN 3 THEN 'source_items_numeric_string_to_list' WHEN 5 THEN 'remove_stray_object_boundary_quote' ELSE '' END AS actions FROM k"""

# --- corpus checks ------------------------------------------------------------------------------------------------------


def corpus_issues(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    manifest = docs.select(F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("doc_id") % 50 != 0, F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("path"), (F.col("n_chars") + (F.col("doc_id") % 97 == 1).cast("int")).cast("int").alias("char_count"))
    loaded = docs.filter("doc_id % 30 <> 7").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    metadata = _t(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 40 == 3, 10_000_000).otherwise(0)).cast("string").alias("source_id"))
    return Q.corpus_issues(manifest, loaded, metadata)


ISSUES_SQL = """WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN doc_id % 50 <> 0 THEN source || '/' || doc_id END AS path, n_chars + CASE WHEN doc_id % 97 = 1 THEN 1 ELSE 0 END AS char_count FROM documents),
l AS (SELECT source || '/' || doc_id AS path, text FROM documents WHERE doc_id % 30 <> 7), s AS (SELECT CAST(doc_id + CASE WHEN doc_id % 40 = 3 THEN 10000000 ELSE 0 END AS VARCHAR) AS source_id FROM labels)
SELECT 'no_path' AS issue, source_id AS key FROM m WHERE path IS NULL
UNION ALL SELECT 'not_loaded', path FROM m WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM l)
UNION ALL SELECT 'not_in_manifest', path FROM l WHERE path NOT IN (SELECT path FROM m WHERE path IS NOT NULL)
UNION ALL SELECT 'repeated_source_id', source_id FROM m GROUP BY source_id HAVING count(*) > 1
UNION ALL SELECT 'repeated_metadata', source_id FROM s GROUP BY source_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'orphan_metadata', source_id FROM s WHERE source_id NOT IN (SELECT source_id FROM m)
UNION ALL SELECT 'missing_metadata', source_id FROM m WHERE source_id NOT IN (SELECT source_id FROM s)
UNION ALL SELECT 'char_count_differs', path FROM m JOIN l USING (path) WHERE length(text) IS DISTINCT FROM char_count"""


def parity(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("long"))
    golden = docs.filter("doc_id % 9 <> 2").withColumns({"doc_id": F.when(F.col("doc_id") % 31 == 5, -F.col("doc_id")).otherwise(F.col("doc_id")), "lang": F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("lang")), "n_chars": F.col("n_chars") + (F.col("doc_id") % 13 == 0).cast("long")})
    return Q.parity(docs, golden, "doc_id", ["lang", "source", "n_chars"]).withColumn("differing", F.array_join("differing", "|"))


PARITY_SQL = """WITH g AS (SELECT CASE WHEN doc_id % 31 = 5 THEN -doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang, source, n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS n_chars, true AS there FROM documents WHERE doc_id % 9 <> 2),
d AS (SELECT doc_id, lang, source, n_chars, true AS there FROM documents),
j AS (SELECT coalesce(d.doc_id, g.doc_id) AS doc_id, d.there AS a, g.there AS b, list_filter([CASE WHEN d.lang IS DISTINCT FROM g.lang THEN 'lang' END, CASE WHEN d.source IS DISTINCT FROM g.source THEN 'source' END, CASE WHEN d.n_chars IS DISTINCT FROM g.n_chars THEN 'n_chars' END], lambda x: x IS NOT NULL) AS f FROM d FULL JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, CASE WHEN a IS NULL THEN 'missing' WHEN b IS NULL THEN 'extra' WHEN len(f) > 0 THEN 'differs' ELSE 'same' END AS status, CASE WHEN a AND b THEN array_to_string(f, '|') ELSE '' END AS differing FROM j"""


def duplicate_texts(spark, sf_dir):
    return Q.duplicates(_t(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5")), "text_md5")


DUPLICATE_SQL = "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"


def evidence_ranges(spark, sf_dir):
    """Documents as sections of lines; each with lines has a case that expects its second half and its first line."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit("ch01").alias("chapter_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("section_id"), F.split("text", "\n").alias("paragraphs"))
    n = F.size("paragraphs")
    entry = lambda a, b: F.struct("chapter_id", "section_id", a.cast("int").alias("start"), b.cast("int").alias("end"))
    cases = docs.select("case_id", F.array(entry(F.floor(n / 2), n), entry(F.lit(0), F.lit(1))).alias("expected"))
    return Q.evidence_of(cases, docs.drop("case_id")).withColumn("evidence", F.col("evidence").cast("int"))


RANGES_SQL = """WITH d AS (SELECT doc_id AS case_id, string_split(text, chr(10)) AS p FROM documents)
SELECT case_id, 0 AS evidence, array_to_string(p[len(p) // 2 + 1:], chr(10) || chr(10)) AS text FROM d UNION ALL SELECT case_id, 1, p[1] FROM d"""


def evidence_match(spark, sf_dir):
    """Lines of each document held against the whole of it and of the document before, normalised."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", T.evidence_lines(F.lower("text")).alias("own"))
    # A text is normalised once, before the join: without the line ends, which go, it is its lines.
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.array_join("own", "").alias("other")), "doc_id")
    whole = (F.col("other") != "") & F.contains("other", F.array_join("own", ""))
    return pairs.select("doc_id", whole.alias("whole"), F.size(F.filter("own", lambda u: (u != "") & F.contains(F.col("other"), u))).cast("long").alias("lines"))


_N = "regexp_replace(lower({}), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"
MATCH_SQL = f"""WITH p AS (SELECT a.doc_id, a.text, {_N.format("b.text")} AS content FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, content <> '' AND contains(content, {_N.format("text")}) AS whole, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda u: {_N.format("u")}), lambda u: u <> '' AND contains(content, u))) AS BIGINT) AS lines FROM p"""


# --- sources and cases ---------------------------------------------------------------------------------------------------


def raw_sections(spark, sf_dir):
    """Documents as raw ones: text before a numbered chapter, lines as paragraphs of its first section, a second one and, in every tenth, an unnumbered heading."""
    d = _t(spark, sf_dir, "documents")
    digit = F.substring(F.lit("一二三四五六七八九"), (F.col("doc_id") % 9 + 1).cast("int"), F.lit(1))
    tail = F.when(F.col("doc_id") % 10 == 0, F.lit("\n# other\n## c\nmore")).otherwise("")
    text = F.concat(F.lit("front\n# 第"), digit, F.lit("章 t\nlead\n## a\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n## b\nend of "), "source", tail)
    found = cases.raw_sections(d.select("doc_id", text.alias("text")))
    return found.select("doc_id", "chapter_id", "section_id", F.size("paragraphs").cast("long").alias("n"), F.md5(F.array_join("paragraphs", "|").cast("binary")).alias("paragraphs_md5"))


RAW_SECTIONS_SQL = f"""WITH s AS (SELECT doc_id, format('ch{{:02d}}', doc_id % 9 + 1) AS chapter_id, unnest([1, 2, 3]) AS s, unnest([{_PARAS}, [CASE WHEN doc_id % 10 = 0 THEN 'end of ' || source || chr(10) || '# other' ELSE 'end of ' || source END], CASE WHEN doc_id % 10 = 0 THEN ['more'] END]) AS p FROM documents)
SELECT doc_id, chapter_id, format('s{{:02d}}', s) AS section_id, len(p) AS n, md5(array_to_string(p, '|')) AS paragraphs_md5 FROM s WHERE p IS NOT NULL"""


def metadata_join(spark, sf_dir):
    """Documents as chunks of a manifest whose ids repeat; label rows are metadata records of some ids, the last one of each counts."""
    d, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    chunks = d.select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("source"))
    manifest = chunks.select(F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("id"), (F.col("doc_id") % 600).cast("string"))).alias("source_id"), F.col("source").alias("path"), "doc_id")
    semantic = labels.select(F.concat(F.lit("id"), (F.col("doc_id") % 900).cast("string")).alias("source_id"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("q"), F.col("quality").cast("string"))).otherwise("").alias("summary"), F.concat(F.lit("t"), F.col("toxic").cast("string")).alias("tags"), "doc_id")
    text = T.metadata_search_text({"summary": F.col("summary"), "inferred.diagnosis_tags": F.when(F.col("doc_id") % 2 == 0, F.col("tags")).otherwise("")})
    found = markdown.metadata_by_path(semantic, markdown.paths_of(manifest, "doc_id"), text, "doc_id")
    return markdown.with_metadata(chunks, found).select("doc_id", "source", "metadata_text")


_TIMES = V.METADATA_WEIGHTS["inferred.diagnosis_tags"]
METADATA_SQL = f"""WITH m AS (SELECT 'id' || (doc_id % 600) AS source_id, arg_max('p' || doc_id, doc_id) AS path FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1),
r AS (SELECT doc_id, 'id' || (doc_id % 900) AS source_id, array_to_string((CASE WHEN doc_id % 3 > 0 THEN ['q' || quality] ELSE [] END) || (CASE WHEN doc_id % 2 = 0 THEN list_transform(range({_TIMES}), lambda i: 't' || toxic) ELSE [] END), chr(10)) AS t FROM labels),
f AS (SELECT path, arg_max(t, r.doc_id) AS t FROM r JOIN m USING (source_id) WHERE t <> '' GROUP BY path)
SELECT doc_id, 'p' || doc_id AS source, coalesce(t, '') AS metadata_text FROM documents LEFT JOIN f ON path = 'p' || doc_id"""


def restored(spark, sf_dir):
    """Conversations' turns as ranked sources, with what the documents hold of them and the split of each case."""
    c, d = _t(spark, sf_dir, "conversations"), _t(spark, sf_dir, "documents")
    n = d.agg(F.max("doc_id").alias("n"))
    ranked = c.crossJoin(F.broadcast(n)).select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("rank"), ((F.col("conv_id") * 31 + F.col("turn") * 7) % (F.col("n") + 1)).cast("string").alias("source"))  # n is one row
    corpus = d.select(F.col("doc_id").cast("string").alias("source"), F.lit(1).alias("chunk_index"), F.col("lang").alias("chapter_title"), F.col("source").alias("section_title"), F.concat_ws("-", "source", "lang").alias("title"), F.concat(F.lit("."), "text").alias("content"))
    splits = c.select(F.col("conv_id").alias("case_id"), F.when(F.col("conv_id") % 3 == 0, "dev").otherwise("test").alias("split")).distinct()
    rows = cases.with_split(cases.restore(ranked, corpus), splits)
    return rows.select("case_id", "rank", "source", "chunk_index", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), "split")


RESTORED_SQL = """WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents), r AS (SELECT conv_id, turn, (conv_id * 31 + turn * 7) % n AS doc_id FROM conversations, n)
SELECT conv_id AS case_id, turn + 1 AS rank, CAST(doc_id AS VARCHAR) AS source, 1 AS chunk_index, source || '-' || lang AS title, md5('.' || text) AS content_md5, CASE WHEN conv_id % 3 = 0 THEN 'dev' ELSE 'test' END AS split FROM r JOIN documents USING (doc_id)"""


def id_differences(spark, sf_dir):
    shifted = _t(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 40 == 3, 10_000_000).otherwise(0)).alias("doc_id"))
    return cases.id_differences(_t(spark, sf_dir, "documents"), shifted, "doc_id")


IDS_SQL = """WITH s AS (SELECT doc_id + CASE WHEN doc_id % 40 = 3 THEN 10000000 ELSE 0 END AS doc_id FROM labels)
SELECT doc_id, 'left' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL SELECT DISTINCT doc_id, 'right' FROM s WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""


def markdown_rows(spark, sf_dir):
    """Turns as rows of a Markdown table, with previews and what a display with citations shows."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("|", "role", F.col("turn").cast("string")).alias("name"), (F.length("text") / 7.0).alias("score"), "text")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", judging.cell(F.col("name")), judging.cell(F.when(F.col("turn") % 2 == 0, F.floor("score")))), F.lit(" |"))
    none = F.lit(None).cast("array<struct<text:string,source_items:array<int>>>")
    view = judging.sentence_view(none, F.concat(F.lit("<b>&"), "name"), F.array(F.lit(1)))
    return c.select("conv_id", "turn", line.alias("line"), F.md5(judging.preview(F.col("text"), 60).cast("binary")).alias("preview_md5"), view[0]["text"].alias("shown"))


ROWS_SQL = """SELECT conv_id, turn, '| ' || role || '\\|' || turn || ' | ' || CASE WHEN turn % 2 = 0 THEN CAST(floor(length(text) / 7.0) AS BIGINT) || '.000' ELSE '-' END || ' |' AS line,
  md5(CASE WHEN length(text) > 60 THEN substr(replace(text, chr(10), ' '), 1, 60) || '... [truncated]' ELSE replace(text, chr(10), ' ') END) AS preview_md5, '&lt;b&gt;&amp;' || role || '|' || turn AS shown FROM conversations"""


QUERIES = {
    "raw_sections": (raw_sections, RAW_SECTIONS_SQL),
    "metadata_join": (metadata_join, METADATA_SQL),
    "restored_results": (restored, RESTORED_SQL),
    "id_differences": (id_differences, IDS_SQL),
    "markdown_rows": (markdown_rows, ROWS_SQL),
    "chunk_fixed": (chunk_fixed, FIXED_SQL),
    "chunk_recursive": (chunk_recursive, RECURSIVE_SQL),
    "section_parse": (section_parse, SECTION_PARSE_SQL),
    "chunk_section_raw": (section_raw, SECTION_RAW_SQL),
    **{f"chunk_{name}": (_strategy(name), SECTIONED_SQL.get(name)) for name in C.STRATEGIES if name.startswith("section_") and name != "section_raw"},
    "chunk_diagnostics": (diagnostics, DIAGNOSTICS_SQL),
    "chunk_diagnostics_overlap": (overlap_diagnostics, OVERLAP_SQL),
    "detect_language": (detect_language, LANGUAGE_SQL),
    "clarity_check": (clarity, CLARITY_SQL),
    "route_problem": (routes, ROUTE_SQL),
    "intake": (intake, INTAKE_SQL),
    "tag_merge": (tag_merge, TAG_SQL),
    "report_quality": (report_quality, QUALITY_SQL),
    "section_validation": (validation, VALIDATION_SQL),
    "section_assembly": (assembly, ASSEMBLY_SQL),
    "source_resolution": (source_resolution, RESOLUTION_SQL),
    "latest_wins": (latest_wins, LATEST_SQL),
    "observation": (observation, OBSERVATION_SQL),
    "retrieved_context": (context, CONTEXT_SQL),
    "json_recovery": (json_recovery, JSON_SQL),
    "corpus_issues": (corpus_issues, ISSUES_SQL),
    "parity": (parity, PARITY_SQL),
    "duplicate_texts": (duplicate_texts, DUPLICATE_SQL),
    "evidence_ranges": (evidence_ranges, RANGES_SQL),
    "evidence_match": (evidence_match, MATCH_SQL),
}
