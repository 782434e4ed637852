"""Rule-based query understanding and report checks as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import fixed_values as V
from tarn.functions.text import contained, let, literals, strip


def _any(text: Column, words: list[str]) -> Column:
    return let(text, lambda t: F.exists(literals(words), lambda w: F.contains(t, w)))


def _issues(*found: tuple[Column, Column | str]) -> Column:
    """The messages whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in found]))


def detect_language(description: Column) -> Column:
    """``en`` or ``zh``: by an explicit wish (English first), else by counting words and CJK characters."""
    text = F.lower(description)
    more = F.regexp_count(description, F.lit(f"[{V.CJK}]")) >= F.regexp_count(description, F.lit("[a-zA-Z]{2,}"))
    return F.when(_any(text, V.ENGLISH_MARKERS), "en").when(_any(text, V.CHINESE_MARKERS) | more, "zh").otherwise("en")


def check_clarity(description: Column) -> Column:
    """struct(is_clear, issues, signal_terms, concrete_terms, questions)."""
    text = strip(description)
    lower = F.lower(text)
    having = lambda words: let(lower, lambda t: F.filter(literals(words), lambda w: F.contains(t, F.lower(w))))
    signals, concrete, vague = having(V.SIGNAL_TERMS), having(V.CONCRETE_TERMS), having(V.VAGUE_TERMS)
    none = F.size(concrete) == 0
    m = V.CLARITY_ISSUES
    issues = _issues((F.length(text) < V.MIN_DESCRIPTION, m["short"]), (F.size(signals) < V.MIN_SIGNALS, m["signals"]), (none, m["concrete"]), ((F.size(vague) > 0) & none, m["vague"]))
    clear = F.size(issues) == 0
    questions = F.when(clear, F.array().cast("array<string>")).otherwise(literals(V.CLARITY_QUESTIONS))
    return F.struct(clear.alias("is_clear"), issues.alias("issues"), signals.alias("signal_terms"), concrete.alias("concrete_terms"), questions.alias("questions"))


def route_problem(context: Column, goal: Column | None = None) -> Column:
    """Problem types with a keyword in the text, in rule order; the general one without any."""
    text = F.lower(F.concat(context, F.lit("\n"), F.coalesce(goal if goal is not None else F.lit(""), F.lit(""))))
    found = lambda t: F.array_compact(F.array(*[F.when(F.exists(literals([w.lower() for w in words]), lambda w: F.contains(t, w)), F.lit(k)) for k, words in V.PROBLEM_KEYWORDS.items()]))
    types = let(text, found)
    return F.when(F.size(types) > 0, types).otherwise(F.array(F.lit(V.GENERAL_PROBLEM)))


def _looked_up(keys: Column, table: dict[str, str], default) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(keys, lambda k: F.coalesce(F.try_element_at(entries, k), default(k)))


def hints(types: Column) -> Column:
    """Guidance for each type; the general one for unknown types and for none."""
    general = F.lit(V.PROBLEM_HINTS[V.GENERAL_PROBLEM])
    return F.when(F.size(types) > 0, _looked_up(types, V.PROBLEM_HINTS, lambda k: general)).otherwise(F.array(general))


def retrieval_query(raw: Column, goal: Column | None = None, mode: str = "rule_based", rewrite=None) -> Column:
    """The query to search with: as it is, with types and hints, or as a model (a column function) rewrites it."""
    raw = strip(raw)
    if mode == "raw":
        return raw
    if mode == "rewrite":
        return rewrite(raw, goal)
    if mode != "rule_based":
        raise ValueError(f"no such mode: {mode}")
    types = route_problem(raw, goal)
    return F.concat_ws("\n", raw, F.coalesce(goal if goal is not None else F.lit(""), F.lit("")), F.array_join(types, " "), F.array_join(hints(types), " "))


def normalize_intake(types: Column, description: Column, other: Column) -> Column:
    """struct(problem_types, description, other_problem_type, valid, errors, retrieval_query)."""
    kept = F.filter(F.transform(F.coalesce(types, F.array().cast("array<string>")), strip), lambda t: t != "")
    text, more = strip(F.coalesce(description, F.lit(""))), F.nullif(strip(F.coalesce(other, F.lit(""))), F.lit(""))
    errors = _issues(
        (F.size(kept) == 0, "problem_types is required"),
        (text == "", "description is required"),
        (F.array_contains(kept, "other") & more.isNull(), "other_problem_type is required when problem_types contains 其他"),
    )
    labels = F.array_join(_looked_up(kept, V.PROBLEM_LABELS, lambda k: k), ", ")
    query = F.concat(F.lit("problem_types: "), labels, F.lit("\ndescription: "), text, F.lit("\nother_problem_type: "), F.coalesce(more, F.lit("")))
    return F.struct(kept.alias("problem_types"), text.alias("description"), more.alias("other_problem_type"), (F.size(errors) == 0).alias("valid"), errors.alias("errors"), query.alias("retrieval_query"))


def merge_tags(labels: Column, tags: Column) -> Column:
    """struct(tags, mapped, unmapped): allowed tags, then those of the labels; labels without a tag are listed."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), strip), lambda x: x != ""))
    labels, known, allowed = clean(labels), literals(list(V.LABEL_TAGS)), literals(list(V.LABEL_TAGS.values()))
    mapped = F.filter(labels, lambda x: F.array_contains(known, x))
    kept = F.filter(clean(tags), lambda x: F.array_contains(allowed, x))
    return F.struct(
        F.array_distinct(F.concat(kept, _looked_up(mapped, V.LABEL_TAGS, lambda k: k))).alias("tags"),
        mapped.alias("mapped"),
        F.array_except(labels, mapped).alias("unmapped"),
    )


def merge_tags_if(labels: Column, tags: Column, status: Column, pending_only: bool = False) -> Column:
    """Merged tags; with ``pending_only`` those of other records stay as they are."""
    merged = merge_tags(labels, tags)["tags"]
    return F.when(status.eqNullSafe("pending"), merged).otherwise(tags) if pending_only else merged


def citations(report: Column) -> Column:
    """The numbers of the knowledge items that a report cites."""
    return F.transform(F.regexp_extract_all(report, F.lit(V.CITATION), F.lit(1)), lambda n: n.cast("int"))


def report_issues(report: Column, sources: Column) -> Column:
    """Messages of the text checks; ``sources``: the source names retrieved (none skips the citation checks)."""
    names = F.coalesce(sources, F.array().cast("array<string>"))
    return let(F.struct(strip(F.coalesce(report, F.lit(""))).alias("text"), F.coalesce(report, F.lit("")).alias("raw"), names.alias("names")), lambda x: let(F.lower(x["text"]), lambda lower: _text_issues(x["text"], x["raw"], lower, x["names"])))


def _text_issues(text: Column, raw: Column, lower: Column, sources: Column) -> Column:
    n = F.size(sources)
    cited = F.exists(citations(raw), lambda i: (i >= 1) & (i <= n))
    either = lambda words: _any(raw, words[0]) | _any(lower, words[1])
    count = lambda c: F.length(raw) - F.length(F.replace(raw, F.lit(c), F.lit("")))
    uneven = F.lit(False)
    for left, right in V.BRACKETS:
        uneven = uneven | (count(left) != count(right))
    m = V.REPORT_ISSUES
    return _issues(
        (text == "", m["empty"]),
        (F.length(text) < 300, m["short"]),
        ((n > 0) & ~cited, m["citation"]),
        (F.exists(sources, lambda s: F.contains(raw, s)), m["source"]),
        (~either(V.RECOMMENDATION_WORDS), m["recommendation"]),
        (~either(V.ASSUMPTION_WORDS), m["assumption"]),
        (F.size(contained(raw, V.GENERIC_PHRASES)) >= 2, m["generic"]),
        (_any(lower, V.LENGTH_NOTES), m["length_notes"]),
        ((text != "") & ~F.exists(literals(V.SENTENCE_ENDS), lambda e: F.endswith(text, e)), m["ending"]),
        (uneven, m["brackets"]),
    )


def section_issues(section: Column, present: Column, content: Column, source_items: Column, n_retrieved: Column, done_reason: Column, parsed: Column) -> Column:
    """Messages of the structural checks of one section; a missing section has one message."""
    said = lambda head: F.concat(F.lit(head), section, F.lit("."))
    checks = _issues(
        (F.coalesce(strip(content), F.lit("")) == "", said("Section content is empty: ")),
        (source_items.isNull(), said("source_items is invalid: ")),
        (F.exists(source_items, lambda i: i.isNull() | (i < 1) | (i > n_retrieved)), said("source_items contains an invalid knowledge-item number: ")),
        (done_reason == "length", said("Section was truncated by token length: ")),
        (~F.coalesce(done_reason, F.lit("")).isin("length", "stop"), F.concat(F.lit("Section did not finish normally ("), F.coalesce(F.nullif(done_reason, F.lit("")), F.lit("missing")), F.lit("): "), section, F.lit("."))),
        (~F.coalesce(parsed, F.lit(False)), said("Structured output parse failure: ")),
    )
    return F.when(present, checks).otherwise(F.array(said("Missing section: ")))


def assemble_section(sentences: Column) -> Column:
    """struct(content, source_items) of array<struct<text, source_items>>: texts joined, distinct items in order."""
    return F.struct(F.array_join(F.transform(sentences, lambda s: s["text"]), "").alias("content"), F.array_distinct(F.flatten(F.transform(sentences, lambda s: s["source_items"]))).alias("source_items"))


def retrieved_context(items: Column) -> Column:
    """Numbered knowledge items of array<struct<chapter_title, section_title, title, content>>, without their sources."""
    empty = lambda c: F.coalesce(c, F.lit(""))

    def item(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return F.concat(F.lit("知识项"), n, F.lit("（Knowledge item "), n, F.lit("）\n章节："), empty(x["chapter_title"]), F.lit("\n小节："), empty(x["section_title"]), F.lit("\n标题："), empty(x["title"]), F.lit("\n正文：\n"), empty(x["content"]))

    return F.when(F.size(items) > 0, F.array_join(F.transform(items, item), "\n\n")).otherwise(V.NOTHING_RETRIEVED)


def display_number(chapter_id: Column, prefix: str = "ch") -> Column:
    """``ch03`` as ``03``; ``-`` without an id."""
    return F.coalesce(F.regexp_replace(chapter_id, f"^{prefix}", ""), F.lit("-"))
