"""Strict parsing and deterministic repair of report sections that a model wrote as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

#: One lexical unit outside of strings: a whole string, an unfinished one, or any other character.
_UNIT = re.compile(r'"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*$|.', re.S)
_STRAY = re.compile(r'"(?=\s*\{)')
_METHOD = "programmatic_json_recovery"


@dataclass
class Recovery:
    sentences: list[dict] | None = None
    success: bool = False
    method: str | None = None
    actions: list[str] = field(default_factory=list)


def _object(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("an object repeats a key")
    return dict(pairs)


def loads(text: str):
    """JSON in which no object repeats a key."""
    return json.loads(text, object_pairs_hook=_object)


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def parse_strict(raw: str | None) -> list[dict] | None:
    """The sentences of exactly {"sentences": [{"text", "source_items"}]}, texts stripped; None for anything else."""
    try:
        value = loads(raw)
    except (ValueError, TypeError):
        return None
    if not isinstance(value, dict) or set(value) != {"sentences"} or not isinstance(value["sentences"], list):
        return None
    out = []
    for s in value["sentences"]:
        if not isinstance(s, dict) or set(s) != {"text", "source_items"}:
            return None
        text, items = s["text"], s["source_items"]
        if not isinstance(text, str) or not text.strip() or not isinstance(items, list) or not all(map(_whole, items)):
            return None
        out.append({"text": text.strip(), "source_items": items})
    return out


def balanced_objects(text: str) -> list[str]:
    """The complete object that begins at each opening brace, if it closes; strings are skipped as seen from that brace.

    One walk closes all braces that it meets outside of strings; another one begins at each brace that no walk has met.
    """
    ends: dict[int, int] = {}
    met: set[int] = set()
    for start in (m.start() for m in re.finditer(r"\{", text)):
        if start in met:
            continue
        open_: list[int] = []
        for unit in _UNIT.finditer(text, start):
            if unit[0] == "{":
                met.add(unit.start())
                open_.append(unit.start())
            elif unit[0] == "}" and open_:
                ends[open_.pop()] = unit.end()
    return [text[start : ends[start]] for start in sorted(ends)]


def drop_stray_quotes(text: str) -> tuple[str, int]:
    """Quotes outside of strings between ``},`` and ``{`` removed, and how many."""
    out: list[str] = []
    at, dropped, tail, spaced = 0, 0, "", False  # tail: the last two characters but for white space at the end
    while at < len(text):
        if tail == "}," and _STRAY.match(text, at):
            at, dropped = at + 1, dropped + 1
            continue
        unit = _UNIT.match(text, at)[0]
        out.append(unit)
        at += len(unit)
        if unit.isspace():
            spaced = True
        else:
            tail, spaced = ((" " if spaced else tail) + unit[-2:])[-2:], False
    return "".join(out), dropped


def _digits(x) -> bool:
    return isinstance(x, str) and x.strip().isdigit()


#: What a value that isn't a list of items is turned into, and the name of that repair.
_LISTED = [(_whole, lambda x: [x], "source_items_scalar_to_list"), (_digits, lambda x: [int(x)], "source_items_numeric_string_to_list")]
#: The same for one item of a list; a number needs no repair.
_NUMBERED = [(_whole, lambda x: x, None), (_digits, int, "source_item_numeric_string_to_int")]


def _by_rule(value, rules: list[tuple]) -> tuple | None:
    return next(((made(value), name) for fits, made, name in rules if fits(value)), None)


def _sentence(value) -> tuple[dict, list[str]] | None:
    if not (isinstance(value, dict) and set(value) == {"text", "source_items"} and isinstance(value["text"], str) and value["text"].strip()):
        return None
    items, name = _by_rule(value["source_items"], _LISTED) or (value["source_items"], None)
    numbers = [_by_rule(i, _NUMBERED) for i in items] if isinstance(items, list) else [None]
    if None in numbers:
        return None
    return {"text": value["text"], "source_items": [n for n, _ in numbers]}, [x for x in (name, *(done for _, done in numbers)) if x]


def _normalized(value) -> tuple[list[dict], list[str]] | None:
    """Sentences with scalar or numeric-string items made lists of numbers, and what was done; None if anything else is off."""
    if not isinstance(value, dict) or list(value) != ["sentences"] or not isinstance(value["sentences"], list):
        return None
    found = [_sentence(s) for s in value["sentences"]]
    return ([s for s, _ in found], [x for _, done in found for x in done]) if found and None not in found else None


def recover(raw: str | None) -> Recovery:
    """The first of these that parses: the text without a code fence, the same without stray quotes, the objects within either."""
    if raw is None:
        return Recovery()
    text, fence = raw.strip(), []
    lines = text.splitlines()
    if len(lines) >= 3 and text.startswith("```") and lines[-1].strip() == "```":
        text, fence = "\n".join(lines[1:-1]).strip(), ["strip_code_fence"]
    repaired, dropped = drop_stray_quotes(text)
    wholes = [(text, fence)] + ([(repaired, fence + ["remove_stray_object_boundary_quote"] * dropped)] if repaired != text else [])
    inner = [(o, done + ["extract_json_object"]) for whole, done in wholes for o in balanced_objects(whole) if o != whole]
    tried = set()
    for candidate, done in wholes + inner:
        if candidate in tried:
            continue
        tried.add(candidate)
        try:
            found = _normalized(loads(candidate))
        except (ValueError, TypeError, RecursionError):
            continue
        if found:
            return Recovery(found[0], True, _METHOD, done + found[1])
    return Recovery(None, False, _METHOD, fence)
