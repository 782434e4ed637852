"""Sequential text algorithms over one document or section: heading parser, packers, semantic boundaries.

They are plain functions from strings to lists, applied by the chunking operators to whole columns per Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tarn.functions import fixed_values as V

# Fixed values. Headings, tables of contents and chapter numbers.
_HEADING = re.compile(r"^(#{1,3}) (.+?)\s*$")
_TOC = re.compile(r"\[\d+\]\([^)]*\)\s*$|^.*\.{2,}\s*\d+\s*$")
_CHAPTER = re.compile(r"^\s*第([0-9一二三四五六七八九十百]+)章")
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")}
_SENTENCE, _SENTENCE_COMMA = re.compile(V.SENTENCE), re.compile(V.SENTENCE_COMMA)
_BLANK = re.compile(r"\n\s*\n")


@dataclass
class Section:
    chapter_id: str
    section_id: str
    chapter_title: str
    section_title: str
    lines: list[str] = field(default_factory=list)

    @property
    def body(self) -> str:
        return "\n".join(self.lines)


def numeral(text: str) -> int:
    """Arabic digits, or Chinese ones up to ninety-nine; 0 for anything else."""
    if text.isdigit():
        return int(text)
    tens, ten, ones = text.rpartition("十")
    if not ten:
        return _DIGITS.get(text, 0)
    return 10 * (_DIGITS.get(tens, 0) if tens else 1) + _DIGITS.get(ones, 0)


def chapter_id(title: str, ordinal: int) -> str:
    found = _CHAPTER.match(title)
    return f"ch{(numeral(found[1]) if found else 0) or ordinal:02d}"


def parse_sections(lines: list[str]) -> list[Section]:
    """Sections of level-1 and level-2 headings; what comes before the first level-1 heading is dropped.

    Text between a chapter's heading and its first section is s00 if there are sections, else s01. Level-3 headings
    become paragraphs. Lines of a table of contents are dropped, sections without text too.
    """
    out: list[Section] = []
    here: Section | None = None
    chapters = number = 0

    def close(then_section: bool = False) -> None:
        if here is None:
            return
        full = [i for i, x in enumerate(here.lines) if x.strip()]
        if full:
            ordinal = number if number else (0 if then_section else 1)
            out.append(Section(here.chapter_id, f"s{ordinal:02d}", here.chapter_title, here.section_title, here.lines[full[0] : full[-1] + 1]))

    for line in map(str.rstrip, lines):
        found = _HEADING.match(line)
        level, title = (len(found[1]), found[2].strip()) if found else (0, "")
        if level == 1:
            close()
            here, number = Section(chapter_id(title, chapters), "", title, ""), 0
            chapters += 1
        elif here is None:
            continue
        elif level == 2:
            close(then_section=True)
            number += 1
            here = Section(here.chapter_id, "", here.chapter_title, title)
        elif level == 3:
            here.lines += ["", f"### {title}", ""]
        elif not _TOC.search(line.strip()):
            here.lines.append(line)
    close()
    return out


def paragraphs_of(lines: list[str]) -> list[str]:
    """Runs of lines that aren't blank."""
    return [p.strip() for p in _BLANK.split("\n".join(x if x.strip() else "" for x in lines)) if p.strip()]


def hard_split(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def sentences_of(text: str, pattern: re.Pattern = _SENTENCE) -> list[str]:
    return [s for s in (m[0].strip() for m in pattern.finditer(text)) if s]


def fill(units: list[str], size: int, joint: str) -> list[str]:
    """Pack units in order while they fit; longer ones are cut and stand alone."""
    out, open_ = [], False
    for u in units:
        if len(u) > size:
            out += hard_split(u, size)
            open_ = False
        elif open_ and len(out[-1]) + len(joint) + len(u) <= size:
            out[-1] += joint + u
        else:
            out.append(u)
            open_ = True
    return out


def recursive(text: str, size: int) -> list[str]:
    """Paragraphs, of long ones the sentences, packed up to ``size``."""
    units: list[str] = []
    for p in filter(None, map(str.strip, _BLANK.split(text))):
        units += [p] if len(p) <= size else sentences_of(p) or [p]
    return fill(units, size, "\n\n")


def with_tail(chunks: list[str], overlap: int) -> list[str]:
    """Each chunk after the end of the one before, as that stands in the output."""
    out: list[str] = []
    for c in chunks:
        out.append(f"{out[-1][-overlap:]}\n\n{c}" if out else c)
    return out


def section_pack(lines: list[str], overlap: int = V.OVERLAP_CHARS, pattern: re.Pattern = _SENTENCE) -> list[str]:
    """Paragraphs packed to TARGET_CHARS (a first one may have MAX_CHARS), each chunk led in by the last paragraph before it, or its end."""
    units: list[str] = []
    for p in paragraphs_of(lines):
        units += [p] if len(p) <= V.MAX_CHARS else fill(sentences_of(p, pattern) or [p], V.MAX_CHARS, "")
    out: list[str] = []
    held: list[str] = []
    for u in units:
        joined = "\n\n".join([*held, u])
        if not held or len(joined) <= V.TARGET_CHARS:
            held.append(u)
            continue
        out.append("\n\n".join(held).strip())
        lead = paragraphs_of(out[-1].splitlines())[-1][-overlap:] if overlap else ""
        held = [lead, u] if lead and len(f"{lead}\n\n{u}".strip()) <= V.MAX_CHARS else [u]
    return [c for c in [*out, "\n\n".join(held).strip()] if c]


def section_pack_no_overlap(lines: list[str]) -> list[str]:
    return section_pack(lines, 0, _SENTENCE_COMMA)


def boundary(start: int, lengths: list[int], similar: np.ndarray, target: int, most: int, threshold: float) -> int:
    """Where the chunk that begins at sentence ``start`` ends (exclusive).

    ``similar[i]`` is the likeness of sentences i and i + 1. Everything left is taken if it fits. Among ends of SEMANTIC_START
    characters or more whose likeness is at most ``threshold``: near the target the least alike, else by distance and
    likeness; without any, the end nearest to the target.
    """
    ends, total = [], -2
    for i in range(start, len(lengths)):
        total += 2 + lengths[i]
        if total > most:
            break
        ends.append((i + 1, total))
    if not ends:
        return start + 1
    if ends[-1][0] == len(lengths):
        return len(lengths)
    far = lambda e: abs(e[1] - target)
    large = [e for e in ends if e[1] >= V.SEMANTIC_START]
    breaks = [e for e in large if similar[e[0] - 1] <= threshold]
    near = [e for e in breaks if far(e) <= V.SEMANTIC_WINDOW]
    if near:
        return min(near, key=lambda e: (similar[e[0] - 1], far(e)))[0]
    if breaks:
        return min(breaks, key=lambda e: (far(e) / target + 0.35 * similar[e[0] - 1], far(e)))[0]
    return min(large, key=far)[0] if large else ends[-1][0]


def semantic_units(body: str) -> list[str]:
    """The sentences of its paragraphs."""
    return [s for p in map(str.strip, _BLANK.split(body)) if p for s in sentences_of(p) or [p]]


def semantic_chunks(units: list[str], similar: np.ndarray, least: int = V.SEMANTIC_MIN, target: int = V.TARGET_CHARS, most: int = V.MAX_CHARS, threshold: float = V.SEMANTIC_BREAK) -> list[str]:
    """Sentences grouped at semantic boundaries; ``similar`` is the likeness of neighbours. A short last group joins the one before if both fit."""
    if len(units) < 2:
        return [c for u in units for c in hard_split(u, most)]
    lengths, out, at = list(map(len, units)), [], 0
    while at < len(units):
        if lengths[at] > most:
            out += hard_split(units[at], most)
            at += 1
            continue
        end = boundary(at, lengths, similar, target, most, threshold)
        out.append("\n\n".join(units[at:end]))
        at = end
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + 2 + len(out[-1]) <= most:
        out[-2:] = ["\n\n".join(out[-2:])]
    return out


def semantic(body: str, embed: Callable[[list[str]], np.ndarray], **sizes) -> list[str]:
    """The semantic chunks of one body, its sentences embedded as unit vectors."""
    units = semantic_units(body)
    vectors = embed(units).astype(np.float64) if len(units) > 1 else np.zeros((1, 1))
    return semantic_chunks(units, np.einsum("ij,ij->i", vectors[:-1], vectors[1:]), **sizes)


def sentence_tail(text: str, size: int) -> str:
    """Whole sentences from the end, one at least, up to about ``size`` characters."""
    units = sentences_of(text) or [text]
    taken, total = [units[-1]], len(units[-1])
    for u in reversed(units[:-1]):
        if total >= size or total + 2 + len(u) > size:
            break
        taken.insert(0, u)
        total += 2 + len(u)
    return "\n\n".join(taken)


def semantic_overlap(chunks: list[str], size: int) -> list[str]:
    """Each chunk led in by the last sentences of the one before, as that stands in the output."""
    out: list[str] = []
    for c in chunks:
        lead = sentence_tail(out[-1], size) if out else ""
        out.append(f"{lead}\n\n{c}" if lead else c)
    return out


def hashed_embedding(units: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for a sentence model: signed hashed character trigrams, unit length."""
    padded = [u if len(u) > 2 else u + "\0" * (3 - len(u)) for u in units]
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(c):
        return np.zeros((0, dim), np.float32)
    owner = np.repeat(np.arange(len(units)), list(map(len, padded)))
    inside = owner[:-2] == owner[2:]
    h = ((c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:])[inside]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    cell = owner[:-2][inside] * (2 * dim) + (h >> np.uint64(40)).astype(np.int64) % (2 * dim)
    seen = np.bincount(cell, minlength=2 * dim * len(units)).reshape(len(units), 2 * dim).astype(np.float64)
    out = seen[:, :dim] - seen[:, dim:]
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)
