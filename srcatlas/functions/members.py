"""Members of the classes of one folded text: plain Python that runs inside the tasks of ``operators.entities``.

Patterns are given by the caller and mean what they mean to Java: letters, digits and blanks are ASCII ones.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from srcatlas.functions import patterns as P
from srcatlas.functions.folding import ESCAPES

_BLANKS = " \t\n\x0b\f\r"
_TOKEN = re.compile(r"«[\s\S]([^«»]*)»")
_SLOT = re.compile(r"‹([^‹›]*)›")
_NUMBER = re.compile(r"\s*\+?\d+\s*", re.ASCII)
_HELD = re.compile("[«‹⇒" + "".join(private for _, private in ESCAPES) + "]")
_WORDS = re.compile(r"\S+", re.ASCII)
_NAME = re.compile(r"\w*", re.ASCII)
_GROUPED = 32  # passes are counted as ``outline.unfold`` counts them


def java(pattern: str) -> re.Pattern:
    """A pattern of the extractors, with Java's meaning; ``\\b`` stands beside any letter there."""
    flags = re.ASCII | (re.MULTILINE if pattern.startswith("(?md)") else 0)
    return re.compile(pattern.removeprefix("(?md)").replace(r"\b", r"(?u:\b)"), flags)


def class_names(text: str) -> list[str]:
    """Names of classes declared at the start of a line, in order; the same as ``lines.class_names``."""
    names = []
    for line in text.split("\n") if "class" in text else ():
        if "class" not in line:
            continue
        words = _WORDS.findall(line)
        if "class" not in words:
            continue
        at = words.index("class")
        if at + 1 < len(words) and all(w in P.CLASS_WORDS for w in words[:at]):
            names.append(_NAME.match(words[at + 1])[0])
    return [n for n in names if n]


def _at(items: Sequence[str], number: str, scale: int = 1, shift: int = 0) -> str | None:
    if not number or not _NUMBER.fullmatch(number):
        return None
    place = int(number) * scale + shift
    return items[place] if place < len(items) else None


def unfold(blocks: Sequence[str], pieces: Sequence[str], text: str) -> str:
    """Text with all tokens and literal slots put back as they were written; the same as ``outline.unfold``."""
    if not _HELD.search(text):
        return text

    def group(found: re.Match) -> str:
        put = _at(blocks, found[1])
        return found[0] if put is None else put

    def literal(found: re.Match) -> str:
        put = _at(pieces, found[1], 2, 1)
        return found[0] if put is None else put

    for _ in range((len(blocks) // _GROUPED + 1) * _GROUPED):
        if "«" not in text:
            break
        before, text = text, _TOKEN.sub(group, text)
        if text == before:
            break
    text = _SLOT.sub(literal, text).replace("⇒", "=>")
    for plain, private in ESCAPES:
        text = text.replace(private, plain)
    return text


class Reader:
    """Methods and properties of the class bodies of outlines; ``patterns``: those of ``operators.entities`` by name."""

    def __init__(self, patterns: dict[str, str], wanted: Sequence[str], decorators: str, targets: str):
        self.p = {name: java(pattern) for name, pattern in patterns.items()}
        self.wanted, self.decorators, self.targets = wanted, decorators, targets

    def read(self, o: dict, names: Sequence[str]) -> dict:
        bodies = self._bodies(o, names)
        made: dict = {"whole": o["whole"], "names": names}
        if "methods" in self.wanted:
            made["methods"] = [m for i, text in enumerate(bodies) for m in self._methods(o, text, i)]
        if "properties" in self.wanted:
            made["properties"] = [p for i, text in enumerate(bodies) for p in self._properties(o, text, i)]
        return made

    def _bodies(self, o: dict, names: Sequence[str]) -> list[str]:
        """For each name the folded body of the first class of that name, at any nesting level; '' if there is none."""
        levels = "\n".join([o["top"], *(b for b in o["blocks"] if b.startswith("{"))])
        first: dict[str, str] = {}
        for found in self.p["class_body"].finditer(levels):
            first.setdefault(found[1], found[2])
        return [(_at(o["blocks"], first.get(name, "")) or "")[1:-1] for name in names]

    def _methods(self, o: dict, text: str, owner: int) -> list[dict]:
        made = []
        for found in self.p["method"].finditer(text):
            params = unfold(o["blocks"], o["pieces"], (_at(o["blocks"], found[2]) or "")[1:-1])
            returns = unfold(o["blocks"], o["pieces"], found[3]).split("{", 1)[0].strip(_BLANKS)
            if ")" not in params and returns:
                made.append({"owner": owner, "name": found[1], "params": params, "return_type": returns})
        return made

    def _properties(self, o: dict, text: str, owner: int) -> list[dict]:
        made = []
        for found in self.p["property"].finditer(text):
            stack = list(self.p["stacked"].finditer(found[1]))
            if self.decorators == "last":
                stack = stack[-1:]
            edges = []
            for head in stack:
                if head[1] in P.RELATION_DECORATORS and (to := self._target(o, head[2] or "", found[0])):
                    edges.append({"to": to, "type": head[1]})
            type_ = unfold(o["blocks"], o["pieces"], found[3]).strip(_BLANKS)
            made.append({"owner": owner, "name": found[2], "type": type_, "decorators": [h[1] for h in stack], "edges": edges})
        return made

    def _target(self, o: dict, token: str, statement: str) -> str:
        if self.targets != "any":
            dense = re.sub(r"\s+", "", unfold(o["blocks"], o["pieces"], statement), flags=re.ASCII)
            _, opened, rest = dense.partition("(()=>")
            return re.match(r"\w*", rest, re.ASCII)[0] if opened else ""
        group = _at(o["blocks"], token) or ""
        if folded := self.p["folded_target"].match(group):
            # parameters that hold neither a group with parentheses nor a literal
            if not folded[1] or self.p["bare"].fullmatch(_at(o["blocks"], folded[1]) or ""):
                return folded[2]
        told = self.p["target"].match(unfold(o["blocks"], o["pieces"], group))
        return (told[1] or told[2] or "") if told else ""
