"""One text folded: plain Python that runs inside the tasks of ``outline.with_outline``.

Literals and comments are found in one left-to-right scan; then every pass replaces the innermost bracket groups
with tokens, until a pass finds none. The patterns are those described in ``outline``.
"""

from __future__ import annotations

import re

TEMPLATE_DEPTH = 3

# Repetitions are possessive and begin with a negated class, so matching never backtracks far,
# whatever the length of a comment or a literal.
_STRING = r"'[^'\n]*+'|\"[^\"\n]*+\""
_COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"


def _template(depth: int) -> str:
    """A template literal; code in its places holds strings, braces and further templates."""
    if depth == 0:
        code = r"[^`{}]*+"
    else:
        inner = rf"{_STRING}|\{{[^{{}}`]*+\}}|{_template(depth - 1)}|['\"]"
        code = rf"[^`{{}}'\"]*+(?:(?:{inner})[^`{{}}'\"]*+)*+"
    return rf"`[^`$]*+(?:(?:\$\{{{code}\}}|\$)[^`$]*+)*+`"


# A slash that cannot divide: nothing before it on its line but what a value may follow.
# A bracket closes the head of a statement if that begins on its line; told from its end, with up to four calls in it,
# each of which may hold one more.
_CALL = r"\([^()\n]{0,60}(?:\([^()\n]{0,40}\)[^()\n]{0,40})?\)"
_AFTER_HEAD = re.compile(
    r"\b(?:if|while|for|with)[ \t]{0,8}\([^()\n]{0,120}" + 4 * rf"(?:{_CALL}[^()\n]{{0,60}})?" + r"\)\Z", re.ASCII
)
_HEAD = 1000  # more than the longest head that is looked for
_VALUE_WORDS = r"return|case|typeof|delete|void|throw|else|do|in|of|await|yield|instanceof"
_AFTER_WORD = re.compile(rf"(?<![\w$.])(?:{_VALUE_WORDS})\Z", re.ASCII)
_WORD = 12  # more than the longest of these words and the sign before it
_VALUE_SIGNS = frozenset("(,=:[!&|?{};+\n>~^%*-")
_BLANKS = 40
_REGEX = r"/(?![*/])[^/\\\n\[]*+(?:(?:\\[^\n]|\[[^\]\\\n]*+(?:\\[^\n][^\]\\\n]*+)*+\])[^/\\\n\[]*+)*+/[a-z]*+"
_LITERAL = re.compile(rf"{_STRING}|{_template(TEMPLATE_DEPTH)}|{_REGEX}|{_COMMENT}")

_ANGLES = r"<[^<>{}();]*+>"
_SQUARES = r"\[[^\[\]{}()<>,]*+,[^\[\]{}()<>]*+\]"
# Inside braces and parentheses, what is not a group of another kind that is still to be folded.
_INSIDE = rf"[^{{}}()<\[]*+(?:(?:<(?!{_ANGLES[1:]})|\[(?!{_SQUARES[2:]}))[^{{}}()<\[]*+)*+"
_GROUP = re.compile(rf"\{{{_INSIDE}\}}|\({_INSIDE}\)|{_ANGLES}|{_SQUARES}")
_LETTERS = {"{": "«b", "(": "«p", "<": "«a", "[": "«s"}
_OPEN = re.compile(r"[{}()]")
_PLAIN = re.compile(r"[^'\"`/\\{}()<>\[\]=]*+")

# Escaped quotes and backslashes, each held as one private-use character.
ESCAPES = [
    ("\\\\", "\ue000"),
    ("\\'", "\ue001"),
    ('\\"', "\ue002"),
    ("\\`", "\ue003"),
    ("\\$", "\ue004"),
]


def _starts_value(text: str, at: int) -> bool:
    """Whether a regular expression may begin at a slash."""
    j = at
    while j and text[j - 1] in " \t" and at - j < _BLANKS:
        j -= 1
    if not j or text[j - 1] in _VALUE_SIGNS:
        return True
    if text[j - 1] == ")":
        line = text.rfind("\n", 0, j) + 1
        return _AFTER_HEAD.search(text[max(line, j - _HEAD) : j]) is not None
    return _AFTER_WORD.search(text[max(0, j - _WORD) : j]) is not None


def code_pieces(text: str) -> list[str]:
    """Code cut at its literals and comments: odd pieces are the literals, and '' for comments.

    Comment signs inside literals stay.
    """
    if "\\" in text:
        for plain, private in ESCAPES:
            text = text.replace(plain, private)
    pieces, last, at = [], 0, 0
    while found := _LITERAL.search(text, at):
        start, at = found.span()
        sign, follows = text[start], text[start + 1]
        if sign == "/" and follows not in "/*" and not _starts_value(text, start):
            at = start + 1
            continue
        pieces += text[last:start], "" if sign == "/" and follows in "/*" else text[start:at]
        last = at
    pieces.append(text[last:])
    return pieces


def folded(text: str) -> tuple[str, list[str]]:
    """Bracket groups replaced with tokens, inside out, and the groups."""
    blocks: list[str] = []

    def token(found: re.Match) -> str:
        group = found[0]
        blocks.append(group)
        return f"{_LETTERS[group[0]]}{len(blocks) - 1}»"

    found = 1
    while found and any(sign in text for sign in _LETTERS):
        text, found = _GROUP.subn(token, text)
    return text, blocks


def outline(text: str) -> dict:
    """``top``, ``blocks``, ``pieces`` and ``whole`` of a text."""
    if _PLAIN.fullmatch(text):
        return {"top": text, "blocks": [], "pieces": [text], "whole": True}
    pieces = code_pieces(text)
    slots = list(pieces)
    for i in range(1, len(slots), 2):
        if slots[i]:
            slots[i] = f"‹{i // 2}›"
    top, blocks = folded("".join(slots).replace("=>", "⇒"))
    return {"top": top, "blocks": blocks, "pieces": pieces, "whole": _OPEN.search(top) is None}
