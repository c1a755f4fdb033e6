"""TeX rules that need balanced braces, a fixpoint or Unicode normalisation, as Arrow-batched functions.

A formula is read once into a list of items (commands, groups, single characters) by ``scan``;
rules then look at items, not at text.
"""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
import xml.etree.ElementTree as ET
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Commands that lay out and carry no meaning.
LAYOUT = frozenset({
    "frac", "dfrac", "tfrac", "sqrt", "root", "of", "begin", "end", "left", "right", "underset", "overset", "limits", "nolimits",
    "displaystyle", "textstyle", "scriptstyle", "scriptscriptstyle", "quad", "qquad", "big", "Big", "bigg", "Bigg", "bigl", "bigr",
    "Bigl", "Bigr", "biggl", "biggr", "Biggl", "Biggr", "mathrm", "mathbf", "mathit", "mathbb", "mathcal", "mathfrak", "operatorname",
    "text", "boldsymbol", "overline", "underline", "overbrace", "underbrace", "binom", "dbinom", "tbinom", "over", "atop", "choose",
    "array", "matrix", "pmatrix", "bmatrix", "Bmatrix", "vmatrix", "Vmatrix", "cases", "aligned", "gathered", "substack", "hphantom",
    "vphantom", "phantom", "smash", "notag", "tag", "thinspace", "medspace", "thickspace",
})
# Commands and their signs. A command that begins with one of these names is read as the first such name and letters.
SIGNS = {
    "Leftrightarrow": "⇔", "Rightarrow": "⇒", "mapsto": "↦", "notin": "∉", "infty": "∞", "iiint": "∭", "iint": "∬", "oint": "∮", "int": "∫",
    "sum": "∑", "prod": "∏", "coprod": "∐", "bigcup": "∪", "cup": "∪", "bigcap": "∩", "cap": "∩", "leqslant": "≤", "leq": "≤", "le": "≤",
    "geqslant": "≥", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "to": "→", "pm": "±", "mp": "∓", "times": "×", "div": "÷", "cdot": "·",
    "in": "∈", "lvert": "|", "rvert": "|", "vert": "|", "lVert": "‖", "rVert": "‖", "Vert": "‖", "langle": "⟨", "rangle": "⟩", "prime": "PRIME",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ",
    "vartheta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "varpi": "π", "rho": "ρ",
    "varrho": "ρ", "sigma": "σ", "varsigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}
# Marks that an anchor ignores; glyphs of one prime, of several; superscript glyphs.
ANCHOR_MARKS = "，,、。.;；:：'\"“”‘’（）()[]【】"
PRIME_GLYPHS = "′ʹ’‘"
SEVERAL_PRIMES = {"‴": "'''", "″": "''", "ʺ": "''"}
RAISED = {"⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "⁺": "+", "⁻": "-"}
# Commands and environments of structure, by name.
FRACTIONS = frozenset({"frac", "dfrac", "tfrac", "cfrac", "binom", "over"})
MATRICES = frozenset({"smallmatrix", "matrix", "pmatrix", "bmatrix", "Bmatrix", "vmatrix", "Vmatrix", "array"})
EQUATION_ARRAYS = frozenset({"cases", "dcases", "rcases", "aligned", "alignedat", "array"})
STRUCTURE = ("fractions", "radicals", "matrices", "equation_arrays", "subscripts", "superscripts", "subsuperscripts")
# Signs and commands of relations and operators, by name.
RELATIONS = {
    "le": ("≤", "\\le", "\\leq", "\\leqslant"), "ge": ("≥", "\\ge", "\\geq", "\\geqslant"), "ne": ("≠", "\\ne", "\\neq"), "lt": ("<", "\\lt"), "gt": (">", "\\gt"),
    "eq": ("=",), "plus": ("+",), "minus": ("-", "−"), "pm": ("±", "\\pm"), "mp": ("∓", "\\mp"), "times": ("×", "\\times"), "divide": ("÷", "\\div"), "cdot": ("·", "\\cdot"),
}
OPERATORS = {
    "integral": ("∫", "\\int"), "double_integral": ("∬", "\\iint"), "triple_integral": ("∭", "\\iiint"), "contour_integral": ("∮", "\\oint"), "sum": ("∑", "\\sum"),
    "product": ("∏", "\\prod"), "coproduct": ("∐", "\\coprod"), "union": ("∪", "\\cup", "\\bigcup"), "intersection": ("∩", "\\cap", "\\bigcap"), "membership": ("∈", "\\in"),
    "nonmembership": ("∉", "\\notin"), "arrow": ("→", "\\to"), "mapsto": ("↦", "\\mapsto"), "implies": ("⇒", "\\Rightarrow"), "equivalence": ("⇔", "\\Leftrightarrow"), "infinity": ("∞", "\\infty"),
}
_NAMED = {token: (kind, name) for kind, table in (("relations", RELATIONS), ("operators", OPERATORS)) for name, tokens in table.items() for token in tokens}


class Item(NamedTuple):
    kind: str  # command, group, space or char
    begin: int
    end: int
    inner: str  # what an argument contributes: a group without its braces
    closed: bool = True


_COMMAND = re.compile(r"\\(?:[A-Za-z]+|.?)", re.S)
_FLAT = re.compile(r"\\(?:[A-Za-z]+|.?)|.", re.S)
_BRACES = re.compile(r"\\.?|[{}]", re.S)


def scan(text: str, at: int = 0) -> list[Item]:
    """Items from ``at`` on; an open group reaches to the end."""
    out: list[Item] = []
    add, item, size = out.append, functools.partial(tuple.__new__, Item), len(text)
    while at < size:
        begin, c = at, text[at]
        if c == "\\":
            at = _COMMAND.match(text, at).end()
            add(item(("command", begin, at, text[begin:at], True)))
        elif c == "{":
            depth, at = 1, size
            for brace in _BRACES.finditer(text, begin + 1):
                depth += {"{": 1, "}": -1}.get(brace[0], 0)
                if not depth:
                    at = brace.end()
                    break
            add(item(("group", begin, at, text[begin + 1 : at if depth else at - 1], not depth)))
        else:
            at += 1
            add(item(("space" if c.isspace() else "char", begin, at, c, True)))
    return out


@dataclass
class Limit:
    """A limit operator: what its wrapper puts below it (null without one), whether a command places its scripts, and the scripts in order."""

    lower: str | None
    placed: bool
    scripts: list[tuple[str, str]]

    def issues(self) -> set[str]:
        below = any(mark == "_" for mark, _ in self.scripts)
        return {
            code
            for code, found in (
                ("empty_underset_lim", self.lower == ""),
                ("lim_limits_command_not_allowed", self.placed),
                ("lim_subscript_requires_underset", below and self.lower is None),
                ("duplicate_lim_subscript", below and self.lower is not None),
            )
            if found
        }


class _LimitWalk:
    """One walk over the items of a formula, groups within groups: the text with lower scripts put below, and all limits on the way."""

    def __init__(self, text: str) -> None:
        self.found: list[Limit] = []
        self.text = self._formula(text)

    def _formula(self, text: str) -> str:
        if "\\lim" not in text:
            return text
        items, out, k = scan(text), [], 0
        while k < len(items):
            piece, k = self._next(items, k)
            out.append(piece)
        return "".join(out)

    def _next(self, items: list[Item], k: int) -> tuple[str, int]:
        item = items[k]
        if item.inner == "\\lim" and item.kind == "command":
            return self._bare(items, k)
        if item.inner == "\\underset" and item.kind == "command":
            first = self._skip(items, k + 1)
            second = self._skip(items, first + 1)
            if second < len(items) and items[second].inner.strip() == "\\lim":
                return self._wrapped(items, k, first, second)
        return self._plain(item), k + 1

    @staticmethod
    def _skip(items: list[Item], k: int) -> int:
        while k < len(items) and items[k].kind == "space":
            k += 1
        return k

    def _plain(self, item: Item) -> str:
        if item.kind != "group":
            return item.inner
        return "{" + self._formula(item.inner) + ("}" if item.closed else "")

    def _scripts(self, items: list[Item], k: int) -> tuple[bool, list[tuple[str, int]], int]:
        """Whether a command places the scripts from ``k`` on, their marks and arguments, and where they end."""
        at = self._skip(items, k)
        placed = at < len(items) and items[at].inner in ("\\limits", "\\nolimits")
        end, marks = at + 1 if placed else k, []
        while True:
            mark = self._skip(items, end)
            argument = self._skip(items, mark + 1)
            if argument >= len(items) or items[mark].kind != "char" or items[mark].inner not in "_^":
                return placed, marks, end
            marks.append((items[mark].inner, argument))
            end = argument + 1

    def _bare(self, items: list[Item], k: int) -> tuple[str, int]:
        placed, marks, end = self._scripts(items, k + 1)
        self.found.append(Limit(None, placed, [(mark, items[at].inner.strip()) for mark, at in marks]))
        if not marks and not placed:
            return items[k].inner, k + 1
        texts: dict[str, str] = {}
        for mark, at in marks:
            inner = self._formula(items[at].inner) if items[at].kind == "group" else items[at].inner
            texts.setdefault(mark, inner.strip())
        below = f"\\underset{{{texts['_']}}}{{\\lim}}" if "_" in texts else "\\lim"
        return below + (f"^{{{texts['^']}}}" if "^" in texts else ""), end

    def _wrapped(self, items: list[Item], k: int, first: int, second: int) -> tuple[str, int]:
        before = [self._plain(i) for i in items[k : first + 1]]
        placed, marks, end = self._scripts(items, second + 1)
        self.found.append(Limit(items[first].inner.strip(), placed, [(mark, items[at].inner.strip()) for mark, at in marks]))
        between = ["{" + i.inner + "}" if i.kind == "group" else i.inner for i in items[first + 1 : second + 1]]
        return "".join([*before, *between, *(self._plain(i) for i in items[second + 1 : end])]), end


def limits(text: str) -> list[Limit]:
    """All ``\\lim`` operators, nested ones included, in text order."""
    return _LimitWalk(text).found


def place_limits(text: str) -> str:
    """A lower script of a limit goes below it by ``\\underset``."""
    return _LimitWalk(text).text


def limit_issues(text: str) -> list[str]:
    return sorted(set().union(*(limit.issues() for limit in limits(text))))


def limit_placements(text: str) -> list[list[str]]:
    sides = {"_": "below", "^": "above"}
    found = [(["below"] if limit.lower else []) + [sides[mark] for mark, _ in limit.scripts] for limit in limits(text)]
    return [f for f in found if f]


def flat(text: str) -> list[str]:
    """Commands whole, everything else character by character."""
    return _FLAT.findall(text)


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


_RUNS = re.compile(f"[{PRIME_GLYPHS}]+|[{''.join(RAISED)}]+|[{''.join(SEVERAL_PRIMES)}]")


def _commands(run: re.Match) -> str:
    run = run[0]
    if run[0] in RAISED:
        return "^{" + "".join(RAISED[c] for c in run) + "}"
    if run[0] in SEVERAL_PRIMES:
        return SEVERAL_PRIMES[run]
    whole, rest = divmod(len(run), 3)
    return "'''" * whole + ("", "\\prime", "''")[rest]


def _glyphs(text: str) -> str:
    """Glyphs of primes and superscripts as commands; a prime is ``\\prime``, two or three are apostrophes."""
    return re.sub("'+", lambda run: "\\prime" if run[0] == "'" else run[0], _RUNS.sub(_commands, text))


def _atom(item: Item | None, empty: bool = False) -> bool:
    """A command, a letter or digit, or a group without groups in it."""
    if item is None or item.kind == "space":
        return False
    if item.kind == "group":
        return item.closed and (empty or bool(item.inner)) and not set(item.inner) & set("{}")
    return len(item.inner) > 1 and _letter(item.inner[1]) if item.kind == "command" else _plain(item.inner)


def _leading_prime(text: str) -> tuple[str, str]:
    """What a text begins with: ``\\prime``, two or three apostrophes, or nothing; and the rest of it."""
    if text.startswith("\\prime"):
        return "\\prime", text[6:]
    n = min(3, len(text) - len(text.lstrip("'")))
    return (text[:n], text[n:]) if n > 1 else ("", text)


def _primed_power(items: list[Item], k: int, text: str) -> tuple[int, str] | None:
    """From item ``k`` on, a base whose exponent has a prime in it, or a primed base with an exponent: the item after it and what it becomes."""

    def at(i: int) -> Item | None:
        return items[i] if i < len(items) else None

    def is_char(i: int, c: str) -> bool:
        return at(i) is not None and at(i).kind == "char" and at(i).inner == c

    if _atom(at(k)) and is_char(k + 1, "^") and at(k + 2) is not None and at(k + 2).kind == "group" and at(k + 2).closed:
        prime, rest = _leading_prime(at(k + 2).inner)
        rest = rest.lstrip()
        if prime and rest and all(_plain(c) or c in "+-" for c in rest):
            return k + 3, f"{{{at(k).inner}{prime}}}^{{{rest}}}"
    end = k + 1
    if is_char(k, "("):
        while at(end) is not None and not is_char(end, ")") and not is_char(end, "("):
            end += 1
        if not is_char(end, ")") or end == k + 1:
            return None
        end += 1
    elif not _atom(at(k)) or at(k).kind == "group":
        return None
    if is_char(end, "_") and _atom(at(end + 1), empty=True):
        end += 2
    marks = end
    if at(end) is not None and (at(end).kind, at(end).inner) == ("command", "\\prime") and not (at(end + 1) is not None and at(end + 1).kind == "char" and (_plain(at(end + 1).inner) or at(end + 1).inner == "_")):
        marks = end + 1
    else:
        while is_char(marks, "'"):
            marks += 1
        if marks - end not in (2, 3):
            return None
    power = marks
    while at(power) is not None and at(power).kind == "space":
        power += 1
    exponent = at(power + 1)
    if not is_char(power, "^") or not _atom(exponent) or exponent.kind == "command":
        return None
    return power + 2, f"{{{text[items[k].begin : items[marks - 1].end]}}}^{{{exponent.inner}}}"


# Where the marks of a primed power can stand, or the sign before an exponent that begins with a prime, at any depth: all that ``_primed_power`` finds has one.
_PRIMED_POWER = re.compile(r"(?<=[A-Za-z0-9}])(?=\^\{(?:\\prime|'{2,3})\s*[A-Za-z0-9+-]+\})|(?<=[A-Za-z0-9)}])(?=(?:\\prime|'{2,3})\s*\^(?:[A-Za-z0-9]|\{[^{}]+\}))")


def _groups(text: str) -> list[Item]:
    """The groups among the items of a text."""
    out, depth, begin = [], 0, 0
    for brace in _BRACES.finditer(text):
        if brace[0] == "{":
            if not depth:
                begin = brace.start()
            depth += 1
        elif brace[0] == "}" and depth:
            depth -= 1
            if not depth:
                out.append(Item("group", begin, brace.end(), text[begin + 1 : brace.end() - 1]))
    if depth:
        out.append(Item("group", begin, len(text), text[begin + 1 :], False))
    return out


def _grouped(text: str, done: set[str] | None = None) -> str:
    """Primed bases with exponents are grouped, inner ones first, until nothing changes; ``done`` holds groups that do not change any more."""
    done = set() if done is None else done
    while text not in done and (spots := {found.start() for found in _PRIMED_POWER.finditer(text)}):
        out: list[str] = []
        at, groups = 0, _groups(text)
        # where all spots lie in groups, other items stay as they are
        items = groups if sum(g.begin < spot < g.end for g in groups for spot in spots) == len(spots) else scan(text)
        k = 0
        while k < len(items):
            item = items[k]
            found = None
            if items is not groups and (item.end in spots or item.inner == "(" and k + 1 < len(items) and items[k + 1].inner or k + 2 < len(items) and items[k + 1].inner == "_" and items[k + 2].end in spots):
                found = _primed_power(items, k, text)
            out.append(text[at : item.begin])
            if found:
                k, piece = found
            else:
                piece = text[item.begin : item.end]
                if item.kind == "group":
                    piece = "{" + _grouped(item.inner, done) + ("}" if item.closed else "")
                k += 1
            at = items[k - 1].end
            out.append(piece)
        whole = "".join(out) + text[at:]
        if whole == text:
            done.add(text)
        text = whole
    return text


def normalize(text: str | None) -> str:
    """The fixed pipeline: limits, small integrals, primes, superscripts, exponents of primed atoms."""
    text = place_limits(text or "")
    if "\\smallint" in text:
        text = "".join("\\int" if t == "\\smallint" else t for t in flat(text))
    return _grouped(_glyphs(text))


def _group_end(tokens: list[str], k: int) -> int | None:
    """The place after a brace group without groups in it that opens at ``k``."""
    if k < len(tokens) and tokens[k] == "{":
        for end in range(k + 1, len(tokens)):
            if tokens[end] == "}":
                return end + 1
            if "{" in tokens[end] or "}" in tokens[end]:
                return None
    return None


def _spaces_end(tokens: list[str], k: int) -> int:
    while k < len(tokens) and tokens[k].isspace():
        k += 1
    return k


@lru_cache(1 << 12)
def _meaning(token: str) -> list[str]:
    """A command as its sign or name, and letters left over; nothing for layout."""
    name = token[1:]
    for known, sign in SIGNS.items():
        if name.startswith(known):
            return [sign, *name[len(known) :]]
    return [] if name in LAYOUT else [name.lstrip("\\") or "\\"]


def semantic_tokens(text: str | None) -> list[str]:
    """What a formula says, without how it is laid out."""
    tokens = flat(normalize(text))
    out: list[str] = []
    k, run = 0, ""
    while k < len(tokens):
        token = tokens[k]
        k += 1
        if token in ("\\begin", "\\end") and (end := _group_end(tokens, _spaces_end(tokens, k))):
            k, parts = end, []
        elif token == "\\\\":
            parts = []
        elif token[0] == "\\" and len(token) > 1:
            parts = _meaning(token)
        else:
            parts = [] if token.isspace() or token in "{}" else ["PRIME"] if token == "′" else [token]
        if not parts:
            run = ""
        for part in parts:
            # letters that follow each other are one token, and so are digits
            kind = "letters" if len(part) == 1 and _letter(part) else "digits" if len(part) == 1 and part.isdecimal() else ""
            if kind and kind == run:
                out[-1] += part
            else:
                out.append(part)
            run = kind
    return out


def _script_end(tokens: list[str], k: int) -> int | None:
    """The place after the argument of a script mark at ``k``: a letter or digit, or a group without groups."""
    if k + 1 < len(tokens) and _plain(tokens[k + 1][0]):
        return k + 2
    return _group_end(tokens, k + 1)


def structure(text: str | None) -> dict:
    """Counts of structure, and of relations and operators by name."""
    tokens = flat(text or "")
    out: dict = dict.fromkeys(STRUCTURE, 0) | {"relations": {}, "operators": {}}
    for k, token in enumerate(tokens):
        if token[0] != "\\" and token not in "_^" and token not in _NAMED:
            continue
        after = tokens[k + 1][0] if k + 1 < len(tokens) else " "
        name = token[1:] if token[0] == "\\" else ""
        bounded = not (after.isalnum() or after == "_")
        out["fractions"] += name in FRACTIONS and bounded
        out["radicals"] += name == "sqrt" and bounded
        out["matrices"] += name == "matrix" and bounded
        begin = _spaces_end(tokens, k + 1)
        if name == "begin" and (end := _group_end(tokens, begin)):
            environment = "".join(tokens[begin + 1 : end - 1])
            out["matrices"] += environment in MATRICES
            out["equation_arrays"] += environment in EQUATION_ARRAYS
        out["subscripts"] += name == "underset" and begin < len(tokens) and tokens[begin] == "{"
        if token in ("_", "^") and (end := _script_end(tokens, k)):
            out["subscripts" if token == "_" else "superscripts"] += 1
            other = _spaces_end(tokens, end)
            out["subsuperscripts"] += token == "_" and other < len(tokens) and tokens[other] == "^" and _script_end(tokens, other) is not None
        kind, what = _NAMED.get(token, (None, None))
        if kind and not (token == "=" and (after == "=" or k and tokens[k - 1][-1] in "<>=")):
            out[kind][what] = out[kind].get(what, 0) + 1
    out["subsuperscripts"] += sum({"below", "above"} <= set(p) for p in limit_placements(text or ""))
    return out


def nfkc(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "")


def anchor(text: str | None) -> str:
    """Without white space and punctuation, compatibility forms folded."""
    return re.sub(r"\s+", "", nfkc(text)).translate({ord(c): None for c in ANCHOR_MARKS})


def strip_delimiters(text: str | None) -> str:
    out = (text or "").strip()
    while len(out) > 1 and out[0] == out[-1] == "$":
        out = out[1:-1].strip()
    return out


def normalize_exported(text: str | None) -> str:
    return strip_delimiters(" ".join(nfkc(text).split()))


def cjk_ratio(one: str | None, two: str | None) -> float:
    """Similarity of the ideographs alone."""
    a, b = (re.sub(r"[^\u3400-\u9fff]", "", x or "") for x in (one, two))
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def canonical_xml(text: str | None) -> str | None:
    """Canonical XML (version 2.0, of the standard library); null for what is no XML."""
    try:
        return ET.canonicalize(text) if text else None
    except ET.ParseError:
        return None


# Fractions of one glyph, signs that make a run mathematics, numerals of lists, marks after a label.
FRACTION_GLYPHS = "½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞"
MATH_SIGNS = "=<>≤≥±×÷∑∏∫√∞≈≠∀∃∄∈∉∋∌⊂⊆⊇⊃∪∩∧∨¬⊕⊗→←↔⇔⇒⟹⟺^_"
NUMERALS = "一二三四五六七八九十"
LABEL_MARKS = "、.．"


def _math_letter(c: str) -> bool:
    return _letter(c) or "Α" <= c <= "Ω" or "α" <= c <= "ω"


def _is_number(value: str) -> bool:
    whole, dot, part = value.removeprefix(value[0] if value[0] in "+-" else "").partition(".")
    return whole.isdecimal() and (part.isdecimal() if dot else True)


def _is_operand(value: str) -> bool:
    return bool(value) and all(_math_letter(c) or c in "0123456789" for c in value)


def math_class(value: str) -> str | None:
    """The class of a whole run; null where it is no mathematics."""
    if _is_number(value):
        return "number"
    if all(map(_math_letter, value)):
        return "letters"
    parts = [p.strip() for p in value.split("/")]
    outer = value == value.strip()
    if value in FRACTION_GLYPHS or len(parts) == 2 and outer and all(map(_is_operand, parts)):
        return "simple_fraction"
    if any(c in MATH_SIGNS for c in value) and not any("\u3400" <= c <= "\u9fff" for c in value):
        return "math_operator"
    for sign in "+-*/=<>":
        value = value.replace(sign, "+")
    parts = value.split("+")
    return "math_expression" if len(parts) > 1 and outer and all(_is_operand(p.strip()) for p in parts) else None


def _digits(text: str, at: int) -> int:
    while at < len(text) and text[at].isdecimal():
        at += 1
    return at


def label_end(paragraph: str) -> int:
    """Where the label that a paragraph begins with ends; 0 where there is none."""
    at = len(paragraph) - len(paragraph.lstrip())
    head = paragraph[at : at + 1]
    if head == "例":
        at = len(paragraph) - len(paragraph[at + 1 :].lstrip())
        end = _digits(paragraph, at)
        return end + 1 if end > at and paragraph[end : end + 1] in tuple(LABEL_MARKS) else 0
    first = at + (head in ("（", "("))
    end = _digits(paragraph, first)
    if end > first:
        return end + 1 if paragraph[end : end + 1] in (")", "）", *LABEL_MARKS) else 0
    end = at
    if head and head in "ABCDabcd":
        end += 1
    else:
        while end < len(paragraph) and paragraph[end] in NUMERALS:
            end += 1
    return end + 1 if end > at and paragraph[end : end + 1] in tuple(LABEL_MARKS) else 0


def plain_math(run: str | None, paragraph: str | None, start: int | None = 0, vertical: str | None = None) -> tuple[bool, str | None]:
    """Whether a plain run is mathematics, and its class; labels of lists and options are not."""
    run, paragraph, start = run or "", paragraph or "", start or 0
    value = nfkc(run.strip())
    if not value:
        return False, None
    end = start + len(run)
    labelled = label_end(paragraph)
    if start < labelled and end <= labelled:
        return False, "paragraph_numbering"
    before, after = paragraph[:start].rstrip()[-1:], paragraph[end:].lstrip()[:1]
    if all(_plain(c) or c in NUMERALS for c in value):
        numbered = after in tuple(LABEL_MARKS) or value.isdigit() and (after in (")", "）") or before in ("例", "题"))
        if numbered:
            return False, "paragraph_numbering"
        if not before and len(value) == 1 and _letter(value) and "\u4e00" <= after <= "\u9fff":
            return False, "option_label"
    kind = math_class(value)
    if vertical in ("superscript", "subscript") and kind in ("number", "letters"):
        return True, f"{vertical}_math"
    return kind is not None, kind


_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())


def _udf(function, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: function(None if v is None else v))

    return run


normalize_udf = _udf(normalize, _TEXT)
tokens_udf = _udf(semantic_tokens, _TEXTS)
limit_issues_udf = _udf(limit_issues, _TEXTS)
limit_placements_udf = _udf(limit_placements, T.ArrayType(_TEXTS))
nfkc_udf = _udf(nfkc, _TEXT)
anchor_udf = _udf(anchor, _TEXT)
exported_udf = _udf(normalize_exported, _TEXT)
safe_udf = _udf(lambda text: normalize(strip_delimiters(text)), _TEXT)
canonical_xml_udf = _udf(canonical_xml, _TEXT)


_COUNTS = T.MapType(_TEXT, T.IntegerType())


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in STRUCTURE] + [T.StructField("relations", _COUNTS), T.StructField("operators", _COUNTS)]))
def structure_udf(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([structure(v) for v in values], columns=[*STRUCTURE, "relations", "operators"])


@F.pandas_udf(T.DoubleType())
def cjk_ratio_udf(one: pd.Series, two: pd.Series) -> pd.Series:
    return pd.Series([cjk_ratio(a, b) for a, b in zip(one, two, strict=True)], dtype=float)


@F.pandas_udf(T.StructType([T.StructField("is_math", T.BooleanType()), T.StructField("kind", _TEXT)]))
def plain_math_udf(run: pd.Series, paragraph: pd.Series, start: pd.Series, vertical: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([plain_math(*x) for x in zip(run, paragraph, start, vertical, strict=True)], columns=["is_math", "kind"])
