"""JavaScript tokens in context, and the functions and calls among them.

A slash begins a regular expression where a value may begin, and divides where one has ended; that depends on what a closing
bracket closes, so brackets are kept on a stack with what they are. Template literals are lexed to any depth: what stands in `${ }` is code. Functions are
declarations, expressions and methods (arrows belong to the function around them); a function's length is the number of
statements of its body, which end at semicolons, blocks or, as the language allows, line ends.

Text that is no JavaScript gives what can be told: unclosed literals end at the line's or text's end, unmatched brackets are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .catalog import JS_DANGEROUS, JS_VALIDATION

_SKIP = re.compile(r"[ \t\r\f\v ﻿]+|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_NAME = re.compile(r"#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r""""(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)""", re.S)
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_CHUNK = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_SIGN = re.compile(r"=>|\?\.(?!\d)|\.\.\.|\+\+|--|>>>=|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|>=|\*\*|&&|\|\||\?\?|>>>|<<|>>|[-+*/%&|^]=|[^\s]")
#: Words after which a value begins, words whose parentheses a statement follows, and words that are no method's name.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof do else yield await default extends".split())
_HEADS = frozenset("if while for with".split())
_NO_METHOD = _HEADS | frozenset("switch catch function return typeof await yield new super".split())
#: Signs that a line may begin with without beginning a statement, and words that end their statement with the line.
_CONTINUES = frozenset("( [ ` . ?. , ? : = => + - * / % & | ^ < > == != === !== <= >= && || ?? ** << >> >>> += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= in instanceof of".split())
_RESTRICTED = frozenset("return break continue throw".split())
_MODIFIERS = frozenset("static async get set *".split())


class Token(NamedTuple):
    kind: str  # name, number, string, regex, template, sign
    text: str
    line: int
    broken: bool  # a line end stands before it
    opens: str  # what an opening bracket opens: value, head, object, class, function, method, arrow, block, template, index


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    stack: list[str] = []  # what the open brackets open
    at, line, broken = 0, 1, False
    value_ended = False  # whether a value has just ended
    pending: list[tuple[str, int]] = []  # classes and functions whose bodies are to come, and how many brackets are open
    ended = ""  # what the last closing bracket closed

    def add(kind: str, text: str, opens: str = "") -> None:
        nonlocal broken
        out.append(Token(kind, text, line, broken, opens))
        broken = False

    def template(start: int) -> int:
        """A template's text from `start` up to its end or the next code in it."""
        nonlocal line, value_ended
        end = _CHUNK.match(source, start).end()
        line += source.count("\n", start, end)
        if source.startswith("${", end):
            add("sign", "${", "template")
            stack.append("template")
            value_ended = False
            return end + 2
        value_ended = True
        return end + 1

    while at < len(source):
        c = source[at]
        if c == "\n":
            line, broken, at = line + 1, True, at + 1
            continue
        if m := _SKIP.match(source, at):
            n = m[0].count("\n")
            line, broken, at = line + n, broken or n > 0, m.end()
            continue
        before = out[-1] if out else None
        if (c.isdigit() or c == "." and source[at + 1 : at + 2].isdigit()) and (m := _NUMBER.match(source, at)):
            add("number", m[0])
            at, value_ended = m.end(), True
        elif m := _NAME.match(source, at):
            member = before is not None and before.text in (".", "?.")
            add("name", m[0])
            if m[0] in ("class", "function") and not member:
                starts = value_ended or before is None or before.text in (";", "}", ")") or before.text == "{" and before.opens != "object"
                pending.append((m[0] if m[0] == "class" or starts else "function value", len(stack)))
            at, value_ended = m.end(), member or m[0] not in _BEFORE_VALUE
        elif c in "\"'" and (m := _STRING.match(source, at)):
            add("string", m[0])
            line += m[0].count("\n")
            at, value_ended = m.end(), True
        elif c == "`":
            add("template", "`")
            at = template(at + 1)
        elif c == "/" and not value_ended and (m := _REGEX.match(source, at)):
            add("regex", m[0])
            at, value_ended = m.end(), True
        else:
            sign = _SIGN.match(source, at)[0]
            opens, postfix = "", value_ended and not broken
            if sign == "(":
                opens = "head" if before and before.kind == "name" and before.text in _HEADS and (len(out) < 2 or out[-2].text != ".") else "value"
            elif sign == "[":
                opens = "index"
            elif sign == "{":
                if pending and pending[-1][1] == len(stack):
                    opens = pending.pop()[0]
                elif before and before.text == ")" and stack[-1:] in (["class"], ["object"]) and ended == "value":
                    opens = "method"
                elif before and before.text == "=>":
                    opens = "arrow"
                elif before is not None and before.text in ("const", "let", "var", "import", "export"):
                    opens = "object"
                elif before is None or value_ended or before.text in (";", "{", "}", ")", "else", "do", "${") or before.text == ":" and stack[-1:] not in (["object"], ["value"], ["index"]) or before.text in ("try", "finally"):
                    opens = "block"
                else:
                    opens = "object"
            add("sign", sign, opens)
            at += len(sign)
            value_ended = False
            if opens:
                stack.append(opens)
            elif sign in (")", "]", "}") and stack:
                ended = stack.pop()
                if ended == "template":
                    at = template(at)
                else:
                    value_ended = ended in ("value", "index", "object", "function value", "arrow", "class")
            elif sign in ("++", "--"):
                value_ended = postfix
    return out


def _matches(ts: list[Token]) -> list[int]:
    """For each opening bracket the place of its end (the last token's if there is none); others have -1."""
    out, open_ = [-1] * len(ts), []
    for i, t in enumerate(ts):
        if t.opens:
            open_.append(i)
        elif t.kind == "sign" and t.text in (")", "]", "}") and open_:
            out[open_.pop()] = i
    for i in open_:
        out[i] = len(ts)
    return out


class _Statements:
    """Where statements end. Brackets are jumped over, so each token of a body is looked at once for each function around it."""

    def __init__(self, ts: list[Token], ends: list[int]):
        self.ts, self.ends = ts, ends

    def text(self, i: int) -> str:
        return self.ts[i].text if i < len(self.ts) and self.ts[i].kind in ("name", "sign") else ""

    def past(self, i: int, sign: str) -> int:
        """The place after the bracket that opens at i, if it is that sign's."""
        return self.ends[i] + 1 if self.text(i) == sign and self.ends[i] >= 0 else i

    def count(self, low: int, high: int) -> int:
        n = 0
        while low < high:
            low, n = max(self.end(low, high), low + 1), n + 1
        return n

    def end(self, i: int, high: int) -> int:
        """The place after the statement that begins at i."""
        while True:
            t = self.text(i)
            if i + 1 < high and self.ts[i].kind == "name" and self.text(i + 1) == ":" and t not in ("case", "default"):
                i += 2  # a label
            elif t in _HEADS:
                i = self.past(i + 1 + (self.text(i + 1) == "await"), "(")
                if t == "if":
                    i = self.end(i, high) if i < high else i
                    if self.text(i) != "else" or i >= high:
                        return i
                    i += 1
                elif i >= high:
                    return i
            elif t == "do":
                i = self.end(i + 1, high)
                i = self.past(i + 1, "(") if self.text(i) == "while" else i
                return i + (self.text(i) == ";" and i < high)
            elif t == "try":
                i = self.past(i + 1, "{")
                while self.text(i) in ("catch", "finally") and i < high:
                    i = self.past(self.past(i + 1, "("), "{")
                return i
            elif t == "switch":
                return self.past(self.past(i + 1, "("), "{")
            elif t == "{" or t == ";":
                return self.past(i, "{") if t == "{" else i + 1
            elif t in ("function", "class") or t == "async" and self.text(i + 1) == "function":
                while i < high and not (self.text(i) == "{" and self.ts[i].opens in ("function", "function value", "class")):
                    i = self.ends[i] + 1 if self.ends[i] >= 0 else i + 1
                return self.past(i, "{")
            else:
                return self.expression(i, high)

    def expression(self, i: int, high: int) -> int:
        start = i
        while i < high:
            t = self.ts[i]
            if t.text == ";" and t.kind == "sign":
                return i + 1
            if i > start and t.broken:
                last = self.ts[i - 1]
                open_ended = last.kind == "sign" and last.text not in (")", "]", "}") and (last.text not in ("++", "--") or last.broken)
                word = last.kind == "name" and last.text in _BEFORE_VALUE - {"return", "throw", "yield", "default"}
                bare = i - 1 == start and last.kind == "name" and last.text in _RESTRICTED
                if bare or not open_ended and not word and not ((t.kind in ("sign", "template") or t.text in ("in", "instanceof", "of")) and t.text in _CONTINUES):
                    return i
            i = self.ends[i] + 1 if self.ends[i] >= 0 else i + 1
        return i


def javascript_facts(source: str | None) -> dict:
    """functions (name, lineno, length, nesting of blocks, validation callees) in order, and dangerous calls (callee, lineno)."""
    ts = tokens(source or "")
    ends = _matches(ts)
    statements = _Statements(ts, ends)
    functions, calls = [], []
    bodies: list[tuple[int, dict]] = []  # open functions with the places of their ends
    blocks: list[int] = []
    key_of_method: set[int] = set()
    found: dict[int, dict] = {}  # by the place of the body's bracket
    for i, t in enumerate(ts):
        if t.kind == "sign" and t.text == "{" and t.opens in ("function", "function value", "method"):
            # parameters end before the body
            k, depth = i - 1, 0
            while k >= 0:
                if ts[k].text in (")", "]", "}") and ts[k].kind == "sign":
                    depth += 1
                elif ts[k].opens:
                    depth -= 1
                    if depth == 0:
                        break
                k -= 1
            head, name = k, "<anonymous>"
            if t.opens == "method":
                key_of_method.add(k - 1)
            else:
                head = k - 1
                if head >= 0 and ts[head].kind == "name" and ts[head].text != "function":
                    name, head = ts[head].text, head - 1
                if head >= 0 and ts[head].text == "*":
                    head -= 1
                head = max(head, 0)
                if head and ts[head - 1].text == "async":
                    head -= 1
            found[i] = {"name": name, "lineno": ts[max(head, 0)].line, "length": statements.count(i + 1, min(ends[i], len(ts))), "nesting": 0, "validation": [], "level": 0, "at": i}
    for i, t in enumerate(ts):
        while bodies and i >= bodies[-1][0]:
            functions.append(bodies.pop()[1])
        while blocks and i >= blocks[-1]:
            blocks.pop()
        if t.opens in ("block", "arrow", "function", "function value", "method", "class"):
            blocks.append(ends[i])
            for _, f in bodies:
                f["nesting"] = max(f["nesting"], len(blocks) - f["level"])
            if i in found:
                found[i]["level"] = len(blocks)
                bodies.append((ends[i], found[i]))
        elif t.kind == "name" and i + 1 < len(ts) and ts[i + 1].text == "(" and i not in key_of_method:
            before = ts[i - 1] if i else None
            if before is None or before.text not in (".", "?.", "new", "function") and not (before.text == "*" and i > 1 and ts[i - 2].text == "function"):
                if t.text in JS_DANGEROUS:
                    calls.append({"callee": t.text, "lineno": t.line})
                if t.text in JS_VALIDATION:
                    for _, f in bodies:
                        f["validation"].append(t.text)
    functions += [f for _, f in bodies]
    functions.sort(key=lambda f: f["at"])
    return {"functions": [{k: f[k] for k in ("name", "lineno", "length", "nesting", "validation")} for f in functions], "calls": calls}
