"""Function definitions of C-like and Python programs by their structure, in one pass over the text."""

from __future__ import annotations

import ast
import re

#: What holds no structure: literals, raw ones too, comments and preprocessor lines.
OPAQUE = re.compile(r"""\b(?:u8|[uUL])?R"(?P<d>[^\s()\\"]{0,16})\(.*?(?:\)(?P=d)"|\Z)|//[^\n]*|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'(?:[^'\\\n]|\\.){1,8}'|^[ \t]*#(?:[^\n\\]|\\.)*+""", re.S | re.M)
#: Words that open a block that is no function.
BLOCKS = frozenset(["if", "for", "while", "switch", "catch", "do", "else", "try", "return", "namespace", "class", "struct", "union", "enum", "extern", "case", "default"])
NAME = re.compile(r"(operator\s*(?:\(\s*\)|\[\s*\]|[^\s\w(]+|\s[\w:<>*& ]+?)|~?\w+)\s*$")
#: A head whose parameters are names alone, and a declaration of them, as in definitions of the old style.
OLD_STYLE = re.compile(r"[\w\s*:]*\b\w+\s*\(\s*\w+(?:\s*,\s*\w+)*\s*\)\s*\w[\w\s*,\[\]]*\s[\w\s*,\[\]]*\Z")
DECLARED = re.compile(r"\s*[A-Za-z_]\w*[\s*][\w\s*,\[\]()]*\Z")
WRAPPED = re.compile(r"(?:\(\s*[*&]+\s*(?:const\s+)?)+(?:\w+\s*::\s*)*(~?\w+)")


TEMPLATE = re.compile(r"\s*template\s*<")


def past_templates(head: str) -> str:
    """A head without the template parameters before it; what stands in parentheses there closes none."""
    at = 0
    while m := TEMPLATE.match(head, at):
        angles, deep = 1, 0
        for x in re.compile("[<>()]").finditer(head, m.end()):
            c = x.group()
            deep = deep + 1 if c == "(" else max(0, deep - 1) if c == ")" else deep
            if not deep and c in "<>":
                angles += 1 if c == "<" else -1
            if not angles:
                break
        if angles:
            return head
        at = x.end()
    return head[at:]


def name_of(head: str) -> str | None:
    """The function that the text before a body declares: `b` of `int *A::b(...)`, `f` of `int (*f(int))[3]`."""
    head = re.sub(r"\b(?:public|private|protected)\s*:(?!:)", " ", past_templates(head)).strip()
    first = re.match(r"~?\w+", head)
    if not first or first.group() in BLOCKS or "(" not in head:
        return None
    before, _, after = head.partition("(")
    if before.rstrip().endswith("operator"):
        return "operator()"
    if "=" in before.replace("==", "").replace("operator=", "") or "[" in before.replace("operator[", ""):
        return None
    own = NAME.search(before)
    wrapped = WRAPPED.match("(" + after)
    if wrapped:
        return wrapped.group(1)
    if not own or own.group(1) in BLOCKS or own.group(1).isdigit():
        return None
    return own.group(1)


def blank(m: re.Match) -> str:
    """As many spaces, with the line ends where they were."""
    return "\n".join([" " * len(x) for x in m.group().split("\n")])


def c_definitions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of every definition at any depth, in order; an open body ends with the text. Between an old-style
    head and its body stand declarations of its parameters."""
    plain = OPAQUE.sub(blank, text)
    out: list[tuple[int, int, str]] = []
    open_: list[int] = []  # for each open brace its definition's place in out, or -1
    begin, deep = 0, 0
    since = -1  # where the last declaration after an old-style head ends, or -1
    for m in re.finditer(r"[{}();]", plain):
        c, at = m.group(), m.start()
        if c == "(":
            deep += 1
        elif c == ")":
            deep = max(0, deep - 1)
        elif c == "{":
            begin, since = since if since >= 0 and plain[since:at].strip() else begin, -1
            head = plain[begin:at]
            name = name_of(head) if deep == 0 else None
            if name:
                own = re.sub(r"^(?:\s|(?:public|private|protected)\s*:(?!:))*", "", head)
                out.append((at - len(own), len(text), name))
            open_.append(len(out) - 1 if name else -1)
            begin = at + 1
        elif c == "}":
            i = open_.pop() if open_ else -1
            if i >= 0:
                out[i] = (out[i][0], at + 1, out[i][2])
            begin, deep, since = at + 1, 0, -1
        elif deep == 0 and since >= 0 and DECLARED.match(plain, since, at):
            since = at + 1
        elif deep == 0:
            start = since if since >= 0 else begin
            old = plain.find("(", start, at) >= 0 and OLD_STYLE.match(plain, start, at)
            begin, since = (start, at + 1) if old else (at + 1, -1)
    return out


def python_definitions(text: str) -> list[tuple[int, int, str]]:
    """The same for Python; a text that does not parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = [0]
    for line in text.split("\n"):
        lines.append(lines[-1] + len(line) + 1)
    column = lambda line, utf8: len(text[lines[line - 1] : lines[line] - 1].encode()[:utf8].decode(errors="ignore"))
    place = lambda line, utf8: lines[line - 1] + column(line, utf8)
    found = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    return sorted((place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset), n.name) for n in found)


def definitions(text: str, language: str) -> list[tuple[int, int, str]]:
    return python_definitions(text) if language == "python" else c_definitions(text)
