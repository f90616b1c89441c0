"""Policy facts of C sources: how status codes map, where code tries again or resumes, what becomes of return values.

There is no grammar here: comments and the insides of strings are blanked, brackets are matched, and statements are read
from tokens. Macros aren't expanded.

Defined cases: a null text has no facts; a function whose bracket never closes reaches to the end of its file; a case
that ends with ``break`` maps to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .detectors import mask_comments

# Endings and parts of names of status types.
STATUS_ENDINGS = ("_res_t", "_result_t", "_status_t", "_code_t", "_error_t", "_ret_t", "_res", "_result", "_status", "_code", "_error", "_ret", "_e")
STATUS_PARTS = ("result", "error", "status", "code")
# Functions that wait, by milliseconds for each unit of their argument; ``poll`` waits by its third.
WAITS = {"sleep": 1000.0, "usleep": 0.001, "nanosleep": None, "Sleep": 1.0}
# What shows that a loop's condition depends on a result.
RESULT_WORDS = ("result", "status", "error", "err", "ret", "rc", "ok", "success", "fail", "code", "state", "try", "attempt", "count")
RESULT_TESTS = ("== 0", "!= 0", "< 0", "> 0", "<= 0", ">= 0", "_ok", "_err", "_fail", "_success")
# Functions whose result is ignored by habit.
HABIT = """free abort exit _Exit quick_exit va_start va_end va_copy perror puts putchar putc fputc fputs printf fprintf sprintf
snprintf vprintf vfprintf vsprintf vsnprintf memcpy memmove memset strcpy strncpy strcat strncat setbuf setvbuf""".split()

_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_WORDS = "if for while do switch return sizeof case else goto break continue default typedef struct union enum".split()
_HEADER = re.compile(r"([A-Za-z_][\w\s*]*?[\s*])(\w+)\s*\(([^(){}]*(?:\([^()]*\)[^(){}]*)*)\)\s*$")
_CLOSES = {"(": ")", "{": "}", "[": "]"}
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|->|<<=|>>=|<<|>>|&&|\|\||[=!<>+*/%&|^-]=|\+\+|--|\S")
_COMPARE, _ASSIGN = ("==", "!=", "<", ">", "<=", ">="), ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=")


@dataclass(frozen=True)
class Function:
    name: str
    returns: str
    parameters: str
    begins: int
    start: int  # of the body, behind its bracket
    stop: int


def plain(text: str) -> str:
    """The text without comments, contents of strings and preprocessor lines; every place stays where it was."""
    text = _STRING.sub(lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1], mask_comments(text, "c"))
    return re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(code: str, at: int) -> int:
    """Where the bracket at a place closes; the end of the code if it doesn't."""
    opens, closes, depth = code[at], _CLOSES[code[at]], 0
    for m in re.compile(f"[{re.escape(opens + closes)}]").finditer(code, at):
        depth += 1 if m[0] == opens else -1
        if not depth:
            return m.start()
    return len(code)


def functions(code: str) -> Iterator[Function]:
    at = since = 0
    while (brace := code.find("{", at)) >= 0:
        since = max(since, code.rfind(";", since, brace) + 1)
        head = code[since:brace]
        stop = closing(code, brace)
        m = _HEADER.search(head)
        if m and m[2] not in _WORDS and "=" not in head:
            yield Function(m[2], " ".join(m[1].replace("*", " * ").split()), m[3], since + m.start(1), brace + 1, stop)
        elif re.search(r"extern\s*\"\s*\"?\s*\"?\s*$", head):
            stop = brace  # look inside a linkage block
        at = since = stop + 1


def _line(code: str, at: int) -> int:
    return code.count("\n", 0, at) + 1


# Status mappings


def _type(words: str) -> str:
    left = [w for w in words.replace("*", " ").split() if w not in ("static", "inline", "extern", "const", "volatile", "struct", "enum", "union", "register")]
    return " ".join(left)


def is_status(name: str) -> bool:
    return name.endswith(STATUS_ENDINGS) or any(p in name.lower() for p in STATUS_PARTS)


def status_mapping(code: str, f: Function) -> tuple | None:
    """(function, line_start, line_end, source type, target type, [(inputs, output)], default)."""
    target = _type(f.returns)
    if not is_status(target):
        return None
    known = {}
    for p in f.parameters.split(","):
        if m := re.match(r"^(.*?)(\*?)\s*(\w+)\s*$", p.strip()):
            known[m[3]] = (_type(m[1]), "*" in p)
    body = code[f.start : f.stop]
    for m in re.finditer(r"\bswitch\s*\(", body):
        if body.count("{", 0, m.start()) != body.count("}", 0, m.start()):
            continue
        shut = closing(body, m.end() - 1)
        asked = re.sub(r"^(?:\(\s*[\w\s]+\**\s*\)\s*)+", "", body[m.end() : shut].strip())
        name = asked.lstrip("* ")
        if name not in known:
            continue
        kind, pointer = known[name]
        if asked.startswith("*") and not pointer:
            continue
        source = f"{kind} *" if pointer and not asked.startswith("*") else kind
        opens = body.find("{", shut)
        if opens < 0:
            continue
        end = closing(body, opens)
        pairs, default = _arms(body[opens + 1 : end])
        if default is None and (back := re.search(r"\breturn\s+([^;]+);", _top(body[end + 1 :]))):
            default = " ".join(back[1].split())
        if pairs:
            return f.name, _line(code, f.begins), _line(code, f.stop), source, target, pairs, default
    return None


def _top(code: str) -> str:
    """Code outside of blocks."""
    out, at = "", 0
    while (brace := code.find("{", at)) >= 0:
        out, at = out + code[at:brace], closing(code, brace) + 1
    return out + code[at:]


def _arms(code: str) -> tuple[list[tuple[list[str], str]], str | None]:
    pairs, default, waiting, open_ = [], None, [], False
    for m in re.finditer(r"\bcase\s+([^:?]+?)\s*:|\b(default)\s*:|\breturn\s+([^;]+);|\b(break)\s*;", code):
        if m[1]:
            waiting, open_ = [*waiting, " ".join(m[1].split())], True
        elif m[2]:
            waiting, open_ = [*waiting, None], True
        elif m[4]:
            waiting, open_ = [], False
        elif open_:
            output = " ".join(m[3].split())
            if None in waiting:
                default = output
            if inputs := [w for w in waiting if w is not None]:
                pairs.append((inputs, output))
            waiting, open_ = [], False
    return pairs, default


# Markers


def _loops(body: str) -> Iterator[tuple[str, int, int, str, str]]:
    """(kind, start, stop, what stands in its brackets, inner code) of every loop, nested ones too."""
    tails = set()
    for m in re.finditer(r"\bdo\b\s*(\{)|\b(for|while)\s*(\()", body):
        if m[1]:
            end = closing(body, m.start(1))
            if tail := re.compile(r"\s*while\s*(\()").match(body, end + 1):
                tails.add(body.find("while", end))
                shut = closing(body, tail.start(1))
                yield "do_while", m.start(), shut, body[tail.end() : shut], body[m.end() : end]
            continue
        if m.start() in tails:
            continue
        shut = closing(body, m.start(3))
        rest = re.compile(r"\s*\{").match(body, shut + 1)
        end = closing(body, rest.end() - 1) if rest else body.find(";", shut + 1)
        yield m[2], m.start(), end if end >= 0 else len(body), body[m.end() : shut], body[rest.end() if rest else shut + 1 : end]


def _wait(code: str) -> tuple[str, int | None] | None:
    for m in re.finditer(rf"\b({'|'.join(WAITS)}|poll)\s*\(", code):
        args = [a.strip() for a in code[m.end() : closing(code, m.end() - 1)].split(",")]
        if m[1] == "poll":
            if len(args) > 2 and args[2].isdigit() and int(args[2]) > 0:
                return "poll", int(args[2])
            continue
        return m[1], int(int(args[0]) * WAITS[m[1]]) if args[0].isdigit() and WAITS[m[1]] else None
    return None


def _attempts(head: str) -> int | None:
    """How often a counting loop runs, if numbers say so."""
    parts = head.split(";")
    first = re.match(r"\s*(?:[\w\s]+\s)(\w+)\s*=\s*(-?\d+)\s*$", parts[0]) if len(parts) == 3 else None
    limit = re.match(r"\s*(\w+)\s*(<=|<|>=|>)\s*(-?\d+)\s*$", parts[1]) if first else None
    if not limit or limit[1] != first[1]:
        return None
    low, high = int(first[2]), int(limit[3])
    n = (high - low if limit[2][0] == "<" else low - high) + limit[2].endswith("=")
    return n if n > 0 else None


def markers(code: str, f: Function) -> Iterator[tuple]:
    """(function, kind, line_start, line_end, loop or option, wait or value, delay_ms, attempts, break condition)."""
    body = code[f.start : f.stop]
    for kind, start, stop, head, inner in _loops(body):
        if not (wait := _wait(inner)):
            continue
        attempts = _attempts(head) if kind == "for" else None
        leave = next((" ".join(inner[m.end() : (shut := closing(inner, m.end() - 1))].split()) for m in re.finditer(r"\bif\s*\(", inner) if re.match(r"\s*\{?[^{}]*?\b(?:break|return|goto)\b", inner[closing(inner, m.end() - 1) + 1 :])), None)
        depends = kind != "for" and any(w in head.lower() for w in (*RESULT_WORDS, *RESULT_TESTS))
        if attempts or leave or depends:
            yield f.name, "RETRY_LOOP", _line(code, f.start + start), _line(code, f.start + stop), kind, *wait, attempts, leave
    for m in re.finditer(r"\bcurl_easy_setopt\s*\(([^,()]*),\s*(CURLOPT_RESUME_FROM\w*)\s*,", body):
        shut = closing(body, body.find("(", m.start()))
        yield f.name, "RESUME_OFFSET", _line(code, f.start + m.start()), _line(code, f.start + shut), m[2], " ".join(body[m.end() : shut].split()), None, None, None


# Return fates


def _levels(code: str, base: int) -> list:
    """Tokens as (text, place) and bracketed groups as (opening, items, place)."""
    root: list = []
    stack = [root]
    for m in _TOKEN.finditer(code):
        t = m[0]
        if t in "([":
            group = (t, [], base + m.start())
            stack[-1].append(group)
            stack.append(group[1])
        elif t in ")]" and len(stack) > 1:
            stack.pop()
        elif t not in ")]":
            stack[-1].append((t, base + m.start()))
    return root


def _is(item, *texts: str) -> bool:
    return len(item) == 2 and item[0] in texts


def _name(item) -> str | None:
    return item[0] if len(item) == 2 and re.match(r"[A-Za-z_]", item[0]) and item[0] not in _WORDS else None


def _show(items: list) -> str:
    out = ""
    for i in items:
        piece = i[0] if len(i) == 2 else i[0] + _show(i[1]) + _CLOSES[i[0]]
        out += (" " if out[-1:].isalnum() and piece[:1].isalnum() else "") + piece
    return out


def _unled(before: list) -> list:
    """A statement's part without the conditions, labels and words that lead to it."""
    labelled = not any(_is(x, "?") for x in before)
    for k in reversed(range(len(before))):
        if _is(before[k], "else", "do") or labelled and _is(before[k], ":") or len(before[k]) == 3 and k and _is(before[k - 1], "if", "while", "for", "switch"):
            return before[k + 1 :]
    return before


def _fate(path: list[tuple[list, int]]) -> tuple[str, str | None]:
    """What becomes of a call, given (items, index) from the innermost level out; the index outside is the group's."""
    for depth, (items, at) in enumerate(path):
        first = at
        if depth == 0:  # a callee may be reached through members
            while first >= 2 and _is(items[first - 1], "->", "."):
                first -= 2
        left = first
        while left > 0 and not _is(items[left - 1], ",", ";", "{", "}"):
            left -= 1
        right = at + (2 if depth == 0 else 1)
        end = right
        while end < len(items) and not _is(items[end], ",", ";", "{", "}"):
            end += 1
        before, after = _unled(items[left:first]), items[right:end]
        if signs := [k for k, x in enumerate(before) if _is(x, *_ASSIGN)]:
            target = before[: signs[-1]]
            for k in reversed(range(len(target))):  # the declared type isn't part of the variable
                if k and _name(target[k]) and (_name(target[k - 1]) or _is(target[k - 1], "*")):
                    target = target[k:]
                    break
            return "STORED", _show(target)
        if before and _is(before[-1], *_COMPARE) or after and _is(after[0], *_COMPARE):
            return "CHECKED", "comparison"
        if any(_is(x, "?") for x in after) and not any(_is(x, "?") for x in before):
            return "CHECKED", "ternary"
        if before and len(before[-1]) == 3 and _show(before[-1][1]) == "void":
            return "IGNORED", "void"
        if before and _is(before[0], "return"):
            return "PROPAGATED", None
        if depth + 1 == len(path):
            return "IGNORED", None
        outer, group = path[depth + 1]
        opener = outer[group - 1] if group else None
        if opener is not None and _is(opener, "if", "while", "switch"):
            return "CHECKED", opener[0]
        if opener is not None and _is(opener, "for"):
            return ("CHECKED", "for") if sum(_is(x, ";") for x in items[:at]) == 1 else ("IGNORED", None)
        if opener is not None and _name(opener):
            return "TRANSFORMED", _name(opener)
    return "IGNORED", None


def return_fates(code: str, f: Function) -> Iterator[tuple]:
    """(caller, callee, line, fate, detail, direct) of each call in order."""

    def look(items: list, outer: list[tuple[list, int]]) -> Iterator[tuple]:
        for k, item in enumerate(items):
            if len(item) == 3:
                callee = _name(items[k - 1]) if k and item[0] == "(" else None
                # A name behind another is a declaration's, not a call's.
                if callee and callee not in HABIT and not (k > 1 and _name(items[k - 2])):
                    direct = not (k > 1 and _is(items[k - 2], "->", "."))
                    yield items[k - 1][1], callee, *_fate([(items, k - 1), *outer]), direct
                yield from look(item[1], [(items, k), *outer])

    for at, callee, fate, detail, direct in sorted(look(_levels(code[f.start : f.stop], f.start), []), key=lambda x: x[0]):
        yield f.name, callee, _line(code, at), fate, detail, direct


# Over a table


def _each(files: DataFrame, find, schema: str) -> DataFrame:
    import pandas as pd

    names = [c.split()[0] for c in schema.replace("array<struct<inputs:array<string>,output:string>>", "x").split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                code = plain(text or "")
                made = list(functions(code))
                out += [(path, *row) for f in made for row in find(code, f, {x.name for x in made})]
            yield pd.DataFrame(out, columns=names)

    return files.filter("language in ('c', 'cpp')").select("path", "text").mapInPandas(run, schema)


def status_mappings(files: DataFrame) -> DataFrame:
    """Functions that turn one status type into another by a switch over a parameter. ``files``: path, language, text."""

    def find(code, f, known):
        if found := status_mapping(code, f):
            *rest, pairs, default = found
            yield *rest, [{"inputs": i, "output": o} for i, o in pairs], default

    return _each(files, find, "path string, function_name string, line_start long, line_end long, source_type string, target_type string, mappings array<struct<inputs:array<string>,output:string>>, default_output string")


def behavioral_markers(files: DataFrame) -> DataFrame:
    """Loops that wait and try again, and transfers that resume at an offset."""
    return _each(files, lambda code, f, known: markers(code, f), "path string, function_name string, kind string, line_start long, line_end long, form string, value string, delay_ms long, max_attempts long, break_condition string")


def fates(files: DataFrame) -> DataFrame:
    """What each call's result becomes; ``own`` if the callee is a function of the same file."""

    def find(code, f, known):
        for caller, callee, line, fate, detail, direct in return_fates(code, f):
            yield caller, callee, line, fate, detail, direct and callee in known

    return _each(files, find, "path string, caller string, callee string, line long, fate string, detail string, own boolean")
