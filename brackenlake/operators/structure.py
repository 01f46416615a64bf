"""Code as a token stream with its bracket and indent forest: symbols with spans and parents, calls in their innermost function, structural patterns.

A file is read once. Strings and comments are no brackets; each bracket knows its partner; in
languages of indentation a line that ends in a colon opens a block. Files stand alone, so Spark
deals them to tasks as they are read, and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V

FILE = ["repository_id", "path"]
#: Languages whose blocks are told by indentation, and whose comments begin with #.
INDENTED = ("python",)
HASHED = ("python", "ruby", "shell", "yaml", "toml")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}

_STRINGS = r'"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`'
#: A quote in Rust may begin a lifetime.
_QUOTED = {"rust": r"'(?:\\.[^'\n]*|[^'\\\n])'|'[A-Za-z_]\w*"}
_WORDS = r"\$\$\$[A-Z_]*|\$[A-Z_][A-Z0-9_]*|[^\W\d]\w*|\d[\w.]*|::|->|=>|[^\w\s]"


def _scanner(language: str) -> re.Pattern:
    comments = r"#[^\n]*" if language in HASHED else r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
    quoted = _QUOTED.get(language, r"'(?:\\.|[^'\\\n])*'")
    return re.compile(rf"(?P<skip>{comments})|(?P<string>{_STRINGS}|{quoted})|(?P<word>{_WORDS})")


_SCANNERS: dict[str, re.Pattern] = {}


@dataclass
class Tokens:
    """The tokens of a text: their texts, begins and ends, the partner of each bracket (or -1), the bracket around each (or -1), and where lines begin."""

    language: str
    text: str
    word: list[str]
    start: list[int]
    end: list[int]
    partner: list[int]
    around: list[int]
    lines: list[int]

    def line(self, token: int) -> int:
        return bisect_right(self.lines, self.start[token])

    def indent(self, token: int) -> int:
        """Columns before the first token of its line."""
        begin = self.lines[self.line(token) - 1]
        rest = self.text[begin : self.start[token]]
        return len(rest) - len(rest.lstrip(" \t"))

    def leads(self, token: int) -> bool:
        """Whether it is the first of its line."""
        return token == 0 or self.line(token - 1) != self.line(token)

    def block_end(self, token: int) -> int:
        """The last token of the indented block whose head holds a token: before the next line that is not deeper, brackets aside."""
        while token > 0 and not self.leads(token):
            token -= 1
        depth, at = self.indent(token), token + 1
        while at < len(self.word):
            if self.partner[at] > at:
                at = self.partner[at] + 1
            elif self.leads(at) and self.indent(at) <= depth:
                break
            else:
                at += 1
        return min(at, len(self.word)) - 1


def tokenize(text: str | None, language: str | None) -> Tokens:
    """One scan; a bracket that its like does not close is no bracket."""
    text, language = text or "", language or ""
    scanner = _SCANNERS.setdefault(language, _scanner(language))
    word, start, end, partner, around, stack = [], [], [], [], [], []
    for m in scanner.finditer(text):
        if m.lastgroup == "skip":
            continue
        i, w = len(word), m[0]
        word.append(w)
        start.append(m.start())
        end.append(m.end())
        partner.append(-1)
        if w in _CLOSE:
            below = next((k for k in range(len(stack) - 1, -1, -1) if word[stack[k]] == _CLOSE[w]), None)
            if below is not None:
                partner[i], partner[stack[below]] = stack[below], i
                del stack[below:]
        around.append(stack[-1] if stack else -1)
        if w in _OPEN:
            stack.append(i)
    lines = [0] + [m.end() for m in re.finditer("\n", text)]
    return Tokens(language, text, word, start, end, partner, around, lines)


# --- symbols --------------------------------------------------------------------------------------

#: Words that name a symbol after them, with its kind, and words that may stand before.
KINDS = {
    "fn": "function", "def": "function", "function": "function", "func": "function", "fun": "function", "struct": "struct", "class": "class", "interface": "interface", "enum": "enum",
    "trait": "trait", "impl": "impl", "type": "type", "mod": "module", "namespace": "module", "module": "module", "record": "class", "object": "class",
}
BEFORE = {"pub", "public", "private", "protected", "internal", "export", "declare", "default", "async", "static", "abstract", "sealed", "final", "unsafe", "const", "override", "virtual", "partial"}
#: Of these languages a type and a name before brackets and a body are a function.
TYPED = ("csharp", "java")
_NAME = re.compile(r"[^\W\d]\w*\Z")


def _body(t: Tokens, at: int, stop: int) -> tuple[int, int] | None:
    """The braces of the first body from a token on, before a semicolon or the end of what is around."""
    around = t.around[at]
    while at < stop and t.word[at] != ";":
        if t.word[at] == "{" and t.partner[at] > at:
            return at, t.partner[at]
        if t.word[at] in _CLOSE and t.around[at] == around and t.partner[at] < at and t.partner[at] == around:
            return None
        at = t.partner[at] + 1 if t.partner[at] > at else at + 1
    return None


def _definition(t: Tokens, i: int) -> tuple[str, str, int, int] | None:
    """(name, kind, first token, last token) of a symbol that token i tells, or None."""
    w, n = t.word, len(t.word)
    kind = KINDS.get(w[i])
    name = i + 1
    if kind and name < n and (i == 0 or w[i - 1] not in (".", "::", "->")):
        if w[i] == "impl":
            if w[name] == "<":  # its parameters
                deep = 0
                while name < n and not (w[name] == ">" and deep == 1):
                    deep += (w[name] == "<") - (w[name] == ">")
                    name += 1
                name += 1
            stop = next((k for k in range(name, n) if w[k] in ("{", ";")), n)
            over = next((k for k in range(name, stop) if w[k] == "for"), None)
            name = over + 1 if over is not None else name
        if name >= n or not _NAME.match(w[name]) or w[name] in KINDS:
            return None
        if kind == "type" and not (name + 1 < n and w[name + 1] in ("=", "<", "struct", "interface")):
            return None
        if kind == "function" and not (name + 1 < n and w[name + 1] in ("(", "<", "[")):
            return None
    elif w[i] == "=" and i + 1 < n and i >= 2 and w[i - 2] in ("const", "let", "var") and _NAME.match(w[i - 1]):
        at = i + 1 + (w[i + 1] == "async")
        arrow = at < n and (w[at] == "function" or t.partner[at] > at and w[at] == "(" and t.partner[at] + 1 < n and w[t.partner[at] + 1] in ("=>", ":"))
        if not arrow:
            return None
        kind, name, i = "function", i - 1, i - 2
    elif t.language in TYPED and w[i] == "(" and i >= 2 and t.partner[i] > i and _NAME.match(w[i - 1]) and w[i - 1] not in V.CALL_KEYWORDS and t.partner[i] + 1 < n and w[t.partner[i] + 1] in ("{", "=>", "where", "throws"):
        if not (_NAME.match(w[i - 2]) or w[i - 2] in (">", "]", "?")) or w[i - 2] in ("new", "return", "await", "else"):
            return None
        kind, name, i = "function", i - 1, i - 2
    else:
        return None
    first = i
    while first > 0 and (w[first - 1] in BEFORE or t.language in TYPED and kind == "function" and t.line(first - 1) == t.line(i) and w[first - 1] not in (";", "{", "}")):
        first -= 1
    if t.language in INDENTED:
        return w[name], kind, first, t.block_end(i)
    body = _body(t, name, n)
    if body:
        return w[name], kind, first, body[1]
    around = t.around[name]
    limit = t.partner[around] if around >= 0 and t.partner[around] > around else n
    return w[name], kind, first, next((k for k in range(name, limit) if w[k] == ";" and t.around[k] == around), name)


def symbols_of(t: Tokens) -> list[tuple[str, str, int, int, int]]:
    """(name, kind, first token, last token, place of the parent in this list or -1), in order."""
    out: list[tuple[str, str, int, int, int]] = []
    held: list[int] = []
    for i in range(len(t.word)):
        found = _definition(t, i)
        if found is None:
            continue
        name, kind, first, last = found
        while held and out[held[-1]][3] < first:
            held.pop()
        out.append((name, kind, first, last, held[-1] if held else -1))
        held.append(len(out) - 1)
    return out


def calls_of(t: Tokens, symbols: list) -> list[tuple[int, str, str]]:
    """(line, callee, caller): names before brackets that are no keyword and no definition, in the innermost function around, or 'unknown'; one walk beside the spans."""
    named = set()
    for name, kind, first, last, _ in symbols:
        named.add(next(k for k in range(first, last + 1) if t.word[k] == name and (k == 0 or t.word[k - 1] != name)))
    functions = [(f, l_, n) for n, kind, f, l_, _ in symbols if kind == "function"]
    out, held, k = [], [], 0
    for i in range(len(t.word) - 1):
        while k < len(functions) and functions[k][0] <= i:
            held.append(functions[k])
            k += 1
        while held and held[-1][1] < i:
            held.pop()
        w = t.word[i]
        if t.word[i + 1] == "(" and t.start[i + 1] - t.end[i] < 2 and _NAME.match(w) and len(w) > 1 and i not in named and w not in V.CALL_KEYWORDS:
            out.append((t.line(i), w, held[-1][2] if held else "unknown"))
    return out


# --- patterns -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """A pattern's tokens; $NAME is one operand, $$$NAME any number of tokens within its brackets."""

    text: str
    words: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return sorted({w.lstrip("$") for w in self.words if w.startswith("$") and w.lstrip("$")})


def compile_pattern(pattern: str, language: str = "") -> Pattern:
    return Pattern(pattern, tuple(tokenize(pattern, language).word))


#: Tokens that carry an operand on: members, paths, generic parameters, references.
_JOINS = (".", "::", "?", "!", "<", ">", "&", "*", "-")


def _ends(t: Tokens, at: int, limit: int):
    """Where an operand that begins at a token may end, the shortest first."""
    k = at
    while k < limit:
        w = t.word[k]
        if t.partner[k] > k and w != "{":
            k = t.partner[k] + 1
            yield k
        elif w in _JOINS:
            k += 1
            if w == ">":
                yield k
        elif w[0] in "\"'`" or w[0].isalnum() or w[0] == "_":
            k += 1
            yield k
        else:
            return
        if k < limit and t.word[k] not in _JOINS and not (t.word[k] in "([" and t.partner[k] > k) and t.word[k - 1] not in _JOINS:
            return


def match_at(p: Pattern, t: Tokens, at: int) -> tuple[int, dict[str, str]] | None:
    """(end, captures) of a match that begins at a token, or None. A name that stands twice holds the same tokens; a bracket of the pattern closes where its partner does."""
    words = p.words
    limit_of = lambda k: t.partner[t.around[k]] if k < len(t.word) and t.around[k] >= 0 else len(t.word)

    def text(a, b):
        return t.text[t.start[a] : t.end[b - 1]] if b > a else ""

    def go(i: int, k: int, limit: int, opened: tuple, held: dict):
        if i == len(words):
            return k, held
        w = words[i]
        if w.startswith("$$$"):
            name, last = w[3:], i + 1 == len(words)
            end = k
            stop = limit
            if last and t.language in INDENTED and k > 0 and t.word[k - 1] == ":":
                stop = t.block_end(k - 1) + 1
            tries = []
            while True:
                tries.append(end)
                if end >= stop or t.partner[end] >= 0 and t.partner[end] < end:
                    break
                end = t.partner[end] + 1 if t.partner[end] > end else end + 1
            for e in tries[::-1] if last else tries:
                mine = text(k, e)
                if name and held.get(name, mine) != mine:
                    continue
                got = go(i + 1, e, limit, opened, held | ({name: mine} if name else {}))
                if got:
                    return got
            return None
        if k >= limit and not (w in _CLOSE and k == limit):
            return None
        if k >= len(t.word):
            return None
        if w.startswith("$"):
            name = w[1:]
            for e in _ends(t, k, limit):
                mine = [*t.word[k:e]]
                if name in held and tokenize(held[name], t.language).word != mine:
                    continue
                got = go(i + 1, e, limit, opened, held if name in held else held | {name: text(k, e)})
                if got:
                    return got
            return None
        if t.word[k] != w:
            return None
        if w in _OPEN and t.partner[k] > k:
            return go(i + 1, k + 1, t.partner[k], (*opened, (k, limit)), held)
        if w in _CLOSE and t.partner[k] >= 0:
            if not opened or t.partner[k] != opened[-1][0]:
                return None
            return go(i + 1, k + 1, opened[-1][1], opened[:-1], held)
        return go(i + 1, k + 1, limit, opened, held)

    return go(0, at, limit_of(at), (), {}) if words else None


def matches_of(p: Pattern, t: Tokens):
    """(line, first token, end, captures) of each match in order; a match begins after the head of the one before."""
    if not p.words:
        return
    lead = None if p.words[0].startswith("$") else p.words[0]
    rest = next((w for w in p.words if not w.startswith("$")), None)
    if rest is not None and rest not in t.word:
        return
    taken = -1
    for k in range(len(t.word)):
        if lead is not None and t.word[k] != lead or k <= taken:
            continue
        if lead is None and (k and t.word[k - 1] in _JOINS or not (t.word[k][0].isalnum() or t.word[k][0] in "_\"'`")):
            continue
        found = match_at(p, t, k)
        if found:
            yield t.line(k), k, *found
            taken = k if lead is not None else next((j for j in range(k, found[0]) if t.word[j] in _OPEN), k)


#: What is asked for by kind and language; '' stands for all other languages.
KIND_PATTERNS = {
    "function": {"rust": ["fn $NAME($$$) { $$$ }", "fn $NAME($$$) -> $RET { $$$ }"], "python": ["def $NAME($$$): $$$"], "go": ["func $NAME($$$) { $$$ }"], "java": ["public $RET $NAME($$$) { $$$ }"], "csharp": ["public $RET $NAME($$$) { $$$ }"], "kotlin": ["fun $NAME($$$) { $$$ }"], "": ["function $NAME($$$) { $$$ }"]},
    "class": {"rust": ["struct $NAME { $$$ }"], "python": ["class $NAME: $$$"], "go": ["type $NAME struct { $$$ }"], "": ["class $NAME { $$$ }"]},
    "method": {"rust": ["impl $TYPE { fn $NAME($$$) { $$$ } }", "impl $TYPE { fn $NAME($$$) -> $RET { $$$ } }"], "": ["function $NAME($$$) { $$$ }"]},
    "impl": {"rust": ["impl $TYPE { $$$ }"]},
    "trait": {"rust": ["trait $NAME { $$$ }"], "": ["interface $NAME { $$$ }"]},
    "interface": {"rust": ["trait $NAME { $$$ }"], "": ["interface $NAME { $$$ }"]},
    "enum": {"": ["enum $NAME { $$$ }"]},
    "module": {"rust": ["mod $NAME { $$$ }"]},
    "call": {"": ["$OBJ.$METHOD($$$)", "$FUNC($$$)"]},
    "import": {"rust": ["use $MODULE;", "use $MODULE::$$$;"], "python": ["import $MODULE", "from $MODULE import $$$"], "javascript": ["import $MODULE from $PATH", "import { $$$ } from $PATH"], "go": ['import "$PATH"'], "java": ["import $MODULE;"], "kotlin": ["import $MODULE"], "csharp": ["using $MODULE;"]},
    "extends": {"python": ["class $NAME($BASE): $$$"], "javascript": ["class $NAME extends $BASE { $$$ }"], "java": ["class $NAME extends $BASE { $$$ }"], "kotlin": ["class $NAME extends $BASE { $$$ }"], "csharp": ["class $NAME : $BASE { $$$ }"]},
}
KIND_PATTERNS["implements"] = KIND_PATTERNS["extends"]
_LIKE = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript"}
#: Kinds that other languages have no pattern of.
_ALONE = ("impl", "module", "import", "extends", "implements")


def patterns_for(kind: str, language: str | None) -> list[str]:
    """The patterns of a kind in a language."""
    by = KIND_PATTERNS.get(kind, {})
    language = language or ""
    return by.get(language) or by.get(_LIKE.get(language, language)) or ([] if kind in _ALONE else by.get("", []))


# --- over files ---------------------------------------------------------------------------------


def _by_file(corpus: DataFrame, each, columns: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows that each(tokens, row) gives of every file, beside its name."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                t = tokenize(row.content, row.language)
                out += [(row.repository_id, row.path, *x) for x in each(t, row)]
            yield pd.DataFrame(out, columns=[*FILE, *names])

    return corpus.select(*FILE, "language", "content", *more).mapInPandas(run, f"repository_id string, path string, {columns}")


def spans(corpus: DataFrame) -> DataFrame:
    """(repository_id, path, name, kind, line_start, line_end, parent): all symbols, their lines from 1, and the name of the symbol around, or null."""

    def each(t, _):
        found = symbols_of(t)
        return [(n, k, t.line(a), t.line(b), found[p][0] if p >= 0 else None) for n, k, a, b, p in found]

    return _by_file(corpus, each, "name string, kind string, line_start int, line_end int, parent string")


def scoped_calls(corpus: DataFrame) -> DataFrame:
    """(repository_id, path, line, callee, caller): calls in their innermost function, or in 'unknown'."""
    return _by_file(corpus, lambda t, _: calls_of(t, symbols_of(t)), "line int, callee string, caller string")


def call_edges(calls: DataFrame, spans_: DataFrame) -> DataFrame:
    """(repository_id, caller_path, caller, callee_path, callee): calls to the first file by path that defines their name; others are left out."""
    first = spans_.where("kind = 'function'").groupBy("repository_id", F.col("name").alias("callee")).agg(F.min("path").alias("callee_path"))
    out = calls.join(first, ["repository_id", "callee"])
    return out.select("repository_id", F.col("path").alias("caller_path"), "caller", "callee_path", "callee").distinct()


_MATCH = "pattern string, nth int, line int, line_end int, matched string, captures map<string,string>, score double"


def _scored(p: Pattern, matched: str, captures: dict) -> float:
    bonus = 0.1 if len(matched) > 100 else 0.05 if len(matched) > 50 else 0.0
    return min(1.0, 0.85 + bonus + 0.05 * p.text.count("$") + 0.05 * len(captures))


def matches(corpus: DataFrame, patterns: list[str] | None = None, kind: str | None = None, first: bool = False) -> DataFrame:
    """(repository_id, path, pattern, nth, line, line_end, matched, captures, score): matches of patterns, or of a kind's patterns in each file's language.

    captures are sorted by name; with first, a file gives its first match by line, then by pattern.
    """
    compiled: dict = {}

    def each(t, row):
        found = []
        for n, x in enumerate(patterns if patterns is not None else patterns_for(kind, row.language)):
            p = compiled.setdefault((x, t.language), compile_pattern(x, t.language))
            for line, a, b, held in matches_of(p, t):
                whole = t.text[t.start[a] : t.end[b - 1]]
                found.append((line, n, a, (x, line, t.line(b - 1), whole, dict(sorted(held.items())), _scored(p, whole, held))))
        found.sort(key=lambda y: y[:3])
        return [(x, i, *rest) for i, (_, _, _, (x, *rest)) in enumerate(found[:1] if first else found)]

    return _by_file(corpus, each, _MATCH)


def matches_in(corpus: DataFrame, candidates: DataFrame, most: int | None = None, **asked) -> DataFrame:
    """matches() in candidate files (repository_id, path) alone; most: so many of them, by file and place, at most."""
    found = matches(corpus.join(candidates.select(*FILE).distinct(), FILE, "left_semi"), **asked)
    return found if most is None else found.orderBy(*FILE, "nth").limit(most)


def valid(pattern: str) -> bool:
    """A pattern that has tokens, and brackets that close each other."""
    t = tokenize(pattern, "")
    return bool(t.word) and all(t.partner[i] >= 0 for i, w in enumerate(t.word) if w in _OPEN or w in _CLOSE)


def kind_column(kind: Column) -> Column:
    """Kinds of a request's words as kinds of patterns."""
    return F.when(kind == "struct", "class").otherwise(kind)


# --- imports ------------------------------------------------------------------------------------


def _paths_of(t: Tokens, at: int, stop: int, head: str = "") -> list[str]:
    """The paths of a use from a token on: a::{b, c::d} gives a::b and a::c::d; names after as are left out."""
    out, path = [], head
    while at < stop:
        w = t.word[at]
        if w == "{" and t.partner[at] > at:
            inner = at + 1
            while inner < t.partner[at]:
                end = next((k for k in range(inner, t.partner[at]) if t.word[k] == "," and t.around[k] == at), t.partner[at])
                out += _paths_of(t, inner, end, path)
                inner = end + 1
            return out
        if w == "as":
            break
        if w == "::" or _NAME.match(w):
            path += w
        else:
            break
        at += 1
    return [path] if path and path != head else out


def imports_of(t: Tokens) -> set[str]:
    """What a file imports, over as many lines as it takes: use and mod of Rust, import and from of Python, import, export from and require of scripts, using of C#."""
    w, n, out = t.word, len(t.word), set()
    for i in range(n - 1):
        if t.language == "rust" and w[i] == "use" and (t.leads(i) or w[i - 1] in ("pub", ")", ";", "{", "}")):
            stop = next((k for k in range(i, n) if w[k] == ";"), n)
            out |= {p.rstrip(":") for p in _paths_of(t, i + 1, stop)}
        elif t.language == "rust" and w[i] == "mod" and i + 2 < n and w[i + 2] == ";" and _NAME.match(w[i + 1]):
            out.add(w[i + 1])
        elif t.language == "python" and w[i] in ("import", "from") and t.leads(i):
            line, at, path = t.line(i), i + 1, ""
            while at < n and t.line(at) == line:
                if w[i] == "from" and w[at] == "import" or w[at] == "as" and not path:
                    break
                if w[at] == "," or w[at] == "as":
                    out |= {path} - {""}
                    path, at = "", at + (2 if w[at] == "as" else 1)
                    continue
                if w[at] not in (".", "(", ")") and not re.match(r"\w", w[at]):
                    path = "" if w[i] == "from" else path
                    break
                path += w[at]
                at += 1
            out |= {path} - {""}
        elif t.language in ("typescript", "javascript", "tsx", "jsx"):
            if w[i] in ("import", "export") and (t.leads(i) or w[i - 1] in (";", "}")):
                for k in range(i + 1, n):
                    if w[k] == ";" or k > i + 1 and t.leads(k) and w[k] in ("import", "export", "const", "let", "function", "class"):
                        break
                    if w[k][0] in "\"'" and w[k - 1] in ("from", "import"):
                        out.add(w[k][1:-1])
                        break
            elif w[i] in ("require", "import") and w[i + 1] == "(" and i + 2 < n and w[i + 2][0] in "\"'" and t.partner[i + 1] == i + 3:
                out.add(w[i + 2][1:-1])
        elif t.language == "csharp" and w[i] == "using" and t.leads(i):
            stop = next((k for k in range(i, n) if w[k] in (";", "(", "=")), n)
            if stop < n and w[stop] == ";":
                out.add("".join(w[i + 1 : stop]).removeprefix("static"))
    return out - {""}


def imports(corpus: DataFrame) -> DataFrame:
    """(repository_id, path, language, source): each import of each file once."""
    return _by_file(corpus, lambda t, row: [(row.language, x) for x in sorted(imports_of(t))], "language string, source string")
