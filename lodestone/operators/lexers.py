"""Error-tolerant extraction of symbols from one source text, a function for each language.

Every function gives (kind, name) pairs: import, import_local, function,
container, reference.  Comments and string contents are first blanked by a
mask of the same length, so structure is read from the mask and names and paths
from the text itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

Fact = tuple[str, str]

_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def mask(code: str, tokens: re.Pattern[str]) -> str:
    """tokens: group ``c`` is blanked whole; of group ``s`` the first and the last character stay."""

    def cover(m: re.Match[str]) -> str:
        if m.lastgroup == "c":
            return _blank(m[0])
        return m[0][0] + _blank(m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0]

    return tokens.sub(cover, code)


def closing(masked: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``; the text's end if none does."""
    depth, opener = 0, masked[at]
    closer = _PAIRS[opener]
    for m in re.compile(re.escape(opener) + "|" + re.escape(closer)).finditer(masked, at):
        depth += 1 if m[0] == opener else -1
        if not depth:
            return m.start()
    return len(masked)


# --- Python ---------------------------------------------------------------------------------------

PY_TOKENS = re.compile(r"""(?P<c>\#[^\n]*)|(?P<s>(?:\b[rRbBuUfF]{1,2})?(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?))""", re.S)
PY_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
PY_IMPORT = re.compile(r"(?:^|[;:])\s*(import\b|from\b(?=[^=]*\bimport\b))")


def logical_lines(masked: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each logical line: brackets and backslashes join lines."""
    depth, start = 0, 0
    for m in re.finditer(r"[(\[{]|[)\]}]|\\\n|\n", masked):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c == "\n" and not depth:
            yield start, m.start()
            start = m.end()
    yield start, len(masked)


def _py_names(part: str) -> Iterator[tuple[str, bool]]:
    """(dotted name, has an alias) of a comma list."""
    for item in part.split(","):
        words = item.split()
        if words and re.fullmatch(r"[\w.]+", words[0]) and words[0] != "*":
            yield words[0], len(words) > 1 and words[1] == "as"


def _py_import(statement: str) -> Iterator[str]:
    text = re.sub(r"\\\n|[()]", " ", statement)
    text = re.sub(r"\s*\.\s*", ".", text) if re.search(r"\w\s+\.|\.\s+\w", text) and not text.lstrip().startswith("from") else text
    if m := re.match(r"\s*import\b(.*)", text, re.S):
        yield from (name for name, _ in _py_names(m[1]))
        return
    m = re.match(r"\s*from\s*(\.*)\s*([\w.]*)\s*import\b(.*)", text, re.S)
    if not m:
        return
    dots, module, rest = m[1], m[2], m[3]
    last, marks = module if not dots else "", (1 + bool(module)) if dots else 0
    if dots or module:
        yield dots + module
    for name, alias in _py_names(rest):
        if not alias:
            last = name
            yield name
        elif marks:
            yield "." * marks + name
        elif last:
            yield last


def _py_references(code: str, masked: str, skip: list[tuple[int, int]]) -> Iterator[str]:
    """Text of every attribute and call that begins at a name or a string."""
    inside, k = skip, 0
    for m in re.finditer(r"(?<![\w.])(?:[A-Za-z_]\w*|[\"'](?: |\n)*[\"'])", masked):
        while k < len(inside) and inside[k][1] <= m.start():
            k += 1
        if k < len(inside) and inside[k][0] <= m.start():
            continue
        word = m[0]
        if word in PY_KEYWORDS or re.search(r"\b(?:def|class)\s+$", masked[max(0, m.start() - 16) : m.start()]):
            continue
        at = m.end()
        while True:
            if name := re.compile(r"\s*\.\s*[A-Za-z_]\w*").match(masked, at):
                at, kind = name.end(), "attribute"
            elif (bracket := re.compile(r"[ \t]*[(\[]").match(masked, at)) and at < len(masked):
                kind = "call" if bracket[0][-1] == "(" else "item"
                at = min(len(masked), closing(masked, bracket.end() - 1) + 1)
            else:
                break
            if kind != "item":
                text = code[m.start() : at]
                if not text.startswith("_"):
                    yield text


def python_facts(code: str) -> Iterator[Fact]:
    masked = mask(code, PY_TOKENS)
    blocks: list[tuple[int, str]] = []
    imports: list[tuple[int, int]] = []
    decorated = False
    for start, end in logical_lines(masked):
        line = masked[start:end]
        if not line.strip():
            continue
        indent = len(line[: len(line) - len(line.lstrip())].expandtabs(8).rpartition("\n")[2])
        while blocks and blocks[-1][0] >= indent:
            blocks.pop()
        if m := re.match(r"\s*(?:async\s+)?def\s+(\w+)", line):
            nested = bool(blocks) and blocks[-1][1] == "def" and not decorated
            if (not m[1].startswith("_") or m[1].startswith("__")) and not nested:
                yield "function", m[1]
            blocks.append((indent, "def"))
        elif m := re.match(r"\s*class\s+(\w+)", line):
            yield "container", m[1]
            blocks.append((indent, "class"))
        elif line.rstrip().endswith(":"):
            blocks.append((indent, "other"))
        decorated = line.lstrip().startswith("@")
        for m in PY_IMPORT.finditer(line):
            stop = line.find(";", m.start(1))
            stop = len(line) if stop < 0 else stop
            imports.append((start + m.start(1), start + stop))
            for name in _py_import(code[start + m.start(1) : start + stop].split("#")[0] if "\n" not in line else re.sub(r"#[^\n]*", "", code[start + m.start(1) : start + stop])):
                yield "import", name
    for text in _py_references(code, masked, imports):
        yield "reference", text


# --- Rust -----------------------------------------------------------------------------------------

RS_TOKENS = re.compile(r"""(?P<c>//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*(?:\*/|\Z))|(?P<s>\bb?r(?P<h>\#*)"(?:.|\n)*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?'(?:\\[^\n']+|[^\\'\n])')""", re.S)
RS_PRIMITIVES = frozenset("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())
RS_MACRO = re.compile(r"\b(?!macro_rules\b)\w+!\s*[(\[{]|\bmacro_rules!\s*\w+\s*[(\[{]")


def _rs_mask(code: str) -> str:
    masked = re.sub(RS_TOKENS, lambda m: _blank(m[0]) if m.group("c") is not None else m[0][0] + _blank(m[0][1:-1]) + m[0][-1], code)
    out, at = [], 0
    while m := RS_MACRO.search(masked, at):
        end = closing(masked, m.end() - 1)
        out += [masked[at : m.end()], _blank(masked[m.end() : end])]
        at = end
    return "".join(out) + masked[at:]


def _rs_split(body: str) -> list[str]:
    """Items of a use list, at its own level."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(body):
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        elif c == "," and not depth:
            out.append(body[start:k])
            start = k + 1
    return [*out, body[start:]]


def _rs_list(tree: str) -> list[str]:
    """Leaves of ``prefix::{...}``: names and paths; self, globs and renamed items give none.

    A prefix that is ``self`` or ``super`` alone is no name, and so is lost.
    """
    prefix, _, body = tree.partition("{")
    prefix = prefix.removesuffix("::")
    head = prefix + "::" if prefix and prefix not in ("self", "super") else ""
    out: list[str] = []
    for item in _rs_split(body[: body.rindex("}")] if "}" in body else body):
        if "{" in item:
            if not item.startswith("{"):
                out += [head + leaf for leaf in _rs_list(item)]
        elif re.fullmatch(r"(?:::)?\w+(?:::\w+)*", item) and item not in ("self", "super", "crate"):
            out.append(head + item)
    return out


def rust_use_paths(clause: str) -> list[str]:
    """Paths of a use clause, the text between ``use`` and the semicolon."""
    as_name = re.match(r"\s*([\w:\s]+?)\s+as\s+\w+\s*$", clause)
    text = re.sub(r"\s+", "", re.sub(r"\bas\s+\w+", "@", clause))
    if as_name:
        name = re.sub(r"\s+", "", as_name[1])
        return [name] if name not in ("self", "super", "crate") else []
    if "{" in text:
        return _rs_list(text) if not text.startswith("{") else []
    return [text] if re.fullmatch(r"(?:::)?\w+(?:::\w+)+", text) else []


def rust_facts(code: str, stem: str) -> Iterator[Fact]:
    masked = _rs_mask(code)
    for m in re.finditer(r"\buse\s+([^;]+);", masked):
        for path in rust_use_paths(m[1]):
            local = path.startswith(("crate::", "self::", "super::", f"{stem}::"))
            yield "import_local" if local else "import", path
    for m in re.finditer(r"\bmod\s+(\w+)\s*;", masked):
        yield "import_local", m[1]
    for m in re.finditer(r"\bfn\s+(\w+)", masked):
        yield "function", m[1]
    for m in re.finditer(r"\b(?:struct|enum|trait)\s+(\w+)", masked):
        yield "container", m[1]
    for m in re.finditer(r"(?:^|[;{}\]\s])(?:unsafe\s+|default\s+)*impl\b", masked):
        brace = masked.find("{", m.end())
        rest = masked[m.end() : brace if brace >= 0 else len(masked)]
        rest = rest.partition(" where ")[0].strip()
        if rest.startswith("<"):
            depth = 0
            for k, c in enumerate(rest):
                depth += (c == "<") - (c == ">" and rest[k - 1] != "-")
                if not depth:
                    rest = rest[k + 1 :]
                    break
        for side in re.split(r"\bfor\b", rest, maxsplit=1):
            name = side.strip().lstrip("!").strip()
            if re.fullmatch(r"\w+", name) and name not in RS_PRIMITIVES:
                yield "container", name
    for m in re.finditer(r"\b[A-Za-z_]\w*(?:\s*::\s*[A-Za-z_]\w*)+", re.sub(r"\buse\s+[^;]*\{[^;]*;", lambda u: re.sub(r"[{},]", ";", u[0]), masked)):
        parts = re.sub(r"\s+", "", m[0]).split("::")
        for k in range(2, len(parts) + 1):
            yield "reference", "::".join(parts[:k])


# --- TypeScript -----------------------------------------------------------------------------------

TS_TOKENS = re.compile(r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|(?<=[=(,:;!&|?{}\[])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)""", re.S)
TS_NOT_METHODS = frozenset("if for while switch catch function return with await typeof new super import constructor_".split())
TS_MODIFIERS = frozenset("public private protected static readonly override async get set abstract".split())
_TS_BEFORE = re.compile(r"(?:^|[;{}\n)])\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?$")


class Brackets:
    """Partners of all brackets and the brace around every place, found in one pass.

    ``closing``: of an opening parenthesis, counting parentheses alone.
    ``after``: of any opening bracket, counting all kinds alike: the place behind its partner.
    """

    def __init__(self, masked: str):
        self.closing: dict[int, int] = {}
        self.after: dict[int, int] = {}
        self.changes, self.around = [-1], [-1]  # from a place on: the innermost open brace, -1 for none
        parens: list[int] = []
        braces: list[int] = []
        every: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", masked):
            at, c = m.start(), m[0]
            if c in "([{":
                every.append(at)
            elif every:
                self.after[every.pop()] = at + 1
            if c == "(":
                parens.append(at)
            elif c == ")" and parens:
                self.closing[parens.pop()] = at
            elif c in "{}":
                if c == "{":
                    braces.append(at)
                elif braces:
                    braces.pop()
                self.changes.append(at + 1)
                self.around.append(braces[-1] if braces else -1)
        self.end = len(masked)

    def brace_around(self, at: int) -> int:
        return self.around[bisect_right(self.changes, at) - 1]


_TS_METHOD = re.compile(r"(?<![\w$.])(?:async\s++|get\s++|set\s++|\*\s*+)*(#?[A-Za-z_$][\w$]*+)\s*+(?:\?\s*+)?(?:<[^()]*>\s*+)?\(")
_TS_BLOCK = re.compile(r"\)\s*+(?::\s*+[^;{}=]*?(?:\{[^{}]*\}[^;{}=]*?)?)?\{")
_TS_CONTINUES = re.compile(r"\s*+[.,?:+\-*/&|=]")
_TS_STOP = re.compile(r"[()\[\]{};,\n]")


def typescript_facts(code: str) -> Iterator[Fact]:
    masked = mask(code, TS_TOKENS)
    brackets = Brackets(masked)

    def string_at(at: int) -> str | None:
        if at >= len(masked) or masked[at] not in "\"'":
            return None
        end = masked.find(masked[at], at + 1)
        return code[at:end].strip("\"").strip("'") if end > 0 else None

    def has_body(paren: int) -> bool:
        """Whether a block follows the parameters that begin at ``paren``, maybe after a return type."""
        return bool(_TS_BLOCK.match(masked, brackets.closing.get(paren, brackets.end)))

    for m in re.finditer(r"(?<![\w.$])(?:import\s*+(?=[\"'])|import\s++(?:type\s++|typeof\s++)?[\w$*{}\s,]+?\bfrom\s*+(?=[\"'])|export\s++(?:type\s++)?(?:\*(?:\s*+as\s++[\w$]++)?|\{[^}]*\})\s*+from\s*+(?=[\"']))", masked):
        path = string_at(m.end())
        if path is not None:
            yield "import_local" if path.startswith(".") else "import", path
    for m in re.finditer(r"\bfunction\s++([\w$]++)\s*+(?:<[^(]*>\s*+)?\(", masked):
        if _TS_BEFORE.search(masked[max(0, m.start() - 80) : m.start()]) and has_body(m.end() - 1):
            yield "function", m[1]
    for m in _TS_METHOD.finditer(masked):
        if m[1] not in TS_NOT_METHODS and _ts_opens(masked, m.start()) and has_body(m.end() - 1) and _ts_members(masked, brackets.brace_around(m.start())):
            yield "function", m[1]
    for m in re.finditer(r"\b(?:const|let)\s+", masked):
        for name in _ts_arrows(masked, m.end(), brackets):
            yield "function", name
    for m in re.finditer(r"\b(class|interface|enum|type)\s+([A-Za-z_$][\w$]*)", masked):
        before = masked[max(0, m.start() - 80) : m.start()]
        if not re.search(r"(?:^|[;{}\n)])\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:const\s+)?$", before):
            continue
        after = masked[m.end() : m.end() + 400]
        if m[1] == "type" and not re.match(r"\s*(?:<[^=]*>)?\s*=", after):
            continue
        if m[1] != "type" and masked.find("{", m.end()) < 0:
            continue
        yield "container", m[2]


def _ts_opens(masked: str, at: int) -> bool:
    """Whether a member can begin at ``at``, as what stands before it tells."""
    k = at
    while k and masked[k - 1].isspace():
        k -= 1
    if not k or masked[k - 1] in "{};,*":
        return True
    if masked[k - 1] in ")'\"":
        return "\n" in masked[k:at]
    word = re.search(r"[\w$]+$", masked[max(0, k - 16) : k])
    return word is not None and word[0] in TS_MODIFIERS


def _ts_members(masked: str, brace: int) -> bool:
    """Whether a brace opens a class body or an object literal."""
    if brace < 0:
        return False
    head = masked[max(0, brace - 300) : brace]
    return bool(re.search(r"\bclass\b[^;{}]*$", head) or re.search(r"(?:[=(,:\[?]|\breturn|\bdefault)\s*$", head) and not re.search(r"=>\s*$", head))


def _ts_arrows(masked: str, at: int, brackets: Brackets) -> Iterator[str]:
    """Names of a declaration list whose values are arrow functions."""
    while True:
        m = re.compile(r"\s*+([A-Za-z_$][\w$]*+)\s*+(?::[^=;]*?(?:=>[^=;]*?)?)?=(?![=>])\s*+").match(masked, at)
        if not m:
            return
        value = m.end()
        if re.compile(r"(?:async\s++)?[A-Za-z_$][\w$]*+\s*+=>").match(masked, value):
            yield m[1]
        elif p := re.compile(r"(?:async\s*+)?(?:<[^()]*>\s*+)?\(").match(masked, value):
            end = brackets.closing.get(p.end() - 1, brackets.end)
            if re.compile(r"\)\s*+(?::\s*+[^;=]*?)?=>").match(masked, end):
                yield m[1]
        k = value
        while stop := _TS_STOP.search(masked, k):
            k, c = stop.start(), stop[0]
            if c in "([{":
                k = brackets.after.get(k, brackets.end)
            elif c == ",":
                break
            elif c != "\n" or _ts_ends(masked, value, k):
                return
            else:
                k += 1
        else:
            return
        at = k + 1


def _ts_ends(masked: str, value: int, line_feed: int) -> bool:
    """Whether a declaration ends at a line feed: something stands before it that needs no more, and no operator follows."""
    k = line_feed
    while k > value and masked[k - 1].isspace():
        k -= 1
    return k > value and not masked.startswith("=>", max(value, k - 2)) and masked[k - 1] not in ",=(" and not _TS_CONTINUES.match(masked, line_feed)


# --- C++ ------------------------------------------------------------------------------------------

CC_TOKENS = re.compile(r"""(?P<c>//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z))|(?P<s>R"(?P<d>[^\s()\\]{0,16})\(.*?\)(?P=d)"|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])+')""", re.S)
CC_NOT_NAMES = frozenset("if for while switch catch return sizeof alignof decltype new delete else do throw case static_assert alignas noexcept explicit requires defined operator".split())


def cpp_facts(code: str) -> Iterator[Fact]:
    comments = re.sub(r"//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')", lambda m: m[0] if m[1] else _blank(m[0]), code, flags=re.S)
    for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*(?:\"([^\"\n]*)\"|<([^>\n]*)>)", comments):
        yield ("import_local", m[1]) if m[1] is not None else ("import", m[2])
    masked = re.sub(CC_TOKENS, lambda m: _blank(m[0]) if m.group("c") is not None else m[0][0] + _blank(m[0][1:-1]) + m[0][-1], code)
    masked = re.sub(r"(?m)^[ \t]*#(?:\\\n|[^\n])*", lambda m: _blank(m[0]), masked)
    for m in re.finditer(r"\b(?:class|struct|union|enum(?:\s+(?:class|struct))?)\s+(?:alignas\s*\([^)]*\)\s*|\[\[[^\]]*\]\]\s*)*([A-Za-z_]\w*)\s*(?:final\s*)?(?=[{:;])", masked):
        if not masked[m.end() :].startswith("::"):
            yield "container", m[1]
    kinds: list[str] = []
    last = 0
    for m in re.finditer(r"[{}]|([A-Za-z_]\w*)\s*\(", masked):
        if m[0] == "}":
            if kinds:
                kinds.pop()
            last = m.end()
        elif m[0] == "{":
            head = masked[max(last, m.start() - 400) : m.start()]
            head = head[max(head.rfind(";"), head.rfind("}")) + 1 :]
            member = re.search(r"\b(?:class|struct|union)\b[^()]*$", head)
            kinds.append("class" if member else "other")
            last = m.end()
        elif m[1] not in CC_NOT_NAMES and (not kinds or kinds[-1] != "class"):
            before = masked[max(0, m.start() - 200) : m.start()].rstrip()
            kind = re.search(r"([A-Za-z_]\w*|>)$", before)
            if not kind or kind[1] in CC_NOT_NAMES or before.endswith("::"):
                continue
            end = closing(masked, masked.index("(", m.start(1)))
            if re.compile(r"\)\s*(?:const\b|noexcept\b(?:\s*\([^)]*\))?|override\b|final\b|volatile\b|&{1,2}|->\s*[\w:<>,*&\s]+?|\s)*\s*(?:try\s*)?\{").match(masked, end):
                yield "function", m[1]


# Names of macros that wrap includes.
INCLUDE_MACROS = ("BOOST_INCLUDE", "Q_INCLUDE", "QT_INCLUDE", "GL_INCLUDE", "SDL_INCLUDE", "INCLUDE", "SYSTEM_INCLUDE", "OPTIONAL_INCLUDE")


def macro_include_facts(code: str) -> Iterator[Fact]:
    """Includes wrapped in macros, line by line: the first quoted and the first bracketed path."""
    for line in code.split("\n"):
        if "(" in line and any(name in line for name in INCLUDE_MACROS):
            if m := re.search(r'"([^"]*)"', line):
                yield "import_local", m[1]
            if m := re.search(r"<([^>]*)>", line):
                yield "import", m[1]


def facts(language: str, path: str, code: str, macro_includes: bool = False) -> set[Fact]:
    """All facts of one file.  Locality of Python imports depends on other files and is found later."""
    if language == "Python":
        return set(python_facts(code))
    if language == "Rust":
        name = path.rpartition("/")[2]
        return set(rust_facts(code, name.rpartition(".")[0] or name))
    if language == "TypeScript":
        return set(typescript_facts(code))
    if language == "Cpp":
        return set(cpp_facts(code)) | (set(macro_include_facts(code)) if macro_includes else set())
    return set()
