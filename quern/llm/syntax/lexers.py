"""Tokenisers: text to (type, line, newline or closing brace before or at it).

Each raises Bad at a character that can't begin a token or a literal that
doesn't end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Token = tuple[str, int, bool]


class Bad(Exception):
    def __init__(self, line: int, what: str):
        super().__init__(what)
        self.line, self.what = line, what


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_ID = r"[^\W\d]\w*"




# ---------------------------------------------------------------- scripts

JS_RESERVED = _words(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum"
)
JS_SOFT = _words("async await of get set static let yield from as")
TS_SOFT = JS_SOFT | _words(
    "type interface namespace module declare abstract readonly keyof infer is asserts satisfies public private protected override unique implements global accessor out"
)

_JS = re.compile(
    r"""(?P<ws>[ \t\v\f\u00a0\ufeff]+)|(?P<nl>[\r\n\u2028\u2029])|(?P<line>//[^\r\n\u2028\u2029]*)|(?P<block>/\*.*?\*/)
    |(?P<num>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))
    |(?P<name>\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:\w|\$|[\u200c\u200d]|\\u[0-9a-fA-F]{4})*)
    |(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')
    |(?P<tpl>`)
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|>>>|>>|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.S | re.X,
)
_TPL = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-z]*(?![\w$])")
_OPERAND_END = _words("NAME NUM STR TPL TPLTAIL REGEX ) ] this super null true false PRIVATE ++ --")


def script(text: str, typed: bool) -> Iterator[Token]:
    """JavaScript or TypeScript; ASI stands for a line end that closes a restricted statement."""
    soft = TS_SOFT if typed else JS_SOFT
    i, n, line, nl, prev = 0, len(text), 1, False, ""
    if text.startswith("#!"):
        i = text.find("\n") if "\n" in text else n
    braces: list[str] = []
    parens: list[bool] = []
    closed_head = False

    def piece(start: int, head: bool) -> tuple[str, int]:
        end = _TPL.match(text, start).end()
        if text.startswith("`", end):
            return ("TPL" if head else "TPLTAIL"), end + 1
        if text.startswith("${", end):
            braces.append("`")
            return ("TPLHEAD" if head else "TPLMID"), end + 2
        raise Bad(line, "template")

    while i < n:
        m = _JS.match(text, i)
        if not m:
            raise Bad(line, text[i : i + 10])
        kind, s = m.lastgroup, m[0]
        at, end = line, m.end()
        if kind == "ws" or kind == "line":
            i = end
            continue
        if kind == "nl":
            if not (s == "\r" and text.startswith("\n", end)):
                line += 1
            nl, i = True, end
            continue
        if kind == "block":
            if "\n" in s:
                nl = True
                line += s.count("\n")
            i = end
            continue
        if kind == "op" and s in ("/", "/=") and not (prev in _OPERAND_END and not (prev == ")" and closed_head) or prev in soft):
            r = _REGEX.match(text, i)
            if not r:
                raise Bad(line, "regular expression")
            s, end, kind = r[0], r.end(), "regex"
            t = "REGEX"
        elif kind == "name":
            t = "PRIVATE" if s[0] == "#" else s if s in JS_RESERVED or s in soft else "NAME"
        elif kind == "num":
            t = "NUM"
        elif kind == "str":
            t = "STR"
            line += s.count("\n")
        elif kind == "tpl":
            t, end = piece(end, True)
            line += text.count("\n", i, end)
        else:
            t = s
            if t == "{":
                braces.append("{")
            elif t == "}":
                if not braces:
                    raise Bad(line, "}")
                if braces.pop() == "`":
                    t, end = piece(end, False)
                    line += text.count("\n", i, end)
            elif t == "(":
                parens.append(prev in ("if", "while", "for", "with"))
            elif t == ")":
                closed_head = bool(parens) and parens.pop()
            elif typed and t[0] == ">" and t != ">":
                for _ in t[:-1] if t[-1] == "=" else t:
                    yield ">", at, nl
                    nl = False
                if t[-1] == "=":
                    yield "=", at, False
                prev, i = "op", end
                continue
            if t in ("++", "--") and nl:
                t += "nl"
        if nl and prev in ("return", "break", "continue"):
            yield "ASI", at, False
        yield t, at, nl or t == "}" or prev == "}"
        prev, nl, i = t, False, end
    if braces:
        raise Bad(line, "end of file")


# ---------------------------------------------------------------- python

PY_RESERVED = _words(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
)
PY_SOFT = _words("match case type")
_PY = re.compile(
    r"""(?P<ws>[ \t\f]+)|(?P<comment>\#[^\r\n]*)|(?P<cont>\\\r?\n)|(?P<nl>\r\n|\r|\n)
    |(?P<str>(?P<pre>[rRbBuUfFtT]{0,3})(?P<q>\"\"\"|'''|"|'))
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))
    |(?P<name>[^\W\d]\w*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|==|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[{}()\[\];,<>+\-*/%&|^~:=.@])""",
    re.X,
)
_PREFIX = frozenset("r b u f t br rb fr rf tr rt".split()) | {""}
_PLAIN = {q: re.compile(rf"(?:[^{q}\\\r\n]|\\(?:\r\n|.))*{q}", re.S) for q in "\"'"} | {q * 3: re.compile(rf"(?:[^\\{q}]|\\.|{q}(?!{q}{q}))*{q * 3}", re.S) for q in "\"'"}
_PY_AFTER_NUM = re.compile(r"(?:and|else|for|if|in|is|or|not)\b")


def _fstring_end(text: str, i: int, q: str, line: int, raw: bool) -> int:
    """The end of an f-string whose body begins at i."""
    depth, n = 0, len(text)
    stack: list[str] = []
    while i < n:
        c = text[i]
        if not stack:
            if text.startswith(q, i):
                return i + len(q)
            if c == "\\" and not (raw and text[i + 1 : i + 2] in "{}"):
                i += 2
                continue
            if c == "\n" and len(q) == 1:
                raise Bad(line, "string")
            if c == "{":
                if text.startswith("{{", i):
                    i += 2
                    continue
                if text[i + 1 : i + 2] in ("}", "!", ":", "="):
                    raise Bad(line, "empty expression in string")
                stack.append("{")
            elif c == "}":
                if not text.startswith("}}", i):
                    raise Bad(line, "} in string")
                i += 2
                continue
            i += 1
            continue
        if c in "\"'" and stack[-1] != ":":
            m = _PY.match(text, i)
            inner = _PLAIN[m["q"]].match(text, m.end()) if m and m["q"] else None
            if not inner:
                raise Bad(line, "string")
            i = inner.end()
            continue
        if stack[-1] == ":":
            if text.startswith(q, i):
                raise Bad(line, "string")
            if c == "{":
                stack.append("{")
            elif c == "}":
                stack.pop()
                stack.pop()
            i += 1
            continue
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if {"(": ")", "[": "]", "{": "}"}[stack.pop()] != c:
                raise Bad(line, "bracket in string")
        elif c == ":" and len(stack) == 1 or c == ":" and stack[-1] == "{" and all(x in "{:" for x in stack):
            stack.append(":")
        elif c == "\n" and len(q) == 1 and depth:
            raise Bad(line, "string")
        i += 1
    raise Bad(line, "string")


def python(text: str) -> Iterator[Token]:
    text = text.removeprefix("\ufeff")
    if "\0" in text:
        raise Bad(1, "null character")
    i, n, line = 0, len(text), 1
    indents, alts, brackets = [0], [0], []
    fresh, wrote = True, False
    while i < n:
        if fresh:
            m = re.compile(r"[ \t\f]*").match(text, i)
            rest = text[m.end() : m.end() + 1]
            if rest in ("", "#", "\r", "\n"):
                fresh = False
                wrote = False
                i = m.end()
                continue
            col = alt = 0
            for c in m[0]:
                if c == " ":
                    col, alt = col + 1, alt + 1
                elif c == "\t":
                    col, alt = (col // 8 + 1) * 8, alt + 1
                else:
                    col = alt = 0
            if col == indents[-1]:
                if alt != alts[-1]:
                    raise Bad(line, "tabs")
            elif col > indents[-1]:
                if alt <= alts[-1]:
                    raise Bad(line, "tabs")
                indents.append(col)
                alts.append(alt)
                yield "INDENT", line, False
            else:
                while col < indents[-1]:
                    indents.pop()
                    alts.pop()
                    yield "DEDENT", line, False
                if col != indents[-1]:
                    raise Bad(line, "dedent")
            fresh, i = False, m.end()
            continue
        m = _PY.match(text, i)
        if not m:
            raise Bad(line, text[i : i + 10])
        kind, s = m.lastgroup, m[0]
        at, end = line, m.end()
        if m["q"]:
            kind = "str"
        if kind in ("ws", "comment"):
            i = end
            continue
        if kind == "cont":
            line, i = line + 1, end
            if i >= n:
                raise Bad(line, "end of file")
            continue
        if kind == "nl":
            line, i = line + 1, end
            if not brackets:
                if wrote:
                    yield "NEWLINE", at, False
                wrote, fresh = False, True
            continue
        if kind == "str":
            pre = m["pre"].lower()
            if pre not in _PREFIX:
                raise Bad(line, "prefix")
            q = m["q"]
            if "f" in pre or "t" in pre:
                end = _fstring_end(text, end, q, line, "r" in pre)
            else:
                body = _PLAIN[q].match(text, end)
                if not body:
                    raise Bad(line, "string")
                end = body.end()
            line += text.count("\n", i, end)
            t = "STR"
        elif kind == "num":
            t = "NUM"
            if re.match(r"\w", text[end : end + 1]) and not _PY_AFTER_NUM.match(text, end):
                raise Bad(line, "number")
            if re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", s):
                raise Bad(line, "number")
        elif kind == "name":
            t = s if s in PY_RESERVED or s in PY_SOFT else "NAME"
        else:
            t = s
            if s in "([{":
                brackets.append(s)
            elif s in ")]}":
                if not brackets or {"(": ")", "[": "]", "{": "}"}[brackets.pop()] != s:
                    raise Bad(line, s)
        yield t, at, False
        wrote, i = True, end
    if brackets:
        raise Bad(line, "end of file")
    if wrote:
        yield "NEWLINE", line, False
    for _ in indents[1:]:
        yield "DEDENT", line, False


# ---------------------------------------------------------------- go, rust, java, c

GO_RESERVED = _words(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
)
_GO = re.compile(
    r"""(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)
    |(?P<str>"(?:[^"\\\n]|\\[abfnrtv\\"'0-7xuU])*"|`[^`]*`)
    |(?P<char>'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)i?(?!\w))
    |(?P<name>[^\W\d]\w*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[{}()\[\];,<>+\-*/%&|^!:=.~])""",
    re.S | re.X,
)
_GO_ENDS = _words("NAME NUM STR break continue fallthrough return ++ -- ) ] }")


def go(text: str) -> Iterator[Token]:
    text = text.removeprefix("\ufeff")
    i, n, line, prev = 0, len(text), 1, ""
    while i < n:
        m = _GO.match(text, i)
        if not m:
            raise Bad(line, text[i : i + 10])
        kind, s, i = m.lastgroup, m[0], m.end()
        lines = s.count("\n") if kind in ("nl", "block", "str") else 0
        if kind in ("ws", "line") or kind == "block" and not lines:
            continue
        if kind in ("nl", "block"):
            if prev in _GO_ENDS:
                yield ";", line, False
            prev = ""
            line += lines
            continue
        t = "NAME" if kind == "name" and s not in GO_RESERVED else "STR" if kind == "str" else "NUM" if kind in ("num", "char") else s
        yield t, line, t in (")", "}")
        prev, line = t, line + lines
    if prev in _GO_ENDS:
        yield ";", line, False


RUST_RESERVED = _words(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"
)
RUST_SOFT = _words("union auto default macro_rules")
_RUST = re.compile(
    r"""(?P<ws>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)
    |(?P<raw>(?:br|cr|r)(?P<h>\#*)"(?:.*?)"(?P=h)(?!\#))
    |(?P<str>[bc]?"(?:[^"\\]|\\.)*")
    |(?P<char>b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')
    |(?P<life>'[^\W\d]\w*(?!'))
    |(?P<num>0x[0-9a-fA-F_]+\w*|0b[01_]+\w*|0o[0-7_]+\w*|\d[\d_]*(?:\.(?![\w.])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?(?!\w))
    |(?P<name>(?:r\#)?[^\W\d]\w*)
    |(?P<op><<=|\.\.\.|\.\.=|&&|\|\||->|=>|::|==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\.\.|[{}()\[\];,<>+\-*/%&|^!:=.@\#$?~_])""",
    re.S | re.X,
)


def rust(text: str) -> Iterator[Token]:
    text = text.removeprefix("\ufeff")
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        text = "//" + text[2:]
    i, n, line = 0, len(text), 1
    while i < n:
        m = _RUST.match(text, i)
        if not m:
            raise Bad(line, text[i : i + 10])
        kind, s, end = m.lastgroup, m[0], m.end()
        if m["h"] is not None:
            kind = "str"
        if kind == "block":
            depth, j = 1, end
            while depth:
                k = re.compile(r"/\*|\*/").search(text, j)
                if not k:
                    raise Bad(line, "comment")
                depth += 1 if k[0] == "/*" else -1
                j = k.end()
            line += text.count("\n", i, j)
            i = j
            continue
        i = end
        if kind not in ("ws", "line"):
            t = {"str": "STR", "raw": "STR", "char": "CHAR", "life": "LIFE", "num": "NUM"}.get(kind) or (s if kind == "op" or s in RUST_RESERVED or s in RUST_SOFT or s == "_" else "NAME")
            yield t, line, False
        line += s.count("\n")


JAVA_RESERVED = _words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
)
JAVA_SOFT = _words("record sealed permits yield var when module open")
_JAVA = re.compile(
    r"""(?P<ws>\s+)|(?P<line>//[^\r\n]*)|(?P<block>/\*.*?\*/)
    |(?P<text>\"\"\"[ \t\f]*\r?\n(?:[^"\\]|\\.|"(?!""))*\"\"\")
    |(?P<str>"(?:[^"\\\r\n]|\\(?:[btnfrs"'\\]|u+[0-9a-fA-F]{4}|[0-7]{1,3}))*")
    |(?P<char>'(?:[^'\\\r\n]|\\(?:[btnfrs"'\\]|u+[0-9a-fA-F]{4}|[0-7]{1,3}))')
    |(?P<num>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))
    |(?P<name>(?:[^\W\d]|\$)[\w$]*)
    |(?P<op><<=|\.\.\.|->|::|&&|\|\||\+\+|--|==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.S | re.X,
)


def java(text: str) -> Iterator[Token]:
    yield from _plain(text.removeprefix("\ufeff"), _JAVA, JAVA_RESERVED | JAVA_SOFT)


def _plain(text: str, pattern: re.Pattern, words: frozenset[str]) -> Iterator[Token]:
    i, n, line = 0, len(text), 1
    while i < n:
        m = pattern.match(text, i)
        if not m:
            raise Bad(line, text[i : i + 10])
        kind, s, i = m.lastgroup, m[0], m.end()
        if kind == "name":
            yield (s if s in words else "NAME"), line, False
        elif kind == "op":
            yield s, line, False
        elif kind in ("str", "text"):
            yield "STR", line, False
        elif kind in ("num", "char"):
            yield "NUM", line, False
        line += s.count("\n")


C_RESERVED = _words(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Imaginary _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local __attribute__ __extension__ asm __asm__"
)
_C = re.compile(
    r"""(?P<ws>\s+|\\\r?\n)|(?P<line>//(?:[^\\\n]|\\\r?\n|\\.)*)|(?P<block>/\*.*?\*/)
    |(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r\n|.))*")
    |(?P<char>[uUL]?'(?:[^'\\\n]|\\.)+')
    |(?P<num>(?:0[xX][0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[uUlLfF]*(?!\w))
    |(?P<name>[^\W\d]\w*)
    |(?P<op><<=|>>=|\.\.\.|->|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[{}()\[\];,<>+\-*/%&|^!~?:=.])""",
    re.S | re.X,
)
_DIRECTIVE = re.compile(r"^[ \t]*\#[ \t]*(\w*)((?:\\\r?\n|/\*.*?\*/|[^\n])*)", re.M | re.S)


def c(text: str) -> Iterator[Token]:
    """C after its directives are blanked out; conditionals must nest, and of their branches the first is kept."""
    text = text.removeprefix("\ufeff")
    masked = re.sub(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], text, flags=re.S)
    out, last, depth, skip, taken = [], 0, 0, [], []
    for m in _DIRECTIVE.finditer(masked):
        line = text.count("\n", 0, m.start()) + 1
        name = m[1]
        body = masked[last : m.start()]
        out.append(re.sub(r"[^\n]", " ", body) if any(skip) else body)
        out.append("\n" * m[0].count("\n"))
        last = m.end()
        if name in ("if", "ifdef", "ifndef"):
            depth += 1
            skip.append(name == "if" and m[2].strip() == "0")
            taken.append(not skip[-1])
        elif name in ("elif", "else", "elifdef", "elifndef", "endif"):
            if not depth:
                raise Bad(line, "#" + name)
            if name == "endif":
                depth -= 1
                skip.pop()
                taken.pop()
            else:
                skip[-1], taken[-1] = taken[-1], True
        elif name not in ("define", "undef", "include", "pragma", "error", "warning", "line", "import", "include_next", ""):
            raise Bad(line, "#" + name)
    if depth:
        raise Bad(1, "#if without #endif")
    out.append(masked[last:])
    yield from _plain("".join(out), _C, C_RESERVED)


# ---------------------------------------------------------------- xml

_NAME = r"[A-Za-z_:\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff][\-.\w:\u00b7]*"
_XML = re.compile(
    rf"""(?P<decl><\?xml(?=[\s?])[^?]*\?>)|(?P<pi><\?{_NAME}(?:\s.*?)?\?>)|(?P<comment><!--(?:(?!--).)*-->)|(?P<cdata><!\[CDATA\[.*?\]\]>)
    |(?P<doctype><!DOCTYPE\s[^\[>]*(?:\[.*?\]\s*)?>)
    |(?P<etag></{_NAME}\s*>)|(?P<stag><{_NAME}(?:\s+{_NAME}\s*=\s*(?:"[^<"]*"|'[^<']*'))*\s*/?>)|(?P<text>[^<]+)""",
    re.S | re.X,
)
_XMLDECL = re.compile(r"""<\?xml\s+version\s*=\s*(["'])1\.[0-9]+\1(?:\s+encoding\s*=\s*(["'])[A-Za-z][\w.\-]*\2)?(?:\s+standalone\s*=\s*(["'])(?:yes|no)\3)?\s*\?>""")
_REF = re.compile(rf"&(?:{_NAME}|\#[0-9]+|\#x[0-9a-fA-F]+);")
_ATTR = re.compile(rf"\s({_NAME})\s*=\s*(\"[^<\"]*\"|'[^<']*')", re.S)
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def xml(text: str) -> Iterator[Token]:
    """Tags, text and markup; names of end tags and of attributes are checked here, nesting by the table."""
    text = text.removeprefix("\ufeff")
    if m := _CONTROL.search(text):
        raise Bad(text.count("\n", 0, m.start()) + 1, "control character")
    declared = set(re.findall(rf"<!ENTITY\s+({_NAME})\s", text)) | {"amp", "lt", "gt", "quot", "apos"}

    def refs(s: str, line: int) -> None:
        bare = _REF.sub(lambda m: "" if m[0][1] == "#" or m[0][1:-1] in declared else "&", s)
        if "&" in bare:
            raise Bad(line, "&")

    i, n, line, open_tags = 0, len(text), 1, []
    while i < n:
        m = _XML.match(text, i)
        if not m:
            raise Bad(line, text[i : i + 10])
        kind, s = m.lastgroup, m[0]
        if kind == "decl":
            if i or not _XMLDECL.fullmatch(s):
                raise Bad(line, "declaration")
            yield "DECL", line, False
        elif kind == "pi":
            if re.match(r"<\?xml[\s?]", s, re.I):
                raise Bad(line, "declaration")
            yield "MISC", line, False
        elif kind == "comment":
            if s.endswith("--->"):
                raise Bad(line, "comment")
            yield "MISC", line, False
        elif kind == "cdata":
            yield "CDATA", line, False
        elif kind == "doctype":
            yield "DOCTYPE", line, False
        elif kind == "etag":
            name = s[2:-1].strip()
            if not open_tags or open_tags.pop() != name:
                raise Bad(line, s[:20])
            yield "ETAG", line, False
        elif kind == "stag":
            attrs = _ATTR.findall(s)
            if len({a for a, _ in attrs}) != len(attrs):
                raise Bad(line, "attribute")
            for _, v in attrs:
                refs(v, line)
            if s.endswith("/>"):
                yield "EMPTY", line, False
            else:
                open_tags.append(re.match(_NAME, s[1:])[0])
                yield "STAG", line, False
        else:
            refs(s, line)
            if "]]>" in s:
                raise Bad(line, "]]>")
            yield ("SPACE" if not s.strip(" \t\r\n") else "TEXT"), line, False
        line += s.count("\n")
        i = m.end()
