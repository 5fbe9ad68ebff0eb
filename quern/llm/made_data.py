"""Made examples of data written as code, for training (problem 7).

Header notices are signed by tools on code; files that are mainly data bear
none, so notices can't teach that class. These examples come from a seed, not
from the corpus: tables of integers, floats and hex, base64 blobs and keyed
records, each in the form the language gives a constant.
"""

from __future__ import annotations

import base64
import random

_FORMS = ("integers", "floats", "hex", "blob", "records")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SHELLS = {
    "python": "{v} = [\n{b}\n]\n",
    "javascript": "export const {v} = [\n{b}\n];\n",
    "typescript": "const {v} = [\n{b}\n];\nexport default {v};\n",
    "java": "package {v};\n\nclass T{v} {{\n  static final Object[] {v} = {{\n{b}\n  }};\n}}\n",
    "go": "package {v}\n\nvar {v} = []any{{\n{b}\n}}\n",
    "rust": "pub const {v}: &[i64] = &[\n{b}\n];\n",
    "c": "static const int {v}[] = {{\n{b}\n}};\n",
}


def _name(rnd: random.Random) -> str:
    return "".join(rnd.choice(_LETTERS) for _ in range(rnd.randint(3, 12)))


def _cells(rnd: random.Random, form: str) -> list[str]:
    n = rnd.randint(80, 1200)
    if form == "integers":
        top = rnd.choice((9, 255, 65535))
        return [str(rnd.randint(0, top)) for _ in range(n)]
    if form == "floats":
        digits = rnd.randint(1, 6)
        return [f"{rnd.uniform(-50, 50):.{digits}f}" for _ in range(n)]
    return [f"0x{rnd.getrandbits(8):02x}" for _ in range(n)]


def _blob(rnd: random.Random) -> list[str]:
    raw = base64.b64encode(rnd.randbytes(3 * rnd.randint(80, 1200))).decode()
    width = rnd.choice((64, 76, len(raw)))
    return [f'"{raw[i : i + width]}"' for i in range(0, len(raw), width)]


def _records(rnd: random.Random, language: str) -> str:
    n = rnd.randint(30, 400)
    if language == "xml":
        a, b = _name(rnd)[:2], _name(rnd)[:2]
        return "<rows>\n" + "\n".join(f'<row {a}="{rnd.randint(0, 999)}" {b}="{rnd.random():.3f}"/>' for _ in range(n)) + "\n</rows>\n"
    body = "\n".join(f'  "{_name(rnd)}": [{rnd.randint(0, 255)}, {rnd.randint(0, 99)}],' for _ in range(n))
    return f"{_name(rnd)} = {{\n{body}\n}}\n"


def made_data(n: int, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, language, node count) of n files, in turn by language and form."""
    rnd = random.Random(seed)
    languages = list(_SHELLS)
    out = []
    for i in range(n):
        language, form = languages[i % len(languages)], _FORMS[i // len(languages) % len(_FORMS)]
        if form == "records":
            language = "xml" if rnd.random() < 0.2 else language
            text = _records(rnd, language)
        elif form == "blob":
            lines = _blob(rnd)
            one = f"{rnd.choice(('export default', _name(rnd) + ' ='))} {lines[0]}\n"
            text = one if len(lines) == 1 else _SHELLS[language].format(v=_name(rnd), b="\n".join("  " + x for x in lines))
        else:
            cells, per, sep = _cells(rnd, form), rnd.choice((8, 12, 16, 24)), rnd.choice((",", ", "))
            body = "\n".join(sep.join(cells[k : k + per]) + sep.rstrip() for k in range(0, len(cells), per))
            text = _SHELLS[language].format(v=_name(rnd), b=body)
        out.append((text, language, rnd.randint(0, 3)))
    return out
