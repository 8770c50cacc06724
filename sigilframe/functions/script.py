"""A reader of scripts that assign object literals to names: quoted or plain keys, strings in either quotes with escapes, numbers, arrays, objects, comments and trailing commas."""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<number>[-+]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?))
    |(?P<name>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<mark>[{}\[\],:;=])""",
    re.S | re.X,
)
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
SINGLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}
WORDS = {"true": True, "false": False, "null": None, "undefined": None}
DECLARING = {"var", "let", "const", "export"}


def text_of(quoted: str) -> str:
    """A string literal's text; two escapes that stand for one character beyond the first plane are joined."""
    plain = ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else SINGLE.get(m[4], m[4]), quoted[1:-1])
    return plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def tokens(script: str) -> list[tuple[str, object]]:
    """(kind, value) of strings, numbers, names and marks; white space and comments are left out."""
    out, at = [], 0
    while at < len(script):
        m = TOKEN.match(script, at)
        if not m:
            raise ValueError(f"unexpected {script[at]!r} at {at}")
        at = m.end()
        if m.lastgroup == "string":
            out.append(("value", text_of(m[0])))
        elif m.lastgroup == "number":
            n = m[0]
            out.append(("value", int(n, 16) if "x" in n.lower() else float(n) if re.search("[.eE]", n) else int(n)))
        elif m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


def assignments(script: str) -> dict[str, object]:
    """The values of all names that are assigned a literal, by name. Open objects and arrays wait in a list, so literals may be nested to any depth."""
    out: dict[str, object] = {}
    all_tokens = [*tokens(script), ("end", "")]
    at = 0

    def take(*marks: str) -> str:
        nonlocal at
        kind, value = all_tokens[at]
        if kind != "mark" or value not in marks:
            raise ValueError(f"expected one of {' '.join(marks)}, found {value!r}")
        at += 1
        return value

    def literal() -> object:
        nonlocal at
        top: list = []
        within: list[tuple[object, object]] = [(top, None)]  # open containers, and the key that the next value of each goes to
        while True:
            box, key = within[-1]
            kind, value = all_tokens[at]
            if box is not top and (kind, value) == ("mark", "}" if isinstance(box, dict) else "]"):
                at += 1
                within.pop()
            else:
                if isinstance(box, dict):
                    if kind not in ("value", "name"):
                        raise ValueError(f"expected a key, found {value!r}")
                    at += 1
                    take(":")
                    key, (kind, value) = str(value), all_tokens[at]
                at += 1
                if kind == "mark" and value in "{[":
                    made: object = {} if value == "{" else []
                elif kind == "value" or (kind == "name" and value in WORDS):
                    made = WORDS[value] if kind == "name" else value
                else:
                    raise ValueError(f"expected a value, found {value!r}")
                if isinstance(box, dict):
                    box[key] = made
                else:
                    box.append(made)
                if isinstance(made, (dict, list)):
                    within.append((made, None))
                    continue
            if within[-1][0] is top:
                return top[0]
            if all_tokens[at] == ("mark", ","):
                at += 1
            elif all_tokens[at][1] != ("}" if isinstance(within[-1][0], dict) else "]"):
                raise ValueError(f"expected a comma, found {all_tokens[at][1]!r}")

    while all_tokens[at][0] != "end":
        kind, value = all_tokens[at]
        if (kind, value) == ("mark", ";") or (kind == "name" and value in DECLARING):
            at += 1
            continue
        if kind != "name":
            raise ValueError(f"expected a name, found {value!r}")
        at += 1
        take("=")
        out[value] = literal()
    return out
