"""Personal data by plain Python: every text is searched place by place, without a first pass."""

from __future__ import annotations

import hashlib
import re
from datetime import date, timedelta

import regex

from skein.llm import pii


def java(pattern: str) -> regex.Pattern:
    """A pattern of the operator: digits, white space and word bounds are ASCII's."""
    return regex.compile(pattern, regex.ASCII)


FIXED = java("|".join((f"(?:{pii.PATTERNS['email']})", f"(?:{pii.PATTERNS['secret']})", f"(?:{pii.PATTERNS['ipv4']})", pii.SSN)))
KINDS = {k: java(v) for k, v in pii.WHOLE.items()}
USUAL, IBAN, DATE, LOCAL = (java(x) for x in (pii.CARD, rf"(?:{pii.IBAN})\b", rf"(?:{pii.DATE})(?!\d)", pii.LOCAL))
CARDS = [java(rf"\d(?:[ -]?\d){{{n - 1}}}(?!\d)") for n in range(19, 12, -1)]
CALLS = [LOCAL, java(r"\+\d{7,15}+(?!\d)"), *(java(rf"\+\d{{1,3}}+(?:[ .-]?\(?\d{{1,4}}+\)?){{{n}}}(?!\d)") for n in range(6, 1, -1))]
APART = java(r"(?<![+)]|\d[ .-]|\)[ .-])")


def number(*parts: object) -> int:
    return int(hashlib.sha256("\u0001".join([pii.KEY, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def digest(tweak: str, value: str) -> str:
    return hashlib.sha256("\u0001".join([pii.KEY, tweak, value]).encode()).hexdigest() * (len(value) // 64 + 1)


def feistel(x: int, y: int, a: int, b: int, tweak: str) -> tuple[int, int]:
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            x = (x + number(tweak, i, y)) % a
        else:
            y = (y + number(tweak, i, x)) % b
    return x, y


def digits(d: str, tweak: str) -> str:
    if len(d) < 2:
        return str((int(d) + number(tweak) % 10) % 10) if d else d
    u = len(d) // 2
    x, y = feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), f"{tweak}:{len(d)}")
    return f"{x:0{u}d}{y:0{len(d) - u}d}"


def base36(n: int, size: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out.rjust(size, "0")


def name(d: str, tweak: str) -> str:
    if not d:
        return d
    if not re.fullmatch("[a-z0-9]{2,24}", d):
        return digest(tweak, d)[: len(d)]
    u = len(d) // 2
    x, y = feistel(int(d[:u], 36), int(d[u:], 36), 36**u, 36 ** (len(d) - u), f"{tweak}:{len(d)}")
    return base36(x, u) + base36(y, len(d) - u)


def refill(shape: str, filling: str, kind: str) -> str:
    rest = iter(filling)
    return "".join(next(rest, "") if regex.match(kind, c) else c for c in shape)


def only(text: str, kind: str) -> str:
    return "".join(c for c in text if regex.match(kind, c))


def luhn(s: str) -> bool:
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def day_of(m: str, layout: str) -> int | None:
    """Days from 1800; layout is the order of year, month and day."""
    numbers = re.split(r"[-./]", m)
    y, mo, d = (int(numbers[layout.index(c)]) for c in "ymd")
    try:
        return (date(y, mo, d) - date(1800, 1, 1)).days
    except ValueError:
        return None


def moved_day(n: int) -> int:
    x, y = feistel(n // 773, n % 773, 189, 773, "date")
    return x * 773 + y


def new_date(m: str) -> str | None:
    layout, form = ("ymd", "%Y-%m-%d") if m[4] == "-" else ("dmy", "%d.%m.%Y" if m[2] == "." else "%d/%m/%Y")
    n, month_first = day_of(m, layout), False
    if n is None and m[2] == "/":
        n, form, month_first = day_of(m, "mdy"), "%m/%d/%Y", True
    if n is None or not 0 <= n < 146_097:
        return None
    n = moved_day(n)
    while month_first and (date(1800, 1, 1) + timedelta(n)).day <= 12:
        n = moved_day(n)
    return (date(1800, 1, 1) + timedelta(n)).strftime(form)


def call_ok(m: str) -> bool:
    return 7 <= len(only(re.sub(r"^\+[0-9]{1,3}(?=[ .(-])", "", m), "[0-9]")) <= 15


def checked(text: str, i: int) -> str | None:
    if not (text[i].isdecimal() and text[i].isascii() and not (i and text[i - 1] in "+0123456789")) and not regex.compile(r"\b(?=[A-Z]{2}[0-9]{2})", regex.ASCII).match(text, i):
        return None
    ahead = text[i : i + pii.SIGHT]
    if (m := IBAN.match(ahead)) and mod97((c := m[0].replace(" ", ""))[4:] + c[:4]) == 1:
        return m[0]
    if (m := DATE.match(ahead)) and new_date(m[0]):
        return m[0]
    cards = [m[0] for p in CARDS if (m := p.match(ahead)) and luhn(only(m[0], "[0-9]"))]
    usual = [c for c in cards if USUAL.fullmatch(c)]
    clear = [c for c in cards if APART.match(text, i) and not re.match("[ -]?[0-9]", ahead[len(c) :])]
    return next(iter(usual + clear), None)


def called(text: str, i: int) -> str | None:
    if not regex.compile(r"(?=\+[0-9])|(?<![0-9])(?=\([0-9]{3}\)|[0-9]{3}[ .-])").match(text, i):
        return None
    return next((m[0] for p in CALLS if (m := p.match(text[i : i + pii.SIGHT])) and call_ok(m[0])), None)


def carded(text: str, i: int) -> str | None:
    if not regex.compile("(?<![0-9])(?=[0-9][ -]?[0-9])").match(text, i):
        return None
    return next((m[0] for p in CARDS if (m := p.match(text[i : i + pii.SIGHT])) and luhn(only(m[0], "[0-9]"))), None)


def cut(parts: list[tuple[str, bool]], find) -> list[tuple[str, bool]]:
    """Pieces and matches (True) after those that ``find`` sees in the pieces have been cut out."""
    out = []
    for piece, is_match in parts:
        if is_match:
            out.append((piece, True))
            continue
        i = start = 0
        while i < len(piece):
            if found := find(piece, i):
                out += [(piece[start:i], False), (found, True)]
                i = start = i + len(found)
            else:
                i += 1
        out.append((piece[start:], False))
    return out


def replaced(m: str) -> tuple[str, str]:
    kind = next(k for k, p in KINDS.items() if p.fullmatch(m))
    if kind == "email":
        local, domain = m.lower().split("@")
        host, top = domain.rsplit(".", 1)
        swap = lambda s, t: refill(s, name(only(s, r"[\p{L}\p{N}]"), t), r"[\p{L}\p{N}]")
        return kind, f"{swap(local, 'local')}@{swap(host, 'host')}.{top}"
    if kind == "secret":
        opening = java(rf"(?:{pii.ASSIGNED}[\"']?)?(?:{'|'.join(pii.ACCESS_KEYS)}|{pii.PEM})?").match(m)[0]
        value = m[len(opening) :]
        d = digest("secret", value)
        return kind, opening + refill(value, d.upper() if value == value.upper() else d, "[A-Za-z0-9]")
    if kind == "iban":
        s = m.replace(" ", "")
        body = refill(s[4:], digits(only(s[4:], "[0-9]"), "iban" + s[:2]), "[0-9]")
        return kind, refill(m, f"{s[:2]}{98 - mod97(body + s[:2] + '00'):02d}{body}", "[A-Z0-9]")
    if kind == "ipv4":
        a, b, c, d = map(int, m.split("."))
        x, y = feistel(a * 256 + b, c * 256 + d, 1 << 16, 1 << 16, "ipv4")
        return kind, f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    if kind == "date":
        return kind, new_date(m) or m
    if kind == "ssn":
        a, g, n = map(int, m.split("-"))
        x, y = feistel(a - (2 if a > 666 else 1), (g - 1) * 9999 + n - 1, 898, 99 * 9999, "ssn")
        return kind, f"{x + (2 if x >= 665 else 1):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    if kind == "card":
        body = digits(only(m, "[0-9]")[:-1], "card")
        return kind, refill(m, body + next(c for c in "0123456789" if luhn(body + c)), "[0-9]")
    code = (re.match(r"\+[0-9]{1,3}(?=[ .(-])", m) or [""])[0]
    rest = m[len(code) :]
    return kind, code + refill(rest, digits(only(rest, "[0-9]"), "phone"), "[0-9]")


def pseudonymise(text: str | None) -> tuple[str | None, int, list[str]]:
    if not text:
        return text, 0, []
    parts, end = [], 0
    for m in FIXED.finditer(text):
        parts += [(text[end : m.start()], False), (m[0], True)]
        end = m.end()
    parts.append((text[end:], False))
    for find in (checked, called, carded):
        parts = cut(parts, find)
    made = [(was, *replaced(was)) if is_match else (was, "", was) for was, is_match in parts]
    changed = [kind for was, kind, new in made if new != was]
    return "".join(new for _, _, new in made), len(changed), sorted(set(changed))
