"""Pseudonyms once more, in plain Python, from the rules in words."""

import datetime
import hashlib
import re

KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "access": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"""(?<![A-Za-z0-9])(?:[A-Za-z]{1,16}[_-]){0,2}(?:(?P<pw>[Pp]ass(?:word|wd|phrase)|PASS(?:WORD|WD|PHRASE))|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)"""
    r"""(?:[_-][A-Za-z]{1,16}){0,2}["']? {0,2}(?:= {0,2}|(?P<colon>:) {0,2})(?:"[^"\n]{4,}(?=")|'[^'\n]{4,}(?=')|(?(colon)(?(pw)[^\s"'<>]{4,}|(?:[^\s"'<>]{12,}|(?=[^\s"'<>0-9]{0,10}[0-9])[^\s"'<>]{4,}))|[^\s"'<>]{4,}))""",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)",
    "iso": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})(?![\w/-])",
    "day": r"(?<![\w/.-])(?:\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{8,15}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:(?: \d{4}){2} \d{1,7}|(?:-\d{4}){2}-\d{1,7}|[ -]\d{6}[ -]\d{5}))(?![\w-])",
}
SCAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()), re.ASCII)
FIRST = datetime.date(1800, 1, 1)


def digest(key, kind, turn, half):
    return hashlib.sha512(f"{key}|{kind}|{turn}|{half}".encode()).hexdigest()


def move(half, hexed):
    out = []
    for i, c in enumerate(half):
        step = int(hexed[i % 42 * 3 : i % 42 * 3 + 3], 16)
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            if 0 <= ord(c) - ord(first) < size:
                c = chr(ord(first) + (ord(c) - ord(first) + step) % size)
                break
        out.append(c)
    return "".join(out)


def permuted(value, key, kind):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for turn in range(1, 9):
        left, right = right, move(left, digest(key, kind, turn, right))
    return left + right


def permuted_pair(a, b, m, n, key, kind):
    for turn in range(1, 9):
        if turn % 2:
            a = (a + int(digest(key, kind + "l", turn, b)[:15], 16) % m) % m
        else:
            b = (b + int(digest(key, kind + "r", turn, a)[:15], 16) % n) % n
    return a, b


def refill(shape, new):
    new = iter(new)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def luhn(body):
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str((10 - total % 10) % 10)


def next_date(date, key, good=lambda d: True):
    day = (date - FIRST).days
    if not 0 <= day < 189 * 773:
        return None
    for _ in range(64):
        a, b = permuted_pair(day // 773, day % 773, 189, 773, key, "date")
        day = a * 773 + b
        if good(FIRST + datetime.timedelta(day)):
            break
    return FIRST + datetime.timedelta(day)


def parsed(value, form):
    try:
        return datetime.datetime.strptime(value, form).date()
    except ValueError:
        return None


def shown(date, form):
    return form.replace("%Y", f"{date.year:04}").replace("%m", f"{date.month:02}").replace("%d", f"{date.day:02}")


def one(kind, value, key):
    digits = re.sub(r"\D", "", value)
    if kind == "email":
        at = value.index("@")
        return permuted(value[:at], key, "email") + value[at:]
    if kind == "access":
        return value[:4] + permuted(value[4:], key, "access")
    if kind == "secret":
        at = re.search("[=:] {0,2}[\"']?", value).end()
        return value[:at] + permuted(value[at:], key, "secret")
    if kind == "ip":
        o = [int(x) for x in value.split(".")]
        if max(o) > 255 or value != ".".join(map(str, o)):
            return value
        a, b = permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind in ("iso", "day"):
        form = {"-": "%Y-%m-%d", ".": "%d.%m.%Y"}.get(re.search(r"\D", value)[0]) or ("%Y/%m/%d" if kind == "iso" else "%m/%d/%Y" if value[:2] <= "12" else "%d/%m/%Y")
        date = parsed(value, form)
        new = date and next_date(date, key, (lambda d: d.day > 12) if form == "%d/%m/%Y" else lambda d: True)
        return shown(new, form) if new else value
    if kind == "ssn":
        possible = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        if not possible(digits):
            return value
        for _ in range(64):
            digits = permuted(digits, key, "ssn")
            if possible(digits):
                break
        return refill(value, digits)
    if kind == "card":
        body = digits[:-1]
        if luhn(body) != digits[-1]:
            return value
        body = permuted(body, key, "card")
        return refill(value, body + luhn(body))
    prefix = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|", value)[0]
    rest = value[len(prefix) :]
    return prefix + refill(rest, permuted(re.sub(r"\D", "", rest), key, "phone"))


def pseudonymised(text, key):
    """The text and the number of values replaced."""
    if text is None:
        return None, 0
    replaced = 0

    def new(m):
        nonlocal replaced
        out = one(next(k for k in KINDS if m[k] is not None), m[0], key)
        replaced += out != m[0]
        return out

    return SCAN.sub(new, text), replaced
