"""Format-preserving pseudonyms in plain Python, written from the operator's description."""

from __future__ import annotations

import datetime
import hmac
import re

from splitproof.llm.pii import PATTERNS

_ALL = re.compile("|".join(PATTERNS.values()), re.ASCII)
_KINDS = {k: re.compile(f"(?:{p})\\Z", re.ASCII) for k, p in PATTERNS.items()}
_ORDER = ("email", "iban", "ip", "iso_date", "slash_date", "dot_date", "phone", "us_phone", "ssn", "card")
_START = datetime.date(1800, 1, 1)


class Plain:
    def __init__(self, key: str):
        self.key = key.encode()

    def hash(self, tag: str, turn: object, value: object) -> str:
        return hmac.new(self.key, f"{tag}|{turn}|{value}".encode(), "sha512").hexdigest()

    def shifted(self, text: str, digest: str) -> str:
        out = ""
        for i, c in enumerate(text):
            n = int(digest[i % 32 * 4 : i % 32 * 4 + 4], 16)
            for low, size in (("0", 10), ("a", 26), ("A", 26)):
                if c.isascii() and 0 <= ord(c) - ord(low) < size:
                    c = chr(ord(low) + (ord(c) - ord(low) + n) % size)
                    break
            out += c
        return out

    def string(self, text: str, tag: str) -> str:
        s = self.shifted(text, self.hash(tag, 0, len(text)))
        left, right = s[: len(s) // 2], s[len(s) // 2 :]
        for turn in range(1, 9):
            left, right = right, self.shifted(left, self.hash(tag, turn, right))
        return left + right

    def number(self, v: int, a: int, b: int, tag: str) -> int:
        x, y = divmod(v, b)
        for turn in range(1, 9):
            f = int(self.hash(tag, turn, y if turn % 2 else x)[:12], 16)
            x, y = ((x + f) % a, y) if turn % 2 else (x, (y + f) % b)
        return x * b + y

    def date(self, m: str, form: str) -> str | None:
        n = day(m, form)
        return None if n is None else (_START + datetime.timedelta(self.number(n, 189, 773, "date"))).strftime(form).zfill(10)

    def value(self, kind: str, m: str) -> str | None:
        d = re.sub("[^0-9]", "", m)
        if kind == "email":
            name, rest = m.split("@", 1)
            return f"{self.string(name, 'email')}@{rest}"
        if kind == "iban":
            p = m.replace(" ", "")
            if mod97(p[4:] + p[:4]) != 1:
                return None
            q = self.string(p[4:], p[:2])
            return put_back(m, f"{p[:2]}{98 - mod97(q + p[:2] + '00'):02d}{q}", " ")
        if kind == "ip":
            v = self.number(int.from_bytes(bytes(map(int, m.split("."))), "big"), 65536, 65536, "ip")
            return ".".join(map(str, v.to_bytes(4, "big")))
        if kind == "iso_date":
            return self.date(m, "%Y-%m-%d")
        if kind == "dot_date":
            return self.date(m, "%d.%m.%Y")
        if kind == "slash_date":
            if day(m, "%m/%d/%Y", False) is not None:
                return self.date(m, "%m/%d/%Y")
            n = day(m, "%d/%m/%Y")
            if n is None:
                return None
            n = self.number(n, 189, 773, "date")
            while (_START + datetime.timedelta(n)).day <= 12:
                n = self.number(n, 189, 773, "date")
            return (_START + datetime.timedelta(n)).strftime("%d/%m/%Y")
        if kind == "phone":
            code = re.match("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}", d)[0]
            return put_back(m, code + self.string(d[len(code) :], "phone" + code)) if 7 <= len(d) <= 16 else None
        if kind == "us_phone":
            return put_back(m, self.string(d, "phone1"))
        if kind == "ssn":
            area, group, serial = map(int, m.split("-"))
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            x, y = divmod(self.number(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn"), 9999)
            area = x // 99 + 1
            return f"{area + (area >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
        if luhn(d) % 10:
            return None
        q = self.string(d[:-1], "card")
        return put_back(m, f"{q}{-luhn(q + '0') % 10}")

    def text(self, text: str | None) -> tuple[str | None, int, int, list[str]]:
        """(text, n_found, n_replaced, kinds)."""
        found, kinds = 0, []

        def one(match: re.Match) -> str:
            nonlocal found
            found += 1
            kind = next((k for k in _ORDER if _KINDS[k].match(match[0])), None)
            new = kind and self.value(kind, match[0])
            if new is None:
                return match[0]
            kinds.append(kind)
            return new

        return (None, 0, 0, []) if text is None else (_ALL.sub(one, text), found, len(kinds), kinds)


def day(m: str, form: str, bounded: bool = True) -> int | None:
    try:
        n = (datetime.datetime.strptime(m, form).date() - _START).days
    except ValueError:
        return None
    return n if 0 <= n <= 146096 or not bounded else None


def luhn(d: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))


def mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def put_back(old: str, new: str, keep: str | None = None) -> str:
    """``old`` with its separators (``keep``, or all but digits) and the characters of ``new`` between them."""
    rest = iter(new)
    return "".join(c if (c == keep if keep else not c.isdigit()) else next(rest, "") for c in old)
