"""Operator 10, PII: format-preserving Feistel pseudonyms (DataFrame functions only).

Values are found by pattern and validated (Luhn, mod 97, ranges, calendar); what doesn't validate stays as it is. A valid value is
permuted by a keyed Feistel network over exactly its own format's domain, so that its pseudonym is valid in the same format,
separators stay where they are, equal values get equal pseudonyms in every document whatever their separators, and different
values different ones. Two kinds of network serve:

- strings (cards, IBANs, phone numbers, mail names): each half shifts the other's characters within their class (digit, lower or
  upper case), after a keyed shift of all; check digits are computed anew;
- numbers below a * b (dates within 400 years, social security numbers, IPv4 addresses): the parts below a and below b are added to by
  each other's hash, modulo a and b, which permutes the domain without walking in cycles.

Every hash is HMAC-SHA-512. Its key reaches the plan through a scalar subquery, so that neither the key nor what is derived from it
stands in explain output or event logs. Every repetition of a group in the patterns is bounded, so that no text is too long for them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, pick

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: The candidates' patterns, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,32}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.-]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w-]|\.\d)",
    "iso_date": r"(?<![\w/-])\d{4}-\d{2}-\d{2}(?=[Tt]\d{2}|(?![\w/-]))",
    "slash_date": r"(?<![\w/-])\d{2}/\d{2}/\d{4}(?![\w/-])",
    "dot_date": r"(?<![\w.-])\d{2}\.\d{2}\.\d{4}(?![\w-]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)",
    "us_phone": r"(?<![\w-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\w-])",
}
_ALL = "|".join(PATTERNS.values())
#: Country codes are prefix-free: one digit, those of two digits, else three.
_COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_DIGITS = "regexp_replace({}, '[^0-9]', '')"


def _hash(tag: str, turn: str, value: str) -> str:
    """HMAC-SHA-512, in hexadecimal, of tag, turn and value; __inner and __outer hold the padded key."""
    return f"sha2(concat(__outer, unhex(sha2(concat(__inner, cast(concat_ws('|', {tag}, {turn}, {value}) AS binary)), 512))), 512)"


def _pads(spark: SparkSession, key: str) -> DataFrame:
    """One row with the key as HMAC pads it for the inner and the outer hash."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (bytes(b ^ pad for b in raw) for pad in (0x36, 0x5C))
    return spark.sql("SELECT * FROM VALUES (:inner, :outer) AS t(inner, outer)", args={"inner": inner, "outer": outer})


def _once(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _shifted(text: str, digest: str) -> str:
    """Each character moved on within its class by four hexadecimal digits of the digest."""
    n = "cast(conv(substr(hh, ((ii - 1) % 32) * 4 + 1, 4), 16, 10) AS int)"
    moved = " ".join(f"WHEN cc BETWEEN '{a}' AND '{z}' THEN chr({ord(a)} + (ascii(cc) - {ord(a)} + {n}) % {size})" for a, z, size in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)))
    each = _once(f"substr({text}, ii, 1)", "cc", f"CASE {moved} ELSE cc END")
    return _once(digest, "hh", f"array_join(transform(sequence(1, greatest(1, length({text}))), ii -> {each}), '')")


def _string(text: str, tag: str) -> str:
    """The Feistel network over a string's halves; eight rounds bring each half back to its side."""
    start = _shifted(text, _hash(tag, "0", f"length({text})"))
    step = _shifted("acc.l", _hash(tag, "turn", "acc.r"))
    halves = "named_struct('l', left(ss, cast(length(ss) / 2 AS int)), 'r', substr(ss, cast(length(ss) / 2 AS int) + 1))"
    return _once(start, "ss", f"aggregate(sequence(1, 8), {halves}, (acc, turn) -> named_struct('l', acc.r, 'r', {step}), acc -> concat(acc.l, acc.r))")


def _number(x: str, y: str, a: int, b: int, tag: str) -> str:
    """The Feistel network over the numbers x * b + y with x below a and y below b."""
    f = lambda v: f"cast(conv(substr({_hash(tag, 'turn', v)}, 1, 12), 16, 10) AS bigint)"
    step = f"IF(turn % 2 = 1, named_struct('x', (acc.x + {f('acc.y')}) % {a}L, 'y', acc.y), named_struct('x', acc.x, 'y', (acc.y + {f('acc.x')}) % {b}L))"
    return f"aggregate(sequence(1, 8), named_struct('x', cast({x} AS bigint), 'y', cast({y} AS bigint)), (acc, turn) -> {step}, acc -> acc.x * {b}L + acc.y)"


def _luhn(digits: str) -> str:
    """The Luhn sum of a string of digits."""
    d = f"cast(substr({digits}, jj, 1) AS int)"
    return f"aggregate(sequence(1, length({digits})), 0, (tt, jj) -> tt + IF((length({digits}) - jj) % 2 = 1, {d} * 2 - IF({d} > 4, 9, 0), {d}))"


def _mod97(text: str) -> str:
    one = _once(f"substr({text}, jj, 1)", "cc", "CASE WHEN cc BETWEEN '0' AND '9' THEN (tt * 10 + cast(cc AS int)) % 97 ELSE (tt * 100 + ascii(cc) - 55) % 97 END")
    return f"aggregate(sequence(1, length({text})), 0, (tt, jj) -> {one})"


def _put_back(old: str, new: str, strip: str = "[^0-9]") -> str:
    """``old`` with its characters, but the separators, replaced by those of ``new`` in turn."""
    nth = f"length(regexp_replace(left({old}, pp), '{strip}', ''))"
    return f"array_join(transform(sequence(1, length({old})), pp -> IF(substr({old}, pp, 1) RLIKE '{strip}', substr({old}, pp, 1), substr({new}, {nth}, 1))), '')"


def _pseudonym(m: str) -> str:
    """A struct (kind, value) for a candidate, value null where it doesn't validate."""
    is_ = lambda kind: f"{m} RLIKE r'^(?:{PATTERNS[kind]})$'"
    mail = _once(f"substring_index({m}, '@', 1)", "name", f"""concat({_string("name", "'email'")}, substr({m}, length(name) + 1))""")
    plain = f"replace({m}, ' ', '')"
    check97 = _mod97("concat(q, left(p, 2), '00')")
    numbered_iban = f"concat(left(p, 2), lpad(cast(98 - {check97} AS string), 2, '0'), q)"
    moved = _once(_string("substr(p, 5)", "left(p, 2)"), "q", _once(numbered_iban, "w", _put_back(m, "w", "[ ]")))
    iban = _once(plain, "p", f"IF({_mod97('concat(substr(p, 5), left(p, 4))')} = 1, {moved}, NULL)")
    part = lambda i: f"cast(split({m}, '[.]')[{i}] AS bigint)"
    ip = _once(_number(f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", 1 << 16, 1 << 16, "'ip'"), "v", "concat_ws('.', shiftright(v, 24), shiftright(v, 16) & 255, shiftright(v, 8) & 255, v & 255)")

    def date(form: str) -> str:
        days = f"datediff(try_to_date({m}, '{form}'), DATE'1800-01-01')"
        moved = _number("cast(n / 773 AS int)", "n % 773", 189, 773, "'date'")
        return _once(days, "n", f"IF(n BETWEEN 0 AND 146096, date_format(date_add(DATE'1800-01-01', cast({moved} AS int)), '{form}'), NULL)")

    def day_first() -> str:
        """Dates that can't be month first, permuted until the day is over 12 again, so that none meets a month-first pseudonym."""
        step = _number("cast(ww / 773 AS int)", "ww % 773", 189, 773, "'date'")
        walk = f"aggregate(sequence(0, 60), cast(n AS bigint), (ww, kk) -> IF(kk = 0 OR day(date_add(DATE'1800-01-01', cast(ww AS int))) <= 12 OR ww > 146096, {step}, ww))"
        return _once(f"datediff(try_to_date({m}, 'dd/MM/yyyy'), DATE'1800-01-01')", "n", f"IF(n BETWEEN 0 AND 146096, date_format(date_add(DATE'1800-01-01', cast({walk} AS int)), 'dd/MM/yyyy'), NULL)")

    code = f"regexp_extract(d, '{_COUNTRY}', 0)"
    local = _once(_string("substr(d, length(code) + 1)", "concat('phone', code)"), "q", _once("concat(code, q)", "w", _put_back(m, "w")))
    phone = _once(_DIGITS.format(m), "d", _once(code, "code", f"IF(length(d) BETWEEN 7 AND 16, {local}, NULL)"))
    us = _once(_DIGITS.format(m), "d", _once(_string("d", "'phone1'"), "q", _put_back(m, "q")))
    area, group, serial = (f"cast(split({m}, '-')[{i}] AS int)" for i in range(3))
    valid = f"{area} NOT IN (0, 666) AND {area} < 900 AND {group} > 0 AND {serial} > 0"
    shown = "concat_ws('-', lpad(cast(cast(x / 99 AS int) + 1 + IF(cast(x / 99 AS int) + 1 >= 666, 1, 0) AS string), 3, '0'), lpad(cast(x % 99 + 1 AS string), 2, '0'), lpad(cast(v % 9999 + 1 AS string), 4, '0'))"
    moved = _number(f"({area} - 1 - IF({area} > 666, 1, 0)) * 99 + {group} - 1", f"{serial} - 1", 898 * 99, 9999, "'ssn'")
    ssn = f"IF({valid}, {_once(moved, 'v', _once('cast(floor(v / 9999) AS bigint)', 'x', shown))}, NULL)"
    check = "concat(q, cast((10 - {} % 10) % 10 AS string))".format(_luhn("concat(q, '0')"))
    moved = _once(_string("left(d, length(d) - 1)", "'card'"), "q", _once(check, "w", _put_back(m, "w")))
    card = _once(_DIGITS.format(m), "d", f"IF({_luhn('d')} % 10 = 0, {moved}, NULL)")
    made = {"email": mail, "iban": iban, "ip": ip, "iso_date": date("yyyy-MM-dd"), "slash_date": f"IF(try_to_date({m}, 'MM/dd/yyyy') IS NULL, {day_first()}, {date('MM/dd/yyyy')})", "dot_date": date("dd.MM.yyyy"), "phone": phone, "us_phone": us, "ssn": ssn, "card": card}
    cases = " ".join(f"WHEN {is_(kind)} THEN named_struct('kind', '{kind}', 'value', {value})" for kind, value in made.items())
    return f"CASE {cases} ELSE named_struct('kind', '', 'value', CAST(NULL AS string)) END"


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs``, all columns kept, with ``text`` rewritten and ``n_found`` (candidates), ``n_replaced`` (long), ``kinds`` (those replaced, in text order) after its own.

    Null texts stay null and empty ones empty, with zeros and no kinds. Rows that repeat come out alike; an empty table gives no rows.
    Slashed dates are month first, or day first where that is no date. Dates before 1800 or after 2199 stay. Each row is rewritten where it is read; nothing is shuffled.
    """
    text, pads = f"__c{docs.columns.index('text')}", _pads(docs.sparkSession, key)
    rows = numbered(docs).withColumns({f"__{side}": pads.select(side).scalar() for side in ("inner", "outer")})
    rows = rows.withColumn("__found", F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({_ALL})"), F.lit(0))))
    rows = rows.withColumn("__new", F.expr(f"transform(__found, m -> {_pseudonym('m')})"))
    gaps = F.split(F.col(text), _ALL, -1)
    filled = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("__new", i)["value"], F.get("__found", i), F.lit(""))))
    done = F.filter("__new", lambda s: s["value"].isNotNull())
    count = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    new = F.when(count(done) > 0, F.array_join(filled, "")).otherwise(F.col(text))
    out = [(new if f"__c{i}" == text else F.col(f"__c{i}")).alias(f"__o{i}") for i in range(len(docs.columns))]
    kinds = F.coalesce(F.transform(done, lambda s: s["kind"]), F.array().cast("array<string>"))
    return rows.select(*out, count(F.col("__found")), count(done), kinds).toDF(*docs.columns, "n_found", "n_replaced", "kinds")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_found, n_replaced, kinds: ``pseudonymised`` for (doc_id, text) alone."""
    return pseudonymised(pick(docs, doc_id="doc_id", text="text"), key)
