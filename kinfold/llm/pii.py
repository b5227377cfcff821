"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Values are found by one pattern, validated by kind (Luhn, mod 97, octet range, calendar, area), and
replaced by a keyed permutation within their format: a Feistel network whose round function is
SHA-256 of key, round and the other half. Where only a part of a network's domain is valid, the
network is applied until it is back in that part (cycle walking), which still is a permutation.
Equal values get equal pseudonyms in all documents, and who has the key can undo them
(:func:`restore`): what a pattern finds depends on the places of digits, letters and punctuation
only, which pseudonyms keep, and what fails its validation is left as it is and fails it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import col, fresh, let

ROUNDS = 10
#: Applications of a network until it must be back among the valid values. The smallest valid part
#: (dates with two one-digit parts) is a fifth of its domain: one value in 10**9 is not back by then.
STEPS = 96
#: Lengths of bank account numbers (IBAN) by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _iban_pattern() -> str:
    """Per length its countries and whole groups of four; so what follows a number is no part of it."""
    one = lambda n: rf"(?:{'|'.join(IBAN_LENGTHS[n].split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    return r"\b(?:" + "|".join(map(one, IBAN_LENGTHS)) + ")(?![0-9a-z])"


_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
_FOURS = lambda sep, not_after: rf"[0-9]{{4}}(?:{sep}[0-9]{{4}}{not_after}){{2,}}+(?:{sep}[0-9]{{1,3}}{not_after})?"
#: Patterns by kind, in the order they are tried. Repeats are bounded or never given back, so long
#: runs of letters or digits cost no more than their length.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,63}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:[a-z0-9]{1,30}[_.-]){0,3}(?:password|passwd|passphrase|pwd|token|secret|(?:api|access|private|secret)[_-]?key))\s{0,8}[=:]\s{0,8}[\"']?[^\s\"',;]{5,}[^\s\"',;.:!?)\]}][\"']?",
    "iban": _iban_pattern(),
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": rf"(?<![0-9/.-])(?:{_DATE})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9]|-[0-9]|(?: [0-9]{4}){2})"
    rf"|\+[0-9]{{8,15}}(?![0-9])|\+[0-9]{{1,3}}(?:[ .-](?!{_DATE})[0-9]{{2,8}}(?![0-9]|[/:])){{2,5}}",
    "card": rf"(?<![0-9])(?:[0-9]{{13,19}}|{_FOURS(' ', '(?![0-9]|[/.-][0-9])')}|{_FOURS('-', '(?![0-9])')}|[0-9]{{4}}([ -])[0-9]{{6}}[ -][0-9]{{4,5}})(?![0-9])".replace("([ -])", "[ -]"),
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these characters hold none of the kinds.
HINT = "[0-9@=:]"


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _hash(key: str, kind: Column, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, turn.cast("string"), other), 256)


def _draw(digest: Column, i: Column) -> Column:
    """The i-th 16-bit draw: sixteen are in the digest, each further sixteen in a digest of it."""
    own = F.when(i < 16, digest).otherwise(F.sha2(F.concat(digest, F.lit("|"), F.floor(i / 16).cast("string")), 256))
    return F.conv(F.substring(own, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _turned(half: Column, digest: Column, sign: int, hexa: bool = False) -> Column:
    """Every digit and letter of ``half`` moved within its class by the digest; the rest stays.

    With ``hexa`` the one class is that of the lower-case hexadecimal digits."""

    def one(c: Column, i: Column) -> Column:
        if hexa:
            moved = F.pmod(F.conv(c, 16, 10).cast("int") + sign * _draw(digest, i), F.lit(16))
            return F.when(c.rlike("[0-9a-f]"), F.lower(F.hex(moved))).otherwise(c)
        step = lambda low, size: F.char(F.lit(low) + F.pmod(F.ascii(c) - low + sign * _draw(digest, i), F.lit(size)))
        return F.when(c.between("0", "9"), step(48, 10)).when(c.between("a", "z"), step(97, 26)).when(c.between("A", "Z"), step(65, 26)).otherwise(c)

    return F.array_join(F.transform(_chars(half), one), "")


def _rounds(key: str, kind: str, left: Column, right: Column, turn, undo: bool) -> Column:
    """A Feistel network over two halves: odd rounds change the right one by the left, even the left."""
    order = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if undo else 1

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        other = F.when(even, acc["r"].cast("string")).otherwise(acc["l"].cast("string"))
        return let(
            _hash(key, F.lit(kind), r, other),
            lambda d: F.struct(
                F.when(even, turn(acc["l"], d, sign, 0)).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(turn(acc["r"], d, sign, 1)).alias("r")
            ),
        )

    return F.aggregate(F.reverse(order) if undo else order, F.struct(left.alias("l"), right.alias("r")), step)


def permute_text(s: Column, key: str, kind: str, undo: bool = False, hexa: bool = False) -> Column:
    """A string's letters and digits permuted within their classes, all else kept in place."""

    def halves(v: Column) -> Column:
        cut = F.floor(F.length(v) / 2).cast("int")
        left, right = F.substring(v, F.lit(1), cut), F.substring(v, cut + 1, F.length(v))
        return let(_rounds(key, kind, left, right, lambda h, d, sign, _: _turned(h, d, sign, hexa), undo), lambda a: F.concat(a["l"], a["r"]))

    return let(s, halves)


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, kind: str, undo: bool = False) -> Column:
    """A struct ``l, r`` of the pair permuted within range(sizes[0]) x range(sizes[1])."""
    turn = lambda v, d, sign, side: F.pmod(v + sign * F.conv(F.substring(d, F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(sizes[side]))
    return _rounds(key, kind, left.cast("long"), right.cast("long"), turn, undo)


def _until(start: Column, turn, ok) -> Column:
    """``turn`` applied to ``start`` once, and on until ``ok`` holds of the value."""
    step = lambda a, _: F.when(a["ok"], a).otherwise(let(turn(a["v"]), lambda x: F.struct(x.alias("v"), ok(x).alias("ok"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(start.alias("v"), F.lit(False).alias("ok")), step, lambda a: a["v"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def _luhn(digits: Column, double_last: bool) -> Column:
    """Luhn sum of a digit string; ``double_last``: a check digit is still to be added."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = (n - 1 - i) % 2 == (0 if double_last else 1)
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), one), F.lit(0), lambda a, x: a + x)


def _into(shape: Column, digits: Column) -> Column:
    """``digits`` put in the places of the digits of ``shape``."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def step(a: Column, c: Column) -> Column:
        own = c.between("0", "9")
        return F.struct(F.concat(a["s"], F.when(own, F.substring(digits, a["k"] + 1, F.lit(1))).otherwise(c)).alias("s"), (a["k"] + own.cast("int")).alias("k"))

    return F.aggregate(_chars(shape), start, step, lambda a: a["s"])


def _card_number(d: Column, key: str, undo: bool) -> Column:
    """A valid number for a valid number: all but the check digit permuted, and that made anew."""
    body = permute_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", undo)
    return let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - _luhn(b, True), F.lit(10)).cast("string")))


def _card(m: Column, key: str, undo: bool) -> Column:
    """``v, n``: the match with its card numbers replaced, and how many there were.

    Without groups of four the match is one number or none. In a row of such groups a number may
    start at any of them and has 16 digits, or else what is left of the row if that are 13 to 19;
    the first valid one counts, and the search goes on behind it. Its pseudonym must leave all that
    was tried before it invalid, so that the same numbers are found in the pseudonymised row.
    """
    whole = let(_digits(m), lambda d: F.when(_luhn(d, False) % 10 == 0, let(_card_number(d, key, undo), lambda x: F.struct(_into(m, x).alias("v"), F.lit(1).alias("n")))))
    sep = F.substring(m, F.lit(5), F.lit(1))

    def size_of(d: Column, rest: Column) -> Column:
        """Digits of the number that starts with ``d``, of a row that goes on for ``rest`` digits; or 0."""
        valid = lambda size: _luhn(F.substring(d, F.lit(1), size), False) % 10 == 0
        return F.when((rest >= 16) & valid(F.lit(16)), F.lit(16)).when(rest.between(13, 19) & (rest % 4 != 0) & valid(rest), rest).otherwise(F.lit(0))

    def row(g: Column) -> Column:
        total = 4 * F.size(g) - 4 + F.length(F.element_at(g, -1))
        joined = lambda at, n: F.array_join(F.slice(g, at + 1, n), "")

        def replaced(a: Column, i: Column, size: Column) -> Column:
            end, first = i + F.ceil(size / 4).cast("int"), F.greatest(a["next"], i - 4)

            def same(w: Column) -> Column:
                def none_before(d: Column) -> Column:
                    early = F.forall(F.sequence(first, F.greatest(first, i - 1)), lambda k: size_of(F.substring(d, 4 * (k - first) + 1, F.lit(19)), total - 4 * k) == 0)
                    return (size_of(w, total - 4 * i) == size) & ((first == i) | early)

                return let(F.concat(joined(first, i - first), w, joined(end, F.lit(5))), none_before)

            new = _until(F.substring(joined(i, F.lit(5)), F.lit(1), size), lambda w: _card_number(w, key, undo), same)
            return F.struct(end.alias("next"), F.concat(a["all"], F.array(F.struct(i.alias("from"), end.alias("to"), new.alias("w")))).alias("all"))

        def step(a: Column, i: Column) -> Column:
            return F.when(i < a["next"], a).otherwise(let(size_of(joined(i, F.lit(5)), total - 4 * i), lambda size: F.when(size == 0, a).otherwise(replaced(a, i, size))))

        def text(a: Column) -> Column:
            fours = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / 4).cast("int")), lambda j: F.substring(w, 4 * j + 1, F.lit(4)))
            to = lambda n: F.coalesce(F.get(a["all"], n)["to"], F.lit(0))
            parts = F.flatten(F.transform(a["all"], lambda x, n: F.concat(F.slice(g, to(n - 1) + 1, x["from"] - to(n - 1)), fours(x["w"]))))
            rest = F.slice(g, F.element_at(a["all"], -1)["to"] + 1, F.size(g))
            own = let(F.concat(parts, rest), lambda x: F.when(sep == " ", F.array_join(x, " ")).otherwise(F.array_join(x, "-")))
            return F.struct(own.alias("v"), F.size(a["all"]).alias("n"))

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<from:int,to:int,w:string>>").alias("all"))
        done = F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, step)
        return let(done, lambda a: F.when(F.size(a["all"]) > 0, text(a)))

    return F.when(m.rlike("^[0-9]{4}[ -][0-9]{4}[ -]"), let(F.split(m, "[ -]"), row)).otherwise(whole)


def _mod97(s: Column) -> Column:
    """An IBAN's remainder, its first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))
    return F.aggregate(
        _chars(moved), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    )


def _iban(m: Column, key: str, undo: bool) -> Column:
    """Country and layout stay; check digits are those of the new number (02 to 98, as are valid ones)."""

    def build(s: Column) -> Column:
        country, body = F.substring(s, F.lit(1), F.lit(2)), F.substring(s, F.lit(5), F.length(s))

        def close(b: Column) -> Column:
            made = F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b)
            return let(made, lambda v: F.array_join(F.transform(_chars(m), lambda c, i: F.when(c == " ", c).otherwise(F.substring(v, i + 1 - _blanks(m, i), F.lit(1)))), ""))

        return let(permute_text(body, key, "iban", undo), close)

    check = F.substring(m, F.lit(3), F.lit(2))
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda s: F.when((_mod97(s) == 1) & check.between("02", "98"), build(s)))


def _blanks(m: Column, i: Column) -> Column:
    head = F.substring(m, F.lit(1), i)
    return F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))


def _ip(m: Column, key: str, undo: bool) -> Column:
    """Octets from 0 to 255, written without leading zeros."""

    def build(o: Column) -> Column:
        pair = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ip", undo)
        return let(pair, lambda p: F.concat_ws(".", *(F.floor(p[h] / s).cast("int") % 256 for h in "lr" for s in (256, 1))))

    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return let(octets, lambda o: F.when(F.forall(o, lambda x: x < 256) & ~m.rlike(r"(^|\.)0[0-9]"), build(o)))


#: The days of the 400 years from 1700-01-01 are 189 * 773, a domain a Feistel network fits exactly.
FIRST_DAY, DAYS = "1700-01-01", (189, 773)


def _date(m: Column, key: str, undo: bool) -> Column:
    """Dates of 1700 to 2099, year first, day first, or month first where only that is a date. The
    pseudonym is read in the same order, and one-digit parts are of one digit again."""
    zero, last = F.lit(FIRST_DAY).cast("date"), DAYS[0] * DAYS[1] - 1
    date = lambda n: F.date_add(zero, n)

    def read(p: Column, order: tuple[int, int, int]) -> Column:
        """The day by the places of year, month and day, and that order; null if there is no such date."""
        text = F.concat_ws("-", *(p[order[0]], F.lpad(p[order[1]], 2, "0"), F.lpad(p[order[2]], 2, "0")))
        return let(F.datediff(F.try_to_date(text, "yyyy-MM-dd"), zero), lambda n: F.when(n.between(0, last), F.struct(n.alias("n"), F.lit("".join(map(str, order))).alias("order"))))

    def turn(n: Column) -> Column:
        pair = permute_pair(F.floor(n / DAYS[1]), n % DAYS[1], DAYS, key, "date", undo)
        return let(pair, lambda q: (q["l"] * DAYS[1] + q["r"]).cast("int"))

    def made(p: Column, found: Column) -> Column:
        day_first, month_first = found["order"] == "210", found["order"] == "201"

        def ok(x: Column) -> Column:
            day, month = F.dayofmonth(date(x)), F.month(date(x))
            a, b = F.when(month_first, month).otherwise(day), F.when(month_first, day).otherwise(month)
            fits = ((F.length(p[0]) > 1) | (a < 10)) & ((F.length(p[1]) > 1) | (b < 10))
            return ~(day_first | month_first) | (fits & (day_first | (day > 12)))

        def text(x: Column) -> Column:
            part = lambda k: F.when(F.length(p[k]) > 1, F.lpad(v[k].cast("string"), 2, "0")).otherwise(v[k].cast("string"))
            day, month = F.dayofmonth(date(x)), F.month(date(x))
            v = [F.when(month_first, month).otherwise(day), F.when(month_first, day).otherwise(month)]
            year = F.date_format(date(x), "yyyy")
            other = F.array_join(F.array(part(0), part(1), year), "/")
            return F.when(m.contains("/"), other).when(day_first | month_first, F.replace(other, F.lit("/"), F.lit("."))).otherwise(F.date_format(date(x), "yyyy-MM-dd"))

        return F.when(found.isNotNull(), let(_until(found["n"], turn, ok), text))

    def pick(p: Column) -> Column:
        found = F.when(m.contains("-"), read(p, (0, 1, 2))).otherwise(F.coalesce(read(p, (2, 1, 0)), read(p, (2, 0, 1))))
        return let(found, lambda f: made(p, f))

    return let(F.split(m, "[-/.]"), pick)


#: Social security areas (001 to 899 but for 666) by groups (01 to 99), and serials (0001 to 9999).
SSN = (898 * 99, 9999)


def _ssn(m: Column, key: str, undo: bool) -> Column:
    def build(p: Column) -> Column:
        area, group, serial = (F.substring(m, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
        pair = permute_pair((area - 1 - (area > 666).cast("int")) * 99 + group - 1, serial - 1, SSN, key, "ssn", undo)

        def text(q: Column) -> Column:
            a = F.floor(q["l"] / 99).cast("int") + 1
            pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
            return F.concat_ws("-", pad(a + (a >= 666).cast("int"), 3), pad(q["l"] % 99 + 1, 2), pad(q["r"] + 1, 4))

        return let(pair, text)

    return F.when(~m.rlike("^(000|666|9)|-00-|-0000$"), let(m, build))


def _phone(m: Column, key: str, undo: bool) -> Column:
    """Seven to fifteen digits. Those behind the country code are permuted whatever stands between
    them, so that one number's spellings stay linked; ten that are a North American number (area
    and exchange from 2 to 9) become one."""
    head = F.regexp_extract(m, r"^(?:\+1(?=[0-9]{10}$)|\+[0-9]{1,3}(?=[ .(-]))", 0)
    american = lambda d: d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")

    def build(h: Column) -> Column:
        rest = F.substring(m, F.length(h) + 1, F.length(m))
        new = lambda d: _until(d, lambda v: permute_text(v, key, "phone", undo), lambda v: american(v) == american(d))
        return F.concat(h, let(_digits(rest), lambda d: let(new(d), lambda v: _into(rest, v))))

    return F.when(F.length(_digits(m)).between(7, 15), let(head, build))


def _secret(m: Column, key: str, undo: bool) -> Column:
    """A secret's value after its name; one of hexadecimal digits stays one, and another never becomes one."""
    first = F.regexp_extract(m, r"^(?:AKIA|[^=:]{1,200}[=:]\s*[\"']?)", 0)
    is_hex = lambda v: v.rlike("^[0-9a-f]+[\"']?$")

    def build(h: Column) -> Column:
        value = F.substring(m, F.length(h) + 1, F.length(m))
        text = _until(value, lambda v: permute_text(v, key, "secret", undo), lambda v: ~is_hex(v))
        return F.concat(h, F.when(is_hex(value), permute_text(value, key, "secret", undo, True)).otherwise(text))

    return let(first, build)


def _email(m: Column, key: str, undo: bool) -> Column:
    """The local part; the host, which many share, stays."""
    at = F.substring_index(m, "@", 1)
    host = F.substring_index(m, "@", -1)
    return F.concat(permute_text(at, key, "email", undo), F.lit("@"), host)


def kind_of(m: Column) -> Column:
    """The kind of a found value: the first whose whole pattern it matches."""
    out = F.when(m.rlike(f"^(?:{PATTERNS[KINDS[0]]})$"), KINDS[0])
    for k in KINDS[1:]:
        out = out.when(m.rlike(f"^(?:{PATTERNS[k]})$"), k)
    return out.otherwise("")


def _pseudonym(m: Column, kind: Column, key: str, undo: bool) -> Column:
    """``v, n``: what stands for the match and how many values that were; null if none is valid."""
    made = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}
    one = lambda v: let(v, lambda x: F.when(x.isNotNull(), F.struct(x.alias("v"), F.lit(1).alias("n"))))
    out = F.when(kind == "card", _card(m, key, undo))
    for k, f in made.items():
        out = out.when(kind == k, one(f(m, key, undo)))
    return out


def _found(text: Column, key: str, undo: bool) -> Column:
    """The text with pseudonyms and the kinds replaced, in order."""

    def one(m: Column) -> Column:
        def close(k: Column) -> Column:
            none = F.array().cast("array<string>")
            return let(_pseudonym(m, k, key, undo), lambda p: F.struct(F.coalesce(p["v"], m).alias("v"), F.when(p.isNotNull(), F.array_repeat(k, p["n"])).otherwise(none).alias("k")))

        return let(kind_of(m), close)

    def joined(made: Column) -> Column:
        gaps = F.split(text, ANY, -1)
        whole = let(gaps, lambda g: F.array_join(F.transform(g, lambda s, i: F.concat(s, F.coalesce(F.get(made, i)["v"], F.lit("")))), ""))
        return F.struct(whole.alias("text"), F.flatten(F.transform(made, lambda x: x["k"])).alias("kinds"))

    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike(HINT), let(F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), one), joined)).otherwise(none)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text, n_pii`` and ``n_<kind>`` for each kind.

    Null texts stay null with counts 0. Null ids and repeated rows pass through, an empty table
    gives no row. A pseudonym has its original's punctuation, letter case, validity and, but for the
    octets of an address, length. Left as they are: what only looks like a value (a wrong check
    digit, a day that never was, octets above 255 or with leading zeros), dates before 1700 or
    after 2099, and hosts of mail addresses.
    """
    made = docs.select(col(id_col).alias("doc_id"), F.when(col(text_col).isNotNull(), _found(col(text_col), key, False)).alias("f"))
    kinds = F.coalesce(F.col("f.kinds"), F.array().cast("array<string>"))
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, w))).cast("long").alias(f"n_{w}") for w in KINDS]
    return made.select("doc_id", F.col("f.text").alias("text"), F.size(kinds).cast("long").alias("n_pii"), *counts)


def apply(docs: DataFrame, key: str, text_col: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with all their columns, the values in ``text_col`` replaced (or put back)."""
    name = fresh(docs.columns, "found")
    rows = docs.select("*", F.when(col(text_col).isNotNull(), _found(col(text_col), key, undo)).alias(name))
    return rows.select(*(F.col(f"{name}.text").alias(c) if c == text_col else col(c) for c in docs.columns))


def restore(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Undo :func:`apply` with the same key, exactly: digits, letter case and punctuation are as they were."""
    return apply(docs, key, text_col, undo=True)
