"""Pseudonyms of random values in random surroundings: found, valid, distinct, and undone exactly."""

import calendar
import hashlib
import random
import re

from kinfold.llm import pii

SCHEMA = "doc_id long, text string"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def card(r, n=None):
    d = "".join(r.choice("0123456789") for _ in range((n or r.randint(13, 19)) - 1))
    return next(d + c for c in "0123456789" if luhn(d + c) == 0)


def grouped(d, sizes, sep):
    out, at = [], 0
    for n in sizes:
        out.append(d[at : at + n])
        at += n
    return sep.join(out)


def any_card(r):
    sep = r.choice(" -")
    layout = r.choice([None, (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 4, 4, 4, 3)])
    if layout is None:
        return card(r)
    while True:
        d = card(r, sum(layout))
        if len(layout) < 5 or luhn(d[:16]):  # a row of four groups of its own counts before the longer one
            return grouped(d, layout, sep)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def iban(r):
    n = r.choice(list(pii.IBAN_LENGTHS))
    body = "".join(r.choice("0123456789ABCXYZ") for _ in range(n - 4))
    country = r.choice(pii.IBAN_LENGTHS[n].split())
    s = f"{country}{98 - mod97(country + '00' + body):02d}{body}"
    return s if r.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, n, 4))


def date(r):
    y, m = r.randint(1700, 2099), r.randint(1, 12)
    d = r.randint(1, calendar.monthrange(y, m)[1])
    a, b = r.choice([(d, m), (m, d)])
    pad = lambda v: r.choice([str(v), f"{v:02d}"])
    return r.choice([f"{y}-{m:02d}-{d:02d}", f"{pad(a)}/{pad(b)}/{y}", f"{pad(a)}.{pad(b)}.{y}"])


def ssn(r):
    return f"{r.choice([x for x in range(1, 900) if x != 666]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"


def phone(r):
    d = "".join(r.choice("0123456789") for _ in range(10))
    return r.choice(["{0}-{1}-{2}", "{0}.{1}.{2}", "({0}) {1}-{2}", "({0}){1}-{2}", "+1 ({0}) {1}-{2}", "+1({0}){1}-{2}", "+1{0}{1}{2}", "+44 {0} {1} {2}"]).format(d[:3], d[3:6], d[6:])


def word(r, n, letters="abcdefghijklmnopqrstuvwxyz0123456789"):
    return "".join(r.choice(letters) for _ in range(n))


def secret(r):
    name = r.choice(["password=", "Password: ", "API_KEY=", "client_secret=", "token = \"", "access-key: "])
    value = r.choice([word(r, r.randint(6, 60)), word(r, r.randint(6, 40), "0123456789abcdef"), word(r, 12, "abcXYZ019-_!")])
    return name + value + '"' * name.endswith('"')


MAKE = {
    "card": any_card, "iban": iban, "date": date, "ssn": ssn, "phone": phone, "secret": secret, "ip": lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    "email": lambda r: f"{word(r, r.randint(2, 40))}.{word(r, 3)}+{word(r, 2)}@{word(r, 5)}.example.com",
}
AROUND = [
    "{}", "Is {}.", "see ({}), please", "{} 12/27 cvv 123", "{} 12 27", "{} EUR 50", "{} 2019-01-02 x", "{} 04/13/2019", "of {}; {}", "no {} ABC123", "12 {} 7", "1234 {} 5678", "{}\n{}\t{}", "x: {}, 10.0.0.1",
]


def valid(kind, v):
    digits = re.sub(r"\D", "", v)
    if kind == "card":
        return luhn(digits) == 0
    if kind == "iban":
        s = v.replace(" ", "")
        return mod97(s) == 1 and "02" <= s[2:4] <= "98"
    if kind == "ip":
        return all(int(o) < 256 and str(int(o)) == o for o in v.split("."))
    if kind == "ssn":
        a, g, s = v.split("-")
        return 0 < int(a) < 900 and a != "666" and int(g) > 0 and int(s) > 0
    if kind == "date":
        p = [int(x) for x in re.split("[-/.]", v)]
        y, rest = (p[0], p[1:]) if "-" in v else (p[2], p[:2])
        return any(1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1] for d, m in (rest, rest[::-1]))
    return True


def shape(v):
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", v)))


def same_spelling(kind, v):
    return re.sub("0+", "0", shape(v)) if kind == "ip" else shape(v).replace("0", "a") if kind == "secret" else shape(v)


def surrounded(kind, v, r):
    form = r.choice(AROUND)
    if kind in ("email", "ip", "secret") or form.startswith(("12 ", "1234 ")) and kind in ("phone", "ssn", "iban"):
        form = r.choice(AROUND[:3])
    if kind == "date":  # other dates around would be replaced too
        form = r.choice([f for f in AROUND if "/" not in f and "-" not in f])
    if v.startswith("+44"):  # how many groups such a number has cannot be told
        form = r.choice(AROUND[:3])
    return form, form.replace("{}", v)


def test_values_are_found_stay_valid_and_come_back(spark):
    r = random.Random(11)
    values = [(kind, MAKE[kind](r)) for kind in MAKE for _ in range(120)]
    inside = [surrounded(kind, v, r) for kind, v in values]
    n = len(values)
    df = spark.createDataFrame([*enumerate(t for _, t in inside), *((n + k, v) for k, (_, v) in enumerate(values))], SCHEMA)
    got = {x["doc_id"]: x for x in pii.pseudonymise(df, "k").collect()}
    back = {x["doc_id"]: x["text"] for x in pii.restore(spark.createDataFrame([(k, x["text"]) for k, x in got.items()], SCHEMA), "k").collect()}
    pseudonyms = {}
    for k, ((kind, v), (form, text)) in enumerate(zip(values, inside)):
        made, p = got[k]["text"], got[n + k]["text"]
        assert got[n + k][f"n_{kind}"] == got[n + k]["n_pii"] == 1, (v, p)
        assert valid(kind, p) and same_spelling(kind, p) == same_spelling(kind, v), (v, p)
        if kind != "card" or not re.match("12|1234", form):
            assert p in made, (form, v, p, made)
        assert v not in made, (text, made)
        assert back[k] == text and back[n + k] == v, (text, made, back[k])
        pseudonyms.setdefault(p, set()).add(v)
    assert all(len(x) == 1 for x in pseudonyms.values())


def test_one_number_in_all_spellings(spark):
    d = ("555", "123", "4567")
    forms = ["{}-{}-{}", "{}.{}.{}", "({}) {}-{}", "({}){}-{}", "+1 ({}) {}-{}", "+1{}{}{}"]
    df = spark.createDataFrame([(k, f.format(*d)) for k, f in enumerate(forms)], SCHEMA)
    got = [re.sub(r"\D", "", r["text"].replace("+1", "")) for r in pii.apply(df, "k").orderBy("doc_id").collect()]
    assert len(set(got)) == 1 and got[0] != "".join(d)


def test_rows_of_cards_and_numbers(spark):
    """Cards among other groups of four, several in a row, and near misses."""
    r = random.Random(3)
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(r.randint(1, 6)):
            parts += [grouped(card(r, 16), (4,) * 4, " ")] if r.random() < 0.6 else [word(r, 4, "0123456789") for _ in range(r.randint(1, 4))]
        texts.append(" ".join(parts) + r.choice(["", " 12", " 123", " 12/27", "."]))
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    made = pii.apply(df, "k")
    for t, b, p in zip(texts, pii.restore(made, "k").orderBy("doc_id").collect(), made.orderBy("doc_id").collect()):
        assert b["text"] == t
        groups = re.findall(r"\d{4}(?!\d|/)", t)
        k = 0
        while k + 4 <= len(groups):  # the first valid number counts, then what is behind it
            if luhn("".join(groups[k : k + 4])) == 0:
                assert " ".join(groups[k : k + 4]) not in p["text"]
                k += 4
            else:
                k += 1


def test_what_is_not_valid_stays(spark):
    texts = ["4204066395720574", "1984-02-30", "300.1.1.1", "000-12-3456", "666-12-3456", "DE88 3704 0044 0532 0130 00", "01.002.3.4", "31/31/2000", "1066-10-14"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert [r["text"] for r in pii.apply(df, "k").orderBy("doc_id").collect()] == texts


def test_hexadecimal_secrets_stay_apart_from_others(spark):
    """Every pseudonym of a short alphabet, so that a clash of the two kinds would show."""
    values = [f"password={'abcde'}{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame(list(enumerate(values)), SCHEMA)
    made = pii.apply(df, "k")
    got = [r["text"] for r in made.orderBy("doc_id").collect()]
    assert len(set(got)) == len(values)
    is_hex = lambda v: bool(re.fullmatch("password=[0-9a-f]+", v))
    assert list(map(is_hex, got)) == list(map(is_hex, values))
    assert [r["text"] for r in pii.restore(made, "k").orderBy("doc_id").collect()] == values


def draws(digest):
    for block in range(9):
        own = digest if not block else hashlib.sha256(f"{digest}|{block}".encode()).hexdigest()
        yield from (int(own[k : k + 4], 16) for k in range(0, 64, 4))


def feistel(value, key, kind):
    """The network of digits and letters, written again in Python."""
    cut = len(value) // 2
    half = [value[:cut], value[cut:]]
    for r in range(pii.ROUNDS):
        side = r % 2
        d = hashlib.sha256("|".join([key, kind, str(r), half[1 - side]]).encode()).hexdigest()
        out = ""
        for c, step in zip(half[side], draws(d)):
            low, n = next(((ord(a), n) for a, z, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)) if a <= c <= z), (None, 0))
            out += chr(low + (ord(c) - low + step) % n) if n else c
        half[side] = out
    return "".join(half)


def pair(left, right, sizes, key, kind):
    half = [left, right]
    for r in range(pii.ROUNDS):
        side = r % 2
        d = hashlib.sha256("|".join([key, kind, str(r), str(half[1 - side])]).encode()).hexdigest()
        half[side] = (half[side] + int(d[:8], 16)) % sizes[side]
    return half


def test_matches_a_plain_network(spark):
    long = "x1" * 45
    phone_ = "5551234567"
    made = feistel(phone_, "k", "phone")
    while re.match("[2-9]..[2-9]", made):
        made = feistel(made, "k", "phone")
    a, s = pair(122 * 99 + 44, 6788, pii.SSN, "k", "ssn")
    area = a // 99 + 1 + (a // 99 + 1 >= 666)
    ip = pair(10 * 256, 255 * 256 + 3, (65536, 65536), "k", "ip")
    df = spark.createDataFrame([(1, f"x joe.doe7@a.example.com y 555-123-4567 z 123-45-6789 t token={long} i 10.0.255.3")], SCHEMA)
    want = (
        f"x {feistel('joe.doe7', 'k', 'email')}@a.example.com y {made[:3]}-{made[3:6]}-{made[6:]} z {area:03d}-{a % 99 + 1:02d}-{s + 1:04d}"
        f" t token={feistel(long, 'k', 'secret')} i {ip[0] // 256}.{ip[0] % 256}.{ip[1] // 256}.{ip[1] % 256}"
    )
    assert pii.pseudonymise(df, "k").first()["text"] == want
