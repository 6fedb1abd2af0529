import datetime
import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from worktrail.llm.pii import ANY, pseudonymise

SECRET = "k"


def noise(kind, step, other):
    return int(hashlib.sha256(f"{SECRET}|{kind}|{step}|{other}".encode()).hexdigest()[:15], 16)


def feistel(a, b, m, n, kind):
    for step in range(1, 11):
        a, b, m, n = b, (a + noise(kind, step, b)) % m, n, m
    return a, b


def number(digits, kind):
    u = len(digits) // 2
    v = len(digits) - u
    a, b = feistel(int(digits[:u]), int(digits[u:]), 10**u, 10**v, kind)
    return f"{a:0{u}d}{b:0{v}d}"


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def refill(form, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def letters(v, kind):
    u = (len(v) + 1) // 2
    a, b = v[:u], v[u:]
    for step in range(1, 11):
        stream = hashlib.sha256(f"{SECRET}|{kind}|{step}|{b}".encode()).hexdigest()
        out = ""
        for i, c in enumerate(a):
            by = int(stream[4 * (i % 16) : 4 * (i % 16) + 4], 16) + i
            first, size = (48, 10) if c in "0123456789" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (0, 0)
            out += chr(first + (ord(c) - first + by) % size) if size else c
        a, b = b, out
    return a + b


def brute(value):
    """Pseudonym of one match, written apart from the operator."""
    d = re.sub("[^0-9]", "", value)
    if "@" in value:
        name, host = value.split("@")
        return letters(name, "email") + "@" + host
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}.*", value):
        flat = value.replace(" ", "")
        code = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
        if code(flat[4:] + flat[:4]) != 1:
            return value
        body = letters(flat[4:], "iban")
        it = iter(f"{flat[:2]}{98 - code(body + flat[:2] + '00'):02d}{body}")
        return "".join(c if c == " " else next(it) for c in value)
    for order, pattern in (("ymd", r"\d{4}-\d\d-\d\d"), ("mdy", r"\d\d/\d\d/\d{4}"), ("dmy", r"\d\d([./])\d\d\1\d{4}")):
        if re.fullmatch(pattern, value):
            form = {"ymd": "%Y-%m-%d", "mdy": "%m/%d/%Y", "dmy": f"%d{value[2]}%m{value[2]}%Y"}[order]
            try:
                days = (datetime.datetime.strptime(value, form) - datetime.datetime(1700, 1, 1)).days
            except ValueError:
                continue
            if not 0 <= days < 146097:
                return value
            a, b = feistel(days // 773, days % 773, 189, 773, "date")
            return (datetime.datetime(1700, 1, 1) + datetime.timedelta(days=a * 773 + b)).strftime(form)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", value):
        x, y, z = map(int, value.split("-"))
        if not (0 < x < 900 and x != 666 and y and z):
            return value
        a, b = feistel(x - 2 if x > 666 else x - 1, (y - 1) * 9999 + z - 1, 898, 99 * 9999, "ssn")
        return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if re.fullmatch(r"(\d+\.){3}\d+", value):
        o = value.split(".")
        if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in o):
            return value
        o = list(map(int, o))
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return ".".join(map(str, (*divmod(a, 256), *divmod(b, 256))))
    if re.search(r"^[+(]|^\d{3}[ .-]\d{3}[ .-]\d{4}$", value):
        kept = max(len(d) - 10, 0)
        return refill(value, d[:kept] + number(d[kept:], "phone")) if 8 <= len(d) <= 15 else value
    if 13 <= len(d) <= 19 and luhn(d) == 0 and int(d):
        body = number(d[:-1], "card")
        return refill(value, body + str((10 - luhn(body + "0")) % 10))
    return value


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii_kinds string")
    return {r.doc_id: r for r in pseudonymise(docs, SECRET).collect()}


CASES = [
    ("bob.smith42@mail7.example.com", "email"), ("A@b.co", "email"), ("+1 (663) 555-6869", "phone"), ("212-555-0123", "phone"), ("+49 30 1234567", "phone"), ("4111111111111111", "card"),
    ("4111-1111-1111-1111", "card"), ("378282246310005", "card"), ("4111111111111112", None), ("0000000000000000", None), ("192.168.1.255", "ip"), ("999.1.1.1", None), ("01.2.3.4", None),
    ("2024-02-29", "date"), ("2023-02-29", None), ("12/31/1999", "date"), ("31/12/1999", "date"), ("31.12.1999", "date"), ("31.12/1999", None), ("1500-01-01", None), ("123-45-6789", "ssn"),
    ("000-45-6789", None), ("666-45-6789", None), ("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban"), ("DE88370400440532013000", None),
]


def test_each_format_equals_brute_force(spark):
    got = run(spark, [f"see {v}, or {v}." for v, _ in CASES])
    for i, (value, kind) in enumerate(CASES):
        new = brute(value)
        assert got[i].text == f"see {new}, or {new}." and got[i].pii_kinds == ([kind] * 2 if kind else []), value
        assert (new != value) == (kind is not None)
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", new))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", value))) or kind == "ip"


def test_whole_texts_nulls_and_repeats(spark):
    texts = [None, "", "no personal data", "4111111111111111", "4111111111111111", "x4111111111111111", "a@b", "1.2.3.4.5", "3.14 and 2 + 2", "né 4111111111111111 é", "word " * 30000 + "10.0.0.1"]
    got = run(spark, texts)
    assert [got[i].text for i in (0, 1, 2, 5, 6, 7, 8)] == [texts[i] for i in (0, 1, 2, 5, 6, 7, 8)] and got[0].pii_kinds == []
    assert got[3].text == got[4].text == brute(texts[3]) and got[9].text == f"né {brute(texts[3])} é" and got[10].text == "word " * 30000 + brute("10.0.0.1")
    with pytest.raises(ValueError):
        pseudonymise(spark.createDataFrame([("a",)], "text string"), "a|b")


def test_pseudonyms_are_one_to_one(spark):
    rng = random.Random(1)
    ips = sorted({".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(3000)})
    got = run(spark, ips)
    assert len({r.text for r in got.values()}) == len(ips)
    days = [(datetime.date(1999, 1, 1) + datetime.timedelta(days=i)).isoformat() for i in range(2000)]
    new = [r.text for r in run(spark, days).values()]
    assert len(set(new)) == 2000 and all(datetime.date.fromisoformat(x) for x in new)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.text for r in pseudonymise(docs, SECRET).collect()}
    some = 0
    for r in docs.collect():
        new = re.sub(ANY, lambda m: brute(m[0]), r.text)
        some += new != r.text
        assert got[r.doc_id] == new
    assert some > 20


def test_no_python_on_the_path(spark):
    plan = pseudonymise(spark.createDataFrame([(1, "a")], "doc_id long, text string"), SECRET)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def valid_iban(country, body):
    code = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{98 - code:02d}{body}"


def test_values_end_where_their_format_ends(spark):
    """Capitals and digits behind a value, other groups of card digits, a full stop before it."""
    fours = lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    ibans = ["BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", fours(valid_iban("AT", "1904300234573201")), fours(valid_iban("PL", "109010140000071219812874")), valid_iban("NO", "86011117947"), fours(valid_iban("DE", "370400440532013000"))]
    cases = [(v, "iban", f"IBAN {{}}{tail}") for v in ibans for tail in (" BIC GKCCBEBB", " US", " 12", " 2024 PAID", "")]
    long = next(f"630400000000000012{c}" for c in "0123456789" if luhn(f"630400000000000012{c}") == 0)
    cases += [(v, "card", f"card {{}}{tail}") for v in ("3782 822463 10005", "3782-822463-10005", fours(long), long) for tail in ("", " 12", " PAID")]
    cases += [("4111 1111 1111 1111", "card", "card {} 123"), ("4111-1111-1111-1111", "card", "card {} 123 12/27"), ("4111111111111111", "card", "card {} 123")]
    cases += [("555-123-4567", "phone", "Tel.{}"), ("2024-02-29", "date", "on.{} or")]
    got = run(spark, [form.format(v) for v, _, form in cases])
    for i, (v, kind, form) in enumerate(cases):
        assert brute(v) != v and got[i].text == form.format(brute(v)) and got[i].pii_kinds == [kind], form.format(v)
    kept = ["4111 1111 1111 1112 123", "v1.10.0.0.1", "3782 822463 10006"]
    assert [r.text for r in run(spark, kept).values()] == kept


def test_long_texts_of_separators(spark):
    """A megabyte of what a format may repeat: neither the stack nor the time runs out."""
    bits = ["a.", "a@", "a@a.", "1-", "1.", "1 ", "12 34 ", "+1", "(1", "AB12 ", "AB12", "9", "a-", "a%", "@"]
    texts = [start + b * (1_000_000 // len(b)) for b in bits for start in ("", "x@")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pseudonymise(docs, "s").select("doc_id", F.length("text").alias("n")).collect()
    assert sorted((r.doc_id, r.n) for r in rows) == [(i, len(t)) for i, t in enumerate(texts)]
