"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Numbers and dates are validated (Luhn, mod 97, octets, calendar) and permuted by a keyed
Feistel network over the values of their own format: the result is again a valid value of
that format, equal values get equal pseudonyms in every document, and different values of a
kind different ones. Separators stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Countries by the length of their IBANs.
_IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_format() -> str:
    """A value as long as its country says, so that what follows it isn't taken in; else any length."""
    known = [f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _IBANS.items()]
    return "|".join([*known, r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"])


#: Formats of personal data, the first that fits counts.
FORMATS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,24}",
    "iban": _iban_format(),
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}",
    "card": r"[0-9]{4}(?:[ -]?[0-9]{4}){3}[ -]?[0-9]{3}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{4}(?:[ -]?[0-9]{4}){2}(?:[ -]?[0-9]{1,7})?|[0-9]{13,19}",
}
KINDS = list(FORMATS)
_BEFORE, _AFTER = r"(?<![A-Za-z0-9_+@-])(?<![0-9]\.)", r"(?![A-Za-z0-9_@])(?![.-][0-9])"
ANY = _BEFORE + "(?:" + "|".join(FORMATS.values()) + ")" + _AFTER
#: Days of 400 Gregorian years are 189 * 773, so a date is two coordinates of a Feistel network.
_FIRST_DAY, _DATE_MODULI = "1700-01-01", (189, 773)
#: Areas of a social security number: 1 to 899 without 666.
_AREAS = 898


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _noise(secret: str, kind: str, step: Column, other: Column) -> Column:
    """60 keyed bits of a round."""
    text = F.concat_ws("|", F.lit(secret), F.lit(kind), step.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _feistel(left: Column, right: Column, left_size: Column, right_size: Column, secret: str, kind: str) -> Column:
    """Permute the pairs of [0, left_size) x [0, right_size): struct(a, b)."""
    state = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"), left_size.cast("long").alias("m"), right_size.cast("long").alias("n"))

    def one(s: Column, step: Column) -> Column:
        moved = F.pmod(s["a"] + F.pmod(_noise(secret, kind, step, s["b"]), s["m"]), s["m"])
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["n"].alias("m"), s["m"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, one)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _number(digits: Column, secret: str, kind: str) -> Column:
    """Permute the digit strings of one length (up to 18)."""

    def of(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        moved = _feistel(F.substring(d, F.lit(1), u), F.substring(d, u + 1, n - u), _power(u), _power(n - u), secret, kind)
        return _bind(moved, lambda s: F.concat(_padded(s["a"], u), _padded(s["b"], n - u)))

    return F.when(F.length(digits) < 2, digits).otherwise(_bind(digits, of))


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def one(s: Column, c: Column) -> Column:
        number = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(number, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(number, 1).otherwise(0)).alias("k"))

    return F.aggregate(_chars(form), start, one, lambda s: s["out"])


def _letters(value: Column, secret: str, kind: str) -> Column:
    """Permute strings within their pattern of digits, small and capital letters: each half in
    turn moves every character inside its own class by noise from the other half."""

    def shift(half: Column, other: Column, step: Column) -> Column:
        noise = F.sha2(F.concat_ws("|", F.lit(secret), F.lit(kind), step.cast("string"), other), 256)

        def moved(stream: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                by = F.conv(F.substring(stream, 4 * F.pmod(i, F.lit(16)) + 1, F.lit(4)), 16, 10).cast("int") + i
                code = F.ascii(c)
                turn = lambda first, size: F.char(first + F.pmod(code - first + by, F.lit(size)))
                return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

            return F.array_join(F.transform(_chars(half), one), "")

        return _bind(noise, moved)

    def of(v: Column) -> Column:
        n = F.length(v)
        u = F.floor((n + 1) / 2).cast("int")
        start = F.struct(F.substring(v, F.lit(1), u).alias("a"), F.substring(v, u + 1, n - u).alias("b"))

        def one(s: Column, step: Column) -> Column:
            return F.struct(s["b"].alias("a"), shift(s["a"], s["b"], step).alias("b"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda s: F.concat(s["a"], s["b"]))

    return _bind(value, of)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string."""

    def one(s: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((s["sum"] + F.when(s["odd"], d).otherwise(twice)).alias("sum"), (~s["odd"]).alias("odd"))

    return F.aggregate(_chars(F.reverse(digits)), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd")), one, lambda s: s["sum"])


def _mod97(value: Column) -> Column:
    """Remainder of an IBAN body: letters count as 10 to 35."""

    def one(s: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        return F.pmod(F.when(letter, s * 100 + F.ascii(c) - 55).otherwise(s * 10 + F.ascii(c) - 48), F.lit(97))

    return F.aggregate(_chars(value), F.lit(0), one)


def _email(v: Column, secret: str) -> Column:
    at = F.instr(v, "@")
    # The domain says who runs the mailbox, not whose it is.
    return F.concat(_letters(F.substring(v, F.lit(1), at - 1), secret, "email"), F.substring(v, at, F.length(v)))


def _iban(v: Column, secret: str) -> Column:
    def of(flat: Column) -> Column:
        country, body = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat) - 4)

        def new(b: Column) -> Column:
            check = 98 - _mod97(F.concat(b, country, F.lit("00")))
            whole = F.concat(country, _padded(check, F.lit(2)), b)
            start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

            def one(s: Column, c: Column) -> Column:
                gap = c == " "
                return F.struct(F.concat(s["out"], F.when(gap, c).otherwise(F.substring(whole, s["k"], F.lit(1)))).alias("out"), (s["k"] + F.when(gap, 0).otherwise(1)).alias("k"))

            return F.aggregate(_chars(v), start, one, lambda s: s["out"])

        return F.when(_mod97(F.concat(F.substring(flat, F.lit(5), F.length(flat) - 4), F.substring(flat, 1, 4))) == 1, _bind(_letters(body, secret, "iban"), new))

    return _bind(F.replace(v, F.lit(" "), F.lit("")), of)


def _date(v: Column, secret: str) -> Column:
    year_first = v.rlike("^[0-9]{4}-")
    p, q = F.substring(v, 1, 2), F.substring(v, 4, 2)
    iso = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    year = F.substring(v, 7, 4)
    # Slashes: month first if that is a date; points: day first.
    month_first = ~year_first & (F.substring(v, 3, 1) == "/") & iso(year, p, q).isNotNull()
    day = F.when(year_first, F.try_to_date(v, "yyyy-MM-dd")).when(month_first, iso(year, p, q)).otherwise(iso(year, q, p))

    def of(day: Column) -> Column:
        first = F.to_date(F.lit(_FIRST_DAY))
        number = F.datediff(day, first)
        m, n = _DATE_MODULI

        def new(s: Column) -> Column:
            moved = F.date_add(first, (s["a"] * n + s["b"]).cast("int"))
            sep = F.substring(v, 3, 1)
            part = lambda f: F.date_format(moved, f)
            return F.when(year_first, part("yyyy-MM-dd")).when(month_first, F.concat(part("MM"), sep, part("dd"), sep, part("yyyy"))).otherwise(F.concat(part("dd"), sep, part("MM"), sep, part("yyyy")))

        inside = (number >= 0) & (number < m * n) & (year_first | (F.substring(v, 3, 1) == F.substring(v, 6, 1)))
        moved = _feistel(F.floor(number / n), F.pmod(number, F.lit(n)), F.lit(m), F.lit(n), secret, "date")
        return F.when(inside, _bind(moved, new))

    return _bind(day, of)


def _ssn(v: Column, secret: str) -> Column:
    area, group, serial = (F.substring(v, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def new(s: Column) -> Column:
        a = s["a"] + F.when(s["a"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", _padded(a, F.lit(3)), _padded(F.floor(s["b"] / 9999) + 1, F.lit(2)), _padded(F.pmod(s["b"], F.lit(9999)) + 1, F.lit(4)))

    return F.when(valid, _bind(_feistel(place, (group - 1) * 9999 + serial - 1, F.lit(_AREAS), F.lit(99 * 9999), secret, "ssn"), new))


def _ip(v: Column, secret: str) -> Column:
    def of(o: Column) -> Column:
        valid = F.forall(o, lambda x: (x.cast("int") < 256) & ((F.length(x) == 1) | ~x.startswith("0")))
        octet = lambda k: F.get(o, F.lit(k)).cast("int")
        half = lambda k: octet(k) * 256 + octet(k + 1)

        def new(s: Column) -> Column:
            return F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(s[h] / 256), F.pmod(s[h], F.lit(256)))])

        return F.when(valid, _bind(_feistel(half(0), half(2), F.lit(65536), F.lit(65536), secret, "ip"), new))

    return _bind(F.split(v, r"\."), of)


def _phone(v: Column, secret: str) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d)
        kept = F.greatest(n - 10, F.lit(0))  # country codes stay
        new = F.concat(F.substring(d, F.lit(1), kept), _number(F.substring(d, kept + 1, n - kept), secret, "phone"))
        return F.when((n >= 8) & (n <= 15), _refill(v, new))

    return _bind(_digits(v), of)


def _card(v: Column, secret: str) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d)

        def new(body: Column) -> Column:
            check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
            return _refill(v, F.concat(body, check.cast("string")))

        valid = (n >= 13) & (n <= 19) & (F.pmod(_luhn(d), F.lit(10)) == 0) & ~d.rlike("^0+$")
        return F.when(valid, _bind(_number(F.substring(d, F.lit(1), n - 1), secret, "card"), new))

    return _bind(_digits(v), of)


def _cards(v: Column, secret: str) -> Column:
    """A card, or one of 16 digits with three digits apart behind it, which stay."""
    n = F.length(v)
    apart = v.rlike("[ -][0-9]{3}$") & (F.length(_digits(v)) == 19)
    return F.coalesce(_card(v, secret), F.when(apart, F.concat(_card(F.substring(v, F.lit(1), n - 4), secret), F.substring(v, n - 3, F.lit(4)))))


_MOVES = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _cards}


def pseudonym(value: Column, secret: str) -> Column:
    """struct(kind, value) of one match: the first kind whose format and validation hold, and
    its pseudonym; kind is null and the value unchanged if none does."""
    moved = [F.when(value.rlike(f"^(?:{FORMATS[k]})$"), F.struct(F.lit(k).alias("kind"), _MOVES[k](value, secret).alias("value"))) for k in KINDS]
    found = F.filter(F.array(*moved), lambda s: s["value"].isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value")))


def pseudonymise(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by pseudonyms, and ``pii_kinds``, the
    kinds replaced in order of the text (a column so named before is replaced).

    What looks like a number or date but fails its validation stays. Of a mail address the part
    before the at sign is replaced and the domain stays; addresses that differ in case are
    different values. A domain has at most 127 labels. Null texts stay null with
    no kinds; texts without personal data stay byte for byte. Rows are handled one by one, so
    repeated rows and keys don't matter.
    """
    if "|" in secret:
        raise ValueError("the secret must not contain |")
    body = F.col(text)
    some = body.rlike("[0-9@]")  # every format has a digit or an at sign
    matches = F.regexp_extract_all(body, F.lit(ANY), F.lit(0))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    marked = docs.drop("pii_kinds").withColumn("__found", F.when(some, F.transform(matches, lambda m: pseudonym(m, secret))).otherwise(none))
    values = F.transform("__found", lambda s: s["value"])
    # Gaps and values alternate; there is one gap more.
    woven = F.array_join(F.flatten(F.zip_with(F.split(body, ANY, -1), values, lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))), "")
    kinds = F.filter(F.transform("__found", lambda s: s["kind"]), lambda k: k.isNotNull())
    return marked.withColumns({text: F.when(F.size("__found") > 0, woven).otherwise(body), "pii_kinds": F.when(body.isNull(), F.array().cast("array<string>")).otherwise(kinds)}).drop("__found")
