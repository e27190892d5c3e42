"""Personal data: format-preserving pseudonyms from a keyed Feistel network, in SQL expressions only.

Card numbers (Luhn), bank account numbers (mod 97), addresses of four octets and dates are validated;
phone and social security numbers, e-mail addresses, access keys and passwords are found by form.
Every value is permuted within its format by a key: digits stay digits, letters stay letters of
their case (a to f among themselves), separators stay, check digits hold again, dates stay dates,
those of the years 1900 to 2100 among themselves. The permutation depends on
the key and the value alone, so equal values get equal pseudonyms in all documents, without a join.

Defined results: a null text stays null, an empty one empty; a value that fails its validation stays
as it is; repeated rows give equal rows; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FORMS = {
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"(?:(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)|"
    r"(?i:\b(?:bearer|(?:password|passwd|pwd)\s{1,3}is)\s{1,3}[\"']?)(?=[A-Za-z+/_.~-]*[0-9]))[A-Za-z0-9+/_.~-]{8,}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "account": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])|"
    r"(?<![0-9+.)-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "security": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "day": r"(?<![0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9-])",
    "address": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
}
ANY = "|".join(FORMS.values())
#: What every form holds at least one of.
HINT = "[0-9@=:]"

ROUNDS = 8
#: Characters that are permuted among themselves.
CLASSES = [("0", "9"), ("a", "f"), ("g", "z"), ("A", "F"), ("G", "Z")]
#: Days of recent dates, which stay among themselves, and of all others from year 1 to 9999; each is a product of two.
FIRST_DAY, DAYS = "1900-01-01", (270, 271)
OTHER_DAYS = (1569, 2281)
BEFORE = 693_595


def _bind(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _shifted(half: Column, other: Column, turn: Column, key: Column) -> Column:
    """Moves every digit and letter of a half within its class, by amounts that follow from the other half."""

    def move(c: Column, by: Column) -> Column:
        out = c
        for first, last in CLASSES:
            size = ord(last) - ord(first) + 1
            within = F.char(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + by, F.lit(size)))
            out = F.when(c.between(first, last), within).otherwise(out)
        return out

    def stream(digest: Column) -> Column:
        def each(c: Column, i: Column) -> Column:
            return move(c, F.conv(F.substr(digest, F.pmod(i * 4, F.lit(128)) + 1, F.lit(4)), 16, 10).cast("int"))

        return F.array_join(F.transform(_chars(half), each), "")

    return _bind(F.sha2(F.concat_ws(":", key, turn.cast("string"), F.length(half).cast("string"), other), 512), stream)


def permuted(text: Column, key: Column) -> Column:
    """A keyed permutation of all texts of the same form: a Feistel network over the two halves.

    The form of a text is the class of each character. No round changes it, so that each is
    one-to-one among the texts of a form, and hexadecimal texts stay hexadecimal.
    """

    def network(value: Column) -> Column:
        cut = F.floor(F.length(value) / 2).cast("int")
        halves = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            left = F.when(i % 2 == 0, _shifted(s["l"], s["r"], i, key)).otherwise(s["l"])
            right = F.when(i % 2 == 1, _shifted(s["r"], s["l"], i, key)).otherwise(s["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(turns, halves, turn, lambda s: F.concat(s["l"], s["r"]))

    return _bind(text, network)


def permuted_number(number: Column, left: int, right: int, key: Column) -> Column:
    """A keyed permutation of the numbers below left * right."""

    def by(other: Column, turn: Column, size: int) -> Column:
        digest = F.sha2(F.concat_ws(":", key, turn.cast("string"), F.lit(str(size)), other.cast("string")), 256)
        return F.conv(F.substr(digest, F.lit(1), F.lit(12)), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        l = F.when(i % 2 == 0, (s["l"] + by(s["r"], i, left)) % left).otherwise(s["l"])
        r = F.when(i % 2 == 1, (s["r"] + by(s["l"], i, right)) % right).otherwise(s["r"])
        return F.struct(l.alias("l"), r.alias("r"))

    def network(n: Column) -> Column:
        start = F.struct(F.floor(n / right).cast("long").alias("l"), F.pmod(n, F.lit(right)).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS + 1)), start, turn, lambda s: s["l"] * right + s["r"])

    return _bind(number, network)


def luhn_digit(payload: Column) -> Column:
    """The digit that completes a payload of digits."""

    def add(total: Column, c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    numbered = F.transform(F.reverse(_chars(payload)), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    total = F.aggregate(numbered, F.lit(0), lambda t, x: add(t, x["c"], x["i"]))
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _but_last(digits: Column) -> Column:
    return F.substr(digits, F.lit(1), F.length(digits) - 1)


def _refilled(form: Column, symbols: Column) -> Column:
    """Puts symbols in the places of the letters and digits of a form."""

    def fill(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(form, F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substr(symbols, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(form), fill), "")


def _card(value: Column, key: Column) -> Column:
    def number(digits: Column) -> Column:
        def whole(payload: Column) -> Column:
            return _refilled(value, F.concat(payload, luhn_digit(payload)))

        return _bind(permuted(_but_last(digits), key), whole)

    return _bind(_digits(value), number)


def _luhn_valid(value: Column) -> Column:
    return _bind(_digits(value), lambda d: luhn_digit(_but_last(d)) == F.substr(d, F.length(d), F.lit(1)))


def _mod97(text: Column) -> Column:
    """The remainder of a text whose letters count as 10 to 35."""

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), add)


def _account_valid(value: Column) -> Column:
    def check(plain: Column) -> Column:
        return _mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1

    return _bind(F.replace(value, F.lit(" "), F.lit("")), check)


def _account(value: Column, key: Column) -> Column:
    def number(plain: Column) -> Column:
        country = F.substr(plain, F.lit(1), F.lit(2))

        def whole(rest: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
            return _refilled(value, F.concat(country, check, rest))

        return _bind(permuted(F.substr(plain, F.lit(5)), key), whole)

    return _bind(F.replace(value, F.lit(" "), F.lit("")), number)


def _octets(value: Column) -> Column:
    return F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda t, o: t * 256 + o.cast("long"))


def _address(value: Column, key: Column) -> Column:
    def written(n: Column) -> Column:
        parts = [F.pmod(F.shiftright(n, 8 * k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]
        return F.concat_ws(".", *parts)

    return _bind(permuted_number(_octets(value), 1 << 16, 1 << 16, key), written)


def _day_form(value: Column) -> Column:
    return F.when(value.rlike("-"), "yyyy-MM-dd").when(value.rlike("/"), F.lit("MM/dd/yyyy")).otherwise("dd.MM.yyyy")


def _day_of(value: Column) -> Column:
    """The date of a value that has the form of one, or null. Of month and day with a slash the month comes first."""
    p = F.split(value, r"[-/.]")
    year = F.when(value.rlike("-"), p[0]).otherwise(p[2])
    month = F.when(value.rlike("/"), p[0]).otherwise(p[1])
    day = F.when(value.rlike("-"), p[2]).when(value.rlike("/"), p[1]).otherwise(p[0])
    return F.concat_ws("-", year, month, day).try_cast("date")


def _day_number(value: Column) -> Column:
    return F.datediff(_day_of(value), F.lit(FIRST_DAY).cast("date")).cast("long")


def _day(value: Column, key: Column) -> Column:
    recent = DAYS[0] * DAYS[1]

    def written(n: Column) -> Column:
        date = F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
        iso, us, eu = (F.date_format(date, form) for form in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy"))
        return F.when(value.rlike("-"), iso).when(value.rlike("/"), us).otherwise(eu)

    def moved(n: Column) -> Column:
        # Other dates are numbered from year 1, without the recent ones.
        place = F.when(n < 0, n + BEFORE).otherwise(n + BEFORE - recent)
        other = _bind(permuted_number(place, *OTHER_DAYS, key), lambda m: F.when(m < BEFORE, m - BEFORE).otherwise(m - BEFORE + recent))
        return F.when(n.between(0, recent - 1), permuted_number(n, *DAYS, key)).otherwise(other)

    return _bind(_bind(_day_number(value), moved), written)


def _after(value: Column, prefix: str, key: Column) -> Column:
    """Keeps what the prefix takes and permutes the rest."""
    return _bind(
        F.regexp_extract(value, f"^{prefix}", 0),
        lambda kept: F.concat(kept, permuted(F.substr(value, F.length(kept) + 1), key)),
    )


def kind_of(value: Column) -> Column:
    """The kind of a value that was found by form, or null where its validation fails."""
    octets = F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)
    number = _day_number(value)
    checks = {"account": _account_valid(value), "card": _luhn_valid(value), "address": octets, "day": number.between(-BEFORE, OTHER_DAYS[0] * OTHER_DAYS[1] + DAYS[0] * DAYS[1] - BEFORE - 1)}
    out = F.lit(None).cast("string")
    for kind, form in reversed(FORMS.items()):
        valid = F.when(F.coalesce(checks[kind], F.lit(False)), kind) if kind in checks else F.lit(kind)
        # Looking around belongs to finding; here the value is all there is.
        out = F.when(value.rlike(f"^(?:{form})$"), valid).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: Column) -> Column:
    return (
        F.when(kind == "card", _card(value, key))
        .when(kind == "account", _account(value, key))
        .when(kind == "address", _address(value, key))
        .when(kind == "day", _day(value, key))
        .when(kind == "phone", _after(value, r"(?:\+[0-9]{1,3}(?=[ .(-])|\+[0-9])", key))
        .when(kind == "key", _after(value, "AKIA", key))
        .when(kind == "secret", _after(value, r"[A-Za-z_]+(?:\s*[=:]\s*|\s+is\s+|\s+)[\"']?", key))
        .when(kind == "email", _bind(F.substring_index(value, ".", -1), lambda top: F.concat(
            permuted(F.substr(value, F.lit(1), F.length(value) - F.length(top)), key), top)))
        .when(kind == "security", permuted(value, key))
        .otherwise(value)
    )


def pseudonymise(documents: DataFrame, key: str, text: str = "text", kinds: str | None = None) -> DataFrame:
    """Replaces the personal data in a column; with `kinds`, adds the kinds found, in order, under that name.

    Every row is worked on where it lies: no shuffle, and texts without a digit, "@", "=" or ":" are only looked at.
    """
    secret = F.lit(key)
    content = F.col(text)
    hinted = content.rlike(HINT)
    found = F.when(hinted, F.regexp_extract_all(content, F.lit(ANY), F.lit(0)))
    marked = F.transform(found, lambda v: F.struct(v.alias("v"), kind_of(v).alias("k")))

    def replaced(values: Column) -> Column:
        new = F.transform(values, lambda x: pseudonym(x["v"], x["k"], secret))
        return F.array_join(F.zip_with(F.split(content, ANY, -1), new, lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")

    named = "__found"
    while named in documents.columns:
        named += "_"
    rows = documents.withColumn(named, marked)
    some = F.coalesce(F.size(named) > 0, F.lit(False))
    columns = []
    for name in documents.columns:
        columns.append(F.when(some, replaced(F.col(named))).otherwise(content).alias(name) if name == text else F.col(name))
    if kinds:
        valid = F.filter(F.transform(named, lambda x: x["k"]), lambda k: k.isNotNull())
        columns.append(F.coalesce(valid, F.array().cast("array<string>")).alias(kinds))
    return rows.select(*columns)
