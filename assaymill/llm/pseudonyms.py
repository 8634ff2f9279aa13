"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in DataFrame expressions.

One scan finds candidates; each is validated by its kind's own rule (Luhn and IBAN check digits,
calendar, number ranges). The validated value becomes a pair of numbers in a mixed radix and is
permuted there by an alternating Feistel network with a keyed SHA-256 round function, so the
pseudonym is valid in the same format, different values stay different and equal values stay equal in
every document, however they are punctuated. Check digits are computed anew.

Values that are no numbers (addresses of mail, passwords, keys) have no such domain: they are replaced
by digits of a keyed digest in their own alphabet, which links equal values as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: A whole Gregorian cycle: 400 years from this day have 189 * 773 days.
FIRST_DAY, DATE_RADIX = "1800-01-01", (189, 773)
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}"
_AWS = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
_SECRET = r"(?i:password|passwd|secret|token|api_key|apikey)[ ]{0,3}[=:][ ]{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+"
_ISO = r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])"
_DMY = r"(?<![\d/.-])\d{1,2}([/.])\d{1,2}[/.]\d{4}(?![\d/])"
_IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_NANP = r"(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
_INTL = r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)"
#: Runs of groups, whole; a group that begins a value of another kind ends the run.
_OTHER = "|".join(x.replace("([/.])", "[/.]") for x in (_ISO, _DMY, _IP, _SSN, _NANP))
_IBAN = rf"(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}[A-Z0-9]{{0,30}}+(?![A-Za-z0-9])(?: (?!AKIA|{_OTHER})[A-Z0-9]{{1,34}}+(?![A-Za-z0-9@]| {{0,3}}[=:]|[.%+_-]\w))*+"
_CARD = rf"(?<![\d.])\d(?:(?:[ -](?!{_OTHER}))?\d){{12,}}+"
# Which digits cards begin with and how many they have, by issuer, and how printed cards are grouped.
ISSUERS = (
    r"4\d{12}(?:\d{3}){0,2}",
    r"5[1-5]\d{14}",
    r"(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}",
    r"3[47]\d{13}",
    r"3(?:0[0-59]|[689]\d)\d{11}",
    r"(?:6011|64[4-9]\d|65\d\d)\d{12}(?:\d{3})?",
    r"35(?:2[89]|[3-8]\d)\d{12}(?:\d{3})?",
    r"62\d{14,17}",
    r"(?:5018|5020|5038|5[678]\d\d|6304|6759|676[1-3])\d{9,15}",
)
PRINTED = r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{5}|\d{4}([ -])\d{6}\3\d{4}"
#: A run with more groups of digits than so many beside its accounts is a list of numbers, in which four may look like a card.
LOOSE = 3
SCAN = "|".join(x.replace("([/.])", "[/.]") for x in (_EMAIL, _AWS, _SECRET, _IBAN, _ISO, _DMY, _IP, _SSN, _NANP, _INTL, _CARD))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _number(x: Column) -> Column:
    return x.cast("long")


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def feistel(key: Column, tag: Column | str, a: Column, b: Column, ma: Column, mb: Column) -> Column:
    """struct(a, b): the pair (a, b) of Z_ma x Z_mb under a keyed permutation; ``tag`` separates domains."""
    tag = F.lit(tag) if isinstance(tag, str) else tag

    def noise(i: Column, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", key, tag, i.cast("string"), x.cast("string")), 256), 1, 14), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(((s["a"] + noise(i, s["b"]) % ma) % ma).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + noise(i, s["a"]) % mb) % mb).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def permuted_digits(key: Column, tag: str, d: Column) -> Column:
    """A string of 2 to 36 decimal digits as another of its length; fewer digits stay."""

    def run(x: Column) -> Column:
        n = F.length(x)
        left = F.floor(n / 2).cast("int")
        power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        out = feistel(key, F.concat(F.lit(tag), n.cast("string")), _number(F.left(x, left)), _number(F.right(x, n - left)), power(left), power(n - left))
        return F.when(n < 2, x).otherwise(let(out, lambda p: F.concat(_pad(p["a"], left), _pad(p["b"], n - left))))

    return let(d, run)


def refill(shape: Column, new: Column) -> Column:
    """``shape`` with its digits replaced in turn by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(new, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.regexp_extract_all(shape, F.lit("(?s)."), F.lit(0)), start, put)["out"]


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""
    value = lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x))
    return F.aggregate(F.transform(F.regexp_extract_all(F.reverse(d), F.lit("."), F.lit(0)), value), F.lit(0), lambda a, b: a + b)


def iban_rest(x: Column) -> Column:
    """Rest modulo 97 of an IBAN without blanks."""
    moved = F.regexp_extract_all(F.concat(F.substr(x, F.lit(5)), F.left(x, F.lit(4))), F.lit("."), F.lit(0))
    return F.aggregate(moved, F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _card(m: Column, key: Column) -> Column:
    """What tells the issuer stays: the first digit of a card that begins with 4, else the first four."""

    def run(d: Column) -> Column:
        issuer = F.when(d.startswith("4"), 1).otherwise(4)
        body = F.concat(F.left(d, issuer), permuted_digits(key, "card", F.substr(d, issuer + 1, F.length(d) - issuer - 1)))
        full = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when((luhn_sum(d) % 10 == 0) & ~d.rlike("^0*$"), refill(m, full))

    return let(_digits(m), run)


def _iban(m: Column, key: Column) -> Column:
    def run(x: Column) -> Column:
        body = F.substr(x, F.lit(5))
        new = refill(body, permuted_digits(key, "iban", _digits(body)))
        check = lambda b: _pad(98 - iban_rest(F.concat(F.left(x, F.lit(2)), F.lit("00"), b)), 2)
        return F.when(iban_rest(x) == 1, let(new, lambda b: refill(m, F.concat(check(b), _digits(b)))))

    return let(F.replace(m, F.lit(" "), F.lit("")), run)


def _accounts(m: Column, key: Column) -> Column:
    """struct(kinds, new): the cards and IBANs among the neighbouring groups of a run, longest first; null without any.

    A card has an issuer's digits in an issuer's number, stands undivided or as cards are printed, and passes Luhn's check. Divided ones do not count in a list of numbers (LOOSE).
    """

    def kind(x: Column, shown: Column) -> Column:
        card = x.rlike(_whole("|".join(ISSUERS))) & F.regexp_replace(shown, "[ -]$", "").rlike(_whole(PRINTED))
        return F.when(x.rlike(r"^\d+$"), F.when(card, F.when(luhn_sum(x) % 10 == 0, "card"))).when(x.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{8,30}$"), F.when(iban_rest(x) == 1, "iban"))

    def run(p: Column) -> Column:
        text = lambda i, k: F.array_join(F.slice(p, i, k), "")

        def window(i: Column, k: Column) -> Column:
            return let(text(i, k), lambda t: let(F.regexp_replace(t, "[ -]", ""), lambda x: F.struct((-F.length(x)).alias("n"), i.alias("i"), k.alias("k"), kind(x, t).alias("kind"))))

        def pick(taken: Column, w: Column) -> Column:
            return F.when(F.exists(taken, lambda c: (w["i"] < c["i"] + c["k"]) & (c["i"] < w["i"] + w["k"])), taken).otherwise(F.array_append(taken, w))

        def put(taken: Column) -> Column:
            def piece(x: Column, at: Column) -> Column:
                inside = F.filter(taken, lambda c: (c["i"] <= at + 1) & (at + 1 < c["i"] + c["k"]))
                changed = lambda c: let(text(c["i"], c["k"]), lambda s: F.when(c["kind"] == "card", _card(s, key)).otherwise(_iban(s, key)))
                return let(F.get(inside, F.lit(0)), lambda c: F.when(c.isNull(), x).when(c["i"] == at + 1, changed(c)).otherwise(F.lit("")))

            kinds = F.transform(F.array_sort(F.transform(taken, lambda c: F.struct(c["i"], c["kind"].alias("kind")))), lambda c: c["kind"])
            return F.when(F.size(taken) > 0, F.struct(kinds.alias("kinds"), F.array_join(F.transform(p, piece), "").alias("new")))

        n = F.size(p)
        windows = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(34), n - i + 1)), lambda k: window(i, k))))
        valid = F.array_sort(F.filter(windows, lambda w: w["kind"].isNotNull()))
        digits = F.size(F.filter(p, lambda g: g.rlike(r"^\d+[ -]?$")))

        def weighed(taken: Column) -> Column:
            cards = F.aggregate(taken, F.lit(0), lambda n, c: n + F.when(c["kind"] == "card", c["k"]).otherwise(0))
            return F.when(digits - cards > LOOSE, F.filter(taken, lambda c: (c["kind"] == "iban") | (c["k"] == 1))).otherwise(taken)

        return let(let(F.aggregate(valid, F.array().cast("array<struct<n:int,i:int,k:int,kind:string>>"), pick), weighed), put)

    return let(F.regexp_extract_all(m, F.lit("[A-Z0-9]+[ -]?"), F.lit(0)), run)


def _phone(m: Column, key: Column) -> Column:
    def north_american(d: Column) -> Column:
        """Numbers with a valid area and exchange are permuted among themselves, and so are the others."""
        area, exchange, line = (_number(F.substr(d, F.lit(i), F.lit(n))) for i, n in ((1, 3), (4, 3), (7, 4)))
        out = feistel(key, "phone", (area - 200) * 100 + F.floor(line / 100), (exchange - 200) * 100 + line % 100, F.lit(80_000), F.lit(80_000))
        new = let(out, lambda p: F.concat(_pad(F.floor(p["a"] / 100) + 200, 3), _pad(F.floor(p["b"] / 100) + 200, 3), _pad(p["a"] % 100, 2), _pad(p["b"] % 100, 2)))
        # The 360,000 other pairs of area and exchange: all exchanges of areas under 200, then exchanges under 200.
        index = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        low = lambda i: F.concat(_pad(F.floor(i / 1000), 3), _pad(i % 1000, 3))
        high = lambda i: F.concat(_pad(F.floor((i - 200_000) / 200) + 200, 3), _pad((i - 200_000) % 200, 3))
        other = let(feistel(key, "phone-other", index, line, F.lit(360_000), F.lit(10_000)), lambda p: F.concat(F.when(p["a"] < 200_000, low(p["a"])).otherwise(high(p["a"])), _pad(p["b"], 4)))
        return F.when((area >= 200) & (exchange >= 200), new).otherwise(other)

    def abroad(d: Column) -> Column:
        return F.concat(F.left(d, F.lit(2)), permuted_digits(key, "phone", F.substr(d, F.lit(3))))

    def run(d: Column) -> Column:
        one = m.startswith("+1") & (F.length(d) == 11)
        return F.when(one, refill(m, F.concat(F.lit("1"), north_american(F.right(d, F.lit(10)))))).when(m.startswith("+") & F.length(d).between(8, 15), refill(m, abroad(d))).when(F.length(d) == 10, refill(m, north_american(d)))

    return let(_digits(m), run)


def _ip(m: Column, key: Column) -> Column:
    def run(p: Column) -> Column:
        octet = [_number(p[i]) for i in range(4)]
        out = feistel(key, "ip", octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65_536), F.lit(65_536))
        new = let(out, lambda x: F.concat_ws(".", *[y.cast("string") for y in (F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)]))
        return F.when((octet[0] < 256) & (octet[1] < 256) & (octet[2] < 256) & (octet[3] < 256), new)

    return let(F.split(m, r"\."), run)


def _ssn(m: Column, key: Column) -> Column:
    def run(p: Column) -> Column:
        area, group, serial = (_number(p[i]) for i in range(3))
        index = F.when(area > 666, area - 2).otherwise(area - 1)
        out = feistel(key, "ssn", index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))
        back = lambda i: F.when(i >= 665, i + 2).otherwise(i + 1)
        new = let(out, lambda x: F.concat_ws("-", _pad(back(F.floor(x["a"] / 99)), 3), _pad(x["a"] % 99 + 1, 2), _pad(x["b"] + 1, 4)))
        return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), new)

    return let(F.split(m, "-"), run)


def _date(m: Column, key: Column) -> Column:
    """Day first where both readings are possible."""
    iso = m.rlike(_whole(_ISO))
    part = F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0))
    sep = F.regexp_extract(m, r"[/.]", 0)

    def run(p: Column) -> Column:
        month_first = ~iso & (_number(p[1]) > 12)
        day, month = F.when(iso, p[2]).when(month_first, p[1]).otherwise(p[0]), F.when(month_first, p[0]).otherwise(p[1])
        year = F.when(iso, p[0]).otherwise(p[2])
        when = F.try_to_timestamp(F.concat_ws("-", year, _pad(month, 2), _pad(day, 2)), F.lit("yyyy-MM-dd")).cast("date")

        def shown(d: Column) -> Column:
            y, mo, da = F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd")
            return F.when(iso, F.concat_ws("-", y, mo, da)).when(month_first, F.concat(mo, sep, da, sep, y)).otherwise(F.concat(da, sep, mo, sep, y))

        def move(n: Column) -> Column:
            a, b = DATE_RADIX
            out = feistel(key, "date", F.floor(n / b), n % b, F.lit(a), F.lit(b))
            new = let(out, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x["a"] * b + x["b"]).cast("int")))
            return F.when((n >= 0) & (n < a * b), let(new, shown))

        return let(F.datediff(when, F.lit(FIRST_DAY).cast("date")), move)

    return let(part, run)


def _keyed(key: Column, tag: str, x: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(tag), x), 256)


def _email(m: Column, key: Column) -> Column:
    return F.concat(F.lit("u"), F.left(_keyed(key, "email", F.lower(m)), F.lit(16)), F.lit("@example.invalid"))


def _aws(m: Column, key: Column) -> Column:
    part = lambda h, i: F.lpad(F.right(F.conv(F.substr(h, F.lit(i), F.lit(12)), 16, 36), F.lit(8)), 8, "0")
    return let(_keyed(key, "key", m), lambda h: F.concat(F.lit("AKIA"), F.upper(part(h, 1)), F.upper(part(h, 20))))


def _secret(m: Column, key: Column) -> Column:
    """Values with a digit, of mixed case or with a sign inside, and all that stand in quotes or right after ``=``."""
    value = F.regexp_extract(m, r"[=:][ ]{0,3}[\"']?([A-Za-z0-9+/_-]+)$", 1)

    def run(v: Column) -> Column:
        h = _keyed(key, "secret", v)
        bound = F.left(m, F.length(m) - F.length(v)).rlike("[=\"']$")
        return F.when(v.rlike("[0-9]|[a-z][A-Z]|[A-Za-z][+/_-][A-Za-z]") | bound, F.concat(F.left(m, F.length(m) - F.length(v)), F.left(F.repeat(h, F.ceil(F.length(v) / 64).cast("int")), F.length(v))))

    return let(value, run)


#: In order: the first kind whose pattern and rule a candidate meets names and replaces it.
KINDS: tuple[tuple[str, str, Callable[[Column, Column], Column]], ...] = (
    ("email", _EMAIL, _email), ("key", _AWS, _aws), ("secret", _SECRET, _secret), ("iban", _IBAN, _accounts), ("date", f"{_ISO}|{_DMY}", _date),
    ("ip", _IP, _ip), ("ssn", _SSN, _ssn), ("card", r"\d(?:[ -]?\d){12,}+", _accounts), ("phone", f"{_NANP}|{_INTL}", _phone),
)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by pseudonyms, and ``pii_kinds``: the kinds replaced, in text order.

    Null stays null, empty stays empty, and candidates that fail validation stay as they are: repeated
    rows, and equal values anywhere, get equal pseudonyms. Cards need an issuer's prefix and length, and the shape of a printed card, so tables and lists of
    plain numbers stay. A text is one value, scanned whole: it and what it turns into must fit a task's memory. Dates outside the 400 years from 1800 stay. Every row and column is kept;
    a column named ``pii_kinds`` is replaced. A digest of ``key`` is read by a scalar subquery, so that no
    plan, log or user interface shows it.
    """
    digest = hashlib.sha256(f"pseudonyms|{key}".encode()).hexdigest()
    docs = docs.withColumn("__pii_key", docs.sparkSession.sql("SELECT * FROM VALUES (:digest) AS t(key)", {"digest": digest}).scalar())
    secret = F.col("__pii_key")

    def named(kind: str) -> Callable[[Column], Column]:
        return lambda new: F.when(new.isNotNull(), F.struct(F.array(F.lit(kind)).alias("kinds"), new.alias("new")))

    def replaced(m: Column) -> Column:
        return F.coalesce(*[F.when(m.rlike(_whole(pattern)), change(m, secret) if change is _accounts else let(change(m, secret), named(kind))) for kind, pattern, change in KINDS])

    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(SCAN), F.lit(0))
    out = docs.withColumn("__pii_found", F.transform(found, lambda m: F.struct(m.alias("old"), replaced(m).alias("r"))))
    mended = F.array_join(F.flatten(F.zip_with(F.split(text, SCAN, -1), "__pii_found", lambda p, m: F.array(p, F.coalesce(m["r"]["new"], m["old"], F.lit(""))))), "")
    kinds = F.flatten(F.filter(F.transform("__pii_found", lambda m: m["r"]["kinds"]), F.isnotnull))
    return out.withColumns({text_col: F.when(F.size("__pii_found") > 0, mended).otherwise(text), "pii_kinds": F.coalesce(kinds, F.array().cast("array<string>"))}).drop("__pii_found", "__pii_key")
