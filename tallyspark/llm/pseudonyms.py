"""Format-preserving pseudonyms for personal data, with Spark's own expressions only.

Texts are split at matches of one pattern; each match is checked, permuted within its format under a key, and put back
between the pieces. Numbers and dates go through a Feistel network: the value is split into two halves of sizes A and B,
and each round adds a keyed hash of one half to the other, modulo that half's size. That is a permutation of 0..A*B-1
for any A and B, so equal values stay equal in all documents, different values stay different, and with the key the
rounds can be undone (``restored`` does). Round hashes are SHA-256 of key, kind, round and half.

=========  ============================================================================  =============================
kind       checked                                                                       permuted
=========  ============================================================================  =============================
card       13 to 19 digits, single spaces or hyphens between, Luhn's check digit         digits between first and last;
                                                                                         the check digit is made anew
iban       country, two check digits, 11 to 30 digits or, of the country's length or     digits, and letters among letters;
           without spaces, digits and capitals, remainder 1 modulo 97                    check digits made anew
phone      + and 7 to 15 digits in groups; as many as the country has for +1, 31, 33,    the digits after the country; of 10,
           34, 41, 44 (a single digit in brackets, as (0), stays and does not count)     area and exchange from 2 on where
                                                                                         they were
ssn        ddd-dd-dddd, area 1 to 899 without 666, group and serial not 0                area, group and serial
ip         four numbers up to 255                                                        all four
date       yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd-mm-yyyy, mm/dd/yyyy, else dd/mm/yyyy   the day among 73,000 of its
           that exist, 1900 to 2099                                                      window (from 1900-01-01)
date       the same with one-digit day or month, and dd/mm/yyyy                          the day among those written alike;
                                                                                         29 February among leap years
email      name@host.tld                                                                 name and first host label: a
                                                                                         keyed hash (not a permutation)
secret     AKIA key, 32 or more hexadecimal digits, value of password=, token= and like  keyed hash, same length and
           (8 signs or more up to a space, a quote or the next name=)                    alphabet, hexadecimal for others
=========  ============================================================================  =============================

What fails its check is left as it is. Separators, country codes and letters' places stay.

Defined cases: a null text stays null, an empty one empty, both with nothing found; all other columns pass through,
except one named like ``found``, which is replaced; rows are handled one by one and whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
KEY = "change this key"

# The host is read sign by sign, dots not side by side: a repeated group of several signs would recurse once per label.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?![.])(?:(?!\.\.)[A-Za-z0-9.-])*\.[A-Za-z]{2,}"
NAMED = r"(?i:password|passwd|secret|token|api_key|apikey)[ ]?[=:][ ]?[\"']?"
SECRET = (rf"{NAMED}(?:(?![,;&] ?[A-Za-z0-9_]{{1,40}} ?[=:])[^\s\"']){{8,}}(?<![.,;:)\]}}>])"
          r"|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
          r"|(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])")
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_countries = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
IBAN = (rf"(?<![A-Za-z0-9])(?:{_countries}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]){{11,30}}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}})"
        r"(?![A-Za-z0-9])")
DATE = (r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}"
        r"|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
        r"|(?<![0-9]|[0-9][./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
        r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9]|[./-][0-9])")
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
CARD = (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])")
_gap = "[ ./  -]"
_next = rf"(?:{_gap}?\([0-9]\))?(?:{_gap}?\(|\){_gap}?|{_gap})?[0-9]"  # a digit, a gap before it; "(0)" is part of a gap
_other = rf"(?!{CARD}|{SSN}|{IP}|{DATE})"  # what stands behind a phone number is not its end
PHONE = (rf"\+(?:1(?:{_next}){{10}}|(?:31|33|34|41)(?:{_next}){{9}}|44(?:{_next}){{10}})(?![0-9])"
         rf"|(?<![0-9])\+[0-9](?:(?:{_gap}?\([0-9]\))?(?:(?:{_gap}?\(|\){_gap}?|{_gap}){_other})?[0-9]){{6,14}}(?![0-9])"
         r"|\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"  # what a phone number begins with
KINDS = (("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("date", DATE), ("ssn", SSN), ("ip", IP), ("phone", PHONE),
         ("card", CARD))
ANY = "|".join(pattern for _, pattern in KINDS)
MAYBE = "[0-9@=:]|AKIA|[a-f]{32}|[A-F]{32}"  # what every match contains, cheap to look for


def _hash(key: str, tag: str, *parts: Column) -> Column:
    """60 bits of a keyed hash."""
    joined = F.concat_ws("|", F.lit(key), F.lit(tag), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("bigint")


def feistel(value: Column, a: Column | int, b: Column | int, key: str, tag: str, back: bool = False) -> Column:
    """Permute 0..a*b-1: even rounds change the upper half (modulo a), odd rounds the lower (modulo b)."""
    a, b = (F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in (a, b))
    value = value.cast("bigint")
    start = F.struct(((value - F.pmod(value, b)) / b).cast("bigint").alias("x"), F.pmod(value, b).alias("y"))
    sign = F.lit(-1 if back else 1).cast("bigint")

    def step(state, k):
        x, y = state["x"], state["y"]
        add_x = sign * F.pmod(_hash(key, tag, a, b, k, y), a)
        add_y = sign * F.pmod(_hash(key, tag, a, b, k, x), b)
        even = k % 2 == 0
        return F.struct(F.when(even, F.pmod(x + add_x, a)).otherwise(x).alias("x"),
                        F.when(even, y).otherwise(F.pmod(y + add_y, b)).alias("y"))

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(k) for k in order]), start, step, lambda s: s["x"] * b + s["y"])


def _let(body, *values: Column) -> Column:
    """body of the values, each computed once however often it stands there."""
    names = [f"v{k}" for k in range(len(values))]
    one = F.array(F.struct(*[v.alias(n) for v, n in zip(values, names)]))
    return F.get(F.transform(one, lambda s: body(*[s[n] for n in names])), F.lit(0))


def _power(n: Column) -> Column:
    """10 to the n, exact for n up to 18."""
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("bigint")


_LETTERS, _BASE26 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOP"


def _permute_letters(letters: Column, key: str, tag: str, back: bool) -> Column:
    """A string of up to 26 capitals, as two numbers of base 26."""
    number = lambda x: F.coalesce(F.conv(F.translate(x, _LETTERS, _BASE26), 26, 10).cast("bigint"), F.lit(0).cast("bigint"))
    half = lambda x, n: F.when(n > 0, F.translate(F.lpad(F.conv(x.cast("string"), 10, 26), n, "0"), _BASE26, _LETTERS)).otherwise("")
    sign = F.lit(-1 if back else 1).cast("bigint")
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def network(letters, upper, lower):
        power = F.array(*[F.lit(26 ** k).cast("bigint") for k in range(14)])

        def step(state, k):
            x, y, a, b = (state[n] for n in "xyab")
            even = k % 2 == 0
            return F.struct(
                F.when(even, F.pmod(x + sign * F.pmod(_hash(key, tag, upper, lower, k, y), a), a)).otherwise(x).alias("x"),
                F.when(even, y).otherwise(F.pmod(y + sign * F.pmod(_hash(key, tag, upper, lower, k, x), b), b)).alias("y"),
                a.alias("a"), b.alias("b"))

        start = F.struct(number(F.substr(letters, F.lit(1), upper)).alias("x"), number(F.substr(letters, upper + 1, lower)).alias("y"),
                         F.get(power, upper).alias("a"), F.get(power, lower).alias("b"))
        return F.aggregate(F.array(*[F.lit(k) for k in order]), start, step,
                           lambda s: F.concat(half(s["x"], upper), half(s["y"], lower)))

    n = F.length(letters)
    return _let(network, letters, F.ceil(n / 2).cast("int"), (n - F.ceil(n / 2)).cast("int"))


def _permute_digits(digits: Column, key: str, tag: str, back: bool) -> Column:
    """A string of up to 36 digits: halves of at most 18 digits are the two halves of the network."""
    upper = F.ceil(F.length(digits) / 2).cast("int")
    lower = F.length(digits) - upper
    sign = F.lit(-1 if back else 1).cast("bigint")
    a, b = _power(upper), _power(lower)
    start = F.struct(F.substr(digits, F.lit(1), upper).try_cast("bigint").alias("x"),
                     F.coalesce(F.substr(digits, upper + 1, lower).try_cast("bigint"), F.lit(0).cast("bigint")).alias("y"))

    def step(state, k):
        x, y = state["x"], state["y"]
        even = k % 2 == 0
        return F.struct(
            F.when(even, F.pmod(x + sign * F.pmod(_hash(key, tag, upper, lower, k, y), a), a)).otherwise(x).alias("x"),
            F.when(even, y).otherwise(F.pmod(y + sign * F.pmod(_hash(key, tag, upper, lower, k, x), b), b)).alias("y"))

    def joined(s):
        low = F.when(lower > 0, F.lpad(s["y"].cast("string"), lower, "0")).otherwise("")
        return F.concat(F.lpad(s["x"].cast("string"), upper, "0"), low)

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(k) for k in order]), start, step, joined)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(text: Column, digits: Column, which: str = "[0-9]") -> Column:
    """The text with its digits (or signs of another class) replaced, in order, by the given ones."""
    chars = F.split(text, "")
    return F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike(f"^{which}$"), F.struct(
            F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"),
        )).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"])


def luhn(digits: Column) -> Column:
    """Sum of Luhn's rule over digits followed by their check digit; 0 modulo 10 if that is right."""
    value = F.zip_with(
        F.split(F.reverse(digits), ""), F.sequence(F.lit(0), F.length(digits) - 1),
        lambda c, k: F.when(k % 2 == 0, c.try_cast("int")).otherwise(
            F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _card(m: Column, key: str, back: bool) -> Column:
    def parts(digits):
        body = F.concat(F.substr(digits, F.lit(1), F.lit(1)),
                        _permute_digits(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card", back))

        def checked(body):
            check = F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10))
            return _let(lambda signs: _refill(m, signs), F.concat(body, check.cast("string")))

        return F.when(luhn(digits) % 10 == 0, _let(checked, body)).otherwise(m)

    return _let(parts, _digits(m))


def _mod97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * 10 + c.try_cast("int")) % 97))


def _numbers(text: Column) -> Column:
    """Capitals as two digits each, A as 10."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(
        c.rlike("^[A-Z]$"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def _iban(m: Column, key: str, back: bool) -> Column:
    def parts(signs, country, account, digits, letters):
        with_digits = F.when(F.length(digits) > 0, _refill(
            account, _permute_digits(digits, key, "iban", back))).otherwise(account)
        # 26 letters are two numbers; what few there may be beyond are others
        permuted = lambda: F.concat(_permute_letters(F.substring(letters, 1, 26), key, "iban", back),
                                    _permute_letters(F.substring(letters, 27, 4), key, "iban-end", back))
        new = _let(lambda x: F.when(F.length(letters) > 0, _let(
            lambda y: _refill(x, y, "[A-Z]"), permuted())).otherwise(x), with_digits)

        def checked(new):
            check = F.lpad((98 - _mod97(_numbers(F.concat(new, country, F.lit("00"))))).cast("string"), 2, "0")
            return _let(lambda signs: _refill(m, signs, "[A-Z0-9]"), F.concat(country, check, new))

        right = _mod97(_numbers(F.concat(account, country, F.substring(signs, 3, 2)))) == 1
        return F.when(right, _let(checked, new)).otherwise(m)

    signs = F.regexp_replace(m, "[^A-Z0-9]", "")
    account = F.substr(signs, F.lit(5), F.length(signs) - 4)
    return _let(parts, signs, F.substring(signs, 1, 2), account, _digits(account), F.regexp_replace(account, "[^A-Z]", ""))


def _phone(m: Column, key: str, back: bool) -> Column:
    def ten(rest):
        area, exchange, line = (F.substring(rest, k, n).try_cast("bigint") for k, n in ((1, 3), (4, 3), (7, 4)))

        def network(area, exchange, line, low_a, low_e):
            size_a, size_e = (F.when(low > 0, F.lit(800)).otherwise(F.lit(200)).cast("bigint") for low in (low_a, low_e))
            value = ((area - low_a) * size_e + exchange - low_e) * 10000 + line

            def text(new, size_e):
                new_line = F.pmod(new, F.lit(10000))
                upper = ((new - new_line) / 10000).cast("bigint")
                new_exchange = F.pmod(upper, size_e)
                new_area = ((upper - new_exchange) / size_e).cast("bigint")
                return F.concat(*[F.lpad(x.cast("string"), k, "0") for x, k in (
                    (new_area + low_a, 3), (new_exchange + low_e, 3), (new_line, 4))])

            return _let(text, feistel(value, size_a * 100, size_e * 100, key, "phone", back), size_e)

        low = [F.when(x >= 200, F.lit(200)).otherwise(F.lit(0)).cast("bigint") for x in (area, exchange)]
        return _let(network, area, exchange, line, *low)

    def parts(bare, digits, country):
        def filled(rest):
            new = F.when(F.length(rest) == 10, ten(rest)).otherwise(_permute_digits(rest, key, "phone", back))
            return _let(lambda signs: _refill(bare, signs), F.concat(country, new))

        return _let(filled, F.substr(digits, F.length(country) + 1, F.length(digits)))

    kept = F.regexp_extract_all(m, F.lit(r"\(([0-9])\)"), F.lit(1))  # single digits in brackets, as (0)
    bare = F.regexp_replace(m, r"\([0-9]\)", "(_)")
    new = _let(parts, bare, _digits(bare), F.regexp_extract(_digits(bare), COUNTRY, 0))
    return _let(lambda text, kept: F.when(kept == "", text).otherwise(_refill(text, kept, "_")), new, F.array_join(kept, ""))


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), F.lit(k)).try_cast("bigint") for k in range(3))
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 1..899 without 666 as 0..897
    new = feistel((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn", back)
    new_serial = F.pmod(new, F.lit(9999))
    rest = ((new - new_serial) / 9999).cast("bigint")
    new_group = F.pmod(rest, F.lit(99))
    new_place = ((rest - new_group) / 99).cast("bigint")
    new_area = F.when(new_place >= 665, new_place + 2).otherwise(new_place + 1)
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(good, F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((new_group + 1).cast("string"), 2, "0"),
                                    F.lpad((new_serial + 1).cast("string"), 4, "0"))).otherwise(m)


def _ip(m: Column, key: str, back: bool) -> Column:
    parts = [F.get(F.split(m, r"\."), F.lit(k)).try_cast("bigint") for k in range(4)]
    new = feistel(((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3], 65536, 65536, key, "ip", back)
    text = F.concat_ws(".", *[F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    # A leading zero has no place in the answer: such spellings stay as they are.
    good = ~m.rlike(r"(^|\.)0[0-9]") & (F.greatest(*parts) <= 255)
    return F.when(good, text).otherwise(m)


_WINDOW = 73_000  # days
# Days of a year before each month and in all, 29 February apart: of all days, of days 1 to 9, of days from 13 on.
_ALL = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365)
_SHORT = tuple(9 * k for k in range(13))
_LATE = tuple(x - 12 * k for k, x in enumerate(_ALL))


def _date(m: Column, key: str, back: bool) -> Column:
    def text(order, separator, y, mo, d):
        return F.when(order == 0, F.concat(y, separator, mo, separator, d)).when(
            order == 2, F.concat(mo, separator, d, separator, y)).otherwise(F.concat(d, separator, mo, separator, y))

    def whole(order, separator, day):
        """Two digits each: any day of the window."""
        base = F.lit("1900-01-01").cast("date")
        written = lambda new: text(order, separator, *[F.date_format(new, p) for p in ("yyyy", "MM", "dd")])
        return _let(lambda number: F.when(number.between(0, _WINDOW - 1), _let(
            written, F.date_add(base, feistel(number, 250, 292, key, "date", back).cast("int")))).otherwise(m),
            F.datediff(day, base).cast("bigint"))

    def alike(order, separator, mo, d, year, month, of_month):
        """Written with one digit, or day first by need: days that are written so, in 200 years."""
        def ranked(starts, size, least):
            place = feistel((year - 1900) * size + F.get(starts, month - 1) + of_month - least, 200, size, key, "date", back)

            def dated(new_year, rank, new_month):
                new_day = rank - F.get(starts, new_month - 1) + least
                return text(order, separator, new_year.cast("string"), F.lpad(new_month.cast("string"), F.length(mo), "0"),
                            F.lpad(new_day.cast("string"), F.length(d), "0"))

            return _let(lambda place: _let(
                dated, ((place - F.pmod(place, size)) / size + 1900).cast("bigint"), F.pmod(place, size),
                F.size(F.filter(F.slice(starts, 1, 12), lambda x: x <= F.pmod(place, size)))), place)

        starts = F.when(F.length(d) == 1, F.array(*map(F.lit, _SHORT))).when(
            order == 3, F.array(*map(F.lit, _LATE))).otherwise(F.array(*map(F.lit, _ALL)))
        leap = (feistel(((year - 1904) / 4).cast("bigint"), 7, 7, key, "leap", back) * 4 + 1904).cast("string")  # to 2096
        plain = _let(ranked, starts, F.get(starts, F.when(F.length(mo) == 1, 9).otherwise(12)).cast("bigint"),
                     F.when(order == 3, 13).otherwise(1))
        return F.when((month == 2) & (of_month == 29), text(order, separator, leap, mo, d)).otherwise(plain)

    def judged(order, separator, mo, d, day):
        two = (F.length(mo) == 2) & (F.length(d) == 2) & (order < 3)
        return F.when(two, whole(order, separator, day)).when(F.year(day).between(1900, 2099), _let(
            alike, order, separator, mo, d, F.year(day), F.month(day), F.dayofmonth(day))).otherwise(m)

    def read(order, separator, a, b, c):
        y, mo = F.when(order == 0, a).otherwise(c), F.when(order == 2, a).otherwise(b)
        d = F.when(order == 0, c).when(order == 2, b).otherwise(a)
        day = F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
        return _let(judged, order, separator, mo, d, day)

    def parts(separator, a, b, c):
        # year first, day first, month first, or day first because no month has that number
        order = F.when(F.length(a) == 4, 0).when(separator != "/", 1).when(a.try_cast("int") > 12, 3).otherwise(2)
        return _let(read, order, separator, a, b, c)

    return _let(parts, F.regexp_extract(m, "[^0-9]", 0),
                *[F.regexp_extract(m, "^([0-9]+)[^0-9]([0-9]+)[^0-9]([0-9]+)$", k) for k in (1, 2, 3)])


def _email(m: Column, key: str) -> Column:
    rest = F.regexp_replace(m, r"^[^@]*@[^.]*", "")
    code = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(code, 1, 12), F.lit("@h"), F.substring(code, 13, 6), rest)


def _secret(m: Column, key: str) -> Column:
    """As long as before; hexadecimal stays so, an AKIA key keeps its beginning, capitals stay; so does the name before."""
    name = F.regexp_extract(m, f"^{NAMED}", 0)
    value = F.substr(m, F.length(name) + 1, F.length(m))
    n = F.length(value)
    first = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lit("0"), value), 256)
    blocks = _let(lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), lambda k: F.when(
        k == 0, x).otherwise(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), k.cast("string"), x), 256))), ""), first)
    code = F.substr(F.when(value.rlike("^[0-9A-Z]+$"), F.upper(blocks)).otherwise(blocks), F.lit(1), n)
    akia = F.concat(F.lit("AKIA"), F.substr(code, F.lit(5), n))
    return F.concat(name, F.when(value.startswith("AKIA"), akia).otherwise(code))


def kind_of(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str = KEY, back: bool = False) -> Column:
    """The pseudonym of one match of a kind, or the match itself if it fails its check. back: from pseudonym to value,
    for all kinds but email and secret, which are one-way."""
    out = F.when(kind == "card", _card(m, key, back)).when(kind == "phone", _phone(m, key, back))
    out = out.when(kind == "ip", _ip(m, key, back)).when(kind == "date", _date(m, key, back))
    out = out.when(kind == "ssn", _ssn(m, key, back)).when(kind == "iban", _iban(m, key, back))
    if not back:
        out = out.when(kind == "email", _email(m, key)).when(kind == "secret", _secret(m, key))
    return out.otherwise(m)


def _rebuilt(documents: DataFrame, key: str, text: str, found: str | None, back: bool) -> DataFrame:
    hits = "_matches"
    while hits in documents.columns:
        hits += "_"
    source, rows = F.col(f"`{text}`"), F.col(f"`{hits}`")
    kinds = F.transform(F.regexp_extract_all(source, F.lit(f"({ANY})"), F.lit(0)),
                        lambda m: F.struct(m.alias("old"), kind_of(m).alias("kind")))
    replaced = F.transform(kinds, lambda r: F.struct(
        r["old"].alias("old"), r["kind"].alias("kind"), pseudonym(r["old"], r["kind"], key, back).alias("new")))
    table = documents.withColumn(hits, F.when(source.rlike(MAYBE), replaced))
    none = F.coalesce(F.size(rows) < 1, F.lit(True))
    joined = F.array_join(F.zip_with(F.split(source, ANY, -1), rows, lambda p, r: F.concat(p, F.coalesce(r["new"], F.lit("")))), "")
    columns = [F.when(none, source).otherwise(joined).alias(text) if c == text else F.col(f"`{c}`")
               for c in documents.columns if c != found]
    if found:
        changed = F.transform(F.filter(rows, lambda r: r["old"] != r["new"]), lambda r: r["kind"])
        columns.append(F.when(none, F.array().cast("array<string>")).otherwise(changed).alias(found))
    return table.select(*columns)


def masked(documents: DataFrame, key: str = KEY, text: str = "text", found: str | None = None) -> DataFrame:
    """The table with pseudonyms in its text and, if a name is given, the kinds of what was replaced, in its order."""
    return _rebuilt(documents, key, text, found, False)


def restored(documents: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """The table with the values that ``masked`` has permuted; names of emails and secrets cannot be brought back."""
    return _rebuilt(documents, key, text, None, True)
