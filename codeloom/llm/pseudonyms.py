"""Format-preserving pseudonyms for private values, in SQL expressions only.

Each value found in a text is validated (checksum, calendar, number ranges) and
replaced by a keyed permutation of its own format: a Feistel network whose halves
are lists of digits in mixed radix, mixed by addition. A permutation sends equal
values to equal pseudonyms and different ones to different ones, so records stay
linked across documents, and a valid value stays a valid value.

All of it happens in one projection: no shuffle, no state, nothing broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.decontaminate import fresh

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX, LEADING = "0123456789abcdef", "23456789"

#: Days from 1900-01-01 to 2099-12-31: 17 * 4297.
DAYS, DAY_RADICES = 73049, (17, 4297)
FIRST_DAY = "1900-01-01"

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "date": r"(?<![\d/.-])(?:(?:19|20)\d\d(?:-\d\d-\d\d|/\d\d/\d\d)|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?!\d|[/-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "card": r"(?<!\d)(?:\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "phone": r"(?<![\d+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d(?:[ .()-]{0,2}\d){7,13})(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=[=\"'])(?:[0-9a-f]{16,64}|[0-9A-F]{16,64})(?![0-9A-Za-z])",
}
#: The look-aheads let most characters fail at once.
FIND = f"(?=[0-9+(])(?:{'|'.join(PATTERNS[k] for k in ('date', 'ssn', 'ipv4', 'card', 'phone'))})|{PATTERNS['secret']}|(?=[A-Z])(?:{PATTERNS['access_key']}|{PATTERNS['iban']})"
FIND_MAIL = f"{PATTERNS['email']}|{FIND}"


def let(value: Column, body: callable) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, radices: Column, tweak: Column, key: str, rounds: int = 8) -> Column:
    """Permute a list of numbers, each below its radix, by a keyed Feistel network with additive mixing.

    Each round adds to the left half, number by number, a keyed hash of the right
    half, and swaps the halves. ``rounds`` is even, so the halves end in their places.
    """
    def halves(v: Column) -> Column:
        half = F.floor(F.size(v["values"]) / 2).cast("int")
        rest = F.size(v["values"]) - half
        return F.struct(F.slice(v["values"], 1, half).alias("l"), F.slice(v["values"], half + 1, rest).alias("r"), F.slice(v["radices"], 1, half).alias("m"), F.slice(v["radices"], half + 1, rest).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.array_join(acc["r"].cast("array<string>"), ","))

        def mixed(seed: Column) -> Column:
            def one(v: Column, j: Column) -> Column:
                hashed = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, j.cast("string")), 256), 1, 12), 16, 10).cast("long")
                return F.pmod(v + hashed, F.element_at(acc["m"], j + 1)).cast("int")

            return F.transform(acc["l"], one)

        return F.struct(acc["r"].alias("l"), let(seed, mixed).alias("r"), acc["s"].alias("m"), acc["m"].alias("s"))

    start = let(F.struct(values.alias("values"), radices.alias("radices")), halves)
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda d: F.concat(d["l"], d["r"]))


def characters(text: Column) -> Column:
    """The characters of a non-empty string."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))


def permuted_text(text: Column, alphabet: callable, tweak: Column, key: str) -> Column:
    """Permute characters within the alphabets that ``alphabet(character, place)`` gives; one of a single character keeps it."""
    def moved(v: Column) -> Column:
        values = F.zip_with(v["chars"], v["alphabets"], lambda c, a: (F.position(c, a) - 1).cast("int"))
        radices = F.transform(v["alphabets"], lambda a: F.length(a))
        return F.array_join(F.zip_with(feistel(values, radices, tweak, key), v["alphabets"], lambda n, a: F.substr(a, n + 1, F.lit(1))), "")

    with_alphabets = let(characters(text), lambda c: F.struct(c.alias("chars"), F.transform(c, alphabet).alias("alphabets")))
    return let(with_alphabets, moved)


def refilled(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in order."""
    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substr(acc["digits"], acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + is_digit.cast("int")).alias("at"), acc["digits"].alias("digits"))

    return F.aggregate(characters(template), F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), digits.alias("digits")), step, lambda acc: acc["out"])


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum in which the last digit counts once; the number is valid if 10 divides it."""
    values = F.reverse(F.transform(characters(digits), lambda c: c.cast("int")))
    weighted = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v > 4, v * 2 - 9).otherwise(v * 2)))
    return F.aggregate(weighted, F.lit(0), lambda a, v: a + v)


def card(match: Column, key: str) -> Column:
    """A card number by its checksum: the first digit stays, the last is computed anew."""
    digits = only_digits(match)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    moved = permuted_text(body, lambda c, i: F.when(i == 0, c).otherwise(F.lit(DIGITS)), F.lit("card"), key)
    full = let(moved, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(luhn_sum(digits) % 10 == 0, refilled(match, full)).otherwise(match)


def phone(match: Column, key: str) -> Column:
    """Ten-digit numbers keep a valid area and exchange code; others behind a plus keep two digits."""
    digits = only_digits(match)
    national = F.substr(digits, F.length(digits) - 9, F.lit(10))
    prefix = F.substr(digits, F.lit(1), F.length(digits) - 10)
    regular = ((F.length(digits) == 10) & ~F.startswith(match, F.lit("+"))) | ((F.length(digits) == 11) & F.startswith(digits, F.lit("1")))
    valid = regular & national.rlike("^[2-9][0-9]{2}[2-9]")
    moved = permuted_text(national, lambda c, i: F.when(i.isin(0, 3), F.lit(LEADING)).otherwise(F.lit(DIGITS)), F.lit("phone"), key)
    abroad = permuted_text(digits, lambda c, i: F.when(i < 2, c).otherwise(F.lit(DIGITS)), F.lit("phone abroad"), key)
    return F.when(valid, refilled(match, F.concat(prefix, moved))).when(F.startswith(match, F.lit("+")), refilled(match, abroad)).otherwise(match)


def number_list(values: list[Column], radices: tuple[int, ...], tweak: str, key: str) -> Column:
    return feistel(F.array(*(v.cast("int") for v in values)), F.array(*(F.lit(r) for r in radices)), F.lit(tweak), key)


def ipv4(match: Column, key: str) -> Column:
    octets = F.split(match, "\\.")
    valid = match.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}$")
    moved = number_list([octets[i] for i in range(4)], (256,) * 4, "ipv4", key)
    return F.when(valid, F.array_join(moved.cast("array<string>"), ".")).otherwise(match)


def ssn(match: Column, key: str) -> Column:
    parts = F.split(match, "-")
    area, group, serial = (parts[i].cast("int") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    moved = number_list([F.when(area < 666, area - 1).otherwise(area - 2), group - 1, serial - 1], (898, 99, 9999), "ssn", key)
    written = let(moved, lambda m: F.format_string("%03d-%02d-%04d", F.when(m[0] < 665, m[0] + 1).otherwise(m[0] + 2), m[1] + 1, m[2] + 1))
    return F.when(valid, written).otherwise(match)


def moved_day(day: Column, tweak: str, key: str) -> Column:
    """Permute a day number below ``DAYS``."""
    low = DAY_RADICES[1]
    moved = let(day, lambda d: number_list([F.floor(d / low), d % low], DAY_RADICES, tweak, key))
    return F.aggregate(moved, F.lit(0), lambda a, v: (a * low + v).cast("int"))


def date(match: Column, key: str) -> Column:
    """Dates from 1900 to 2099 as year-month-day, month/day/year, day/month/year where the day is above 12, or day.month.year."""
    digits = only_digits(match)
    year_first = match.rlike(r"^\d{4}")
    year = F.when(year_first, F.substr(digits, F.lit(1), F.lit(4))).otherwise(F.substr(digits, F.lit(5), F.lit(4))).cast("int")
    one = F.when(year_first, F.substr(digits, F.lit(5), F.lit(2))).otherwise(F.substr(digits, F.lit(1), F.lit(2))).cast("int")
    two = F.when(year_first, F.substr(digits, F.lit(7), F.lit(2))).otherwise(F.substr(digits, F.lit(3), F.lit(2))).cast("int")
    day_first = ~year_first & (F.contains(match, F.lit(".")) | (one > 12))
    month, day = F.when(day_first, two).otherwise(one), F.when(day_first, one).otherwise(two)
    valid = month.between(1, 12) & (day >= 1) & (day <= F.dayofmonth(F.last_day(F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1)))))
    number = F.datediff(F.make_date(F.when(valid, year), month, day), F.lit(FIRST_DAY).cast("date"))

    def as_date(n: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), n)

    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(99)),
        F.struct(number.alias("n"), F.lit(False).alias("done")),
        lambda acc, _: F.when(acc["done"], acc).otherwise(
            let(moved_day(acc["n"], "day first", key), lambda n: F.struct(n.alias("n"), (F.dayofmonth(as_date(n)) > 12).alias("done")))
        ),
        lambda acc: acc["n"],
    )
    slashed = day_first & F.contains(match, F.lit("/"))
    moved = F.when(slashed, walk).otherwise(moved_day(number, "date", key))
    written = let(
        as_date(moved),
        lambda d: F.when(F.contains(match, F.lit("-")), F.date_format(d, "yyyy-MM-dd")).when(year_first, F.date_format(d, "yyyy/MM/dd")).when(F.contains(match, F.lit(".")), F.date_format(d, "dd.MM.yyyy")).when(day_first, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")),
    )
    return F.when(valid, written).otherwise(match)


def mod_97(text: Column) -> Column:
    """The remainder of the text read as a number, letters as 10 to 35."""
    def step(acc: Column, c: Column) -> Column:
        value = (F.position(c, F.lit(DIGITS + UPPER)) - 1).cast("int")
        return (F.when(value < 10, acc * 10 + value).otherwise(acc * 100 + value) % 97).cast("int")

    return F.aggregate(characters(text), F.lit(0), step)


def by_class(c: Column) -> Column:
    """The alphabet of a character: digits, lower or upper case; others stand for themselves."""
    return F.when(c.between("0", "9"), F.lit(DIGITS)).when(c.between("a", "z"), F.lit(LOWER)).when(c.between("A", "Z"), F.lit(UPPER)).otherwise(c)


def valid_iban(match: Column) -> Column:
    plain = F.regexp_replace(match, " ", "")
    return mod_97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1


def iban(match: Column, key: str) -> Column:
    """Account numbers by their remainder of 97: the country stays, the check digits are computed anew."""
    plain = F.regexp_replace(match, " ", "")
    country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    moved = permuted_text(account, lambda c, i: by_class(c), F.concat(F.lit("iban "), country), key)
    full = let(moved, lambda a: F.concat(country, F.lpad((98 - mod_97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))

    def step(acc: Column, c: Column) -> Column:
        blank = c == " "
        return F.struct(F.concat(acc["out"], F.when(blank, c).otherwise(F.substr(acc["full"], acc["at"], F.lit(1)))).alias("out"), (acc["at"] + (~blank).cast("int")).alias("at"), acc["full"].alias("full"))

    spaced = F.aggregate(characters(match), F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), full.alias("full")), step, lambda acc: acc["out"])
    return F.when(valid_iban(match), spaced).otherwise(match)


def email(match: Column, key: str) -> Column:
    """The letters and digits before the at sign, each within its class; the domain stays."""
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    return F.concat(permuted_text(local, lambda c, i: by_class(c), F.concat(F.lit("email "), F.lower(domain)), key), F.lit("@"), domain)


def kind_of(match: Column, before: Column) -> Column:
    """The first pattern that the match is whole; a secret in the shape of an account number is one by what stands ``before`` it."""
    found = None
    for kind, pattern in PATTERNS.items():
        body = pattern.replace(PATTERNS["secret"], r"[0-9a-f]{16,64}|[0-9A-F]{16,64}") if kind == "secret" else pattern
        test = match.rlike(f"^(?:{body})$")
        if kind == "secret":
            test = test & ~match.rlike("^[0-9]{13,19}$")
        if kind == "iban":
            test = test & ~(match.rlike("^[0-9A-F]{16,64}$") & before.rlike("[=\"']$") & ~valid_iban(match))
        found = F.when(test, F.lit(kind)) if found is None else found.when(test, F.lit(kind))
    return found


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """struct(kind, value): the pseudonym of a match; what fails validation is left as it is."""
    access_key = F.concat(F.lit("AKIA"), permuted_text(F.substr(match, F.lit(5)), lambda c, i: F.lit(DIGITS + UPPER), F.lit("access_key"), key))
    hexadecimal = permuted_text(F.lower(match), lambda c, i: F.lit(HEX), F.lit("secret"), key)
    secret = F.when(match.rlike("[A-F]"), F.upper(hexadecimal)).otherwise(hexadecimal)
    value = F.when(kind == "email", email(match, key)).when(kind == "date", date(match, key)).when(kind == "ssn", ssn(match, key)).when(kind == "ipv4", ipv4(match, key)).when(kind == "card", card(match, key)).when(kind == "phone", phone(match, key)).when(kind == "iban", iban(match, key)).when(kind == "access_key", access_key).when(kind == "secret", secret).otherwise(match)
    return F.struct(kind.alias("kind"), value.alias("value"))


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Replace private values in a text column; adds n_private (values replaced) and private_kinds (sorted).

    Kinds: e-mail addresses, dates, social security numbers, IPv4 addresses, card
    numbers, phone numbers, bank accounts, access keys and hexadecimal secrets, of either
    case, after an equals sign or quote. A value that fails validation stays. A null text stays null
    with no values; the rest of a text stays as it is to the letter. Repeated rows are
    each treated; other columns are kept, and those named like the added ones replaced.
    """
    text = F.col(column)
    found = F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(FIND_MAIL), 0)).when(text.rlike("[0-9]|AKIA"), F.regexp_extract_all(text, F.lit(FIND), 0))
    parts = F.when(F.contains(text, F.lit("@")), F.split(text, FIND_MAIL)).otherwise(F.split(text, FIND))
    kept = docs.drop("n_private", "private_kinds")
    old, new = fresh(kept, "found"), fresh(kept, "new")
    out = kept.withColumn(old, F.coalesce(found, F.array().cast("array<string>")))
    before = F.when(F.size(old) > 0, F.slice(parts, F.lit(1), F.size(old))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn(new, F.zip_with(old, before, lambda m, p: let(kind_of(m, p), lambda kind: pseudonym(m, kind, key))))
    joined = F.array_join(F.flatten(F.zip_with(parts, F.transform(new, lambda n: n["value"]), lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    changed = F.filter(F.zip_with(old, new, lambda m, n: F.struct(m.alias("old"), n.alias("new"))), lambda z: z["old"] != z["new"]["value"])
    return out.withColumns({
        column: F.when(F.size(old) > 0, joined).otherwise(text),
        "n_private": F.size(changed).cast("long"),
        "private_kinds": F.array_sort(F.array_distinct(F.transform(changed, lambda z: z["new"]["kind"]))),
    }).drop(old, new)
