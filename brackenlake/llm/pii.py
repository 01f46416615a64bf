"""Personal data (op9): validated numbers and dates become keyed pseudonyms of the same format.

Everything is a DataFrame expression. A text is split at what looks like personal data, each find
is permuted by a Feistel network over its own format, and the parts are put together again. A
permutation is keyed, so that equal values get equal pseudonyms in all documents and unequal ones
unequal pseudonyms.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

#: The setting that holds the key of a deployment.
KEY_SETTING = "spark.brackenlake.pii.key"
_drawn: dict[str, str] = {}
ROUNDS = 8
KINDS = ("email", "phone", "card", "ssn", "ip", "date", "secret")

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}"
CARD = r"\d(?:[ -]?\d){12,18}(?![\d])"
#: Usual groups of a card number, looked for at each group of a run of digits: 4-4-4-4-3, 4-4-4-4, 4-6-5, unbroken.
USUAL = tuple(rf"{x}(?!\d)" for x in (r"(?:\d{4}[ -]){4}\d{3}", r"(?:\d{4}[ -]){3}\d{4}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{13,19}"))
SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
DATE = r"\d{4}-\d{2}-\d{2}(?![\d-])|\d{2}/\d{2}/\d{4}(?![\d/])"
SECRET_NAME = r"(?i:password|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\x22']?"
SECRET = rf"AKIA[0-9A-Z]{{16}}(?![0-9A-Za-z])|{SECRET_NAME}[A-Za-z0-9_-]{{8,128}}"
#: Finds start at the beginning of a run of such characters, so a long run is looked at once.
BEFORE = r"(?<![A-Za-z0-9._%+-])"
FINDS = rf"{BEFORE}(?:{EMAIL}|{DATE}|{SSN}|{IP}|{CARD}|{PHONE}|{SECRET})"
#: A card may also follow groups of digits and hyphens that start so.
INNER = rf"(?<=\d-)(?<={BEFORE}\d[\d-]{{0,60}}-)"
NO_CARD = "[^\\s\\S]"


def key_of(spark: SparkSession) -> str:
    """The key that the session is set to, else one drawn at random for this application and kept nowhere.

    So no key is known beforehand; without the setting equal values are linked within one
    application only.
    """
    app = spark.sparkContext.applicationId
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(app, secrets.token_hex(16))


def _number(key: str, *parts: Column) -> Column:
    """A keyed pseudo-random number of 48 bits from some values."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long")


def permute(index: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1: a Feistel network whose halves are numbers below a and below b."""
    start = F.struct(F.floor(index / b).cast("long").alias("l"), (index % b).cast("long").alias("r"))
    turn = lambda s, i: F.when(i % 2 == 0, F.struct(((s["l"] + _number(key, F.lit(kind), i, s["r"])) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _number(key, F.lit(kind), i, s["l"])) % b).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def _moved(part: Column, by: Column, i: Column, key: str, kind: str) -> Column:
    """Each digit and letter of a half moved on within its class by a stream from the other half."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(part) - 1) / 16)).cast("int")), lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.length(part).cast("string"), k.cast("string"), by), 256))
    stream = F.array_join(blocks, "")

    def move(c, j):
        v = F.conv(F.substr(stream, j * 4 + 1, F.lit(4)), 16, 10).cast("int")
        at = F.ascii(c)
        turn = lambda low, n: F.char(F.lit(low) + (at - low + v) % n)
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    chars = F.filter(F.split(part, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, move), "")


def permute_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of texts that keeps each character's class: digit, small, capital; others stay."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    turn = lambda s, i: F.struct(F.when(i % 2 == 1, _moved(s["l"], s["r"], i, key, kind)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, _moved(s["r"], s["l"], i, key, kind)).otherwise(s["r"]).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _luhn(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right; every other one is doubled, from the first (doubled 0) or second (1)."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = lambda c, j: F.when(j % 2 == doubled, F.when(c.cast("int") >= 5, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(each, value), F.lit(0), lambda s, x: s + x)


def _refill(shape: Column, digits: Column) -> Column:
    """The digits of one text put in the places of another's digits."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _card(x: Column, key: str) -> Column:
    d = _digits(x)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    return _refill(x, F.concat(body, ((10 - _luhn(body, 0) % 10) % 10).cast("string")))


def _finds(t: Column) -> Column:
    """The pattern of all finds of a text, with its valid card numbers in place of CARD.

    The check digit is tested first, on the usual groups at each start and on whole runs, so that
    digits that are no card number take nothing from what stands before, in or after them.
    """
    valid = lambda found: F.filter(found, lambda x: _luhn(_digits(x), 1) % 10 == 0)
    usual = F.concat(*[F.regexp_extract_all(t, F.lit(rf"(?:{BEFORE}|{INNER})(?=({x}))"), F.lit(1)) for x in USUAL])
    runs = F.filter(F.regexp_extract_all(t, F.lit(f"({FINDS})"), F.lit(1)), lambda x: x.rlike(f"^(?:{CARD})$") & ~x.rlike(f"^(?:{DATE}|{SSN}|{IP})$"))
    cards = F.array_distinct(F.concat(valid(usual), valid(runs)))
    either = F.when(F.size(cards) > 0, F.concat(F.lit("(?:"), F.array_join(cards, "|"), F.lit(r")(?!\d)"))).otherwise(F.lit(NO_CARD))
    start = F.concat(F.lit(f"(?:{BEFORE}(?:{EMAIL}|{DATE}|{SSN}|{IP}|"), either, F.lit(f"|{PHONE}|{SECRET})"))
    return F.concat(start, F.when(F.size(cards) > 0, F.concat(F.lit(f"|{INNER}"), either)).otherwise(F.lit("")), F.lit(")"))


def _ip(x: Column, key: str) -> Column:
    o = F.split(x, r"\.")
    n = F.aggregate(o, F.lit(0).cast("long"), lambda s, c: s * 256 + c.cast("long"))
    out = permute(n, 65536, 65536, key, "ip")
    return F.concat_ws(".", *[(F.floor(out / 256**k) % 256).cast("long").cast("string") for k in (3, 2, 1, 0)])


def _ssn(x: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999: a permutation of the numbers that pass the check."""
    area, group, serial = (F.get(F.split(x, "-"), k).cast("long") for k in range(3))
    n = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    out = permute(n, 898 * 99, 9999, key, "ssn")
    area = F.floor(out / (99 * 9999)).cast("long") + 1
    parts = (area + (area >= 666).cast("long"), 3), (F.floor(out / 9999).cast("long") % 99 + 1, 2), (out % 9999 + 1, 4)
    return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])


#: 400 years from 1900 on: 146,097 days, 189 times 773; without the first 12 days of each month 88,497, 9 times 9,833.
FIRST_DAY, DAYS, LATE_DAYS = "1900-01-01", (189, 773), (9, 9833)
_MONTHS = 4800


def _day(x: Column) -> Column:
    return F.try_to_date(x, "yyyy-MM-dd")


def _as_iso(x: Column, order: tuple[int, int, int]) -> Column:
    p = F.split(x, "[-/]")
    return F.concat_ws("-", *[F.get(p, k) for k in order])


def _after(n: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))


def _month(day: Column) -> Column:
    return (F.year(day) - 1900) * 12 + F.month(day) - 1


def _late(day: Column, n: Column, key: str) -> Column:
    """Another day after the 12th of its month: such days are numbered, permuted, and found again from about the right month."""
    out = permute((n - 12 * (_month(day) + 1)).cast("long"), *LATE_DAYS, key, "late date")
    guess = F.floor(out * _MONTHS / (LATE_DAYS[0] * LATE_DAYS[1]))
    tries = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.struct((guess + i).alias("m"), _after(out + 12 * (guess + i + 1)).alias("d")))
    return F.get(F.filter(tries, lambda t: (_month(t["d"]) == t["m"]) & (F.dayofmonth(t["d"]) > 12)), 0)["d"]


def _date(x: Column, key: str) -> tuple[Column, Column]:
    """(valid, pseudonym): of yyyy-mm-dd, of dd/mm/yyyy, or, if that is no date, of mm/dd/yyyy.

    Each of the three has its own range: pseudonyms of the third have days over 12, so that they
    are no dates of the second.
    """
    slash = F.contains(x, F.lit("/"))
    a, b, c = (_day(_as_iso(x, o)) for o in ((0, 1, 2), (2, 1, 0), (2, 0, 1)))
    day = F.when(~slash, a).otherwise(F.coalesce(b, c))
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    valid = day.isNotNull() & n.between(0, DAYS[0] * DAYS[1] - 1)
    out = _after(permute(n.cast("long"), *DAYS, key, "date"))
    return valid, F.when(~slash, F.date_format(out, "yyyy-MM-dd")).when(b.isNotNull(), F.date_format(out, "dd/MM/yyyy")).otherwise(F.date_format(_late(day, n, key), "MM/dd/yyyy"))


def _find(x: Column, key: str) -> Column:
    """struct(kind, new) of one find; kind is null and new the find itself if it is not valid."""
    of = lambda kind, new: F.struct(F.lit(kind).alias("kind"), new.alias("new"))
    whole = lambda p: x.rlike(f"^(?:{p})$")
    nothing = F.struct(F.lit(None).cast("string").alias("kind"), x.alias("new"))
    local = F.substring_index(x, "@", 1)
    valid, day = _date(x, key)
    name = F.regexp_extract(x, rf"^({SECRET_NAME})", 1)
    secret = F.when(x.startswith("AKIA"), F.concat(F.lit("AKIA"), permute_text(F.substr(x, F.lit(5)), key, "secret"))).otherwise(F.concat(name, permute_text(F.substr(x, F.length(name) + 1), key, "secret")))
    d = _digits(x)
    # the country code of a phone number stays, as does an area's place in brackets
    code = F.regexp_extract(x, r"^(\+\d{1,3}[ .-]?)", 1)
    rest = F.substr(x, F.length(code) + 1)
    return (
        F.when(F.contains(x, F.lit("@")), of("email", F.concat(permute_text(local, key, "email"), F.substr(x, F.length(local) + 1))))
        .when(whole(DATE), F.when(valid, of("date", day)).otherwise(nothing))
        .when(whole(SSN), F.when(~x.rlike("^(?:000|666|9)") & ~x.rlike("-00-|-0000$"), of("ssn", _ssn(x, key))).otherwise(nothing))
        .when(whole(IP), F.when(F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255), of("ip", _ip(x, key))).otherwise(nothing))
        .when(whole(CARD), F.when(_luhn(d, 1) % 10 == 0, of("card", _card(x, key))).otherwise(nothing))
        .when(x.rlike("^[+(]"), of("phone", F.concat(code, _refill(rest, permute_text(_digits(rest), key, "phone")))))
        .otherwise(of("secret", secret))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of docs with the text rewritten, and n_<kind> for each kind and n_pii.

    Card numbers must pass their check digit (which is made anew); in longer runs of digits they are
    found in their usual groups (USUAL). Dates must exist (1900 to 2299,
    where their pseudonyms lie), octets of addresses must be under 256; numbers that fail stay as
    they are. Domains of addresses, country codes and all other text stay. A null text stays null,
    with counts of 0; empty texts stay empty; repeated rows come out each, alike; columns named as
    the counts are replaced. The key is a secret of the deployment (key_of). No shuffle, no Python.
    """
    if not key:
        raise ValueError("a key is needed")
    found = docs.drop(*[c for c in docs.columns if c.startswith("n_") and c[2:] in (*KINDS, "pii")])
    t = F.col(text)
    might = t.rlike("[0-9@]|AKIA|(?i:password|token|secret|api_?key)")  # a secret may be letters only
    finds, held = base.free_name(found, "finds"), base.free_name(found, "hits")
    found = found.withColumn(finds, F.when(might, _finds(t)))
    hits = F.when(might, F.regexp_extract_all(t, F.concat(F.lit("("), F.col(finds), F.lit(")")), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = found.withColumn(held, F.transform(hits, lambda x: _find(x, key)))
    parts = F.split(t, F.col(finds), -1)
    new = F.array_join(F.zip_with(parts, F.col(held)["new"], lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")
    found = found.withColumn(text, F.when(F.size(held) > 0, new).otherwise(t))
    n = lambda k: F.size(F.filter(F.col(held)["kind"], lambda x: x == k)).cast("long")
    counted = found.withColumns({f"n_{k}": F.greatest(n(k), F.lit(0)).cast("long") for k in KINDS})
    return counted.withColumn("n_pii", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long"))).drop(finds, held)
