"""Private numbers, dates and names under format-preserving Feistel pseudonyms, with DataFrame functions only.

Found and validated: e-mail addresses, calendar dates, IPv4 addresses, card numbers (Luhn), US social security numbers,
phone numbers, and quoted or assigned secrets (token, password, secret, api key). What fails its check stays. A value is
permuted by a keyed Feistel network within its own format: digits stay digits, letters letters of their case, separators
stay; card numbers stay Luhn-valid, social security numbers valid, octets under 256, dates real dates whose day and month
have as many digits as before. The network sees the value without its separators (for dates the year, month and day),
so equal values get equal pseudonyms in all documents and in every way of writing them, and unlike ones stay unlike. A
single letter or digit always changes. An e-mail address keeps its domain, a secret its name.

Dates count from FIRST_YEAR for YEARS years; day/month/year is tried before month/day/year. Whole texts are searched,
long ones too, each in one go: repeated groups of the patterns are possessive, which Java runs as loops, and a value of
any length is hashed once a round. A null text stays null, an empty one empty. Rows are judged one by one, so that repeated
rows and rows without an id give what their text gives, and no rows give no rows. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The session's setting that has the key, and the key of the query where that is unset (a demonstration: anyone can undo it).
SETTING, DEMO_KEY = "spark.seqcover.pii.key", "demonstration only"
ROUNDS = 8
FIRST_YEAR, YEARS = 1900, 201
#: How often a day that no month has is permuted on; one try in 30 fails.
TRIES = 12
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "date": r"(?<![\d./-])(?:\d{4}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{1,2}|\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{4})(?![\d/-]|\.\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[.-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "secret": r"\b(?i:token|password|passwd|secret|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{6,}",
}
PATTERN = "|".join(KINDS.values())
_NAME = r"^[A-Za-z_-]+\s*[=:]\s*[\"']?"


def _byte(*parts: Column | str, at: Column | None = None, digits: int = 2) -> Column:
    """A number from the keyed hash of the parts: `digits` hex digits of it."""
    h = F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(h, 1, digits) if at is None else F.substr(h, at, F.lit(digits)), 16, 10).cast("long")


def _bound(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _shifted(text: Column, other: Column, key: str, kind: str, round_: Column) -> Column:
    """Each letter or digit of text moved on within its kind by what the other half gives at its place: the other half is hashed once, then the hash with the number of each 32 places."""

    def move(hashes: Column):
        def one(c: Column, i: Column) -> Column:
            by, code = F.conv(F.substr(F.get(hashes, (i / 32).cast("int")), (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.ascii(c)
            turn = lambda first, n: F.char(F.lit(first) + (code - first + by) % n)
            return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    spread = lambda whole: F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 32).cast("int")), lambda k: F.sha2(F.concat_ws("|", whole, k.cast("string")), 256))
    whole = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), other), 256)
    return _bound(_bound(whole, spread), move)


def permuted(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of letters and digits with the same kinds at the same places; one character alone is moved on by a fixed step, which isn't zero."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, _shifted(s["l"], s["r"], key, kind, i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(_shifted(s["r"], s["l"], key, kind, i)).alias("r"))

    by, code = _byte(key, kind, "one", digits=12), F.ascii(text)
    turn = lambda first, n: F.char(F.lit(first) + (code - first + 1 + by % (n - 1)) % n)
    one = F.when(text.between("0", "9"), turn(48, 10)).when(text.between("a", "z"), turn(97, 26)).otherwise(turn(65, 26))
    return F.when(F.length(text) == 1, one).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"])))


def paired(left: Column, right: Column, lefts: Column | int, rights: Column | int, key: str, kind: Column | str) -> Column:
    """A keyed permutation of the pairs (l, r) of numbers under `lefts` and under `rights`."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        moved = lambda a, b, n: ((a + _byte(key, kind, i, b, digits=12)) % n).cast("long")
        even = i % 2 == 0
        return F.struct(F.when(even, moved(s["l"], s["r"], lefts)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved(s["r"], s["l"], rights)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def _refilled(shape: Column, plain: Column) -> Column:
    """plain's characters in the places of shape's letters and digits. Both are sorted by place once, so long values take their length."""
    own = lambda c: c.rlike("[A-Za-z0-9]")
    known = lambda x: x.isNotNull()

    def put(made: Column) -> Column:
        chars = F.split(shape, "")
        seats = F.filter(F.transform(chars, lambda c, i: F.when(own(c), i)), known)
        rest = F.filter(F.transform(chars, lambda c, i: F.when(~own(c), F.struct(i.alias("i"), c.alias("c")))), known)
        filled = F.concat(F.zip_with(seats, F.split(made, ""), lambda i, c: F.struct(i.alias("i"), c.alias("c"))), rest)
        return F.when(F.length(made) == F.length(shape), made).otherwise(F.array_join(F.transform(F.sort_array(filled), lambda x: x["c"]), ""))

    return _bound(plain, put)


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is zero for a valid number."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))
    )


def _card(m: Column, key: str) -> Column:
    digits = _plain(m)
    body = permuted(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(_luhn(digits) % 10 == 0, _refilled(m, F.concat(body, check.cast("string"))))


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    high, low = part[0] * 256 + part[1], part[2] * 256 + part[3]
    made = F.transform(F.array(paired(high, low, 1 << 16, 1 << 16, key, "ip")), lambda to: F.concat_ws(".", F.floor(to["l"] / 256).cast("long"), to["l"] % 256, F.floor(to["r"] / 256).cast("long"), to["r"] % 256))
    return made[0]


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serial numbers 0001 to 9999."""
    part = F.transform(F.split(m, "-"), lambda x: x.cast("long"))
    area = part[0] - 1 - (part[0] > 666).cast("long")

    def spelt(to: Column) -> Column:
        own = to["l"] + 1 + (to["l"] >= 665).cast("long")
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(own, 3), pad(F.floor(to["r"] / 9999).cast("long") + 1, 2), pad(to["r"] % 9999 + 1, 4))

    return F.transform(F.array(paired(area, (part[1] - 1) * 9999 + part[2] - 1, 898, 99 * 9999, key, "ssn")), spelt)[0]


def _date(m: Column, key: str) -> Column:
    """Days and months of one digit are permuted among each other, and so are those of two."""
    part = F.split(m, "[-/.]")
    year_first = F.length(part[0]) == 4
    year = F.when(year_first, part[0]).otherwise(part[2])
    real = lambda month, d: F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd").isNotNull()
    usual = F.when(year_first, real(part[1], part[2])).otherwise(real(part[1], part[0]))
    turned = ~year_first & ~usual & real(part[0], part[1])
    month = F.when(year_first | ~turned, part[1]).otherwise(part[0]).cast("long")
    day = F.when(year_first, part[2]).when(turned, part[1]).otherwise(part[0]).cast("long")
    # the first of the days and of the months of as many digits, and how many there are
    day_from, days = F.when(day < 10, 1).otherwise(10), F.when(day < 10, 9).otherwise(22)
    month_from, months = F.when(month < 10, 1).otherwise(10), F.when(month < 10, 9).otherwise(3)
    kind = F.concat(F.lit("date"), day_from.cast("string"), month_from.cast("string"))
    spelt = lambda s: (s["l"] + FIRST_YEAR, F.floor(s["r"] / days).cast("long") + month_from, s["r"] % days + day_from)
    exists = lambda s: F.try_to_date(F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in zip(spelt(s), (4, 2, 2), strict=True))), "yyyy-MM-dd").isNotNull()
    on = lambda l, r: paired(l, r, YEARS, days * months, key, kind)
    first = on(year.cast("long") - FIRST_YEAR, (month - month_from) * days + day - day_from)
    to = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), first, lambda s, _: F.when(exists(s), s).otherwise(on(s["l"], s["r"])))

    def written(s: Column) -> Column:
        y, mm, d = (x.cast("string") for x in spelt(s))
        sign, as_long = F.regexp_extract(m, "[-/.]", 0), lambda x, k: F.lpad(x, F.length(part[k]), "0")
        return F.when(year_first, F.concat(y, sign, as_long(mm, 1), sign, as_long(d, 2))).when(turned, F.concat(as_long(mm, 0), sign, as_long(d, 1), sign, y)).otherwise(F.concat(as_long(d, 0), sign, as_long(mm, 1), sign, y))

    inside = year.cast("int").between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
    return F.when((usual | turned) & inside, F.transform(F.array(to), written)[0])


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of PATTERN; null if it fails its check."""
    at = F.instr(m, "@")
    local, name = F.substr(m, F.lit(1), at - 1), F.regexp_extract(m, _NAME, 0)
    secret = F.substr(m, F.length(name) + 1, F.length(m))
    whole = lambda kind: F.regexp_extract(m, f"^(?:{KINDS[kind]})$", 0) != ""
    return (
        F.when((name != "") & (at == 0), F.concat(name, _refilled(secret, permuted(_plain(secret), key, "secret"))))
        .when(at > 0, F.concat(_refilled(local, permuted(_plain(local), key, "email")), F.substr(m, at, F.length(m))))
        .when(whole("date"), _date(m, key))
        .when(whole("ip"), _ip(m, key))
        .when(whole("card"), _card(m, key))
        .when(whole("ssn"), _ssn(m, key))
        .otherwise(_refilled(m, permuted(_plain(m), key, "phone")))
    )


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in text, and n_private (matches that were valid), which takes the place of a column of that name."""
    text = F.col("text")
    found = F.when(text.rlike(r"[0-9]{3}|@|[0-9][./-][0-9]|[=:]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    found_, made_ = common.unused("_found", docs.columns), common.unused("_made", docs.columns)
    out = docs.drop("n_private").withColumn(found_, found)
    made = F.when(F.size(found_) > 0, F.transform(found_, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))))
    out = out.withColumn(made_, made)
    parts = F.split(text, PATTERN, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(parts, 1, F.size(made_)), F.col(made_), lambda p, x: F.concat(p, F.coalesce(x["new"], x["old"]))), ""), F.element_at(parts, -1))
    new = F.when(F.col(made_).isNull(), text).otherwise(joined)
    count = F.coalesce(F.size(F.filter(made_, lambda x: x["new"].isNotNull())), F.lit(0))
    return out.select(*[new.alias(c) if c == "text" else F.col(c) for c in docs.columns if c != "n_private"], F.when(F.col(made_).isNull(), 0).otherwise(count).cast("long").alias("n_private"))


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymised(common.table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(SETTING, DEMO_KEY))
