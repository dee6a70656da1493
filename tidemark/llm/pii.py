"""Format-preserving Feistel pseudonyms for personal data, in DataFrame operations only.

A found value is validated and becomes a list of residues, one per place that may change (a digit, a letter, an address
byte, the year and the day of a date), each with its own modulus; the rest of its format stays. A keyed Feistel network
adds to one half of the list residues drawn from a hash of the other half, in turn. That is a permutation within the
format: equal values get equal pseudonyms in every document, different values different ones. Numbers and phones are
permuted without their blanks, hyphens and parentheses, which are put back, so a number stays linked however it is
written. Texts are rewritten where they lie, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import let

#: What is looked for. Lookbehinds make each pattern start only where a run starts.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE = r"(?<![0-9A-Za-z])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4})(?![0-9A-Za-z])"
ADDRESS = r"(?<![0-9A-Za-z])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
NUMBER = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "date": DATE, "address": ADDRESS, "phone": PHONE, "number": NUMBER}
ANY = "|".join(KINDS.values())
ROUNDS = 8
#: Dates from 1800-01-01 on, as many as 400 times 365.
FIRST_DAY, YEARS, DAYS = "1800-01-01", 400, 365


#: Card numbers begin with 2 to 6; areas of social security numbers run from 1 to 899 without 666.
CARD_FIRST, CARD_STARTS = 2, 5
SSN_GAP = 666
SSN_MODULI = (898, 99, 9999)


def feistel(residues: Column, key: Column) -> Column:
    """struct<values, moduli, tag> -> the permuted values. ``tag`` keeps formats apart."""

    def rounds(x: Column) -> Column:
        n = F.size(x["values"])
        half = F.floor(n / 2).cast("int")

        def added(to: Column, by: Column, mods: Column, round_no: Column) -> Column:
            said = F.concat_ws("|", key, x["tag"], round_no, n, F.array_join(by.cast("array<string>"), ","))
            # eight residues are drawn from each hash
            hashes = F.transform(F.sequence(F.lit(0), F.floor(F.size(to) / 8)), lambda k: F.sha2(F.concat_ws("|", said, k), 256))
            return let(hashes, lambda h: F.transform(F.zip_with(to, mods, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda y, i: F.pmod(y["v"] + F.conv(F.substring(h[F.floor(i / 8).cast("int")], F.pmod(i, F.lit(8)) * 8 + 1, F.lit(8)), 16, 10).cast("bigint"), y["m"])))

        zero = F.struct(F.slice(x["values"], F.lit(1), half).alias("to"), F.slice(x["values"], half + 1, n - half).alias("by"), F.slice(x["moduli"], F.lit(1), half).alias("m_to"), F.slice(x["moduli"], half + 1, n - half).alias("m_by"))
        # the half that changes and the one that drives change places before each round
        step = lambda acc, k: F.struct(added(acc["by"], acc["to"], acc["m_by"], k).alias("to"), acc["to"].alias("by"), acc["m_by"].alias("m_to"), acc["m_to"].alias("m_by"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, step, lambda acc: F.concat(acc["to"], acc["by"]))

    return let(residues, rounds)


def _characters(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))).cast("bigint"))


def _base(c: Column) -> Column:
    return F.when(c.between(48, 57), 48).when(c.between(65, 90), 65).when(c.between(97, 122), 97).otherwise(c).cast("bigint")


def _modulus(c: Column) -> Column:
    return F.when(c.between(48, 57), 10).when(c.between(65, 90), 26).when(c.between(97, 122), 26).otherwise(1).cast("bigint")


def _by_class(s: Column, tag: Column) -> Column:
    """Residues of a string: digits stay digits, letters letters of their case, other characters themselves."""
    form = lambda codes: F.array_join(F.transform(codes, lambda c: F.when(c.between(48, 57), F.lit("0")).otherwise(F.chr(_base(c)))), "")
    return let(_characters(s), lambda codes: F.struct(F.transform(codes, lambda c: c - _base(c)).alias("values"), F.transform(codes, _modulus).alias("moduli"), F.concat_ws(":", tag, form(codes)).alias("tag")))


def _classed(s: Column, new: Column) -> Column:
    return F.array_join(F.zip_with(_characters(s), new, lambda c, v: F.chr(_base(c) + v)), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string that a check digit is to follow."""
    each = F.transform(_characters(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, F.when((c - 48) * 2 > 9, (c - 48) * 2 - 9).otherwise((c - 48) * 2)).otherwise(c - 48))
    return F.when(F.length(digits) > 0, F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _put_back(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced by others, in order."""
    place = lambda i: F.length(_digits(F.substring(s, F.lit(1), i)))
    chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: let(F.substring(s, i, F.lit(1)), lambda c: F.when(c.between("0", "9"), F.substring(digits, place(i), F.lit(1))).otherwise(c)))
    return F.array_join(chars, "")


def _is_ssn(s: Column) -> Column:
    return F.length(_digits(s)) == 9


def _ssn(digits: Column) -> Column:
    """Area, group and serial number."""
    return F.array(*[F.substring(digits, at, n).cast("bigint") for at, n in ((1, 3), (4, 2), (6, 4))])


def _is_number(s: Column) -> Column:
    """A card number whose Luhn check holds, or a social security number that can exist."""
    card = F.substring(s, 1, 1).between(str(CARD_FIRST), str(CARD_FIRST + CARD_STARTS - 1)) & let(_digits(s), lambda d: (luhn(F.substring(d, F.lit(1), F.length(d) - 1)) + F.substring(d, F.length(d), F.lit(1)).cast("bigint")) % 10 == 0)
    ssn = let(_ssn(_digits(s)), lambda p: (p[0].between(1, 899)) & (p[0] != SSN_GAP) & (p[1] > 0) & (p[2] > 0))
    return F.when(_is_ssn(s), ssn).otherwise(card)


def _number_residues(s: Column) -> Column:
    longs = lambda *xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    ssn = let(_ssn(_digits(s)), lambda p: F.struct(F.array(p[0] - 1 - (p[0] > SSN_GAP).cast("bigint"), p[1] - 1, p[2] - 1).alias("values"), longs(*SSN_MODULI).alias("moduli"), F.lit("ssn").alias("tag")))
    body = lambda d: F.substring(d, F.lit(1), F.length(d) - 1)
    first = lambda i, x, y: F.when(i == 0, F.lit(x)).otherwise(F.lit(y)).cast("bigint")
    card = let(_characters(body(_digits(s))), lambda codes: F.struct(F.transform(codes, lambda c, i: c - 48 - first(i, CARD_FIRST, 0)).alias("values"), F.transform(codes, lambda c, i: first(i, CARD_STARTS, 10)).alias("moduli"), F.lit("card").alias("tag")))
    return F.when(_is_ssn(s), ssn).otherwise(card)


def _number(s: Column, new: Column) -> Column:
    """The number of the new residues in the format of the old one; a card gets the check digit that it needs."""
    area = let(new[0] + 1, lambda a: a + (a >= SSN_GAP).cast("bigint"))
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    ssn = F.concat(padded(area, 3), padded(new[1] + 1, 2), padded(new[2] + 1, 4))
    body = F.array_join(F.transform(new, lambda v, i: F.when(i == 0, v + CARD_FIRST).otherwise(v).cast("string")), "")
    card = let(body, lambda b: F.concat(b, F.pmod(-luhn(b), F.lit(10)).cast("string")))
    return _put_back(s, F.when(_is_ssn(s), ssn).otherwise(card))


def _phone_residues(part: Column) -> Column:
    return let(_characters(_digits(part)), lambda codes: F.struct(F.transform(codes, lambda c: c - 48).alias("values"), F.transform(codes, lambda c: F.lit(10).cast("bigint")).alias("moduli"), F.lit("phone").alias("tag")))


def _date_parts(s: Column) -> Column:
    """array of year, month, day; with / or . the day comes first unless only the month can."""
    n = F.transform(F.split(s, "[-/.]"), lambda x: x.cast("int"))
    return F.when(F.substring(s, 5, 1) == "-", n).when((n[1] > 12) & (n[0] <= 12), F.array(n[2], n[0], n[1])).otherwise(F.array(n[2], n[1], n[0]))


def _day(parts: Column) -> Column:
    return F.datediff(F.make_date(parts[0], parts[1], parts[2]), F.lit(FIRST_DAY).cast("date"))


def _dated(s: Column, new: Column) -> Column:
    """The date of the new residues in the format of the old one."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (new[0] * DAYS + new[1]).cast("int"))
    mark = F.regexp_extract(s, "[/.]", 0)
    american = F.split(s, "[/.]")

    def formatted(d: Column) -> Column:
        dd, mm, yyyy = (F.date_format(d, f) for f in ("dd", "MM", "yyyy"))
        return F.when(mark == "", F.date_format(d, "yyyy-MM-dd")).when((american[1].cast("int") > 12) & (american[0].cast("int") <= 12), F.concat(mm, mark, dd, mark, yyyy)).otherwise(F.concat(dd, mark, mm, mark, yyyy))

    return let(day, formatted)


def _is_date(s: Column) -> Column:
    def exists(parts: Column) -> Column:
        good = (parts[1].between(1, 12)) & (parts[2] >= 1) & (parts[0].between(1800, 2199))
        last = F.dayofmonth(F.last_day(F.make_date(parts[0], parts[1], F.lit(1))))
        return F.when(good, F.when(parts[2] <= last, _day(parts) < YEARS * DAYS).otherwise(False)).otherwise(False)

    return let(_date_parts(s), exists)


def kind(s: Column) -> Column:
    """Kind of a match of ANY; null for what fails its check and is left as it is."""
    address = F.forall(F.split(s, r"\."), lambda x: x.try_cast("int") <= 255)
    return (
        F.when(s.contains("@"), F.lit("email"))
        .when(s.rlike(f"^{DATE}$"), F.when(_is_date(s), F.lit("date")))
        .when(s.rlike(f"^{ADDRESS}$"), F.when(address, F.lit("address")))
        .when(s.rlike(f"^{NUMBER}$"), F.when(_is_number(s), F.lit("number")))
        .otherwise(F.lit("phone"))
    )


def _part(s: Column, what: Column) -> Column:
    """The part of an e-mail or a phone that is permuted: what comes before the domain, or after the country code."""
    code = F.length(F.regexp_extract(s, r"^\+[0-9]{1,3}", 0))
    return F.when(what == "email", F.substring_index(s, "@", 1)).otherwise(F.substring(s, code + 1, F.length(s)))


def _residues(s: Column, what: Column, part: Column) -> Column:
    day = lambda d: F.struct(F.array(F.floor(d / DAYS), F.pmod(d, F.lit(DAYS)).cast("bigint")).alias("values"), F.array(F.lit(YEARS), F.lit(DAYS)).cast("array<bigint>").alias("moduli"), F.lit("date").alias("tag"))
    address = F.struct(F.transform(F.split(s, r"\."), lambda x: x.cast("bigint")).alias("values"), F.array_repeat(F.lit(256).cast("bigint"), 4).alias("moduli"), F.lit("address").alias("tag"))
    return F.when(what == "date", let(let(_date_parts(s), _day), day)).when(what == "address", address).when(what == "number", _number_residues(s)).when(what == "phone", _phone_residues(part)).otherwise(_by_class(part, what))


def _written(s: Column, what: Column, part: Column, new: Column) -> Column:
    """The pseudonym."""
    return (
        F.when(what == "date", _dated(s, new))
        .when(what == "address", F.array_join(new.cast("array<string>"), "."))
        .when(what == "number", _number(s, new))
        .when(what == "email", F.concat(_classed(part, new), F.substring(s, F.length(part) + 1, F.length(s))))
        .otherwise(F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(part)), _put_back(part, F.array_join(new.cast("array<string>"), ""))))
    )


def _count(what: str) -> Column:
    return F.size(F.filter("_found", lambda x: F.coalesce(x["kind"] == what, F.lit(False)))).cast("long")


def pseudonymise(df: DataFrame, key: str | DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` rewritten, and ``n_email``, ``n_date``, ``n_address``, ``n_phone``, ``n_number`` (replaced values).

    ``key`` is a table of one row and one column, read when the query runs, so that the key is in no plan; a string
    serves for tests. One row per row, repeated rows too; a null text stays null with counts of 0; other columns stay,
    but for those with the names of the counts, which are replaced. E-mail keeps its domain, a phone its country code.
    Numbers are card numbers of 13 to 19 digits whose Luhn check holds, which stay valid, and social security numbers
    that can exist; dates must exist and lie in 1800-2199. Values that fail the check of their format are left.
    """
    df = df.withColumn("_key", F.lit(key) if isinstance(key, str) else key.scalar())
    t = F.col(text)
    found = F.when(t.rlike(ANY), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_found", F.transform(found, lambda s: F.struct(s.alias("s"), kind(s).alias("kind"))))
    # one column a step, so that no step is worked out twice
    df = df.withColumn("_part", F.transform("_found", lambda x: F.when(x["kind"].isNotNull(), _part(x["s"], x["kind"]))))
    df = df.withColumn("_res", F.zip_with("_found", "_part", lambda x, p: F.when(x["kind"].isNotNull(), _residues(x["s"], x["kind"], p))))
    df = df.withColumn("_res", F.transform("_res", lambda r: F.when(r.isNotNull(), feistel(r, F.col("_key")))))
    both = F.zip_with("_part", "_res", lambda p, r: F.struct(p.alias("part"), r.alias("new")))
    df = df.withColumn("_new", F.zip_with("_found", both, lambda x, y: F.when(x["kind"].isNotNull(), _written(x["s"], x["kind"], y["part"], y["new"])).otherwise(x["s"])))
    pieces = F.transform(F.split(t, ANY, -1), lambda p, i: F.concat(p, F.coalesce(F.get("_new", i), F.lit(""))))
    counts = {f"n_{k}": _count(k) for k in KINDS}
    return df.withColumns(counts | {text: F.when(F.size("_found") > 0, F.array_join(pieces, "")).otherwise(t)}).drop("_found", "_part", "_res", "_new", "_key")
