import datetime
import hashlib
import re

from tidemark.llm import pii

KEY = "k"


def feistel(values, moduli, tag):
    half = len(values) // 2
    to, by, m_to, m_by = list(values[:half]), list(values[half:]), moduli[:half], moduli[half:]
    for n in range(pii.ROUNDS):
        to, by, m_to, m_by = by, to, m_by, m_to
        said = "|".join(map(str, (KEY, tag, n, len(values), ",".join(map(str, by)))))
        draw = lambda i, said=said: int(hashlib.sha256(f"{said}|{i // 8}".encode()).hexdigest()[i % 8 * 8 :][:8], 16)
        to = [(v + draw(i)) % m for i, (v, m) in enumerate(zip(to, m_to, strict=True))]
    return to + by


def by_class(s, tag):
    base = [48 if c.isdigit() else 65 if c.isupper() else 97 if c.islower() else ord(c) for c in s]
    mods = [10 if b == 48 else 26 if b in (65, 97) and c.isalpha() else 1 for b, c in zip(base, s, strict=True)]
    form = "".join("0" if b == 48 and c.isdigit() else chr(b) for b, c in zip(base, s, strict=True))
    return "".join(chr(b + v) for b, v in zip(base, feistel([ord(c) - b for c, b in zip(s, base, strict=True)], mods, f"{tag}:{form}"), strict=True)) if s else s


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))


def brute(s):
    if "@" in s:
        local, _, domain = s.partition("@")
        return "email", by_class(local, "email") + "@" + domain
    if re.fullmatch(pii.DATE, s):
        n = list(map(int, re.split("[-/.]", s)))
        iso, american = s[4] == "-", n[1] > 12 and n[0] <= 12
        y, m, d = n if iso else (n[2], n[0], n[1]) if american else (n[2], n[1], n[0])
        try:
            day = (datetime.date(y, m, d) - datetime.date(1800, 1, 1)).days
        except ValueError:
            return None, s
        if not 0 <= day < 400 * 365:
            return None, s
        a, b = feistel([day // 365, day % 365], [400, 365], "date")
        to = datetime.date(1800, 1, 1) + datetime.timedelta(a * 365 + b)
        sep = re.search("[/.]", s)
        return "date", str(to) if iso else to.strftime(f"%m{sep[0]}%d{sep[0]}%Y") if american else to.strftime(f"%d{sep[0]}%m{sep[0]}%Y")
    if re.fullmatch(pii.ADDRESS, s):
        v = list(map(int, s.split(".")))
        return ("address", ".".join(map(str, feistel(v, [256] * 4, "address")))) if max(v) <= 255 else (None, s)
    digits = re.sub("[^0-9]", "", s)
    if re.fullmatch(pii.NUMBER, s):
        if len(digits) == 9:
            area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            areas = [a for a in range(1, 900) if a != 666]
            if area not in areas or not group or not serial:
                return None, s
            a, g, n = feistel([areas.index(area), group - 1, serial - 1], [898, 99, 9999], "ssn")
            new = f"{areas[a]:03d}{g + 1:02d}{n + 1:04d}"
        else:
            if digits[0] not in "23456" or (luhn(digits[:-1]) + int(digits[-1])) % 10:
                return None, s
            values = feistel([int(digits[0]) - 2, *map(int, digits[1:-1])], [5] + [10] * (len(digits) - 2), "card")
            new = "".join(map(str, [values[0] + 2, *values[1:]]))
            new += str(-luhn(new) % 10)
        return "number", put_back(s, new)
    code = re.match(r"\+\d{1,3}", s)
    code = code[0] if code else ""
    own = [int(c) for c in s[len(code) :] if c.isdigit()]
    return "phone", code + put_back(s[len(code) :], "".join(map(str, feistel(own, [10] * len(own), "phone"))))


def put_back(s, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in s)


def rewritten(text):
    counts = dict.fromkeys(pii.KINDS, 0)

    def put(m):
        k, new = brute(m[0])
        if k:
            counts[k] += 1
        return new

    return (text if text is None else re.sub(pii.ANY, put, text)), counts


TEXTS = [None, "", "nothing", "card 4111111111111111, again 4111111111111111! and 4111 1111 1111 1111", "bad 9807915762804490 7536784127813050 4845168114407329", "und.34@mail7.example.com A.B-c@x.org.", "+1 (017) 555-7713 and (017) 555-7713 555-123-4567", "1.2.3.4 999.1.1.1 255.255.255.255 1.2.3.4.5", "2024-02-29 2023-02-29 31/12/1999 12/31/1999 1.2.2003 99/99/2000 2199-12-31 1799-12-31", "token04dbebab9112345678901234 123-45-6789 123 45 6789 000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000", "1700000000123 9780306406157 378282246310005 3782 822463 10005 6011-0009-9013-9424 4111111111111112", "é" * 3000 + " 123456789 " + "a" * 20000, "@ x@ @y.z 1/2/3"]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_date string")
    got = pii.pseudonymise(df, KEY).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows, strict=True):
        text, counts = rewritten(t)
        assert (r.doc_id, r.text) == (i, text)
        assert {k: r[f"n_{k}"] for k in pii.KINDS} == counts


def test_against_brute_force(spark):
    check(spark, [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[4])])


def test_documents(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_permutation():
    assert len({tuple(feistel([a, b], [12, 7], "t")) for a in range(12) for b in range(7)}) == 84
    assert len({by_class(f"{i:03d}", "n") for i in range(1000)}) == 1000
    assert (luhn(brute("4111111111111111")[1][:-1]) + int(brute("4111111111111111")[1][-1])) % 10 == 0


def test_forms_of_a_value_stay_linked(spark):
    forms = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (743) 555-3824", "(743) 555-3824", "743-555-3824", "743.555.3824", "123-45-6789", "123 45 6789", "2024-02-29", "29/02/2024", "02/29/2024", "29.2.2024"]
    df = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    got = [r.text for r in pii.pseudonymise(df, KEY).orderBy("doc_id").collect()]
    digits = [re.sub(r"^\+1|[^0-9]", "", t) for t in got]
    assert len(set(digits[:3])) == len(set(digits[3:7])) == len(set(digits[7:9])) == 1
    day = lambda t: {t[:10]} if "-" in t else {"-".join(reversed(re.split("[/.]", t))), "-".join(re.split("[/.]", t)[i] for i in (2, 0, 1))}
    assert got[9] in set.intersection(*map(day, got[9:])) and not set(got) & set(forms)
    assert [re.sub("[0-9]", "9", t) for t in got[:9]] == [re.sub("[0-9]", "9", t).replace("+9", "+9") for t in forms[:9]]


def test_key_of_a_table(spark, tmp_path, capsys):
    (tmp_path / "key").write_text("a very secret key")
    df = spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string")
    made = pii.pseudonymise(df, spark.read.text(f"file://{tmp_path}/key"))
    assert made.first().text == pii.pseudonymise(df, "a very secret key").first().text != pii.pseudonymise(df, "another").first().text
    made.explain(True)
    assert "a very secret key" not in capsys.readouterr().out


def test_empty_table(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0
