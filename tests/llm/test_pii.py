from __future__ import annotations

import re
import time

from fieldloom.llm import pii
from tests.llm.conftest import TRICKY, clash


KEY = b"a key for tests"


def test_permutation_is_one_to_one():
    for n in (1, 2, 7, 100, 1000):
        new = [pii.permute(i, n, b"k", b"t") for i in range(n)]
        assert sorted(new) == list(range(n)) and (n == 1 or all(i != x for i, x in enumerate(new)))


def test_formats_stay_and_equal_values_stay_linked():
    text = "Card 4111 1111 1111 1111 or 4111111111111111, mail jo.doe@example.org, born 1990-05-17 or 17.05.1990, SSN 123-45-6789, at 10.0.0.1, IBAN DE89 3704 0044 0532 0130 00, call +49 30 1234567."
    new, found = pii.pseudonymise(text, KEY)
    kinds = [k for _, _, k, _ in found]
    assert {"card", "mail", "date", "social", "address", "iban"} <= set(kinds)
    by = {text[s:e]: p for s, e, _, p in found}
    a, b = by["4111 1111 1111 1111"], by["4111111111111111"]
    assert a.replace(" ", "") == b and pii.luhn_digit(b[:-1]) == b[-1] and a != "4111 1111 1111 1111"
    assert re.fullmatch(r"\d{4}-\d{2}-\d{2}", by["1990-05-17"]) and by["1990-05-17"].split("-") == by["17.05.1990"].split(".")[::-1]
    iban = by["DE89 3704 0044 0532 0130 00"].replace(" ", "")
    assert iban.startswith("DE") and pii.iban_digits("DE", iban[4:]) == iban[2:4]
    assert by["jo.doe@example.org"].endswith("@example.org")
    assert new != text and re.sub(r"[A-Za-z0-9]", "", new) == re.sub(r"[A-Za-z0-9]", "", text)
    assert pii.pseudonymise(text, KEY)[0] == new and pii.pseudonymise(text, b"other key")[0] != new


def test_invalid_values_stay():
    text = "4111 1111 1111 1112, 2024-13-45, 999.1.1.1, 000-12-3456"
    assert pii.pseudonymise(text, KEY) == (text, [])


def test_table(spark, tricky, documents):
    out = {r["doc_id"]: (r["text"], len(r["findings"])) for r in pii.replace(clash(tricky), KEY).collect()}
    assert out == {i: (t, 0) for i, t in TRICKY}
    assert pii.replace(tricky.where("false"), KEY).count() == 0
    rows = pii.replace(documents, KEY).collect()
    assert len(rows) == documents.count() and any(r["findings"] for r in rows)


def test_ibans_of_all_countries_whatever_follows():
    for country, n in pii.IBAN_LENGTHS.items():
        rest = "".join("ABCD1234567890"[(i * 5 + n) % 14] for i in range(n - 4))
        flat = country + pii.iban_digits(country, rest) + rest
        for form in (flat, " ".join(flat[i : i + 4] for i in range(0, n, 4))):
            for after in ("", " EUR", " BIC", " 7", " ABCD", " ABCD EF", ", 12"):
                found = [(s, e, p.replace(" ", "")) for s, e, k, p in pii.pseudonymise(f"to {form}{after}", KEY)[1] if k == "iban"]
                assert [f[:2] for f in found] == [(3, 3 + len(form))], (form, after)
                new = found[0][2]
                assert new[:2] == country and new != flat and pii.iban_digits(country, new[4:]) == new[2:4]
    for text in ("ES9121000418450200051332 EUR", "BE68 5390 0754 7034 EUR", "PL61109010140000071219812874 BIC", "GR16 0110 1250 0000 0001 2300 695", "GB12 ABCD ES91 2100 0418 4502 0005 1332"):
        assert [k for _, _, k, _ in pii.pseudonymise(text, KEY)[1]] == ["iban"]
    assert pii.pseudonymise("ES9221000418450200051332 EUR", KEY)[0][:24] == "ES9221000418450200051332"


def test_phone_numbers_however_separated():
    for forms in (("+49 30 1234567", "+49301234567", "+49-30-1234567", "+4930 1234567", "+49.30.1234567"), ("+1 555 123 4567", "+15551234567", "+1 (555) 123-4567"), ("+351 21 123 4567", "+351211234567")):
        new = [pii.pseudonymise(f"call {f} now", KEY)[0][5:-4] for f in forms]
        assert [re.sub(r"\d", "0", x) for x in new] == [re.sub(r"\d", "0", f) for f in forms]
        assert len({re.sub(r"\D", "", x) for x in new}) == 1 and new[0] != forms[0]


def test_no_value_stays_and_no_two_meet():
    values = ["иван@example.org", "李雷@example.org", "a@example.org", "b@example.org", "élan@example.org", "٣@example.org", "4111111111111111", "11111111111111117"[:16], "0000000000000018", "12. März 2020", "3 mai 2021", "1er mai 2021", "3 de mayo de 2021", "May 3, 1999"]
    values += [f"{i}111111111111111"[:15] + pii.luhn_digit(f"{i}111111111111111"[:15]) for i in range(10)]
    for v in values:
        new, found = pii.pseudonymise(f"x {v} y", KEY)
        assert len(found) == (0 if v == "1111111111111111" else 1), v
        assert not found or f" {v} " not in new
    cards = {d + pii.luhn_digit(d) for d in (f"{i:012d}" for i in [*range(300), 10**12 // 9 * 1])}
    made = {pii.pseudonymise(c, KEY)[0] for c in cards if len(set(c)) > 1}
    assert len(made) == len([c for c in cards if len(set(c)) > 1])
    singles = [pii.pseudonymise(f"{c}@example.org", KEY)[0] for c in "abcdefghijklmnopqrstuvwxyz"]
    assert len(set(singles)) == 26


def test_dates_of_four_languages_are_linked():
    forms = {"en": ("3 May 2021", "May 3, 2021"), "de": ("3. Mai 2021",), "fr": ("3 mai 2021",), "es": ("3 de mayo de 2021",)}
    day = pii.pseudonymise("2021-05-03", KEY)[0]
    y, m, d = map(int, day.split("-"))
    for language, texts in forms.items():
        name = pii.MONTHS[language][m - 1]
        want = {"en": (f"{d} {name} {y}", f"{name} {d}, {y}"), "de": (f"{d}. {name} {y}",), "fr": (f"{d} {name} {y}",), "es": (f"{d} de {name} de {y}",)}[language]
        assert tuple(pii.pseudonymise(t, KEY)[0] for t in texts) == want


def test_long_texts_take_time_in_proportion():
    hard = ["w" * 3_000_000 + "@", "+" * 3_000_000, "1990-05-17 " * 300_000, "a@b" * 1_000_000, "1 " * 1_500_000, "DE89 " * 600_000, "(" * 2_000_000 + "1", "a." * 1_500_000 + "@a." + "b." * 1_000_000]
    for text in hard:
        start = time.process_time()
        pii.pseudonymise(text, KEY)
        assert time.process_time() - start < 60, text[:20]


def plain(text):
    """(start, kind) of values, kind by kind at every place of the text, by forms written without regard to speed."""
    forms = [
        ("mail", r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", r"[\w.+-]"),
        ("iban", r"[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30}\b", r"\w"),
        ("date", r"\d{4}-\d\d-\d\d(?!\d)", r"\d"),
        ("social", r"\d{3}-\d\d-\d{4}(?![\d-])", r"[\d-]"),
        ("address", r"(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", r"[\d.]"),
        ("card", r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)|\d{16}(?!\d)", r"\d"),
    ]
    out, used = [], [False] * len(text)
    for kind, form, before in forms:
        for i in range(len(text)):
            m = re.compile(form).match(text, i)
            if m and not used[i] and not (i and re.match(before, text[i - 1])):
                digits = re.sub(r"\D", "", m[0])
                if kind == "card" and pii.luhn_digit(digits[:-1]) != digits[-1]:
                    continue
                if kind == "address" and max(map(int, m[0].split("."))) > 255:
                    continue
                if kind == "iban" and not any(pii.iban_digits(v[:2], v[4:]) == v[2:4] for v in [re.sub(" ", "", m[0])[: pii.IBAN_LENGTHS.get(m[0][:2], 0)]] if len(v) > 4):
                    continue
                out.append((i, kind))
                used[m.start() : m.end()] = [True] * (m.end() - m.start())
    return out


def test_finds_what_a_plain_search_finds(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    seen = 0
    for r in rows:
        text = r["text"] or ""
        if len(text) < 6000 and re.search(r"@|\d{3}", text):
            want = {(i, k) for i, k in plain(text)}
            found = {(s, k) for s, _, k, _ in pii.pseudonymise(text, KEY)[1]}
            assert want <= found and all(k in ("phone", "date", "card", "address") for _, k in found - want), (want ^ found)
            seen += len(want)
    assert seen > 20


#: Values of each language, in the forms that people write.
FORMS = {
    "en": ["+1 555 123 4567", "1 555 123 4567", "1-555-123-4567", "5551234567", "555-123-4567", "(555) 123-4567", "555 123 4567", "555.123.4567", "+44 20 7946 0958", "+44 (0)20 7946 0958", "3/4/1985", "04/03/85", "12/31/1999", "2020-1-2", "2020-01-02", "5 Jan 2020", "jan 5, 2020", "March 5th, 1999", "5th March 1999", "5th of March 1999", "Mar 5 1999", "05-Jan-2020", "Sept. 5, 2019", "J.O'Neil@x.org"],
    "de": ["+49 (0)30 123456", "+49 30 1234567", "030 1234567", "(030) 1234567", "030/1234567", "030-123456", "030 / 12 34 56", "0170 1234567", "01701234567", "089 12345678", "+43 1 58858", "+41 44 668 18 00", "1.2.2020", "01.02.2020", "01.02.85", "5. Januar 2020", "5. Jan. 2020", "5. März 2020", "5. Mrz 2020", "5. Okt. 2020", "31. Dez 1999", "x@münchen.de", "jürgen.groß@straße.de"],
    "fr": ["+33 6 12 34 56 78", "+33612345678", "+33 (0)6 12 34 56 78", "06 12 34 56 78", "06.12.34.56.78", "06-12-34-56-78", "0612345678", "01 23 45 67 89", "01/02/2020", "1/2/2020", "01/02/85", "1er mai 2021", "1er janv. 2021", "5 janv. 2020", "5 févr. 2020", "5 août 2020", "14 juillet 1989", "14 juil. 1989", "25 déc. 2001", "5 Avr 2003", "rené.d'arc@exemple.fr"],
    "es": ["+34 612 34 56 78", "+34 912 345 678", "612 34 56 78", "612345678", "612 345 678", "91 123 45 67", "912 345 678", "912-345-678", "612.34.56.78", "5/1/2020", "05/01/2020", "05-01-2020", "5.1.2020", "05/01/85", "5 de enero de 2020", "5 de enero del 2020", "5 ene 2020", "5 de ene. de 2020", "12 sept 1999", "12 oct. 1999", "3 dic. 1988", "peña@correo.es"],
}


def test_forms_of_four_languages():
    for language, values in FORMS.items():
        assert len(values) >= 20
        for v in values:
            for text in (f"call {v} now", v, f"({v})", f"a: {v}, b", f"{v}."):
                new, found = pii.pseudonymise(text, KEY)
                assert len(found) == 1, (language, text, found)
                s, e, _, p = found[0]
                assert text[s:e] == v and p != v and v not in new, (language, text)


def test_numbers_are_linked_through_their_forms():
    for forms in (("+1 555 223 4567", "1 555 223 4567", "555-223-4567", "(555) 223-4567", "5552234567"), ("+34 612 34 56 78", "612 345 678", "612345678"), ("+49 (0)30 123456", "+49 30 123456", "+4930123456"), ("06 12 34 56 78", "0612345678", "06.12.34.56.78")):
        new = [re.sub(r"\D", "", pii.pseudonymise(f, KEY)[0].replace("(0)", "")) for f in forms]
        assert len({x[-9:] if forms[0].startswith("+34") else x[-10:] for x in new}) == 1, (forms, new)
    assert pii.pseudonymise("3/4/1985", KEY)[0].split("/") == [str(int(x)) for x in pii.pseudonymise("03/04/1985", KEY)[0].split("/")]


def test_what_is_no_value_stays():
    for text in ("version 1.2.3.4", "v1.2.3.4 of it", "in 1999 or 2001", "1 2 3 4 5 6 7 8", "12.5.3", "3.14159265", "1,000,000,000", "31/31/1999", "20000000", "May 2020", "pages 100-200", "section 1.2.3"):
        assert pii.pseudonymise(text, KEY) == (text, []), text


def test_worded_dates_stay_apart():
    text = "On 5 May 2020, 6 May 2021 and May 7, 2022; 12. März 2020/13. März 2020"
    assert [text[s:e] for s, e, _, _ in pii.pseudonymise(text, KEY)[1]] == ["5 May 2020", "6 May 2021", "May 7, 2022", "12. März 2020", "13. März 2020"]
