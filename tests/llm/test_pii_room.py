"""Operator 4: forms without room, harmless words, and entities that a test planted itself."""

import itertools
import random
import re
import string

from millrace.llm import pii


def test_surrogates_never_run_out(spark):
    """Every short local part of a domain, every one-letter domain, all short numbers: distinct, and none is its own."""
    one, two = list(string.ascii_lowercase), ["".join(p) for p in itertools.product(string.ascii_lowercase, repeat=2)]
    rows = [("email", f"{x}@example.com") for x in one + two]
    rows += [("domain", f"{x}.com") for x in one + two] + [("email", f"a@{x}.com") for x in one]
    rows += [("phone", f"+49{n:03d}") for n in range(1000)] + [("ipv6", f"{a:x}::{b:x}") for a in range(16) for b in range(16)] + [("ipv6", "fe80::1")]
    rows += [("first_latin_f", x) for x in two] + [("first_latin_f", "")] + [("ssn", "123456789")]
    table = pii.surrogates(spark.createDataFrame(rows, "type string, canonical string"), "k").collect()
    made = {(r["type"], r["canonical"]): r["surrogate"] for r in table}
    assert len(table) == len(set(rows)) == len(made) and made["first_latin_f", ""] == ""
    assert len({(t, s) for (t, _), s in made.items()}) == len(made)
    assert all(s != c for (_, c), s in made.items() if c)
    assert all(s.endswith("@example.com") for (t, c), s in made.items() if t == "email" and c.endswith("@example.com"))
    assert all(re.fullmatch(r"\+49\d{3}", s) for (t, _), s in made.items() if t == "phone") and all(re.fullmatch(r"[a-z]+\.com", s) for (t, _), s in made.items() if t == "domain")
    real = {(t, c) for t, c in rows if t in ("email", "domain", "first_latin_f") and c}
    assert not real & {(t, s) for (t, _), s in made.items()}  # where a space can grow, no surrogate is an entity


def test_short_addresses_of_a_corpus(spark):
    docs = spark.createDataFrame([(i, f"to {x}@example.com now") for i, x in enumerate(string.ascii_lowercase)], "doc_id long, text string")
    made = [re.fullmatch(r"to (\S+)@(\S+) now", r["text"]) for r in pii.replace(docs, key="k").collect()]
    assert all(made) and len({m[1] for m in made}) == 26 and len({m[2] for m in made}) == 1


def test_common_words_are_no_names(spark):
    texts = [
        "Mr. Will Young came in May. Will you send Mr. May a letter? Young people like it.",
        "Dr. Anna Stark spoke. Stark said so. A stark choice.",
        "Dr. Anna Stark spoke. Stark said so; write to stark@example.org.",
        "Mr. Will Young and Young Will met Will Young in May.",
    ]
    out = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), key="k").collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came in May\. Will you send Mr\. (\w+) a letter\? Young people like it\.", out[0])
    assert m and "Young" not in m[2] and m[3] != "May"
    assert re.fullmatch(r"Dr\. \w+ (?!Stark)\w+ spoke\. Stark said so\. A stark choice\.", out[1])
    m = re.fullmatch(r"Dr\. \w+ (\w+) spoke\. (\w+) said so; write to \w{5}@\w{7}\.org\.", out[2])
    assert m and m[1] == m[2] != "Stark"
    m = re.fullmatch(r"Mr\. (\w+) (\w+) and (\w+) (\w+) met (\w+) (\w+) in May\.", out[3])
    assert m and m[1] == m[4] == m[5] and m[2] == m[3] == m[6]


def _luhn(digits):
    """The check digit."""
    total = sum((lambda x: x // 10 + x % 10)(int(d) * (2 - i % 2)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def test_planted_entities(spark):
    """Texts are put together from words, decoys and entities whose places are known, without the module's patterns."""
    r = random.Random(5)
    digits = lambda n, first="123456789": r.choice(first) + "".join(r.choice(string.digits) for _ in range(n - 1))
    letters = lambda n: "".join(r.choice(string.ascii_lowercase) for _ in range(n))

    def iban():
        body = digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        return f"DE{check:02d}{body}"

    make = {
        "email": lambda: f"{letters(r.randrange(1, 9))}.{letters(3)}+{digits(2)}@{letters(5)}.co.uk",
        "key": lambda: "ghp_" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(36)),
        "secret": lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        "iban": iban,
        "ip": lambda: ".".join(str(r.randrange(1, 255)) for _ in range(4)),
        "ipv6": lambda: ":".join(f"{r.randrange(4096, 65536):x}" for _ in range(8)),
        "phone": lambda: r.choice([f"+44 20 {digits(4)} {digits(4)}", f"({digits(3, '23456789')}) {digits(3, '23456789')}-{digits(4)}", f"0{digits(3)}-{digits(7)}", f"0{digits(2)} {digits(7)}"]),
        "ssn": lambda: f"{digits(3, '12345')}-{digits(2)}-{digits(4)}",
        "card": lambda: (lambda d: d + _luhn(d))("4" + digits(14)),
        "name": lambda: f"{r.choice(['Mr.', 'Mrs', 'Dr.', 'Frau', 'Sgt.', 'Г-жа'])} {r.choice(['Anna Kovacs', 'Петрова', 'Lee', 'Jean Dupont-Moreau'])}",
    }
    decoys = ["at 12:30:45", "version 1.22.333", "2024-05-06", "$1,299.00", "x = y[3]", "page 12 of 340", "std::vector", "a@b", "1234567", "(1999)", "ISBN 978-3-16", "naïve", "…", "\n"]
    rows, want = [], {}
    for i in range(400):
        pieces, kinds = [], []
        for _ in range(r.randrange(1, 14)):
            if r.random() < 0.4:
                k = r.choice(list(make))
                kinds.append(k)
                pieces.append(make[k]())
            else:
                kinds.append(None)
                pieces.append(r.choice(decoys) if r.random() < 0.5 else letters(r.randrange(2, 9)))
        rows.append((i, " , ".join(pieces)))
        want[i] = list(zip(pieces, kinds, strict=True))
    seen = {}
    for row in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect():
        planted, got = want[row["doc_id"]], row["text"].split(" , ")
        assert len(planted) == len(got)
        assert {k: n for k, n in row["pii_found"].asDict().items() if n} == {k: sum(x == k for _, x in planted) for _, k in planted if k}, (planted, row["pii_found"])
        for (old, kind), new in zip(planted, got, strict=True):
            assert (new == old) == (kind is None), (kind, old, new)
            if kind:
                assert seen.setdefault((kind, old), new) == new and (kind in ("ip", "email", "name") or re.sub(r"\w", "", old) == re.sub(r"\w", "", new))
    assert len({(k, new) for (k, _), new in seen.items()}) == len(seen)
