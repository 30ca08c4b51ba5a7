"""Private data in sentences that were written without the templates, and columns that clash."""

import pytest

import corpus_pipeline
from kelpline.llm import decontaminate, private, secrets

# Written by hand: with private data, and without.
WITH = """
Please ring Marta on 0176 2233 4455 before noon.
Her number, 415-555-0134, is still valid.
You can text 07700 900461 any time.
Büro: 030/1234567, Durchwahl 12
Tel 030/1234567
anna (at) example.org
john dot smith at gmail dot com
peter at garden.org
My SSN was 219-09-9999 back then.
send it to kim_lee [at] mailbox [dot] org
billing at acme dot co dot uk handles refunds
Wire to DE44 5001 0517 5407 3249 31 today
IBAN: FR76 3000 6000 0112 3456 7890 189
GB29 NWBK 6016 1331 9268 19 is the account
ES9121000418450200051332
router 2001:0db8:85a3:0000:0000:8a2e:0370:7334 replied
ping fe80::1ff:fe23:4567:890a failed
Fax (212) 555-0187
phone: 2125550187
her mobile is 06 12 34 56 78
Handy 0151-23456789 bitte
Call (020) 7946 0958 for tickets
contact: 01 42 68 53 00
reach us: 800.555.0199
whatsapp 612 345 678
jane.doe (at) company (dot) com
write me: bob@home dot net
info [at] shop.de
support @ vendor . com
mail dave at example dot org
taxpayer 078-05-1120 filed late
social security 457-55-5462
identity no. 123-45-6789 expired
passport holder ssn 321-54-9876
maria at correo dot es
hello (at) studio.io
press at museum.org answers questions
sales_12 at store.com
contact ann.lee at uni dot edu now
tel 0221/998877 or later
Tel.: 089/12345678
Telefon (030) 123 4567
teléfono 91 123 45 67
call 1-800-555-0123 x4
office 020 7946 0991
cell 310.555.0121
his cell: 310 555 0122 thanks
sms to 0712 345 678
fax 0044 20 7946 0000
number 555-010-9988 rings out
bank account NL91 ABNA 0417 1643 00
konto AT61 1904 3002 3457 3201
IT60 X054 2811 1010 0000 0123 456
compte BE68 5390 0754 7034
CH93 0076 2011 6238 5295 7 please
2a02:26f0:00fe:0001:0000:0000:0000:0001 answered
address 2001:db8:1234:ffff:0:0:0:5 was blocked
fd12:3456:789a:1:2:3:4:5
nora at fjord dot no
leo(at)lyon.fr
"""
WITHOUT = """
We met at noon. Then it rained.
The war of 1914-1918 1939 1945
Pages 112-118 and 220
Version 10.15.7 of the system
It costs 1,200.50 today
The score was 21-19 21-15
In 2019 2020 2021 sales fell
Section 12.4.6 applies
Add 250 300 400 grams
ISBN 978-3-16-148410-0
Flight XY12 ABCD left
at 12:30:45:10 exactly
look at this. com is a suffix
born 12.05.1987 in Rome
on 2021-03-04 we left
ratio 3:4:5:6 holds
order 12345-6789-012 shipped
item no 99887766
Total 100 200 300 units
see chapter 7 at page 12. Next
"""


def test_sentences(spark):
    """Of sentences with private data nine in ten have a span, and of others at most one in twenty has."""
    some, none = WITH.strip().split("\n"), WITHOUT.strip().split("\n")
    rows = list(enumerate(some + none))
    got = {r["doc_id"]: r["spans"] for r in private.private_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [t for i, t in rows[: len(some)] if got[i]]
    wrong = [t for i, t in rows[len(some) :] if got[i]]
    assert len(some) >= 60 and len(found) >= 0.9 * len(some) and len(wrong) <= 0.05 * len(none)


CLASH = ["_base", "_found", "_added", "_likely", "_scored", "_row", "_secrets", "_toxicity", "kinds", "found", "every", "base", "runs", "hits", "items", "n_words", "_kept_hits", "_id", "_md5", "_kept", "_again"]


@pytest.fixture(scope="module")
def clashing(spark):
    fields = ", ".join(f"{c} string" for c in CLASH)
    rows = [(i, t, {"k": i}, len(t or ""), *CLASH) for i, t in [(1, "token = abcdef123456 and more"), (1, "token = abcdef123456 and more"), (2, None), (None, "mail ann@example.org"), (3, "")]]
    return spark.createDataFrame(rows, f"doc_id long, text string, more map<string,long>, n_chars long, {fields}")


@pytest.mark.parametrize("work", [lambda d: private.find(d), lambda d: secrets.find(d), secrets.redact, lambda d: decontaminate.remove(d, d.sparkSession.createDataFrame([(1, "and more")], "item_id long, text string"))], ids=["private", "secrets", "redact", "remove"])
def test_clashing_columns_and_maps(clashing, work):
    got = work(clashing)
    assert set(clashing.columns) <= set(got.columns) and got.count() == 5
    for r in got.collect():
        assert all(r[c] == c for c in CLASH) and r["more"] is not None


def test_clashing_columns_in_the_stages(clashing):
    """Each filtering stage of the pipeline keeps all columns of what it keeps, maps too."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(clashing.sparkSession, clashing, "/root/testdata/sf0.001")
        assert got.columns == clashing.columns, name
        for r in got.collect():
            assert all(r[c] == c for c in CLASH) and r["more"] is not None
    kept = corpus_pipeline.keep_one_of_each(clashing.sparkSession, clashing, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "mail ann@example.org"), (1, "token = abcdef123456 and more"), (2, None)]
