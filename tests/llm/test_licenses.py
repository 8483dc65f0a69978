import re

import pytest

from reportmill.llm import licenses as L
from tests.llm.odd import ROWS, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    words = WORD.findall(low)
    hits = [(i, v) for p, v in L.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in hits}))


TEXTS = [
    "MIT License mit-license, MIT\nLICENSE.", "the cc by, cc-by 4.0 ccby", "x GNU General Public License y gnu general\tpublic  license",
    "Apache License x apache license", "émit license mit licensé mit license", "commit license", "Licensed under the Apache License, Version 2.0.",
]


def test_base_places_as_brute_force(spark, sf):
    rows = [(i, t, "", "", 1) for i, t in enumerate(TEXTS)] + ROWS
    rows += [(1000 + r.doc_id, r.text, "", "", 1) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = L.scan_licenses(documents(spark, rows, True)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == sorted(str((r[0], *brute(r[1]))) for r in rows)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


@pytest.mark.parametrize(
    "text,postfix,labels,free",
    [
        ("mit", "mit", {"mit"}, True),
        ("gpl-2.0-only with classpath-exception-2.0 or mit", "gpl-2.0-only classpath-exception-2.0 with mit or", {"gpl", "mit"}, True),
        ("mit or apache-2.0 and gpl-3.0+", "mit apache-2.0 gpl-3.0+ and or", {"mit", "apache", "gpl"}, True),
        ("(mit or apache-2.0) and gpl-3.0+ */", "mit apache-2.0 or gpl-3.0+ and", {"mit", "apache", "gpl"}, False),
        ("(lgpl-2.1 and (mit or cc-by-sa-4.0))", "lgpl-2.1 mit cc-by-sa-4.0 or and", {"lgpl", "mit", "cc-by-sa"}, False),
        ("mit and", "mit", {"mit"}, True),
        ("mit or (gpl-2.0", "mit", {"mit"}, True),
        ("mit) or gpl", "mit", {"mit"}, True),
        ("mit this file is", "mit", {"mit"}, True),
    ],
)
def test_expressions(text, postfix, labels, free):
    got = L.to_postfix(text)
    assert " ".join(got) == postfix and L.evaluate(got) == (labels, free)


def test_identifiers_and_exceptions():
    assert len(L.identifiers()) > 400
    for name, label in {"gpl-2.0-or-later": "gpl", "lgpl-2.1+": "lgpl", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-4.0": "cc-by", "bsd-3-clause": "bsd", "bsd-9-odd": "bsd", "mit-0": "mit", "x-own": "x-own"}.items():
        assert L.family(name) == label
    assert L.evaluate(L.to_postfix("apache-2.0 with llvm-exception")) == ({"apache"}, True)
    assert L.evaluate(L.to_postfix("apache-2.0 with own-terms")) == ({"apache"}, False)


def test_phrases_joined_by_words(spark):
    rows = [(1, "Under the MIT License or the GNU General Public License, or Apache License and GNU Affero General Public License.", "", "", 1), (2, "MIT license, or MIT License OR Apache License with BSD license x cc by sa and cc by", "", "", 1)]
    a, b = sorted(L.scan_licenses(documents(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert (a.expressions, a.permissive) == ("gpl apache agpl and or", False)
    assert (b.expressions, b.permissive) == ("mit mit or apache bsd with or; cc-by-sa cc-by and", False)


def test_very_long_texts_take_time_in_proportion():
    """Ten megabytes of nothing but places, and as many without any."""
    import time

    found_by = L.automaton((("mit license", "mit", True), ("cc by", "cc-by", True)))
    began = time.process_time()
    got = L.scan_text("mit license cc by " * 550_000, found_by)
    assert got[:4] == (2_200_000, 1_100_000, 0, 2_199_998)
    assert L.scan_text("commit licensee " * 650_000, found_by)[:2] == (1_300_000, 0)
    assert time.process_time() - began < 30


@pytest.mark.parametrize("text", ["", "and mit", "()", ") mit", "( or )", "* x"])
def test_no_expression(text):
    assert L.to_postfix(text) == []


def test_tags(spark):
    rows = [(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\n// all rights reserved", "", "", 1), (2, "SPDX-License-Identifier:\nfoo", "", "", 1)]
    a, b = sorted(L.scan_licenses(documents(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert (a.labels, a.base_labels, a.expressions, a.permissive) == ("bsd,gpl,mit,reserved", "", "mit gpl-2.0-only or bsd-3-clause and", True) and a.score == 1 - 2**-3
    assert (b.labels, b.expressions, b.permissive, b.score) == ("", "", None, 0.0)
    assert L.scan_licenses(documents(spark, [])).count() == 0
