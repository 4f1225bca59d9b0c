import hashlib

import pytest

from tablemill.llm import licences
from tests.llm.awkward import ROWS, as_rows, clashing, documents

MIT = licences.KNOWN["MIT"][0]


@pytest.mark.parametrize(
    "text",
    [
        MIT,
        MIT.upper(),
        MIT.replace("\n", "\r\n  "),
        MIT.replace('"', "''").replace(",", " ;"),
        "Copyright (c) 2020 Some Body\n" + MIT + "\n\nAll rights reserved.\n",
        "# Copyright 1999-2004 A, B\n * (C) 2001 C\n" + MIT,
        MIT.replace("License", "Licence").replace("sublicense", "SubLicence"),
    ],
)
def test_texts_that_count_as_equal(text):
    assert licences.digest(text.encode()) == licences.digest(MIT.encode())


@pytest.mark.parametrize("text", [MIT + " Except on Sundays.", MIT.replace("free of charge", "for a fee"), "", "copyright law is long"])
def test_texts_that_do_not(text):
    assert licences.digest(text.encode()) != licences.digest(MIT.encode())


def test_documents(spark):
    rows = [
        (1, MIT.lower(), "", "", 0),
        (2, f"some prose\nReleased under the MIT Licence\nLicensed under CC BY-NC 4.0.\nreleased under the MIT license.", "", "", 0),
        (3, "Released under the MIT License.", "", "", 0),
        (3, "Released under the MIT License.", "", "", 0),
        (None, "it was released under the MIT License.", "", "", 0),
    ]
    found = licences.licences(clashing(documents(spark, rows)))
    assert as_rows(found, "doc_id", "licence", "notices") == sorted(
        [(1, "MIT", ""), (2, None, "CC-BY-NC-4.0,MIT"), (3, "MIT", "MIT"), (3, "MIT", "MIT"), (None, None, "")], key=repr
    )


def test_awkward_rows(spark):
    found = licences.licences(documents(spark)).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(found) == len(ROWS) and all(r.licence is None and r.notices == "" for r in found)
    assert {r.digest for r in found if r.doc_id in (3, 4, 5)} == {nothing}
    assert licences.licences(documents(spark, [])).count() == 0
    assert licences.licences(documents(spark), known={}).count() == len(ROWS)


def test_entire_texts_are_known(spark):
    whole = {p.stem: p.read_text() for p in licences.FOLDER.glob("*.txt")}
    assert {"Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-3-Clause"} <= set(whole)
    texts = list(whole.items())
    apache, gpl = whole["Apache-2.0"], whole["GPL-3.0"]
    texts += [("Apache-2.0", apache.split("APPENDIX:")[0]), ("Apache-2.0", apache[apache.index("TERMS AND") :].replace("[yyyy] [name of copyright owner]", "2019 Jane Doe"))]
    texts += [("GPL-3.0", gpl[gpl.index("Preamble") :].replace("http:", "https:")), ("GPL-3.0", gpl.replace("\n", "\r\n"))]
    body = MIT.removeprefix("MIT License")
    texts += [("MIT", body), ("MIT", "The MIT License (MIT)\n\nCopyright Jane Doe 2019\n" + body), ("ISC", licences.KNOWN["ISC"][0].removeprefix("ISC License"))]
    texts += [("MIT", MIT.replace('"Software"', "“Software”").replace(",", "‚").replace('"AS IS"', "«AS IS»")), ("MIT", "﻿© Jane Doe\n" + MIT.replace("-", "–"))]
    bsd = whole["BSD-3-Clause"]
    texts += [("BSD-3-Clause", "Copyright Jane Doe, 2001-present <jane@example.com>\n" + bsd[bsd.index("Redist") :].replace("1. ", "* ").replace("2. ", "• ").replace("3. ", "- "))]
    texts += [(None, apache + "\nExcept on Sundays."), (None, gpl[: len(gpl) // 2])]
    rows = [(i, text, "", "", 0) for i, (_, text) in enumerate(texts)]
    found = {r.doc_id: r.licence for r in licences.licences(documents(spark, rows)).collect()}
    assert [found[i] for i in range(len(texts))] == [name for name, _ in texts]


def test_words_of_a_text_are_no_copyright_line():
    for line in ("copyright notice of 2019", "copyright treaty adopted on 20 December 1996", "copyright holder in 2020, whoever that is"):
        assert licences.matching(line.encode()) != ""
