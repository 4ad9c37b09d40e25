import re

import pytest
from edges import LONG, awkward_docs, no_docs
from grainmill.llm.licenses import BASE_PHRASES, UNKNOWN, parse, scan, scan_licenses


def brute(text):
    """Words and places of the base phrases by sliding over the words."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(parts)] == parts]
    return len(words), sorted(found)


@pytest.mark.parametrize(
    "text",
    [
        "Released under the MIT License.", "under the mit license under the mit license", "CC-BY-NC 4.0, cc by nc",
        "Apache License, Version 2.0", "Apache License Version 20", "xunder the mit license", "UNDER THE MİT LICENSE",
        "cc by\nnc", "", None, "é cc by nc é", "under the mit licenses",
    ],
)
def test_base_findings_equal_brute_force(text):
    words, base, labels, score = scan(text)
    assert (words, sorted(base)) == brute(text)
    assert {label for _, label in base} <= labels and 0 <= score <= 1


def test_expressions():
    assert parse("MIT").labels == {"mit"}
    assert parse("MIT OR GPL-3.0-only").freedom == parse("MIT").freedom
    assert parse("MIT AND GPL-3.0-only").freedom == parse("GPL-2.0").freedom
    # and binds closer than or, with closer than and
    assert parse("MIT OR GPL-2.0 AND AGPL-3.0").freedom == parse("MIT").freedom
    assert parse("(MIT OR GPL-2.0) AND AGPL-3.0").freedom == parse("AGPL-3.0").freedom
    assert parse("GPL-2.0 WITH Classpath-exception-2.0").freedom > parse("GPL-2.0").freedom
    assert parse("CC-BY-NC-4.0").labels == {"cc-by-nc"} and parse("CC-BY-4.0").labels == {"cc-by"}
    for wrong in ["", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT GPL-2.0", "NoSuchLicence", "MIT WITH (GPL-2.0)", "()"]:
        assert parse(wrong) is None


def test_tags_add_labels():
    assert "gpl" in scan("/* SPDX-License-Identifier: GPL-2.0-only OR MIT */")[2]
    assert scan("é SPDX-License-Identifier: MIT\nmore text")[2] == {"mit"}
    assert scan("License: to kill")[2] == frozenset() and scan("nothing")[3] == UNKNOWN


@pytest.mark.parametrize(
    ("line", "labels"),
    [
        ("License: MIT, see the LICENSE file", {"mit"}), ("License: MIT License", {"mit"}), ("License: MIT.", {"mit"}),
        ("License: Apache License 2.0", {"apache-2"}), ("SPDX-License-Identifier: MIT OR LicenseRef-X", {"mit"}),
        ("SPDX-License-Identifier: LicenseRef-X AND (LicenseRef-Y OR GPL-2.0-only) -->", {"gpl"}),
        ("License: MIT OR", {"mit"}), ("License: MIT) or so", {"mit"}), ("License: (MIT OR GPL-2.0", set()),
        ("License: MIT WITH GPL-2.0", {"mit"}), ("License: MIT WITH (GPL-2.0)", {"mit"}), ("License: ", set()),
        ("License: LicenseRef-X OR LicenseRef-Y", set()), ("License: LicenseRef-X WITH Y AND MIT", {"mit"}),
        ("License: see MIT", set()), ("License: MIT OR GPL-2.0 and more words", {"mit", "gpl"}),
        ("License: GPL-2.0 WITH Classpath-exception-2.0 for this file", {"gpl"}),
    ],
)
def test_the_leading_expression_behind_a_tag_counts(line, labels):
    assert scan(f"é {line}\nGPL-3.0")[2] == labels


def test_long_lines_take_one_pass():
    assert scan("License: " + "MIT OR X AND " * 20000 + "(")[2] == {"mit"}


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    rows = scan_licenses(docs).collect()
    assert len(rows) == docs.count()
    assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert [r["n_words"] for r in rows if r["doc_id"] == 5] == [len(LONG.split())]
    assert scan_licenses(no_docs(spark)).count() == 0
