"""Whole licence texts, notices and base places against plain scans."""

import random
import re

import pytest

from graphloom.llm import licences

SCAN = licences.scanner()


@pytest.mark.parametrize("label", sorted(licences.TEMPLATES))
def test_every_template_is_found_whole_and_with_gaps(label):
    rnd = random.Random(label)
    for text in licences.TEMPLATES[label]:
        found = SCAN.scan("Some words before. " + text.upper() + "\n\nand some after")
        assert label in found["labels"].split(",") and found["score"] == 1.0
        words = text.split()
        if len(words) > 30:
            # A word changed in every twenty: nineteen twentieths of the text are covered.
            for k in range(rnd.randrange(20), len(words), 20):
                words[k] = "changed"
            assert label in SCAN.scan(" ".join(words))["labels"].split(",")


@pytest.mark.parametrize("text, label", [("MIT License\n\nCopyright (c) 2020 Somebody", "mit"), ("BSD 3-Clause License", "bsd-3-clause"), ("// SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0")])
def test_usual_notices(text, label):
    assert SCAN.scan(text)["labels"] == label


@pytest.mark.parametrize("text", ["We mean it under the license.", "You may use, copy and modify it.", "SPDX-License-Identifier: none", "", None, "software " * 500])
def test_no_label_without_a_notice(text):
    found = SCAN.scan(text)
    assert found["labels"] == "" and found["score"] < licences.COVER


def test_base_places_equal_a_plain_scan():
    rnd = random.Random(6)
    parts = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "CC-BY", "General Public License,", "\u00e9"]
    for _ in range(300):
        text = " ".join(rnd.choice(parts) for _ in range(rnd.randrange(60)))
        words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in text)) if w]
        want = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        got = SCAN.scan(text)
        assert (got["n_words"], got["n_base"]) == (len(words), len(want))
        assert got["base_labels"] == ",".join(sorted({label for _, label in want}))
        assert (got["first_word"], got["last_word"]) == (min((i for i, _ in want), default=None), max((i for i, _ in want), default=None))
