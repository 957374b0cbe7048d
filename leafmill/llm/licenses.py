"""Licence scans by sentence rules.

A text is cut into sentences; each is normalised (comment signs, case, punctuation and white space go). A table of
known licence sentences, held by the hash of their first words, gives the identifiers of those that stand in it, and
a small grammar those of references ("under the terms of version 2 of the ...") to any licence of a table of names.
The sequence of identifiers is then matched against ordered licence rules, longest rule first. A sentence that speaks
of a licence that neither table knows gives the identifier UNKNOWN.

Defined results: null and empty texts have no findings. Repeated rows each give their row, an empty table gives none.
Whole texts are read, of whatever length. Columns beside the id and the text are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches, table

# Sentences of public licence texts, or the part of one that does not vary. {v} is a version, {*} some
# words (a name), [x] a word that may be missing, {k} the kind of a GNU licence (lesser, library, affero) or none.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions",
    "mit-notice-next": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions",
    "as-is": "The software is provided as is, without warranty of any kind",
    "mit-liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability",
    "x11-liability": "In no event shall the X Consortium be liable for any claim, damages or other liability",
    "x11-names": "Except as contained in this notice, the name {*} shall not be used in advertising or otherwise to promote the sale, use or other dealings",
    "json-good": "The software shall be used for good, not evil",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the [above] copyright notice, this list of conditions",
    "bsd-binary": "Redistributions in binary form must reproduce the [above] copyright notice, this list of conditions",
    "bsd-names": "Neither the name of {*} nor the names of its contributors may be used to endorse or promote",
    "bsd-names-2": "The name of the author may not be used to endorse or promote products derived from this software",
    "bsd-names-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote",
    "bsd-ads": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-ads-us": "All advertising materials mentioning features or use of this software must display the following acknowledgment",
    "bsd-as-is": "This software is provided by {*} as is and any express or implied warranties",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-or-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "The software is provided as is and the author disclaims all warranties",
    "ntp-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose {*} is hereby granted",
    "postgres-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "apache-grant": "Licensed under the Apache License, Version {v} (the License)",
    "apache-foundation": "Licensed to {*} under one or more contributor license agreements",
    "apache-notice-file": "See the NOTICE file distributed with this work for additional information regarding copyright ownership",
    "apache-file": "You may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Software distributed under the License is distributed on an as is basis",
    "apache-limits": "See the License for the specific language governing permissions and limitations",
    "apache-1.1-product": "Products derived from this software may not be called {*} nor may {*} appear in their name",
    "gpl-grant": "You can redistribute it and/or modify it under the terms of the GNU {k} General Public License as published by the Free Software Foundation",
    "gpl-grant-version": "You can redistribute it and/or modify it under the terms of version {v} of the GNU {k} General Public License as published by the Free Software Foundation",
    "gpl-version": "either version {v} of the License",
    "gpl-only": "version {v} of the License",
    "gpl-later": "at your option any later version",
    "gpl-hope": "is distributed in the hope that it will be useful",
    "gpl-received": "You should have received a copy of the GNU {k} General Public License",
    "gpl-preamble": "The licenses for most software are designed to take away your freedom to share and change it",
    "gpl3-preamble": "The GNU {k} General Public License is a free, copyleft license for software and other kinds of works",
    "gfdl-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {v}",
    "gfdl-invariant": "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, you can obtain one at",
    "mpl1-grant": "The contents of this file are subject to the Mozilla Public License Version {v}",
    "mpl1-as-is": "Software distributed under the License is distributed on an as is basis, without warranty of any kind, either express or implied",
    "epl-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. {v}",
    "epl-grant-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v{v}",
    "epl-ref": "made available under the terms of the Eclipse Public License {v}",
    "cpl-grant": "This program and the accompanying materials are made available under the terms of the Common Public License v{v}",
    "cddl-grant": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "eupl-grant": "Licensed under the EUPL, Version {v} or as soon they will be approved by the European Commission",
    "boost-grant": "Distributed under the Boost Software License, Version {v}",
    "boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "zlib-as-is": "This software is provided as-is, without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "zlib-altered": "Altered source versions must be plainly marked as such",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc0-waive": "To the extent possible under law, {*} has waived all copyright and related or neighboring rights to",
    "public-domain": "released into the public domain",
    "public-domain-in": "is in the public domain",
    "public-domain-placed": "placed in the public domain",
    "wtfpl": "You just do what the fuck you want to",
    "beerware": "As long as you retain this notice you can do whatever you want with this stuff",
    "artistic-intent": "The intent of this document is to state the conditions under which a Package may be copied",
    "artistic2": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed",
    "perl-same": "You can redistribute it and/or modify it under the same terms as Perl itself",
    "ruby-same": "You can redistribute it and/or modify it under either the terms of the 2-clause BSDL",
    "ofl-grant": "This Font Software is licensed under the SIL Open Font License, Version {v}",
    "ofl-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software",
    "psf-grant": "This LICENSE AGREEMENT is between the Python Software Foundation",
    "ncsa-deal": "to deal with the Software without restriction, including without limitation the rights to use",
    "openssl-product": "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit",
    "php-grant": "This source file is subject to version {v} of the PHP license",
    "w3c-grant": "Permission to copy, modify, and distribute this work, with or without modification, for any purpose and without fee or royalty is hereby granted",
    "mspl-text": "This license governs use of the accompanying software",
    "curl-grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies of",
    "sspl-text": "If you make the functionality of the Program or a modified version available to third parties as a service",
    "bsl11-grant": "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work",
    "elastic-grant": "You may not provide the software to third parties as a hosted or managed service",
    "confidential": "This software is the confidential and proprietary information of",
    "no-reproduction": "may be reproduced, distributed, or transmitted in any form or by any means",
    "all-rights": "All rights reserved",
}

# Licences by the names that texts refer to them with; {v} is the version that is named with them.
NAMES = {
    "MIT": "mit|mit license|mit/x11|expat|expat license|mit-license|mit-licensed", "X11": "x11 license|mit x11 license", "ISC": "isc|isc license", "Apache-{v}": "apache|apache license|apache software license|apache public license|asl|apl|apache-2.0|al2",
    "BSD": "bsd|bsd license|bsd-style license|berkeley software distribution license", "BSD-2-Clause": "2-clause bsd license|two-clause bsd license|2-clause bsd|simplified bsd license|freebsd license|bsd 2-clause|bsd-2-clause|bsd 2 clause license|bsd 2-clause license|2 clause bsd license",
    "BSD-3-Clause": "3-clause bsd license|three-clause bsd license|3-clause bsd|new bsd license|modified bsd license|revised bsd license|bsd 3-clause|bsd-3-clause|bsd 3 clause license|bsd 3-clause license|3 clause bsd license",
    "BSD-4-Clause": "4-clause bsd license|original bsd license|bsd 4-clause|bsd-4-clause|bsd 4-clause license|4 clause bsd license", "0BSD": "0bsd|zero-clause bsd|zero-clause bsd license|bsd zero clause license",
    "GPL-{v}": "gnu general public license|gnu gpl|gpl|general public license|gplv{v}|gnu public license", "LGPL-{v}": "gnu lesser general public license|gnu library general public license|gnu lgpl|lgpl|lesser general public license|gnu lesser gpl|lgplv{v}",
    "AGPL-{v}": "gnu affero general public license|affero general public license|gnu agpl|agpl|agplv{v}", "GFDL-{v}": "gnu free documentation license|gfdl|gnu fdl",
    "MPL-{v}": "mozilla public license|mpl", "EPL-{v}": "eclipse public license|epl", "CPL-{v}": "common public license|cpl", "CDDL-{v}": "common development and distribution license|cddl", "EUPL-{v}": "european union public license|european union public licence|eupl",
    "BSL-{v}": "boost software license|boost license", "Zlib": "zlib license|zlib/libpng license|zlib libpng license|zlib", "Unlicense": "unlicense|the unlicense", "WTFPL": "wtfpl|do what the fuck you want to public license", "Artistic-{v}": "artistic license",
    "PSF-{v}": "python software foundation license|psf license|python license", "OFL-{v}": "sil open font license|open font license|ofl", "NCSA": "university of illinois/ncsa open source license|ncsa license|uiuc license|university of illinois ncsa open source license",
    "PostgreSQL": "postgresql license|postgresql licence", "OpenSSL": "openssl license", "PHP-{v}": "php license", "Ruby": "ruby license|ruby's license", "MS-PL": "microsoft public license|ms-pl", "MS-RL": "microsoft reciprocal license|ms-rl",
    "W3C": "w3c license|w3c software notice and license|w3c software license", "JSON": "json license", "Beerware": "beerware license|beer-ware license", "SSPL-{v}": "server side public license|sspl", "BUSL-{v}": "business source license|busl", "Elastic-{v}": "elastic license",
    "CC0-{v}": "cc0|cc-zero|creative commons zero|creative commons cc0|public domain under cc0|cc0 public domain dedication", "ODbL-{v}": "open database license|odbl", "OSL-{v}": "open software license|osl", "AFL-{v}": "academic free license|afl", "CeCILL-{v}": "cecill|cecill license",
}
#: Parts of the names of Creative Commons licences.
COMMONS = {"by": "BY", "attribution": "BY", "nc": "NC", "noncommercial": "NC", "non-commercial": "NC", "sa": "SA", "sharealike": "SA", "share-alike": "SA", "nd": "ND", "noderivatives": "ND", "noderivs": "ND"}

# Ordered rules; a name in brackets may be missing. {v} and {k} are what a sentence named; a name is what
# a reference gave.
RULES = [
    ("Apache-{v}", "[copyright] [all-rights] apache-grant apache-file [apache-copy] [apache-as-is] [apache-limits]"),
    ("Apache-{v}", "apache-foundation [apache-notice-file] apache-grant [apache-file] [apache-copy] [apache-as-is] [apache-limits]"),
    ("JSON", "[copyright] [all-rights] mit-grant mit-notice json-good as-is [mit-liability]"),
    ("X11", "[copyright] [all-rights] mit-grant mit-notice as-is [x11-liability] x11-names"),
    ("NCSA", "[copyright] [all-rights] mit-grant ncsa-deal bsd-source bsd-binary [as-is]"),
    ("MIT", "[copyright] [all-rights] mit-grant mit-notice as-is [mit-liability]"),
    ("MIT", "[copyright] [all-rights] mit-grant mit-notice-next as-is [mit-liability]"),
    ("BSD-4-Clause", "[copyright] [all-rights] bsd-grant bsd-source bsd-binary bsd-ads [bsd-names] [bsd-names-2] [bsd-as-is]"),
    ("BSD-4-Clause", "[copyright] [all-rights] bsd-grant bsd-source bsd-binary bsd-ads-us [bsd-names] [bsd-names-2] [bsd-as-is]"),
    ("BSD-3-Clause", "[copyright] [all-rights] bsd-grant bsd-source bsd-binary bsd-names [bsd-as-is]"),
    ("BSD-3-Clause", "[copyright] [all-rights] bsd-grant bsd-source bsd-binary bsd-names-2 [bsd-as-is]"),
    ("BSD-3-Clause", "[copyright] [all-rights] bsd-grant bsd-source bsd-binary bsd-names-3 [bsd-as-is]"),
    ("BSD-2-Clause", "[copyright] [all-rights] bsd-grant bsd-source bsd-binary [bsd-as-is]"),
    ("curl", "[copyright] [all-rights] curl-grant as-is"), ("ISC", "[copyright] [all-rights] isc-grant [isc-as-is]"), ("ISC", "[copyright] [all-rights] isc-or-grant [isc-as-is]"), ("0BSD", "[copyright] [all-rights] 0bsd-grant [isc-as-is]"),
    ("PostgreSQL", "[copyright] postgres-grant"), ("NTP", "[copyright] ntp-grant"),
    ("{k}GPL-{v}-or-later", "[copyright] [all-rights] gpl-grant gpl-version gpl-later [gpl-hope] [gpl-received]"),
    ("{k}GPL-{v}-only", "[copyright] [all-rights] gpl-grant gpl-version [gpl-hope] [gpl-received]"),
    ("{k}GPL-{v}-only", "[copyright] [all-rights] gpl-grant gpl-only [gpl-hope] [gpl-received]"),
    ("{k}GPL-{v}-or-later", "[copyright] [all-rights] gpl-grant-version gpl-later [gpl-hope] [gpl-received]"),
    ("{k}GPL-{v}-only", "[copyright] [all-rights] gpl-grant-version [gpl-hope] [gpl-received]"),
    ("{k}GPL", "[copyright] [all-rights] gpl-grant [gpl-hope] [gpl-received]"), ("{k}GPL", "gpl-received"), ("GPL", "gpl-preamble"), ("{k}GPL-3.0", "gpl3-preamble"),
    ("GFDL-{v}-or-later", "gfdl-grant gpl-later [gfdl-invariant]"), ("GFDL-{v}", "gfdl-grant [gfdl-invariant]"), ("MPL-{v}", "mpl-form [mpl-copy]"), ("MPL-{v}", "mpl1-grant [apache-file] [apache-copy] [mpl1-as-is]"),
    ("EPL-{v}", "epl-grant"), ("EPL-{v}", "epl-grant-v"), ("EPL-{v}", "epl-ref"), ("CPL-{v}", "cpl-grant"), ("CDDL", "cddl-grant"), ("EUPL-{v}", "eupl-grant"), ("BSL-{v}", "boost-grant"), ("BSL-1.0", "boost-text"),
    ("Zlib", "[zlib-as-is] zlib-grant [zlib-origin] [zlib-altered] [zlib-notice]"), ("Unlicense", "unlicense [unlicense-free]"), ("CC0-1.0", "cc0-waive"), ("WTFPL", "wtfpl"), ("Beerware", "beerware"),
    ("Artistic-1.0", "artistic-intent"), ("Artistic-2.0", "artistic2"), ("Perl", "perl-same"), ("Ruby", "ruby-same"), ("OFL-{v}", "ofl-grant [ofl-text]"), ("OFL", "ofl-text"), ("PSF-2.0", "psf-grant"), ("OpenSSL", "openssl-product"),
    ("PHP-{v}", "php-grant"), ("W3C", "w3c-grant"), ("MS-PL", "mspl-text"), ("SSPL-1.0", "sspl-text"), ("BUSL-1.1", "bsl11-grant"), ("Elastic-2.0", "elastic-grant"),
    ("PublicDomain", "public-domain"), ("PublicDomain", "public-domain-in"), ("PublicDomain", "public-domain-placed"), ("Proprietary", "[copyright] [all-rights] confidential"), ("Proprietary", "[copyright] all-rights no-reproduction"),
    ("Apache-{v}", "apache-grant"), ("MIT", "mit-grant"), ("{x}", "spdx"), ("{x}", "ref"), ("AllRightsReserved", "all-rights"), ("UNKNOWN", "UNKNOWN"),
]
_RULES = sorted(((name, [(x.strip("[]"), x[0] == "[") for x in rule.split()]) for name, rule in RULES), key=lambda r: -sum(not o for _, o in r[1]))
# A sentence ends at a stop before white space, or at an empty line.
_END = re.compile(r"(?<!dentifier)(?<!icense:)(?<!icence:)(?<![ .][vV])[.;:!?](?=[\"')\]]*(?:\s|$))(?<!icense:)(?<!icence:)|\n[ \t]*(?:[#*/;%-]+[ \t]*)?\n")
_COMMENT = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|dnl\b|rem\b)[ \t]*", re.I)
_SPEAKS = re.compile(r"\b(?:licensed|released|distributed|available) under\b.*\b(?:license|cc|copyleft)\b|\bsee license\b")
_VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*)\.?")
#: A rule's sentences may have so many others between them (addresses, names, headings).
GAP = 3
#: Words that {*} stands for, at most.
NAME_WORDS = 14
#: Words that lead to a licence's name, and those between.
LEADS = frozenset("under licensed license terms subject dedicated".split())
BETWEEN = frozenset("the terms of a an to and conditions by either same following version versions v gnu's under".split())
KINDS = {"lesser": "L", "library": "L", "affero": "A"}


def normalised(sentence: str) -> str:
    bare = _COMMENT.sub(" ", sentence).lower().replace("licence", "license")
    return " ".join(re.sub(r"[^\w.+\-{}*\[\]]+|(?<!\w)[.\-]+|[.\-]+(?!\w)|_+", " ", bare).split())


def _plain(sentence: str) -> list[str]:
    """Words of a normalised sentence of a text, without the signs that only the table has."""
    return normalised(re.sub(r"[{}*\[\]]", " ", _COMMENT.sub(" ", sentence))).split()


def _known() -> tuple[dict, dict, re.Pattern]:
    """Sentences by their first two words, names by their first word, and a pattern of words of which every sentence and
    every lead to a name has one: the longest of each sentence's fixed words."""
    first: dict[tuple[str, str], list[tuple[str, list[str]]]] = {}
    words = set(LEADS) | {"copyright", "spdx"}
    for key, text in SENTENCES.items():
        parts = normalised(text).replace("v{v}", "{v}").split()
        first.setdefault((parts[0], "" if parts[1][0] in "{[" else parts[1]), []).append((key, parts))
        words.add(max((w for w in parts if w[0] not in "{["), key=len))
    names: dict[str, list[tuple[list[str], str]]] = {}
    for licence, said in NAMES.items():
        for name in said.split("|"):
            parts = normalised(name).split()
            names.setdefault(parts[0] if "{v}" not in parts[0] else parts[0][: parts[0].index("{")], []).append((parts, licence))
    for found in first.values():
        found.sort(key=lambda x: -len(x[1]))
    for found in names.values():
        found.sort(key=lambda x: -len(x[0]))
    parts = {w.split("-")[0] for w in words if w != "license"} | {"licen"}
    return first, names, re.compile("|".join(sorted(map(re.escape, parts))))


_FIRST, _NAMES, _WORDS = _known()


def _take(parts: list[str], words: list[str], k: int, at: int, groups: dict[str, str]) -> int | None:
    """Where the words from `at` on that parts[k:] stand for end, or None; fills the groups."""
    while k < len(parts):
        p = parts[k]
        if p == "{*}":
            for end in range(at, min(at + NAME_WORDS, len(words) - 1) + 1):
                if words[end] == parts[k + 1] and (got := _take(parts, words, k + 1, end, groups)) is not None:
                    return got
            return None
        if p == "{k}":
            if at < len(words) and words[at] in KINDS:
                groups["k"] = KINDS[words[at]]
                at += 1
        elif p == "{v}":
            if at >= len(words) or not (m := _VERSION.fullmatch(words[at])):
                return None
            groups["v"] = m[1]
            at += 1
        elif p[0] == "[":
            at += at < len(words) and words[at] == p[1:-1]
        elif at < len(words) and words[at] == p:
            at += 1
        else:
            return None
        k += 1
    return at


def _reference(words: list[str], at: int) -> tuple[str, int] | None:
    """(licence, end) of the name that words lead to from `at` on, past words between, with its version before or after."""
    version = ""
    while at < len(words) and (words[at] in BETWEEN or (m := _VERSION.fullmatch(words[at]))):
        if any(words[at : at + len(parts)] == parts for parts, _ in _NAMES.get(words[at], [])):
            break
        version = version if words[at] in BETWEEN else m[1]
        at += 1
    if at >= len(words):
        return None
    later = only = False

    def tail(end: int, version: str) -> tuple[int, str]:
        nonlocal later, only
        k = end + (words[end : end + 1] == ["license"])
        k += words[k : k + 1] in (["version"], ["v"], ["ver"])
        if k < len(words) and (m := _VERSION.fullmatch(words[k].removesuffix("+"))):
            later |= words[k].endswith("+")
            end, version = k + 1, m[1]
        more = words[end : end + 5]
        later |= more[:2] in (["or", "later"], ["or", "newer"]) or more[:3] == ["or", "any", "later"] or more == ["or", "at", "your", "option", "any"] or more[:4] == ["or", "above", "at", "your"]
        only |= more[:1] == ["only"]
        return end, version

    if words[at] in ("creative", "cc") or words[at].startswith("cc-"):
        k = at + 1 + (words[at] == "creative" and words[at + 1 : at + 2] == ["commons"])
        kinds = [COMMONS[x] for x in words[at].split("-")[1:] if x in COMMONS]
        while k < len(words) and (more := [COMMONS[x] for x in ([words[k]] if words[k] in COMMONS else words[k].split("-")) if x in COMMONS]):
            kinds, k = kinds + more, k + 1
        if kinds:
            end, version = tail(k, version)
            if end < len(words) and words[end] in ("international", "unported", "generic"):
                end += 1
            return "-".join(["CC", *dict.fromkeys(kinds), *([version] if version else [])]), end
    stem = re.sub(r"v?[0-9].*", "", words[at])
    for parts, licence in _NAMES.get(words[at], []) + (_NAMES.get(stem + "v", []) if stem != words[at] else []):
        if parts[0].endswith("{v}"):
            if not (m := _VERSION.fullmatch(words[at].removeprefix(parts[0].removesuffix("v{v}")).removesuffix("+"))):
                continue
            later = words[at].endswith("+")
            end, found = tail(at + 1, m[1])
        elif words[at : at + len(parts)] == parts:
            end, found = tail(at + len(parts), version)
        else:
            continue
        if licence.startswith("Apache") and words[at] == "apache-2.0":
            found = "2.0"
        name = _named(licence, {"v": found})
        if "GPL" in licence or "GFDL" in licence:
            name += "-or-later" if later else "-only" if only else ""
        return name, end
    return None


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the sentences, without white space at either end."""
    at = 0
    for m in [*_END.finditer(text), None]:
        end = m.end() if m else len(text)
        piece = text[at:end]
        if body := piece.strip():
            start = at + piece.index(body)
            yield start, start + len(body)
        at = end


def in_sentence(words: list[str]) -> list[tuple[str, dict[str, str]]]:
    """Identifiers of the known sentences and references in the words of one sentence, in order; where one of them has
    begun, none that lies within it is told."""
    found: list[tuple[str, dict[str, str]]] = []
    at = 0
    while at < len(words):
        w, got, end = words[at], None, None
        for key, parts in _FIRST.get((w, words[at + 1] if at + 1 < len(words) else " "), []) + _FIRST.get((w, ""), []):
            groups: dict[str, str] = {}
            if (end := _take(parts, words, 0, at, groups)) is not None:
                if key == "all-rights" and end < len(words) or key == "gpl-only" and (at or end < len(words)):
                    continue
                got = key, groups
                break
        if got is None and w == "copyright" and (at == 0 or words[:at] == ["portions"]) and re.match(r"[0-9]{4}", "".join(words[at + 1 : at + 2]).removeprefix("c") or "".join(words[at + 2 : at + 3])):
            got, end = ("copyright", {}), at + 2
        if got is None and w == "spdx-license-identifier" and at + 1 < len(words):
            end = at + 2
            while end + 1 < len(words) and words[end] in ("or", "and", "with"):
                end += 2
            got = "spdx", {"x": "-".join(words[at + 1 : end]).upper()}
        if got is None and w in LEADS and (name := _reference(words, at + 1)):
            got, end = ("ref", {"x": name[0]}), name[1]
        if got is None and (w.endswith("-licensed") or words[at + 1 : at + 2] == ["licensed"]):
            bare = w.removesuffix("-licensed")
            if name := next((x for parts, x in _NAMES.get(bare, []) if parts == [bare]), None):
                got, end = ("ref", {"x": _named(name, {})}), at + 1 + (bare == w)
        if got:
            found.append(got)
            # The names inside a sentence are its own; its end may begin another.
            at = max(at + 1, end)
        else:
            at += 1
    return found


def identified(text: str) -> list[tuple[str, dict[str, str], int, int, int]]:
    """(identifier, named groups, number of the sentence, start, end) of the licence sentences in order."""
    found = []
    if not _WORDS.search(text.lower()):
        return found
    for n, (a, b) in enumerate(sentences(text)):
        if not _WORDS.search(text[a:b].lower()):
            continue
        words = _plain(text[a:b])
        own = in_sentence(words)
        found += [(k, g, n, a, b) for k, g in own]
        if not own and _SPEAKS.search(" ".join(words)):
            found.append(("UNKNOWN", {}, n, a, b))
    return found


def _matched(ids: list, at: int, rule: list[tuple[str, bool]]) -> list[int] | None:
    """Places of the identifiers that a rule takes from `at` on, or None."""
    taken: list[int] = []
    i = at
    for name, optional in rule:
        j = i
        while j < len(ids) and ids[j][0] != name and taken and ids[j][2] - ids[taken[-1]][2] <= GAP:
            j += 1
        if j < len(ids) and ids[j][0] == name and (not taken or ids[j][2] - ids[taken[-1]][2] <= GAP):
            taken.append(j)
            i = j + 1
        elif not optional:
            return None
    return taken


def _named(name: str, groups: dict[str, str]) -> str:
    version = groups.get("v", "")
    if version and "." not in version:
        version += ".0"
    return name.format(k=groups.get("k", ""), v=version, x=groups.get("x", "")).replace("--", "-").rstrip("-")


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """(licence, start, end, identifiers) of all findings in order."""
    ids = identified(text) if text else []
    found, at, used = [], 0, set()
    while at < len(ids):
        if at in used:
            at += 1
            continue
        for name, rule in _RULES:
            taken = _matched(ids, at, rule)
            if taken and taken[0] == at and not used & set(taken):
                groups: dict[str, str] = {}
                for k in taken:
                    groups |= {g: v for g, v in ids[k][1].items() if v}
                used |= set(taken)
                found.append((_named(name, groups), ids[at][3], max(ids[k][4] for k in taken), " ".join(ids[k][0] for k in taken)))
                break
        at += 1
    return found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, findings (array of license, start, end in code points, sentences), for each row."""
    small_batches(docs.sparkSession)
    names = ("license", "start", "end", "sentences")
    kind_of = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(names, x)) for x in scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind_of)], names=["id", "findings"])

    kind = docs.schema[id_col].dataType.simpleString()
    said = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return said.mapInArrow(rows, f"id {kind}, findings array<struct<license:string,start:bigint,end:bigint,sentences:string>>").withColumnRenamed("id", id_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_findings"),
        F.array_join(F.array_sort(F.array_distinct("findings.license")), ",").alias("licenses"),
        F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",").alias("spans"))
