"""License scan by ordered signature rules.

A rule is a pattern with a label, a keyword and a priority. A rule's pattern runs only where its
keyword occurs. Of overlapping detections, one that lies inside another of equal or higher priority is
suppressed. Rules come from hand-written signatures of license texts, notices and addresses, and from
families of names in a few sentence frames.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame

from .common import alnum_words, map_rows

#: The base: phrases of consecutive words and their labels.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))

#: label, names as they are written (patterns), identifiers.
FAMILIES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("apache", (r"apache license", r"apache software license", r"apache public license"), ("Apache-1.0", "Apache-1.1", "Apache-2.0")),
    ("mit", (r"mit license", r"x11 license", r"expat license"), ("MIT", "MIT-0", "X11")),
    ("bsd", (r"bsd license", r"(?:new|modified|revised|simplified) bsd license", r"(?:2|3|4)-clause bsd license", r"bsd (?:2|3|4)-clause license"), ("BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD")),
    ("gpl", (r"(?:gnu )?general public license", r"gnu gpl", r"gplv?[23]"), ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later")),
    ("lgpl", (r"(?:gnu )?(?:lesser|library) general public license", r"gnu lgpl"), ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    ("agpl", (r"(?:gnu )?affero general public license", r"gnu agpl"), ("AGPL-3.0-only", "AGPL-3.0-or-later")),
    ("gfdl", (r"gnu free documentation license",), ("GFDL-1.2-only", "GFDL-1.3-or-later")),
    ("mpl", (r"mozilla public license",), ("MPL-1.1", "MPL-2.0")),
    ("epl", (r"eclipse public license",), ("EPL-1.0", "EPL-2.0")),
    ("eupl", (r"european union public licen[cs]e",), ("EUPL-1.1", "EUPL-1.2")),
    ("cddl", (r"common development and distribution license",), ("CDDL-1.0", "CDDL-1.1")),
    ("cpl", (r"common public license",), ("CPL-1.0",)),
    ("artistic", (r"artistic license",), ("Artistic-1.0", "Artistic-2.0")),
    ("isc", (r"isc license",), ("ISC",)),
    ("zlib", (r"zlib(?:/libpng)? license",), ("Zlib",)),
    ("boost", (r"boost software license",), ("BSL-1.0",)),
    ("python", (r"python software foundation license",), ("PSF-2.0", "Python-2.0")),
    ("ofl", (r"sil open font license", r"open font license"), ("OFL-1.0", "OFL-1.1")),
    ("ms-pl", (r"microsoft public license", r"microsoft reciprocal license"), ("MS-PL", "MS-RL")),
    ("wtfpl", (r"do what the f\w* you want to public license",), ("WTFPL",)),
    ("unlicense", (r"unlicense",), ("Unlicense",)),
    ("postgresql", (r"postgresql license",), ("PostgreSQL",)),
    ("openssl", (r"openssl license",), ("OpenSSL",)),
    ("odbl", (r"open database license",), ("ODbL-1.0",)),
    ("cc-by", (r"creative commons attribution(?: license)?(?! *-? *(?:non|share|no))",), ("CC-BY-3.0", "CC-BY-4.0")),
    ("cc-by-sa", (r"creative commons attribution *-? *share-?alike(?: license)?",), ("CC-BY-SA-3.0", "CC-BY-SA-4.0")),
    ("cc-by-nc", (r"creative commons attribution *-? *non-?commercial(?: license)?",), ("CC-BY-NC-3.0", "CC-BY-NC-4.0")),
    ("cc-by-nd", (r"creative commons attribution *-? *no-?deriv(?:ative|ativ)e?s?(?: license)?",), ("CC-BY-ND-4.0",)),
    ("cc0", (r"creative commons zero", r"cc0(?: license)?"), ("CC0-1.0",)),
    ("proprietary", (r"proprietary license", r"commercial license", r"end[- ]user license agreement"), ("LicenseRef-Proprietary",)),
)

#: Sentences around a name, strongest first, with their weight in the score.
TEMPLATES: tuple[tuple[str, float], ...] = (
    (r"(?:licen[cs]ed|released|distributed|published|available|provided) (?:under|subject to) (?:the terms of )?(?:the |an? )?{name}(?:,? version \d[\d.]*| v?\d[\d.]*)?", 0.95),
    (r"under (?:the terms of )?(?:the |an? )?{name}(?:,? version \d[\d.]*| v?\d[\d.]*)?", 0.9),
    (r"(?:copying|copy of|text of|see) the {name}(?:,? version \d[\d.]*)?", 0.8),
    (r"{name},? (?:version |v)\d[\d.]*", 0.8),
    (r"{name}", 0.6),
)

#: Signatures: label, keyword, pattern, weight. White space in a text is one space and letters are lower case.
SINGLE: tuple[tuple[str, str, str, float], ...] = (
    # permissive texts
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 0.95),
    ("mit", "without restriction", r"deal in the software without restriction", 0.9),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.95),
    ("mit", "authors or copyright holders", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability", 0.8),
    ("x11", "x consortium", r"except as contained in this notice, the names? of (?:the )?x consortium shall not be used", 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification, are permitted", 0.95),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd", "endorse or promote", r"neither the names? of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote", 0.95),
    ("bsd", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("bsd", "copyright holders and contributors", r"this software is provided by the copyright holders and contributors [\"'“]?as is", 0.9),
    ("bsd", "bsd-style", r"bsd-style (?:open source )?licen[cs]e", 0.8),
    ("bsd", "freebsd", r"freebsd (?:documentation )?license", 0.8),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("isc", "author disclaims", r"the author disclaims all warranties with regard to this software", 0.85),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty", 0.9),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 0.95),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 0.95),
    ("boost", "boost", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", 0.95),
    ("boost", "boost.org", r"boost\.org/license_1_0\.txt", 0.95),
    ("postgresql", "postgres", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement", 0.95),
    ("python", "python software foundation", r"psf is making python available to licensee on an [\"'“]?as is", 0.95),
    ("python", "beopen", r"beopen python open source license agreement", 0.95),
    ("ncsa", "ncsa", r"university of illinois/ncsa open source license", 0.95),
    ("unicode", "unicode", r"unicode,? inc\.? license agreement", 0.9),
    ("curl", "curl", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice .{0,200}?curl", 0.9),
    ("beerware", "beer", r"(?:the )?beer-?ware license", 0.95),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 0.95),
    ("wtfpl", "wtfpl", r"wtfpl", 0.9),
    ("wtfpl", "what the f", r"you just do what the f\w* you want to", 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.98),
    ("unlicense", "unlicense.org", r"unlicense\.org", 0.95),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 0.95),
    ("openssl", "eric young", r"this product includes cryptographic software written by eric young", 0.95),
    ("php", "php license", r"php license,? version \d", 0.95),
    ("php", "php.net", r"php\.net/license/\d", 0.95),
    ("zope", "zope public", r"zope public license(?:,? \(?zpl\)?)?", 0.9),
    ("w3c", "w3c", r"w3c(?:\(r\)|®)? (?:software|document) (?:notice and )?licen[cs]e", 0.95),
    ("afl", "academic free", r"academic free license(?:,? version \d[\d.]*)?", 0.95),
    ("ecl", "educational community", r"educational community license(?:,? version \d[\d.]*)?", 0.95),
    ("upl", "universal permissive", r"universal permissive license", 0.95),
    ("ms-pl", "ms-pl", r"ms-pl", 0.85),
    ("ms-rl", "ms-rl", r"ms-rl", 0.85),
    # apache
    ("apache", "apache.org", r"apache\.org/licenses/license-\d", 0.95),
    ("apache", "apache", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", 0.95),
    ("apache", "except in compliance", r"you may not use this file except in compliance with the license", 0.9),
    ("apache", "contributor hereby grants", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable", 0.9),
    ("apache", "apache 2", r"apache[- ]2(?:\.0)?", 0.7),
    ("apache", "asl 2", r"asl[- ]2(?:\.0)?", 0.7),
    # copyleft texts
    ("gpl", "redistribute it and/or modify", r"redistribute it and/or modify it under the terms of the gnu general public license", 0.98),
    ("gpl", "free software foundation", r"general public license as published by the free software foundation", 0.95),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses/(?:old-licenses/)?|copyleft/)gpl", 0.9),
    ("gpl", "gpl-", r"gpl-[123](?:\.0)?(?:\+|-only|-or-later)?", 0.85),
    ("gpl", "gplv", r"gplv[123](?:\+)?", 0.85),
    ("gpl", "copy of the gnu", r"you should have received a copy of the gnu general public license", 0.95),
    ("gpl", "classpath exception", r"(?:gnu )?classpath exception", 0.9),
    ("lgpl", "gnu lesser", r"redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license", 0.98),
    ("lgpl", "gnu.org", r"gnu\.org/(?:licenses/(?:old-licenses/)?|copyleft/)(?:lgpl|lesser)", 0.9),
    ("lgpl", "lgpl", r"lgplv?[- ]?[23](?:\.[01])?(?:\+|-only|-or-later)?", 0.85),
    ("lgpl", "lesser general public", r"you should have received a copy of the gnu lesser general public license", 0.95),
    ("agpl", "affero", r"redistribute it and/or modify it under the terms of the gnu affero general public license", 0.98),
    ("agpl", "gnu.org", r"gnu\.org/licenses/agpl", 0.9),
    ("agpl", "agpl", r"agplv?[- ]?3(?:\.0)?(?:\+|-only|-or-later)?", 0.85),
    ("gfdl", "free documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", 0.98),
    ("gfdl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/fdl", 0.9),
    ("gfdl", "invariant sections", r"with no invariant sections, no front-cover texts,? and no back-cover texts", 0.95),
    ("mpl", "mozilla public", r"this source code form is subject to the terms of the mozilla public license", 0.98),
    ("mpl", "mozilla.org", r"mozilla\.org/mpl", 0.95),
    ("mpl", "incompatible with secondary", r"incompatible with secondary licenses", 0.9),
    ("mpl", "mpl", r"mpl[- ]?[12]\.[01]", 0.85),
    ("epl", "eclipse.org", r"eclipse\.org/legal/epl", 0.95),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 0.98),
    ("edl", "eclipse", r"eclipse distribution license", 0.9),
    ("eupl", "eupl", r"eupl(?:,? v?\.? ?\d[\d.]*)?", 0.85),
    ("eupl", "europa.eu", r"joinup\.ec\.europa\.eu/(?:collection/eupl|software/page/eupl)", 0.95),
    ("cddl", "cddl", r"cddl(?:[- ]1\.[01])?", 0.85),
    ("osl", "open software license", r"open software license(?:,? (?:version |v\. ?)?\d[\d.]*)?", 0.95),
    ("qpl", "q public license", r"q public license(?:,? version \d[\d.]*)?", 0.95),
    ("ipl", "ibm public license", r"ibm public license(?:,? version \d[\d.]*)?", 0.95),
    ("cecill", "cecill", r"cecill(?:-[bc])?(?: (?:free software )?license(?: agreement)?)?", 0.85),
    ("sleepycat", "sleepycat", r"(?:the )?sleepycat license", 0.95),
    ("artistic", "artistic", r"the intent of this document is to state the conditions under which a package may be copied", 0.95),
    ("artistic", "perl itself", r"(?:under )?the same terms as perl(?: \d)? itself", 0.9),
    ("ruby", "ruby", r"(?:the )?ruby licen[cs]e|(?:under )?the same terms as ruby", 0.85),
    ("lppl", "latex project", r"latex project public license(?:,? version \d[\d.a-z]*)?", 0.95),
    ("ofl", "scripts.sil.org", r"scripts\.sil\.org/ofl", 0.95),
    ("ofl", "reserved font name", r"with reserved font names?", 0.9),
    ("vim", "vim license", r"(?:the )?vim license", 0.85),
    # content
    ("cc-by", "creativecommons.org", r"creativecommons\.org/licenses/by/\d", 0.95),
    ("cc-by-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-sa/\d", 0.95),
    ("cc-by-nc", "creativecommons.org", r"creativecommons\.org/licenses/by-nc(?:-sa)?/\d", 0.95),
    ("cc-by-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-(?:nc-)?nd/\d", 0.95),
    ("cc0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/\d", 0.95),
    ("public-domain", "creativecommons.org", r"creativecommons\.org/publicdomain/mark/\d", 0.95),
    ("cc-by-sa", "cc by-sa", r"cc by-sa(?: \d\.\d)?", 0.9),
    ("cc-by-sa", "cc-by-sa", r"cc-by-sa(?:-\d\.\d)?", 0.9),
    ("cc-by-nc", "cc by-nc", r"cc by-nc(?:-(?:sa|nd))?(?: \d\.\d)?", 0.9),
    ("cc-by-nc", "cc-by-nc", r"cc-by-nc(?:-(?:sa|nd))?(?:-\d\.\d)?", 0.9),
    ("cc-by-nd", "cc by-nd", r"cc by-nd(?: \d\.\d)?", 0.9),
    ("cc-by-nd", "cc-by-nd", r"cc-by-nd(?:-\d\.\d)?", 0.9),
    ("cc0", "cc0", r"to the extent possible under law, .{1,120}? (?:has|have) waived all copyright", 0.95),
    ("cc-by-sa", "wikipedia", r"text is available under the creative commons attribution[- ]share-?alike license", 0.98),
    ("odbl", "odbl", r"odbl(?:[- ]1\.0)?", 0.85),
    ("odbl", "openstreetmap", r"© openstreetmap contributors", 0.8),
    ("odbl", "opendatacommons", r"opendatacommons\.org/licenses/(?:odbl|dbcl)", 0.95),
    ("odc-by", "opendatacommons", r"opendatacommons\.org/licenses/by", 0.95),
    ("pddl", "opendatacommons", r"opendatacommons\.org/licenses/pddl", 0.95),
    ("ogl", "open government", r"open government licen[cs]e(?:,? v?(?:ersion )?\d[\d.]*)?", 0.95),
    ("ogl", "nationalarchives", r"nationalarchives\.gov\.uk/doc/open-government-licence", 0.95),
    ("etalab", "licence ouverte", r"licence ouverte(?: */ *open licence)?", 0.9),
    ("dl-de", "datenlizenz", r"datenlizenz deutschland", 0.9),
    ("free-art", "free art license", r"free art license", 0.9),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.85),
    ("public-domain", "public domain", r"public domain", 0.5),
    ("public-domain", "no known copyright", r"no known copyright restrictions", 0.8),
    ("public-domain", "domaine public", r"domaine public", 0.5),
    ("public-domain", "gemeinfrei", r"gemeinfrei", 0.5),
    ("public-domain", "dominio p", r"dominio p[uú]blico", 0.5),
    # reserved and proprietary
    ("proprietary", "confidential", r"(?:this (?:software|document) is )?proprietary and confidential", 0.9),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|document|software)(?:, via any medium)? is strictly prohibited", 0.95),
    ("proprietary", "trade secret", r"contains (?:confidential information and )?trade secrets? of", 0.85),
    ("proprietary", "without the prior", r"may (?:not )?be reproduced .{0,120}?without the prior (?:written )?permission", 0.85),
    ("proprietary", "personal, non-commercial", r"for (?:your )?personal, non-commercial use only", 0.8),
    ("proprietary", "not be redistributed", r"(?:must|may|shall) not be redistributed", 0.8),
    ("reserved", "alle rechte vorbehalten", r"alle rechte vorbehalten", 0.6),
    ("reserved", "tous droits", r"tous droits r[ée]serv[ée]s", 0.6),
    ("reserved", "todos los derechos", r"todos los derechos reservados", 0.6),
    ("reserved", "todos os direitos", r"todos os direitos reservados", 0.6),
    ("reserved", "tutti i diritti", r"tutti i diritti (?:sono )?riservati", 0.6),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d", 0.5),
    ("copyright", "©", r"© ?(?:19|20)\d\d", 0.5),
    # source-available
    ("sspl", "server side public", r"server side public license(?:,? (?:version |v)\d)?", 0.95),
    ("busl", "business source", r"business source license(?: \d[\d.]*)?", 0.95),
    ("elastic", "elastic license", r"elastic license(?: \d[\d.]*)?", 0.9),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?", 0.9),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license", 0.95),
    # addresses of texts
    ("mit", "opensource.org", r"opensource\.org/licenses?/mit", 0.9),
    ("bsd", "opensource.org", r"opensource\.org/licenses?/bsd", 0.9),
    ("isc", "opensource.org", r"opensource\.org/licenses?/isc", 0.9),
    ("artistic", "opensource.org", r"opensource\.org/licenses?/artistic", 0.9),
    ("gpl", "opensource.org", r"opensource\.org/licenses?/gpl", 0.9),
    ("mpl", "opensource.org", r"opensource\.org/licenses?/mpl", 0.9),
)


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    weight: float


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order; a smaller priority number is stronger."""
    out: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, weight: float) -> None:
        out.append(Rule(label, keyword, re.compile(rf"(?<!\w){pattern}(?!\w)"), round(100 * (1 - weight)), weight))

    for label, _, ids in FAMILIES:
        for name in ids:
            add(label, "spdx-license-identifier", rf"spdx-license-identifier: *{re.escape(name.lower())}", 1.0)
    for template, weight in TEMPLATES:
        for label, names, _ in FAMILIES:
            for name in names:
                keyword = "creative commons" if name.startswith("creative") else "cc0" if name.startswith("cc0") else "unlicense" if name == "unlicense" else "gnu" if name.startswith("gnu ") else "gpl" if name.startswith("gpl") else "licen"
                add(label, keyword, template.replace("{name}", f"(?:{name})"), weight)
    for label, keyword, pattern, weight in SINGLE:
        add(label, keyword, pattern, weight)
    return tuple(out)


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int
    weight: float


def suppress(found: list[Detection]) -> list[Detection]:
    """Drops what lies inside another detection of equal or higher priority; the result is by start.

    Of equal intervals the one of higher priority stays, then of the smaller label; those that merely overlap both
    stay. One pass by start: whatever contains a detection comes before it, so the furthest end of each priority tells.
    """
    kept: list[Detection] = []
    reach: dict[int, int] = {}
    for d in sorted(found, key=lambda d: (d.start, -d.end, d.priority, d.label)):
        if all(priority > d.priority or end < d.end for priority, end in reach.items()):
            kept.append(d)
        reach[d.priority] = max(reach.get(d.priority, -1), d.end)
    return sorted(kept)


@lru_cache(maxsize=1)
def keywords() -> ahocorasick.Automaton:
    """All keywords of the rules, found in one pass over a text."""
    out = ahocorasick.Automaton()
    for word in {r.keyword for r in rules()}:
        out.add_word(word, word)
    out.make_automaton()
    return out


def gated(hits: Iterator[tuple[int, str]]) -> list[Rule]:
    """The rules of the keywords that occur."""
    present = {word for _, word in hits}
    return [r for r in rules() if r.keyword in present] if present else []


def detect(text: str | None) -> list[Detection]:
    """Signature detections in the whole text; white space counts as one space, letter case doesn't matter."""
    if not text:
        return []
    low = " ".join(text.lower().split())
    found = []
    for r in gated(keywords().iter(low)):
        found += [Detection(m.start(), m.end(), r.label, r.priority, r.weight) for m in r.pattern.finditer(low)]
    return suppress(found)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of every place where a base phrase's words stand consecutively, in order."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in BASE:
        needle = b" " + phrase + b" "
        at, seen, word = joined.find(needle), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)  # from the last hit on
            out.append((word, label))
            seen, at = at, joined.find(needle, at + 1)
    return sorted(out)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with the contract's columns.

    score is the probability-like union of the evidence: 1 - prod(1 - weight) over the distinct
    labels' strongest detections (a base phrase counts 0.6); 0 without any. Null text is empty; very long texts are
    scanned whole, in time linear in their detections; of tied detections of one place the smaller label stays;
    null ids are kept; extra columns are ignored; repeated rows give repeated results; an empty table an empty one.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, raw in rows:
            words = alnum_words(raw)
            places = phrase_places(words)
            found = detect(raw.decode("utf-8", "replace") if raw else None)
            base = sorted({x[1] for x in places})
            weights = dict.fromkeys(base, 0.6)
            for d in found:
                weights[d.label] = max(weights.get(d.label, 0), d.weight)
            miss = 1.0
            for label in sorted(weights):
                miss *= 1 - weights[label]
            starts = [x[0] for x in places]
            yield doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(weights)), 1 - miss

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_rows(docs.select("doc_id", "text"), run, schema, binary=("text",))
