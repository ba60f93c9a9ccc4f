"""License scans by ordered signature rules.

A rule is a regular expression with a label, a priority and keywords, strings of which every match holds one; only
rules with a keyword in the text run, so they find what all rules would. Detections are ordered by priority, then length; one inside an interval
already kept is dropped. Three base phrases are found by consecutive word hashes and are never dropped.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .text_features import word_hashes

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: label: (SPDX forms, written names). Names are regular expressions over lower-case text; a space stands for any gap.
FAMILIES = {
    "mit": (["mit", "x11", "expat"], [r"mit", r"massachusetts institute of technology", r"expat"]),
    "mit-0": (["mit-0"], [r"mit no attribution", r"mit-0"]),
    "apache-2": (["apache-2\\.0"], [r"apache software", r"apache,? (?:license,? )?(?:version |v\.?)?2(?:\.0)?", r"apache-2\.0", r"apl ?2"]),
    "apache-1.1": (["apache-1\\.1"], [r"apache software license,? (?:version )?1\.1", r"apache-1\.1"]),
    "gpl-2": (["gpl-2\\.0(?:-only|-or-later|\\+)?"], [r"gnu general public license,?(?: as published by the free software foundation[;,]?)?(?: either)? ?(?:version |v)2(?:\.0)?", r"gpl ?v?2(?:\.0)?", r"gplv2\+?"]),
    "gpl-3": (["gpl-3\\.0(?:-only|-or-later|\\+)?"], [r"gnu general public license,?(?: as published by the free software foundation[;,]?)?(?: either)? ?(?:version |v)3(?:\.0)?", r"gpl ?v?3(?:\.0)?", r"gplv3\+?"]),
    "gpl": (["gpl"], [r"gnu general public", r"gnu gpl", r"general public license"]),
    "lgpl-2.1": (["lgpl-2\\.1(?:-only|-or-later|\\+)?"], [r"gnu lesser general public license,? (?:version |v)2\.1", r"lgpl ?v?2\.1"]),
    "lgpl-3": (["lgpl-3\\.0(?:-only|-or-later|\\+)?"], [r"gnu lesser general public license,? (?:version |v)3", r"lgpl ?v?3(?:\.0)?"]),
    "lgpl": (["lgpl"], [r"gnu (?:lesser|library) general public", r"lesser general public license", r"gnu lgpl"]),
    "agpl-3": (["agpl-3\\.0(?:-only|-or-later|\\+)?"], [r"gnu affero general public license,? (?:version |v)3", r"agpl ?v?3(?:\.0)?", r"gnu affero general public", r"affero gpl"]),
    "bsd-2": (["bsd-2-clause"], [r"bsd 2[- ]clause", r"2[- ]clause bsd", r"two[- ]clause bsd", r"simplified bsd", r"freebsd"]),
    "bsd-3": (["bsd-3-clause"], [r"bsd 3[- ]clause", r"3[- ]clause bsd", r"three[- ]clause bsd", r"new bsd", r"modified bsd", r"revised bsd"]),
    "bsd-4": (["bsd-4-clause"], [r"bsd 4[- ]clause", r"4[- ]clause bsd", r"original bsd"]),
    "bsd": (["bsd"], [r"bsd", r"bsd[- ]style", r"berkeley software distribution"]),
    "isc": (["isc"], [r"isc", r"internet systems consortium"]),
    "mpl-2": (["mpl-2\\.0"], [r"mozilla public license,? (?:version |v\. ?)?2(?:\.0)?", r"mpl ?v?2(?:\.0)?"]),
    "mpl-1.1": (["mpl-1\\.1"], [r"mozilla public license,? (?:version |v\. ?)?1\.1", r"mpl ?v?1\.1"]),
    "epl-2": (["epl-2\\.0"], [r"eclipse public license,? (?:version |v\. ?)?2(?:\.0)?", r"epl ?v?2(?:\.0)?"]),
    "epl-1": (["epl-1\\.0"], [r"eclipse public license,? (?:version |v\. ?)?1(?:\.0)?", r"epl ?v?1(?:\.0)?"]),
    "cddl-1": (["cddl-1\\.[01]"], [r"common development and distribution", r"cddl"]),
    "unlicense": (["unlicense"], [r"the unlicense", r"unlicense"]),
    "cc0": (["cc0-1\\.0", "cc0"], [r"cc0", r"creative commons zero", r"cc zero"]),
    "cc-by": (["cc-by-[1-4]\\.0"], [r"creative commons attribution(?: [1-4]\.0)?(?: international| unported)?", r"cc[- ]by(?: [1-4]\.0)?"]),
    "cc-by-sa": (["cc-by-sa-[1-4]\\.0"], [r"creative commons attribution[- ]share ?alike(?: [1-4]\.0)?(?: international| unported)?", r"cc[- ]by[- ]sa(?: [1-4]\.0)?"]),
    "cc-by-nd": (["cc-by-nd-[1-4]\\.0"], [r"creative commons attribution[- ]no ?derivatives(?: [1-4]\.0)?", r"cc[- ]by[- ]nd(?: [1-4]\.0)?"]),
    "cc-by-nc": (["cc-by-nc-[1-4]\\.0"], [r"creative commons attribution[- ]non ?commercial(?: [1-4]\.0)?(?: international| unported)?", r"cc[- ]by[- ]nc(?: [1-4]\.0)?"]),
    "cc-by-nc-sa": (["cc-by-nc-sa-[1-4]\\.0"], [r"creative commons attribution[- ]non ?commercial[- ]share ?alike(?: [1-4]\.0)?", r"cc[- ]by[- ]nc[- ]sa(?: [1-4]\.0)?"]),
    "cc-by-nc-nd": (["cc-by-nc-nd-[1-4]\\.0"], [r"creative commons attribution[- ]non ?commercial[- ]no ?deriv\w*(?: [1-4]\.0)?", r"cc[- ]by[- ]nc[- ]nd(?: [1-4]\.0)?"]),
    "zlib": (["zlib"], [r"zlib", r"zlib/libpng"]),
    "bsl-1": (["bsl-1\\.0"], [r"boost software", r"boost software license,? (?:version )?1\.0"]),
    "artistic-2": (["artistic-2\\.0"], [r"artistic license,? (?:version )?2(?:\.0)?", r"perl artistic"]),
    "wtfpl": (["wtfpl"], [r"do what the f\w+ you want to public", r"wtfpl"]),
    "ofl-1.1": (["ofl-1\\.1"], [r"sil open font", r"ofl ?1\.1"]),
    "odbl": (["odbl-1\\.0"], [r"open database", r"odbl"]),
    "odc-by": (["odc-by-1\\.0"], [r"open data commons attribution", r"odc-by"]),
    "gfdl": (["gfdl-1\\.[1-3](?:-only|-or-later)?"], [r"gnu free documentation", r"gfdl"]),
    "python-2": (["python-2\\.0", "psf-2\\.0"], [r"python software foundation", r"psf"]),
    "postgresql": (["postgresql"], [r"postgresql"]),
    "upl-1": (["upl-1\\.0"], [r"universal permissive"]),
    "eupl-1.2": (["eupl-1\\.2"], [r"european union public", r"eupl"]),
    "ms-pl": (["ms-pl"], [r"microsoft public", r"ms-pl"]),
    "openrail": (["openrail(?:\\+\\+)?"], [r"open ?rail(?:-m)?", r"responsible ai"]),
}

#: What stands before a name, in every match of the first carrier.
HEAD = r"(?:licen[sc]ed|released|distributed|available|published|provided) under"
#: How a name is introduced: (pattern around it, priority, weight). Smaller priorities come first.
CARRIERS = [
    (r"(?:licen[sc]ed|released|distributed|available|published|provided|made available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[sc]e)?", 1, 0.95),
    (r"under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[sc]e)", 2, 0.9),
    (r"(?:licen[sc]e|licence terms) ?[:=] ?(?:the )?{name}", 2, 0.9),
    (r"{name}(?: public)?,? licen[sc]e(?:,? ?(?:version |v\.? ?)?[0-9]+(?:\.[0-9]+)*)?", 3, 0.8),
    (r"see (?:the )?(?:file )?{name}[ .-]licen[sc]e", 3, 0.7),
]
#: (label, a word that every match holds, pattern, priority, weight). Fixed words of public licenses and notices.
WHOLE_TEXTS = [
    ("mit", "granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 0, 0.97),
    ("isc", "permission", r"permission to use, copy, modify, and/?or distribute this software for any purpose with or without fee is hereby granted", 0, 0.97),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms,? with or without modification,? are permitted", 0, 0.95),
    ("bsd-3", "endorse", r"neither the name of .{1,80}? may be used to endorse or promote products", 0, 0.97),
    ("zlib", "warranty", r"this software is provided 'as-is', without any express or implied warranty", 0, 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0, 0.97),
    ("public-domain", "domain", r"(?:released|dedicated|placed) (?:in)?to the public domain", 2, 0.8),
    ("proprietary", "reserved", r"all rights reserved", 5, 0.5),
    ("copyright", "copyright", r"copyright ?(?:\(c\)|©)? ?(?:19|20)[0-9]{2}", 6, 0.3),
    ("cc-by", "creativecommons", r"creativecommons\.org/licenses/by/[1-4]\.0", 1, 0.95),
    ("cc-by-sa", "creativecommons", r"creativecommons\.org/licenses/by-sa/[1-4]\.0", 1, 0.95),
    ("cc-by-nc", "creativecommons", r"creativecommons\.org/licenses/by-nc/[1-4]\.0", 1, 0.95),
    ("cc0", "creativecommons", r"creativecommons\.org/publicdomain/zero/1\.0", 1, 0.95),
    ("cc-by-nd", "creativecommons", r"creativecommons\.org/licenses/by-nd/[1-4]\.0", 1, 0.95),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.0", 1, 0.95),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.0", 1, 0.95),
    # addresses
    ("apache-2", "apache.org", r"apache\.org/licenses/license-2\.0", 1, 0.95),
    ("apache-1.1", "apache.org", r"apache\.org/licenses/license-1\.1", 1, 0.95),
    ("mit", "opensource.org", r"opensource\.org/licenses?/mit(?![\w-])", 1, 0.95),
    ("bsd-2", "opensource.org", r"opensource\.org/licenses?/bsd-2-clause", 1, 0.95),
    ("bsd-3", "opensource.org", r"opensource\.org/licenses?/bsd-3-clause", 1, 0.95),
    ("isc", "opensource.org", r"opensource\.org/licenses?/isc", 1, 0.95),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl", 1, 0.9),
    ("lgpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/lgpl", 1, 0.9),
    ("agpl-3", "gnu.org", r"gnu\.org/licenses/agpl", 1, 0.9),
    ("gfdl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/fdl", 1, 0.9),
    ("mpl-2", "mozilla.org", r"mozilla\.org/mpl/2\.0", 1, 0.95),
    ("mpl-1.1", "mozilla.org", r"mozilla\.org/mpl/1\.1", 1, 0.95),
    ("epl-1", "eclipse.org", r"eclipse\.org/legal/epl-v10", 1, 0.95),
    ("epl-2", "eclipse.org", r"eclipse\.org/legal/epl-(?:v20|2\.0)", 1, 0.95),
    ("bsl-1", "boost.org", r"boost\.org/license_1_0\.txt", 1, 0.95),
    ("unlicense", "unlicense.org", r"unlicense\.org", 1, 0.9),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net", 1, 0.9),
    ("ofl-1.1", "scripts.sil.org", r"scripts\.sil\.org/ofl", 1, 0.9),
    ("odbl", "opendatacommons", r"opendatacommons\.org/licenses/odbl", 1, 0.95),
    ("odc-by", "opendatacommons", r"opendatacommons\.org/licenses/by", 1, 0.95),
    # sentences of the texts
    ("mit", "copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0, 0.95),
    ("mit-0", "restriction", r"to deal in the software without restriction[^.]{0,200}? and to permit persons to whom the software is furnished to do so\. the software is provided", 0, 0.9),
    ("apache-2", "this", r"you may not use this file except in compliance with the license", 0, 0.95),
    ("apache-2", "distributed", r"distributed on an \"?as is\"? basis, without warranties or conditions of any kind", 0, 0.95),
    ("apache-2", "perpetual", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license", 0, 0.97),
    ("apache-2", "notice", r"if the work includes a \"?notice\"? text file as part of its distribution", 0, 0.95),
    ("gpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu general public license", 0, 0.95),
    ("lgpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu lesser general public license", 0, 0.95),
    ("lgpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu library general public license", 0, 0.95),
    ("agpl-3", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu affero general public license", 0, 0.95),
    ("gpl", "freedom", r"licenses for most software are designed to take away your freedom to share and change it", 0, 0.95),
    ("gpl-3", "copyleft", r"the gnu general public license is a free, copyleft license for software and other kinds of works", 0, 0.97),
    ("agpl-3", "copyleft", r"the gnu affero general public license is a free, copyleft license", 0, 0.97),
    ("gfdl", "invariant", r"with no invariant sections, no front-cover texts,? and no back-cover texts", 0, 0.95),
    ("bsd", "reproduce", r"redistributions in binary form must reproduce the above copyright notice", 0, 0.95),
    ("bsd", "retain", r"redistributions of source code must retain the above copyright notice", 0, 0.95),
    ("bsd-3", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission", 0, 0.97),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0, 0.97),
    ("bsd-2", "freebsd", r"official policies, either expressed or implied, of the freebsd project", 0, 0.9),
    ("isc", "without", r"any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", 0, 0.95),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license,? v\. 2\.0", 0, 0.97),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1", 0, 0.97),
    ("mpl-2", "software", r"covered software is provided under this license on an \"?as is\"? basis", 0, 0.9),
    ("epl-1", "eclipse", r"made available under the terms of the eclipse public license v1\.0", 0, 0.97),
    ("epl-2", "eclipse", r"made available under the terms of the eclipse public license (?:v\. ?)?2\.0", 0, 0.97),
    ("cddl-1", "development", r"subject to the terms of the common development and distribution license", 0, 0.95),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 0, 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 0, 0.95),
    ("bsl-1", "machine-executable", r"unless such copies or derivative works are solely in the form of machine-executable object code", 0, 0.97),
    ("artistic-2", "package", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed\. preamble this license establishes the terms under which a given free software package", 0, 0.9),
    ("wtfpl", "just", r"you just do what the f\w+ you want to", 0, 0.97),
    ("ofl-1.1", "software", r"this font software is licensed under the sil open font license", 0, 0.97),
    ("ofl-1.1", "software", r"the font software may be modified, altered, or added to", 0, 0.9),
    ("cc0", "waive", r"to the extent possible under law,? .{1,80}? waived all copyright and related or neighboring rights", 0, 0.97),
    ("cc-by-sa", "similar", r"distribute the resulting work only under the same or similar license", 1, 0.6),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes", 1, 0.6),
    ("postgresql", "postgresql", r"postgresql database management system \(formerly known as postgres", 0, 0.9),
    ("python-2", "hereby", r"psf hereby grants licensee a nonexclusive, royalty-free, world-wide license", 0, 0.97),
    ("upl-1", "larger", r"larger works? to which the software is contributed", 0, 0.9),
    ("ms-pl", "accept", r"if you use the software, you accept this license\. if you do not accept the license, do not use the software", 0, 0.9),
    ("eupl-1.2", "eupl", r"licensed under the eupl,? (?:version |v\.? ?)?1\.2", 0, 0.97),
    ("openrail", "restrictions", r"use-based restrictions as referenced in paragraph 5", 0, 0.95),
    ("public-domain", "domain", r"this (?:work|file|software|text|image) is in the public domain", 1, 0.85),
    ("public-domain", "reserved", r"no rights reserved", 4, 0.6),
    ("proprietary", "confidential", r"proprietary and confidential", 4, 0.6),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)", 4, 0.7),
    ("proprietary", "permission", r"(?:may not|must not) be (?:reproduced|copied|redistributed|distributed)[^.]{0,80}? without (?:the )?(?:prior )?(?:express )?written permission", 4, 0.7),
    ("proprietary", "evaluation", r"licensed for evaluation (?:purposes )?only", 4, 0.7),
]


def gap(pattern: str) -> str:
    """A space stands for any gap, an optional one for any gap or none.

    A gap doesn't hold the mark that must follow it, nor gives back what it holds once that mark is found: a long run
    of marks is read once, not once for each of its places.
    """
    for space in ("[- ]", "[ .-]"):
        pattern = pattern.replace(space, " ")
    pattern = pattern.replace(" ?[:=] ?", r"[^\w:=]*[:=]\W*+")
    pattern = pattern.replace(r" ?(?:\(c\)|©)? ?", r"\W*+(?:(?<=\()c\)\W*+)?")
    return pattern.replace(" ?", r"\W*").replace(" ", r"\W+")


def signature_rules() -> list[tuple]:
    """(label, keywords, pattern, priority, weight), some hundreds, in order of priority."""
    rules = []
    for label, (spdx, names) in FAMILIES.items():
        for x in spdx:
            rules.append((label, ("spdx",), rf"spdx-license-identifier:\s*{x}(?![\w.-])", 0, 0.99))
        for name in names:
            for carrier, priority, weight in CARRIERS:
                rules.append((label, ("under",) if priority == 1 else ("license", "licence"), rf"(?<!\w){gap(carrier.replace('{name}', name))}(?!\w)", priority, weight))
    for label, keyword, pattern, priority, weight in WHOLE_TEXTS:
        rules.append((label, (keyword,), gap(pattern), priority, weight))
    return sorted(rules, key=lambda r: r[3])


#: Keywords of the carriers, which hold a name as well.
CARRIED = frozenset({"under", "license", "licence"})


class Scanner:
    def __init__(self):
        self.rules = [(label, frozenset(keys), re.compile(p, re.S), priority, weight) for label, keys, p, priority, weight in signature_rules()]
        self.keywords = sorted({k for r in self.rules for k in r[1]})
        self.head = re.compile(gap(HEAD))
        # a family's names: at least one must stand in the text before its carriers run
        self.names = {label: re.compile("|".join(map(gap, names))) for label, (_, names) in FAMILIES.items()}
        self.phrases = [(label, word_hashes(phrase.split())) for label, phrase in sorted(BASE.items())]

    def have(self, text: bytes) -> set[str]:
        return {k for k in self.keywords if k.encode() in text}

    def detect(self, text: str, have: set | None) -> list[tuple[str, int, int, float]]:
        """(label, start, end, weight) of the detections that stay, in a lower-case text that holds the keywords `have`; by all rules without them."""
        found, named = [], {}
        if have and "under" in have and not self.head.search(text):
            have = have - {"under"}
        for label, keys, pattern, priority, weight in self.rules:
            if have is not None:
                if have.isdisjoint(keys):
                    continue
                if keys <= CARRIED:
                    if label not in named:
                        named[label] = self.names[label].search(text) is not None
                    if not named[label]:
                        continue
            found += [(priority, m.start() - m.end(), m.start(), m.end(), label, weight) for m in pattern.finditer(text)]
        # kept intervals that none later kept spares a look at: both ends ascend
        kept, starts, ends = [], [], []
        for _, _, a, b, label, weight in sorted(found):
            i = bisect.bisect_right(starts, a)
            if i and ends[i - 1] >= b:
                continue
            kept.append((label, a, b, weight))
            j = bisect.bisect_right(ends, b, lo=bisect.bisect_left(starts, a))
            i = bisect.bisect_left(starts, a)
            starts[i:j], ends[i:j] = [a], [b]
        return kept

    def scan(self, column) -> dict[str, list]:
        data, at = C.utf8(column)
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for _, _, part, cut in C.pieces(data, at):
            low = C.lower_ascii(part)
            s, e, first = C.spans(C.ALNUM[low], cut)
            h = C.span_hashes(low, s, e)
            row = np.repeat(np.arange(len(cut) - 1), np.diff(first))
            places = {}
            for label, phrase in self.phrases:
                m = len(phrase)
                if len(h) < m:
                    continue
                hit = row[m - 1 :] == row[: len(row) - m + 1]
                for k, w in enumerate(phrase):
                    hit &= h[k : len(h) - m + 1 + k] == w
                for i in np.flatnonzero(hit):
                    places.setdefault(int(row[i]), []).append((int(i - first[row[i]]), label))
            for r in range(len(cut) - 1):
                base = places.get(r, [])
                labels, miss = {label for _, label in base}, 0.01 if base else 1.0
                text = low[cut[r] : cut[r + 1]].tobytes()
                if have := self.have(text):
                    for label, _, _, weight in self.detect(text.decode("utf-8", "replace"), have):
                        labels.add(label)
                        miss *= 1 - weight
                where = [x for x, _ in base]
                for key, value in (("n_words", int(first[r + 1] - first[r])), ("n_base", len(base)), ("first_word", min(where, default=None)), ("last_word", max(where, default=None)), ("base_labels", ",".join(sorted({x for _, x in base}))), ("labels", ",".join(sorted(labels))), ("score", 1.0 - miss)):
                    out[key].append(value)
        return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: word count, base phrases' places, labels and a confidence from 0 (nothing found) to 1.

    Null texts are empty: no words, no places, empty label strings, score 0. Repeated rows get equal results;
    other columns are not read. Texts are scanned where they lie; nothing is shuffled.
    """
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            found = scanner.scan(batch.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v, kinds[k]) for k, v in found.items()})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(C.tidied(run), SCHEMA)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
