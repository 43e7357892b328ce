"""License scan: ordered signature rules behind a keyword filter; priority and containment settle overlaps."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, table, texts

# Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, keywords of which each of its wordings holds one, and the name as a pattern over lower-case words with single blanks.
NAMES = [
    ("gpl-2.0", "gpl gpl2 gplv2", r"gpl ?v?2(?: 0)?"), ("gpl-3.0", "gpl gpl3 gplv3", r"gpl ?v?3(?: 0)?"), ("gpl-2.0", "gnu", r"gnu general public licen[sc]e (?:version |v )?2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu general public licen[sc]e (?:version |v )?3(?: 0)?"), ("gpl-1.0", "gnu", r"gnu general public licen[sc]e (?:version |v )?1(?: 0)?"),
    ("gpl", "gnu", r"gnu (?:general public licen[sc]e|gpl)"), ("lgpl-2.1", "lgpl lgpl2 lgplv2", r"lgpl ?v?2 1"), ("lgpl-3.0", "lgpl lgpl3 lgplv3", r"lgpl ?v?3(?: 0)?"), ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1"), ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)?"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[sc]e"), ("agpl-3.0", "agpl agpl3 agplv3", r"agpl ?v?3(?: 0)?"), ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: (?:version |v )?3(?: 0)?)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e"), ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e (?:version |v )?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e (?:version |v )?1 1"), ("apache-1.0", "apache", r"apache(?: software)? licen[sc]e (?:version |v )?1 0"), ("apache", "apache", r"apache(?: software)? licen[sc]e"),
    ("apache-2.0", "apache", r"apache 2(?: 0)?"), ("mit", "mit", r"(?:the )?mit licen[sc]e"), ("mit", "expat", r"expat licen[sc]e"), ("x11", "x11", r"x11 licen[sc]e"), ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd(?: licen[sc]e)?"), ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd(?: licen[sc]e)?"), ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"bsd (?:2|two) clause(?: licen[sc]e)?"), ("bsd-3-clause", "bsd", r"bsd (?:3|three) clause(?: licen[sc]e)?"), ("bsd", "bsd", r"(?:new |modified |simplified )?bsd(?: style)? licen[sc]e"),
    ("0bsd", "bsd", r"zero clause bsd(?: licen[sc]e)?"), ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v )?1 1"), ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e (?:version |v )?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"), ("mpl-2.0", "mpl mpl2 mplv2", r"mpl ?v?2(?: 0)?"), ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:version |v )?1(?: 0)?"), ("epl-2.0", "eclipse", r"eclipse public licen[sc]e (?:version |v )?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"), ("cpl", "common", r"common public licen[sc]e"), ("cddl", "cddl", r"cddl(?: 1 [01])?"), ("cddl", "development", r"common development and distribution licen[sc]e"),
    ("eupl", "union", r"european union public licen[sc]e"), ("isc", "isc", r"isc licen[sc]e"), ("zlib", "zlib", r"zlib licen[sc]e"), ("boost-1.0", "boost", r"boost software licen[sc]e(?: (?:version |v )?1(?: 0)?)?"),
    ("artistic", "artistic", r"artistic licen[sc]e(?: (?:version |v )?2(?: 0)?)?"), ("unlicense", "unlicense", r"(?:the )?unlicense"), ("wtfpl", "wtfpl", r"wtfpl"), ("psf", "python", r"python software foundation licen[sc]e"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[sc]e"), ("openssl", "openssl", r"openssl licen[sc]e"), ("php", "php", r"php licen[sc]e"), ("ms-pl", "microsoft", r"microsoft public licen[sc]e"), ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: \d 0)?"), ("cc-by-nc-sa", "cc", r"cc by nc sa(?: \d 0)?"), ("cc-by-nc", "cc", r"cc by nc(?: \d 0)?"), ("cc-by-nd", "cc", r"cc by nd(?: \d 0)?"), ("cc-by-sa", "cc", r"cc by sa(?: \d 0)?"),
    ("cc-by", "cc", r"cc by(?: \d 0)?"), ("cc0", "cc0", r"cc0(?: 1 0)?"), ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike(?: \d 0)?"), ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: \d 0)?"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: \d 0)?"), ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s(?: \d 0)?"), ("cc-by", "commons", r"creative commons attribution(?: \d 0)?"),
    ("cc", "commons", r"creative commons(?: licen[sc]e)?"), ("public-domain", "domain", r"public domain"), ("odbl", "odbl", r"odbl(?: 1 0)?"), ("odbl", "database", r"open database licen[sc]e"), ("proprietary", "rights", r"all rights reserved"),
]
# Label and identifier as SPDX writes it; found after `SPDX-License-Identifier:`.
SPDX = [("0bsd", "0BSD"), ("afl-3.0", "AFL-3.0"), ("agpl-3.0", "AGPL-3.0"), ("apache-1.0", "Apache-1.0"), ("apache-1.1", "Apache-1.1"), ("apache-2.0", "Apache-2.0"), ("artistic", "Artistic-1.0"), ("artistic", "Artistic-2.0"),
        ("bsd-1-clause", "BSD-1-Clause"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("bsd-4-clause", "BSD-4-Clause"), ("blueoak-1.0", "BlueOak-1.0.0"), ("boost-1.0", "BSL-1.0"), ("busl-1.1", "BUSL-1.1"),
        *[(x.lower(), f"{x}-{v}") for x in ("CC-BY", "CC-BY-SA", "CC-BY-NC", "CC-BY-ND", "CC-BY-NC-SA", "CC-BY-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")], ("cc0", "CC0-1.0"), ("cddl", "CDDL-1.0"), ("cddl", "CDDL-1.1"),
        ("cecill-2.1", "CECILL-2.1"), ("cpl", "CPL-1.0"), ("epl-1.0", "EPL-1.0"), ("epl-2.0", "EPL-2.0"), ("eupl", "EUPL-1.1"), ("eupl", "EUPL-1.2"), ("gfdl", "GFDL-1.1"), ("gfdl", "GFDL-1.2"), ("gfdl", "GFDL-1.3"),
        ("gpl-1.0", "GPL-1.0"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"), ("isc", "ISC"), ("lgpl-2.0", "LGPL-2.0"), ("lgpl-2.1", "LGPL-2.1"), ("lgpl-3.0", "LGPL-3.0"), ("mit", "MIT"), ("mit-0", "MIT-0"), ("mpl-1.0", "MPL-1.0"),
        ("mpl-1.1", "MPL-1.1"), ("mpl-2.0", "MPL-2.0"), ("ms-pl", "MS-PL"), ("ms-rl", "MS-RL"), ("ncsa", "NCSA"), ("odbl", "ODbL-1.0"), ("ofl-1.1", "OFL-1.0"), ("ofl-1.1", "OFL-1.1"), ("openssl", "OpenSSL"), ("osl-3.0", "OSL-3.0"),
        ("php", "PHP-3.0"), ("php", "PHP-3.01"), ("postgresql", "PostgreSQL"), ("psf", "PSF-2.0"), ("psf", "Python-2.0"), ("unlicense", "Unlicense"), ("upl-1.0", "UPL-1.0"), ("wtfpl", "WTFPL"), ("x11", "X11"), ("zlib", "Zlib"), ("zpl-2.1", "ZPL-2.1")]
# Label, keywords and short name that only counts as a licence after `licensed under` and the like.
SHORT = [("mit", "mit", r"mit"), ("isc", "isc", r"isc"), ("zlib", "zlib", r"zlib"), ("bsd", "bsd", r"bsd"), ("apache", "apache", r"apache"), ("gpl", "gpl", r"gpl"), ("lgpl", "lgpl", r"lgpl"), ("agpl", "agpl", r"agpl"), ("mpl", "mpl", r"mpl"),
         ("epl", "epl", r"epl"), ("epl-1.0", "epl epl1 eplv1", r"epl ?v?1(?: 0)?"), ("epl-2.0", "epl epl2 eplv2", r"epl ?v?2(?: 0)?"), ("eupl", "eupl", r"eupl(?: v?1 [12])?"), ("x11", "x11", r"x11"), ("0bsd", "0bsd", r"0bsd"), ("mit-0", "mit", r"mit 0"),
         ("boost-1.0", "bsl", r"bsl 1 0"), ("ofl-1.1", "ofl", r"ofl(?: 1 [01])?"), ("psf", "psf", r"psf(?: licen[sc]e)?"), ("openssl", "openssl", r"openssl"), ("ms-pl", "pl", r"ms pl"), ("ms-rl", "rl", r"ms rl")]
# Label, keyword and a clause that the text of that licence holds, or a notice usual with it.
CLAUSES = [("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"), ("boost-1.0", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
           ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"), ("isc", "modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
           ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"), ("bsd-3-clause", "endorse", r"(?:names of its contributors|names of (?:its|the|any) contributors) may be used to endorse or promote products derived from this software"),
           ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"), ("apache-2.0", "contributor", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual"),
           ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"), ("zlib", "implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"), ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
           ("wtfpl", "fuck", r"you just do what the fuck you want to"), ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
           ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation"), ("agpl-3.0", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation"),
           ("gpl", "copyleft", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"), ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"), ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
           ("epl", "accompanying", r"the accompanying program is provided under the terms of this eclipse public licen[sc]e"), ("artistic", "intent", r"the intent of this document is to state the conditions under which a package may be copied"), ("ofl-1.1", "font", r"this font software is licensed under the sil open font licen[sc]e"),
           ("cc0", "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"), ("proprietary", "confidential", r"proprietary and confidential")]
# Wordings around a name; the more a wording says, the surer the finding.
WORDINGS = [("tag", r"spdx licen[sc]e identifier (?:{})", 1.0), ("grant", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{})", 0.95),
            ("terms", r"(?:terms|conditions|copy) of (?:the )?(?:{})", 0.9), ("name", r"(?:{})", 0.8)]

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]  # every text the pattern matches has one of these words
    pattern: re.Pattern
    priority: int  # of two findings where one lies inside the other, the smaller number stays when they are equally long
    score: float


@cache
def rules() -> tuple[Rule, ...]:
    """SPDX tags, grants of short names, clauses and every wording of every name, in order of priority."""
    out = []

    def rule(label: str, keywords: str, pattern: str, score: float) -> None:
        out.append(Rule(label, tuple(keywords.encode().split()), re.compile(rf"(?<!\S){pattern}(?!\S)".encode()), len(out), score))

    for label, name in SPDX:
        rule(label, "spdx", rf"spdx licen[sc]e identifier {_plain(name)}(?: only| or later)?", 1.0)
    for label, keywords, name in SHORT:
        rule(label, keywords, WORDINGS[1][1].format(name), 0.95)
    for label, keywords, clause in CLAUSES:
        rule(label, keywords, clause, 0.95)
    for _, wording, score in WORDINGS:
        for label, keywords, name in NAMES:
            rule(label, keywords, wording.format(name), score)
    return tuple(out)


def _plain(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


@cache
def _by_keyword() -> dict[bytes, tuple[Rule, ...]]:
    out: dict[bytes, tuple[Rule, ...]] = {}
    for r in rules():
        for keyword in r.keywords:
            out[keyword] = (*out.get(keyword, ()), r)
    return out


def words_of(text: str) -> list[bytes]:
    """Lower-case words: runs of a-z, 0-9 and everything beyond ASCII."""
    return text.encode().translate(_LOWER).split()


def _blanks(line: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(line, np.uint8) == 32)


def detections(words: list[bytes], present: set[bytes]) -> list[tuple[int, int, Rule]]:
    """(first word, past last word, rule) after suppression.

    A finding goes if a longer finding covers it, or an equally long one of higher priority.
    """
    line = b" ".join(words)
    found = []
    for rule in {r.priority: r for keyword in present for r in _by_keyword()[keyword]}.values():
        found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(line)]
    found.sort(key=lambda x: (x[0], -x[1], x[2].priority))
    kept, reach, blanks = [], -1, _blanks(line) if found else None
    for start, end, rule in found:  # by start, longest first: one that ends no later than any before lies inside it
        if end > reach:
            kept.append((int(np.searchsorted(blanks, start)), int(np.searchsorted(blanks, end)) + 1, rule))
            reach = end
    return kept


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word number, label) of every place where the words of a base phrase stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    out, blanks = [], None
    for phrase, label in BASE.items():
        needle = f" {phrase} ".encode()
        at = line.find(needle)
        while at >= 0:
            blanks = _blanks(line) if blanks is None else blanks
            out.append((int(np.searchsorted(blanks, at)), label))
            at = line.find(needle, at + 1)
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document; one scan, no shuffle.

    `score` is that of the surest finding, 0 without one. Null and empty texts have no words, null places and empty
    labels; a null doc_id is scanned like any other; other columns are ignored; long texts are scanned whole.
    """

    def run(batches):
        keywords, starts = frozenset(_by_keyword()), {p.split()[0].encode() for p in BASE}
        for b in batches:
            n = b.num_rows
            n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first, last, base_labels, labels = [None] * n, [None] * n, [""] * n, [""] * n
            for i, text in enumerate(b.column(1).to_pylist()):
                words = words_of(text)
                n_words[i] = len(words)
                seen = set(words)
                places = base_places(words) if not starts.isdisjoint(seen) else []
                found = detections(words, seen & keywords) if not keywords.isdisjoint(seen) else []
                if places:
                    n_base[i] = len(places)
                    first[i], last[i] = min(places)[0], max(places)[0]
                    base_labels[i] = ",".join(sorted({x[1] for x in places}))
                if places or found:
                    labels[i] = ",".join(sorted({x[1] for x in places} | {x[2].label for x in found}))
                    score[i] = max([0.5 if places else 0.0, *(x[2].score for x in found)])
            yield {"doc_id": b.column(0), "n_words": n_words, "n_base": n_base, "first_word": first, "last_word": last, "base_labels": base_labels, "labels": labels, "score": score}

    return map_rows(texts(docs), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
