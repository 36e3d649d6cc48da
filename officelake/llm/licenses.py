"""License scans: ordered signature rules over the words of a text, gated by keywords, with priorities and containment.

A rule is a regular expression over the text's words (lower-cased, joined by one space), tried only where all its
keywords are among the words. Of detections, one that lies within another of higher priority, or of the same
priority and longer, is suppressed. Rules come from the table below: each license has a hand-written pattern of its
name and short form, and each way of naming a license in a text is a rule of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame

from officelake.llm.common import texts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases that are always counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label | keyword of the full name (a/b: either) | pattern of the full name | pattern of the short form, as words
LICENSES = r"""
apache-2.0 | apache | apache (?:software )?license(?: version)? 2(?: 0)? | apache 2(?: 0)?
apache-1.1 | apache | apache (?:software )?license(?: version)? 1 1 | apache 1 1
apache-1.0 | apache | apache (?:software )?license(?: version)? 1 0 | apache 1 0
mit | mit | mit (?:x11 )?(?:license|licence|lizenz) | mit
mit-0 | mit | mit no attribution(?: license)? | mit 0
x11 | x11 | x11 (?:license|licence) | x11
isc | isc | isc (?:license|licence) | isc
bsd-2-clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd(?: (?:license|licence))? | bsd 2 clause
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd(?: (?:license|licence))? | bsd 3 clause
bsd-4-clause | bsd | (?:original|4 clause|four clause) bsd(?: (?:license|licence))? | bsd 4 clause
bsd | bsd | bsd (?:style )?(?:license|licence) | bsd
0bsd | bsd | (?:zero clause|0 clause) bsd | 0bsd
agpl-3.0 | affero | (?:gnu )?affero general public (?:license|licence)(?: version)? 3(?: 0)? | agpl ?v?3(?: 0)?
agpl-1.0 | affero | affero general public (?:license|licence)(?: version)? 1(?: 0)? | agpl ?v?1(?: 0)?
agpl | affero | (?:gnu )?affero general public (?:license|licence) | agpl
lgpl-2.0 | library | (?:gnu )?library general public (?:license|licence)(?: version)? 2(?: 0)? | lgpl ?v?2 0
lgpl-2.1 | lesser | (?:gnu )?lesser general public (?:license|licence)(?: version)? 2 1 | lgpl ?v?2 1
lgpl-3.0 | lesser | (?:gnu )?lesser general public (?:license|licence)(?: version)? 3(?: 0)? | lgpl ?v?3(?: 0)?
lgpl | lesser/library | (?:gnu )?(?:lesser|library) general public (?:license|licence) | lgpl
gpl-1.0 | gnu | gnu general public (?:license|licence)(?: version)? 1(?: 0)? | gpl ?v?1(?: 0)?
gpl-2.0 | gnu | gnu general public (?:license|licence)(?: version)? 2(?: 0)? | gpl ?v?2(?: 0)?
gpl-3.0 | gnu | gnu general public (?:license|licence)(?: version)? 3(?: 0)? | gpl ?v?3(?: 0)?
gpl | gnu | gnu (?:general public )?(?:license|licence) | gpl
gfdl-1.1 | documentation | (?:gnu )?free documentation (?:license|licence)(?: version)? 1 1 | gfdl 1 1
gfdl-1.2 | documentation | (?:gnu )?free documentation (?:license|licence)(?: version)? 1 2 | gfdl 1 2
gfdl-1.3 | documentation | (?:gnu )?free documentation (?:license|licence)(?: version)? 1 3 | gfdl 1 3
gfdl | documentation | (?:gnu )?free documentation (?:license|licence) | gfdl
mpl-1.0 | mozilla | mozilla public (?:license|licence)(?: version)? 1 0 | mpl 1 0
mpl-1.1 | mozilla | mozilla public (?:license|licence)(?: version)? 1 1 | mpl 1 1
mpl-2.0 | mozilla | mozilla public (?:license|licence)(?: version)? 2(?: 0)? | mpl 2(?: 0)?
mpl | mozilla | mozilla public (?:license|licence) | mpl
epl-1.0 | eclipse | eclipse public (?:license|licence)(?: version| v)? ?1(?: 0)? | epl 1 0
epl-2.0 | eclipse | eclipse public (?:license|licence)(?: version| v)? ?2(?: 0)? | epl 2 0
cpl-1.0 | common | common public (?:license|licence)(?: version)? 1(?: 0)? | cpl 1 0
cddl-1.0 | distribution | common development and distribution (?:license|licence)(?: version)? 1 0 | cddl 1 0
cddl-1.1 | distribution | common development and distribution (?:license|licence)(?: version)? 1 1 | cddl 1 1
eupl-1.1 | european | european union public (?:license|licence)(?: version| v)? ?1 1 | eupl 1 1
eupl-1.2 | european | european union public (?:license|licence)(?: version| v)? ?1 2 | eupl 1 2
osl-3.0 | open | open software (?:license|licence)(?: version| v)? ?3 0 | osl 3 0
afl-3.0 | academic | academic free (?:license|licence)(?: version| v)? ?3 0 | afl 3 0
artistic-1.0 | artistic | artistic (?:license|licence)(?: version)? 1(?: 0)? | artistic 1 0
artistic-2.0 | artistic | artistic (?:license|licence)(?: version)? 2(?: 0)? | artistic 2 0
zlib | zlib | zlib(?: libpng)? (?:license|licence) | zlib
libpng | libpng | libpng (?:license|licence) | libpng
bsl-1.0 | boost | boost software (?:license|licence)(?: version)? 1(?: 0)? | bsl 1 0
busl-1.1 | business | business source (?:license|licence)(?: version)? 1 1 | busl 1 1
unlicense | unlicense | (?:the )?unlicense | unlicense
wtfpl | fuck | do what the fuck you want to public (?:license|licence) | wtfpl
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)? | cc0 1 0
cc-by-1.0 | cc | cc by 1 0 | cc by 1 0
cc-by-2.0 | cc | cc by 2 0 | cc by 2 0
cc-by-2.5 | cc | cc by 2 5 | cc by 2 5
cc-by-3.0 | cc | cc by 3 0 | cc by 3 0
cc-by-4.0 | cc | cc by 4 0 | cc by 4 0
cc-by-sa-2.0 | cc | cc by sa 2 0 | cc by sa 2 0
cc-by-sa-2.5 | cc | cc by sa 2 5 | cc by sa 2 5
cc-by-sa-3.0 | cc | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0 | cc by sa 4 0
cc-by-nd-3.0 | cc | cc by nd 3 0 | cc by nd 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0 | cc by nd 4 0
cc-by-nc-2.0 | cc | cc by nc 2 0 | cc by nc 2 0
cc-by-nc-3.0 | cc | cc by nc 3 0 | cc by nc 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0 | cc by nc 4 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0 | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by | creative | creative commons attribution(?: (?:license|licence|international|unported|generic))* (?:1|2|3|4) (?:0|5) | creative commons attribution
cc-by-sa | creative | creative commons attribution share ?alike(?: [1-4] [05])? | creative commons by sa
cc-by-nc | creative | creative commons attribution non ?commercial(?: [1-4] [05])? | creative commons by nc
cc-by-nd | creative | creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])? | creative commons by nd
odbl-1.0 | open | open (?:data commons )?(?:open )?database (?:license|licence)(?: v?1 0)? | odbl
odc-by-1.0 | open | open data commons attribution (?:license|licence) | odc by
pddl-1.0 | public | (?:open data commons )?public domain dedication and (?:license|licence) | pddl
python-2.0 | python | python software foundation (?:license|licence) | psf
php-3.01 | php | php (?:license|licence)(?: version)? 3 01 | php 3 01
ruby | ruby | ruby (?:license|licence) | ruby
postgresql | postgresql | postgresql (?:license|licence) | postgresql
openssl | openssl | openssl (?:license|licence) | openssl
ofl-1.1 | open | (?:sil )?open font (?:license|licence)(?: version)?(?: 1 1)? | ofl 1 1
ms-pl | microsoft | microsoft public (?:license|licence) | ms pl
ms-rl | microsoft | microsoft reciprocal (?:license|licence) | ms rl
ncsa | illinois | university of illinois ncsa open source (?:license|licence) | ncsa
upl-1.0 | universal | universal permissive (?:license|licence)(?: v?1 0)? | upl 1 0
ecl-2.0 | educational | educational community (?:license|licence)(?: version)?(?: 2 0)? | ecl 2 0
sspl-1.0 | server | server side public (?:license|licence)(?: v?1)? | sspl 1 0
elastic-2.0 | elastic | elastic (?:license|licence)(?: version)? 2(?: 0)? | elastic 2 0
mulan-2.0 | mulan | mulan permissive software (?:license|licence) v?2 | mulanpsl 2 0
openrail | openrail | openrail(?: m)?(?: (?:license|licence))? | openrail
llama-community | llama | llama(?: [23])? community (?:license|licence) | llama
jquery | jquery | jquery (?:license|licence) | jquery
json | json | json (?:license|licence) | json
tcl | tcl | tcl tk (?:license|licence) | tcl
vim | vim | vim (?:license|licence) | vim
curl | curl | curl (?:license|licence) | curl
"""

#: name | keywords besides the license's own | priority | score | pattern around the license ({name} or {short})
FORMS = r"""
spdx | spdx identifier | 90 | 1.0 | spdx license identifier {short}(?: (?:only|or later))?
grant | | 80 | 0.95 | (?:licensed|released|distributed|published|available|covered|provided|made available) (?:under|by) (?:the )?(?:terms of )?(?:the )?{name}
granted short | | 70 | 0.9 | (?:licensed|released|distributed|published|available) (?:under|by) (?:the )?{short}(?: (?:license|licence))?
declared | license/licence | 60 | 0.85 | (?:license|licence) {short}
named | | 50 | 0.75 | {name}
"""

#: label | keywords | priority | score | pattern: notices that name no license of the table
NOTICES = r"""
public-domain | public domain | 60 | 0.8 | (?:in|into|to) the public domain
public-domain | dedicated public | 65 | 0.85 | dedicated to the public domain
proprietary | proprietary confidential | 60 | 0.8 | proprietary and confidential
proprietary | permission written | 55 | 0.7 | without (?:the )?(?:prior )?(?:express )?written permission
proprietary | reproduction prohibited | 55 | 0.7 | reproduction (?:is |or distribution is )?(?:strictly )?prohibited
no-commercial | noncommercial | 55 | 0.7 | for noncommercial use only
no-commercial | commercial | 55 | 0.7 | (?:for )?non commercial use only
mit | permission hereby granted | 85 | 0.95 | permission is hereby granted free of charge to any person obtaining a copy
isc | permission hereby granted | 85 | 0.9 | permission to use copy modify and or distribute this software for any purpose
bsd | redistribution source binary | 85 | 0.9 | redistribution and use in source and binary forms with or without modification are permitted
gpl | redistribute modify | 85 | 0.9 | you can redistribute it and or modify it under the terms of the gnu general public license
apache-2.0 | apache compliance | 85 | 0.95 | you may not use this file except in compliance with the license
wtfpl | fuck | 60 | 0.7 | just do what the fuck you want to
copyright | copyright | 30 | 0.4 | copyright (?:c )?(?:19|20)[0-9][0-9]
copyright | copyright | 30 | 0.4 | (?:c|©) copyright
"""

#: No rule matches a text without one of these words; the first gate, as some keywords are common words elsewhere.
ANCHORS = frozenset(
    "license licence lizenz licensed released distributed published available covered provided made identifier commons cc cc0 clause "
    "bsd unlicense openrail attribution domain permission permitted prohibited commercial noncommercial confidential redistribute "
    "redistribution compliance copyright want license1 licence1 license2 licence2 license3 licence3".split()
)


@dataclass(frozen=True)
class Rule:
    """A signature: tried where all keywords are among the words; every match has them. One of "a/b" is enough."""

    label: str
    keywords: frozenset[str]
    priority: int
    score: float
    pattern: str


def _rows(table: str) -> list[list[str]]:
    return [[c.strip() for c in line.split(" | ")] for line in table.replace(" | | ", " |  | ").strip().splitlines()]


def _first_word(short: str) -> str:
    """The first word of a short form, "a/b/c" where its version may be written to it: gpl 3, gpl3, gplv3."""
    joined = re.match(r"([a-z]+) \?v\?([0-9])", short)
    if joined:
        return f"{joined[1]}/{joined[1]}{joined[2]}/{joined[1]}v{joined[2]}"
    own = re.match("[a-z0-9]+(?= |$|\\(\\?: )", short)
    return own[0] if own else ""


def rules() -> list[Rule]:
    """Every rule, highest priority first; between equals in the order of the tables."""
    out = []
    for label, keyword, name, short in _rows(LICENSES):
        for form, more, priority, score, pattern in _rows(FORMS):
            own = keyword if "{name}" in pattern else _first_word(short)
            if form == "granted short" and short == name:
                continue
            filled = pattern.replace("{name}", f"(?:{name})").replace("{short}", f"(?:{short})")
            keys = frozenset(k for k in [*more.split(), own] if k)
            out.append(Rule(label, keys, int(priority), float(score), filled))
    for label, keywords, priority, score, pattern in _rows(NOTICES):
        out.append(Rule(label, frozenset(k for k in keywords.split() if k in pattern), int(priority), float(score), pattern))
    return sorted(out, key=lambda r: -r.priority)


class Scanner:
    """Rules by their rarest keyword, compiled when first needed."""

    def __init__(self, given: list[Rule] | None = None):
        self.rules = rules() if given is None else given
        self.gates = [frozenset(k for k in r.keywords if "/" not in k) for r in self.rules]
        self.either = [[frozenset(k.split("/")) for k in r.keywords if "/" in k] for r in self.rules]
        self.every = frozenset().union(*self.gates, *(e for more in self.either for e in more))
        self.compiled: dict[int, re.Pattern] = {}
        self.bases = [(p.split(" "), label) for p, label in PHRASES.items()]
        self.base_words = {w[0] for w, _ in self.bases}

    def base(self, words: list[str], seen: set[str]) -> list[tuple[int, int, str]]:
        """Places of the fixed phrases as (start, end, label)."""
        out = []
        for phrase, label in self.bases:
            if not seen.issuperset(phrase):
                continue
            first, n = phrase[0], len(phrase)
            i = -1
            try:
                while True:
                    i = words.index(first, i + 1)
                    if words[i : i + n] == phrase:
                        out.append((i, i + n, label))
            except ValueError:
                pass
        return sorted(out)

    def detections(self, words: list[str], seen: set[str]) -> list[tuple[int, int, str, float]]:
        """What the rules find and containment leaves, as (start, end, label, score), in order of place."""
        if ANCHORS.isdisjoint(seen):
            return []
        present = self.every & seen
        tried = [
            k for k, gate in enumerate(self.gates) if gate <= present and not any(e.isdisjoint(present) for e in self.either[k])
        ]
        if not tried:
            return []
        text = " ".join(words)
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        found = []
        for k in tried:
            pattern = self.compiled.get(k)
            if pattern is None:
                pattern = self.compiled[k] = re.compile(rf"(?:(?<=\s)|(?<![\s\S])){self.rules[k].pattern}(?= |\Z)")
            for m in pattern.finditer(text):
                a = bisect_right(starts, m.start()) - 1
                b = bisect_right(starts, m.end() - 1)
                found.append((-self.rules[k].priority, a - b, a, b, k))
        # by priority, then length: each is kept unless an interval kept before covers it
        kept: list[tuple[int, int, int]] = []
        edges: list[int] = []
        reach: list[int] = []
        for _, _, a, b, k in sorted(set(found)):
            at = bisect_right(edges, a)
            if at and reach[at - 1] >= b:
                continue
            kept.append((a, b, k))
            # edges are starts of kept intervals, reach the furthest end of those up to it
            edges.insert(at, a)
            reach.insert(at, max(b, reach[at - 1] if at else 0))
            for i in range(at + 1, len(reach)):
                if reach[i] >= b:
                    break
                reach[i] = b
        return [(a, b, self.rules[k].label, self.rules[k].score) for a, b, k in sorted(kept)]


def scan(docs: DataFrame, given: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, base, found) per row: places of the fixed phrases and what the rules detect.

    ``base`` holds struct(start, end, label), ``found`` struct(start, end, label, score), in words from 0. Null and
    empty texts have no words and no places; repeated rows are scanned alike; other columns are not read.
    """
    import pyarrow as pa

    def run(batches):
        scanner = Scanner(given)
        for b in batches:
            n_words, base, found = [], [], []
            for text in b.column("text").to_pylist():
                # bytes.lower() changes A-Z alone
                words = WORDS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                seen = set(words)
                n_words.append(len(words))
                base.append([{"start": s, "end": e, "label": x} for s, e, x in scanner.base(words, seen)])
                found.append([{"start": s, "end": e, "label": x, "score": p} for s, e, x, p in scanner.detections(words, seen)])
            place = [("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(base, pa.list_(pa.struct(place))),
                    pa.array(found, pa.list_(pa.struct([*place, ("score", pa.float64())]))),
                ],
                ["doc_id", "n_words", "base", "found"],
            )

    place = "start: long, end: long, label: string"
    return texts(docs).mapInArrow(run, f"doc_id long, n_words long, base array<struct<{place}>>, found array<struct<{place}, score: double>>")
