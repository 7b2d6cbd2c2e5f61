"""Licence scans by sentence rules.

Texts are cut into sentences, normalised sentences are mapped to identifiers of known licence sentences, and the
sequence of identifiers is matched against ordered licence rules. Wrapped lines are joined as long as they go on with a
known sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetnet.llm.common import map_batches

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License",
    "mit-title-brackets": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-grant-unconditional": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit-notice-project": "This project is licensed under the MIT License.",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-notice": "Licensed under the BSD License.",
    "bsd2-notice": "Licensed under the BSD 2-Clause License.",
    "bsd3-notice": "Licensed under the BSD 3-Clause License.",
    "bsd-notice-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-end": "END OF TERMS AND CONDITIONS",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-project": "This project is licensed under the Apache License 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gnu-version-2": "Version 2, June 1991",
    "gnu-version-21": "Version 2.1, February 1999",
    "gnu-version-3": "Version 3, 29 June 2007",
    "agpl-version-3": "Version 3, 19 November 2007",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-header-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl2-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-header-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "agpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl2-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-fitness": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-copy-if-not": "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc.",
    "lgpl-copy": "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "lgpl-copy-if-not": "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
    "agpl-copy": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl11-title": "Mozilla Public License Version 1.1",
    "mpl11-header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    "epl1-title": "Eclipse Public License - v 1.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl1-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl-agreement": "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented;",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-keep": "This notice may not be removed or altered from any source distribution.",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "unlicense-title": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "artistic2-title": "The Artistic License 2.0",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-notice": "This work is dedicated to the public domain under CC0 1.0.",
    "public-domain": "This work has been placed in the public domain.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-notice": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "reserved": "All rights reserved.",
}

# Licence names that tags and short notices are made of.
TAGGED = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "WTFPL", "Artistic-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")


def known_sentences() -> dict[str, str]:
    """SENTENCES, and for each of TAGGED its tag line."""
    return SENTENCES | {f"tag-{name}": f"SPDX-License-Identifier: {name}" for name in TAGGED}


@dataclass(frozen=True)
class Rule:
    """A licence whose sentences, by identifier, follow one another with up to ``gap`` other lines or parts of lines between the end of one and the start of the next."""

    licence: str
    kind: str
    order: tuple[str, ...]
    gap: int = 3


# Ordered rules; of two that start at a sentence, the longer is tried first, then the one named first.
RULES = (
    Rule("MIT", "text", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    Rule("MIT", "text", ("mit-grant", "mit-condition", "mit-warranty")),
    Rule("MIT", "text", ("mit-grant", "mit-condition")),
    Rule("MIT", "text", ("mit-grant", "mit-warranty"), 6),
    Rule("MIT-0", "text", ("mit-grant-unconditional", "mit-warranty"), 6),
    Rule("MIT", "title", ("mit-title",)),
    Rule("MIT", "title", ("mit-title-the",)),
    Rule("MIT", "title", ("mit-title-brackets",)),
    Rule("MIT", "notice", ("mit-notice",)),
    Rule("MIT", "notice", ("mit-notice-licensed",)),
    Rule("MIT", "notice", ("mit-notice-project",)),
    Rule("ISC", "text", ("isc-grant", "isc-warranty")),
    Rule("ISC", "text", ("isc-grant",)),
    Rule("ISC", "title", ("isc-title",)),
    Rule("0BSD", "text", ("0bsd-grant",)),
    Rule("BSD-4-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse"), 6),
    Rule("BSD-4-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise"), 6),
    Rule("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    Rule("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    Rule("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    Rule("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("BSD", "notice", ("bsd-notice",)),
    Rule("BSD", "notice", ("bsd-notice-style",)),
    Rule("BSD-2-Clause", "notice", ("bsd2-notice",)),
    Rule("BSD-3-Clause", "notice", ("bsd3-notice",)),
    Rule("Apache-2.0", "text", ("apache-title", "apache-version", "apache-terms", "apache-end"), 600),
    Rule("Apache-2.0", "text", ("apache-title", "apache-version", "apache-terms")),
    Rule("Apache-2.0", "title", ("apache-title", "apache-version")),
    Rule("Apache-2.0", "header", ("apache-header", "apache-comply", "apache-copy", "apache-warranty")),
    Rule("Apache-2.0", "header", ("apache-header", "apache-comply")),
    Rule("Apache-2.0", "notice", ("apache-notice",)),
    Rule("Apache-2.0", "notice", ("apache-notice-project",)),
    Rule("GPL-2.0", "text", ("gpl-title", "gnu-version-2", "gnu-verbatim"), 6),
    Rule("GPL-3.0", "text", ("gpl-title", "gnu-version-3", "gnu-verbatim"), 6),
    Rule("LGPL-2.1", "text", ("lgpl-title", "gnu-version-21", "gnu-verbatim"), 6),
    Rule("LGPL-3.0", "text", ("lgpl-title", "gnu-version-3", "gnu-verbatim"), 6),
    Rule("AGPL-3.0", "text", ("agpl-title", "agpl-version-3", "gnu-verbatim"), 6),
    Rule("GPL-2.0", "title", ("gpl-title", "gnu-version-2")),
    Rule("GPL-3.0", "title", ("gpl-title", "gnu-version-3")),
    Rule("LGPL-2.1", "title", ("lgpl-title", "gnu-version-21")),
    Rule("LGPL-3.0", "title", ("lgpl-title", "gnu-version-3")),
    Rule("AGPL-3.0", "title", ("agpl-title", "agpl-version-3")),
    Rule("GPL-3.0", "header", ("gpl3-header", "gpl-warranty", "gpl-copy")),
    Rule("GPL-3.0", "header", ("gpl3-header",)),
    Rule("GPL-3.0", "header", ("gpl3-header-only",)),
    Rule("GPL-3.0", "notice", ("gpl3-notice",)),
    Rule("GPL-2.0", "header", ("gpl2-header", "gpl-warranty", "gpl-copy-if-not")),
    Rule("GPL-2.0", "header", ("gpl2-header", "gpl-warranty", "gpl-copy")),
    Rule("GPL-2.0", "header", ("gpl2-header",)),
    Rule("GPL-2.0", "header", ("gpl2-header-only",)),
    Rule("GPL-2.0", "notice", ("gpl2-notice",)),
    Rule("LGPL-2.1", "header", ("lgpl21-header", "lgpl-warranty", "lgpl-copy-if-not")),
    Rule("LGPL-2.1", "header", ("lgpl21-header", "lgpl-warranty", "lgpl-copy")),
    Rule("LGPL-2.1", "header", ("lgpl21-header",)),
    Rule("LGPL-2.0", "header", ("lgpl2-header",)),
    Rule("LGPL-3.0", "header", ("lgpl3-header",)),
    Rule("AGPL-3.0", "header", ("agpl3-header", "gpl-warranty", "agpl-copy")),
    Rule("AGPL-3.0", "header", ("agpl3-header",)),
    Rule("MPL-2.0", "title", ("mpl2-title",)),
    Rule("MPL-2.0", "header", ("mpl-header", "mpl-copy")),
    Rule("MPL-2.0", "header", ("mpl-header",)),
    Rule("MPL-1.1", "title", ("mpl11-title",)),
    Rule("MPL-1.1", "header", ("mpl11-header",)),
    Rule("EPL-1.0", "text", ("epl1-title", "epl-agreement"), 6),
    Rule("EPL-2.0", "text", ("epl2-title", "epl-agreement"), 6),
    Rule("EPL-1.0", "title", ("epl1-title",)),
    Rule("EPL-2.0", "title", ("epl2-title",)),
    Rule("EPL-1.0", "header", ("epl1-header",)),
    Rule("EPL-2.0", "header", ("epl2-header",)),
    Rule("Zlib", "text", ("zlib-warranty", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-keep")),
    Rule("Zlib", "text", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    Rule("BSL-1.0", "text", ("bsl-title", "bsl-grant")),
    Rule("BSL-1.0", "title", ("bsl-title",)),
    Rule("BSL-1.0", "notice", ("bsl-notice",)),
    Rule("Unlicense", "text", ("unlicense-title", "unlicense-grant")),
    Rule("Unlicense", "text", ("unlicense-title",)),
    Rule("WTFPL", "title", ("wtfpl-title",)),
    Rule("Artistic-2.0", "title", ("artistic2-title",)),
    Rule("CC0-1.0", "title", ("cc0-title",)),
    Rule("CC0-1.0", "notice", ("cc0-notice",)),
    Rule("public-domain", "notice", ("public-domain",)),
    Rule("CC-BY-4.0", "notice", ("cc-by-notice",)),
    Rule("CC-BY-SA-4.0", "notice", ("cc-by-sa-notice",)),
    Rule("CC-BY-NC-4.0", "notice", ("cc-by-nc-notice",)),
    Rule("CC-BY-ND-4.0", "notice", ("cc-by-nd-notice",)),
    Rule("CC-BY-NC-SA-4.0", "notice", ("cc-by-nc-sa-notice",)),
    Rule("CC-BY-NC-ND-4.0", "notice", ("cc-by-nc-nd-notice",)),
    Rule("CC-BY-4.0", "notice", ("cc-by-long",)),
    Rule("CC-BY-SA-4.0", "notice", ("cc-by-sa-long",)),
    Rule("CC-BY-NC-4.0", "notice", ("cc-by-nc-long",)),
    Rule("CC-BY-ND-4.0", "notice", ("cc-by-nd-long",)),
    Rule("CC-BY-NC-SA-4.0", "notice", ("cc-by-nc-sa-long",)),
    Rule("CC-BY-NC-ND-4.0", "notice", ("cc-by-nc-nd-long",)),
    Rule("proprietary", "notice", ("reserved",)),
    *(Rule(name, "tag", (f"tag-{name}",)) for name in TAGGED),
)

#: A sentence ends at a line's end, or at . ! ? ; : before white space or the end.
_FRAGMENT = re.compile(r"(?:[^\n.!?;:]|[.!?;:](?![\s.!?;:]|\Z))+")
_TOKEN = re.compile(r"[a-z0-9]+")
_FIRST = re.compile(r"[\W_]*([A-Za-z0-9]+)")


def normalise(sentence: str) -> str:
    """Lower-cased letters and digits, everything else one space."""
    return " ".join(_TOKEN.findall(sentence.lower()))


class Lexicon:
    """Known sentences by normalised form, with the word prefixes that tell whether a wrapped sentence may go on."""

    def __init__(self, sentences: dict[str, str]) -> None:
        self.known: dict[str, str] = {}
        self.prefixes: set[str] = set()
        for name, sentence in sentences.items():
            words = normalise(sentence).split()
            self.known.setdefault(" ".join(words), name)
            self.prefixes.update(" ".join(words[:k]) for k in range(1, len(words)))
        self.first = {k.split()[0] for k in self.known}

    def identify(self, text: str) -> list[tuple[int, str, int, int, int]]:
        """(number of its first line or part, identifier, start, end, number of its last) of each known sentence of the text,
        in order."""
        spans = [m.span() for m in _FRAGMENT.finditer(text)]
        out, at = [], 0
        while at < len(spans):
            begin, end = spans[at]
            head = _FIRST.match(text, begin, end)
            step = 1
            if head and head[1].lower() in self.first:
                said, upto, best = normalise(text[begin:end]), at, None
                while True:
                    if said in self.known:
                        best = (upto, self.known[said])
                    if said not in self.prefixes or upto + 1 >= len(spans):
                        break
                    upto += 1
                    said = f"{said} {normalise(text[spans[upto][0] : spans[upto][1]])}".rstrip()
                if best:
                    out.append((at, best[1], begin, spans[best[0]][1], best[0]))
                    step = best[0] - at + 1
            at += step
        return out


def recognise(found: list[tuple[int, str, int, int, int]], rules: tuple[Rule, ...] = RULES) -> list[tuple[str, str, int, int]]:
    """(licence, kind, start, end) of each rule that a run of identified sentences meets; no sentence is used twice."""
    by_head: dict[str, list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: -len(r.order)):
        by_head.setdefault(rule.order[0], []).append(rule)
    used, out = set(), []
    for i, (_, name, start, _, _) in enumerate(found):
        if i in used:
            continue
        for rule in by_head.get(name, ()):
            chain = [i]
            for want in rule.order[1:]:
                last, nxt = found[chain[-1]][4], None
                for j in range(chain[-1] + 1, len(found)):  # no further than the gap
                    if found[j][0] - last > rule.gap + 1:
                        break
                    if j not in used and found[j][1] == want:
                        nxt = j
                        break
                if nxt is None:
                    break
                chain.append(nxt)
            else:
                used.update(chain)
                out.append((rule.licence, rule.kind, start, found[chain[-1]][3]))
                break
    return out


SCHEMA = "doc_id {kind}, sentences array<string>, matches array<struct<licence:string,kind:string,start:int,stop:int>>"


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, sentences (identifiers in order), matches (with offsets).

    Null and empty texts have none. Licences that occur twice match twice. Repeated rows are scanned each, other
    columns are ignored, an empty table gives an empty result.
    """
    lexicon = Lexicon(sentences or known_sentences())
    matched = pa.list_(pa.struct([("licence", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.identify(t.as_py() or "") for t in batch.column(1)]
            names = pa.array([[x[1] for x in f] for f in found], pa.list_(pa.string()))
            rows = [[dict(zip(("licence", "kind", "start", "stop"), m, strict=True)) for m in recognise(f, rules)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(rows, matched)], names=["doc_id", "sentences", "matches"])

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA.format(kind=docs.schema["doc_id"].dataType.simpleString()))
