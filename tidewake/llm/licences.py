"""Operator 8: licence scan by sentence rules.

A text is read as words (lower case, letters and digits).  Between words stand borders: line ends, and ``.``, ``!``, ``?``, ``;`` or
``:`` before a blank.  A known licence sentence is found where all its words follow each other, the first one after a border and the
last one before a border; the longest one at a place is taken and reading goes on behind it.  So wrapped lines, stops inside a
sentence and headings without a full stop do not hide a sentence, and no part of one stands for the whole.

The identifiers found form a sequence per text; it is read from left to right, and at each place the first rule of the ordered
list whose identifiers follow there is taken and its identifiers are used up, so a title goes with the grant below it.

Every known sentence holds one of ``MARKERS``; a text without any of them cannot match and is not cut at all.  Whole texts are
read.  A null or empty text has no identifiers and no licence.  Repeated rows, empty tables and further columns are allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, map_arrow, row_slices

#: Known sentences of public licences, by identifier (fixed values).
SENTENCES = [
    ("mit-note", "Released under the MIT License."),
    ("mit-note", "Licensed under the MIT License."),
    ("mit-note", "This project is licensed under the MIT License."),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-title", "The MIT License"),
    ("mit-title", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("as-is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("no-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-title", "Apache License Version 2.0, January 2004"),
    ("apache-terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("apache-note", "Licensed under the Apache License, Version 2.0."),
    ("apache-note", "This project is licensed under the Apache License, Version 2.0."),
    ("apache-head", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache-use", "you may not use this file except in compliance with the License."),
    ("apache-obtain", "You may obtain a copy of the License at"),
    ("apache-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl3-note", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-note", "Licensed under the GNU General Public License, version 3."),
    ("gpl2-note", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl2-note", "Licensed under the GNU General Public License, version 2."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gpl-fitness", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("gpl3-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl2-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl3-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl21-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl2-title", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("agpl3-title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("lgpl-note", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-note", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl-title", "Mozilla Public License Version 2.0"),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl2-title", "Eclipse Public License - v 2.0"),
    ("epl1-title", "Eclipse Public License - v 1.0"),
    ("epl-agreement", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")."),
    ("epl2-note", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("mpl-head", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-note", "Licensed under the Mozilla Public License, version 2.0."),
    ("bsd-redistribute", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-disclaimer", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd3-title", "BSD 3-Clause License"),
    ("bsd2-title", "BSD 2-Clause License"),
    ("bsd-note", "Licensed under the BSD 3-Clause License."),
    ("bsd2-note", "Licensed under the BSD 2-Clause License."),
    ("isc-title", "ISC License"),
    ("boost-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("boost-note", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("cc0-note", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, licensed as CC0 1.0 Universal."),
    ("cc0-title", "Creative Commons Legal Code CC0 1.0 Universal Public License"),
    ("cc-by-nc-note", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-note", "This work is licensed under CC BY-NC 4.0."),
    ("cc-by-nc-note", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-note", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-note", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-note", "Licensed under CC BY 4.0."),
    ("cc-by-note", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: The GNU notices differ in the name of the licence and its version only.
GNU = [("GPL", "General", ("1", "2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("LGPL", "Library General", ("2",)), ("AGPL", "Affero General", ("3",))]
for _short, _name, _versions in GNU:
    for _v in _versions:
        SENTENCES += [
            (f"{_short}-{_v}-redistribute", f"you can redistribute it and/or modify it under the terms of the GNU {_name} Public License as published by the Free "
                                            f"Software Foundation; either version {_v} of the License, or (at your option) any later version."),
            (f"{_short}-{_v}-only", f"you can redistribute it and/or modify it under the terms of the GNU {_name} Public License version {_v} as published by the "
                                    "Free Software Foundation.")]
    SENTENCES += [("gpl-copy", f"You should have received a copy of the GNU {_name} Public License along with this {_what}.") for _what in ("program", "library")]
    SENTENCES += [("gpl-details", f"See the GNU {_name} Public License for more details.")]

#: Ordered rules: licence, and the identifiers that must follow each other.
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-title", "isc-grant")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-title", "apache-terms")),
    ("Apache-2.0", ("apache-head", "apache-use", "apache-obtain", "apache-as-is")),
    ("Apache-2.0", ("apache-head", "apache-use", "apache-obtain")),
    ("Apache-2.0", ("apache-head", "apache-use")),
    ("Apache-2.0", ("apache-title",)),
    ("BSD-3-Clause", ("bsd3-title", "bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd2-title", "bsd-redistribute", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    *[(f"{short}-{v if '.' in v else v + '.0'}-or-later", (f"{short}-{v}-redistribute", *rest)) for short, _, versions in GNU for v in versions
      for rest in (("gpl-hope", "gpl-fitness", "gpl-details", "gpl-copy"), ("gpl-hope", "gpl-fitness", "gpl-details"), ("gpl-hope",), ())],
    *[(f"{short}-{v if '.' in v else v + '.0'}-only", (f"{short}-{v}-only",)) for short, _, versions in GNU for v in versions],
    *[(licence, (name, *rest)) for licence, name in (("GPL-3.0", "gpl3-title"), ("GPL-2.0", "gpl2-title"), ("LGPL-3.0", "lgpl3-title"), ("LGPL-2.1", "lgpl21-title"),
                                                      ("LGPL-2.0", "lgpl2-title"), ("AGPL-3.0", "agpl3-title")) for rest in (("gpl-verbatim",), ())],
    ("MPL-2.0", ("mpl-head", "mpl-copy")),
    ("MPL-2.0", ("mpl-head",)),
    ("MPL-2.0", ("mpl-title",)),
    ("EPL-2.0", ("epl2-title", "epl-agreement")),
    ("EPL-1.0", ("epl1-title", "epl-agreement")),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-1.0", ("epl1-title",)),
    ("EPL-2.0", ("epl2-note",)),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-note",)),
    ("Zlib", ("zlib-grant",)),
    ("CC0-1.0", ("cc0-title",)),
    ("CC0-1.0", ("cc0-note",)),
    ("MIT", ("mit-note",)),
    ("MIT", ("mit-title",)),
    ("ISC", ("isc-title",)),
    ("Apache-2.0", ("apache-note",)),
    ("GPL-3.0", ("gpl3-note",)),
    ("GPL-2.0", ("gpl2-note",)),
    ("LGPL-3.0", ("lgpl-note",)),
    ("AGPL-3.0", ("agpl-note",)),
    ("MPL-2.0", ("mpl-note",)),
    ("BSD-3-Clause", ("bsd-note",)),
    ("BSD-2-Clause", ("bsd2-note",)),
    ("BSD-3-Clause", ("bsd3-title",)),
    ("BSD-2-Clause", ("bsd2-title",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-note",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-note",)),
    ("CC-BY-4.0", ("cc-by-note",)),
    ("Unlicense", ("unlicense",)),
]

MARKERS = ("licen", "permission", "redistribut", "warrant", "unencumbered", "liable for", "terms and conditions", "of the mpl")
_WORD = re.compile(r"[^\W_]+")
_BORDER = re.compile(r"\n|[.!?;:](?=\s)")


class Scanner:
    """Known sentences and ordered rules, ready to scan texts."""

    def __init__(self, sentences=SENTENCES, rules=RULES, markers=MARKERS):
        self.known: dict[str, list[tuple[tuple[str, ...], str]]] = {}  # by first word, longest sentences first
        for name, s in sentences:
            if not any(m in s.lower() for m in markers):
                raise ValueError(f"known sentence without a marker: {s!r}")
            words = tuple(_WORD.findall(s.lower()))
            self.known.setdefault(words[0], []).append((words, name))
        for same in self.known.values():
            same.sort(key=lambda x: -len(x[0]))
        self.rules, self.markers = rules, markers

    def identifiers(self, text: str | None) -> list[str]:
        """Identifiers of the known sentences of a text, in order."""
        low = (text or "").lower()
        if not any(m in low for m in self.markers):
            return []
        spans = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(low)]
        words = [w for _, _, w in spans]
        after = lambda i: i == len(spans) - 1 or _BORDER.search(low, spans[i][1], spans[i + 1][0] + 1) is not None
        found, i = [], 0
        while i < len(words):
            step = 1
            for want, name in self.known.get(words[i], ()):
                n = len(want)
                if tuple(words[i : i + n]) == want and (i == 0 or after(i - 1)) and after(i + n - 1):
                    found.append(name)
                    step = n
                    break
            i += step
        return found

    def licences(self, ids: list[str]) -> list[str]:
        """Licences by the ordered rules, from left to right."""
        out, i = [], 0
        while i < len(ids):
            for licence, want in self.rules:
                if tuple(ids[i : i + len(want)]) == want:
                    out.append(licence)
                    i += len(want)
                    break
            else:
                i += 1
        return out


def scan_licences(docs: DataFrame, text: str = "text", sentences=SENTENCES, rules=RULES, markers=MARKERS) -> DataFrame:
    """``docs`` with sentence_ids and licences (arrays of string, empty where none)."""
    keep = [c for c in docs.columns if c not in ("sentence_ids", "licences")]
    kind = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules, markers)
        for b in row_slices(batches, text):
            ids = [scanner.identifiers(t) for t in b.column(text).to_pylist()]
            made = [pa.array(ids, kind), pa.array(list(map(scanner.licences, ids)), kind)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made], names=[*keep, "sentence_ids", "licences"])

    return map_arrow(docs, run, extended(docs.schema, sentence_ids="array<string>", licences="array<string>"))
