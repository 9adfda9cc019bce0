"""License scans by conditional compression: a piece that a template's text makes much smaller is compared with it word by word."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brolga.llm.common import table, worker_cache

_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_NOTICE = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
#: License texts, the headers that files carry for longer ones, and the short notices that stand for them, by
#: SPDX identifier. The full texts of longer licenses can be given as further templates.
TEMPLATES = {
    "MIT": [
        f"{_MIT_GRANT}{_MIT_NOTICE} {_DISCLAIMER}",
        f"{_MIT_GRANT}{_MIT_NOTICE}",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
    ],
    "MIT-0": [f"{_MIT_GRANT}. {_DISCLAIMER}"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "licensed under the GNU General Public License, version 2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "licensed under the GNU General Public License, version 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "licensed under the GNU Lesser General Public License, version 2.1",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "licensed under the GNU Lesser General Public License, version 3",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "licensed under the GNU Affero General Public License, version 3",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "BSD-2-Clause": [f"{_BSD} {_BSD_DISCLAIMER}", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [f"{_BSD} {_BSD_NAMES} {_BSD_DISCLAIMER}", f"{_BSD} {_BSD_NAMES}", "Licensed under the BSD 3-Clause License."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ],
    "ISC": [
        f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "0BSD": [f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_DISCLAIMER}"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "licensed under a Creative Commons Zero 1.0 Universal License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
}
#: Words of which every template has one, and so every candidate piece.
CUES = r"licen[cs]e|copyright|permission|redistribut|warrant|public domain|creative commons|free software"
#: Words of the templates of a class, at most; its pieces are twice as long and overlap by half, so each template lies whole in one.
CLASSES = (20, 80, 320)
#: Least part of its own compressed size that a template saves in a piece; share of its words that may differ.
LEAST, DIFFERING = 0.15, 0.1
#: A template of up to so many words must be there word by word, and is looked for wherever it saves anything.
SHORT = 20
LEVEL = 9

_CUE = re.compile(CUES, re.I)
_WORD = re.compile(r"\w+(?:\.\w+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    """Compressors for each template, whose words are the dictionary. Templates longer than the last class make one of their own."""

    def __init__(self, templates: dict[str, list[str]] | None = None):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.known: dict[int, list[tuple]] = {}
        for name, texts in (templates or TEMPLATES).items():
            for k, text in enumerate(texts):
                own = words(text)
                if not _CUE.search(text):
                    raise ValueError(f"template {name}/{k} has none of the cue words")
                data = " ".join(own).encode()
                raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size = next((c for c in CLASSES if len(own) <= c), len(own))
                one = f"{name}/{k}", zstandard.ZstdCompressor(level=LEVEL, dict_data=raw), own, len(self.plain.compress(data))
                self.known.setdefault(size, []).append(one)

    def pieces(self, n: int, cues: list[int], size: int) -> Iterator[tuple[int, int]]:
        """(first, past) of the pieces of a text of n words that hold a cue at one of the (sorted) words."""
        for first in range(0, max(1, n - size), size):
            past = min(n, first + 2 * size)
            at = bisect_left(cues, first)
            if at < len(cues) and cues[at] < past:
                yield first, past

    def ranked(self, piece: list[str], size: int) -> list[tuple[float, str, list[str]]]:
        """(part of a template's size that it saves, template, its words) of the templates of a class, the most first."""
        data = " ".join(piece).encode()
        alone = len(self.plain.compress(data))
        return sorted((((alone - len(c.compress(data))) / whole, name, own) for name, c, own, whole in self.known[size]), key=lambda x: (-x[0], x[1]))

    def differences(self, template: list[str], piece: list[str]) -> tuple[int, int, int, int, str] | None:
        """(template words missing, words between them that it has not, first and past word, what differs) where a piece says it.

        The longest common stretch places the template; it is compared with the words that can belong to it there. None if
        more than DIFFERING of its words are missing (none may be, in a short one), if a missing one has a digit (it may be
        the version), or if there are more than DIFFERING words between.
        """
        if len(template) <= SHORT:
            at = next((k for k in range(len(piece) - len(template) + 1) if piece[k : k + len(template)] == template), None)
            return None if at is None else (0, 0, at, at + len(template), "")
        most = int(DIFFERING * len(template))
        seed = SequenceMatcher(None, template, piece, autojunk=False).find_longest_match()
        low = max(0, seed.b - seed.a - most)
        near = piece[low : seed.b - seed.a + len(template) + most]
        found = [m for m in SequenceMatcher(None, template, near, autojunk=False).get_matching_blocks() if m.size]
        if not found:
            return None
        said = sum(m.size for m in found)
        first, past = found[0].b, found[-1].b + found[-1].size
        missing, extra = len(template) - said, past - first - said
        if max(missing, extra) > most:
            return None
        at, out = 0, []
        for m, before in zip(found, [None, *found], strict=False):
            if m.a > at:
                out.append("-" + " ".join(template[at : m.a]))
            if before is not None and m.b > before.b + before.size:
                out.append("+" + " ".join(near[before.b + before.size : m.b]))
            at = m.a + m.size
        if at < len(template):
            out.append("-" + " ".join(template[at:]))
        if any(c.isdigit() for x in out if x[0] == "-" for c in x):
            return None
        return missing, extra, low + first, low + past, "; ".join(out)

    def scan(self, text: str | None) -> list[dict]:
        """Of each license in a text the place that says it best: the longest template, fewest words differing, then the first.

        Where the texts of two licenses are confirmed at one place, the one with more differences goes, if it is not longer.
        """
        if not text or not _CUE.search(text):
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        said = [text[a:b].lower() for a, b in spans]
        starts = [a for a, _ in spans]
        cues = sorted({max(0, bisect_left(starts, m.start() + 1) - 1) for m in _CUE.finditer(text)})
        confirmed: dict[tuple[str, int, int], tuple] = {}
        for size in self.known:
            for first, past in self.pieces(len(said), cues, size):
                piece = said[first:past]
                for saved, name, own in self.ranked(piece, size):
                    if saved <= 0 or (size > SHORT and saved < LEAST):
                        break
                    found = self.differences(own, piece)
                    if found:
                        missing, extra, a, b, told = found
                        confirmed.setdefault((name, first + a, first + b), (missing + extra, len(own), saved, missing, extra, told))
        best: dict[str, tuple] = {}
        order = sorted(confirmed.items(), key=lambda x: x[0][1])
        for (name, a, b), (off, n, saved, missing, extra, told) in order:
            licence = name.split("/")[0]
            if off and any(x < b and a < y and o < off and m >= 0.8 * n and other.split("/")[0] != licence for (other, x, y), (o, m, *_) in order):
                continue
            key = (-n, off, a, -saved)
            if licence not in best or key < best[licence][0]:
                at = spans[a][0], spans[b - 1][1]
                best[licence] = key, dict(licence=licence, template=name, first=at[0], last=at[1], saved=saved, missing=missing, extra=extra, differences=told)
        return [row for _, (_, row) in sorted(best.items())]


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each license that a text states: doc_id, licence, template, first, last, saved, missing, extra, differences.

    Texts are cut into overlapping pieces of words, long enough for the templates of a class (CLASSES), whatever their lines.
    Pieces with a cue word (CUES; each template must have one) are compressed alone and with each template of the class as
    raw dictionary. Every template that saves LEAST of its own size (a short one: anything) is compared word by word, the one
    that saves most first, and kept if the piece says its words in order with few differences: none in a short one. saved is
    that part, first and last are the letters where it stands, missing and extra count words, differences names them. Of two
    licenses confirmed at one place, the one with more differences is left out, unless its template is much longer.
    A license has one row for each text: its longest template confirmed, with the fewest words missing, at the first place.
    templates adds to or replaces (by name) the built-in ones. Only texts with a cue leave the JVM, whole; nothing is
    shuffled. Null and empty texts state nothing; repeated rows and null ids are scanned like any other.
    """

    def scan(texts: pd.Series) -> pd.Series:
        kept = worker_cache("licences")
        if kept.get("of") != templates or "scanner" not in kept:
            kept.update({"of": templates, "scanner": Scanner(TEMPLATES | (templates or {}))})
        return pd.Series([kept["scanner"].scan(t) for t in texts])

    told = F.pandas_udf(scan, "array<struct<licence string, template string, first int, last int, saved double, missing int, extra int, differences string>>")
    cued = docs.select("doc_id", "text").where(F.col("text").rlike(f"(?i){CUES}"))
    return cued.select("doc_id", F.explode(told("text")).alias("x")).select("doc_id", "x.*")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
