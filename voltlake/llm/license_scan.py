"""Licence notices and texts in documents.

A text is scanned by lines, by paragraphs (runs of lines that are not blank), as a whole, and by windows. A unit is
normalised (ASCII lower case, runs of other than letters and digits to one space) and compared to licence templates by
the Dice coefficient over word-bigram multisets, 2 * |A and B| / (|A| + |B|). Dice of t needs
|A| * t / (2 - t) <= |B| <= |A| * (2 - t) / t, so a unit meets only the templates within these bounds. A text larger
than a template meets it in windows too, of the template's size, each starting an eighth of it after the last, and
one at the end: so a notice amid a longer line, and a licence quoted whole in a larger text, are found. Templates of
near licences (versions of one family) all match a notice of one of them; of matches that overlap only the best
counts: the larger coefficient, then the larger template, the earlier unit, the smaller licence id.

Templates are notices and headers of licences by version, built from names and wordings, short licences in full, and
the full texts in the folder `licences` (read on the driver, shipped with the tasks).

Edge cases: null, empty and blank texts match nothing; units under two words have no bigram and match nothing; rows
are judged one by one, repeated or not; columns named license_id, dice, line_no, n_matches are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read

#: Licences by version, as their notices call them.
NAMES = (
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-1.1", "Apache Software License, Version 1.1"), ("GPL-1.0", "GNU General Public License, version 1"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-2.0", "GNU GPL v2"), ("GPL-3.0", "GNU General Public License, version 3"), ("GPL-3.0", "GNU General Public License v3.0"), ("GPL-3.0", "GNU GPL v3"),
    ("LGPL-2.0", "GNU Library General Public License, version 2"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-2.1", "GNU Lesser General Public License v2.1"), ("LGPL-2.1", "GNU LGPL v2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License v3.0"), ("LGPL-3.0", "GNU LGPL v3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License v3.0"), ("AGPL-3.0", "GNU AGPL v3"), ("GFDL-1.2", "GNU Free Documentation License, Version 1.2"), ("GFDL-1.3", "GNU Free Documentation License, Version 1.3"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-4-Clause", "BSD 4-Clause License"), ("ISC", "ISC License"), ("0BSD", "Zero-Clause BSD License"), ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("Unlicense", "Unlicense"), ("WTFPL", "Do What The Fuck You Want To Public License, Version 2"),
    ("MPL-1.1", "Mozilla Public License, Version 1.1"), ("MPL-2.0", "Mozilla Public License, v. 2.0"), ("EPL-1.0", "Eclipse Public License v1.0"), ("EPL-2.0", "Eclipse Public License v2.0"), ("CDDL-1.0", "Common Development and Distribution License, Version 1.0"), ("EUPL-1.2", "European Union Public Licence, Version 1.2"), ("Artistic-2.0", "Artistic License 2.0"), ("MS-PL", "Microsoft Public License"), ("OFL-1.1", "SIL Open Font License, Version 1.1"), ("PSF-2.0", "Python Software Foundation License Version 2"), ("ODbL-1.0", "Open Database License v1.0"),
)
#: Creative Commons licences: code and words of the name.
COMMONS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
#: Wordings of notices.
WORDINGS = ("Licensed under the {}.", "This work is licensed under the {}.", "This program is licensed under the {}.", "This project is licensed under the terms of the {}.", "Released under the {}.", "Distributed under the terms of the {}.")
#: The header that the GNU licences ask for.
GNU_HEADER = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
GNU_ONLY = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the {2} as published by the Free Software Foundation{3} version {4} of the License."
GNU_REST = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {2} for more details."
GNU = (("GPL-1.0", "program", "GNU General Public License", "1"), ("GPL-2.0", "program", "GNU General Public License", "2"), ("GPL-3.0", "program", "GNU General Public License", "3"), ("LGPL-2.0", "library", "GNU Library General Public License", "2"), ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "program", "GNU Affero General Public License", "3"))
#: Short licences in full, without the copyright line.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "{}. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AD = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_END = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
SHORT = (
    ("BSD-2-Clause", _BSD + _BSD_1 + _BSD_2 + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_1 + _BSD_2 + _BSD_3.format(3) + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_1 + _BSD_2 + _BSD_3.format(3)), ("BSD-4-Clause", _BSD + _BSD_1 + _BSD_2 + _BSD_AD + _BSD_3.format(4) + _BSD_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + _ISC_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: http://scripts.sil.org/OFL"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("GFDL-1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation"),
)
#: Other notices as commonly written in documents and source headers.
_NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
FOLDER = Path(__file__).resolve().parent / "licences"


def _built() -> tuple[tuple[str, str], ...]:
    out = list(_NOTICES) + list(SHORT)
    out += [("MIT", _NOTICES[2][1] + _MIT_END), ("ISC", _NOTICES_BY["ISC"] + _ISC_END)]
    out += [(i, w.format(name)) for i, name in NAMES for w in WORDINGS]
    out += [(i, f"SPDX-License-Identifier: {x}") for i in dict.fromkeys(i for i, _ in NAMES) for x in ((i, i + "-only", i + "-or-later") if "GPL" in i or "GFDL" in i else (i,))]
    for code, words in COMMONS:
        for v, end in (("3.0", "Unported"), ("4.0", "International")):
            out += [(f"CC-{code}-{v}", x) for x in (f"Licensed under CC {code} {v}.", f"This work is licensed under CC {code} {v}.", f"This work is licensed under a Creative Commons {words} {v} {end} License.", f"Licensed under the Creative Commons {words} {v} {end} License.", f"SPDX-License-Identifier: CC-{code}-{v}")]
    for i, thing, name, version in GNU:
        for mark, stop in ((":", ","), (";", ";")):
            for what in dict.fromkeys((thing, "program", "file")):
                for shape in (GNU_HEADER, GNU_ONLY):
                    out += [(i, shape.format(what, mark, name, stop, version)), (i, (shape + GNU_REST).format(what, mark, name, stop, version))]
    seen: dict[tuple[str, tuple[str, ...]], tuple[str, str]] = {}
    for i, text in out:
        seen.setdefault((i, tuple(_TOKEN.findall(text.lower()))), (i, text))
    return tuple(seen.values())


THRESHOLD, STRIDE = 0.8, 8
_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_NOTICES_BY = dict(_NOTICES)
TEMPLATES = _built()


@functools.cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """The licences of the folder, by the names of their files."""
    return tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted(FOLDER.glob("*.txt")))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def bigrams(text: str) -> Counter:
    found = tokens(text)
    return Counter(zip(found, found[1:]))


class Matcher:
    """Templates by size, and by bigram."""

    def __init__(self, templates=None, threshold: float = THRESHOLD):
        templates = TEMPLATES + full_texts() if templates is None else templates
        self.threshold, self.ids = threshold, [t[0] for t in templates]
        self.grams = [bigrams(t[1]) for t in templates]
        self.sizes = [sum(g.values()) for g in self.grams]
        self.low = [n * threshold / (2 - threshold) - 1e-9 for n in self.sizes]
        self.high = [n * (2 - threshold) / threshold + 1e-9 for n in self.sizes]
        self.most, self.least = max(self.high), min(self.low)
        self.by_gram = defaultdict(list)
        for i, g in enumerate(self.grams):
            for gram, n in g.items():
                self.by_gram[gram].append((i, n))

    def _reached(self, hits: Counter, n: int) -> list[tuple[float, int]]:
        """(coefficient, template) of every template that n bigrams reach, hits of them in templates."""
        common: dict[int, int] = defaultdict(int)
        for gram, k in hits.items():
            for i, m in self.by_gram[gram]:
                if self.low[i] <= n <= self.high[i]:
                    common[i] += min(k, m)
        scored = ((2 * c / (n + self.sizes[i]), i) for i, c in common.items())
        return [x for x in scored if x[0] >= self.threshold - 1e-12]

    def best(self, unit: str) -> list[tuple[float, str]]:
        """(coefficient, licence) of every template that the unit reaches."""
        found = tokens(unit)
        hits = Counter(g for g in zip(found, found[1:]) if g in self.by_gram)
        return [(c, self.ids[i]) for c, i in self._reached(hits, len(found) - 1)]

    def _windows(self, hit: list[int], grams: list[tuple[str, str]]) -> list[tuple[float, int, int, int]]:
        """(coefficient, first token, end, template) of windows; hit: the places of bigrams that templates have."""
        n, total = len(grams), Counter(grams[p] for p in hit)
        common: dict[int, int] = defaultdict(int)
        for gram, k in total.items():
            for i, m in self.by_gram[gram]:
                common[i] += min(k, m)
        out = []
        for i, c in common.items():
            size = self.sizes[i]
            if n <= size or c < self.threshold * size - 1e-9:
                continue
            own, step, need = self.grams[i], max(1, size // STRIDE), math.ceil(self.threshold * size - 1e-9)
            at = [p for p in hit if grams[p] in own]
            starts = set()  # a window needs so many hits: it starts no later than one, and ends after the last of them
            for p, q in zip(at, at[need - 1 :]):
                if q - p < size:
                    starts.update(range(-(-max(0, q - size + 1) // step) * step, min(p, n - size - 1) + 1, step))
                    if q - size < n - size <= p:
                        starts.add(n - size)
            left = right = got = 0
            inside: Counter = Counter()
            for s in sorted(starts):
                while right < len(at) and at[right] < s + size:
                    g = grams[at[right]]
                    inside[g] += 1
                    got += inside[g] <= own[g]
                    right += 1
                while left < right and at[left] < s:
                    g = grams[at[left]]
                    got -= inside[g] <= own[g]
                    inside[g] -= 1
                    left += 1
                if got >= self.threshold * size - 1e-9:
                    out.append((got / size, s, s + size + 1, i))
        return out

    def scan(self, text: str | None) -> list[tuple[float, int, str]]:
        """(coefficient, line number from 0, licence) of every match that no better one overlaps."""
        text = text or ""
        found = tokens(text)
        grams = list(zip(found, found[1:]))
        hit = [p for p, g in enumerate(grams) if g in self.by_gram]
        if len(hit) < self.least:
            return []
        lines, ends = text.split("\n"), []
        total = 0
        for line in lines:
            total += len(tokens(line))
            ends.append(total)  # tokens never span lines
        starts = [0, *ends[:-1]]
        units = [(i, i + 1) for i in range(len(lines))]
        first = 0
        for i, line in enumerate([*lines, ""]):
            if not line.strip():
                if i - first > 1:
                    units.append((first, i))
                first = i + 1
        if len(lines) > 1 and (0, len(lines)) not in units:
            units.append((0, len(lines)))
        matches = []
        for a, b in units:
            s, e = starts[a], ends[b - 1]
            if self.least <= e - s - 1 <= self.most:
                own = hit[bisect_left(hit, s) : bisect_left(hit, e - 1)]
                if len(own) >= self.least:
                    matches += [(c, s, e, a, i) for c, i in self._reached(Counter(grams[p] for p in own), e - s - 1)]
        matches += [(c, s, e, bisect_right(ends, s), i) for c, s, e, i in self._windows(hit, grams)]
        key = lambda m: (-round(m[0], 12), -self.sizes[m[4]], m[1], self.ids[m[4]])
        matches = sorted(set(matches), key=lambda m: (*key(m), m[3], m[4]))
        taken, kept = bytearray(len(found)), []
        for _, group in groupby(matches, key):
            group = list(group)
            kept += [m for m in group if taken.find(1, m[1], m[2]) < 0]
            for _, s, e, _, _ in group:
                taken[s:e] = b"\x01" * (e - s)
        return [(c, line, self.ids[i]) for c, _, _, line, i in kept]


def scan_licenses(df: DataFrame, text_col: str = "text", templates=None, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) with license_id (best match or null), its dice and line_no, and n_matches: how many licences match."""
    keep = [c for c in keep or df.columns if c not in ("license_id", "dice", "line_no", "n_matches")]
    templates = TEMPLATES + full_texts() if templates is None else templates

    def run(batches):
        matcher = Matcher(templates, threshold)
        for batch in batches:
            best = []
            for text in batch.column(len(keep)):
                found = matcher.scan(text.as_py())
                c, line, name = found[0] if found else (None, None, None)
                best.append((name, c, line, len({x[2] for x in found})))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([x[i] for x in best], k) for i, k in enumerate(kinds))], names=[*keep, "license_id", "dice", "line_no", "n_matches"])

    return map_arrow(df.select(*keep, F.col(text_col).alias("__text")), run, "license_id string, dice double, line_no long, n_matches long", keep)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "license_id", F.round("dice", 9).alias("dice"), "line_no", "n_matches")


def _sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(TEMPLATES + full_texts()))
    toks = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    t = THRESHOLD
    return rf"""
WITH template(tid, lic, txt) AS (VALUES {rows}),
tw AS (SELECT tid, lic, {toks.format('txt')} AS w FROM template),
tg AS (SELECT tid, lic, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM tw),
tc AS (SELECT tid, lic, size, gram, count(*) AS n FROM tg GROUP BY ALL),
line AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
lw AS (SELECT *, len({toks.format('line')}) AS k, regexp_matches(line, '^\s*$') AS b FROM line),
placed AS (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM lw),
unit AS (
  SELECT doc_id, pos, upto - k AS a, upto AS e FROM placed
  UNION ALL SELECT doc_id, min(pos), min(upto - k), max(upto) FROM placed WHERE NOT b GROUP BY doc_id, g HAVING count(*) > 1
  UNION ALL SELECT doc_id, 0, 0, max(upto) FROM placed GROUP BY doc_id HAVING count(*) > 1),
dw AS (SELECT doc_id, {toks.format("coalesce(text, '')")} AS w FROM documents),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram, unnest(range(0, len(w) - 1)) AS p, len(w) - 1 AS total FROM dw WHERE len(w) > 1),
hit AS (SELECT doc_id, p, gram, tid, size, n, total FROM dg JOIN tc USING (gram)),
near AS (SELECT doc_id, tid, size, any_value(total) AS total FROM (SELECT doc_id, tid, size, gram, any_value(total) AS total, least(count(*), any_value(n)) AS c FROM hit GROUP BY ALL) GROUP BY ALL HAVING sum(c) >= {t} * size - 1e-9 OR sum(c) >= size * {t} / (2 - {t}) * {t} - 1e-9),
span AS (
  SELECT DISTINCT u.doc_id, u.pos, u.a, u.e, n.tid, n.size FROM unit u JOIN near n ON u.doc_id = n.doc_id AND u.e - u.a - 1 BETWEEN n.size * {t} / (2 - {t}) - 1e-9 AND n.size * (2 - {t}) / {t} + 1e-9
  UNION ALL SELECT doc_id, NULL, s, s + size + 1, tid, size FROM (SELECT doc_id, tid, size, unnest(list_distinct(list_concat(range(0, total - size, greatest(1, size // {STRIDE})), [total - size]))) AS s FROM near WHERE total > size)),
met AS (SELECT s.doc_id, s.pos, s.a, s.e, s.tid, s.size, h.gram, least(count(*), any_value(h.n)) AS c FROM span s JOIN hit h ON h.doc_id = s.doc_id AND h.tid = s.tid AND h.p >= s.a AND h.p < s.e - 1 GROUP BY ALL),
score AS (SELECT doc_id, pos, a, e, tid, size, 2.0 * sum(c) / (e - a - 1 + size) AS dice FROM met GROUP BY doc_id, pos, a, e, tid, size HAVING 2.0 * sum(c) / (e - a - 1 + size) >= {t} - 1e-12),
named AS (SELECT x.*, round(dice::DOUBLE, 12) AS d, lic, coalesce(x.pos, (SELECT min(p.pos) FROM placed p WHERE p.doc_id = x.doc_id AND p.upto > x.a)) AS line_no FROM score x JOIN tw USING (tid)),
kept AS (SELECT * FROM named m WHERE NOT EXISTS (SELECT 1 FROM named x WHERE x.doc_id = m.doc_id AND x.a < m.e AND m.a < x.e AND (-x.d, -x.size, x.a, x.lic) < (-m.d, -m.size, m.a, m.lic))),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d DESC, size DESC, a, lic, line_no) AS r FROM kept),
num AS (SELECT doc_id, count(DISTINCT lic) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, b.lic AS license_id, round(b.dice::DOUBLE, 9) AS dice, b.line_no::BIGINT AS line_no, coalesce(num.n, 0)::BIGINT AS n_matches
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id AND b.r = 1 LEFT JOIN num ON d.doc_id = num.doc_id
"""


OP3_SQL = _sql()
