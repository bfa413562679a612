"""Licences by name: near ones told apart, notices amid longer text, whole texts; and the query against its SQL."""

from pathlib import Path

import pandas as pd
import pytest

from voltlake.llm import license_scan as l

DIR = Path("/root/testdata/sf0.01")
GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
LESSER = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion {} of the License, or (at your option) any later version."
BSD = """Copyright (c) 2020, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
THIRD = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
NOISE = "The river ran past the stone and the cloud was over the field for a long time that day. "


@pytest.fixture(scope="module")
def matcher():
    return l.Matcher()


@pytest.mark.parametrize(
    "want, text",
    [("GPL-1.0", GNU.format("GNU General Public License", 1)), ("GPL-2.0", GNU.format("GNU General Public License", 2)), ("GPL-3.0", GNU.format("GNU General Public License", 3)), ("AGPL-3.0", GNU.format("GNU Affero General Public License", 3)),
     ("LGPL-2.1", LESSER.format("2.1")), ("LGPL-3.0", LESSER.format("3")), ("LGPL-2.0", LESSER.format("2").replace("Lesser", "Library")), ("GPL-3.0", "Licensed under the GNU GPL v3"), ("GPL-2.0", "Licensed under the GNU GPL v2"),
     ("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD + THIRD), ("Apache-2.0", "licensed under the APACHE license, version 2.0"), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."), ("CC-BY-SA-3.0", "This work is licensed under CC BY-SA 3.0."),
     ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("EPL-2.0", "Released under the Eclipse Public License v2.0."), ("LGPL-2.1", "// SPDX-License-Identifier: LGPL-2.1-or-later")],
)
def test_by_name(matcher, want, text):
    for page in (text, f"{NOISE}\n\n{text}\n\n{NOISE}\n", NOISE * 3 + text.replace("\n", " ") + " " + NOISE * 3):
        found = matcher.scan(page)
        assert found and found[0][2] == want and {x[2] for x in found} == {want}, found[:3]


def test_every_template_and_full_text_names_its_licence(matcher):
    assert len({i for i, _ in l.TEMPLATES}) >= 40 and len(l.full_texts()) == 13
    for name, text in l.full_texts():
        for page in (text, NOISE * 40 + "\n\n" + text + "\n\n" + NOISE * 40):
            assert matcher.scan(page)[0][2] == name
    for name, text in l.TEMPLATES:
        found = matcher.scan(text)
        assert found[0][0] == pytest.approx(1.0) and name in {x[2] for x in found}


def test_several_licences_and_none(matcher):
    text = f"Licensed under the MIT License.\n{NOISE}\nLicensed under the Apache License, Version 2.0.\n{NOISE}"
    assert {x[2] for x in matcher.scan(text)} == {"MIT", "Apache-2.0"}
    assert matcher.scan(NOISE * 500) == [] and matcher.scan("you can redistribute the water of the river under the bridge") == []
    many = ("Licensed under the MIT License.\n" + NOISE + "\n") * 3000
    assert len(matcher.scan(many)) == 3000


def test_windows_against_every_start(matcher):
    """A window found by hits is one of all windows at the stride, and the other way round."""
    text = NOISE * 2 + LESSER.format("2.1") + NOISE + "Licensed under the GNU GPL v3 " + NOISE
    words = l.tokens(text)
    grams = list(zip(words, words[1:]))
    hit = [p for p, g in enumerate(grams) if g in matcher.by_gram]
    want = set()
    for i, (own, size) in enumerate(zip(matcher.grams, matcher.sizes)):
        if len(grams) > size:
            for s in {*range(0, len(grams) - size, max(1, size // l.STRIDE)), len(grams) - size}:
                c = sum((l.Counter(grams[s : s + size]) & own).values())
                if c >= 0.8 * size - 1e-9:
                    want.add((c / size, s, s + size + 1, i))
    assert set(matcher._windows(hit, grams)) == want and want


def test_through_spark(spark):
    rows = [(1, "Released under the MIT License.", "x", 2.0), (1, "Released under the MIT License.", "x", 2.0), (None, None, None, None), (2, "", "y", 0.0), (3, " \n\n\t", None, None), (4, "word " * 200_000 + "\nLicensed under CC BY 4.0.", "z", 1.0), (5, "one", "q", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string, dice double")
    out = sorted(((r["doc_id"] or 0, r["license_id"], r["line_no"], r["n_matches"]) for r in l.scan_licenses(df).collect()), key=str)
    assert out == [(0, None, None, 0), (1, "MIT", 0, 1), (1, "MIT", 0, 1), (2, None, None, 0), (3, None, None, 0), (4, "CC-BY-4.0", 1, 1), (5, None, None, 0)]
    assert l.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.skipif(not DIR.exists(), reason="no test tables")
def test_sql_on_awkward_texts(spark):
    duckdb = pytest.importorskip("duckdb")
    docs = pd.read_parquet(DIR / "documents.parquet", columns=["doc_id", "text"]).iloc[:150]
    more = [BSD, BSD + THIRD, LESSER.format("2.1"), NOISE * 3 + GNU.format("GNU General Public License", 2) + NOISE, l.full_texts()[0][1], f"a\n\n\n{LESSER.format(3)}\n\n", "Licensed under the MIT License. " * 5, "", None]
    docs = pd.concat([docs, pd.DataFrame({"doc_id": range(10**6, 10**6 + len(more)), "text": more})])
    con = duckdb.connect()
    con.register("documents", docs)
    want = sorted(map(str, con.sql(l.OP3_SQL).fetchall()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    from pyspark.sql import functions as F

    found = l.scan_licenses(df, keep=["doc_id"]).select("doc_id", "license_id", F.round("dice", 9), "line_no", "n_matches").collect()
    assert sorted(str(tuple(r)) for r in found) == want
