"""Line quality, license scan and WARC: against their SQL twins and small cases."""

import base64
import hashlib
import tempfile

import pytest
from check_oracle import compare, duck
from conftest import SMOKE
from tests.llm.conftest import ODD, words

from tillpoint.llm import license_scan, line_quality, queries, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    status, message = compare(spark, duck(SMOKE), name, queries.QUERIES[name], queries.ORACLE[name], SMOKE)
    assert status == "ok", message


def repeated_words(w):
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)})


def test_base_counts_of_odd_rows(odd):
    got = line_quality.judge(odd).collect()
    assert len(got) == len(ODD)
    expected = []
    for i, t in ODD:
        w = words(t, lower=False)
        lines = [x for x in (t or "").split("\n") if words(x)]
        n, rep = len(w), repeated_words(w)
        failed = n < 50 or 100 * rep > 50 * n
        expected.append((i, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep, failed))
    order = lambda rows: sorted(rows, key=str)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert order(tuple(r[c] for c in cols) for r in got) == order(expected)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert line_quality.judge(odd.limit(0)).collect() == []


def test_line_rules(spark):
    good = "This is a sentence about things that were done on that day by all of them. " * 2
    lines = {"good": good.strip(), "menu": "Home | News | About | Contact | Shop | Help.", "loud": "WOW!! BUY!! NOW!! THIS!! IS!! IT!!",
             "symbols": "a%%% b### c$$$ d*** e&&& f%%%.", "legal": "All rights reserved.", "open": "no end of a sentence here"}
    text = "\n".join(lines.values())
    filler = " ".join(f"w{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(1, text + "\n" + filler), (2, "\n".join([lines["symbols"]] * 3 + [" ".join(["x%%%"] * 60)]))],
                               "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_quality.judge(df).collect()}
    assert got[1]["clean_text"] == lines["good"] + "\n" + filler and got[1]["kept"]
    assert got[2]["clean_text"] == "" and not got[2]["kept"]


def test_licenses(spark):
    mit = ("The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and\n"
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without\n"
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the\n"
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n")
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
           "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
           "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
           "the following disclaimer in the documentation and/or other materials provided with the distribution.")
    rows = [(1, mit), (2, bsd), (3, "Some text\nLicensed under CC BY-NC 4.0.\nMore"), (4, "No licence at all."), (5, None), (6, ""),
            (7, "Released under the MIT License. All rights reserved."), (8, "licensed under the apache license, version 2.0!")]
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "MIT", 2: "BSD-2-Clause", 3: "CC-BY-NC-4.0", 4: "", 5: "", 6: "", 7: "MIT,All-rights-reserved", 8: "Apache-2.0"}


GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as\n"
       "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n"
       "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of\n"
       "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
LGPL = ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
        "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.")
MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0."
LICENSE_CASES = {
    "// SPDX-License-Identifier: MIT\nint main;": ("spdx-mit", "MIT"), "License: MIT": ("spdx-mit", "MIT"),
    "SPDX-License-Identifier: MIT OR Apache-2.0": ("spdx-mit,spdx-apache", "MIT,Apache-2.0"),
    "# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause)\ncode": ("spdx-gpl2,spdx-bsd", "BSD-3-Clause,GPL-2.0"),
    "SPDX-License-Identifier: LGPL-2.1-only": ("spdx-lgpl", "LGPL"), "SPDX-License-Identifier: ISC": ("spdx-isc", "ISC"),
    "SPDX-License-Identifier: AGPL-3.0-or-later": ("spdx-agpl", "AGPL-3.0"), "SPDX-License-Identifier: BSL-1.0\n": ("spdx-bsl", "BSL-1.0"),
    "SPDX-License-Identifier: EPL-2.0": ("spdx-epl", "EPL-2.0"), "SPDX-License-Identifier: Unknown-9": ("", ""),
    GPL: ("gpl-free,gpl-warranty", "GPL-3.0"), LGPL: ("lgpl-free", "LGPL"), MPL: ("mpl-ref", "MPL-2.0"),
    "   Apache License\n   Version 2.0, January 2004\n   http://x": ("apache-title", "Apache-2.0"),
    # parts of a sentence that don't stand next to each other are no sentence
    "License\nThis is proprietary software.\nMIT is a university.\nMIT\n": ("", ""), "MIT": ("", ""), "MIT\nSome license text.": ("", ""),
    # text order, repeats
    "All rights reserved. Released under the MIT License.\nAll rights reserved.": ("reserved,mit-ref,reserved", "MIT,All-rights-reserved"),
    # a rule's order is the text's
    GPL.split("\n\n")[1] + "\n\n" + GPL.split("\n\n")[0]: ("gpl-warranty,gpl-free", ""),
    "\x01License:\x01 MIT\x01 software \x01": ("spdx-mit", "MIT"),
}


def test_licence_sentences_over_marks_and_lines(spark):
    import duckdb
    rows = list(enumerate(LICENSE_CASES))
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert {r[0]: r[1:3] for r in con.execute(license_scan.SQL).fetchall()} == got
    for i, text in rows:
        assert got[i] == LICENSE_CASES[text], text


def test_licenses_of_odd_rows(odd):
    got = license_scan.scan(odd).collect()
    assert len(got) == len(ODD) and {r["n_sentences"] for r in got} == {0}
    assert license_scan.scan(odd.limit(0)).collect() == []


def test_every_known_sentence_is_normalised_and_has_a_cue():
    import re
    for forms in license_scan.SENTENCES.values():
        for s in forms:
            assert re.sub("[^a-z0-9]+", " ", s).strip() == s
            assert any(c in s for c in license_scan.CUES), s
    assert {i for _, _, ids in license_scan.RULES for i in ids} <= set(license_scan.SENTENCES)


def test_warc_round_trip_with_magic_in_payloads_and_tiny_splits(spark):
    m = warc.MAGIC
    fake = m + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["a" * 900, None, "", fake * 3, "x" + fake + "y", m, m * 3 + "\r\n\r\n", fake * 3, "é" * 50, "", "b\r\n\r\n",
            m + "Content-Length: 99999\r\n\r\n" + "q" * 1200]
    rows = [(i, f"http://x/{i}", h, i) for i, h in enumerate(html)] + [(None, None, "zz", 1), (None, "u", "zz", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int").coalesce(2)
    first, expected = {}, []
    for i, _, h, _ in rows:
        if i is not None:
            first.setdefault((h or "").encode(), i)
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = i is not None and first[b] != i
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                         first[b] if again else None))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = warc.round_trip(df, tempfile.mkdtemp() + "/w").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert warc.round_trip(df.limit(0), tempfile.mkdtemp() + "/w").collect() == []


def test_warc_chain_ends_at_a_damaged_record(spark):
    d = tempfile.mkdtemp()
    record = lambda body: (f"{warc.MAGIC}WARC-Type: response\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n").encode()
    with open(f"{d}/a.warc", "wb") as f:
        f.write(record("one") + record("two") + warc.MAGIC.encode() + b"Content-Length: x\r\n\r\n" + record("lost"))
    with open(f"{d}/b.warc", "wb") as f:
        f.write(b"junk" + record("one"))
    got = warc.read_warc(spark, d).collect()
    assert sorted((r["offset"], r["block_bytes"]) for r in got) == [(0, 3), (len(record("one")), 3)]


GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version %s of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""


def test_notices_with_marks_inside(spark):
    cases = {GPL % 3: "GPL-3.0", (GPL % 2).replace("software:", "software;"): "GPL-2.0", MPL: "MPL-2.0", "License: MIT": "MIT",
             "License: Apache 2.0": "Apache-2.0"}
    spdx = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause",
            "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0",
            "MPL-2.0": "MPL-2.0"}
    for name, licence in spdx.items():
        cases[f"SPDX-License-Identifier: {name}"] = licence
        cases[f"#!/bin/sh\n// SPDX-License-Identifier: {name}\nimport os\n"] = licence
        cases[f"SPDX-License-Identifier:{name}"] = licence
    cases["This software needs version 2.0"] = ""
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_repeated_page_ids_keep_their_payloads(spark):
    rows = [(1, "u", "same"), (2, "u", "other"), (3, "u", "same"), (3, "u", "its own"), (3, "u", "other")]
    got = warc.records(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode(), r["refers_to"] or 0) for r in got) == [
        (1, "same", 0), (2, "other", 0), (3, "its own", 0), (3, "other", 2), (3, "same", 1)]
