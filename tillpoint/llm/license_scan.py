"""License scan by sentence rules: known licence sentences, then ordered rules over them.

A text is cut into parts behind sentence marks and at line breaks, and each part is
normalised (lower case, runs of other characters than letters and digits as one blank).  A known
sentence is one part, or several that stand next to each other (it may be wrapped over
lines, or hold a mark itself, as SPDX lines and the GPL notices do); it begins and ends
where parts do, and of two that begin at one place the longer counts.  Sentences are mapped
to identifiers in text order.  An SPDX expression gives the identifiers of its licences.  A
rule is a sequence of identifiers; it matches when the document's identifiers hold it in this
order.  The first matching rule of each licence family names the licence.  Built-in functions
only, no shuffle: each row is judged by itself against tables of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of licence sentences, in normalised form.
SENTENCES = {
    "mit-name": ["mit license", "the mit license", "the mit license mit"],
    "mit-ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
                "distributed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation the "
                  "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                  "persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions "
                   "of the software"],
    "mit-asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the "
                 "warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache-name": ["apache license"],
    "apache-ref": ["licensed under the apache license version 2 0", "released under the apache license version 2 0",
                   "this work is licensed under the apache license version 2 0",
                   "licensed under the apache license version 2 0 the license"],
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-asis": ["unless required by applicable law or agreed to in writing software distributed under the license is "
                    "distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the "
                  "following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the "
                   "following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                   "following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission"],
    "bsd-ref": ["licensed under the bsd license", "released under the bsd license",
                "licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "bsd2-ref": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "gpl3-ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public "
                 "license version 3", "released under the gnu general public license version 3", "licensed under the gnu gpl v3"],
    "gpl2-ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public "
                 "license version 2", "released under the gnu general public license version 2"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                 "license as published by the free software foundation either version 3 of the license or at your option any "
                 "later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                  "public license as published by the free software foundation either version 2 of the license or at your option "
                  "any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the "
                     "implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl-ref": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public "
                 "license version 2 1"],
    "agpl-ref": ["licensed under the gnu affero general public license version 3"],
    "mpl-ref": ["this source code form is subject to the terms of the mozilla public license v 2 0",
                "licensed under the mozilla public license version 2 0"],
    "cc-by-nc-nd": ["licensed under cc by nc nd 4 0", "this work is licensed under cc by nc nd 4 0"],
    "cc-by-nc-sa": ["licensed under cc by nc sa 4 0", "this work is licensed under cc by nc sa 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "released under cc by nc 4 0",
                 "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "released under cc by sa 4 0",
                 "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "released under cc by 4 0",
              "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0": ["licensed under cc0 1 0", "this work is licensed under cc0 1 0", "released under cc0 1 0",
            "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
                  "granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
    "apache-title": ["apache license version 2 0", "apache license version 2 0 january 2004"],
    "isc-name": ["isc license", "the isc license"],
    "lgpl-free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
                  "license as published by the free software foundation either version 2 1 of the license or at your option any later "
                  "version", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
                  "general public license as published by the free software foundation either version 3 of the license or at your "
                  "option any later version"],
}

#: SPDX identifiers in normalised form, by family.
SPDX = {
    "mit": ["mit"], "apache": ["apache 2 0"], "bsd": ["bsd 3 clause"], "bsd2": ["bsd 2 clause"], "isc": ["isc"], "mpl": ["mpl 2 0"],
    "gpl3": ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"], "gpl2": ["gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"],
    "lgpl": ["lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"],
    "agpl": ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"], "bsl": ["bsl 1 0"], "epl": ["epl 2 0"], "cc0": ["cc0 1 0"],
    "unlicense": ["unlicense"],
}
SPDX_HEAD = "spdx license identifier"
SENTENCES |= {f"spdx-{name}": [f"{head} {i}" for i in ids for head in (SPDX_HEAD, "license")] for name, ids in SPDX.items()}

#: Ordered rules (family, licence, identifiers in order); the first of a family wins.
RULES = (
    ("mit", "MIT", ["mit-grant", "mit-notice", "mit-asis"]), ("mit", "MIT", ["mit-name", "mit-grant"]),
    ("mit", "MIT", ["mit-ref"]), ("mit", "MIT", ["spdx-mit"]),
    ("apache", "Apache-2.0", ["apache-ref", "apache-use", "apache-copy", "apache-asis"]),
    ("apache", "Apache-2.0", ["apache-name", "apache-use"]), ("apache", "Apache-2.0", ["apache-title"]),
    ("apache", "Apache-2.0", ["apache-ref"]),
    ("apache", "Apache-2.0", ["spdx-apache"]),
    ("bsd", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("bsd", "BSD-2-Clause", ["bsd2-ref"]),
    ("bsd", "BSD-3-Clause", ["bsd-ref"]), ("bsd", "BSD-2-Clause", ["spdx-bsd2"]), ("bsd", "BSD-3-Clause", ["spdx-bsd"]),
    ("gpl", "GPL-3.0", ["gpl-free", "gpl-warranty"]), ("gpl", "GPL-2.0", ["gpl2-free", "gpl-warranty"]),
    ("gpl", "GPL-3.0", ["gpl3-ref"]), ("gpl", "GPL-2.0", ["gpl2-ref"]),
    ("gpl", "GPL-3.0", ["spdx-gpl3"]), ("gpl", "GPL-2.0", ["spdx-gpl2"]),
    ("lgpl", "LGPL", ["lgpl-ref"]), ("lgpl", "LGPL", ["lgpl-free"]), ("lgpl", "LGPL", ["spdx-lgpl"]),
    ("agpl", "AGPL-3.0", ["agpl-ref"]), ("agpl", "AGPL-3.0", ["spdx-agpl"]), ("mpl", "MPL-2.0", ["mpl-ref"]),
    ("mpl", "MPL-2.0", ["spdx-mpl"]),
    ("cc", "CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]), ("cc", "CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]), ("cc", "CC-BY-NC-4.0", ["cc-by-nc"]),
    ("cc", "CC-BY-SA-4.0", ["cc-by-sa"]), ("cc", "CC-BY-4.0", ["cc-by"]), ("cc0", "CC0-1.0", ["cc0"]), ("cc0", "CC0-1.0", ["spdx-cc0"]),
    ("isc", "ISC", ["isc-grant"]), ("isc", "ISC", ["isc-name"]), ("isc", "ISC", ["spdx-isc"]), ("bsl", "BSL-1.0", ["spdx-bsl"]),
    ("epl", "EPL-2.0", ["spdx-epl"]), ("unlicense", "Unlicense", ["unlicense"]), ("unlicense", "Unlicense", ["spdx-unlicense"]),
    ("reserved", "All-rights-reserved", ["reserved"]),
)
#: Every known sentence holds one of these words, so texts without them need no split.
CUES = ("licens", "copyright", "permission", "redistribut", "software", "rights", "warrant", "released")

#: Where parts end: behind a mark that white space follows, and at line breaks.
PART_END = r"[.!?:;]+\s+|\s*\n\s*"
#: Stands twice between two parts, so each has one of its own on either side.
MARK = "\x01"


def _cue() -> str:
    return f"(?i){'|'.join(CUES)}"


def _pattern() -> str:
    """Known sentences between marks, the longest first; an SPDX line is an expression."""
    gap = f"(?: |{MARK}{MARK})"
    ids = "|".join(gap.join(i.split()) for i in sorted((i for v in SPDX.values() for i in v), key=len, reverse=True))
    one = f"(?:{ids})(?: with [a-z0-9 ]+ exception(?: [0-9]+)*)?"
    line = gap.join(SPDX_HEAD.split()) + gap + one + f"(?: (?:or|and) {one})*"
    forms = sorted((f for v in SENTENCES.values() for f in v), key=lambda f: (-len(f.split()), f))
    return f"{MARK}({line}|{'|'.join(gap.join(f.split()) for f in forms)}){MARK}"


def marked(body: Column) -> Column:
    """The normalised parts of a text, two marks between any two and one at least at its ends."""
    parts = F.regexp_replace(F.regexp_replace(F.lower(body), PART_END, MARK), f"[^a-z0-9{MARK}]+", " ")
    inner = F.regexp_replace(F.btrim(parts, F.lit(f" {MARK}")), f" *{MARK}[ {MARK}]*", MARK + MARK)
    return F.concat(F.lit(MARK + MARK), inner, F.lit(MARK + MARK))


def _ids(body: Column) -> Column:
    """Identifiers of the known sentences, in the text's order."""
    known = F.create_map(*(F.lit(v) for name, forms in SENTENCES.items() for s in forms for v in (s, name)))
    found = F.transform(F.regexp_extract_all(marked(body), F.lit(_pattern()), 1), lambda s: F.regexp_replace(s, f"{MARK}+", " "))

    def of(s):
        # "gpl 3 0 or later" holds no operator
        rest = F.regexp_replace(F.substring(s, len(SPDX_HEAD) + 2, 1 << 20), " or later", " orlater")
        rest = F.split(F.regexp_replace(rest, " with [a-z0-9 ]+? exception( [0-9]+)*", ""), " (?:or|and) ")
        spdx = F.transform(rest, lambda i: F.try_element_at(known, F.concat(F.lit(SPDX_HEAD + " "), F.regexp_replace(i, " orlater", " or later"))))
        return F.when(s.startswith(SPDX_HEAD + " "), spdx).otherwise(F.array(F.try_element_at(known, s)))

    return F.array_compact(F.flatten(F.transform(found, of)))


def _licences(sequence: Column) -> Column:
    """Licences of the rules that match in the string ``,id,id,``, one for each family."""
    found = []
    for family in dict.fromkeys(f for f, _, _ in RULES):
        case = None
        for f, licence, ids in RULES:
            if f == family:
                hit = sequence.rlike("," + ",(.*,)?".join(ids) + ",")
                case = F.when(hit, licence) if case is None else case.when(hit, licence)
        found.append(case)
    return F.array_compact(F.array(*found))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, sentence_ids, licences, n_sentences``.

    Identifiers come in text order and repeat as the sentences do.  Both strings are
    comma-joined; licences keep the rules' order.  Null, empty and licence-free texts give
    empty strings and 0.  Ids may be null or repeat; extra columns are ignored; empty input
    gives no rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(F.col(id).alias("doc_id"), F.when(body.rlike(_cue()), body).alias("body"))
    two = one.select("doc_id", F.when(F.col("body").isNotNull(), _ids(F.col("body"))).otherwise(F.array().cast("array<string>")).alias("ids"))
    three = two.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_sentences"))
    return three.select("doc_id", "sentence_ids", F.array_join(_licences(F.concat(F.lit(","), "sentence_ids", F.lit(","))), ",")
                        .alias("licences"), "n_sentences")


def _case(family: str) -> str:
    when = " ".join(f"when regexp_matches(seq, ',{',(.*,)?'.join(ids)},') then '{licence}'" for f, licence, ids in RULES if f == family)
    return f"case {when} end"


_VALUES = ", ".join(f"('{s}', '{name}')" for name, forms in SENTENCES.items() for s in forms)
_FAMILIES = ", ".join(_case(f) for f in dict.fromkeys(f for f, _, _ in RULES))

_RE = lambda t: t.replace(MARK, r"\x01")

SQL = f"""
with known(s, name) as (values {_VALUES}),
d as (select doc_id, coalesce(text, '') as body, row_number() over () as r from documents),
m as (select r, chr(1) || chr(1) || regexp_replace(trim(regexp_replace(regexp_replace(lower(body), '{PART_END}', chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g'), ' ' || chr(1)),
        ' *\\x01[ \\x01]*', chr(1) || chr(1), 'g') || chr(1) || chr(1) as n from d where regexp_matches(body, '{_cue()}')),
f as (select r, list_transform(regexp_extract_all(n, '{_RE(_pattern())}', 1), lambda s: regexp_replace(s, '\\x01+', ' ', 'g')) as found from m),
p as (select r, unnest(found) as s, generate_subscripts(found, 1) as i from f),
e as (select r, i, case when starts_with(s, '{SPDX_HEAD} ') then list_transform(string_split_regex(regexp_replace(regexp_replace(
        substr(s, {len(SPDX_HEAD) + 2}), ' or later', ' orlater', 'g'), ' with [a-z0-9 ]+? exception( [0-9]+)*', '', 'g'), ' (?:or|and) '),
        lambda x: '{SPDX_HEAD} ' || replace(x, ' orlater', ' or later')) else [s] end as parts from p),
u as (select r, i, unnest(parts) as s, generate_subscripts(parts, 1) as j from e),
q as (select r, string_agg(name, ',' order by i, j) as ids, count(*) as n from u join known using (s) group by r),
z as (select doc_id, coalesce(ids, '') as sentence_ids, coalesce(n, 0) as n_sentences, ',' || coalesce(ids, '') || ',' as seq
      from d left join q using (r))
select doc_id, sentence_ids, array_to_string(list_filter([{_FAMILIES}], lambda x: x is not null), ',') as licences, n_sentences from z
"""
