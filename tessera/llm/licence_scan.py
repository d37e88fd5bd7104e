"""Operator 2: licence scans by sentence rules, in DataFrame operations only.

Texts are cut into sentences, sentences are normalised (lower case, letters
and digits) and mapped to the identifiers of known licence sentences; a text
is then a sequence of identifiers, 00 for any other sentence. Licence rules
are ordered identifier sequences with a bounded number of other sentences in
between; at each place the first rule of the list that fits wins, so the long
form of a licence goes before its one-line notice.

Three readings of line ends are taken: as sentence ends (notices on a line of
their own), as spaces (hard-wrapped headers), and as spaces but for blank
lines, which end a sentence (whole texts, where a copyright line has no full
stop); the findings are united.
Only texts with an anchor word are cut up: every known sentence contains one.

Defined cases: NULL and empty texts hold no licence; repeated rows are each
scanned; an empty table gives no rows; other columns are ignored.

The oracle SQL has the plain cut of sentences and two readings: it agrees on
one-line notices, not on whole BSD texts or GPL-2.0 and MPL-2.0 headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices (a colon ends a sentence).
SENTENCES = (
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
    "the license",
    "you may obtain a copy of the license at",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
    "on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "released under the mit license",
    "licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement",
    "this work is licensed under the gnu general public license version 3",
    "licensed under the gnu general public license version 3",
    "licensed under the gnu general public license version 2",
    "you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version",
    "you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 2 of the license or at your option any later "
    "version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "you should have received a copy of the gnu general public license along with this program",
    "licensed under cc by nc 4 0",
    "licensed under cc by sa 4 0",
    "licensed under cc by 4 0",
    "licensed under cc0 1 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed",
    "licensed under the bsd 3 clause license",
    "licensed under the bsd 2 clause license",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "licensed under the mozilla public license version 2 0",
    "this is free and unencumbered software released into the public domain",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies",
)
# Ordered rules, identifiers counted from 1 in SENTENCES.
RULES = (
    ("Apache-2.0", (2, 3, 5, 6)), ("Apache-2.0", (2, 4, 5, 6)), ("Apache-2.0", (2, 5)), ("Apache-2.0", (2,)),
    ("Apache-2.0", (1,)),
    ("MIT", (9, 10, 11)), ("MIT", (9, 10)), ("MIT", (7,)), ("MIT", (8,)),
    ("GPL-3.0-or-later", (15, 17, 18, 19)), ("GPL-3.0-or-later", (15, 17)), ("GPL-3.0-or-later", (15,)),
    ("GPL-2.0-or-later", (16, 17, 18, 19)), ("GPL-2.0-or-later", (16, 17)), ("GPL-2.0-or-later", (16,)),
    ("GPL-3.0-only", (12,)), ("GPL-3.0-only", (13,)), ("GPL-2.0-only", (14,)),
    ("CC-BY-NC-4.0", (20,)), ("CC-BY-SA-4.0", (21,)), ("CC-BY-4.0", (22,)), ("CC0-1.0", (23,)),
    ("CC-BY-4.0", (24,)), ("CC-BY-SA-4.0", (25,)), ("CC-BY-NC-4.0", (26,)),
    ("BSD-3-Clause", (27, 28, 29)), ("BSD-2-Clause", (27, 29)), ("BSD-3-Clause", (30,)), ("BSD-2-Clause", (31,)),
    ("MPL-2.0", (32,)), ("MPL-2.0", (33,)), ("Unlicense", (34,)), ("ISC", (35,)),
)
ANCHOR = r"(?i)licen[sc]e|copyright|permission|warrant|public domain|redistribut"
GAP = 3  # other sentences allowed between two of a rule
# Published wordings brought to the stored one before sentences are cut (lower case): names of holders and programs
# vary, "free software;" ends no sentence, "v." would.
AS_STORED = (
    (r"\bv\.[^\w\n]+(?=[0-9])", "v "),
    (r"\bfree[^\w\n]+software[;,:][^\w\n]+you[^\w\n]+can[^\w\n]+redistribute\b", "free software: you can redistribute"),
    (r"\bneither[^\w\n]+the[^\w\n]+name[^\w\n]+of\b[^\n]{1,200}?\bnor[^\w\n]+the[^\w\n]+names?[^\w\n]+of"
     r"[^\w\n]+(?:its|their|any)[^\w\n]+contributors\b",
     "neither the name of the copyright holder nor the names of its contributors"),
    (r"\bthis[^\w\n]+software[^\w\n]+is[^\w\n]+provided[^\w\n]+by[^\w\n]+the\b[^\n]{1,120}?\band[^\w\n]+contributors\b",
     "this software is provided by the copyright holders and contributors"),
)


def rule_pattern(ids: tuple[int, ...], gap: int = GAP) -> str:
    return f"(?:00;){{0,{gap}}}".join(f"{i:02d};" for i in ids)


ALL_RULES = "|".join(rule_pattern(ids) for _, ids in RULES)


def sentences(text: Column, line_end: str) -> Column:
    """Normalised sentences, in order; ``line_end`` replaces line ends. Bare
    list markers (digits or one letter) are no sentences."""
    t = F.regexp_replace(F.lower(text), r"[\r\n]+", line_end)
    for published, stored in AS_STORED:
        t = F.regexp_replace(t, published, stored)
    t = F.regexp_replace(t, r"[.!?:]+(?:\s+|$)", "\n")
    t = F.regexp_replace(t, r"(?m)^[^a-z0-9\n]*(?:[0-9]{1,2}|[a-z])\)\s+", "")
    return F.filter(F.transform(F.split(t, "\n+"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))),
                    lambda s: ~s.rlike("^(?:[0-9]*|[a-z])$"))


def identifiers(text: Column, line_end: str) -> Column:
    """The text as a string of two-digit sentence identifiers, 00 if unknown."""
    known = F.array(*[F.lit(s) for s in SENTENCES])
    ids = F.transform(sentences(text, line_end),
                      lambda s: F.concat(F.lpad(F.array_position(known, s).cast("string"), 2, "0"), F.lit(";")))
    return F.array_join(ids, "")


def licence_of(match: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ids in reversed(RULES):
        out = F.when(match.rlike(f"^(?:{rule_pattern(ids)})$"), F.lit(name)).otherwise(out)
    return out


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``licences`` (names, ascending, comma-joined; empty if none),
    ``n_licences`` and ``n_sentences`` (known sentences, in the first reading)
    for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.when(text.rlike(ANCHOR), text).alias("t"))
    by_line, wrapped = identifiers(F.col("t"), "\n"), identifiers(F.col("t"), " ")
    paragraphs = identifiers(F.regexp_replace("t", r"\r?\n[^\p{L}\p{N}\r\n]*\r?\n", ".\n"), " ")
    rows = rows.select("doc_id", F.coalesce(by_line, F.lit("")).alias("ids"),
                       F.coalesce(wrapped, F.lit("")).alias("wrapped"),
                       F.coalesce(paragraphs, F.lit("")).alias("paragraphs"))
    found = F.concat(*[F.regexp_extract_all(c, F.lit(f"({ALL_RULES})")) for c in ("ids", "wrapped", "paragraphs")])
    names = F.array_sort(F.array_distinct(F.transform(found, licence_of)))
    return rows.select("doc_id", names.alias("names"), "ids").select(
        "doc_id", F.array_join("names", ",").alias("licences"), F.size("names").cast("long").alias("n_licences"),
        (F.length(F.regexp_replace("ids", "00;", "")) / 3).cast("long").alias("n_sentences"))


def oracle_sql() -> str:
    known = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + "]"
    cases = " ".join(f"when regexp_full_match(m, '{rule_pattern(ids)}') then '{name}'" for name, ids in RULES)

    def reading(line_end: str) -> str:
        t = f"regexp_replace(lower(coalesce(text, '')), '[\\r\\n]+', {line_end}, 'g')"
        t = f"regexp_replace({t}, '[.!?:]+(?:[ \\t\\n\\x0B\\f\\r]+|$)', chr(10), 'g')"
        s = f"list_transform(string_split({t}, chr(10)), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')))"
        return (f"list_aggregate(list_transform(list_filter({s}, lambda s: s <> ''), "
                f"lambda s: lpad(coalesce(list_position({known}, s), 0)::varchar, 2, '0') || ';'), 'string_agg', '')")

    return rf"""
with r as (select doc_id, coalesce({reading('chr(10)')}, '') as ids, coalesce({reading("' '")}, '') as wrapped
           from documents),
f as (select doc_id, ids, list_sort(list_distinct(list_transform(
        list_concat(regexp_extract_all(ids, '{ALL_RULES}'), regexp_extract_all(wrapped, '{ALL_RULES}')),
        lambda m: case {cases} end))) as names from r)
select doc_id, coalesce(list_aggregate(names, 'string_agg', ','), '') as licences, len(names)::bigint as n_licences,
       (length(replace(ids, '00;', '')) // 3)::bigint as n_sentences
from f
"""
