"""License scans by sentence rules.

A text falls into sentences, once by lines and once with single line ends read as spaces, as licence
texts are often wrapped.  A sentence is normalised (lower case, letters and digits only) and looked up
in a table of known licence sentences; the identifiers found, in order, are a sequence for each reading.
Ordered rules map sequences to licences: a rule names the identifiers that must follow each other in
one of the sequences, whatever other known sentences lie between, and the first rule of a licence that
matches either reading decides whether it is there in full or by notice only.  So a text of several notices
line by line and a wrapped licence gives both.  A known sentence that no rule uses still marks the text as
``partial``.

The tables are constants, so they go into the plan as literals; nothing is joined or shuffled.  Most
texts hold none of the trigger words, at least one of which is in every known sentence, and are not
cut at all.

Defined results: null and empty texts have no licence; repeated rows stay; an empty table gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.llm.common import documents, let

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License",
                   "SPDX-License-Identifier: MIT"],
    "mit-title": ["MIT License", "The MIT License (MIT)"],
    "mit-grant": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions:"""],
    "mit-condition": ["""The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software"""],
    "mit-warranty": ["""THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"""],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", """Licensed under the Apache License, Version 2.0 (the
        "License"); you may not use this file except in compliance with the License""", "Released under the Apache License, Version 2.0",
                      "SPDX-License-Identifier: Apache-2.0"],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-basis": ["""Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"""],
    "apache-limits": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3",
                    "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only",
                    "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl3-grant": ["""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version"""],
    "gpl2-notice": ["Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl2-grant": ["""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
        later version"""],
    "gpl-warranty": ["""This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"""],
    "gpl-details": ["See the GNU General Public License for more details"],
    "bsd-grant": ["""Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met:"""],
    "bsd-source": ["""Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer"""],
    "bsd-binary": ["""Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution"""],
    "bsd-endorse": ["""Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission"""],
    "bsd3-notice": ["SPDX-License-Identifier: BSD-3-Clause"],
    "bsd2-notice": ["SPDX-License-Identifier: BSD-2-Clause"],
    "mpl-notice": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0""",
                   "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
                 "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "lgpl21-notice": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later",
                      "Licensed under the GNU Lesser General Public License, version 2.1"],
    "lgpl21-grant": ["""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version"""],
    "lgpl3-notice": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later",
                     "Licensed under the GNU Lesser General Public License, version 3"],
    "lgpl-warranty": ["""This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"""],
    "lgpl-details": ["See the GNU Lesser General Public License for more details"],
    "agpl3-notice": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
                     "Licensed under the GNU Affero General Public License, version 3"],
    "agpl3-grant": ["""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version"""],
    "agpl-details": ["See the GNU Affero General Public License for more details"],
    "epl2-notice": ["SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License, version 2.0"],
    "epl2-grant": ["""This program and the accompanying materials are made available under the terms of the Eclipse Public License
        2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""],
    "isc-notice": ["SPDX-License-Identifier: ISC", "Licensed under the ISC License"],
    "unlicense-notice": ["SPDX-License-Identifier: Unlicense", "Released under the Unlicense"],
    "isc-grant": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies"""],
    "ccby-notice": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "ccbysa-notice": ["Licensed under CC BY-SA 4.0",
                      "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "ccbync-notice": ["Licensed under CC BY-NC 4.0",
                      "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0-notice": ["Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}
#: Licence, extent, identifiers in their order; the first match of a licence counts.
RULES = (
    ("MIT", "text", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", "notice", ("mit-notice",)),
    ("Apache-2.0", "text", ("apache-notice", "apache-copy", "apache-basis", "apache-limits")),
    ("Apache-2.0", "notice", ("apache-notice",)),
    ("GPL-3.0", "text", ("gpl3-grant", "gpl-warranty", "gpl-details")),
    ("GPL-3.0", "notice", ("gpl3-notice",)),
    ("GPL-3.0", "notice", ("gpl3-grant",)),
    ("GPL-2.0", "text", ("gpl2-grant", "gpl-warranty", "gpl-details")),
    ("GPL-2.0", "notice", ("gpl2-notice",)),
    ("GPL-2.0", "notice", ("gpl2-grant",)),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", "notice", ("bsd3-notice",)),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", "notice", ("bsd2-notice",)),
    ("MPL-2.0", "text", ("mpl-notice", "mpl-copy")),
    ("MPL-2.0", "notice", ("mpl-notice",)),
    ("LGPL-2.1", "text", ("lgpl21-grant", "lgpl-warranty", "lgpl-details")),
    ("LGPL-2.1", "notice", ("lgpl21-notice",)),
    ("LGPL-2.1", "notice", ("lgpl21-grant",)),
    ("LGPL-3.0", "notice", ("lgpl3-notice",)),
    ("AGPL-3.0", "text", ("agpl3-grant", "gpl-warranty", "agpl-details")),
    ("AGPL-3.0", "notice", ("agpl3-notice",)),
    ("AGPL-3.0", "notice", ("agpl3-grant",)),
    ("EPL-2.0", "text", ("epl2-grant",)),
    ("EPL-2.0", "notice", ("epl2-notice",)),
    ("ISC", "text", ("isc-grant",)),
    ("ISC", "notice", ("isc-notice",)),
    ("CC-BY-4.0", "notice", ("ccby-notice",)),
    ("CC-BY-SA-4.0", "notice", ("ccbysa-notice",)),
    ("CC-BY-NC-4.0", "notice", ("ccbync-notice",)),
    ("CC0-1.0", "notice", ("cc0-notice",)),
    ("Unlicense", "text", ("unlicense-grant",)),
    ("Unlicense", "notice", ("unlicense-notice",)),
    ("Proprietary", "notice", ("reserved",)),
)
#: A rule of the longer BSD text rules out the shorter one.
SHADOWED = {"BSD-2-Clause": "BSD-3-Clause"}
TRIGGERS = ("licen", "copyright", "permission", "warrant", "redistribut", "public domain", "derived from", "reserved",
            "of the mpl")

_END = r"(?<=[.!?])\s+"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {normal(s): name for name, sentences in SENTENCES.items() for s in sentences}
#: Known sentences are cut like the texts, so that inner ends ("v. 2.0") do not hide them.
for _name, _sentences in SENTENCES.items():
    for _s in _sentences:
        _parts = [normal(p) for p in re.split(_END, " ".join(_s.split())) if normal(p)]
        if len(_parts) > 1:
            KNOWN[_parts[0]] = _name


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of ``text``, in order."""
    table = F.create_map(*[F.lit(x) for pair in sorted(KNOWN.items()) for x in pair])
    found = F.transform(F.split(text, _END), lambda s: F.element_at(table, _normal(s)))
    return F.filter(found, lambda i: i.isNotNull())


def _rule_found(readings: Column, rule: tuple[str, ...]) -> Column:
    """Whether a reading holds the identifiers of the rule one after the other; those of no rule part do not count."""
    if len(rule) == 1:
        return F.exists(readings, lambda ids: F.array_contains(ids, rule[0]))
    # A sequence is written as ">a>b>c>".
    return F.exists(readings, lambda ids: F.contains(
        F.concat(F.lit(">"), F.array_join(F.filter(ids, lambda i: i.isin(*rule)), ">"), F.lit(">")), F.lit(f">{'>'.join(rule)}>")))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sequence, licenses, extent of every row.

    ``licenses`` are comma-joined in rule order; ``extent`` is the fullest: text, notice, partial, none.
    ``sequence`` is that of the reading with more identifiers.
    """
    text = F.coalesce("text", F.lit(""))
    lower = F.lower(text)
    hit = F.lit(False)
    for word in TRIGGERS:
        hit |= F.contains(lower, F.lit(word))
    by_line = F.regexp_replace(text, r"\s*\n\s*", "\n")
    lines = F.flatten(F.transform(F.split(by_line, "\n"), identifiers))
    wrapped = identifiers(F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t]*\n\s*", ". "), r"\s+", " "))
    none = F.array().cast("array<array<string>>")
    read = docs.select("doc_id", F.when(hit, F.array(lines, wrapped)).otherwise(none).alias("readings"))

    def decide(readings: Column) -> Column:
        matched = {}
        for name, extent, rule in RULES:
            matched[name] = F.coalesce(*[c for c in (matched.get(name), F.when(_rule_found(readings, rule), F.lit(extent)))
                                         if c is not None])
        out = []
        for name, extent in matched.items():
            if name in SHADOWED:
                extent = F.when(matched[SHADOWED[name]].isNull(), extent)
            out.append(F.when(extent.isNotNull(), F.struct(F.lit(name).alias("license"), extent.alias("extent"))))
        return F.filter(F.array(*out), lambda m: m.isNotNull())

    none = F.array().cast("array<struct<license:string,extent:string>>")
    found = F.when(F.exists("readings", lambda ids: F.size(ids) > 0), let(F.col("readings"), decide)).otherwise(none)
    one, two = F.get("readings", 0), F.get("readings", 1)
    fuller = F.when(F.size(one) >= F.size(two), one).when(F.size(two) > 0, two).otherwise(F.array().cast("array<string>"))
    read = read.select("doc_id", fuller.alias("ids"), found.alias("found"))
    extent = (
        F.when(F.exists("found", lambda m: m["extent"] == "text"), "text").when(F.size("found") > 0, "notice")
        .when(F.size("ids") > 0, "partial").otherwise("none")
    )
    return read.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sequence"),
                       F.array_join(F.transform("found", lambda m: m["license"]), ",").alias("licenses"), extent.alias("extent"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole text of ``documents``."""
    return license_scan(documents(spark, sf_dir))


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in sorted(KNOWN.items()))
    first = {}
    for name, extent, rule in RULES:
        only = ", ".join(f"'{i}'" for i in rule)
        held = " OR ".join(
            f"contains('>' || array_to_string(list_filter({r}, lambda i: i IN ({only})), '>') || '>', '>{'>'.join(rule)}>')" for r in "lw")
        first.setdefault(name, []).append(f"WHEN {held} THEN '{extent}'")
    marks = []
    for name, cases in first.items():
        case = f"CASE {' '.join(cases)} END"
        if name in SHADOWED:
            case = f"CASE WHEN (CASE {' '.join(first[SHADOWED[name]])} END) IS NULL THEN {case} END"
        marks.append(f"{{'license': '{name}', 'extent': {case}}}")
    # Java splits after the end mark; the mark is kept by a separator put behind it.
    cut = r"string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    ids = r"list_filter(list_transform({}, lambda s: t[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL)"
    lines = ids.format("flatten(list_transform(string_split(regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g'), chr(10)), lambda l: "
                       + cut.format("l") + "))")
    wrapped = ids.format(cut.format(r"regexp_replace(regexp_replace(text, '[ \t]*\n[ \t]*\n\s*', '. ', 'g'), '\s+', ' ', 'g')"))
    return f"""
WITH k(s, i) AS (VALUES {known}), m AS (SELECT map(list(s), list(i)) AS t FROM k),
     d AS (SELECT doc_id, coalesce(text, '') AS text, t FROM documents, m),
     e AS (SELECT doc_id, {lines} AS l, {wrapped} AS w FROM d),
     f AS (SELECT doc_id, l, w, CASE WHEN len(l) >= len(w) THEN l ELSE w END AS ids FROM e),
     h AS (SELECT doc_id, ids, list_filter([{", ".join(marks)}], lambda x: x.extent IS NOT NULL) AS found FROM f)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sequence,
       array_to_string(list_transform(found, lambda x: x.license), ',') AS licenses,
       CASE WHEN len(list_filter(found, lambda x: x.extent = 'text')) > 0 THEN 'text' WHEN len(found) > 0 THEN 'notice'
            WHEN len(ids) > 0 THEN 'partial' ELSE 'none' END AS extent
FROM h
"""


QUERIES = {"op3_licenses": op3_licenses}
ORACLE = {"op3_licenses": _oracle()}
