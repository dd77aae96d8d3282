"""Licence scans by sentence rules.

A text is cut into sentences, a normalised sentence that is known becomes its
identifier, and the sequence of identifiers is matched against ordered rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Sentences of public licence texts and notices, normalised (lower
# case; everything but a-z and 0-9 is one space).
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    6: "licensed under the apache license version 2 0",
    7: "licensed under the apache license version 2 0 the license",
    8: "you may not use this file except in compliance with the license",
    9: "you may obtain a copy of the license at",
    10: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    11: "see the license for the specific language governing permissions and limitations under the license",
    12: "this work is licensed under the gnu general public license version 3",
    13: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    14: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    15: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    16: "see the gnu general public license for more details",
    17: "licensed under cc by nc 4 0",
    18: "licensed under cc by 4 0",
    19: "licensed under cc by sa 4 0",
    20: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    21: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    22: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    23: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    24: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    25: "this is free and unencumbered software released into the public domain",
    26: "this source code form is subject to the terms of the mozilla public license v",
}

# Each licence by the sentence sequences, in order, that state it.
RULES = {
    "Apache-2.0": [[6], [7, 8, 9], [7, 8, 9, 10, 11]],
    "BSD-2-Clause": [[20, 21, 22]],
    "BSD-3-Clause": [[20, 21, 22, 23]],
    "CC-BY-4.0": [[18]],
    "CC-BY-NC-4.0": [[17]],
    "CC-BY-SA-4.0": [[19]],
    "GPL-2.0-or-later": [[14], [14, 15, 16]],
    "GPL-3.0": [[12]],
    "GPL-3.0-or-later": [[13], [13, 15, 16]],
    "ISC": [[24]],
    "MIT": [[1], [2], [3, 4], [3, 4, 5]],
    "MPL-2.0": [[26]],
    "Unlicense": [[25]],
}
#: Where a longer rule of the first licence holds, the second is part of it.
WITHIN = {"BSD-2-Clause": "BSD-3-Clause"}

# A sentence ends with a mark before white space, or with a blank line; in the
# second reading with every line. Licence texts wrap their lines, notices don't.
WRAPPED = r"[.!?:;]+[\x20\x09-\x0D]+|[.!?:;]+$|[\x0A\x0D][\x20\x09]*[\x0A\x0D][\x20\x09-\x0D]*"
BY_LINE = r"[.!?:;]+[\x20\x09-\x0D]+|[.!?:;]+$|[\x0A\x0D]+"


def sentences(ends: str, column: str = "text") -> Column:
    """Normalised sentences between the given ends."""
    breaks = F.regexp_replace(F.lower(text_of(column)), ends, "|")
    plain = F.trim(F.regexp_replace(breaks, r"[^a-z0-9|]+", " "))
    return F.filter(F.split(plain, r"[ |]*\|[ |]*"), lambda s: s != "")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_sentences, sentence_ids, line_ids, licenses.

    ``sentence_ids`` lists the known sentences in order with lines read on,
    ``line_ids`` with each line read for itself; ``licenses`` names the licences
    of which a rule is a run of either list, comma-separated. All are empty when
    nothing is found. Sentences that aren't known may stand between those of a
    rule. ``n_sentences`` counts by lines. A bar in the text ends a sentence.
    Null and empty texts have no sentences; repeated rows and ids each give a
    row of their own; other columns are ignored. The work is one pass over each
    text, without a shuffle.
    """
    known = F.create_map(*[F.lit(x) for key, text in SENTENCES.items() for x in (text, key)])

    def ids(column: str) -> Column:
        found = F.filter(F.transform(column, lambda s: F.element_at(known, s)), lambda x: x.isNotNull())
        return F.array_join(found.cast("array<string>"), ",")

    rows = docs.select(F.col(id_col).alias("doc_id"), sentences(WRAPPED, text_col).alias("_w"), sentences(BY_LINE, text_col).alias("_l"))
    rows = rows.select("doc_id", F.size("_l").cast("long").alias("n_sentences"), ids("_w").alias("sentence_ids"), ids("_l").alias("line_ids"))

    def holds(name: str, around: Column) -> Column:
        hit = F.lit(False)
        for rule in RULES[name]:
            hit = hit | around.contains("," + ",".join(map(str, rule)) + ",")
        return hit & ~holds(WITHIN[name], around) if name in WITHIN else hit

    around = [F.concat(F.lit(","), F.col(c), F.lit(",")) for c in ("sentence_ids", "line_ids")]
    names = [F.when(holds(name, around[0]) | holds(name, around[1]), F.lit(name)) for name in sorted(RULES)]
    return rows.withColumn("licenses", F.array_join(F.array(*names), ","))
