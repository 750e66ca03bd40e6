"""Licences by known sentences and ordered rules, with DataFrame functions alone.

Comment marks at the beginnings of lines go, wrapped lines are joined, and the text is cut
into sentences at blank lines and after sentence marks. Sentences are normalised (lower
case, letters and digits only) and the known licence sentences in them, as whole runs of
words, are mapped to identifiers; SPDX tags are sentences of their own. What is found, in
the text's order, is a sequence of identifiers. A rule is such a sequence too, and holds
where it occurs in order, other known sentences between being allowed. Several licences
can hold for a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrilith.llm.common import let

#: Well-known licence sentences in their normalised forms, and the identifiers they map to.
SENTENCES = {
    # Apache
    "licensed under the apache license version 2 0": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-2-use",
    "you may obtain a copy of the license at": "apache-2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2-see",
    # MIT
    "mit license": "mit-title",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit-rights",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability": "mit-liability",
    # ISC
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits": "isc-liability",
    # BSD
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-4-advertising",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-names",
    "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "be liable for any direct indirect incidental special exemplary or consequential damages": "bsd-liability",
    # GNU
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later",
    "under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-2-only",
    "under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl-3-only",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "licensed under the gnu general public license version 3": "gpl-3-notice",
    "licensed under the gnu general public license version 2": "gpl-2-notice",
    "gnu general public license version 3": "gpl-3-title",
    "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-2-1-later",
    "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-later",
    "licensed under the gnu lesser general public license version 3": "lgpl-3-notice",
    "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-later",
    "licensed under the gnu affero general public license version 3": "agpl-3-notice",
    "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "see the gnu affero general public license for more details": "agpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "you should have received a copy of the gnu lesser general public license along with": "lgpl-copy",
    "you should have received a copy of the gnu affero general public license along with": "agpl-copy",
    # Mozilla, Eclipse, Boost
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2-copy",
    "are made available under the terms of the eclipse public license v 2 0": "epl-2-notice",
    "are made available under the terms of the eclipse public license 2 0": "epl-2-notice",
    "distributed under the boost software license version 1 0": "boost-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost-grant",
    "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software": "boost-condition",
    # zlib
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    # public domain
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "dedicate any and all copyright interest in the software to the public domain": "unlicense-dedication",
    "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law": "cc0-notice",
    # Creative Commons
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4-notice",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-notice",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-notice",
    # none
    "all rights reserved": "rights-reserved",
}
#: Names of licences in SPDX tags.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
#: Licence and sentence sequence of each rule, longest sequences of a licence first.
RULES = [
    ("Apache-2.0", ("apache-2-notice", "apache-2-use", "apache-2-copy", "apache-2-warranty", "apache-2-see")),
    ("Apache-2.0", ("apache-2-notice", "apache-2-use", "apache-2-copy")),
    ("Apache-2.0", ("apache-2-notice",)),
    ("MIT", ("mit-grant", "mit-rights", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("ISC", ("isc-grant", "isc-warranty", "isc-liability")),
    ("ISC", ("isc-grant",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-4-advertising", "bsd-3-names", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-3-names", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-3-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-warranty")),
    ("GPL-3.0-or-later", ("gpl-3-later", "gnu-warranty", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later", "gnu-warranty", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("GPL-3.0-only", ("gpl-3-only",)),
    ("GPL-3.0-only", ("gpl-3-notice",)),
    ("GPL-2.0-only", ("gpl-2-only",)),
    ("GPL-2.0-only", ("gpl-2-notice",)),
    ("LGPL-3.0-or-later", ("lgpl-3-later", "gnu-warranty", "lgpl-see", "lgpl-copy")),
    ("LGPL-3.0-or-later", ("lgpl-3-later",)),
    ("LGPL-2.1-or-later", ("lgpl-2-1-later", "gnu-warranty", "lgpl-see", "lgpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl-2-1-later",)),
    ("LGPL-3.0-only", ("lgpl-3-notice",)),
    ("AGPL-3.0-or-later", ("agpl-3-later", "gnu-warranty", "agpl-see", "agpl-copy")),
    ("AGPL-3.0-or-later", ("agpl-3-later",)),
    ("AGPL-3.0-only", ("agpl-3-notice",)),
    ("MPL-2.0", ("mpl-2-notice", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2-notice",)),
    ("EPL-2.0", ("epl-2-notice",)),
    ("BSL-1.0", ("boost-grant", "boost-condition")),
    ("BSL-1.0", ("boost-notice",)),
    ("Zlib", ("zlib-warranty", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Unlicense", ("unlicense-notice", "unlicense-grant", "unlicense-dedication")),
    ("Unlicense", ("unlicense-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    *((name, (f"spdx-{name.lower()}",)) for name in SPDX),
    ("Proprietary", ("rights-reserved",)),
]
#: Rules that don't hold where another licence's does: their sequence is part of that one's, or says less.
YIELDS = {"BSD-3-Clause": ("BSD-4-Clause",), "BSD-2-Clause": ("BSD-3-Clause", "BSD-4-Clause"), "Proprietary": tuple(dict.fromkeys(name for name, _ in RULES if name != "Proprietary"))}
#: A text with a known sentence holds one of these.
_HINT = r"(?i)licen[sc]|copyright|rights reserved|redistribut|permission|public domain|warrant|liable|this software|source distribution|misrepresented|the mpl|anyone is free|spdx"
#: Marks of comments at a line's beginning.
_COMMENT = r"(?m)^[\x20\t]*(?://+|/\*+|\*+/|\*+|#+|--+|;+|<!--|%+|dnl\b)[\x20\t]*"
_TAG = r"(?i)(SPDX-License-Identifier:[^\r\n]*)"
#: Sentence ends: blank lines, and marks before white space and a capital letter, a quote or a bracket.
_END = r"\r?\n[\x20\t]*\r?\n|(?<=[.!?])\s+(?=[\p{Lu}\"'(\[])"
_KNOWN = r"(?<![a-z0-9])(?:" + "|".join(sorted(SENTENCES, key=len, reverse=True)) + r")(?![a-z0-9])"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in order."""
    known = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    names = F.array(*(F.lit(x.lower()) for x in SPDX))
    lines = F.regexp_replace(F.regexp_replace(text, _COMMENT, ""), _TAG, "\n\n$1\n\n")

    def tagged(s: Column) -> Column:
        """The names in a tag's expression; exceptions and brackets don't count."""
        named = F.split(F.regexp_replace(F.lower(F.substring_index(s, ":", -1)), r"[()*/]|\bwith\s+\S+|-->", " "), r"\s+(?:and|or)\s+")
        plain = F.transform(named, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^((?:a|l)?gpl-[0-9.]+)\+$", "$1-or-later"), r"^((?:a|l)?gpl-[0-9.]+)$", "$1-only"))
        return F.transform(F.filter(plain, lambda x: F.array_contains(names, x)), lambda x: F.concat(F.lit("spdx-"), x))

    def ids(s: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(normalised(s), F.lit(_KNOWN), F.lit(0)), lambda x: F.try_element_at(known, x))
        return F.when(s.rlike(r"(?i)^\s*SPDX-License-Identifier:"), tagged(s)).otherwise(runs)

    return F.when(text.rlike(_HINT), F.flatten(F.transform(F.split(lines, _END), ids))).otherwise(F.array().cast("array<string>"))


def _holds(ids: Column, rule: tuple[str, ...]) -> Column:
    """Whether the identifiers of a rule stand in `ids` in its order, with or without others between.

    One pass whose state is how much of the rule has been seen: linear however often its
    sentences repeat.
    """
    first = F.array_contains(ids, rule[0])
    if len(rule) == 1:
        return first
    names = F.array(*map(F.lit, rule))
    seen = F.aggregate(ids, F.lit(0), lambda at, x: F.when(x == F.get(names, at), at + 1).otherwise(at))
    return first & (seen == len(rule))


def _yielding(name: str, others: tuple[str, ...]):
    """Takes `name` from an array that holds one of `others`."""
    return lambda names: F.when(F.arrays_overlap(names, F.array(*map(F.lit, others))), F.array_remove(names, name)).otherwise(names)


def scan(docs: DataFrame, text_col: str = "text", sentences: str = "license_sentences", licenses: str = "licenses") -> DataFrame:
    """`docs` with two more columns: the identifiers of known sentences, and the licences whose rules hold, in the order of RULES.

    Both are empty for a null or empty text, and an empty table gives an empty one. All
    rows and columns stay, repeated rows too; a column of either name in `docs` stops the call.
    """
    if clash := {sentences, licenses} & set(docs.columns):
        raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")
    found = docs.withColumn(sentences, sentence_ids(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    names = F.array_distinct(F.array_compact(F.array(*(F.when(_holds(F.col(sentences), rule), F.lit(name)) for name, rule in RULES))))
    for name, others in YIELDS.items():
        names = let(names, _yielding(name, others))
    return found.withColumn(licenses, F.when(F.size(sentences) > 0, names).otherwise(F.array().cast("array<string>")))
