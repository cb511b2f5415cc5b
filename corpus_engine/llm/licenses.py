"""License scans by recognising sentences.

A text is normalised to lower-case words between separators: a blank, a line end, a semicolon (for `:` and `;`) or a full
stop (a closing mark before white space, or an empty line). Marks of comments at the ends of lines are no words and so
vanish. A known sentence is found where its words stand between two separators other than blanks; between its own words
stands anything but a full stop, so that hard-wrapped and commented texts are read like others. What is found
maps to the sentence's identifier, and the sequence of identifiers of a text is matched against ordered licence rules:
the rule's identifiers in order, up to `gap` other known sentences between them. Where a matched rule lies within a
longer one that is of the same licence or has all its sentences, the longer one is reported.

In the table below a full stop is one within a sentence, [words] may be absent and {a|b} is either. Null or empty text: no licence. Repeated rows of an id count
once, and so do rows without an id. A null id is kept. Sentences are told apart at any length; whole texts are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences as words, from the published licence texts and their usual notices (fixed values).
SENTENCES = {
    "apache_notice": "{licensed|released} under the apache license version 2 0 [the license]",
    "apache_spdx": "spdx license identifier apache 2 0",
    "apache_limits": "you may not use this file except in compliance with the license",
    "apache_notice_limits": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at [{http|https} www apache org licenses license 2 0]",
    "apache_url": "{http|https} www apache org licenses license 2 0",
    "apache_asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_language": "see the license for the specific language governing permissions and limitations under the license",
    "mit_notice": "{released|licensed|distributed} under the [terms of the] mit license",
    "mit_spdx": "spdx license identifier mit",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so [subject to the following conditions]",
    "mit_condition": "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software",
    "mit_asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc_grant": "permission to use copy modify and {or|and or} distribute this software for any purpose with or without fee is hereby granted [provided that the above copyright notice and this permission notice appear in all copies]",
    "isc_asis": "the software is provided as is and {the author|isc} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "[3] neither the name of [the] {copyright holder|copyright holders|author|university} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_advert": "[3] all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd_notice": "{released|licensed|distributed} under the [terms of the] bsd license",
    "bsd2_spdx": "spdx license identifier bsd 2 clause",
    "bsd3_spdx": "spdx license identifier bsd 3 clause",
    "gpl2_spdx": "spdx license identifier gpl 2 0 {only|or later}",
    "gpl3_notice": "this {work|program|software} is licensed under the gnu general public license version 3",
    "gpl2_notice": "this {work|program|software} is licensed under the gnu general public license version 2",
    "gpl3_spdx": "spdx license identifier gpl 3 0 {only|or later}",
    "gpl3_free": "{this program|this file|it} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "{this program|this file|it} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl21_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_free": "{this library|this program} is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "{this program|this library|this file} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_details": "see the gnu [lesser|affero] general public license for more details",
    "mpl2_notice": "this source code form is subject to the terms of the mozilla public license v.2 0",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at {http|https} mozilla org mpl 2 0",
    "epl2_notice": "this program and the accompanying materials are made available under the terms of the eclipse public license {2 0|v 2 0|v.2 0} [which is available at {http|https} www eclipse org legal epl 2 0]",
    "zlib_asis": "this software is provided as is without any express or implied warranty",
    "zlib_liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost_notice": "distributed under the boost software license version 1 0",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_any": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0_notice": "{this work is|} {licensed|released} under [the] {cc0 1 0|creative commons zero v1 0 universal|cc0 1 0 universal} [license]",
    "ccbync_notice": "licensed under cc by nc 4 0",
    "ccbysa_notice": "licensed under cc by sa 4 0",
    "ccby_short": "licensed under cc by 4 0",
    "ccby_notice": "this work is licensed under {a|the} creative commons attribution 4 0 international license",
    "ccbysa_long": "this work is licensed under {a|the} creative commons attribution sharealike 4 0 international license",
    "ccbync_long": "this work is licensed under {a|the} creative commons attribution noncommercial 4 0 international license",
}


@dataclass(frozen=True)
class LicenceRule:
    license: str
    family: str
    sentences: tuple[str, ...]


RULES = (
    LicenceRule("Apache-2.0", "notice", ("apache_notice",)),
    LicenceRule("Apache-2.0", "tag", ("apache_spdx",)),
    LicenceRule("Apache-2.0", "header", ("apache_notice_limits", "apache_copy", "apache_asis", "apache_language")),
    LicenceRule("Apache-2.0", "split header", ("apache_notice", "apache_limits", "apache_asis", "apache_language")),
    LicenceRule("Apache-2.0", "limits", ("apache_limits", "apache_copy", "apache_asis")),
    LicenceRule("MIT", "notice", ("mit_notice",)),
    LicenceRule("MIT", "tag", ("mit_spdx",)),
    LicenceRule("MIT", "text", ("mit_grant", "mit_condition", "mit_asis")),
    LicenceRule("MIT", "full text", ("mit_grant", "mit_condition", "mit_asis", "mit_liable")),
    LicenceRule("ISC", "text", ("isc_grant",)),
    LicenceRule("ISC", "full text", ("isc_grant", "isc_asis")),
    LicenceRule("BSD-2-Clause", "text", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_asis")),
    LicenceRule("BSD-2-Clause", "tag", ("bsd2_spdx",)),
    LicenceRule("BSD-3-Clause", "text", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name", "bsd_asis")),
    LicenceRule("BSD-3-Clause", "tag", ("bsd3_spdx",)),
    LicenceRule("BSD-4-Clause", "text", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advert")),
    LicenceRule("BSD", "notice", ("bsd_notice",)),
    LicenceRule("GPL-2.0", "notice", ("gpl2_notice",)),
    LicenceRule("GPL-2.0", "tag", ("gpl2_spdx",)),
    LicenceRule("GPL-2.0-or-later", "text", ("gpl2_free", "gpl_hope")),
    LicenceRule("GPL-3.0", "notice", ("gpl3_notice",)),
    LicenceRule("GPL-3.0", "tag", ("gpl3_spdx",)),
    LicenceRule("GPL-3.0-or-later", "text", ("gpl3_free", "gpl_hope")),
    LicenceRule("LGPL-2.1-or-later", "text", ("lgpl21_free", "gpl_hope")),
    LicenceRule("LGPL-3.0-or-later", "text", ("lgpl3_free", "gpl_hope")),
    LicenceRule("AGPL-3.0-or-later", "text", ("agpl3_free", "gpl_hope")),
    LicenceRule("MPL-2.0", "notice", ("mpl2_notice",)),
    LicenceRule("MPL-2.0", "full notice", ("mpl2_notice", "mpl2_copy")),
    LicenceRule("EPL-2.0", "notice", ("epl2_notice",)),
    LicenceRule("Zlib", "text", ("zlib_asis", "zlib_liable", "zlib_grant")),
    LicenceRule("BSL-1.0", "notice", ("boost_notice",)),
    LicenceRule("BSL-1.0", "text", ("boost_grant",)),
    LicenceRule("Unlicense", "text", ("unlicense_free", "unlicense_any")),
    LicenceRule("CC0-1.0", "notice", ("cc0_notice",)),
    LicenceRule("CC-BY-NC-4.0", "notice", ("ccbync_notice",)),
    LicenceRule("CC-BY-NC-4.0", "long notice", ("ccbync_long",)),
    LicenceRule("CC-BY-SA-4.0", "notice", ("ccbysa_notice",)),
    LicenceRule("CC-BY-SA-4.0", "long notice", ("ccbysa_long",)),
    LicenceRule("CC-BY-4.0", "notice", ("ccby_short",)),
    LicenceRule("CC-BY-4.0", "long notice", ("ccby_notice",)),
)
GAP = 2
#: For each rule the numbers of the longer rules that are reported instead of it.
ABOVE = [[n for n, o in enumerate(RULES) if len(o.sentences) > len(r.sentences) and (o.license == r.license or set(o.sentences) > set(r.sentences))] for r in RULES]
#: One of these stands in every known sentence; texts without any are not normalised.
SIGNS = r"(?iu)licen[cs]e|permission|permitted|warrant|redistribut|copyright|public\P{L}+domain|this\P{L}+software|of\P{L}+the\P{L}+mpl|advertising\P{L}+materials|released\P{L}+under"
WORD = r"\p{L}\p{N}"
OPEN, CLOSE = "", ""


def normalised(text: Column) -> Column:
    """The text as words and separators. Every step is linear: runs of marks are matched from their start only."""
    sep = "[ .!?:;\n]"
    steps = (
        (rf"[^{WORD}.!?:;\n]+", " "),
        (rf"(?<=[{WORD}])[.!?:;](?=[{WORD}])", " "),  # within numbers and addresses
        (rf"(?<!{sep})[ :;\n]*+[.!?]{sep}*+", "."),
        (rf"(?<!{sep})[ :;]*+\n[ :;]*+\n{sep}*+", "."),
        (rf"(?<!{sep})[ \n]*+[:;][ :;\n]*+", ";"),
        (rf"(?<!{sep}) ?\n ?", "\n"),
    )
    out = F.lower(text)
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return out


def variants(words: str) -> list[str]:
    """The word sequences that an entry of the table stands for."""
    choice = re.search(r"\[[^\[\]{}]*\]|\{[^\[\]{}]*\}", words)
    if not choice:
        return [" ".join(words.split())]
    inner = choice[0][1:-1]
    options = ["", inner] if choice[0][0] == "[" else inner.split("|")
    return [v for o in options for v in variants(words[: choice.start()] + o + words[choice.end() :])]


def sequences() -> list[tuple[str, str]]:
    """(words, identifier) of all known sentences, longer ones first."""
    return sorted(((v, name) for name, words in SENTENCES.items() for v in variants(words)), key=lambda s: (-len(s[0]), s[0]))


def named(text: Column) -> Column:
    """The normalised text, each known sentence replaced by its identifier between two marks."""
    by_name: dict[str, list[str]] = {}
    for words, name in sequences():
        by_name.setdefault(name, []).append(words.replace(".", r"\.").replace(" ", "[ \n;]"))
    out = F.concat(F.lit("."), normalised(F.concat(F.lit("\n"), text, F.lit("\n"))), F.lit("."))
    for name, patterns in by_name.items():
        out = F.regexp_replace(out, rf"(?<=[.;\n])(?:{'|'.join(patterns)})(?=[.;\n])", OPEN + name + CLOSE)
    return out


def sentence_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hits): the known sentences of each text that has any, as (number of the sentence in the text, identifier)."""
    some = docs.where(F.col(text_col).rlike(SIGNS)).select(F.col(id_col).alias("doc_id"), named(F.col(text_col)).alias("t"))
    cut = F.split("t", r"\.", -1)
    each = F.transform(cut, lambda s, i: F.transform(F.regexp_extract_all(s, F.lit(f"{OPEN}(\\w+){CLOSE}"), F.lit(1)), lambda n: F.struct((i - 1).alias("at"), n.alias("name"))))
    return some.where(F.contains("t", F.lit(OPEN))).select("doc_id", F.flatten(each).alias("hits"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """(doc_id, license, rule, n, first, last): n matches of each rule; first and last are numbers of sentences of the text."""
    line = F.concat(F.lit(" "), F.array_join(F.transform("hits", lambda h: h["name"]), "  "), F.lit(" "))

    def found(n_rule: int, rule: LicenceRule) -> Column:
        pattern = rf"(?: \w+ ){{0,{gap}}}?".join(f" {s} " for s in rule.sentences)
        n = F.size(F.regexp_extract_all("line", F.lit(f"({pattern})"), F.lit(1)))
        own = F.filter("hits", lambda h: h["name"].isin(*rule.sentences))
        return F.struct(F.lit(rule.license).alias("license"), F.lit(rule.family).alias("rule"), n.alias("n"), F.get(own, F.lit(0))["at"].alias("first"), F.try_element_at(own, F.lit(-1))["at"].alias("last"), F.lit(n_rule).alias("no"), F.array(*map(F.lit, ABOVE[n_rule])).cast("array<int>").alias("above"))

    all_of = sentence_ids(docs, id_col, text_col).withColumn("line", line).select("doc_id", F.filter(F.array(*[found(i, r) for i, r in enumerate(RULES)]), lambda r: r["n"] > 0).alias("r"))
    best = F.filter("r", lambda r: ~F.exists("r", lambda o: F.array_contains(r["above"], o["no"]) & (o["first"] <= r["first"]) & (o["last"] >= r["last"])))
    each = all_of.select("doc_id", F.explode(best).alias("r"))
    return each.select("doc_id", "r.license", "r.rule", F.col("r.n").cast("long").alias("n"), F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last")).distinct()
