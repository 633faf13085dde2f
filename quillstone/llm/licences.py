"""Licence scans by sentence rules.

A text is cut into sentences; a sentence is normalised (lower case, only letters, digits and
dots inside numbers, one space between) and, if it is a known licence sentence, gets that
sentence's identifier. A sentence that speaks of a licence but is not known is UNKNOWN. The
sequence of identifiers is then matched against ordered rules: a rule names the identifiers
that must follow one another, and what it matches is taken away before the next rule looks.

A line feed ends a sentence, but a known sentence is first laid on one line where it is wrapped,
with or without comment marks. Lines between two sentence ends or blank lines that are not
known by themselves also speak of a licence if they do when read as one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "ApacheStatement",
    "licensed under the apache license version 2.0 the license": "ApacheStatement",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "ApacheCopy",
    "released under the mit license": "MitStatement",
    "licensed under the mit license": "MitStatement",
    "this project is licensed under the mit license": "MitStatement",
    "this software is released under the mit license": "MitStatement",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied": "AsIs",
    "this work is licensed under the gnu general public license version 3": "Gpl3Statement",
    "this work is licensed under the gnu general public license version 2": "Gpl2Statement",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3OrLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2OrLater",
    "licensed under cc by nc 4.0": "CcByNc4Statement",
    "licensed under cc by 4.0": "CcBy4Statement",
    "licensed under cc by sa 4.0": "CcBySa4Statement",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdConditions",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed": "BsdDisclaimer",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "Mpl2Statement",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "Cc0Dedication",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "Lgpl21OrLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3OrLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3OrLater",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": "Epl2Statement",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "Gpl2Header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "Gpl3Header",
    "spdx license identifier mit": "SpdxMit",
    "spdx license identifier apache 2.0": "SpdxApache2",
    "spdx license identifier bsd 2 clause": "SpdxBsd2",
    "spdx license identifier bsd 3 clause": "SpdxBsd3",
    "spdx license identifier isc": "SpdxIsc",
    "spdx license identifier mpl 2.0": "SpdxMpl2",
    "spdx license identifier gpl 2.0 only": "SpdxGpl2",
    "spdx license identifier gpl 2.0": "SpdxGpl2",
    "spdx license identifier gpl 2.0 or later": "SpdxGpl2Later",
    "spdx license identifier gpl 3.0 only": "SpdxGpl3",
    "spdx license identifier gpl 3.0": "SpdxGpl3",
    "spdx license identifier gpl 3.0 or later": "SpdxGpl3Later",
    "all rights reserved": "AllRights",
}

#: Real notices' sentences in full, and the known sentence that each stands for; * is any name.
FULL = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "the software is provided as is without warranty of any kind express or implied",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at *": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
}

#: Fixed values, in order: a licence and the identifiers that must follow one another.
RULES = [
    ("BSD-3-Clause", ["BsdConditions", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdConditions", "BsdSource", "BsdBinary"]),
    ("Apache-2.0", ["ApacheStatement", "ApacheCompliance", "ApacheCopy"]),
    ("Apache-2.0", ["ApacheStatement"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitStatement"]),
    ("GPL-3.0-or-later", ["Gpl3OrLater"]),
    ("GPL-3.0-only", ["Gpl3Statement"]),
    ("GPL-2.0-or-later", ["Gpl2OrLater"]),
    ("GPL-2.0-only", ["Gpl2Statement"]),
    ("CC-BY-NC-4.0", ["CcByNc4Statement"]),
    ("CC-BY-SA-4.0", ["CcBySa4Statement"]),
    ("CC-BY-4.0", ["CcBy4Statement"]),
    ("MPL-2.0", ["Mpl2Statement"]),
    ("ISC", ["IscGrant"]),
    ("Unlicense", ["UnlicenseGrant"]),
    ("CC0-1.0", ["Cc0Dedication"]),
    ("LGPL-2.1-or-later", ["Lgpl21OrLater"]),
    ("LGPL-3.0-or-later", ["Lgpl3OrLater"]),
    ("AGPL-3.0-or-later", ["Agpl3OrLater"]),
    ("EPL-2.0", ["Epl2Statement"]),
    ("GPL-2.0-only", ["Gpl2Header"]),
    ("GPL-3.0-only", ["Gpl3Header"]),
    ("MIT", ["SpdxMit"]),
    ("Apache-2.0", ["SpdxApache2"]),
    ("BSD-2-Clause", ["SpdxBsd2"]),
    ("BSD-3-Clause", ["SpdxBsd3"]),
    ("ISC", ["SpdxIsc"]),
    ("MPL-2.0", ["SpdxMpl2"]),
    ("GPL-2.0-only", ["SpdxGpl2"]),
    ("GPL-2.0-or-later", ["SpdxGpl2Later"]),
    ("GPL-3.0-only", ["SpdxGpl3"]),
    ("GPL-3.0-or-later", ["SpdxGpl3Later"]),
    ("Proprietary", ["AllRights"]),
    ("Unknown", ["UNKNOWN"]),
]

#: A sentence is looked at only if it holds one of these; every known sentence does.
CUE = "licen[cs]e|copyright|permi(tted|ssion)|warrant|redistribut|public domain|rights reserved|cc by"
#: The same in a text as it is, where any signs may stand between two words.
LOOSE_CUE = re.sub(" ", "[^a-z0-9]+", CUE)
_STATE = "struct<rest:string,got:array<string>>"
#: Ends of sentences, and blank lines; a comment mark alone is a blank line too.
_HARD = r"(?<![.!?;:])[.!?;:]++[ \t\r]*+\n|(?<![.!?])[.!?]++ |\n[^\S\n]*+(?:[#*/;%|-]++[^\S\n]*+)?(?=\n)"
_SIGN = r"[^A-Za-z0-9\n.!?;:)]"
_BEFORE, _AFTER = r"(?:(?<=[\n.!?;:)])|^)[^A-Za-z0-9\n.]{0,16}", r"(?=[^A-Za-z0-9\n.!?;:]{0,16}(?:[.!?;:\n]|$))"


def _unwrapped(text: Column) -> Column:
    """Known sentences that go over several lines, and real notices' full ones, as lines of their own.

    Gaps between words are possessive: a repeated group would recurse once a sign, and a class
    would be tried again for each.
    """

    # What stands before and behind a sentence is looked at for 16 signs; longer runs are cut to
    # that. A run of over 48 signs with stops in it ends a sentence, four lines without a word a passage.
    text = F.regexp_replace(text, f"({_SIGN}{{16}}){_SIGN}++", "$1")
    text = F.regexp_replace(text, r"([^A-Za-z0-9\n]{48})[^A-Za-z0-9\n]++", "$1. ")
    text = F.regexp_replace(text, r"(?:\n[^A-Za-z0-9\n]*+){4}(?:\n[^A-Za-z0-9\n]*+)*+", "\n\n\n")

    def words(sentence: str, gap: str) -> str:
        return gap.join("[^.!?;]+?" if w == "*" else re.escape(w) for w in sentence.split())

    for full, known in FULL.items():
        text = F.regexp_replace(text, f"(?i){_BEFORE}{words(full, '[^A-Za-z0-9]++')}{_AFTER}", f"\n{known}\n")
    for known in sorted(SENTENCES, key=len, reverse=True):
        on_a_line = words(known, r"(?:[^A-Za-z0-9\n.!?]|[.!?](?! ))++")  # and without what ends a sentence
        text = F.regexp_replace(text, f"(?i){_BEFORE}(?!{on_a_line}(?![A-Za-z0-9])){words(known, '[^A-Za-z0-9]++')}{_AFTER}", f"\n{known}\n")
    return text


def _normal(sentence: Column) -> Column:
    words = F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(words, r"(?<!\.)\.++( |$)", " "))


def _speaks(sentence: Column) -> Column:
    """Whether a normalised sentence speaks of a licence; what must follow is looked for behind the first place only."""
    after = lambda start: F.regexp_extract(sentence, f"{start}(.*)", 1).rlike("licen[cs]e")
    return sentence.rlike("licen[cs]ed? under") | after("under the terms of ") | after("released under ")


def recognise(docs: DataFrame, text_col: str = "text", *, identifiers: str = "identifiers", licences: str = "licences") -> DataFrame:
    """`docs` with two string arrays: the licence sentences' identifiers in order of the text, and
    the licences recognised, sorted, each once.

    Every row stays with its other columns; a column that has the name of a new one is
    replaced. A null, empty or unlicensed text has empty arrays. A text is looked at whole,
    sentence by sentence, without leaving its row, so no size or repetition moves data.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "!!", "")
    cue = F.lower(text).rlike(LOOSE_CUE)
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])

    def identifier(s: Column) -> Column:
        return F.coalesce(F.try_element_at(known, s), F.when(_speaks(s), F.lit("UNKNOWN")))

    def identifiers_of(part: Column) -> Column:
        lines = F.transform(F.split(part, "\n", -1), lambda x: _normal(x))
        lines = F.transform(lines, lambda s: F.struct(s.alias("s"), F.when(s.rlike(CUE), identifier(s)).alias("i")))
        by_line = F.filter(F.transform(lines, lambda x: x["i"]), lambda x: x.isNotNull())
        other = F.array_join(F.transform(F.filter(lines, lambda x: x["i"].isNull()), lambda x: x["s"]), " ")
        return F.concat(by_line, F.when(_speaks(other), F.array(F.lit("UNKNOWN"))).otherwise(F.array().cast("array<string>")))

    found = F.flatten(F.transform(F.split(F.when(cue, _unwrapped(text)).otherwise(""), _HARD, -1), identifiers_of))
    rows = docs.withColumn(identifiers, F.when(cue, found).otherwise(F.array().cast("array<string>")))
    rest = F.concat(F.lit(" "), F.array_join(F.transform(identifiers, lambda x: F.concat(x, F.lit(" "))), " "))
    start = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("got")).cast(_STATE)
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(f" {'  '.join(needs)} ").alias("sign")) for licence, needs in RULES])

    def apply(state: Column, rule: Column) -> Column:
        has = F.contains(state["rest"], rule["sign"])
        got = F.when(has, F.array_append(state["got"], rule["licence"])).otherwise(state["got"])
        return F.struct(F.replace(state["rest"], rule["sign"], F.lit(" ")).alias("rest"), got.alias("got")).cast(_STATE)

    return rows.withColumn(licences, F.array_sort(F.array_distinct(F.aggregate(rules, start, apply)["got"])))
