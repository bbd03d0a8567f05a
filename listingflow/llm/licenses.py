"""Licence recognition by known sentences: sentences to identifiers, identifier sequences to rules.

A text is cut into sentences twice, with line ends as sentence ends and with single line ends
as spaces, for licence lines and wrapped licence texts.  Each normalised sentence that is a
known licence sentence becomes its identifier, and a rule fits where its identifiers follow in
order, other sentences between them allowed.  All of it is column expressions over the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Normalised sentences of public licence notices, cut where real notices are: at line ends and
# after . ! ? ; and :.  Several forms of one sentence have one identifier.
SENTENCES: dict[int, tuple[str, ...]] = {
    1: ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license",
        "this file is licensed to you under the apache license version 2 0", "licensed under the apache license 2 0",
        "the asf licenses this file to you under the apache license version 2 0 the license"),
    2: ("you may not use this file except in compliance with the license",),
    3: ("you may obtain a copy of the license at",),
    4: ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    5: ("see the license for the specific language governing permissions and limitations under the license",),
    6: ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    7: ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    8: ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    9: ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    10: ("this work is licensed under the gnu general public license version 3",),
    11: ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
         "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    12: ("this program is distributed in the hope that it will be useful but without any warranty",
         "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    13: ("licensed under cc by nc 4 0",),
    14: ("licensed under cc by 4 0",),
    15: ("licensed under cc by sa 4 0",),
    16: ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    17: ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
         "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    18: ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
         "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    19: ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
         "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    20: ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    21: ("all rights reserved",),
    22: ("see the license for details",),
    23: ("this file is part of a project under the mit license",),
    24: ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    25: ("either version 2 of the license or at your option any later version",),
    26: ("you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",),
    27: ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",),
    28: ("either version 2 1 of the license or at your option any later version",),
    29: ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    30: ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    31: ("this source code form is subject to the terms of the mozilla public license v",),
    32: ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
         "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    33: ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
         "2 0 which is available at https www eclipse org legal epl 2 0", "2 0 which is available at http www eclipse org legal epl 2 0"),
    34: ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",),
    35: ("to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
         "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    36: ("this is free and unencumbered software released into the public domain",),
    37: ("this software is provided as is without any express or implied warranty",),
    38: ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    39: ("distributed under the boost software license version 1 0",),
    40: ("either version 3 of the license or at your option any later version",),
}
#: (licence, identifiers in order).
RULES = [
    ("Apache-2.0", [1]), ("Apache-2.0", [1, 2, 3]), ("Apache-2.0", [1, 2, 4, 5]), ("MIT", [6]), ("MIT", [7, 8, 9]),
    ("MIT", [23]), ("GPL-3.0-only", [10]), ("GPL-3.0-or-later", [11, 12]), ("GPL-3.0-or-later", [24, 40]), ("GPL-2.0-or-later", [24, 25]),
    ("GPL-2.0-only", [26]), ("LGPL-2.1-or-later", [27, 28]), ("LGPL-3.0-or-later", [29]), ("AGPL-3.0-or-later", [30]),
    ("MPL-2.0", [31, 32]), ("EPL-2.0", [33]), ("EPL-1.0", [34]), ("CC0-1.0", [35]), ("Unlicense", [36]), ("Zlib", [37, 38]), ("BSL-1.0", [39]),
    ("CC-BY-NC-4.0", [13]), ("CC-BY-4.0", [14]), ("CC-BY-SA-4.0", [15]), ("BSD-2-Clause", [16, 17, 18]), ("BSD-3-Clause", [16, 17, 18, 19]),
    ("ISC", [20]), ("proprietary", [21]),
]
#: Licences that a line ``SPDX-License-Identifier: …`` may name; each is a sentence and a rule of its own.
SPDX = [
    "Apache-2.0", "MIT", "ISC", "Zlib", "BSL-1.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0",
    "EPL-1.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense",
]
for _i, _name in enumerate(SPDX):
    SENTENCES[1000 + _i] = ("spdx license identifier " + _name.lower().replace("-", " ").replace(".", " "),)
    RULES.append((_name, [1000 + _i]))
#: Every known sentence holds one of these, so a text without them has none.
STEMS = ["licens", "permission", "warrant", "redistribut", "copyright", "reserved", "mpl", "epl", "domain"]


def sentences(text: Column, wrapped: bool) -> Column:
    """Normalised sentences: lower-case letters and digits with single spaces."""
    if wrapped:
        text = F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    named = F.regexp_replace(F.lower(text), "spdx-license-identifier:[ \t]*", "spdx license identifier ")
    ended = F.regexp_replace(named, r"([.!?;:])[\x20\x09-\x0D]+", "$1\n")
    return F.transform(F.split(ended, "\n"), lambda s: F.btrim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")))


def sequence(parts: Column, known: dict[int, tuple[str, ...]]) -> Column:
    """Identifiers of the known sentences in order, as one string like ``<7><8>``."""
    table = F.create_map(*[F.lit(x) for i, forms in known.items() for s in forms for x in (s, f"<{i}>")])
    return F.array_join(F.filter(F.transform(parts, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()), "")


def find_licenses(
    docs: DataFrame, *, known: dict[int, tuple[str, ...]] = SENTENCES, rules: list[tuple[str, list[int]]] = RULES, stems: list[str] = STEMS,
) -> DataFrame:
    """(doc_id, license, n_sentences): each rule a document fits, once per row and licence.

    ``n_sentences`` is the length of the licence's longest fitting rule.  Null and empty texts
    fit nothing; repeated rows are reported each; null ids stay null; other columns are ignored;
    an empty table gives an empty result; very long texts are read whole.
    """
    missing = [s for forms in known.values() for s in forms if not any(stem in s for stem in stems)]
    if missing:
        raise ValueError(f"no stem for {missing}")
    some = docs.select("doc_id", "text").filter(F.lower("text").rlike("|".join(stems)))
    some = some.select("doc_id", sequence(sentences(F.col("text"), False), known).alias("lines"), sequence(sentences(F.col("text"), True), known).alias("wrapped"))
    some = some.filter("lines <> '' OR wrapped <> ''")
    best: dict[str, list] = {}
    for license_, ids in rules:
        pattern = "%" + "%".join(f"<{i}>" for i in ids) + "%"
        best.setdefault(license_, []).append(F.when(F.col("lines").like(pattern) | F.col("wrapped").like(pattern), len(ids)).otherwise(0))
    found = [
        F.struct(F.lit(name).alias("license"), (F.greatest(*n) if len(n) > 1 else n[0]).alias("n_sentences")) for name, n in best.items()
    ]
    return (
        some.select("doc_id", F.explode(F.array(*found)).alias("hit")).select("doc_id", "hit.license", "hit.n_sentences")
        .filter("n_sentences > 0")
    )
