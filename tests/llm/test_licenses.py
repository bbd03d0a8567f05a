"""Licence rules on written texts and odd inputs."""

from listingflow.llm import licenses

MIT = """Some title

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. More text.
"""


def test_rules(spark):
    rows = [
        (1, MIT), (2, "text | without end\nLicensed under the Apache License, Version 2.0.\nmore"), (3, None), (4, ""),
        (5, "Fine. This program is distributed in the hope that it will be useful. Released under the MIT License."),
        (6, "\n".join(MIT.split("\n\n")[::-1])),  # the sentences in the wrong order
        (7, "licensed under CC BY-NC 4.0"), (7, "licensed under CC BY-NC 4.0"), (None, "All rights reserved."),
        (8, "license " * 100_000), (9, "Unlicensed under the Apache License, Version 2.0."),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license int")
    got = sorted(((r["doc_id"], r["license"], r["n_sentences"]) for r in licenses.find_licenses(docs).collect()), key=str)
    assert got == sorted([
        (1, "MIT", 3), (2, "Apache-2.0", 1), (5, "MIT", 1), (7, "CC-BY-NC-4.0", 1), (7, "CC-BY-NC-4.0", 1), (None, "proprietary", 1),
    ], key=str)
    assert licenses.find_licenses(docs.filter("false")).collect() == []


# The notices as their licences' publishers print them.
GNU = """    This {what} is free software{a} you can redistribute it and/or modify
    it under the terms of the GNU {kind}General Public License as published by
    the Free Software Foundation{b} either version {v} of the License, or
    (at your option) any later version.

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {kind}General Public License for more details.
"""
NOTICES = {
    "Apache-2.0": """/*
 * Copyright 2020 Somebody
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */""",
    "GPL-3.0-or-later": GNU.format(what="program", a=":", b=",", v="3", kind=""),
    "GPL-2.0-or-later": GNU.format(what="program", a=";", b=";", v="2", kind=""),
    "LGPL-2.1-or-later": GNU.format(what="library", a=";", b=";", v="2.1", kind="Lesser "),
    "LGPL-3.0-or-later": GNU.format(what="library", a=":", b=",", v="3", kind="Lesser "),
    "AGPL-3.0-or-later": GNU.format(what="program", a=":", b=",", v="3", kind="Affero "),
    "GPL-2.0-only": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License version 2 as
 * published by the Free Software Foundation.""",
    "MPL-2.0": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """ * This program and the accompanying materials are made available under the
 * terms of the Eclipse Public License 2.0 which is available at
 * https://www.eclipse.org/legal/epl-2.0/""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use it.",
    "Zlib": """  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "MIT": "// SPDX-License-Identifier: MIT\nint main() {}", "ISC": "# x\n# SPDX-License-Identifier:\tISC */",
}


def test_real_notices(spark):
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(NOTICES.values())], "doc_id long, text string")
    found = {}
    for r in licenses.find_licenses(docs).collect():
        found.setdefault(list(NOTICES)[r["doc_id"]], set()).add(r["license"])
    # A text with three clauses holds the two of the shorter licence.
    assert found == {**{name: {name} for name in NOTICES}, "BSD-3-Clause": {"BSD-2-Clause", "BSD-3-Clause"}}


def test_every_rule_uses_known_sentences():
    assert all(i in licenses.SENTENCES for _, ids in licenses.RULES for i in ids)
