import os
import re

import pytest

from tessera.llm.licence_scan import ANCHOR, RULES, SENTENCES, scan_licences
from tests.llm.helpers import EDGE, docs

GPL = """/* This program is free software: you can redistribute it and/or modify it under the
 * terms of the GNU General Public License as published by the Free Software Foundation, either
 * version 3 of the License, or (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
 * without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. */"""


def test_fixed_values_fit_together():
    assert all(re.search(ANCHOR[4:], s) for s in SENTENCES)
    assert all(1 <= i <= len(SENTENCES) for _, ids in RULES for i in ids)
    assert len(SENTENCES) < 100 and len(set(SENTENCES)) == len(SENTENCES)
    assert {i for _, ids in RULES for i in ids} | {3, 4, 5, 6, 10, 11, 17, 18, 19, 28, 29} == set(range(1, len(SENTENCES) + 1))


def test_notices_headers_and_order(spark):
    rows = [(10, "Some prose.\nLicensed under the Apache License, Version 2.0."),
            (11, "Text | cell\nReleased under the MIT License.\nMore. Licensed under CC BY-NC 4.0."),
            (12, GPL), (13, "We licensed nothing here."),
            (14, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3"),
            (15, "Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met: one. two. This software is provided by the copyright "
                 "holders and contributors \"as is\" and any express or implied warranties, including, but not limited "
                 "to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."),
            *EDGE]
    got = {r.doc_id: r for r in scan_licences(docs(spark, rows)).collect()}
    assert {i: got[i].licences for i in range(10, 16)} == {
        10: "Apache-2.0", 11: "CC-BY-NC-4.0,MIT", 12: "GPL-3.0-or-later", 13: "", 14: "GPL-3.0-only", 15: "BSD-2-Clause"}
    assert got[11].n_licences == 2 and got[11].n_sentences == 2 and got[1].licences == "" and got[1].n_licences == 0
    assert scan_licences(docs(spark, rows)).count() == len(rows)
    assert scan_licences(docs(spark, [])).count() == 0


BSD_HEAD = """Copyright (c) 2020, Some Holder

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE.
"""
MIT = """MIT License

Copyright (c) 2020 Some Holder

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
ISC = """Copyright 2020 Some Holder

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def commented(text):
    return "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in text.splitlines()) + " */\n"


def check(spark, cases):
    rows = [(2 * i + j, form(x)) for i, (x, _) in enumerate(cases) for j, form in enumerate((str, commented))]
    got = {r.doc_id: r.licences for r in scan_licences(docs(spark, rows)).collect()}
    assert got == {2 * i + j: name for i, (_, name) in enumerate(cases) for j in (0, 1)}


def test_whole_texts(spark):
    named = BSD_THIRD.replace("the copyright holder", "Foo Inc.")
    check(spark, [
        (BSD_HEAD + BSD_THIRD + BSD_TAIL, "BSD-3-Clause"), (BSD_HEAD + BSD_TAIL, "BSD-2-Clause"),
        (BSD_HEAD + named + BSD_TAIL, "BSD-3-Clause"),
        ((BSD_HEAD + BSD_THIRD + BSD_TAIL).replace("1.", "(1)").replace("2.", "b)").replace("3.", "3)"), "BSD-3-Clause"),
        (MIT, "MIT"), (ISC, "ISC")])


GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
PUBLISHED = "/usr/share/common-licenses"


def test_headers_as_published(spark):
    check(spark, [(GPL2, "GPL-2.0-or-later"), (GPL2.replace("This program is", "Foobar is"), "GPL-2.0-or-later"),
                  (GPL2.replace("version 2", "version 3").replace("software;", "software:"), "GPL-3.0-or-later"),
                  (MPL, "MPL-2.0"), (MPL.replace("2.0", "1.1"), "")])


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="no licence texts on this machine")
def test_texts_of_the_system(spark):
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0-or-later",
             "GPL-3": "GPL-3.0-or-later", "MPL-2.0": "MPL-2.0"}
    rows = [(i, open(f"{PUBLISHED}/{n}", encoding="utf-8").read()) for i, n in enumerate(names)]
    got = {r.doc_id: r.licences for r in scan_licences(docs(spark, rows)).collect()}
    assert got == dict(enumerate(names.values()))
