"""Whole licences, wrapped headers and notices inside prose are found, whatever stands around them."""

from __future__ import annotations

from chronolith.llm import licenses

MIT = """Copyright (c) 2019 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""


def found(spark, texts, **more):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan(d, **more).orderBy("doc_id").collect()
    return [[(m.segment, m.license, round(m.dice, 6)) for m in r.matches] for r in rows]


def test_whole_licenses(spark):
    names = [n for n in licenses.TEMPLATES if len(licenses.TEMPLATES[n]) > 400]
    assert {"BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Unlicense", "ISC", "MIT"} <= {*names}
    got = found(spark, [MIT, *(licenses.TEMPLATES[n] for n in names)])
    assert got[0][0][:2] == (0, "MIT") and got[0][0][2] > 0.95
    assert [m[0] for m in got[1:]] == [(0, n, 1.0) for n in names]


def test_passages(spark):
    prose = " ".join(f"word{i} of the text" for i in range(400))
    notice = "released under the MIT license"
    texts = [f"#!/bin/x\n{HEADER}\n{prose}\n{prose}", f"{prose}\n{MIT}{prose}", f"{prose} and {notice}, {prose} {notice} {prose}", prose, f"{prose}\nReleased under the MIT License.\n{prose}"]
    got = found(spark, texts)
    assert (-2, "Apache-2.0 header", 1.0) in got[0]
    assert any(s < 0 and n == "MIT" and d > 0.95 for s, n, d in got[1])
    assert got[2:] == [[(-1, "MIT notice", 1.0)] * 2, [], [(2, "MIT notice", 1.0)]]


def test_passage_of_a_whole_long_licence(spark):
    prose = " ".join(f"word{i} of the text" for i in range(3000))
    (got,) = found(spark, [f"{prose}\n{licenses.TEMPLATES['Apache-2.0']}\n{prose}"])
    assert any(s < 0 and n == "Apache-2.0" and d == 1 for s, n, d in got)


def test_gate_keeps_every_match():
    for least in (0.8, 0.5):
        gate = licenses.gate_words([licenses._template_bigrams(t) for t in licenses.TEMPLATES.values()], least)
        for t in licenses.TEMPLATES.values():
            b = licenses._template_bigrams(t)
            free = [x for x in b if not {*gate} & {*x.split(" ")}]
            assert len(free) < licenses._least_shared(len(b), least)


def test_gate_pattern_finds_words_only():
    import re

    words = ["nc", "license", "licensed", "a1"]
    find = re.compile(licenses.gate_pattern(words).replace("\\x{10FFFF}", "\U0010ffff"))
    for text, hit in [("x nc", 1), ("since", 0), ("_NC_", 1), ("(License)", 1), ("licenses", 0), ("licensed", 1), ("éncé", 0), ("1nc", 0), ("", 0), ("A1\n", 1), ("nc", 1)]:
        assert bool(find.search(text)) == bool(hit), text
