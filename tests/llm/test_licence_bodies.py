"""Whole licence texts and headers in forms that training does not see: wrapped anew, commented, inside other text."""

import textwrap

import pytest

from tessera.llm import licences

BODIES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
You should have received a copy of the GNU General Public License along with this program.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
You should have received a copy of the GNU Lesser General Public License along with this library.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.""",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.",
}
PROSE = [
    "the river ran past the old mill and the children were granted a free afternoon under the trees",
    "a public library gives a licence to read, and all readers may copy what they like for any purpose",
    "the software was sold without fee and its terms were the subject of a long and general argument",
]


def forms(body):
    """A body wrapped at three widths, as comments, upper-cased, and between other paragraphs."""
    for width in (50, 72, 100):
        yield "\n".join(textwrap.fill(line, width) for line in body.split("\n"))
    yield "\n".join(" * " + line for p in body.split("\n") for line in textwrap.wrap(p, 68))
    yield "\n".join("# " + line for p in body.upper().split("\n") for line in textwrap.wrap(p, 76))
    yield "\n\n".join([PROSE[0], body, PROSE[1]])


@pytest.fixture(scope="module")
def found(spark):
    rows = [(family, text) for family, body in BODIES.items() for text in forms(body)] + [("", p) for p in PROSE]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    notices = {r.doc_id: {n.family for n in r.notices} for r in licences.scan(docs, licences.train(docs)).collect()}
    return [(family, notices[k]) for k, (family, _) in enumerate(rows)]


def test_every_body_is_found(found):
    assert all(family in names for family, names in found if family)


def test_no_other_family_is_found(found):
    assert [(family, names) for family, names in found if names - {family}] == []
