"""Further licence families, as their publishers print them."""

from clausewell.llm import licences

HOPE = """This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{1} for more details."""
FREE = """This {0} is free software; you can redistribute it and/or
modify it under the terms of the GNU {1}
as published by the Free Software Foundation; either version {2}
of the License, or (at your option) any later version.

""" + HOPE
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""


def test_families(spark):
    general, affero, lesser = ("General Public License", "Affero General Public License", "Lesser General Public License")
    cases = [
        (FREE.format("program", general, "2"), "GPL-2.0-or-later", "header", 3), (FREE.format("program", general, "3"), "GPL-3.0-or-later", "header", 3),
        (FREE.format("program", affero, "3"), "AGPL-3.0-or-later", "header", 3), (FREE.format("library", lesser, "2.1"), "LGPL-2.1-or-later", "header", 3),
        (FREE.format("library", lesser, "3"), "LGPL-3.0-or-later", "header", 3), (ZLIB, "Zlib", "full text", 3), (UNLICENSE, "Unlicense", "full text", 2),
        ("// Distributed under the Boost Software License, Version 1.0.", "BSL-1.0", "notice", 1)]
    docs = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(cases)], "doc_id bigint, text string")
    found = {r.doc_id: (r.licence, r.rule, r.n_sentences) for r in licences.licence_rows(docs).collect()}
    assert found == {k: tuple(x) for k, (_, *x) in enumerate(cases)}
