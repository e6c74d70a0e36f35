import public_tokenizers
import pyarrow as pa
import pytest
from test_corpus_queries import slow_components
from tokenizers import Tokenizer

from clausewell.llm import exact_dedup, licences, line_rules, ngram_join, packing, quality_qda, secret_forest, sentencepieces, token_cache, token_files, warc
from clausewell.llm.common import Scratch

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PROSE = "This is a line of good prose, with commas and a full stop at its end.\n"
LONG = " ".join(f"w{k}" for k in range(60_000))
KEY = "api_key = 'sk9f83kD02mfKq81Zx77'"
ROWS = [
    (1, "same text here now ok"), (2, "same  text\there now ok"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG + " tail"), (7, LONG + " tail"), (8, KEY),
    (9, PROSE * 20), (10, PROSE * 19 + "Released under the MIT license."), (11, "é 😀 ▁x".encode("utf-16", "surrogatepass").decode("utf-16")), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, blanks, long and repeated rows, and extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(k, t, "en", None, None, "d", 5, 0.5, "w") for k, t in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, size int, score double, words string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(1, 12)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")


def test_quality(spark, docs, labels):
    scored = quality_qda.quality_scores(docs, labels, Scratch(spark, "t")).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert quality_qda.quality_scores(docs.limit(0), labels, Scratch(spark, "t")).count() == 0
    assert {r.score for r in quality_qda.quality_scores(docs, labels.limit(0), Scratch(spark, "t")).collect()} == {0.5}
    assert quality_qda.keep_quality(docs, labels, Scratch(spark, "t")).columns == docs.columns


def test_exact(spark, docs):
    found = exact_dedup.exact_groups(docs, Scratch(spark, "t")).collect()
    assert len(found) == len(ROWS)
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert (by[2].keep_id, by[2].kept, by[2].group_size) == (1, False, 2)
    assert (by[3].keep_id, by[4].keep_id, by[4].group_size, by[5].kept) == (3, 3, 3, True)
    kept = exact_dedup.keep_first(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 5, 6, 7, 7, 8, 9, 10, 11]
    assert exact_dedup.exact_groups(docs.limit(0), Scratch(spark, "t")).count() == 0
    # a filter with far too few bits sends more rows to the exact pass and gives the same rows
    tight = exact_dedup.exact_groups(docs, Scratch(spark, "t"), most_bits=64).collect()
    assert sorted(map(str, tight)) == sorted(map(str, found))


def test_ngrams(spark, docs):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs, Scratch(spark, "t")).collect() if r.doc_id}
    assert found == slow_components(dict(r for r in ROWS if r[0]))
    assert found[7][1] == 6 and found[2][1] == 1 and found[4] == (0, 4)
    assert ngram_join.components(docs.limit(0), Scratch(spark, "t")).count() == 0
    assert ngram_join.keep_one(docs, Scratch(spark, "t")).columns == docs.columns


def test_ngrams_in_large_blocks(spark):
    """Blocks dealt into chunks lose no link: chains of copies that each change a few words."""
    words, rows = [f"a{k}" for k in range(120)], []
    for k in range(90):
        words[k] = f"b{k}"
        rows.append((k, " ".join(words)))
        rows.append((1000 + k, " ".join([*words[:60], *(f"c{k}_{i}" for i in range(60))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = ngram_join.components(docs, Scratch(spark, "t"), most_docs=8)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == slow_components(dict(rows))


def test_rules(spark, docs):
    found = {r.doc_id: r for r in line_rules.line_verdicts(docs).collect()}
    assert (found[3].n_words, found[3].kept, found[9].n_dup_lines, found[9].base_failed) == (0, False, 19, True)
    assert (found[6].n_words, found[6].kept) == (60_000, False)
    varied = "\n".join(f"Here a{k} meets b{k} while c{k} leaves d{k}." for k in range(20))
    more = spark.createDataFrame([(1, varied), (2, varied + "\nHome | About | Shop | Login | Help | News"), (3, varied.replace(".", ""))], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in line_rules.line_first(more).collect()}
    assert (rows[1].kept, rows[2].kept, rows[3].kept) == (True, True, False)
    assert rows[2].cleaned == varied and rows[3].cleaned == ""
    assert line_rules.line_verdicts(docs.limit(0)).count() == 0


def test_secrets(spark, docs):
    found = secret_forest.findings(docs, Scratch(spark, "t")).collect()
    assert [(r.doc_id, r.candidate, r.accepted) for r in found] == [(8, "sk9f83kD02mfKq81Zx77", True)]
    clean = secret_forest.redact(docs, Scratch(spark, "t"))
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    row = clean.filter("doc_id = 8").first()
    assert row.text == "api_key = '[secret]'" and row.n_chars == len(row.text)
    assert secret_forest.findings(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_secrets_of_any_form(spark):
    """Short, symbol-bearing and digit-free values after a credential name are found and redacted where they stand."""
    planted = ["password = 'Tr0ub4dorX3'", "pwd: 'xK9$fQ2!vb'", "my_password=xK9abc$fQ2", 'api_key: "QwErTyUiOpAsDfGhJkLz"', '{"db-passwd": "hun,ter2"}', "secret_key=>s3@!", "password: 'correct horse battery staple'"]
    values = ["Tr0ub4dorX3", "xK9$fQ2!vb", "xK9abc$fQ2", "QwErTyUiOpAsDfGhJkLz", "hun,ter2", "s3@!", "correct horse battery staple"]
    rows = [(k, f"Some text \U0001f600 s3@ here. {p}\nand more of it") for k, p in enumerate(planted)]
    rows += [(100 + k, f"see https://example.org/a/{k}f83kD02mfKq81Zx77{k} and 12345678901234567{k} counterrevolutionaries said Author: John, max_tokens: 512") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = secret_forest.findings(docs, Scratch(spark, "t")).collect()
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate for r in found)
    accepted = {(r.doc_id, r.candidate) for r in found if r.accepted}
    assert accepted == set(enumerate(values))
    assert "counterrevolutionaries" in {r.candidate for r in found}
    clean = {r.doc_id: r.text for r in secret_forest.redact(docs, Scratch(spark, "t")).collect()}
    assert clean == {k: t.replace(values[k], "[secret]") if k < 100 else t for k, t in rows}
    # a short finding that a word holds is redacted where it stands only
    twice = spark.createDataFrame([(1, "a cat: password = 'a1' in a1b"), (1, "password = 'b2c' too")], "doc_id bigint, text string")
    assert {r.text for r in secret_forest.redact(twice, Scratch(spark, "t")).collect()} == {"a cat: password = '[secret]' in a1b", "password = '[secret]' too"}


def test_packing_and_tokens(spark, docs):
    pieces = packing.pack(docs, BYTE, with_ids=True).collect()
    assert sum(r.length for r in pieces if r.doc_id == 4) == 1 and sum(1 for r in pieces if r.doc_id == 7 and r.start == 0) == 2
    assert packing.pack(docs.limit(0), BYTE).count() == 0
    files = token_files.write_files(docs, Scratch(spark, "t"), WORD, keep_blanks=False, end_id=2)
    back = token_files.read_files(files).collect()
    assert len(back) == len(ROWS)
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert token_files.read_files(token_files.write_files(docs.limit(0), Scratch(spark, "t"), WORD, keep_blanks=False, end_id=2)).count() == 0
    found = {r.doc_id: r for r in sentencepieces.encode_documents(docs, PIECE).collect()}
    assert found[3].n_pieces == 0 and all(r.round_trip for r in found.values())
    assert sentencepieces.encode_documents(docs.limit(0), PIECE).count() == 0


def test_licences(spark, docs):
    assert [(r.doc_id, r.licence) for r in licences.licence_rows(docs).collect()] == [(10, "MIT")]
    assert licences.licence_rows(docs.limit(0)).count() == 0


MIT = """MIT License
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
AUTHORS BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""


def test_wrapped_and_commented_licences(spark):
    full = [("MIT", "full text", 3, MIT), ("Apache-2.0", "header", 5, APACHE), ("GPL-3.0-or-later", "header", 3, GPL), ("BSD-3-Clause", "full text", 4, BSD)]
    shapes = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */"]
    shapes += [lambda t, m=m: "\n".join(m + x for x in t.split("\n")) for m in ("// ", "# ", "-- ", "; ", "dnl ")]
    shapes += [lambda t: "\n".join(f"* {x:<80} *" for x in t.split("\n"))]
    rows = [(100 * k + j, shape(t)) for k, (_, _, _, t) in enumerate(full) for j, shape in enumerate(shapes)]
    rows += [(300 + 50 + k, BSD.replace("1. ", m).replace("2. ", m).replace("3. ", m)) for k, m in enumerate(["- ", "* ", "a) ", "(1) "])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.licence): (r.rule, r.n_sentences) for r in licences.licence_rows(docs).collect()}
    for k, _ in rows:
        licence, rule, n, _ = full[k // 100]
        assert found[k, licence] == (rule, n), (k, licence)
    # a blank line, empty or of marks only, ends a sentence
    cut = spark.createDataFrame([(1, "Released under\n\nthe MIT license"), (2, "# Released under\n#\n# the MIT license"), (3, "Released under\nthe MIT license")], "doc_id bigint, text string")
    assert [(r.doc_id, r.first_sentence) for r in licences.licence_rows(cut).collect()] == [(3, 0)]


def test_warc(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a", big, 0), (2, None, big, 0), (3, "http://b", None, 0), (4, "http://c", "", 0), (5, "u", "é" * 499, 0), (6, "u", "é" * 499, 0), (7, "u\r\nX: y", big, 0), (7, "u", big, 0), (None, "n", big, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    records, payloads = warc.write_archive(pages, Scratch(spark, "t"))
    back = warc.read_archive(records, payloads)
    assert payloads.count() == 3
    found = sorted(((r.page_id or 0, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in back.collect()), key=str)
    expected = sorted(((p or 0, "revisit" if (p or 0) < 3 else "response", 7 if (p or 0) < 3 else None, h or "") for p, _, h, _ in rows), key=str)
    assert found == expected
    assert back.filter("not verified").count() == 0
    assert back.select(warc.record_bytes().alias("b")).count() == len(rows)
    assert warc.read_archive(*warc.write_archive(pages.limit(0), Scratch(spark, "t"))).count() == 0


def test_warc_with_null_and_repeated_ids(spark):
    """Rows that share an id with a copied page keep their own payloads and are told apart by them."""
    a, b, c = ("<p>" + x * 2000 for x in "abc")
    rows = [(1, a), (9, a), (1, c), (None, a), (None, b), (8, b), (None, "own"), (None, c + "!"), (2, "s"), (3, "s"), (2, "t")]
    pages = spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id bigint, url string, html string")
    records, payloads = warc.write_archive(pages, Scratch(spark, "t"))
    back = warc.read_archive(records, payloads).collect()
    last = {a: 9, b: 8}
    expected = [(k, "response" if last.get(h, k) == k else "revisit", None if last.get(h, k) == k else last[h], h) for k, h in rows]
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload and bytes(r.payload).decode()) for r in back), key=str) == sorted(expected, key=str)
    assert all(r.verified for r in back) and payloads.count() == len({h for _, h in rows})


@pytest.mark.parametrize("name, keep_blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_special_tokens_as_the_library_has_them(spark, name, keep_blanks):
    """The queries' encoder gives the ids of the library's own call, for texts that quote special tokens, too."""
    path = public_tokenizers.path(name)
    end, start = "<|endoftext|>", "<|startoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"a{end}b", f"a  {end}  b", f"x \n{end}\n\n b", f"{start} a {end}", end.upper() + " A", f"<{end}>", "<|endof", f"a\t{end}　B c\n", "a <| b |>", "plain words", f"é́{end}́"]
    library = Tokenizer.from_file(path)
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [x.tolist() for x in token_cache.encoder(path, keep_blanks, 1).each(pa.array(texts))] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    if keep_blanks:
        found = {r.doc_id: list(r.ids) for r in packing.pack(docs, path, with_ids=True, end_id=1).collect()}
    else:
        found = {r.doc_id: r.n_tokens for r in token_files.read_files(token_files.write_files(docs, Scratch(spark, "t"), path, keep_blanks=False, end_id=1)).collect()}
        want = [len(x) for x in want]
    assert found == dict(enumerate(want))


def test_damaged_payloads_are_seen(spark):
    """Both digests are computed anew: a damaged payload, or one under a wrong strong digest, is not verified."""
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id bigint, url string, html string")
    records, payloads = warc.write_archive(pages, Scratch(spark, "t"))
    damaged = payloads.selectExpr("digest", "if(payload = binary('one'), binary('0ne'), payload) as payload")
    moved = [t.selectExpr("replace(digest, substring(digest, 1, 8), 'moved') as digest", *[c for c in t.columns if c != "digest"]) for t in (records, payloads)]
    assert {r.page_id: r.verified for r in warc.read_archive(records, damaged).collect()} == {1: False, 2: True}
    assert not any(r.verified for r in warc.read_archive(*moved).collect())
    assert warc.proven(warc.read_archive(records, payloads)).count() == 2
    with pytest.raises(Exception, match="damaged payload"):
        warc.proven(warc.read_archive(records, damaged)).collect()
