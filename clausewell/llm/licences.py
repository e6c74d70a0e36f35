"""Licence recognition by sentence rules.

Every sentence of a text is normalised and looked up in a fixed table of known licence sentences. The identifiers
found, in the order of the text, form the document's sequence; ordered rules then match sequences: a rule names the
sentences that must follow one another in it (others may stand between), and of one licence's rules the first that
matches counts, so a full text is preferred to a lone notice.

Texts are cut into parts at line breaks and sentence ends. A known sentence is one part, or consecutive parts that no
blank line parts: licence texts are wrapped, and hold colons and semicolons inside a sentence. Comment and bullet marks
around a part count as blanks, and a line of marks only is blank. Of two known sentences that begin at one part the
longer counts. The SQL knows sentences of one part without such marks only, the form that the given tables have.

All steps are DataFrame functions. Texts without any trigger word, which every known sentence contains, are left
before they are split. The table and the rules are constants of this module, so what is broadcast has a fixed size.

Defined cases: null and empty texts, and texts without known sentences, give no rows; a sentence that repeats counts
once per occurrence in ``n_sentences``; repeated rows give their rows again; texts are read whole; other columns are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, in normalised form (lower case, words of letters, digits, dots
#: within numbers and hyphens, one space between). Public licence texts and the notices their publishers recommend.
SENTENCES = {
    "apache-note": "licensed under the apache license version 2.0",
    "apache-note-full": "licensed under the apache license version 2.0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-note": "released under the mit license",
    "mit-note-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-note": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "agpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "lgpl21-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
    "zlib-as-is": "this software is provided as-is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-note": "distributed under the boost software license version 1.0",
    "cc-by-nc4-note": "licensed under cc by-nc 4.0",
    "cc-by4-note": "licensed under cc by 4.0",
    "cc-by-sa4-note": "licensed under cc by-sa 4.0",
    "cc-by4-long": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc4-long": "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    "cc0-note": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "bsd-intro": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-note": "this source code form is subject to the terms of the mozilla public license v. 2.0",
}

#: Rules in order, (licence, rule, sentences that must follow one another).
RULES = [
    ("Apache-2.0", "header", ["apache-note-full", "apache-comply", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", "short header", ["apache-note-full", "apache-comply"]),
    ("Apache-2.0", "notice", ["apache-note"]),
    ("Apache-2.0", "notice", ["apache-note-full"]),
    ("MIT", "full text", ["mit-grant", "mit-condition", "mit-as-is"]),
    ("MIT", "grant", ["mit-grant"]),
    ("MIT", "notice", ["mit-note"]),
    ("MIT", "notice", ["mit-note-licensed"]),
    ("GPL-3.0-or-later", "header", ["gpl-redistribute", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", "short header", ["gpl-redistribute"]),
    ("GPL-3.0-only", "notice", ["gpl3-note"]),
    ("GPL-2.0-or-later", "header", ["gpl2-redistribute", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", "short header", ["gpl2-redistribute"]),
    ("AGPL-3.0-or-later", "header", ["agpl-redistribute", "gpl-hope", "agpl-see"]),
    ("AGPL-3.0-or-later", "short header", ["agpl-redistribute"]),
    ("LGPL-2.1-or-later", "header", ["lgpl21-redistribute", "lgpl-hope", "lgpl-see"]),
    ("LGPL-2.1-or-later", "short header", ["lgpl21-redistribute"]),
    ("LGPL-3.0-or-later", "header", ["lgpl3-redistribute", "lgpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", "short header", ["lgpl3-redistribute"]),
    ("Unlicense", "full text", ["unlicense-domain", "unlicense-anyone"]),
    ("Unlicense", "notice", ["unlicense-domain"]),
    ("Zlib", "full text", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("BSL-1.0", "notice", ["boost-note"]),
    ("CC-BY-NC-4.0", "notice", ["cc-by-nc4-note"]),
    ("CC-BY-NC-4.0", "notice", ["cc-by-nc4-long"]),
    ("CC-BY-SA-4.0", "notice", ["cc-by-sa4-note"]),
    ("CC-BY-4.0", "notice", ["cc-by4-note"]),
    ("CC-BY-4.0", "notice", ["cc-by4-long"]),
    ("CC0-1.0", "waiver", ["cc0-note"]),
    ("BSD-3-Clause", "full text", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "full text", ["bsd-intro", "bsd-source", "bsd-binary"]),
    ("ISC", "grant", ["isc-grant"]),
    ("MPL-2.0", "notice", ["mpl-note"]),
]

#: Every rule has a sentence that holds one of these.
TRIGGER = r"(?i)licen[sc]e|copyright|permission|redistribut|warranty|cc by|unencumbered"
#: A sentence ends at a line break, or after . ! ? ; or : before a blank. The list markers of licence texts stand alone.
STOP = r"\n+|(?<=[.!?;:])[\x20\x09-\x0D]+"
#: An empty line between two parts.
GAP = r"\n[\x20\x09-\x0D]*\n"
#: Comment and bullet marks before a part's first word or after its last one.
MARKS = r"^[^\p{L}\p{N}]*(?:(?i:dnl|rem|c|o|[0-9]{1,2}\)|[a-z]\)|[ivx]{1,4}\))[\x20\x09]+[^\p{L}\p{N}]*)?|[^\p{L}\p{N}]+$"
NOT_WORD = r"[^\p{L}\p{N}.-]+"
LOOSE = r"(?<![0-9])\.|\.(?![0-9])"


def normalised(sentence: Column) -> Column:
    """Lower case, punctuation but number points and hyphens as spaces, one space between words."""
    spaced = F.regexp_replace(F.lower(sentence), NOT_WORD, " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(spaced, LOOSE, " "), " +", " "))


def _known_form(text: str) -> str:
    import re

    return re.sub(" +", " ", re.sub(r"(?<![0-9])\.|\.(?![0-9])", " ", text)).strip()


def _once(value: Column, body) -> Column:
    """``body`` of a value that is made once, and not once for every part."""
    return F.transform(F.array(value), body)[0]


def _runs() -> Column:
    """For every part of ``text`` the normalised sentences that begin with it, of one part and more, as far as a known
    sentence can reach; none where no known sentence begins like the part."""
    known = [_known_form(v) for v in SENTENCES.values()]
    most_words, most = max(len(x.split(" ")) for x in known), max(map(len, known))
    starts = "^(" + "|".join(sorted({x.split(" ")[0] for x in known})) + ")( |$)"
    table = F.array(*map(F.lit, known))
    words = F.transform(F.split("text", STOP), lambda p: normalised(F.regexp_replace(p, MARKS, "")))
    between = F.concat(F.array(F.lit("\n\n")), F.regexp_extract_all("text", F.lit(STOP), F.lit(0)), F.array(F.lit("\n\n")))

    def pieces(stops: Column) -> Column:
        # a line of marks only parts as a blank line does; marks that are cut off beside words do not
        return F.transform(words, lambda w, k: F.struct(w.alias("words"), (
            stops[k].rlike(GAP) | ((w == "") & stops[k].contains("\n") & stops[k + 1].contains("\n"))).alias("after_gap")))

    def longer(acc: Column, piece: Column) -> Column:
        both = F.concat_ws(" ", acc["last"], F.nullif(piece["words"], F.lit("")))
        on = acc["on"] & ~piece["after_gap"] & (F.length(both) <= most)
        more = F.when(on & (piece["words"] != ""), F.array(both)).otherwise(F.array().cast("array<string>"))
        # what has ended is not made longer
        return F.struct(F.concat(acc["all"], more).alias("all"), F.when(on, both).otherwise(acc["last"]).alias("last"), on.alias("on"))

    def from_part(all_pieces: Column, piece: Column, k: Column) -> Column:
        first = F.struct(F.array(piece["words"]).alias("all"), piece["words"].alias("last"), F.lit(True).alias("on"))
        begins = piece["words"].rlike(starts) & F.exists(table, lambda x: x.startswith(piece["words"]))
        return F.when(begins, F.aggregate(F.slice(all_pieces, k + 2, 4 * most_words), first, longer)["all"]).otherwise(F.array().cast("array<string>"))

    return _once(_once(between, pieces), lambda p: F.transform(p, lambda piece, k: from_part(p, piece, k)))


def licence_rows(docs: DataFrame) -> DataFrame:
    """One row per document and licence found: doc_id, licence, rule, first_sentence (from 0), n_sentences, sentences."""
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([(_known_form(v), k) for k, v in SENTENCES.items()], "sentence string, id string"))
    some = docs.select("doc_id", "text").filter(F.col("text").rlike(TRIGGER)).withColumn("row", F.monotonically_increasing_id())
    parts = some.select("row", "doc_id", F.posexplode(_runs()).alias("position", "runs")).filter(F.size("runs") > 0)
    runs = parts.select("row", "doc_id", "position", F.posexplode("runs").alias("more", "sentence"))
    known = runs.join(table, "sentence")
    hits = F.sort_array(F.collect_list(F.struct("position", (-F.col("more")).alias("shorter"), "id")))
    found = known.groupBy("row", "doc_id").agg(hits.alias("hits")).withColumn(
        "hits", F.expr("filter(hits, (h, k) -> k = 0 or hits[k - 1].position <> h.position)"))
    sequence = F.concat(F.lit(","), F.array_join("hits.id", ","), F.lit(","))
    named = found.withColumn("sequence", sequence)
    rules = F.broadcast(spark.createDataFrame([(k, a, b, "," + ",(.*,)?".join(ids) + ",", ids) for k, (a, b, ids) in enumerate(RULES)], "place int, licence string, rule string, pattern string, ids array<string>"))
    # each document meets the fixed rules that name its first matching sentence, by equality on that identifier
    first = named.select("row", "doc_id", "hits", "sequence", F.explode(F.array_distinct("hits.id")).alias("start"))
    matched = first.join(rules.withColumn("start", F.col("ids")[0]), "start").filter(F.expr("sequence rlike pattern"))
    used = F.expr("filter(hits, h -> array_contains(ids, h.id))")
    rows = matched.select("row", "doc_id", "licence", F.struct("place", "rule", used.alias("hits")).alias("best"))
    best = rows.groupBy("row", "doc_id", "licence").agg(F.min("best").alias("best"))
    return best.select(
        "doc_id", "licence", F.col("best.rule").alias("rule"), F.col("best.hits")[0]["position"].cast("bigint").alias("first_sentence"),
        F.size("best.hits").cast("bigint").alias("n_sentences"), F.array_join("best.hits.id", ",").alias("sentences"))


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(_known_form(v))}, {quoted(k)})" for k, v in SENTENCES.items())
    rules = ", ".join(f"({k}, {quoted(a)}, {quoted(b)}, {quoted(',' + ',(.*,)?'.join(ids) + ',')}, {quoted(',' + ','.join(ids) + ',')})" for k, (a, b, ids) in enumerate(RULES))
    clean = r"regexp_replace(regexp_replace(lower(part), '[^\p{L}\p{N}.-]+', ' ', 'g'), '([0-9])\.([0-9])', '\1' || chr(2) || '\2', 'g')"
    return rf"""
with known(sentence, id) as (values {table}), rules(place, licence, rule, pattern, ids) as (values {rules}),
base as (select row_number() over () as r, doc_id, text from documents where text is not null),
parts as (select r, doc_id, generate_subscripts(s, 1) - 1 as position, unnest(s) as part from
  (select r, doc_id, string_split_regex(regexp_replace(text, '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '\n+') as s from base)),
hits as (select r, doc_id, position, id from (select *, trim(regexp_replace(replace(replace({clean}, '.', ' '), chr(2), '.'), ' +', ' ', 'g')) as sentence from parts) join known using (sentence)),
seqs as (select r, doc_id, ',' || string_agg(id, ',' order by position) || ',' as sequence from hits group by all),
best as (select r, doc_id, licence, min(place) as place from seqs, rules where regexp_matches(sequence, pattern) group by all)
select b.doc_id, b.licence, any_value(u.rule) as rule, min(h.position) as first_sentence, count(*) as n_sentences, string_agg(h.id, ',' order by h.position) as sentences
from best b join rules u using (place) join hits h on h.r = b.r and contains(u.ids, ',' || h.id || ',') group by b.r, b.doc_id, b.licence
"""


ORACLE = _oracle()
