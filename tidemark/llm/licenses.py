"""Licence scans by sentence rules, with DataFrame functions only.

Rules are licences with ordered sentences. A text is cut into pieces (lines and parts of lines), each one normalised:
lower case, runs of letters and digits with single spaces. First, sentences are recognised: a known sentence stands
where its words are those of whole pieces that follow each other, however lines are wrapped, whatever comment marks
they start with and wherever abbreviations and blank lines cut them; list numbers between them don't count. Of the
known sentences at a piece the longest one counts, and none that starts within an earlier one. So a text becomes a
sequence of sentence identifiers. Then each rule's identifiers are matched against this sequence, where sentences
follow each other without other pieces between; at a sentence the longest rule counts, and none that starts within an
earlier match. Pieces are numbered as they are cut.

Each licence of an SPDX expression (OR, AND) is a sentence of its own; exceptions (WITH) don't count.

Defined cases: null and empty texts have no rows; a sentence that occurs twice gives two matches; equal texts
give equal matches; repeated rows (one ``doc_id``, one text) count once, different texts of one ``doc_id`` are each
scanned on their own; a line that goes on in lower case belongs to the sentence before it; columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Full names of licences, with versions (none: the name alone).
NAMES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "MIT License", ()),
    ("MIT-0", "MIT No Attribution License", ()),
    ("X11", "X11 License", ()),
    ("ISC", "ISC License", ()),
    ("0BSD", "BSD Zero Clause License", ()),
    ("BSD-2-Clause", "BSD 2-Clause License", ()),
    ("BSD-3-Clause", "BSD 3-Clause License", ()),
    ("BSD-4-Clause", "BSD 4-Clause License", ()),
    ("Apache-1.1", "Apache License", ("1.1",)),
    ("Apache-2.0", "Apache License", ("2.0", "2")),
    ("GPL-2.0-only", "GNU General Public License", ("2", "2.0")),
    ("GPL-3.0-only", "GNU General Public License", ("3", "3.0")),
    ("LGPL-2.0-only", "GNU Library General Public License", ("2", "2.0")),
    ("LGPL-2.1-only", "GNU Lesser General Public License", ("2.1",)),
    ("LGPL-3.0-only", "GNU Lesser General Public License", ("3", "3.0")),
    ("AGPL-3.0-only", "GNU Affero General Public License", ("3", "3.0")),
    ("GFDL-1.3-only", "GNU Free Documentation License", ("1.3",)),
    ("MPL-1.1", "Mozilla Public License", ("1.1",)),
    ("MPL-2.0", "Mozilla Public License", ("2.0", "2")),
    ("EPL-1.0", "Eclipse Public License", ("1.0", "1")),
    ("EPL-2.0", "Eclipse Public License", ("2.0", "2")),
    ("EUPL-1.2", "European Union Public Licence", ("1.2",)),
    ("CDDL-1.0", "Common Development and Distribution License", ("1.0",)),
    ("CPL-1.0", "Common Public License", ("1.0",)),
    ("Artistic-1.0", "Artistic License", ("1.0",)),
    ("Artistic-2.0", "Artistic License", ("2.0",)),
    ("AFL-3.0", "Academic Free License", ("3.0",)),
    ("OSL-3.0", "Open Software License", ("3.0",)),
    ("BSL-1.0", "Boost Software License", ("1.0",)),
    ("BUSL-1.1", "Business Source License", ("1.1",)),
    ("SSPL-1.0", "Server Side Public License", ("1",)),
    ("Elastic-2.0", "Elastic License", ("2.0",)),
    ("MS-PL", "Microsoft Public License", ()),
    ("MS-RL", "Microsoft Reciprocal License", ()),
    ("MulanPSL-2.0", "Mulan Permissive Software License", ("2",)),
    ("UPL-1.0", "Universal Permissive License", ("1.0",)),
    ("NCSA", "University of Illinois/NCSA Open Source License", ()),
    ("OFL-1.1", "SIL Open Font License", ("1.1",)),
    ("PostgreSQL", "PostgreSQL License", ()),
    ("PSF-2.0", "Python Software Foundation License", ("2",)),
    ("Ruby", "Ruby License", ()),
    ("PHP-3.01", "PHP License", ("3.01",)),
    ("Zlib", "zlib License", ()),
    ("Unlicense", "Unlicense", ()),
    ("BlueOak-1.0.0", "Blue Oak Model License", ("1.0.0",)),
    ("CECILL-2.1", "CeCILL Free Software License Agreement", ("2.1",)),
    ("ODbL-1.0", "Open Data Commons Open Database License", ("1.0",)),
    ("ODC-By-1.0", "Open Data Commons Attribution License", ("1.0",)),
)
#: How a text names its licence, and a licence its version.
PHRASES = (
    "License: {}", "Licensed under the terms of the {}",
    "This product is licensed under the {}", "This product is licensed under the terms of the {}", "This project is licensed under the terms of the {}",
    "This software is licensed under the terms of the {}", "This program is licensed under the terms of the {}", "This work is licensed under the terms of the {}",
    "Licensed under the {}", "Released under the {}", "Distributed under the {}", "Published under the {}", "Available under the {}",
    "This project is licensed under the {}", "This work is licensed under the {}", "This software is licensed under the {}", "This program is licensed under the {}",
    "This file is licensed under the {}", "This code is licensed under the {}", "This package is licensed under the {}", "This library is licensed under the {}",
    "This project is released under the {}", "This software is released under the {}", "This code is released under the {}", "This work is released under the {}",
)
VERSIONS = ("{} {}", "{}, version {}", "{} v{}")
#: The first lines of licence texts whose heading has more than name and version.
HEADINGS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0-only", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0-only", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1-only", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0-only", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0-only", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Zlib", "The zlib License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License (MIT)"),
)
#: Creative Commons licences, their names and versions.
COMMONS = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
COMMONS_VERSIONS = ("2.0", "2.5", "3.0", "4.0")

#: Sentences of licence texts and notices.
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
)
_APACHE_END = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "See the License for the specific language governing permissions and limitations under the License",
)
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"

#: The licence texts' and notices' rules, each a licence and its sentences in order; a longer one comes beside its beginning.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", (_GRANT, _NOTICE)),
    ("MIT", (_GRANT, _NOTICE, *_AS_IS)),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", (*_APACHE, *_APACHE_END)),
    ("GPL-3.0-or-later", (_FREE.format("General Public License", 3), _HOPE)),
    ("GPL-3.0-or-later", (_FREE.format("General Public License", 3),)),
    ("AGPL-3.0-or-later", (_FREE.format("Affero General Public License", 3),)),
    ("LGPL-3.0-or-later", (_FREE.format("Lesser General Public License", 3),)),
    ("GPL-2.0-or-later", ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",)),
    ("LGPL-2.1-or-later", ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",)),
    ("BSD-2-Clause", _BSD[:2]),
    ("BSD-2-Clause", _BSD[:3]),
    ("BSD-2-Clause", (*_BSD[:3], *_BSD_END)),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", (*_BSD, *_BSD_END)),
    ("ISC", (_ISC,)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",)),
    ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",)),
    ("EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",)),
    ("Zlib", ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",)),
    ("CC0-1.0", ("Licensed under CC0 1.0",)),
    ("CC0-1.0", ("Licensed under the Creative Commons Zero License",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain",)),
)


#: What an SPDX tag starts with, what stands between its licences, and before an exception.
SPDX = "SPDX-License-Identifier:"
EITHER = r"[ \t]+(?:OR|AND)[ \t]+"
EXCEPT = r"[ \t]WITH[ \t].*"


def all_rules() -> list[tuple[str, tuple[str, ...]]]:
    """``RULES``, headings, those made of names and phrases, and SPDX tags."""
    out = [*RULES, *((licence, (line,)) for licence, line in HEADINGS)]
    for licence, name, versions in NAMES:
        for full in [form.format(name, v) for v in versions for form in VERSIONS] or [name]:
            out += [(licence, (phrase.format(full),)) for phrase in PHRASES]
            out += [(licence, (full,))] if " " in full else []  # a heading
    for short, name in COMMONS:
        for v in COMMONS_VERSIONS:
            licence = f"CC-{short}-{v}"
            out += [(licence, (f"Licensed under CC {short} {v}",)), (licence, (f"This work is licensed under CC {short} {v}",))]
            out += [(licence, (f"{phrase} a Creative Commons {name} {v} International License",)) for phrase in ("Licensed under", "This work is licensed under")]
    out += [(licence, (tag.format(licence),)) for licence in dict.fromkeys(x for x, _ in out) for tag in (f"{SPDX} {{}}", "License: {}")]
    words: set[tuple[str, ...]] = set()
    return [(licence, parts) for licence, parts in out if (form := tuple(map(normalised, parts))) not in words and not words.add(form)]


#: Each rule has a sentence with one of these in lower case; a text without any needs no look-up.
MARKS = ("licen", "permission", "redistribut", "unencumbered")

#: A new line, with a comment mark or without, that goes on in lower case; what ends a sentence; what is no letter or digit.
GOES_ON = r"[ \t]*\r?\n[ \t]*(?:(?:[*#;%>]+|//+|--)[ \t]*)?([a-z])"
ENDS = r"[.!?]+[ \t\r\n]+|\r?\n[ \t\r\n]*"
OTHER = r"[^a-z0-9]+"
#: A list mark before a piece's words; a piece that is a list number.
LISTED = r"^[^A-Za-z0-9]*(?:[0-9]{1,2}|[a-z])\)[ \t]+"
NUMBER = "^(?:[0-9]{1,2}|[a-z])$"
#: Words of a piece's start by which sentences are looked up.
KEY = 2
#: Marks between a piece's number and its first word: a piece, a list number.
PIECE, LIST = "|", "="
MARK = "[0-9]+[|=]"


def normalised(sentence: str) -> str:
    """The form in which a sentence is looked up."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def rule_table() -> tuple[dict[str, int], list[tuple[int, str, list[int]]]]:
    """Identifiers of the known sentences, and (rule, licence, identifiers) of the rules."""
    sentences: dict[str, int] = {}
    out = []
    for rule, (licence, parts) in enumerate(all_rules(), 1):
        ids = [sentences.setdefault(normalised(p), len(sentences) + 1) for p in parts]
        out.append((rule, licence, ids))
    return sentences, out


def _clean(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), OTHER, " "))


def _plain(words: Column) -> Column:
    """Marked words as one string without marks."""
    return F.regexp_replace(F.array_join(words, " "), MARK, "")


def marked_words(docs: DataFrame) -> DataFrame:
    """``doc_id, row`` (tells texts of one ``doc_id`` apart), ``words``: the normalised words of texts that may hold a
    licence; the first one of a piece has the piece's number and a mark before it."""
    lower = F.lower("text")
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(lower, F.lit(mark))
    tag = lambda part, i: F.concat(F.when(i > 0, F.lit(f"{SPDX} ")).otherwise(F.lit("")), F.regexp_replace(part, EXCEPT, ""))
    one = lambda piece: F.when(F.contains(piece, F.lit(SPDX)), F.transform(F.split(piece, EITHER), tag)).otherwise(F.array(piece))
    cut = F.flatten(F.transform(F.split(F.regexp_replace("text", GOES_ON, " $1"), ENDS), one))
    each = F.transform(cut, lambda piece, i: F.struct(i.alias("sentence"), _clean(F.regexp_replace(piece, LISTED, "")).alias("clean")))
    shown = lambda x: F.concat(x["sentence"], F.when(x["clean"].rlike(NUMBER), LIST).otherwise(PIECE), x["clean"])
    words = F.split(F.array_join(F.transform(F.filter(each, lambda x: x["clean"] != ""), shown), " "), " ")
    return docs.where(marked).select("doc_id", F.xxhash64("text").alias("row"), words.alias("words"))


def sentences(docs: DataFrame) -> DataFrame:
    """The known sentences of each text: ``doc_id, row, sentence`` (number of its first piece), ``id, stop`` (after its
    last piece), ``next`` (the piece that follows, list numbers aside; null: none)."""
    spark = docs.sparkSession
    known, _ = rule_table()
    table = [(clean, i, len(clean.split()), " ".join(clean.split()[:KEY])) for clean, i in known.items()]
    keys, most = sorted({row[3] for row in table}), max(row[2] for row in table)
    # Known sentences are a constant of this module.
    lengths = F.broadcast(spark.createDataFrame(sorted({(row[3], row[2]) for row in table}), "key string, n_words int"))
    ids = F.broadcast(spark.createDataFrame([row[:2] for row in table], "clean string, id int"))
    # A place takes its next words along, as many as the longest sentence may need; the text itself stays behind.
    at = lambda i: _plain(F.slice("words", i + 1, KEY)).isin(keys) & F.contains(F.get("words", i), F.lit(PIECE))
    places = F.transform(F.filter(F.transform("words", lambda _, i: i), at), lambda i: F.slice("words", i + 1, 2 * most))
    # Outer, as a filter on the places would go below ``words`` and work them out again for each one.
    each = marked_words(docs).withColumn("places", places).select("doc_id", "row", F.explode_outer("places").alias("run"))
    each = each.withColumn("key", _plain(F.slice("run", 1, KEY))).join(lengths, "key")
    unlisted = F.filter("run", lambda w: ~F.contains(w, F.lit(LIST)))
    each = each.withColumn("run", F.explode(F.array_distinct(F.array("run", unlisted))))
    first, after = F.slice("run", 1, F.col("n_words")), F.get("run", F.col("n_words"))
    whole = each.where((F.size("run") >= F.col("n_words")) & (after.isNull() | after.rlike(MARK)))
    number = lambda word: F.regexp_extract(word, "^[0-9]+", 0).cast("int")
    begun = F.filter(first, lambda w: w.rlike(MARK))
    follows = F.filter(F.slice("run", F.col("n_words") + 1, 2 * most), lambda w: F.contains(w, F.lit(PIECE)))
    found = whole.withColumn("clean", _plain(first)).join(ids, "clean")
    found = found.select("doc_id", "row", number(F.get("run", F.lit(0))).alias("sentence"), F.struct("n_words", "id", (number(F.element_at(begun, -1)) + 1).alias("stop"), number(F.get(follows, F.lit(0))).alias("next")).alias("hit"))
    return found.groupBy("doc_id", "row", "sentence").agg(F.max("hit").alias("hit")).select("doc_id", "row", "sentence", "hit.id", "hit.stop", "hit.next")


#: Those of a text's rows that start within none before them.
APART = "coalesce(max(stop) over (partition by doc_id, row order by sentence rows between unbounded preceding and 1 preceding) <= sentence, true)"


def scan(docs: DataFrame) -> DataFrame:
    """One row a match: ``doc_id, sentence, n_sentences, rule, license``."""
    _, rules = rule_table()
    most = max(len(ids) for _, _, ids in rules)
    table = docs.sparkSession.createDataFrame([(r, name, ids, len(ids), ids[0]) for r, name, ids in rules], "rule int, license string, ids array<int>, n int, first int")
    apart = sentences(docs).withColumn("apart", F.expr(APART)).where("apart")
    ahead = Window.partitionBy("doc_id", "row").orderBy("sentence").rowsBetween(0, most - 1)
    sequence = apart.select("doc_id", "row", "sentence", F.col("id").alias("first"), F.collect_list(F.struct("id", "sentence", "stop", "next")).over(ahead).alias("seq"))
    follow = "forall(sequence(1, n), k -> coalesce(get(seq, k - 1).id = ids[k - 1] and (k = 1 or get(seq, k - 1).sentence = get(seq, k - 2).next), false))"
    # The rules are a constant of this module.
    found = sequence.join(F.broadcast(table), "first").where(F.expr(follow))
    best = found.groupBy("doc_id", "row", "sentence").agg(F.max(F.struct("n", (-F.col("rule")).alias("r"), "license", F.expr("seq[n - 1].stop").alias("stop"))).alias("best"))
    rows = best.select("doc_id", "row", "sentence", "best.*").withColumn("apart", F.expr(APART)).where("apart")
    return rows.select("doc_id", F.col("sentence").cast("long").alias("sentence"), F.col("n").cast("long").alias("n_sentences"), (-F.col("r")).alias("rule"), "license")


def scan_sql() -> str:
    """The same as one DuckDB statement over ``documents``."""
    known, rules = rule_table()
    most, longest = max(len(ids) for _, _, ids in rules), max(len(clean.split()) for clean in known)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(s)}, {i}, {len(s.split())}, {quoted(' '.join(s.split()[:KEY]))})" for s, i in known.items())
    rows = ", ".join(f"({r}, {quoted(name)}, {ids})" for r, name, ids in rules)
    marks = " or ".join(f"contains(lower(text), {quoted(m)})" for m in MARKS)
    plain = lambda words: f"regexp_replace(array_to_string({words}, ' '), '{MARK}', '', 'g')"
    number = lambda word: f"cast(regexp_extract({word}, '^[0-9]+') as int)"
    earlier = "max(stop) over (partition by doc_id order by sentence rows between unbounded preceding and 1 preceding)"
    return rf"""
with known(clean, id, n, key) as (values {table}), rules(rule, license, ids) as (values {rows}),
cut as (select doc_id, regexp_split_to_array(regexp_replace(text, '{GOES_ON}', ' \1', 'g'), '{ENDS}') as s from documents where {marks}),
tags as (select doc_id, flatten(list_transform(s, lambda piece: case when contains(piece, '{SPDX}')
    then list_transform(regexp_split_to_array(piece, '{EITHER}'), lambda part, i: (case when i > 1 then '{SPDX} ' else '' end) || regexp_replace(part, '{EXCEPT}', '', 'g'))
    else [piece] end)) as s from cut),
clean as (select doc_id, list_transform(s, lambda piece: trim(regexp_replace(lower(regexp_replace(piece, '{LISTED}', '')), '{OTHER}', ' ', 'g'))) as s from tags),
shown as (select doc_id, list_transform(s, lambda c, i: case when c = '' then null else (i - 1) || (case when regexp_matches(c, '{NUMBER}') then '{LIST}' else '{PIECE}' end) || c end) as s from clean),
words as (select doc_id, string_split(array_to_string(list_filter(s, lambda c: c is not null), ' '), ' ') as w from shown),
places as (select doc_id, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: contains(w[i], '{PIECE}')), lambda i: w[i:i + {2 * longest - 1}])) as run from words),
keyed as (select doc_id, run, {plain(f"run[1:{KEY}]")} as key from places),
kept as (select * from keyed where key in (select key from known)),
variants as (select doc_id, key, unnest([run, list_filter(run, lambda c: not contains(c, '{LIST}'))]) as run from kept),
hits as (
    select doc_id, {number("run[1]")} as sentence, n, id, 1 + {number("list_filter(run[1:n], lambda c: regexp_matches(c, '" + MARK + "'))[-1]")} as stop,
        {number(f"list_filter(run[n + 1:], lambda c: contains(c, '{PIECE}'))[1]")} as next
    from variants join known using (key)
    where len(run) >= n and (len(run) = n or regexp_matches(run[n + 1], '{MARK}')) and {plain("run[1:n]")} = clean
),
longest as (select *, row_number() over (partition by doc_id, sentence order by n desc, id desc, stop desc, next desc nulls last) as k from hits),
starts as (select *, {earlier} as until from longest where k = 1),
sequences as (
    select doc_id, sentence, list({{'id': id, 'sentence': sentence, 'stop': stop, 'next': next}}) over (partition by doc_id order by sentence rows between current row and {most - 1} following) as seq
    from starts where until is null or until <= sentence
),
found as (
    select doc_id, sentence, len(ids) as n, rule, license, seq[len(ids)].stop as stop from sequences join rules on seq[1].id = ids[1]
    where list_transform(seq[:len(ids)], lambda x: x.id) = ids
        and len(list_filter(range(2, len(ids) + 1), lambda k: coalesce(seq[k].sentence = seq[k - 1].next, false))) = len(ids) - 1
),
best as (select *, row_number() over (partition by doc_id, sentence order by n desc, rule) as k from found),
marked as (select *, {earlier} as until from best where k = 1)
select doc_id, cast(sentence as bigint) as sentence, cast(n as bigint) as n_sentences, rule, license from marked where until is null or until <= sentence
"""
