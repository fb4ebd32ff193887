"""License scans by a positional rare-token index, in SQL functions only; no shuffle but that of the word counts.

Templates are short texts that go with a licence.  Their words and places are postings (template, place) with an
idf = 1 + ln((files + 1) / (files with the word + 1)) over all files: a word that every file has still counts for its
place.  The index names, for each rare word, its postings: a template enters it with its anchors, its rarest postings, as
many as carry more than 1 - AGREE of its idf.

A file's own words are gone through once: those that the index has, its rarest words of licences, are looked up.  Each
posting found gives an alignment, a template and the place in the file less the place in the template.  Of each
alignment, the template's whole postings are intersected with the file by relative position: its share is the idf of those
that stand at their place, over the template's whole idf.  As an alignment without any anchor cannot reach AGREE, none is
missed.  Where an alignment has a share of AGREE or more, the template's key phrases are verified, word by word and last: it
counts if all of them stand in the file.

The index, the postings and the key phrases are literals of the plan: one expression, whatever the number of templates.
Beside that the base phrases are counted everywhere: places where their words stand consecutively.

Cases: a null or empty text has no words, null places, empty labels and score 0; a very long text is gone through whole; a
null id and repeated rows give a row each; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.llm.texts import quoted

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, words that go with the licence, key phrases that must all stand in the file): notices and first sentences.
TEMPLATES = [
    ("agpl", "gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted free of charge", "to any person obtaining a copy")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
]
#: The same for whole paragraphs, of licences that only several phrases together tell from their relatives.
TEMPLATES += [
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2 0", "unless required by applicable law or agreed to in writing", "without warranties or conditions of any kind"),
    ),
    (
        "boost-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use "
        "reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ("any person or organization obtaining a copy of the software", "reproduce display distribute execute and transmit the software"),
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission",
        ("redistributions in binary form must reproduce the above copyright notice", "may be used to endorse or promote products derived from this software"),
    ),
    (
        "cc0-1.0",
        "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
        ("to the extent possible under law", "copyright and related and neighboring rights"),
    ),
    (
        "gpl-2.0-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation", "either version 2 of the license or at your option any later version"),
    ),
    (
        "gpl-3.0-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation", "either version 3 of the license or at your option any later version"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ("with or without fee is hereby granted", "the author disclaims all warranties with regard to this software"),
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction", "shall be included in all copies or substantial portions of the software"),
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as "
        "a compiled binary for any purpose commercial or non commercial and by any means",
        ("unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ("in no event will the authors be held liable for any damages", "to alter it and redistribute it freely"),
    ),
]
#: The share of a template's idf that must agree.
AGREE = 0.6

Template = tuple[str, str, tuple[str, ...]]


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def idf_of(docs: DataFrame, text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> dict[str, float]:
    """The idf of every template word over all files; as many rows as the templates have words reach the driver."""
    known = vocabulary(templates)
    own = F.array_intersect(words(F.col(quoted(text_col))), F.array(*map(F.lit, known)))
    seen = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    have = {r.word: r.n for r in seen.collect()}
    return {w: 1 + math.log((have.get("", 0) + 1) / (have.get(w, 0) + 1)) for w in known}


def _places(phrase: str) -> str:
    """SQL: the places of the word array w where the phrase starts."""
    parts = phrase.split()
    same = " AND ".join(f"get(w, p + {k}) = '{x}'" for k, x in enumerate(parts))
    found = f"filter(sequence(0, size(w) - 1), p -> {same})"
    return f"CASE WHEN array_contains(w, '{parts[-1]}') AND array_contains(w, '{parts[0]}') THEN {found} ELSE cast(array() AS array<int>) END"


def anchors(text: str, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The rarest words of the template and their places; any alignment with a share of AGREE has one of them."""
    postings = sorted(((w, k) for k, w in enumerate(text.split())), key=lambda x: (-idf[x[0]], x[1]))
    total, mass, out = sum(idf[w] for w, _ in postings), 0.0, []
    for w, k in postings:
        out.append((w, k))
        mass += idf[w]
        if mass > (1 - AGREE + 1e-5) * total:  # more than the rounding of shares
            break
    return out


def _sql_index(templates: Sequence[Template], idf: dict[str, float]) -> tuple[str, list[str]]:
    """SQL: a map from each anchor word to its postings; and those words."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text, _) in enumerate(templates):
        for w, k in anchors(text, idf):
            index.setdefault(w, []).append((t, k))
    return "map(" + ", ".join(f"'{w}', array({', '.join(f"named_struct('t', {t}, 'p', {k})" for t, k in found)})" for w, found in sorted(index.items())) + ")", sorted(index)


def _sql_postings(templates: Sequence[Template], idf: dict[str, float]) -> str:
    """SQL: the postings of every template, and its whole idf."""
    each = []
    for _, text, _ in templates:
        own = [(w, k, idf[w]) for k, w in enumerate(text.split())]
        posts = ", ".join(f"named_struct('w', '{w}', 'p', {k}, 'v', {v!r}D)" for w, k, v in own)
        each.append(f"named_struct('posts', array({posts}), 'total', {sum(v for _, _, v in own)!r}D)")
    return f"array({', '.join(each)})"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """`id_col`, n_words, n_base, first_word, last_word, base_labels, labels and score for every row."""
    idf = idf_of(docs, text_col, templates)
    index, rare = _sql_index(templates, idf)
    strings = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    keys = "array(" + ", ".join(strings(f" {k} " for k in phrases) for _, _, phrases in templates) + ")"
    name = quoted(id_col)
    df = docs.select(F.col(name), words(F.col(quoted(text_col))).alias("w"))
    # the file's rarest words of licences with their places, and the alignments that they tell of
    in_index = ", ".join(f"'{x}'" for x in rare)
    found = f"filter(transform(w, (x, i) -> named_struct('x', x, 'i', i)), h -> h.x IN ({in_index}))"
    df = df.selectExpr(name, "w", *(f"{_places(p)} AS b{k}" for k, p in enumerate(BASE)), f"{found} AS found")
    lined = f"array_distinct(flatten(transform(found, h -> transform(element_at({index}, h.x), q -> named_struct('t', q.t, 'a', h.i - q.p)))))"
    df = df.withColumn("lined", F.expr(lined)).drop("found")
    # postings intersected by relative position
    posts = f"element_at({_sql_postings(templates, idf)}, x.t + 1)"
    share = f"round(aggregate({posts}.posts, 0D, (s, y) -> s + CASE WHEN get(w, x.a + y.p) = y.w THEN y.v ELSE 0D END) / {posts}.total, 6)"
    df = df.withColumn("agreed", F.expr(f"filter(transform(lined, x -> named_struct('t', x.t, 's', {share})), x -> x.s >= {AGREE}D)")).drop("lined")
    # the key phrases of what agrees, last
    df = df.withColumn("line", F.expr("CASE WHEN size(agreed) > 0 THEN concat(' ', array_join(w, ' '), ' ') END"))
    kept = f"filter(array_distinct(transform(agreed, x -> x.t)), t -> forall(element_at({keys}, t + 1), k -> contains(line, k)))"
    df = df.withColumn("held", F.expr(f"CASE WHEN size(agreed) > 0 THEN {kept} ELSE cast(array() AS array<int>) END")).drop("line")
    places = f"concat({', '.join(f'b{k}' for k in range(len(BASE)))})"
    ours = ", ".join(f"CASE WHEN size(b{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE.values()))
    theirs = f"transform(held, t -> element_at({strings(label for label, _, _ in templates)}, t + 1))"
    tidy = lambda x: f"array_join(array_sort(array_distinct(array_compact({x}))), ',')"
    return df.selectExpr(
        name,
        "cast(size(w) AS bigint) AS n_words",
        f"cast(size({places}) AS bigint) AS n_base",
        f"cast(array_min({places}) AS bigint) AS first_word",
        f"cast(array_max({places}) AS bigint) AS last_word",
        f"{tidy(f'array({ours})')} AS base_labels",
        f"{tidy(f'concat(array({ours}), {theirs})')} AS labels",
        "coalesce(array_max(transform(filter(agreed, x -> array_contains(held, x.t)), x -> x.s)), 0D) AS score",
    )
