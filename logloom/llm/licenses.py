"""License scan by a positional index of rare template words, with DataFrame functions only.

Every text is split once, and only words of the licence vocabulary are kept, with their positions. The document
frequency of each such word over all documents gives its IDF. Each template is indexed by its highest-IDF words, with
their positions. A file's occurrences of them look up the postings: those that agree, within a few words, on where the
template would begin vote for that alignment, and one with enough votes is a licence if every word of the template's
mandatory key phrases stands at its place relative to it. Besides, base phrases label a text wherever they stand.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import alnum_words, checkpointed

BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Openings of public licence texts by label, and the phrases that each must contain.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted", "permission notice appear in all copies"),
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "with or without modification are permitted"),
    ),
    "apache": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        ("may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing"),
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("redistribute it and or modify it under the terms of the gnu general public license",),
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ("subject to the terms of the mozilla public license",),
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        ("under the terms of the gnu lesser general public license",),
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("under the terms of the gnu affero general public license",),
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        ("made available under the terms of the eclipse public license",),
    ),
    "boost": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        ("permission is hereby granted free of charge", "to use reproduce display distribute execute and transmit the software"),
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("in no event will the authors be held liable for any damages", "to alter it and redistribute it freely"),
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        ("free and unencumbered software released into the public domain",),
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0 or send a letter to Creative Commons",
        ("licensed under a creative commons attribution 4 0 international license",),
    ),
    "cc0": (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights to this work",),
    ),
    "bsd-3": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("may be used to endorse or promote products derived from this software without specific prior written permission",),
    ),
    "0bsd": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
        ("with or without fee is hereby granted the software is provided as is",),
    ),
    "gpl-2": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        ("gnu general public license as published by the free software foundation either version 2 of the license",),
    ),
    "lgpl-3": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("gnu lesser general public license as published by the free software foundation either version 3 of the license",),
    ),
    "gfdl": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts",
        ("under the terms of the gnu free documentation license",),
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0 or send a letter to Creative Commons",
        ("licensed under a creative commons attribution sharealike 4 0 international license",),
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0 or send a letter to Creative Commons",
        ("licensed under a creative commons attribution noncommercial 4 0 international license",),
    ),
    "cddl": (
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License",
        ("subject to the terms of the common development and distribution license",),
    ),
    "eupl": (
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence",
        ("as soon they will be approved by the european commission", "subsequent versions of the eupl"),
    ),
    "artistic": (
        "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software",
        ("the copyright holder maintains some artistic control over the development of that package",),
    ),
    "ofl": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at",
        ("licensed under the sil open font license",),
    ),
    "postgresql": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
        ("without a written agreement is hereby granted", "this paragraph and the following two paragraphs appear in all copies"),
    ),
    "ms-pl": (
        "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software",
        ("governs use of the accompanying software if you use the software you accept this license",),
    ),
    "ncsa": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("to deal with the software without restriction",),
    ),
    "openssl": (
        "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit",
        ("software developed by the openssl project for use in the openssl toolkit",),
    ),
    "psf": (
        "PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly, prepare derivative works, distribute, and otherwise use Python alone or in any derivative version",
        ("psf hereby grants licensee a nonexclusive royalty free world wide license",),
    ),
}
#: Words too common to index.
STOP_WORDS = frozenset("a an and any are as at be by for if in is it its may not of on one or that the this to was with you can your all".split())


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_tables(templates=TEMPLATES) -> tuple[list, list]:
    """Postings (template, word, t_at) of words worth indexing, and the mandatory phrases (template, words, t_at)."""
    postings, mandatory = [], []
    for name, (text, phrases) in templates.items():
        words = words_of(text)
        postings += [(name, w, i) for i, w in enumerate(words) if w not in STOP_WORDS]
        for phrase in phrases:
            parts = words_of(phrase)
            mandatory.append((name, parts, next(i for i in range(len(words)) if words[i : i + len(parts)] == parts)))
    return postings, mandatory


def _places(parts: list[str]) -> Column:
    """Where words stand consecutively, from the columns words and hits (struct of word and at); looked for by their longest kept one."""
    lead = max((k for k, w in enumerate(parts) if w not in STOP_WORDS), key=lambda k: len(parts[k]))

    def fits(h: Column) -> Column:
        fit = (h["word"] == parts[lead]) & (h["at"] >= lead)
        for k, w in enumerate(parts):
            if k != lead:
                fit = fit & F.coalesce(F.get("words", h["at"] + (k - lead)) == w, F.lit(False))
        return fit

    return F.transform(F.filter("hits", fits), lambda h: h["at"].cast("long") - lead)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE_PHRASES, rare_words: int = 12, min_votes: int = 4, slack: int = 8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found, a row for each row of docs.

    n_base counts the places of all base phrases; first_word and last_word are the smallest and largest start of one,
    from 0, else null. labels joins the base labels and those of aligned templates, all that a file holds. found lists
    the alignments (label, begins, votes). score is 1 with a base label, else the share of a template's `rare_words`
    indexed words that agree on its best verified alignment, else 0. Votes agree if no two neighbouring ones are more than
    `slack` words apart, so that a few inserted or dropped words do no harm. Null and empty texts have no words and no
    labels; a text is looked at whole, whatever its length; repeated rows and doc_ids are rows of their own; an empty
    table gives no rows. Columns but doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    postings, mandatory = template_tables(templates)
    vocabulary = sorted({w for _, w, _ in postings} | {w for _, parts, _ in mandatory for w in parts if w not in STOP_WORDS} | {w for phrase, _ in base for w in phrase.split()})
    words = docs.select("doc_id", alnum_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    at = F.filter(F.sequence(F.lit(0), F.col("n_words").cast("int") - 1), lambda i: F.get("words", i).isin(vocabulary))
    at = F.when(F.col("n_words") > 0, at).otherwise(F.array().cast("array<int>"))
    hits = words.withColumn("hits", F.transform(at, lambda i: F.struct(F.get("words", i).alias("word"), i.alias("at"))))
    hits = hits.withColumns({f"at_{label}": _places(phrase.split()) for phrase, label in base})
    mark = lambda n: lambda x: F.struct(F.lit(n).alias("phrase"), x.alias("at"))
    placed = F.concat(*[F.transform(_places(parts), mark(n)) for n, (_, parts, _) in enumerate(mandatory)])
    hits = hits.withColumn("phrases", F.when(F.size("hits") >= min_votes, placed).otherwise(F.array().cast("array<struct<phrase:int,at:bigint>>")))
    seen = checkpointed(hits.drop("words").withColumn("uid", F.monotonically_increasing_id()))

    # One row for each word of the fixed vocabulary at most: the statistics are small however many documents there are.
    n_docs = seen.count()
    each = seen.select("uid", F.explode("hits").alias("h")).select("uid", "h.word", "h.at")
    df = each.select("uid", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    indexed = F.broadcast(spark.createDataFrame(postings, "template string, word string, t_at int"))
    rarity = indexed.select("template", "word").distinct().join(df, "word", "left").withColumn("idf", F.log((n_docs + 1) / (F.coalesce("df", F.lit(0)) + 1)))
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.col("idf").desc(), "word"))
    index = checkpointed(rarity.withColumn("rank", rank).where(F.col("rank") <= rare_words).join(indexed, ["template", "word"]).select("template", "word", "t_at"))
    looked = F.broadcast(index.groupBy("template").agg(F.count_distinct("word").alias("looked")))

    begun = each.join(F.broadcast(index), "word").select("uid", "template", "word", (F.col("at") - F.col("t_at")).alias("begins"))
    in_order = Window.partitionBy("uid", "template").orderBy("begins", "word")
    opens = F.when(F.col("begins") - F.lag("begins").over(in_order) <= slack, 0).otherwise(1)
    runs = begun.withColumn("opens", opens).withColumn("run", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    cast = runs.groupBy("uid", "template", "run").agg(F.count_distinct("word").alias("votes"), F.min("begins").alias("begins"), F.max("begins").alias("ends")).where(F.col("votes") >= min_votes)
    needed = F.broadcast(spark.createDataFrame([(n, name, at) for n, (name, _, at) in enumerate(mandatory)], "phrase int, template string, p_at int"))
    n_needed = F.broadcast(needed.groupBy("template").agg(F.count("*").alias("needed")))
    stand = seen.select("uid", F.explode("phrases").alias("p")).select("uid", "p.phrase", F.col("p.at").alias("place")).join(needed, "phrase")
    met = cast.join(stand, ["uid", "template"]).where((F.col("place") - F.col("p_at")).between(F.col("begins") - slack, F.col("ends") + slack))
    met = met.groupBy("uid", "template", "begins", "votes").agg(F.count_distinct("phrase").alias("met"))
    sure = met.join(n_needed, "template").where("met = needed").join(looked, "template")
    found = sure.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct(F.col("template").alias("label"), "begins", "votes"))).alias("found"), F.max(F.col("votes") / F.col("looked")).alias("share"))

    starts = F.concat(*[F.col(f"at_{label}") for _, label in base])
    named = F.filter(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for _, label in base]), lambda x: x.isNotNull())
    out = seen.join(found, "uid", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<label:string,begins:int,votes:bigint>>")))
    return out.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(named, F.col("found.label")))), ",").alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        "found",
    )
