"""Licence scan (native): a positional index of rare licence words.

The document frequency of every licence word is counted over all files. A licence word is rare if its smoothed IDF,
log((files + 20) / (files with it + 0.5)), is at least log 4; the two rarest words of each template and of each mandatory
phrase are in the index whatever their IDF, so that no group of copies takes its licence out of it. All of a file's words
that are in the index are looked up in the postings of the templates; each place gives (template, place - template
position). Pairs that two places or more agree on are alignments, so every place of a mandatory phrase is one. An alignment whose mandatory phrases all stand where the template has them gives the template's
label; the score is the largest share of a template's words that stand in place in an alignment, 0 without one.

Base phrases are looked for beside this, and their labels always stay.

Defined results: null and empty texts have no words, places or labels; repeated rows are judged alike; extra columns
stay; a column named as the result column is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH, LEAST_IDF = 20.0, math.log(4.0)
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, words of the template (a licence's published header, grant or notice), its mandatory phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "this software and associated documentation files"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ["permission is hereby granted free of charge", "to any person obtaining a copy"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2", "compliance with the license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ["cc by nc sa"]),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ["cc by nc nd"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "released under the creative commons cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3 of the license"]),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2 of the license"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ["gnu lesser general public license", "version 3 of the license"]),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ["gnu lesser general public license", "version 2 1 of the license"]),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license", "version 3 of the license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("agpl-3", "licensed under the gnu affero general public license v3", ["gnu affero general public license v3"]),
    ("gpl-3", "licensed under the gnu general public license v3", ["gnu general public license v3"]),
    ("gpl-2", "licensed under the gnu general public license v2", ["gnu general public license v2"]),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["creative commons attribution noncommercial sharealike 4 0"]),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", ["creative commons attribution noncommercial noderivatives 4 0"]),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ["creative commons attribution noderivatives 4 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["to any person or organization obtaining a copy"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "in no event will the authors be held liable"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software"]),
    ("wtfpl", "do what the fuck you want to public license", ["do what the fuck you want to"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]
#: Published identifiers, as words, and their labels. What follows one (only, or later) makes no difference.
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd",
    "mpl 2 0": "mpl-2", "epl 2 0": "epl-2", "isc": "isc", "bsl 1 0": "bsl-1", "zlib": "zlib", "unlicense": "unlicense", "wtfpl": "wtfpl", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc",
}
TEMPLATES += [(label, f"spdx license identifier {words}", [f"spdx license identifier {words}"]) for words, label in IDENTIFIERS.items()]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def _always(idf: dict[str, float]) -> set[str]:
    """The two rarest words of each template and of each mandatory phrase."""
    parts = [p for _, text, phrases in TEMPLATES for p in (text, *phrases)]
    return {w for p in parts for w in sorted(set(p.split()), key=lambda w: (-idf[w], w))[:2]}


def rare_words(df: DataFrame, text: str = "text") -> list[str]:
    """The words of the index, highest IDF first; the counts of at most the templates' words reach the driver."""
    vocabulary = _vocabulary()
    words = df.select(words_of(F.col(text)).alias("w"))
    files, *_ = words.agg(F.count("*")).first()
    found = words.select(F.explode(F.array_intersect(_strings(vocabulary), "w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = dict(found.limit(len(vocabulary)).collect())
    idf = {w: math.log((files + SMOOTH) / (counts.get(w, 0) + 0.5)) for w in vocabulary}
    always = _always(idf)
    return sorted((w for w in vocabulary if idf[w] >= LEAST_IDF or w in always), key=lambda w: (-idf[w], w))


def scan(df: DataFrame, text: str = "text", into: str = "licence", rare: list[str] | None = None) -> DataFrame:
    """df with a struct column: words, base places and labels, all labels, score."""
    rare = rare_words(df, text) if rare is None else rare
    step = df.withColumn("__words", words_of(F.col(text)))
    w = F.col("__words")
    joined = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    step = step.withColumn("__joined", joined)
    at = lambda i, k: F.get(w, i + F.lit(k))

    # base phrases: places are listed only where a phrase occurs
    def places(phrase: str) -> Column:
        parts = phrase.split()
        here = lambda i: F.forall(_strings_at(parts), lambda p: F.get(w, i + p["k"]) == p["w"])
        listed = F.filter(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: at(i, 0) == parts[0]), here)
        return F.when(F.contains("__joined", F.lit(f" {phrase} ")), listed).otherwise(F.array().cast("array<int>"))

    for k, phrase in enumerate(BASE):
        step = step.withColumn(f"__p{k}", places(phrase))
    every = F.concat(*(F.col(f"__p{k}") for k in range(len(BASE))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"__p{k}") > 0, F.lit(x)) for k, x in enumerate(BASE.values()))))
    step = step.withColumn("__places", every).withColumn("__base", base_labels)

    # the method: (template, offset) of every place of the file's words that are in the index
    spots: dict[str, list[tuple[int, int]]] = {}
    for t, (_, body, _) in enumerate(TEMPLATES):
        for k, word in enumerate(body.split()):
            if word in rare:
                spots.setdefault(word, []).append((t, k))
    step = step.withColumn("__rare", F.array_intersect(_strings(rare), w))
    if spots:
        postings = F.create_map(*(x for word, found in spots.items() for x in (F.lit(word), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in found)))))
        here = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains("__rare", x), F.struct(x.alias("w"), i.alias("i")))), lambda s: s.isNotNull())
        step = step.withColumn("__here", F.when(F.size("__rare") > 0, here))
        hits = F.flatten(F.transform("__here", lambda s: F.transform(F.element_at(postings, s["w"]), lambda q: F.struct(q["t"].alias("t"), (s["i"] - q["k"]).alias("o")))))
        step = step.withColumn("__sorted", F.array_sort(hits))
        same = lambda x, j: F.coalesce(F.get("__sorted", j) == x, F.lit(False))
        step = step.withColumn("__aligned", F.array_distinct(F.filter("__sorted", lambda x, j: same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))))))
        bodies = F.array(*(_strings(body.split()) for _, body, _ in TEMPLATES))
        phrases = F.array(*(_placed(body, found) for _, body, found in TEMPLATES))
        share = lambda x: F.size(F.filter(F.transform(F.get(bodies, x["t"]), lambda b, k: (x["o"] + k >= 0) & F.coalesce(F.get(w, F.greatest(x["o"] + k, F.lit(0))) == b, F.lit(False))), lambda b: b)) / F.size(F.get(bodies, x["t"]))
        stands = lambda x: F.forall(F.get(phrases, x["t"]), lambda p: (x["o"] + p["k"] >= 0) & F.coalesce(F.get(w, F.greatest(x["o"] + p["k"], F.lit(0))) == p["w"], F.lit(False)))
        names = _strings([label for label, _, _ in TEMPLATES])
        own = F.coalesce(F.transform(F.filter("__aligned", stands), lambda x: F.get(names, x["t"])), F.array().cast("array<string>"))
        score = F.coalesce(F.array_max(F.transform("__aligned", share)), F.lit(0.0))
    else:
        own, score = F.array().cast("array<string>"), F.lit(0.0)
    result = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size("__places").cast("long").alias("n_base"),
        F.array_min("__places").cast("long").alias("first_word"),
        F.array_max("__places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("__base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("__base", own))), ",").alias("labels"),
        score.cast("double").alias("score"),
    )
    return step.select(*(F.col(f"`{c}`") for c in df.columns if c != into), result.alias(into))


def _strings_at(words: list[str], start: int = 0) -> Column:
    return F.array(*(F.struct(F.lit(start + k).alias("k"), F.lit(x).alias("w")) for k, x in enumerate(words)))


def _placed(body: str, phrases: list[str]) -> Column:
    """Each word of the mandatory phrases with its place in the template."""
    words = body.split()
    starts = [next(k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()) for p in phrases]
    return F.concat(*(_strings_at(p.split(), k) for p, k in zip(phrases, starts, strict=True)))


def report(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row a document: its id and the result's fields."""
    return scan(df.select(row_id, text), text, "__licence").select(row_id, "__licence.*")
