"""License scans: phrases by place, and an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is any passage of consecutive words, across line breaks, of half as many words again as the template (rounded up), so that a
notice that wraps or has a few words put in is whole in one, and words scattered over a long line are in none. A template is found where
a block holds at least the containment threshold of its distinct words. Template words are ordered by their document frequency over the
whole table, rarest first. With need = ceil(threshold * size):

* prefix filter: a block has one of the template's first size - need + 1 words in the order; only the words around such a word are looked at;
* positional and length filter: of the template's words from the shared one on, those words must hold `need` distinct ones;
* what is left is verified by the whole intersection, in every block around the shared word; of templates of SHORT words at most, also by their order.

`scan(..., lines=True)` takes single lines as blocks instead, of any length; it loses notices that wrap. There words that no template
holds are left out first, the length and positional filters are those of sets, and order doesn't count. The templates are a fixed parameter, so their index
is a constant of bounded size, and the join with it needs no shuffle: each row finds its own labels, whatever its doc_id.

Null and empty texts have no words, no labels and a score of 0; rows with a null doc_id and rows that share one are judged each by its own text;
repeated rows repeat; very long texts are searched whole; labels are distinct, so ties show once; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII marks part words; all else is in them.
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Phrases whose places are reported, with their labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Wording of license notices and headers (fixed values), with their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "all rights reserved"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
]
#: Templates of so many words at most must stand in order; sets of so few words say little.
SHORT = 8


def words(text: Column) -> Column:
    parted = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + MARKS, "abcdefghijklmnopqrstuvwxyz" + " " * len(MARKS))
    return F.array_remove(F.split(parted, " "), "")


def phrase_places(w: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, as an array of word positions from 0."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        condition = F.get(w, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            condition = condition & F.coalesce(F.get(w, i + k) == part, F.lit(False))
        return condition

    none = F.array().cast("array<int>")
    return F.when(F.array_contains(w, parts[-1]) & (F.size(w) > 0), F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)).otherwise(none)


def template_index(frequencies: dict[str, int], templates: list[tuple[str, str]], threshold: float) -> tuple[dict[str, int], list[dict]]:
    """The rank of each template word (rarest first, ties by word), and each template's ranks in that order, size and need."""
    vocabulary = {w for _, text in templates for w in text.split(" ")}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequencies.get(w, 0), w)))}
    index = []
    for label, text in templates:
        ranks = sorted({rank[w] for w in text.split(" ")})
        index.append({"label": label, "ranks": ranks, "size": len(ranks), "text": text.split(" "), "need": ceil(threshold * len(ranks) - 1e-9), "width": ceil(1.5 * len(text.split(" ")))})
    return rank, index


def _constant(rows: list[tuple], kind: str) -> Column:
    """An array of structs as one literal."""
    return F.from_json(F.lit(json.dumps([dict(zip([c.split(":")[0] for c in kind.split(";")], r)) for r in rows])), f"array<struct<{kind.replace(';', ',')}>>")


def _line_matches(rank: dict[str, int], index: list[dict]) -> Column:
    """label, overlap, size of the templates that single lines hold."""
    own = F.array(*map(F.lit, sorted(rank)))
    templates = _constant([(t["label"], t["ranks"], t["size"], t["need"]) for t in index], "label:string;ranks:array<int>;size:int;need:int")
    lead = sorted({w for t in index for w, r in rank.items() if r in t["ranks"][: t["size"] - t["need"] + 1]})
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])

    def matches(b: Column) -> Column:
        def one(t: Column) -> Column:
            def judged(both: Column) -> Column:
                first = F.get(both, F.lit(0))
                left = F.least(t["size"] - F.array_position(t["ranks"], first) + 1, F.size(b) - F.array_position(b, first) + 1)
                return F.when((F.size(both) >= t["need"]) & (left >= t["need"]), F.size(both)).otherwise(0)

            prefix = F.arrays_overlap(F.slice(t["ranks"], F.lit(1), t["size"] - t["need"] + 1), F.slice(b, F.lit(1), F.size(b) - t["need"] + 1))
            overlap = F.when((F.size(b) >= t["need"]) & prefix, F.get(F.transform(F.array(F.array_intersect(b, t["ranks"])), judged), F.lit(0))).otherwise(0)
            return F.struct(t["label"].alias("label"), overlap.cast("int").alias("overlap"), t["size"].alias("size"), t["need"].alias("need"))

        return F.filter(F.transform(templates, one), lambda x: x["overlap"] >= x["need"])

    blocks = F.transform(F.split("text", "\n"), lambda line: F.array_sort(F.transform(F.array_intersect(words(line), own), lambda x: ranks[x])))
    blocks = F.filter(blocks, lambda b: F.size(b) >= min(t["need"] for t in index))
    return F.when(F.arrays_overlap("w", F.array(*map(F.lit, lead))), F.flatten(F.transform(blocks, matches)))


def _passage_matches(rank: dict[str, int], index: list[dict]) -> Column:
    """label, overlap, size of the templates that passages hold.

    A passage that holds a template has its rarest shared word in the prefix and is within `width` words of it, so the words around
    the prefix words of a document hold all such passages.
    """
    word = {r: w for w, r in rank.items()}
    kind = "word:string;label:string;text:array<string>;own:array<string>;size:int;need:int;width:int;t_at:int"
    rows = [(word[r], t["label"], t["text"], [word[x] for x in t["ranks"]], t["size"], t["need"], t["width"], at) for t in index for at, r in enumerate(t["ranks"][: t["size"] - t["need"] + 1])]
    templates, w = _constant(rows, kind), F.col("w")
    leads = F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(sorted({x[0] for x in rows}))))

    def at(i: Column) -> Column:
        def one(t: Column) -> Column:
            first = F.greatest(i - t["width"] + 1, F.lit(0))

            def around(b: Column) -> Column:
                def held(s: Column) -> Column:
                    block = F.slice(b, s + 1, t["width"])
                    inside = F.size(F.array_intersect(block, t["own"]))
                    ordered = F.aggregate(block, F.lit(0), lambda n, x: n + (F.coalesce(F.get(t["text"], n) == x, F.lit(False))).cast("int")) == F.size(t["text"])
                    return F.when((F.size(t["text"]) > SHORT) | (inside < t["need"]), inside).otherwise(F.when(ordered, inside).otherwise(0))

                near = F.size(F.array_intersect(b, F.slice(t["own"], t["t_at"] + 1, t["size"]))) >= t["need"]
                return F.when(near, F.array_max(F.transform(F.sequence(F.lit(0), i - first), held))).otherwise(0)

            overlap = F.get(F.transform(F.array(F.slice(w, first + 1, i + t["width"] - first)), around), F.lit(0))
            return F.struct(t["label"].alias("label"), overlap.cast("int").alias("overlap"), t["size"].alias("size"), t["need"].alias("need"))

        mine = F.filter(templates, lambda t: t["word"] == F.get(w, i))
        return F.filter(F.transform(mine, one), lambda x: x["overlap"] >= x["need"])

    return F.flatten(F.transform(leads, at))


def scan(docs: DataFrame, threshold: float = 0.9, templates: list[tuple[str, str]] | None = None, lines: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (long), base_labels, labels (strings), score double."""
    templates = templates or TEMPLATES
    read = docs.select("doc_id", "text", words(F.col("text")).alias("w"))
    vocabulary = sorted({w for _, text in templates for w in text.split(" ")})
    own = F.array(*map(F.lit, vocabulary))
    counts = read.select(F.explode(F.array_intersect("w", own)).alias("word")).groupBy("word").count()
    rank, index = template_index({r["word"]: r["count"] for r in counts.collect()}, templates, threshold)
    found = F.transform((_line_matches if lines else _passage_matches)(rank, index), lambda x: F.struct(x["label"].alias("label"), (x["overlap"] / x["size"]).alias("share")))

    places = {label: phrase_places(F.col("w"), phrase) for label, phrase in PHRASES.items()}
    base = read.select("doc_id", F.size("w").cast("long").alias("n_words"), *(p.alias(f"p_{label}") for label, p in places.items()), F.coalesce(found, F.array().cast("array<struct<label:string,share:double>>")).alias("found"))
    every = F.concat(*(F.col(f"p_{label}") for label in PHRASES))
    own_labels = F.array_compact(F.array(*(F.when(F.size(f"p_{label}") > 0, F.lit(label)) for label in sorted(PHRASES))))
    labels = F.array_sort(F.array_union(own_labels, F.transform("found", lambda x: x["label"])))
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return base.select("doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_join(own_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
