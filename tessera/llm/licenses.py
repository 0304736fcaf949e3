"""Operator 10: licence scans with a positional index of rare words.

Templates (fixed licence notices) are indexed by word: word -> (template, position). Document
frequencies of the templates' words are counted over all rows; they give the words' IDF. Of
each template a file looks up the ``top_words`` highest-IDF words that it holds, and every
occurrence votes for the place where the template would begin. Votes at
places within ``slack`` words of each other are one alignment. An alignment that enough of
the template's rare words share is verified by the template's mandatory key phrases, whose
words must stand consecutively within the aligned span.

Plain phrases (``PHRASES``) are found as consecutive words in every text whatever the index
says, and give the base labels.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import prepare

TOP_WORDS = 6
SLACK = 2
MIN_SHARE = 0.6
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases and their base labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Licence notices (public wording), label -> [(notice, mandatory key phrases)]. What tells versions apart is a key phrase.
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} public license as published by the free software foundation"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
TEMPLATES = {
    "apache-2.0": [
        ("licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
        ("you may not use this file except in compliance with the license you may obtain a copy of the license at",
         ["except in compliance with the license"]),
    ],
    "bsd": [(_BSD, ["redistribution and use in source and binary forms"])],
    "bsd-3-clause": [
        ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
         "this software without specific prior written permission", ["neither the name of", "without specific prior written permission"]),
        ("licensed under the bsd 3 clause license", ["bsd 3 clause license"]),
    ],
    "bsl-1.0": [("distributed under the boost software license version 1 0", ["boost software license", "version 1 0"])],
    "cc0-1.0": [
        ("released under cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
        ("licensed under cc0 1 0", ["cc0 1 0"]),
    ],
    "epl-2.0": [("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
                 ["eclipse public license", "2 0"])],
    "isc": [
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
         ["permission to use copy modify and", "with or without fee is hereby granted"]),
        ("released under the isc license", ["isc license"]),
    ],
    "mit": [
        ("released under the mit license", ["mit license"]),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
         "documentation files", ["permission is hereby granted", "free of charge"]),
    ],
    "mpl-2.0": [
        ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license", "2 0"]),
    ],
    "unlicense": [("this is free and unencumbered software released into the public domain", ["free and unencumbered software"])],
    "zlib": [("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
              "arising from the use of this software", ["in no event will the authors be held liable"])],
    # Creative Commons by kind and version, the GNU licences by name and version
    **{f"cc-by-{kind}-{v}.0": [(f"licensed under cc by {kind.replace('-', ' ')} {v} 0", [f"cc by {kind.replace('-', ' ')} {v} 0"])]
       for kind in ("nc", "sa", "nd", "nc-sa", "nc-nd") for v in (2, 3, 4)},
    **{f"{label}-{v}.{minor}": [
        (f"{_GNU.format(name)} either version {v}{point} of the license or at your option any later version",
         [f"gnu {name} public license", f"version {v}{point} of the license"]),
        (f"{_GNU.format(name)} version {v}{point} of the license", [f"gnu {name} public license", f"version {v}{point} of the license"]),
        (f"this work is licensed under the gnu {name} public license version {v}{point}", [f"gnu {name} public license", f"license version {v}{point}"])]
       for label, name, v, minor in (("gpl", "general", 2, 0), ("gpl", "general", 3, 0), ("lgpl", "lesser general", 2, 1), ("lgpl", "lesser general", 3, 0),
                                     ("agpl", "affero general", 3, 0))
       for point in [f" {minor}" if minor else ""]},
}


def lower_words(text: str | None) -> list[str]:
    """The words of a text with A-Z lowered (bytes.lower leaves all other letters alone)."""
    return WORD.findall(text.encode().lower().decode()) if text else []


class Index:
    """Positional index of the templates: word -> [(template, position)], and each template's words by falling IDF."""

    def __init__(self, templates: dict[str, list[tuple[str, list[str]]]], idf: dict[str, float], top_words: int):
        self.top = top_words
        self.labels, self.length, self.need, self.words, self.keys, self.key_words = [], [], [], [], [], []
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for label, notices in sorted(templates.items()):
            for notice, keys in notices:
                w = notice.split()
                t = len(self.labels)
                self.labels.append(label)
                self.length.append(len(w))
                self.words.append(sorted(set(w), key=lambda x: (-idf.get(x, 0.0), x)))
                self.keys.append([k.split() for k in keys])
                self.key_words.append(frozenset(x for k in keys for x in k.split()))
                self.need.append(max(2, int(np.ceil(MIN_SHARE * min(top_words, len(set(w)))))))
                for i, x in enumerate(w):
                    self.postings[x].append((t, i))


def consecutive(words: list[str], phrase: list[str], lo: int = 0, hi: int | None = None) -> list[int]:
    """Starts of the places where the words of ``phrase`` stand consecutively, from lo up to hi."""
    n = len(phrase)
    end = min(len(words), len(words) if hi is None else hi) - n
    out, at = [], lo - 1
    while True:
        try:
            at = words.index(phrase[0], at + 1, max(0, end + 1))
        except ValueError:
            return out
        if words[at:at + n] == phrase:
            out.append(at)


def scan(words: list[str], held: set[str], index: Index, slack: int = SLACK) -> dict[str, float]:
    """Labels of the templates that the index finds and the key phrases confirm, with the share of rare words aligned."""
    rare: dict[int, list[str]] = {}
    for t, keys in enumerate(index.key_words):
        if keys <= held:  # a template whose key phrases cannot stand in the file is not looked up
            own = [w for w in index.words[t] if w in held][:index.top]
            if len(own) >= index.need[t]:
                rare[t] = own
    if not rare:
        return {}
    wanted = {w for own in rare.values() for w in own}
    votes: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for i, w in enumerate(words):
        if w in wanted:
            for t, pos in index.postings[w]:
                if t in rare and w in rare[t]:
                    votes[t].append((i - pos, w))
    out: dict[str, float] = {}
    for t, places in votes.items():
        places.sort()
        first, inside, best = 0, Counter(), 0.0
        for place, w in places:  # a window of places at most ``slack`` apart
            inside[w] += 1
            while places[first][0] < place - slack:
                old = places[first][1]
                inside[old] -= 1
                if not inside[old]:
                    del inside[old]
                first += 1
            share = len(inside) / len(rare[t])
            if len(inside) >= index.need[t] and share > best:
                lo, hi = max(0, places[first][0]), place + index.length[t] + slack
                if all(consecutive(words, k, lo, hi) for k in index.keys[t]):
                    best = share
        if best:
            out[index.labels[t]] = max(best, out.get(index.labels[t], 0.0))
    return out


def fit_idf(docs: DataFrame, text_col: str = "text", templates=None) -> dict[str, float]:
    """IDF of the templates' words (a fixed number of them) over all rows."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = frozenset(w for notices in templates.values() for notice, _ in notices for w in notice.split())

    @F.pandas_udf("array<string>")
    def held(text: pd.Series) -> pd.Series:
        return pd.Series([sorted(vocabulary.intersection(lower_words(t))) for t in text], dtype=object)

    # a null word for every row counts the rows in the same pass
    found = docs.select(F.explode(F.concat(held(F.col(text_col).cast("string")), F.array(F.lit(None).cast("string")))).alias("w"))
    df = {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}
    total = df.pop(None, 0)
    return {w: float(np.log((total + 1) / (df.get(w, 0) + 1))) for w in vocabulary}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, phrases=None,
                  top_words: int = TOP_WORDS) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``score`` is 1 if a plain phrase stands in the text, else the largest share of a template's
    rare words that one verified alignment holds, else 0. Null texts count as empty: no
    words, empty labels, score 0. A very long text is scanned whole. Repeated rows are returned each; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    templates = TEMPLATES if templates is None else templates
    phrases = {tuple(p.split()): label for p, label in (PHRASES if phrases is None else phrases).items()}
    shared = spark.sparkContext.broadcast(Index(templates, fit_idf(docs, text_col, templates), top_words))

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def scanned(text: pd.Series) -> pd.DataFrame:
        index = shared.value
        out = []
        for t in text:
            words = lower_words(t)
            held = set(words)
            base, places = set(), []
            for phrase, label in phrases.items():
                if held.issuperset(phrase):
                    found = consecutive(words, list(phrase))
                    if found:
                        places += found
                        base.add(label)
            more = scan(words, held, index)
            score = 1.0 if places else max(more.values(), default=0.0)
            out.append((len(words), len(places), min(places, default=None), max(places, default=None),
                        ",".join(sorted(base)), ",".join(sorted(base | set(more))), score))
        frame = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
        return frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(id_col).alias("doc_id"), scanned(F.col(text_col).cast("string")).alias("s")).select("doc_id", "s.*")
