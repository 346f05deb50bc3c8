"""Licence phrases and licence texts in documents, by a generalised suffix automaton of their words.

The automaton holds all word sequences of the templates. A text streams through it: at each word it
knows the longest run of words, ending there, that stands in some template (matching statistics).
Words outside the templates' vocabulary reset it, so only runs of vocabulary words are stepped, all
runs of a slice side by side. A base phrase stands where it is a suffix of the current match, which
its state tells. Matches of at least `LONG` words that go no further are chained per template, in
order on both sides; a template whose words are covered to `COVER` or more adds its label.

Handled cases: null and empty texts have no words, no labels and score 0; null and repeated ids stay
a row per row; phrases may overlap and every place counts; long texts are streamed whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from llm.shared import cut
from llm.textkernel import ALNUM, U, slices, words

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Sentences of public licence texts.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"
    " sublicense and or sell copies of the software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
    " you may obtain a copy of the license at",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
    " as published by the free software foundation",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
LONG, GAP, COVER = 5, 12, 0.5
#: Bytes of templates in one automaton (some 700,000 words, a few hundred licences).
TEMPLATE_BYTES = 4 << 20
STATS = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
SPANS = "array<struct<label:string,start:int,end:int,coverage:double>>"


class Automaton:
    """A generalised suffix automaton over word numbers: its edges as one sorted array, the rest by suffix links.

    Its size is proportional to the number of words of the templates, whatever their vocabulary is.
    """

    def __init__(self, texts: list[list[str]], phrases: list[list[str]]):
        vocabulary = sorted({w for t in texts + phrases for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        column = pa.array(vocabulary, pa.string())
        hashes = np.concatenate([np.zeros(0, U), *(words(s, ALNUM, True).hash for s in slices(column))])
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        self.length, self.link, go = [0], [-1], [{}]
        self.ends: list[dict[int, int]] = [{}]
        for t, text in enumerate(texts + phrases):
            last = 0
            for place, w in enumerate(text):
                last = self._extend(go, last, number[w])
                self.ends[last].setdefault(t, place)
        for state in sorted(range(1, len(go)), key=lambda s: -self.length[s]):  # a state ends where those that extend it to the left do
            if self.length[self.link[state]] >= LONG:  # shorter matches are in no chain
                for t, place in self.ends[state].items():
                    self.ends[self.link[state]].setdefault(t, place)
        self.terms, self.length, self.link = len(vocabulary), np.array(self.length, np.int32), np.array(self.link, np.int32)
        edges = sorted((state * self.terms + w, to) for state, out in enumerate(go) for w, to in out.items())
        self.edge, self.target = np.array([e for e, _ in edges], np.int64), np.array([t for _, t in edges], np.int32)
        held = [sorted(e.items()) for e in self.ends]
        self.ends_at = np.r_[0, np.cumsum([len(e) for e in held])]
        self.ends = np.array([pair for e in held for pair in e], np.int32).reshape(-1, 2)
        # marked[state]: the nearest state up the suffix links, itself included, in which phrases end
        stands: dict[int, list[int]] = {}
        for p, phrase in enumerate(phrases):
            state = 0
            for w in phrase:
                state = go[state][number[w]]
            if state:
                stands.setdefault(state, []).append(p)
        self.marked = np.zeros(len(go), np.int32)
        for state in np.argsort(self.length, kind="stable").tolist()[1:]:
            self.marked[state] = state if state in stands else self.marked[self.link[state]]
        self.phrases_at = np.r_[0, np.cumsum([len(stands.get(state, ())) for state in range(len(go))])]
        self.phrases = np.array([p for state in sorted(stands) for p in stands[state]], np.int32)
        self.phrase_size = np.array([len(p) for p in phrases], np.int32)

    def _extend(self, go, last, w):
        length, link = self.length, self.link
        if w in go[last]:
            q = go[last][w]
            return q if length[q] == length[last] + 1 else self._split(go, last, w, q)
        cur = self._new(go, length[last] + 1, {})
        p = last
        while p >= 0 and w not in go[p]:
            go[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = go[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(go, p, w, q)
        return cur

    def _new(self, go, length, edges):
        self.length.append(length)
        self.link.append(0)
        go.append(edges)
        self.ends.append({})
        return len(go) - 1

    def _split(self, go, p, w, q):
        clone = self._new(go, self.length[p] + 1, dict(go[q]))
        self.ends[clone] = dict(self.ends[q])
        self.link[clone] = self.link[q]
        while p >= 0 and go[p].get(w) == q:
            go[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _step(self, s: np.ndarray, m: np.ndarray, w: np.ndarray) -> None:
        """All runs go on by a word each: along an edge, or after falling back along suffix links to a state that has one.

        The root has an edge for every word of the vocabulary.
        """
        left = np.arange(len(s))
        while len(left):
            key = s[left].astype(np.int64) * self.terms + w[left]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            there = self.edge[at] == key
            go = left[there]
            s[go], m[go] = self.target[at[there]], m[go] + 1
            left = left[~there]
            s[left] = self.link[s[left]]
            m[left] = self.length[s[left]]

    def found(self, state: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, phrase) of every phrase that ends at a word, in order of both."""
        at = np.flatnonzero(self.marked[state])
        here = self.marked[state[at]]
        words_of, phrases_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        while len(at):
            n = self.phrases_at[here + 1] - self.phrases_at[here]
            place = np.repeat(self.phrases_at[here] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            phrase, word = self.phrases[place], np.repeat(at, n)
            fits = self.phrase_size[phrase] <= size[word]
            words_of.append(word[fits])
            phrases_of.append(phrase[fits])
            here = self.marked[self.link[here]]
            at, here = at[here > 0], here[here > 0]
        word, phrase = np.concatenate(words_of), np.concatenate(phrases_of)
        order = np.lexsort((phrase, word))
        return word[order], phrase[order]

    def stream(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, match length) at each word."""
        state, size = np.zeros(len(h), np.int32), np.zeros(len(h), np.int32)
        if not len(h) or not len(self.hashes):
            return state, size
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        word = np.where(self.hashes[at] == h, self.number[at], -1)
        known = word >= 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(h))]
        begins[inner] = known[inner]
        first = np.flatnonzero(begins)
        last = known.copy()
        last[:-1] &= ~known[1:] | begins[1:]
        n = np.flatnonzero(last) + 1 - first
        order = np.argsort(-n, kind="stable")
        first, n = first[order], n[order]
        s, m = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
        live = len(first)
        for k in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -k, "left"))  # runs of more than k words
            w = word[first[:live] + k]
            self._step(s[:live], m[:live], w)
            state[first[:live] + k], size[first[:live] + k] = s[:live], m[:live]
        return state, size


def _chains(a: Automaton, templates: list[list[str]], lo: int, hi: int, state, size) -> list[tuple[int, int, int, float]]:
    """(template, first word, end word, coverage) of one text's chained long matches."""
    ends = np.flatnonzero((size[lo:hi] >= LONG) & (np.r_[size[lo + 1 : hi], 0] != size[lo:hi] + 1))
    by: dict[int, list] = {}
    for e in ends:
        n = int(size[lo + e])
        for t, place in a.ends[a.ends_at[state[lo + e]] : a.ends_at[state[lo + e] + 1]].tolist():
            if t < len(templates):
                by.setdefault(t, []).append((int(e) - n + 1, int(e) + 1, place - n + 1, place + 1))
    out = []
    for t, found in by.items():
        chain, words_in = [], len(templates[t])
        for m in [*found, None]:
            if m is not None and (not chain or (m[0] - chain[-1][1] <= GAP and m[2] >= chain[-1][2] and m[3] > chain[-1][3])):
                chain.append(m)
                continue
            covered = np.zeros(words_in, bool)
            for x in chain:
                covered[x[2] : x[3]] = True
            out.append((t, chain[0][0], chain[-1][1], float(covered.mean())))
            chain = [m]
    return out


def _scan(shared, phrase_labels: list[str], templates: list[list[str]], names: list[str], schema: pa.Schema, first: bool):
    def run(batches):
        a: Automaton = shared.value
        for batch in batches:
            for s in slices(batch.column(batch.schema.get_field_index("text"))):
                w = words(s, ALNUM, True)
                n = len(s.rows)
                state, size = a.stream(w.hash, w.offsets)
                has_long = np.zeros(n, bool)
                has_long[np.searchsorted(w.offsets, np.flatnonzero(size >= LONG), "right") - 1] = True
                chains = [_chains(a, templates, w.offsets[d], w.offsets[d + 1], state, size) if has_long[d] else [] for d in range(n)]
                spans = [[{"label": names[t], "start": x, "end": y, "coverage": c} for t, x, y, c in of] for of in chains]
                more = [*(_places(a, phrase_labels, w.offsets, state, size) if first else []), spans]
                kept = batch.slice(s.rows[0], n).columns
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, schema.field(len(kept) + i).type) for i, c in enumerate(more))], schema=schema)

    return run


def _places(a: Automaton, phrase_labels: list[str], offsets: np.ndarray, state: np.ndarray, size: np.ndarray) -> list[list]:
    """Number of words and of places, first and last place, and labels of the base phrases of each text."""
    n = len(offsets) - 1
    at, phrase = a.found(state, size)
    doc = np.searchsorted(offsets, at, "right") - 1
    start = at - a.phrase_size[phrase] + 1 - offsets[doc]
    count = np.bincount(doc, minlength=n)
    edge = np.r_[0, np.cumsum(count)]
    here = [slice(edge[d], edge[d + 1]) for d in range(n)]
    first = [int(start[h].min()) if count[d] else None for d, h in enumerate(here)]
    last = [int(start[h].max()) if count[d] else None for d, h in enumerate(here)]
    return [np.diff(offsets).tolist(), count.tolist(), first, last, [sorted({phrase_labels[p] for p in phrase[h]}) for h in here]]


def template_parts(templates: dict[str, str] | DataFrame, most: int = TEMPLATE_BYTES) -> list[list[tuple[str, str]]]:
    """(label, text) of the templates, in parts of about `most` bytes; a label may have several texts.

    A table (label, text) is counted first. Repeated rows count once; those without label or text are left out.
    """
    if isinstance(templates, dict):
        return [list(templates.items())]
    rows = templates.select(F.col("label").cast("string").alias("label"), F.col("text").cast("string").alias("text")).dropna().distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    part = F.pmod(F.xxhash64("label", "text"), F.lit(n))
    return [sorted((r["label"], r["text"]) for r in rows.where(part == i).collect()) for i in range(n)]


def license_scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] | DataFrame = TEMPLATES,
    most: int = TEMPLATE_BYTES,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each text.

    `templates` is a dict or a table (label, text) of any size: one pass over the texts for every `most` bytes
    of it, the automaton of which is broadcast; between passes the rows are cut into the shared folder.
    """
    spark = docs.sparkSession
    cut_up = lambda t: re.findall("[a-z0-9]+", t.lower())
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    parts = template_parts(templates, most)
    for i, part in enumerate(parts):
        bodies, base = [cut_up(t) for _, t in part], phrases if i == 0 else {}
        shared = spark.sparkContext.broadcast(Automaton(bodies, [cut_up(p) for p in base]))
        result = T.StructType([*rows.schema.fields, *T.StructType.fromDDL((STATS if i == 0 else "") + f"spans{i} {SPANS}").fields])
        rows = rows.mapInArrow(_scan(shared, list(base.values()), bodies, [name for name, _ in part], to_arrow_schema(result), i == 0), result)
        if i + 1 < len(parts):
            rows = cut(rows, "license-pass")
    rows = rows.withColumn("spans", F.concat(*[f"spans{i}" for i in range(len(parts))]))
    covered = F.transform(F.filter("spans", lambda x: x["coverage"] >= COVER), lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0))
    return rows.select(
        "id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_distinct(F.concat("base_labels", covered))).alias("labels"),
        F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(best).alias("score"), "spans",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: places of the base phrases, and the labels found."""
    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
    return out.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")}).drop("spans")
