"""Licence scans by diagonal voting.

1. Every text's words (A-Z lower-cased; runs of letters, digits and non-ASCII characters) give a hash at
   each position for the k words from there.  Spark joins all of them to the positions of the templates'
   k-grams (a fixed, small table, so that side is broadcast).
2. A hit at text position p and template position q votes for the diagonal p - q.  Votes are counted by
   document, template and diagonal.
3. Diagonals of a document and template are grouped where each differs from the next by at most ``slack``;
   those of a group that lie within ``gap`` words of each other are merged, whatever lies between: an insertion or deletion moves the rest of a passage to a neighbouring diagonal.
4. Merged spans whose votes cover enough of the template are verified word by word in the document: the
   words that span and template have in common in order must reach ``threshold`` of the longer one.

The few fixed ``PHRASES`` are looked up exactly at every position besides.

Scale: hits are few (a shuffle of three numbers each); the texts are read twice and not shuffled while the
spans' count is at most ``common.BROADCAST_ROWS`` documents, beyond that they are joined by id.

Defined cases: a null text is an empty one (no words, empty labels, score 0); equal rows get equal results;
rows with a null id are scanned like others; spans of several templates may overlap; a template that occurs
several times in a document gives several spans; an empty table gives an empty result.  Columns other than
the id and the text aren't touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionsift.llm.bytekit import ALNUM, LOWER, Words, mix, slices, word_hash
from sessionsift.llm.common import join_checked, staged

# Phrases that are looked up as they stand, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices (label, text), as their owners word them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

K = 3
SLACK = 4
GAP = 8
THRESHOLD = 0.9
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    data = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    w = Words(data, np.array([0, len(data)]), ALNUM)
    return [data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on, for the positions that have so many."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _STEP + h[i:i + n]
    return mix(out)


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([word_hash(x) for x in words], dtype=np.uint64)


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(hash, template, at): one row for each template position."""
    rows = [(int(h), t, q) for t, (_, text) in enumerate(templates) for q, h in enumerate(gram_hashes(_hashes(words_of(text)), k).view(np.int64))]
    return spark.createDataFrame(rows, "hash long, template int, at int")


def _identified(docs: DataFrame) -> DataFrame:
    """Rows with equal ids and texts share (id, th)."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("th"))


def candidate_spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, slack: int = SLACK, gap: int = GAP, threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, template, begin, end): word spans of ``docs`` (doc_id, text) that votes speak for."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch):
                w = Words(LOWER[data], off, ALNUM)
                h = w.hash
                hashes = gram_hashes(h, k)
                # k-grams do not cross documents
                count = np.maximum(np.diff(w.first) - k + 1, 0)
                ok = np.arange(len(h)) - w.first[w.doc] < count[w.doc] if len(h) else np.zeros(0, bool)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(hashes[ok[:len(hashes)]].view(np.int64)))
                yield pa.record_batch([part.column(part.schema.get_field_index("id")), part.column(part.schema.get_field_index("th")), lists], names=["id", "th", "grams"])

    rolled = _identified(docs).select("id", "th", "text").mapInArrow(grams, "id long, th long, grams array<long>")
    hits = rolled.select("id", "th", F.posexplode("grams").alias("pos", "hash"))
    hits = hits.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "hash")  # some hundred rows
    voted = hits.groupBy("id", "th", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count_distinct("at").alias("votes"), F.min("pos").alias("begin"), (F.max("pos") + k).alias("end"))
    passage = ["id", "th", "template"]
    step = F.col("diagonal") - F.lag("diagonal").over(Window.partitionBy(*passage).orderBy("diagonal"))
    close = voted.withColumn("step", step).withColumn("near", F.sum(F.coalesce(F.col("step") > slack, F.lit(True)).cast("int")).over(Window.partitionBy(*passage).orderBy("diagonal")))
    along = Window.partitionBy(*passage, "near").orderBy("begin", "diagonal")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    merged = close.withColumn("apart", F.coalesce(F.col("begin") > reached + gap, F.lit(True))).withColumn("group", F.sum(F.col("apart").cast("int")).over(along))
    spans = merged.groupBy(*passage, "near", "group").agg(F.sum("votes").alias("votes"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    lengths = F.array(*(F.lit(len(words_of(t))) for _, t in templates))
    need = lengths[F.col("template")] - k + 1
    # one differing word breaks k grams: what is left must still allow for the threshold
    least = F.greatest(F.lit(1), F.ceil(need - k * F.ceil((1 - threshold) * lengths[F.col("template")])))
    return spans.where(F.col("votes") >= least).select("id", "th", "template", "begin", "end")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: counts and places of the phrases, labels, verified spans, score."""
    spans = candidate_spans(docs, templates, threshold=threshold)
    of_doc = staged(spans.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("template", "begin", "end"))).alias("spans")), "licence-spans")
    texts = [words_of(t) for _, t in templates]
    known = [_hashes(p.split()) for p in phrases]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch):
                lower = LOWER[data]
                w = Words(lower, off, ALNUM)
                h, n = w.hash, len(off) - 1
                places, kinds = [], []
                for number, p in enumerate(known):
                    m = max(0, len(h) - len(p) + 1)
                    hit = np.ones(m, dtype=bool)
                    for i, x in enumerate(p):
                        hit &= h[i:i + m] == x
                    at = np.flatnonzero(hit)
                    at = at[w.doc[at] == w.doc[at + len(p) - 1]]
                    places.append(at)
                    kinds.append(np.full(len(at), number))
                place, kind = np.concatenate(places), np.concatenate(kinds)
                out = {c: [] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "licences")}
                owner = w.doc[place]
                of_row: dict[int, np.ndarray] = {r: np.flatnonzero(owner == r) for r in np.unique(owner).tolist()}
                ids, found = part.column(0).to_pylist(), part.column(2).to_pylist()
                for r in range(n):
                    a = int(w.first[r])
                    mine = of_row.get(r)
                    base = sorted({list(phrases.values())[i] for i in kind[mine]}) if mine is not None else []
                    good = []
                    for s in found[r] or []:
                        template = texts[s["template"]]
                        lo, hi = max(0, s["begin"] - 2), min(int(w.first[r + 1]) - a, s["end"] + 2)
                        own = [lower[x:y].tobytes().decode() for x, y in zip(w.start[a + lo:a + hi], w.end[a + lo:a + hi])]
                        same = SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks()
                        same = [b for b in same if b.size]
                        reach = same[-1].b + same[-1].size - same[0].b if same else 0  # inserted words count against it
                        share = sum(b.size for b in same) / max(len(template), reach)
                        if share >= threshold:
                            good.append({"label": templates[s["template"]][0], "begin": s["begin"], "end": s["end"], "share": share})
                    out["doc_id"].append(ids[r])
                    out["n_words"].append(int(w.first[r + 1]) - a)
                    out["n_base"].append(0 if mine is None else len(mine))
                    out["first_word"].append(None if mine is None else int(place[mine].min()) - a)
                    out["last_word"].append(None if mine is None else int(place[mine].max()) - a)
                    out["base_labels"].append(",".join(base))
                    out["labels"].append(",".join(sorted({*base, *(g["label"] for g in good)})))
                    out["score"].append(max([1.0 if base else 0.0, *(g["share"] for g in good)]))
                    out["licences"].append(good)
                spans_type = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))
                kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans_type]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds_of)], names=list(out))

    joined = join_checked(_identified(docs), of_doc, ["id", "th"], "left").select("doc_id", "text", "spans")
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
              "licences array<struct<label: string, begin: int, end: int, share: double>>")
    return joined.mapInArrow(verify, schema)


BASE_COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
