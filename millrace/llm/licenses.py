"""License scans by diagonal voting.

All rolling k-word hashes of the texts meet the positions of the templates' k-grams in a Spark
join; each meeting votes for the diagonal (place in the text minus place in the template).
Diagonals that lie close together are merged (words were added or dropped).  Of merged diagonals the
best stretch is verified: of all stretches of about the template's length, the one that covers most
of its words, and that must be enough of them.  So further votes beside a license do not hide it.

Hashes that no template has are left out before the rows leave the Python worker (templates are
few and fixed), so the join sees only hashes that can meet.  Votes meet on 128 bits, two independent
hashes of their words.  Short base phrases are templates whose places must match word for word on a
single diagonal.

Null texts count as empty: one row with no words and no labels.  Rows are told apart by key and
text; equal rows are scanned once and given back as often as they occur.  Very long texts are
hashed whole.  Other columns are not read and may have any names.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.core import BUFFER, LOWER, WORD, text_buffers, text_marks, word_grams, word_hashes, words_of

K = 3
BROADCAST_GRAMS = 100_000  #: k-grams of all templates
SLACK = 4  #: words by which neighbouring diagonals of one span may differ
COVER = 0.6  #: share of the template's words that a span must cover
STRETCH = 1.5  #: how far a stretch reaches, as a multiple of the template's length

#: Fixed values: (label, phrase); each place where the words stand consecutively counts.
BASE = (
    ("mit", "the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Well-known notices, as (label, text).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "This content is licensed under CC BY-NC 4.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
)


def checked_grams(texts: list[bytes], k: int):
    """(grams, whether they lie in one text, texts and places of words, a function to second hashes of grams)."""
    hashes, doc, index, start, end = words_of(texts, WORD, lower=True)
    grams, ok = word_grams(hashes, doc, k)

    def check(at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.uint64)
        raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        used, which = np.unique(at[:, None] + np.arange(k), return_inverse=True)
        other = word_hashes(raw, start[used], end[used], salt=1)[which.ravel()]
        return word_grams(other, np.zeros(len(other), np.int64), k)[0][::k]

    return grams, ok, doc, index, check


def template_rows(base: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], k: int = K) -> list[tuple]:
    """(hash, check, template, label, is_base, grams, words, place) of each k-gram of each template."""
    out = []
    for number, (label, text, is_base) in enumerate([*((a, b, True) for a, b in base), *((a, b, False) for a, b in templates)]):
        grams, _, _, index, check = checked_grams([text.encode()], k)
        if not len(grams):
            raise ValueError(f"a template needs {k} words or more: {text!r}")
        both = zip(grams.view(np.int64).tolist(), check(np.arange(len(grams))).view(np.int64).tolist(), strict=True)
        out += [(h, c, number, label, is_base, len(grams), len(index), place) for place, (h, c) in enumerate(both)]
    return out


def scan_batches(wanted: np.ndarray, k: int):
    """Arrow batches of (key, text) to (key, text hash, words, places and hashes that some template has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 16, bool)
        maybe[(wanted >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            for low, high, part in text_buffers(batch.column(1), 4 * BUFFER):
                grams, ok, doc, index, check = checked_grams(part, k)
                n_words = np.bincount(doc, minlength=len(part))
                at = np.flatnonzero(ok & maybe[(grams >> np.uint64(48)).astype(np.int64)])
                at = at[np.isin(grams[at], wanted)]
                ends = np.searchsorted(doc[at], np.arange(len(part) + 1))
                # equal texts of one key are one place; the mark tells different texts of a key apart
                places = pa.StructArray.from_arrays([pa.array(index[at].astype(np.int64)), pa.array(grams[at].view(np.int64)), pa.array(check(at).view(np.int64))], ["place", "hash", "check"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(text_marks(part)), pa.array(n_words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), places)], ["key", "mark", "n_words", "hits"]
                )

    return run


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """One row for each row of df: key, n_words, n_base, first_word, last_word, base_labels, labels,
    score and spans (label, first word, words of the verified spans)."""
    spark = df.sparkSession
    rows = template_rows(base, templates, k)
    table = spark.createDataFrame(rows, "hash long, check long, template int, label string, is_base boolean, grams int, words int, at int")
    table = F.broadcast(table) if len(rows) <= BROADCAST_GRAMS else table
    wanted = np.unique(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    kind = df.schema[key].dataType.simpleString()
    hits = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan_batches(wanted, k), f"key {kind}, mark long, n_words long, hits array<struct<place: long, hash: long, check: long>>")
    # every row also carries one hit that meets nothing: it keeps and counts rows without votes
    none = F.expr("array(named_struct('place', CAST(NULL AS LONG), 'hash', CAST(NULL AS LONG), 'check', CAST(NULL AS LONG)))")
    votes = hits.select("key", "mark", "n_words", F.explode(F.concat(none, "hits")).alias("hit")).repartition("key", "mark")
    votes = votes.select("key", "mark", "n_words", F.col("hit.place").alias("place"), F.col("hit.hash").alias("hash"), F.col("hit.check").alias("check")).join(table, ["hash", "check"], "left")
    own = ["key", "mark", "n_words"]
    line = votes.groupBy(*own, "template", "label", "is_base", "grams", "words", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("times"), F.collect_set("at").alias("ats"))
    place = "PARTITION BY key, mark, template ORDER BY diagonal"
    line = line.withColumn("fresh", F.expr(f"CASE WHEN diagonal - lag(diagonal) OVER ({place}) <= {SLACK} THEN 0 ELSE 1 END"))
    line = line.withColumn("cluster", F.expr(f"CASE WHEN is_base THEN diagonal ELSE sum(fresh) OVER ({place} ROWS UNBOUNDED PRECEDING) END"))
    # each vote begins a stretch of STRETCH times the template's words: what of the template lies in it
    vote = line.select(*own, "template", "label", "is_base", "grams", "words", "cluster", "times", F.explode_outer("ats").alias("at"), "diagonal").withColumn("place", F.col("diagonal") + F.col("at"))
    stretch = f"PARTITION BY key, mark, template, cluster ORDER BY place / words RANGE BETWEEN CURRENT ROW AND {STRETCH}D FOLLOWING"
    vote = vote.withColumn("ats", F.expr(f"collect_set(at) OVER ({stretch})")).withColumn("end", F.expr(f"max(place) OVER ({stretch})") + k)
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + k - 1)))))
    vote = vote.withColumn("share", F.when(F.col("template").isNotNull(), covered / F.col("words")).otherwise(0.0))
    best = F.max_by(F.struct("ats", "share", F.col("place").alias("first"), "end"), F.struct("share", F.negative("place")))
    span = vote.groupBy(*own, "template", "label", "is_base", "grams", "words", "cluster").agg(best.alias("best"), F.max(F.when(F.col("template").isNull(), F.col("times"))).alias("times"))
    span = span.select(*own, "template", "label", "is_base", "grams", "words", "cluster", "times", "best.*")
    full = F.col("is_base") & (F.size("ats") == F.col("grams"))
    found = ~F.col("is_base") & (F.col("share") >= COVER)
    span = span.withColumns({"full": F.coalesce(full, F.lit(False)), "found": F.coalesce(found, F.lit(False))})
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = span.groupBy(*own).agg(
        F.max("times").alias("times"),
        F.count_if("full").alias("n_base"),
        F.min(F.when(F.col("full"), F.col("cluster"))).alias("first_word"),
        F.max(F.when(F.col("full"), F.col("cluster"))).alias("last_word"),
        joined(F.col("full")).alias("base_labels"),
        joined(F.col("full") | F.col("found")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("full"), F.lit(1.0)).when(F.col("found"), F.least(F.col("share"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("first", (F.col("end") - F.col("first")).alias("words"), "label")))).alias("spans"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
