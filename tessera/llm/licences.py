"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

All of it is DataFrame functions. Terms outside the templates' vocabulary count towards a unit's length with the
weight of a term that no document has, so that only the vocabulary's document frequencies are needed; these are
counted over all texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, id_back, id_key

#: Statements that licences are declared with, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: A unit is compared if it has one of these, in either case; every template has one. A unit is a line, or the lines of
#: a paragraph put together without the marks of comments, cut at the ends of sentences, or a whole licence file.
ANCHORS = "licen[cs]|spdx|copyright|permission|redistribut|public domain|free software|software foundation"
#: What stands before a line's text in a comment, where paragraphs end, and what is between words of one.
MARKS, BLANK, SPACE = r"^[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+)?[ \t]*", r"\n[ \t\r]*\n", r"[ \t\r\n]+"
SIMILARITY = 0.75
#: Folders with a licence to inherit that may be broadcast, after counting them.
FOLDERS = 100_000
#: Names of licence files, without extension, in either case.
FILES = "(licen[cs]e|copying|unlicense|notice)([-_.].*)?"
_APART = "[^a-z0-9.]+|[.](?![0-9])"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _APART, -1), "")


def _weights(spark: SparkSession, texts: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """template, term, weight (of unit length); term, idf; and the idf of terms that no text has."""
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    templates = spark.createDataFrame(rows, "template int, licence string, text string")
    counted = templates.select("template", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    vocabulary = sorted(r.term for r in counted.select("term").distinct().collect())  # of the fixed templates
    among = F.array(*[F.lit(t) for t in vocabulary])
    each = texts.select(terms(F.col("text")).alias("terms")).select(F.explode(F.array_intersect("terms", among)).alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    n = texts.count()
    known = spark.createDataFrame([(t,) for t in vocabulary], "term string").join(df, "term", "left")
    idf = checkpointed(known.select("term", (F.log((n + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1).alias("idf")))
    raw = counted.join(F.broadcast(idf), "term").select("template", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    out = raw.join(norm, "template").join(templates.select("template", "licence"), "template").select("licence", "template", "term", (F.col("w") / F.col("norm")).alias("weight"))
    return checkpointed(out), idf, F.lit(math.log(n + 1.0) + 1)


def _units(files: DataFrame) -> DataFrame:
    """doc, row, whole (a licence file's text), unit (place) and text of what is compared."""
    end = r"(?<=[.;:])\s+(?=[A-Z])"
    anchored = lambda parts: F.filter(parts, lambda x: F.lower(x).rlike(ANCHORS))
    some = files.where(F.lower("text").rlike(ANCHORS))
    lined = anchored(F.split("text", r"\n|" + end, -1))
    paragraphs = F.filter(F.split(F.regexp_replace("text", "(?md)" + MARKS, ""), BLANK, -1), lambda x: x.contains("\n") & F.lower(x).rlike("(?s)" + ANCHORS))
    wrapped = anchored(F.flatten(F.transform(paragraphs, lambda x: F.split(F.regexp_replace(x, SPACE, " "), end, -1))))
    named = F.lower(F.element_at(F.split("path", "/", -1), -1)).rlike(f"^{FILES}$")
    unit = lambda whole, at, text: F.struct(F.lit(whole).alias("whole"), at.cast("int").alias("unit"), text.alias("text"))
    parts = [
        F.transform(lined, lambda x, i: unit(False, i, x)), F.transform(wrapped, lambda x, i: unit(False, -2 - i, x)),
        F.when(named, F.array(unit(True, F.lit(-1), F.col("text")))).otherwise(F.array().cast("array<struct<whole:boolean,unit:int,text:string>>")),
    ]
    # Outer, or Spark works the units out twice, to filter by their number.
    return some.select("doc", "row", F.explode_outer(F.concat(*parts)).alias("part")).select("doc", "row", "part.*").where("text is not null")


def _scored(units: DataFrame, templates: DataFrame, idf: DataFrame, unseen: Column, least: float) -> DataFrame:
    """doc, row and the best licence of its units, with its cosine."""
    counted = units.select("doc", "row", "whole", "unit", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc", "row", "whole", "unit", "term").agg(F.count("*").alias("tf"))
    # Both broadcast tables are made of the fixed templates' terms.
    weighed = counted.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    norms = weighed.groupBy("doc", "row", "whole", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(templates), "term").groupBy("doc", "row", "whole", "unit", "licence", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosines = dots.join(norms, ["doc", "row", "whole", "unit"]).select("doc", "row", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    best = cosines.where(F.col("cosine") >= least).groupBy("doc", "row").agg(F.max(F.struct("cosine", "licence")).alias("best"))
    return best.select("doc", "row", F.col("best.licence").alias("own"), F.col("best.cosine").alias("cosine"))


def scan(files: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, path, own and cosine, licence and origin ("own", a directory, or null) of every row of files.

    files has doc_id, path (parts joined by "/") and text. own is the licence that a header, wrapped or not, or a licence
    file's title or whole text declares with a cosine of at least ``least``; of equal cosines the name that sorts last. A file that
    declares none takes the licence of the nearest directory above it that has a licence file: one with such a name,
    or a text that is a declaration and nothing else. Of several in a directory, the one with the largest cosine
    counts, then the first path.

    Null and empty texts declare nothing, and a text of any length is read to its end; a null path is a file of that name "" at the root. A null id stays null;
    rows that repeat an id are judged each. Other columns are passed over. Empty files give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = files.select(id_key().alias("doc"), F.xxhash64("path", text).alias("row"), F.coalesce("path", F.lit("")).alias("path"), text.alias("text"))
    templates, idf, unseen = _weights(files.sparkSession, keyed.select("text"))
    found = checkpointed(_scored(_units(keyed), templates, idf, unseen, least))
    parts = F.split("path", "/", -1)
    alone = ~F.trim("text").contains("\n") & (F.length("text") <= max(len(t) for _, t in TEMPLATES) + 40)
    named = F.lower(F.element_at(parts, -1)).rlike(f"^{FILES}$")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    base = keyed.select("doc", "row", "path", folder.alias("folder"), (alone | named).alias("licence_file"))
    base = base.join(found.hint("shuffle_hash"), ["doc", "row"], "left")

    declared = base.where("licence_file and own is not null").groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "path", "own")).alias("best"))
    declared = declared.select(F.col("folder").alias("above"), F.col("best.own").alias("given"))
    split = F.split("folder", "/", -1)
    chain = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.transform(F.sequence(F.lit(0), F.size(split) - 1), lambda i: F.array_join(F.slice(split, F.lit(1), F.size(split) - i), "/")), F.array(F.lit("")))
    )
    folders = base.select("folder").distinct().select("folder", F.posexplode(chain).alias("far", "above"))
    nearest = folders.join(declared, "above").groupBy("folder").agg(F.min(F.struct("far", "above", "given")).alias("near"))
    # Folders are few against files. If they are so for sure, no file is moved, however many stand in one folder.
    nearest = checkpointed(nearest)
    out = base.join(F.broadcast(nearest) if nearest.limit(FOLDERS + 1).count() <= FOLDERS else nearest, "folder", "left")
    return out.select(
        id_back("doc").alias("doc_id"), "path", "own", "cosine", F.coalesce("own", "near.given").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), F.concat(F.lit("/"), "near.above")).alias("origin"),
    )
