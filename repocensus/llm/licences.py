"""License scans: TF-IDF cosine of statements to licence templates, then inheritance from the nearest ancestor directory.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Licence and statement, several for some licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
)
KEYWORDS = "licen[sc]|copyright|rights reserved|cc by|cc0|spdx|public domain|hereby granted|redistribution"
SPLIT = "\\n|[.!?]\\s+"
TOKEN = "[a-z]+|[0-9]+(?:[.][0-9]+)?"
LEAST = 0.6
FILE_NAMES = "(?i)^(licen[sc]e|copying|notice|unlicense)([.].*)?$"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _weights(statements: DataFrame) -> DataFrame:
    """(statement, n) to (statement, token, tf)."""
    return statements.select("statement", F.explode(_tokens(F.col("statement"))).alias("token")).groupBy("statement", "token").agg(F.count("*").cast("double").alias("tf"))


def statements_of(files: DataFrame) -> DataFrame:
    """path and statement: the sentences and lines of the whole text in which a licence word stands, each once for a path."""
    parts = F.filter(F.split("text", SPLIT), lambda s: F.lower(s).rlike(KEYWORDS))
    return files.filter(F.lower("text").rlike(KEYWORDS)).select("path", F.explode(F.array_distinct(parts)).alias("statement"))


def matched(statements: DataFrame, least: float = LEAST) -> DataFrame:
    """statement, licence, score of every distinct statement (statement, n: how often it occurs) that is near enough to a template.

    Term weights are tf * (ln((1 + N) / (1 + df)) + 1) over all occurrences of all statements and the templates. Ties: the
    licence first by name.
    """
    spark = statements.sparkSession
    templates = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES)], "template int, licence string, statement string")
    every = statements.select("statement", "n").unionByName(templates.select("statement", F.lit(1).cast("long").alias("n")))
    tf = materialize(_weights(statements), "terms")
    own_tf = _weights(templates.select("statement"))
    total = every.agg(F.sum("n").cast("double").alias("total"))
    df = every.select("n", F.explode(F.array_distinct(_tokens(F.col("statement")))).alias("token")).groupBy("token").agg(F.sum("n").cast("double").alias("df"))
    idf = materialize(df.join(F.broadcast(total)).select("token", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")

    weighed = tf.join(idf, "token").select("statement", "token", (F.col("tf") * F.col("idf")).alias("w"))
    model = own_tf.join(idf, "token").select(F.col("statement").alias("t"), "token", (F.col("tf") * F.col("idf")).alias("v"))
    size = model.groupBy("t").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    model = F.broadcast(model.join(size, "t"))  # as many rows as the templates have words
    norm = weighed.groupBy("statement").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = weighed.join(model, "token").groupBy("statement", "t", "size").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    near = dot.join(norm, "statement").select("statement", "t", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 4).alias("score"))
    near = near.filter(F.col("score") >= least).join(F.broadcast(templates.select(F.col("statement").alias("t"), "licence").distinct()), "t")
    best = near.groupBy("statement", "licence").agg(F.max("score").alias("score"))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("statement").orderBy(F.desc("score"), "licence"))).filter("r = 1").drop("r")


def scan_licences(files: DataFrame, licence_file: Column | None = None, least: float = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """path, own_licence, own_score, inherited_licence, inherited_from, licence, basis for every row of ``files`` (path, text), then the columns named in ``carry``; other columns are ignored.

    own_licence: the template nearest to any statement of the file's whole text. inherited: that of the nearest directory
    above (its own directory first) with a licence file; among several there the highest score, then the licence's name.
    licence: the file's own, else the inherited; basis "own", "inherited" or "none". ``licence_file`` (on path and text)
    says which files are licence files, by default their names do.

    Null text: as empty. A null path inherits nothing; its text is scanned all the same. Repeated rows: each gets the result
    of the path. Empty table: empty result. Statements are compared once however many files have them, directories are
    looked up once however many files they hold, and hot ones meet their results in joins that can be split.
    """
    own_paths = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    is_file = licence_file if licence_file is not None else F.element_at(F.split("path", "/"), -1).rlike(FILE_NAMES)
    said = materialize(statements_of(own_paths.withColumn("path", F.struct("path", F.xxhash64("text").alias("key"), F.coalesce(is_file, F.lit(False)).alias("is_file")))).select("path.*", "statement"), "statements")
    found = materialize(matched(said.groupBy("statement").agg(F.count("*").alias("n")), least), "matched")
    named = said.join(found, "statement").select("path", "key", "is_file", "licence", "score")
    best = named.groupBy("path", "key", "is_file").agg(F.max("score").alias("best"), F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("x"))
    best = materialize(best.select("path", "key", "is_file", F.col("x.licence").alias("own_licence"), F.col("best").alias("own_score")), "own")

    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    given = best.filter("is_file and path is not null").groupBy(directory.alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_licence")).alias("x")).select("dir", F.col("x.own_licence").alias("licence"))
    parts = F.split("leaf", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    dirs = own_paths.select(directory.alias("leaf")).filter("leaf is not null").distinct().select("leaf", F.explode(above).alias("a")).select("leaf", "a.depth", "a.dir")
    nearest = dirs.join(materialize(given, "given"), "dir").groupBy("leaf").agg(F.max(F.struct("depth", "dir", "licence")).alias("x"))
    nearest = materialize(nearest.select("leaf", F.col("x.licence").alias("inherited_licence"), F.col("x.dir").alias("inherited_from")), "nearest")

    rows = files.select("path", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), directory.alias("leaf"), F.struct(*carry).alias("carry") if carry else F.lit(None).alias("carry"))
    out = rows.join(nearest, "leaf", "left")
    mine = best.select(F.col("path").alias("p"), F.col("key").alias("k"), "own_licence", "own_score")
    out = out.join(mine, F.col("path").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")), "left")
    basis = F.when(F.col("own_licence").isNotNull(), "own").when(F.col("inherited_licence").isNotNull(), "inherited").otherwise("none")
    return out.select("path", "own_licence", "own_score", "inherited_licence", "inherited_from", F.coalesce("own_licence", "inherited_licence").alias("licence"), basis.alias("basis"), *[F.col("carry").getField(c).alias(c) for c in carry])
