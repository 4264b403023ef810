"""License scans: diagonal voting over word k-grams, all in DataFrame functions.

Every word with its successors (a k-gram) meets the templates' k-grams in an
equi-join on their hash; the words themselves confirm it.  A hit votes for the
diagonal ``place in the text - place in the template``.  A diagonal with a vote for
every gram of a phrase is one exact place of that phrase.  For notices,
neighbouring diagonals (inserted or lost words shift a hit to the next one) are
merged, and the span is verified by the share of grams found and by its extent.

Long notices are matched by 4-grams, whose hits are few, short phrases by 2-grams.

Defined cases: a null or empty text has no words, no places and score 0; null
doc_ids stay; each row, repeated or not, gets a result of its own; where two notices
tie, both labels stand; a very long text gives a row for each of its words, which meet in
one task; an empty table gives an empty result; other columns are not read.  Texts are
numbered where they are read, so ``docs`` should be a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import ascii_lower

#: Fixed values: (label, phrase) whose every place counts.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Fixed values: (label, notice), words of public licence texts and notices.
NOTICES = [
    ("mit", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("agpl", "licensed under the gnu affero general public license version"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("artistic", "under the terms of the artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
        "copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
        "action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this "
        "list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
        "particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not "
        "limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort "
        "including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing "
        "permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at "
        "your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular "
        "purpose see the gnu general public license for more details",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version of the license "
        "or at your option any later version this library is distributed in the hope that it will be useful but without any warranty",
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version of the license or at "
        "your option any later version",
    ),
    (
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    ),
    (
        "epl",
        "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution",
    ),
    (
        "artistic",
        "this program is free software you can redistribute it and or modify it under the terms of the artistic license either version of the license or under the same terms as the language itself",
    ),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to "
        "use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute "
        "and transmit the software and to prepare derivative works of the software",
    ),
]
#: Fixed values: (label, notice) that differ from one another in single words, so that each counts only as a whole.
WHOLE_NOTICES = [
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by", "creative commons attribution 3 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 3 0"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international"),
    ("cc0", "cc0 1 0 universal"),
    ("agpl", "gnu affero general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("epl", "eclipse public license"),
]
#: Words of a gram in short and in long templates, and the words from which a template is long.
SHORT, LONG, LONG_WORDS = 2, 4, 20
#: What separates words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this close belong to one span; a span needs this share of the grams, within this many times the notice's words.
SLACK, MIN_SHARE, MAX_STRETCH = 2, 0.8, 1.5
#: The share for long templates: a word lost or put in breaks as many grams as a gram has words.
LONG_SHARE = 0.6
#: Template grams up to which the table is broadcast (under 10 MB).
BROADCAST_GRAMS = 50_000


def templates(phrases=PHRASES, notices=NOTICES, whole=WHOLE_NOTICES) -> list[tuple]:
    """(template, label, exact, base, grams, k, place, words of the gram joined by spaces) of every gram.

    Exact templates count only as a whole; base ones are the phrases whose places are reported."""
    rows = []
    for number, (label, text, exact, base) in enumerate([(*p, True, True) for p in phrases] + [(*n, False, False) for n in notices] + [(*w, True, False) for w in whole]):
        words = text.split()
        k = SHORT if exact or len(words) < LONG_WORDS else LONG
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        rows += [(number, label, exact, base, len(grams), k, place, gram) for place, gram in enumerate(grams)]
    return rows


def template_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Templates keyed by gram hash, and one row with hash 0 that every text's last word meets."""
    frame = spark.createDataFrame([*rows, (-1, None, False, False, 0, 1, 0, None)], "template int, label string, exact boolean, base boolean, grams int, k int, place int, tgram string")
    return frame.withColumn("gram", F.when(F.col("template") < 0, F.lit(0)).otherwise(F.xxhash64("tgram")))


def scan(docs: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    ``rows`` are templates as ``templates`` makes them; they are broadcast up to ``BROADCAST_GRAMS`` grams."""
    spark = docs.sparkSession
    rows = templates() if rows is None else rows
    table = template_frame(spark, rows)
    table = F.broadcast(table) if len(rows) <= BROADCAST_GRAMS else table
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), GAP), "")
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("words"))
    n_words = F.size("words").cast("long").alias("n_words")
    after = [F.slice("words", j, F.greatest(F.size("words"), F.lit(1))) for j in range(2, LONG + 1)]
    runs = F.arrays_zip(F.col("words").alias("w1"), *(a.alias(f"w{j}") for j, a in enumerate(after, 2)))
    # The last word has no successor, and a text without words gives one empty row: each text keeps exactly one row of hash 0.
    placed = texts.select("doc_id", "row", n_words, F.posexplode_outer(runs).alias("pos", "run"))
    short = F.when(F.col("run.w2").isNull(), F.lit("")).otherwise(F.concat_ws(" ", *(F.col(f"run.w{j}") for j in range(1, SHORT + 1))))
    long = F.when(F.col(f"run.w{LONG}").isNotNull(), F.concat_ws(" ", *(F.col(f"run.w{j}") for j in range(1, LONG + 1))))
    grams = placed.select("doc_id", "row", "n_words", "pos", F.explode(F.array_compact(F.array(short, long))).alias("words"))
    grams = grams.withColumn("gram", F.when(F.col("words") == "", F.lit(0)).otherwise(F.xxhash64("words")))
    same = (F.col("words") == F.col("tgram")) | ((F.col("words") == "") & (F.col("template") < 0))
    hits = grams.join(table, "gram").where(same).select("doc_id", "row", "n_words", "template", "label", "exact", "base", "grams", "k", "pos", (F.col("pos") - F.col("place")).alias("diagonal"))
    # All rows of a text meet here, so that what follows needs no further exchange.
    hits = hits.repartition("row")
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "base", "grams", "k", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(False)) | F.col("exact")
    runs = votes.withColumn("run", F.sum(gap.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "base", "grams", "k", "run").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("start"), (F.max("high") - F.min("low") + F.col("k")).alias("extent"))
    share = F.when(F.col("template") < 0, 0.0).otherwise(F.least(F.col("votes") / F.col("grams"), F.lit(1.0)))
    found = F.when(F.col("exact"), F.col("votes") == F.col("grams")).otherwise((share >= F.when(F.col("k") == LONG, LONG_SHARE).otherwise(MIN_SHARE)) & (F.col("extent") <= MAX_STRETCH * (F.col("grams") + F.col("k") - 1)))
    place = F.when(found & F.col("base"), F.col("start").cast("long"))
    listed = spans.withColumns({"share": share, "found": found & (F.col("template") >= 0), "place": place})
    return listed.groupBy("row", "doc_id", "n_words").agg(
        F.count("place").alias("n_base"),
        F.min("place").alias("first_word"),
        F.max("place").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("place").isNotNull(), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("found"), F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    ).drop("row")
