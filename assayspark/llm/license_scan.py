"""Licence texts found by diagonal voting, with DataFrame operations only.

All rolling k-grams of a text's words are joined by their hash to the places of the templates' k-grams. A hit votes
for a diagonal: the place in the text less the place in the template. Votes are summed by diagonal and stretch of text.
Words put in or left out move the later hits to another diagonal, so neighbouring diagonals are merged: bands of 2 * DRIFT
diagonals begin every DRIFT, so hits whose diagonals differ by up to DRIFT are together in one of them, whatever else hits
between them. In a band, hits with no gap over GAP words make up a span, which is verified by the share of the template's words that its
hits cover, of all that the template has and of all that the span has. Of overlapping spans of a template, which neighbouring bands and repeated
phrases give, the one with the largest share counts. The words of each hit are compared with the template's, so a vote never rests on a hash alone.

The templates are given by label: notices in common use and whole licence texts here, or the caller's own. They are sent
to all executors; more than MOST_WORDS are refused. A text's hits are the only rows that are shuffled, dealt out by
document, template and diagonal.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayspark.llm.shared import keep

#: Phrases and their labels: each place where the words stand consecutively counts. Fixed values of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label and words of the notices that the method adds; public licence texts in common use.
NOTICES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2.0-line": "licensed under the apache license version 2 0",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-by-4.0": "licensed under cc by 4 0",
    "gpl-3.0-line": "licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc-terms": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-line": "released under the mit license",
    "mit-terms": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "proprietary": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means",
    "public-domain": "this is free and unencumbered software released into the public domain",
}
#: Whole licence texts and headers; public texts in common use. The names of holders and dates stand outside of them.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEXTS = {
    "mit-text": f"{NOTICES['mit-terms']} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS} in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": f"{NOTICES['isc-terms']} the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause-text": f"{_BSD} {_BSD_END}",
    "bsd-3-clause-text": f"{_BSD} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "apache-2.0-header": f"{NOTICES['apache-2.0-notice']} http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-3.0-header": f"{NOTICES['gpl-notice']} either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    "mpl-2.0-header": f"{NOTICES['mpl-2.0-notice']} if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "unlicense-text": f"{NOTICES['public-domain']} anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
MOST_WORDS = 200_000
#: Words in a k-gram of a notice; a phrase is one gram of all its words.
K = 3
#: So many words put in or left out, on balance, can't break a span; a gap of more words without a hit does. BSD texts differ by a
#: clause of more than 2 * DRIFT words, and so stay apart.
DRIFT, GAP = 12, 12
#: Share of a template's words, and of the span's, that hits must cover for a label.
LEAST_SHARE = 0.7
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case; null counts as empty."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NO_WORD), lambda w: w != "")


def template_grams(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """template, grams (how many it has), place, k and gram of every gram of every template."""
    rows, lower = [], str.maketrans(_UPPER, _LOWER)
    if sum(len(x.split()) for x in notices.values()) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    for kind, templates in (("phrase", PHRASES), ("notice", notices)):
        for key, value in templates.items():
            w = [x for x in re.split(_NO_WORD, (key if kind == "phrase" else value).translate(lower)) if x]
            k = len(w) if kind == "phrase" else min(K, len(w))
            label = value if kind == "phrase" else key
            if not w:
                continue
            rows += [(kind, label, len(w) - k + 1, i, k, w[i : i + k]) for i in range(len(w) - k + 1)]
    made = spark.createDataFrame(rows, "kind string, label string, grams int, place int, k int, gram array<string>")
    return made.withColumn("hash", F.xxhash64(F.col("k"), F.concat_ws(" ", "gram")))


def scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    n_base counts all places of PHRASES; first_word and last_word are the smallest and largest of their first words
    (from 0). base_labels are the phrases' labels, labels those and the labels of verified notices (text by label: where
    none are given, NOTICES and TEXTS); both distinct, sorted and joined by commas, empty if there are none. score is the
    largest verified share of a notice, 1 where a phrase stands, else 0. spans lists the verified notices (label, first
    word, last word, share). A notice of fewer than K words is one gram; one without words is left out. A null or empty text has no
    words and no labels. Null doc_ids stay null; rows with one doc_id and text have the same result. An empty table gives an
    empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    notices = NOTICES | TEXTS if notices is None else notices
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    place = F.col("at")
    word = lambda i: F.get("w", place + i)
    grams = [(k, F.xxhash64(F.lit(k), F.concat_ws(" ", *(word(i) for i in range(k))))) for k in sorted({K, *(len(p.split()) for p in PHRASES), *(n for n in (1, 2) if any(len(t.split()) <= n for t in notices.values()))})]
    # one gram of length 0 stands for the text itself, so that texts without hits and their numbers of words stay
    each = rows.select("row", "doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    head = F.when(place == F.size("w"), F.array(F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("hash"))))
    each = each.select("row", "doc_id", "w", "at", F.explode(F.coalesce(head, F.array(*(F.struct(F.lit(k).alias("k"), h.alias("hash")) for k, h in grams)))).alias("g"))
    table = template_grams(spark, notices)
    own = spark.createDataFrame([("text", "", 1, 0, 0, [], 0)], "kind string, label string, grams int, place int, k int, gram array<string>, hash long")
    table = F.broadcast(table.unionByName(own).withColumnsRenamed({"k": "t_k", "hash": "t_hash"}))
    same = (F.col("t_hash") == F.col("g.hash")) & (F.col("t_k") == F.col("g.k")) & (F.col("gram") == F.slice("w", place + 1, F.col("t_k")))
    hits = each.join(table, same).select("row", "doc_id", "kind", "label", "grams", "place", "at", F.col("t_k").alias("k"), F.when(F.col("kind") == "text", F.size("w")).alias("n_words"))

    # votes by diagonal and stretch of text
    diagonal = F.col("at") - F.col("place")
    stretch = F.when(F.col("kind") == "notice", F.floor(F.col("at") / GAP)).otherwise(F.col("at"))
    votes = hits.groupBy("row", "doc_id", "kind", "label", "grams", "k", diagonal.alias("diagonal"), stretch.alias("stretch")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"), F.max("n_words").alias("n_words")
    )
    votes = keep(votes, "votes")  # a row for each text and a few for its hits; read by what follows, so that texts are read once
    found = votes.filter("kind <> 'notice'").select("row", "doc_id", "kind", "label", "low", "high", "k", "n_words", F.lit(1.0).alias("share"))

    # neighbouring diagonals; a band holds no more votes than its template has places and 2 * DRIFT diagonals
    band = F.floor(F.col("diagonal") / DRIFT)
    votes = votes.filter("kind = 'notice'").withColumn("band", F.explode(F.array(band, band - 1)))
    along = Window.partitionBy("row", "label", "band").orderBy("low", "diagonal")
    apart = F.col("low") - F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1)) > GAP
    votes = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    votes = votes.withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = votes.groupBy("row", "doc_id", "kind", "label", "grams", "k", "band", "span").agg(F.flatten(F.collect_list("places")).alias("places"), F.min("low").alias("low"), F.max("high").alias("high"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    share = covered / F.greatest(F.col("grams") + F.col("k") - 1, F.col("high") - F.col("low") + F.col("k"))
    spans = spans.select("row", "doc_id", "kind", "label", "low", "high", "k", share.alias("share")).filter(F.col("share") >= LEAST_SHARE)

    # the best of spans that overlap
    along = Window.partitionBy("row", "label").orderBy("low", "high")
    apart = F.col("low") > F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("place", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("low", "high", "share"), F.struct("share", -F.col("low"), -F.col("high"))).alias("s")
    spans = spans.groupBy("row", "doc_id", "kind", "label", "k", "place").agg(best).select("row", "doc_id", "kind", "label", "s.low", "s.high", "k", F.lit(None).cast("int").alias("n_words"), "s.share")
    kept = found.unionByName(spans)
    phrase, notice = F.col("kind") == "phrase", F.col("kind") == "notice"
    out = kept.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(phrase).alias("n_base"),
        F.min(F.when(phrase, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(phrase, F.col("low"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(phrase | notice, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(phrase, 1.0).when(notice, F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(notice, F.struct("low", "label", (F.col("high") + F.col("k") - 1).alias("last"), "share")))).alias("spans"),
    )
    return out.drop("row")
