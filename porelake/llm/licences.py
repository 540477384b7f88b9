"""Licence scan with DataFrame functions alone: parts of a text against templates by Dice's coefficient over word bigrams.

All counts are of distinct bigrams of normalised words (`[a-z0-9]+`, lower case). What is compared with a template:
* each line, and each paragraph of several lines (blank lines part them) none of which matches, as a whole, where its number
  of bigrams lies within the bounds that the threshold sets;
* in the whole text, each run of as many words as the template has, so notices within longer lines and whole licences of
  several paragraphs are found.
A match shares at least t/(2-t) of the template's bigrams, so any match holds one of the few that are left out of that share
(its anchors): only texts that hold an anchor (and before that, the longer word of one) are looked at further, and only runs
that hold one are scored, each once, from the leftmost anchor in it. The threshold is a whole number of per cent, so that
bounds are exact integers.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from porelake.llm.common import staged

#: Least Dice coefficient, in per cent.
THRESHOLD = 80

#: Notices and paragraphs of well-known licences, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


#: Whole licences, by SPDX identifier, without their copyright lines.
WHOLE = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)


def bigrams_of(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bounds(n: int, threshold: int) -> tuple[int, int]:
    """Fewest and most distinct bigrams of a unit that can match a template of n distinct bigrams."""
    return -(-n * threshold // (200 - threshold)), n * (200 - threshold) // threshold


def anchors(found: list[str], threshold: int) -> list[str]:
    """Distinct bigrams of a template of which every match has at least one; those of long words, as they are rare."""
    distinct = sorted(set(found), key=lambda b: (-len(b), b))
    must = -(-len(distinct) * threshold // (200 - threshold))
    return distinct[: len(distinct) - must + 1]


def _template_rows(templates, threshold: int) -> list[tuple]:
    """(number, spdx, distinct bigrams, fewest and most bigrams of a unit, bigrams of a run, anchors)."""
    rows = []
    for number, (spdx, text) in enumerate(templates):
        found = bigrams_of(text)
        rows.append((number, spdx, sorted(set(found)), *bounds(len(set(found)), threshold), len(found), anchors(found, threshold)))
    return rows


def anchor_words(found: list[str]) -> list[str]:
    """The longer word of each anchor."""
    return sorted({max(b.split(" "), key=len) for b in found})


def lowered(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): texts in lower case; null texts go."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lower("text").alias("text"))


def units(lower: DataFrame) -> DataFrame:
    """lowered() -> (doc_id, text_hash, kind, part, unit, words): normalised words of each line, each paragraph of several lines, and the whole text.

    part numbers the paragraphs, unit the lines of one."""
    keys = ["doc_id", "text_hash"]
    parts = lower.select(*keys, F.posexplode(F.split("text", "\n[ \t\r]*\n")).alias("part", "t"))
    whole = lower.select(*keys, F.lit("text").alias("kind"), F.lit(-1).alias("part"), F.lit(-1).alias("unit"), F.col("text").alias("t"))
    lines = parts.select(*keys, F.lit("line").alias("kind"), "part", F.posexplode(F.split("t", "\n")).alias("unit", "t"))
    blocks = parts.where(F.instr("t", "\n") > 0).select(*keys, F.lit("paragraph").alias("kind"), "part", F.lit(-1).alias("unit"), "t")
    return whole.unionByName(lines).unionByName(blocks).select(*keys, "kind", "part", "unit", F.split(F.trim(F.regexp_replace("t", "[^a-z0-9]+", " ")), " ").alias("words"))


def _bigrams(words: Column) -> Column:
    """The bigrams of two words or more."""
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def _listed(words: list[str]) -> Column:
    """A constant array of normalised words or bigrams, folded once."""
    return F.split(F.lit(",".join(words)), ",")


def matches(docs: DataFrame, templates=TEMPLATES + WHOLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, kind, part, unit, template, spdx, score): what matches a template; repeated rows come back as often.

    A paragraph in which a line matches isn't matched itself. score is the unit's Dice coefficient, or for kind `text` that of the template's best run (the first of equal ones), unless
    it overlaps the best run of another template with a higher score (then a longer one, then an earlier template). The templates
    are a fixed table of a few rows: their anchors are literals, and they are broadcast.
    """
    spark: SparkSession = docs.sparkSession
    rows = _template_rows(templates, threshold)
    table = spark.createDataFrame(rows, "template int, spdx string, bigrams array<string>, low int, high int, run int, anchors array<string>")
    starts = sorted({a for r in rows for a in r[6]})
    by_anchor = F.from_json(F.lit(json.dumps({a: [r[0] for r in rows if a in r[6]] for a in starts})), "map<string,array<int>>")  # constant
    # a unit's words follow each other in the text, so an anchor of a unit is one of its text
    words = F.split("text", "[^a-z0-9]+")
    texts = lowered(docs).withColumn("words", words).where((F.size("words") > 1) & F.arrays_overlap("words", _listed(anchor_words(starts))))
    texts = staged(texts.where(F.arrays_overlap(_bigrams(F.col("words")), _listed(starts))).drop("words"))  # few, and read by each kind of unit
    near = units(texts).where(F.size("words") > 1).select("doc_id", "text_hash", "kind", "part", "unit", _bigrams(F.col("words")).alias("own"))
    candidates = F.array_distinct(F.flatten(F.transform(F.array_intersect("own", _listed(starts)), lambda a: F.element_at(by_anchor, a))))
    met = near.withColumn("template", F.explode(candidates)).join(F.broadcast(table), "template")
    dice = lambda own: F.lit(2.0) * F.size(F.array_intersect(own, "bigrams")) / (F.size(F.array_distinct(own)) + F.size("bigrams"))
    enough = lambda own: 200 * F.size(F.array_intersect(own, "bigrams")) >= threshold * (F.size(F.array_distinct(own)) + F.size("bigrams"))
    keys = ["doc_id", "text_hash", "kind", "part", "unit", "template", "spdx"]
    size = F.size(F.array_distinct("own"))
    wholes = met.where("kind != 'text'").where(size.between(F.col("low"), F.col("high"))).where(enough(F.col("own"))).select(*keys, dice(F.col("own")).alias("score"))
    wholes = staged(wholes)  # few
    of_lines = wholes.where("kind = 'line'").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("part").alias("_part")).distinct()
    held = wholes.doc_id.eqNullSafe(of_lines._id) & (wholes.text_hash == of_lines._hash) & (wholes.part == of_lines._part) & (wholes.kind == "paragraph")
    wholes = wholes.join(of_lines, held, "left_anti")
    # runs: places of anchors, then for each place the runs whose leftmost anchor it is
    places = F.filter(F.transform("own", lambda b, i: F.when(F.array_contains("anchors", b), i)), lambda i: i.isNotNull())
    hits = met.where("kind = 'text'").withColumn("places", places).select("*", F.posexplode("places").alias("k", "at"))
    first = F.greatest(F.lit(0), F.col("at") - F.col("run") + 1, F.when(F.col("k") > 0, F.try_element_at("places", F.col("k")) + 1).otherwise(F.lit(0)))
    last = F.least("at", F.greatest(F.lit(0), F.size("own") - F.col("run")))
    held = hits.withColumn("first", first).withColumn("last", last).where("first <= last")
    own_run = lambda i: F.slice("own", i + 1, F.col("run"))
    runs = F.transform(F.filter(F.sequence("first", "last"), lambda i: enough(own_run(i))), lambda i: F.struct(dice(own_run(i)).alias("score"), (-i).alias("place")))
    best = held.select("doc_id", "text_hash", "template", "spdx", "run", F.array_max(runs).alias("m")).where("m is not null").groupBy("doc_id", "text_hash", "template", "spdx", "run").agg(F.max("m").alias("m"))
    # a row for each template at most: of those that overlap the better one stays
    order = F.struct("m.score", "run", (-F.col("template")).alias("by"), (-F.col("m.place")).alias("start"), "template", "spdx")
    of_text = best.groupBy("doc_id", "text_hash").agg(F.collect_list(order).alias("of"))
    worse = lambda x, y: (F.struct(y["score"], y["run"], y["by"]) > F.struct(x["score"], x["run"], x["by"])) & (y["start"] < x["start"] + x["run"]) & (x["start"] < y["start"] + y["run"])
    kept = of_text.select("doc_id", "text_hash", F.explode(F.filter("of", lambda x: ~F.exists("of", lambda y: worse(x, y)))).alias("x"))
    within = kept.select("doc_id", "text_hash", F.lit("text").alias("kind"), F.lit(-1).alias("part"), F.lit(-1).alias("unit"), "x.template", "x.spdx", "x.score")
    return wholes.unionByName(within)


def scan(docs: DataFrame, templates=TEMPLATES + WHOLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_matches, licences, best, score): one row for each row of docs; other columns are not looked at.

    n_matches counts the lines, paragraphs and, once, the text in which something matches; licences are the distinct SPDX
    identifiers of their best templates (ties: the first by name, then by number), for the text of every template whose best
    run stands, sorted and comma-joined; best is the one of the highest score (then the first by name). Null, empty and
    other texts without a match: 0, '', null, 0.0. Repeated rows come back as often, null ids too; texts are read whole,
    however long. An empty table gives no rows.
    """
    found = matches(docs, templates, threshold)
    rank = F.struct(-F.col("score"), F.col("spdx"), F.col("template"))
    units_of = found.where("kind != 'text'").groupBy("doc_id", "text_hash", "kind", "part", "unit").agg(F.min_by(F.struct("spdx", "score"), rank).alias("m")).select("doc_id", "text_hash", "kind", "m.spdx", "m.score")
    every = units_of.unionByName(found.where("kind = 'text'").select("doc_id", "text_hash", "kind", "spdx", "score"))
    best = F.min_by("spdx", F.struct(-F.col("score"), F.col("spdx")))
    n = F.count(F.when(F.col("kind") != "text", 1)) + F.max((F.col("kind") == "text").cast("int"))
    by_doc = every.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(n.alias("n"), F.array_join(F.array_sort(F.collect_set("spdx")), ",").alias("names"), best.alias("top"), F.max("score").alias("high"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    out = rows.join(by_doc, rows.doc_id.eqNullSafe(by_doc._id) & (rows.text_hash == by_doc._hash), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("names", F.lit("")).alias("licences"), F.col("top").alias("best"), F.round(F.coalesce("high", F.lit(0.0)), 6).alias("score"))


def oracle_sql(templates=TEMPLATES + WHOLE, threshold: int = THRESHOLD) -> str:
    """DuckDB, without bounds and anchors: every unit, and every run of a text, that has any bigram of a template against it.

    A run's bigrams are counted as it slides: a bigram of the template counts for the runs between its earlier place and itself.
    """
    values = ",\n".join(f"({number}, '{spdx}', {own}, {run})" for number, spdx, own, _, _, run, _ in _template_rows(templates, threshold))
    words = "regexp_extract_all(lower(t), '[a-z0-9]+')"
    return f"""
WITH tpl(template, spdx, bigrams, run) AS (VALUES {values}),
tb AS (SELECT template, unnest(bigrams) AS bg FROM tpl),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
pg AS (SELECT r, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), 1) AS part FROM d),
u AS (SELECT r, 'line' AS kind, part, unnest(string_split(t, chr(10))) AS t, generate_subscripts(string_split(t, chr(10)), 1) AS unit FROM pg
    UNION ALL SELECT r, 'paragraph', part, t, -1 FROM pg WHERE contains(t, chr(10))
    UNION ALL SELECT r, 'text', -1, text, -1 FROM d WHERE text IS NOT NULL),
w AS (SELECT r, kind, part, unit, {words} AS w FROM u),
b AS (SELECT r, kind, part, unit, len(w) - 1 AS n, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bg FROM w WHERE len(w) > 1),
size AS (SELECT r, kind, part, unit, count(DISTINCT bg) AS n FROM b WHERE kind <> 'text' GROUP BY ALL),
common AS (SELECT b.r, b.kind, b.part, b.unit, tb.template, count(DISTINCT b.bg) AS c FROM b JOIN tb ON b.bg = tb.bg WHERE b.kind <> 'text' GROUP BY ALL),
whole AS (SELECT common.r, common.kind, common.part, common.unit, template, spdx, c, size.n + len(bigrams) AS total FROM common JOIN size ON common.r = size.r AND common.kind = size.kind AND common.part = size.part AND common.unit = size.unit JOIN tpl USING (template)),
x AS (SELECT r, n, i, bg, coalesce(lag(i) OVER (PARTITION BY r, bg ORDER BY i), 0) AS before FROM b WHERE kind = 'text'),
near AS (SELECT DISTINCT x.r, tb.template, x.n FROM x JOIN tb ON x.bg = tb.bg),
lim AS (SELECT near.r, near.template, least(run, near.n) AS size, near.n FROM near JOIN tpl USING (template)),
h AS (SELECT lim.r, lim.template, size, greatest(1, x.i - size + 1, x.before + 1) AS a, least(x.i, lim.n - size + 1) AS z FROM x JOIN tb ON x.bg = tb.bg JOIN lim ON lim.r = x.r AND lim.template = tb.template),
step AS (SELECT r, template, pos, sum(v) AS v FROM (SELECT r, template, a AS pos, 1 AS v FROM h WHERE a <= z UNION ALL SELECT r, template, z + 1, -1 FROM h WHERE a <= z) GROUP BY ALL),
level AS (SELECT r, template, pos, sum(v) OVER (PARTITION BY r, template ORDER BY pos) AS c, lead(pos, 1, pos) OVER (PARTITION BY r, template ORDER BY pos) AS till FROM step),
run AS (SELECT r, template, unnest(range(pos, till)) AS i, c FROM level JOIN tpl USING (template) WHERE c > 0 AND c * 200 >= {threshold} * (c + len(bigrams))),
part AS (SELECT run.r, run.template, run.i, run.c, (SELECT count(DISTINCT x.bg) FROM x WHERE x.r = run.r AND x.i BETWEEN run.i AND run.i + lim.size - 1) + len(bigrams) AS total
    FROM run JOIN lim ON lim.r = run.r AND lim.template = run.template JOIN tpl ON tpl.template = run.template),
f AS (SELECT r, kind, part, unit, template, spdx, 2.0::DOUBLE * c / total AS score FROM whole WHERE 200 * c >= {threshold} * total),
a AS (SELECT * FROM f WHERE NOT (kind = 'paragraph' AND (r, part) IN (SELECT (r, part) FROM f WHERE kind = 'line'))),
fit AS (SELECT * FROM (SELECT r, part.template, spdx, run, i, 2.0::DOUBLE * c / total AS score, row_number() OVER (PARTITION BY r, part.template ORDER BY 2.0::DOUBLE * c / total DESC, i) AS k
    FROM part JOIN tpl USING (template) WHERE 200 * c >= {threshold} * total) WHERE k = 1),
m AS (SELECT r, kind, spdx, score FROM (SELECT *, row_number() OVER (PARTITION BY r, kind, part, unit ORDER BY score DESC, spdx, template) AS k FROM a) WHERE k = 1
    UNION ALL SELECT r, 'text', spdx, score FROM fit AS x WHERE NOT EXISTS (SELECT 1 FROM fit AS y WHERE y.r = x.r AND (y.score, y.run, -y.template) > (x.score, x.run, -x.template) AND y.i < x.i + x.run AND x.i < y.i + y.run)),
g AS (SELECT r, count(*) FILTER (WHERE kind <> 'text') + max(CAST(kind = 'text' AS INTEGER)) AS n, string_agg(DISTINCT spdx, ',' ORDER BY spdx) AS names, max(score) AS high FROM m GROUP BY r),
t AS (SELECT m.r, min(m.spdx) AS top FROM m JOIN g ON m.r = g.r AND m.score = g.high GROUP BY m.r)
SELECT d.doc_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_matches, coalesce(g.names, '') AS licences, t.top AS best, round(coalesce(g.high, 0.0::DOUBLE), 6) AS score
FROM d LEFT JOIN g ON d.r = g.r LEFT JOIN t ON d.r = t.r
"""
