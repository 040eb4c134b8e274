"""License scans: ordered signature rules, gated by keywords, with suppression of contained detections. DataFrame functions only.

A text becomes its lower-cased words, each with a space before and after it (" mit  license "), so that rules match whole words and
a match never takes the space of the next word.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_CONFIDENCE = 0.9

# What each license is called: label, keyword, signature. Single spaces stand between words.
NAMES = (
    ("gpl-1.0", "gpl", "gpl (?:v ?1|version 1)(?: 0)?"),
    ("gpl-2.0", "general public license", "gnu general public license (?:as published by the free software foundation )?(?:either )?(?:v2|v 2|version 2|2)(?: 0)?"),
    ("gpl-3.0", "general public license", "gnu general public license (?:as published by the free software foundation )?(?:either )?(?:v3|v 3|version 3|3)(?: 0)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?(?:v2|v 2|version 2|2)(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?(?:v3|v 3|version 3|3)(?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl-2.1", "lesser general public", "gnu lesser general public license (?:v|version )?2 1"),
    ("lgpl-3.0", "lesser general public", "gnu lesser general public license (?:v|version )?3(?: 0)?"),
    ("lgpl", "lesser general public", "(?:gnu )?lesser general public license"),
    ("lgpl-2.0", "library general public", "gnu library general public license(?: version 2)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: v?[0-9]+(?: [0-9]+)?)?"),
    ("agpl-3.0", "affero", "gnu affero general public license(?: version 3| v3)?"),
    ("agpl-3.0", "agpl", "agpl(?: v?3(?: 0)?)?"),
    ("gfdl", "free documentation", "gnu free documentation license(?: version 1(?: [123])?)?"),
    ("apache-1.1", "apache", "apache (?:software )?license (?:version )?1 [01]"),
    ("apache-2.0", "apache", "apache (?:software )?license (?:version |v)?2(?: 0)?"),
    ("apache-2.0", "apache", "apache 2(?: 0)?(?: license)?"),
    ("apache", "apache", "apache (?:software )?licen[sc]e"),
    ("mit", "mit", "(?:the )?(?:mit|expat) licen[sc]e"),
    ("mit", "x11", "(?:mit )?x11 licen[sc]e"),
    ("mit-0", "no attribution", "mit no attribution"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e"),
    ("isc", "isc", "isc licen[sc]e"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e (?:version )?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("mpl-2.0", "mpl", "mpl 2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e (?:version |v)?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("cddl", "common development", "common development and distribution licen[sc]e(?: [0-9] [0-9])?"),
    ("eupl", "european union", "european union public licen[sc]e(?: v ?1(?: [0-9])?)?"),
    ("cecill", "cecill", "cecill(?: [bc])?(?: licen[sc]e)?"),
    ("artistic-2.0", "artistic", "artistic licen[sc]e(?: 2(?: 0)?)?"),
    ("bsl-1.0", "boost", "boost software licen[sc]e(?: (?:version )?1(?: 0)?)?"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e"),
    ("psf-2.0", "python", "python software foundation licen[sc]e"),
    ("php", "php", "php licen[sc]e(?: (?:version |v)?3(?: 01?)?)?"),
    ("ofl-1.1", "open font", "(?:sil )?open font licen[sc]e(?: (?:version )?1 1)?"),
    ("odbl", "open database", "open (?:data commons open )?database licen[sc]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: version 2)?"),
    ("cc0", "cc0", "cc0(?: 1(?: 0)?)?(?: universal)?"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4](?: [05])?)?"),
    ("cc-by", "cc by", "cc by(?: [1-4](?: [05])?)?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc", "creative commons", "creative commons(?: licen[sc]e)?"),
)
# How a text refers to a license: name, keyword, words before, words after, priority (1 wins), confidence.
REFERENCES = (
    ("identifier", "spdx", "spdx license identifier ", "", 1, 1.0),
    ("grant", "under", "(?:licensed|released|distributed|available|published|provided|redistribute it) (?:and or modify it )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a )?", "(?: license)?", 1, 0.95),
    ("notice", "subject", "subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", "(?: license)?", 1, 0.9),
    ("copy", "copy of", "copy of (?:the )?", "(?: along with this (?:program|software|library|file|document))?", 2, 0.85),
    ("name", "", "", "", 3, 0.7),
)
# Texts and notices that name no license.
TEXTS = (
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 1, 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95),
    ("boost", "permission is hereby", "permission is hereby granted free of charge to any person or organization", 1, 0.95),
    ("gpl", "free software", "this program is free software(?: you can redistribute it)?", 2, 0.8),
    ("public-domain", "public domain", "(?:released into|dedicated to|placed in|in) the public domain", 2, 0.8),
    ("public-domain", "public domain", "public domain", 3, 0.6),
    ("proprietary", "all rights reserved", "all rights reserved", 3, 0.5),
    ("proprietary", "proprietary", "proprietary (?:and confidential|licen[sc]e)", 2, 0.7),
    ("no-warranty", "without warranty", "without warranty of any kind", 3, 0.3),
    ("copyright", "copyright", "copyright(?: c)? [0-9]{4}(?: [0-9]{4})?", 3, 0.4),
    ("license-mention", "licen", "(?:this )?(?:work|software|file|program|document|text|content) is licen[sc]ed", 3, 0.3),
)


class Rule(NamedTuple):
    place: int
    label: str
    keyword: str
    name_keyword: str
    pattern: str
    priority: int
    confidence: float


def spaced(words: str) -> str:
    """The signature in the form of the texts: a space before and after each word."""
    return " " + words.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "


def rules() -> list[Rule]:
    """Every way of reference with every name, and the texts, in the order that settles ties."""
    out = [(label, key.replace(" ", "  "), name_key.replace(" ", "  "), spaced(before + name + after), priority, confidence) for _, key, before, after, priority, confidence in REFERENCES for label, name_key, name in NAMES]
    out += [(label, "", key.replace(" ", "  "), spaced(text), priority, confidence) for label, key, text, priority, confidence in TEXTS]
    return [Rule(i, *x) for i, x in enumerate(out)]


def keywords() -> list[str]:
    """The keywords of all names and texts, without those that hold another one: no rule finds anything in a text without any."""
    found = {r.name_keyword for r in rules()}
    return sorted(x for x in found if not any(y != x and y in x for y in found))


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() agrees where no other letter has an ASCII letter as its lower case; translate() is slower."""
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _detections(words: Column, found: list[Rule]) -> Column:
    """Sorted detections (start, minus end, priority, place, label, confidence) of the rules whose keywords the text has."""
    table = F.array(*[F.struct(F.lit(r.place).alias("place"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.name_keyword).alias("name_keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for r in found])
    gated = F.filter(table, lambda r: words.contains(r.name_keyword) & words.contains(r.keyword))

    def places(r: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(words, r.pattern, F.lit(0)), lambda x: F.length(x))
        gaps = F.transform(F.split(words, r.pattern, -1), lambda x: F.length(x))
        step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,until:int,priority:int,place:int,label:string,confidence:double>>").alias("out"))

        def add(done: Column, x: Column) -> Column:
            start = done.at + x.gaps
            one = F.struct(start.alias("start"), (-(start + x.hits)).alias("until"), r.priority.alias("priority"), r.place.alias("place"), r.label.alias("label"), r.confidence.alias("confidence"))
            return F.struct((start + x.hits).alias("at"), F.when(x.hits.isNull(), done.out).otherwise(F.concat(done.out, F.array(one))).alias("out"))

        return F.aggregate(F.arrays_zip(gaps.alias("gaps"), hits.alias("hits")), step, lambda a, x: add(a, x), lambda a: a.out)

    return F.array_sort(F.flatten(F.transform(gated, places)))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    Base phrases count wherever their words stand one after another. A rule's detection is suppressed if another detection of the
    same or a better priority covers it; of equal ones the first in the rules' order stays. score is the best confidence of what is
    left, 0 without any. A null or empty text has no words: counts 0, places null, labels empty. Repeated rows give repeated rows;
    other columns are ignored.
    """
    raw = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(raw), SEPARATORS, "  ")), F.lit(" "))
    # explode() of one element keeps the optimizer from computing the words once for each use
    df = docs.select(F.col(id_column), F.explode(F.array(joined)).alias("_words"))
    w = F.col("_words")
    empty = w == "  "
    hits = {p: w.contains(f" {p.replace(' ', '  ')} ") for p in BASE}
    form = {p: f" {p.replace(' ', '  ')} " for p in BASE}
    count = sum((F.when(hits[p], F.regexp_count(w, F.lit(form[p]))).otherwise(0) for p in BASE), F.lit(0)).cast("long")
    first = F.least(*[F.when(hits[p], F.floor(_spaces(F.substring(w, F.lit(1), F.locate(form[p], w) - 1)) / 2)) for p in BASE]).cast("long")
    last = F.greatest(*[F.when(hits[p], F.floor(_spaces(F.substring(w, F.lit(1), F.length(w) + 1 - F.locate(form[p][::-1], F.reverse(w)) - len(form[p]))) / 2)) for p in BASE]).cast("long")
    base = F.array_compact(F.array(*[F.when(hits[p], F.lit(BASE[p])) for p in BASE]))
    gate = F.lit(False)
    for keyword in keywords():
        gate = gate | w.contains(keyword)
    nothing = F.array().cast("array<struct<start:int,until:int,priority:int,place:int,label:string,confidence:double>>")
    df = df.select(
        id_column,
        F.when(empty, 0).otherwise(F.floor(_spaces(w) / 2)).cast("long").alias("n_words"),
        count.alias("n_base"),
        F.when(hits_any(hits), first).alias("first_word"),
        F.when(hits_any(hits), last).alias("last_word"),
        base.alias("_base"),
        F.explode(F.array(F.when(gate, _detections(w, rules())).otherwise(nothing))).alias("_found"),
    )
    start = F.struct(*[F.lit(-1).alias(f"reach{p}") for p in (1, 2, 3)], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"), F.lit(0).alias("n"))

    def settle(done: Column, d: Column) -> Column:
        end = -d.until
        covered = F.when(d.priority == 1, done.reach1).when(d.priority == 2, done.reach2).otherwise(done.reach3) >= end
        reach = [F.when(d.priority <= p, F.greatest(done[f"reach{p}"], end)).otherwise(done[f"reach{p}"]).alias(f"reach{p}") for p in (1, 2, 3)]
        return F.struct(*reach, F.when(covered, done.labels).otherwise(F.array_union(done.labels, F.array(d.label))).alias("labels"), F.when(covered, done.best).otherwise(F.greatest(done.best, d.confidence)).alias("best"), F.when(covered, done.n).otherwise(done.n + 1).alias("n"))

    settled = F.explode(F.array(F.when(F.size("_found") > 0, F.aggregate("_found", start, settle)).otherwise(start))).alias("_kept")
    df = df.select("*", settled)
    return df.select(
        id_column, "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", "_kept.labels")), ",").alias("labels"),
        F.greatest(F.col("_kept.best"), F.when(F.size("_base") > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
        F.col("_kept.n").cast("long").alias("n_detections"),
    )


def hits_any(hits: dict[str, Column]) -> Column:
    out = F.lit(False)
    for h in hits.values():
        out = out | h
    return out


def scan_sql(source: str = "documents") -> str:
    """The result in DuckDB's SQL: detections as rows, suppression by windows over each document."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({r.place}, {quote(r.label)}, {quote(r.keyword)}, {quote(r.name_keyword)}, {quote(r.pattern)}, {r.priority}, {r.confidence}::double)" for r in rules())
    base = " union all ".join(f"select {quote(' ' + p.replace(' ', '  ') + ' ')} phrase, {quote(label)} label" for p, label in BASE.items())
    gate = " or ".join(f"contains(w, {quote(s)})" for s in keywords())
    return f"""
with t as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from {source}),
d as (select rid, doc_id, len(ws) n_words, ' ' || array_to_string(ws, '  ') || ' ' w from t),
base as ({base}),
b as (select rid, label, string_split(w, phrase) parts from d, base where contains(w, phrase)),
b2 as (select rid, label, len(parts) - 1 n, (length(parts[1]) - length(replace(parts[1], ' ', ''))) // 2 f, (length(parts[-1]) - length(replace(parts[-1], ' ', ''))) // 2 tail, case label when 'gpl' then 4 else 2 end k from b),
b3 as (select rid, sum(n)::bigint n_base, min(f)::bigint first_word, max(n_words - tail - k)::bigint last_word, list_sort(list(distinct label)) labels from b2 join d using (rid) group by rid),
rule(place, label, keyword, name_keyword, pattern, priority, confidence) as (values {values}),
g as (select * from d where {gate}),
m as (select rid, rule.*, regexp_extract_all(w, pattern) hits, regexp_split_to_array(w, pattern) gaps from g, rule where contains(w, keyword) and contains(w, name_keyword)),
x as (select rid, place, label, priority, confidence, unnest(range(1, len(hits) + 1)) k, hits, gaps from m where len(hits) > 0),
y as (select rid, place, label, priority, confidence, list_sum(list_transform(gaps[1:k], lambda z: length(z))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda z: length(z))), 0) s, length(hits[k]) len from x),
z as (select *, s + len e, max(s + len) filter (where priority = 1) over p r1, max(s + len) filter (where priority <= 2) over p r2, max(s + len) over p r3 from y
  window p as (partition by rid order by s, s + len desc, priority, place rows between unbounded preceding and 1 preceding)),
k as (select rid, list(distinct label) labels, max(confidence) best, count(*) n from z where coalesce(case priority when 1 then r1 when 2 then r2 else r3 end, -1) < e group by rid)
select doc_id, n_words, coalesce(n_base, 0) n_base, first_word, last_word, array_to_string(coalesce(b3.labels, []), ',') base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b3.labels, []), coalesce(k.labels, [])))), ',') labels,
  greatest(coalesce(best, 0.0), case when n_base > 0 then {BASE_CONFIDENCE} else 0.0 end)::double score, coalesce(n, 0) n_detections
from d left join b3 using (rid) left join k using (rid)"""
