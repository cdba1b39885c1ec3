"""Licence scans by a positional index of rare words.

Licence notices are templates of words. Every word of theirs is posted with its template and place, and
counted over all documents. A file is looked up, template by template, by the rarest words that both hold.
A template's mandatory phrase stands in every copy of the notice, so the rarest word of that phrase leads to
each place where the template may begin; there the file's rare words vote for it if they stand at their own
places as well. Where enough agree and the whole phrase stands unchanged, the licence is found. All of it is
done within each row by array functions, in time linear in the row's words; nothing is shuffled but the counts
of the templates' words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words of a template that a file is looked up by, and the share of them that must agree on a place.
LOOKED_UP = 12
AGREE = 0.5
#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, words of a notice, and the phrase in it that must stand unchanged.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed under the license is distributed on an as is basis"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "gnu general public license along with this program"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "nor the names of its contributors may be used to endorse or promote"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software released into the public domain"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")" if words else "cast(array() as array<string>)"


def _places(label: str, notice: str, key: str) -> tuple[str, list[str], list[str], int]:
    words, phrase = notice.split(), key.split()
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return label, words, phrase, at


def word_counts(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """The number of rows with each word of ``vocabulary``; as many rows as it has reach the driver."""
    found = words.select(F.explode(F.expr(f"array_intersect({_quoted(vocabulary)}, words)")).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def scan_licenses(docs: DataFrame, looked_up: int = LOOKED_UP, agree: float = AGREE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base (array of label, word), found (array of label, word, share).

    ``base`` has every place of a base phrase, ``found`` every verified notice with the share of the file's
    ``looked_up`` rarest words of the notice that stand at their places. How common a word is only orders the
    words: a notice is found whatever else the table or the file holds. Null texts count as empty and have no
    words; repeated rows are scanned each for itself; an empty table gives no rows; other columns are ignored.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"))
    templates = [_places(*t) for t in TEMPLATES]
    df = word_counts(rows, sorted({w for _, words, _, _ in templates for w in words}))
    rarity = lambda w: (df.get(w, 0), w)
    anchors = [min(phrase, key=rarity) for _, _, phrase, _ in templates]
    hit, seen = "array<struct<w:string,p:int>>", sorted(set(anchors))
    # The words that lead to a template, by hashing, and with their places where a row holds any.
    is_anchor = f"w in ({', '.join(map(repr, seen))})"
    rows = rows.withColumn("hits", F.expr(f"if(arrays_overlap(words, {_quoted(seen)}), filter(transform(words, (w, i) -> if({is_anchor}, named_struct('w', w, 'p', i), null)), x -> x is not null), cast(array() as {hit}))"))
    # All words of templates that the row holds, the rarest first; they are few, whatever the row's length.
    order = _quoted(sorted({w for _, words, _, _ in templates for w in words}, key=rarity))
    rows = rows.withColumn("held", F.expr(f"if(size(hits) > 0, array_intersect({order}, words), cast(array() as array<string>))"))
    shown = []
    for (label, words, phrase, at), anchor in zip(templates, anchors, strict=True):
        k = phrase.index(anchor)
        sel = f"slice(array_intersect({_quoted(sorted(set(words), key=rarity))}, held), 1, {looked_up})"
        here = f"filter(hits, h -> h.w = '{anchor}' and h.p >= {k} and slice(words, h.p - {k} + 1, {len(phrase)}) = {_quoted(phrase)})"
        # A word that is null, before the beginning or behind the end, agrees with none.
        votes = f"size(filter(transform({_quoted(words)}, (w, j) -> coalesce(get(words, h.p - {k + at} + j) = w and array_contains(s, w), false)), y -> y))"
        need = min(len(words), looked_up)
        # The look-up words are bound to a name, so that they are found once a row and only where the phrase stands.
        found = f"transform(f, h -> named_struct('label', '{label}', 'word', cast(h.p - {k} as long), 'share', least(1.0D, cast({votes} as double) / {need})))"
        shown.append(f"flatten(transform(filter(array({here}), f -> size(f) > 0), f -> flatten(transform(array({sel}), s -> {found}))))")
    none = "cast(array() as array<struct<label:string,word:bigint,share:double>>)"
    rows = rows.withColumn("found", F.expr(f"if(size(hits) = 0, {none}, filter(concat({', '.join(shown)}), x -> x.share >= {agree}D))"))
    base = []
    for phrase, label in BASE.items():
        w = phrase.split()
        follows = " and ".join(f"get(words, i + {k}) = '{x}'" for k, x in enumerate(w) if k)
        base.append(f"filter(transform(words, (w, i) -> if(w = '{w[0]}' and {follows}, named_struct('label', '{label}', 'word', cast(i as long)), null)), x -> x is not null)")
    rows = rows.withColumn("base", F.expr(f"if(array_contains(words, 'license'), concat({', '.join(base)}), cast(array() as array<struct<label:string,word:bigint>>))"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "base", "found")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(x, lambda y: y["label"]) for x in c]))), ",")
    words = F.transform("base", lambda x: x["word"])
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), joined("base").alias("base_labels"), joined("base", "found").alias("labels"), score.alias("score"))


def _sql() -> str:
    bodies = []
    for t, (label, words, phrase, at) in enumerate(map(lambda x: _places(*x), TEMPLATES)):
        bodies.append(f"({t}, '{label}', [{', '.join(map(repr, words))}], [{', '.join(map(repr, phrase))}], {at})")
    base = [f"select r, '{label}' as label, i as word from x where words[i + 1 : i + {len(p.split())}] = [{', '.join(repr(w) for w in p.split())}]" for p, label in BASE.items()]
    return f"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') as words
  from documents),
body(t, label, notice, phrase, pos) as (values {', '.join(bodies)}),
post as (select t, unnest(notice) as w, generate_subscripts(notice, 1) - 1 as p from body),
u as (select r, unnest(words) as w, generate_subscripts(words, 1) - 1 as i from d),
v as (select r, w, i from u where w in (select w from post)),
df as (select w, count(distinct r) as df from v group by w),
sel as (
  select r, t, w from (select distinct v.r, t, w, df from v join post using (w) join df using (w))
  qualify row_number() over (partition by r, t order by df, w) <= {LOOKED_UP}),
stands as (
  select v.r, t, v.i - pos as o
  from v join body on v.w = phrase[1] join d on d.r = v.r
  where words[v.i + 1 : v.i + len(phrase)] = phrase),
votes as (
  select s.r, s.t, s.o, count(v.i) as votes
  from stands s join post on post.t = s.t join v on v.r = s.r and v.i = s.o + post.p and v.w = post.w join sel on sel.r = s.r and sel.t = s.t and sel.w = v.w
  group by all),
found as (
  select r, label, least(1.0::double, votes::double / least(len(notice), {LOOKED_UP})) as share
  from votes join body using (t) where least(1.0::double, votes::double / least(len(notice), {LOOKED_UP})) >= {AGREE}),
x as (select d.r, d.words, u.i from d join u on d.r = u.r and u.w in ('mit', 'apache', 'general')),
base as ({' union all '.join(base)}),
b as (select r, count(*) as n, min(word) as lo, max(word) as hi, string_agg(distinct label, ',' order by label) as labels from base group by r),
f as (select r, max(share) as share from found group by r),
l as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from base union all select r, label from found) group by r)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(b.n, 0) as bigint) as n_base, cast(lo as bigint) as first_word, cast(hi as bigint) as last_word,
       coalesce(b.labels, '') as base_labels, coalesce(l.labels, '') as labels, case when b.n > 0 then 1.0::double else coalesce(share, 0.0::double) end as score
from d left join b using (r) left join f using (r) left join l using (r)
"""


OP10_SQL = _sql()
