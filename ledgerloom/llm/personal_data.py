"""Personal data by candidates and boosted trees.

Wide generators propose spans that overlap freely: whatever looks like a number, a group of numbers or an
address. Boosted trees judge each by its format and its context. They are fitted on labelled examples of two
kinds. Real ones are the table's own strict spans, written as the strict patterns don't have them (other marks
between digits, no country's plus, "(at)") and left in their own contexts; beside each a twin that is none (a wrong
check digit, a part beyond 255). Seeds are drawn by rule from stated formats and cues, both of personal data and of
what looks like it (dates, book and order numbers, amounts, versions). The threshold comes from held-out examples. Of a chain of overlapping candidates the generator of the best one stays; strict spans always stay and
nothing overlaps them. All of it is DataFrame operations: candidates are rows, and chains are told by a sweep
over each document's sorted spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.boosting import Boosted, threshold
from ledgerloom.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
ADDED = ("number", "group", "address")
PRECISION = 0.95
#: Labelled examples that the trees are fitted on and calibrated with.
SEEDS = 6000
#: Strict spans of the table that real examples are made of, drawn by a hash.
REAL = 4000
#: Trees.
ROUNDS = 80
#: The strict patterns, rewritten so that no text takes more than a few steps a character: runs are entered
#: at their start alone (or where the last match ended) and never given back. They match what these do:
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+; [0-9]+(\.[0-9]+){3}; [0-9]([ -]?[0-9])+ with 16 to 19
#: digits; \+[0-9][ ().0-9-]+[0-9].
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z_+(])[+(]{0,2}[0-9](?:[\x20().\-/]{0,3}[0-9]){6,24}(?![0-9A-Za-z_])",
    "group": r"(?<![0-9A-Za-z_])[0-9]{1,6}+(?:[\x20\-][0-9]{2,6}+){1,5}+(?![0-9A-Za-z_])",
    "address": r"(?<![^\s<>()\[\]\",;:])[^\s<>()\[\]\",;:@]{1,64}+(?:@|\s?\(at\)\s?)[^\s<>()\[\]\",;:@]{3,253}+",
}
#: Words of context, in the languages of the corpus, and their numbers as a feature.
CONTEXT = (
    (1, r"(?i)\b(phone|tel|telephone|call|mobile|fax|telefon|anruf|mobil|teléfono|llamar|téléphone|appel|portable)\b"),
    (2, r"(?i)\b(mail|e-mail|email|contact|kontakt|correo|courriel|write|adresse)\b"),
    (3, r"(?i)\b(card|visa|mastercard|credit|karte|tarjeta|carte|iban|account|konto|cuenta|compte)\b"),
    (4, r"(?i)\b(ssn|social security|passport|ausweis|pasaporte|passeport)\b"),
    (5, r"(?i)\b(isbn|issn|doi|order|version|page|bestellung|pedido|commande|art|no|nr|on|am|total|price|preis|precio|prix)\b"),
)
#: The formats of the seed: # stands for a digit, ? for a letter. ``always`` is personal, ``never`` is not, and ``cued`` is
#: where a cue before it says so.
FORMATS = (
    ("always", "(###) ###-####"), ("always", "###-###-####"), ("always", "0## ### ## ##"), ("always", "0### / ######"), ("always", "8 (9##) ###-##-##"),
    ("always", "0#.##.##.##.##"), ("always", "(0##) #### ####"), ("cued", "0##########"), ("cued", "##########"), ("cued", "### ### ###"), ("cued", "#######"),
    ("cued", "## ## ## ## ##"), ("cued", "###-##-####"), ("cued", "#### ###### #####"), ("cued", "###-####"), ("cued", "#########"),
    ("always", "????? (at) ????.???"), ("always", "???.???? (at) ?????.??"), ("always", "jörg.????@????.??"), ("always", "????@müller.??"), ("always", "?????.????é@????.???"), ("always", "???(at)????.??"),
    ("never", "20##-0#-1#"), ("never", "20##-0#-1# 1#:##"), ("never", "1#.0#.20##"), ("never", "0#/1#/20##"), ("never", "978-#-##-######-#"), ("never", "# ### ### ###"), ("never", "### ###.##"),
    ("never", "#.#.##.####"), ("never", "################"), ("never", "####################"), ("never", "19## - 20##"), ("never", "20## 20## 20##"), ("never", "##.###### ##.######"), ("never", "#######.##"),
    ("never", "#### #### #### ####"), ("never", "####-####"), ("never", "##-##-##-##"), ("never", "@???????"), ("never", "??? @???? ???"), ("never", "#@###"), ("never", "??@??"),
)
#: Words before a seed: those that speak of personal data, and others. The first empty ones are as likely as all others are.
PERSONAL_CUES = ("phone", "call me at", "Tel.", "my mobile:", "fax", "Telefon", "llamar al teléfono", "téléphone", "account", "Konto", "SSN", "passport", "contact", "card")
OTHER_CUES = ("", "", "", "and the", "ISBN", "order", "total", "page", "version", "on", "price", "of about", "in the year", "see", "Bestellung Nr")
TAILS = ("", ".", ", ok", " and", ")", ";", " / 555-012-3456")
_BLOCK = 512
_NO_SPANS = "cast(array() as array<struct<v:string,s:bigint,e:bigint>>)"
_NO_CANDIDATES = "cast(array() as array<struct<v:string,s:bigint,e:bigint,b:string,a:string>>)"


def with_matches(rows: DataFrame, name: str, pattern: str, needs: str | None = None, around: bool = False) -> DataFrame:
    """``rows`` with the column ``name``: each match of ``pattern`` in the column text, its start and its end, and what is ``around`` it up to the next match: b, 24 characters before, and a, one behind.

    A text is matches and the gaps between them, so starts are running sums of both lengths; the sums are
    taken in blocks, as a single running sum of an array would copy it once for each element.
    """
    m, g, d, b = (f"_{name}_{x}" for x in "mgdb")
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = rows.withColumn(m, F.when(F.contains("text", F.lit(needs)), found).otherwise(F.array().cast("array<string>")) if needs else found)
    rows = rows.withColumn(g, F.when(F.size(m) > 0, F.split("text", pattern, -1)))
    rows = rows.withColumn(d, F.expr(f"zip_with({m}, slice({g}, 1, size({m})), (x, y) -> cast(length(x) + length(y) as bigint))"))
    total = "aggregate(slice(%s, %s, %s), 0L, (t, x) -> t + x)"
    rows = rows.withColumn(b, F.expr(f"if(size({m}) = 0, null, transform(sequence(0, (size({m}) - 1) div {_BLOCK}), j -> {total % (d, f'cast(j as int) * {_BLOCK} + 1', _BLOCK)}))"))
    # The blocks' sums are named twice below, so that they are computed once a row and not moved into the loop.
    start = f"{total % (b, 1, f'cast(i div {_BLOCK} as int)')} + {total % (d, f'cast(i div {_BLOCK} as int) * {_BLOCK} + 1', f'i % {_BLOCK}')} + length({g}[i])"
    more, shown, kind = "", "", _NO_SPANS
    if around:
        more = f", 'b', right({g}[i], 24), 'a', left({g}[i + 1], 1)"
        shown, kind = ", 'b', x.b, 'a', x.a", _NO_CANDIDATES
    spans = f"transform(transform({m}, (v, i) -> named_struct('v', v, 's', {start}{more})), x -> named_struct('v', x.v, 's', x.s, 'e', x.s + length(x.v){shown}))"
    return rows.withColumn(name, F.expr(f"if(size({m}) = 0 or size({b}) = 0, {kind}, {spans})")).drop(m, g, d, b)


def _sound(kind: str) -> str:
    """The check of a strict match ``x``."""
    digits = "regexp_replace(x.v, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(x.v, '[.]'), p -> length(ltrim('0', p)) < 4 and cast(if(ltrim('0', p) = '', '0', ltrim('0', p)) as int) <= 255)"
    if kind == "card":
        digit = f"cast(substring(reverse({digits}), i, 1) as int)"
        return f"aggregate(sequence(1, length({digits})), 0L, (t, i) -> t + if(i % 2 = 0, 2 * {digit} % 10 + 2 * {digit} div 10, {digit})) % 10 = 0"
    if kind == "phone":
        return f"length({digits}) between 8 and 15"
    return "true"


_DIGITS = "regexp_replace(v, '[^0-9]', '')"
#: Whether a candidate's digits pass the check of cards, if they are as many, and whether it is four parts up to 255.
_CARD = f"case when length({_DIGITS}) between 16 and 19 then if(exists(array(named_struct('v', v)), x -> {_sound('card')}), 1, 2) else 0 end"
_PARTS = "cast(v rlike '^[0-9]{1,3}([^0-9]{1,3}[0-9]{1,3}){3}$' and forall(split(v, '[^0-9]+'), p -> p <> '' and cast(p as int) <= 255) as int)"


def _features() -> str:
    """Binned features of a candidate (columns k, v, b, a): format first, then context."""
    words = " ".join(f"when b rlike r'{p}' then {n}" for n, p in CONTEXT)
    # Lengths of the runs of digits, by position, tell formats apart.
    return f"""array(
      k, least(length(regexp_replace(v, '[^0-9]', '')), 20), least(regexp_count(v, '[0-9]+'), 7), least(length(regexp_extract(v, '^[^0-9]*([0-9]+)', 1)), 8),
      least(length(regexp_extract(v, '([0-9]+)[^0-9]*$', 1)), 8), least(length(regexp_replace(v, '[^ ()/-]', '')), 5), cast(v like '%(%' as int), cast(v like '%-%' as int), cast(v like '%/%' as int),
      least(length(regexp_replace(v, '[^.]', '')), 4), cast(v rlike '^[(]?0' as int), cast(v rlike '^(19|20)[0-9][0-9]([^0-9]|$)' as int), cast(v rlike '[^0-9](19|20)[0-9][0-9]$' as int), cast(v like '978%' as int),
      case when v rlike '([(]at[)]|@).*[.][a-z]' then 2 when v rlike '@' then 1 else 0 end, cast(v rlike '^[ -~]*$' as int),
      {_CARD}, {_PARTS}, case {words} else 0 end, case when a = '' then 0 when a rlike '[A-Za-z0-9]' then 2 else 1 end)"""


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, ``strict`` (array of kind, s, e, v, b) and ``wide`` (array of k, the generator's number, v, s, e, b, a)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    for kind, needs in zip(KINDS, ("@", ".", None, "+"), strict=True):
        rows = with_matches(rows, kind, PATTERNS[kind], needs, around=True)
    for kind in ADDED:
        rows = with_matches(rows, kind, PATTERNS[kind], around=True)
    strict = ", ".join(f"transform(filter({k}, x -> {_sound(k)}), x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e, 'v', x.v, 'b', x.b))" for k in KINDS)
    wide = ", ".join(f"transform({g}, x -> named_struct('k', {i}, 'v', x.v, 's', x.s, 'e', x.e, 'b', x.b, 'a', x.a))" for i, g in enumerate(ADDED))
    return rows.select("doc_id", *keep, F.expr(f"concat({strict})").alias("strict"), F.expr(f"concat({wide})").alias("wide"))


def seeds(spark: SparkSession, n: int = SEEDS) -> DataFrame:
    """Labelled examples: doc_id, text, where in it the value stands (vs, ve), and whether it is personal (y); by hashes of their numbers."""
    listed = lambda x: F.array(*map(F.lit, x))
    of = lambda x, seed: F.element_at(listed(x), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(x))) + 1).cast("int"))
    rows = spark.range(0, n, 1, 1).select("id", of([f for f, _ in FORMATS], 1).alias("label"), of([f for _, f in FORMATS], 1).alias("format"), of([0, 1], 2).alias("cued"), of(PERSONAL_CUES, 3).alias("cue"), of(OTHER_CUES, 4).alias("other"), of(TAILS, 5).alias("tail"))
    drawn = "case c when '#' then cast(pmod(xxhash64(id, i, 6), 10) as string) when '?' then substring('abcdefghijklmnopqrstuvwxyz', cast(pmod(xxhash64(id, i, 7), 26) as int) + 1, 1) else c end"
    rows = rows.withColumn("value", F.expr(f"array_join(transform(split(format, ''), (c, i) -> {drawn}), '')"))
    before = F.when(F.col("cued") == 1, F.col("cue")).otherwise(F.col("other"))
    rows = rows.withColumn("before", F.concat(F.lit("so "), before, F.lit(" ")))
    y = (F.col("label") == "always") | ((F.col("label") == "cued") & (F.col("cued") == 1))
    vs = F.length("before").cast("long")
    return rows.select(F.col("id").alias("doc_id"), F.concat("before", "value", "tail").alias("text"), vs.alias("vs"), (vs + F.length("value")).alias("ve"), y.alias("y"))


#: How strict values are written otherwise, by kind, as expressions over v; and their twins that are no personal data.
REWRITTEN = {
    "phone": ["substring(v, 2)", *[f"regexp_replace(substring(v, 2), '[^0-9]+', '{m}')" for m in ("/", " ", "-")]],
    "card": [f"regexp_replace({_DIGITS}, '([0-9]{{4}})(?=[0-9])', '$1{m}')" for m in ("/", ".", " / ", ") (")],
    "email": ["replace(v, '@', ' (at) ')", "replace(v, '@', '(at)')", "replace(v, '@', ' (at)')", "replace(v, '@', '(at) ')"],
    "ip": [f"replace(v, '.', '{m}')" for m in ("-", " ", "/", " - ")],
}
TWINS = {
    "card": f"concat(substring({_DIGITS}, 1, length({_DIGITS}) - 1), (cast(right({_DIGITS}, 1) as int) + 1 + pmod(xxhash64(v), 8)) % 10)",
    "ip": "concat(300 + pmod(xxhash64(v), 600), regexp_replace(v, '^[0-9]+', ''))",
    "phone": "concat('+20', 10 + pmod(xxhash64(v), 20), '-0', 1 + pmod(xxhash64(v), 9), '-1', pmod(xxhash64(v), 10))",
    "email": "replace(v, '.', ' ')",
}


def real_examples(found: DataFrame, n: int = REAL) -> DataFrame:
    """Labelled examples as ``seeds`` gives them, out of ``n`` strict spans of ``found`` (as ``candidates`` gives it, with row) at most."""
    each = found.filter("size(strict) > 0").select("row", F.inline("strict")).withColumn("h", F.xxhash64("row", "s", "kind"))
    few = each.orderBy("h", "row", "s", "kind").limit(n).select("h", "kind", "v", "b", F.explode(F.array(F.lit(True), F.lit(False))).alias("y"))
    twin = F.expr("case " + " ".join(f"when kind = '{k}' then {x}" for k, x in TWINS.items()) + " end")
    few = few.withColumn("v", F.when(F.col("y"), F.col("v")).otherwise(twin))
    way = "pmod(h div 16, 4)"
    written_as = "case " + " ".join(f"when kind = '{k}' and {way} = {i} then {x}" for k, ways in REWRITTEN.items() for i, x in enumerate(ways)) + " end"
    few = few.withColumn("v", F.expr(written_as)).withColumn("tail", F.element_at(F.array(*map(F.lit, TAILS)), (F.pmod(F.col("h"), F.lit(len(TAILS))) + 1).cast("int")))
    vs = F.length("b").cast("long")
    return few.select(F.col("h").alias("doc_id"), F.concat("b", "v", "tail").alias("text"), vs.alias("vs"), (vs + F.length("v")).alias("ve"), "y")


def trained(spark: SparkSession, precision: float = PRECISION, n: int = SEEDS, real: DataFrame | None = None) -> tuple[Boosted, float]:
    """The trees and the threshold, from the counted features of the examples' candidates; a third of the examples, by a hash, is held out.

    A candidate is personal where it and the value that it was drawn around overlap by four fifths of either. What
    begins behind the value has no label.
    """
    examples = seeds(spark, n)
    found = candidates(examples if real is None else examples.unionByName(real), keep=("vs", "ve", "y"))
    each = found.select((F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(3)) == 0).alias("held"), "vs", "ve", "y", F.inline("wide")).filter("s < ve")
    personal = F.expr("y and least(e, ve) - greatest(s, vs) >= 0.8 * greatest(e - s, ve - vs)")
    each = each.select("held", F.expr(_features()).alias("f"), personal.cast("long").alias("y"))
    counts = each.groupBy("held", "f").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()  # as many rows as there are seeds' candidates at most
    parts = {}
    for held in (False, True):
        rows = sorted((r["f"], r["p"], r["n"]) for r in counts if bool(r["held"]) == held)
        parts[held] = [np.asarray([r[k] for r in rows], float if k else int) for k in range(3)]
    model = Boosted.fitted(*parts[False], rounds=ROUNDS)
    x, p, total = parts[True]
    return model, threshold(model.score(x), p, total, precision)


def find_personal_data(docs: DataFrame, precision: float = PRECISION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end, score).

    Strict spans come first, by kind, with score 1; added ones by start, with their calibrated model's probability.
    These pass the threshold and overlap no strict span and none of their own. Null texts count as empty; repeated
    rows are searched each for itself, with or without an id; an empty table gives no rows; other columns are ignored.
    """
    found = written(candidates(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    model, least = trained(docs.sparkSession, precision, real=real_examples(found))
    each = found.filter("size(wide) > 0").select("row", F.inline("wide")).select("row", "k", "s", "e", F.expr(_features()).alias("f"))
    scored = each.select("row", "k", "s", "e", F.expr(model.folded("f")).alias("o")).filter(F.col("o") >= least)
    strict = found.filter("size(strict) > 0").select("row", F.inline("strict")).select("row", F.lit(-1).alias("k"), "s", "e", F.lit(0.0).alias("o"))
    # A span begins a new chain where none before it in its document reaches it.
    by = Window.partitionBy("row").orderBy("s", "e", "k")
    swept = scored.unionByName(strict).withColumn("reach", F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    swept = swept.withColumn("chain", F.sum(F.when(F.col("s") < F.col("reach"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chain = Window.partitionBy("row", "chain")
    swept = swept.withColumn("strict", F.min("k").over(chain) < 0).withColumn("best", F.max_by("k", F.struct("o", -F.col("s"), "e", -F.col("k"))).over(chain))
    names = F.element_at(F.array(*map(F.lit, ADDED)), F.col("k") + 1)
    stays = swept.filter("not strict and k = best").select("row", F.struct(F.col("s").alias("start"), names.alias("kind"), F.col("e").alias("end"), (1 / (1 + F.exp(-F.col("o")))).alias("score")).alias("x"))
    added = stays.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("added"))
    none = "cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)"
    spans = f"concat(transform(strict, x -> named_struct('kind', x.kind, 'start', x.s, 'end', x.e, 'score', 1.0D)), coalesce(transform(added, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'score', x.score)), {none}))"
    return found.select("row", "doc_id", "strict").join(added, "row", "left").select("doc_id", F.expr(spans).alias("spans"))


def span_columns() -> list[Column]:
    """Counts by strict kind, the digest of the strict spans and all spans as text."""
    shown = lambda names: "array_join(flatten(array(" + ", ".join(f"transform(filter(spans, x -> x.kind = '{k}'), x -> concat_ws(':', x.kind, x.start, x.end))" for k in names) + ")), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return [*counts, F.sha2(F.expr(shown(KINDS)), 256).alias("base_sha256"), F.expr(shown((*KINDS, *ADDED))).alias("spans")]


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *span_columns())
