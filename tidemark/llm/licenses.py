"""License scan by diagonal voting, with DataFrame functions only.

The rolling k-grams of words of each text are looked up by hash among the k-grams of license templates, whole texts and
notices alike. Hits are joined to template positions, and vote for their diagonal (place in the text less place in
the template) within the template; Spark adds a diagonal's votes up before they are shuffled. Neighbouring diagonals,
as small insertions or deletions make, are merged; a merged span counts if it covers enough of the template's words within
little more than its length. Hits are checked word by word, so a span rests on equal words. Places of a template are
bits of as many numbers as its length asks for. Templates are a fixed table, and so is what is broadcast. Base phrases are
counted besides.

Defined results: null and empty texts have no words, no labels and score 0; a phrase or template that occurs
several times gives one label; templates shorter than k words never match; whole texts count, however long; repeated
rows are judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .store import kept

#: Base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

TEMPLATES = TEXTS
GRAM = 3
#: Diagonals so far apart are merged, and a span has to cover so many hundredths of the template's words.
NEAR, COVER = 2, 75

#: Places of a template that one number holds; a k-gram may reach over by k - 1 bits.
PLACES = 48

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of A-Z-lower-cased letters, digits and characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))  # lower() would make ASCII letters of these
    parts = F.split(F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text)), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    front = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    back = F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 1), 1).otherwise(0)
    return F.slice(parts, front + 1, F.size(parts) - front - back)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def _grams(templates: Sequence[tuple[str, str]], k: int) -> list[tuple[int, str, int, int, str]]:
    """(template, label, its words, place, k-gram)."""
    return [(t, label, len(w), p, " ".join(w[p : p + k])) for t, (label, text) in enumerate(templates) for w in [template_words(text)] for p in range(len(w) - k + 1)]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, k: int = GRAM, near: int = NEAR, cover: int = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template
    that a counted span or phrase covers) and spans (label, first word, words, covered words)."""
    spark: SparkSession = docs.sparkSession
    rows = _grams(templates, k)
    positions = spark.createDataFrame(rows, "template int, label string, n int, place int, gram string").withColumn("hash", F.xxhash64(F.col("gram")))
    hashes = sorted({r.hash for r in positions.select("hash").collect()})
    at = lambda j: F.get("words", j)
    gram = lambda i: F.concat_ws(" ", *(at(i + j) for j in range(k)))
    fits = lambda i, phrase: F.expr("true") if not phrase else _all(at(i + j) == w for j, w in enumerate(phrase.split()))
    starts = sorted({g[4].split()[0] for g in rows})
    assert k < 64 - PLACES
    firsts = sorted({p.split()[0] for p, _ in phrases})
    spot = lambda i: (at(i).isin(firsts) & _any(fits(i, p) for p, _ in phrases)) | (at(i).isin(starts) & F.xxhash64(gram(i)).isin(hashes))
    index = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(F.filter(index, spot), lambda i: F.struct(i.alias("i"), gram(i).alias("gram"), F.filter(F.array(*(F.when(fits(i, p), F.lit(label)) for p, label in phrases)), lambda x: x.isNotNull()).alias("base")))
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), words(F.col(f"`{text}`")).alias("words"))
    slim = kept(slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), found.alias("hits")))

    numbers = range(-(-max((n for _, _, n, _, _ in rows), default=1) // PLACES))
    bit = lambda b: F.when(F.expr(f"place div {PLACES} = {b}"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % PLACES)).otherwise(F.lit(0).cast("long"))
    votes = (
        slim.select("row", F.explode("hits").alias("h"))
        .join(F.broadcast(positions), (F.xxhash64("h.gram") == F.col("hash")) & (F.col("h.gram") == F.col("gram")))
        .groupBy("row", "template", "label", "n", (F.col("h.i") - F.col("place")).alias("diagonal"))
        .agg(*(F.bit_or(bit(b)).alias(f"m{b}") for b in numbers), F.min("h.i").alias("lo"), F.max("h.i").alias("hi"))
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True)).cast("int")
    # bits of all words that the k-grams cover; those that reach over belong to the next number
    reach = {b: " | ".join(f"shiftleft(m{b}, {j})" for j in range(k)) for b in numbers}
    covered = " + ".join(f"bit_count(({reach[b]}) & {(1 << PLACES) - 1}L" + (f" | shiftright({reach[b - 1]}, {PLACES})" if b else "") + ")" for b in numbers)
    spans = (
        votes.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(order))
        .groupBy("row", "template", "label", "n", "run")
        .agg(*(F.bit_or(f"m{b}").alias(f"m{b}") for b in numbers), F.min("lo").cast("long").alias("first_word"), (F.max("hi") + k).cast("long").alias("end_word"))
        .withColumn("covered", F.expr(covered).cast("long"))
        .where((100 * F.col("covered") >= cover * F.col("n")) & (4 * (F.col("end_word") - F.col("first_word")) <= 5 * F.col("n") + 8))
    )
    judged = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first_word", "end_word", "label", "covered", "n"))).alias("spans"))
    base = F.filter("hits", lambda h: F.size(h["base"]) > 0)
    base_labels = F.array_sort(F.array_distinct(F.flatten(F.transform(base, lambda h: h["base"]))))
    none = F.array().cast("array<struct<first_word:bigint,end_word:bigint,label:string,covered:bigint,n:int>>")
    return (
        slim.withColumns({"base": base, "base_list": base_labels})
        .join(judged, "row", "left")
        .withColumn("spans", F.coalesce("spans", none))
        .select(
            "doc_id",
            "n_words",
            F.aggregate("base", F.lit(0).cast("long"), lambda a, h: a + F.size(h["base"])).alias("n_base"),
            F.array_min(F.transform("base", lambda h: h["i"])).cast("long").alias("first_word"),
            F.array_max(F.transform("base", lambda h: h["i"])).cast("long").alias("last_word"),
            F.array_join("base_list", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base_list", F.transform("spans", lambda s: s["label"]))), ",").alias("labels"),
            F.greatest(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"] / s["n"])), F.lit(0.0))).alias("score"),
            "spans",
        )
    )


def _all(items) -> Column:
    out = None
    for x in items:
        out = x if out is None else out & x
    return out


def _any(items) -> Column:
    out = None
    for x in items:
        out = x if out is None else out | x
    return out


def oracle() -> str:
    """DuckDB SQL for scan() with its defaults, less the spans."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    positions = ", ".join(f"({t}, {q(label)}, {n}, {p}, {q(g)})" for t, label, n, p, g in _grams(TEMPLATES, GRAM))
    phrases = ", ".join(f"({q(p)}, {q(label)}, {len(p.split())})" for p, label in PHRASES)
    return f"""
    with positions(template, label, n, place, gram) as (values {positions}),
    phrases(phrase, label, n) as (values {phrases}),
    docs as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
    word as (select row, doc_id, unnest(words) as w, generate_subscripts(words, 1) - 1 as i from docs),
    grams as (select row, i, w || ' ' || coalesce(lead(w) over (partition by row order by i), '') as g2,
                     w || ' ' || coalesce(lead(w) over (partition by row order by i), '') || ' ' || coalesce(lead(w, 2) over (partition by row order by i), '') as g3 from word),
    base as (select row, i, label from grams join phrases on phrase = case n when 2 then g2 else g3 end),
    based as (select row, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct label) as labels from base group by row),
    hits as (select row, template, label, n, place, i, i - place as diagonal from grams join positions on gram = g3),
    votes as (select row, template, diagonal, min(i) as lo, max(i) as hi from hits group by all),
    fresh as (select *, case when diagonal - lag(diagonal) over (partition by row, template order by diagonal) <= {NEAR} then 0 else 1 end as fresh from votes),
    runs as (select *, sum(fresh) over (partition by row, template order by diagonal) as run from fresh),
    spans as (select row, label, n, count(distinct place + j) as covered, min(lo) as a, max(hi) + {GRAM} as b
              from runs join hits using (row, template, diagonal), (select unnest(range({GRAM})) as j) group by row, template, label, n, run),
    good as (select row, list(distinct label) as labels, max(covered / n) as score from spans where 100 * covered >= {COVER} * n and 4 * (b - a) <= 5 * n + 8 group by row)
    select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
           coalesce(array_to_string(list_sort(based.labels), ','), '') as base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(good.labels, [])))), ','), '') as labels,
           greatest(case when n_base > 0 then 1.0 else 0.0 end, coalesce(score, 0))::double as score
    from docs left join based using (row) left join good using (row)"""
