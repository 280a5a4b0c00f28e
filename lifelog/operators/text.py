"""Text checks over published prose.  JVM-side expressions over whole texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dedupe_roster, first_sentence
from .ordered import ranked


def scan_terms(
    docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", exempt: str | None = None
) -> DataFrame:
    """(key, term) for every listed term found between non-[a-z0-9] characters.

    ``exempt`` names an array column; its entries are blanked out first, ignoring case.  All terms are
    looked up at once: the text falls into words and the gaps between them, and every run of as many
    words as some term has, gaps included, is looked up in one hash set of the terms.  The cost depends
    on the text and on the different lengths of terms in words, not on their number.  A term that begins
    or ends with another character than [a-z0-9] is no run of words and costs a pattern test of its own.
    """
    terms = sorted({t.lower() for t in terms})
    runs = [t for t in terms if re.fullmatch("[a-z0-9](.*[a-z0-9])?", t, re.DOTALL)]
    other = [t for t in terms if t not in set(runs)]
    body = F.lower(text)
    if exempt is not None:
        body = F.aggregate(
            F.filter(exempt, lambda e: F.length(e) > 0), body,
            lambda acc, e: F.replace(acc, F.lower(e), F.lit(" ")),
        )
    split = docs.select(
        key, body.alias("__body"), F.regexp_extract_all(body, F.lit("[a-z0-9]+"), F.lit(0)).alias("__words"),
        F.split(body, "[a-z0-9]+").alias("__gaps"))

    def runs_of(length: int) -> Column:
        def run_at(i: Column) -> Column:
            parts = [F.get("__words", i)]
            for k in range(1, length):
                parts += [F.get("__gaps", i + k), F.get("__words", i + k)]
            return F.concat(*parts)

        return F.transform(F.sequence(F.lit(0), F.size("__words") - length), run_at)

    found = []
    for length in sorted({len(re.findall("[a-z0-9]+", t)) for t in runs}):
        of_length = F.array(*[F.lit(t) for t in runs if len(re.findall("[a-z0-9]+", t)) == length])
        if length == 1:
            found.append(F.array_intersect("__words", of_length))
            continue
        grams = F.when(F.size("__words") >= length, runs_of(length))
        found.append(F.coalesce(F.array_intersect(grams, of_length), F.array().cast("array<string>")))
    if other:
        tests = [F.when(F.col("__body").rlike(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])"), F.lit(t)) for t in other]
        found.append(F.filter(F.array(*tests), lambda t: t.isNotNull()))
    if not found:
        return split.select(key, F.lit(None).cast("string").alias("term")).limit(0)
    hits = reduce(lambda a, b: F.array_distinct(F.concat(a, b)), found)
    return split.select(key, F.explode(hits).alias("term"))


def find_mentions(
    docs: DataFrame, key: str = "doc_id", text: str = "text", roster: str = "roster"
) -> DataFrame:
    """(key, start, name) for every roster name in the row's own text.

    Longest names first, case ignored, text consumed left to right; a match touching a word
    character on either side is dropped (and its text stays consumed).  ``start`` is 0-based.
    Everything happens inside the row; only mentions that stay leave it.
    """
    names = F.array_sort(
        dedupe_roster(F.col(roster)),
        lambda a, b: F.length(b) - F.length(a),
    )
    quoted = F.transform(names, lambda n: F.regexp_replace(n, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit("(?iu)"), F.array_join(quoted, "|"))
    rows = docs.where(F.size(names) > 0).select(key, F.col(text).alias("__t"), pattern.alias("__p"))
    rows = rows.select(
        key,
        F.expr("regexp_extract_all(__t, __p, 0)").alias("__m"),
        F.expr("split(__t, __p, -1)").alias("__g"),
    ).where(F.size("__m") > 0)
    # The characters around match i: the gaps beside it, or the neighbouring match where a gap is empty.
    matches, gaps, none = F.col("__m"), F.col("__g"), F.lit("")
    word = r"^[A-Za-z0-9_]$"

    def glued(i: Column) -> Column:
        left = F.right(F.concat(F.coalesce(F.get(matches, i - 1), none), F.get(gaps, i)), F.lit(1))
        right = F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(matches, i + 1), none)), F.lit(1))
        return left.rlike(word) | right.rlike(word)

    parts = F.transform(matches, lambda m, i: F.struct(m.alias("name"), glued(i).alias("glued")))
    ends = running_totals(F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))
    spots = F.zip_with(parts, ends, lambda p, e: F.when(
        ~p["glued"], F.struct((e - F.length(p["name"])).alias("start"), p["name"].alias("name"))))
    return rows.select(key, F.inline(F.array_compact(spots)))


def running_totals(values: Column) -> Column:
    """Running totals of an array of integers, gathered in chunks so that appending stays cheap."""
    start = F.struct(
        F.lit(0).alias("sum"), F.array().cast("array<int>").alias("open"), F.array().cast("array<array<int>>").alias("chunks")
    )

    def step(acc: Column, v: Column) -> Column:
        total = acc["sum"] + v
        full = F.size(acc["open"]) >= 64
        return F.struct(
            total.alias("sum"),
            F.when(full, F.array(total)).otherwise(F.array_append(acc["open"], total)).alias("open"),
            F.when(full, F.array_append(acc["chunks"], acc["open"])).otherwise(acc["chunks"]).alias("chunks"),
        )

    return F.aggregate(values, start, step, lambda acc: F.flatten(F.array_append(acc["chunks"], acc["open"])))


def recent_prose(articles: DataFrame, kind: str, n: int) -> DataFrame:
    """Headline, attribution and opening sentence of the last ``n`` published articles."""
    published = articles.where((F.col("kind") == kind) & (F.col("status") == "published"))
    newest = ranked(published, [F.col("created_at").desc(), F.col("id").desc()], n)
    return newest.select(
        "id", F.coalesce("headline", F.lit("")).alias("headline"),
        F.col("pull_quote_attribution").alias("attribution"),
        first_sentence(F.col("lede")).alias("opener"),
    )


def dedupe_quotes(new: DataFrame, recent: DataFrame) -> DataFrame:
    """Null the quote of new articles whose attribution was used recently.

    ``new(…, quote_text, quote_attribution)``, ``recent(attribution)``.
    """
    used = (
        recent.select(F.lower(F.trim("attribution")).alias("__key"))
        .where(F.length("__key") > 0).distinct().withColumn("__used", F.lit(True))
    )
    keyed = new.withColumn("__key", F.lower(F.trim("quote_attribution")))
    flagged = keyed.join(used, "__key", "left")
    reused = F.coalesce("__used", F.lit(False))
    return (
        flagged.withColumn("quote_text", F.when(~reused, F.col("quote_text")))
        .withColumn("quote_attribution", F.when(~reused, F.col("quote_attribution")))
        .drop("__key", "__used")
    )
