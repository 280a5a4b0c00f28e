"""Document fingerprints by SpotSigs.

A text is read as lower-case words of letters and digits.  Common words of a few languages are
anchors; a signature is an anchor with the chain of the ``CHAIN`` content words after it, so that it
comes from running prose, wherever in a page that stands.  Of neighbouring anchors the last one
counts.  A text without any chain gives one signature for each of its words and the next, or for its
only word; a text without a word but not empty is its own signature.  The fingerprint is the digest of
the set of signatures.

Likeness is the Jaccard coefficient of two sets.  Sets of lengths a <= b cannot reach ``tau`` unless
a >= tau * b, so sets are partitioned by length into ranges that grow by ``1 / tau``: a set can only
match within its own range and the next.  A pair is met under its rare signatures only: any
``|s| - ceil(tau * |s|) + 1`` of a set must hold one that it shares with a match, and the rarest are
taken.  Equal sets are folded before.

``neighbour_likeness`` compares each text to its edited text and to the next one.  "Next" is by
descending doc_id over the whole table: ids are cut into ranges, each range is ordered in one task,
and the first rows of the next range ride along, so each text is shuffled once.

Defined results: null texts read as empty; two empty sets have likeness 1, an empty and another 0;
null ids come last and repeated ids follow each other by their text; a single row is its own next;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifelog.llm.common import documents, let
from lifelog.staging import stage

CHAIN = 2
TAU = 0.8
#: Ids fall into at most this many ranges, of about ``RANGE_ROWS`` rows.
RANGES, RANGE_ROWS = 65_536, 512
#: Rows of a task that orders ranges, about.
TASK_ROWS = 4_096

# Common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be by for from had has have he her his i in is it its of on or she that the their they this to was
were which with you
als am auch auf aus bei das dem den der des die ein eine einen er es für hat ich im ist mit nicht sich sie sind und
von war wie zu zum zur
au aux avec ce ces dans de des du elle en est et il ils la le les leur lui mais ne nous ou par pas pour qui que sa se
ses son sur un une vous
al como con del el ella en era es esta fue ha la las lo los más muy no para pero por que se ser si sin sobre su sus
también un una y
""".split()

_MARK = "\u0001"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The distinct signatures of ``text``, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    # Each content word with the anchors before it: "anchor MARK anchor MARK word".
    marked = F.array_join(F.transform(words, lambda w: F.concat(
        w, F.when(w.isin(*sorted(set(ANCHORS))), F.lit(_MARK)).otherwise(F.lit(" ")))), "")
    groups = F.filter(F.split(marked, " "), lambda g: g != "")

    def chains(g: Column, content: Column) -> Column:
        def one(e: Column, k: Column) -> Column:
            link = F.concat_ws(" ", F.replace(F.substring_index(e, _MARK, -2), F.lit(_MARK), F.lit(":")),
                               *[F.get(content, k + i) for i in range(1, chain)])
            whole = F.get(content, k + chain - 1) != ""
            return F.when(F.contains(e, F.lit(_MARK)) & whole, link)
        return F.filter(F.transform(g, one), lambda s: s.isNotNull())

    def pairs(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))).otherwise(
            F.transform(w, lambda a, k: F.when(k == F.size(w) - 1, a).otherwise(F.concat_ws(" ", a, F.get(w, k + 1)))))

    found = let(groups, lambda g: let(F.transform(g, lambda e: F.substring_index(e, _MARK, -1)), lambda c: chains(g, c)))
    return let(found, lambda s: F.array_sort(F.array_distinct(
        F.when(F.size(s) > 0, s).otherwise(let(words, pairs)))))


def fingerprint(sigs: Column) -> Column:
    return F.md5(F.array_join(sigs, "\n"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets of signatures."""
    common = F.size(F.array_intersect(a, b))
    return let(common, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def in_order(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, next_text) of every row, the next by descending id, from the last to the first."""
    ids = docs.select("doc_id")
    known = ids.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    low, high = (int(known["low"]), int(known["high"])) if known["high"] is not None else (0, 0)
    wanted = min(RANGES - 1, max(1, known["n"] // rows))
    width = max(1, -(-(high - low + 1) // wanted))
    part = F.coalesce(F.expr(f"({high} - doc_id) div {width}"), F.lit(RANGES))
    # At most RANGES rows of three numbers: the first id of each range and the range before it.
    heads = ids.groupBy(part.alias("range")).agg(F.max("doc_id").alias("head"))
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy()))
    heads = heads.select(F.col("head"), before.alias("goes"))

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = texts.select(part.alias("range"), F.lit(False).alias("guest"), "doc_id", "text")
    guests = texts.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).select(
        F.col("goes").alias("range"), F.lit(True).alias("guest"), "doc_id", "text")
    # Tasks of a bounded number of rows, whatever the session's number of partitions.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), known["n"] // TASK_ROWS)
    return own.union(guests).repartition(tasks, "range")


def neighbour_likeness(docs: DataFrame, chain: int = CHAIN, rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures."""
    ordered = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    read = in_order(docs, rows).withColumn("sigs", signatures(F.col("text"), chain))
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    both = (
        read.withColumn("next_text", F.lead("text").over(ordered)).withColumn("next_sigs", F.lead("sigs").over(ordered))
        .where(~F.col("guest"))
        .select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    )
    result = let(signatures(F.col("edited"), chain), lambda e: F.struct(
        fingerprint(e).alias("edited_fingerprint"), likeness(F.col("sigs"), e).alias("near_edited")))
    return both.withColumn("compared", result).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
        "compared.edited_fingerprint", "compared.near_edited", likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"))


def length_range(size: Column, tau: float) -> Column:
    """Number of the range of set lengths; matching sets are in the same or in neighbouring ranges."""
    return F.floor(F.log(size) / F.log(F.lit(1 / tau)) + F.lit(1e-9)).cast("int")


def near_pairs(docs: DataFrame, key: Column, tau: float = TAU, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (doc_key, class) of every row, and (class, other, likeness) at ``tau`` or more.

    A class holds the texts of one fingerprint; pairs are between classes, the smaller one first.
    """
    read = docs.select(key.alias("doc_key"), signatures(F.coalesce("text", F.lit("")), chain).alias("sigs"))
    read = stage(read.withColumn("class", fingerprint(F.col("sigs"))), "spotsigs")
    sets = stage(read.where(F.size("sigs") > 0).groupBy("class").agg(F.first("sigs").alias("sigs")), "spotsigs-sets")
    terms = sets.select("class", F.size("sigs").alias("size"), F.explode("sigs").alias("sig"))
    rare = terms.groupBy("sig").agg(F.count("*").alias("df"))
    # A signature found in one set cannot bring two together; it still takes a place in the prefix.
    ranked = terms.join(rare, "sig")
    order = Window.partitionBy("class").orderBy("df", "sig")
    prefix = F.col("size") - F.ceil(F.col("size") * tau - 1e-9) + 1
    kept = (
        ranked.withColumn("place", F.row_number().over(order)).where((F.col("place") <= prefix) & (F.col("df") > 1))
        .withColumn("range", length_range(F.col("size"), tau))
    )
    left = kept.select("sig", "range", F.col("class").alias("a"), F.col("size").alias("na"), F.col("place").alias("pa"))
    right = kept.select("sig", F.explode(F.array("range", F.col("range") - 1)).alias("range"), F.col("class").alias("b"),
                        F.col("size").alias("nb"), F.col("place").alias("pb"), F.col("range").alias("rb"))
    # Shorter first; what the places leave must still reach the overlap that tau asks for.
    overlap = F.lit(tau / (1 + tau)) * (F.col("na") + F.col("nb")) - 1e-9
    met = left.join(right, ["sig", "range"]).where(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("na") >= F.col("nb") * tau - 1e-9)
        & (1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb") - 1 >= overlap))
    candidates = met.select("a", "b").distinct()
    x = sets.select(F.col("class").alias("a"), F.col("sigs").alias("sa"))
    y = sets.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    pairs = (
        candidates.join(x, "a").join(y, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
        .where(F.col("likeness") >= tau - 1e-12)
        .select(F.least("a", "b").alias("class"), F.greatest("a", "b").alias("other"), "likeness")
    )
    return read.select("doc_key", "class"), pairs


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    return neighbour_likeness(documents(spark, sf_dir))


_SIGNATURES = f"""
    CASE WHEN len(list_filter(chains, lambda x: x IS NOT NULL)) > 0 THEN list_filter(chains, lambda x: x IS NOT NULL)
         WHEN len(words) > 0 THEN list_transform(words, lambda w, i: CASE WHEN i = len(words) THEN w ELSE w || ' ' || words[i + 1] END)
         WHEN text <> '' THEN [text] ELSE [] END
"""
_READ = f"""
    SELECT *, list_sort(list_distinct({_SIGNATURES})) AS sigs FROM (
      SELECT *, list_transform(groups, lambda g, i: CASE WHEN instr(g, chr(1)) > 0 AND i < len(groups) AND string_split(groups[i + 1], chr(1))[-1] <> '' THEN
                  array_to_string(string_split(g, chr(1))[-2:], ':') || ' ' || string_split(groups[i + 1], chr(1))[-1] END) AS chains
      FROM (SELECT *, list_filter(string_split(array_to_string(list_transform(words, lambda w: w || CASE WHEN w IN
                  ({", ".join(f"'{a}'" for a in sorted(set(ANCHORS)))}) THEN chr(1) ELSE ' ' END), ''), ' '), lambda g: g <> '') AS groups
            FROM (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words FROM %s)))
"""
ORACLE = {"op5_spotsigs": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     n AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM d
           WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
     e AS (SELECT *, substring(text, 1, (length(text) - length(text) // 3)::INT) || substring(next_text, 1, (length(text) // 3)::INT) AS edited FROM n),
     a AS ({_READ % "e"}),
     b AS ({_READ % "(SELECT doc_id AS b_id, edited AS text FROM e)"}),
     c AS ({_READ % "(SELECT DISTINCT next_text AS text FROM e)"}),
     j AS (SELECT a.doc_id, a.text, a.edited, a.sigs AS s, b.sigs AS t, c.sigs AS u,
                  len(list_intersect(a.sigs, b.sigs)) AS m, len(list_intersect(a.sigs, c.sigs)) AS k
           FROM a JOIN b ON a.doc_id = b.b_id JOIN c ON a.next_text = c.text)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, md5(array_to_string(s, chr(10))) AS fingerprint,
       md5(array_to_string(t, chr(10))) AS edited_fingerprint,
       CASE WHEN len(s) + len(t) = 0 THEN 1.0::DOUBLE ELSE m::DOUBLE / (len(s) + len(t) - m) END AS near_edited,
       CASE WHEN len(s) + len(u) = 0 THEN 1.0::DOUBLE ELSE k::DOUBLE / (len(s) + len(u) - k) END AS near_next,
       len(s)::BIGINT AS n_signatures
FROM j
"""}
QUERIES = {"op5_spotsigs": op5_spotsigs}
