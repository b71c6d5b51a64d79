"""Benchmark decontamination by template canonicalisation, with DataFrame operations only.

Texts become words, letter case folded, in which numbers, units after numbers, and names are typed placeholders. A name
is a word that the benchmark never writes in lower case, so the rule does not depend on the case in a document or on
where a sentence begins: Tom, TOM and Jim are names, buys is not. Windows of five such words are hash-joined to the
windows of the benchmark items, so a question with other numbers or names still matches. A window of fewer than two
literal words says nothing as a template (a table of numbers matches every other) and is compared by its own words.

A match counts only if the values in its slots are consistent: along one alignment of item and document, one value of
the item always stands where one value of the document stands, and the other way round. Of an alignment that is not,
only the windows that equal the item word for word count. An item is leaked when at least 0.8 of its words lie in
matched windows.

The windows of a document are made and probed inside one stage; only windows that match leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.llm.common import quoted, text_of, with_row_keys, without_rows, written

WINDOW = 5
#: Literal words that a window needs to be compared as a template.
LITERAL = 2
LEAST_COVERAGE = 0.8
#: Words that the benchmark writes in lower case, at most; the commonest, then in alphabetical order. Others are names.
LEXICON = 20_000
#: Bytes of benchmark text up to which its windows are broadcast; beyond, both sides are shuffled by window hash.
BROADCAST_BYTES = 8 << 20
#: A number with inner separators, or a run of letters.
_TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*|\p{L}+"
#: Units of measure that become placeholders after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs ms day days week weeks month months year years "
    "hour hours minute minutes second seconds meter meters metre metres mile miles inch inches foot feet pound pounds "
    "gram grams kilogram kilograms liter liters litre litres percent degree degrees dollar dollars euro euros cent cents "
    "usd eur gbp kb mb gb tb hz khz mhz ghz w kw kwh v j cal kcal mph kph kmh"
).split()


def lexicon(benchmark: DataFrame) -> list[str]:
    """The words that are no names: at most LEXICON of them."""
    words = benchmark.select(F.explode(F.regexp_extract_all(text_of("text"), F.lit(_TOKEN), F.lit(0))).alias("w"))
    first = F.substring("w", 1, 1)
    lower = words.where((F.lower(first) == first) & ~first.between("0", "9")).select(_folded(F.col("w")).alias("w"))
    return [r.w for r in lower.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(LEXICON).collect()]


def _canonical(raw: Column, before: Column, known: list[str]) -> Column:
    """A token begins with a digit or a letter, and digits sort below the colon."""
    return (
        F.when(raw < ":", F.lit("<num>"))
        .when((before < ":") & raw.isin(UNITS), F.lit("<unit>"))
        .when(raw.isin(known) if known else F.lit(False), raw)
        .otherwise(F.lit("<name>"))
    )


def _folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _windows(rows: DataFrame, known: list[str]) -> DataFrame:
    """rows (..., text) without text, with n_words, pos, raws, words, plain and hash, a row per window of five words.

    A shorter text is one window, a text without words none. plain: the window is compared by its own words. The words
    of a window are cut out before the windows become rows, so no row holds a whole text.
    """
    kept = [c for c in rows.columns if c != "text"]
    raws = rows.select(*kept, F.regexp_extract_all(_folded(text_of("text")), F.lit(_TOKEN), F.lit(0)).alias("raws"))
    canonical = F.zip_with("raws", F.concat(F.array(F.lit("a")), F.slice("raws", 1, F.greatest(F.size("raws") - 1, F.lit(0)))), lambda raw, before: _canonical(raw, before, known))
    words = raws.select(*kept, "raws", F.when(F.size("raws") > 0, canonical).alias("words"))
    # the k-th words of all windows are the words from the k-th on
    of = [(f"{c[0]}{k}", F.slice(c, k + 1, F.greatest(F.size("raws"), F.lit(1)))) for c in ("raws", "words") for k in range(WINDOW)]
    out = words.select(*kept, F.size("raws").alias("n_words"), F.posexplode(F.arrays_zip(*[col.alias(name) for name, col in of])).alias("pos", "w"))
    out = out.where(F.col("pos") <= F.greatest(F.col("n_words") - WINDOW, F.lit(0)))
    literal = sum((F.coalesce(~F.col(f"w.w{k}").startswith("<"), F.lit(False)).cast("int") for k in range(WINDOW)), F.lit(0))
    plain = (literal < LITERAL) & (F.col("n_words") >= WINDOW)
    out = out.select(*kept, "n_words", "pos", "w", plain.alias("plain"))
    pick = [F.when(F.col("plain"), F.col(f"w.r{k}")).otherwise(F.col(f"w.w{k}")) for k in range(WINDOW)]
    five = lambda c: F.array(*[F.col(f"w.{c}{k}") for k in range(WINDOW)]).alias({"r": "raws", "w": "words"}[c])
    return out.select(*kept, "n_words", "pos", five("r"), five("w"), "plain", F.xxhash64("plain", *pick).alias("hash"))


def _leaks(rows: DataFrame, key: list[str], benchmark: DataFrame, least: float) -> DataFrame:
    """(key..., item_id, coverage, verbatim) for rows (key..., text); null keys are equal."""
    bench = benchmark.select("item_id", "text")
    known = lexicon(bench)
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    items = _windows(bench, known).select("item_id", F.col("pos").alias("ipos"), F.col("hash").alias("ihash"), F.col("plain").alias("iplain"), "n_words", F.col("words").alias("iwords"), F.col("raws").alias("iraws"))
    made = _windows(rows, known).select(*key, "pos", "hash", F.col("words").alias("dwords"), F.col("raws").alias("draws"))
    found = made.join(F.broadcast(items) if size <= BROADCAST_BYTES else items.hint("merge"), F.col("hash") == F.col("ihash"))
    equal = F.when(F.col("iplain"), F.col("draws") == F.col("iraws")).otherwise(F.col("dwords") == F.col("iwords"))  # nulls in arrays are equal
    # texts are read once: what matches is written, and the rest works on that
    matched = written(found.where(equal).select(*key, "item_id", "ipos", (F.col("pos") - F.col("ipos")).alias("diagonal"), "n_words", "iwords", "iraws", "draws"), "matched")
    line = [*key, "item_id", "diagonal"]
    zipped = F.arrays_zip(F.col("iwords").alias("w"), F.col("iraws").alias("i"), F.col("draws").alias("d"))
    slots = matched.select(*line, F.explode(F.filter(zipped, lambda z: F.coalesce(z["w"].startswith("<"), F.lit(False)))).alias("s")).select(*line, "s.*").distinct()
    doubled = [slots.groupBy(*line, "w", of).agg(F.count("*").alias("n")).where("n > 1").select(*line) for of in ("i", "d")]
    bad = doubled[0].unionByName(doubled[1]).distinct().select(*[F.col(c).alias("__" + c) for c in line], F.lit(True).alias("bad"))
    on = [matched[c].eqNullSafe(bad["__" + c]) for c in line]
    same = F.col("iraws") == F.col("draws")
    kept = matched.join(bad, _all(on), "left").where(same | F.col("bad").isNull())
    # a word is covered by the windows that begin on it or up to four words before
    covers = F.sequence(F.col("ipos"), F.least(F.col("ipos") + WINDOW, "n_words") - 1)
    words = kept.select(*key, "item_id", "n_words", same.alias("same"), F.explode(covers).alias("word"))
    words = words.groupBy(*key, "item_id", "word").agg(F.max("n_words").alias("n_words"), F.min("same").alias("same"))
    whole = words.groupBy(*key, "item_id").agg(F.max("n_words").alias("n_words"), F.count("*").alias("covered"), F.min("same").alias("verbatim"))
    return whole.withColumn("coverage", F.col("covered") / F.col("n_words")).where(F.col("coverage") >= least).select(*key, "item_id", "coverage", "verbatim")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_COVERAGE, text_col: str = "text", any_case: bool = True) -> DataFrame:
    """(doc_id, item_id, coverage, verbatim) of the items that a document holds.

    verbatim: all that counts equals the item word for word, letter case aside. An item that a document holds twice
    with different values counts if either alignment is consistent. Null and empty texts hold nothing and are held by
    nothing. Items of fewer than five words are held only by documents that have just those words. Rows with the same
    doc_id are one document, rows with the same item_id one item. Letter case never matters; any_case is kept for callers.
    """
    return _leaks(docs.select("doc_id", F.col(quoted(text_col)).alias("text")), ["doc_id"], benchmark, least)


def decontamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_COVERAGE, text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, contaminated, n_items, item_ids (ascending, comma-joined), coverage (the largest).

    See leaks for what counts. Clean documents have n_items 0, an empty item_ids and a coverage of 0. Either table may
    be empty; other columns are not read.
    """
    held = leaks(docs, benchmark, least, text_col).groupBy(F.col("doc_id").alias("__id")).agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("items"), F.max("coverage").alias("top")
    )
    ids = docs.select("doc_id")
    out = ids.join(held, ids["doc_id"].eqNullSafe(held["__id"]), "left")
    return out.select("doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("item_ids"), F.round(F.coalesce("top", F.lit(0.0)), 6).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item. Columns as in docs; each row is judged by its own text."""
    keyed, file, place = with_row_keys(docs)
    rows = keyed.select(F.col(file).alias("f"), F.col(place).alias("p"), F.col(quoted(text_col)).alias("text"))
    held = _leaks(rows, ["f", "p"], benchmark, LEAST_COVERAGE)
    return without_rows(keyed, file, place, held.select(F.col("f").alias(file), F.col("p").alias(place)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP1_SQL = (
    r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, replace(lower(coalesce(text, '')), 'ß', 'ss') AS text FROM documents
  UNION ALL SELECT 'b', item_id, replace(lower(coalesce(text, '')), 'ß', 'ss') FROM benchmark
), lexicon AS (
  SELECT list(w) AS known FROM (
    SELECT replace(lower(w), 'ß', 'ss') AS w, count(*) AS n
    FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,:/][0-9]+)*|\p{L}+')) AS w FROM benchmark)
    WHERE lower(left(w, 1)) = left(w, 1) AND NOT regexp_matches(w, '^[0-9]') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20000)
), raws AS (
  SELECT side, id, regexp_extract_all(text, '[0-9]+(?:[.,:/][0-9]+)*|\p{L}+') AS raws FROM texts
), words AS (
  SELECT side, id, raws, list_transform(range(1, len(raws) + 1), lambda i: CASE
    WHEN regexp_matches(raws[i], '^[0-9]') THEN '<num>'
    WHEN i > 1 AND regexp_matches(raws[i - 1], '^[0-9]') AND list_contains([UNITS], raws[i]) THEN '<unit>'
    WHEN list_contains(known, raws[i]) THEN raws[i]
    ELSE '<name>' END) AS words
  FROM raws, lexicon WHERE len(raws) > 0
), windows AS (
  SELECT *, n >= 5 AND len(list_filter(w, lambda x: NOT starts_with(x, '<'))) < 2 AS plain FROM (
    SELECT side, id, len(raws) AS n, pos, words[pos + 1 : pos + 5] AS w, raws[pos + 1 : pos + 5] AS r
    FROM (SELECT *, unnest(range(0, greatest(len(raws) - 5, 0) + 1)) AS pos FROM words))
), matched AS (
  SELECT d.id AS doc_id, b.id AS item_id, b.pos AS ipos, d.pos - b.pos AS diagonal, b.n AS n_words, b.w AS w, b.r AS ir, d.r AS dr, b.r = d.r AS same
  FROM windows d JOIN windows b ON d.side = 'd' AND b.side = 'b' AND d.plain = b.plain
   AND CASE WHEN d.plain THEN d.r ELSE d.w END = CASE WHEN b.plain THEN b.r ELSE b.w END
), slots AS (
  SELECT doc_id, item_id, diagonal, w[k] AS kind, ir[k] AS iv, dr[k] AS dv
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM matched) WHERE w[k] LIKE '<%'
), bad AS (
  SELECT doc_id, item_id, diagonal FROM slots GROUP BY doc_id, item_id, diagonal, kind, iv HAVING count(DISTINCT dv) > 1
  UNION SELECT doc_id, item_id, diagonal FROM slots GROUP BY doc_id, item_id, diagonal, kind, dv HAVING count(DISTINCT iv) > 1
), kept AS (
  SELECT doc_id, item_id, ipos, n_words FROM matched WHERE same
  UNION SELECT doc_id, item_id, ipos, n_words FROM matched ANTI JOIN bad USING (doc_id, item_id, diagonal)
), covered AS (
  SELECT doc_id, item_id, n_words, count(DISTINCT p) AS n
  FROM (SELECT doc_id, item_id, n_words, unnest(range(ipos, least(ipos + 5, n_words))) AS p FROM kept)
  GROUP BY doc_id, item_id, n_words
), held AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(n / n_words) AS top
  FROM covered WHERE n / n_words >= 0.8 GROUP BY doc_id
)
SELECT documents.doc_id, held.n IS NOT NULL AS contaminated, coalesce(held.n, 0) AS n_items, coalesce(items, '') AS item_ids,
       round(coalesce(top, 0.0), 6) AS coverage
FROM documents LEFT JOIN held ON documents.doc_id = held.doc_id
"""
).replace("UNITS", ", ".join(f"'{u}'" for u in UNITS))
