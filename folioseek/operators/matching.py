"""From query words to weighted index terms."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from folioseek.functions import quoted
from folioseek.functions.edits import (
    allowed_edits,
    allowed_edits_of,
    edits_between,
    near_literal,
    saved_keys,
    sought_keys,
)
from folioseek.functions.ranking import by_field, rarity
from folioseek.functions.text import placed_terms
from folioseek.operators.postings import term_bucket, term_hash

# Query words up to this number are compared as literals in one vocabulary scan.
LITERAL_WORDS = 32

# Folders of saved deletion keys; each holds as many files as its keys need.
KEY_BUCKETS = 64


def query_words(spark: SparkSession, text: str, analyzer: str = "standard") -> list[Row]:
    """Index terms of a query the driver holds, in order: (term, pos)."""
    given = spark.range(1).select(F.lit(text).alias("text"))
    return given.select(F.expr(placed_terms("text", analyzer))).first()[0]


def words_of_each(
    spark: SparkSession, texts: list[str], analyzer: str = "standard"
) -> list[list[str]]:
    """Index terms of each of some texts, in one job."""
    if not texts:
        return []
    rows = [(n, text) for n, text in enumerate(texts)]
    given = spark.createDataFrame(rows, "n int, text string")
    found = given.select("n", F.expr(placed_terms("text", analyzer)).alias("placed")).collect()
    return [[item["term"] for item in row["placed"] or []] for row in sorted(found)]


def near_literals(
    vocabulary: DataFrame, found: list[str], fuzziness: str | int = "AUTO"
) -> DataFrame:
    """Vocabulary terms near each of a few known words: token, term, edits.

    One scan whose length bounds reach the Parquet reader; no join. A word's
    exact test runs only on terms that a plain edit distance leaves in reach.
    """
    if not found:
        empty = vocabulary.filter("false")
        return empty.selectExpr("*", "'' AS token", "0 AS edits")
    reach, options = [], []
    for word in sorted(set(found)):
        most = allowed_edits_of(word, fuzziness)
        bounds = f"term_len BETWEEN {len(word) - most} AND {len(word) + most}"
        reach.append(bounds if most else f"({bounds} AND term = {quoted(word)})")
        options.append(near_literal(word, "term", "term_len", most))
    near = f"explode(array_compact(array({', '.join(options)})))"
    return (
        vocabulary.filter(" OR ".join(reach))
        .select("*", F.expr(near).alias("near"))
        .select(*vocabulary.columns, "near.token", "near.edits")
        .filter("edits IS NOT NULL")
    )


def key_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def term_keys(terms: DataFrame) -> DataFrame:
    """The deletion keys of distinct terms (`term`), with the buckets they are saved in."""
    keys = terms.select("term", F.expr(f"explode({saved_keys('term')})").alias("key"))
    return keys.withColumn("key_bucket", key_bucket(F.col("key")))


def near_words(
    vocabulary: DataFrame,
    tokens: DataFrame,
    fuzziness: str | int = "AUTO",
    keys: DataFrame | None = None,
) -> DataFrame:
    """As `near_literals` for a table of distinct words (`token`).

    Words and terms meet in an equi-join on shared deletion keys, so only likely
    pairs are formed; the exact test follows and each pair is kept once. `keys` are
    the saved `term_keys` of the vocabulary, and are made here if not given.
    """
    columns = vocabulary.columns
    if fuzziness == 0:
        same = F.col("term") == F.col("token")
        return vocabulary.join(tokens, same).select(*columns, "token", F.lit(0).alias("edits"))
    if keys is None:
        # One row: the lengths worth making keys for.
        span = tokens.agg(F.min(F.char_length("token")), F.max(F.char_length("token"))).first()
        near = F.col("term_len").between((span[0] or 0) - 2, (span[1] or 0) + 2)
        keys = term_keys(vocabulary.filter(near).select("term").distinct())
    wanted = tokens.select("token", F.expr(allowed_edits("token", fuzziness)).alias("most"))
    sought = wanted.select(
        "*", F.expr(f"explode({sought_keys('token', 'most')})").alias("key")
    ).withColumn("key_bucket", key_bucket(F.col("key")))
    # Catalyst sizes exploded words by their files and would broadcast either side.
    pairs = (
        keys.join(sought.hint("merge"), ["key_bucket", "key"])
        .filter("abs(char_length(term) - char_length(token)) <= most")
        .select("token", "term", "most")
        .distinct()
        .select("token", "term", F.expr(edits_between("token", "term", "most")).alias("edits"))
        .filter("edits IS NOT NULL")
    )
    return vocabulary.join(pairs, "term").select(*columns, "token", "edits")


def best_expansions(
    near: DataFrame,
    counts: Mapping[str, float],
    merged: bool = False,
    most: int | None = None,
) -> DataFrame:
    """Weight the near terms, share one df per word and field.

    In: field, term, token, edits, df (signed per batch, or already `merged`).
    Out: field, token, term, weight, idf. `counts` gives the documents per
    field. With `most`, only the best terms of each word and field are kept; that
    limit is applied in each task before the shuffle.
    """
    current = near
    if not merged:
        current = near.groupBy("field", "token", "term", "edits").agg(
            F.expr("sum(df)").alias("df")
        )
    weight = "1 - edits / least(char_length(token), char_length(term))"
    place = "row_number() OVER (PARTITION BY field, token ORDER BY weight DESC, term)"
    shared = "max(df) OVER (PARTITION BY field, token)"
    weighted = current.selectExpr(
        "field", "token", "term", "df", f"{weight} AS weight"
    ).filter("df > 0 AND weight > 0")
    if most is not None:
        weighted = weighted.selectExpr("*", f"{place} AS place").filter(f"place <= {most}")
    return weighted.selectExpr(
        "field", "token", "term", "weight", f"{rarity(by_field(counts), shared)} AS idf"
    )


def boosts(expansions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weight of each index term for a query; `repeats` counts a repeated word."""
    return expansions.groupBy(*keys, "field", "term").agg(
        F.expr("sum(repeats * weight * idf)").alias("boost")
    )


def with_hash(terms: DataFrame) -> DataFrame:
    """The hash that a term's bucket is made of."""
    return terms.withColumn("term_hash", term_hash(F.col("term")))


def with_buckets(terms: DataFrame, counts: set[int]) -> DataFrame:
    """A row for each number of buckets that batches have, with the term's bucket."""
    if len(counts) == 1:
        return terms.withColumn("term_bucket", term_bucket(F.col("term"), min(counts)))
    each = F.explode(F.array(*[F.lit(count) for count in sorted(counts)]))
    rows = terms.withColumn("buckets", each)
    return rows.withColumn("term_bucket", term_bucket(F.col("term"), F.col("buckets")))
