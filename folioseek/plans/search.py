"""Ranked, filtered and ordered searches over a saved index.

A search first finds its top hits from postings alone and then fetches just
those documents. What reaches the driver on the way is the query's words, the
index terms near them, and the hits of a search for up to COLLECTED_HITS, which
runs when it is called. More hits are joined, and the result is lazy. A table of
queries is handled by joins throughout.
"""

from collections import Counter
from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from folioseek.functions import listed, strings
from folioseek.functions.display import MAX_HIGHLIGHTS, highlights, summary_lines
from folioseek.functions.edits import check_fuzziness
from folioseek.functions.ranking import by_field, rarity
from folioseek.functions.text import placed_terms
from folioseek.operators.clauses import match_clauses, match_phrase
from folioseek.operators.bounds import heaviest_files, reaching_files
from folioseek.operators.filters import Filters, after_hit, keep_if, ordering, top, window_of
from folioseek.operators.matching import (
    LITERAL_WORDS,
    best_expansions,
    boosts,
    near_literals,
    near_words,
    query_words,
    with_buckets,
    with_hash,
    words_of_each,
)
from folioseek.operators.postings import FILE_COLUMNS
from folioseek.operators.ranks import with_places
from folioseek.operators.scoring import (
    PLACED,
    VERSION,
    matched_documents,
    score_documents,
    score_postings,
    without_superseded,
)
from folioseek.operators.trends import changing_terms, frequent_terms
from folioseek.plans.store import DocumentIndex, local_table
from folioseek.schema import (
    DEFAULT_SIZE,
    DOCUMENTS_TABLE,
    HIT_COLUMNS,
    POSTINGS_SCHEMA,
    TEXT_FIELDS,
)

# Hits whose places the driver holds, so that only their files are opened; more are joined.
COLLECTED_HITS = 1000

# Files that hold a query's heaviest postings are read first if there are so many times more.
FEW_FILES = 3

# Equality tests per pushed filter: the reader keeps short lists exact. Longer
# lists than the second number are pushed as the range of their values.
PUSHED_VALUES, PUSHED_LISTS = 10, 1000

_TERMS = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("boost", T.DoubleType()),
    ]
)
_PLACES = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("_place", T.IntegerType()),
    ]
)


# Searches


def search_documents(
    index: DocumentIndex,
    query_text: str,
    size: int | None = DEFAULT_SIZE,
    *,
    fuzziness: str | int = "AUTO",
    page: int | None = None,
    page_size: int | None = None,
    after: tuple[float, str] | None = None,
    max_highlights: int | None = MAX_HIGHLIGHTS,
    max_expansions: int | None = None,
) -> DataFrame:
    """Documents whose content or name matches any word, best first.

    Every hit has a list of highlights, empty if only the name matched. A query
    without words, or a missing index, gives no rows. `max_expansions` keeps only
    the nearest index terms of each word and field. `after` is the (score, path) of
    a hit: those that follow it are returned, however deep, without the ones before.
    """
    offset, count = window_of(size, page, page_size)
    terms = query_terms(index, query_text, fuzziness, max_expansions)
    best = count and offset + count if after is None else None
    scored = _scored(index, terms, Filters(), best)
    if after is not None:
        scored = scored.filter(after_hit("score", "desc", after))
    order = ordering("score", "desc")
    return _hits(index, scored, order, offset, count, terms, max_highlights)


def advanced_search(
    index: DocumentIndex,
    query_text: str | None = None,
    file_type: str | None = None,
    min_size: int | None = None,
    max_size: int | None = None,
    sort_by: str = "score",
    sort_order: str = "desc",
    size: int | None = DEFAULT_SIZE,
    *,
    modified_from: datetime | str | None = None,
    modified_to: datetime | str | None = None,
    created_from: datetime | str | None = None,
    created_to: datetime | str | None = None,
    metadata: Mapping[str, str] | None = None,
    fuzziness: str | int = "AUTO",
    page: int | None = None,
    page_size: int | None = None,
    after: tuple | None = None,
    max_highlights: int | None = MAX_HIGHLIGHTS,
    max_expansions: int | None = None,
) -> DataFrame:
    """Documents by optional text and filters, in a chosen order.

    The score is null unless it orders the result. Without text it is 0.0 under
    filters and 1.0 without any; highlights are null where there are none. `after`
    is the sort value and path of a hit that the returned ones follow.
    """
    offset, count = window_of(size, page, page_size)
    order = ordering(sort_by, sort_order)
    filters = Filters(
        file_type,
        min_size,
        max_size,
        modified_from,
        modified_to,
        created_from,
        created_to,
        metadata or {},
    )
    by_score = sort_by == "score"
    terms: list[Row] | None = None
    if query_text:
        terms = query_terms(index, query_text, fuzziness, max_expansions)
        if by_score:
            top_first = sort_order == "desc" and after is None
            best = count and offset + count if top_first else None
            found = _scored(index, terms, filters, best)
        else:
            carry = (sort_by,) if sort_by in FILE_COLUMNS else ()
            matched = _postings_of(index, terms, filters)
            found = _current(index, matched_documents(matched, carry), filters)
    else:
        found = keep_if(index.documents(), filters.on_file() + filters.on_metadata())
        found = found.select(
            *PLACED, "file_name", "file_type", "file_size", "created_at", "modified_at"
        ).withColumn("score", F.lit(0.0 if filters else 1.0))
    if after is not None:
        found = found.filter(after_hit(sort_by, sort_order, after))
    if not by_score:
        found = found.withColumn("score", F.lit(None).cast("double"))
    hits = _hits(index, found, order, offset, count, terms, max_highlights)
    return hits.withColumn("highlights", F.expr("nullif(highlights, array())"))


def bool_search(
    index: DocumentIndex,
    must: Iterable[str] = (),
    should: Iterable[str] = (),
    must_not: Iterable[str] = (),
    size: int | None = DEFAULT_SIZE,
    *,
    field: str = "content",
    max_highlights: int | None = MAX_HIGHLIGHTS,
) -> DataFrame:
    """Documents by required, optional and excluded words, matched exactly.

    Optional words only add to the score if there are required ones; otherwise
    one of them is needed. The score sums BM25 over the words present.
    """
    spark = index.spark
    clauses_of = [list(must), list(should), list(must_not)]
    each = iter(words_of_each(spark, sum(clauses_of, []), index.analyzer))
    groups = [sorted({w for _ in texts for w in next(each)}) for texts in clauses_of]
    wanted = set(groups[0] + groups[1])
    clauses = _exact_terms(index, sorted(wanted | set(groups[2])), field)
    terms = [row for row in clauses if row["term"] in wanted]
    matched = _postings_of(index, clauses, Filters())
    scored = without_superseded(
        match_clauses(matched, *groups, index.per_field("avgdl")[field]), index.superseded()
    )
    order = ordering("score", "desc")
    return _hits(index, scored, order, 0, size, terms, max_highlights)


def phrase_search(
    index: DocumentIndex,
    phrase: str,
    field: str = "content",
    size: int | None = DEFAULT_SIZE,
    *,
    max_highlights: int | None = MAX_HIGHLIGHTS,
) -> DataFrame:
    """Documents with the words of a phrase side by side, in order.

    BM25 with phrase occurrences as the frequency and the sum of the words' idf.
    """
    placed = query_words(index.spark, phrase, index.analyzer)
    words = [item["term"] for item in placed]
    terms = _exact_terms(index, words, field)
    weights = {item["term"]: item["boost"] for item in terms}
    if not words or set(words) - set(weights):
        return _no_hits(index)
    scored = match_phrase(
        _postings_of(index, terms, Filters()),
        words,
        [item["pos"] for item in placed],
        sum(weights[word] for word in words),
        index.per_field("avgdl")[field],
    )
    scored = without_superseded(scored, index.superseded())
    order = ordering("score", "desc")
    return _hits(index, scored, order, 0, size, terms, max_highlights)


def search_many(
    index: DocumentIndex,
    queries: DataFrame,
    size: int | None = DEFAULT_SIZE,
    *,
    fuzziness: str | int = "AUTO",
    max_highlights: int | None = MAX_HIGHLIGHTS,
    max_expansions: int | None = None,
) -> DataFrame:
    """`search_documents` for a table of (query_id, query_text), all at once.

    Words meet the vocabulary, and terms the postings, in equi-joins, and each
    query's top is cut in every task before the shuffle; without a size, hits are
    dealt out by ranges of query and score to be ranked. Queries of the same words
    are scored once. How a join is done is left to adaptive execution; no hits or
    terms reach the driver, only the words if they are few.
    """
    check_fuzziness(fuzziness)
    placed = F.expr(f"explode({placed_terms('query_text', index.analyzer)})").alias("placed")
    words = (
        queries.select(F.col("query_id").alias("asked_as"), placed)
        .groupBy("asked_as")
        .agg(F.array_sort(F.collect_list("placed.term")).alias("bag"))
    )
    # One query stands for all of its words.
    named = words.groupBy("bag").agg(F.min("asked_as").alias("query_id"))
    members = words.join(named, "bag").select("asked_as", "query_id")
    asked = (
        named.select("query_id", F.explode("bag").alias("token"))
        .groupBy("query_id", "token")
        .agg(F.count(F.lit(1)).alias("repeats"))
    )
    tokens = asked.select("token").distinct()
    # A few words are sought as literals, which spares the keys of the vocabulary.
    few = tokens.limit(LITERAL_WORDS + 1).collect()
    if len(few) <= LITERAL_WORDS:
        near = near_literals(_vocabulary(index), [row["token"] for row in few], fuzziness)
    else:
        near = near_words(_vocabulary(index), tokens, fuzziness, index.saved_term_keys())
    merged = len(index.batches) == 1
    expansions = best_expansions(near, index.per_field("n"), merged, max_expansions)
    terms = boosts(asked.join(expansions, "token"), ("query_id",))
    buckets_of = index.buckets_of or {0: 1}
    counts = set(buckets_of.values())
    sought, postings = with_buckets(terms, counts), index.posting_versions()
    if len(few) <= LITERAL_WORDS:
        # The terms near a few words are few as well: postings stay where they are.
        sought = F.broadcast(sought)
    keys = ["term_bucket", "field", "term"]
    if len(counts) > 1:
        # Batches differ in their number of buckets; a term is sought in its bucket of each.
        pairs = F.create_map(*[F.lit(x) for pair in buckets_of.items() for x in pair])
        postings = postings.withColumn("buckets", pairs[F.col("batch_id")])
        keys.append("buckets")
    matched = postings.join(sought, keys)
    scored = score_documents(matched, index.per_field("avgdl"), ("query_id",))
    scored = without_superseded(scored, index.superseded())
    order = ordering("score", "desc")
    if size is None:
        kept = with_places(scored, ["query_id"], order, index.saved_work)
    else:
        best = Window.partitionBy("query_id").orderBy(*order)
        kept = scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= size)
    documents = index.document_versions().select("batch_id", *HIT_COLUMNS)
    # The terms of one query: as many as its words have near ones.
    shown = (
        terms.filter(F.col("field") == "content")
        .groupBy("query_id")
        .agg(F.collect_set("term").alias("_terms"))
    )
    holding = F.expr(
        highlights(
            "content", lambda word: f"array_contains(_terms, {word})", max_highlights, index.analyzer
        )
    )
    return (
        documents.join(kept, list(VERSION))
        .join(shown, "query_id", "left")
        .join(members, "query_id")
        .select(
            F.col("asked_as").alias("query_id"),
            F.col("place").cast("int").alias("place"),
            *HIT_COLUMNS,
            "score",
            F.when(F.col("_terms").isNotNull(), holding)
            .otherwise(F.array().cast("array<string>"))
            .alias("highlights"),
        )
    )


def term_trends(index: DocumentIndex, by: str = "file_type", top: int = 20) -> DataFrame:
    """Most widespread content terms per value of a file column."""
    content = index.postings().filter(F.col("field") == "content")
    return frequent_terms(content, by, top)


def term_changes_over_time(
    index: DocumentIndex, period: str = "week", top: int = 20
) -> DataFrame:
    """Content terms whose spread changed most against the period before."""
    content = index.postings().filter(F.col("field") == "content")
    return changing_terms(content, period, top)


def summarize_hits(hits: DataFrame) -> DataFrame:
    """Hits with the short highlight lines that are shown to people."""
    return hits.withColumn("summary", F.expr(summary_lines("highlights")))


# Terms


def query_terms(
    index: DocumentIndex,
    query_text: str,
    fuzziness: str | int = "AUTO",
    max_expansions: int | None = None,
) -> list[Row]:
    """Weighted index terms of a query: all that its words may mean."""
    check_fuzziness(fuzziness)
    spark = index.spark
    if not index.exists:
        return []
    words = [word["term"] for word in query_words(spark, query_text, index.analyzer)]
    if not words:
        return []
    if len(set(words)) <= LITERAL_WORDS:
        near = near_literals(_vocabulary(index), words, fuzziness)
    else:
        each = f"explode({strings(sorted(set(words)))})"
        tokens = spark.range(1).select(F.expr(each).alias("token"))
        near = near_words(_vocabulary(index), tokens, fuzziness, index.saved_term_keys())
    merged = len(index.batches) == 1
    weighted = best_expansions(near, index.per_field("n"), merged, max_expansions)
    return _summed(with_hash(weighted).collect(), Counter(words))


def _vocabulary(index: DocumentIndex) -> DataFrame:
    return index.term_changes().drop("cf", "docs")


def _summed(expansions: list[Row], repeats: Counter) -> list[Row]:
    """One weight per field and term, over the query words that lead to it."""
    found: dict[tuple, float] = {}
    for row in sorted(expansions):
        key = row["field"], row["term"], row["term_hash"]
        earned = repeats[row["token"]] * row["weight"] * row["idf"]
        found[key] = found.get(key, 0.0) + earned
    return [
        Row(field=field, term=term, term_hash=number, boost=boost)
        for (field, term, number), boost in found.items()
    ]


def _exact_terms(index: DocumentIndex, words: list[str], field: str) -> list[Row]:
    """Weights of given index terms in one field, unknown ones left out."""
    if field not in TEXT_FIELDS:
        raise ValueError(f"unknown text field {field!r}; known: {TEXT_FIELDS}")
    if not words or not index.exists:
        return []
    lengths = sorted({len(word) for word in words})
    found = index.term_changes().filter(
        (F.col("field") == field)
        & F.col("term_len").isin(lengths)
        & _one_of("term", sorted(set(words)))
    )
    counted = found.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    idf = rarity(by_field(index.per_field("n")), "df")
    terms = counted.selectExpr("field", "term", f"{idf} AS boost")
    return with_hash(terms).collect()


# Documents


def _postings_of(
    index: DocumentIndex, terms: list[Row], filters: Filters, places: list[Row] | None = None
) -> DataFrame:
    """Postings of known terms with their boost; file filters reach the reader.

    Only files whose span holds one of the terms are opened. The terms are a
    relation whose size Spark knows and joins by.
    """
    spark = index.spark
    asked = local_table(spark, terms, _TERMS)
    if not terms:
        return local_table(spark, [], POSTINGS_SCHEMA).join(asked, ["field", "term"])
    if places is None:
        places = _places_of(index, terms)
    postings = index.posting_versions(places).filter(
        _one_of("term", sorted({row["term"] for row in terms}))
    )
    return keep_if(postings, filters.on_file()).join(asked, ["field", "term"])


def _places_of(index: DocumentIndex, terms: list[Row]) -> list[Row]:
    return index.posting_places({row["term"]: row["term_hash"] for row in terms})


def _scored(
    index: DocumentIndex, terms: list[Row], filters: Filters, best: int | None = None
) -> DataFrame:
    """Scores count over the whole corpus; filters only leave documents out.

    With `best`, at least that many of the best documents are among the rows with
    their scores; files that cannot hold one of them stay closed.
    """
    score = score_postings if len(terms) == 1 else score_documents
    averages = index.per_field("avgdl")

    def scored(places: list[Row] | None) -> DataFrame:
        matched = _postings_of(index, terms, filters, places)
        return _current(index, score(matched, averages), filters)

    if best is None or not terms:
        return scored(None)
    places = _places_of(index, terms)
    wanted, all_files = best, {*map(_file_of, places)}
    while True:
        first = heaviest_files(places, terms, averages, wanted)
        if len({*map(_file_of, first)}) * FEW_FILES >= len(all_files):
            return scored(places)
        # One row: the score of the last hit if there were no other files.
        found = scored(first).orderBy(F.desc("score")).limit(best).agg(
            F.count(F.lit(1)).alias("hits"), F.min("score").alias("least")
        ).first()
        if found["hits"] == best:
            return scored(reaching_files(places, terms, averages, found["least"]))
        # Filters and replaced versions left too few of them.
        wanted *= 4


def _file_of(place: Row) -> tuple:
    return place["batch_id"], place["term_bucket"], place["file"]


def _current(index: DocumentIndex, rows: DataFrame, filters: Filters) -> DataFrame:
    rows = without_superseded(rows, index.superseded())
    if filters.metadata:
        fitting = keep_if(index.document_versions(), filters.on_metadata())
        rows = rows.join(fitting.select(*VERSION), list(VERSION), "left_semi")
    return rows


def _hits(
    index: DocumentIndex,
    found: DataFrame,
    order: list[Column],
    offset: int,
    count: int | None,
    terms: list[Row] | None,
    max_highlights: int | None,
) -> DataFrame:
    """Cut the result and fetch its documents, in order."""
    if not index.exists or count == 0:
        return _no_hits(index)
    if count is not None and count <= COLLECTED_HITS:
        best = top(found, order, offset, count).select(*PLACED, "score").collect()
        if not best:
            return _no_hits(index)
        places = [row.asDict() | {"_place": n} for n, row in enumerate(best)]
        cut = local_table(index.spark, places, _PLACES)
        hits = _at_places(index, best).join(cut, list(VERSION)).orderBy("_place")
    else:
        documents = index.document_versions().select("batch_id", *HIT_COLUMNS)
        cut = top(found, order, offset, count).select(*VERSION, "score")
        hits = documents.join(cut, list(VERSION)).orderBy(*order)
    return hits.select(
        *HIT_COLUMNS, "score", _marked(index, terms, max_highlights).alias("highlights")
    )


def _at_places(index: DocumentIndex, hits: list[Row]) -> DataFrame:
    """Documents of the hits: only their files are opened, and only their pages read."""
    places = {(row["batch_id"], row["file_part"]) for row in hits}
    documents = index.document_versions(places=places).select("batch_id", *HIT_COLUMNS)
    return documents.filter(_one_of("file_path", sorted({row["file_path"] for row in hits})))


def _marked(index: DocumentIndex, terms: list[Row] | None, most: int | None) -> Column:
    found = sorted({row["term"] for row in terms or [] if row["field"] == "content"})
    if not found:
        return F.array().cast("array<string>")
    # A list of literals becomes a hash set, however many terms are near the words.
    known = listed(found)
    return F.expr(
        highlights("content", lambda word: f"{word} IN ({known})", most, index.analyzer)
    )


def _no_hits(index: DocumentIndex) -> DataFrame:
    empty = local_table(index.spark, [], DOCUMENTS_TABLE)
    return empty.select(
        *HIT_COLUMNS,
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("array<string>").alias("highlights"),
    )


def _one_of(name: str, values: list[str]) -> Column:
    """Membership in a list, said twice if it is long.

    The whole list is a hash lookup that settles nearly every row; the same
    values in short lists are what the Parquet reader can skip pages by.
    """
    if not values:
        return F.lit(False)
    if len(values) > PUSHED_LISTS:
        bounds = f"{name} BETWEEN {listed([min(values)])} AND {listed([max(values)])}"
        return F.expr(f"{name} IN ({listed(values)}) AND {bounds}")
    lists = [values[at : at + PUSHED_VALUES] for at in range(0, len(values), PUSHED_VALUES)]
    short = " OR ".join(f"{name} IN ({listed(part)})" for part in lists)
    return F.expr(f"{name} IN ({listed(values)}) AND ({short})" if len(lists) > 1 else short)
