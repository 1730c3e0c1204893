"""DuckDB statements that say, over the raw tables, what each query must return.

They share no code with the library: text is cut into words, counted and scored
from scratch in plain SQL. The patterns and tables marked as fixed values are
the same, as the contract gives them.
"""

from __future__ import annotations

# The word pattern and its complement, as the contract states them.
WORD = r"[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*"
PIECE = WORD + r"|[^\p{L}\p{M}\p{N}_]+"
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"

# DuckDB's edit distances count bytes. These letters of the test corpus are
# mapped, one for one, to characters that no word holds.
TWO_BYTE, ONE_BYTE = "ßäçèéêíñóöü", "!#$%&*+-/:;"

# Fixed values of Portuguese analysis.
FOLD = ("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
STOPS = (
    "a ao aos as ate com como da das de dele dela deles delas depois do dos e ela elas ele "
    "eles em entre era essa essas esse esses esta estas este estes eu foi foram ha isso isto "
    "ja lhe lhes mais mas me mesmo meu meus minha minhas muito na nao nas nem no nos nossa "
    "nosso num numa o os ou para pela pelas pelo pelos por qual quando que quem se sem ser "
    "seu seus so sua suas tambem te tem teu teus tua tuas um uma voce voces"
).split()
ENDINGS = (
    ("amente", "o", 3), ("mente", "", 4), ("coes", "cao", 2), ("oes", "ao", 2),
    ("aes", "ao", 2), ("ais", "al", 2), ("eis", "el", 2), ("ois", "ol", 2),
    ("ns", "m", 2), ("res", "r", 3), ("s", "", 3),
)

DOCS = """docs AS (
  SELECT concat('/', source, '/doc_', doc_id, '.', lang) AS file_path,
         concat('doc_', doc_id, '.', lang) AS file_name, lang AS file_type,
         text AS content, CAST(strlen(text) AS BIGINT) AS file_size,
         TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS modified_at
  FROM documents)"""

UPDATED = f"""{DOCS.replace("docs AS", "first_scan AS")},
docs AS (
  SELECT file_path, file_name, file_type, modified_at,
         CASE WHEN file_type = 'en' THEN concat(content, chr(10), 'Revised edition.')
              ELSE content END AS content,
         file_size + CASE WHEN file_type = 'en' THEN 17 ELSE 0 END AS file_size,
         CASE WHEN file_type = 'en' THEN 2 ELSE 1 END AS batch_id
  FROM first_scan)"""


def _fold(x: str) -> str:
    return f"translate({x}, '{FOLD[0]}', '{FOLD[1]}')"


def _stem(x: str) -> str:
    cases = " ".join(
        f"WHEN ends_with({x}, '{ending}') AND length({x}) >= {before + len(ending)} "
        f"THEN concat(left({x}, length({x}) - {len(ending)}), '{new}')"
        for ending, new, before in ENDINGS
    )
    return f"CASE {cases} ELSE {x} END"


def _terms(source: str, analyzer: str) -> str:
    if analyzer == "standard":
        return f"SELECT * FROM {source}"
    stops = ", ".join(f"'{word}'" for word in STOPS)
    return (
        f"SELECT * EXCLUDE (term, folded), {_stem('folded')} AS term FROM "
        f"(SELECT *, {_fold('term')} AS folded FROM {source}) WHERE folded NOT IN ({stops})"
    )


def corpus(docs: str = DOCS, analyzer: str = "standard") -> str:
    """CTEs from documents to postings and statistics."""
    return f"""{docs},
texts AS (
  SELECT file_path, 'content' AS field, content AS text FROM docs
  UNION ALL SELECT file_path, 'file_name', file_name FROM docs),
word_lists AS (
  SELECT file_path, field, regexp_extract_all(lower(text), '{WORD}') AS words FROM texts),
words AS (
  SELECT file_path, field, unnest(words) AS term,
         unnest(range(len(words))) AS pos FROM word_lists),
tokens AS ({_terms("words", analyzer)}),
lengths AS (SELECT file_path, field, count(*) AS dl FROM tokens GROUP BY ALL),
postings AS (
  SELECT field, term, file_path, count(*) AS tf, list(pos ORDER BY pos) AS positions
  FROM tokens GROUP BY field, term, file_path),
stats AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM lengths GROUP BY field),
dfs AS (SELECT field, term, count(*) AS df, sum(tf) AS cf FROM postings GROUP BY field, term)"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ascii(x: str) -> str:
    return f"translate({x}, '{TWO_BYTE}', '{ONE_BYTE}')"


def matching(
    queries: str,
    fuzziness: str | int = "AUTO",
    analyzer: str = "standard",
    most: int | None = None,
) -> str:
    """CTEs from a relation (query_id, query_text) to scored documents."""
    limit = (
        ""
        if most is None
        else "QUALIFY row_number() OVER "
        f"(PARTITION BY field, token ORDER BY weight DESC, term) <= {most}"
    )
    allowed = (
        "CASE WHEN length(token) < 3 THEN 0 WHEN length(token) < 6 THEN 1 ELSE 2 END"
        if fuzziness == "AUTO"
        else str(fuzziness)
    )
    return f"""asked AS ({queries}),
query_words AS (
  SELECT query_id, unnest(regexp_extract_all(lower(query_text), '{WORD}')) AS term FROM asked),
query_terms AS (
  SELECT query_id, term AS token, count(*) AS repeats
  FROM ({_terms("query_words", analyzer)}) GROUP BY ALL),
limits AS (SELECT DISTINCT token, {allowed} AS most FROM query_terms),
near AS (
  SELECT field, token, term, df, most,
         damerau_levenshtein({_ascii("token")}, {_ascii("term")}) AS edits
  FROM limits JOIN dfs ON abs(length(term) - length(token)) <= most),
weighted AS (
  SELECT field, token, term, df, 1 - edits / least(length(token), length(term)) AS weight
  FROM near WHERE edits <= most),
kept AS (
  SELECT * FROM weighted WHERE weight > 0 {limit}),
idfs AS (
  SELECT kept.*, ln(1 + (n - max(df) OVER w + 0.5) / (max(df) OVER w + 0.5)) AS idf
  FROM kept JOIN stats USING (field) WINDOW w AS (PARTITION BY field, token)),
boosts AS (
  SELECT query_id, field, term, sum(repeats * weight * idf) AS boost
  FROM idfs JOIN query_terms USING (token) GROUP BY ALL),
field_scores AS (
  SELECT query_id, field, file_path,
         sum(boost * 2.2::DOUBLE * tf
             / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM postings JOIN boosts USING (field, term) JOIN lengths USING (file_path, field)
  JOIN stats USING (field) GROUP BY ALL),
scored AS (
  SELECT query_id, file_path, round(max(score), 6) AS score FROM field_scores GROUP BY ALL)"""


def search(
    text: str,
    columns: str = "file_path, file_type, file_size, score",
    tail: str = "",
    *,
    fuzziness: str | int = "AUTO",
    analyzer: str = "standard",
    docs: str = DOCS,
    most: int | None = None,
) -> str:
    asked = f"SELECT 1 AS query_id, {_quote(text)} AS query_text"
    return f"""WITH {corpus(docs, analyzer)},
{matching(asked, fuzziness, analyzer, most)}
SELECT {columns} FROM scored JOIN docs USING (file_path) {tail}"""


def listing(columns: str, tail: str = "", docs: str = DOCS) -> str:
    return f"WITH {docs} SELECT {columns} FROM docs {tail}"


def highlighted(
    asked: str,
    summary: bool = False,
    most: int | None = 5,
    tail: str = "SELECT file_path, coalesce(found, '') AS {name} FROM joined",
) -> str:
    """Sentences holding a matched content term, words marked, the first `most`."""
    line = (
        f"regexp_replace(replace(sentence, chr(10), ' '), '^{SPACE}+|{SPACE}+$', '', 'g')"
        if summary
        else "sentence"
    )
    shown = "CASE WHEN length(line) > 100 THEN concat(left(line, 100), '...') ELSE line END"
    name, most = ("summary", 2) if summary else ("highlights", most)
    first = "" if most is None else (
        f"QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY place) <= {most}"
    )
    return rf"""WITH {corpus()},
{matching(asked)},
hits AS (SELECT query_id, file_path, content FROM scored JOIN docs USING (file_path)),
parts AS (
  SELECT query_id, file_path, string_split(regexp_replace(regexp_replace(
    content, '([.!?])\s+', '\1' || chr(1), 'g'), '[\r\n]+', chr(1), 'g'), chr(1)) AS list
  FROM hits),
sentences AS (
  SELECT query_id, file_path, unnest(list) AS part, generate_subscripts(list, 1) AS place
  FROM parts),
piece_lists AS (
  SELECT query_id, file_path, place, regexp_extract_all(part, '{PIECE}') AS list
  FROM sentences WHERE part <> ''),
pieces AS (
  SELECT query_id, file_path, place, unnest(list) AS piece, generate_subscripts(list, 1) AS n
  FROM piece_lists),
marked AS (
  SELECT p.query_id, file_path, place, n, piece, term IS NOT NULL AS found FROM pieces p
  LEFT JOIN (SELECT query_id, term FROM boosts WHERE field = 'content') b
  ON p.query_id = b.query_id AND lower(piece) = term),
lines AS (
  SELECT query_id, file_path, place, string_agg(
    CASE WHEN found THEN concat('<em>', piece, '</em>') ELSE piece END, '' ORDER BY n) AS sentence
  FROM marked GROUP BY ALL HAVING bool_or(found)),
first_lines AS (
  SELECT query_id, file_path, place, {line} AS line FROM lines {first}),
lists AS (
  SELECT query_id, file_path, string_agg({shown if summary else "line"}, '|' ORDER BY place)
    AS found
  FROM first_lines GROUP BY query_id, file_path),
joined AS (
  SELECT query_id, file_path, found FROM hits LEFT JOIN lists USING (query_id, file_path))
{tail.format(name=name)}"""


def bool_clauses(must: list[str], should: list[str], must_not: list[str]) -> str:
    every = ", ".join(map(_quote, must + should))
    need = " AND ".join(f"bool_or(term = {_quote(word)})" for word in must)
    bar = " OR ".join(f"bool_or(term = {_quote(word)})" for word in must_not)
    return f"""WITH {corpus()},
earned AS (
  SELECT file_path, term, CASE WHEN term IN ({every}) THEN
    ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2::DOUBLE * tf
    / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) END AS score
  FROM postings JOIN dfs USING (field, term) JOIN lengths USING (file_path, field)
  JOIN stats USING (field) WHERE field = 'content'),
found AS (
  SELECT file_path, round(sum(score), 6) AS score FROM earned GROUP BY file_path
  HAVING {need} AND NOT ({bar}))
SELECT file_path, file_type, file_size, score FROM found JOIN docs USING (file_path)"""


def phrase(words: list[str]) -> str:
    joins = " ".join(
        f"JOIN content_tokens t{n} ON t{n}.file_path = t0.file_path "
        f"AND t{n}.pos = t0.pos + {n} AND t{n}.term = {_quote(word)}"
        for n, word in enumerate(words)
        if n
    )
    idfs = " + ".join(
        f"(SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM dfs JOIN stats USING (field) "
        f"WHERE field = 'content' AND term = {_quote(word)})"
        for word in words
    )
    return f"""WITH {corpus()},
content_tokens AS (SELECT * FROM tokens WHERE field = 'content'),
found AS (
  SELECT t0.file_path, count(*) AS tf FROM content_tokens t0 {joins}
  WHERE t0.term = {_quote(words[0])} GROUP BY t0.file_path),
weight AS (SELECT {idfs} AS idf)
SELECT file_path, file_type, file_size, round(idf * 2.2::DOUBLE * tf
  / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 6) AS score
FROM found JOIN docs USING (file_path) JOIN lengths USING (file_path) JOIN stats USING (field)
CROSS JOIN weight WHERE field = 'content'"""


def normalized() -> str:
    text = "content"
    for pattern, new in (
        (r"\r\n?", "chr(10)"),
        (r"[\x{200B}-\x{200D}\x{FEFF}]", "''"),
        (r"[\t\p{Zs}]+", "' '"),
        (r"[\x00-\x09\x0B-\x1F\x7F]", "''"),
        (r" ?\n ?", "chr(10)"),
        (r"\n{3,}", "chr(10) || chr(10)"),
        (r"^[ \n]+|[ \n]+$", "''"),
    ):
        text = f"regexp_replace({text}, '{pattern}', {new}, 'g')"
    return listing(f"file_path, {text} AS content")


def summary_of_lines() -> str:
    def shown(n: int) -> str:
        flat = f"regexp_replace(lines[{n}], '^{SPACE}+|{SPACE}+$', '', 'g')"
        return (
            f"CASE WHEN length({flat}) > 100 THEN concat(left({flat}, 100), '...') ELSE {flat} END"
        )

    return f"""WITH {DOCS}
SELECT file_path, concat_ws('|', {shown(1)}, {shown(2)}) AS summary
FROM (SELECT file_path, string_split(content, chr(10)) AS lines FROM docs)"""


BEST = "ORDER BY score DESC, file_path"
NO_SCORE = "file_path, file_type, file_size, CAST(NULL AS DOUBLE) AS score"
EPOCH = "file_path, CAST(epoch(modified_at) AS BIGINT) AS modified_epoch"


def oracle_queries() -> dict[str, str]:
    sizes = "file_size BETWEEN 1000 AND 5000"
    whole = "file_path, file_type, file_size, CAST({} AS DOUBLE) AS score".format
    watched = (
        "SELECT * FROM (VALUES (1, 'the'), (2, 'thereou quene'), (3, 'réaution'), "
        "(4, 'doc_12.en')) AS q (query_id, query_text)"
    )
    term_stats = (
        "SELECT field, term, df, CAST(length(term) AS INTEGER) AS term_len, "
        "CAST(cf AS BIGINT) AS cf FROM dfs"
    )
    asked = f"SELECT 1 AS query_id, {_quote('thereou réaution')} AS query_text"
    placed = (
        "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id "
        "ORDER BY score DESC, file_path) AS INTEGER) AS place, file_path, score"
    )
    return {
        "document_records": listing("file_name, file_path, file_type, content, file_size"),
        "normalized_text": normalized(),
        "scan_summary": listing(
            "file_type, count(*) AS files_seen, count(*) FILTER (content <> '') AS "
            "files_processed, CAST(sum(file_size) AS BIGINT) AS bytes_seen",
            "GROUP BY file_type",
        ),
        "index_counts": listing(
            "count(*) FILTER (file_type IN ('en', 'de')) AS indexed, "
            "count(*) FILTER (file_type = 'es') AS quarantined"
        ),
        "upsert_latest": listing("file_path, content, file_size, batch_id", docs=UPDATED),
        "incremental_new_or_changed": listing(
            "file_path, file_size", "WHERE file_type IN ('en', 'fr')", UPDATED
        ),
        "postings": f"""WITH {corpus()}
SELECT field, term, file_path, tf, dl, array_to_string(positions, ',') AS positions
FROM postings JOIN lengths USING (file_path, field)""",
        "term_stats": f"WITH {corpus()} {term_stats}",
        "term_stats_updated": f"WITH {corpus(UPDATED)} {term_stats}",
        "doc_stats": f"WITH {corpus()} SELECT file_path, field, dl FROM lengths",
        "field_stats": f"""WITH {corpus()}
SELECT field, count(*) AS n, CAST(sum(dl) AS BIGINT) AS tokens, round(avg(dl), 6) AS avgdl
FROM lengths GROUP BY field""",
        "keyword_sort_keys": listing(
            "file_path, CASE WHEN length(file_name) <= 256 THEN file_name END AS name_key, "
            "CASE WHEN length(file_path) <= 512 THEN file_path END AS path_key"
        ),
        "index_count": listing("count(*) AS documents"),
        "index_count_updated": listing(
            "count(*) AS documents, CAST(sum(file_size) AS BIGINT) AS bytes", docs=UPDATED
        ),
        "search_exact": search("the réaution", fuzziness=0),
        "search_fuzzy": search("thereou quene réaution"),
        "search_basic": search(
            "The thereou, quene!",
            "file_path, file_type, file_size, score, content",
            f"{BEST} LIMIT 10",
        ),
        "search_file_name": search("doc_12.en"),
        "search_updated": search("revised thereou", docs=UPDATED),
        "filter_type": listing(whole(0), "WHERE file_type = 'fr'"),
        "filter_size_range": listing(whole(0), f"WHERE {sizes}"),
        "match_all": listing(whole(1)),
        "text_with_filters": search(
            "thereou quene", tail=f"WHERE file_type = 'en' AND {sizes}"
        ),
        "sort_score": search("thereou", tail="ORDER BY score, file_path LIMIT 20"),
        "sort_name_desc": search(
            "thereou",
            NO_SCORE,
            "WHERE file_type = 'en' AND file_size >= 1000 "
            "ORDER BY file_name DESC, file_path LIMIT 10",
        ),
        "sort_size_asc": listing(
            NO_SCORE, "WHERE file_size >= 1000 ORDER BY file_size, file_path LIMIT 10"
        ),
        "top_k": search("quene", tail=f"{BEST} LIMIT 3"),
        "unscored_hits": search("réaution", f"{NO_SCORE}, content"),
        "fuzzy_limited": search("thereou quene réaution", most=5),
        "metadata_filter": search("the thereou", tail="WHERE file_path LIKE '/src7/%'"),
        "sort_path": search("quene", NO_SCORE, "ORDER BY file_path DESC LIMIT 20"),
        "highlights": highlighted(asked),
        "all_highlights": highlighted(asked, most=None),
        "hit_projection": highlighted(
            asked,
            tail="SELECT file_name, file_path, file_type, content, file_size, score, "
            "coalesce(found, '') AS {name} "
            "FROM joined JOIN scored USING (query_id, file_path) JOIN docs USING (file_path)",
        ),
        "hit_summary": summary_of_lines(),
        "search_summary": highlighted(asked, summary=True),
        "advanced_search": search(
            "the thereou",
            f"{NO_SCORE}, file_name, content",
            f"WHERE file_type = 'en' AND {sizes} ORDER BY file_size DESC, file_path LIMIT 25",
        ),
        "bool_search": bool_clauses(["the", "of"], ["reound"], ["and"]),
        "phrase_search": phrase(["of", "the"]),
        "phrase_of_three": phrase(["attion", "to", "thanedble"]),
        "phrase_repeated": phrase(["the", "the"]),
        "fixed_fuzziness": search("thereou quene", fuzziness=1),
        "date_range": listing(
            f"{EPOCH}, CAST(0 AS DOUBLE) AS score",
            "WHERE modified_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' "
            "AND TIMESTAMP '2024-01-20 12:00:00'",
        ),
        "sort_modified": search(
            "quene",
            f"{EPOCH}, CAST(NULL AS DOUBLE) AS score",
            "ORDER BY modified_at DESC, file_path LIMIT 15",
        ),
        "page_two": search("the thereou", tail=f"{BEST} LIMIT 7 OFFSET 7"),
        "page_after_hit": search("the thereou", tail=f"{BEST} LIMIT 7 OFFSET 7"),
        "folded_text_search": search("REAUTION mais reounds", fuzziness=0, analyzer="pt"),
        "search_many": highlighted(
            watched, tail=f"{placed}, coalesce(found, '') AS {{name}} "
            "FROM scored JOIN joined USING (query_id, file_path) QUALIFY place <= 25"
        ),
        "search_many_all": f"WITH {corpus()}, {matching(watched)} {placed} FROM scored",
        "term_trends": f"""WITH {corpus()},
counted AS (
  SELECT file_type, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf
  FROM postings JOIN docs USING (file_path) WHERE field = 'content' GROUP BY ALL)
SELECT file_type, term, df, tf, CAST(row_number() OVER (
  PARTITION BY file_type ORDER BY df DESC, tf DESC, term) AS INTEGER) AS place
FROM counted QUALIFY place <= 20""",
        "term_changes_over_time": f"""WITH {corpus()},
dated AS (
  SELECT date_trunc('week', modified_at) AS period, file_path, term
  FROM postings JOIN docs USING (file_path) WHERE field = 'content'),
totals AS (SELECT period, count(DISTINCT file_path) AS docs FROM dated GROUP BY period),
periods AS (
  SELECT *, row_number() OVER (ORDER BY period) AS turn,
    lag(docs) OVER (ORDER BY period) AS docs_before FROM totals),
counted AS (
  SELECT turn, term, count(*) AS df FROM dated JOIN periods USING (period) GROUP BY ALL),
asked AS (SELECT DISTINCT turn + step AS turn, term FROM counted, (VALUES (0), (1)) AS s (step)),
pairs AS (
  SELECT p.*, term, coalesce(now.df, 0) AS df, coalesce(old.df, 0) AS df_before
  FROM periods p JOIN asked USING (turn)
  LEFT JOIN counted now USING (turn, term)
  LEFT JOIN (SELECT turn + 1 AS turn, term, df FROM counted) old USING (turn, term)
  WHERE docs_before IS NOT NULL),
cells AS (
  SELECT *, df + df_before AS yes, docs + docs_before - df - df_before AS no,
    CAST(docs + docs_before AS DOUBLE) AS everything FROM pairs),
changes AS (
  SELECT *, round(2 * (
    if(df = 0, 0, df * ln(df / (docs * yes / everything)))
    + if(df_before = 0, 0, df_before * ln(df_before / (docs_before * yes / everything)))
    + if(docs = df, 0, (docs - df) * ln((docs - df) / (docs * no / everything)))
    + if(docs_before = df_before, 0, (docs_before - df_before)
         * ln((docs_before - df_before) / (docs_before * no / everything)))), 6) AS change
  FROM cells)
SELECT CAST(epoch(period) AS BIGINT) AS period_epoch, CAST(row_number() OVER (
  PARTITION BY period ORDER BY change DESC, term) AS INTEGER) AS place,
  term, df, docs, df_before, docs_before, change
FROM changes QUALIFY place <= 20""",
    }
