"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from . import secrets

# Kind, pattern, tested group and least length of the base rules for
# secrets, as the contract gives them, and the marks around a turn.
BASE_SECRETS = (
    (
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
)
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def contamination() -> str:
    def words(table: str, key: str) -> str:
        low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
        pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
        return f"SELECT {key}, regexp_extract_all({low}, '{pattern}') AS w FROM {table}"

    def grams(source: str, key: str) -> str:
        return (
            f"SELECT {key}, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM "
            f"(SELECT {key}, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM {source})"
        )

    return f"""WITH d AS ({words("documents", "doc_id")}), b AS ({words("benchmark", "item_id")}),
items AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, gram FROM ({grams("items", "item_id")})),
sizes AS (SELECT DISTINCT n FROM items),
sized AS (SELECT doc_id, w, n FROM d JOIN sizes ON len(w) >= n),
found AS (SELECT doc_id, k, n, item_id FROM ({grams("sized", "doc_id")}) JOIN windows USING (n, gram)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
lists AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN lists USING (doc_id)"""


def secret_spans() -> str:
    """Positions are running sums over the pieces between matches."""
    parts = []
    more = [(r.kind, r.pattern, r.group, r.least) for r in secrets.MORE_RULES]
    base = [kind for kind, *_ in BASE_SECRETS]
    for rank, (kind, pattern, group, least) in enumerate([*BASE_SECRETS, *more]):
        pattern = _quote(pattern)
        tested = f"regexp_extract(hit, {pattern}, {group})"
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, stop, length(hit) AS size FROM (
    SELECT doc_id, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)
      AS BIGINT) AS stop
    FROM (SELECT doc_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap,
            generate_subscripts(hits, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS hits,
                  string_split_regex(text, {pattern}) AS gaps FROM documents)))
  WHERE length({tested}) >= {least}""")
    counts = ", ".join(
        f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in base
    )
    zeros = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in base)
    shown = "concat(kind, ':', stop - size, ':', stop), ',' ORDER BY stop - size, rank"
    return f"""WITH spans AS ({" UNION ALL ".join(parts)}),
found AS (
  SELECT doc_id, {counts}, string_agg({shown}) AS spans,
    string_agg({shown}) FILTER (rank < {len(base)}) AS base
  FROM spans GROUP BY doc_id)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found USING (doc_id)"""


def chat_digests() -> str:
    hard = _quote(f"{TURN_END}{TURN_START}assistant ok")
    order = "ORDER BY turn, role, text"
    conflict = rf"contains(text, '{TURN_END}') OR regexp_matches(text, '<\\+\|')"
    body = rf"CASE WHEN {conflict} THEN regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') ELSE text END"
    frame = len(TURN_START) + len(TURN_END) + 2
    return f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {hard} UNION ALL SELECT -1, 1, 'assistant', {hard})
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({frame} + length(role) + length({body})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def hard_negatives() -> str:
    """All anchors against all rows; sums of products stay exact in doubles."""
    odd = "lambda x: x IS NULL OR NOT isfinite(x)"
    return f"""WITH v AS (
  SELECT vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, {odd})) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s
  WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score,
  s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3"""


ORACLE_QUERIES = {
    "op2_benchmark_decontamination": contamination(),
    "op3_secret_scans": secret_spans(),
    "op5_chat_round_trip": chat_digests(),
    "op11_hard_negatives": hard_negatives(),
}
