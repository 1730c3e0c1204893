"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger
has a row for each run that met a blob: which rule versions were scanned and
what they found. A run scans only blobs, and only by those rule versions, that
the ledger does not have yet; all paths then get their findings by blob id.
Only built-in expressions are used. Texts are never grouped by blob, so many
copies of one text are no hot key: one row is chosen for each blob and the
texts are read again for those rows alone.

Offsets count code points, ends are exclusive. The pieces between matches have
the same lengths whether a rule's match is kept or fails its test of length, so
positions are running sums over pieces.

Cases: a null text is empty; null and repeated ids, and repeated rows, each get
the findings of their text; an empty table gives no rows and an empty ledger
row set; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import new_path, saved


@dataclass(frozen=True)
class Rule:
    """`pattern` finds candidates; one is kept if `group` has `least` characters.

    `hint`, if given, is a literal that every match contains.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    hint: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = (
    "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE_RULES = (
    Rule("assign", ASSIGN, group=2, least=12),
    Rule("access", "AKIA[A-Z0-9]+", least=18, hint="AKIA"),
    # A run of 16 or more; shorter runs need not be found to be dropped.
    Rule("hex", "[0-9a-f]{16,}", least=16),
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    # Parts of bounded length, as a run may hold many beginnings.
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,400}\\.eyJ[A-Za-z0-9_-]{8,900}\\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    # A scheme of bounded length: in a long run of letters each one begins a search.
    Rule("url_password", "[a-z][a-z0-9+.-]{0,30}://[^\\s/:@]+:[^\\s/@]+@", hint="://"),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = (
    "blob_id string, scanned array<string>, "
    "findings array<struct<start: bigint, rank: int, kind: string, end: bigint, rule: string>>"
)


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger at `path`; no rows if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def _matches(rule: Rule, todo: Column) -> Column:
    due = F.array_contains(todo, rule.name)
    if rule.hint:
        due = due & F.contains("text", F.lit(rule.hint))
    return F.when(due, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)))


def _pieces(rule: Rule, rank: int, hits: Column) -> Column:
    """A rule's matches with the lengths that their positions follow from."""
    parts = F.split("text", rule.pattern, -1)
    return F.when(
        F.size(hits) > 0,
        F.struct(
            F.lit(rank).alias("rank"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.name).alias("rule"),
            F.transform(
                F.arrays_zip(parts.alias("part"), hits.alias("hit")),
                lambda x: F.struct(
                    F.length(x["part"]).alias("gap"),
                    F.length(x["hit"]).alias("size"),
                    (
                        F.length(
                            F.regexp_extract(x["hit"], rule.pattern, rule.group)
                            if rule.group
                            else x["hit"]
                        )
                        >= rule.least
                    ).alias("kept"),
                ),
            ).alias("pieces"),
        ),
    )


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of `blobs` (blob_id, todo, text): one row per blob with matches.

    `todo` names the rule versions to apply.
    """
    hits = blobs.select(
        "blob_id", "text", *(_matches(r, F.col("todo")).alias(f"hits{i}") for i, r in enumerate(rules))
    )
    found = F.array_compact(
        F.array(*(_pieces(r, i, F.col(f"hits{i}")) for i, r in enumerate(rules)))
    )
    # Rows that repeat an id and its text are scanned as often, but counted once.
    rows = (
        hits.select("blob_id", found.alias("found"))
        .filter(F.size("found") > 0)
        .dropDuplicates(["blob_id"])
    )
    piece = (
        rows.select("blob_id", F.explode("found").alias("f"))
        .select("blob_id", "f.rank", "f.kind", "f.rule", F.posexplode("f.pieces").alias("i", "p"))
        .select("blob_id", "rank", "kind", "rule", "i", "p.gap", "p.size", "p.kept")
        # What follows the last match has no size.
        .filter("size IS NOT NULL")
    )
    order = Window.partitionBy("blob_id", "rank").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(order).cast("long")
    return (
        piece.withColumn("end", end)
        .filter("kept")
        .withColumn("start", F.col("end") - F.col("size"))
        .groupBy("blob_id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "rule"))).alias("findings"))
    )


def scan_versions(
    versions: DataFrame,
    ledger_path: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`findings` of every row of `versions`, scanning only what the ledger lacks.

    Returns id_col, blob_id and findings, one row for each row given. Without a
    `ledger_path` a new ledger is begun.
    """
    spark = versions.sparkSession
    ledger_path = ledger_path or new_path(spark, "ledger")
    rows = versions.select(
        F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")
    ).withColumn("blob_id", F.sha2("text", 256))
    paths = saved(rows.select("id", "blob_id"), "blobs")
    chosen = paths.groupBy("blob_id").agg(F.min("id").alias("id"))
    known = (
        read_ledger(spark, ledger_path)
        .select("blob_id", F.explode("scanned").alias("rule"))
        .groupBy("blob_id")
        .agg(F.collect_set("rule").alias("known"))
    )
    current = F.array(*(F.lit(r.name) for r in rules))
    todo = F.array_except(current, F.coalesce("known", F.array().cast("array<string>")))
    due = saved(
        chosen.join(known, "blob_id", "left")
        .select("blob_id", "id", todo.alias("todo"))
        .filter(F.size("todo") > 0),
        "due",
    )
    of_row = due.select("todo", F.col("blob_id").alias("due_blob"), F.col("id").alias("due_id"))
    # The small side is hashed, so the texts are dealt out but not sorted.
    texts = rows.join(
        of_row.hint("shuffle_hash"),
        rows["id"].eqNullSafe(of_row["due_id"]) & (rows["blob_id"] == of_row["due_blob"]),
    ).select("blob_id", "todo", "text")
    found = find_spans(texts, rules)
    (
        due.join(found, "blob_id", "left")
        .select(
            "blob_id",
            F.col("todo").alias("scanned"),
            F.coalesce("findings", F.from_json(F.lit("[]"), LEDGER.split("findings ")[1])).alias("findings"),
        )
        .write.mode("append")
        .parquet(ledger_path)
    )
    names = [r.name for r in rules]
    findings = (
        read_ledger(spark, ledger_path)
        .filter(F.size("findings") > 0)
        .select("blob_id", F.filter("findings", lambda x: x["rule"].isin(names)).alias("findings"))
        .groupBy("blob_id")
        .agg(F.sort_array(F.flatten(F.collect_list("findings"))).alias("findings"))
    )
    return paths.join(findings, "blob_id", "left").select(
        F.col("id").alias(id_col), "blob_id", "findings"
    )


def spans_text(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    shown = F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return F.coalesce(F.array_join(shown, ","), F.lit(""))


def redact(docs: DataFrame, ledger_path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every finding replaced by `mark`, and `n_chars` to match.

    Overlapping findings are replaced as one. The text is cut at the findings
    and put together again.
    """
    found = (
        scan_versions(docs, ledger_path)
        .filter(F.size("findings") > 0)
        .select(F.col("doc_id").alias("__id"), F.col("blob_id").alias("__blob"), F.col("findings").alias("__found"))
        .dropDuplicates(["__id", "__blob"])
    )
    keyed = docs.withColumn("__blob_now", F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = keyed.join(
        found.hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__blob_now") == F.col("__blob")),
        "left",
    )
    # Each finding ends a kept piece; a finding inside an earlier one keeps nothing.
    ends = F.transform(
        "__found",
        lambda x, i: F.struct(
            x["start"].alias("start"),
            F.coalesce(
                F.array_max(F.transform(F.slice("__found", F.lit(1), i), lambda y: y["end"])),
                F.lit(0),
            ).alias("from"),
        ),
    )
    last = F.array_max(F.transform("__found", lambda x: x["end"]))

    def cut(start: Column, end: Column) -> Column:
        return F.substring(F.col("text"), start.cast("int") + 1, (end - start).cast("int"))

    kept = F.concat(
        F.array_join(
            F.transform(
                "__ends",
                lambda e: F.when(
                    e["start"] >= e["from"], F.concat(cut(e["from"], e["start"]), F.lit(mark))
                ).otherwise(F.lit("")),
            ),
            "",
        ),
        F.substring(F.col("text"), last.cast("int") + 1, F.length("text")),
    )
    text = F.when(F.size("__found") > 0, kept).otherwise(F.col("text"))
    return (
        joined.withColumn("__ends", ends)
        .withColumn("text", text)
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(docs.columns)
    )
