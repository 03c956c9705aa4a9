"""Secret scan over a ledger of content-addressed blobs.

Every version of a file is addressed by the SHA-256 of its text. The ledger
holds one row per (blob, rule version) that has been scanned, with the spans
found in it, also when there are none. A run scans only the pairs that the
ledger lacks and then joins the findings of all blobs back to every path that
holds one. Copies of a text are therefore scanned once, and a later run over
old and new versions pays for the new ones.

Spans are in code points, end exclusive. Spark has no function that returns
the position of every match; the pieces between the matches (``split``) and
the matches themselves (``regexp_extract_all``) add up to the positions.

Defined results for odd input: a null text counts as empty and has no spans;
repeated rows each get their findings; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.llm.common import checkpointed, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``least``: code points that the match (or group ``measured``) needs; ``hint``: texts without it cannot match."""

    kind: str
    pattern: str
    least: int = 0
    measured: int = 0
    hint: str | None = None


#: The three base rules, then those that this scan adds. Order decides between spans with one start.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, "gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, "xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, "eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
)
RULES = BASE_RULES + EXTRA_RULES
RULE_VERSION = "1"

SPAN = "struct<start:int,ord:int,end:int,kind:string>"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of spans of one rule, leftmost first and not overlapping."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.measured)) if rule.measured else matches
    pairs = F.zip_with(
        F.zip_with(F.split(text, rule.pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"))),
        measured,
        lambda p, v: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), F.length(v).alias("measured")),
    )
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + p["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(p["measured"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    # the last gap has no match: the filter takes it away before positions are summed
    found = F.aggregate(F.filter(pairs, lambda p: p["size"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    gate = text.rlike(rule.pattern)
    if rule.hint:
        gate = text.contains(rule.hint) & gate
    return F.when(gate, found).otherwise(empty)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (``blob``, ``rule_version``, ``spans``) of blobs (``blob``, ``text``)."""
    found = reduce(F.concat, [rule_spans(F.col("text"), rule, i) for i, rule in enumerate(rules)])
    return blobs.select("blob", F.lit(version).alias("rule_version"), F.array_sort(found).alias("spans"))


def unseen_blobs(docs: DataFrame, ledger: DataFrame | None, text: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """One row (``blob``, ``text``) for each text that the ledger has not seen with this rule version."""
    t = text_or_empty(text)
    blobs = docs.select(F.sha2(t.cast("binary"), 256).alias("blob"), t.alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.dropDuplicates(["blob"])


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings and new ledger rows.

    The findings are the rows of ``docs`` without their text, with ``blob`` and
    ``spans``. The new ledger rows are checkpointed: the caller can append them
    and the findings read the same rows, so texts are scanned once. Appending
    twice does no harm, as the ledger is read through ``distinct``.
    """
    fresh = checkpointed(scan_blobs(unseen_blobs(docs, ledger, text, version), rules, version))
    known = fresh
    if ledger is not None:
        old = ledger.filter(F.col("rule_version") == version).select("blob", "rule_version", "spans")
        known = old.dropDuplicates(["blob"]).unionByName(fresh)
    hits = known.filter(F.size("spans") > 0).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    t = text_or_empty(text)
    paths = docs.withColumn("__path_blob", F.sha2(t.cast("binary"), 256)).drop(text)
    found = paths.join(hits, F.col("__path_blob") == F.col("__blob"), "left")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "blob", "spans")]
    spans = F.coalesce("__spans", F.array().cast(f"array<{SPAN}>"))
    return found.select(*keep, F.col("__path_blob").alias("blob"), spans.alias("spans")), fresh


def scan_with_ledger(docs: DataFrame, ledger_path: str, text: str = "text", rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Findings of ``docs``; what was scanned for them is appended to the ledger at ``ledger_path``."""
    spark = docs.sparkSession
    schema = f"blob string, rule_version string, spans array<{SPAN}>"
    spark.createDataFrame([], schema).write.mode("append").parquet(ledger_path)
    found, fresh = scan_secrets(docs, spark.read.schema(schema).parquet(ledger_path), text, rules, version)
    found = checkpointed(found)
    fresh.write.mode("append").parquet(ledger_path)
    return found


def digest(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(digest(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


def _oracle_rule(rule: Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return (
        f"SELECT b, {order} AS ord, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(body, '{pattern}') AS gaps, "
        f"regexp_extract_all(body, '{pattern}', 0) AS whole, regexp_extract_all(body, '{pattern}', {rule.measured}) AS part FROM blobs"
    )


def _oracle() -> str:
    rules = "\nUNION ALL ".join(_oracle_rule(r, i) for i, r in enumerate(RULES))
    kinds = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    row = "kind || ':' || s || ':' || e"
    return f"""
WITH blobs AS (SELECT DISTINCT coalesce(text, '') AS body, sha256(coalesce(text, '')) AS b FROM documents),
m AS ({rules}),
u AS (SELECT b, ord, kind, least, unnest(range(1, len(whole) + 1)) AS i, gaps, whole, part FROM m WHERE len(whole) > 0),
p AS (SELECT b, ord, kind, least, i, length(gaps[i]) AS gap, length(whole[i]) AS size, length(part[i]) AS measured FROM u),
q AS (SELECT b, ord, kind, least, measured, size,
             sum(gap + size) OVER (PARTITION BY b, ord ORDER BY i) AS e FROM p),
spans AS (SELECT b, ord, kind, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM q WHERE measured >= least),
f AS (SELECT b, {counts},
             string_agg({row}, ',' ORDER BY s, ord) FILTER (kind IN ({kinds})) AS base,
             string_agg({row}, ',' ORDER BY s, ord) AS spans FROM spans GROUP BY b)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN f ON f.b = sha256(coalesce(text, ''))
"""


ORACLE = _oracle()
