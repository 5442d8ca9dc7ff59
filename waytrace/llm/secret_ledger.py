"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every text version is addressed by its content (SHA-256 of its UTF-8). The ledger is a folder
of Parquet files with one row per blob and run, holding an entry (rule, version, spans) for each rule that was
scanned then. A run

1. hashes all texts,
2. keeps one text per blob and, of the rules, those whose (blob, rule, version) is
   not in the ledger,
3. scans these and appends the entries to the ledger,
4. joins the ledger's findings, old and new, back to every row (path) with that blob.

So a copy is scanned once, an unchanged text never again, and a changed rule
only by itself. Blobs without findings are in the ledger too, but not in the
join back. ``redact`` masks what the ledger says.

A rule's matches are leftmost and non-overlapping. Splitting a text at them gives the gaps between; running
sums of the lengths of gaps and matches are the positions, in code points. The sums are taken by runs of
``RUN`` matches, then over the runs, so a text of very many matches isn't copied once for each. What is too short is
dropped after matching, so it still takes its place.

Null text counts as empty. Repeated rows each get their findings; an empty
table gives an empty result. Very long texts are scanned whole, in time proportional to their length. Only the id and text columns are read; columns named like
those made here don't clash. A blob that holds most rows is one row in step 2 (the first
text per blob is taken before the shuffle, too) and a broadcast row in step 4.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace.llm.common import free_prefix, local_table, shared_dir, skew_join, staged, table

#: Matches whose positions are summed up together.
RUN = 256
SPANS = "array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """``needles``: one of them is in the lower-cased text wherever the rule can match (empty: try all texts).
    ``value``: the group whose length counts (0: the match), at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    value: int = 0
    needles: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: A class that takes all it can may state its least length: no shorter run of it holds a longer match.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 6, 2, ("password", "passwd", "secret", "token", "api_key", "apikey")),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20, 0, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 40, 0, ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0, ("private key-----",)),
]
#: Of RULES, those every scan has to have; the others only add spans.
BASE = ("assign", "access", "hex")


def rule_spans(text: Column, rule: Rule) -> Column:
    """All spans of one rule in ``text``, in order."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = (lambda h: F.regexp_extract(h, rule.pattern, rule.value)) if rule.value else (lambda h: h)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("long"))
    steps = F.transform(hits, lambda h: F.struct(F.length(h).cast("long").alias("long"), (F.length(counted(h)) >= rule.least).alias("counts")))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), steps.alias("hit"))
    none = F.array().cast(SPANS)

    def walk(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + p["hit"]["long"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["hit"]["counts"], F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    def moved(acc: Column, run: Column) -> Column:
        spans = F.transform(run["found"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["found"], spans).alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))
    begins = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(RUN))
    runs = F.transform(begins, lambda at: F.aggregate(F.slice(pairs, at, F.lit(RUN)), start, walk))
    found = F.aggregate(runs, start, moved)["found"]
    if rule.needles:
        low, likely = F.lower(text), F.lit(False)
        for needle in rule.needles:
            likely = likely | F.contains(low, F.lit(needle))
    else:
        likely = text.rlike(rule.pattern)
    return F.when(likely, found).otherwise(none)


LEDGER = f"blob binary, entries array<struct<rule:string,version:int,spans:{SPANS}>>"


def entries_in(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, rule, version, spans) of all runs in the folder ``ledger``; empty where there is none yet."""
    try:
        held = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException:
        held = local_table(spark, [], LEDGER)
    return held.select("blob", F.explode("entries").alias("e")).select("blob", "e.rule", "e.version", "e.spans")


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/waytrace-ledger-{uuid.uuid4().hex}"


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan(docs: DataFrame, ledger: str, rules: list[Rule] | None = None, text_column: str = "text") -> DataFrame:
    """(blob, found) of the blobs with findings, ``found`` being an array of (start, rank, kind, end) in order of start, then of
    the rules. Blobs of ``docs`` that the ``ledger`` has not seen with some rule are scanned first, and the entries appended."""
    spark, rules = docs.sparkSession, RULES if rules is None else rules
    keys = [r.key for r in rules]
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    blobs = docs.select(_blob(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    old = entries_in(spark, ledger)
    if old.isEmpty():
        todo = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        old = old.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen"))
        todo = blobs.join(old, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        todo = todo.where(~F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.array_contains("seen", k)))
    per_rule = [
        F.when(~F.array_contains("seen", F.lit(r.key)), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), rule_spans(F.col("text"), r).alias("spans"))) for r in rules
    ]
    todo.select("blob", F.filter(F.array(*per_rule), lambda e: e.isNotNull()).alias("entries")).write.mode("append").parquet(ledger)

    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    known = entries_in(spark, ledger).where(F.concat_ws("@", "rule", "version").isin(keys) & (F.size("spans") > 0))
    told = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("rule")].alias("rank"), F.col("rule").alias("kind"), s["end"].alias("end")))
    findings = known.select("blob", told.alias("found")).groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    return staged(findings.select("blob", F.array_sort("found").alias("found")), "findings")


NONE_FOUND = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def scan_paths(docs: DataFrame, ledger: str, rules: list[Rule] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, blob, found) of each row of ``docs``."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    findings = scan(docs, ledger, rules, text_column)
    paths = staged(docs.select(F.col(f"`{id_column}`").cast("long").alias(id_column), _blob(text).alias("blob")), "paths")
    return skew_join(paths, findings, "blob", "left").select(id_column, "blob", F.coalesce("found", F.array().cast(NONE_FOUND)).alias("found"))


def spell(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: str | None = None, rules: list[Rule] | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with every run of overlapping spans masked and n_chars set anew.

    Texts are scanned through the ``ledger`` (default: a new one), then each row meets the findings of its blob, if it has some: rows without
    findings stay where they are. A null text stays null."""
    p = free_prefix(docs)
    new, at, key = f"{p}new", f"{p}spans", f"{p}key"
    keyed = docs.withColumn(key, _blob(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    findings = scan(docs, ledger or new_ledger(docs.sparkSession), rules)
    joined = skew_join(keyed, findings.select(F.col("blob").alias(key), F.col("found").alias(at)), key, "left")
    cut = F.aggregate(
        at,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"))),
    )
    masked = joined.withColumn(new, F.when(F.col(at).isNotNull(), cut).otherwise(F.col("text")))
    columns = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(at).isNotNull(), F.length(new).cast("long")).otherwise(F.col("n_chars").cast("long"))
    return masked.withColumns(columns).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans in all ``documents``, through a ledger in the shared folder that this run begins."""
    paths = scan_paths(table(spark, sf_dir, "documents"), new_ledger(spark))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.select("doc_id", *[count(k) for k in BASE], F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("found")).alias("spans"), F.lower(F.hex("blob")).alias("blob"))


def _sql_spans(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    cut = f"'(?s)(.*?)(?:({pattern})|\\z)'"
    kept = f"length(regexp_extract(hit, '{pattern}', {rule.value})) >= {rule.least}" if rule.value else f"length(hit) >= {rule.least}"
    return f"""
SELECT row, {rank} AS rank, '{rule.kind}' AS kind, reached - length(hit) AS begins, reached AS ends FROM (
  SELECT row, hit, sum(step) OVER (PARTITION BY row ORDER BY i) AS reached FROM (
    SELECT row, unnest(hits) AS hit, unnest(steps) AS step, generate_subscripts(hits, 1) AS i FROM (
      SELECT row, regexp_extract_all(body, {cut}, 2) AS hits,
             list_transform(regexp_extract_all(body, {cut}, 0), lambda s: length(s)) AS steps FROM bodies)))
WHERE hit <> '' AND {kept}"""


ORACLE = f"""
WITH bodies AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
found AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
told AS (
  SELECT row,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(begins AS BIGINT) || ':' || CAST(ends AS BIGINT), ',' ORDER BY begins, rank) FILTER (kind IN ('assign', 'access', 'hex')) AS base,
         string_agg(kind || ':' || CAST(begins AS BIGINT) || ':' || CAST(ends AS BIGINT), ',' ORDER BY begins, rank) AS spans
  FROM found GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(body) AS blob
FROM bodies LEFT JOIN told USING (row)
"""
