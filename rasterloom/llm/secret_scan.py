"""Incremental secret scanning over a ledger of content-addressed blobs, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a Parquet folder with a row for each blob and
scan: the rules (with versions) that were run, and the spans they found. A scan runs a rule on a blob only if no row of the ledger
has that pair, once however many paths hold the blob, appends what it ran, and joins
what the ledger holds back to all paths.

A pattern's matches and the gaps between them become rows with a running sum of lengths, so a text's cost is linear in its length and matches.

Defined results: null text is the empty text, which has no spans; repeated rows and rows that share
an id each get a row; a null id stays null; an empty table gives an empty result; columns other than
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, few_files, new_folder


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; one whose group has under least characters is dropped."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    base: bool = False
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
RULES = (
    Rule("assign", ASSIGN, 6, 2, base=True),
    Rule("access", "AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", "[0-9a-f]+", 24, base=True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 30),
    Rule("github", "gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
)
#: To skip texts that can't match: cheaper than the pattern itself.
_HINT = {"hex": "[0-9a-f]{24}"}

#: Places in code points; from and to are places in bytes.
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,from:bigint,to:bigint>>"
LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:bigint,end:bigint,from:bigint,to:bigint>>"
#: Where queries keep their ledger between runs; unset, a run starts its own in the shared folder.
LEDGER_CONF = "spark.rasterloom.secrets.ledger"
LENGTHS = "array<struct<gap:bigint,own:bigint,gap_bytes:bigint,own_bytes:bigint,long:boolean>>"


def lengths_of(text: Column, rule: Rule) -> Column:
    """Of each match of a rule the lengths of the gap before it and of itself; empty without matches. What split() leaves is the gaps."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    sizes = lambda x: (F.length(x).cast("bigint"), F.octet_length(x).cast("bigint"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(sizes(g)[0].alias("gap"), sizes(m)[0].alias("own"), sizes(g)[1].alias("gap_bytes"), sizes(m)[1].alias("own_bytes")))
    whole = F.zip_with(pairs, value, lambda a, v: F.struct(a["gap"].alias("gap"), a["own"].alias("own"), a["gap_bytes"].alias("gap_bytes"), a["own_bytes"].alias("own_bytes"), (F.length(v) >= rule.least).alias("long")))
    return F.when(text.rlike(_HINT.get(rule.kind, rule.pattern)), whole).otherwise(F.array().cast(LENGTHS))


@dataclass
class Scan:
    """findings: (path, blob, spans) for each version of a path; fresh: the ledger rows that the scan appended."""

    findings: DataFrame
    fresh: DataFrame


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows; none where the folder doesn't exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def scan_history(versions: DataFrame, path: str, content: str, folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> Scan:
    """Scans versions (any rows of a path and its content) against the ledger in a folder, and appends to it.

    Each blob is read from one row of the path of least text, so copies move no text and are scanned once; a rule is evaluated for a blob only if the ledger lacks the pair.
    """
    spark = versions.sparkSession
    folder = folder or spark.conf.get(LEDGER_CONF, None) or new_folder(spark, "secret-ledger")
    keys = [r.key for r in rules]
    ledger = read_ledger(spark, folder)
    rows = versions.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    rows = rows.withColumn("blob", F.sha2(F.col("content"), 256)).withColumn("pick", F.coalesce(F.col("path").cast("string"), F.lit("")))
    unseen = rows.groupBy("blob").agg(F.min("pick").alias("pick"))
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
    unseen = unseen.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    unseen = unseen.where(~F.forall(F.array(*map(F.lit, keys)), lambda k: F.array_contains("known", k)))
    # One row of a blob: those of one path and one content are alike.
    blobs = rows.select("pick", "blob", "content").join(unseen, ["pick", "blob"]).dropDuplicates(["pick", "blob"])
    lacks = lambda r: ~F.array_contains("known", r.key)
    found = [F.struct(F.lit(r.key).alias("rule"), F.when(lacks(r), lengths_of(F.col("content"), r)).alias("x")) for r in rules]
    run = F.filter(F.array(*[F.when(lacks(r), F.lit(r.key)) for r in rules]), lambda k: k.isNotNull())
    # Written: each pair is scanned once, and the joins get plain exchanges, whose hot blobs Spark can split.
    done = cut(blobs.select("blob", run.alias("rules"), F.filter(F.array(*found), lambda f: F.size(F.coalesce(f["x"], F.array().cast(LENGTHS))) > 0).alias("found")))
    match = done.select("blob", F.explode("found").alias("f")).select("blob", F.col("f.rule").alias("rule"), F.posexplode("f.x").alias("i", "x"))
    so_far = W.partitionBy("blob", "rule").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    match = match.withColumn("end", F.sum(F.col("x.gap") + F.col("x.own")).over(so_far)).withColumn("to", F.sum(F.col("x.gap_bytes") + F.col("x.own_bytes")).over(so_far))
    span = F.struct("rule", (F.col("end") - F.col("x.own")).alias("start"), "end", (F.col("to") - F.col("x.own_bytes")).alias("from"), "to")
    spans = match.where("x.long").groupBy("blob").agg(F.collect_list(span).alias("spans"))
    fresh = done.select("blob", "rules").join(spans, "blob", "left").select("blob", "rules", F.coalesce("spans", F.array()).alias("spans"))
    fresh = cut(fresh.select("blob", "rules", F.col("spans").cast(LEDGER.rpartition("spans ")[2]).alias("spans")))
    few_files(fresh).write.mode("append").parquet(folder)
    known = ledger.unionByName(fresh)  # not the folder, to which others may append meanwhile
    own = F.filter("spans", lambda s: s["rule"].isin(keys))
    rank = lambda s: F.array_position(F.array(*map(F.lit, keys)), s["rule"]).cast("int") - 1
    kind = lambda s: F.element_at(F.array(*[F.lit(r.kind) for r in rules]), rank(s) + 1)
    shaped = F.transform(own, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), kind(s).alias("kind"), s["end"].alias("end"), s["from"].alias("from"), s["to"].alias("to")))
    own = known.select("blob", shaped.alias("spans")).where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Two scans at once may both have appended a pair.
    own = own.withColumn("spans", F.filter("spans", lambda s, i: (i == 0) | (s != F.element_at("spans", F.greatest(i, F.lit(1))))))
    findings = rows.select("path", "blob").join(own, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return Scan(findings, fresh)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per document: counts of base spans, their digest, and all spans."""
    base = [r.kind for r in rules if r.base]
    found = scan_history(documents, "doc_id", "text", rules=rules).findings
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        F.col("path").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents with each secret replaced by [kind]; overlapping spans are replaced as one by the first's kind.

    The columns stay as they are, n_chars becoming the new length. Null text stays null.
    """
    # The blob's own text is masked, so the spans are joined by content and not by id.
    rows = documents.withColumn("_blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = scan_history(documents, "doc_id", "text", rules=rules).findings.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    span = found.select("blob", F.posexplode("spans").alias("i", "s")).select("blob", "i", "s.*")
    before = W.partitionBy("blob").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    # A span opens a mask if all before it end by then; a mask ends where the last of its spans does.
    span = span.withColumn("opens", (F.col("from") >= F.coalesce(F.max("to").over(before), F.lit(0))).cast("int"))
    span = span.withColumn("mask", F.sum("opens").over(W.partitionBy("blob").orderBy("i")))
    masks = span.groupBy("blob", "mask").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.min_by("kind", "i").alias("kind"))
    masks = masks.groupBy(F.col("blob").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("from", "to", "kind"))).alias("_masks"))
    rows = rows.join(masks, F.col("_blob") == F.col("_b"), "left")
    last = lambda i: F.when(i > 0, F.element_at("_masks", i)["to"]).otherwise(F.lit(0))
    # substring() of bytes copies its own part only, and the bytes are made once, so a text is masked in time linear in its length.
    piece = lambda raw, at, to: F.substring(raw, (at + 1).cast("int"), (to - at).cast("int")).cast("string")
    parts = lambda raw: F.transform("_masks", lambda m, i: F.concat(piece(raw, last(i), m["from"]), F.lit("["), m["kind"], F.lit("]")))
    tail = lambda raw: piece(raw, F.element_at("_masks", F.size("_masks"))["to"], F.octet_length("text"))
    masked = F.element_at(F.transform(F.array(F.col("text").cast("binary")), lambda raw: F.concat(F.array_join(parts(raw), ""), tail(raw))), 1)
    out = rows.withColumn("text", F.when(F.col("_masks").isNull() | F.col("text").isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("_masks").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(documents.schema["n_chars"].dataType)))
    return out.select(documents.columns)


def op7_sql() -> str:
    """DuckDB SQL for secret_digest()."""

    def spans(rank: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""SELECT doc_id, rn, {rank} AS rnk, '{r.kind}' AS kind, m.s AS s, m.e AS e FROM (
  SELECT doc_id, rn, unnest(list_transform(range(1, len(f) + 1), lambda i: struct_pack(
    s := coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0),
    e := coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i], lambda x: length(x))), 0),
    n := length(v[i])))) AS m
  FROM (SELECT doc_id, rn, regexp_extract_all(t, '{p}', 0) AS f, regexp_extract_all(t, '{p}', {r.group}) AS v, regexp_split_to_array(t, '{p}') AS g
        FROM d WHERE regexp_matches(t, '{_HINT.get(r.kind, p)}'))) WHERE m.n >= {r.least}"""

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rn FROM documents),
x AS ({' UNION ALL '.join(spans(i, r) for i, r in enumerate(RULES))}),
y AS (SELECT rn, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rnk) FILTER (rnk < 3) AS b,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rnk) AS a FROM x GROUP BY rn)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN y USING (rn)"""
