"""Secret scans by an incremental ledger of content-addressed blobs, in DataFrame operations alone.

Every version of every path is a blob, named by the SHA-256 of its text. The ledger says which rules, in
which versions, have been run on which blobs and what they found; a scan runs only the pairs that it
lacks, once per blob, and joins findings back to all paths that have, or had, that blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least``: code points that group ``group`` needs; shorter matches are dropped after matching.
    ``hint``: a text that the pattern can match has one of these strings, in the case given."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: tuple[str, ...] = ()

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds first; their order breaks ties between spans that start together.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, (":", "=")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # the runs of 24 and more among all runs
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, ("gh",)),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("-----BEGIN ",)),
)
BASE = ("assign", "access", "hex")
#: What is masked: of a private key all lines to its END, or the header alone where none follows before other such dashes. A key has few other hyphens.
MASKED = (*RULES[:-1], Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++-{1,4}(?!-)){0,64}+[^-]*+-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0, ("-----BEGIN ",)))

SPAN = "struct<start:int,rank:int,end:int,kind:string,version:int>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of a rule, leftmost first, in code points. Positions follow from the lengths of the pieces between matches."""
    pattern = F.lit(rule.pattern)
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  evaluates the value once
    parts = F.struct(F.split(text, rule.pattern, -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))
    none = F.array().cast(f"array<{SPAN}>")

    def walk(p):
        def step(acc, k):
            start = acc["at"] + F.length(F.get(p["between"], k))
            end = start + F.length(F.get(p["all"], k))
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))
            return F.struct(end.alias("at"), F.when(F.length(F.get(p["part"], k)) >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

        zero = F.struct(F.lit(0).alias("at"), none.alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.size(p["all"]) - 1), zero, step, lambda acc: acc["found"])

    hinted = F.lit(True)
    for k, hint in enumerate(rule.hint):
        hinted = F.contains(text, F.lit(hint)) if k == 0 else hinted | F.contains(text, F.lit(hint))
    return F.when(hinted & text.rlike(rule.pattern), let(parts, walk)).otherwise(none)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def find(text: Column, rules: tuple[Rule, ...] = RULES, seen: Column | None = None) -> Column:
    """All spans of the rules in a text, sorted by start, then rule. ``seen``: the tags of rules to leave out."""
    found = []
    for rank, rule in enumerate(rules):
        spans = _spans(text, rule, rank)
        found.append(spans if seen is None else F.when(F.array_contains(seen, rule.tag), F.array().cast(f"array<{SPAN}>")).otherwise(spans))
    return F.array_sort(F.concat(*found))


LEDGER = f"blob string, scanned array<string>, spans array<{SPAN}>"


def update_ledger(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the blobs of ``versions`` with the rules in whose present version they haven't been scanned, and appends to the ledger at that path.

    Texts meet once per blob: copies are dropped before the shuffle and after it. A null text is the empty blob. Scans at the same time, or one
    that is run again after its append, may enter a blob twice; readers count its findings once.
    """
    spark = versions.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), t.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    old = read_ledger(spark, ledger)
    tags = [r.tag for r in rules]
    if old is not None:
        seen = old.select("blob", F.explode("scanned").alias("tag")).where(F.col("tag").isin(tags)).groupBy("blob").agg(F.collect_set("tag").alias("seen"))  # no more than there are rules
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    else:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    todo = F.array_except(F.array(*[F.lit(x) for x in tags]), F.col("seen"))
    fresh = blobs.where(F.size(todo) > 0).select("blob", todo.alias("scanned"), find(F.col("body"), rules, None if old is None else F.col("seen")).alias("spans"))
    fresh.write.mode("append").parquet(ledger)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def live_findings(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of blobs in which the present versions of the rules found something, sorted by start, then rule. A ledger that holds a blob and rule twice, as after a
    retried or concurrent scan, has each finding once."""
    current = F.array(*[F.lit(r.tag) for r in rules])
    live = F.filter("spans", lambda s: F.array_contains(current, F.concat_ws("@", s["kind"], s["version"].cast("string"))))
    found = ledger.select("blob", live.alias("spans")).where(F.size("spans") > 0)
    return found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))  # a row for each time that rules changed or a scan was repeated


def scan(versions: DataFrame, ledger: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns to keep, blob and spans (sorted by start, then rule) for every row of ``versions``.

    ``ledger``: where findings are kept from scan to scan; without one a new one is made in the shared folder. Spans of older
    rule versions don't come out. Null texts count as empty; repeated rows come out as often as they came in; no rows give no rows.
    """
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    update_ledger(versions, ledger, text, rules)
    found = live_findings(spark.read.schema(LEDGER).parquet(ledger), rules)
    # What is kept travels in one struct, so none of it clashes with the ledger's columns.
    paths = versions.select(F.struct(*keep).alias("__row"), blob_id(F.col(text)).alias("blob"))
    return paths.join(found, "blob", "left").select(*[F.col("__row")[k].alias(k) for k in keep], "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scanned.select(*keep, *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, by: str = "[secret]") -> Column:
    """The text with every run of overlapping spans replaced."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

    def step(acc, s):
        apart = s["start"] >= acc["at"]
        made = F.when(apart, F.concat(acc["made"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(by))).otherwise(acc["made"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), made.alias("made"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, lambda acc: F.concat(acc["made"], F.substr(text, acc["at"] + 1, F.length(text))))).otherwise(text)


def mask_secrets(df: DataFrame, ledger: str | None = None, text: str = "text", chars: str = "n_chars", rules: tuple[Rule, ...] = MASKED) -> DataFrame:
    """``df`` with its secrets masked, and ``chars``, where there is such a column, counted again for texts that changed.

    Findings of the present rule versions come through the ledger and are joined back by blob; only blobs with findings take part in that join.
    A null text stays null, rows that repeat come out as often as they came in, no rows give no rows, and all columns pass.
    """
    spark = df.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    update_ledger(df, ledger, text, rules)
    found = live_findings(spark.read.schema(LEDGER).parquet(ledger), rules)
    # All columns travel in one struct, so none clashes with those of the ledger.
    marked = df.select(blob_id(F.col(text)).alias("blob"), F.struct("*").alias("row")).join(found, "blob", "left")
    changed = F.coalesce(F.size("spans") > 0, F.lit(False))
    old = lambda c: F.col("row")[c]
    new = {text: F.when(changed, masked(old(text), F.col("spans"))).otherwise(old(text))}
    if chars in df.columns:
        new[chars] = F.when(changed, F.length(new[text]).cast(df.schema[chars].dataType)).otherwise(old(chars))
    return marked.select(*[new.get(c, old(c)).alias(c) for c in df.columns])
