"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger knows which blobs were
scanned under which version of the rules; only unseen pairs are scanned, once for all paths
and versions that share a blob, and the findings are joined back to all of them. The ledger keeps
the paths of every run, so the findings of older versions can be told as well. A run that breaks off
leaves nothing that is read, only work to be done again.

DataFrame functions only. A regular expression finds one kind; its matches are framed with control
characters, the text is split at the frames, and running sums of the parts' lengths give the
places in code points. Cases: a null text is empty; an empty text has no finding; the control
characters U+0001 to U+0003 in a text are read as U+0004, which no rule matches; copies and repeated
rows share their findings; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwright.llm.storage import materialise, shared_dir


@dataclass(frozen=True)
class Rule:
    """kind: its name. prefix and value: what must stand there, and the secret itself. A match counts if the value has ``least`` characters."""

    kind: str
    prefix: str
    value: str
    least: int = 1


#: The base rules. Runs that are too short can't hide longer ones in access and hex, so their lengths stand in the patterns.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", "", r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", "", r"[0-9a-f]{16,}", 16),
)
#: A private key: from its header to its end, or, where the end is missing, as far as base64 goes. Line ends may be escaped. Possessive, so that it's read once.
_GAP = r"(?:\s|\\[nrt])*+"
_CUT = rf"(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:{_GAP}[A-Za-z0-9+/]++={{0,2}}+(?=[\x20\t]*+(?:[\r\n\\]|\z)))?+"
_PEM = rf"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:[A-Z]+ )*PRIVATE KEY-----|{_CUT})?+"
#: What the method adds: private keys, JSON web tokens, credentials in addresses.
ADDED = (
    Rule("pem", "", _PEM),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"://[A-Za-z0-9._~-]++:", r"[^\s:/@\x22'<>]{6,}+(?=@)"),
)
RULES = BASE + ADDED


def version(rules: tuple[Rule, ...]) -> str:
    import hashlib

    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def address(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def _framed(text: Column, rule: Rule) -> Column:
    pattern = f"({rule.prefix})({rule.value})"
    plain = F.translate(text, "\x01\x02\x03", "\x04\x04\x04")
    parts = F.split(F.regexp_replace(plain, pattern, "\x01$1\x02$2\x03"), "\x01")
    return F.when(text.rlike(pattern), parts)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(sha, kind, rank, start, end) of the findings in ``blobs(sha, text)``; rank: the rule's number."""
    framed = F.array(*(F.struct(F.lit(k).alias("rank"), _framed(F.col("text"), r).alias("parts")) for k, r in enumerate(rules)))
    kinds = blobs.select("sha", F.explode(framed).alias("f")).where("f.parts is not null")
    parts = kinds.select("sha", "f.rank", F.posexplode("f.parts").alias("k", "part"))
    before, value, size = F.instr("part", "\x02"), F.instr("part", "\x03"), F.length("part")
    sized = parts.select("sha", "rank", "k", (value - before - 1).alias("value"), (value - 2).alias("length"), F.when(F.col("k") == 0, size).otherwise(size - 2).alias("size"))
    so_far = Window.partitionBy("sha", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.sum("size").over(so_far)).where("k > 0")
    least = F.array(*(F.lit(r.least) for r in rules))
    kind = F.array(*(F.lit(r.kind) for r in rules))
    kept = placed.where(F.col("value") >= F.get(least, F.col("rank")))
    return kept.select("sha", F.get(kind, F.col("rank")).alias("kind"), "rank", "start", (F.col("start") + F.col("length")).alias("end"))


class Ledger:
    """Paths, scanned blobs and findings of all runs, in a folder that all executors reach.

    A run's rows are a batch, a folder in each table. The note that a batch is whole is written last, and only
    whole batches are read: what a run that broke off has left is never seen.
    """

    TABLES = {
        "paths": "doc_id long, sha string, version long",
        "scanned": "sha string, rules string",
        "findings": "sha string, kind string, rank int, start long, end long, rules string",
    }

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def _file(self, name: str):
        file = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return file, file.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """The names of whole batches, one for each run, in order."""
        folder, fs = self._file("whole")
        return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def _read(self, table: str, batches: list[str] | None = None) -> DataFrame:
        some = self.batches() if batches is None else batches
        schema = self.TABLES[table]
        if not some:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{table}/{b}" for b in some))

    def scanned(self) -> DataFrame:
        return self._read("scanned")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Each finding once, also if two runs at a time have scanned its blob."""
        return self._read("findings").where(F.col("rules") == version(rules)).drop("rules").dropDuplicates(["sha", "rank", "start"])

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Keep the paths of ``docs(doc_id, sha, text)`` as a version and scan what is new in it; the paths."""
        mark, known = version(rules), self.batches()
        number = 1 + max((int(b.split("-")[0]) for b in known), default=0)
        batch = f"{number:08d}-{uuid.uuid4().hex}"
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "sha", F.lit(number).cast("long").alias("version")).write.parquet(f"{self.path}/paths/{batch}")
        texts = docs.select("sha", "text")
        seen = self._read("scanned", known).where(F.col("rules") == mark).select("sha").distinct()
        if not seen.isEmpty():
            texts = texts.join(seen, "sha", "left_anti")
        found = scan(texts.groupBy("sha").agg(F.first("text").alias("text")), rules).withColumn("rules", F.lit(mark))
        found.select("sha", "kind", "rank", "start", F.col("end").cast("long").alias("end"), "rules").write.parquet(f"{self.path}/findings/{batch}")
        own = self._read("paths", [batch])
        own.select("sha").distinct().join(seen, "sha", "left_anti").withColumn("rules", F.lit(mark)).write.parquet(f"{self.path}/scanned/{batch}")
        file, fs = self._file(f"whole/{batch}")
        fs.create(file).close()
        return own

    def history(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(doc_id, version, sha, kind, start, end) of the findings in every version of every path."""
        return self._read("paths").distinct().join(self.findings(rules), "sha").select("doc_id", "version", "sha", "kind", "start", "end")


def find(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The paths (doc_id, sha) of ``docs(doc_id, text)``, and each blob's findings as (sha, found: array of (start, rank, kind, end), in order)."""
    ledger = ledger or Ledger(docs.sparkSession)
    paths = ledger.update(docs.select("doc_id", address().alias("sha"), F.coalesce("text", F.lit("")).alias("text")), rules)
    blobs = ledger.findings(rules).groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("found"))
    return paths.drop("version"), materialise(blobs, "blobs")


def report(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans."""
    paths, blobs = find(docs, ledger, rules)
    base = len(BASE)
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long")
    digests = blobs.select(
        "sha",
        *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)),
        F.concat_ws(",", F.transform(F.filter("found", lambda s: s["rank"] < base), name)).alias("base"),
        F.concat_ws(",", F.transform("found", name)).alias("spans"),
    )
    joined = paths.join(digests, "sha", "left")
    zero = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return joined.select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[REDACTED]", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mask``, and ``n_chars``, if there, by the new length.

    Findings that overlap are replaced as one. Texts without a finding, null ones among them, stay as they are.
    """
    _, blobs = find(docs, ledger, rules)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), address().alias("sha"))
    text = F.col("row.text")

    def step(done: Column, s: Column) -> Column:
        more = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit(mask))
        return F.struct(F.when(s["start"] >= done["at"], more).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    spans = F.transform("found", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    joined = rows.join(blobs, "sha", "left").select("row", F.when(F.col("found").isNotNull() & text.isNotNull(), cut).alias("cut"))
    new = {"text": F.coalesce("cut", text), "n_chars": F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.length("cut")).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {"text": F.coalesce("cut", text)}
    return joined.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
