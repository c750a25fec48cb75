"""Secret scans over content-addressed blobs.

Every historical version of every path is reduced to the SHA-256 of its content. A ledger table records which
(blob, rule version) pairs were scanned and what was found; a scan reads only blobs whose pair is not in the ledger, and
findings are joined back to all paths and versions that hold the blob.

Which blobs repeat is found on their ids alone. A text whose blob surely stands once is scanned where it is read; only the others
are shuffled, to be one for each blob.

Defined results: a null content is the empty text; a null path keeps its row; repeated versions share a blob and each get its
findings; an empty table gives no rows; other columns are ignored (`scan`) or kept (`redact`), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, free_name, handed_out, join_dealt, kept, materialise, new_folder, scratch, sieve, sieve_flag, small_batches

#: The base kinds' patterns, in the order in which ties at one start are listed. Then what this method adds.
ASSIGN = r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A whole key block: up to the END line of the same label or, where the next five dashes are no such line, header fields and
#: base64 lines with a short last one (line breaks may be written as \n).
PEM = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:[^-]*(?:-(?!----)[^-]*)*-----END \1PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nrt])*(?:Proc-Type|DEK-Info):[^\n\\]*)*"
    r"(?:(?:\s|\\[nrt])*[A-Za-z0-9+/=]{16,}(?:(?:\s|\\[nrt])+[A-Za-z0-9+/=]{16,})*"
    r"(?:[^\S\n]*(?:\n|\\r\\n|\\n)[^\S\n]*[A-Za-z0-9+/=]+(?=[^\S\n]*(?:[\n\\]|\Z)))?)?)"
)
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"


@dataclass(frozen=True)
class Rule:
    """`group`: whose length must reach `least` (0: the whole match). `ignore_case`: ASCII letters only. `hints`: a text (in lower case, if case is ignored) without any of them has no match."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    ignore_case: bool = False
    hints: tuple[str, ...] = ()
    base: bool = True


RULES = (
    Rule("assign", ASSIGN, 6, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", ACCESS, 20, hints=("AKIA",)),
    Rule("hex", HEX, 24),
    Rule("pem", PEM, 1, hints=("PRIVATE KEY-----",), base=False),
    Rule("jwt", JWT, 1, hints=("eyJ",), base=False),
)


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.find = []
        for r in rules:
            # A run shorter than `least` can't pass, so for a plain repeated class the run is asked for at once.
            pattern = f"{r.pattern[:-1]}{{{r.least},}}" if r.kind == "hex" else r.pattern
            self.find.append(re.compile(pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points, in order."""
        out = []
        lower = text.lower()
        for k, (r, find) in enumerate(zip(self.rules, self.find, strict=True)):
            if r.hints and not any(h in (lower if r.ignore_case else text) for h in r.hints):
                continue
            for m in find.finditer(text):
                if m.end(r.group) - m.start(r.group) >= r.least:
                    out.append((m.start(), k, m.end()))
        out.sort()
        return out


def _scan_batches(rules: tuple[Rule, ...], version: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            found = []
            for text in b.column("content").to_pylist():
                found.append([{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, k, e in scanner.spans(text)])
            yield pa.RecordBatch.from_arrays(
                [b.column("blob_id").cast(pa.string()), pa.array([version] * b.num_rows, pa.string()), pa.array(found, kind)],
                names=["blob_id", "rules_version", "findings"],
            )

    return run


FINDINGS = "blob_id string, rules_version string, findings array<struct<kind:string,start:int,end:int,base:boolean>>"


class SecretLedger:
    """A ledger in folder `path` (in the shared folder if not given); `scan` may be called again with further versions."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.rules, self.version = spark, rules, rules_version(rules)
        self.path = path or new_folder(spark, "secret-ledger")
        small_batches(spark)

    def _exists(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def seen(self) -> DataFrame:
        """All ledger rows, of any rule version. A pair that two lost-and-repeated scans both wrote counts once."""
        if not self._exists():
            return self.spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (x.split(" ", 1) for x in FINDINGS.split(", "))) + " WHERE false")
        return self.spark.read.schema(FINDINGS).parquet(self.path).dropDuplicates(["blob_id", "rules_version"])

    @staticmethod
    def blobs(versions: DataFrame, content: str = "content") -> DataFrame:
        """(blob_id, content) of every row."""
        text = F.coalesce(F.col(content), F.lit(""))
        return versions.select(F.sha2(text.cast("binary"), 256).alias("blob_id"), text.alias("content"))

    def unseen(self, versions: DataFrame, content: str = "content", counts: DataFrame | None = None) -> DataFrame:
        """One row for each blob of `versions` that this rule version has not scanned. `counts`: (blob_id, n) of `versions`, if known."""
        blobs = self.blobs(versions, content)
        if self._exists():
            ids = blobs.select("blob_id").distinct().join(self.seen().where(F.col("rules_version") == self.version), "blob_id", "left_anti")
            ids = materialise(ids, "unseen")
            return sieve(blobs, F.col("blob_id"), ids).join(ids, "blob_id", "left_semi").dropDuplicates(["blob_id"])
        if counts is None:
            counts = blobs.groupBy("blob_id").agg(F.count("*").alias("n")).where("n > 1")
        marked = sieve_flag(blobs, F.col("blob_id"), materialise(counts.where("n > 1").select("blob_id"), "repeated"), "again")
        return marked.where("not again").drop("again").unionByName(marked.where("again").drop("again").dropDuplicates(["blob_id"]))

    def update(self, versions: DataFrame, content: str = "content", counts: DataFrame | None = None) -> None:
        """Scan what is unseen and add it to the ledger. Files appear by the writer's commit, so a failed scan leaves no rows."""
        with scratch(self.spark):
            found = self.unseen(versions, content, counts).mapInArrow(_scan_batches(self.rules, self.version), FINDINGS)
            found.write.mode("append").parquet(self.path)

    def scan(self, versions: DataFrame, key: str, content: str = "content") -> DataFrame:
        """(key, blob_id, findings) for every row of `versions`, findings in order of start."""
        with scratch(self.spark):
            rows = versions.select(F.col(f"`{key}`").alias("_key"), F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("blob_id"))
            rows = materialise(rows, "versions")
            counts = materialise(rows.groupBy("blob_id").agg(F.count("*").alias("n")).where("n > 1"), "counts")
            self.update(versions, content, counts)
            found = self.seen().where(F.col("rules_version") == self.version).select("blob_id", "findings")
            out = join_dealt(rows, found, "blob_id", F.col("_key"), "left", counts=counts)
            return kept(out.select(F.col("_key").alias(key), "blob_id", "findings"), "found")

    def redact(self, docs: DataFrame, content: str = "text", length: str = "n_chars") -> DataFrame:
        """`docs` with every found span replaced by [REDACTED:kind]; overlapping spans become one. The columns stay the same; one
        named as in `length`, if there is one, gets the new length of a changed text.

        Texts without a finding stay where they are: only rows whose blob may have one are joined with the findings.
        """
        names = docs.columns
        self.update(docs, content)
        found = self.seen().where((F.col("rules_version") == self.version) & (F.size("findings") > 0)).select("blob_id", "findings")
        blob, spans, flag, part = (free_name(names, n) for n in ("_blob", "_found", "_hit", "_part"))
        found = materialise(found.withColumnsRenamed({"blob_id": blob, "findings": spans}), "hits")
        id_ = F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256)
        marked = sieve_flag(docs.withColumn(blob, id_), F.col(blob), found.select(blob), flag)
        hit = marked.where(F.col(flag)).drop(flag)
        rows, many = dealt(hit, blob, F.monotonically_increasing_id(), HIT_ROWS, hit.groupBy(blob).agg(F.count("*").alias("n")), part)
        joined = rows.join(handed_out(found, blob, many, part), [blob, part], "left").select(*[F.col(f"`{c}`") for c in names], spans)
        changed = joined.mapInArrow(_redact_batches(names, content, length if length in names else None, spans), docs.schema)
        return marked.where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in names]).unionByName(changed)


#: Rows with one text that one task joins with its findings.
HIT_ROWS = 2_000


def redacted(text: str | None, found: list[dict] | None) -> str | None:
    """The gaps between spans, and a mark for each run of overlapping ones, named by its first."""
    if text is None or not found:
        return text
    parts, at = [], 0
    for x in found:
        if x["start"] >= at:
            parts += (text[at : x["start"]], f"[REDACTED:{x['kind']}]")
        at = max(at, x["end"])
    return "".join([*parts, text[at:]])


def _redact_batches(names: list[str], content: str, length: str | None, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(spans).to_pylist()
            texts = [redacted(t, f) for t, f in zip(b.column(content).to_pylist(), found, strict=True)]
            columns = {c: b.column(c) for c in names}
            columns[content] = pa.array(texts, columns[content].type)
            if length:
                old = columns[length]
                now = [len(t) if f and t is not None else n for t, f, n in zip(texts, found, old.to_pylist(), strict=True)]
                columns[length] = pa.array(now, pa.int64()).cast(old.type) if pa.types.is_integer(old.type) else old
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's digest columns from `scan`'s rows."""
    spans = F.coalesce(F.col("findings"), F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>"))

    def joined(xs):
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("_f", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.withColumn("_f", spans).select(
        key,
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(F.filter("_f", lambda x: x["base"])), 256).alias("base_sha256"),
        joined(F.col("_f")).alias("spans"),
    )


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    return digest_columns(SecretLedger(spark).scan(docs, "doc_id"))
