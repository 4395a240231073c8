"""Merkle fingerprints of documents.

A text is a tree: document > sections > paragraphs (lines) > clauses. A clause ends behind .!?;:, with the spaces and tabs
that follow, which belong to it, so the clauses of a text spell it. Each clause is hashed (128 bits of SHA-256); the digest
of a paragraph, of a section and of the document (the root) is the SHA-256 of what its children's digests spell. A section
ends at a paragraph whose digest begins with 0 to 3, so an edit moves no boundary elsewhere. The fingerprint is the root
followed by the leaf digests in base64 with their structure ("," between clauses, ";" between paragraphs, "#" before
sections): inner digests follow from it.

Equal roots mean equal texts, different texts have different roots (but for a collision of 128-bit hashes). Where roots
differ, compared() descends: branches that are equal count whole, and only differing sections are opened into paragraphs,
only differing paragraphs into clauses.

Built-in functions only. A null text is empty; an empty text is one empty clause. Extra columns are not carried by
fingerprints() and op2(), and all kept by compared(), which uses internal names with the prefix __fp_. Repeated rows each
have their row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chained, same, whole_text

DIGEST = 22  # characters of 128 bits
CLAUSE_END = r"([.!?;:,][\x20\t]+)"


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""
    lines = F.split(F.regexp_replace(text, CLAUSE_END, "$1\x01"), "\n")
    leaf = lambda clause: F.left(F.base64(F.unhex(F.left(F.sha2(clause, 256), F.lit(32)))), F.lit(DIGEST))
    leaves = F.transform(lines, lambda line: F.array_join(F.transform(F.split(line, "\x01"), leaf), ","))
    ended = F.transform(leaves, lambda leaf: F.concat(leaf, F.when(F.left(F.sha2(leaf, 256), F.lit(1)).isin(*"0123"), "#").otherwise(";")))
    tree = F.regexp_replace(F.array_join(ended, ""), "[;#]$", "")
    # sha2 over the text itself would not be a Merkle root: the root hashes the sections' digests
    root = F.sha2(F.array_join(F.transform(F.split(tree, "#"), lambda section: F.sha2(F.array_join(F.transform(F.split(section, ";"), lambda leaf: F.sha2(leaf, 256)), ""), 256)), ""), 256)
    return F.concat(root, F.lit("#"), tree)


def root(fp: Column) -> Column:
    return F.left(fp, F.lit(64))


def sections(fp: Column) -> Column:
    """The sections of a fingerprint, each spelt by its leaves."""
    return F.split(F.substring(fp, F.lit(66), F.length(fp)), "#")


def _opened(branches: Column, mark: str) -> Column:
    return F.flatten(F.transform(branches, lambda x: F.split(x, mark)))


def _clauses(branches: Column) -> Column:
    """How many leaves spell the branches."""
    return F.aggregate(branches, F.lit(0), lambda n, x: n + ((F.length(x) + 1) / (DIGEST + 1)).cast("int"))


def _common(x: Column, y: Column) -> Column:
    """How many elements two arrays have in common from their beginning."""
    equal = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    stop = F.array_position(equal, F.lit(False)).cast("int")
    return F.when(stop == 0, F.size(equal)).otherwise(stop - 1)


def compared(rows: DataFrame, a: str, b: str, likeness: str, edit: str | None = None) -> DataFrame:
    """rows with the likeness of the fingerprints in columns a and b, 1 for equal roots: the share of clauses that both have,
    of all; equal branches count whole, and each branch once however often it is repeated.

    With `edit`, three more columns locate the edit: `{edit}_first`, the 0-based number of the first paragraph that differs
    (null for equal roots), `{edit}_removed` and `{edit}_added`, the paragraphs from there on that a has and b has
    instead. Sections are compared first, from both ends; only those between are opened."""
    t = lambda name: f"__fp_{name}"
    c = lambda name: F.col(t(name))
    # each step is a projection of its own, so that no step is computed twice
    rows = rows.withColumns({t("a"): sections(F.col(a)), t("b"): sections(F.col(b))})
    rows = rows.withColumns({t("same"): F.array_intersect(t("a"), t("b")), t("pa"): F.array_distinct(_opened(F.array_except(t("a"), t("b")), ";")), t("pb"): F.array_distinct(_opened(F.array_except(t("b"), t("a")), ";"))})
    rows = rows.withColumns({t("alike"): F.array_intersect(t("pa"), t("pb")), t("la"): F.array_distinct(_opened(F.array_except(t("pa"), t("pb")), ",")), t("lb"): F.array_distinct(_opened(F.array_except(t("pb"), t("pa")), ","))})
    rows = rows.withColumn(t("both"), F.size(F.array_intersect(t("la"), t("lb"))))
    rows = rows.withColumns({t("shared"): _clauses(c("same")) + _clauses(c("alike")) + c("both"), t("only"): F.size(t("la")) + F.size(t("lb")) - 2 * c("both")})
    rows = rows.withColumn(likeness, F.when(root(F.col(a)) == root(F.col(b)), 1.0).otherwise(c("shared") / (c("shared") + c("only"))))
    if edit:
        rows = rows.withColumn(t("front"), _common(c("a"), c("b")))
        rows = rows.withColumn(t("back"), F.least(_common(F.reverse(t("a")), F.reverse(t("b"))), F.least(F.size(t("a")), F.size(t("b"))) - c("front")))
        middle = lambda x: _opened(F.slice(x, c("front") + 1, F.size(x) - c("front") - c("back")), ";")
        rows = rows.withColumns({t("ma"): middle(c("a")), t("mb"): middle(c("b")), t("base"): F.size(_opened(F.slice(c("a"), F.lit(1), c("front")), ";"))})
        rows = rows.withColumn(t("first"), _common(c("ma"), c("mb")))
        rows = rows.withColumn(t("last"), F.least(_common(F.reverse(t("ma")), F.reverse(t("mb"))), F.least(F.size(t("ma")), F.size(t("mb"))) - c("first")))
        differ = lambda x: (F.size(x) - c("first") - c("last")).cast("long")
        rows = rows.withColumns({f"{edit}_first": F.when(root(F.col(a)) != root(F.col(b)), (c("base") + c("first")).cast("long")), f"{edit}_removed": differ(c("ma")), f"{edit}_added": differ(c("mb"))})
    return rows.drop(*[x for x in rows.columns if x.startswith("__fp_")])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint for each row."""
    return documents.select("doc_id", fingerprint(whole_text()).alias("fingerprint"))


def op2(documents: DataFrame) -> DataFrame:
    """The contract's digest. The order is descending doc_id (null last), then text hash; repeated rows (same doc_id and
    text) stand at one place of the order and each get the same result.

    Only ids, hashes and lengths are ordered. Each document's text then meets its own id once and sends on no more than
    the half that its neighbour takes over."""
    docs = documents.select("doc_id", whole_text().alias("text")).withColumn("h", F.xxhash64("text"))
    keys = docs.groupBy("doc_id", "h").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies"))
    chain = chained(keys, ["doc_id", "h"]).select(F.col("doc_id").alias("i"), F.col("h").alias("j"), F.col("succ.doc_id").alias("to_id"), F.col("succ.h").alias("to_h"), F.floor(F.col("succ.n") / 2).cast("int").alias("take"), "copies")
    sent = docs.join(chain, same(F.col("doc_id"), F.col("i")) & (F.col("h") == F.col("j")))
    sent = sent.select("to_id", "to_h", F.left("text", F.col("take")).alias("head"), fingerprint(F.col("text")).alias("next_fp"), "copies")
    if chain.where("copies > 1").limit(1).count():
        sent = sent.dropDuplicates(["to_id", "to_h"])
    n = F.length("text")
    rows = docs.join(sent.drop("copies"), same(F.col("doc_id"), F.col("to_id")) & (F.col("h") == F.col("to_h")))
    rows = rows.withColumn("edited", F.concat(F.left("text", n - F.floor(n / 2).cast("int")), "head"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fp")
    rows = compared(compared(rows, "fingerprint", "edited_fingerprint", "near_edited", "edit"), "fingerprint", "next_fp", "near_next")
    return rows.drop("next_fp")
