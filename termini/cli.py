"""Command line: `python -m termini filter|extract|extend`."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .functions import motifs as M
from .operators import classify as K
from .operators import extend as X
from .operators import stats as S
from .report import extraction, facts, html, markdown
from .report.words import bars
from .sinks import files
from .sources import formats, text
from .sources.bam import BamSource, exists

log = logging.getLogger("termini")


class CommandError(Exception):
    """What a command says before it ends with status 1."""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="termini", description="Reads that reach past contig ends.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, what: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=what, description=what)
        p.add_argument("--min-clip", type=int, default=1, help="bases past the contig end")
        p.add_argument("--max-break", type=int, default=50, help="unaligned bases between the clip and the contig end")
        p.add_argument("--min-anchor", type=int, default=100, help="aligned bases")
        p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
        p.add_argument("--logfile")
        return p

    p = command("filter", "Pass on the alignments that overhang a contig end.")
    p.add_argument("sam", nargs="?", default="-", help="a file; - is the standard input")
    p.add_argument("output", nargs="?", default="-", help="folder of the part files; - is the standard output")
    p.add_argument("--ref-idx", required=True)
    p.add_argument("--motifs")
    p.add_argument("--no-rev", action="store_true", help="without reverse complements")
    p.add_argument("--fuzzy", action="store_true", help="runs of a letter may be one shorter or longer")
    p.add_argument("--min-repeats", type=int, default=1)
    p.add_argument("--match-anywhere", action="store_true")
    p.add_argument("--keep-secondary", action="store_true")

    p = command("extract", "Write the overhanging reads of each contig end to a file.")
    p.add_argument("sam", nargs="?", default="-", help="a file; - is the standard input")
    p.add_argument("--ref-idx", required=True)
    p.add_argument("--extract-dir", default=".")
    p.add_argument("--prefix")
    p.add_argument("--min-mapq", type=int, default=0)
    p.add_argument("--keep-secondary", action="store_true")
    p.add_argument("--include-stats", action="store_true")
    p.add_argument("--count-motifs")
    p.add_argument("--fuzzy-count", action="store_true")
    p.add_argument("--buffer-size", type=int, default=1000, help="accepted; the engine sizes its own batches")
    p.add_argument("--output-format", choices=["fasta", "fastq"], default="fasta")
    p.add_argument("--report-stats", action="store_true")
    p.add_argument("--no-mask-overhangs", action="store_true")

    p = command("extend", "Extend contigs by their best overhangs.")
    p.add_argument("bam")
    p.add_argument("fasta")
    p.add_argument("--output-fasta")
    p.add_argument("--stats-report", help="a file; - is the standard output")
    p.add_argument("--html-report")
    p.add_argument("--html-max-reads", type=int, default=25)
    p.add_argument("--overhang-log", help="folder of the part files")
    p.add_argument("--outlier-threshold", type=float, default=3.5)
    p.add_argument("--min-overhangs", type=int, default=1)
    p.add_argument("--max-homopolymer", type=int, default=500)
    p.add_argument("--min-extension", type=int, default=1)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--count-motifs")
    p.add_argument("--fuzzy-count", action="store_true")
    p.add_argument("--screen-terminal-bases", type=int, default=0)
    p.add_argument("--exclude-contigs", default="")
    p.add_argument("--exclude-contigs-file")
    p.add_argument("--prefix", help="accepted and without effect")
    return top


def limits(a: argparse.Namespace) -> K.Limits:
    return K.Limits(a.min_clip, a.max_break, a.min_anchor, getattr(a, "min_mapq", 0), getattr(a, "keep_secondary", False))


def need(*paths: str) -> None:
    for path in paths:
        if not exists(path):
            raise CommandError(f"{path} does not exist")


def parent(path: str | None) -> None:
    """Makes the folder that a result goes to, and sees that it can be written."""
    if path and path != "-":
        folder = os.path.dirname(os.path.abspath(path))
        try:
            os.makedirs(folder, exist_ok=True)
        except OSError as e:
            raise CommandError(f"cannot make the folder of {path}: {e}") from e
        if not os.access(folder, os.W_OK | os.X_OK) or os.path.isdir(path) and not os.access(path, os.W_OK | os.X_OK):
            raise CommandError(f"{path} cannot be written")


def counted_motifs(words: str | None, fuzzy: bool) -> dict[str, str]:
    good, skipped = M.parse_motifs(words or "")
    for word in skipped:
        log.warning("motif %s is skipped: letters other than ACGT", word)
    return M.patterns(good, fuzzy) if good else {}


def sam_input(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers and rows of a SAM file or the standard input."""
    path = text.spooled(spark, sys.stdin.buffer) if path == "-" else path
    if "://" not in path:
        need(path)
    formats.require_sam(path)
    headers, rows = text.read_sam(spark, path)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    if text.undecodable(headers.select("value").union(rows.select("value"))):
        raise formats.InputFormatError(f"{path} holds lines that are not text; this command reads SAM text, for BAM use samtools view -h")
    return headers, rows


def run_filter(spark: SparkSession, a: argparse.Namespace) -> None:
    need(a.ref_idx)
    headers, rows = sam_input(spark, a.sam)
    calls = K.classify(rows.where("not malformed"), text.read_fai(spark, a.ref_idx), limits(a))
    found = M.patterns(M.parse_filter_motifs(a.motifs, a.no_rev), a.fuzzy, complements=False) if a.motifs else None
    how = (found, a.min_repeats, a.match_anywhere)
    n = K.counters(calls, rows.where("malformed"), *how).first()
    shown, more = text.flaws(rows)
    for reason, excerpt in shown:
        log.warning("a line is skipped (%s): %s", reason, excerpt)
    if more:
        log.warning("further lines like these are counted and not listed")
    if n.excluded_unknown_contig:
        raise CommandError(f"{n.excluded_unknown_contig:,} clipped alignments name a contig that {a.ref_idx} lacks")
    if n.processed and n.excluded_malformed == n.processed:
        raise formats.InputFormatError(f"none of the {n.processed:,} lines can be read as an alignment")
    kept = K.filtered(calls, *how)
    if a.output == "-":
        files.print_sam(headers, kept, sys.stdout)
    else:
        files.write_sam(headers, kept, a.output)
    names = [("processed", "alignments read"), ("kept", "clipped past a contig end"), ("both", "clipped past both ends"), *([("motif", "of these with a motif")] if found else []), ("removed", "removed")]
    names += [(f"excluded_{b}", f"removed, {b}") for b in K.BUCKETS if b != "unknown_contig"] + ([("excluded_motifs", "removed, motifs")] if found else [])
    for name, words in names:
        log.info("%s: %s", words, f"{n[name]:,}")
    tell_ends(calls)


def tell_ends(calls: DataFrame) -> None:
    """Logs the reads kept at each contig end, and how they are spread. A row for each contig with reads."""
    ends = K.kept_ends(calls).orderBy("contig").collect()
    for r in ends:
        log.info("%s: %s left, %s right", r.contig, f"{r.left_kept:,}", f"{r.right_kept:,}")
    counts = [n for r in ends for n in (r.left_kept, r.right_kept)]
    if counts:
        low, high = min(counts), max(counts)
        bins = min(10, high - low + 1)
        width = (high - low + 1) / bins
        place = [min(bins - 1, int((n - low) / width)) for n in counts]
        edges = [low + int(k * width) for k in range(bins)] + [high + 1]
        log.info("reads at %s contig ends:\n%s", f"{len(counts):,}", bars([(edges[k], max(edges[k], edges[k + 1] - 1), place.count(k)) for k in range(bins)]))


def headers_of(rows: DataFrame, a: argparse.Namespace, found: dict[str, str]) -> DataFrame:
    """header and seq of the sequences that extract writes."""
    tags = a.include_stats and a.output_format == "fastq"
    stats = [("mapq", "i", F.col("mapq")), ("clip_length", "i", F.col("clip_length")), ("overhang_length", "i", F.col("clip_length"))]
    if found:
        each = [F.concat(F.lit(f"'{name}': "), M.count(F.upper("clip_seq"), p).cast("string")) for name, p in found.items()]
        stats.append(("motif_counts", "Z", F.concat(F.lit("{"), F.concat_ws(", ", *each), F.lit("}"))))
    said = [F.concat(F.lit(f"{k}:{kind}:" if tags else f"{k}="), v.cast("string")) for k, kind, v in stats] if a.include_stats else []
    word = F.when(F.col("end") == "L", "left").otherwise("right")
    header = F.concat_ws(" ", "qname", F.concat_ws("_", F.lit("overhang"), word, "contig"), *said)
    seq = K.masked(a.no_mask_overhangs or a.output_format == "fastq")
    return rows.select("contig", "end", header.alias("header"), seq.alias("seq"), "line_no")


def run_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    need(a.ref_idx)
    contigs = text.read_fai(spark, a.ref_idx)
    rows = sam_input(spark, a.sam)[1].where("not malformed and pos is not null and mapq is not null")
    found, limit = counted_motifs(a.count_motifs, a.fuzzy_count), limits(a)
    calls = K.classify(rows, contigs, limit)
    ends = K.extracted(calls, limit, found or None).persist(StorageLevel.DISK_ONLY)
    parent(os.path.join(a.extract_dir, "x"))
    written = files.write_sequences(headers_of(ends, a, found), os.path.abspath(a.extract_dir), a.output_format == "fastq", a.prefix)
    log.info("%s sequences in %s files", f"{sum(written.values()):,}", f"{len(written):,}")
    if a.report_stats:
        buckets = {r.bucket: r.n for r in K.extract_buckets(calls, limit, found or None).collect()}
        with open(os.path.join(a.extract_dir, f"{a.prefix or 'extract'}_stats.txt"), "w") as out:
            out.write(extraction.render(rows.count(), buckets, *extraction.tally(ends, contigs)))


def run_extend(spark: SparkSession, a: argparse.Namespace) -> None:
    formats.require_indexed(a.fasta, a.bam)
    for path in (a.output_fasta, a.stats_report, a.html_report, a.overhang_log):
        parent(path)
    a.min_clip = max(1, a.min_clip)
    spark.dataSource.register(BamSource)
    contigs, sequences = text.read_fai(spark, a.fasta + ".fai"), text.read_fasta(spark, a.fasta)
    excluded = text.exclusions(spark, contigs, a.exclude_contigs, a.exclude_contigs_file)
    calls = K.classify(spark.read.format("bam").load(a.bam), contigs, limits(a))
    every = K.overhangs(calls, limits(a)).persist(StorageLevel.DISK_ONLY)
    backed = S.supported(S.contig_stats(every, contigs), a.min_overhangs).select("contig")
    overhangs = every.join(backed, "contig", "left_semi")
    if a.overhang_log:
        files.write_log(X.overhang_log(overhangs.orderBy("contig_ord", "end", "line_no")), a.overhang_log)
    allowed = overhangs.where(~F.col("contig").isin(excluded)) if excluded else overhangs
    plan = X.plan(X.best(allowed, a.min_extension, a.max_homopolymer), contigs).persist(StorageLevel.DISK_ONLY)
    applied = X.apply_extensions(plan, sequences).persist(StorageLevel.DISK_ONLY)
    found = counted_motifs(a.count_motifs, a.fuzzy_count)
    motifs = None
    if found:
        after = X.terminal_counts(X.grafted(plan, sequences) if a.dry_run else applied, "extended", found, a.screen_terminal_bases, False, False)
        motifs = X.motif_gain(X.terminal_counts(sequences, "seq", found, a.screen_terminal_bases, True, True), after)
    missing = [r.contig for r in contigs.join(sequences, "contig", "left_anti").orderBy("contig_ord").collect()]
    warnings = [f"{name} is in the index and not in {a.fasta}" for name in missing]
    if not a.dry_run:
        warnings += [r.warning for r in X.extension_warnings(plan, sequences).orderBy("contig_ord", "warning").collect()]
    for warning in warnings:
        log.warning(warning)
    told = facts.gather(overhangs, contigs, X.gains(plan, None if a.dry_run else applied), a.min_overhangs, a.outlier_threshold, motifs, excluded=excluded, warnings=warnings, dry_run=a.dry_run, window=a.screen_terminal_bases)
    shape = S.histogram(S.contig_stats(overhangs, contigs).select(F.explode(F.array("left_count", "right_count")).alias("reads")), "reads").orderBy("bin").collect()
    lows = [int(r.low) for r in shape]
    log.info("reads at contig ends:\n%s", bars([(low, max(low, nxt - 1), r.n) for low, nxt, r in zip(lows, [*lows[1:], lows[-1] + 1] if lows else [], shape, strict=True)]))
    if not a.dry_run:
        final = X.assembly(applied, contigs, sequences)
        if a.output_fasta:
            files.write_fasta(final, a.output_fasta)
        elif a.stats_report != "-":
            files.write_fasta(final, "/dev/stdout")
    page = markdown.render(told)
    if a.stats_report and a.stats_report != "-":
        with open(a.stats_report, "w") as out:
            out.write(page)
    else:
        (sys.stdout if a.stats_report else sys.stderr).write(page)
    if a.html_report:
        with open(a.html_report, "w") as out:
            out.write(html.render(told, facts.panels(overhangs, a.html_max_reads, sequences), list(found.values())))


RUN = {"filter": run_filter, "extract": run_extract, "extend": run_extend}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if a.logfile:
        parent(a.logfile)
        handlers.append(logging.FileHandler(a.logfile))
    logging.basicConfig(level=a.log_level, handlers=handlers, format="%(asctime)s %(levelname)s %(message)s", force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        RUN[a.command](spark or SparkSession.builder.getOrCreate(), a)
    except (CommandError, formats.InputFormatError, text.ExclusionError, text.SpoolError, M.MotifError) as e:
        log.error("%s", e)
        return 1
    return 0
