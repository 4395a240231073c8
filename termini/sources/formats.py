"""What a file is, from its first bytes, and errors for what a command can't take."""

from __future__ import annotations

from .bam import exists, index_of, opened

HEADER_TAGS = ("@HD", "@SQ", "@RG", "@PG", "@CO")


class InputFormatError(ValueError):
    pass


def sniff(head: bytes) -> str:
    """gzip (BAM is gzip), cram, sam or other."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:4] == b"CRAM":
        return "cram"
    try:
        line = head.decode().split("\n", 1)[0]
    except UnicodeDecodeError:
        return "other"
    return "sam" if line.startswith(HEADER_TAGS) or "\t" in line else "other"


def peek(path: str, n: int = 64) -> bytes:
    with opened(path) as f:
        return f.read(n)


def require_sam(path: str) -> None:
    kind = sniff(peek(path))
    if kind in ("gzip", "cram"):
        raise InputFormatError(f"{path} is binary ({kind}); this command reads SAM text")


def require_bam(path: str) -> None:
    kind = sniff(peek(path))
    if kind != "gzip":
        raise InputFormatError(f"{path} is not BAM but {kind}")


def require_indexed(fasta: str, bam: str) -> None:
    """The files of `extend`, in the order in which a user would mend them: a SAM file is told to be none before its
    missing index is."""
    for path in (fasta, bam):
        if not exists(path):
            raise InputFormatError(f"{path} does not exist")
    if not exists(f"{fasta}.fai"):
        raise InputFormatError(f"{fasta}.fai does not exist: make it with samtools faidx {fasta}")
    require_bam(bam)
    if index_of(bam) is None:
        raise InputFormatError(f"{bam}.bai does not exist: make it with samtools index {bam}")
