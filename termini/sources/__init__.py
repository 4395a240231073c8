"""File sources: SAM text, BAM, contig index, FASTA, exclusion lists."""
