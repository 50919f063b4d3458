"""Column functions on sequences, qualities, CIGAR strings and overlaps; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_bases(data: Column) -> Column:
    return F.upper(data)


def reverse_complement(data: Column) -> Column:
    """A and T, C and G change places, other letters stay, and the whole is reversed."""
    return F.reverse(F.translate(data, "ATCG", "TAGC"))


def reverse_quality(quality: Column) -> Column:
    return F.reverse(quality)


def known_quality(quality: Column) -> Column:
    """The quality, or null if each of its bases has the lowest ('!')."""
    return F.when(quality.rlike("[^!]"), quality)


def mean_quality(quality: Column) -> Column:
    """Mean of the Phred scores (offset 33); null for an empty string."""
    total = F.aggregate(F.split(quality, ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", 0).otherwise(F.ascii(c) - 33))
    return F.when(F.length(quality) > 0, total / F.length(quality))


def oriented(data: Column, strand: Column) -> Column:
    return F.when(strand, reverse_complement(data)).otherwise(data)


def slice_of(text: Column, begin: Column, end: Column) -> Column:
    """Characters [begin, end), counted from 0, of a text in ASCII; as bytes, so that a slice far into it costs no walk through what is before."""
    return text.cast("binary").substr((begin + 1).cast("int"), (end - begin).cast("int")).cast("string")


def cigar_lengths(cigar: Column) -> Column:
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(1)), lambda x: x.cast("long"))


def cigar_codes(cigar: Column) -> Column:
    return F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(2))


def _sum_of(cigar: Column, codes: str) -> Column:
    own = F.zip_with(cigar_lengths(cigar), cigar_codes(cigar), lambda n, c: F.when(c.isin(*codes), n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)


def clip_start(cigar: Column) -> Column:
    """Length of the first operation if that is a clip, else 0; later clips do not count."""
    return F.coalesce(F.regexp_extract(cigar, r"^(\d+)[SH]", 1).try_cast("long"), F.lit(0).cast("long"))


def query_span(cigar: Column) -> Column:
    return _sum_of(cigar, "M=XI")


def target_span(cigar: Column) -> Column:
    return _sum_of(cigar, "M=XDN")


def clipped(cigar: Column) -> Column:
    return _sum_of(cigar, "SH")


def query_range(cigar: Column, strand: Column) -> tuple[Column, Column, Column]:
    """Begin, end and length of the query in forward coordinates."""
    length = clipped(cigar) + query_span(cigar)
    begin = clip_start(cigar)
    end = begin + query_span(cigar)
    return F.when(strand, length - end).otherwise(begin), F.when(strand, length - begin).otherwise(end), length


def overlap_length(q_span: Column, t_span: Column) -> Column:
    return F.greatest(q_span, t_span)


def overlap_error(q_span: Column, t_span: Column) -> Column:
    """1 - shorter / longer span; NaN if both are zero."""
    longest = F.greatest(q_span, t_span)
    return F.when(longest == 0, F.lit(float("nan"))).otherwise(1 - F.least(q_span, t_span) / F.when(longest != 0, longest))


def too_wrong(error: Column, threshold: float) -> Column:
    """Whether the error is above the threshold; NaN is not (as a plain comparison would have it)."""
    return ~F.isnan(error) & (error > threshold)


def fixed6(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator with six decimals, as C's %f prints a double: halves go to the even digit."""
    return F.bround((numerator / denominator).cast("decimal(20,15)"), 6).cast("string")


def tag(name: Column, length: Column, coverage: Column, polished: Column, windows: Column, fragment: bool) -> Column:
    return F.concat(name, F.lit("r" if fragment else ""), F.lit(" LN:i:"), length.cast("string"), F.lit(" RC:i:"), coverage.cast("string"), F.lit(" XC:f:"), fixed6(polished, windows))
