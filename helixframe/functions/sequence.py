"""Scalar functions over base sequences as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    """Reverse complement; case is kept, anything but A, C, G, T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca"))


def complement(seq: Column) -> Column:
    return F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca")


def is_sequence(seq: Column) -> Column:
    return seq.rlike("^[ACGTN]*$")


def longest_clean_run(seq: Column) -> Column:
    """The longest run without N; of equal ones the first."""
    return F.aggregate(F.split(seq, "N", -1), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))


def quality_mask(seq: Column, qual: Column, least: int) -> Column:
    """Bases whose quality byte is under least become N; the byte is taken as it is, without an offset."""
    bases = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.when(F.ascii(F.substring(qual, i, F.lit(1))) < least, F.lit("N")).otherwise(F.substring(seq, i, F.lit(1))))
    return F.when(F.length(seq) > 0, F.array_join(bases, "")).otherwise(seq)


def homopolymer_runs(seq: Column) -> Column:
    """All runs of one letter, in order."""
    return F.regexp_extract_all(seq, F.lit("((.)\\2*)"), F.lit(1))


def homopolymer_score(seq: Column) -> Column:
    """Sum over runs longer than two of what they have beyond two."""
    return F.aggregate(homopolymer_runs(seq), F.lit(0), lambda a, x: a + F.greatest(F.length(x) - 2, F.lit(0)))


def end_homopolymer(seq: Column, right: bool) -> Column:
    """Length of the run at one end."""
    return F.length(F.regexp_extract(seq, "(.)\\1*$" if right else "^(.)\\1*", 0))


def homopolymer_length(seq: Column, right: bool) -> Column:
    """Length of the run at one end and one more; with a second run of two or more beside it, both and one more; 0 for neither."""
    runs = homopolymer_runs(seq)
    n = F.size(runs)
    size = lambda i: F.coalesce(F.length(F.get(runs, (n - 1 - i) if right else F.lit(i))), F.lit(0))
    return F.when(size(1) > 1, size(0) + size(1) + 1).when(size(0) > 1, size(0) + 1).otherwise(0)


def overlap_length(left: Column, right: Column, least: int) -> Column:
    """Longest tail of left that is a head of right, at least `least` and with least under right's length; else 0."""
    found = F.filter(
        F.sequence(F.least(F.length(left), F.length(right)), F.lit(least), F.lit(-1)),
        lambda n: F.substring(left, F.length(left) - n + 1, n) == F.substring(right, F.lit(1), n),
    )
    possible = (F.lit(least) < F.length(right)) & (F.least(F.length(left), F.length(right)) >= least)
    return F.coalesce(F.when(possible, F.get(found, F.lit(0))), F.lit(0))


def end_trim(seq: Column, trim: Column) -> Column:
    """Length of the longest tail of seq that is a head of trim; 0 if none."""
    return F.when((F.length(seq) > 0) & (F.length(trim) > 0), F.coalesce(F.get(F.filter(F.sequence(F.least(F.length(seq), F.length(trim)), F.lit(1), F.lit(-1)), lambda n: F.substring(seq, F.length(seq) - n + 1, n) == F.substring(trim, F.lit(1), n)), F.lit(0)), F.lit(0))).otherwise(0)


def end_match(query: Column, target: Column, least: int, right: bool) -> Column:
    """(start, end, in target) of the longest tail (right) or head of query that occurs in target with at least `least` letters; else null."""
    piece = (lambda n: F.substring(query, F.length(query) - n + 1, n)) if right else (lambda n: F.substring(query, F.lit(1), n))
    sizes = F.filter(F.sequence(F.length(query), F.lit(least), F.lit(-1)), lambda n: F.contains(target, piece(n)))
    n = F.get(sizes, F.lit(0))
    start = F.call_function("instr", target, piece(n)) - 1
    return F.when((F.length(query) >= least) & n.isNotNull(), F.struct(start.alias("start"), (start + n).alias("end")))


def congruent(a: Column, b: Column, right: bool = True) -> Column:
    """Whether two extensions agree over the shorter length, from their left (right extensions) or right end."""
    n = F.least(F.length(a), F.length(b))
    return (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)) if right else (F.substring(a, F.length(a) - n + 1, n) == F.substring(b, F.length(b) - n + 1, n))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.substring(a, F.lit(1), F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n)))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ, over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), 1).otherwise(0))


#: Bases of three bits in a long, its sign left alone.
PACKED = 20


def packed(seq: Column) -> Column:
    """At most PACKED letters A, C, G, T and N as one long, three bits each."""
    return F.conv(F.translate(seq, "ACGTN", "01234"), 8, 10).cast("long")


def packed_differences(a: Column, b: Column) -> Column:
    """Places that differ between two packed pieces of one length."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(sum(1 << (3 * i) for i in range(PACKED)))))


def mask_from(seq: Column, start: Column) -> Column:
    """seq with N from a 0-based place on."""
    return F.concat(F.substring(seq, F.lit(1), start), F.repeat(F.lit("N"), (F.length(seq) - start).cast("int")))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; empty for shorter sequences."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


# --- read ids: bit 0 is the strand, bit 1 the mate


def reverse_id(read_id: Column) -> Column:
    return read_id.bitwiseXOR(F.lit(1))


def mate_id(read_id: Column, orientation: Column) -> Column:
    """Id of the mate on the strand that faces this one: 1 both forward, 2 inward, 3 outward; null for unpaired (0)."""
    return F.when(orientation == 1, read_id.bitwiseXOR(F.lit(2))).when(orientation.isin(2, 3), read_id.bitwiseXOR(F.lit(3)))


def mate_direction(read_id: Column, orientation: Column) -> Column:
    """1 where the mate lies to the right, 0 to the left, 2 without a mate."""
    reverse = read_id.bitwiseAND(F.lit(1)).cast("int")
    return F.when(orientation.isin(1, 2), 1 - reverse).when(orientation == 3, reverse).otherwise(2)


def library_min(size: Column) -> Column:
    return F.greatest(F.floor(size / 5) - 100, F.lit(1)).cast("int")


def library_max(size: Column) -> Column:
    return (F.floor(size * 1.2) + 200).cast("int")


# --- counts of next bases


def max_branch(counts: Column) -> Column:
    """Index of the largest of four counts; 4 where it is shared or nothing was counted."""
    top = F.array_max(counts)
    return F.when((top == 0) | (F.size(F.filter(counts, lambda x: x == top)) > 1), 4).otherwise(F.array_position(counts, top) - 1).cast("int")


def branch_count(counts: Column) -> Column:
    return F.size(F.filter(counts, lambda x: x > 0))
