"""Feature vectors of variants in an assay window, as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_number
from ..functions.sequence import clipped, composition, kmer_frequencies, words_of

#: Regions of an assay window (fixed values).
REGIONS = ("exon", "upstr_intron", "downstr_intron")
BASES = ("A", "C", "G", "T")
#: Bases to either side of the variant, and letters of a word.
REACH, WORD = 10, 3


def _number(name: str) -> Column:
    return parse_number(F.col(name))


def _one_of(value: Column, choices) -> list[Column]:
    return [F.coalesce((value == c).cast("double"), F.lit(0.0)) for c in choices]


def variant_features(rows: DataFrame, name: str = "features") -> DataFrame:
    """``rows`` with an array of position, conservation, region, allele and word-frequency features.

    Distances are signed, from the variant to the acceptor and the donor of the
    exon; conservation is null where the source has none.  A position outside
    the sequence gives a null vector.
    """
    position, first, exon = _number("rel_position"), _number("intron1_len"), _number("exon_len")
    acceptor, donor = position - first, position - first - exon
    at = (position - 1).cast("int")
    sequence = F.upper("mutant_sequence")
    words = kmer_frequencies(clipped(sequence, at, REACH), words_of("".join(BASES), WORD))
    scalars = [position, _number("rel_position_scaled"), acceptor, donor, F.least(F.abs(acceptor), F.abs(donor)), exon, first, _number("intron2_len"), _number("phylop_score"), _number("mean_phastCons_score")]
    scalars += _one_of(F.col("region"), REGIONS) + _one_of(F.col("ref_allele"), BASES) + _one_of(F.col("alt_allele"), BASES)
    vector = F.concat(F.array(*scalars), words)
    return rows.withColumn(name, F.when((at >= 0) & (at < F.length(sequence)), vector))


def paired_composition(rows: DataFrame, alphabet: str = "ACGT", reference: str = "reference_sequence", mutant: str = "mutant_sequence", constant: bool = False, name: str = "features") -> DataFrame:
    """``rows`` with a struct ``reference, mutant`` of the compositions of two sequences; ``constant`` gives a zero for each, which tests a head without any sequence."""
    sides = {"reference": reference, "mutant": mutant}
    made = [(F.array(F.lit(0.0)) if constant else composition(F.col(c), alphabet)).alias(k) for k, c in sides.items()]
    return rows.withColumn(name, F.struct(*made))
