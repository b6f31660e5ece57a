"""Identifier, lineage, calendar and sequence functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of a sample identifier and its letters.
SAMPLE_ID = "^(e[0-9]+_)?([TFSV])?([0-9]+)(PR|P|D|S)r([0-9]+)"
CAMPAIGN = {"": 1, "T": 2, "F": 3, "S": 4, "V": 5}
POSITION = {"S": "Surface", "D": "Deep", "P": "Rhizosphere", "PR": "Rhizosphere"}
RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
PREFIXES = "dpcofgs"

#: Amino acids of translation table 11 in the order of codons TTT, TTC, TTA, TTG, TCT ...
BASES = "TCAG"
TABLE_11 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS_11 = ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")


def _lookup(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def sample_id(text: Column) -> Column:
    """(campaign, site, position, replicate) of an identifier, null where it has another shape."""
    t = F.replace(text, F.lit(" "), F.lit(""))
    part = lambda i: F.regexp_extract(t, SAMPLE_ID, i)
    made = F.struct(
        _lookup(CAMPAIGN, part(2)).alias("campaign"),
        part(3).try_cast("int").alias("site"),
        _lookup(POSITION, part(4)).alias("position"),
        part(5).try_cast("int").alias("replicate"),
    )
    return F.when(t.rlike(SAMPLE_ID), made)


def lineage(text: Column) -> Column:
    """The seven ranks of a semicolon lineage; blank, NA and nan are missing."""
    parts = F.split(text, ";")
    one = lambda i: F.trim(F.get(parts, F.lit(i)))
    return F.struct(*[F.when(~one(i).isin("", "NA", "nan"), one(i)).alias(r) for i, r in enumerate(RANKS)])


def tagged_lineage(text: Column) -> Column:
    """The ranks of a lineage whose tokens carry d__ ... s__; the bare tag where one is absent."""
    tokens = F.transform(F.split(text, ";"), lambda x: F.trim(x))
    rank = lambda p: F.coalesce(F.get(F.filter(tokens, lambda x: x.startswith(f"{p}__")), F.lit(0)), F.lit(f"{p}__"))
    return F.struct(*[rank(p).alias(r) for p, r in zip(PREFIXES, ("domain", *RANKS[1:]))])


def group_or_singleton(group: Column, member: Column) -> Column:
    """The group's name; an unclassified group becomes a singleton of its member."""
    g = F.trim(group)
    return F.when(g.isNull() | g.isin("", "g__", "unclassified"), F.concat(F.lit("unclassified_singleton::"), member)).otherwise(g)


def well(position: Column) -> Column:
    """Row and column of a plate well such as C7, row A being 0."""
    return F.struct((F.ascii(F.substring(position, 1, 1)) - 65).alias("row"), F.substring(position, 2, 2).try_cast("int").alias("column"))


def meteorological_year(date: Column) -> Column:
    """The year of a date's season: December counts to the next year."""
    return F.year(date) + (F.month(date) == 12).cast("int")


def remapped_date(date: Column, years: dict[int, int]) -> Column:
    """The date with month and day kept in the mapped meteorological year; null where no year is mapped; raises on 29 February without one."""
    year = _lookup(years, meteorological_year(date)) - (F.month(date) == 12).cast("int")
    return F.when(year.isNotNull(), F.make_date(year, F.month(date), F.day(date)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km on a sphere of radius 6371 km."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 12742.0 * F.asin(F.sqrt(h))


def covariance_kernel(distance: Column, kind: str, length: float) -> Column:
    """Exponential, Matern 3/2 or Matern 5/2 correlation at a distance."""
    r = distance / F.lit(float(length))
    if kind == "exponential":
        return F.exp(-r)
    if kind == "matern32":
        return (1 + 3**0.5 * r) * F.exp(-(3**0.5) * r)
    if kind == "matern52":
        return (1 + 5**0.5 * r + 5 * r * r / 3) * F.exp(-(5**0.5) * r)
    raise ValueError(kind)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgtNn", "TGCAtgcaNn"))


def codon_map() -> Column:
    codons = [a + b + c for a in BASES for b in BASES for c in BASES]
    return F.create_map(*[F.lit(x) for kv in zip(codons, TABLE_11) for x in kv])


def translate_cds(seq: Column, five_prime_complete: Column) -> Column:
    """Status, protein and internal stops of a coding sequence under table 11.

    A complete 5' end with an admissible start gives M; unknown codons are X;
    one terminal stop is removed.
    """
    s = F.upper(seq)
    n = F.floor(F.length(s) / 3).cast("int")
    codon = lambda i: F.substring(s, F.lit(1) + i * 3, F.lit(3))
    table = codon_map()
    aa = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(table[codon(i)], F.lit("X")))
    raw = F.array_join(aa, "")
    first = F.when(five_prime_complete & F.substring(s, 1, 3).isin(*STARTS_11), F.concat(F.lit("M"), F.substring(raw, 2, 1 << 30))).otherwise(raw)
    protein = F.regexp_replace(first, "\\*$", "")
    ok = (F.length(s) % 3 == 0) & (F.length(s) > 0)
    return F.struct(
        F.when(ok, "ok").otherwise("length_not_multiple_of_three").alias("status"),
        F.when(ok, protein).alias("protein"),
        F.when(ok, F.length(protein) - F.length(F.replace(protein, F.lit("*"), F.lit("")))).alias("internal_stops"),
    )


def clean_protein(aa: Column) -> Column:
    """Status and sequence of a candidate protein: one terminal stop is removed, others and blanks are refused."""
    core = F.regexp_replace(aa, "\\*$", "")
    status = (
        F.when(aa.isNull() | (aa == ""), "missing").when(aa.rlike("\\s"), "whitespace").when(core.contains("*"), "internal_stop").otherwise("ok")
    )
    return F.struct(status.alias("status"), F.when(status == "ok", core).alias("sequence"))
