"""Text helpers: resolutions, motifs and restriction sites."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nucleotide codes (fixed values of the IUPAC notation).
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "N": "[ACGTN]", "R": "[AG]", "Y": "[CT]", "M": "[AC]", "K": "[GT]", "S": "[CG]",
    "W": "[AT]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]",
}
#: Common enzymes, cut marked by a bar (public facts); any other is passed as ``LEFT|RIGHT``.
ENZYMES = {
    "DpnII": "|GATC", "MboI": "|GATC", "Sau3AI": "|GATC", "HindIII": "A|AGCTT", "NcoI": "C|CATGG", "BglII": "A|GATCT",
    "EcoRI": "G|AATTC", "BamHI": "G|GATCC", "XhoI": "C|TCGAG", "MseI": "T|TAA", "HinfI": "G|ANTC", "DdeI": "C|TNAG",
    "NlaIII": "CATG|", "AluI": "AG|CT", "HaeIII": "GG|CC", "TaqI": "T|CGA", "Csp6I": "G|TAC", "HpaII": "C|CGG",
    "MspI": "C|CGG", "XbaI": "T|CTAGA", "SalI": "G|TCGAC", "NotI": "GC|GGCCGC", "KpnI": "GGTAC|C", "SacI": "GAGCT|C",
    "PstI": "CTGCA|G", "SphI": "GCATG|C", "NdeI": "CA|TATG", "RsaI": "GT|AC", "Tsp509I": "|AATT", "ApoI": "R|AATTY",
}
_BY_LOWER = {k.lower(): v for k, v in ENZYMES.items()}


def enzyme(name: str) -> tuple[str, str]:
    """(left, right) of a site by enzyme name in any case, or of a literal ``LEFT|RIGHT``."""
    site = name if "|" in name else _BY_LOWER[name.lower()]
    left, right = site.split("|")
    return left, right


def motif_regex(motif: str) -> str:
    return "".join(IUPAC[c] for c in motif.upper())


def complementary(sequence: str) -> str:
    """Reverse complement."""
    return sequence[::-1].translate(str.maketrans("ACGTNacgtn", "TGCANtgcan"))


def complementary_column(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTNacgtn", "TGCANtgcan"))


def repaired(name: str) -> str:
    """Site end after the overhang is filled: what a dangling read starts with."""
    left, right = enzyme(name)
    site = left + right
    return site[min(len(left), len(right)) :] if len(left) <= len(right) else site[len(right) :]


def filled_ends(name: str) -> tuple[str, str]:
    left, right = enzyme(name)
    site = left + right
    short, long = sorted((len(left), len(right)))
    return site[:long], site[short:]


def religated(names: list[str]) -> dict[tuple[str, str], str]:
    """Ligation product of every ordered pair of enzymes."""
    ends = {n: filled_ends(n) for n in names}
    return {(a, b): ends[a][0] + ends[b][1] for a, b in product(names, repeat=2)}


def resolution(text: str | int) -> int:
    """'100Kb' -> 100000."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kKmMgG]?)(?:bp?|B)?", str(text).strip())
    if m is None:
        raise ValueError(f"unknown resolution {text!r}")
    return int(float(m[1]) * {"": 1, "k": 1_000, "m": 1_000_000, "g": 1_000_000_000}[m[2].lower()])


def nicer(value: int, sep: str = " ", comma: str = "", decimals: int = 0) -> str:
    """1000000 -> '1 Mb': the largest unit that divides the value."""
    for unit, name in ((1_000_000_000, "Gb"), (1_000_000, "Mb"), (1_000, "kb")):
        if value >= unit and round(value / unit, decimals) * unit == value:
            number = f"{value / unit:,.{decimals}f}" if comma else f"{value / unit:.{decimals}f}"
            return f"{number.replace(',', comma)}{sep}{name}"
    return f"{value:,}".replace(",", comma) + sep + "bp"


def nicer_column(value: Column) -> Column:
    """The same as a column, without decimals."""
    part = lambda unit, name: F.when((value >= unit) & (value % unit == 0), F.concat(F.floor(value / unit).cast("string"), F.lit(f" {name}")))
    return F.coalesce(part(1_000_000_000, "Gb"), part(1_000_000, "Mb"), part(1_000, "kb"), F.concat(value.cast("string"), F.lit(" bp")))


def round_to(value: float, digits: int) -> float:
    return round(value, digits)
