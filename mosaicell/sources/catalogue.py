"""Compounds, adducts and pathways to annotate ions with. They are defaults: every operator takes tables of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Adduct, charge, multiplicity, mass difference.
ADDUCTS = """
[M+H]+ 1 1 1.007276
[M+Na]+ 1 1 22.989218
[M+K]+ 1 1 38.963158
[M+NH4]+ 1 1 18.034374
[M+Li]+ 1 1 7.016003
[M+2H]2+ 2 1 1.007276
[M+H-H2O]+ 1 1 -17.003289
[M+H-NH3]+ 1 1 -16.019273
[M+ACN+H]+ 1 1 42.06004
[M+2Na-H]+ 1 1 44.97116
[M-H]- -1 1 -1.007276
[M+Cl]- -1 1 34.969402
[M+FA-H]- -1 1 44.997654
[M+Ac-H]- -1 1 59.013305
[M-H-H2O]- -1 1 -19.017841
[M+Br]- -1 1 78.918885
[M-2H]2- -2 1 -1.007276
"""

# Name, formula, neutral mass, class, subclass, HMDB id, class abbreviation, mode; - where there is none.
COMPOUNDS = """
PC(32:0) C40H80NO8P 733.5622 GP PC HMDB0000564 LPC both
PC(34:1) C42H82NO8P 759.5778 GP PC HMDB0007859 LPC both
PC(34:2) C42H80NO8P 757.5622 GP PC HMDB0008107 LPC both
PC(36:2) C44H84NO8P 785.5935 GP PC HMDB0008973 LPC both
PC(36:4) C44H80NO8P 781.5622 GP PC HMDB0011380 LPC both
PC(38:4) C46H84NO8P 809.5935 GP PC HMDB0011065 LPC both
PC(38:6) C46H80NO8P 805.5622 GP PC HMDB0013847 LPC both
PC(36:1) C44H86NO8P 787.6091 GP PC HMDB0010383 LPC both
PC(34:0) C42H84NO8P 761.5935 GP PC HMDB0015659 LPC both
PC(38:5) C46H82NO8P 807.5778 GP PC HMDB0005372 LPC both
PC(40:6) C48H84NO8P 833.5935 GP PC HMDB0010983 LPC both
PC(40:4) C48H88NO8P 837.6248 GP PC HMDB0010380 LPC both
PC(16:0/0:0) C24H50NO7P 495.3353 GP LPC HMDB0010382 LPC both
PC(18:0/0:0) C26H54NO7P 523.3666 GP LPC HMDB0010386 LPC both
PC(18:1/0:0) C26H52NO7P 521.3510 GP LPC HMDB0002815 LPC both
PE(36:4) C41H74NO8P 739.5153 GP PE HMDB0009398 LPE both
PE(38:4) C43H78NO8P 767.5466 GP PE HMDB0009404 LPE both
PE(38:6) C43H74NO8P 763.5153 GP PE HMDB0009405 LPE both
PE(34:1) C39H76NO8P 717.5309 GP PE HMDB0009384 LPE both
PE(36:2) C41H78NO8P 743.5466 GP PE HMDB0009397 LPE both
PE(34:0) C39H78NO8P 719.5466 GP PE HMDB0009383 LPE both
PE(40:6) C45H78NO8P 791.5466 GP PE HMDB0009410 LPE both
PE(16:0/0:0) C21H44NO7P 453.2883 GP LPE HMDB0011503 LPE both
PE(18:0/0:0) C23H48NO7P 481.3196 GP LPE HMDB0011483 LPE both
SM(d18:1/16:0) C39H79N2O6P 702.5668 SP SM HMDB0001348 SM both
SM(d18:1/18:0) C41H83N2O6P 730.5981 SP SM HMDB0001348 SM both
SM(d18:1/24:1) C47H93N2O6P 812.6763 SP SM HMDB0001348 SM both
SM(d18:1/24:0) C47H95N2O6P 814.6920 SP SM HMDB0001348 SM both
Cer(d18:1/16:0) C34H67NO3 537.5121 SP Cer HMDB0004949 Cer both
Cer(d18:1/18:0) C36H71NO3 565.5434 SP Cer HMDB0006106 Cer both
Cer(d18:1/24:1) C42H81NO3 647.6217 SP Cer HMDB0006107 Cer both
Cer(d18:1/24:0) C42H83NO3 649.6373 SP Cer HMDB0004949 Cer both
TG(16:0/16:0/16:0) C51H98O6 806.7341 GL TG HMDB0005356 TG pos
TG(16:0/18:1/18:1) C55H102O6 858.7654 GL TG HMDB0005357 TG pos
TG(18:0/18:1/18:1) C57H106O6 886.7967 GL TG HMDB0005375 TG pos
PS(34:1) C40H76NO10P 761.5231 GP PS HMDB0008185 LPS neg
PS(36:1) C42H80NO10P 789.5544 GP PS HMDB0008239 LPS neg
PS(38:4) C44H78NO10P 811.5231 GP PS HMDB0008388 LPS neg
PI(34:1) C43H79O13P 834.5295 GP PI HMDB0009783 LPI neg
PI(36:2) C45H81O13P 860.5452 GP PI HMDB0009783 LPI neg
PI(38:4) C47H83O13P 886.5608 GP PI HMDB0009783 LPI neg
FA(16:0) C16H32O2 256.2402 FA FA HMDB0000220 FA neg
FA(18:0) C18H36O2 284.2715 FA FA HMDB0000827 FA neg
FA(18:1) C18H34O2 282.2559 FA FA HMDB0000207 FA neg
FA(20:4) C20H32O2 304.2402 FA FA HMDB0001043 FA neg
FA(22:6) C22H32O2 328.2402 FA FA HMDB0002183 FA neg
Cholesterol C27H46O 386.3549 ST ST HMDB0000067 ST both
Cholesteryl ester(18:1) C45H78O2 670.5966 ST SE HMDB0010359 SE pos
ATP C10H16N5O13P3 506.9957 NuA NuA HMDB0000538 - both
ADP C10H15N5O10P2 427.0126 NuA NuA HMDB0001341 - both
NAD+ C21H27N7O14P2 663.1096 Vit CoE HMDB0000902 - both
Glutathione C10H17N3O6S 307.0838 AA Pep HMDB0000125 - neg
L-Glutamine C5H10N2O3 146.0691 AA AA HMDB0000641 - both
L-Tryptophan C11H12N2O2 204.0899 AA AA HMDB0000929 - both
Glucose C6H12O6 180.0634 Sug Sug HMDB0000122 - neg
Cholesterol C27H46O 386.3549 ST ST HMDB0000067 ST both
"""

# Subclass and its pathways.
PATHWAYS = """
PC: Glycerophospholipid metabolism; Membrane composition
PE: Glycerophospholipid metabolism; Membrane composition; Autophagy
PS: Glycerophospholipid metabolism; Apoptosis signalling
PI: Glycerophospholipid metabolism; PI3K/Akt signalling
SM: Sphingolipid metabolism; Membrane rafts
Cer: Sphingolipid metabolism; Apoptosis signalling; Ceramide signalling
TG: Triacylglycerol metabolism; Lipid storage
FA: Fatty acid metabolism; Beta-oxidation
LPC: Lysophospholipid signalling; Inflammation
ST: Sterol metabolism; Membrane fluidity
SE: Cholesterol esterification; Lipid storage
NuA: Purine metabolism; Energy metabolism
CoE: TCA cycle; Redox metabolism
"""


def compound_rows() -> list[tuple]:
    """(seq, name, formula, neutral_mass, class, subclass, hmdb, lipidmaps, mode)."""
    out = []
    for k, line in enumerate(COMPOUNDS.strip().splitlines()):
        name, formula, mass, kind, sub, hmdb, maps, mode = line.rsplit(" ", 7)
        out.append((k, name, formula, float(mass), kind, sub, hmdb, maps.replace("-", ""), mode))
    return out


def adduct_rows() -> list[tuple]:
    """(adduct_seq, adduct, charge, mult, delta)."""
    return [(k, a, int(c), int(m), float(d)) for k, (a, c, m, d) in enumerate(line.split() for line in ADDUCTS.strip().splitlines())]


def pathway_rows() -> list[tuple]:
    """(subclass, pathways)."""
    return [(sub, rest.strip().split("; ")) for sub, rest in (line.split(":", 1) for line in PATHWAYS.strip().splitlines())]


def compounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(compound_rows(), "seq int, name string, formula string, neutral_mass double, class string, subclass string, hmdb string, lipidmaps string, mode string")


def adducts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(adduct_rows(), "adduct_seq int, adduct string, charge int, mult int, delta double")


def pathways(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pathway_rows(), "subclass string, pathways array<string>")


def markers(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Query peaks (query_id, mz) some ppm off the index's masses, on both sides of the usual tolerances."""
    offsets = F.array(*map(F.lit, (-12.0, -6.0, -4.9, 0.0, 4.9, 6.0, 12.0)))
    return (index.select("seq", "adduct_seq", "obs_mz", F.posexplode(offsets).alias("k", "e"))
            .select((F.col("seq").cast("long") * 1000 + F.col("adduct_seq") * 10 + F.col("k")).alias("query_id"), (F.col("obs_mz") * (1 + F.col("e") * 1e-6)).alias("mz")))
